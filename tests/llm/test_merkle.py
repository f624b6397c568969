import hashlib
import random
import zlib

import pytest

from tessarine.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def climb(levels, at):
    for row in levels[:-1]:
        start = at // 3 * 3
        yield row[start:at], row[at + 1 : start + 3]
        at //= 3


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = None if text is None else text.replace("\n", "")
        own = leaf(doc_id, source, lang, n, text)
        groups.setdefault(source, []).append((doc_id, own, leaf(doc_id, source, lang, n, other) if hit else own))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: grown([r[1] for r in groups[s]]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (doc_id, own, other) in enumerate(groups[s]):
            path = [*climb(trees[s], at), *climb(top, place)]
            node = other
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("levels", [8, 2, 1])
def test_manifest_is_brute_force(make_docs, levels):
    draw = random.Random(levels)
    sources = ["a"] * 12 + ["b", "é", "Z", "", None, *(f"s{i}" for i in range(30))]
    rows = [(i, draw.choice(["one\ntwo", "plain", "", None, "é\n"]) , draw.choice(["en", None]), draw.choice(sources)) for i in range(150)]
    rows += [(None, "no id\n", "en", "a"), (None, "other", None, None), rows[0], rows[0], (999, "long line\n" * 60_000, "en", "a")]
    docs = make_docs(rows, extra=("tree", "node", "at", "block", "root"))
    want = brute([(*r, len(r[1]) if r[1] is not None else None) for r in rows])
    got = found(merkle.manifest(docs, *merkle.cut_newlines(), levels=levels))
    assert got == want
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_empty_table_and_single_leaf(make_docs):
    assert merkle.manifest(make_docs([]), *merkle.cut_newlines()).count() == 0
    assert found(merkle.manifest(make_docs([(1, "x", None, "s")]), *merkle.cut_newlines())) == brute([(1, "x", None, "s", 1)])


def test_versions_share_untouched_nodes():
    tree = merkle.Tree([sha(str(i)) for i in range(20)], 3)
    path = tree.path(7)
    assert merkle.copied(tree.rows[0][7], path) == [tree.rows[k][7 // 3**k] for k in range(4)]
    changed = merkle.copied(sha("new"), path)
    whole = merkle.Tree([sha("new") if i == 7 else sha(str(i)) for i in range(20)], 3)
    assert [whole.rows[k][7 // 3**k] for k in range(4)] == changed
    others = [(k, i) for k in range(4) for i in range(len(tree.rows[k])) if i != 7 // 3**k]
    assert all(tree.rows[k][i] == whole.rows[k][i] for k, i in others)


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert found(queries.QUERIES["op11_merkle"](spark, sf)) == brute([tuple(r) for r in docs.collect()])
