import math
import random

import numpy as np
from pyspark.sql import types as T

from tessarine.llm import embedding

KINDS = {
    kind: T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind())), T.StructField("label", T.IntegerType()),
        T.StructField("rep", T.StringType()), T.StructField("n", T.StringType()),
    ])
    for kind in (T.FloatType, T.DoubleType)
}


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows):
    n, links = len(rows), [[] for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and good(v) and good(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def fixture(near=0.08):
    draw = np.random.default_rng(8)
    pick = random.Random(8)
    rows = []
    for i in range(260):
        if rows and pick.random() < 0.5:
            base = pick.choice(rows)
            v = np.array(base[1]) + draw.normal(size=16) * near * np.linalg.norm(base[1]) / 4
            rows.append((i, [float(np.float32(x)) for x in v], base[2]))
        else:
            rows.append((i, [float(np.float32(x)) for x in draw.normal(size=16)], pick.randrange(3)))
    one = rows[0][1]
    rows += [(900 + i, one, rows[0][2]) for i in range(6)] + [(950, [2 * x for x in one], rows[0][2]), (951, one, None)]
    rows += [(952, None, 1), (953, [], 1), (954, [0.0] * 16, 1), (955, [0.0] * 16, 1), (956, [math.nan] * 16, 1), (957, [math.inf] * 16, 1)]
    return rows + [(958, [None] + [1.0] * 15, 1), (959, one[:8], rows[0][2]), (None, one, rows[0][2]), rows[5], (None, None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_groups_match_brute_force(spark, monkeypatch):
    rows = fixture()
    for kind, tile, cells in ((T.FloatType, 2048, 1024), (T.DoubleType, 7, 1024)):
        monkeypatch.setattr(embedding, "TILE", tile)
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS[kind])
        assert rows_of(embedding.embedding_groups(df)) == expected(rows)


def test_probes_and_table_distances_lose_no_link():
    draw = np.random.default_rng(1)
    base = draw.normal(size=(3000, 32))
    base[1500:] = base[:1500] + draw.normal(size=(1500, 32)) * 0.1
    units = base / np.linalg.norm(base, axis=1)[:, None]
    index = embedding.Index(units[::2], 60)
    cell, codes, off = index.place(units)
    probes = index.probes(units, cell, 0.2)
    near = np.argwhere(units @ units.T >= 0.98)
    assert len(near) > 4000 and probes.sum() < 60 * 3000 / 2
    for i, j in near:
        assert probes[i, cell[j]]
        assert index.table_distances(units[i : i + 1], cell[j], codes[j : j + 1])[0, 0] <= 0.2 + off[j] + 1e-6


def test_without_vectors(spark):
    empty = spark.createDataFrame([], KINDS[T.FloatType])
    assert embedding.embedding_groups(empty).count() == 0
    none = spark.createDataFrame([(1, None, 2, "", ""), (2, [0.0], 2, "", "")], KINDS[T.FloatType])
    assert rows_of(embedding.embedding_groups(none)) == [(1, 0, 1, True), (2, 0, 2, True)]
