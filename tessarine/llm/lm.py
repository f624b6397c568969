"""Log-bilinear language model: noise-contrastive training in numpy, normalised scores of whole texts.

A token is a word (A-Z in lower case) or the end of a text. The most frequent tokens are classes of
their own; the other words fall into SUFFIXES classes by their last letters, and within such a
class have probability by count, with a Good-Turing share left for words never seen. With r and q the
vectors of the class before and of the class itself, log P(class | before) is r.q + b less the
logarithm of the sum over all classes. All unseen words are one symbol, so that the probabilities of
the V known tokens and that symbol sum to 1 after any token.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import in_training, pieces, stored, words

OWN_CLASSES = 2048
SUFFIXES = 256
KNOWN_WORDS = 1 << 18
WIDTH = 32
SHARDS = 16
EPOCHS = 5
ROUNDS = 8
NOISE = 20
RATE = 0.1
COUNTED = 400_000
SCORED = 1 << 16
END = b""


def suffix(word: bytes) -> int:
    """Suffix class of a word: its last three bytes, hashed."""
    return zlib.crc32(word[-3:]) % SUFFIXES


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, suffix, n) over all texts, the end of a text being the empty token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            arrays = [pa.array(list(seen), pa.binary()), pa.array([suffix(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["token", "suffix", "n"])

        seen = Counter()
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                seen.update(words(text))
                seen[END] += 1
            if len(seen) > COUNTED:
                yield flush()
                seen = Counter()
        yield flush()

    return docs.mapInArrow(count, "token binary, suffix int, n long").groupBy("token", "suffix").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the tokens: at most about KNOWN_WORDS of them, the most frequent, by number.

    `cls` and `n` are class and count of those tokens; `mass`, `unseen` are, by suffix class, the count of its
    words and the share left for unseen ones; `frequency` is the count of each class.
    """

    tokens: list[bytes]
    cls: np.ndarray
    n: np.ndarray
    own: int
    mass: np.ndarray
    unseen: np.ndarray
    frequency: np.ndarray
    total: int
    distinct: int

    def lookup(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals and the frequent tokens of a counted table; at most about KNOWN_WORDS rows reach the driver.

    The least count that keeps the number within the bound is found on a histogram of eighths of
    powers of two.
    """
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n")).toArrow().to_pylist()
    total, distinct = sum(s["n"] for s in steps), sum(s["tokens"] for s in steps)
    least, held = None, 0
    for s in sorted(steps, key=lambda s: -s["step"]):
        held += s["tokens"]
        if held > KNOWN_WORDS:
            break
        least = s["step"]
    frequent = counts.where((step >= least) | (F.length("token") == 0)) if least is not None else counts.limit(0)
    found = frequent.select("token", "n").toArrow().to_pylist()
    found.sort(key=lambda r: (r["token"] != END, -r["n"], r["token"]))
    found = found or [{"token": END, "n": 0}]
    own = min(OWN_CLASSES, len(found))
    tokens = [bytes(r["token"]) for r in found]
    cls = np.array([i if i < own else own + suffix(t) for i, t in enumerate(tokens)], dtype=np.int32)
    n = np.array([r["n"] for r in found], dtype=np.int64)
    by_suffix = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"))
    mass, once = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in by_suffix.toArrow().to_pylist():
        mass[r["suffix"]], once[r["suffix"]] = r["n"], r["once"]
    for t, c in zip(tokens[:own], n[:own], strict=True):
        mass[suffix(t)] -= c
        once[suffix(t)] -= c == 1
    unseen = np.where(mass > 0, np.clip((once + 0.5) / (mass + 1), 0, 0.5), 1.0)
    return Vocabulary(tokens, cls, n, own, mass, unseen, np.concatenate([n[:own], mass]) + 0.5, total, distinct)


class Model:
    """Vectors before (`r`) and of a class (`q`), and biases (`b`), each with the squared steps taken so far."""

    def __init__(self, frequency: np.ndarray, width: int = WIDTH, seed: int = 11):
        draw = np.random.default_rng(seed)
        noise = (frequency / frequency.sum()).astype(np.float32)
        self.noise = noise
        self.r, self.q = (draw.normal(size=(2, len(noise), width)) * 0.1).astype(np.float32)
        self.b = np.log(noise)
        self.taken = [np.full_like(x, 1e-6) for x in (self.r, self.q, self.b)]

    def copy(self) -> Model:
        other = object.__new__(Model)
        other.noise, other.r, other.q, other.b = self.noise, self.r.copy(), self.q.copy(), self.b.copy()
        other.taken = [x.copy() for x in self.taken]
        return other

    def train(self, rows: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        """Noise-contrastive estimation on pair counts: `counts[i, c]` is how often class c follows class rows[i].

        A true pair is told from NOISE classes drawn by frequency; as each pair stands for all its
        occurrences, the draws enter with their expected number. Adagrad steps over the whole matrix.
        """
        own = np.arange(len(self.b))
        false = counts.sum(axis=1, keepdims=True) * (NOISE * self.noise)
        log_noise = np.log(NOISE * self.noise)
        for _ in range(rounds):
            r = self.r[rows]
            chance = 1 / (1 + np.exp(-np.clip(r @ self.q.T + self.b - log_noise, -30, 30)))
            error = counts - (counts + false) * chance
            for k, (table, at, step) in enumerate(
                ((self.r, rows, error @ self.q), (self.q, own, error.T @ r), (self.b, own, error.sum(axis=0)))
            ):
                self.taken[k][at] += step**2
                table[at] += RATE * step / np.sqrt(self.taken[k][at])

    def log_normal(self) -> np.ndarray:
        """For each class before, the logarithm of the sum over classes of exp(r.q + b)."""
        out = np.empty(len(self.b))
        for at in range(0, len(self.b), 512):
            s = (self.r[at : at + 512] @ self.q.T + self.b).astype(np.float64)
            top = s.max(axis=1)
            out[at : at + 512] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out

    def log_unseen(self, log_normal: np.ndarray, vocab: Vocabulary) -> np.ndarray:
        """For each class before, the log-probability of the unseen symbol."""
        s = (self.r @ self.q[vocab.own :].T + self.b[vocab.own :]).astype(np.float64) - log_normal[:, None]
        return np.log(np.exp(s) @ vocab.unseen)


def classes(text_words: list[bytes], known: dict[bytes, int], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's tokens among the known ones (-1: not there) and their classes; the end comes last."""
    at = np.fromiter(map(known.get, text_words, repeat(-1)), dtype=np.int32, count=len(text_words))
    cls = vocab.cls[at]
    for i in np.flatnonzero(at < 0):
        cls[i] = vocab.own + suffix(text_words[i])
    return np.append(at, np.int32(0)), np.append(cls, np.int32(0))


def pair_counts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(before, cls, n): how often a class follows another in all texts, combined by task and then by Spark."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocab), len(vocab.frequency)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        known, total = vocab.lookup(), np.zeros(size * size, dtype=np.int32)
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                cls = classes(words(text), known, vocab)[1].astype(np.int64)
                at, n = np.unique(np.append(0, cls[:-1]) * size + cls, return_counts=True)
                total[at] += n.astype(np.int32)
        at = np.flatnonzero(total)
        for cut in range(0, len(at), 1 << 18):
            some = at[cut : cut + (1 << 18)]
            arrays = [some // size, some % size, total[some]]
            kinds = [pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(k.to_pandas_dtype())) for a, k in zip(arrays, kinds, strict=True)], ["before", "cls", "n"])

    return docs.mapInArrow(count, "before int, cls int, n long").groupBy("before", "cls").agg(F.sum("n").alias("n"))


def _learner(start, size: int):
    def learn(pairs):
        before, cls, n = (pairs.column(c).to_numpy() for c in ("before", "cls", "n"))
        rows, at = np.unique(before, return_inverse=True)
        counts = np.zeros((len(rows), size), dtype=np.float32)
        counts[at, cls] = n
        own = start.value.copy()
        own.train(rows, counts, ROUNDS)
        values = [own.r, own.taken[0], own.q, own.taken[1], own.b[:, None], own.taken[2][:, None]]
        values = np.concatenate(values, axis=1).astype(np.float32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float32()))
        every, weight = np.arange(size, dtype=np.int32), np.full(size, float(n.sum()))
        return pa.table([pa.array(every), pa.array(np.isin(every, rows)), pa.array(weight), lists], ["cls", "own", "pairs", "v"])

    return learn


def train(docs: DataFrame, vocab: Vocabulary, epochs: int = EPOCHS) -> Model:
    """Fit a model on the pair counts of all texts.

    The classes before are dealt to SHARDS tasks, each with a bounded part of the matrix of pairs.
    In an epoch a task trains its own vectors before, and the other parameters from the common
    start; their means, weighted by pairs, start the next epoch. Only one row per class and shard
    comes back.
    """
    model, context, size = Model(vocab.frequency), docs.sparkSession.sparkContext, len(vocab.frequency)
    pairs = pair_counts(docs, vocab).withColumn("shard", F.pmod(F.hash("before"), F.lit(SHARDS)))
    pairs = stored(pairs, "lm-pairs")
    for _ in range(epochs):
        learn = _learner(context.broadcast(model), size)
        found = pairs.groupBy("shard").applyInArrow(learn, "cls int, own boolean, pairs double, v array<float>").toArrow()
        if found.num_rows:
            cls, own = found.column("cls").to_numpy(), found.column("own").to_numpy()
            weight, width = found.column("pairs").to_numpy(), model.r.shape[1]
            values = found.column("v").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
            model.r[cls[own]], model.taken[0][cls[own]] = values[own, :width], values[own, width : 2 * width]
            rest, total = np.zeros((size, values.shape[1] - 2 * width)), np.bincount(cls, weights=weight, minlength=size)
            np.add.at(rest, cls, values[:, 2 * width :] * weight[:, None])
            rest = (rest / total[:, None]).astype(np.float32)
            model.q, model.taken[1] = rest[:, :width].copy(), rest[:, width : 2 * width].copy()
            model.b, model.taken[2] = rest[:, -2].copy(), rest[:, -1].copy()
    return model


def score_texts(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of whole texts.

    Tasks score what they know of; the rest of a document's words, some per cent of them, meet their
    counts in one join by word, in which a document has one row per distinct word.
    """
    normal = model.log_normal()
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model, normal, model.log_unseen(normal, vocab)))
    base = math.log10(vocab.total + vocab.distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model, normal, unseen = shared.value
        known, partition, number = vocab.lookup(), TaskContext.get().partitionId() << 33, 0
        inside = np.zeros(len(vocab.tokens))  # log-probability of a token within its class
        rare = vocab.cls - vocab.own
        own_suffix = rare >= 0
        with np.errstate(divide="ignore"):
            within = np.log(1 - vocab.unseen) - np.log(vocab.mass)  # of one count
        inside[own_suffix] = np.log(vocab.n[own_suffix]) + within[rare[own_suffix]]
        bases = np.log10(vocab.n + 1) - base

        def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = [classes(t, known, vocab) for t in texts]
            at, cls = np.concatenate([a for a, _ in found]), np.concatenate([c for _, c in found])
            before = np.concatenate([np.append(np.int32(0), c[:-1]) for _, c in found])
            logs = np.empty(len(cls))
            for cut in range(0, len(cls), SCORED):
                part = slice(cut, cut + SCORED)
                logs[part] = np.einsum("ij,ij->i", model.r[before[part]], model.q[cls[part]]) + model.b[cls[part]]
            logs -= normal[before]
            has = (at >= 0) & (vocab.n[at] > 0)
            sizes = np.array([len(a) for a, _ in found])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = lambda x: np.add.reduceat(x, starts)
            here = total(np.where(has, logs + inside[at], np.where((at >= 0) & ~has, unseen[before], 0.0)))
            other = []
            for text, start, size in zip(texts, starts, sizes, strict=True):
                rest: dict[bytes, list] = {}
                for i in np.flatnonzero(at[start : start + size] < 0):
                    one = rest.setdefault(text[i], [0, 0.0, 0.0])
                    one[0] += 1
                    one[1] += logs[start + i] + within[cls[start + i] - vocab.own]
                    one[2] += unseen[before[start + i]]
                other.append([{"token": w, "times": a, "if_known": b, "if_not": c} for w, (a, b, c) in rest.items()])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(ids)) + partition), pa.array(ids, pa.int64()), pa.array(sizes),
                    pa.array(total(has.astype(np.int64))), pa.array(total(np.where(at >= 0, bases[at], 0.0))), pa.array(here),
                    pa.array(other, REST),
                ],
                ["row", "doc_id", "n_tokens", "known", "base", "logs", "rest"],
            )

        for batch in pieces(batches):
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(words(text))
                held += len(texts[-1])
                if held > SCORED:
                    yield rows(ids, texts)
                    number += len(ids)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)
                number += len(ids)

    scored = docs.mapInArrow(
        score,
        "row long, doc_id long, n_tokens long, known long, base double, logs double, "
        "rest array<struct<token:binary,times:long,if_known:double,if_not:double>>",
    )
    scored = stored(scored, "lm-scored")
    rest = scored.select("row", F.inline("rest"))
    rest = rest.join(counts.select("token", "n"), "token", "left")
    base_of = F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(base)
    log_of = F.when(F.col("n").isNull(), F.col("if_not")).otherwise(F.col("if_known") + F.col("times") * F.ln("n"))
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * base_of).alias("more_base"),
        F.sum(log_of).alias("more_logs"),
    )
    zero = F.lit(0.0)
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        ((F.col("logs") + F.coalesce("more_logs", zero)) / math.log(10)).alias("score"),
    )


REST = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64()), ("if_known", pa.float64()), ("if_not", pa.float64())]))


def language_model_scores(docs: DataFrame, folds: int = 7, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns counts and model from the training folds only. A null text is empty, and an empty text
    is its end alone; a row without id is scored and never learned from; repeated rows stay;
    without training tokens every token is unseen, the base gives it 1 / 1, and the model what
    its start gives the unseen symbol; an empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(in_training(F.col("doc_id"), folds)).select("text")
    counts = stored(count_tokens(training), "token-counts")
    vocab = vocabulary(counts)
    model = train(training, vocab, epochs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(False))
    return score_texts(rows, counts, vocab, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
