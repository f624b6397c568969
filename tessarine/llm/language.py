"""Language identification by mixtures: which languages share a document, and in which proportions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import in_training, pieces

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
UNDETERMINED = "und"


def _fold_table() -> np.ndarray:
    """Code points below 0x250: letters to lower case, all else to a space."""
    shown = [chr(c) for c in range(0x250)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0x20 for c in shown], dtype=np.uint32)


FOLD = _fold_table()


def ngrams(text: str) -> np.ndarray:
    """Hashed three-letter windows around every letter of a text; non-letters count as spaces.

    Characters from code point 0x250 on count as letters here.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = FOLD[np.minimum(points, len(FOLD) - 1)]
    points = np.where(points < len(FOLD), known, points)
    around = np.concatenate([[np.uint32(0x20)], points, [np.uint32(0x20)]]).astype(np.uint32)
    mixed = around[:-2] * np.uint32(0x9E3779B1) ^ around[1:-1] * np.uint32(0x85EBCA77) ^ around[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17))[points != 0x20]


def language_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learned languages in code-point order, and the probability of each hashed window in each language.

    Windows of all documents with a language and a text are counted, combined by task and then by
    Spark; what comes to the driver is one number for each language and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = np.bincount(ngrams(text), minlength=BUCKETS)
                total[lang] = total[lang] + seen if lang in total else seen
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at])], ["lang", "bucket", "n"]
            )

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(languages)))
    number = {lang: k for k, lang in enumerate(languages)}
    table[found.column("bucket").to_numpy(), [number[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return languages, (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)


def proportions(chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns by expectation-maximisation, and the log-likelihood at the end."""
    weights = np.full(chances.shape[1], 1 / chances.shape[1])
    for _ in range(ROUNDS if len(weights) > 1 else 0):
        joint = chances * weights
        weights = (counts / joint.sum(axis=1)) @ joint / counts.sum()
    return weights, float(counts @ np.log(chances @ weights))


def mixture(windows: np.ndarray, table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Languages of a text (column numbers, heaviest first) and their proportions.

    The set grows by the weights all languages get together; the one kept has the greatest
    log-likelihood less `penalty` * log(windows) for each language.
    """
    seen = np.bincount(windows, minlength=BUCKETS)
    at = np.flatnonzero(seen)
    chances, counts = table[at], seen[at].astype(np.float64)
    order = np.argsort(-proportions(chances, counts)[0], kind="stable")
    best = None
    for k in range(1, len(order) + 1):
        weights, likelihood = proportions(chances[:, order[:k]], counts)
        value = likelihood - penalty * k * np.log(counts.sum() + 1)
        if best is not None and value <= best[0]:
            break
        best = value, order[:k], weights
    turn = np.argsort(-best[2], kind="stable")
    return best[1][turn], best[2][turn]


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, penalty: float = 4.0) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) from the texts alone.

    `languages` are all languages found, heaviest first, `shares` their proportions; `lang_pred` is
    the first and `score` its share. A null text, one without letters, or a model without languages gives
    `und`, score 0 and empty lists. Repeated rows stay, an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chances = model.value
        for batch in pieces(batches):
            found = []
            for text in batch.column("text").to_pylist():
                if not text or not names or not any(map(str.isalpha, text)):
                    found.append(([], []))
                    continue
                at, shares = mixture(ngrams(text), chances, penalty)
                found.append(([names[k] for k in at], [min(1.0, float(s)) for s in shares]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([a[0] if a else UNDETERMINED for a, _ in found], pa.string()),
                    pa.array([s[0] if s else 0.0 for _, s in found], pa.float64()),
                    pa.array([a for a, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def identify_held_out(docs: DataFrame, folds: int = 4) -> DataFrame:
    """Learn from the training folds, then predict every document: `identify` with `held_out`."""
    chosen = docs.where(in_training(F.col("doc_id"), folds)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = identify(docs, *language_model(chosen))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(False))
    return found.withColumn("held_out", held_out)
