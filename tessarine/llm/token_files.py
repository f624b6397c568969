"""Token ids of a corpus in Simple-8b coded files.

A file is a table of blocks in corpus order. A block holds the ids of whole documents, at least
BLOCK_IDS of them unless it is the last of its shard: `words` are 64-bit little-endian words with a
4-bit selector below 60 bits of payload; `at`/`skip` give, for every STRIDE-th id, the word it is in
and the ids of that word before it; ids of 60 bits or more are written 0 and stand in
`escape_at`/`escape_value`. `doc_ids`/`doc_tokens` list the block's documents.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessarine.llm.common import per_process, pieces, small_batches
from tessarine.llm.encoding import Encoder, fingerprint_of

#: Fixed values: (ids per word, bits per id) by selector 0 to 13.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
PER_WORD = np.array([n for n, _ in SELECTORS])
BLOCK_IDS = 1 << 16
STRIDE = 1024

BLOCKS = (
    "shard int, block int, first long, n_ids long, words binary, at array<int>, skip array<int>, "
    "escape_at array<int>, escape_value array<long>, doc_ids array<long>, doc_tokens array<long>"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a sequence of ids below 2^60, each as full as the next ids allow; and the first id of each word."""
    if not len(ids):
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    padded = np.zeros(len(ids) + 60, dtype=np.uint64)
    padded[: len(ids)] = ids
    best = np.zeros(len(ids), dtype=np.uint8)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        n, width = SELECTORS[selector]
        fits, held = padded < np.uint64(1 << width), 1
        while held < n:  # fits[i] tells of ids i to i + held - 1
            step = min(held, n - held)
            fits = fits[: len(fits) - step] & fits[step:]
            held += step
        np.putmask(best, fits[: len(ids)], selector)
    steps = PER_WORD.astype(np.uint8)[best].tobytes()
    starts, at, end = array("q"), 0, len(ids)
    while at < end:
        starts.append(at)
        at += steps[at]
    starts = np.frombuffer(starts, dtype=np.int64)
    selectors = best[starts]
    words = selectors.astype("<u8")
    for selector in np.unique(selectors):
        n, width = SELECTORS[selector]
        own = np.flatnonzero(selectors == selector)
        begins, held = starts[own], words[own]
        for k in range(n):
            held |= padded[begins + k] << np.uint64(4 + width * k)
        words[own] = held
    return words, starts


def unpack(words: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of a sequence of words, whole selectors at a time."""
    selectors = (words & np.uint64(15)).astype(np.intp)
    counts = PER_WORD[selectors]
    ends = np.cumsum(counts)
    ids = np.zeros((int(ends[-1]) if len(ends) else 0), dtype=np.uint64)
    for selector in np.unique(selectors):
        n, width = SELECTORS[selector]
        own = np.flatnonzero(selectors == selector)
        shifts = (4 + width * np.arange(n)).astype(np.uint64)
        values = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
        ids[(ends[own] - n)[:, None] + np.arange(n)] = values
    return ids[:n_ids]


def encode_block(ids: np.ndarray) -> dict:
    """`words`, `at`, `skip`, `escape_at`, `escape_value` of a sequence of unsigned 63-bit ids."""
    ids = ids.astype(np.uint64)
    escaped = np.flatnonzero(ids >= np.uint64(1 << 60))
    values = ids[escaped].astype(np.int64)
    ids[escaped] = 0
    words, starts = pack(ids)
    marks = np.arange(0, len(ids), STRIDE)
    at = np.searchsorted(starts, marks, side="right") - 1
    return {
        "words": words.tobytes(), "at": at.astype(np.int32), "skip": (marks - starts[at]).astype(np.int32) if len(marks) else marks.astype(np.int32),
        "escape_at": escaped.astype(np.int32), "escape_value": values,
    }


def decode_block(block: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids `start` to `stop` of a block; decoding begins at the word the offsets name."""
    stop = block["n_ids"] if stop is None else min(stop, block["n_ids"])
    if start >= stop:
        return np.empty(0, np.uint64)
    words, mark = np.frombuffer(block["words"], dtype="<u8"), start // STRIDE
    last = stop // STRIDE + 1
    end = block["at"][last] + 1 if last < len(block["at"]) else len(words)
    begin = mark * STRIDE - block["skip"][mark]
    ids = unpack(words[block["at"][mark] : end], stop - begin)[start - begin :]
    for at, value in zip(block["escape_at"], block["escape_value"], strict=True):
        if start <= at < stop:
            ids[at - start] = value
    return ids


def write_token_ids(docs: DataFrame, path: str, vocabulary: str | Path, end_id: int = 2) -> None:
    """Encode every whole text, append `end_id` to each, and write the coded files to `path`.

    Documents are dealt by ranges of (doc_id, text hash), nulls first, so a repeated id cannot fill
    one task; each range becomes one shard, and shards and rows within them ascend. Ids are made
    after that shuffle, so texts are encoded once. `vocabulary` is a tokenizers JSON file on the
    driver; its content travels with the task. A null text is empty, an empty text is its end id
    alone, repeated rows are written repeatedly, an empty table writes no block, other columns are
    ignored.
    """
    content = Path(vocabulary).read_text()
    key = ("encoder", fingerprint_of(content))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(key, lambda: Encoder(content))
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, counts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            coded = encode_block(np.frombuffer(b"".join(held), dtype="<u4"))
            row = {"shard": shard, "block": number, "first": first, "n_ids": size, **coded, "doc_ids": doc_ids, "doc_tokens": counts}
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                coded = encoder.encode(text or "") + end
                held.append(coded)
                doc_ids.append(doc_id)
                counts.append(len(coded) // 4)
                size += len(coded) // 4
                if size >= BLOCK_IDS:
                    yield block()
                    number, first = number + 1, first + size
                    held, doc_ids, counts, size = [], [], [], 0
        if held:
            yield block()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    dealt = docs.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(task, BLOCKS).write.parquet(path)


LISTS = {"at": pa.int32(), "skip": pa.int32(), "escape_at": pa.int32(), "escape_value": pa.int64(), "doc_ids": pa.int64(), "doc_tokens": pa.int64()}
SCHEMA = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary())]
    + [(name, pa.list_(kind)) for name, kind in LISTS.items()]
)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of coded files: (doc_id, start, n_tokens, ids_crc32, ids).

    `start` counts the ids of all documents before; `ids` (left out on request) and their crc32 are
    over little-endian unsigned 32-bit integers. Shard totals, one row per written file and so
    small enough to broadcast, are the only state beyond a block.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row).astype("<u4").tobytes()
                ends = np.cumsum(np.array(row["doc_tokens"], dtype=np.int64))
                starts = ends - np.array(row["doc_tokens"], dtype=np.int64)
                own = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(own), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"]), pa.array(row["doc_tokens"], pa.int64()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        *([pa.array(own, pa.binary())] if with_ids else []),
                    ],
                    names,
                )

    names = ["shard", "doc_id", "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.mapInArrow(task, kinds).join(F.broadcast(bases), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("within")).alias("start"), *names[3:])
