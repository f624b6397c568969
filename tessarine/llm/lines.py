"""Delete repeated runs of lines: winnowing picks anchors, anchors extend to windows, windows to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.llm.common import WORD, once, stored

WINDOW = 2
LONG_WORDS = 50
SPACES = " \t\r\x0b\x0c"


def _with_lines(df: DataFrame) -> DataFrame:
    """Add `__lines` of the text and `__places` (from 0), those that are not blank."""
    df = once(df, "__lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    full = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.trim(F.get("__lines", i), F.lit(SPACES)) != "")
    return once(df, "__places", full)


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, mark, starts) of documents with lines to delete; `starts` are windows (s, size) that occurred before.

    Lines are compared without the spaces around them, blank ones are passed over. Every window of `window`
    consecutive lines selects the last of its least line hashes, so that equal windows select the same
    line: an anchor hash that stands at one place only belongs to no repeated window and
    ends there. A repeated anchor extends both ways to the windows that chose it; their contents
    are compared by 128 bits with their first occurrence, in order of (doc_id, text hash, place), null
    ids first. Adjoining windows make up runs, so each run of `window` or more lines that occurred
    before is found whole, and no pairs of places are formed. A line of `long_words` words or more is also
    a window of its own, whatever stands around it; with None there are no such windows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("text").cast("string")).alias("mark"))
    hashes = F.transform("__places", lambda i: F.xxhash64(F.trim(F.get("__lines", i), F.lit(SPACES))))
    long = F.transform("__places", lambda i: F.regexp_count(F.get("__lines", i), F.lit(WORD)) >= (long_words or 0))
    held = once(_with_lines(rows), "h", hashes)
    held = held if long_words is None else once(held, "long", long)
    held = held.select("doc_id", "mark", "h", *([] if long_words is None else ["long"]))

    def window_at(s: Column) -> Column:
        own = F.slice("h", s + 1, window)
        back = F.array_position(F.reverse(own), F.array_min(own)).cast("int")
        return F.struct(
            s.alias("s"), F.array_min(own).alias("anchor"), (s + window - back).alias("at"),
            F.xxhash64(own).alias("k1"), F.xxhash64(F.lit("second"), own).alias("k2"), F.lit(window).alias("size"),
        )

    def line_at(h: Column, s: Column) -> Column:
        own = F.array(h)
        return F.struct(
            s.alias("s"), h.alias("anchor"), s.alias("at"),
            F.xxhash64(own).alias("k1"), F.xxhash64(F.lit("second"), own).alias("k2"), F.lit(1).alias("size"),
        )

    starts = F.filter(F.sequence(F.lit(0), F.size("h")), lambda s: s <= F.size("h") - window)
    windows = F.transform(starts, window_at)
    if long_words is not None:
        alone = F.filter(F.transform("h", lambda h, s: F.when(F.get("long", s), line_at(h, s))), lambda w: w.isNotNull())
        windows = F.concat(windows, alone)
    held = held.select("doc_id", "mark", windows.alias("windows")).where(F.size("windows") > 0)
    held = stored(held, "line-windows")
    anchors = F.array_distinct(F.transform("windows", lambda w: F.struct(w["anchor"].alias("anchor"), w["at"].alias("at"))))
    anchors = held.select(F.inline(anchors)).groupBy("anchor").count().where(F.col("count") > 1).select("anchor")
    anchors = stored(anchors, "line-anchors")
    windows = held.select("doc_id", "mark", F.inline("windows")).join(anchors, "anchor", "left_semi")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "s")
    windows = stored(windows.select("k1", "k2", "doc_id", "mark", "s", "size", place.alias("place")), "line-candidates")
    first = windows.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("k1", "k2", "first"), "line-first")
    later = windows.join(first, ["k1", "k2"]).where(F.col("place") > F.col("first"))
    return later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("s", "size")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The documents with their text cut, and `lines` and `deleted`, the numbers of non-blank lines.

    Deleted lines go with their line break; blank lines and all others stay as they are. Columns are
    those of `docs` (`n_chars`, if there, counted anew) and the two counts, which replace columns of
    these names. A null text stays null with 0 lines; rows equal in id and text are one document
    and get the same text; documents with fewer lines than the window lose none but
    lines of `long_words` words or more; an empty table gives an empty table.
    """
    found = repeated_runs(docs, window, long_words).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__own"), F.col("starts").alias("__starts"))
    rows = docs.withColumn("__mark", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__own"))
    rows = rows.join(found, same, "left")
    rows = _with_lines(rows)
    gone = F.flatten(F.transform("__starts", lambda w: F.sequence(w["s"], w["s"] + w["size"] - 1)))
    gone = F.array_distinct(F.coalesce(gone, F.array().cast("array<int>")))
    rows = once(rows, "__gone", gone).withColumn("lines", F.size("__places")).withColumn("deleted", F.size("__gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.transform("__gone", lambda i: F.get("__places", i)))
    cut = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("deleted") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    counts = [c for c in ("lines", "deleted") if c not in docs.columns]
    return rows.select(*docs.columns, *counts)
