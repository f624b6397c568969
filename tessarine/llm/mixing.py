"""Mix sources to target weights by Sainte-Laguë apportionment of equal word blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.llm.common import WORD, once, row_key, stored, word_count

BLOCK_WORDS = 64
SHARD_BLOCKS = 128
SHARD_DOCS = 384
MOST_SHARDS = 65_536


def _number(text: Column) -> Column:
    """A seeded number below 2^32 from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """Add `target` to (source, source_size): shares by weight, stopped at `ceiling` times the size.

    Sources by code point, null last, take the weights in turn. What a stopped source leaves goes to
    the others by weight until none is above its stop. In the order of stop / weight the stopped
    sources come first, so one running sum finds the level of the rest. One row per source is in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    stop = F.col("source_size") * F.lit(float(ceiling))
    ranked = sources.withColumn("weight", weight).withColumn("stop", stop).withColumn("ratio", stop / weight)
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest, all_rows = (by_ratio.rowsBetween(*b) for b in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("stopped", F.col("ratio") <= F.col("level"))
    common = F.min(F.when(~F.col("stopped"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return ranked.withColumn("target", F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("weight") * common)).select(
        *sources.columns, "target"
    )


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[Column], name: str) -> DataFrame:
    """Add `name`: seats of each party of a group by highest quotients votes / (2k + 1).

    `seats` is the number a group gives, ties go by `order`. With p the party's part of the votes
    and S the parties, its seats lie within p * seats +- (p * S / 2 + 1/2) for any divisor that
    gives all seats, so only quotients in that range are ranked: about four rows per party.
    """
    own, key = Window.partitionBy(*group), [*group, "party"]
    part = F.coalesce(F.try_divide(votes, F.sum(votes).over(own)), F.lit(0.0))
    wide = part * F.count(F.lit(1)).over(own) / 2 + 1
    ranged = (
        parties.withColumn("party", F.row_number().over(own.orderBy(*order)))
        .withColumn("low", F.greatest(F.lit(0), F.floor(part * F.col(seats) - wide)))
        .withColumn("high", F.ceil(part * F.col(seats) + wide))
        .withColumn("open", F.col(seats) - F.sum("low").over(own))
    )
    rivals = ranged.where(F.col(votes) > 0).select(*key, "open", votes, F.explode(F.expr("sequence(low, high - 1)")).alias("k"))
    turn = F.row_number().over(own.orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), "party", "k"))
    won = rivals.withColumn("turn", turn).where("turn <= open").groupBy(*key).agg(F.count(F.lit(1)).alias("won"))
    won = won.withColumnsRenamed({c: f"won_{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"won_{c}")) for c in key]
    return ranged.join(won, same, "left").select(
        *parties.columns, (F.col("low") + F.coalesce("won", F.lit(0))).alias(name)
    )


def mix_plan(
    docs: DataFrame,
    seed: int = 7,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """What a mix takes of each document: (doc_id, row, size, source_size, target, taken, passes, spans).

    Sources get their words by Sainte-Laguë (equal blocks of one word), and the same number of words in
    equal blocks of up to `block_words` goes to a source's shards the same way by their blocks. Blocks
    are such that a shard's part of the target is SHARD_BLOCKS blocks or more, down to single words, so
    that a small source meets its target as a large one does. A shard holds its documents end to end
    in seeded order; it takes all its blocks `passes` times and a seeded, evenly spread selection of
    them once more. `spans` are the word ranges (start, end) the selection takes of the document;
    `taken` counts its words, repeats included, and never passes twice the size. A shard's words
    are within two blocks of its part of the target. Shards hold about SHARD_DOCS documents, more where that would make over
    MOST_SHARDS; a source of any size so spreads over many tasks.

    Null texts and texts without words have size 0 and are never taken; a null source is a source
    of its own; repeated rows count each; a null doc_id is ordered as an empty one; an empty table
    gives an empty table; other columns are ignored.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    sized = stored(
        docs.select(
            doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"),
            row_key(doc_id, text).alias("row"), word_count(text).alias("size"),
        ).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everywhere = Window.partitionBy(F.lit(0))
    shard_docs = F.greatest(F.lit(SHARD_DOCS), F.ceil(F.sum("n").over(everywhere) / MOST_SHARDS))
    sources = targets(sources.withColumn("shards", F.ceil(F.col("n") / shard_docs)), weights, share, ceiling)
    sources = sources.withColumn("one", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(everywhere)).cast("long"))
    sources = apportion(sources, ["one"], "target", "seats", [F.col("source").isNull(), F.col("source")], "words")
    block = F.floor(F.col("target") / (F.col("shards") * SHARD_BLOCKS))
    sources = sources.withColumn("block", F.least(F.greatest(block, F.lit(1)), F.lit(block_words)).cast("long"))
    sources = stored(sources.select("source", "source_size", "target", "shards", "words", "block"), "mix-sources")

    placed = sized.join(sources.select(F.col("source").alias("of"), "shards"), F.col("source").eqNullSafe(F.col("of")), "left")
    place = F.when(F.col("shards") > 0, F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards"))
    placed = stored(placed.withColumn("shard", F.coalesce(place, F.lit(0))).drop("of", "shards"), "mix-placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "shards")
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    quota = F.try_divide(F.col("words").cast("double"), "source_size") * F.sum("blocks").over(Window.partitionBy("source"))
    shards = shards.withColumn("quota", F.coalesce(F.round(quota), F.lit(0)).cast("long"))
    shards = apportion(shards, ["source"], "blocks", "quota", [F.col("shard")], "shard_quota")
    quota = F.least("shard_quota", 2 * F.col("blocks"))
    chosen_by = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("shard").cast("string"))
    shards = (
        shards.where("shard_size > 0")
        .withColumn("passes", F.expr("0L") + F.floor(quota / F.col("blocks")))
        .withColumn("once", quota - F.col("passes") * F.col("blocks"))
        .withColumn("shift", _number(chosen_by) % F.col("blocks"))
        .select(F.col("source").alias("of"), F.col("shard").alias("in"), "block", "blocks", "passes", "once", "shift")
    )
    lay = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "row")
    laid = placed.withColumn("b", F.sum("size").over(lay.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    shards = stored(shards, "mix-shards")
    laid = laid.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("in")), "left")

    def chosen_before(j: Column) -> Column:  # blocks of the selection among the first j
        return F.floor((j * F.col("once") + F.col("shift")) / F.col("blocks")).cast("long")

    def selected(j: Column) -> Column:
        return chosen_before(j + 1) > chosen_before(j)

    size = F.col("block")
    span = F.filter(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size)), selected)
    span = F.transform(
        span, lambda j: F.struct((F.greatest(j * size, "a") - F.col("a")).alias("start"), (F.least((j + 1) * size, "b") - F.col("a")).alias("end"))
    )
    kind = "array<struct<start:bigint,end:bigint>>"
    laid = laid.withColumn("spans", F.when(F.col("size") > 0, span.cast(kind)).otherwise(F.array().cast(kind)))
    once = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    laid = laid.withColumn("passes", F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("long"))
    laid = laid.withColumn("taken", F.col("passes") * F.col("size") + once)
    known = sources.select(F.col("source").alias("named"), "source_size", "target")
    return laid.join(known, F.col("source").eqNullSafe(F.col("named")), "left").select(
        "doc_id", "row", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "passes", "spans"
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: each as often as it is taken whole, and once more cut to its spans.

    Columns are those of `docs`, with `n_chars`, if there, counted anew for cut texts. Cut texts keep the
    spaces after their words.
    """
    plan = mix_plan(docs, **settings).select(F.col("row").alias("__row"), "passes", "spans")
    turn = Window.partitionBy("__row").orderBy(F.lit(0))
    plan = plan.where("passes > 0 or size(spans) > 0").withColumn("__turn", F.row_number().over(turn))
    plan = plan.select("__row", "__turn", F.col("passes").alias("__passes"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__row", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows = rows.withColumn("__turn", F.row_number().over(turn)).join(plan, ["__row", "__turn"])
    parts = F.regexp_extract_all("text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("__parts", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    rows = once(rows, "__parts", F.when(F.size("__spans") > 0, parts))
    texts = F.concat(
        F.array_repeat("text", F.col("__passes").cast("int")),
        F.when(F.size("__spans") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
