"""Chunk walks and pooling.

Each walk is a fold over a bounded sequence inside one row, so documents need no
shuffle to be cut; only pooling (token vectors against spans) joins.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions import text as T
from tessarine.functions import vectors
from tessarine.session import fenced, spread_by

BLOCK_CHARACTERS = 4096
POOL_BLOCK = 512  # token positions

_SPAN = "array<struct<first:int,last:int,chars:int,width:int>>"


def last_boundary(raw: Column) -> Column:
    """End of the last leftmost boundary match in `raw`; 0 if there is none.

    Going from boundary to boundary without a way back equals scanning from the left, which a
    greedy pattern does not. Characters that cannot begin a boundary are passed in runs.
    """
    begins = r"\n.!?;:।॥,"
    run = f"(?:[a-z ]++|[^{begins}])*+"
    to_next = f"{run}(?:(?!{T.BOUNDARY})[{begins}]{run})*+{T.BOUNDARY}"
    return F.char_length(F.regexp_extract(raw, f"(?U)^(?:{to_next})*+", 0))


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than a chunk")


def _steps(length: Column, size: int, overlap: int) -> Column:
    """Upper bound of chunks: each step moves on by at least `advance`."""
    advance = max(1, size // 2 + 1 - overlap)
    return F.sequence(F.lit(1), F.floor(length / advance).cast("int") + 1)


def naive_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) character spans of the recursive-character walk.

    The text is cut into blocks once, so a step reads two blocks and not the text from its start.
    """
    block = max(BLOCK_CHARACTERS, size)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    measured = F.struct(blocks.alias("blocks"), F.char_length(text).alias("length"))
    return vectors.let(measured, lambda d: _walk(d["blocks"], d["length"], block, size, overlap))


def _walk(blocks: Column, length: Column, block: int, size: int, overlap: int) -> Column:
    spans_type = "array<struct<start:int,stop:int>>"
    first = F.struct(F.lit(0).alias("start"), F.array().cast(spans_type).alias("spans"))

    def step(state: Column, _: Column) -> Column:
        start = state["start"]
        hard = F.least(start + size, length)
        low = start + size // 2
        number = F.floor(low / block).cast("int")
        near = F.concat(F.get(blocks, number), F.coalesce(F.get(blocks, number + 1), F.lit("")))
        found = last_boundary(F.substring(near, low - number * block + 1, hard - low))

        def cut(b: Column) -> Column:
            return F.when((b["hard"] < length) & (b["found"] > 0), low + b["found"]).otherwise(b["hard"])

        def move(stop: Column) -> Column:
            span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
            following = F.when(stop >= length, F.lit(-1)).otherwise(F.greatest(start + 1, stop - overlap))
            return F.struct(
                following.cast("int").alias("start"),
                F.concat(state["spans"], span.cast(spans_type)).alias("spans"),
            )

        bound = F.struct(hard.alias("hard"), found.alias("found"))
        moved = vectors.let(vectors.let(bound, cut), move)
        return F.when((start < 0) | (length == 0), state).otherwise(moved)

    return F.aggregate(_steps(length, size, overlap), first, step, lambda s: s["spans"])


def naive_chunks(
    documents: DataFrame,
    size: int = V.CHUNK_CHARACTERS,
    overlap: int = V.CHUNK_OVERLAP_CHARACTERS,
) -> DataFrame:
    """(document_id, text) to (document_id, chunk_index, chunk_id, start_char, end_char, text)."""
    check_sizes(size, overlap)

    def trimmed(span: Column) -> Column:
        raw = F.substring("text", span["start"] + 1, span["stop"] - span["start"])
        return F.struct(T.trimmed_offsets(raw, span["start"]).alias("t"))

    found = F.transform(naive_spans(F.col("text"), size, overlap), trimmed)
    return number_chunks(documents.select("document_id", found.alias("found")), "naive")


def number_chunks(spans: DataFrame, strategy: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of each row's `found` spans, numbered inside the row after blank ones are dropped: no shuffle."""
    full = F.filter("found", lambda s: s["t"]["text"] != "")
    return spans.select("document_id", F.posexplode(full).alias("chunk_index", "s")).select(
        "document_id",
        "chunk_index",
        F.concat_ws(":", "document_id", F.lit(strategy), "chunk_index").alias("chunk_id"),
        F.lit(strategy).alias("strategy"),
        "s.t.start_char",
        "s.t.end_char",
        "s.t.text",
        *[f"s.{c}" for c in extra],
    )


def _windows(text: Column, window_tokens: int) -> Column:
    """Array of a text's token windows with the characters and tokens before each."""
    pieces = F.regexp_extract_all(
        text, F.lit(f"(?U)(?:{T.WS}*+{T.WORD}){{1,{window_tokens}}}+"), F.lit(0)
    )
    kind = "array<struct<window_text:string,window_tokens:int,char_offset:bigint,token_offset:bigint>>"
    start = F.struct(
        F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("tokens"), F.array().cast(kind).alias("out")
    )

    def add(state: Column, piece: Column) -> Column:
        def grow(n: Column) -> Column:
            window = F.struct(
                piece.alias("window_text"), n.alias("window_tokens"),
                state["chars"].alias("char_offset"), state["tokens"].alias("token_offset"),
            )
            return F.struct(
                (state["chars"] + F.char_length(piece)).alias("chars"),
                (state["tokens"] + n).alias("tokens"),
                F.concat(state["out"], F.array(window).cast(kind)).alias("out"),
            )

        return vectors.let(T.word_count(piece).cast("int"), grow)

    return F.aggregate(pieces, start, add, lambda state: state["out"])


def document_windows(documents: DataFrame, window_tokens: int = V.WINDOW_TOKENS) -> DataFrame:
    """Cut each document's token stream into windows; spans never cross a window.

    A token is a run of non-space characters.  `window_text` keeps its leading space,
    so character offsets add up.
    """
    windows = F.posexplode(_windows(F.col("text"), window_tokens)).alias("window_index", "w")
    return documents.select("document_id", windows).select("document_id", "window_index", "w.*")


def token_spans(window: Column, tokens: Column, target: int, overlap: int) -> Column:
    """Array of spans (first token, token after last, char start, char length) of one window."""
    ws = T.WS
    one = f"(?:{ws}*+{T.WORD})"
    half = max(1, target // 2)
    first = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("chars"), window.alias("rest"),
        F.array().cast(_SPAN).alias("spans"),
    )

    def head(raw: Column, count: int) -> Column:
        return F.regexp_extract(raw, f"(?U)^{one}{{0,{count}}}+", 0)

    def skip(raw: Column, count: Column) -> Column:
        """Length of the first `count` tokens with the space before each."""
        tokens_of = F.slice(F.regexp_extract_all(raw, F.lit(f"(?U){ws}*+{T.WORD}"), F.lit(0)), 1, count)
        return F.aggregate(tokens_of, F.lit(0), lambda acc, t: acc + F.char_length(t))

    def step(state: Column, _: Column) -> Column:
        at, rest = state["at"], state["rest"]
        hard = F.least(at + target, tokens)

        def search(p: Column) -> Column:
            low = F.char_length(F.regexp_extract(p["part"], f"(?U)^{one}{{0,{half}}}+{ws}*+", 0))
            tail = F.substring(p["part"], low + 1, F.lit(2**31 - 1))
            return vectors.let(
                F.struct(tail.alias("tail"), last_boundary(tail).alias("found")),
                lambda t: F.when(t["found"] > 0, T.word_count(F.substring(t["tail"], F.lit(1), t["found"]))).otherwise(0),
            )

        def cut(p: Column) -> Column:
            """Token after the last one of this chunk."""
            inside = F.when(p["hard"] < tokens, search(p)).otherwise(0)
            return vectors.let(inside, lambda n: F.when(n > 0, at + half + n).otherwise(p["hard"]))

        def move(b: Column) -> Column:
            last, part = b["last"], b["p"]["part"]
            width = F.when(last == b["p"]["hard"], F.char_length(part)).otherwise(skip(part, last - at))
            lead = T.leading_space(part)
            span = F.array(
                F.struct(at.alias("first"), last.alias("last"), (state["chars"] + lead).alias("chars"), (width - lead).alias("width"))
            ).cast(_SPAN)
            return F.when(
                last >= tokens,
                F.struct(
                    F.lit(-1).alias("at"), state["chars"].alias("chars"), F.lit("").alias("rest"),
                    F.concat(state["spans"], span).alias("spans"),
                ),
            ).otherwise(
                vectors.let(
                    skip(part, F.greatest(at + 1, last - overlap) - at),
                    lambda gone: F.struct(
                        F.greatest(at + 1, last - overlap).alias("at"),
                        (state["chars"] + gone).alias("chars"),
                        F.substring(rest, gone + 1, F.lit(2**31 - 1)).alias("rest"),
                        F.concat(state["spans"], span).alias("spans"),
                    ),
                )
            )

        piece = F.struct(head(rest, target).alias("part"), hard.alias("hard"))
        moved = vectors.let(
            vectors.let(piece, lambda p: F.struct(p.alias("p"), cut(p).cast("int").alias("last"))), move
        )
        return F.when(at < 0, state).otherwise(moved)

    return F.aggregate(_steps(tokens, target, overlap), first, step, lambda s: s["spans"])


def token_chunks(
    documents: DataFrame,
    target: int = V.CHUNK_TOKENS,
    overlap: int = V.CHUNK_OVERLAP_TOKENS,
    window_tokens: int = V.WINDOW_TOKENS,
) -> DataFrame:
    """Late-strategy chunks with token and character spans."""
    check_sizes(target, overlap)
    if target > window_tokens:
        raise ValueError("a chunk cannot exceed its document window")

    def cut(window: Column) -> Column:
        def trimmed(span: Column) -> Column:
            raw = F.substring(window["window_text"], span["chars"] + 1, span["width"])
            start = (window["char_offset"] + span["chars"]).cast("int")
            return F.struct(
                T.trimmed_offsets(raw, start).alias("t"),
                (window["token_offset"] + span["first"]).cast("int").alias("first_token"),
                (window["token_offset"] + span["last"]).cast("int").alias("last_token"),
            )

        return F.transform(token_spans(window["window_text"], window["window_tokens"], target, overlap), trimmed)

    found = F.flatten(F.transform(_windows(F.col("text"), window_tokens), cut))
    spans = documents.select("document_id", found.alias("found"))
    numbered = number_chunks(spans, "late", ("first_token", "last_token"))
    return numbered.withColumn("token_count", F.col("last_token") - F.col("first_token"))


def fixed_spans(lengths: DataFrame, target: int, overlap: int) -> DataFrame:
    """Spans over token streams that carry no text (no boundaries): target/overlap only."""
    check_sizes(target, overlap)
    stride = target - overlap
    starts = F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - overlap) / stride) - 1).cast("int") * stride,
        F.lit(stride),
    )
    return lengths.select("document_id", "n", F.posexplode(starts).alias("span", "first_token")).select(
        "document_id", "span", "first_token",
        F.least(F.col("first_token") + target, F.col("n")).cast("int").alias("last_token"),
    )


def position_block() -> Column:
    """The stretch of positions a token is pooled in."""
    return F.floor(F.col("pos") / POOL_BLOCK).cast("int").alias("block")


def by_block(tokens: DataFrame) -> DataFrame:
    """Tokens (document_id, pos, ...) dealt out as `late_pool` needs them.

    Rows dealt before vectors are attached by a join that keeps their place need no shuffle after it.
    """
    return spread_by(tokens.withColumn("block", position_block()), "document_id", "block")


def late_pool(tokens: DataFrame, spans: DataFrame, span_key: str = "span", width: int | None = None) -> DataFrame:
    """Mean of the contextual token vectors of each span, normalised.

    `tokens`: document_id, pos, vector, and `block` if `by_block` has dealt them.  Spans meet tokens in
    stretches of positions: a long document spreads over many tasks, each token vector travels once
    at most, and the vectors of a span are summed in its stretches before the shuffle.  With `width`
    they are summed in plain columns; vectors of another width give no span.
    """
    if "block" not in tokens.columns:
        tokens = tokens.withColumn("block", position_block())
    first, last = (F.floor(c / POOL_BLOCK).cast("int") for c in (F.col("first_token"), F.col("last_token") - 1))
    touched = spans.filter("last_token > first_token").select(
        "document_id", span_key, "first_token", "last_token", F.explode(F.sequence(first, last)).alias("block")
    )
    return _pooled(tokens.join(touched, ["document_id", "block"]), ["document_id", span_key], width)


def _pooled(met: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """(keys, token_count, vector) of tokens that met the spans of their stretch."""
    inside = (F.col("pos") >= F.col("first_token")) & (F.col("pos") < F.col("last_token"))
    grouped = met.filter(inside).groupBy(*keys)
    count = F.count(F.lit(1)).alias("token_count")
    if width is None:
        pooled = grouped.agg(Summarizer.mean(array_to_vector("vector")).alias("_mean"), count)
        mean = vector_to_array("_mean")
    else:
        parts = [F.sum(F.get("vector", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(width)]
        whole = F.count_if(F.size("vector") == width).alias("_whole")
        pooled = grouped.agg(*parts, whole, count).filter("_whole = token_count")
        mean = F.array(*[F.col(f"_{i}") / F.col("token_count") for i in range(width)])
    # generators, so that the mean and its unit vector are computed once a span and not once for each use
    pooled = pooled.select(*keys, "token_count", F.explode(F.array(mean)).alias("_mean"))
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    unit = vectors.let(vectors.l2_normalize(F.col("_mean")), lambda v: F.when(finite(v), F.array(v)))
    return pooled.select(*keys, "token_count", F.explode(unit).alias("vector"))


def position_window(position: Column) -> Column:
    """The document window of a token; chunks never cross one."""
    return F.floor(position / V.WINDOW_TOKENS).cast("int").alias("window")


def by_window(lists: DataFrame, name: str) -> DataFrame:
    """(document_id, `name`: values in the order of tokens) to tokens (document_id, window, pos, `name`), dealt out by window.

    Lists travel, cut into windows; the rows of tokens are made and put in order where they arrive. Vectors attached
    by a join that keeps the rows' place and order are neither moved nor sorted when `chunk_vectors` meets them.
    """
    size = V.WINDOW_TOKENS
    windows = F.sequence(F.lit(0), F.floor((F.size(name) - 1) / size).cast("int"))
    parts = F.transform(windows, lambda w: F.slice(name, w * size + 1, F.lit(size)))
    cut = lists.filter(F.size(name) > 0).select("document_id", F.posexplode(parts).alias("window", "part"))
    rows = spread_by(cut, "document_id", "window").select("document_id", "window", F.posexplode("part").alias("at", name))
    tokens = rows.select("document_id", "window", (F.col("window") * size + F.col("at")).alias("pos"), name)
    return fenced(tokens.sortWithinPartitions("document_id", "window"), "pos")


def chunk_vectors(tokens: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Chunks that have token vectors of `width`, with `window` and `vector`, the normalised mean of their tokens' vectors.

    Tokens and chunks meet by document window, so sums are whole where they are made: a chunk's text travels
    once, sums never, and token vectors not if `by_window` has dealt the tokens. Chunks are cut once.
    """
    if "window" not in tokens.columns:
        tokens = tokens.withColumn("window", position_window(F.col("pos")))
    place = ["document_id", "window"]
    chunks = spread_by(chunks.withColumn("window", position_window(F.col("first_token"))), *place)
    chunks = fenced(chunks, *chunks.columns)
    spans = chunks.filter("last_token > first_token").select(*place, F.col("chunk_index").alias("_number"), "first_token", "last_token")
    pooled = _pooled(tokens.join(spans, place), [*place, "_number"], width).drop("token_count")
    # not a key of the join: rows that stand together by document and window stay where they are
    return chunks.join(pooled, place).filter("_number - chunk_index = 0").drop("_number")


def mean_pool_masked(tokens: DataFrame, key: str = "document_id") -> DataFrame:
    """Attention-masked mean (mask sum at least 1), normalised; an all-masked row stays zero."""
    masked = F.transform("vector", lambda x: x.cast("double") * F.col("mask"))
    sums = tokens.groupBy(key).agg(
        Summarizer.metrics("sum").summary(array_to_vector(masked)).alias("_s"),
        F.sum("mask").alias("_n"),
    )
    mean = F.transform(
        vector_to_array("_s.sum"), lambda x: x / F.greatest(F.col("_n"), F.lit(1))
    )
    length = F.greatest(vectors.norm(F.col("_mean")), F.lit(1e-12))
    return sums.withColumn("_mean", mean).select(
        key, F.transform("_mean", lambda x: (x / length).cast("float")).alias("vector")
    )


def chunk_stats(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    tokens = F.col("token_count")
    return chunks.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg(tokens).alias("mean_tokens"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
    )


def chunking_comparison(documents: DataFrame) -> DataFrame:
    """Both strategies over the same documents: count, mean characters, mean tokens."""
    late = token_chunks(documents).select("strategy", "text", "token_count")
    naive = naive_chunks(documents).select(
        "strategy", "text", T.word_count(F.col("text")).alias("token_count")
    )
    return late.unionByName(naive).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg(F.char_length("text")).alias("mean_chars"),
        F.avg("token_count").alias("mean_tokens"),
    )


def offset_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with a blank id or text, bad offsets, or text that is not the source slice."""
    start, end = F.col("start_char"), F.col("end_char")
    source = documents.select("document_id", F.col("text").alias("_source"))
    problem = (
        F.when(T.is_blank(F.col("chunk_id")) | T.is_blank(F.col("document_id")), "blank_id")
        .when(T.is_blank(F.col("text")), "blank_text")
        .when((start < 0) | (end < 0), "negative_offset")
        .when(end < start, "end_before_start")
        .when(F.substring("_source", start + 1, end - start) != F.col("text"), "not_the_source_slice")
    )
    return chunks.join(source, "document_id", "left").withColumn("problem", problem).drop("_source")


def merge_metadata(base: Column, own: Column) -> Column:
    """Base map overlaid by the chunk's own map: the later key wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)
