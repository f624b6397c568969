"""Quality rules: word and line counts, and the distance of a document's histograms from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.llm.common import once, stored

#: What separates words, what counts as a symbol, what is taken off words before they are looked up.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
MARKS = "[#*$%&|<>.,;:!?]+"
#: Classes of characters, in the order in which they are taken off a text; what is left is one more.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?]+", GAP, r"[#*$%&|<>]+")

COMMON = 32
MIN_WORDS, MAX_REPEATED = 50, 50
MIN_JUDGED = 50
#: Distances that a document of any length may have, and what sampling adds to their squares, by 1 / words.
CLASS_DISTANCE, WORD_DISTANCE = 0.14, 0.14
CLASS_NOISE, WORD_NOISE = 5.0, 12.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _bare(text: Column) -> Column:
    """A text in lower case without marks, as its words are looked up."""
    return F.lower(F.regexp_replace(text, MARKS, ""))


def _repeated(name: str) -> Column:
    """Words that lie in three-word windows found twice or more, from `name`: sorted (hash, place) of all windows."""
    held = F.col(name)
    twin = F.filter(held, lambda x, i: (F.get(held, i - 1)["h"] == x["h"]) | (F.get(held, i + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(twin, lambda x: x["i"]))
    # Each window adds the words that the window before it does not have.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("before"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["before"])).cast("long").alias("n"), i.alias("before")),
        lambda acc: acc["n"],
    )


def common_words(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, words): the `common` most frequent words of each language over all its documents, ties by code point.

    Words are counted per language before the shuffle, and each task hands on only its `common` best, so a
    language with most of the words is not sorted in one task.
    """
    words = docs.select("lang", F.explode(F.split(_bare(F.col("text")), GAP)).alias("word")).where("word <> ''")
    words = words.groupBy("lang", "word").count()
    best = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = words.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= common)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "word"))), lambda x: x["word"]).alias("words"))


def counted(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, lang, text) and its language's `words`: the counts and both histograms.

    `classes` has lower-case letters, capitals, digits, sentence marks, spaces, symbols and the rest;
    `hits` how often each common word occurs, and all other words.
    """
    rows = once(docs, "found", _words(F.col("text")))
    # The last two places have no window.
    triple = F.transform("found", lambda w, i: F.xxhash64(w, F.get("found", i + 1), F.get("found", i + 2)))
    triple = F.slice(triple, F.lit(1), F.greatest(F.size("found") - 2, F.lit(0)))
    rows = once(rows, "hashes", triple)
    # Only texts with a repeated window are sorted.
    windows = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = once(rows, "windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # What follows copies rows, so the long arrays end here.
    rows = once(rows, "n_repeat_words", _repeated("windows"))
    rows = once(rows, "n_words", F.size("found").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    rows = once(rows, "n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    # Each class is counted by what taking off its runs takes off; the rest gets short at once.
    left, rest = [F.char_length("text")], F.col("text")
    for number, kind in enumerate(CLASSES):
        rows = once(rows, f"rest{number}", F.regexp_replace(rest, kind, ""))
        rest = F.col(f"rest{number}")
        left.append(F.char_length(rest))
    kinds = [a - b for a, b in zip(left, left[1:], strict=False)]
    spaces, symbols = kinds[4:]
    rows = once(rows, "plain", _words(_bare(F.col("text"))))
    words = F.coalesce("words", F.array().cast("array<string>"))
    # Places in the list of common words, which hold no commas: `_bare` takes these off.
    rows = once(rows, "listed", F.array_join(words, ","))
    places = F.transform("plain", lambda w: F.find_in_set(w, F.col("listed")))
    rows = once(rows, "met", F.filter(places, lambda i: i > 0))
    rows = once(rows, "known", F.transform(words, lambda w, i: F.size("met") - F.size(F.array_remove("met", i + 1))))
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        (left[0] - spaces).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.array(*kinds, left[-1]).cast("array<long>").alias("classes"),
        F.concat("known", F.array(F.size("plain") - F.size("met"))).cast("array<long>").alias("hits"),
    )


def _sums(column: str, bins: int) -> Column:
    """Sum of a histogram over rows, bin by bin; bins that a row lacks count as 0."""
    return F.array(*(F.sum(F.coalesce(F.get(column, F.lit(i)), F.lit(0))) for i in range(bins)))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; null if one is all zero."""

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda x, y: x + y)
        return F.transform(counts, lambda x: x / F.nullif(total, F.lit(0.0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(x * 0)

    terms = F.zip_with(shares(a), shares(b), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def divergence(
    docs: DataFrame,
    common: int = COMMON,
    class_distance: float = CLASS_DISTANCE,
    word_distance: float = WORD_DISTANCE,
    class_noise: float = CLASS_NOISE,
    word_noise: float = WORD_NOISE,
    min_judged: int = MIN_JUDGED,
) -> DataFrame:
    """One row per document: the base counts, `base_failed`, both distances and whether it is `kept`.

    The reference of a language is the sum of the histograms of all documents with that `lang` (null is one
    more language) that the base does not fail: classes of characters, and its `common` most frequent words
    against all others. A document of n words (without marks) may lie sqrt(`class_distance`^2 + `class_noise` / n)
    from the classes of its reference and sqrt(`word_distance`^2 + `word_noise` / n) from its words: few words
    stray further by chance alone. What lies further is rejected; documents of less than `min_judged`
    such words say too little of their shares and pass. The text is read twice, once for the common words and once for all counts; references
    join by language, one row each, and Spark broadcasts them only if their written size allows it.

    A null text is empty; an empty one has null distances and fails the base; a language of one
    document is its own reference; repeated rows are rows of their own; an empty table gives an empty table;
    other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(common_words(docs, common), "common-words")
    same = F.col("l.lang").eqNullSafe(F.col("r.lang"))
    counts = counted(docs.alias("l").join(words.alias("r"), same, "left").select("l.*", "r.words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    counts = stored(counts.withColumn("base_failed", failed), "rule-counts")
    sums = counts.where(~F.col("base_failed")).groupBy("lang")
    sums = sums.agg(_sums("classes", len(CLASSES) + 1).alias("all_classes"), _sums("hits", common + 1).alias("all_hits"))
    sums = stored(sums, "language-references")
    rows = counts.alias("l").join(sums.alias("r"), same, "left").select("l.*", "r.all_classes", "r.all_hits")
    rows = rows.withColumn("all_hits", F.slice("all_hits", F.lit(1), F.size("hits")))
    far = jensen_shannon(F.col("classes"), F.col("all_classes")), jensen_shannon(F.col("hits"), F.col("all_hits"))
    n = F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumns({"class_distance": far[0], "word_distance": far[1], "n": n})
    strange = (F.pow("class_distance", F.lit(2.0)) > class_distance**2 + class_noise / F.col("n")) | (
        F.pow("word_distance", F.lit(2.0)) > word_distance**2 + word_noise / F.col("n")
    )
    strange = F.coalesce((F.col("n") >= min_judged) & strange, F.lit(False))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~strange)
    return rows.select(*BASE, "class_distance", "word_distance", "base_failed", "kept")


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
