"""Text expressions: folding, tokens, sentences, citations, offsets.

Everything is a Column built from Spark functions.  `fold` hands only those values to ICU,
which Spark carries for its collations, that Spark's own `lower` cannot fold exactly.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessarine import fixed_values as V
from tessarine.functions.vectors import let

# Python's whitespace: the Unicode White_Space property plus U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of anything else, to be used with (?U); plain ASCII runs take the quick branch.
WORD = r"(?:[!-~]++|[^\s\x1c-\x1f])++"
TOKEN = r"[\p{L}\p{M}\p{N}]+"
BOUNDARY = V.CHUNK_BOUNDARY.replace(r"\s", WS)


def _natively_foldable(char: str) -> bool:
    """True if `lower` alone equals NFKC + casefold, whatever stands next to the char."""
    if char == "ß":  # replaced after lower()
        return True
    return (
        unicodedata.normalize("NFKC", char) == char
        and char.casefold() == char.lower()
        and len(char.lower()) == 1
        and unicodedata.combining(char) in (0, 9)
        and char not in "Σςσ"
    )


def _composing_seconds(limit: int) -> set[str]:
    """Characters that may merge with the one before them under composition."""
    seconds = set()
    for code in range(limit):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return seconds


def _fold_class() -> str:
    """Regex class of natively foldable characters, in the blocks worth checking."""
    seconds = _composing_seconds(0x3000)
    blocks = [(0x80, 0x180), (0x900, 0x980), (0x2010, 0x2028)]
    ranges: list[list[int]] = []
    for low, high in blocks:
        for code in range(low, high):
            char = chr(code)
            if char in seconds or not _natively_foldable(char):
                continue
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


FOLDABLE = _fold_class()


def _outside_native(text: Column) -> Column:
    """True if some character needs more than `lower`."""
    native = f"(?:[\\x00-\\x7f]++|[{FOLDABLE}]++)*+"  # plain ASCII runs take the quick branch
    return text.rlike(f"(?s)^(?!{native}\\z).")


def _icu_nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def fold(text: Column) -> Column:
    """NFKC + casefold, by ICU for the values outside the native class.

    No Python worker holds texts, and rows dealt out by a key stay so: the windows after a fold need no
    shuffle of their own.
    """
    native = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _icu_nfkc(text), F.lit(True))
    return F.when(_outside_native(text), folded).otherwise(native)


def nfkc(text: Column) -> Column:
    return F.when(_outside_native(text), _icu_nfkc(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (SQL trim removes spaces only)."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"(?U){WS}+", " "))


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def drop_function_words(tokens: Column, words: tuple[str, ...]) -> Column:
    """Tokens without function words; all of them if nothing would be left."""

    def choose(s: Column) -> Column:
        return F.when(F.size(s["kept"]) > 0, s["kept"]).otherwise(s["all"])

    def split(all_tokens: Column) -> Column:
        kept = F.filter(all_tokens, lambda t: ~t.isin(*words))
        return let(F.struct(all_tokens.alias("all"), kept.alias("kept")), choose)

    return let(tokens, split)


def content_tokens(text: Column, words: tuple[str, ...] = V.ENGLISH_FUNCTION_WORDS) -> Column:
    return drop_function_words(lexical_tokens(text), words)


def sentences(text: Column) -> Column:
    """Array of stripped, non-blank sentences in text order."""
    parts = F.split(text, f"(?U)(?={WS})(?:(?<=[{V.SENTENCE_ENDS}]){WS}+|\\n+)")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def normalize_transcript(text: Column) -> Column:
    """Folded text with everything but letters, numbers, `_` turned into single spaces.

    Combining marks are not word characters here, hence no `\\w`.
    """
    return collapse_spaces(F.regexp_replace(fold(text), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " "))


def normalize_answer(text: Column) -> Column:
    return collapse_spaces(fold(text))


def citations(text: Column) -> Column:
    pattern = V.CITATION.replace(r"\s", r"\s\x1c-\x1f")
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1))


def strip_citations(text: Column) -> Column:
    pattern = V.CITATION.replace(r"\s", r"\s\x1c-\x1f")
    return strip(F.regexp_replace(text, "(?U)" + pattern, ""))


def strip_markdown_prefix(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + V.MARKDOWN_PREFIX, "")


def is_safe_citation_id(chunk_id: Column) -> Column:
    return chunk_id.rlike(r"(?U)^[^\]\s\x1c-\x1f]+\z")


def has_control_characters(text: Column) -> Column:
    return text.rlike(V.CONTROL_CHARACTERS)


def leading_space(raw: Column) -> Column:
    return F.char_length(F.regexp_extract(raw, f"(?U)^{WS}*", 0))


def trimmed_offsets(raw: Column, start: Column) -> Column:
    """Struct of the offsets and text of `raw` (which begins at `start`) without outer space."""


    def place(s: Column) -> Column:
        return F.struct(
            s["at"].alias("start_char"),
            (s["at"] + F.char_length(s["text"])).alias("end_char"),
            s["text"].alias("text"),
        )

    return let(F.struct((start + leading_space(raw)).alias("at"), strip(raw).alias("text")), place)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){WORD}"))


def missing_key(value: Column) -> Column:
    """Counter key of a string: null and '' become `<missing>`."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("<missing>"))


def missing_float_key(value: Column) -> Column:
    """Counter key of a double: eight significant digits, trailing zeros dropped.

    Exponents from -4 to 7 print in plain notation, others like `1.5e+08`.
    """
    parts = F.split(F.format_string("%.7e", value), "e")
    exponent = F.when(value == 0, F.lit(0)).otherwise(parts[1].cast("int"))
    zeros = r"\.?0+$"
    scientific = F.concat(
        F.regexp_replace(parts[0], zeros, ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    plain = F.lit(None).cast("string")
    for e in range(-4, 8):
        text = F.format_string(f"%.{7 - e}f", value)
        plain = F.when(exponent == e, F.regexp_replace(text, zeros, "") if e < 7 else text).otherwise(plain)
    return (
        F.when(value.isNull(), F.lit("<missing>"))
        .when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(exponent.between(-4, 7), plain)
        .otherwise(scientific)
    )


def redact(text: Column, secrets: list[str]) -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text


def normalize_language(code: Column) -> Column:
    """Primary subtag in lower case, three-letter codes mapped to two; '' becomes null."""
    primary = F.split_part(F.lower(strip(code)), F.lit("-"), F.lit(1))
    aliases = F.create_map(
        *[F.lit(part) for pair in V.LANGUAGE_ALIASES.items() for part in pair]
    )
    return F.when(F.coalesce(code, F.lit("")) != "", F.coalesce(aliases[primary], primary))
