"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, as a class body.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# Runs of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
# Decimal digits, and the signs that count as digits.
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters; none for null."""
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def space_tokens(c: Column) -> Column:
    """Pieces between white space; none for null."""
    parts = F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of low..high tokens, joined by single spaces."""
    # Each length grows from the one before by pairing whole arrays: a function over
    # positions would make the tokens anew for every position.
    grown, runs = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            later = F.slice(tokens, n, F.greatest(F.size(tokens), F.lit(1)))
            grown = F.filter(F.zip_with(grown, later, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
        if n >= low:
            runs.append(grown)
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def clean_text(c: Column, lowercase: bool = True, squeeze: bool = True) -> Column:
    """Null to '', lower case, white space squeezed to single blanks."""
    out = F.lower(c) if lowercase else c
    if squeeze:
        out = F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))
    return F.coalesce(out, F.lit(""))


def truncate_text(c: Column, longest: int = 100) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def text_stats(c: Column) -> dict[str, Column]:
    words = space_tokens(c)
    count = F.size(words)
    return {
        "length": F.length(c),
        "word_count": count,
        # The whole length over the words, blanks included.
        "avg_word_length": F.when(count > 0, F.length(c) / count).otherwise(F.lit(0.0)),
        "unique_words": F.size(F.array_distinct(F.transform(words, F.lower))),
        "has_numbers": F.rlike(c, F.lit(DIGIT)),
        "has_special": F.rlike(c, F.lit(rf"[^\p{{L}}\p{{N}}{SPACE}]")),
    }
