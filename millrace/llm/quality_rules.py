"""Line-first quality rules: lines are judged one by one, bad ones go, and a document that loses too much goes too.

A line fails by
* punctuation: at least `MARKS` loud marks (`LOUD`), and more than one to every two words;
* navigation: at least `SEPARATORS` words that are separators only, and at least one to every four words;
* boilerplate: at most `BOILERPLATE_WORDS` words and one of the `BOILERPLATE` phrases.
Lines without a word are kept and count nothing. A document is kept unless its base rules fail or its failed lines
hold more than half of its characters in words.

Defined cases: a null or empty text has no words, fails and is not kept; texts of any length are taken whole, line
by line; rows are independent, so repeated rows repeat their result; an empty table gives an empty one. `measure`
reads the id and the text column only; `clean` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.llm.names import free_names
from millrace.schema import col

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LOUD = [c.encode() for c in "!?#*$%&<>~^=_"]
SEPARATOR_WORDS = [w.encode() for w in ("|", "||", ">", ">>", "»", "›", "•", "·", "/")]
MARKS = 6
SEPARATORS = 3
BOILERPLATE_WORDS = 30
BOILERPLATE = [p.encode() for p in (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "uses cookies", "accept cookies", "lorem ipsum", "javascript", "click here", "read more", "sign in", "log in",
    "skip to content", "back to top", "subscribe to our newsletter")]
MIN_WORDS = 50
REPEAT_SHARE = 50  # per cent of words in repeated 3-word windows
MAX_LOST = 50      # per cent of characters in words that failed lines may hold

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_failed_lines long, lost_chars long, text string")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    # Number the pairs, then the triples, so that no product leaves 64 bits.
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= twice
    return int(cover.sum())


def failed_line(line: bytes, words: list[bytes]) -> bool:
    marks = sum(map(line.count, LOUD))
    if marks >= MARKS and 2 * marks > len(words):
        return True
    separators = sum(map(words.count, SEPARATOR_WORDS))
    if separators >= SEPARATORS and 4 * separators >= len(words):
        return True
    if len(words) <= BOILERPLATE_WORDS:
        low = line.lower()
        return any(phrase in low for phrase in BOILERPLATE)
    return False


def judge(text: str) -> tuple:
    """The fields of RESULT for one text; its last is the text without the failed lines."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    kept_lines, dup, failed, lost = [], 0, 0, 0
    for line in text.encode().split(b"\n"):
        if parts := line.split():
            words += parts
            dup += line in seen
            seen.add(line)
            if failed_line(line, parts):
                failed += 1
                lost += len(b"".join(parts).decode())
                continue
        kept_lines.append(line)
    n, chars, repeat = len(words), len(text) - sum(map(text.count, SPACE)), repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > REPEAT_SHARE * n
    kept = not base_failed and 100 * lost <= MAX_LOST * chars
    return (n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, base_failed, kept, failed, lost,
            b"\n".join(kept_lines).decode() if failed else text)


def _judged(docs: DataFrame, text_col: str, with_text: bool):
    fields = RESULT if with_text else RESULT.rpartition(",")[0]
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [judge(t)[:len(names)] for t in texts]
        return pd.DataFrame(rows, columns=names)

    # Else Spark pushes the filter on the result below, and judges every text twice.
    return run.asNondeterministic()(F.coalesce(col(text_col).cast("string"), F.lit("")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, kept, n_failed_lines and lost_chars of every row. One pass, no shuffle."""
    return (bounded_batches(docs).select(col(id_col).alias(id_col), _judged(docs, text_col, False).alias("__r"))
            .select(col(id_col), "__r.*"))


def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The kept documents without their failed lines, all columns in place; `length_col` is counted again."""
    name, = free_names(docs, "quality")
    judged = bounded_batches(docs).withColumn(name, _judged(docs, text_col, True)).filter(f"{name}.kept")
    text = F.col(f"{name}.text")
    return judged.select(*[text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c)
                           if c == length_col else col(c) for c in docs.columns])
