"""One CSV dialect for writing and reading.

Quotes are doubled inside quotes, line breaks may stand inside quotes, spaces are kept, quoted empty text stays apart
from a missing value, and moments keep their microseconds.
"""

from __future__ import annotations

_QUOTES = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

CSV_WRITE = {**_QUOTES, "nullValue": "", "emptyValue": '""', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
             "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# The reader takes an unquoted empty field for `nullValue`, so that must be something no field holds.
CSV_READ = {**_QUOTES, "nullValue": "\u0000", "emptyValue": ""}


def csv_read_options(multi_line: bool = True) -> dict:
    """With `multi_line` a file is one task's work; without, files are split, but no field may hold a line break."""
    return {**CSV_READ, "multiLine": multi_line}
