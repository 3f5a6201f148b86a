"""Search tokens and diacritics folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]+)"


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and their base letters."""
    marked, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(chr(code))
            base.append(parts[0])
    return "".join(marked), "".join(base)


MARKED, BASE = _folding()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), MARKED, BASE)


def tokens(c: Column) -> Column:
    """Words of a search text; an empty array means there is nothing to search."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 1)


def search_tokens(c: Column) -> Column:
    return tokens(fold(c))
