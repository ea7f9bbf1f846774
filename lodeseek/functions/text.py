"""Text to terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """The text's terms in order: lower case, runs of letters and numbers, of two bytes or more in UTF-8. Null: none."""
    c = F.col(text) if isinstance(text, str) else text
    runs = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(runs, lambda t: F.octet_length(t) > 1)
