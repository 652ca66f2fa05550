"""Words as these operators define them: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    """The words in order, as an array; null or wordless text gives an empty one."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))
