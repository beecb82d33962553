"""Parts of a legal description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.text import col

# Patterns of the parts. They are deliberately unanchored: "LOT12"
# also reads as township 12, and results must keep that.
LEGAL_PATTERNS = {
    "subdivision": r"(?i)LOT\s+\d+,\s+([^,]+)",
    "block": r"(?i)BLOCK\s+(\d+)",
    "section": r"(?i)S(\d+)",
    "township": r"(?i)T(\d+)",
    "range": r"(?i)R(\d+)",
}


def legal_part(c: Column | str, part: str) -> Column:
    """One part of a description; empty text when absent."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), LEGAL_PATTERNS[part], 1)
    return F.trim(found)
