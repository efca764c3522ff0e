"""Text expressions. All stay on the JVM side, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when a review or label is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the quote run that is removed from reviews.
TRIPLE_QUOTE = '"""'


def strip_unicode(col: Column) -> Column:
    """Strip white space at both ends, Unicode spaces included (plain ``trim`` only strips U+0020)."""
    return F.trim(col, F.lit(WHITE_SPACE))


def clean_text(col: Column) -> Column:
    """Cast to string, strip, then drop every triple quote; what the removal uncovers is not stripped again."""
    return F.replace(strip_unicode(col.cast("string")), F.lit(TRIPLE_QUOTE), F.lit(""))


def clean_label(col: Column) -> Column:
    return strip_unicode(col.cast("string"))


def split_tokens(col: Column) -> Column:
    """All lower-case tokens, split on runs of anything but letters and digits."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def cap_tokens(col: Column, max_tokens: int = 512) -> Column:
    """The first ``max_tokens`` tokens."""
    return F.slice(split_tokens(col), 1, max_tokens)
