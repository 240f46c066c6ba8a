"""Column builders for text and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks around a value: ASCII and the no-break, em, ideographic and similar spaces.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """The value without blanks at its ends."""
    return F.btrim(c(x), F.lit(BLANKS))


def id_upper(x: Column | str) -> Column:
    """An id as compared (case and blanks aside), in upper case; empty becomes null as it names nobody."""
    return F.nullif(F.upper(strip(x)), F.lit(""))


def id_lower(x: Column | str) -> Column:
    return F.nullif(F.lower(strip(x)), F.lit(""))


def split_key(x: Column | str) -> Column:
    """A split name as compared: case, blanks and ``-``/``_`` aside; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(strip(x)), "-", "_"), F.lit(""))


def category_key(x: Column | str) -> Column:
    """Lower case without any blanks; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(c(x)), r"(?U)[\s\x1c-\x1f]+", ""), F.lit(""))


def clean_text(x: Column | str) -> Column:
    """TX1: null as empty, tags to a blank, runs of Unicode white space to one blank, ends stripped."""
    bare = F.regexp_replace(F.coalesce(c(x), F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "))


def word_count(x: Column | str) -> Column:
    """TX10: pieces between runs of ASCII white space (a text of blanks counts one empty piece)."""
    return F.size(F.split(F.trim(c(x)), r"[ \t\n\f\r]+"))


def fingerprint(x: Column | str) -> Column:
    """TX11: md5 of the lower-case text with collapsed white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(c(x), r"[ \t\n\f\r]+", " "))))


def md5_low64(x: Column | str) -> Column:
    """TX12: last eight digest bytes of md5, little-endian, unsigned, as decimal(20,0)."""
    h = F.md5(c(x).cast("string"))
    swapped = F.concat(*[F.substring(h, 17 + 2 * i, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def bucket100(x: Column | str) -> Column:
    return (md5_low64(x) % 100).cast("int")


def title_key(x: Column | str) -> Column:
    """TX7: lower case, anything but a-z and 0-9 to one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z0-9]+", " "))


def spreadsheet_safe(x: Column | str) -> Column:
    """SNK9: text that a spreadsheet would run as a formula gets a leading quote."""
    x = c(x)
    return F.when(x.rlike(r"^[ \t\r\n\f\x0b]*[=+\-@]|^[\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
