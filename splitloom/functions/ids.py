"""Numbers behind unevenly spelled ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer blanks (of any script), a word before the number with or without a joint, a plus, leading zeros, ".0".
#: Nothing else spells a number; 18 digits at most, so that every number fits a BIGINT with room for a tag.
NUMBER_PATTERN = r"^[\s\p{Z}]*(?:\p{L}+[_:# ]?)?\+?0*([1-9][0-9]{0,17})(?:\.0*)?[\s\p{Z}]*$"

#: The blanks of any script, \\s and \\p{Z} of the pattern (fixed values).
BLANKS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled_number(c: Column) -> Column:
    """The one positive whole number that a text spells, else null (null, blank, zero, negative, fractions, words)."""
    # most ids are plain digits, which a cast reads without the pattern
    plain = c.try_cast("bigint")
    return F.when(plain.between(1, 10**18 - 1), plain).otherwise(F.regexp_extract(c, NUMBER_PATTERN, 1).try_cast("bigint"))


def spelled_numbers(c: Column) -> Column:
    """The distinct numbers that an array of texts spells; an empty array where it spells none or is null."""
    found = F.filter(F.transform(c, spelled_number), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(found), F.array().cast("array<bigint>"))
