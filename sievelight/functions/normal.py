"""Normal forms of manifest fields: hashes, splits and names, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test_unseen", "held", "eval_only")
EVALUATION_SPLITS = ("val", "test_unseen", "eval_only")


#: The characters that count as white space around a value.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _bare(value: Column) -> Column:
    """Lower case, without surrounding white space."""
    return F.lower(F.trim(value, F.lit(SPACE)))


def _hex_digits(value: Column, digits: int) -> Column:
    """A pattern is only matched where a value is longer than its digits; the digits are checked by translation."""
    bare = _bare(value)
    text = F.when(F.length(bare) > digits, F.regexp_replace(bare, r"^(?:[a-z][a-z0-9_-]*:\s*)?(?:0x)?", "")).otherwise(bare)
    return F.when((F.length(text) == digits) & (F.translate(text, "0123456789abcdef", "") == ""), text)


def _hex_bytes(value: Column, digits: int) -> Column:
    """The bytes of so many hex digits. A value of just these is decoded as it is, all others are brought to their digits first."""
    return F.coalesce(F.when(F.length(value) == digits, F.unhex(value)), F.unhex(_hex_digits(value, digits)))


def sha256_bytes(value: Column) -> Column:
    """The 32 bytes of a SHA-256 value in any spelling; null where it identifies nothing."""
    return _hex_bytes(value, 64)


def phash_bytes(value: Column) -> Column:
    """The 8 bytes of a perceptual hash in any spelling; null where it identifies nothing."""
    return _hex_bytes(value, 16)


def sha256_of(value: Column) -> Column:
    """The 64 hex digits of a SHA-256 value in any spelling; null where it identifies nothing."""
    return F.lower(F.hex(sha256_bytes(value)))


def phash_of(value: Column) -> Column:
    """A perceptual hash as bigint; null where it identifies nothing.

    Two halves are converted, for a conversion of 16 digits at once overflows above 2^63.
    """
    plain = (F.length(value) == 16) & F.unhex(value).isNotNull()
    found = F.when(plain, value).otherwise(_hex_digits(value, 16))
    high = F.conv(F.substring(found, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(found, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def split_of(value: Column) -> Column:
    """One of SPLITS; null where the value names none."""
    name = F.replace(_bare(value), F.lit("-"), F.lit("_"))
    return F.when(value.isin(*SPLITS), value).otherwise(F.when(name.isin(*SPLITS), name))


def name_of(value: Column) -> Column:
    """A source, generator or category name: letters and digits in lower case; null if none is left."""
    name = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))
    return F.when(name != "", name)
