"""The normal forms of functions/normal.py in the oracle's SQL."""

from __future__ import annotations


SPLITS = ("train", "val", "test_unseen", "held", "eval_only")


def bare(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def hex_digits(c: str, n: int) -> str:
    return f"CASE WHEN regexp_full_match({bare(c)}, '([a-z][a-z0-9_-]*:\\s*)?(0x)?[0-9a-f]{{{n}}}') THEN right({bare(c)}, {n}) END"


def sha(c: str = "sha256") -> str:
    return hex_digits(c, 64)


def phash(c: str = "phash") -> str:
    """Unsigned, for bits are counted only."""
    return f"CAST('0x' || ({hex_digits(c, 16)}) AS UBIGINT)"


def split(c: str = "split") -> str:
    s = f"replace({bare(c)}, '-', '_')"
    return f"CASE WHEN {s} IN ('train', 'val', 'test_unseen', 'held', 'eval_only') THEN {s} END"


def name(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '')"
