"""Text column expressions: tokens, digests and seeded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairweave.functions.vectors import col


# Fixed value: characters that separate words.
BLANKS = r"[ \t\n\r\f\x0B\x00]+"


def words(text: str | Column) -> Column:
    """Non-empty tokens between runs of blanks."""
    parts = F.split(col(text), BLANKS)
    return F.filter(parts, lambda w: w != "")


def text_key(text: str | Column) -> Column:
    """Digest that stands for a text in joins, so shuffles do not carry it."""
    return F.sha2(col(text), 256)


def seeded_digest(key: str | Column, seed: int | str) -> Column:
    """md5 hex of ``seed:key``: the pseudo-random order used for sampling."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def digest_number(digest: Column, first: int = 1, digits: int = 8) -> Column:
    """Some hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def seeded_number(key: str | Column, seed: int | str) -> Column:
    return digest_number(seeded_digest(key, seed))
