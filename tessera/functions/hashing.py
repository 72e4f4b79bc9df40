"""Seeded, engine-independent pseudo-random numbers from row keys.

Both helpers are pure functions of ``(seed, key)``: a recomputed task after
an executor loss gets the same value, and DuckDB can reproduce them from
the same md5 text (``('0x' || substr(md5(s), 1, k))::BIGINT``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.types import qcol


def _seeded_md5(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def order_hash(key: Column, seed: int) -> Column:
    """60-bit non-negative ordering key (first 15 hex digits of md5)."""
    return F.conv(F.substring(_seeded_md5(key, seed), 1, 15), 16, 10).cast("long")


def uniform01(key: Column, seed: int) -> Column:
    """Uniform value in [0, 1) (first 8 hex digits of md5 / 2^32)."""
    return F.conv(F.substring(_seeded_md5(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def row_key(*cols: str) -> Column:
    """A single string key from one or more key columns."""
    if len(cols) == 1:
        return qcol(cols[0]).cast("string")
    return F.concat_ws("|", *[qcol(c).cast("string") for c in cols])
