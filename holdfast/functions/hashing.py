"""Key-hashed pseudo-randomness: the same row draws the same number on every run and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """Uniform number in [0, 1) from md5(key-salt). Use one salt per purpose."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def prediction_id(key: Column, at: Column, whole: Column | None = None, digits: int = 16) -> Column:
    """``pred_<time>_<hex>``; the hex part hashes key and time, so a replay repeats the id.

    A record without key or time is told apart by ``whole``, its input text; without a time it is ``pred_untimed_``.
    """
    stamp = F.coalesce(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("untimed"))
    named = F.concat_ws("-", key.cast("string"), stamp)
    if whole is not None:
        named = F.when(key.isNull() | at.isNull(), F.concat_ws("-", stamp, whole)).otherwise(named)
    return F.concat(F.lit("pred_"), stamp, F.lit("_"), F.substring(F.sha2(named, 256), 1, digits))


def record_digest(id_column: Column, whole: Column) -> Column:
    """What tells logged records apart: two inputs of one key in the same second are two records."""
    return F.sha2(F.concat_ws("-", id_column, whole), 256)
