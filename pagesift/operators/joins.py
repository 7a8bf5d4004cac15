"""Equi-joins that broadcast a side of measured size and salt hot keys otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
#: left rows of a key that one salt takes, about
SALT_ROWS = 1_000_000
#: a null key matches nothing; its rows are dealt out over so many places
NULL_SALTS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Rows times a fixed row cost plus the text lengths: a small distributed aggregate."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = [name for name, kind in kinds.items() if kind in ("string", "binary")]
    # short arrays, such as a SHA1's routes
    arrays = sum(kind.startswith("array") for kind in kinds.values())
    total = F.count(F.lit(1)) * (16 + 16 * len(kinds) + 128 * arrays)
    for name in texts:
        total = total + F.coalesce(F.sum(F.octet_length(F.col(name))), F.lit(0))
    return df.agg(total.alias("bytes")).first()["bytes"]


def equi_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = SALT_ROWS,
) -> DataFrame:
    """`left` joined with `right` on `key`, where any key may hold a large share of `left`.

    A small right side is broadcast after its size is measured. Otherwise the left rows of a key
    are counted, a key with more than `hot_rows` is spread over as many salts as it needs by
    `spread`, and its right rows are copied to each of them. Salts affect speed, never the result.
    """
    if measured_bytes(right) <= broadcast_bytes:
        return left.join(F.broadcast(right), key, how)
    # at most one row per hot_rows left rows
    hot = F.broadcast(
        left.filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    )
    salted_left = (
        left.join(hot, key, "left")
        .withColumn(
            "_salt",
            # a null key matches nothing, so its rows may go anywhere
            F.pmod(
                F.xxhash64(F.col(spread)),
                F.when(F.col(key).isNull(), NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1))),
            ).cast("int"),
        )
        .drop("_salts")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = (
        right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
