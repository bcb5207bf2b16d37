"""Left joins that survive a key holding a large share of the rows.

Adaptive execution splits a skewed join only when both sides come straight out
of a shuffle.  The fact build joins against aggregated sides, where that rule
does not apply, so hot keys are found up front and spread explicitly.

``hot_keys`` is one map-side sketch per key set: it moves no rows, returns at
most ``MAX_TRACKED`` hashes per key set, and its answer only decides how rows
are spread, never which rows are joined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row_nr"
SLOT = "_slot"
MAX_TRACKED = 256


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys to spread and the number of slots each one gets."""

    hashes: tuple[int, ...] = ()
    slots: int = 1

    def __bool__(self) -> bool:
        return bool(self.hashes)


def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.xxhash64(*[df[k] for k in keys])


def hot_keys(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> dict[str, HotKeys]:
    """Keys holding more rows than two average shuffle partitions, per key set.

    One pass over the key columns serves all key sets.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usable = {name: keys for name, keys in key_sets.items() if set(keys) <= set(df.columns)}
    if not usable:
        return {name: HotKeys() for name in key_sets}
    hashed = df.select(*[_key_hash(df, keys).alias(name) for name, keys in usable.items()])
    found = hashed.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.expr(f"approx_top_k(`{name}`, {MAX_TRACKED})").alias(name) for name in usable],
    ).first()
    result = {}
    for name in key_sets:
        tops = found[name] if name in usable else []
        limit = max(2.0 * found["_rows"] / partitions, 1.0)
        hot = [t for t in tops if t["count"] > limit]
        if not hot:
            result[name] = HotKeys()
            continue
        share = max(t["count"] for t in hot) / found["_rows"]
        result[name] = HotKeys(tuple(t["item"] for t in hot), max(2, math.ceil(share * partitions)))
    return result


def with_row_number(df: DataFrame) -> DataFrame:
    """Number the rows of a stored table, as the source of spreading.

    Call it directly on a scan: row order is fixed there, so a task that runs
    again after a lost executor numbers its rows as before.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: HotKeys = HotKeys()) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys``; rows of hot keys are spread over slots.

    Hot left rows get a slot from their row number.  The matching right rows, at
    most ``MAX_TRACKED`` keys, are repeated once per slot, so each left row still
    meets each of its right rows exactly once.  ``left`` must not be partitioned by
    a part of ``keys``, which holds after a scan or a spread join.
    """
    keys = list(keys)
    if not hot:
        return left.join(right, keys, "left")
    for key in keys:
        if left.schema[key].dataType != right.schema[key].dataType:
            raise TypeError(f"join key {key!r} must have one type on both sides to be spread")
    # A NULL key matches nothing, so it needs no partner in the slots it is spread over.
    left_hot = _key_hash(left, keys).isin(*hot.hashes)
    right_hot = _key_hash(right, keys).isin(*hot.hashes)
    spread = F.when(left_hot, F.pmod(left[ROW], F.lit(hot.slots)).cast("int")).otherwise(F.lit(0))
    copies = F.when(right_hot, F.sequence(F.lit(0), F.lit(hot.slots - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn(SLOT, spread)
    # An aggregated right side is already placed by its keys, and Spark would move
    # the left rows there, slots or not.  Placing it by key and slot prevents that.
    repeated = right.withColumn(SLOT, F.explode(copies)).repartition(*keys, SLOT)
    return salted.join(repeated, [*keys, SLOT], "left").drop(SLOT)
