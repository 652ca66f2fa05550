"""Sketches of fixed size, built from all rows, that tasks use to skip what cannot matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a membership sketch: 8 MB whatever the data. A full one lets everything through and loses nothing.
BITS = 26


def members(hashes: DataFrame) -> np.ndarray:
    """uint64 words with a bit for each hash in the one long column of ``hashes``; at most 2**20 words come back."""
    (h,) = hashes.columns
    bit = F.col(h).bitwiseAND(F.lit((1 << BITS) - 1))
    flag = F.expr("shiftleft(cast(1 as bigint), cast(b & 63 as int))")
    rows = hashes.select(bit.alias("b")).select(F.shiftright("b", 6).alias("word"), flag.alias("flag"))
    table = rows.groupBy("word").agg(F.bit_or("flag").alias("flags")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("flags").to_numpy().view(np.uint64)
    return out


def may_hold(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    b = hashes & np.uint64((1 << BITS) - 1)
    return (sketch[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)


def member_table(hashes: DataFrame) -> DataFrame:
    """``(line, flags)``: the same sketch as 2**14 rows at most of 64 words each, for joins without Python; 17 MB as a broadcast."""
    (h,) = hashes.columns
    bit = F.col(h).bitwiseAND(F.lit((1 << BITS) - 1))
    flag = F.expr("shiftleft(cast(1 as bigint), cast(b & 63 as int))")
    words = hashes.select(bit.alias("b")).select(F.shiftright("b", 6).alias("word"), flag.alias("flag")).groupBy("word").agg(F.bit_or("flag").alias("flags"))
    slot = F.col("word").bitwiseAND(F.lit(63))
    lines = words.groupBy(F.shiftright("word", 6).alias("line")).agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), "flags"))).alias("words"))
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("words", k.cast("long")), F.lit(0).cast("long")))
    return lines.select("line", every.alias("flags"))


def only_members(rows: DataFrame, table: DataFrame, value: Column) -> DataFrame:
    """The ``rows`` whose hash ``value`` a ``member_table`` may hold."""
    b = value.bitwiseAND(F.lit((1 << BITS) - 1))
    near = table.withColumnsRenamed({"line": "__line", "flags": "__flags"})
    bit = F.getbit(F.get("__flags", F.shiftright(b, 6).bitwiseAND(F.lit(63)).cast("int")), b.bitwiseAND(F.lit(63)).cast("int"))
    return rows.join(F.broadcast(near), (F.shiftright(b, 12) == F.col("__line")) & (bit == 1)).drop("__line", "__flags")
