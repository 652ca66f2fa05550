"""Marker-to-range segmentation: ordered markers, numbering, and the text up to the next marker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import placed


def markers(texts: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """``(unit_id, nth, start, marker, value)``: matches of ``pattern`` with their places (from 0), in order.

    The places come from the lengths of the gaps and the matches before, in built-in functions.
    """
    gaps, hits, values = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    starts = placed(gaps, hits)
    found = texts.select("unit_id", F.arrays_zip(starts.alias("start"), hits.alias("marker"), values.alias("value")).alias("all"))
    return found.select("unit_id", F.posexplode("all").alias("nth", "m")).select("unit_id", "nth", "m.start", "m.marker", "m.value")


def ranges(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Markers with the text of their range: from the marker to the next one, or to the end."""
    nxt = F.lead("start").over(Window.partitionBy("unit_id").orderBy("start"))
    rows = found.withColumn("next", nxt).join(texts.select("unit_id", "text"), "unit_id")
    rows = rows.withColumn("end", F.coalesce("next", F.length("text")).cast("int"))
    return rows.select("unit_id", "nth", "value", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("body"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Running count within a group."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def repaired(rows: DataFrame, group: str, order: str, raw: str) -> DataFrame:
    """Strictly rising numbers: each is its raw one, or one above the last. Closed form: place + running max of (raw - place)."""
    w = Window.partitionBy(group).orderBy(order)
    place = F.row_number().over(w)
    rows = rows.withColumn("_p", place)
    gain = F.when(F.col("_p") == 1, F.greatest(F.col(raw), F.lit(1))).otherwise(F.col(raw)) - F.col("_p")
    return rows.withColumn("_g", gain).withColumn("repaired", F.col("_p") + F.max("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_g")


def rising(rows: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Rows whose number is above all accepted before, which is above all before."""
    before = F.max(number).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_b", before).where(F.col(number) > F.coalesce("_b", F.lit(0))).drop("_b")


def nearest_before(rows: DataFrame, group: str, order: str, marker: str, into: str = "last_marker") -> DataFrame:
    """The last non-null marker at or before each row (a backward as-of join with itself)."""
    return rows.withColumn(into, F.last(marker, True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def nearest_both(rows: DataFrame, group: str, order: str, anchor: str) -> DataFrame:
    """Previous and next anchor of each row, and the value between them in proportion to the place."""
    back, ahead = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(anchor).isNotNull(), F.col(order))
    rows = rows.withColumns({"previous": F.last(anchor, True).over(back), "following": F.first(anchor, True).over(ahead), "_a": F.last(place, True).over(back), "_z": F.first(place, True).over(ahead)})
    between = F.col("previous") + (F.col("following") - F.col("previous")) * (F.col(order) - F.col("_a")) / (F.col("_z") - F.col("_a"))
    return rows.withColumn("estimate", F.when(F.col("_z") == F.col("_a"), F.col(anchor).cast("double")).otherwise(between)).drop("_a", "_z")


def first_writer(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
