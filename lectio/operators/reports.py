"""Comparison and quality reports over texts and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency_gaps(counts: DataFrame, left: str, right: str) -> DataFrame:
    """Words of two collections whose counts differ by more than max(1, a fifth of the smaller), missing as 0."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("collection") == c, F.col("n"))), F.lit(0))
    both = counts.where(F.col("collection").isin(left, right)).groupBy("word").agg(pick(left).alias("n_left"), pick(right).alias("n_right"))
    gap = F.abs(F.col("n_left") - F.col("n_right"))
    return both.withColumn("gap", gap).where((F.col("n_left") > 0) & (F.col("n_right") > 0) & (gap > F.greatest(F.lit(1.0), 0.2 * F.least("n_left", "n_right"))))


def only_in(counts: DataFrame, left: str, right: str) -> DataFrame:
    """Words of one collection that the other lacks."""
    a = counts.where(F.col("collection") == left).select("word", "n")
    return a.join(counts.where(F.col("collection") == right).select("word"), "word", "left_anti")


def overlap(counts: DataFrame) -> DataFrame:
    """Jaccard overlap of the vocabularies of each two collections, from one shuffle by word."""
    per = counts.groupBy("word").agg(F.array_sort(F.collect_set("collection")).alias("in"))
    sizes = per.select(F.explode("in").alias("c")).groupBy("c").agg(F.count("*").alias("size"))
    pairs = per.select(F.explode("in").alias("a"), "in").select("a", F.explode("in").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    one, two = sizes.select(F.col("c").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("c").alias("b"), F.col("size").alias("size_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "shared", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))


def unknown_words(tokens: DataFrame, known: DataFrame, texts: int = 5) -> DataFrame:
    """Words without an entry: count, number of units, first unit, and a sorted sample of units."""
    rows = tokens.join(known.select("word").distinct(), "word", "left_anti")
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("n_units"), F.min("unit_id").alias("first_unit"), F.slice(F.array_sort(F.collect_set("unit_id")), 1, texts).alias("units"))


def text_quality(texts: DataFrame) -> DataFrame:
    """Penalty score of a scan: share of accented letters, broken pieces, garbage lines; banded at 70 and 50."""
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    accented = F.regexp_count("text", F.lit("[āīūṭḍṇṅñṃḷàâäáãéèêëíìîïóòôöúùûüçß]"))
    pieces = F.regexp_count("text", F.lit(r"(?<![\p{L}])\p{L}(?![\p{L}])"))
    bad = F.size(F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 0) & (2 * F.length(F.regexp_replace(x, r"[^\p{L}]", "")) < F.length(x))))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.least(F.lit(40), bad * 5) - F.least(F.lit(40), pieces))
    rows = texts.select("unit_id", letters.cast("long").alias("letters"), accented.cast("long").alias("accented"), pieces.cast("long").alias("pieces"), bad.cast("long").alias("bad_lines"), score.alias("score"))
    return rows.withColumn("band", F.when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").otherwise("poor"))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of ``n`` by the given columns with subtotals and a grand total."""
    return rows.rollup(*by).agg(F.sum("n").alias("n"))
