"""Vocabulary, document-term and frequency tables from a token table ``(unit_id, collection, seg_ord, tok_ord, word, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def segments(docs: DataFrame) -> DataFrame:
    """``(unit_id, collection, seg_ord, segment_id, text)``: the non-empty lines of each document."""
    rows = docs.select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("collection"), F.posexplode(F.split("text", "\n")).alias("seg_ord", "text"))
    return rows.where("text <> ''").withColumn("segment_id", F.concat_ws(":", "unit_id", "seg_ord"))


def tokens(segs: DataFrame, letters: str = T.LETTERS) -> DataFrame:
    keep = [c for c in segs.columns if c != "text"]
    return segs.select(*keep, F.posexplode(T.tokens(F.col("text"), letters)).alias("tok_ord", "word"))


def word_counts(toks: DataFrame, by: str = "collection") -> DataFrame:
    return toks.groupBy(by, "word").agg(F.count("*").alias("n"))


def term_share(toks: DataFrame, by: str = "collection") -> DataFrame:
    """Counts with the total of their book and their share of it. Totals are one row a book and meet the counts by a join, so no task holds a whole book."""
    totals = toks.groupBy(by).agg(F.count("*").alias("total")).withColumnRenamed(by, "_book")
    counts = word_counts(toks, by)
    return counts.join(totals, F.col(by).eqNullSafe(F.col("_book"))).drop("_book").withColumn("freq", F.col("n") / F.col("total"))


def document_terms(toks: DataFrame, unit: str = "unit_id", min_df: int = 1) -> DataFrame:
    """``(unit, term, n)`` in long form, for terms found in ``min_df`` documents or more."""
    counts = toks.groupBy(unit, F.col("word").alias("term")).agg(F.count("*").alias("n"))
    if min_df <= 1:
        return counts
    often = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).select("term")
    return counts.join(often, "term", "left_semi").select(unit, "term", "n")


def wide_frequencies(toks: DataFrame, min_freq: int = 5, terms: list[str] | None = None) -> DataFrame:
    """One row per term of corpus total ``min_freq`` or more with its share in each collection; shares of unfiltered totals."""
    share = term_share(toks)
    often = share.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= min_freq).select("word")
    return share.join(often, "word", "left_semi").groupBy("word").pivot("collection", terms).agg(F.first("freq")).na.fill(0.0)


def statistics(lemmas: DataFrame) -> DataFrame:
    """One row: tokens, resolved tokens, coverage and distinct lemmas of ``(word, lemma, sandhi)`` token rows."""
    resolved = F.col("lemma").isNotNull() | F.col("sandhi").isNotNull()
    out = lemmas.agg(F.count("*").alias("total_tokens"), F.count_if(resolved).alias("resolved_tokens"), F.count_distinct("lemma").alias("unique_lemmas"))
    return out.withColumn("coverage", F.when(F.col("total_tokens") > 0, F.col("resolved_tokens") / F.col("total_tokens")).otherwise(0.0))


def unit_texts(segs: DataFrame) -> DataFrame:
    """One row per unit with its segments joined by line breaks, in order."""
    rows = F.array_sort(F.collect_list(F.struct("seg_ord", "text")))
    return segs.groupBy("unit_id", "collection").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))
