"""The registered queries of this subpackage, with the parameters meant for production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from . import chat, html_crf, lines, mixing, neighbours, phrases, pieces, pii, quality, scratch, simhash
from .words import count_words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (3-word shingles, 3 bits)."""
    prints = scratch.cut(simhash.fingerprints(_table(spark, sf_dir, "documents")), "simhash")
    found = simhash.near_duplicates(prints, limit=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document, and the terms that disclose them."""
    out = pii.detect(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.render(F.col("spans")), 256).alias("base_sha256"), pii.render(pii.all_spans()).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, with its source's size and target."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("words"))
    out = mixing.mix(scratch.cut(docs, "sizes"), F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that recur in the corpus."""
    out = phrases.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines with words, and the numbers of those that an earlier line of the corpus makes redundant."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    found = lines.removed_lines(docs).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from its prefix-tree pack, and one that holds control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, k, r, chat.SAMPLE_TEXT) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.packs(rows.unionByName(extra)))


#: Where the public tokenizer's model file is, on the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's piece ids, and whether they decode to the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    out = pieces.encode_decode(docs, PIECES)
    digest = F.sha2(F.array_join("ids", ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("sha")).alias("exact"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality cascade for every document."""
    out = quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_simhash": op2_simhash, "op3_neighbours": op3_neighbours, "op4_pii": op4_pii, "op5_mixing": op5_mixing, "op6_phrases": op6_phrases, "op7_lines": op7_lines, "op8_pieces": op8_pieces, "op9_chat": op9_chat, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": chat.ORACLE, "op10_quality": quality.oracle()}
