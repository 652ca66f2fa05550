"""A corpus pipeline of five stages, from raw documents to a de-duplicated, mixed and encoded corpus.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``. Counted with ``lectio.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio import ship
from lectio.llm import lines, mixing, pieces, quality, scratch, simhash
from lectio.llm.queries import PIECES
from lectio.llm.words import count_words


#: The columns that the stages read. Others pass through under other names, so that none can clash.
READ = ("doc_id", "text", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that no stage reads renamed, and what gives a result the columns of ``docs`` again."""
    names = {c: c if c in READ else f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda out: out.select(*[F.col(new).alias(old) for old, new in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade rejects go.

    Each row is judged by its own text: null and empty texts have too few words and go, repeated rows share one
    verdict, other columns are not read. An empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents left without a word by that; ``n_chars`` follows the text.

    Earlier is by id (null first), line, text hash. Null texts stay, as do texts without words; rows that agree in
    id and text keep the same lines, each of them. An empty table stays empty.
    """
    ship(spark)
    plain, back = _apart(docs)
    out = lines.drop_lines(plain)
    out = out.where((F.col("n_removed") == 0) | (count_words(F.col("text")) > 0))
    return back(out.withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more): that of least id.

    A null id comes first; ties go to the lesser text hash, and of rows that agree in id and text one stays. Texts
    without a word, null ones too, are copies of each other. An empty table stays empty.
    """
    ship(spark)
    plain, back = _apart(docs)
    return back(simhash.keep_one(plain, shingle=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, 0 to 2.

    A null source is one of its own; null texts have no words and are taken or left by the share of their source.
    Ties between documents of one length fall by a hash of id and text; rows that agree in both are told apart by
    nothing. An empty table stays empty.
    """
    ship(spark)
    plain, back = _apart(docs)
    order = plain.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = mixing.mix(order, count_words(F.col("text")), order_cols=("doc_id", "__mark"))
    return back(out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` less the text, with ``ids`` and their number ``n_pieces``, which replace columns of those names.

    Null and empty texts have the space piece alone; every row is encoded by itself. An empty table stays empty.
    """
    ship(spark)
    return pieces.encode(docs, PIECES).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Near-duplicate groups, budget fitting and piece encoding are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
    return docs
