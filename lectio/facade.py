"""A corpus of segments with the read API: lists, texts, search, vocabulary, matrices, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import search as S
from .operators import vocabulary as V
from .sinks import exports as X


class Corpus:
    """``segments``: ``(unit_id, collection, seg_ord, segment_id, text)``; ``tokens`` adds ``tok_ord, word, lemma, pos, sandhi, components``."""

    def __init__(self, segments: DataFrame, tokens: DataFrame | None = None):
        self.segments, self._tokens = segments, tokens

    @property
    def tokens(self) -> DataFrame:
        return self._tokens if self._tokens is not None else V.tokens(self.segments)

    def list_collections(self) -> DataFrame:
        return self.segments.groupBy("collection").agg(F.count_distinct("unit_id").alias("units"), F.count("*").alias("segments")).orderBy("collection")

    def list_units(self, collection: str) -> DataFrame:
        return self.segments.where(F.col("collection") == collection).groupBy("unit_id").agg(F.count("*").alias("segments")).orderBy("unit_id")

    def get_unit(self, unit) -> DataFrame:
        """Segments of a unit; a unit inside a range such as ``abc1-20`` finds the range."""
        own = self.segments.where(F.col("unit_id") == unit)
        return own.unionByName(self.segments.where(T.in_range(F.lit(str(unit)), F.col("unit_id").cast("string")))).orderBy("seg_ord")

    def get_segments(self, unit, first: str, last: str) -> DataFrame:
        """From one segment id to another, both included; an unknown id or a reversed range gives none."""
        rows = self.segments.where(F.col("unit_id") == unit)
        ends = rows.agg(F.min(F.when(F.col("segment_id") == first, F.col("seg_ord"))), F.min(F.when(F.col("segment_id") == last, F.col("seg_ord")))).first()
        return rows.where(F.col("seg_ord").between(*ends) if None not in ends else F.lit(False)).orderBy("seg_ord")

    def get_text(self, unit) -> str:
        row = V.unit_texts(self.segments.where(F.col("unit_id") == unit)).first()
        return row["text"] if row else ""

    def search_lemma(self, lemma: str, collection: str | None = None, limit: int = 1000) -> tuple[int, dict, DataFrame]:
        """Total, counts by collection, and occurrences (the total is not limited)."""
        rows = S.postings(self.tokens).where(F.col("lemma") == lemma)
        if collection is not None:
            rows = rows.where(F.col("collection") == collection)
        by = {r[0]: r[1] for r in rows.groupBy("collection").count().collect()}
        return sum(by.values()), by, rows.orderBy("unit_id", "segment_id", "word").limit(limit)

    def search_text(self, query: str, collection: str | None = None, limit: int = 100) -> DataFrame:
        return S.search_text(self.segments, query, collection, limit)

    def all_lemmas(self) -> DataFrame:
        return S.postings(self.tokens).select("lemma").distinct().orderBy("lemma")

    def vocabulary(self, collection: str | None = None, unit=None, top: int = 100) -> DataFrame:
        """Counts of lemmas, components only where a token has no lemma; the most frequent first, ties by lemma."""
        rows = self.tokens
        rows = rows.where(F.col("collection") == collection) if collection is not None else rows
        rows = rows.where(F.col("unit_id") == unit) if unit is not None else rows
        parts = F.transform("components", lambda c: c["lemma"])
        names = rows.select(F.explode(F.when(F.coalesce("lemma", F.lit("")) != "", F.array("lemma")).otherwise(parts)).alias("lemma")).where("lemma <> ''")
        return names.groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(top)

    def document_terms(self, unit: str = "unit_id", min_df: int = 1) -> DataFrame:
        return V.document_terms(self.tokens, unit, min_df)

    def export_vocabulary(self, path: str) -> None:
        X.vocabulary_csv(self.tokens.groupBy("word").agg(F.count("*").alias("n")), path)

    def export_matrix(self, path: str, min_df: int = 2) -> None:
        X.matrix_csv(self.tokens, path, min_df=min_df)

    def export_bundle(self, folder: str) -> None:
        """Long, wide and text tables of collections and of units."""
        X.write_csv(X.long_table(self.tokens), f"{folder}/long")
        X.write_csv(X.long_table(self.tokens, "unit_id"), f"{folder}/units_long")
        X.write_csv(V.wide_frequencies(self.tokens, 10).orderBy("word"), f"{folder}/wide")
        X.write_csv(V.unit_texts(self.segments), f"{folder}/units_raw")

    def to_latex(self, unit) -> str:
        return X.latex(self.segments.where(F.col("unit_id") == unit), str(unit))
