"""Lemma postings and full-text search over segments, as filters on folded token arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and the plain letters that search folds them to.
ACCENTED = "āīūṭḍṇṅñṃṁḷàâäáãéèêëíìîïóòôöúùûüçñß"
PLAIN = "aiutdnnnmmlaaaaaeeeeiiiioooouuuucns"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def folded(segs: DataFrame) -> DataFrame:
    """Segments with ``terms``: folded words of the id, the collection and the text."""
    word = r"[\p{L}\p{N}]+"
    parts = [F.regexp_extract_all(fold(F.col(c).cast("string")), F.lit(word), F.lit(0)) for c in ("segment_id", "unit_id", "collection", "text")]
    return segs.withColumn("fields", F.array(*[F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" ")) for p in parts]))


class QueryError(ValueError):
    """A full-text query that does not parse."""


def _has(term: str, prefix: bool) -> Column:
    fold_table = str.maketrans(ACCENTED, PLAIN)
    words = re.findall(r"[^\W_]+", term.lower().translate(fold_table))
    if not words:
        raise QueryError(term)
    wanted = " " + " ".join(words) + ("" if prefix else " ")
    return F.exists("fields", lambda f: f.contains(wanted))


def parse(query: str) -> Column:
    """Predicate on ``fields``: terms, "phrases", prefix*, AND (also implied), OR, NOT, parentheses."""
    items = re.findall(r'"[^"]*"\*?|[()]|[^\s()"]+|"', query)
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        at += 1
        return items[at - 1]

    def either() -> Column:
        left = both()
        while peek() == "OR":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = less()
        while peek() is not None and peek() not in ("OR", ")", "NOT"):
            if peek() == "AND":
                take()
            left = left & less()
        return left

    def less() -> Column:
        left = one()
        while peek() == "NOT":
            take()
            left = left & ~one()
        return left

    def one() -> Column:
        item = take() if at < len(items) else None
        if item is None or item in ("OR", "AND", "NOT", ")", '"') or item.startswith("-"):
            raise QueryError(query)
        if item == "(":
            inner = either()
            if at >= len(items) or take() != ")":
                raise QueryError(query)
            return inner
        return _has(item.rstrip("*"), item.endswith("*"))

    out = either()
    if at < len(items):
        raise QueryError(query)
    return out


def search_text(segs: DataFrame, query: str, collection: str | None = None, limit: int | None = None) -> DataFrame:
    """Matching segments in corpus order; a query that does not parse finds nothing."""
    rows = folded(segs)
    try:
        rows = rows.where(parse(query))
    except QueryError:
        rows = rows.where(F.lit(False))
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    rows = rows.drop("fields")
    return rows.orderBy("unit_id", "seg_ord").limit(limit) if limit is not None else rows


def postings(tokens: DataFrame) -> DataFrame:
    """A row per lemma and one per component lemma of each token, components also where the token has a lemma."""
    own = F.array(F.struct(F.col("lemma").alias("lemma"), F.col("pos").alias("pos")))
    parts = F.coalesce(F.transform("components", lambda c: F.struct(c["lemma"].alias("lemma"), c["pos"].alias("pos"))), F.expr("cast(array() as array<struct<lemma:string,pos:string>>)"))
    rows = tokens.select("word", "segment_id", "unit_id", "collection", F.explode(F.concat(own, parts)).alias("x"))
    return rows.select("x.lemma", "x.pos", "word", "segment_id", "unit_id", "collection").where("lemma <> ''")


def segment_range(segs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Segments of each unit from ordinal ``first`` to ``last``, both included."""
    return segs.where(F.col("seg_ord").between(first, last))
