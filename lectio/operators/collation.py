"""Collation of witnesses: word alignment, classification of differences, apparatus and counts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_key

#: Words of two letters or fewer that are words of their own. Fixed values.
SHORT_WORDS = ("ti", "ca", "vā", "no", "na", "so", "te", "me", "ye", "pi")
WITNESSES = ("base", "w1", "w2", "w3", "w4")


def align_words(first: list[str], second: list[str]) -> list[tuple]:
    """``(type, word1, word2, idx1, idx2)`` of the matcher's operations; replaced runs are paired in order and padded."""
    out = []
    for op, i, i_end, j, j_end in SequenceMatcher(None, first, second).get_opcodes():
        kind = {"equal": "match", "replace": "variant"}.get(op, op)
        for k in range(max(i_end - i, j_end - j)):
            a, b = i + k if i + k < i_end else None, j + k if j + k < j_end else None
            out.append((kind, None if a is None else first[a], None if b is None else second[b], a, b))
    return out


def alignments(pairs: DataFrame) -> DataFrame:
    """Alignment rows of ``(unit_id, witness, base, other)`` word arrays; each pair is one row, so pairs run in parallel."""

    def run(frames):
        for f in frames:
            rows = [(u, w, *r) for u, w, a, b in f[["unit_id", "witness", "base", "other"]].itertuples(index=False) for r in align_words([] if a is None else list(a), [] if b is None else list(b))]
            out = pd.DataFrame(rows, columns=["unit_id", "witness", "type", "word1", "word2", "idx1", "idx2"])
            yield out.astype({"idx1": "Int64", "idx2": "Int64"})

    return pairs.mapInPandas(run, "unit_id long, witness string, type string, word1 string, word2 string, idx1 long, idx2 long")


def combine(aligned: DataFrame, witnesses: tuple[str, ...] = WITNESSES[1:]) -> DataFrame:
    """One row per base word with each witness's reading and match flag; words that only others have drop out."""
    rows = aligned.where("idx1 is not null").groupBy("unit_id", F.col("idx1").alias("position"))
    picks = [F.max(F.when(F.col("witness") == w, F.col("word2"))).alias(w) for w in witnesses]
    flags = [F.max(F.when(F.col("witness") == w, F.col("type") == "match")).alias(f"{w}_match") for w in witnesses]
    return rows.agg(F.max("word1").alias("base"), *picks, *flags)


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks, 0 where either is missing."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def related_without_ratio(a: Column, b: Column) -> Column:
    """Whether two words are plausibly forms of one another, null where only the similarity ratio can tell."""
    x, y = F.lower(a), F.lower(b)
    small, large = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    same = F.size(F.filter(F.sequence(F.lit(1), small), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))
    out = F.when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin(""), F.lit(False)).when(small <= 2, x == y).when(large > 3 * small, F.lit(False))
    return out.when(2 * same >= small, F.lit(True)).when(x.contains(y) | y.contains(x), F.lit(True))


def words_related(df: DataFrame, a: str, b: str, into: str = "related") -> DataFrame:
    """``df`` with a relatedness flag; the Python ratio sees only the pairs that the built-in legs leave open."""
    settled = related_without_ratio(F.col(a), F.col(b))
    open_ratio = F.pandas_udf(ratio, "double")
    return df.withColumn("_s", settled).withColumn(into, F.coalesce("_s", open_ratio(F.when(F.col("_s").isNull(), F.lower(a)), F.when(F.col("_s").isNull(), F.lower(b))) >= 0.5)).drop("_s")


def classify(rows: DataFrame) -> DataFrame:
    """Type, confidence and preferred reading of ``(g, s, v, b, t, g_ok, s_ok, v_ok[, unrelated])``; the first rule that fits wins.

    ``g`` is the base reading, ``s`` and ``v`` the required witnesses, ``b`` and ``t`` optional; ``*_ok`` says whether
    a reading is a dictionary word; ``unrelated`` (optional) that g is related to neither s nor v.
    """
    g, s, v, b, t = (F.col(c) for c in "gsvbt")
    gk, sk, vk, bk, tk = (comparison_key(c) for c in (g, s, v, b, t))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    hg, hs, hv, hb, ht = map(has, (g, s, v, b, t))
    unrelated = F.coalesce(F.col("unrelated"), F.lit(False)) if "unrelated" in rows.columns else F.lit(False)
    more = (hb & (bk == sk)).cast("int") + (ht & (tk == sk)).cast("int")
    ally = (hb & (bk == gk)) | (ht & (tk == gk))
    sv = hs & hv & (sk == vk) & (gk != sk)
    # the largest group of equal readings, ties to the earliest witness
    cells = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("key"), F.when(h, w).alias("word")) for k, (c, w, h) in enumerate(((gk, g, hg), (sk, s, hs), (vk, v, hv), (bk, b, hb), (tk, t, ht)))])
    cells = F.filter(cells, lambda c: c["word"].isNotNull())
    sized = F.transform(cells, lambda c: F.struct((-F.size(F.filter(cells, lambda d: d["key"] == c["key"]))).alias("n"), c["k"].alias("k"), c["word"].alias("word")))
    top = F.array_min(sized)
    all_apart = hg & hs & hv & (gk != sk) & (sk != vk) & (gk != vk)
    only = F.col("g_ok").cast("int") + F.col("s_ok").cast("int") + F.col("v_ok").cast("int") == 1
    top_ok = F.when(F.col("top.k") == 0, F.col("g_ok")).when(F.col("top.k") == 1, F.col("s_ok")).when(F.col("top.k") == 2, F.col("v_ok")).otherwise(F.lit(False))
    near = lambda agree, key: F.least(F.lit(0.9), F.lit(0.5) + (F.lit(2) + (hb & (bk == key)).cast("int") + (ht & (tk == key)).cast("int")) * F.lit(0.1))
    none = F.lit(None).cast("string")
    kept = F.col("top.word")
    rules = [
        (hg & hs & hv & unrelated, "alignment_artifact", F.lit(0.1), none),
        (hg & (F.length(g) <= 2) & ~g.isin(*SHORT_WORDS), "fragment", F.lit(0.1), none),
        (~hg & hs & hv, "pts_omission", F.when(s == v, 0.8).otherwise(0.5), F.when(s == v, s)),
        (hg & ~hs & ~hv, "pts_addition", F.lit(0.7), g),
        (~hg, "missing", F.lit(0.0), none),
        ((gk == sk) & (sk == vk) & (~hb | (bk == gk)) & (~ht | (tk == gk)), "orthographic", F.lit(1.0), g),
        (sv & ~F.col("g_ok") & F.col("s_ok"), "error", F.when(more == 2, 0.98).when(more == 1, 0.95).when(ally, 0.85).otherwise(0.9), s),
        (sv & F.col("g_ok") & F.col("s_ok"), "variant", F.when(more == 2, 0.9).when(more == 1, 0.8).when(ally, 0.6).otherwise(0.7), g),
        (sv, "uncertain", F.lit(0.4), s),
        (all_apart & (F.col("top.n") <= -3), "uncertain", F.lit(0.7), kept),
        (all_apart & (F.col("top.n") == -2), "uncertain", F.when(top_ok, 0.6).otherwise(0.4), kept),
        (all_apart & only, "uncertain", F.lit(0.5), F.when(F.col("g_ok"), g).when(F.col("s_ok"), s).otherwise(v)),
        (all_apart, "uncertain", F.lit(0.3), g),
        (hs & hv & (gk == sk) & (sk != vk), "vri_variant", near(None, gk), g),
        (hs & hv & (gk == vk) & (gk != sk), "sc_variant", near(None, gk), g),
    ]
    kind, sure, kept_ = F.lit("unknown"), F.lit(0.2), g
    for when, name, confidence, reading in reversed(rules):
        kind, sure, kept_ = F.when(when, name).otherwise(kind), F.when(when, confidence).otherwise(sure), F.when(when, reading).otherwise(kept_)
    out = rows.withColumn("top", top)
    return out.withColumns({"type": kind, "confidence": sure, "preferred": kept_}).drop("top")


def bucket(kind: Column) -> Column:
    """Class of a type in the counts."""
    return F.when(kind == "error", "errors").when(kind == "variant", "variants").when(kind == "orthographic", "orthographic").when(kind.isin("uncertain", "pts_omission", "pts_addition"), "uncertain").otherwise("other")


def capped(rows: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` rows of each unit and class, by position: a report's cap, counts are taken before it."""
    w = Window.partitionBy("unit_id", "bucket").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def rejected(readings: Column, selected: Column) -> Column:
    """Distinct attested readings other than the selected one, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.filter(readings, lambda x: F.coalesce(x != "", F.lit(False)))), F.array(F.coalesce(selected, F.lit("")))))
