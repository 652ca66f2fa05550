"""Exports: CSV frequency tables, texts, matrices, JSON editions, LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_latex, is_verse
from ..operators import vocabulary as V


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def vocabulary_csv(counts: DataFrame, path: str) -> None:
    write_csv(counts.orderBy(F.desc("n"), "word"), path)


def ten_places(share: Column) -> Column:
    """A share from 0 to 1 written to ten places as C's ``%.10f`` does: its exact binary value rounded, ties to even.

    Java's own format rounds the shortest decimals of the double, ties up. The share is split in two halves of 26 bits,
    whose products with 10^10 are exact, so each side of the comparison with one half is exact too.
    """
    scale = 10**10
    split = share * F.lit(float((1 << 27) + 1))
    high = split - (split - share)
    low = share - high
    whole = F.floor(share * F.lit(float(scale)))
    left, right = high * F.lit(float(scale)) - whole - F.lit(0.5), -(low * F.lit(float(scale)))
    up = (left > right) | ((left == right) & (whole % 2 == 1))
    n = whole + up.cast("long")
    return F.format_string("%d.%010d", F.floor(n / F.lit(scale)), n % F.lit(scale))


def long_table(tokens: DataFrame, by: str = "collection") -> DataFrame:
    """``word, n, total, freq, book`` with the share written to ten places."""
    return V.term_share(tokens, by).select("word", "n", "total", ten_places(F.col("freq")).alias("freq"), F.col(by).cast("string").alias("book"))


#: Terms of one folder of a matrix; wider tables are no use as CSV and a plan of so many columns does not end.
BLOCK = 2000


def matrix_csv(tokens: DataFrame, path: str, unit: str = "unit_id", min_df: int = 2) -> None:
    """Document-term matrix over terms found in ``min_df`` documents, units in order, terms in order.

    Terms come in blocks of ``BLOCK`` columns, each a folder ``terms-00000`` and on of ``path``; every folder has a
    row for each unit of the table. The terms' names, not the counts, come to the driver, as columns need them.
    """
    counts = V.document_terms(tokens, unit, min_df)
    terms = [r["term"] for r in counts.select("term").distinct().orderBy("term").collect()]
    units = tokens.select(unit).distinct()
    for k in range(0, max(1, len(terms)), BLOCK):
        some = terms[k : k + BLOCK]
        wide = counts.where(F.col("term").between(some[0], some[-1])).groupBy(unit).pivot("term", some).agg(F.sum("n")) if some else counts.select(unit).limit(0)
        write_csv(units.join(wide, unit, "left").na.fill(0).orderBy(unit), f"{path}/terms-{k // BLOCK:05d}")


def lemma_texts(tokens: DataFrame) -> DataFrame:
    """Per unit the surface text and its lemmas: the lemma, else the components' lemmas, else the word."""
    parts = F.array_join(F.filter(F.transform("components", lambda c: c["lemma"]), lambda x: F.coalesce(x != "", F.lit(False))), " ")
    lemma = F.coalesce(F.expr("nullif(lemma, '')"), F.when(F.size("components") > 0, parts), F.col("word"))
    rows = tokens.select("unit_id", "collection", F.struct("seg_ord", "tok_ord", "word", lemma.alias("lemma")).alias("x"))
    sorted_ = F.array_sort(F.collect_list("x"))
    return rows.groupBy("unit_id", "collection").agg(F.array_join(F.transform(sorted_, lambda x: x["word"]), " ").alias("text"), F.array_join(F.transform(sorted_, lambda x: x["lemma"]), " ").alias("lemmas"))


def editions_json(editions: DataFrame, path: str) -> None:
    editions.write.mode("overwrite").partitionBy("collection").json(path)


def latex(segments: DataFrame, title: str) -> str:
    """A document of one unit's segments in order; verses keep their line breaks. Reads one unit to the driver."""
    rows = segments.orderBy("seg_ord").select(escape_latex(F.col("text")).alias("t"), is_verse(F.col("text")).alias("v")).collect()
    out, verse = [r"\documentclass{article}", r"\usepackage{fontspec}", r"\usepackage{verse}", r"\begin{document}", rf"\section*{{{title}}}"], False
    for t, v in rows:
        if v != verse:
            out.append(r"\begin{verse}" if v else r"\end{verse}")
            verse = v
        out.append(t.replace(";", "\\\\\n").replace(",", ",\\\\\n\\vin ") if v else t + "\n")
    return "\n".join([*out, *([r"\end{verse}"] if verse else []), r"\end{document}"])
