"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import split_words

#: Words of one window whose repetition inside a text counts.
WINDOW = 8


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word run found twice or more in the array, the first run included.

    The runs' hashes are compared first; only an array with equal hashes goes on to compare the runs
    themselves, sorted together with their places. The gaps between repeated places give the cover.
    """
    def cover(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            return (F.get(s, i - 1)["r"] == x["r"]) | (F.get(s, i + 1)["r"] == x["r"])

        places = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def bound(x: Column, f) -> Column:
        """``f`` of a value that is computed once: a lambda's variable, not an expression that is repeated."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def checked(w: Column) -> Column:
        hashes = F.transform(runs_of(w), lambda i: F.xxhash64(F.slice(w, i, window)))
        exact = F.sort_array(F.transform(runs_of(w), lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("r"), i.alias("p"))))
        return F.when(bound(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(bound(exact, cover))

    def runs_of(w: Column) -> Column:
        return F.sequence(F.lit(1), F.size(w) - F.lit(window - 1))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(bound(words, checked)).cast("long")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of the whole text.

    Null text counts as empty (all 0). A line counts if it has a word; it is a duplicate if an earlier
    line of the text is equal to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = text
    for c in "#*$%&|<>":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    out = df.withColumn("_words", split_words(text)).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(bare)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    })
    return out.drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Rules of the verdict, as SQL that is true where a document is rejected. ``{t}`` is the text, never null.
#: Each needs only the text, so that a rejected document pays for no later rule. Lines count if they have a word.
RULES: dict[str, str] = {
    "few_words": r"regexp_count({t}, '[^\\x20\\x09-\\x0D]+') < 20",
    "symbols": r"5 * (length({t}) - length(regexp_replace({t}, '[#*$%&|<>]+', ''))) > regexp_count({t}, '[^\\x20\\x09-\\x0D]+')",
    "shouting": r"5 * regexp_count({t}, '!') > regexp_count({t}, '[^\\x20\\x09-\\x0D]+')",
    "capitals": r"2 * regexp_count({t}, '[A-Z]') > length({t})",
    "letterless": r"2 * length(regexp_replace({t}, '[\\x20\\x09-\\x0D\\p{L}]+', '')) > length(regexp_replace({t}, '[\\x20\\x09-\\x0D]+', ''))",
    "word_length": r"length(regexp_replace({t}, '[\\x20\\x09-\\x0D]+', '')) NOT BETWEEN 2 * regexp_count({t}, '[^\\x20\\x09-\\x0D]+') AND 15 * regexp_count({t}, '[^\\x20\\x09-\\x0D]+')",
    "repeated_lines": r"get(transform(array(filter(split({t}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), l -> 10 * (size(l) - size(array_distinct(l))) > 4 * size(l)), 0)",
}


def rule(name: str, text_col: str = "text") -> Column:
    return F.expr(RULES[name].replace("{t}", f"coalesce(`{text_col}`, '')"))


def order_rules(df: DataFrame, text_col: str = "text", sample_rows: int = 500, rules: list[str] | None = None) -> list[str]:
    """The rules by rejection per cost, best first, as estimated on a sample of at most ``sample_rows`` rows.

    A rule's cost is the measured time of evaluating it over the sample, its selectivity the share it rejects.
    The order decides how much work is done, never the verdict: that is false if any rule rejects.
    """
    rules = list(rules or RULES)
    spark = df.sparkSession
    rows = df.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64(text_col), F.lit(2)) == 0).limit(sample_rows).collect()
    if not rows:
        return rules
    sample = spark.createDataFrame(rows, "text string").coalesce(1).persist()
    sample.count()
    worth = {}
    for name in rules:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(rule(name))).first()[0]
        worth[name] = (hits + 0.5) / len(rows) / (time.perf_counter() - began)
    sample.unpersist()
    return sorted(rules, key=lambda n: (-worth[n], n))


def passes(rules: list[str], text_col: str = "text") -> Column:
    """True if no rule rejects; CASE stops at the first that does."""
    case = F.when(rule(rules[0], text_col), F.lit(False))
    for name in rules[1:]:
        case = case.when(rule(name, text_col), F.lit(False))
    return case.otherwise(F.lit(True))


def assess(df: DataFrame, text_col: str = "text", rules: list[str] | None = None) -> DataFrame:
    """``df`` with the measures, ``base_failed`` and ``kept``. The cascade runs only where the base passes."""
    rules = rules or order_rules(df, text_col)
    out = measures(df, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(rules, text_col)))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes: the cheap rules first, then the window measure where they all pass."""
    words = split_words(F.coalesce(F.col(text_col), F.lit("")))
    ok = F.when(~passes(order_rules(df, text_col), text_col), F.lit(False))
    return df.where(ok.otherwise((F.size(words) >= 20) & (100 * repeated_words(words) <= 30 * F.size(words))))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of ``assess`` over ``table(doc_id, text)``."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, p, array_to_string(words[p:p+{WINDOW - 1}], ' ') AS r
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS p FROM w WHERE len(words) > {WINDOW})),
d AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, r) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, p - prev)) AS n FROM (SELECT rid, p, coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -{WINDOW}) AS prev FROM d) GROUP BY rid),
m AS (SELECT w.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (n_words < 20)
  AND NOT (5 * n_symbols > n_words)
  AND NOT (5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words)
  AND NOT (2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(t))
  AND NOT (2 * length(regexp_replace(t, '[\x20\x09-\x0D\p{{L}}]+', '', 'g')) > word_chars)
  AND NOT (word_chars NOT BETWEEN 2 * n_words AND 15 * n_words)
  AND NOT (10 * (len(lines) - len(list_distinct(lines))) > 4 * len(lines)) AS kept
FROM b"""
