"""Registered queries of the text operators over the driver's tables, each with its SQL for DuckDB.

Bindings: a unit is a document, its collection the language, its segments the non-empty lines; the dictionary is
the vocabulary of ``benchmark``; witnesses are fixed edits of a document's words, so the true alignment is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions import text as T
from ..operators import collation as C
from ..operators import lemmas as M
from ..operators import lexicon as L
from ..operators import reports as R
from ..operators import search as S
from ..operators import segmentation as G
from ..operators import vocabulary as V
from ..sinks import exports as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAT = f"[{T.LETTERS}]+"
ACCENTS = "[a-zàâäáãéèêëíìîïóòôöúùûüçñß]+"

SEG = """seg AS (SELECT doc_id AS unit_id, lang AS collection, (i - 1)::INT AS seg_ord, l[i] AS text, doc_id::VARCHAR || ':' || (i - 1)::VARCHAR AS segment_id
  FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)) WHERE l[i] <> '')"""
TOK = f"{SEG}, tok AS (SELECT unit_id, collection, seg_ord, segment_id, unnest(w) AS word, unnest(range(0, len(w)))::INT AS tok_ord FROM (SELECT *, regexp_extract_all(lower(text), '{PAT}') AS w FROM seg))"
DIC = f"dic AS (SELECT DISTINCT word, regexp_replace(word, '(ed|ing|s)$', '') AS lemma, CASE WHEN regexp_matches(word, '(ed|ing)$') THEN 'pr' WHEN regexp_matches(word, 's$') THEN 'nt' ELSE 'masc' END AS pos FROM (SELECT unnest(regexp_extract_all(lower(text), '{PAT}')) AS word FROM benchmark))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segs(spark, d):
    return V.segments(table(spark, d, "documents"))


def toks(spark, d):
    return V.tokens(segs(spark, d))


def dictionary(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    pos = F.when(F.col("word").rlike("(ed|ing)$"), "pr").when(F.col("word").rlike("s$"), "nt").otherwise("masc")
    return words.select("word", F.regexp_replace("word", "(ed|ing|s)$", "").alias("lemma"), pos.alias("pos"))


# --- tokens, normalisers, predicates -------------------------------------------------------------------------


@query(f"WITH {TOK} SELECT collection, word, n, n / sum(n) OVER (PARTITION BY collection) AS freq, (sum(n) OVER (PARTITION BY collection))::BIGINT AS total FROM (SELECT collection, word, count(*) AS n FROM tok GROUP BY ALL)")
def word_counts_by_collection(spark, d):
    return V.term_share(toks(spark, d))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{PAT}'))::BIGINT AS n, len(regexp_extract_all(text, '(?i){PAT}'))::BIGINT AS n_counted, len(regexp_extract_all(lower(text), '{ACCENTS}'))::BIGINT AS n_accented FROM documents")
def tokenize_library(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("n"), T.count_tokens(t).alias("n_counted"), F.size(F.regexp_extract_all(F.lower(t), F.lit(ACCENTS), F.lit(0))).cast("long").alias("n_accented"))


@query(f"SELECT page_id, array_to_string(list_filter(string_split_regex(lower(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'ṁ', 'ṃ')), '[^{T.LETTERS}]+'), lambda x: x <> ''), ' ') AS words FROM pages")
def tokenize_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.strip_tokens(F.col("html")), " ").alias("words"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(replace(translate(replace(replace(lower(text), '-', ''), '*', ''), 'ṁŋ', 'ṃṃ'), 'saṅgh', 'saṃgh'), '{PAT}'), ' ') AS words FROM documents")
def tokenize_collation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.collation_tokens(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(translate(lower(text), 'ṁŋ', 'ṃṃ'), '{PAT}'), ' ') AS words, trim(regexp_replace(replace(text, 'ṁ', 'ṃ'), '\\s+', ' ', 'g')) AS plain FROM documents")
def tokenize_folded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.folded_tokens(F.col("text")), " ").alias("words"), T.normalise(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, word, start FROM (SELECT doc_id, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0))::INT)) AS start FROM (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '{PAT}') AS w, string_split_regex(lower(text), '{PAT}') AS g FROM benchmark))")
def token_offsets(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(T.token_offsets(F.col("text"))).alias("x"))
    return rows.select("doc_id", F.col("x.token").alias("word"), F.col("x.start").alias("start"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name)), '\\s*sutta[ṃm]?\\.?\\s*$', ''), '^(paṭhama|dutiya|tatiya|catuttha|pañcama)\\s*', ''), '\\s+', '', 'g') AS key FROM part")
def normalize_title_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.title_key(F.col("p_name")).alias("key"))


@query(f"WITH {SEG} SELECT segment_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0 AND length(regexp_replace(text, '[^,;]', '', 'g')) / len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0.15 AS verse FROM seg")
def verse_flag(spark, d):
    return segs(spark, d).select("segment_id", T.is_verse(F.col("text")).alias("verse"))


@query(f"""WITH {SEG}, a AS (SELECT segment_id, text, instr(text, 'the') AS p, length(text) AS n FROM seg),
b AS (SELECT *, greatest(1, p - 30) AS low, least(n, p + 32) AS high FROM a)
SELECT segment_id, CASE WHEN p > 0 THEN (CASE WHEN low > 1 THEN '...' ELSE '' END) || substring(text, low, high - low + 1) || (CASE WHEN high < n THEN '...' ELSE '' END) ELSE substring(text, 1, 120) END AS context FROM b""")
def context_snippet(spark, d):
    return segs(spark, d).select("segment_id", T.snippet(F.col("text"), F.lit("the")).alias("context"))


@query(r"SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', chr(1)), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS tex FROM documents")
def escape_latex(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_latex(F.col("text")).alias("tex"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.markup_to_text(F.col("html")).alias("text"))


@query("SELECT * FROM (VALUES ('IV', 4), ('xii', 12), ('MCMXC', 1990), ('abc', 0), ('', 0)) t(numeral, value)")
def roman_numerals(spark, d):
    rows = spark.createDataFrame([("IV",), ("xii",), ("MCMXC",), ("abc",), ("",)], "numeral string")
    return rows.select("numeral", T.roman_value(F.col("numeral")).alias("value"))


# --- vocabulary ----------------------------------------------------------------------------------------------


@query(f"WITH {TOK}, {DIC}, x AS (SELECT tok.word, dic.lemma FROM tok LEFT JOIN dic USING (word)) SELECT count(*) AS total_tokens, count(lemma) AS resolved_tokens, count(DISTINCT lemma) AS unique_lemmas, count(lemma) / count(*) AS coverage FROM x")
def vocab_stats(spark, d):
    rows = toks(spark, d).join(dictionary(spark, d), "word", "left").withColumn("sandhi", F.lit(None).cast("array<string>"))
    return V.statistics(rows)


@query(f"WITH {TOK}, {DIC} SELECT lemma, count(*) AS n FROM tok JOIN dic USING (word) GROUP BY lemma ORDER BY n DESC, lemma LIMIT 100")
def vocab_top_lemmas(spark, d):
    return toks(spark, d).join(dictionary(spark, d), "word").groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(100)


@query(f"WITH {TOK} SELECT unit_id, word AS term, count(*) AS n FROM tok GROUP BY ALL")
def dtm_long(spark, d):
    return V.document_terms(toks(spark, d))


@query(f"WITH {TOK}, c AS (SELECT unit_id, word AS term, count(*) AS n FROM tok GROUP BY ALL), o AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 5) SELECT unit_id, term, n FROM c JOIN o USING (term)")
def dtm_min_df(spark, d):
    return V.document_terms(toks(spark, d), min_df=5)


@query(f"WITH {TOK}, c AS (SELECT unit_id, word, count(*) AS n FROM tok GROUP BY ALL) SELECT word, n, (sum(n) OVER (PARTITION BY unit_id))::BIGINT AS total, printf('%.10f', n / sum(n) OVER (PARTITION BY unit_id)) AS freq, unit_id::VARCHAR AS book FROM c")
def term_share_by_unit(spark, d):
    return X.long_table(toks(spark, d), "unit_id")


@query(f"WITH {TOK}, c AS (SELECT collection, word, count(*) AS n FROM tok GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY collection) AS f, sum(n) OVER (PARTITION BY word) AS a FROM c) SELECT word, coalesce(max(f) FILTER (collection = 'de'), 0.0) AS de, coalesce(max(f) FILTER (collection = 'en'), 0.0) AS en, coalesce(max(f) FILTER (collection = 'es'), 0.0) AS es, coalesce(max(f) FILTER (collection = 'fr'), 0.0) AS fr FROM s WHERE a >= 5 GROUP BY word")
def freq_wide(spark, d):
    return V.wide_frequencies(toks(spark, d), 5, ["de", "en", "es", "fr"])


@query(f"WITH {SEG} SELECT unit_id, collection, string_agg(text, chr(10) ORDER BY seg_ord) AS text FROM seg GROUP BY unit_id, collection")
def unit_texts(spark, d):
    return V.unit_texts(segs(spark, d))


@query(f"WITH {TOK}, {DIC} SELECT unit_id, collection, string_agg(word, ' ' ORDER BY seg_ord, tok_ord) AS text, string_agg(coalesce(nullif(lemma, ''), word), ' ' ORDER BY seg_ord, tok_ord) AS lemmas FROM tok LEFT JOIN dic USING (word) GROUP BY ALL")
def lemma_texts(spark, d):
    rows = toks(spark, d).join(dictionary(spark, d), "word", "left").withColumn("components", F.expr("cast(null as array<struct<lemma:string,pos:string>>)"))
    return X.lemma_texts(rows)


@query(f"WITH {TOK}, {DIC} SELECT collection, count(*) AS tokens, count(lemma) AS found, count(lemma) / count(*) AS coverage FROM tok LEFT JOIN dic USING (word) GROUP BY collection")
def coverage(spark, d):
    rows = toks(spark, d).join(dictionary(spark, d), "word", "left").groupBy("collection").agg(F.count("*").alias("tokens"), F.count("lemma").alias("found"))
    return rows.withColumn("coverage", F.col("found") / F.col("tokens"))


# --- search --------------------------------------------------------------------------------------------------


def tagged(spark, d):
    """Tokens with lemma, pos and components: a word that ends in a listed particle has two components."""
    base = L.particle_base(F.col("word"))
    parts = F.when(base.isNotNull() & (F.length("word") > 4), F.array(F.struct(base.alias("lemma"), F.lit("masc").alias("pos")), F.struct(F.lit("ti").alias("lemma"), F.lit("ind").alias("pos"))))
    return toks(spark, d).join(dictionary(spark, d), "word", "left").withColumn("components", parts)


_BASE = "CASE " + " ".join(f"WHEN word LIKE '%{p}' AND length(word) > {len(p)} THEN left(word, length(word) - {len(p)})" for p in L.PARTICLES) + " END"
POST = f"""{TOK}, {DIC}, tag AS (SELECT tok.*, dic.lemma, dic.pos, {_BASE} AS base FROM tok LEFT JOIN dic USING (word)),
post AS (SELECT lemma, pos, word, segment_id, unit_id, collection FROM tag WHERE lemma <> ''
  UNION ALL SELECT base, 'masc', word, segment_id, unit_id, collection FROM tag WHERE base IS NOT NULL AND length(word) > 4
  UNION ALL SELECT 'ti', 'ind', word, segment_id, unit_id, collection FROM tag WHERE base IS NOT NULL AND length(word) > 4)"""


@query(f"WITH {POST} SELECT lemma, count(*) AS n, count(DISTINCT unit_id) AS n_units, count(DISTINCT segment_id) AS n_segments FROM post GROUP BY lemma")
def lemma_postings(spark, d):
    return S.postings(tagged(spark, d)).groupBy("lemma").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("n_units"), F.count_distinct("segment_id").alias("n_segments"))


@query(f"WITH {POST} SELECT lemma, pos, word, segment_id, unit_id, collection FROM post WHERE lemma = 'the'")
def lemma_search(spark, d):
    return S.postings(tagged(spark, d)).where("lemma = 'the'").select("lemma", "pos", "word", "segment_id", "unit_id", "collection")


@query(f"WITH {POST} SELECT collection, count(*) AS n FROM post WHERE lemma = 'ti' GROUP BY collection")
def lemma_by_collection(spark, d):
    return S.postings(tagged(spark, d)).where("lemma = 'ti'").groupBy("collection").agg(F.count("*").alias("n"))


@query(f"WITH {POST} SELECT DISTINCT lemma FROM post")
def distinct_lemmas(spark, d):
    return S.postings(tagged(spark, d)).select("lemma").distinct()


_FOLD = f"translate(lower(text), '{S.ACCENTED}', '{S.PLAIN}')"
FTS = f"{SEG}, fts AS (SELECT *, ' ' || array_to_string(regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS f FROM seg)"
_ROWS = "SELECT unit_id, collection, seg_ord, segment_id, text FROM fts WHERE "


def _search(text: str):
    return lambda spark, d: S.search_text(segs(spark, d), text).select("unit_id", "collection", "seg_ord", "segment_id", "text")


for _name, _query, _where in (
    ("text_search_and", "The with", "contains(f, ' the ') AND contains(f, ' with ')"),
    ("text_search_phrase", '"of the"', "contains(f, ' of the ')"),
    ("text_search_prefix", "therea*", "contains(f, ' therea')"),
    ("text_search_or", "haben OR avec OR thereof", "contains(f, ' haben ') OR contains(f, ' avec ') OR contains(f, ' thereof ')"),
    ("text_search_not", "pour NOT dans", "contains(f, ' pour ') AND NOT contains(f, ' dans ')"),
    ("text_search_folded", "fur", "contains(f, ' fur ')"),
    ("text_search_malformed", "OR AND NOT", "false"),
):
    QUERIES[_name], SQL[_name] = _search(_query), f"WITH {FTS} {_ROWS}{_where}"


@query(f"WITH {SEG} SELECT unit_id, seg_ord, segment_id FROM seg WHERE seg_ord BETWEEN 2 AND 4")
def segment_range(spark, d):
    return S.segment_range(segs(spark, d), F.lit(2), F.lit(4)).select("unit_id", "seg_ord", "segment_id")


@query("SELECT 'src' || g || '-' || (g + 4) AS span, count(*) AS n FROM documents, (SELECT unnest([0, 5, 10, 15]) AS g) WHERE regexp_extract(source, '[0-9]+')::INT BETWEEN g AND g + 4 GROUP BY g")
def range_id_lookup(spark, d):
    spans = [f"src{g}-{g + 4}" for g in (0, 5, 10, 15)]
    one = F.coalesce(*[F.when(T.in_range(F.col("source"), F.lit(s)), s) for s in spans])
    return table(spark, d, "documents").select(one.alias("span")).where("span is not null").groupBy("span").agg(F.count("*").alias("n"))


# --- lexicon -------------------------------------------------------------------------------------------------


@query(f"WITH {TOK}, {DIC} SELECT word, count(*) AS n, any_value(lemma) AS lemma, any_value(pos) AS pos FROM tok JOIN dic USING (word) GROUP BY word")
def lexicon_direct(spark, d):
    return toks(spark, d).join(dictionary(spark, d), "word").groupBy("word").agg(F.count("*").alias("n"), F.first("lemma").alias("lemma"), F.first("pos").alias("pos"))


def _cut(n: int) -> str:
    return f"left(word, length(word) - {n})"


_PRON = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PRONOUNS.items()) + " END"
_VERB = "CASE " + " ".join(f"WHEN word LIKE '%{a}' THEN {_cut(len(a))} || '{b}'" for a, b in L.VERB_ENDINGS.items()) + " END"
_CAUS = "CASE " + " ".join(f"WHEN word LIKE '%{a}' THEN {_cut(len(a))} || '{b}'" for a, b in L.CAUSATIVES) + " END"
CASCADE = f"""{TOK}, {DIC}, dw AS (SELECT DISTINCT word FROM tok), cand AS (
  SELECT word, 0 AS r, 'direct' AS strategy, word AS k FROM dw
  UNION ALL SELECT word, 1, 'niggahita', CASE WHEN regexp_matches(word, 'n$|.m$') THEN {_cut(1)} || 'ṃ' END FROM dw
  UNION ALL SELECT word, 2, 'final_vowel', CASE WHEN regexp_matches(word, '[āīū]$') THEN {_cut(1)} || translate(right(word, 1), 'āīū', 'aiu') END FROM dw
  UNION ALL SELECT word, 3, 'verb_ending', {_VERB} FROM dw
  UNION ALL SELECT word, 4, 'long_vowels', CASE WHEN regexp_matches(word, '[āīū]') THEN translate(word, 'āīū', 'aiu') END FROM dw
  UNION ALL SELECT word, 5, 'causative', {_CAUS} FROM dw
  UNION ALL SELECT word, 90, 'particle', {_BASE} FROM dw),
hit AS (SELECT cand.word, r, strategy, lemma, pos, row_number() OVER (PARTITION BY cand.word ORDER BY r) AS n FROM cand JOIN dic ON k = dic.word),
res AS (SELECT dw.word, CASE WHEN {_PRON.replace('word', 'dw.word')} IS NOT NULL AND coalesce(r, 99) > 2 THEN {_PRON.replace('word', 'dw.word')} ELSE lemma END AS lemma,
  CASE WHEN {_PRON.replace('word', 'dw.word')} IS NOT NULL AND coalesce(r, 99) > 2 THEN 'pron' ELSE pos END AS pos,
  CASE WHEN {_PRON.replace('word', 'dw.word')} IS NOT NULL AND coalesce(r, 99) > 2 THEN 'pronoun' ELSE coalesce(strategy, 'unknown') END AS strategy
  FROM dw LEFT JOIN hit ON dw.word = hit.word AND n = 1)"""


@query(f"WITH {CASCADE} SELECT word, lemma, pos, strategy FROM res")
def lexicon_cascade(spark, d):
    return L.resolve(toks(spark, d), dictionary(spark, d))


@query(f"WITH {CASCADE} SELECT strategy, count(*) AS n FROM res GROUP BY strategy")
def strategy_histogram(spark, d):
    return L.resolve(toks(spark, d), dictionary(spark, d)).groupBy("strategy").agg(F.count("*").alias("n"))


@query(f"WITH {CASCADE} SELECT unit_id, seg_ord, tok_ord, word, lemma, strategy FROM tok JOIN res USING (word)")
def lemmatized_tokens(spark, d):
    rows = toks(spark, d)
    return rows.join(L.resolve(rows, dictionary(spark, d)), "word", "left").select("unit_id", "seg_ord", "tok_ord", "word", "lemma", "strategy")


_PARTICLE = "CASE " + " ".join(f"WHEN word LIKE '%{p}' AND length(word) > {len(p) + 1} THEN '{p}'" for p in L.PARTICLES) + " END"
_FUSED = "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) > {len(s) + 2} THEN '{s}'" for s in M.FUSED) + " END"
_NEGATED = (  # spelling, least length, letters to cut
    ("word LIKE 'no%'", 5, 2), (f"word LIKE 'na%' AND regexp_matches(word[3], '[^{M.VOWELS}]') AND word[3] = word[4]", 5, 3), (f"regexp_matches(word, '^an[{M.VOWELS}]')", 5, 2),
    ("word LIKE 'nā%'", 6, 2), (f"regexp_matches(word, '^a[^{M.VOWELS}]') AND word[2] = word[3]", 6, 2), (f"regexp_matches(word, '^a[^{M.VOWELS}]')", 9, 1),
)
_NEGATIONS = " ".join(f"UNION ALL SELECT word, 'negation', substring(word, {cut + 1}), 'na' FROM dw WHERE {holds} AND length(word) >= {least}" for holds, least, cut in _NEGATED)


@query(f"""WITH {TOK}, dw AS (SELECT DISTINCT word FROM tok WHERE length(word) <= {M.LONGEST}),
p AS (SELECT word, {_PARTICLE} AS part FROM dw), f AS (SELECT word, {_FUSED} AS part FROM dw WHERE NOT (word LIKE 'aham%' AND length(word) > 6))
SELECT word, 'nca' AS strategy, {_cut(3)} || 'ṃ' AS base, 'ca' AS part FROM dw WHERE word LIKE '_%ñcā'
UNION ALL SELECT word, 'particle', CASE WHEN part = 'ca' AND word LIKE '%ñca' THEN {_cut(3)} || 'ṃ' ELSE left(word, length(word) - length(part)) END, part FROM p WHERE part IS NOT NULL
UNION ALL SELECT word, 'fused_pronoun', substring(word, 5), 'ahaṃ' FROM dw WHERE word LIKE 'aham%' AND length(word) > 6
UNION ALL SELECT word, 'fused_pronoun', left(word, length(word) - length(part)) || part[1], part FROM f WHERE part IS NOT NULL {_NEGATIONS}""")
def spelling_splits(spark, d):
    return M.spelling_splits(toks(spark, d))


def whole_lexicon(spark, d):
    """The benchmark's words as dictionary, those of five letters or more that end in a as names, fixed rules and custom words."""
    words = dictionary(spark, d)
    name = (F.length("word") >= 5) & F.col("word").endswith("a")
    names = words.where(name).select(F.crc32("word").alias("nr"), F.col("word").alias("name"))
    custom = spark.createDataFrame([("qua", "qua", "ind", None), ("alsdann", None, None, ["als", "dann"])], "word string, lemma string, pos string, parts array<string>")
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "nr int, a string, b string, c string, d string, weight int")
    return M.Lexicon(M.single(words.where(~name)), names, custom, rules)


@query()
def lemma_cascade(spark, d):
    """The whole cascade over the distinct words of all documents; held by recursion from the top in tests/test_lemmas.py."""
    return M.lemmatize(toks(spark, d), whole_lexicon(spark, d)).select("word", "lemma", "pos", F.array_join("parts", "+").alias("parts"), F.array_join(F.transform("components", lambda c: F.coalesce(c["lemma"], c["word"])), "+").alias("components"), "strategy")


@query()
def lemma_strategies(spark, d):
    return M.lemmatize(toks(spark, d), whole_lexicon(spark, d)).groupBy("strategy").agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, {DIC} SELECT word, count(*) AS n, count(DISTINCT unit_id) AS n_units, min(unit_id) AS first_unit, list_sort(list_distinct(list(unit_id)))[1:5] AS units FROM tok WHERE word NOT IN (SELECT word FROM dic) GROUP BY word")
def unknown_words(spark, d):
    return R.unknown_words(toks(spark, d), dictionary(spark, d))


RULES = [("a", "t", "ā", "t", 3), ("e", "r", "", "r", 3), ("t", "h", "ta", "h", 2), ("t", "h", "ta", "h", 2), ("o", "n", "oṃ", "n", 4)]
_RULES = ", ".join(f"('{a}', '{b}', '{c}', '{e}', {w})" for a, b, c, e, w in RULES)


@query(f"""WITH {DIC}, rules(a, b, c, d, weight) AS (SELECT DISTINCT * FROM (VALUES {_RULES})), cut AS (SELECT word, unnest(range(1, length(word))) AS p FROM dic),
x AS (SELECT word, p, left(word, p) AS l, substring(word, p + 1) AS r, 1 AS weight FROM cut
  UNION ALL SELECT word, p, left(word, p - 1) || c, d || substring(word, p + 2), weight FROM cut JOIN rules ON substring(word, p, 1) = a AND substring(word, p + 1, 1) = b)
SELECT word, p::INT AS "at", l AS "left", r AS "right", weight::INT AS weight FROM x WHERE l <> '' AND r <> ''""")
def sandhi_boundary(spark, d):
    rules = spark.createDataFrame(RULES, "a string, b string, c string, d string, weight int")
    return L.boundary_splits(dictionary(spark, d), rules)


@query(f"WITH {TOK}, dw AS (SELECT DISTINCT word FROM tok) SELECT word, {_BASE} AS base FROM dw WHERE {_BASE} IS NOT NULL")
def particle_split(spark, d):
    return toks(spark, d).select("word").distinct().select("word", L.particle_base(F.col("word")).alias("base")).where("base is not null")


@query(f"""WITH RECURSIVE {TOK}, {DIC}, w AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 8), k AS (SELECT word AS key FROM dic WHERE length(word) >= 4),
s(word, done, parts) AS (SELECT word, 0, []::VARCHAR[] FROM w UNION ALL
  SELECT s.word, s.done + length(k.key), list_append(s.parts, k.key) FROM s JOIN k ON substring(s.word, s.done + 1, length(k.key)) = k.key WHERE len(s.parts) < 4 AND s.done < length(s.word)),
f AS (SELECT word, parts, row_number() OVER (PARTITION BY word ORDER BY len(parts), -length(parts[1]), parts) AS n FROM s WHERE done = length(word) AND len(parts) > 1)
SELECT word, array_to_string(parts, '+') AS parts FROM f WHERE n = 1""")
def compound_split(spark, d):
    return L.split_compounds(toks(spark, d), dictionary(spark, d)).select("word", F.array_join("parts", "+").alias("parts"))


_POS = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{k}'" for p, k in L.POS_RULES) + " ELSE 'unknown' END"
_CAT = "CASE WHEN length(word) <= 2 THEN 'short' WHEN length(word) > 25 THEN 'compound' WHEN regexp_matches(word, '[āīū]$') THEN 'long_vowel' WHEN regexp_matches(word, '[ṃnm]$') THEN 'nasal' ELSE 'other' END"


@query(f"WITH {TOK}, {DIC} SELECT {_POS} AS pos, {_CAT} AS category, count(*) AS n FROM (SELECT DISTINCT word FROM tok WHERE word NOT IN (SELECT word FROM dic)) GROUP BY ALL")
def unknown_categories(spark, d):
    rows = toks(spark, d).select("word").distinct().join(dictionary(spark, d).select("word"), "word", "left_anti")
    return rows.groupBy(L.infer_pos(F.col("word")).alias("pos"), L.unknown_category(F.col("word")).alias("category")).agg(F.count("*").alias("n"))


# --- collation -----------------------------------------------------------------------------------------------


def readings(spark, d):
    """Five readings of each benchmark word, by fixed edits of its place, and which of them the dictionary has."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("unit_id"), F.posexplode(T.tokens(F.col("text"))).alias("position", "g0")).where("length(g0) > 2")
    p = F.col("position")
    respelt = F.concat("g0", F.lit("x"))
    rows = words.select(
        "unit_id", "position",
        F.when(p % 11 == 0, respelt).when(p % 29 == 5, None).otherwise(F.col("g0")).alias("g"),
        F.when(p % 13 == 4, F.concat("g0", F.lit("y"))).when(p % 31 == 7, None).otherwise(F.col("g0")).alias("s"),
        F.when(p % 17 == 4, F.concat("g0", F.lit("z"))).when(p % 31 == 7, None).otherwise(F.col("g0")).alias("v"),
        F.when(p % 3 == 0, F.col("g0")).when(p % 3 == 1, respelt).alias("b"),
        F.when(p % 5 < 3, F.col("g0")).when(p % 5 == 3, respelt).alias("t"),
    )
    ok = lambda c: F.coalesce(F.col(c) == F.col("g0"), F.lit(False))
    rows = rows.join(words.select("unit_id", "position", "g0"), ["unit_id", "position"])
    return rows.withColumns({"g_ok": ok("g") | (p % 22 == 0), "s_ok": ok("s"), "v_ok": ok("v")}).drop("g0")


READ = f"""w AS (SELECT * FROM (SELECT item_id AS unit_id, unnest(x) AS g0, unnest(range(0, len(x)))::INT AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '{PAT}') AS x FROM benchmark)) WHERE length(g0) > 2),
r0 AS (SELECT unit_id, p AS position, g0, CASE WHEN p % 11 = 0 THEN g0 || 'x' WHEN p % 29 = 5 THEN NULL ELSE g0 END AS g, CASE WHEN p % 13 = 4 THEN g0 || 'y' WHEN p % 31 = 7 THEN NULL ELSE g0 END AS s,
  CASE WHEN p % 17 = 4 THEN g0 || 'z' WHEN p % 31 = 7 THEN NULL ELSE g0 END AS v, CASE WHEN p % 3 = 0 THEN g0 WHEN p % 3 = 1 THEN g0 || 'x' END AS b, CASE WHEN p % 5 < 3 THEN g0 WHEN p % 5 = 3 THEN g0 || 'x' END AS t FROM w),
r AS (SELECT unit_id, position, g, s, v, b, t, coalesce(g = g0, false) OR position % 22 = 0 AS g_ok, coalesce(s = g0, false) AS s_ok, coalesce(v = g0, false) AS v_ok,
  coalesce(b = s, false)::INT + coalesce(t = s, false)::INT AS more, coalesce(b = g, false) OR coalesce(t = g, false) AS ally, coalesce(b = g, false)::INT + coalesce(t = g, false)::INT AS with_g,
  list_filter([{{'k': 0, 'w': g}}, {{'k': 1, 'w': s}}, {{'k': 2, 'w': v}}, {{'k': 3, 'w': b}}, {{'k': 4, 'w': t}}], lambda c: c.w IS NOT NULL) AS cells FROM r0),
q AS (SELECT *, list_sort(list_transform(cells, lambda c: {{'n': -len(list_filter(cells, lambda e: e.w = c.w)), 'k': c.k, 'w': c.w}}))[1] AS top FROM r),
k AS (SELECT *, CASE WHEN g IS NULL AND s IS NOT NULL AND v IS NOT NULL THEN 'pts_omission' WHEN g IS NOT NULL AND s IS NULL AND v IS NULL THEN 'pts_addition' WHEN g IS NULL THEN 'missing'
  WHEN g = s AND s = v AND coalesce(b = g, true) AND coalesce(t = g, true) THEN 'orthographic' WHEN s = v AND g <> s AND NOT g_ok AND s_ok THEN 'error' WHEN s = v AND g <> s AND g_ok AND s_ok THEN 'variant' WHEN s = v AND g <> s THEN 'uncertain4'
  WHEN g <> s AND s <> v AND g <> v AND top.n <= -3 THEN 'uncertain7' WHEN g <> s AND s <> v AND g <> v AND top.n = -2 THEN 'uncertain6' WHEN g <> s AND s <> v AND g <> v AND g_ok::INT + s_ok::INT + v_ok::INT = 1 THEN 'uncertain5'
  WHEN g <> s AND s <> v AND g <> v THEN 'uncertain3' WHEN g = s AND s <> v THEN 'vri_variant' WHEN g = v AND g <> s THEN 'sc_variant' ELSE 'unknown' END AS kind FROM q),
cls AS (SELECT unit_id, position, g, s, v, b, t, regexp_replace(kind, '[0-9]$', '') AS type,
  CASE kind WHEN 'pts_omission' THEN CASE WHEN s = v THEN 0.8 ELSE 0.5 END WHEN 'pts_addition' THEN 0.7 WHEN 'missing' THEN 0.0 WHEN 'orthographic' THEN 1.0
   WHEN 'error' THEN CASE WHEN more = 2 THEN 0.98 WHEN more = 1 THEN 0.95 WHEN ally THEN 0.85 ELSE 0.9 END WHEN 'variant' THEN CASE WHEN more = 2 THEN 0.9 WHEN more = 1 THEN 0.8 WHEN ally THEN 0.6 ELSE 0.7 END
   WHEN 'uncertain4' THEN 0.4 WHEN 'uncertain7' THEN 0.7 WHEN 'uncertain6' THEN CASE WHEN CASE top.k WHEN 0 THEN g_ok WHEN 1 THEN s_ok WHEN 2 THEN v_ok ELSE false END THEN 0.6 ELSE 0.4 END WHEN 'uncertain5' THEN 0.5 WHEN 'uncertain3' THEN 0.3
   WHEN 'vri_variant' THEN least(0.9, 0.5 + (2 + with_g) * 0.1) WHEN 'sc_variant' THEN least(0.9, 0.5 + (2 + with_g) * 0.1) ELSE 0.2 END::DOUBLE AS confidence,
  CASE kind WHEN 'pts_omission' THEN CASE WHEN s = v THEN s END WHEN 'missing' THEN NULL WHEN 'error' THEN s WHEN 'uncertain4' THEN s WHEN 'uncertain7' THEN top.w WHEN 'uncertain6' THEN top.w
   WHEN 'uncertain5' THEN CASE WHEN g_ok THEN g WHEN s_ok THEN s ELSE v END ELSE g END AS preferred FROM k)"""


@query(f"WITH {READ} SELECT unit_id, position, type, confidence, preferred FROM cls")
def classify_variants(spark, d):
    return C.classify(readings(spark, d)).select("unit_id", "position", "type", "confidence", "preferred")


_BUCKET = "CASE WHEN type = 'error' THEN 'errors' WHEN type = 'variant' THEN 'variants' WHEN type = 'orthographic' THEN 'orthographic' WHEN type IN ('uncertain', 'pts_omission', 'pts_addition') THEN 'uncertain' ELSE 'other' END"


@query(f"WITH {READ} SELECT unit_id, {_BUCKET} AS bucket, count(*) AS n FROM cls GROUP BY ROLLUP (unit_id, {_BUCKET})")
def collation_stats(spark, d):
    rows = C.classify(readings(spark, d)).withColumn("bucket", C.bucket(F.col("type"))).withColumn("n", F.lit(1))
    return R.totals(rows, "unit_id", "bucket")


@query(f"""WITH {READ}, e AS (SELECT *, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY unit_id, {_BUCKET} ORDER BY position) AS n FROM cls)
SELECT unit_id, bucket, position, type, preferred AS selected, array_to_string(list_sort(list_distinct(list_filter([g, s, v, b, t], lambda x: x <> '' AND x <> coalesce(preferred, '')))), ',') AS rejected FROM e WHERE bucket IN ('errors', 'variants', 'uncertain') AND n <= 1000""")
def apparatus(spark, d):
    rows = C.classify(readings(spark, d)).withColumn("bucket", C.bucket(F.col("type"))).where(F.col("bucket").isin("errors", "variants", "uncertain"))
    rows = C.capped(rows)
    return rows.select("unit_id", "bucket", "position", "type", F.col("preferred").alias("selected"), F.array_join(C.rejected(F.array(*"gsvbt"), F.col("preferred")), ",").alias("rejected"))


def witnesses(spark, d):
    """Base and four edited word lists of each benchmark text."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("unit_id"), T.tokens(F.col("text")).alias("base"))
    edits = [F.filter("base", lambda x, i: i % 7 != 3), F.transform("base", lambda x, i: F.when(i % 9 == 4, F.concat(x, F.lit("q"))).otherwise(x)), F.flatten(F.transform("base", lambda x, i: F.when(i % 8 == 2, F.array(x, F.lit("extra"))).otherwise(F.array(x)))), F.col("base")]
    return words.select("unit_id", "base", F.explode(F.array(*[F.struct(F.lit(f"w{k + 1}").alias("witness"), e.alias("other")) for k, e in enumerate(edits)])).alias("x")).select("unit_id", "base", "x.witness", "x.other")


@query()
def align_words(spark, d):
    ship(spark)
    return C.alignments(witnesses(spark, d))


@query()
def align_witnesses(spark, d):
    ship(spark)
    return C.combine(C.alignments(witnesses(spark, d)))


@query()
def words_related(spark, d):
    ship(spark)
    w = dictionary(spark, d).select("word")
    pairs = w.withColumn("other", F.lead("word").over(Window.partitionBy(F.substring("word", 1, 1)).orderBy("word"))).where("other is not null")
    return C.words_related(pairs, "word", "other")


# --- segmentation and windows --------------------------------------------------------------------------------


@query("""SELECT doc_id AS unit_id, nth, value, start, lead(start, 1, n) OVER (PARTITION BY doc_id ORDER BY start) AS "end" FROM (
  SELECT doc_id, length(text)::INT AS n, unnest(range(0, len(h)))::INT AS nth, unnest(h) AS value, unnest(list_transform(range(1, len(h) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::INT)) AS start
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+') AS h, string_split_regex(text, '[0-9]+') AS g FROM documents))""")
def marker_ranges(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return G.ranges(texts, G.markers(texts, "([0-9]+)")).select("unit_id", "nth", "value", "start", "end")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("raw"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("mark"))


_EV = "ev AS (SELECT event_id, user_id, floor(coalesce(value, 0))::BIGINT AS raw, CASE WHEN event_id % 5 = 0 THEN event_id END AS mark FROM events)"


@query(f"WITH {_EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) SELECT event_id, user_id, raw, p + max(CASE WHEN p = 1 THEN greatest(raw, 1) ELSE raw END - p) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS repaired FROM a")
def monotone_repair(spark, d):
    return G.repaired(_events(spark, d), "user_id", "event_id", "raw").select("event_id", "user_id", "raw", "repaired")


@query(f"WITH {_EV}, a AS (SELECT *, max(raw) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) SELECT event_id, user_id, raw FROM a WHERE raw > coalesce(b, 0)")
def running_max_filter(spark, d):
    return G.rising(_events(spark, d), "user_id", "event_id", "raw").select("event_id", "user_id", "raw")


@query(f"WITH {_EV} SELECT event_id, user_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_marker, first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM ev")
def asof_marker(spark, d):
    rows = G.nearest_both(G.nearest_before(_events(spark, d), "user_id", "event_id", "mark"), "user_id", "event_id", "mark")
    return rows.select("event_id", "user_id", "last_marker", "following")


@query(f"WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, row_number() OVER (PARTITION BY raw ORDER BY event_id) AS f FROM ev) SELECT event_id, user_id, raw, number FROM n WHERE f = 1")
def running_number_first_writer(spark, d):
    return G.first_writer(G.numbered(_events(spark, d), "user_id", "event_id"), "raw", "event_id").select("event_id", "user_id", "raw", F.col("number").cast("long").alias("number"))


# --- reports -------------------------------------------------------------------------------------------------

CNT = f"{TOK}, cnt AS (SELECT collection, word, count(*) AS n FROM tok GROUP BY ALL)"


@query(f"WITH {CNT} SELECT word, n FROM cnt WHERE collection = 'en' AND word NOT IN (SELECT word FROM cnt WHERE collection = 'de')")
def vocab_anti(spark, d):
    return R.only_in(V.word_counts(toks(spark, d)), "en", "de")


@query(f"WITH {CNT}, x AS (SELECT word, coalesce(sum(n) FILTER (collection = 'en'), 0)::BIGINT AS n_left, coalesce(sum(n) FILTER (collection = 'de'), 0)::BIGINT AS n_right FROM cnt GROUP BY word) SELECT word, n_left, n_right, abs(n_left - n_right) AS gap FROM x WHERE n_left > 0 AND n_right > 0 AND abs(n_left - n_right) > greatest(1.0, 0.2 * least(n_left, n_right)) ORDER BY gap DESC, word LIMIT 20")
def freq_gap_topk(spark, d):
    return R.frequency_gaps(V.word_counts(toks(spark, d)), "en", "de").orderBy(F.desc("gap"), "word").limit(20)


@query(f"WITH {CNT}, s AS (SELECT collection, count(*) AS size FROM cnt GROUP BY collection) SELECT x.collection AS a, y.collection AS b, count(*) AS shared, count(*) / (any_value(sa.size) + any_value(sb.size) - count(*)) AS jaccard FROM cnt x JOIN cnt y ON x.word = y.word AND x.collection < y.collection JOIN s sa ON sa.collection = x.collection JOIN s sb ON sb.collection = y.collection GROUP BY ALL")
def jaccard_overlap(spark, d):
    return R.overlap(V.word_counts(toks(spark, d)))


@query(f"WITH {TOK}, {DIC} SELECT collection, count(*) AS n, count(DISTINCT word) AS n_words FROM tok WHERE word NOT IN (SELECT word FROM dic) GROUP BY collection")
def unknown_by_collection(spark, d):
    rows = toks(spark, d).join(dictionary(spark, d).select("word"), "word", "left_anti")
    return rows.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words"))


@query()
def ocr_quality(spark, d):
    return R.text_quality(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))


@query(f"WITH {CNT} SELECT collection, sum(n)::BIGINT AS n FROM cnt GROUP BY ROLLUP (collection)")
def rollup_totals(spark, d):
    return R.totals(V.word_counts(toks(spark, d)), "collection")


@query("SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality UNION ALL SELECT NULL, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labelled_units(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    seen = docs.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"))
    return seen.unionByName(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("quality"), "n"))
