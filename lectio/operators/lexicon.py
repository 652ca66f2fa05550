"""Resolution of distinct words to dictionary headwords by an ordered cascade; the first strategy that answers wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Trailing particles with their lemmas, short pronouns, known compounds, verb endings, title endings.
PARTICLES = {"ca": "ca", "pi": "api", "pī": "api", "va": "va", "vā": "vā", "ti": "ti", "tī": "ti", "tu": "tu", "tū": "tu"}
PRONOUNS = {"m": "ahaṃ", "man": "ahaṃ", "maṃ": "ahaṃ", "tan": "so", "taṃ": "so", "yan": "ya", "yaṃ": "ya", "kin": "kiṃ", "kiṃ": "kiṃ"}
COMPOUNDS = {"paṭhamajhāna": ("paṭhama", "jhāna"), "dutiyajhāna": ("dutiya", "jhāna"), "tatiyajhāna": ("tatiya", "jhāna"), "catutthajhāna": ("catuttha", "jhāna")}
VERB_ENDINGS = {"āmā": "āma", "āmī": "āmi"}
TITLES = {"vaggo": "vagga", "vagga": "vagga", "vatthu": "vatthu"}
CAUSATIVES = (("ayitvā", "eti"), ("etvā", "eti"), ("āpetvā", "āpeti"))
LONG, SHORT = "āīū", "aiu"


def lookup_map(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def shortened_end(word: Column) -> Column:
    """The word with a final long vowel shortened, or null."""
    return F.when(word.rlike(f"[{LONG}]$"), F.concat(F.expr("substring(word, 1, length(word) - 1)"), F.translate(F.expr("right(word, 1)"), LONG, SHORT)))


def niggahita_end(word: Column) -> Column:
    """The word with a final n, or m after another letter, written as niggahita; or null."""
    return F.when(word.rlike("n$|.m$"), F.concat(F.expr("substring(word, 1, length(word) - 1)"), F.lit("ṃ")))


#: Spellings that a word is looked up under, in order, with the strategy's name; null where one does not apply.
CANDIDATES: list[tuple[str, Callable[[Column], Column]]] = [
    ("direct", lambda w: w),
    ("niggahita", niggahita_end),
    ("final_vowel", shortened_end),
    ("verb_ending", lambda w: F.coalesce(*[F.when(w.endswith(a), F.concat(F.expr(f"substring(word, 1, length(word) - {len(a)})"), F.lit(b))) for a, b in VERB_ENDINGS.items()])),
    ("long_vowels", lambda w: F.when(w.rlike(f"[{LONG}]"), F.translate(w, LONG, SHORT))),
    ("causative", lambda w: F.coalesce(*[F.when(w.endswith(a), F.concat(F.expr(f"substring(word, 1, length(word) - {len(a)})"), F.lit(b))) for a, b in CAUSATIVES])),
]


def particle_base(word: Column) -> Column:
    """What stands before the first listed particle that the word ends with, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(PARTICLES):
        out = F.when(word.endswith(p) & (F.length(word) > len(p)), F.expr(f"substring(word, 1, length(word) - {len(p)})")).otherwise(out)
    return out


def resolve(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(word, lemma, pos, strategy)`` per distinct word; strategy ``unknown`` where nothing answers.

    All candidate spellings are looked up in one join on the key, and the first in order wins: one shuffle of
    distinct words, whatever the number of strategies. Short pronouns come after the direct spellings; a
    trailing particle is tried last, with the lemma of its base (one level).
    """
    w = F.col("word")
    tries = [F.struct(F.lit(k).alias("rank"), F.lit(name).alias("strategy"), f(w).alias("key")) for k, (name, f) in enumerate(CANDIDATES)]
    tries.append(F.struct(F.lit(90).alias("rank"), F.lit("particle").alias("strategy"), particle_base(w).alias("key")))
    distinct = words.select("word").distinct()
    rows = distinct.select("word", F.explode(F.filter(F.array(*tries), lambda x: x["key"].isNotNull())).alias("x")).select("word", "x.*")
    hits = rows.join(dictionary.select(F.col("word").alias("key"), "lemma", "pos"), "key")
    best = hits.groupBy("word").agg(F.min(F.struct("rank", "strategy", "lemma", "pos")).alias("b")).select("word", "b.*")
    pronoun = lookup_map(PRONOUNS, w)
    out = distinct.join(best, "word", "left")
    early = pronoun.isNotNull() & (F.coalesce("rank", F.lit(99)) > 2)
    return out.select("word", F.when(early, pronoun).otherwise(F.col("lemma")).alias("lemma"), F.when(early, F.lit("pron")).otherwise(F.col("pos")).alias("pos"), F.when(early, F.lit("pronoun")).otherwise(F.coalesce("strategy", F.lit("unknown"))).alias("strategy"))


def boundary_splits(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``(word, at, left, right, weight)``: identity (weight 1) and rule splits at every place; empty parts drop out.

    ``rules(a, b, c, d, weight)``: where a and b meet, the parts end in c and begin with d instead.
    """
    cut = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).where("length(word) > 1")
    left, right = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 1)")
    plain = cut.select("word", "at", left.alias("left"), right.alias("right"), F.lit(1).alias("weight"))
    ruled = cut.withColumn("a", F.expr("substring(word, at, 1)")).withColumn("b", F.expr("substring(word, at + 1, 1)")).join(rules.distinct(), ["a", "b"])
    ruled = ruled.select("word", "at", F.concat(F.expr("substring(word, 1, at - 1)"), "c").alias("left"), F.concat("d", F.expr("substring(word, at + 2)")).alias("right"), "weight")
    return plain.unionByName(ruled).where("left <> '' and right <> ''")


def split_compounds(words: DataFrame, keys: DataFrame, least: int = 8, part: int = 4, depth: int = 4) -> DataFrame:
    """``(word, parts)``: fewest-part split of words into dictionary keys of ``part`` letters or more; ties to longer first parts.

    Built-in and distributed: each round extends all partial splits by one join on the key, so no task holds the dictionary.
    """
    long_ = words.select("word").distinct().where(F.length("word") >= least)
    known = keys.select(F.col("word").alias("key")).distinct().where(F.length("key") >= part)
    front = long_.select("word", F.lit(0).alias("done"), F.array().cast("array<string>").alias("parts"))
    found = None
    for _ in range(depth):
        ends = F.sequence(F.col("done") + part, F.length("word"))
        step = front.where(F.length("word") - F.col("done") >= part).select("word", "done", "parts", F.explode(ends).alias("end"))
        step = step.withColumn("key", F.expr("substring(word, done + 1, end - done)")).join(known, "key")
        step = step.select("word", F.col("end").alias("done"), F.array_append("parts", F.col("key")).alias("parts"))
        whole = step.where((F.col("done") == F.length("word")) & (F.size("parts") > 1))
        found = whole if found is None else found.unionByName(whole)
        front = step.where(F.col("done") < F.length("word"))
    rank = F.struct(F.size("parts").alias("n"), (-F.length(F.get("parts", F.lit(0)))).alias("first"), F.col("parts"))
    return found.groupBy("word").agg(F.min(rank).alias("r")).select("word", F.col("r.parts").alias("parts"))


# Endings that suggest a part of speech, first match wins, and ordered categories of unknown words.
POS_RULES = (("tvā$", "abs"), ("tuṃ$", "inf"), ("anto$|ant[aā]$", "prp"), ("(nti|ti|si|mi)$", "pr"), ("(ṃsu|esuṃ|iṃsu)$", "aor"), ("o$", "masc"), ("aṃ$", "nt"), ("ā$", "fem"))


def infer_pos(word: Column) -> Column:
    out = F.lit("unknown")
    for pattern, pos in reversed(POS_RULES):
        out = F.when(word.rlike(pattern), pos).otherwise(out)
    return out


def unknown_category(word: Column) -> Column:
    """Ordered rules: very short, very long, long final vowel, nasal ending, else other."""
    return F.when(F.length(word) <= 2, "short").when(F.length(word) > 25, "compound").when(word.rlike("[āīū]$"), "long_vowel").when(word.rlike("[ṃnm]$"), "nasal").otherwise("other")
