"""The whole lemma cascade over distinct words: lookups in one join, recursion and compounds inside a word.

What a word can be split into by its spelling alone (particles, negations, fused pronouns) is a pure function of the
word, so all remainders are known before anything is looked up: they are looked up together in one join and put
together again within the word, shortest first. Compounds of what is left open go the same way: one join for all
spellings that their splits may ask for. No task holds the dictionary. Spelling and choice run in Arrow batches of
distinct words: as column expressions they took 27 s to build, and a run on 20 words had not ended after 75 s.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.storagelevel import StorageLevel

from .. import ship
from .lexicon import COMPOUNDS, LONG, PARTICLES, PRONOUNS, SHORT, TITLES

# Placeholder words, finite tags, name endings, fused verbs, verb and causative endings, base endings.
ENGLISH = ("on", "display", "title", "of", "section", "only")
FINITE = ("pr", "aor", "fut", "imp", "opt", "cond", "perf", "imperf")
NAME_ENDINGS = ("ssa", "āya", "ena", "ehi", "ānaṃ", "āsu", "aṃ", "ā", "e", "o")
FUSED = ("osmī", "osmi", "omhī", "omhi", "asmī", "asmi", "amhī", "amhi")
VERB_ENDINGS = (("āmā", "āma"), ("āmī", "āmi"), ("essāmī", "essāmi"), ("issāmī", "issāmi"), ("essāmā", "essāma"), ("issāmā", "issāma"))
CAUSATIVES = (("ayitvā", "eti"), ("etvā", "eti"), ("āpetvā", "āpeti"))
BASE_ENDINGS = ("ati", "eti", "oti", "āti")
VOWELS = "aeiouāīū"
APADANA = "^(.+?)(thera|therī|therassa|therassā)(apadāna|apadānaṃ)$"

#: Longer words are looked up as they stand and never taken apart.
LONGEST = 256
#: Rounds of the compound splitter; a compound has at most one part more.
DEPTH = 4
#: Sandhi rules that go to every task.
MOST_RULES = 100_000

COMPONENT = "struct<word:string,lemma:string,pos:string,root:string,verb:string,look:int>"
ANSWER = f"struct<strategy:string,lemma:string,pos:string,root:string,parts:array<string>,components:array<{COMPONENT}>>"
CUSTOM = "struct<lemma:string,pos:string,parts:array<string>>"
HEADWORDS = "array<struct<lemma:string,pos:string,root:string>>"

# Ranks of the strategies that look a word up; those that recurse stand between them (``options``).
ENGLISH_AT, DIRECT_AT, PRONOUN_AT, NAME_AT, VERB_AT, SHORT_AT, KNOWN_AT, TITLE_AT, APADANA_AT, CAUSATIVE_AT, COMPOUND_AT, CUSTOM_AT = 0, 10, 20, 50, 70, 80, 90, 100, 110, 120, 140, 150
NEGATION_AT = 130


@dataclass
class Lexicon:
    """What the cascade looks up. All but the dictionary may be left out; without rules no compound is split.

    ``dictionary(word, headwords, splits)``: one row a word (of several the least), headwords in order, splits as ``"a + b"``.
    ``names(nr, name)``, a later name wins a shared stem. ``custom(word, lemma, pos, parts)``; with parts, these answer.
    ``rules(nr, a, b, c, d, weight)``: where a and b meet, the parts end in c and begin with d.
    """

    dictionary: DataFrame
    names: DataFrame | None = None
    custom: DataFrame | None = None
    rules: DataFrame | None = None


def entries(lookup: DataFrame, headwords: DataFrame) -> DataFrame:
    """A dictionary from ``lookup(word, headwords, deconstructor)``, both JSON lists, and ``headwords(id, lemma_1, pos, root_key)``.

    The version number of a lemma goes, a root gets its sign; an id without a row keeps its place as null.
    """
    ids = lookup.select("word", F.posexplode(F.from_json("headwords", "array<bigint>")).alias("nr", "id"))
    lemma = F.regexp_replace("lemma_1", r"\s+\d+(\.\d+)?$", "")
    root = F.when(F.col("root_key") != "", F.concat(F.lit("√"), "root_key"))
    rows = headwords.select("id", F.struct(lemma.alias("lemma"), F.col("pos").alias("pos"), root.alias("root")).alias("h"))
    listed = ids.join(rows, "id", "left").groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "h"))), lambda x: x["h"]).cast(HEADWORDS).alias("headwords"))
    splits = lookup.select("word", F.from_json("deconstructor", "array<string>").alias("splits"))
    return splits.join(listed, "word", "left")


def single(dictionary: DataFrame) -> DataFrame:
    """A dictionary of the cascade from ``(word, lemma, pos)``, one headword a word and no splits."""
    entry = F.struct("lemma", "pos", F.lit(None).cast("string").alias("root"))
    return dictionary.groupBy("word").agg(F.min(entry).alias("e")).select("word", F.array("e").cast(HEADWORDS).alias("headwords"), F.lit(None).cast("array<string>").alias("splits"))


def _component(word=None, lemma=None, pos=None, root=None, verb=None, look=0) -> dict:
    return {"word": word, "lemma": lemma, "pos": pos, "root": root, "verb": verb, "look": look}


def _answer(strategy, lemma=None, pos=None, root=None, parts=None, components=None) -> dict:
    return {"strategy": strategy, "lemma": lemma, "pos": pos, "root": root, "parts": parts, "components": components}


def _looked(parts: list[str], look: int = 1) -> list[dict]:
    return [_component(word=p, look=look) for p in parts]


@dataclass
class Option:
    """One way to take a word apart by its spelling; it stands if its base is answered (``strict``: by a lemma)."""

    rank: int
    strategy: str
    base: str
    part: str
    component: dict
    front: bool = False
    strict: bool = False


def options(w: str) -> list[Option]:
    """The ways to take ``w`` apart, in order."""
    n, out = len(w), []
    if n > LONGEST:
        return out
    if n > 3 and w.endswith("ñcā"):
        out.append(Option(30, "nca", w[:-3] + "ṃ", "ca", _component(lemma="ca", pos="ind")))
    particle = next((p for p in PARTICLES if w.endswith(p) and n > len(p) + 1), None)
    if particle:
        base = w[: -len(particle)]
        base = base[:-1] + "ṃ" if particle == "ca" and base[-1] == "ñ" else base
        out.append(Option(40, "particle", base, particle, _component(lemma=PARTICLES[particle], pos="ind")))
    verb = next((s for s in FUSED if w.endswith(s) and n > len(s) + 2), None)
    if w.startswith("aham") and n > 6:
        out.append(Option(60, "fused_pronoun", w[4:], "ahaṃ", _component(lemma="ahaṃ", pos="pron"), front=True))
    elif verb:
        told = _component(lemma="attā", pos="pron", verb="asmi" if "sm" in verb else "amhi")
        out.append(Option(60, "fused_pronoun", w[: -len(verb)] + verb[0], verb, told))
    hard = [c not in VOWELS for c in w[1:3]]  # whether the second and the third letter are consonants
    negations = (  # least length, spelling, letters to cut, whether a lemma is asked
        (5, lambda: w.startswith("no"), 2, False),
        (5, lambda: w.startswith("na") and hard[1] and w[3] == w[2], 3, False),
        (5, lambda: w.startswith("an") and not hard[1], 2, n > 12),
        (6, lambda: w.startswith("nā"), 2, False),
        (6, lambda: w[0] == "a" and hard[0] and w[2] == w[1], 2, True),
        (9, lambda: w[0] == "a" and hard[0], 1, True),
    )
    for least, holds, cut, strict in negations:
        if n >= least and holds():
            out.append(Option(NEGATION_AT, "negation", w[cut:], "na", _component(lemma="na", pos="ind"), front=True, strict=strict))
    return out


def closure(word: str) -> list[str]:
    """``word`` and every remainder that some chain of options leads to."""
    found = {word: None}
    new = [word]
    while new:
        new = [b for b in dict.fromkeys(o.base for w in new for o in options(w)) if b not in found]
        found.update(dict.fromkeys(new))
    return list(found)


def _short_end(w: str) -> str | None:
    return w[:-1] + SHORT[LONG.index(w[-1])] if w and w[-1] in LONG else None


_SHORTEN = str.maketrans(LONG, SHORT)


def _quoted(host: str, w: str) -> bool:
    """Whether ``host`` and the quotative iti run together as ``w``, its last vowel long or short."""
    told, last = (w[:-1] + "i" if w.endswith("tī") else w), host[-1]
    if last == "ṃ":
        return told in (host[:-1] + "nti", host[:-1] + "miti")
    if last in SHORT and told == host[:-1] + LONG[SHORT.index(last)] + "ti":
        return True
    return last in SHORT + LONG + "oe" and told in (host + "ti", host + "iti")


def _chosen_split(splits: list[str], w: str, finite: bool) -> list[str] | None:
    """The split that answers: the first, but a quotative only if it makes the word and the word is no finite verb in -nti."""
    parts = [[p for p in (s or "").replace(" ", "").split("+") if p] for s in splits]
    if not (len(parts[0]) == 2 and parts[0][1] == "iti"):
        return parts[0] or None
    if finite and w.endswith(("nti", "ntī")):
        return None
    return next((p for p in parts if len(p) == 2 and p[1] == "iti" and _quoted(p[0], w)), None)


def _headword(listed: list[dict | None], w: str) -> dict | None:
    """The first headword; for a word in -ti that it does not cite, a present verb that cites the word comes first."""
    cited = (w, _short_end(w) or w)
    first = listed[0] if listed else None
    if first and first["pos"] not in FINITE and first["lemma"] not in cited and w.endswith(("ti", "tī")):
        return next((h for h in listed[1:] if h and h["pos"] == "pr" and h["lemma"] in cited), first)
    return first


def _store(lexicon: Lexicon) -> DataFrame:
    """All that can be looked up, under a kind and a key: d dictionary, n name, s stem of a name, c custom."""
    none = {"headwords": HEADWORDS, "splits": "array<string>", "name": "string", "custom": CUSTOM}

    def rows(df, kind, key, **have):
        return df.select(F.lit(kind).alias("kind"), key.alias("key"), F.struct(*[have.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()]).alias("entry"))

    out = rows(lexicon.dictionary, "d", F.col("word"), headwords=F.col("headwords"), splits=F.col("splits"))
    if lexicon.names is not None:
        names = lexicon.names.where(~F.col("name").contains(" "))
        out = out.unionByName(rows(names.select("name").distinct(), "n", F.col("name"), name=F.col("name")))
        stems = names.where(F.col("name").rlike("[aā]$")).groupBy(F.expr("left(name, length(name) - 1)").alias("stem")).agg(F.max_by("name", "nr").alias("name"))
        out = out.unionByName(rows(stems, "s", F.col("stem"), name=F.col("name")))
    if lexicon.custom is not None:
        out = out.unionByName(rows(lexicon.custom, "c", F.col("word"), custom=F.struct("lemma", "pos", "parts")))
    return out


def _keys(w: str) -> Iterator[tuple[int, str, str]]:
    """Every ``(slot, kind, key)`` that a form is looked up under, by slots in order."""
    yield 0, "d", w
    if w.endswith("n") or (w.endswith("m") and len(w) > 1):
        yield 1, "d", w[:-1] + "ṃ"
    if _short_end(w):
        yield 2, "d", _short_end(w)
    verb = next((w[: -len(a)] + b for a, b in VERB_ENDINGS if w.endswith(a)), None)
    if verb:
        yield 3, "d", verb
    if w.translate(_SHORTEN) != w:
        yield 4, "d", w.translate(_SHORTEN)
    yield 5, "c", w
    slot = CAUSATIVE_SLOT
    for end, base in CAUSATIVES:
        stem = w[: -len(end)] if w.endswith(end) else ""
        for k, e in enumerate((base, *BASE_ENDINGS)):
            if len(stem) > (3 if k else 0):
                yield slot + k, "d", stem + e
        slot += 1 + len(BASE_ENDINGS)
    yield NAME_SLOT, "n", w
    for k, end in enumerate(NAME_ENDINGS):
        if w.endswith(end) and len(w) > len(end) + 2:
            yield NAME_SLOT + 1 + 2 * k, "s", w[: -len(end)]
            yield NAME_SLOT + 2 + 2 * k, "n", w[: -len(end)] + "a"


CAUSATIVE_SLOT = 6
NAME_SLOT = CAUSATIVE_SLOT + len(CAUSATIVES) * (1 + len(BASE_ENDINGS))


def _by_headword(strategy: str, h: dict | None) -> dict | None:
    return _answer(strategy, h["lemma"], h["pos"], h["root"]) if h and h["lemma"] else None


def _direct(w: str, hits: dict[int, dict]) -> dict | None:
    """By the dictionary row of the word, its niggahita spelling or its short end: the first that holds anything."""
    for slot, strategy in enumerate(("direct", "niggahita", "final_vowel")):
        row = hits.get(slot) or {}
        if row.get("headwords") or row.get("splits"):
            verbs = [h for k in (0, 2) if k == 0 or w.endswith("ī") for h in (hits.get(k) or {}).get("headwords") or [] if h and h["pos"] in FINITE]
            parts = _chosen_split(row["splits"], w, bool(verbs)) if row["splits"] else None
            return _answer(strategy, parts=parts, components=_looked(parts)) if parts else _by_headword(strategy, _headword(row["headwords"], w))
    return None


def _at_hand(w: str, hits: dict[int, dict]) -> Iterator[tuple[int, dict | None]]:
    """What each strategy that looks up answers for ``w``, in order."""
    yield ENGLISH_AT, _answer("english", w, "eng") if w in ENGLISH else None
    yield DIRECT_AT, _direct(w, hits)
    yield PRONOUN_AT, _answer("pronoun", PRONOUNS[w], "pron") if w in PRONOUNS else None
    yield NAME_AT, next((_answer("name", hits[k]["name"], "name") for k in sorted(hits) if k >= NAME_SLOT), None)
    for rank, slot, strategy in ((VERB_AT, 3, "verb_ending"), (SHORT_AT, 4, "long_vowels")):
        yield rank, _by_headword(strategy, _headword((hits.get(slot) or {}).get("headwords"), w))
    yield KNOWN_AT, _answer("known_compound", parts=list(COMPOUNDS[w]), components=_looked(COMPOUNDS[w])) if w in COMPOUNDS else None
    for end, base in TITLES.items():
        if w.endswith(end) and w != end:
            stem = w[: -len(end)]
            yield TITLE_AT, _answer("title", w, "title", parts=[stem, base], components=[_component(word=stem, pos="name"), _component(lemma=base, pos="masc")])
    m = re.match(APADANA, w)
    if m:
        elder = _component(lemma="therī", pos="fem") if "therī" in m[2] else _component(lemma="thera", pos="masc")
        yield APADANA_AT, _answer("apadana", w, "title", parts=list(m.groups()), components=[_component(word=m[1], pos="name"), elder, _component(lemma="apadāna", pos="nt")])
    cause = next((hits[k]["headwords"] for k in sorted(hits) if CAUSATIVE_SLOT <= k < NAME_SLOT), None)
    if cause and cause[0]:
        yield CAUSATIVE_AT, _answer("causative", cause[0]["lemma"], "abs", cause[0]["root"])
    custom = (hits.get(5) or {}).get("custom")
    if custom:
        yield CUSTOM_AT, _answer("custom", parts=custom["parts"], components=_looked(custom["parts"])) if custom["parts"] else _answer("custom", custom["lemma"], custom["pos"])


def _by_row(rows: DataFrame, ddl: str, f: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """The rows that ``f`` makes of each row, in Arrow batches."""
    ship(rows.sparkSession)
    schema: StructType = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = [made for row in batch.to_pylist() for made in f(row)]
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_pylist(out[k : k + 4096], schema=arrow)

    return rows.mapInArrow(run, schema)


def _ask(row: dict) -> Iterator[dict]:
    return ({"word": row["word"], "slot": slot, "kind": kind, "key": key} for slot, kind, key in _keys(row["word"]))


def _look(row: dict) -> Iterator[dict]:
    hits = {h["slot"]: h["entry"] for h in sorted(row["hits"], key=str, reverse=True)}  # of rows under one key the least
    rank, answer = next(((k, a) for k, a in _at_hand(row["word"], hits) if a and (a["lemma"] or a["parts"])), (None, None))
    yield {"word": row["word"], "custom": 5 in hits, "rank": rank, "answer": answer}


def _spell(row: dict) -> Iterator[dict]:
    return ({"word": row["word"], "form": form} for form in closure(row["word"]))


def _apart(row: dict) -> Iterator[dict]:
    return ({"word": row["word"], "strategy": o.strategy, "base": o.base, "part": o.part} for o in options(row["word"]))


def spelling_splits(words: DataFrame) -> DataFrame:
    """``(word, strategy, base, part)``: the ways to take each distinct word apart by its spelling, answered or not."""
    return _by_row(words.select("word").where("word is not null").distinct(), "word string, strategy string, base string, part string", _apart)


def looked_up(forms: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(word, custom, rank, answer)``: what answers each form without taking it apart; rank null if nothing does."""
    asked = _by_row(forms, "word string, slot int, kind string, key string", _ask)
    hits = asked.join(_store(lexicon), ["kind", "key"], "left").groupBy("word").agg(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("slot", "entry"))).alias("hits"))
    return _by_row(hits, f"word string, custom boolean, rank int, answer {ANSWER}", _look)


Rules = dict[tuple[str, str], list[tuple[int, str, str, int]]]


def _rules(rules: DataFrame) -> Rules:
    """The sandhi rules by the letters they join; a parameter table, refused beyond ``MOST_RULES`` rows."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} sandhi rules")
    out: Rules = {}
    for r in sorted(rows, key=lambda r: r["nr"]):
        out.setdefault((r["a"], r["b"]), []).append((r["nr"], r["c"], r["d"], r["weight"]))
    return out


def _seams(w: str, rules: Rules) -> Iterator[tuple[int, str, str]]:
    """``(weight, front, rest)`` of every place where ``w`` may be two parts, in order: the plain seam, then the rules."""
    least = 3 if len(w) >= 10 else 4
    for at in range(least, len(w) - least + 1):
        yield 1, w[:at], w[at:]
        for _, c, d, weight in rules.get((w[at - 1], w[at]), ()):
            front, rest = w[: at - 1] + c, d + w[at + 1 :]
            if len(front) >= least and len(rest) >= least:
                yield weight, front, rest


def _openable(w: str, rest: str) -> bool:
    return len(rest) >= (6 if len(w) >= 10 else 8)


def _reached(w: str, rules: Rules) -> dict[str, list[tuple[int, str, str]]]:
    """The seams of ``w`` and of all that may be left of it after fewer than ``DEPTH`` parts."""
    out, new = {}, [w]
    for _ in range(DEPTH):
        found = {x: list(_seams(x, rules)) for x in new}
        out.update(found)
        new = [r for r in dict.fromkeys(rest for x, seams in found.items() for _, _, rest in seams if _openable(x, rest)) if r not in out]
    return out


def _best(w: str, rules: Rules, known: set[str]) -> tuple[list[str], int] | None:
    """The best split of ``w``: by number of parts, so that a remainder is settled a round before what it ends."""

    def whole(x):
        return x in known or x.translate(_SHORTEN) in known

    reached = {x: [s for s in seams if whole(s[1])] for x, seams in _reached(w, rules).items()}
    done: dict[str, tuple[tuple[int, int], list[str]]] = {}
    for k in range(DEPTH):
        layer = {}
        for x, seams in reached.items():
            if x in done:
                continue
            found = []
            for weight, front, rest in seams:
                if k == 0 and whole(rest):
                    found.append(((-weight, min(len(front), len(rest))), [front, rest]))
                elif k and rest in done and _openable(x, rest) and not whole(rest):
                    (less, short), parts = done[rest]
                    found.append(((less - weight, min(len(front), short)), [front, *parts]))
            if found:
                layer[x] = max(found, key=lambda f: f[0])
        done.update(layer)
    return (done[w][1], -done[w][0][0]) if w in done else None


def sandhi_compounds(words: DataFrame, keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``(word, parts, weight)``: the best split of words of 8 to ``LONGEST`` letters into keys, across sandhi.

    Fewest parts win (five at most), then least weight (1 a plain seam, else the rule's), then the longest least part,
    then the first seam and rule. Parts have 3 letters, 4 where less than 10 are to be split; they count as keys with
    all vowels short too, and only what is no key is split further. All spellings that a word's splits may ask for go
    through one join; the choice is made within the word. Words that nothing splits are left out.
    """
    table = _rules(rules)

    def ask(row):
        asked = {p for seams in _reached(row["word"], table).values() for s in seams for p in s[1:]}
        return ({"word": row["word"], "key": k} for k in sorted(asked | {p.translate(_SHORTEN) for p in asked}))

    def split(row):
        best = _best(row["word"], table, set(row["known"]))
        if best:
            yield {"word": row["word"], "parts": best[0], "weight": best[1]}

    long_ = words.select("word").distinct().where(F.length("word").between(8, LONGEST))
    known = _by_row(long_, "word string, key string", ask).join(keys.select(F.col("word").alias("key")).distinct(), "key")
    return _by_row(known.groupBy("word").agg(F.collect_list("key").alias("known")), "word string, parts array<string>, weight int", split)


def _put_together(row: dict) -> Iterator[dict]:
    """The answer of a word from those of its forms, shortest first, each from its lookup or its answered remainder."""
    done: dict[str, dict] = {}
    for x in sorted(row["found"], key=lambda x: len(x["form"])):
        before = CUSTOM_AT + 1 if x["rank"] is None else x["rank"]
        answer = x["answer"]
        for o in options(x["form"]):
            base = done.get(o.base)
            if o.rank < before and base and (base["lemma"] or not o.strict) and not (x["custom"] and o.rank >= NEGATION_AT):
                parts = base["parts"] or [o.base]
                told = base["components"] or [_component(lemma=base["lemma"], pos=base["pos"], root=base["root"])]
                both = ([o.part, *parts], [o.component, *told]) if o.front else ([*parts, o.part], [*told, o.component])
                answer = _answer(o.strategy, parts=both[0], components=both[1])
                break
        if answer:
            done[x["form"]] = answer
    yield {"word": row["word"], "answer": done.get(row["word"])}


def _with_components(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Components that name a part get the first headword of it, or of its short-vowelled spelling in compounds."""
    asked = rows.where("exists(answer.components, c -> c.look > 0)").select("word", F.posexplode("answer.components").alias("nr", "c"))
    keys = F.array(F.struct(F.lit(0).alias("k"), F.when(F.col("c.look") > 0, F.col("c.word")).alias("key")), F.struct(F.lit(1).alias("k"), F.when(F.col("c.look") > 1, F.translate("c.word", LONG, SHORT)).alias("key")))
    heads = dictionary.select(F.col("word").alias("key"), F.get("headwords", F.lit(0)).alias("h")).where("h is not null")
    seen = asked.select("word", "nr", "c", F.explode(keys).alias("x")).select("word", "nr", "c", "x.*").join(heads, "key", "left")
    one = seen.groupBy("word", "nr").agg(F.first("c").alias("c"), F.min(F.when(F.col("h").isNotNull(), F.struct("k", "h"))).alias("m"))
    told = F.expr("if(m is null, c, named_struct('word', cast(null as string), 'lemma', m.h.lemma, 'pos', m.h.pos, 'root', m.h.root, 'verb', cast(null as string), 'look', 0))")
    full = one.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", told.alias("c")))), lambda x: x["c"]).alias("told"))
    return rows.join(full, "word", "left").withColumn("components", F.coalesce("told", "answer.components")).drop("told")


def lemmatize(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(word, lemma, pos, root, parts, components, strategy)`` per distinct word; ``unknown`` where nothing answers.

    In order: placeholder words, dictionary (as it stands, niggahita, final vowel), short pronouns, -ñcā, particles,
    names, fused pronouns, verb endings, long vowels, known compounds, titles, causatives, negations, compounds, custom.
    Null words are left out, empty ones are unknown, repeated ones come once; an empty table gives an empty one. Words
    beyond ``LONGEST`` letters are not taken apart.
    """
    distinct = words.select("word").where("word is not null").distinct()
    pairs = _by_row(distinct, "word string, form string", _spell)
    found = looked_up(pairs.select(F.col("form").alias("word")).distinct(), lexicon)
    if lexicon.rules is not None:
        found = found.persist(StorageLevel.MEMORY_AND_DISK)
        split = sandhi_compounds(found.where(f"(rank is null or rank > {COMPOUND_AT}) and not custom"), lexicon.dictionary, lexicon.rules)
        told = F.expr(f"cast(named_struct('strategy', 'compound', 'lemma', null, 'pos', null, 'root', null, 'parts', parts, 'components', transform(parts, p -> named_struct('word', p, 'lemma', null, 'pos', null, 'root', null, 'verb', null, 'look', 2))) as {ANSWER})")
        found = found.join(split.select("word", told.alias("compound")), "word", "left")
        found = found.select("word", "custom", F.when(F.col("compound").isNotNull(), COMPOUND_AT).otherwise(F.col("rank")).alias("rank"), F.coalesce("compound", "answer").alias("answer"))
    forms = pairs.join(found.withColumnRenamed("word", "form"), "form").groupBy("word").agg(F.collect_list(F.struct("form", "custom", "rank", "answer")).alias("found"))
    out = _with_components(_by_row(forms, f"word string, answer {ANSWER}", _put_together), lexicon.dictionary)
    components = F.expr("transform(components, c -> named_struct('word', c.word, 'lemma', c.lemma, 'pos', c.pos, 'root', c.root, 'verb', c.verb))")
    return out.select("word", "answer.lemma", "answer.pos", "answer.root", "answer.parts", components.alias("components"), F.coalesce("answer.strategy", F.lit("unknown")).alias("strategy"))
