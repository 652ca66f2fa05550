"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence, in built-in functions only.

Protected entities are the values that the patterns find, compared without case. A document is one event: n(e),
n(t) and n(e, t) count the documents that hold an entity, a term, and both, whatever their distance. A term
discloses an entity if their pointwise mutual information reaches ``DISCLOSED`` of the entity's information; it is
marked wherever it stands, in documents that do not name the entity too, and generalised or removed.

The patterns' guards (``(?<!..)``, ``\\G``) and possessive repeats change no match that counts; they keep the search
linear in texts with very long runs, and leave out runs of digits whose number no card has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .sketch import member_table, only_members

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Words that can reveal an entity: three letters or more, whole.
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?!\p{N})"
#: A term discloses an entity if their pointwise mutual information reaches this share of the entity's own information.
DISCLOSED = 0.85
#: Leading letters that a generalised term may keep, at least and at most.
STEM = (3, 6)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def find_all(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, end, value>>``, code points, end exclusive; only those whose value ``keep`` holds for.

    Only kept matches grow an array, and very many matches are placed in blocks of about the square root of their
    number, first the blocks, then the matches of each, so that no array grows by more than that many steps.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    keep = keep or (lambda value: F.lit(True))

    def place(p: Column) -> Column:
        n = F.size(p["hits"])
        wide = F.greatest(F.lit(256), F.ceil(F.sqrt(n)).cast("int"))
        every = F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int"))
        block = lambda b: F.sequence(b * wide, F.least(n, (b + 1) * wide) - 1)
        gap = lambda i: F.length(F.get(p["gaps"], i))
        sums = F.transform(every, lambda b: F.aggregate(block(b), F.lit(0), lambda a, i: a + gap(i) + F.length(F.get(p["hits"], i))))
        grow = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        firsts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), grow, lambda a: a["out"])

        def step(a: Column, i: Column) -> Column:
            start, value = a["at"] + gap(i), F.get(p["hits"], i)
            end = start + F.length(value)
            more = F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), value.alias("value")))
            return F.struct(end.alias("at"), F.when(keep(value), more).otherwise(a["out"]).alias("out"))

        walk = lambda first, b: F.aggregate(block(b), F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])
        many = bound(firsts, lambda f: F.flatten(F.transform(every, lambda b: walk(F.get(f, b), b))))
        return F.when(n == 0, none).when(n <= wide, walk(F.lit(0), F.lit(0))).otherwise(many)

    return bound(parts, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""

    def step(d: Column):
        def add(a: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return bound(digits, step)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(14, 19), luhn(_digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
_NONE = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def _spans_of(text: Column, k: int) -> Column:
    valid = _VALID[KINDS[k]]
    spans = find_all(text, PATTERNS[KINDS[k]], valid)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end, value>>`` by start, then kind as listed in ``KINDS`` (its number).

    Failing matches are dropped and not retried. ``text`` must not be null. A text without digits or ``@`` is not searched.
    """
    found = []
    for k, kind in enumerate(KINDS):
        may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        found.append(F.when(may, _spans_of(text, k)).otherwise(F.expr(_NONE)))
    return F.array_sort(F.concat(*found))


def _entities(spans: Column) -> Column:
    """The distinct protected values of a document."""
    return F.array_distinct(F.transform(spans, lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, text)``: the id as it is, a hash of the text, the text, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def judge(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``(t, removed, need)``: the terms that disclose an entity; whether one never occurs without an entity; in how many documents a safe substitute must occur.

    ``rows`` is ``(id, mark, text)``, ``spans`` adds their base spans, without the text, and the distinct terms of
    those that have any. With N documents a term discloses an entity if log2(n(e,t) N / (n(e) n(t))) is
    ``DISCLOSED`` or more of log2(N / n(e)). Entities of the same documents are judged as one. A substitute that
    occurs in ``need`` documents or more discloses none of the entities, even if it occurs with them always.
    """
    total = F.lit(float(max(spans.count(), 1)))
    held = spans.where(F.size("spans") > 0)
    named = held.select("id", "mark", "terms", F.explode(_entities(F.col("spans"))).alias("e"))
    # entities that occur in the same documents have equal counts with every term
    place = F.xxhash64("id", "mark")
    same = named.groupBy("e").agg(F.count("*").alias("ne"), *[F.sum(F.pmod(F.xxhash64(F.lit(k), place), F.lit(1 << 40))).alias(f"s{k}") for k in (1, 2)])
    kind = ["ne", "s1", "s2"]
    occurs = named.select("id", "mark", "e").join(same, "e").select("id", "mark", *kind).distinct()
    copies = held.groupBy("id", "mark").agg(F.count("*").alias("copies"), F.first("terms").alias("terms"))
    occurs = occurs.withColumnsRenamed({"id": "id_", "mark": "mark_"})
    pairs = occurs.join(copies, (F.col("mark_") == F.col("mark")) & F.col("id_").eqNullSafe(F.col("id")))
    met = pairs.select(*kind, "copies", F.explode("terms").alias("t")).groupBy(*kind, "t").agg(F.sum("copies").alias("net"))
    counts = rows.select(F.explode(_terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("nt"))
    own = -F.log2(F.col("ne") / total)
    mutual = F.log2(F.col("net") * total / (F.col("ne") * F.col("nt")))
    need = F.ceil(total * F.pow(F.col("ne") / total, F.lit(DISCLOSED)))
    return met.join(counts, "t").where(mutual >= DISCLOSED * own).groupBy("t").agg(F.max(F.col("net") == F.col("nt")).alias("removed"), F.max(need).alias("need"))


def _bucketed(terms: Column) -> Column:
    """The structs dealt by the hash of their ``t`` into arrays of about eight."""
    n = F.floor(F.size(terms) / 8).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(terms, lambda x: F.pmod(F.hash(x["t"]), n) == b))


def _bucket(buckets: Column, value: Column) -> Column:
    return F.get(buckets, F.pmod(F.hash(value), F.size(buckets)))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, spans, terms)``, a row for each of ``df``: base spans, and the spans of disclosing terms outside them.

    ``removed`` tells the terms that never occur without an entity that they disclose.

    Rows count one by one, repeated rows and null ids too; null text is empty; an empty table gives no rows. Other
    columns are not read. Ties at the threshold count as disclosing. Counts and mentions are shuffled,
    of the words that stand in a text only those that a sketch of the disclosing terms may hold; texts meet the
    terms found in them by a broadcast of those where they are few, else by a join on id and text hash.
    """
    rows = keyed(df, id_col, text_col)
    terms = F.when(F.size("spans") > 0, _terms(F.col("text")))
    spans = scratch.cut(rows.withColumn("spans", base_spans(F.col("text"))).withColumn("terms", terms).drop("text"), "mentions")
    judged = _judged(rows, spans)
    return _marked(rows, spans, judged)


def _judged(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``judge``'s rows, written once; the shuffle files behind them are left to be dropped."""
    judged = scratch.cut(judge(rows, spans), "judged")
    scratch.release(rows.sparkSession)
    return judged


def _marked(rows: DataFrame, spans: DataFrame, judged: DataFrame) -> DataFrame:
    """``(id, mark, spans, terms)`` of ``rows``: base spans, and those of the judged terms outside them."""
    key = lambda df: df.withColumnsRenamed({"id": "id_", "mark": "mark_"})
    # most words are no judged terms: a sketch of those keeps the others out of the shuffle
    words = only_members(rows.select("id", "mark", F.explode(_terms(F.col("text"))).alias("t")), member_table(judged.select(F.xxhash64("t"))), F.xxhash64("t"))
    hits = words.join(judged.select("t", "removed"), "t").select("id", "mark", F.struct("t", "removed").alias("x")).distinct()
    hits = key(hits.groupBy("id", "mark").agg(F.sort_array(F.collect_list("x")).alias("found"))).withColumn("found", _bucketed(F.col("found")))
    held = spans.where(F.size("spans") > 0).select("id", "mark", "spans").dropDuplicates(["id", "mark"])
    known = held.join(hits, (F.col("mark") == F.col("mark_")) & F.col("id").eqNullSafe(F.col("id_")), "full")
    known = known.select(F.coalesce("id", "id_").alias("id_"), F.coalesce("mark", "mark_").alias("mark_"), "spans", "found")
    known = scratch.cut(known, "known")
    scratch.release(rows.sparkSession)  # the shuffle files so far
    out = rows.join(known, (F.col("mark") == F.col("mark_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    out = out.withColumn("spans", F.coalesce("spans", F.expr(_NONE)))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,removed:boolean>>)")

    def marked(found: Column, s: Column) -> Column:
        same = lambda v: bound(F.lower(v), lambda w: F.exists(_bucket(found, w), lambda x: x["t"] == w))
        free = lambda t: ~F.exists(s, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        gone = lambda t: F.exists(_bucket(found, F.lower(t["value"])), lambda x: (x["t"] == F.lower(t["value"])) & x["removed"])
        hit = F.filter(find_all(F.col("text"), TERM, same), free)
        return F.transform(hit, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), gone(t).alias("removed")))

    terms = F.when(F.col("found").isNull(), none).otherwise(marked(F.col("found"), F.col("spans")))
    return out.select("id", "mark", "spans", terms.alias("terms"))


def render(spans: Column) -> Column:
    """``kind:start:end`` of ``array<struct<start, kind, end>>``, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Base and term spans of ``detect``'s rows, by start, then kind."""
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    term = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat(base, term))


def substitutes(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``(t, by)``: for each judged term its generalisation, its longest leading letters that are safe and a star; empty if none is.

    Leading letters stand for all terms that start so. They occur in as many documents at least as the commonest
    of those terms other than ``t``, and are safe if that is ``need`` or more.
    """
    least, most = STEM
    sizes = lambda t: F.sequence(F.lit(least), F.least(F.lit(most), F.length(t) - 1))
    stems = F.when(F.length("t") > least, F.transform(sizes("t"), lambda n: F.substring("t", F.lit(1), n))).otherwise(F.expr("cast(array() as array<string>)"))
    asked = judged.select("t", "need", F.explode(stems).alias("stem"))
    counts = rows.select(F.explode(_terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("nt"))
    # the two commonest terms of each stem are enough: one of them is not t
    top = counts.select(F.explode(stems).alias("stem"), "t", "nt").join(asked.select("stem").distinct(), "stem", "left_semi")
    best = top.groupBy("stem").agg(F.max(F.struct("nt", "t")).alias("best"))
    other = top.join(best, "stem").where(F.col("t") != F.col("best.t")).groupBy("stem").agg(F.max("nt").alias("second"))
    both = best.join(other, "stem", "left").select("stem", "best", F.coalesce("second", F.lit(0)).alias("second"))
    safe = asked.join(both, "stem").where(F.when(F.col("best.t") == F.col("t"), F.col("second")).otherwise(F.col("best.nt")) >= F.col("need"))
    safe = safe.groupBy("t").agg(F.max(F.struct(F.length("stem"), "stem"))["stem"].alias("stem"))
    return judged.select("t").join(safe, "t", "left").select("t", F.coalesce(F.concat("stem", F.lit("*")), F.lit("")).alias("by"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text sanitised: base values become ``[EMAIL]`` and so on, disclosing terms their generalisation or nothing.

    A term that never occurs without its entity is removed; of the others the safe leading letters stay, if any are.

    Where spans overlap, the one that starts first is replaced, and of the next what is left of it goes. Null text
    stays null. Rows that agree in id and text get the same text; other columns may have any names.
    """
    rows = keyed(df, id_col, text_col)
    terms = F.when(F.size("spans") > 0, _terms(F.col("text")))
    spans = scratch.cut(rows.withColumn("spans", base_spans(F.col("text"))).withColumn("terms", terms).drop("text"), "mentions")
    judged = _judged(rows, spans)
    found = scratch.cut(_marked(rows, spans, judged).dropDuplicates(["id", "mark"]).where((F.size("spans") > 0) | (F.size("terms") > 0)), "spans")
    by = substitutes(rows, judged.where(~F.col("removed")))
    base = found.select("id", "mark", F.explode("spans").alias("s")).select("id", "mark", "s.start", "s.end", F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("s.kind")).alias("by"))
    term = found.select("id", "mark", F.explode("terms").alias("s")).select("id", "mark", "s.start", "s.end", F.lower("s.value").alias("t"))
    term = term.join(by, "t", "left").select("id", "mark", "start", "end", F.coalesce("by", F.lit("")).alias("by"))
    cover = base.unionByName(term).groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "by"))).alias("__cover"))
    cover = cover.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__cover")
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        fresh = F.concat(kept, F.when(s["start"] >= a["at"], s["by"]).otherwise(F.lit("")))
        return F.struct(F.array_append(a["out"], fresh).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("__cover", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    joined = df.withColumn("__m", mark).join(cover, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    return joined.withColumn(text_col, F.when(F.col("__cover").isNull(), text).otherwise(clean)).drop("__m", "__id", "__mark", "__cover")
