"""Line de-duplication by an exact set-similarity join (prefix, positional and length filters, as in PPJoin).

A line is the set of its words. It is removed if an earlier line of the corpus has a Jaccard similarity of
``SIMILAR`` or more with it; earlier is by id, then line number, then a hash of the text.

1. Lines of equal sets form a class, known by 128 bits of hash and by its first line. All its later lines go.
2. Words are ordered by rarity, from counts over all texts in a fixed number of hash buckets; any order is
   exact, a rarer first word only makes shorter lists. Each class is posted under the words of its prefix: two
   sets as similar as asked share a word there. Words with very many postings are replaced by pairs of words.
3. Within a list the length and positional filters apply, and a bound from 128 parity bits of the sets. Each
   class names the likeliest earlier matches of each of its lists; those are verified on the whole sets, words as
   64-bit hashes. Classes whose named matches all fail come back in rounds, each with the next candidates of
   their lists, until a match is verified or the lists end.

Texts are read again for the sets to verify and for the lines to remove, so that no table of all lines is kept.
Postings travel packed: one row holds many of one unit, a range of key hashes whose number grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowio import utf8
from .linesets import LEAST, NAMED, SIMILAR, LineSets, Lists, pack, postings, unpacked
from .sketch import may_hold, member_table, members, only_members
from .tokens import slices

#: Bits of the hash buckets of the rarity counts: 512 KB to every task, whatever the data.
RARITY_BITS = 16
#: Postings of a word from which on the word's list is split by a second word.
HOT = 4096
#: Postings of a unit, about; units are packed and sent whole, so this bounds what a packed row holds.
UNIT = 1 << 13
#: Candidates of a list that a class names in the first round after the named one; each round takes sixteen times as many.
NEXT = 256
#: An odd factor that spreads line numbers over the bits of a sketch; a line number times it stays below 2^63.
STRIDE = 2_654_435_761


def _rarity(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts of each hash bucket of words, and its rank from the rarest."""

    def run(batches):
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, words in slices(batch.column(0)):
                counts += np.bincount((words.hash >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    table = df.select(utf8("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out, np.argsort(np.argsort(out, kind="stable"), kind="stable")


_CLASS = "k1 long, k2 long, id long, mark long, number int, lines long, n int, bits long, bits2 long, warm boolean, prefix array<long>"


def _classes(df: DataFrame, rarity) -> DataFrame:
    """A row per class of equal lines: key, place of its first line, number of lines, set size, parities, whether a prefix word may be hot, prefix and one word more.

    Each batch of texts folds its own equal lines first, so a very common line is one row of each batch.
    """

    def heads(batches):
        counts, rank = rarity.value
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, marks = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, words in slices(batch.column(2)):
                s = LineSets(words)
                if not len(s.n):
                    continue
                at = a + s.owner
                order = np.lexsort((marks[at], s.number, ids[at], known[at], s.k2, s.k1))
                new = np.flatnonzero(np.r_[True, (s.k1[order][1:] != s.k1[order][:-1]) | (s.k2[order][1:] != s.k2[order][:-1])])
                # lines of one place in the corpus (repeated rows) are one line
                place = np.stack([s.k1[order].view(np.int64), s.k2[order].view(np.int64), known[at][order], ids[at][order], s.number[order], marks[at][order]])
                fresh = np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]
                lines = np.add.reduceat(fresh.astype(np.int64), new)
                head = order[new]
                bits, bits2 = s.parities()
                words_, bounds = s.prefixes(rank, RARITY_BITS)
                often = np.r_[0, np.cumsum(counts[(words_ >> np.uint64(64 - RARITY_BITS)).astype(np.int64)] > HOT)]
                warm = often[bounds[1:]] > often[bounds[:-1]]
                size = (bounds[1:] - bounds[:-1])[head]
                pick = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[:-1][head], size)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(words_[pick].view(np.int64)))
                own = at[head]
                columns = [s.k1[head].view(np.int64), s.k2[head].view(np.int64), pa.array(ids[own], mask=~known[own]), marks[own], s.number[head].astype(np.int32), lines, s.n[head].astype(np.int32), bits[head].view(np.int64), bits2[head].view(np.int64), warm[head], lists]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in _CLASS.split(", ")])

    rows = df.select("id", "mark", utf8("text")).mapInArrow(heads, _CLASS)
    first = F.struct("id", "number", "mark")
    same = [F.first(c).alias(c) for c in ("n", "bits", "bits2", "warm", "prefix")]
    # folded by batch already, so nothing is gained by a sort and a second fold before the shuffle
    out = rows.repartition("k1", "k2").groupBy("k1", "k2").agg(F.min(first).alias("first"), F.sum("lines").alias("lines"), *same)
    return out.select("k1", "k2", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"), F.col("first.number").alias("number"), "lines", "n", "bits", "bits2", "warm", "prefix")


def _hot(classes: DataFrame, counts: np.ndarray):
    """A sketch of the prefix words with over ``HOT`` postings, or None. Only buckets with so many words in all can hold one."""
    spark = classes.sparkSession
    if not (counts > HOT).any():
        return None
    held = spark.sparkContext.broadcast(counts > HOT)

    def run(batches):
        for batch in batches:
            word = batch.column(0).flatten().to_numpy().view(np.uint64)
            word = word[held.value[(word >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]]
            w, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    words = classes.where("warm").select("prefix").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    sketch = members(words.select("w"))
    return spark.sparkContext.broadcast(sketch) if sketch.any() else None


def _placed(id_: Column, number: Column) -> Column:
    """What a sketch knows of a line's place; ``_place_hash`` computes the same."""
    return F.coalesce(id_, F.lit(0).cast("long")).bitwiseXOR(number.cast("long") * F.lit(STRIDE))


def _place_hash(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (ids ^ number.astype(np.int64) * STRIDE).view(np.uint64)


_POSTED = ["id", "number", "n", "bits", "bits2", "prefix"]
_PAIRS = "y long, yn int, x long, xn int, key long, more boolean"


def _packed(classes: DataFrame, units: int, hot, flagged=None) -> DataFrame:
    """``(unit, rows)``: the postings of all classes, packed by unit. A null id is written as 0 with the number -1 - number."""

    def run(batches):
        is_hot = None if hot is None else lambda w: may_hold(hot.value, w)
        is_flagged = None if flagged is None else lambda k: may_hold(flagged.value, k)
        yield from pack((postings(batch, is_hot, is_flagged) for batch in batches), units)

    number = F.when(F.col("id").isNull(), -1 - F.col("number")).otherwise(F.col("number")).alias("number")
    rows = classes.where(F.col("n") >= LEAST).select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), number, *_POSTED[2:])
    return rows.mapInArrow(run, "unit long, rows binary").repartition("unit").sortWithinPartitions("unit")


def _candidates(packed: DataFrame, asking=None, skip: int = 0, take: int = 0) -> DataFrame:
    """``(y, yn, x, xn, key, more)``: places of pairs that may match, x not after y: each y's best of a list, or the ranked next ones of those ``asking``.

    ``more`` is true where y may have candidates in the list of ``key`` that this round has not named.
    """

    def one(unit: np.ndarray, rows: np.ndarray):
        lists = Lists(rows, unit)
        if asking is None:
            y, x, more = lists.best(NAMED)
        else:
            plain = np.where(lists.number >= 0, lists.number, -1 - lists.number)
            y, x, more = lists.ranked(np.flatnonzero(may_hold(asking.value, _place_hash(lists.id, plain))), skip, take)
        columns = [lists.id[y], lists.number[y], lists.id[x], lists.number[x], lists.key[y].astype(np.int64), more]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _PAIRS.split(", ")])

    def run(batches):
        for unit, rows in unpacked(batches):
            yield one(unit, rows)

    return packed.mapInArrow(run, _PAIRS)


def _sets(df: DataFrame, sketch, owners) -> DataFrame:
    """``(id, number, mark, k1, k2, words)`` of the lines whose place the sketch may hold, numbers as in postings; only texts whose id ``owners`` may hold are parsed."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(owners.value, batch.column(0).fill_null(0).to_numpy().view(np.uint64))))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, marks = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for a, z, words in slices(batch.column(2)):
                own = ids[a:z]
                s = LineSets(words, lambda owner, number: may_hold(sketch.value, _place_hash(own[owner], number)))  # noqa: B023
                if not len(s.n):
                    continue
                at = a + s.owner
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(s.n)].astype(np.int32)), pa.array(s.hash.view(np.int64)))
                number = np.where(known[at], s.number, -1 - s.number).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(number), pa.array(marks[at]), pa.array(s.k1.view(np.int64)), pa.array(s.k2.view(np.int64)), lists], names=["id", "number", "mark", "k1", "k2", "words"])

    return df.select("id", "mark", utf8("text")).mapInArrow(run, "id long, number int, mark long, k1 long, k2 long, words array<long>")


def _verified(df: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """``(k1, k2, id, number, mark)`` of lines y with a pair (y, x) whose words are similar and whose x comes first; numbers as in postings."""
    num, den = SIMILAR
    spark = df.sparkSession
    plain = lambda n: F.when(F.col(n) < 0, -1 - F.col(n)).otherwise(F.col(n))
    places = pairs.select(F.explode(F.array(_placed(F.col("y"), plain("yn")), _placed(F.col("x"), plain("xn")))).alias("place"))
    sketch = spark.sparkContext.broadcast(members(places))
    ids = pairs.select(F.explode(F.array("y", "x")).alias("id"))
    owners = spark.sparkContext.broadcast(members(ids))
    # the first round asks for most texts, later ones for few, which then are picked before they reach Python
    some = only_members(df, member_table(ids), F.coalesce(F.col("id"), F.lit(0).cast("long"))) if few else df
    sets = scratch.cut(_sets(some, sketch, owners), "sets", hashes=True)
    x = sets.select(F.col("id").alias("x"), F.col("number").alias("xn"), F.col("mark").alias("xm"), F.col("words").alias("wx"))
    y = sets.select(F.col("id").alias("y"), F.col("number").alias("yn"), F.col("mark").alias("ym"), "k1", "k2", F.col("words").alias("wy"))
    place = lambda i, n, m: F.struct(F.col(n) >= 0, F.col(i), plain(n), F.col(m))
    both = F.size(F.array_intersect("wy", "wx"))
    met = pairs.join(x, ["x", "xn"]).join(y, ["y", "yn"])
    hit = met.where((place("x", "xn", "xm") < place("y", "yn", "ym")) & (den * both >= num * (F.size("wy") + F.size("wx") - both)))
    return hit.select("k1", "k2", F.col("y").alias("id"), F.col("yn").alias("number"), F.col("ym").alias("mark")).distinct()


def _late(df: DataFrame, classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """Verified lines of ``_verified``, over all rounds; some may not be the first of their class."""
    spark = df.sparkSession
    pair = ["y", "yn", "x", "xn"]
    num, den = SIMILAR
    prefix = F.col("n") - F.expr(f"({num} * cast(n as long) + {den - 1}) div {den}") + 1
    total = classes.where(F.col("n") >= LEAST).agg(F.coalesce(F.sum(prefix), F.lit(0))).first()[0]
    units = max(1, -(-total // UNIT))
    hot = _hot(classes, counts)
    last = scratch.cut(_candidates(_packed(classes, units, hot)), "named")
    found = fresh = scratch.cut(_verified(df, scratch.cut(last.select(*pair).distinct(), "pairs")), "found")
    skip, take = 0, NEXT
    while True:
        # a class goes on if none of its pairs held and one of its lists has more; only those lists are read again
        done = fresh.select(F.col("id").alias("y"), F.col("number").alias("yn"))
        open_ = scratch.cut(last.where("more").select("y", "yn", "key").distinct().join(done, ["y", "yn"], "left_anti"), "open")
        if open_.isEmpty():
            return found
        place = _placed(F.col("y"), F.when(F.col("yn") < 0, -1 - F.col("yn")).otherwise(F.col("yn")))
        asking = spark.sparkContext.broadcast(members(open_.select(place.alias("place"))))
        keys = spark.sparkContext.broadcast(members(open_.select("key")))
        more = _candidates(_packed(classes, units, hot, keys), asking, skip, take)
        last = scratch.cut(more.join(open_.select("y", "yn").distinct(), ["y", "yn"], "left_semi"), "more")
        fresh = scratch.cut(_verified(df, scratch.cut(last.select(*pair).distinct(), "pairs"), few=True), "found")
        found = found.unionByName(fresh)
        skip, take = skip + take, take * 16


def _judged(df: DataFrame, judged) -> DataFrame:
    """``(id, mark, number, k1, k2)`` of the lines whose class ``judged`` may hold, and one row of each text with a null number and its ``n_lines``."""

    def run(batches):
        names = ["id", "mark", "number", "k1", "k2", "n_lines"]
        for batch in batches:
            for a, z, words in slices(batch.column(2)):
                s = LineSets(words)
                ok = may_hold(judged.value, s.k1)
                own, count = np.arange(a, z), np.bincount(s.owner, minlength=z - a)
                at = pa.array(np.r_[own, a + s.owner[ok]])
                none = lambda some, t: pa.concat_arrays([pa.nulls(len(own), t), pa.array(some, t)])  # noqa: E731, B023
                k1, k2 = s.k1[ok].view(np.int64), s.k2[ok].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), none(s.number[ok].astype(np.int32), pa.int32()), none(k1, pa.int64()), none(k2, pa.int64()), pa.concat_arrays([pa.array(count), pa.nulls(int(ok.sum()), pa.int64())])], names=names)

    return df.select("id", "mark", utf8("text")).mapInArrow(run, "id long, mark long, number int, k1 long, k2 long, n_lines long")


def removed_lines(df: DataFrame) -> DataFrame:
    """``(id, mark, rows, n_lines, removed)`` for rows ``(id, mark, text)``, mark a hash of the text: the sorted numbers, from 0, of lines that go.

    Lines without a word are not counted and stay. Rows that agree in id and mark are one document and get
    one row with their number. Null ids come before all others; null text is empty; an empty table gives no rows. Of equal and near lines the earliest stays; near is by each pair, so a line whose
    only matches are later ones stays too.
    """
    spark = df.sparkSession
    counts, rank = _rarity(df)
    rarity = spark.sparkContext.broadcast((counts, rank))
    classes = scratch.cut(_classes(df, rarity), "classes", hashes=True)
    found = _late(df, classes, counts)
    number = F.when(F.col("number") < 0, -1 - F.col("number")).otherwise(F.col("number"))
    place = F.struct(F.when(F.col("number") >= 0, F.col("id")).alias("id"), number.alias("number"), "mark")
    late = scratch.cut(found.groupBy("k1", "k2").agg(F.collect_set(place).alias("places")), "late")
    first = F.struct("id", "number", "mark")
    judged = classes.join(late, ["k1", "k2"], "left").withColumn("late", F.coalesce(F.array_contains("places", first), F.lit(False)))
    judged = scratch.cut(judged.where((F.col("lines") > 1) | F.col("late")).select("k1", "k2", first.alias("first"), "late"), "judged")
    lines = _judged(df, spark.sparkContext.broadcast(members(judged.select("k1"))))
    lines = scratch.cut(lines, "judging")
    scratch.release(spark, classes, late)
    gone = lines.where(F.col("number").isNotNull()).join(judged, ["k1", "k2"])
    gone = gone.where(F.col("late") | (F.struct("id", "number", "mark") != F.col("first"))).select("id", "mark", "number", F.lit(None).cast("long").alias("n_lines"))
    every = lines.where(F.col("n_lines").isNotNull()).select("id", "mark", F.lit(None).cast("int").alias("number"), "n_lines").unionByName(gone)
    return every.groupBy("id", "mark").agg(F.count("n_lines").alias("rows"), F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("number")).alias("removed"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text less the removed lines, and ``n_removed``; null text stays null.

    Rows that agree in id and text lose the same lines. Other columns may have any names, but for ``n_removed``,
    which is set anew.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    found = removed_lines(rows).where(F.size("removed") > 0).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__gone"))
    joined = df.drop("n_removed").withColumn("__m", mark).join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    joined = joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept))
    return joined.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0))).drop("__m", "__id", "__mark", "__gone")
