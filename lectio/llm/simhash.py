"""SimHash fingerprints of word shingles with groups by a Gray-order hierarchical index, and near copies by an exact shingle-set join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowio import per_batch, slabs, utf8
from .graph import components
from .grayindex import gray_rank, link
from .linesets import GROUPED, NAMED, POSTING, SIMILAR, HashSets, Lists, pack, postings, unpacked
from .sketch import may_hold, members
from .tokens import Words, run_hashes, slices

#: Rows of one key group that a single task compares; larger groups are dealt out as pairs of blocks.
BLOCK = 8192


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words of the text, A-Z lower-cased, repeats included.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return np.fromiter((xxhash.xxh64_intdigest(run, 42) for run in runs), np.uint64, n)


def bit_margins(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, lowest first: how many more hashes set it than leave it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total - len(hashes)


def pack_bits(margins: np.ndarray) -> np.ndarray:
    """uint64 words with a bit set where the margin is above zero."""
    return np.packbits(margins > 0, bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of each row's whole text, as a signed long. Null or wordless text: 0."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def make(batch):
        texts = batch.column(1)
        fp = np.fromiter((pack_bits(bit_margins(shingle_hashes(x.as_py(), shingle)))[0] for x in texts), np.uint64, len(texts))
        return {"id": batch.column(0), "fp": fp.view(np.int64)}

    rows = df.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(per_batch(make, schema), "id long, fp long")


def _links(rows: DataFrame, few_keys: bool, words: list[str], limit: int) -> DataFrame:
    """Edges ``(u, v)`` that span the links among rows of each ``key``; ``node`` names a row.

    The rows of a key of over ``BLOCK`` rows are split by hash into blocks, and each pair of blocks is a task group
    of its own. With ``few_keys`` there are at most 2^20 keys, and the table of the large ones is broadcast.
    """
    large = rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    dealt = rows.join(F.broadcast(large) if few_keys else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", *words)

    def run(batches):
        for table in slabs(batches, ["key", "a", "b"]):
            key, a, b = (table.column(k).to_numpy() for k in ("key", "a", "b"))
            new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            group = np.cumsum(new) - 1
            held = np.bincount(group)[group] > 1
            if not held.any():
                continue
            group, node = group[held], table.column("node").to_numpy()[held]
            prints = np.stack([table.column(w).to_numpy()[held].view(np.uint64) for w in words], axis=1)
            order = np.lexsort((gray_rank(prints[:, 0]), group))
            group, node, prints = group[order], node[order], prints[order]
            root = link(group, prints, limit)
            moved = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])

    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


def _scheme(rows: int, limit: int) -> int:
    """Into how many blocks a fingerprint is cut: the fewest whose patterns would have ``BLOCK / 8`` rows or less each.

    Two fingerprints within ``limit`` bits agree on all but ``limit`` blocks, whatever their number, so every
    choice finds the same pairs; more blocks make more keys of longer patterns.
    """
    blocks = limit + 1
    while blocks < 2 * limit + 2 and rows >> (64 * (blocks - limit) // blocks) > BLOCK // 8:
        blocks += 1
    return blocks


def fingerprint_links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """Edges ``(u, v)`` that span the links of the distinct fingerprints ``fp``: those within ``limit`` differing bits.

    Exact for any data: each fingerprint is sent under the patterns of all but ``limit`` of its blocks (the masked
    patterns of the index's top nodes), and a Gray-order index searches within each.
    """
    blocks = _scheme(distinct.count(), limit)
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    patterns, ways = [], list(combinations(range(blocks), blocks - limit))
    for k, way in enumerate(ways):
        value, at = F.lit(k).cast("long"), 6
        for b in way:
            width = bounds[b + 1] - bounds[b]
            part = F.shiftrightunsigned("fp", bounds[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            value, at = value.bitwiseOR(F.shiftleft(part, at)), at + width
        patterns.append(value)
    keyed = distinct.select(F.explode(F.array(*patterns)).alias("key"), F.col("fp").alias("node"), "fp")
    return _links(keyed, len(ways) << max(bounds[k + 1] - bounds[k] for k in range(blocks)) * (blocks - limit) <= 1 << 20, ["fp"], limit)


def near_duplicates(prints: DataFrame, limit: int = 3) -> DataFrame:
    """``(id, fp, component)`` for rows ``(id, fp)``: fingerprints within ``limit`` differing bits are linked.

    ``component`` is the smallest id reachable, itself included. Null ids take part but are never the smallest
    unless a component has no other (then null). Equal fingerprints count once; repeated rows stay repeated.
    """
    distinct = scratch.cut(prints.groupBy("fp").agg(F.min("id").alias("low")), "prints")
    found = components(fingerprint_links(distinct, limit))
    member = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = member.groupBy("root").agg(F.min("low").alias("component"))
    named = member.join(low, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


#: Hash buckets of the rarity counts, in bits: 512 KB to every task, whatever the data.
RARITY_BITS = 16
#: Postings of a unit, about; candidates of a list that a set names in the first round after the likeliest ones.
UNIT, NEXT = 1 << 13, 256


class ShingleSets(HashSets):
    """The sets of word runs of some texts, A-Z lower-cased; a text of fewer words has one run, all its words."""

    def __init__(self, words: Words, shingle: int):
        size = np.diff(words.bounds)
        owner = np.repeat(np.arange(len(size)), size)
        runs = run_hashes(words.hash, shingle)
        at = np.flatnonzero(np.arange(len(runs)) + shingle <= words.bounds[1:][owner[: len(runs)]])
        few = np.flatnonzero((size > 0) & (size < shingle))
        short = [run_hashes(words.hash[words.bounds[k] : words.bounds[k + 1]], int(size[k])) for k in few.tolist()]
        text, h = np.r_[owner[at], few], np.concatenate([runs[at], *short])
        order = np.argsort(text, kind="stable")
        self.texts = len(size)
        super().__init__(text[order], h[order])

    def fingerprints(self) -> np.ndarray:
        """The 64-bit SimHash of each set that has a run."""
        out = np.zeros(len(self.start), np.uint64)
        stop = np.r_[self.start[1:], len(self.hash)]
        for k, (a, z) in enumerate(zip(self.start.tolist(), stop.tolist())):
            out[k] = pack_bits(bit_margins(self.hash[a:z]))[0]
        return out


def _shingle_rarity(rows: DataFrame, shingle: int) -> np.ndarray:
    """The rank of each hash bucket of shingles, from the rarest."""

    def run(batches):
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, words in slices(batch.column(0), fold=True):
                own = ShingleSets(words, shingle).hash
                counts += np.bincount((own >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    table = rows.select(utf8("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return np.argsort(np.argsort(out, kind="stable"), kind="stable")


#: Parity bits of a whole set, held against a pair before its sets are read.
WIDE = 2048
_SET = "id long, mark long, node long, fp long, n int, bits long, bits2 long, prefix array<long>, wide array<long>"


def _sets(rows: DataFrame, shingle: int, rarity) -> DataFrame:
    """``(id, mark, node, fp, n, bits, bits2, prefix, wide)`` of rows ``(id, mark, text)``: the set's name, SimHash, size, parities, rarest shingles, more parities.

    A text without words has the name 0 and an empty prefix.
    """

    def run(batches):
        for batch in batches:
            for a, z, words in slices(batch.column(2), fold=True):
                s = ShingleSets(words, shingle)
                bits, bits2 = s.parities()
                held, bounds = s.prefixes(rarity.value, RARITY_BITS)
                n, node, fp, some = np.zeros(z - a, np.int32), np.zeros(z - a, np.int64), np.zeros(z - a, np.int64), s.owner
                n[some], node[some], fp[some] = s.n, s.k1.view(np.int64), s.fingerprints().view(np.int64)
                both = [np.zeros(z - a, np.int64) for _ in range(2)]
                both[0][some], both[1][some] = bits.view(np.int64), bits2.view(np.int64)
                size = np.zeros(z - a, np.int64)
                size[some] = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(held.view(np.int64)))
                more = np.zeros((z - a, WIDE // 64), np.uint64)
                more[some] = s.wide_parities(WIDE)
                wide = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * (WIDE // 64)), pa.array(more.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), *map(pa.array, (node, fp, n, *both)), lists, wide], names=[c.split()[0] for c in _SET.split(", ")])

    return rows.select("id", "mark", utf8("text")).mapInArrow(run, _SET)


_NAMES = "y long, x long, key long, more boolean"


def _candidates(sets: DataFrame, units: int, asking=None, keys=None, take: int = 0) -> DataFrame:
    """``(y, x, key, more)``: sets of one list that the filters let pass: each y's likeliest, or of those ``asking`` the first ``take`` of other groups.

    ``more`` is true where the list of ``key`` may hold others for y. With ``asking``, only the lists of ``keys``
    are posted, and each set with its ``root``.
    """
    kind = POSTING if asking is None else GROUPED

    def packed(batches):
        flagged = None if keys is None else lambda k: may_hold(keys.value, k)
        yield from pack((postings(batch, None, flagged, kind) for batch in batches), units)

    def run(batches):
        for unit, rows in unpacked(batches, kind):
            lists = Lists(rows, unit)
            if asking is None:
                y, x, more = lists.best(NAMED)
            else:
                y, x, more = lists.ranked(np.flatnonzero(may_hold(asking.value, lists.id.view(np.uint64))), 0, take)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (lists.id[y], lists.id[x], lists.key[y].astype(np.int64), more)], names=["y", "x", "key", "more"])

    root = [] if asking is None else ["root"]
    rows = sets.where("n > 0").select(F.col("node").alias("id"), F.lit(0).alias("number"), "n", "bits", "bits2", "prefix", *root)
    dealt = rows.mapInArrow(packed, "unit long, rows binary").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, _NAMES)


def _verified(rows: DataFrame, shingle: int, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Edges ``(u, v)``: the pairs ``(y, x)`` whose whole shingle sets have a Jaccard similarity of ``SIMILAR`` or more.

    Pairs whose parities differ by more than such sets may are left out first. Of the rest only the texts of named
    sets are parsed again; ``known(node, mark, n, wide)`` finds them.
    """
    num, den = SIMILAR
    spark = rows.sparkSession
    each = known.join(pairs.select(F.explode(F.array("y", "x")).alias("node")).distinct(), "node", "left_semi")
    each = scratch.cut(each.groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("wide")), "parities")
    of = lambda c: each.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    apart = F.aggregate(F.zip_with("wy", "wx", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)
    sizes = F.col("ny") + F.col("nx")
    most = sizes - 2 * F.expr(f"({num} * (ny + nx) + {num + den - 1}) div {num + den}")
    pairs = scratch.cut(pairs.join(of("x"), "x").join(of("y"), "y").where(apart <= most).select("y", "x"), "close")
    named = scratch.cut(pairs.select(F.explode(F.array("y", "x")).alias("node")).distinct(), "asked")
    marks = known.join(named, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    sketch = spark.sparkContext.broadcast(members(marks.select("mark")))

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(may_hold(sketch.value, batch.column(0).to_numpy().view(np.uint64))))
            for _, _, words in slices(some.column(1), fold=True):
                s = ShingleSets(words, shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(s.n)].astype(np.int32)), pa.array(s.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.k1.view(np.int64)), lists], names=["node", "words"])

    sets = rows.select("mark", utf8("text")).mapInArrow(run, "node long, words array<long>")
    sets = scratch.cut(sets.join(named, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "sets")
    y = sets.select(F.col("node").alias("y"), F.col("words").alias("wy"))
    x = sets.select(F.col("node").alias("x"), F.col("words").alias("wx"))
    both = F.size(F.array_intersect("wy", "wx")).cast("long")
    hit = pairs.join(x, "x").join(y, "y").where((num + den) * both >= num * (F.size("wy") + F.size("wx")))
    return hit.select(F.col("y").alias("u"), F.col("x").alias("v"))


def near_copies(rows: DataFrame, shingle: int, limit: int = 3) -> DataFrame:
    """``(id, mark, root)`` of rows ``(id, mark, text)``, mark a hash of the text: equal roots for a group of near copies.

    Texts whose sets of ``shingle``-word runs have a Jaccard similarity of ``SIMILAR`` or more are linked, and
    links are merged to groups; sets and shingles are told apart by 64-bit hashes.

    1. Fingerprints of the sets within ``limit`` bits of each other, found by the Gray-order index, name candidates.
    2. A SimHash misses pairs near the threshold, so a prefix join with length, positional and parity filters names
       the rest: of each list first a set's likeliest partner, then in rounds all others that are not yet of its group.
    Every candidate is verified on the whole sets before it links.
    """
    spark = rows.sparkSession
    rarity = spark.sparkContext.broadcast(_shingle_rarity(rows, shingle))
    own = scratch.cut(_sets(rows, shingle, rarity), "shingles")
    known = own.select("node", "mark", "n", "wide")
    # sets of several texts are folded; the others, most of them, are read where they are
    several = scratch.cut(own.groupBy("node").count().where("count > 1").select("node"), "several")
    wide = ["node", "fp", "n", "bits", "bits2", "prefix"]
    folded = own.join(several, "node", "left_semi").select(*wide).groupBy("node").agg(*[F.first(c).alias(c) for c in wide[1:]])
    sets = own.join(several, "node", "left_anti").select(*wide).unionByName(scratch.cut(folded, "folded"))
    num, den = SIMILAR
    total = sets.agg(F.coalesce(F.sum(F.col("n") - F.expr(f"({num} * cast(n as long) + {den - 1}) div {den}") + 1), F.lit(0))).first()[0]
    units = max(1, -(-total // UNIT))
    prints = scratch.cut(sets.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = fingerprint_links(prints.select("fp"), limit)
    by = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}n"))
    alike = near.join(by("u"), "u").join(by("v"), "v").select(F.col("un").alias("y"), F.col("vn").alias("x"))
    equal = sets.where("n > 0").select("fp", F.col("node").alias("y")).join(prints.select("fp", F.col("node").alias("x")), "fp").where("y <> x").select("y", "x")
    named = scratch.cut(_candidates(sets, units), "named")
    pairs = scratch.cut(alike.unionByName(equal).unionByName(named.select("y", "x")).distinct(), "pairs")
    roots = scratch.cut(components(scratch.cut(_verified(rows, shingle, pairs, known), "links")), "roots")
    take = NEXT
    while True:
        open_ = scratch.cut(named.where("more").select("y", "key").distinct(), "open")
        if open_.isEmpty():
            return own.select("id", "mark", "node").join(roots, "node", "left").select("id", "mark", F.coalesce("root", "node").alias("root"))
        asking = spark.sparkContext.broadcast(members(open_.select("y")))
        keys = spark.sparkContext.broadcast(members(open_.select("key")))
        grouped = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = scratch.cut(_candidates(grouped, units, asking, keys, take), "named")
        rest = scratch.cut(named.select("y", "x").distinct().join(pairs, ["y", "x"], "left_anti"), "rest")
        if not rest.isEmpty():
            pairs = pairs.unionByName(rest)
            edges = _verified(rows, shingle, rest, known)
            roots = scratch.cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges)), "roots")
        take *= 16


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``df`` less all but one row of each group of near copies: the one of smallest id, then smallest text hash.

    Groups come from ``near_copies``; rows that agree in id and text are one document. A null id comes first; texts
    without a word, null ones too, are one group. Texts are shuffled once, to meet the ids that stay. Other columns
    may have any names but ``__``-led ones.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    stays = near_copies(rows, shingle).groupBy("root").agg(F.min(F.struct("id", "mark")).alias("s")).select("s.*")
    stays = stays.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
    joined = df.withColumn("__m", mark).join(stays, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left_semi")
    return joined.dropDuplicates([id_col, "__m"]).drop("__m")
