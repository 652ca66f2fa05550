"""Removal of passages that recur anywhere in a corpus: confirmed by counts, located by Aho-Corasick automata.

1. Every window of words has an anchor, its run of ``GRAM`` words of least hash; equal windows have equal anchors
   in the same place. Consecutive windows of one anchor are a region. Regions whose anchor occurs once in the
   corpus cannot recur; equal regions are folded to one row with their number.
2. A region that occurs twice or more recurs with all its windows. The windows of other regions that share an
   anchor with a different region are counted one by one, by 128 bits of hash. What is confirmed becomes a
   passage: the words of one occurrence of the region and the windows in it that recur.
3. Documents with a region of a repeated anchor are dealt into blocks. Each block's shard of passages, those of
   its documents' regions, is compiled into an automaton over the passages' anchors, and the block's documents
   are streamed through it. At each hit the text is compared word by word with the passage, and the confirmed
   windows that it holds are marked. No place found in steps 1 and 2 reaches this step: what is removed is what
   the automata locate. Documents without such a region hold no passage and stay whole.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .arrowio import utf8
from .sketch import may_hold, members
from .tokens import Words, buffer_of, mixed, powers, slices

#: Words of an anchor.
GRAM = 12
#: Regions of the documents that share an automaton, about; a document is never split.
SHARD = 60_000
#: Hits that are compared with their passages at once.
HITS = 1 << 15
#: An odd factor that spreads word numbers over the bits of a sketch; a word number times it stays below 2^63.
STRIDE = 2_654_435_761
_U = np.uint64


class Runs:
    """Hashes of runs of consecutive words, from prefix sums of a polynomial in the words' hashes."""

    def __init__(self, own: np.ndarray):
        up, self.down = powers(len(own) + 1)
        self.sums = np.zeros(len(own) + 1, _U)
        np.cumsum(own * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mixed(raw + (stop - start).astype(_U) * _U(0x165667B19E3779F9))


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` numbers the place of its least one, the first of those."""
    best, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        later = right < left
        best, at, have = np.where(later, right, left), np.where(later, at[step:], at[:-step]), have + step
    return at


class Regions:
    """The regions of some texts: owner text, first word (in the slice), number of windows, place of the anchor."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        self.runs = Runs(words.hash)
        n = len(words.hash)
        size = np.diff(words.bounds)
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(n)
        at = at[at + window <= words.bounds[1:][owner]]
        if not len(at):
            self.start = self.count = self.place = self.owner = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, _U)
            return
        gram = np.arange(n - GRAM + 1)
        grams = self.runs.of(gram, gram + GRAM)
        place = least_places(grams, window - GRAM + 1)[at]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.start, self.count, self.place = at[new], np.diff(np.r_[new, len(at)]), place[new]
        self.owner, self.anchor = owner[self.start], grams[self.place]

    def keys(self, which: np.ndarray) -> np.ndarray:
        """The hash of all words of each region."""
        return self.runs.of(self.start[which], self.start[which] + self.count[which] + self.window - 1)

    def within(self, which: np.ndarray) -> np.ndarray:
        """The number of each region's first word in its own text."""
        return self.start[which] - self.words.bounds[self.owner[which]]


def _anchor_counts(df: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [Regions(words, window).anchor for _, _, words in slices(batch.column(0))]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return df.select(utf8("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _regions(df: DataFrame, window: int, sketch) -> DataFrame:
    """``(id, mark, anchor, region, start)`` of the regions whose anchor the sketch may hold."""
    names = ["id", "mark", "anchor", "region", "start"]

    def run(batches):
        for batch in batches:
            for a, _, words in slices(batch.column(2)):
                r = Regions(words, window)
                ok = np.flatnonzero(may_hold(sketch.value, r.anchor))
                if len(ok):
                    own = pa.array(a + r.owner[ok])
                    columns = [r.anchor[ok].view(np.int64), r.keys(ok).view(np.int64), r.within(ok)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, columns)], names=names)

    return df.select("id", "mark", utf8("text")).mapInArrow(run, "id long, mark long, anchor long, region long, start long")


def _placed(mark: Column, start: Column) -> Column:
    """What a sketch knows of a region's place; ``_pieces`` computes the same."""
    return mark.bitwiseXOR(start * F.lit(STRIDE))


def _pieces(df: DataFrame, window: int, sketch) -> DataFrame:
    """``(mark, start, anchor, region, place, windows, words)`` of the regions whose place the sketch may hold: the anchor's place, the windows' hashes, the text."""
    names = ["mark", "start", "anchor", "region", "place", "windows", "words"]

    def run(batches):
        for batch in batches:
            marks = batch.column(0).to_numpy()
            for a, _, words in slices(batch.column(1)):
                r = Regions(words, window)
                every = np.arange(len(r.start))
                ok = every[may_hold(sketch.value, (marks[a + r.owner] ^ r.within(every) * STRIDE).view(np.uint64))]
                if not len(ok):
                    continue
                first, count = r.start[ok], r.count[ok]
                at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(r.runs.of(at, at + window).view(np.int64)))
                low, high = words.start[first].tolist(), words.stop[first + count + window - 2].tolist()
                raw = words.data.tobytes()
                text = pa.array([b" ".join(raw[x:z].split()) for x, z in zip(low, high)], pa.binary())
                columns = [marks[a + r.owner[ok]], r.within(ok), r.anchor[ok].view(np.int64), r.keys(ok).view(np.int64), (r.place[ok] - first).astype(np.int32), lists, text]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return df.select("mark", utf8("text")).mapInArrow(run, "mark long, start long, anchor long, region long, place int, windows array<long>, words binary")


def confirmed(df: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """``(anchor, region, place, at, words)``: the distinct regions with windows that recur, those windows' numbers (null: all), and their words."""
    spark = df.sparkSession
    folded = regions.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("mark", "start")).alias("first"))
    folded = scratch.cut(folded.select("anchor", "region", "n", "first.*"), "folded")
    several = folded.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("several"))
    worth = scratch.cut(folded.join(several, "anchor", "left").where("n > 1 or several").withColumn("several", F.coalesce("several", F.lit(False))), "worth")
    sketch = spark.sparkContext.broadcast(members(worth.select(_placed(F.col("mark"), F.col("start")).alias("h"))))
    found = _pieces(df, window, sketch).join(worth, ["anchor", "region", "mark", "start"]).dropDuplicates(["anchor", "region"])
    found = scratch.cut(found.select("anchor", "region", "n", "several", "place", F.when(F.col("several"), F.col("windows")).alias("windows"), "words"), "pieces")
    each = found.where("several").select("anchor", "region", "n", F.posexplode("windows").alias("at", "w"))
    counted = each.groupBy("anchor", "w").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("anchor", "w")
    lone = each.where("n = 1").join(counted, ["anchor", "w"]).groupBy("anchor", "region").agg(F.sort_array(F.collect_list("at")).alias("at"))
    part = found.where("n = 1").join(lone, ["anchor", "region"]).select("anchor", "region", "place", "at", "words")
    whole = found.where("n > 1").select("anchor", "region", "place", F.lit(None).cast("array<int>").alias("at"), "words")
    return scratch.cut(part.unionByName(whole), "passages")


class Shard:
    """An automaton over the anchors of some passages, which locates the passages' windows in texts."""

    def __init__(self, texts: list[bytes], place: list[int], at: list, window: int):
        self.window, self.place = window, np.array(place)
        words = Words(*buffer_of(pa.array(texts, pa.binary())))
        self.known, own = np.unique(words.hash, return_inverse=True)
        # a word is two characters of two alphabets, so that no node has many children and all hits are aligned
        self.base = int((len(self.known) + 2) ** 0.5) + 1
        assert 2 * self.base + 2 < 0xD800, "a shard holds too many distinct words"
        self.long = np.diff(words.bounds)
        self.words = np.zeros((len(texts), int(self.long.max())), np.int32)
        row = np.repeat(np.arange(len(texts)), self.long)
        self.words[row, np.arange(len(row)) - words.bounds[:-1][row]] = own + 1
        self.windows = np.arange(self.words.shape[1]) < (self.long - window + 1)[:, None]
        for k, some in enumerate(at):
            if some is not None:
                self.windows[k] = False
                self.windows[k, some] = True
        anchors = self._written(self.words[np.arange(len(texts))[:, None], self.place[:, None] + np.arange(GRAM)].ravel())
        groups: dict[str, list[int]] = {}
        for k in range(len(texts)):
            groups.setdefault(anchors[2 * GRAM * k : 2 * GRAM * (k + 1)], []).append(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for g, anchor in enumerate(groups):
            self.automaton.add_word(anchor, g)
        self.automaton.make_automaton()
        self.passages = np.concatenate([np.array(x) for x in groups.values()])
        self.bounds = np.r_[0, np.cumsum([len(x) for x in groups.values()])]

    def _written(self, ids: np.ndarray) -> str:
        out = np.empty(2 * len(ids), "<u2")
        out[::2], out[1::2] = ids // self.base + 1, ids % self.base + self.base + 2
        return out.tobytes().decode("utf-16-le")

    def covered(self, words: Words) -> np.ndarray:
        """For each word of some texts whether a window of a passage covers it."""
        found = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        ids = np.where(self.known[found] == words.hash, found + 1, 0).astype(np.int32)
        # 0 stands for words of no passage and behind each text
        size = np.diff(words.bounds)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)
        stream = np.zeros(len(ids) + len(size) + 1, np.int32)
        stream[place] = ids
        edge = np.zeros(len(stream) + 1, np.int32)
        hits = np.array(list(self.automaton.iter(self._written(stream))), np.int64).reshape(-1, 2)
        many = np.diff(self.bounds)[hits[:, 1]]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // HITS, prepend=0))
        starts = [self._held(stream, hits[a:z], many[a:z]) for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(hits)])]
        at = np.unique(np.concatenate(starts))
        edge[at] += 1
        edge[at + self.window] -= 1
        return (np.cumsum(edge) > 0)[place]

    def _held(self, stream: np.ndarray, hits: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Compares each hit with the passages of its anchor, word by word: where confirmed windows start that the text holds."""
        own = np.repeat(np.arange(len(hits)), many)
        k = self.passages[self.bounds[hits[own, 1]] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)]
        first = hits[own, 0] // 2 - GRAM + 1 - self.place[k]
        at = first[:, None] + np.arange(self.words.shape[1])
        np.clip(at, 0, len(stream) - 1, out=at)
        same = (stream[at] == self.words[k]) & (self.words[k] > 0)
        last = self.words.shape[1] - self.window + 1
        total = np.zeros((len(k), self.words.shape[1] + 1), np.int16)
        np.cumsum(same, axis=1, dtype=np.int16, out=total[:, 1:])
        hit, start = np.nonzero((total[:, self.window :] - total[:, :last] == self.window) & self.windows[k, :last])
        return first[hit] + start


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``(id, kept, n_words, n_removed)``: each text without the words of windows that recur, kept words joined by a space.

    Windows are ``window`` consecutive words of one text and are judged on the input; one that starts anywhere
    else too, in the same text or a repeated row included, goes with all its words, at every occurrence.
    Null or short texts have no windows and stay whole; null ids count as ids; an empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    repeated = spark.sparkContext.broadcast(members(_anchor_counts(rows, window).where("n > 1").select("h")))
    regions = scratch.cut(_regions(rows, window, repeated), "regions")
    passages = confirmed(rows, regions, window)
    blocks = max(1, -(-regions.count() // SHARD))
    block = F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).alias("block")
    sharing = spark.sparkContext.broadcast(members(regions.select("mark")))
    routed = regions.select("anchor", "region", block).distinct().join(passages, ["anchor", "region"])
    shipped = routed.select("block", F.lit(None).cast("long").alias("id"), F.col("words").alias("payload"), "place", "at")
    names, out = ["id", "kept", "n_words", "n_removed"], "id long, kept binary, n_words long, n_removed long"

    def whole(batches):
        for batch in batches:
            some = batch.filter(pa.array(~may_hold(sharing.value, batch.column(1).to_numpy().view(np.uint64))))
            texts = [x.as_py().split() for x in some.column(2)]
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([b" ".join(t) for t in texts], pa.binary()), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64())], names=names)

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(sharing.value, batch.column(1).to_numpy().view(np.uint64))))

    def streamed(shard, ids, texts):
        texts = pa.array(texts, pa.binary())
        for a, z, words in slices(texts):
            size = np.diff(words.bounds)
            gone = shard.covered(words) if shard else np.zeros(len(words.hash), bool)
            cut = [gone[x:y] for x, y in zip(words.bounds[:-1], words.bounds[1:])]
            kept = [words.joined(~g, k) if g.any() else b" ".join(texts[a + k].as_py().split()) for k, g in enumerate(cut)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:z], pa.int64()), pa.array(kept, pa.binary()), pa.array(size), pa.array([int(g.sum()) for g in cut], pa.int64())], names=names)

    def locate(batches):
        now, held, shard, ids, texts = None, [], None, [], []
        for batch in batches:
            for b, kind, i, payload, place, at in zip(*(batch.column(k) for k in range(6))):
                if b.as_py() != now:
                    yield from streamed(shard, ids, texts)
                    now, held, shard, ids, texts = b.as_py(), [], None, [], []
                if not kind.as_py():
                    held.append((payload.as_py(), place.as_py(), at.values.to_numpy() if at.is_valid else None))
                    continue
                if held:
                    shard, held = Shard(*map(list, zip(*held)), window), []
                ids.append(i.as_py())
                texts.append(payload.as_py())
            yield from streamed(shard, ids, texts)
            ids, texts = [], []

    source = rows.select("id", "mark", utf8("text"))
    clean = source.mapInArrow(whole, out)
    texts = source.mapInArrow(chosen, "id long, mark long, text binary").select(block, "id", F.col("text").alias("payload"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<int>").alias("at"))
    both = shipped.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1))).select("block", "kind", "id", "payload", "place", "at")
    located = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(locate, out)
    return clean.unionByName(located).withColumn("kept", F.col("kept").cast("string"))
