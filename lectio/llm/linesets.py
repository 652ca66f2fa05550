"""Sets of word hashes, and the candidate search of a set-similarity join, as array operations within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tokens import Words, buffer_of, mixed

#: Least Jaccard similarity of a match, as a fraction.
SIMILAR = (4, 5)
#: Two different sets this similar have at least so many words each.
LEAST = 4
_U = np.uint64


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``n`` words with any match."""
    num, den = SIMILAR
    return -(-num * n // den)


class HashSets:
    """Sets of hashes: ``h`` with the number of the set's owner in order, repeats allowed."""

    def __init__(self, owner: np.ndarray, h: np.ndarray):
        new = np.r_[True, owner[1:] != owner[:-1]][: len(h)]
        line, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.owner = owner[first]
        h = _by_line(line, h, len(first))
        new = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])][: len(h)]
        #: Per member of a set: its hash and the set, by set, then hash.
        self.hash, self.line = h[new], line[new]
        self.start = np.flatnonzero(np.r_[True, self.line[1:] != self.line[:-1]][: len(self.line)])
        self.n = np.diff(np.r_[self.start, len(self.line)])
        if len(self.hash):
            x = self.hash * _U(0xD6E8FEB86659FD93)
            self.k1 = np.add.reduceat(x ^ (x >> _U(29)), self.start)
            x = (self.hash ^ (self.hash >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
            self.k2 = np.add.reduceat(x ^ (x >> _U(32)), self.start)
        else:
            self.k1 = self.k2 = np.zeros(0, _U)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each line: two sets differ in as many words at least as their parities differ in bits."""
        if not len(self.hash):
            return np.zeros(0, _U), np.zeros(0, _U)
        bit = _U(1) << (self.hash >> _U(20) & _U(63))
        half = (self.hash >> _U(26) & _U(1)).astype(bool)
        return tuple(np.bitwise_xor.reduceat(np.where(side, bit, _U(0)), self.start) for side in (half, ~half))

    def wide_parities(self, bits: int) -> np.ndarray:
        """``(sets, bits / 64)``: as ``parities``, with so many bits, for sets too large for 128."""
        out = np.zeros((len(self.start), bits // 64), np.uint64)
        ends = np.r_[self.start, len(self.hash)]
        place = (self.hash >> _U(27)).astype(np.int64) % bits
        for a in range(0, len(out), 512):
            z = min(a + 512, len(out))
            own = slice(ends[a], ends[z])
            odd = np.bincount((self.line[own] - a) * bits + place[own], minlength=(z - a) * bits) & 1
            out[a:z] = np.packbits(odd.astype(bool).reshape(z - a, bits), axis=1, bitorder="little").view("<u8")
        return out

    def prefixes(self, rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The rarest words of each line, rarest first: those of the prefix and one more; and the bounds of the lines in them.

        ``rank`` orders the words' hash buckets (the highest ``bits`` bits) from the rarest.
        """
        by = rank[(self.hash >> _U(64 - bits)).astype(np.int64)].astype(np.uint64)
        # hashes are in order within a line, so places settle ties of rank
        place = np.arange(len(self.hash)) - np.repeat(self.start, self.n)
        most = int(self.n.max(initial=0)).bit_length()
        key = self.line.astype(np.uint64) << _U(bits) | by
        if len(self.n).bit_length() + bits + most <= 64:
            order = np.argsort(key << _U(most) | place.astype(np.uint64))
        else:
            order = np.argsort(key, kind="stable")
        length = np.minimum(self.n - needed(self.n) + 2, self.n)
        head = place < np.repeat(length, self.n)
        return self.hash[order][head], np.r_[0, np.cumsum(length)]


class LineSets(HashSets):
    """The word sets of the lines with a word of some texts: all, or those whose words ``wanted(owner, number)`` flags."""

    def __init__(self, words: Words, wanted=None):
        owner, number = words.lines()
        h = words.hash
        if wanted is not None:
            ok = wanted(owner, number)
            owner, number, h = owner[ok], number[ok], h[ok]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])][: len(h)]
        first = np.flatnonzero(new)
        super().__init__(np.cumsum(new) - 1, h)
        #: Per line: its text, its number in the text.
        self.owner, self.number = owner[first], number[first]


def _by_line(line: np.ndarray, h: np.ndarray, lines: int) -> np.ndarray:
    """The hashes by line, in order within each; ``line`` is in order. One sort on line and leading hash bits, another only where those tie."""
    spare = _U(max(1, int(lines).bit_length()))
    key = line.astype(np.uint64) << (_U(64) - spare) | h >> spare
    order = np.argsort(key)
    key, out = key[order], h[order]
    tied = (key[1:] == key[:-1]) & (out[1:] != out[:-1])
    return h[np.lexsort((h, line))] if tied.any() else out


#: One posting: a class of equal lines, known by the place of its first line, under one key.
POSTING = np.dtype([("key", "<u4"), ("id", "<i8"), ("number", "<i4"), ("n", "<i4"), ("place", "<i4"), ("bits", "<u8"), ("bits2", "<u8")])
#: The same with the group that a set is known to belong to.
GROUPED = np.dtype([*POSTING.descr, ("root", "<i8")])


def postings(batch: pa.RecordBatch, hot, flagged=None, kind: np.dtype = POSTING) -> tuple[np.ndarray, np.ndarray]:
    """``(unit key, posting)`` arrays of the classes in ``batch(id, number, n, bits, bits2, prefix[, root])``.

    A class is posted under each word of its prefix. Under a word that ``hot`` flags it is posted with each later
    word up to one beyond the prefix instead: sets that share that word first share another one there.
    ``flagged``, if given, keeps only the keys that it flags.
    """
    n = batch.column(2).to_numpy().astype(np.int64)
    lists = batch.column(5)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    word = lists.flatten().to_numpy().view(np.uint64)
    long = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), long)
    place = np.arange(len(word)) - bounds[:-1][row]
    inside = place < (n - needed(n) + 1)[row]
    warm = inside & hot(word) if hot is not None else np.zeros(len(word), bool)
    plain = np.flatnonzero(inside & ~warm)
    key, of, at = [word[plain]], [row[plain]], [place[plain]]
    first = np.flatnonzero(warm)
    if len(first):
        more = long[row[first]] - place[first] - 1
        a = np.repeat(first, more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        key.append(mixed(word[a] + mixed(word[b])))
        of.append(row[a])
        at.append(place[a])
    key, of, at = map(np.concatenate, (key, of, at))
    if flagged is not None:
        ok = flagged(key)
        key, of, at = key[ok], of[ok], at[ok]
    out = np.empty(len(key), kind)
    out["key"], out["place"] = key.astype(np.uint32), at
    for k, name in ((0, "id"), (1, "number"), (2, "n")):
        out[name] = batch.column(k).to_numpy()[of]
    for k, name in ((3, "bits"), (4, "bits2")):
        out[name] = batch.column(k).to_numpy().view(np.uint64)[of]
    if "root" in kind.names:
        out["root"] = batch.column(6).to_numpy()[of]
    return key, out


def packed_rows(unit: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """``(unit, rows)``: the postings of each unit as one binary value."""
    order = np.argsort(unit, kind="stable")
    unit, rows = unit[order], rows[order]
    cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]][: len(unit)])
    bounds = np.r_[cut, len(rows)] * rows.itemsize
    blobs = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(unit[cut]), blobs], names=["unit", "rows"])


def pack(made, units: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of about ``PACKED`` of the ``(key, postings)`` in ``made`` at a time."""
    held, size = [], 0
    for key, rows in made:
        held.append(((key >> _U(32)).astype(np.int64) % units, rows))
        size += len(rows)
        if size >= PACKED:
            yield packed_rows(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield packed_rows(*map(np.concatenate, zip(*held)))


#: Postings that are searched at once, whole units each.
SLAB = 1 << 18


def unpacked(batches, kind: np.dtype = POSTING) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(unit, postings)`` of about ``SLAB`` postings, whole units each, from ``packed_rows`` sorted by unit."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = buffer_of(batch.column(1))
        rows = np.frombuffer(data, kind)
        held.append((np.repeat(batch.column(0).to_numpy(), np.diff(bounds) // kind.itemsize), rows))
        size += len(rows)
        if size >= SLAB:
            unit, rows = map(np.concatenate, zip(*held))
            first = np.flatnonzero(np.diff(unit)) + 1
            ends = np.unique(np.searchsorted(first, np.arange(SLAB, len(rows) + SLAB, SLAB), side="right") - 1)
            at = 0
            for end in first[ends[ends >= 0]].tolist():
                yield unit[at:end], rows[at:end]
                at = end
            held = [(unit[at:].copy(), rows[at:].copy())]
            size = len(held[0][0])
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


#: Pairs held while a step of the search goes on; a bound on memory, not on results.
HELD = 1 << 21
#: A candidate whose parities differ by so much less than those of sets just similar enough is taken as good.
SURE = 4
#: Candidates of a list that a row without a sure one names in the first round.
NAMED = 8
#: Postings that are packed together, 40 bytes or so each.
PACKED = 1 << 20


def _corpus_order(known: np.ndarray, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order by known, id, number: one sort of packed numbers where they fit in 63 bits."""
    if not len(ids):
        return np.zeros(0, np.int64)
    low, span, most = int(ids.min()), int(ids.max()) - int(ids.min()), int(number.max())
    if span.bit_length() + most.bit_length() > 62:
        return np.lexsort((number, ids, known))
    packed = (ids - low) << most.bit_length() | number
    return np.argsort(packed | known.astype(np.int64) << 62)


class Lists:
    """The postings of some units in order of key and of place in the corpus, and the search for candidates in them."""

    def __init__(self, rows: np.ndarray, unit: np.ndarray | None = None):
        known = rows["number"] >= 0
        number = np.where(known, rows["number"], -1 - rows["number"]).astype(np.int64)
        nth = np.empty(len(rows), np.uint64)
        nth[_corpus_order(known, rows["id"], number)] = np.arange(len(rows), dtype=np.uint64)
        key = rows["key"].astype(np.uint64)
        if unit is not None and len(unit):
            key |= (unit - unit.min()).astype(np.uint64) << _U(32)
        bits = len(rows).bit_length()
        order = np.argsort(key << _U(bits) | nth) if not len(key) or int(key.max()).bit_length() + bits <= 64 else np.lexsort((nth, key))
        key = key[order]
        self.key, self.id, self.number = rows["key"][order], rows["id"][order], rows["number"][order]
        self.bits, self.bits2 = rows["bits"][order], rows["bits2"][order]
        self.n, self.place = rows["n"][order], rows["place"][order]
        self.root = rows["root"][order] if "root" in rows.dtype.names else None
        num, den = SIMILAR
        self.least, self.most = needed(self.n.astype(np.int64)).astype(np.int32), np.minimum(self.n.astype(np.int64) * den // num, 2**31 - 1).astype(np.int32)
        new = np.r_[True, key[1:] != key[:-1]][: len(rows)]
        cut = np.r_[np.flatnonzero(new), len(rows)]
        self.first = np.repeat(cut[:-1], np.diff(cut))
        # rows of one place in the corpus (ids that repeat) may come in either order, so each meets the others too
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = ~new[1:] & (self.id[1:] == self.id[:-1]) & (self.number[1:] == self.number[:-1])
        group = np.cumsum(~same[:-1]) - 1
        self.stop = np.r_[np.flatnonzero(~same[:-1])[1:], len(rows)][group]
        # a list of one row and the first of each list have nothing to meet
        self.meets = np.flatnonzero(self.stop - self.first > 1)

    def slack(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (by place in ``y``) that no filter rules out, and how far their parities differ by less than those of sets just similar enough would."""
        num, den = SIMILAR
        nx = self.n[x]
        ok = (nx >= self.least[y]) & (nx <= self.most[y])
        if self.root is not None:
            ok &= self.root[x] != self.root[y]
        ok = np.flatnonzero(ok)
        y, x, nx = y[ok], x[ok], nx[ok].astype(np.int64)
        ny, py, px = self.n[y], self.place[y], self.place[x]
        need = -(-num * (ny + nx) // (num + den))
        fits = (np.minimum(py, px) + np.minimum(ny - py, nx - px) >= need) & (x != y)
        ok, y, x, most = ok[fits], y[fits], x[fits], (ny + nx - 2 * need)[fits]
        apart = np.bitwise_count(self.bits[y] ^ self.bits[x]).astype(np.int64)
        fits = apart <= most
        ok, y, x, most, apart = ok[fits], y[fits], x[fits], most[fits], apart[fits]
        apart += np.bitwise_count(self.bits2[y] ^ self.bits2[x])
        fits = apart <= most
        ok, most, apart = ok[fits], most[fits], apart[fits]
        return ok, np.floor(64 * -np.expm1(-most / 64)).astype(np.int64) - apart

    def _steps(self, todo: np.ndarray, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(y, x, slack)`` of candidate pairs, step by step; rows that the receiver flags in ``done`` stop."""
        at, stop = self.first[todo], self.stop[todo]
        while len(todo):
            ok, left = self.slack(todo, at)
            on = at + 1 < stop
            if len(ok):
                yield todo[ok], at[ok], left
                if done is not None:
                    on &= ~done[todo]
            todo, at, stop = todo[on], at[on] + 1, stop[on]

    def best(self, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(y, x, more)``: for each row the first sure candidate before it, or else the ``take`` with most slack, the earliest of equals; whether there may be others."""
        done = np.zeros(len(self.n), bool)
        found = self._ranked(self._steps(self.meets, done), done, take)
        y, x, left, nth = found
        sure = left >= SURE
        keep = sure | ~done[y]
        y, x, nth, sure = y[keep], x[keep], nth[keep], sure[keep]
        return y, x, sure | (nth == take - 1)

    def _ranked(self, steps, done: np.ndarray, take: int) -> tuple[np.ndarray, ...]:
        """``(y, x, slack, nth)``: the first ``take`` pairs of each y by slack, then place; a sure one ends the search for y."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def trim() -> tuple[np.ndarray, ...]:
            y, x, left = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((x, -left, y))
            y, x, left = y[order], x[order], left[order]
            new = np.flatnonzero(np.r_[True, y[1:] != y[:-1]][: len(y)])
            nth = np.arange(len(y)) - np.repeat(new, np.diff(np.r_[new, len(y)]))
            ok = nth < take
            return y[ok], x[ok], left[ok], nth[ok]

        for part in steps:
            if done is not None:
                done[part[0][part[2] >= SURE]] = True
            held.append(part)
            size += len(part[0])
            if size > HELD:
                held = [trim()[:3]]
                size = len(held[0][0]) // 2
        return trim()

    def ranked(self, asking: np.ndarray, skip: int, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(y, x, more)`` for the rows ``asking``: their candidates ranked ``skip`` to ``skip + take`` by slack, then place; ``more`` marks the last."""
        asking = asking[np.isin(asking, self.meets, assume_unique=True)]
        y, x, _, nth = self._ranked(self._steps(asking), None, skip + take)
        ok = nth >= skip
        return y[ok], x[ok], nth[ok] == skip + take - 1
