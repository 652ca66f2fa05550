"""SentencePiece encoding by an Aho-Corasick automaton and a single Viterbi pass, and exact decoding.

The model file gives pieces and scores. A text is a space, then the text, each space written as U+2581; the
encoding is the piece sequence of greatest total score, where a character that no piece covers costs the least
score less ten and is written as its UTF-8 bytes' pieces. Ties take the longer last piece. Decoding joins the
pieces' bytes; a U+2581 in the text itself is written in byte pieces, and bytes that are no UTF-8 too, so that
decoding returns every text exactly. For a model trained by merges the best-score sequence need not be the
merge order's sequence; it is the one that this method defines.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import per_batch, utf8

SPACE = "▁"
#: Score below the least piece's score for a character in byte pieces.
PENALTY = 10.0
#: Distinct chunks whose encoding a worker remembers.
REMEMBERED = 1 << 18
#: Longest chunk that is remembered, in characters.
LONG = 64


class Encoder:
    """Pieces of one model, as an automaton and as bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.byte_id):
            raise ValueError("the model has no byte pieces, so it cannot write every text")
        normal = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        self.bytes = [b""] * n
        for b, i in enumerate(self.byte_id):
            self.bytes[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i, piece in normal.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
            scores.append(sp.get_score(i))
            self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
        self.automaton.make_automaton()
        self.unknown = min(scores) - PENALTY
        # a piece never runs from a word into the space before the next one, and none holds a line break:
        # then the best sequence of a text is that of its chunks in turn
        apart = all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or len(p) == 1) for p in normal.values())
        self.chunks = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if apart else "(?s:.+)").findall
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best sequence for ``text`` in one pass: every piece that ends at a position relaxes its score."""
        n = len(text)
        best, back = [0.0] * (n + 1), [(1, -1)] * (n + 1)
        done = 0  # best[1..done] hold the fallback or better

        def reach(end: int) -> None:
            nonlocal done
            while done < end:
                best[done + 1], back[done + 1] = best[done] + self.unknown, (1, -1)
                done += 1

        for end, (size, score, piece) in self.automaton.iter(text):
            end += 1
            reach(end)
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and size > back[end][0]):
                best[end], back[end] = total, (size, piece)
        reach(n)
        out: list[int] = []
        at = n
        while at:
            size, piece = back[at]
            if piece < 0:
                c = text[at - 1]
                out.extend(self.byte_id[b] for b in reversed(c.encode("utf-8", "surrogateescape")))
            else:
                out.append(piece)
            at -= size
        return out[::-1]

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian int32, for a text in UTF-8 or any other bytes."""
        s = text.decode("utf-8", "surrogateescape")
        if SPACE in s:
            parts = re.split(f"([{SPACE}])", s)
            made = [self._plain(SPACE + parts[0].replace(" ", SPACE))]
            for c, rest in zip(parts[1::2], parts[2::2]):
                made += [np.array([self.byte_id[b] for b in c.encode()], "<i4").tobytes(), self._plain(rest.replace(" ", SPACE))]
            return b"".join(made)
        return self._plain(SPACE + s.replace(" ", SPACE))

    def _plain(self, s: str) -> bytes:
        known, out = self.known, []
        for chunk in self.chunks(s):
            ids = known.get(chunk)
            if ids is None:
                ids = np.array(self.viterbi(chunk), "<i4").tobytes()
                if len(chunk) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One encoder for each model and worker process."""
    return Encoder(model)


def encode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids``, the array of piece ids of its whole text. Null and empty text: the space piece alone."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))
    others = [c for c in df.columns if c not in (text_col, "ids")]
    return _mapped(df, others, text_col, model, False)


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """As ``encode``, with ``decoded``, the text that the ids give back."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))
    others = [c for c in df.columns if c not in (text_col, "ids", "decoded")]
    return _mapped(df, others, text_col, model, True)


def _mapped(df: DataFrame, others: list[str], text_col: str, model, decode: bool) -> DataFrame:
    """The other columns pass through untouched, whatever their types; only the text is read in Python."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

    kept = [df.schema[c] for c in others]
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kept] + [pa.field("ids", pa.list_(pa.int32()))] + [pa.field("decoded", pa.binary())] * decode

    def run(batches):
        for batch in batches:
            e = encoder(model.value)
            ids = [np.frombuffer(e.encode(x.as_py()), "<i4") for x in batch.column(len(others))]
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
            made = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))]
            if decode:
                made.append(pa.array([e.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(others))] + made, names=[f.name for f in fields])

    schema = StructType(kept).add("ids", ArrayType(IntegerType()))
    if decode:
        schema = schema.add("decoded", BinaryType())
    out = df.select(*[F.col(f"`{c}`") for c in others], utf8(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumn("decoded", F.col("decoded").cast("string")) if decode else out


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
