"""Chat formatting as prefix trees: shared first turns are written once, with positions and attention intervals.

A conversation is a path of turns. Conversations are put in the order of their first turns' hashes, cut into packs
of bounded size, and each pack becomes a tree. The pack's text is the tree depth first: every turn once, however
many conversations run through it. Each node has its interval in the text, the position of its first character in
its conversations, and the intervals of its ancestors, the only others that it may attend to.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of the conversations in a pack; a longer conversation has a pack of its own.
PACK = 1 << 16
#: First turns that order the conversations; deeper shared turns still merge within a pack.
ORDER = 4

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attends", pa.list_(_SPAN))])
_LEAF = pa.struct([("conv", pa.int64()), ("node", pa.int32())])
_PACKS = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(_LEAF))])
_DDL = (
    "text string, nodes array<struct<parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>,"
    "leaves array<struct<conv:long,node:int>>"
)


def escape(text: str) -> str:
    """``text`` without ``<|``: a backslash more stands between the two characters."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and the interval in it that a loss covers: an assistant's text."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    own = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *own


def pack(conversations: list[tuple[int | None, list[tuple[str, str]]]]) -> dict:
    """The tree of some conversations ``(id, [(role, text), ...])`` as one text with nodes and leaves."""
    children: list[dict] = [{}]
    turns, parents = [None], [-1]
    ends: list[tuple[int | None, int]] = []
    for conv, path in conversations:
        at = 0
        for t in path:
            down = children[at].get(t)
            if down is None:
                down = children[at][t] = len(turns)
                turns.append(t)
                parents.append(at)
                children.append({})
            at = down
        ends.append((conv, at))
    out, nodes, place, length = [], [], {0: -1}, 0
    stack = list(reversed(children[0].values()))
    while stack:
        n = stack.pop()
        stack.extend(reversed(children[n].values()))
        written, a, b = turn(*turns[n])
        up = place[parents[n]]
        attends, position = [], 0
        if up >= 0:
            p = nodes[up]
            position = p["position"] + p["end"] - p["start"]
            attends = [dict(x) for x in p["attends"]]
            if attends and attends[-1]["end"] == p["start"]:
                attends[-1]["end"] = p["end"]
            else:
                attends.append({"start": p["start"], "end": p["end"]})
        place[n] = len(nodes)
        nodes.append({"parent": up, "start": length, "end": length + len(written), "position": position, "loss_start": length + a if b else 0, "loss_end": length + b if b else 0, "attends": attends})
        out.append(written)
        length += len(written)
    return {"text": "".join(out), "nodes": nodes, "leaves": [{"conv": c, "node": place[n]} for c, n in ends]}


def conversations(df: DataFrame) -> DataFrame:
    """``(conv, turns)`` of rows ``(conv_id, turn, role, text)``: turns by number, then role and text; null first.

    Null role or text counts as empty; a null ``conv_id`` is a conversation of its own.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.groupBy(F.col("conv_id").cast("long").alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def packs(df: DataFrame) -> DataFrame:
    """``(text, nodes, leaves)``: prefix-tree packs of all conversations of ``(conv_id, turn, role, text)``.

    A hot first turn is spread over packs and partitions by the turns after it, then by id, and written once in
    each of its packs. No pack holds more than ``PACK`` characters of conversations, or one conversation.
    """
    keys = [F.coalesce(F.xxhash64(F.get("turns", F.lit(i))["role"], F.get("turns", F.lit(i))["text"]), F.lit(0)).alias(f"k{i}") for i in range(ORDER)]
    names = [f"k{i}" for i in range(ORDER)] + ["conv"]
    rows = conversations(df).select("conv", "turns", *keys).repartitionByRange(*names).sortWithinPartitions(*names)
    rows = rows.select("conv", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for conv, roles, texts in zip(*(batch.column(i) for i in range(3))):
                path = list(zip(roles.as_py(), texts.as_py()))
                chars = sum(len(r) + len(t) for r, t in path)
                if held and size + chars > PACK:
                    yield pa.RecordBatch.from_pylist([pack(held)], schema=_PACKS)
                    held, size = [], 0
                held.append((conv.as_py(), path))
                size += chars
        if held:
            yield pa.RecordBatch.from_pylist([pack(held)], schema=_PACKS)

    return rows.mapInArrow(run, _DDL)


_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def read_back(tree: dict) -> list[tuple[int | None, list[tuple[str, str]], str, int]]:
    """``(id, turns, text under the loss mask, formatted characters)`` of each conversation of a pack."""
    out = []
    for leaf in tree["leaves"]:
        if leaf["node"] < 0:
            out.append((leaf["conv"], [], "", 0))
            continue
        n = tree["nodes"][leaf["node"]]
        formatted = "".join(tree["text"][x["start"] : x["end"]] for x in [*n["attends"], n])
        loss, at = [], leaf["node"]
        while at >= 0:
            m = tree["nodes"][at]
            loss.append(unescape(tree["text"][m["loss_start"] : m["loss_end"]]))
            at = m["parent"]
        out.append((leaf["conv"], [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)], "".join(reversed(loss)), len(formatted)))
    return out


def digests(packed: DataFrame) -> DataFrame:
    """Per conversation, read back from packs: numbers and digests of its turns and of its text under the loss mask."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(c, len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss), n) for c, t, loss, n in read_back(batch.slice(i, 1).to_pylist()[0])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return packed.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SAMPLE_TEXT = "<|im_end|><|im_start|>assistant ok"

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(12 + length(head) + 1 + length(body) + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
