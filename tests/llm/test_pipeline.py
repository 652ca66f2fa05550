"""Each stage of the corpus pipeline against a version in plain Python, over nulls, ties, repeats and clashing names."""

import os
import random
import sys
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as P
from lectio.llm import pieces, scratch
from lectio.llm.queries import PIECES

sys.path.insert(0, os.path.dirname(__file__))
from test_mixing import targets

NAMES = "doc_id long, text string, lang string, source string, n_chars long, n int, target string, size int, copies int, removed int, ids string, id int, mark string"
EXTRA = (1, "t", 2, 3, 4, "i", 5, "m")


def documents():
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "tu", "re", "son"]) for _ in range(4)) + r.choice([""] * 8 + [","])
    line = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for k in range(60):
        docs.append("\n".join(line(r.randrange(6, 30)) for _ in range(r.randrange(1, 6))))
    for k in range(0, 40, 2):  # near copies: a word of each line replaced, a line copied whole, reordered words
        t = docs[k].split("\n")
        docs.append("\n".join(" ".join([*x.split()[:-1], word()]) for x in t))
        docs.append(docs[k + 1].split("\n")[0] + "\n" + line(12))
        docs.append(" ".join(reversed(t[0].split())) + "\n\n" + line(9))
    docs += [docs[3]] * 4 + ["", None, " \n\t", "too few words here", "# * $ % " * 20, "same line of eight words is repeated here\n" * 9, "x" * 70_000]
    rows = [(k, t, "en", r.choice(["a", "b", None]), len(t or ""), *EXTRA) for k, t in enumerate(docs)]
    rows += [rows[5], rows[5], (None, docs[7], None, "b", 1, *EXTRA), (7, docs[8], "en", "a", 1, *EXTRA)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), NAMES)


def test_line_dedup(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    seen, want = [], Counter()
    ranked = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in rows if r["text"] is not None})
    marks = {x["t"]: x["m"] for x in spark.createDataFrame([(t,) for *_, t in ranked], "t string").selectExpr("t", "xxhash64(t) m").collect()}
    places = sorted((known, i, n, marks[t], t, frozenset(line.split())) for known, i, t in ranked for n, line in enumerate(t.split("\n")) if line.split())
    gone = set()
    for known, i, n, _, t, own in places:
        if any(5 * len(own & x) >= 4 * len(own | x) for x in seen if 5 * min(len(own), len(x)) >= 4 * max(len(own), len(x))):
            gone.add((known, i, t, n))
        seen.append(own)
    for r in rows:
        key = (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])
        if r["text"] is None:
            want[(r["doc_id"], None)] += 1
            continue
        parts = r["text"].split("\n")
        kept = "\n".join(x for n, x in enumerate(parts) if (*key, n) not in gone)
        if kept == r["text"] or kept.split():
            want[(r["doc_id"], kept)] += 1
    got = P.line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == want and len(gone) > 20
    assert all(tuple(r)[5:] == EXTRA and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)


def test_near_dedup(spark, docs):
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()})
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for *_, t in rows]
    label = list(range(len(rows)))
    for y in range(len(rows)):
        for x in range(y):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = [low if k == high else k for k in label]
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    ids = Counter((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect())
    assert ids == Counter(rows[k][:2] for k in set(label))


def test_quality_rules(spark, docs):
    def good(t):
        words = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.split()]
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = [False] * len(words)
        for k in range(len(words) - 7):
            if seen[tuple(words[k : k + 8])] > 1:
                again[k : k + 8] = [True] * 8
        chars = sum(map(len, words))
        letters = sum(c.isalpha() for c in t or "")
        return not (
            len(words) < 20 or 5 * sum(c in "#*$%&|<>" for c in t) > len(words) or 5 * t.count("!") > len(words) or 2 * sum("A" <= c <= "Z" for c in t) > len(t)
            or 2 * (chars - letters) > chars or not 2 * len(words) <= chars <= 15 * len(words) or 10 * (len(lines) - len(set(lines))) > 4 * len(lines) or 100 * sum(again) > 30 * len(words)
        )

    got = P.quality_rules(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter((r["doc_id"], r["text"]) for r in docs.collect() if good(r["text"])) and 20 < sum(kept.values()) < docs.count() - 5


def test_mix_sources(spark, docs):
    got = P.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    rows, out = docs.collect(), got.collect()
    size, taken = Counter(), Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").split())
    for r in out:
        taken[r["source"]] += len((r["text"] or "").split())
    had, has = Counter((r["doc_id"], r["text"]) for r in rows), Counter((r["doc_id"], r["text"]) for r in out)
    assert all(has[k] <= 2 * had[k] for k in has) and set(has) <= set(had)
    # weights 5, 2, 1 for a, b, null; shares of 150 % stop at twice a source's size
    for s, t in targets(size).items():
        assert abs(taken[s] - t) <= 0.5


def test_encode_pieces(spark, docs):
    got = P.encode_pieces(spark, docs, "")
    assert set(got.columns) == set(docs.columns) - {"text"} | {"ids", "n_pieces"}
    encoder, sp = pieces.Encoder(open(PIECES, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = Counter()
    for r in got.collect():
        assert r["n_pieces"] == len(r["ids"]) and all(0 <= i < sp.get_piece_size() for i in r["ids"])
        texts[(r["doc_id"], b"".join(encoder.bytes[i] for i in r["ids"])[1:].decode())] += 1
    assert texts == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())


def test_run_is_the_stages_in_turn(spark, tmp_path):
    spark.createDataFrame(documents(), NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        now = scratch.cut(stage(spark, now, str(tmp_path)), name)
    once, twice = (Counter((r["doc_id"], tuple(r["ids"])) for r in x.collect()) for x in (now, P.run(spark, str(tmp_path))))
    assert once == twice and sum(once.values()) > 10


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], NAMES), "").collect() == []
