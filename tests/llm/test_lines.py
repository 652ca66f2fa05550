"""Line de-duplication against a comparison of every line with all earlier ones."""

import pyarrow.parquet as pq
import pytest

from lectio.llm import queries as Q

AT = "/root/testdata/sf0.001"


def brute(docs):
    earlier, out = [], {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        n, gone = 0, []
        for k, line in enumerate((text or "").encode().split(b"\n")):
            own = frozenset(line.split())
            if not own:
                continue
            n += 1
            # 5 * both >= 4 * either: a Jaccard similarity of 0.8 or more
            if any(5 * (both := len(own & x)) >= 4 * (len(own) + len(x) - both) for x in earlier if 5 * min(len(own), len(x)) >= 4 * max(len(own), len(x))):
                gone.append(k)
            earlier.append(own)
        out[doc] = (n, gone)
    return out


def test_whole_table(spark):
    found = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in Q.op7_lines(spark, AT).collect()}
    table = pq.read_table(f"{AT}/documents.parquet", columns=["doc_id", "text"])
    want = brute(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    assert found == want and any(gone for _, gone in want.values())


@pytest.mark.parametrize("shared, gone", [(8, False), (9, True)])
def test_threshold(spark, tmp_path, shared, gone):
    """Ten words against ten: eight in common are 8/12, nine are 9/11."""
    a = " ".join(f"a{i}" for i in range(10))
    b = " ".join([f"a{i}" for i in range(shared)] + [f"b{i}" for i in range(10 - shared)])
    spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["removed"] for r in Q.op7_lines(spark, str(tmp_path)).collect()}
    assert found == {1: [], 2: [0] if gone else []}


def test_words_that_agree_in_most_bits_stay_apart():
    """However many lines share a slice, hashes that differ in one bit are two words."""
    import numpy as np

    from lectio.llm.linesets import HashSets

    owner = np.repeat(np.arange(5000), 4)
    h = np.tile(np.array([1 << 63, (1 << 63) + 1, 1 << 63, 7], np.uint64), 5000)
    s = HashSets(owner, h)
    assert (s.n == 3).all() and len(set(s.k1.tolist())) == 1 and (s.k1 == HashSets(owner[:4], h[:4]).k1[0]).all()


def test_hot_words_and_many_like_lines(spark, monkeypatch):
    """Few words, so that nearly all lists are hot and go on by pairs of words; small units and rounds."""
    import random

    from lectio.llm import lines, linesets

    monkeypatch.setattr(lines, "HOT", 5)
    monkeypatch.setattr(lines, "UNIT", 64)
    monkeypatch.setattr(lines, "NEXT", 2)
    monkeypatch.setattr(lines, "NAMED", 1)
    monkeypatch.setattr(linesets, "SLAB", 100)
    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    docs = [(k if k != 50 else None, "\n".join(" ".join(r.sample(common, r.randrange(4, 14))) for _ in range(4))) for k in range(120)]
    base = [f"b{i}" for i in range(40)]
    docs += [(200 + k, " ".join(w if r.random() > 0.12 else f"x{r.randrange(99)}" for w in base)) for k in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = frame.selectExpr("doc_id as id", "xxhash64(text) as mark", "text")
    found = {r["id"]: (r["n_lines"], r["removed"]) for r in lines.removed_lines(rows).collect()}
    assert found == {i: v for (i, _), v in zip(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)), brute([(d[0] if d[0] is not None else -1, d[1]) for d in docs]).values())}
