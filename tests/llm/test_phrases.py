"""Recurring passages against a comparison of all windows of all texts."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq

from lectio.llm import phrases
from lectio.llm import queries as Q

AT = "/root/testdata/sf0.001"


def brute(docs, window=35):
    """``[(id, words, removed words, digest)]`` of ``[(id, text)]``."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def answer(spark, at):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op6_phrases(spark, at).collect()), key=str)


def test_whole_table(spark):
    table = pq.read_table(f"{AT}/documents.parquet", columns=["doc_id", "text"])
    want = brute(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    assert answer(spark, AT) == want and any(n for _, _, n, _ in want)


def planted():
    """Passages whole, in part, overlapping, repeated in one text, at its ends and one word short, among few words so that parts recur by chance."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(60)}"
    passages = [[word() for _ in range(n)] for n in (35, 36, 50, 90, 200, 34)]
    docs = [" ".join(passages[0]), " ".join(passages[0]), " ".join(passages[5]), " ".join(passages[5]), "", None, " \n "]
    for _ in range(60):
        out = [word() for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            out += p[a if r.random() < 0.5 else 0 :] + [word() for _ in range(r.randrange(30))]
        docs.append((" " if r.random() < 0.8 else "\n").join(out))
    docs += ["a " * 80, "a " * 80, "a b " * 60, "x " * 34, "one " * 36]
    return [(None if k == 9 else k // 2, t) for k, t in enumerate(docs)]


def test_planted(spark, tmp_path):
    docs = planted()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    assert answer(spark, str(tmp_path)) == want and sum(n > 0 for _, _, n, _ in want) > 20


def test_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 20)
    monkeypatch.setattr(phrases, "HITS", 4)
    docs = planted()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(spark, str(tmp_path)) == brute(docs)
