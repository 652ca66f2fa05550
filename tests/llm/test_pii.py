"""Personal data against the plain patterns of its definition and counts in Python."""

import hashlib
import math
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
import regex

from lectio.llm import pii
from lectio.llm import queries as Q

AT = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def counts(kind, value):
    digits = regex.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def base(text):
    found = [(m.start(), k, m.end(), m[0]) for k, kind in enumerate(PLAIN) for m in regex.finditer(PLAIN[kind], text) if counts(kind, m[0])]
    return sorted(found)


def brute(docs):
    """``{doc_id: (counts, base digest, all spans)}`` of ``[(id, text)]`` with distinct ids."""
    spans = {i: base(t or "") for i, t in docs}
    terms = {i: [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(pii.TERM, t or "")] for i, t in docs}
    ne, nt, net, n = Counter(), Counter(), Counter(), len(docs)
    for i, _ in docs:
        own, words = {(k, v.lower()) for _, k, _, v in spans[i]}, {regex.sub("", "", w) for _, _, w in terms[i]}
        ne.update(own)
        nt.update(words)
        net.update((e, w) for e in own for w in words)
    told = {w for (e, w), c in net.items() if math.log2(c * n / (ne[e] * nt[w])) >= -pii.DISCLOSED * math.log2(ne[e] / n)}
    out = {}
    for i, _ in docs:
        write = lambda rows: ",".join(f"{(*PLAIN, 'term')[k]}:{a}:{z}" for a, k, z in sorted(rows))
        own = [(a, k, z) for a, k, z, _ in spans[i]]
        more = [(a, 4, z) for a, z, w in terms[i] if w in told and not any(x < z and a < y for x, _, y in own)]
        out[i] = (*[sum(s[1] == k for s in own) for k in range(4)], hashlib.sha256(write(own).encode()).hexdigest(), write(own + more))
    return out


def answer(spark, at):
    return {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in Q.op4_pii(spark, at).collect()}


def test_whole_table(spark):
    table = pq.read_table(f"{AT}/documents.parquet", columns=["doc_id", "text"])
    want = brute(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    got = answer(spark, AT)
    assert got == want and any("term" in w[-1] for w in want.values()) and any(w[1] for w in want.values())


ODD = [
    "a@b.c a@b a.b@c.d.e, x@y.z@w.v 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4 1.2.3 9999999999.1.1.1",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 1111 1111 12345678901234567890123",
    "+1 (499) 555-6503 +12 +123456789012345678 +1--------2 ++49 30 1234567 +1 234 567 8901+1 234 567 8902",
    "x" * 3000 + "@" + "é a@é.com 4111 1111 1111 1111\n+4 111 1111 1111",
    "a@b." + "c." * 4000 + " 1" + ".1" * 5000 + " " + "4 " * 5000 + "+" * 500 + "1" + "-" * 3000,
    "😀 mail zoë@example.org 10.0.0.1😀 +33 1 23 45 67 89. Ünique wörd",
    "",
    None,
]


def test_odd_texts(spark, tmp_path):
    docs = list(enumerate(ODD))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(spark, str(tmp_path)) == brute(docs)


@pytest.mark.parametrize("text", [",".join(map(str, range(32_000))), " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(32_000))])
def test_many_matches_in_one_text(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    frame.select(pii.base_spans(frame["text"])).collect()
    began = time.perf_counter()
    found = frame.select(pii.base_spans(frame["text"]).alias("s")).collect()[0]["s"]
    assert time.perf_counter() - began < 8 and [(s["start"], s["kind"], s["end"]) for s in found] == [b[:3] for b in base(text)]


def test_sanitise(spark):
    """A term that only occurs with the entity goes, one with a common stem keeps that, the rest stay; other columns too."""
    rows = [(1, "write to zanzibar officina at jo@example.com today"), (2, "officina today"), (3, None)]
    rows += [(k, f"please write to the office today w{k}") for k in range(4, 400)]
    frame = spark.createDataFrame([(*r, 7, "m") for r in rows], "doc_id long, text string, t int, mark string")
    out = {r["doc_id"]: r for r in pii.sanitise(frame).collect()}
    assert len(out) == len(rows) and out[3]["text"] is None and out[5]["text"] == rows[4][1] and (out[1]["t"], out[1]["mark"]) == (7, "m")
    assert out[1]["text"] == "write to  offic* at [EMAIL] today" and out[2]["text"] == "offic* today"
