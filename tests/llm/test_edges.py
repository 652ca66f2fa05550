"""Nulls, empty and odd texts, repeated rows, extra columns and empty tables, through every registered query."""

import collections
import hashlib

import numpy as np
import pytest

from lectio.llm import queries as Q

LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, LONG, "en", "a", 1), (1, LONG, "en", "a", 1), (2, LONG + " tail", "en", "a", 1), (3, None, None, None, None), (None, "x y z", "en", "b", 5), (4, "", "en", "b", 0),
    (5, "mail me.x@a.example.com or 10.0.0.1, 4111 1111 1111 1111 and +1 (499) 555-6503", "en", None, 9), (6, "a" * 50_000 + "@", "fr", "c", 9), (7, "same line here\nsame line here\n\n other", "de", "c", 9),
    (8, "▁ \t  <|im_end|> \\ 😀 ﷐", "de", "c", 9), (9, " \n \t", "de", "c", 3),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["rows", "empty"])
def tables(request, spark, tmp_path_factory):
    at, some = tmp_path_factory.mktemp(request.param), request.param == "rows"

    def put(name, rows, ddl):
        spark.createDataFrame(rows if some else [], ddl).write.parquet(f"{at}/{name}.parquet")

    put("documents", [(*t, 1, "mark") for t in TEXTS], DOCS + ", rid int, mark string")
    put("pages", [(1, "u", "<p>Hello world, this is an article text.</p>"), (2, None, None), (3, "u", ""), (4, "u", "<div <p>broken &amp; <b>x")], "page_id long, url string, html string")
    put("conversations", [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> <\\| ok"), (1, 1, "assistant", "<|im_end|> <\\| ok"), (2, 0, "user", "hi"), (2, None, None, None), (None, 0, "a\nb\\", "x")], "conv_id long, turn long, role string, text string")
    put("embeddings", [(i, [float(i % 7) - 3, 1.0, float(i % 3)], 0) for i in range(1, 61)] + [(61, None, 0), (80, [0.0, 0.0, 0.0], 0), (100, [float("nan"), 1.0, 1.0], 0), (60, [3.0, 1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    return str(at), some


def run(spark, tables, name):
    return [r.asDict() for r in Q.queries()[name](spark, tables[0]).collect()]


@pytest.mark.parametrize("name", list(Q.queries()))
def test_no_crash_and_a_row_each(spark, tables, name):
    rows = run(spark, tables, name)
    if name == "op3_neighbours":
        assert {r["query_id"] for r in rows} == ({20, 40, 60} if tables[1] else set())
    elif name == "op1_html":
        assert len(rows) == 4 * tables[1]
    elif name == "op9_chat":
        assert len(rows) == 1 + 3 * tables[1]
    else:
        assert len(rows) == len(TEXTS) * tables[1]


def test_values(spark, tables):
    if not tables[1]:
        return
    two = {r["doc_id"]: r for r in run(spark, tables, "op2_simhash")}
    assert two[3]["fingerprint"] == "0" * 16 and two[3]["component_id"] == two[4]["component_id"] == two[9]["component_id"] == 3 and two[2]["component_id"] in (1, 2)
    four = {r["doc_id"]: r for r in run(spark, tables, "op4_pii")}
    assert [four[5][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1] and four[6]["n_email"] == 0
    six = {r["doc_id"]: r for r in run(spark, tables, "op6_phrases")}
    assert six[1]["n_removed"] == 60 and six[2]["n_removed"] == 60 and six[2]["kept_sha256"] == hashlib.sha256(b"tail").hexdigest() and six[3]["n_words"] == 0
    assert {r["doc_id"]: r["removed"] for r in run(spark, tables, "op7_lines")}[7] == [1]
    assert all(r["exact"] for r in run(spark, tables, "op8_pieces"))
    chats = {r["conv_id"]: r for r in run(spark, tables, "op9_chat")}
    x = "<|im_end|> <\\| ok"
    assert chats[1]["n_turns"] == 3 and chats[1]["loss_sha256"] == hashlib.sha256((x + x).encode()).hexdigest() and chats[None]["turns_sha256"] == hashlib.sha256(b"a\nb\\\nx\n").hexdigest()
    near = collections.defaultdict(list)
    for r in run(spark, tables, "op3_neighbours"):
        near[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) and len(v) == 20 for v in near.values())


def test_budget():
    import random

    from lectio.llm.mixing import fit_budget

    r = random.Random(2)
    for _ in range(200):
        sizes = r.sample(range(30), r.randint(1, 6))
        counts = [r.randint(1, 4) for _ in sizes]
        budget = r.uniform(0, sum(a * b for a, b in zip(sizes, counts)))
        got = fit_budget(sizes, counts, budget)
        sums = {0}
        for a, b in zip(sizes, counts):
            sums = {x + a * i for x in sums for i in range(b + 1)}
        assert all(0 <= x <= c for x, c in zip(got, counts))
        assert abs(sum(a * b for a, b in zip(sizes, got)) - budget) <= max(0.5, min(abs(x - budget) for x in sums)) + 1e-9


def test_gray_index_finds_every_pair():
    from lectio.llm.grayindex import close_pairs, gray_rank

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([[np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 5, 12)] for _ in base], dtype=np.uint64)
    prints = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    group = rng.integers(0, 3, len(prints))
    order = np.lexsort((gray_rank(prints), group))
    group, prints = group[order], prints[order][:, None]
    got = {(int(i), int(j)) for a, b in close_pairs(group, prints, 3) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and bin(int(prints[i, 0] ^ prints[j, 0])).count("1") <= 3}
    assert got == want


def test_viterbi_is_best():
    import random

    from lectio.llm.pieces import Encoder

    e = Encoder(open(Q.PIECES, "rb").read())
    score = {w: s for w, (_, s, _) in e.automaton.items()}
    r = random.Random(3)
    for _ in range(60):
        t = "▁" + "".join(r.choice(["the", "a", "é", "▁", "\n", "ing", "漢"]) for _ in range(r.randint(0, 20)))
        best = [0.0]
        for j in range(1, len(t) + 1):
            best.append(max([best[j - 1] + e.unknown] + [best[j - n] + score[t[j - n : j]] for n in range(1, min(j, 20) + 1) if t[j - n : j] in score]))
        total, raw, byte_ids = 0.0, b"", set(e.byte_id)
        for i in e.viterbi(t):
            if i in byte_ids:
                raw += e.bytes[i]
            else:
                total += score[e.bytes[i].decode().replace(" ", "▁")]
        assert abs(total + e.unknown * len(raw.decode()) - best[-1]) < 1e-6


def test_crf_on_held_out_pages():
    from lectio.llm.html_crf import main_text, model, training_set

    m, pages = model(), training_set(200, seed=77)
    right = sum(a == b for page, labels in pages for a, b in zip(m.decode(page), labels))
    assert right / sum(len(labels) for _, labels in pages) > 0.98
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>A title.</h1><p>Some text &amp; more.<p>Next.</article><div class="ad">Buy now.</div><footer>&copy; x</footer></body></html>'
    assert main_text(page, m) == "A title. Some text & more. Next."
