"""Places in long texts, the matrix export beyond a pivot's limit, and shares of books."""

import random
import re
import time

from lectio.functions import text as T
from lectio.operators import segmentation, vocabulary
from lectio.sinks import exports


def test_places_of_many_tokens(spark):
    text = "; ".join(f"word{'abc'[k % 3]} x" for k in range(16_000))
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "none")], "unit_id long, text string")
    began = time.perf_counter()
    rows = {r["unit_id"]: r["o"] for r in frame.select("unit_id", T.token_offsets(frame["text"]).alias("o")).collect()}
    assert time.perf_counter() - began < 20
    assert [(o["token"], o["start"]) for o in rows[1]] == [(m[0], m.start()) for m in re.finditer(f"[{T.LETTERS}]+", text)]
    assert rows[2] == [] and rows[3] is None and [tuple(o) for o in rows[4]] == [("none", 0)]
    found = segmentation.markers(frame, r"word([abc])").where("unit_id = 1").orderBy("nth").collect()
    assert [(m["start"], m["value"]) for m in found] == [(m.start(), m[1]) for m in re.finditer(r"word([abc])", text)]


def test_matrix_of_many_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "BLOCK", 3)
    rows = [(u, w) for u in ("a", "b") for w in ("p", "q", "r", "s", "t")] + [("a", "p"), ("c", "z")]
    exports.matrix_csv(spark.createDataFrame(rows, "unit_id string, word string"), f"{tmp_path}/m")
    first, second = (spark.read.option("header", True).csv(f"{tmp_path}/m/terms-0000{k}").orderBy("unit_id") for k in (0, 1))
    assert first.columns == ["unit_id", "p", "q", "r"] and second.columns == ["unit_id", "s", "t"]
    assert [tuple(r) for r in first.collect()] == [("a", "2", "1", "1"), ("b", "1", "1", "1"), ("c", "0", "0", "0")]


def test_shares_of_a_book(spark):
    toks = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), (None, "a")], "collection string, word string")
    got = {(r["collection"], r["word"]): (r["n"], r["total"], r["freq"]) for r in vocabulary.term_share(toks).collect()}
    assert got == {("x", "a"): (2, 3, 2 / 3), ("x", "b"): (1, 3, 1 / 3), (None, "a"): (1, 1, 1.0)}


def test_written_shares_round_as_c_does(spark):
    toks = spark.range(2048).selectExpr("'x' as collection", "concat('w', greatest(id, 3)) as word")
    got = {r["word"]: r["freq"] for r in exports.long_table(toks).collect()}
    assert got["w4"] == "0.0004882812" and got["w3"] == "0.0019531250"  # 1 / 2048 is a tie of ten places
    random.seed(5)
    totals = [2**a * 5**b for a in range(30) for b in range(12) if 1 < 2**a * 5**b < 2**40]
    shares = [0.0, 1.0, 0.5e-10, 1.5e-10, 1 - 0.5e-10, 1 - 2**-53, 2**-33, 2**-34, 2**-60]
    for _ in range(20_000):
        total = random.choice(totals) if random.random() < 0.7 else random.randint(1, 10**9)
        shares.append(random.randint(1, total if random.random() < 0.5 else min(total, 3000)) / total)
    rows = spark.createDataFrame([(x,) for x in shares], "x double")
    wrong = [(r["x"], r["s"]) for r in rows.select("x", exports.ten_places(rows["x"]).alias("s")).collect() if r["s"] != "%.10f" % r["x"]]
    assert wrong == []
