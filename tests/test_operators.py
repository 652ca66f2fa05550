import random

from pyspark.sql import functions as F

from lectio.facade import Corpus
from lectio.operators import collation as C
from lectio.operators import lexicon as L
from lectio.operators import segmentation as G

DDL = "g string, s string, v string, b string, t string, g_ok boolean, s_ok boolean, v_ok boolean"


def test_classifier_rows(spark):
    rows = [
        (("dhamma", "dhamma", "dhamma", None, None), True, ("orthographic", 1.0)),
        ((None, "dhamma", "dhamma", None, None), True, ("pts_omission", 0.8)),
        (("dhamma", None, None, None, None), True, ("pts_addition", 0.7)),
        (("dhammo", "dhamma", "dhamma", None, None), False, ("error", 0.9)),
        (("dhammo", "dhamma", "dhamma", "dhamma", None), False, ("error", 0.95)),
        (("dhammo", "dhamma", "dhamma", "dhamma", "dhamma"), False, ("error", 0.98)),
        (("dhammo", "dhamma", "dhamma", "dhammo", None), False, ("error", 0.85)),
        (("saṅgha", "saṃgha", "saṃgha", None, None), True, ("orthographic", 1.0)),
        (("xx", "dhamma", "dhamma", None, None), True, ("fragment", 0.1)),
    ]
    df = spark.createDataFrame([(*r, ok, True, True) for r, ok, _ in rows], DDL)
    got = [(x["type"], x["confidence"]) for x in C.classify(df).collect()]
    assert got == [want for *_, want in rows]


def test_alignment():
    same = "a b c".split()
    assert all(k == "match" for k, *_ in C.align_words(same, same))
    assert C.align_words(["a", "b", "c", "d"], ["a", "x", "d"]) == [("match", "a", "a", 0, 0), ("variant", "b", "x", 1, 1), ("variant", "c", None, 2, None), ("match", "d", "d", 3, 2)]
    assert C.align_words([], ["x"]) == [("insert", None, "x", None, 0)]
    assert C.align_words([], []) == []


def test_relatedness(spark):
    pairs = [("dhammassa", "dhammaṃ", True), ("buddha", "buddhaṃ", True), ("āyasmā", "pathavī", False), ("ca", "ce", False), ("ca", "mahāparinibbānasutta", False), (None, "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["related"] == r["want"] for r in C.words_related(df, "a", "b").collect())


def test_boundary_splits(spark):
    rules = spark.createDataFrame([("a", "p", "a", "ap", 3), ("a", "b", "", "b", 3), ("h", "u", "ha", "u", 3), ("h", "u", "ha", "u", 3)], "a string, b string, c string, d string, weight int")
    words = spark.createDataFrame([("abhivaggenapi",), ("ab",), ("x",), ("",)], "word string")
    got = {tuple(r) for r in L.boundary_splits(words, rules).collect()}
    assert ("abhivaggenapi", 11, "abhivaggena", "api", 3) in got and ("abhivaggenapi", 11, "abhivaggena", "pi", 1) in got
    assert {r for r in got if r[0] == "ab"} == {("ab", 1, "a", "b", 1)}  # the rule's empty left part drops out
    assert not [r for r in got if r[0] in ("x", "")]


def test_numbering(spark):
    r = random.Random(1)
    raw = [(g, i, r.randint(0, 6)) for g in range(20) for i in range(12)]
    df = spark.createDataFrame(raw, "g int, i int, n int")
    last, want, kept = {}, {}, set()
    high = {}
    for g, i, n in raw:
        last[g] = want[g, i] = max(n, last.get(g, 0) + 1)
        if n > high.get(g, 0):
            high[g] = n
            kept.add((g, i))
    assert {(x.g, x.i): x.repaired for x in G.repaired(df, "g", "i", "n").collect()} == want
    assert {(x.g, x.i) for x in G.rising(df, "g", "i", "n").collect()} == kept


def test_facade(spark):
    rows = [("abc1-20", "kn", 0, "a:0", "Dhammaṃ passati"), ("abc1-20", "kn", 1, "a:1", "so maṃ passati"), ("d1", "dn", 0, "d1:0", "evaṃ me sutaṃ")]
    c = Corpus(spark.createDataFrame(rows, "unit_id string, collection string, seg_ord int, segment_id string, text string"))
    assert c.get_unit("abc5").count() == 2
    assert c.get_segments("abc1-20", "a:0", "a:1").count() == 2 and c.get_segments("abc1-20", "a:1", "a:0").count() == 0 and c.get_segments("abc1-20", "zz", "a:0").count() == 0
    assert [r.segment_id for r in c.search_text("dhammam").collect()] == ["a:0"]
    assert c.search_text('"evam me"').count() == 1 and c.search_text("passati NOT dhammam").count() == 1 and c.search_text('"open').count() == 0
    assert c.search_text("kn").count() == 2  # the collection code is a searched column
    assert "section*{d1}" in c.to_latex("d1") and c.get_text("d1") == "evaṃ me sutaṃ"


def test_readers(spark, tmp_path):
    import json

    from lectio.sources import corpus as S

    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a1.json").write_text(json.dumps({"id": "a1", "segments": [{"id": "a1:0.1", "pali": "T"}, {"id": "a1:1", "pali": "x y"}]}))
    (tmp_path / "u" / "b.json").write_text(json.dumps({"id": "b", "suttas": [{"id": "b1", "segments": []}, {"id": "b2", "segments": [{"id": "b2:1", "pali": "z"}]}]}))
    (tmp_path / "u" / "_index.json").write_text("{}")
    units = S.read_units(spark, str(tmp_path / "u"), "c")
    assert {r.unit_id for r in units.collect()} == {"a1", "b1", "b2"}
    assert S.explode_segments(units).count() == 3
    (tmp_path / "m.json").write_text(json.dumps({"q:0.1": "head", "q:1": "<b>a</b>", "q:2": "{}", "q:3": "b"}))
    assert [r.text for r in S.running_text(S.read_segment_map(spark, str(tmp_path / "m.json"))).collect()] == ["a b"]


def test_streaming(spark, tmp_path):
    from lectio.streaming import postings as P

    docs = spark.createDataFrame([(1, "ab cd\nab", "en", "s", 8)], P.DOCUMENTS)
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        P.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 == P.new_postings(docs).select(F.col("word")).count()
