from pyspark.sql import functions as F

from lectio.functions import text as T


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first()["x"]


def test_tokenizers(spark):
    assert one(spark, T.tokens(F.col("t")), t="Evaṃ me SUTAṂ, 12 saṁgha") == ["evaṃ", "me", "sutaṃ", "sa", "gha"]
    assert one(spark, T.count_tokens(F.col("t")), t="Evaṃ SUTAṂ") == 2
    assert one(spark, T.strip_tokens(F.col("t")), t="<b>saṁ</b>gha") == ["saṃ", "gha"]
    assert one(spark, T.collation_tokens(F.col("t")), t="Saṅgha-vagga *x") == ["saṃghavagga", "x"]
    assert one(spark, T.tokens(F.col("t")), t="") == []
    assert one(spark, T.tokens(F.col("t")), t=None) is None
    assert [tuple(r) for r in one(spark, T.token_offsets(F.col("t")), t=" ab, c")] == [("ab", 1), ("c", 5)]


def test_keys(spark):
    assert one(spark, T.comparison_key(F.col("t")), t="Saṅghaṁ") == "saṃghaṃ"
    assert one(spark, T.comparison_key(F.col("t")), t=None) == ""
    assert one(spark, T.title_key(F.col("t")), t="Paṭhama Abc Suttaṃ") == "abc"
    assert one(spark, T.escape_latex(F.col("t")), t="a\\b{_") == r"a\textbackslash{}b\{\_"
    assert one(spark, T.is_verse(F.col("t")), t="a, b; c") is True
    assert one(spark, T.roman_value(F.col("t")), t="XIV") == 14


def test_ranges(spark):
    inside = T.in_range(F.col("u"), F.col("s"))
    for u, s, want in (("abc5", "abc1-20", True), ("abc20", "abc1-20", True), ("abc21", "abc1-20", False), ("xyz5", "abc1-20", False), ("abc5", "abc5", False)):
        assert one(spark, inside, u=u, s=s) is want
