"""Blank lines between paragraphs are no repeated lines."""

from lectio.llm import quality


def text(paragraphs, varied=True):
    return "\n\n".join(" ".join(f"word{k * varied}of{i}para" for i in range(12)) + f" end{k * varied}" for k in range(paragraphs))


def test_blank_lines_between_paragraphs(spark):
    rows = [(1, text(12)), (2, text(300)), (3, text(12).replace("\n\n", "\n \t\n")), (4, text(12, varied=False))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = {r["doc_id"]: r["bad"] for r in docs.select("doc_id", quality.rule("repeated_lines").alias("bad")).collect()}
    assert rule == {1: False, 2: False, 3: False, 4: True}
    assert {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == [1, 2, 3]
