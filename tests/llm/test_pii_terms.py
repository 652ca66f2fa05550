"""Terms that disclose an entity of a single document."""

from lectio.llm import pii


def test_entity_of_one_document_is_judged(spark):
    rows = [(1, "please write to the zanzibar office at jo@example.com today")]
    rows += [(k, "please write to the office today and at noon") for k in range(2, 40)]
    found = {r["id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(rows[0][1][t["start"] : t["end"]], t["removed"]) for t in found[1]["terms"]] == [("zanzibar", True)]
    assert all(not found[k]["terms"] for k in range(2, 40))
