"""What the search for disclosing terms sends across the cluster."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectio.llm import pii, sketch


def test_words_that_disclose_nothing_are_not_shuffled(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choices(VOCABULARY, k=300))) for k in range(2000)]
    rows += [(k, "please write to the zanzibar office at jo@example.com today") for k in range(2000, 2004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    docs.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    words = pii.keyed(docs, "doc_id", "text").select("id", "mark", F.explode(pii._terms(F.col("text"))).alias("t"))
    began = written()
    words.repartition("t").foreach(lambda r: None)
    whole = written() - began
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        found = {r["id"]: [t["value"] for t in r["terms"]] for r in pii.detect(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        docs.unpersist()
    # the texts and the counts of terms are, and were before
    assert written() - began < whole and whole > 0
    assert all(found[k] == ["zanzibar"] for k in range(2000, 2004)) and not any(found[k] for k in range(2000))


VOCABULARY = sorted({"".join(random.Random(k).choices("abcdefghiklmnoprstuw", k=7)) for k in range(3000)}) + ["please", "write", "the", "office", "today"] * 20


def test_a_member_table_agrees_with_the_sketch(spark):
    ids = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    some = ids.where("h % 7 = 0")
    got = {r["h"] for r in sketch.only_members(ids, sketch.member_table(some), F.col("h")).collect()}
    h = np.array([r["h"] for r in ids.collect()])
    assert got == set(h[sketch.may_hold(sketch.members(some), h.view(np.uint64))].tolist()) and {r["h"] for r in some.collect()} <= got
    assert sketch.only_members(ids, sketch.member_table(some.where("false")), F.col("h")).count() == 0
