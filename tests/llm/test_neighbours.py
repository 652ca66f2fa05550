"""Neighbours against the exact inner products of all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lectio.llm import neighbours
from lectio.llm import queries as Q


def truth(ids, v, k=20):
    """``{query_id: [(vec_id, score)]}``, nearest first, ties to the smaller id."""
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("d,nd->n", v[i], v)
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in best if score[j] > -np.inf]
    return out


def answer(spark, at):
    out = {}
    for r in Q.op3_neighbours(spark, at).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    at = f"/root/testdata/{sf}"
    table = pq.read_table(f"{at}/embeddings.parquet")
    ids, v = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    want, got = truth(ids, v), answer(spark, at)
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(found) >= 0.9
    place = {int(i): n for n, i in enumerate(ids)}
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len({i for i, _ in rows}) == 20 and q not in {i for i, _ in rows}
        assert all(abs(s - v[place[q]] @ v[place[i]]) < 1e-12 for i, s in rows)


def test_copies_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Ninety copies of one vector, ids that repeat with other vectors, small blocks: ties go to the smallest ids."""
    monkeypatch.setattr(neighbours, "VECTORS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    r = np.random.default_rng(3)
    one = r.normal(size=8).astype(np.float32)
    rows = [(i, (one if i < 90 else r.normal(size=8)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(40, one.tolist()), (100, rows[150][1]), (7, None), (160, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = answer(spark, str(tmp_path))
    for q in (0, 20, 60, 80):
        assert [i for i, _ in got[q]] == [i for i in range(22) if i != q][:20]
    # row 40 has an equal row of its own id, which is a candidate; both lie beyond the first 20
    assert [i for i, _ in got[40]] == list(range(20)) and got.keys() == set(range(0, 200, 20))


def test_few(spark, tmp_path):
    spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert answer(spark, str(tmp_path)) == {20: [(1, 2.0), (2, 0.0)]}
