"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import per_batch, utf8
from .html_blocks import blocks, features
from .html_pages import SKIP, TAKE, labelled

#: Labelled pages that the model is trained on, rounds of training, and the seed: fixed, whatever the data.
PAGES, ROUNDS, SEED = 700, 6, 5


def training_set(pages: int = PAGES, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels (1: main text) of the blocks of generated pages."""
    r, out = random.Random(seed), []
    for _ in range(pages):
        found = blocks(labelled(r))
        labels = [int(TAKE in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(SKIP, "").replace(TAKE, "") or "-"
        if found:
            out.append((features(found), labels))
    return out


class Model:
    """Weights of features for label 1 against 0, and of transitions."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = np.zeros((2, 2))

    def scores(self, page: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in block]) for block in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The labels of greatest total score."""
        (a, b), (c, d) = self.step.tolist()
        zero = one = 0.0
        back = []
        for k, u in enumerate(self.scores(page)):
            if k:
                from0 = (zero + a >= one + c, zero + b >= one + d)
                zero, one = max(zero + a, one + c), max(zero + b, one + d) + u
                back.append(from0)
            else:
                one = u
        at = int(one > zero)
        out = [at] if page else []
        for from0 in reversed(back):
            at = 0 if from0[at] else 1
            out.append(at)
        return out[::-1]


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def train(data: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad on the exact gradient of each page (forward and backward sums)."""
    m = Model()
    seen: dict[str, float] = {}
    seen_step = np.full((2, 2), 1e-2)
    for _ in range(rounds):
        for page, labels in data:
            u, step = m.scores(page), m.step.tolist()
            n = len(u)
            ahead = [(0.0, u[0])]
            for k in range(1, n):
                z, o = ahead[-1]
                ahead.append((_add(z + step[0][0], o + step[1][0]), _add(z + step[0][1], o + step[1][1]) + u[k]))
            behind = [(0.0, 0.0)]
            for k in range(n - 1, 0, -1):
                z, o = behind[-1]
                behind.append((_add(step[0][0] + z, step[0][1] + u[k] + o), _add(step[1][0] + z, step[1][1] + u[k] + o)))
            behind.reverse()
            total = _add(*ahead[-1])
            slope = np.zeros((2, 2))
            for k in range(n):
                off = labels[k] - math.exp(ahead[k][1] + behind[k][1] - total)
                if k:
                    slope[labels[k - 1], labels[k]] += 1
                    for i in (0, 1):
                        for j in (0, 1):
                            slope[i, j] -= math.exp(ahead[k - 1][i] + step[i][j] + (u[k] if j else 0.0) + behind[k][j] - total)
                for f in page[k]:
                    w = m.weight.get(f, 0.0)
                    g = off - decay * w
                    s = seen[f] = seen.get(f, 1e-2) + g * g
                    m.weight[f] = w + rate * g / math.sqrt(s)
            seen_step += slope**2
            m.step += rate * slope / np.sqrt(seen_step)
    return m


@lru_cache(maxsize=1)
def model() -> Model:
    """The trained model; the same weights in every session."""
    return train(training_set())


def main_text(page: str, m: Model) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, m.decode(features(found))) if keep)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` (a long id and a string) and ``text``, the main text of each whole page; null or blockless: empty.

    Bytes that are no UTF-8 are read with replacement characters. The trained weights go to the tasks once.
    """
    held = df.sparkSession.sparkContext.broadcast(model())
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def make(batch):
        m = held.value
        return {"id": batch.column(0), "url": batch.column(1), "text": [main_text(x.as_py().decode("utf-8", "replace"), m) for x in batch.column(2)]}

    rows = df.select(F.col(keep[0]).cast("long").alias("id"), F.col(keep[1]).cast("string").alias("url"), utf8(html_col).alias("html"))
    return rows.mapInArrow(per_batch(make, schema), "id long, url string, text string").select(F.col("id").alias(keep[0]), F.col("url").alias(keep[1]), "text")
