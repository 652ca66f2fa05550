"""Near copies against a comparison of every text with all others."""

import random

from lectio.llm.simhash import keep_one

N = 100


def texts():
    """Planted groups of texts with whole runs of words replaced, so that the similarity falls step by step through 0.8."""
    r = random.Random(5)
    out = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(N)]
        out.append(base)
        for changed in r.sample(range(1, 30), 6):
            cut = r.randint(0, N - changed)
            out.append(base[:cut] + [f"x{r.random()}" for _ in range(changed)] + base[cut + changed :])
    shared = [f"s{i}" for i in range(60)]
    out += [shared + [f"t{g}u{i}" for i in range(r.randint(5, 60))] for g in range(40)]
    out += [["only", "three", "words"], ["Only", "Three", "words"], [], []]
    r.shuffle(out)
    return [" ".join(w) for w in out]


def brute(docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in docs]
    label = list(range(len(sets)))
    for y in range(len(sets)):
        for x in range(y):
            both = len(sets[x] & sets[y])
            if 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = [low if k == high else k for k in label]
    return sorted(set(label))


def test_planted_groups(spark):
    docs = texts()
    want = brute(docs)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in keep_one(frame).collect())
    assert got == want and 100 < len(want) < len(docs) - 30
