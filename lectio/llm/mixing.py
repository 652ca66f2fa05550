"""Mixing sources to target weights by fitting subset sums of exact document lengths to a word budget."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows of one (source, size) that a single window partition ranks.
RANKED = 4096
#: Words of the even share that are undone first where the rest cannot be met.
WINDOW = 1 << 16
#: Budgets of up to so many units are met exactly; sums take an eighth of that in bytes.
RESOLUTION = 1 << 30


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from one row per source, ``(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn. ``share`` times all sizes is dealt by
    weight; a target stops at ``most`` times its source's size and the excess goes to the rest by weight.
    That ends where a level L gives every source min(most * size, L * weight), so sources are ordered by the
    level at which they fill up; the first that does not fill sets L. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    ranked = sources.withColumn("place", place)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(full))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))
    first = filled.withColumn("first", F.min(open_).over(whole))
    target = F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    return first.select("source", "source_size", target.alias("target"))


def fit_budget(sizes: list[int], counts: list[int], budget: float) -> list[int]:
    """How many documents of each size to take, at most ``counts``, so that the words come nearest ``budget``.

    The same share of all documents is taken first, spread evenly over the sizes from the largest down, so the
    choice looks like the source and stays below the budget by less than one document. A bounded-knapsack
    dynamic programme over the remaining documents (bit sets of reachable sums, counts split in powers of two)
    fits the rest. Where it finds no sum that is as near as the sizes' common divisor allows, it is run again
    with ``WINDOW`` words of the share undone, then with ever more, at last over all documents and the whole budget.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    near, window, best, best_off = max(0.5, math.gcd(*sizes) / 2), 0, None, math.inf
    while True:
        take = _even_share(sizes, counts, max(0.0, budget - window) / total if total else 0.0)
        rest = budget - sum(s * t for s, t in zip(sizes, take))
        found, off = _knapsack(sizes, [c - t for c, t in zip(counts, take)], rest)
        if off < best_off:
            best, best_off = [t + f for t, f in zip(take, found)], off
        if best_off <= near + 1e-6 or not any(take):
            return best
        window = 4 * window or WINDOW


def _even_share(sizes: list[int], counts: list[int], part: float) -> list[int]:
    """``part`` of all documents with a word: of the ``k`` largest always the whole part of ``part * k``."""
    take, seen = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i]:
            take[i] = int(part * (seen + counts[i])) - int(part * seen)
            seen += counts[i]
    return take


def _knapsack(sizes: list[int], counts: list[int], budget: float) -> tuple[list[int], float]:
    """Bounded-knapsack choice whose sum comes nearest ``budget``, and how far off it is.

    Reachable sums are the bits of one number, in units of the sizes' common divisor; counts are split in powers
    of two. Budgets of over ``RESOLUTION`` units are met to a unit of that share of the budget.
    """
    take = [0] * len(sizes)
    unit = max(math.gcd(*sizes), 1) if sizes else 1
    unit *= max(1, math.ceil(budget / unit / RESOLUTION))
    goal = max(0, int(budget / unit + 0.5))
    items: list[tuple[int, int, int]] = []
    full, reach = (1 << (goal + max(sizes, default=0) // unit + 1)) - 1, 1
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        left, n, size = counts[i], 1, (2 * sizes[i] + unit) // (2 * unit)
        while sizes[i] and left and not reach >> goal & 1:
            now = min(n, left)
            items.append((i, now, size * now))
            reach |= reach << size * now & full
            left -= now
            n *= 2
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> goal
    over = goal + (above & -above).bit_length() - 1 if above else at
    if abs(over * unit - budget) < abs(at * unit - budget):
        at = over
    for i, n in _chosen(items, at):
        take[i] += n
    return take, abs(sum(s * t for s, t in zip(sizes, take)) - budget)


def _chosen(items: list[tuple[int, int, int]], goal: int) -> list[tuple[int, int]]:
    """``(size's number, documents)`` of items that sum to a reachable ``goal``.

    The two halves of the items are searched from 0 up and from the goal down; where they meet, the goal is split.
    So the sums before each item need not be kept.
    """
    work, out = [(items, goal)], []
    while work:
        items, goal = work.pop()
        if not goal:
            continue
        if len(items) == 1:
            out.append(items[0][:2])
            continue
        half = len(items) // 2
        up, down, full = 1, 1 << goal, (1 << (goal + 1)) - 1
        for _, _, size in items[:half]:
            up |= up << size & full
        for _, _, size in items[half:]:
            down |= down >> size
        met = (up & down).bit_length() - 1
        work += [(items[:half], met), (items[half:], goal - met)]
    return out


def _plan(sizes: DataFrame) -> DataFrame:
    """``(source, size, n, base, extra, source_size, target)``: copies that all documents of a source and size get, and how many of them get one more."""
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sources)
    joined = counted.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        base = int(target // whole) if whole else 0
        extra = fit_budget(rows["size"].tolist(), rows["n"].tolist(), target - base * whole) if whole else [0] * len(rows)
        return rows.assign(base=base, extra=extra)

    return joined.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, base long, extra long")


def mix(df: DataFrame, size: Column, source_col: str = "source", order_cols: tuple[str, ...] = ("doc_id",), seed: int = 17) -> DataFrame:
    """``df`` with ``size, source_size, target, copies``: how often the mix takes each row, 0 to 2 times.

    Documents of one source and size are interchangeable for the budget; those of least seeded hash of
    ``order_cols`` are chosen, so reruns agree. Rows that agree in all of ``order_cols`` are told apart by nothing
    that matters. Hashes alone are ranked, a large (source, size) group in buckets of about ``RANKED`` rows, each
    with its own share of the places, so that no window partition grows with the data; the rows themselves meet
    only the greatest hash that is taken. A null source is a source of its own; null ids and sizes of 0 are ranked
    like any other; an empty table stays empty. Columns of ``df`` named as a result are replaced by it, other
    columns may have any names but ``__``-led ones.
    """
    sized = df.withColumn("__size", size).withColumn("__h", F.xxhash64(F.lit(seed), *order_cols)).withColumn("__src", F.col(source_col))
    hashes = scratch.cut(sized.select("__src", "__size", "__h"), "hashes")
    plan = scratch.cut(_plan(hashes.select(F.col("__src").alias("source"), F.col("__size").alias("size"))), "plan")
    names = {"source": "__of", "size": "__s", "n": "__n", "base": "__base", "extra": "__extra", "source_size": "__total", "target": "__target"}
    plan = plan.withColumnsRenamed(names).withColumn("__buckets", F.ceil(F.col("__n") / RANKED).cast("long"))
    same = F.col("__src").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__s"))
    some = hashes.join(plan.where("__extra > 0 and __extra < __n"), same).select("__of", "__s", "__h", "__extra", F.pmod("__h", "__buckets").alias("__b"))
    group = ["__of", "__s", "__b"]
    counts = some.groupBy(*group).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__of", "__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias(f"{c}2") for c in group], F.coalesce(before, F.lit(0)).alias("__before"))
    placed = some.join(counts, F.col("__of").eqNullSafe(F.col("__of2")) & (F.col("__s") == F.col("__s2")) & (F.col("__b") == F.col("__b2")))
    placed = placed.withColumn("__nth", F.row_number().over(Window.partitionBy(*group).orderBy("__h")) + F.col("__before"))
    equal = Window.partitionBy(*group, "__h")
    placed = placed.withColumn("__few", F.col("__extra") - F.min("__nth").over(equal) + 1).withColumn("__many", F.count("*").over(equal))
    # rows come in order of bucket, then hash: the last one taken tells which are, but for rows of its own hash
    last = placed.where(F.col("__nth") == F.col("__extra")).select(F.col("__of").alias("__of2"), F.col("__s").alias("__s2"), F.col("__b").alias("__last"), F.col("__h").alias("__top"), "__few", "__many")
    ends = scratch.cut(plan.join(last, F.col("__of").eqNullSafe(F.col("__of2")) & (F.col("__s") == F.col("__s2")), "left").drop("__of2", "__s2"), "ends")
    met = sized.join(ends, same).withColumn("__b", F.pmod("__h", "__buckets"))
    at_end = F.coalesce((F.col("__b") == F.col("__last")) & (F.col("__h") == F.col("__top")), F.lit(False))
    inside = F.when(F.col("__last").isNull(), F.col("__extra") > 0).otherwise(at_end | (F.struct("__b", "__h") < F.struct("__last", "__top")))
    met = met.withColumn("__in", inside)
    if not ends.where("__few < __many").isEmpty():
        tied = at_end & (F.col("__few") < F.col("__many"))
        nth = F.row_number().over(Window.partitionBy("__src", "__size", "__h").orderBy(*order_cols))
        met = met.where(~tied).unionByName(met.where(tied).withColumn("__in", nth <= F.col("__few")))
    results = {"size": F.col("__size"), "source_size": F.col("__total"), "target": F.col("__target"), "copies": F.col("__base") + F.col("__in").cast("long")}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in results], *[c.alias(k) for k, c in results.items()])
