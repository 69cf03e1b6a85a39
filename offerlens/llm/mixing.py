"""Mixing sources to target weights by subset-sum fitting of word budgets.

A source's target is its share of all words by weight, at most a fixed multiple of what it has. Whole passes
over the source come first; what is left of the target is a subset-sum problem over its documents. Documents
are counted by exact length; a like share of each length is taken outright, the longest first close the gap to
a few thousand words, and bounded-knapsack dynamic programming over the documents left fits the rest, to the
word if that can be. Which documents of a length are taken is settled by a seeded hash, spread over salts so
that no group of documents of one source and length is ranked in one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, stored

#: Documents for which a source and length gets one more salt, and the salts there are at least.
SALTED, SALTS = 1_000_000, 64
#: Words that the dynamic programme fits at the end.
FITTED = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from sizes (source, source_size), one row each.

    Sources in order of size over weight fill up first. With those before it full, a source is full too if its
    part of what is left would reach its bound; as full ones are first in that order, running sums tell all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    df = df.withColumn("bound", (most * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    df = df.withColumn("left", F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))).withColumn("weights_left", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("full", F.col("bound") * F.col("weights_left") <= F.col("left") * F.col("weight"))
    rate = F.max(F.when(~F.col("full"), F.struct((-(F.col("bound") / F.col("weight"))).alias("k"), (F.col("left") / F.col("weights_left")).alias("rate")))).over(everything)
    target = F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * rate["rate"])
    return df.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near the budget as can be found."""
    taken = np.zeros(len(lengths), np.int64)
    total = int(lengths @ counts)
    if budget <= 0 or not total:
        return taken
    taken = (counts.astype(object) * max(0, budget - FITTED) // total).astype(np.int64) if budget < total else counts.copy()
    left = budget - int(lengths @ taken)
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and left > FITTED:
            more = min(int(counts[i] - taken[i]), max(0, left - FITTED) // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
    if 0 < left <= 8 * FITTED:
        taken += knapsack(lengths, counts - taken, left)
    return taken if int(lengths @ taken) == budget else coarse(lengths, counts, taken, budget)


def coarse(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int) -> np.ndarray:
    """Where the budget could not be hit to the word, as it can't with few and very long documents: the nearest total of
    what is taken, that and the one document nearest to the gap, and a knapsack over all documents in units of several words."""
    off = lambda t: abs(budget - int(lengths @ t))
    more = taken.copy()
    free = np.flatnonzero((counts > taken) & (lengths > 0))
    if len(free):
        more[free[np.argmin(np.abs(lengths[free] - (budget - int(lengths @ taken))))]] += 1
    unit = -(-budget // (8 * FITTED))
    scaled = knapsack((lengths + unit // 2) // unit, counts, -(-budget // unit))
    left = budget - int(lengths @ scaled)
    if 0 < left <= 8 * FITTED:
        scaled += knapsack(lengths, counts - scaled, left)
    return min((taken, more, scaled), key=off)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: documents whose words sum to the reachable number nearest to the budget (the smaller of two).

    Sums are in units of the lengths' common divisor. Each is kept with the length that first reached it and how many
    documents that took, so memory goes with the budget, not with the number of lengths. Lengths are added from the
    commonest on until the multiple nearest to the budget is hit."""
    out = np.zeros(len(lengths), np.int64)
    useful = np.flatnonzero((counts > 0) & (lengths > 0) & (lengths <= 2 * budget))
    if not len(useful):
        return out
    unit = int(np.gcd.reduce(lengths[useful]))
    aim = (budget + (unit - 1) // 2) // unit  # the nearest multiple, the smaller of two
    top = 2 * aim + 2
    step, copies_at = np.full(top, -1, np.int32), np.zeros(top, np.int32)  # the length that first reached a sum, and how many of it
    step[0] = 0
    steps = useful[np.argsort(-counts[useful], kind="stable")]
    for number, i in enumerate(steps, 1):
        n, have = int(lengths[i]) // unit, step >= 0
        if n >= top:
            continue
        # Along each residue of the length, a new sum is reached from the last old one at most counts[i] steps back.
        rows = -(-top // n)
        grid = np.zeros(rows * n, bool)
        grid[:top] = have
        grid = grid.reshape(rows, n)
        last = np.maximum.accumulate(np.where(grid, np.arange(rows, dtype=np.int32)[:, None], -1), axis=0)
        copies = np.where(last >= 0, np.arange(rows, dtype=np.int32)[:, None] - last, 0).ravel()[:top]
        new = ~have & (copies > 0) & (copies <= counts[i])
        step[new], copies_at[new] = number, copies[new]
        if step[aim] >= 0:
            break
    sums = np.flatnonzero(step >= 0)
    at = int(sums[np.argmin(np.abs(sums * unit - budget))])
    while at:
        i = steps[step[at] - 1]
        out[i] += copies_at[at]
        at -= int(copies_at[at]) * (int(lengths[i]) // unit)
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes) and copies of every row, then the carried columns.

    A null source is a source of its own, the last. Null and blank texts have size 0 and are taken in whole
    passes only, which adds nothing. Rows of equal id, source and text are alike; which of them is taken more
    often makes no difference to the result. An empty table gives no rows; other columns are not read. Per
    source, one task holds the counts by length, whose number the longest document bounds.
    """
    extra = [f"x{i}" for i in range(len(carry))]
    docs = pick(docs, doc_id=id_col, text=text_col, source=source_col, **dict(zip(extra, carry)))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rank = F.xxhash64(F.lit(seed), "doc_id", "source", "text")
    sized = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), rank.alias("rank"), *extra))
    sized = sized.withColumn("salt", F.pmod("rank", F.lit(max(SALTS, sized.count() // SALTED))).cast("int"))
    counts = stored(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    targets = stored(source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))

    def plan(table: pa.Table) -> pa.Table:
        source_size, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        passes = min(most, int(target) // source_size) if source_size else 0
        order = np.argsort(table["size"].to_numpy(), kind="stable")
        lengths, counts = table["size"].to_numpy()[order], table["n"].to_numpy()[order]
        budget = int(round(target)) - passes * source_size if passes < most else 0
        extra = fit(lengths, counts, budget)
        same = lambda x, kind: pa.array([x] * len(lengths), kind)
        return pa.table({"source": table["source"].take(pa.array(order)), "size": lengths, "passes": same(passes, pa.int64()), "extra": extra, "source_size": same(source_size, pa.int64()), "target": same(target, pa.float64())})

    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    joined = lengths.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plans = joined.groupBy("source").applyInArrow(plan, "source string, size long, passes long, extra long, source_size long, target double")
    # Salts of a length are served one after another, so a document's rank within its salt decides.
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quotas = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"source": "s", "size": "z"})
    quotas = quotas.join(plans, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")))
    quotas = quotas.select("s", "z", F.col("salt").alias("q"), "passes", "source_size", "target", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("quota"))
    ranked = sized.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("rank", "doc_id")))
    found = ranked.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("q")))
    copies = F.col("passes") + (F.col("place") <= F.col("quota")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(F.col(x).alias(c) for x, c in zip(extra, carry)))
