"""Filling containers of fixed capacity with items (problem 8).

*Hierarchical multi-length packing.*  Items are routed to tiers by size (long: over half the capacity, then
a quarter, then the rest).  Tiers are packed from the longest down; the gap a container still has is filled
from its own and then from shorter tiers, the best fitting size first, with a look-ahead for two sizes that
fill it exactly.  The result names the tier.  Containers are put into step groups of equal count whose loads are balanced by dealing them
in snake order of load.

Sizes are whole numbers no larger than the capacity, so the *plan* is made from the histogram of sizes: at
most ``capacity`` numbers reach the driver, whatever the number of items.  A plan step says "this many
containers, each with these sizes"; as every step uses up at least one size, there are at most ``capacity``
steps.  Each item then finds its place from its rank among the items of its size.  A size with more than
``per_bucket`` items is dealt to as many hash buckets as it takes (a row number inside each bucket, plus the count in
the buckets before), so a size that a third of all items have is never ranked in one task, and what reaches the
driver is one row per size and per ``per_bucket`` items.

Defined cases: items with null size take no part; size 0 is an item like any other and takes no room; an item
above the capacity is split into full containers and one remainder (the only items ever split); equal sizes
are placed in order of bucket and key; repeated rows of one key count once (largest size); an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Items of one size that are ranked together, and containers of a step group.
PER_BUCKET, GROUP = 1_000_000, 8


def tier_of(size: int, capacity: int) -> int:
    """0: over half the capacity, 1: over a quarter, 2: the rest."""
    return 0 if 2 * size > capacity else 1 if 4 * size > capacity else 2


def _best_fit(tiers: list[list[int]], left: dict[int, int], inside: dict[int, int], gap: int, first: int) -> tuple[int, int] | None:
    """(tier, place) of the greatest size that fits the gap and has items left, from the own tier on to shorter ones."""
    for t in range(first, len(tiers)):
        i = bisect_right(tiers[t], gap) - 1
        while i >= 0 and left[tiers[t][i]] <= inside.get(tiers[t][i], 0):
            i -= 1
        if i >= 0:
            return t, i
    return None


def _exact_pair(tiers: list[list[int]], left: dict[int, int], inside: dict[int, int], gap: int, t: int, i: int) -> int | None:
    """The greater of two sizes that fill the gap exactly, looked for from place i of tier t on to shorter ones."""
    for own in (tiers[t][: i + 1], *tiers[t + 1 :]):
        for a in reversed(own):
            b = gap - a
            if a < b:
                return None
            if b in left and left[a] >= inside.get(a, 0) + 1 + (a == b) and left[b] >= inside.get(b, 0) + 1 + (a == b):
                return a
    return None


def plan_packing(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, list[tuple[int, int]]]], int]:
    """Steps (first container, containers, [(size, items per container)]) and the number of containers.

    ``sizes``: items of each size from 1 to ``capacity``.  Uses every item exactly once.  The tier of a step is
    that of its first, greatest size.
    """
    left = {s: n for s, n in sizes.items() if n > 0 and s > 0}
    tiers: list[list[int]] = [[], [], []]  # sizes still available, by tier
    for s in sorted(left):
        tiers[tier_of(s, capacity)].append(s)
    steps, base = [], 0
    for tier, own in enumerate(tiers):
        while own:
            inside: dict[int, int] = {own[-1]: 1}
            gap = capacity - own[-1]
            while gap > 0 and (found := _best_fit(tiers, left, inside, gap, tier)):
                t, i = found
                s = tiers[t][i]
                least = next(x[0] for x in reversed(tiers) if x)
                if s < gap and gap - s < least:  # nothing would fit beside it: look for two that fill the gap exactly
                    s = _exact_pair(tiers, left, inside, gap, t, i) or s
                inside[s] = inside.get(s, 0) + 1
                gap -= s
            times = min(left[s] // m for s, m in inside.items())
            steps.append((base, times, sorted(inside.items(), reverse=True)))
            base += times
            for s, m in inside.items():
                left[s] -= m * times
                if not left[s]:
                    del left[s]
                    sizes_of = tiers[tier_of(s, capacity)]
                    del sizes_of[bisect_right(sizes_of, s) - 1]
    return steps, base


def _tables(steps, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: ascending first ranks, items per container, first container of each run."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for base, times, inside in steps:
        for s, m in inside:
            at = used.get(s, 0)
            rows.setdefault(s, []).append((at, m, base))
            used[s] = at + m * times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


def _loads(steps, total: int, group: int) -> tuple[np.ndarray, int]:
    """Step group of every run's containers is computed from their place in order of load; this gives the places."""
    loads = sorted(range(len(steps)), key=lambda i: (-sum(s * m for s, m in steps[i][2]), -sum(m for _, m in steps[i][2]), i))
    place = np.zeros(len(steps), np.int64)
    at = 0
    for i in loads:
        place[i] = at
        at += steps[i][1]
    return place, max(1, -(-total // group))


def pack(sized: DataFrame, key: str, size: str, capacity: int, *, per_bucket: int = PER_BUCKET, group: int = GROUP) -> DataFrame:
    """(key, piece BIGINT, size BIGINT, start BIGINT, container BIGINT, step_group BIGINT, tier INT): one row per piece.

    ``start`` is the piece's offset inside its item; only items above ``capacity`` have more than one piece.
    ``tier`` is that of the container: of its greatest size (see :func:`tier_of`).
    ``sized`` should be cheap to read twice (a written table); see the module for the defined cases.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = (
        sized.where(F.col(size).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k")).agg(F.max(size).cast("bigint").alias("n"))
        .withColumn("full", F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / F.lit(capacity)).cast("bigint"))
        .withColumn("last", F.col("n") - F.col("full") * capacity)
    )
    items = cut_lineage(items)
    hot = {r["last"]: -(-r["c"] // per_bucket) for r in items.groupBy("last").agg(F.count(F.lit(1)).alias("c")).collect() if r["c"] > per_bucket}
    several = F.create_map(*[F.lit(x).cast("bigint") for kv in hot.items() for x in kv]) if hot else None
    items = items.withColumn("bucket", F.pmod(F.xxhash64("k"), F.coalesce(F.try_element_at(several, F.col("last")), F.lit(1))).cast("int") if hot else F.lit(0))
    # at most one row per size and one per full bucket
    counts = items.groupBy("bucket", "last").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f"))
    seen = counts.toPandas()
    histogram = {int(s): int(c) for s, c in seen.groupby("last")["c"].sum().items()}
    steps, total = plan_packing(histogram, capacity)
    full_total = int(seen["f"].sum()) if len(seen) else 0
    seen = seen.sort_values(["last", "bucket"])
    seen["before"] = seen.groupby("last")["c"].cumsum() - seen["c"]
    seen["full_before"] = seen["f"].cumsum() - seen["f"]
    offsets = {(int(b), int(s)): (int(x), int(y)) for b, s, x, y in seen[["bucket", "last", "before", "full_before"]].itertuples(index=False)}
    tables = _tables(steps, capacity)
    place, groups = _loads(steps, total + full_total, group)
    bases = np.array([s[0] for s in steps], np.int64)
    tiers = np.array([tier_of(s[2][0][0], capacity) for s in steps] or [tier_of(0, capacity)], np.int32)
    shared = items.sparkSession.sparkContext.broadcast((tables, offsets, place, bases, tiers))

    w = Window.partitionBy("bucket", "last").orderBy("k")
    ranked = items.withColumn("rank", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("full_rank", F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, offsets, place, bases, tiers = shared.value
        for pdf in batches:
            n = len(pdf)
            last, full = pdf["last"].to_numpy(), pdf["full"].to_numpy()
            off = np.array([offsets[x] for x in zip(pdf["bucket"].tolist(), last.tolist())], np.int64).reshape(n, 2)
            rank, first = pdf["rank"].to_numpy() + off[:, 0], pdf["full_rank"].to_numpy() + off[:, 1]
            container = np.zeros(n, np.int64)
            for s in np.unique(last):
                at = np.flatnonzero(last == s)
                if s == 0:
                    continue  # no room needed: container 0
                lo, m, base = tables[int(s)]
                i = np.searchsorted(lo, rank[at], side="right") - 1
                container[at] = base[i] + (rank[at] - lo[i]) // m[i]
            run = np.maximum(np.searchsorted(bases, container, side="right") - 1, 0)
            spot = (place[run] + container - bases[run] if len(bases) else container) + full_total  # full containers bear the greatest load
            out = [pd.DataFrame({"k": pdf["k"], "piece": full, "size": last, "start": full * capacity, "container": container + full_total, "spot": spot, "tier": tiers[run]})]
            if full.any():
                own = np.repeat(np.arange(n), full)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
                at = first[own] + piece
                out.append(pd.DataFrame({"k": pdf["k"].to_numpy()[own], "piece": piece, "size": capacity, "start": piece * capacity, "container": at, "spot": at, "tier": np.int32(0)}))
            res = pd.concat(out)
            row, col = res["spot"] // groups, res["spot"] % groups
            res["step_group"] = np.where(row % 2 == 0, col, groups - 1 - col)
            yield res[["k", "piece", "size", "start", "container", "step_group", "tier"]]

    kind = sized.schema[key].dataType.simpleString()
    packed = ranked.mapInPandas(assign, f"k {kind}, piece bigint, size bigint, start bigint, container bigint, step_group bigint, tier int")
    return packed.withColumnRenamed("k", key)


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, pieces, used, capacity, fill DOUBLE): how full the containers are; no rows give zeros and null fill."""
    c = F.count_distinct("container")
    return packed.agg(
        c.alias("containers"), F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"),
        F.lit(capacity).cast("bigint").alias("capacity"), F.when(c > 0, F.sum("size") / (c * capacity)).alias("fill"),
    )
