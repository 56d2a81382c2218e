"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by
membership pattern (the set of their sources); the flow network is

    start -> pattern -> source -> end

with the quota of each source on its last arc and, on the first arc of each
pattern, one lane per repetition: the k-th use of the pattern's words costs
``k * k``, a convex cost, so that no words are repeated while others that fit
are unused.  The network has one node per pattern and source, whatever the
number of documents; successive cheapest augmenting paths solve it on the
driver (an error above ``MOST_PATTERNS`` patterns, not a cut).  Documents are then selected within each pattern by a seeded hash:
whole passes over the pattern first, then documents in hash order up to the
word where the flow ends (of the last one, its first words).

The order is never materialised for a whole pattern.  The hash is cut into
two digits of 4096 values; running sums over digit totals find the digit pair
in which the flow ends, and only documents of that pair are ordered, so a
source with a third of all rows is split like any other.

Nulls: a null text has no words; a null source is a source of its own (last
in the order).  Documents without words take 0.  Repeated rows count as so
many documents; equal rows share their hash and are told apart by nothing, so
which of them is cut is not defined, the sums are.  Empty table: empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
SEED = 20
DIGIT = 4096
#: The network is solved on the driver: so many patterns at most, counted
#: before they are collected.  Tables of one row per pattern are broadcast.
MOST_PATTERNS = BROADCAST_ROWS = 100_000
START = object()                # no source: None is one


def targets_of(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
               cap: float = REPEATS) -> dict[str | None, float]:
    """Source → target: ``share`` of all words by weight (weights repeat over
    the sources by code point, null last), stopped at ``cap`` times the
    source's words, the excess reshared by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / w for s in open_}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return fixed | target
        fixed |= {s: float(cap * sizes[s]) for s in above}


def min_cost_flow(capacity: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words that each pattern gives to each of its sources.

    ``capacity``: pattern (tuple of sources) → words of one pass; ``quota``:
    source → words wanted.  As much as possible is routed, at the least sum of
    ``k * k`` over the words in their k-th use.
    """
    patterns = list(capacity)
    flow: dict[tuple, int] = {(p, s): 0 for p in patterns for s in p}
    used = dict.fromkeys(patterns, 0)
    want = dict(quota)
    holders: dict = {s: [] for s in quota}
    for p in patterns:
        for s in p:
            holders[s].append(p)
    open_ = [p for p in patterns if capacity[p]]

    def lane(p: tuple) -> tuple[int, int]:
        """Cost of the next word of p and how many have that cost."""
        k = used[p] // capacity[p]
        return (k + 1) ** 2, (k + 1) * capacity[p] - used[p]

    def back(p: tuple) -> tuple[int, int]:
        """Cost of the last word of p and how many have that cost."""
        k = -(-used[p] // capacity[p])
        return k * k, used[p] - (k - 1) * capacity[p]

    while True:
        # cheapest path from the start to a source that still wants words;
        # costs lie on the first arcs alone, so the search spreads from the
        # patterns in order of their next word's cost
        heap = [(lane(p)[0], i, p, START) for i, p in enumerate(open_) if used[p] < repeats * capacity[p]]
        heapq.heapify(heap)
        later = count(len(open_))
        came_p: dict = {}
        came_s: dict = {}
        goal = START
        while heap and goal is START:
            cost, _, p, via = heapq.heappop(heap)
            if p in came_p:
                continue
            came_p[p] = (via, cost)
            for s in p:
                if s in came_s:
                    continue
                came_s[s] = p
                if want[s] > 0:
                    goal = s
                    break
                for q in holders[s]:                 # take s's words back from q, which gives them elsewhere
                    if q not in came_p and flow[q, s] > 0:
                        heapq.heappush(heap, (cost, next(later), q, s))
        if goal is START:
            return flow
        path, s = [], goal
        while s is not START:
            p = came_s[s]
            path.append((p, s))
            s = came_p[p][0]
        head = path[-1][0]
        amount = min(want[goal], lane(head)[1])
        for (p, _), (q, t) in zip(path, path[1:]):
            amount = min(amount, flow[p, t])
        used[head] += amount
        want[goal] -= amount
        for p, s in path:
            flow[p, s] += amount
        for (p, _), (q, t) in zip(path, path[1:]):
            flow[p, t] -= amount


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        seed: int = SEED, sources: Column | None = None,
        carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, size, sources, taken (and the columns of ``carry``,
    each with a ``_`` before its name) of every document; and source,
    source_size, target of every source.

    ``sources``: array column of a document's sources (default: its source
    alone); the size of a source counts every document that belongs to it.
    """
    spark = docs.sparkSession
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    sources = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       word_count(F.col("text").cast("string")).alias("size"), sources.alias("sources"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")).alias("h"),
                       *(F.col(c).alias(f"_{c}") for c in carry))
    sized = materialize(wide.drop(*(f"_{c}" for c in carry)), "sizes")
    by_pattern = materialize(sized.groupBy("sources").agg(F.sum("size").alias("size")), "patterns")
    if (n := by_pattern.count()) > MOST_PATTERNS:
        raise ValueError(f"{n} membership patterns; the flow is solved for {MOST_PATTERNS} at most: join rare sources first")
    patterns = {tuple(r[0]): int(r[1]) for r in by_pattern.collect()}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_of(sizes, weights, share, repeats) if sizes else {}
    flow = min_cost_flow(patterns, {s: round(t) for s, t in targets.items()}, repeats)
    given = [(list(p), n, sum(flow[p, s] for s in p)) for p, n in patterns.items()]
    plan = spark.createDataFrame([(p, g // n if n else 0, g % n if n else 0) for p, n, g in given],
                                 "sources array<string>, passes long, rest long")
    key = F.xxhash64(F.to_json("sources"))
    plan = _small(plan.select(key.alias("p"), "passes", "rest"), len(given))

    def digit(k: int) -> Column:
        return F.shiftrightunsigned("h", 52 - 12 * k).bitwiseAND(F.lit(DIGIT - 1)).cast("int")

    def planned(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"p": key, "d1": digit(0), "d2": digit(1)}).join(plan, "p")

    def edge(rows: DataFrame, digit_name: str, start: str) -> DataFrame:
        """Per pattern the digit in which the flow ends and the words before it."""
        sums = rows.groupBy("p", digit_name, "rest", start).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("p").orderBy(digit_name)) + F.col(start)
        return (sums.withColumn("run", run).where("run > rest and run - n <= rest")
                .groupBy("p").agg(F.min_by(F.struct(F.col(digit_name).alias("d"), (F.col("run") - F.col("n")).alias("b")),
                                           digit_name).alias("e"))
                .select("p", F.col("e.d").alias(f"{digit_name}_end"), F.col("e.b").alias(f"{digit_name}_before")))

    d = planned(sized).withColumn("zero", F.lit(0).cast("long"))
    e1 = _small(materialize(edge(d, "d1", "zero"), "mix-edge"), len(given))
    e2 = materialize(edge(d.join(e1, "p").where("d1 = d1_end"), "d2", "d1_before"), "mix-edge")
    # one row per pattern, like ``plan``; no document moves to meet them
    ends = _small(e1.join(e2, "p"), len(given))
    d = planned(wide if carry else sized).join(ends, "p", "left")
    # whole documents below the end; a pattern whose rest is 0 ends before its first word
    one_more = (F.col("d1") < F.col("d1_end")) | ((F.col("d1") == F.col("d1_end")) & (F.col("d2") < F.col("d2_end")))
    at_end = F.coalesce((F.col("d1") == F.col("d1_end")) & (F.col("d2") == F.col("d2_end")), F.lit(False))
    keep = ["doc_id", "size", "sources", *(f"_{c}" for c in carry)]
    base = F.col("passes") * F.col("size")
    whole = d.where(~at_end).select(*keep, (base + F.when(one_more, F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy("p").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("d2_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = d.where(at_end).select(*keep, (base + F.greatest(F.lit(0), F.least("size", left))).alias("taken"))
    out = whole.unionByName(cut)
    table = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes],
                                  "source string, source_size long, target double")
    return out, _small(table, len(sizes))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows, marked for broadcast if they are few; a table
    made on the driver has no statistics that would tell."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix_by_source(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
                  seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each of
    one source."""
    out, table = mix(docs, weights, share, repeats, seed)
    own = out.withColumn("source", F.element_at("sources", 1))
    return (own.join(table, own["source"].eqNullSafe(table["source"]))                # one row per source
            .select("doc_id", "size", "source_size", "target", "taken"))
