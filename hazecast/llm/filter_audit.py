"""Filter interaction audit over failing-id relations.

Every filter's failing documents are stored once, as a table of their ids.
Which documents a chain of filters keeps depends on the set of filters applied
so far, not on their order, so the audit walks the sets (prefixes) level by
level: the survivors of a prefix, left-anti joined with one filter's ids, are
the survivors of the prefix and that filter; left-semi joined, they are what
the filter would remove there.  The numbers of every order of the filters then
follow from these counts: what a filter fails but no longer meets is redundant,
what only it fails is removed even after all others, and a filter's removals
summed over all orders are its Shapley numerator.

Documents that fail nothing survive every prefix: they are counted once and do
not travel.  All relations are narrow (two longs of identity, the part and two
labels) and joined on the identity, of which no value has more rows than a
level has prefixes.  The duplicate filter keeps the smallest id of each text: a
grouped minimum (folded before the shuffle), then a left-anti join, so a text
that a third of all rows share meets in no task.  Only the constant table of
orders is broadcast; the number of parts is not bounded.

Null texts count as empty.  A null source and the empty one are one part.  Rows
without doc_id are audited like others, but repeat nothing and have no labels.
Repeated rows count as often as they occur and fail alike; of rows of one id
with different texts each fails for its own text.  A document with several
label rows has a label if one of them says so.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import WORD_RE, materialize, text_key
from hazecast.session import shared_dir

ID = ["id", "k1"]
LEAST_WORDS = 50
LEAST_DISTINCT, MOST_CAPITALS = 65, 5           # percent
SYMBOLS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the text filters A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    n = F.size(words)
    return {"A": n < LEAST_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
            "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
            "D": text.rlike(SYMBOLS)}


def relations(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], repeats: str) -> tuple[DataFrame, DataFrame]:
    """The audited rows (part, identity, label flags) and the failing ids
    (filter, identity), stored as one table a filter; ``repeats`` names the filter
    that fails a document whose text a smaller id has."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flagged = read.select("doc_id", "part", *(c.alias(n) for n, c in text_key(F.col("text")).items()),
                          F.filter(F.array(*(F.when(c, f) for f, c in conditions.items())), lambda f: f.isNotNull()).alias("fails"))
    flagged = materialize(flagged.withColumn("id", F.coalesce("doc_id", F.lit(0))), "flags")
    flags = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = (flagged.select("doc_id", "id", "k1", "part").join(flags, "doc_id", "left")
            .select("part", *ID, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))))
    own = flagged.where("doc_id is not null")
    firsts = own.groupBy("k1", "k2").agg(F.min("id").alias("id")).select(*ID)
    failing = flagged.select(*ID, F.explode("fails").alias("filter")).unionByName(
        own.select(*ID).join(firsts, ID, "left_anti").withColumn("filter", F.lit(repeats)))
    path = f"{shared_dir(docs.sparkSession, 'llm-failing')}/table"
    failing.distinct().write.partitionBy("filter").parquet(path)
    return materialize(rows, "rows"), docs.sparkSession.read.schema("id long, k1 long, filter string").parquet(path)


def counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("part", *by).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def prefixes(rows: DataFrame, failing: DataFrame, names: list[str]) -> DataFrame:
    """Counts (part, prefix, filter, n, good, toxic) of what each filter removes
    after each prefix, and of the survivors where filter is empty; a prefix is
    the sum of the bits of its filters."""
    any_of = failing.select(*ID).distinct()
    every = F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(names)))
    clean = counted(rows.join(any_of, ID, "left_anti"))
    counts = [materialize(clean, "clean").withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
              .withColumn("filter", F.lit(""))]
    level = materialize(rows.join(any_of, ID, "left_semi").withColumn("prefix", F.lit(0)), "survivors")
    for depth in range(len(names) + 1):
        options = level.select("*", F.explode(every).alias("f")).select(*level.columns, "f.*").where(F.col("prefix").bitwiseAND(F.col("bit")) == 0)
        removed = counted(options.join(failing, ["filter", *ID], "left_semi"), "prefix", "filter")
        kept = counted(level, "prefix").withColumn("filter", F.lit(""))
        counts.append(materialize(kept.unionByName(removed), "counts"))
        if depth < len(names):          # each prefix arises once, from the one without its last filter
            level = materialize(options.where("prefix < bit").join(failing, ["filter", *ID], "left_anti")
                                .withColumn("prefix", F.col("prefix") + F.col("bit")).select(*level.columns), "survivors")
    return (reduce(DataFrame.unionByName, counts).groupBy("part", "prefix", "filter")
            .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))))


def orders(names: list[str]) -> list[tuple]:
    """(filter_order, step, filter, prefix before the step) of all orders."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    return [("".join(order), i + 1, f, sum(bit[g] for g in order[:i])) for order in permutations(names) for i, f in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """A row per part, order of the filters and step, see the module's text.

    ``conditions`` are failure conditions over the column ``text`` by filter
    name; the default are the filters A to D.
    """
    conditions = text_filters(F.col("text")) if conditions is None else conditions
    names = [*conditions, repeats]
    counts = prefixes(*relations(docs, labels, conditions, repeats), names)
    bit = {f: 1 << i for i, f in enumerate(names)}
    everything = sum(bit.values())

    # one row a part: its survivors by prefix and its removals by filter and
    # prefix, at most filters x prefixes entries
    entry = F.struct(F.concat("filter", F.col("prefix").cast("string")), F.struct("n", "good", "toxic"))
    cells = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))

    def of(cell: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("cells", cell)[field], F.lit(0)).cast("long")

    def orders_with(prefix: int) -> int:                # orders in which exactly these filters come before one
        k = bin(prefix).count("1")
        return factorial(k) * factorial(len(names) - 1 - k)

    shapley = F.coalesce(*(F.when(F.col("filter") == f, sum((of(F.lit(f"{f}{p}"), "n") * orders_with(p)
                           for p in range(everything + 1) if not p & b), F.lit(0))) for f, b in bit.items()))
    by_filter = cells.select("part", "cells", F.explode(F.array(*map(F.lit, names))).alias("filter"))
    own = F.coalesce(*(F.when(F.col("filter") == f, b) for f, b in bit.items()))
    others = F.lit(everything) - own
    by_filter = by_filter.select("part", "cells", "filter", of(F.concat("filter", F.lit("0")), "n").alias("fails"),
                                 of(F.concat("filter", others.cast("string")), "n").alias("unique_fails"), shapley.cast("long").alias("shapley"))
    steps = docs.sparkSession.createDataFrame(orders(names), "filter_order string, step int, filter string, prefix int")
    out = by_filter.join(F.broadcast(steps), "filter")          # filters x orders rows, a constant
    here = F.concat("filter", F.col("prefix").cast("string"))
    after = (F.col("prefix") + own).cast("string")
    return out.select("part", "filter_order", "step", of(after, "n").alias("kept"), of(here, "n").alias("removed"),
                      (F.col("fails") - of(here, "n")).alias("redundant"), "unique_fails", of(here, "good").alias("good_lost"),
                      of(here, "toxic").alias("toxic_lost"), "shapley")
