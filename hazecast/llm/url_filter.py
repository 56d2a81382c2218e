"""URL filters: prefix rules, then a list of canonical URLs behind a blocked
Bloom filter.  DataFrame functions throughout.

A URL's canonical form is its host (after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased) and its path (then up to ``?``,
``#`` or the end).

1. Rules are few and fixed: (action, host and path prefix).  A rule fits its
   host and all subdomains if the path starts with the rule's; the longest
   fitting rule decides (of equal length, the one with the longer host).
2. URLs that no rule decides are looked up in the listed canonical URLs.  The
   list is hashed into a split-block Bloom filter: a block is eight 32-bit
   words, a URL sets one bit in each word of its block.  The number of blocks
   follows the list (``KEYS`` URLs a block: 16 bits a URL) up to ``MOST_BLOCKS``, so
   the broadcast filter has a proven bound (that many rows of nine integers); a
   still longer list raises the share of false hits and nothing else.  Possible hits alone go to the exact hash join with the list,
   which removes the false ones.  A URL found there is blocked, any other is
   allowed.

The list holds one row per canonical URL, so a URL that a third of all pages
share meets one row, and a skewed partition can be split.

Null URLs and those without ``://`` have an empty host and path, fit no rule,
are never listed and are allowed.  Repeated rows and null page_ids are judged
like any other; an empty table or list gives what one expects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import materialize

#: (action, rule); a rule is a host and a path prefix in one string.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Listed URLs a block, and the bounds of the number of blocks.
KEYS, LEAST_BLOCKS, MOST_BLOCKS = 16, 1 << 10, 1 << 20
WORDS = 8


def canonical(url: Column) -> dict[str, Column]:
    """host and path columns of a URL column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"host": F.translate(host, upper, upper.lower()), "path": path}


def decide(rules: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """rule and action columns from host and path: the longest fitting rule."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) \
            & F.startswith(F.col("path"), F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else F.when(fits, text).otherwise(rule)
        action = F.when(fits, act) if action is None else F.when(fits, act).otherwise(action)
    none = F.lit(None).cast("string")
    return {"rule": none if rule is None else rule, "action": none if action is None else action}


def bloom_place(blocks: int) -> dict[str, Column]:
    """Block and the bit in each of its words, from host and path."""
    h, bits = F.xxhash64("host", "path"), F.xxhash64(F.lit("bits"), "host", "path")
    one = F.lit(1).cast("long")
    return {"block": F.pmod(h, F.lit(blocks)).cast("int")} | {
        f"m{i}": F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int"))
        for i in range(WORDS)}


def blocks_for(urls: int) -> int:
    """Blocks of the filter of a list of so many URLs: a power of two."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (-(-urls // KEYS) - 1).bit_length() if urls else 0))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of listed (host, path): at most ``blocks`` rows."""
    return (listed.select(*(c.alias(n) for n, c in bloom_place(blocks).items()))
            .groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS))))


def canonical_list(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct (host, path) of a table of URLs; those without a host go."""
    return urls.select(*(c.alias(n) for n, c in canonical(F.col(column)).items())).where("host <> ''").distinct()


def repeated_urls(pages: DataFrame, least: int = 2) -> DataFrame:
    """The list that the tables at hand offer: canonical URLs that ``least``
    pages or more were fetched from."""
    return (pages.select(*(c.alias(n) for n, c in canonical(F.col("url")).items())).where("host <> ''")
            .groupBy("host", "path").count().where(F.col("count") >= least).select("host", "path"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
                blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    ``listed``: distinct (host, path), as ``canonical_list`` gives them; ``blocks``:
    of the filter (default: by the list's length).
    """
    listed = materialize(listed.select("host", "path"), "listed-urls")
    blocks = blocks or blocks_for(listed.count())
    urls = pages.select("page_id", *(c.alias(n) for n, c in canonical(F.col("url")).items()))
    urls = urls.withColumns(decide(rules))
    ruled = urls.where("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"),
                                                    F.lit(None).cast("boolean").alias("listed"))
    probe = urls.where("action is null").select("page_id", "host", "path", "rule",
                                                *(c.alias(n) for n, c in bloom_place(blocks).items()))
    probe = probe.join(F.broadcast(bloom_filter(listed, blocks)), "block", "left")     # at most ``blocks`` rows
    hit = F.coalesce(F.expr(" and ".join(f"(w{i} & m{i}) <> 0" for i in range(WORDS))), F.lit(False))
    probe = probe.select("page_id", "host", "path", "rule", hit.alias("possible"))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    clear = probe.where("not possible").withColumn("listed", F.lit(False))
    exact = probe.where("possible").join(listed.select("host", "path", F.lit(True).alias("found")).hint("shuffle_hash"),
                                         ["host", "path"], "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    keep = ["page_id", "host", "path", "rule", verdict.alias("verdict"), "listed"]
    return ruled.unionByName(clear.select(*keep)).unionByName(exact.select(*keep))
