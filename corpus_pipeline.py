"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last return
the columns of ``documents``.  Other columns of ``docs`` are dropped.

Null texts and texts without letters go with the first stage.  Null ids, langs
and sources are carried along: a document without lang is judged but not
learned from, and null is a source of its own.  Of equal rows the second stage
keeps one.  Of ties each stage takes what its operator documents.  An empty
table goes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.llm import best_fit_pack, language_id, simhash_dedup, source_mix, substring_dedup
from hazecast.llm.common import WORD_RE, materialize
from hazecast.llm.queries import PATH_BATCH, TEXT_BATCH, fold, set_batches, vocabulary
from hazecast.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: A document stays if one language has at least this share of its letters.
LEAST_SHARE = 0.5

ORACLE_SQL = None       # learned languages and hashed selections: tested against a brute-force version


def _documents(docs: DataFrame, batch: int = TEXT_BATCH) -> DataFrame:
    set_batches(docs.sparkSession, batch)
    return docs.select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; texts without letters and texts in
    which no language has half of the letters go."""
    docs = _documents(docs, PATH_BATCH)
    model = language_id.train(docs.where(fold(4) != 2).select("text", "lang"))
    out = language_id.predict(docs, model, carry=REST, spans=False)
    stays = (F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SHARE)
    return out.where(stays).select("doc_id", *(F.col(f"_{c}").alias(c) for c in REST))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.keep_one(_documents(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated 35-word windows go; other texts stay as they are."""
    out = substring_dedup.remove_repeats(_documents(docs), carry=REST[1:], as_is=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("_n_chars"))
    return out.select("doc_id", F.col("kept").alias("text"), F.col("_lang").alias("lang"),
                      F.col("_source").alias("source"), n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for every whole time that the mix takes it;
    where the mix ends within a document, its first words appear as well."""
    out, _ = source_mix.mix(_documents(docs), carry=REST)
    rest = [F.col(f"_{c}").alias(c) for c in REST]
    whole = (out.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("taken div size"))))
             .where("copy > 0").select("doc_id", *rest))
    cut = out.where("size > 0 and taken % size > 0")
    some = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD_RE), F.lit(0)), F.lit(1),
                                F.expr("cast(taken % size as int)")), " ")
    cut = cut.withColumn("_text", some).withColumn("_n_chars", F.length("_text").cast("long"))
    return whole.unionByName(cut.select("doc_id", *rest))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return best_fit_pack.pack(_documents(docs), vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("simhash_dedup", near_dedup), ("substring_dedup", cut_repeats),
          ("source_mix", mix), ("best_fit_pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
