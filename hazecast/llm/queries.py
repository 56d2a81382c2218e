"""One query per operator over its whole table; the digest columns of the
contracts are derived here from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.llm import (ann_forest, best_fit_pack, filter_audit, hard_negatives, language_id, pq_dedup,
                          quality_knn, simhash_dedup, source_mix, substring_dedup, token_counts, toxicity, url_filter)
from hazecast.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Rows of an Arrow batch: texts can be long, so few of them travel at once.
TEXT_BATCH = 512
VECTOR_BATCH = 4096
#: Texts whose Viterbi paths advance together.
PATH_BATCH = 1024


def vocabulary(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def set_batches(spark: SparkSession, batch: int) -> None:
    """Rows that travel together, to Python and out of a Parquet column: 4096
    texts, Spark's default, are one buffer of many megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(batch))


def register(name: str, batch: int = TEXT_BATCH):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            set_batches(spark, batch)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return run
    return deco


@register("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the four rules; undecided ones against the list of
    URLs that two or more pages came from."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.repeated_urls(pages))


@register("op2_source_mix")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150% of their words."""
    return source_mix.mix_by_source(table(spark, sf_dir, "documents"))


@register("op3_ann_forest", VECTOR_BATCH)
def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    found = ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of all documents when repeated 35-word windows go."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def fold(modulus: int):
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@register("op5_language_id", PATH_BATCH)
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2).select("text", "lang"))
    out = language_id.predict(docs, model, spans=False)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op6_best_fit_pack")
def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return best_fit_pack.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@register("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents at 4 bits."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


@register("op8_quality_knn")
def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(docs.select("doc_id", "text"), labels=labels)
    out = quality_knn.score(docs, model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op9_pq_dedup", VECTOR_BATCH)
def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors of equal label."""
    return pq_dedup.duplicate_groups(table(spark, sf_dir, "embeddings"))


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op11_hard_negatives", VECTOR_BATCH)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every vector whose id
    is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    out = hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)
    return out.withColumn("rank", F.col("rank").cast("int"))


@register("op12_filter_audit")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters A to E in all 120 orders over all documents, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
