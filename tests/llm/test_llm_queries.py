"""Registered queries against DuckDB, and the pipeline stage by stage."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from hazecast.llm.oracle import SQL  # noqa: E402
from hazecast.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_small, name):
    import duckdb
    from oracle_check import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_small}/{t}.parquet"):
            path = f"{sf_small}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    r = compare(QUERIES[name](spark, sf_small).toPandas(), con.execute(SQL[name]).fetchdf())
    assert r["cols"] and r["rows"][0] == r["rows"][1] and r["hash"], r


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != "best_fit_pack":
            assert docs.columns == columns
        if name == "simhash_dedup":
            from hazecast.llm.simhash_dedup import simhash_components
            parts = simhash_components(before)
            assert docs.count() == parts.select("component_id").distinct().count()
            assert docs.join(parts.where("doc_id = component_id"), "doc_id").count() == docs.count()
        if name == "substring_dedup":
            assert docs.count() == before.count()
        if name == "source_mix":
            from hazecast.llm.common import word_count
            from hazecast.llm.source_mix import mix_by_source
            want = {r[0]: r[1] for r in mix_by_source(before).where("taken > 0").groupBy("doc_id").sum("taken").collect()}
            got = docs.withColumn("w", word_count(docs["text"])).groupBy("doc_id").sum("w").collect()
            assert {r[0]: r[1] for r in got} == want
    assert sizes[1] >= 0.99 * sizes[0]                  # clean documents stay
    assert corpus_pipeline.run(spark, sf_small).count() == sizes[-1]
