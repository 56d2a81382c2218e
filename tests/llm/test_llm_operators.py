"""Operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and extra columns with clashing names."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazecast.llm import (ann_forest, best_fit_pack, language_id, pq_dedup, quality_knn, simhash_dedup, source_mix,
                          substring_dedup, token_counts, url_filter)
from hazecast.llm.common import bounded_sample, connected_components
from hazecast.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("k1", "h", "part", "size", "n", "found", "rank", "label2", "host", "value")


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = sentence(rng, 120)
    out = [(i, sentence(rng, rng.randrange(1, 90)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(40)]
    out += [(40, base, "en", "s0"), (41, base, "en", "s1"), (42, base + " tail", "en", None), (42, base + " tail", "en", None),
            (43, "lead " + " ".join(base.split()[20:100]) + " end", None, "s2"), (44, None, None, "s2"), (45, "", "en", "s3"),
            (46, " \t\n", "en", "s3"), (None, "orphan text here", "en", "s0"), (47, base.upper(), "en", "s1"),
            (48, sentence(rng, 3000), "en", "s2"), (49, "x" * 20_000, "en", "s2"), (50, "日本語 テキスト é ñ <|endoftext|> z", "ja", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def unite(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = unite(200, pairs)
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x", "https://x.org/fr/1?q", "http://b.example.com/de/", "http://b.example.com/de",
            "http://c.com/p#f", "http://c.com/p?x=1", "http://d.com", None, "no scheme", "ftp://net/", "http://annet/", ""]
    pages = spark.createDataFrame([(i, u, "y") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_filter.filter_urls(pages, url_filter.repeated_urls(pages)).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[2] == ("b.example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("b.example.com", "/de", None, "allow")
    assert got[4] == got[5] == ("c.com", "/p", None, "block")          # listed: two pages came from it
    assert got[6] == ("d.com", "", None, "allow") and got[7] == got[8] == got[11] == ("", "", None, "allow")
    assert got[9] == ("net", "/", "net/", "block") and got[10] == ("annet", "/", None, "allow")
    few = url_filter.filter_urls(pages, url_filter.repeated_urls(pages), blocks=1)      # a full filter: same verdicts
    assert {r["page_id"]: r["verdict"] for r in few.collect()} == {k: v[3] for k, v in got.items()}
    empty = pages.where("false")
    assert url_filter.filter_urls(empty, url_filter.repeated_urls(empty)).count() == 0


def test_min_cost_flow_prefers_unused_words():
    flow = source_mix.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    used = Counter()
    for (p, _), n in flow.items():
        used[p] += n
    assert all(n <= 10 for n in used.values()) and sum(used.values()) == 30       # nothing twice
    flow = source_mix.min_cost_flow({("a", "b"): 10, ("b",): 1}, {"a": 12, "b": 9})
    both, sole = flow[("a", "b"), "a"] + flow[("a", "b"), "b"], flow[("b",), "b"]
    assert both + sole == 21 and both <= 20 and 1 <= sole <= 2          # both ways cost the same


def test_targets():
    t = source_mix.targets_of({"b": 10, "a": 100, None: 1, "é": 1000})
    assert t["a"] == 200 and t["b"] == 20 and abs(t["é"] + t[None] - (1.5 * 1111 - 220)) < 1e-6 and t[None] == 2


def test_source_mix(docs, rows, no_docs):
    out = source_mix.mix_by_source(docs).collect()
    again = source_mix.mix_by_source(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = Counter()
    for _, text, _, s in rows:
        sizes[s] += len(WORD.findall(text or ""))
    taken, target = Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert len(out) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target), (taken, target)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert source_mix.mix_by_source(no_docs).count() == 0


@pytest.mark.parametrize("hot", [4_096, 0])
def test_substring_dedup(docs, rows, no_docs, hot):
    out = substring_dedup.remove_repeats(docs, hot=hot).collect()
    split = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in split for i in range(len(w) - 34))
    expected = []
    for (doc, *_), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone |= set(range(i, i + 35))
        expected.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out))) == sorted(map(str, expected))
    assert sum(e[2] for e in expected) > 300
    if hot:
        assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_simhash(docs, rows, no_docs):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def fp(text):
        w = WORD.findall((text or "").translate(str.maketrans(upper, upper.lower())))
        s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    f = [fp(r[1]) for r in rows]
    root = unite(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    expected = sorted(str((r[0], f"{x:016x}", least.get(k))) for r, x, k in zip(rows, f, root))
    for tile in (8_192, 2):
        got = simhash_dedup.simhash_components(docs, tile_rows=tile).collect()
        assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == expected
    kept = simhash_dedup.keep_one(docs).collect()
    assert len(kept) == len(set(root)) and Counter(r["doc_id"] for r in kept).most_common(1)[0][1] == 1
    assert simhash_dedup.simhash_components(no_docs).count() == 0


def test_bit_sliced_pairs_are_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)])
    key = np.sort(rng.integers(0, 3, len(fps)))
    for radius in (0, 1, 2, 4, 7):
        got = {(i, j) for a, b in simhash_dedup.close_pairs(fps, key, radius) for i, j in zip(a.tolist(), b.tolist())}
        want = {(i, j) for j in range(len(fps)) for i in range(j)
                if key[i] == key[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_packing(docs, rows, no_docs):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = best_fit_pack.pack(docs, path, capacity=64).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64
    total = sum(r["length"] for r in got)
    assert len(fill) <= -(-total // 64) + 2
    want = []
    for doc, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = ids[s:s + 64]
            want.append(str((doc, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(want)
    assert best_fit_pack.pack(no_docs, path).count() == 0


def test_packing_plan_uses_exact_fills():
    rng = random.Random(5)
    for _ in range(20):
        histogram = Counter(rng.randrange(1, 33) for _ in range(rng.randrange(1, 400)))
        plan = best_fit_pack.plan_packing(dict(histogram), 32)
        used = Counter()
        for n, content in plan:
            assert n > 0 and sum(x * k for x, k in content) <= 32
            for x, k in content:
                used[x] += n * k
        assert used == histogram
    assert sum(n for n, _ in best_fit_pack.plan_packing({20: 5, 7: 5, 3: 5, 2: 5}, 32)) == 5      # 20 + 7 + 3 + 2


def test_token_counts(docs, rows, no_docs):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = sorted(str((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids))) for r in rows)
    for frequent in (32_768, 1):
        got = token_counts.with_token_counts(docs, path, frequent=frequent).collect()
        assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.with_token_counts(no_docs, path).count() == 0


def test_language_id(spark, sf_small, docs, no_docs):
    table = spark.read.parquet(f"{sf_small}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.train(table.where(fold != 2))
    out = table.join(language_id.predict(table, model).select("doc_id", "lang_pred", "score"), "doc_id").where(fold == 2)
    right = out.where("lang = lang_pred").count() / out.count()
    assert right >= 0.95
    got = by_id(language_id.predict(docs, model))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (44, 45, 46))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    de, en = ([r["text"] for r in table.where(f"lang = '{x}' and n_chars > 500").limit(2).collect()] for x in ("de", "en"))
    mixed = spark.createDataFrame([(1, " ".join(en[0].split()[:60]) + " " + " ".join(de[0].split()[:60]))], "doc_id long, text string")
    assert [s["lang"] for s in language_id.predict(mixed, model).first()["spans"]] == ["en", "de"]
    nothing = language_id.predict(docs, language_id.train(no_docs))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_quality(spark, docs, no_docs):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = table.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = quality_knn.train(known.where(fold != 0))
    held = quality_knn.score(known.where(fold == 0), model).join(known.select("doc_id", "label"), "doc_id")
    assert held.where("predicted = label").count() / held.count() >= 0.9
    got = quality_knn.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_knn.train(no_docs.select("text", F.lit(1).alias("label")))
    assert {r["score"] for r in quality_knn.score(docs, none).collect()} == {0.5}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((160, 12))
    x[100:130] = x[:30] + 0.02 * rng.standard_normal((30, 12))
    x[130:140] = x[3]
    rows = [(i, v.tolist(), i % 2 if i < 100 else (i - 100) % 2 if i < 130 else 1) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] + [1.0] * 11, 1), (203, [None] + [1.0] * 11, 0),
             (204, x[0].tolist(), None), (205, [float("inf")] * 12, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("k1", F.lit(1)), x


def test_nearest(vectors):
    df, x = vectors
    x = np.concatenate([x, x[:1]])
    ids = np.array([*range(160), 204])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = ann_forest.search(df, F.col("vec_id") % 10 == 0, shard_rows=60, miss=1e-9)        # climbs to the root: exact
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 160, 10))
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        found.sort()
        assert [f[1] for f in found] == want and [f[0] for f in found] == [1, 2, 3, 4, 5]
    assert ann_forest.search(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("noise", [0.0, 1e-7, 1e-5, 1e-4])
def test_ann_forest_orders_copies_that_float32_cannot(spark, noise):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(32)
    x = np.concatenate([(base + noise * rng.standard_normal((300, 32))) * rng.uniform(0.5, 2, 300)[:, None],
                        rng.standard_normal((40, 32)), 2.0 ** np.arange(60)[:, None] * rng.standard_normal(32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    norms, got = np.linalg.norm(x, axis=1), {}
    for r in ann_forest.search(df, F.col("vec_id") % 20 == 0, shard_rows=150).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in [*range(0, 300, 20), 340, 360, 380]:
        s = np.einsum("ij,j->i", x, x[q]) / (norms * norms[q])
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        if noise or q >= 300:
            assert [i for i, _ in got[q]] == want
        assert np.abs(np.array([v for _, v in got[q]]) - s[want]).max() < 1e-15


def test_pq_dedup(vectors):
    df, x = vectors
    rows = [(r["vec_id"], r["label"]) for r in df.collect()]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = dict(rows)
    pairs = [(i, j) for i in range(160) for j in range(i) if label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    root, links = unite(160, pairs), Counter(v for p in pairs for v in p)
    for tile in (8_192, 7):
        got = {r["vec_id"]: r for r in pq_dedup.duplicate_groups(df, tile_rows=tile).collect()}
        assert len(got) == len(rows)
        for i in range(160):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], root[i], root[i] == i)
        for i in range(200, 206):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert pq_dedup.duplicate_groups(df.where("false")).count() == 0


def test_quality_labels_by_hash_give_the_same_model(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(48)] + [(3, 1), (5, None), (None, 1), (999, 0)],
                                   "doc_id long, label int")
    slim = docs.select("doc_id", "text")
    joined = quality_knn.train(slim.join(labels, "doc_id"), per_label=9)
    hashed = quality_knn.train(slim, per_label=9, labels=labels)
    assert len(hashed.labels) == len(joined.labels) and (hashed.labels == joined.labels).all()
    assert np.allclose(hashed.latent, joined.latent)
    assert not len(quality_knn.train(slim, labels=labels.where("false")).labels)


def test_bounded_sample_takes_the_smallest_hashes(spark):
    rows = spark.range(3000).select(F.concat(F.lit("t"), F.col("id") % 1500).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("lang"))
    got = {(r[0], r[1]) for r in bounded_sample(rows, "lang", 40).collect()}
    want = set()
    for lang in "ab":
        texts = rows.where(F.col("lang") == lang).select("text", F.xxhash64("text").alias("h")).distinct().collect()
        want |= {(lang, r["text"]) for r in sorted(texts, key=lambda r: r["h"])[:40]}
    assert got == want


def test_training_bounds_are_those_of_the_first_version():
    assert (language_id.PER_LANGUAGE, quality_knn.PER_LABEL) == (1_500, 1_200)
