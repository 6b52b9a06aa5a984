"""The registered queries against their SQL, or brute force over the same tables; and the pipeline, stage by stage."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import mixing
from pagewright.llm.decontaminate import contaminated
from pagewright.llm.neardup import RADIUS
from pagewright.llm.oracles import ORACLES
from pagewright.llm.queries import QUERIES
from tests.llm.test_operators import brute_components, brute_nearest, brute_secrets, dense_error, naive_simhash
from tests.llm.test_similar import brute_heads

TABLES = "documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or str(v) in ("<NA>", "nan"):
        return "null"
    return v if isinstance(v, str) else f"{float(v):.9g}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False)) for df in (want, got)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def heads_of(texts):
    """doc_id -> smallest doc_id of its near-duplicates."""
    fps = {d: naive_simhash(t) for d, t in texts.items()}
    label = brute_components(sorted(set(fps.values())), 2)
    heads: dict[int, int] = {}
    for d, fp in fps.items():
        heads[label[fp]] = min(d, heads.get(label[fp], d))
    return fps, {d: heads[label[fp]] for d, fp in fps.items()}


def test_op4(spark, sf_dir, texts):
    fps, heads = heads_of(texts)
    got = QUERIES["op4_neardup"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", heads[d]) for d in texts} and len(got) == len(texts)


def test_op3(spark, sf_dir, texts):
    got = QUERIES["op3_language"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(texts) and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_op5(spark, sf_dir, texts):
    got = QUERIES["op5_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(r.tokens == len(texts[r.doc_id].split()) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op5_is_least_squares(spark, sf):
    got = QUERIES["op5_mixing"](spark, f"/root/testdata/{sf}").toPandas()
    p, wanted = got[[f"p_{d}" for d in mixing.TARGETS]].to_numpy(), np.array(list(mixing.TARGETS.values()))
    reached = (got.rate.to_numpy()[:, None] * got.tokens.to_numpy()[:, None] * p).sum(axis=0) / got.tokens.sum()
    assert ((reached - wanted) ** 2).sum() <= 1.01 * dense_error(got.tokens.to_numpy(float), p, wanted, np.inf, rounds=5000) + 1e-6


def test_op6(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in rows])
    got = QUERIES["op6_neighbours"](spark, sf_dir).collect()
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert Counter(r.query_id for r in got) == {q: len(near) for q, near in want.items()}
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    hits = [k for k in exact if k in found]
    assert len(hits) >= 0.9 * len(exact) and all(abs(found[k] - exact[k]) < 1e-6 for k in hits)


def test_op8(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op8_secrets"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        spans = brute_secrets(t)
        kinds = Counter(s.split(":")[0] for s in spans.split(",") if s)
        assert (got[d].spans, got[d].n_assign, got[d].n_access, got[d].n_hex) == (spans, kinds["assign"], kinds["access"], kinds["hex"])
        assert got[d].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9_000_001, None, None, None, 0), (9_000_002, "12 34 !", "en", "src1", 7), (9_000_003, "", None, "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]

    kept = stages["language"](spark, docs, sf_dir)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns
    assert rows == {r.doc_id: r for r in docs.collect() if any(map(str.isalpha, r.text or ""))}

    heads = brute_heads({d: r.text for d, r in rows.items()}, RADIUS)
    kept = stages["near_duplicates"](spark, kept, sf_dir)
    left = {d: rows[d] for d, h in heads.items() if d == h}
    assert kept.columns == docs.columns and {r.doc_id: r for r in kept.collect()} == left

    bad = {r.doc_id for r in contaminated(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    kept = stages["decontamination"](spark, kept, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id: r for r in kept.collect()} == {d: r for d, r in left.items() if d not in bad}

    rated = {r.doc_id: r.rate for r in mixing.mix(kept, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    mixed = stages["mixing"](spark, kept, sf_dir)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= set(rated)
    assert all(int(rate) <= times[d] <= int(rate) + 1 for d, rate in rated.items())

    sharded = stages["sharding"](spark, mixed, sf_dir)
    sizes = Counter(r.shard for r in sharded.collect())
    assert sharded.count() == sum(times.values()) and max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_on_empty_and_odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).withColumn("row", F.lit("x")).withColumn("source", F.when(F.col("doc_id") > 5, F.col("source")))
    for rows in (docs.filter("false"), odd):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
            assert name == "sharding" or "text" in rows.columns
        rows.collect()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "size", "text_crc32", "law", "shard", "slot"} <= set(got.columns)
