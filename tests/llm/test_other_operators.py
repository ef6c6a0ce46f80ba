"""Vectors, WARC archives, components and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallmark.llm import topk, vector_dedup, warc
from stallmark.llm.graph import components
from stallmark.llm.scratch import scratch_path

ODD = [(9001, None), (9002, []), (9003, [float("nan")] * 16), (9004, [0.0] * 16), (9005, [1.0] * 8), (9006, [None] * 16), (9007, [float("inf")] * 16)]


def vectors():
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 16))
    near = [x[i % 7] + 0.05 * r.standard_normal(16) for i in range(120)]
    hot = [x[9]] * 60
    every = [*x, *near, *hot]
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(every)] + ODD


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, "q") for i, v in vectors()], "vec_id long, embedding array<float>, cell string").repartition(3).cache()


def test_exact_top_k(table):
    rows = [(i, np.floor(256 * np.array(v))) for i, v in vectors() if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = topk.exact_top_k(table, F.col("vec_id") % 50 == 0, group_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_beyond_doubles(spark):
    big = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [1e30, 2.0])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(big, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 3, (1 << 63) - 1), (2, 2, 256_000_000**2 + 768 * 512)]


def test_near_vectors(table):
    rows = vectors()
    sound = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = list(sound)
    links = {i: set() for i, _ in rows}
    for i in ids:
        for j in ids:
            if i != j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= 0.9:
                links[i].add(j)
    low = {i: i for i, _ in rows}
    for _ in range(10):
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
    for options in ({}, {"block": 16, "recall": 1.0}):
        got = vector_dedup.near_vectors(table, **options).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (len(links[i]), low[i], low[i] == i) for i in low}


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = vector_dedup.rotation(64)
    got, half = vector_dedup.estimates(*vector_dedup.encode(x, turn), x @ turn, 4.0)
    error = got - x @ x.T
    assert abs(error.mean()) < 2e-3 and (np.abs(error) > half[:, None]).mean() < 1e-3


def planted(n, cosine, seed=6):
    """n random pairs (i, i + n) of unit vectors with this cosine."""
    r = np.random.default_rng(seed)
    a = r.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = r.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * noise]))]


@pytest.mark.parametrize(("classes", "bits"), [(48_000, 6), (2_000_000, 11)])
def test_recall_at_the_threshold(spark, classes, bits):
    """At 0.90, with the bits and tables that tables of these sizes get."""
    block = 1024 * 4800 / classes
    assert vector_dedup.plan_tables(classes, 1024, 0.9, 0.98)[0] == bits == vector_dedup.plan_tables(4800, block, 0.9, 0.98)[0]
    table = spark.createDataFrame(planted(2400, 0.9000001), "vec_id long, embedding array<double>")
    got = vector_dedup.near_vectors(table, block=block).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 4800
    assert all(r.n_links <= 1 and r.component_id in (r.vec_id, r.vec_id % 2400) for r in got)


def test_every_pair_is_met_with_full_recall(spark):
    table = spark.createDataFrame(planted(600, 0.9000001), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(table, recall=1.0, block=64).collect()}
    assert got == {i: (1, i % 600) for i in range(1200)}


def test_a_hot_bucket_is_cut_into_tiles(spark):
    r = np.random.default_rng(7)
    heads = np.linalg.qr(r.standard_normal((32, 32)))[0][:6]
    x = np.concatenate([h + 0.07 * r.standard_normal((60, 32)) for h in heads])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(table, block=20, recall=0.999).collect()}
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.97 * sum(want.values())


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(none, F.lit(True)).count() == 0 and vector_dedup.near_vectors(none).count() == 0


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (7, None)]
    low = {x: x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)


def pages():
    inner = "<pre>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n</pre>"
    return [(3, "http://a/ü", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b\r\nX: y", inner), (4, "u", None), (5, "u", ""), (6, "u", inner), (6, "u", inner), (7, "u", "WARC/1.1\r\n" * 5), (None, "u", "<p>x</p>"), (8, "u", "é" * 1000 + "\r\n\r\n")]


@pytest.mark.parametrize(("least", "compression"), [(0, "gzip"), (20, "none")])
def test_warc_round_trip(spark, least, compression):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(*p, "extra") for p in pages()], "page_id long, url string, html string, payload string")
    warc.write_warc(df, path, min_payload=least, records_per_file=3, compression=compression)
    got = warc.read_warc(spark, path).withColumn("sha", warc.base32_sha1(F.col("payload"))).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    keeper = {}
    for i, _, h in pages():
        if i is not None and len((h or "").encode()) >= least:
            keeper[digest(h)] = min(keeper.get(digest(h), i), i)
    want = []
    seen = set()
    for i, _, h in pages():
        d = digest(h)
        first = i is None or d not in keeper or (keeper[d] == i and (i, d) not in seen)
        seen.add((i, d))
        want.append((i, "response" if first else "revisit", None if first else keeper[d], d, d if first else digest("")))
    assert sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.sha) for r in got), key=str) == sorted(want, key=str)


def test_warc_reads_large_files_in_splits(spark):
    path = scratch_path(spark, "warc-split")
    rows = [(i, "u", ("WARC/1.1\r\nContent-Length: 3\r\n\r\n" if i % 3 == 0 else "") + str(i) * 200) for i in range(300)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records_per_file=1000, compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.record_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: h for i, _, h in rows}


def test_warc_of_nothing_and_of_other_files(spark):
    path = scratch_path(spark, "warc-none")
    spark.createDataFrame([("no archive",), ("WARC/1.1 is not here",)], "value string").write.text(path)
    assert warc.read_warc(spark, path).count() == 0


def test_near_copies_of_repeated_ids(spark):
    import corpus_pipeline

    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    close = text("d").replace("d59", "other")
    rows = [(5, text("a")), (5, text("b")), (3, text("b")), (7, text("c")), (7, text("c")), (8, text("d")), (8, close), (9, close), (None, text("a")), (None, text("a")), (10, ""), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], corpus_pipeline.COLUMNS).repartition(3)
    got = corpus_pipeline.ngram_jaccard(spark, docs, "").collect()
    ids = sorted(((r.doc_id, r.text[:1]) for r in got), key=str)
    assert ids == sorted([(5, "a"), (3, "b"), (7, "c"), (8, "d"), (None, "a"), (None, "a"), (10, ""), (11, "")], key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from stallmark.llm.scratch import materialize

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality_classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert sum(q == (i in kept) for i, q in labels.items()) >= 0.95 * len(labels)
        if name == "ngram_jaccard":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] and docs.where("length > 0").count() == sizes[-1]
