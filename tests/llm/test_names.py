"""Extra columns whose names differ from an operator's own by case alone, and archives of other versions."""

import gzip

from pyspark.sql import functions as F

from stallmark.llm import license_scan, mixing, ngram_join, packing, quality, topk, vector_dedup, warc

TEXT = "one two three four five six seven"


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, TEXT, "a", "X", "Y", 3, 4), (2, TEXT, "b", "X", "Y", 3, 4), (3, None, None, None, None, None, None)], "doc_id long, text string, source string, DOC_ID string, TEXT string, Source int, `a.b` int")
    rows = mixing.measured(docs, keep=["a.b", "Source"]).orderBy("id").collect()
    assert [(r.id, r.source, r["size"]) for r in rows] == [(1, "a", 7), (2, "b", 7), (3, None, 0)] and rows[0].kept.asDict() == {"a.b": 4, "Source": 3}
    measured = mixing.measured(docs)
    plan = mixing.plan_for(measured)
    assert {r.id for r in mixing.texts(docs, measured, plan).select("id").collect()} <= {1, 2, 3}
    assert license_scan.scan(docs, {"seven": TEXT}).select("doc_id").distinct().count() == 2
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in packing.pack(docs, with_ids=False).collect()} == {1, 2, 3}
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id long, quality int, QUALITY string")
    assert quality.train(docs, labels) is not None
    vectors = spark.createDataFrame([(0, [1.0, 0.0], "x", 1), (1, [1.0, 0.01], "y", 2)], "vec_id long, embedding array<double>, VEC_ID string, Embedding int")
    assert [(r.query_id, r.vec_id) for r in topk.exact_top_k(vectors, lambda i: i == 0).collect()] == [(0, 1)]
    assert {r.vec_id: r.component_id for r in vector_dedup.near_vectors(vectors).collect()} == {0: 0, 1: 0}


def test_pages_with_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>", 5, "x"), (2, "v", "<p>", 6, "y")], "page_id long, url string, html string, PAGE_ID int, Html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert {r.record_id: r.record_type for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {1: "response", 2: "revisit"}


def test_empty_pages_and_other_versions(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    bodies = [b"first WARC/1.0\r\n inside", b""]
    record = lambda i, b: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(http + b), http + b)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.warc.gz").write_bytes(gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies))))
    for options in ({}, {"version": "1.0"}):
        assert {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path / "old"), **options).select("record_id", F.col("payload")).collect()} == dict(enumerate(bodies))
