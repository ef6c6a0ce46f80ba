"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from stallmark.llm import conversation_trie, hard_negatives, license_scan, line_dedup, mixing, ngram_join, packing, quality, scratch, substring_dedup, token_files, topk, vector_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    digest = F.when(F.col("record_type") == "response", warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest"))
    return records.select(F.col("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch.materialize(mixing.measured(_table(spark, sf_dir, "documents")), "mixing-sizes")
    plan = mixing.plan_for(rows)
    goals = spark.createDataFrame([*zip(plan.names, plan.sizes, plan.targets, strict=True)], "s string, source_size long, target double")
    out = mixing.taken_words(rows, plan).join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    return quality.score(docs.select("doc_id", quality.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine_negatives(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, noisy)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = conversation_trie.sequences(_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.branched(seqs, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, 5))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.scratch_path(spark, "token-files")
    token_files.write_corpus(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_corpus(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_substring_dedup, op4_license_scan, op5_exact_topk, op6_ngram_jaccard, op7_vector_dedup, op8_packing, op9_warc, op10_quality, op11_hard_negatives, op12_conversation_trie, op13_token_files)}

#: SQL for DuckDB where a query's rows can be had from it; the others are held against brute force in tests/llm.
_REACH = "reach AS (SELECT id, id AS r FROM node UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a), component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS t(i)),
 first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
 gone AS (SELECT DISTINCT doc_id, win.i + k AS i FROM win JOIN first USING (h), range(50) AS r(k) WHERE m < doc_id),
 words AS (SELECT doc_id, i, w[i] AS x FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
 lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_exact_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), node AS (SELECT doc_id AS id FROM documents), {_REACH}
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN component ON id = doc_id""",
    "op7_vector_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9), node AS (SELECT vec_id AS id FROM e), {_REACH}, n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
 SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n ON a = id""",
    "op9_warc": """WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
 d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + ((((strpos('0123456789abcdef', substr(h, 1 + i * 5 // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + i * 5 // 4, 1)) - 1) >> (3 - i * 5 % 4)) & 31)::INT, 1)), '') AS payload_digest FROM h),
 m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM m""",
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_conversation_trie": """WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT conv_id, l, (xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
 lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6)::INT AS h FROM o),
 r AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
 p AS (SELECT conv_id, d, l[1:d] AS p, d = len(l) AS ends, CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS n FROM r, unnest(range(0, len(l) + 1)) AS t(d)),
 node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY p, d),
 kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
 own AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p AND kids.d = node.d),
 sub AS (SELECT p[1:k] AS p, k AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(w)::BIGINT AS saved_tokens FROM own, unnest(range(0, d + 1)) AS t(k) GROUP BY ALL)
 SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
 FROM own JOIN sub ON sub.p = own.p AND sub.d = own.d LEFT JOIN node up ON own.d > 0 AND up.d = own.d - 1 AND up.p = own.p[1:own.d - 1]""",
}
