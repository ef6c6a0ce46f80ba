"""Operators over texts against brute force on a small table with copies, near copies, nulls and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallmark.llm import kernels, license_scan, line_dedup, mixing, ngram_join, packing, quality, substring_dedup, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, N_Lines string, Score double, `c``d` string"


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, out = text(70), []
    for i in range(40):
        lines = [text(r.randint(5, 40)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 4 == 0:
            lines.append("a common closing line of the site number " + str(i % 8) + " that all of them carry")
        out.append("\n".join(lines))
    base = text(120)
    for i in range(8):  # near copies: a word of 120 changed
        words = base.split()
        words[i * 13] = f"changed{i}"
        out.append(" ".join(words))
    out += [base, base, base.upper(), "", " \n\t ", "one two", "one two", "ONE two", "x " * 400, None, "Ünï cödé\x0bwörds   here", text(3000)]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "hot", len(t or ""), "clash") for i, t in enumerate(out)]
    rows = [*rows, (3, rows[3][1], "en", "hot", 1, "again"), (None, base, "en", "hot", 1, "no id")]
    return [(*row, "lines", 2.0, "tick") for row in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


def test_words_match_the_byte_rule():
    texts = [r[1] for r in corpus()]
    w = kernels.Words(pa.array(texts, pa.string()))
    assert [w.word(i) for i in range(len(w))] == [x for t in texts for x in split(t)]


@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_grams_equal_where_words_equal(xs, k):
    g = kernels.grams(np.array(xs, np.uint64), k)
    assert len(g) == max(0, len(xs) - k + 1)
    seen = {}
    for i, h in enumerate(g.tolist()):
        assert seen.setdefault(h, tuple(xs[i : i + k])) == tuple(xs[i : i + k])
    assert len(seen) == len({tuple(xs[i : i + k]) for i in range(len(g))})


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1, max_size=6), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_automaton_gives_the_least_document(texts, n):
    a = substring_dedup.Automaton()
    for d, t in enumerate(texts):
        a.add(t, d)
    a.close()
    for t in texts:
        want = [min(d for d, u in enumerate(texts) if any(u[j : j + n] == t[i : i + n] for j in range(len(u)))) for i in range(len(t) - n + 1)]
        assert a.least(t, n) == want


def brute_spans(rows, n):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = split(t)
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = split(t)
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k] += 1
                gone[k + n] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        out.append((i, len(w), int((~keep).sum()), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1024, 2])
def test_substring_dedup(docs, shard):
    got = substring_dedup.dedup_substrings(docs, 50, shard=shard).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_spans(corpus(), 50)
    assert sum(r.n_removed for r in got) > 500


def test_line_dedup(docs):
    rows = [r for r in corpus() if r[0] is not None]
    lines = [(i, n, tuple(split(x)), x) for i, t, *_ in rows for n, x in enumerate((t or "").split("\n")) if split(x)]
    first, near = {}, set()
    for i, n, w, _ in lines:
        first[w] = min(first.get(w, (i, n)), (i, n))
    for w in first:
        for v in first:
            if w != v and len(w) >= 5 and len(v) >= 5 and first[v] < first[w] and line_dedup.one_apart(list(w), list(v)):
                near.add(w)
    gone = defaultdict(set)
    for i, n, w, _ in lines:
        if w in near or (i, n) > first[w]:
            gone[i].add(n)
    got = line_dedup.dedup_lines(docs).collect()
    want = [(i, t if i is None or t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t, *_ in corpus()]
    assert near and sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_clashing_names(docs):
    """Names with dots and backticks, and names of the result in other case, pass through or give way."""
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "Score", "c`d", "n_lines", "n_removed"]
    assert {(r[5], r[6], r[7]) for r in got.collect()} == {("clash", 2.0, "tick"), ("again", 2.0, "tick"), ("no id", 2.0, "tick")}
    got = substring_dedup.dedup_substrings(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "a.b", "N_Lines", "Score", "c`d", "n_words", "n_removed", "kept"]
    got = quality.score(docs, None)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "N_Lines", "c`d", "score", "predicted"]
    assert {r[6] for r in got.collect()} == {"lines"}
    rows = mixing.measured(docs, keep=["a.b", "n_chars"])
    assert {tuple(r) for r in rows.select("kept.*").collect()} == {(r[5], r[4]) for r in corpus()}
    assert mixing.texts(docs, rows, mixing.plan_for(rows, block=32)).select("kept").distinct().count() > 3


def test_short_lines_that_repeat_go(spark, tmp_path):
    import corpus_pipeline
    from stallmark.llm import queries

    rows = [(1, "a\n- x\na\n\nlast"), (2, "\n- x\n}\nown"), (3, " -  x \n\n}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ("a\n- x\n\nlast", 5, 1), 2: ("\n}\nown", 4, 1), 3: ("", 3, 2)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()} == {1: "a\n- x\n\nlast", 2: "\n}\nown"}


@given(st.lists(st.integers(0, 2), max_size=7), st.lists(st.integers(0, 2), max_size=7))
@settings(max_examples=100, deadline=None)
def test_one_apart_is_the_edit_distance(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert line_dedup.one_apart(a, b) == (d[-1, -1] <= 1)


def brute_components(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [r[0] for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return sorted([(ids[i], len(s), ids[find(i)]) for i, s in enumerate(sets)], key=str)


def test_ngram_components(docs):
    got = ngram_join.jaccard_components(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(corpus())


def test_mixing(docs):
    rows = mixing.measured(docs)
    plan = mixing.plan_for(rows, block=32)
    got = [tuple(r) for r in mixing.taken_words(rows, plan).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.taken_words(rows, plan).collect()), key=str)
    assert sorted((g[:3] for g in got), key=str) == sorted(((r[0], r[3], len(split(r[1]))) for r in corpus()), key=str)
    taken = defaultdict(int)
    for _, s, size, n in got:
        assert n <= 2 * size
        taken[s] += n
    for s, size, target in zip(plan.names, plan.sizes, plan.targets, strict=True):
        assert abs(taken[s] - target) <= 1 and target <= 2 * size
    assert abs(sum(plan.targets) - 1.5 * sum(plan.sizes)) < 1e-6
    texts = mixing.texts(docs, rows, plan).collect()
    assert sum(len(split(r.text)) for r in texts) == sum(n for *_, n in got)
    originals = {(i, t) for i, t, *_ in corpus()}
    whole = [r for r in texts if len(split(r.text)) == r.size]
    assert whole and all((r.id, r.text) in originals for r in whole)
    assert sorted(str(r.id) for r in texts if r.size == 0) == sorted(str(r[0]) for r in corpus() if not split(r[1]))
    for r in texts:
        assert any(i == r.id and b" ".join(split(r.text)) in b" ".join(split(t)) or len(split(t)) == r.size for i, t in originals)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_targets_share_the_excess(sizes):
    w = [[5.0, 2.0, 1.0][i % 3] for i in range(len(sizes))]
    t = mixing.targets(sizes, w)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    open_ = [x / y for x, y, s in zip(t, w, sizes, strict=True) if x < 2 * s - 1e-9]
    assert not open_ or max(open_) - min(open_) < 1e-6


@given(st.integers(1, 500), st.integers(0, 10**9))
@settings(max_examples=50, deadline=None)
def test_permutations_and_shard_counts(n, key):
    assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))
    plan = mixing.make_plan([("a", n), ("b", 3 * n), (None, 7)], block=8, per_shard=5, seed=key % 97)
    total, before = np.zeros(3, int), np.zeros(3, int)
    for k in range(plan.shards):
        c, b = plan.counts(k)
        assert (b == total).all() and c.sum() <= 5
        total += c
    assert total.tolist() == plan.slots and (before == 0).all()


def test_packing(docs):
    rows = packing.pack(docs, length=256, stretch=1000).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus())
    docs_of, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append(r)
        docs_of[r.doc_id].append(r)
    for s in sequences.values():
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and sum(r.length for r in s) <= 256
    used = [sum(r.length for r in s) for s in sequences.values()]
    assert sum(256 - u for u in used if u & (u - 1)) < 0.05 * sum(used)
    assert sum(len(r.ids) for r in rows) == sum(map(len, want))
    whole = [tuple(x for r in sorted(v, key=lambda r: r.start) for x in r.ids) for k, v in docs_of.items() if k not in (3,)]
    assert not set(whole) - set(want)


@given(st.lists(st.integers(1, 7), min_size=1, max_size=12), st.data())
@settings(max_examples=60, deadline=None)
def test_best_cuts_are_best(steps, data):
    pos = np.concatenate([[0], np.cumsum(steps)])
    pen = np.array([0, *data.draw(st.lists(st.integers(0, 5), min_size=len(steps), max_size=len(steps)))])
    at = {int(p): int(q) for p, q in zip(pos, pen, strict=True)}
    cost = lambda cuts: sum(10 - (b - a) + at[b] for a, b in zip(cuts, cuts[1:], strict=False))
    best = {0: 0}
    for j in pos[1:].tolist():
        best[j] = min(best[i] + 10 - (j - i) + at[j] for i in best if j - i <= 10)
    assert cost(packing.best_cuts(pos, pen, 10)) == best[int(pos[-1])]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizer(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokens.word_ids(path)
    ids, at = coder.encode(pa.array([text, "thin, <|endoftext|>x", text]))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[at[0] : at[1]].tolist() == want == ids[at[2] : at[3]].tolist()
    assert ids[at[1] : at[2]].tolist() == coder.tokenizer.encode("thin, <|endoftext|>x", add_special_tokens=False).ids


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT permission"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i != 40)
    some = " ".join(mit.split()[:40])
    rows = [(1, "noise " * 50 + mit.upper() + " noise"), (2, "x " * 300 + broken), (3, some), (4, "Released under the MIT License."), (5, "Released under no license"), (6, None), (7, ""), (4, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0")]
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT permission"), (2, "MIT permission"), (4, "MIT statement"), (None, "CC-BY-NC-4.0 statement")}


def test_quality(spark):
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200))) + "."
    bad = lambda: " | ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) + "!!" for _ in range(r.randint(20, 200)))
    rows = [(i, good() if i % 4 else bad()) for i in range(240)] + [(900, None), (901, ""), (None, good()), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)] + [(7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels.where(~quality.held_out()))
    got = quality.score(docs.select("doc_id", quality.held_out().alias("held_out"), "text"), model).collect()
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240 and x.text != "again"]
    assert len(held) > 60 and all(x.predicted == int(x.doc_id % 4 > 0) for x in held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got) and len(got) == len(rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 3 == 1) for x in got)
    assert {x.score for x in quality.score(docs, None).collect()} == {0.5}
    one = {x.doc_id: x.score for x in quality.score(docs.where("doc_id = 9"), model).collect()}
    assert abs(one[9] - next(x.score for x in got if x.doc_id == 9)) < 1e-6  # neighbours in a batch do not matter


def test_empty_tables(empty):
    for got in (substring_dedup.dedup_substrings(empty), line_dedup.dedup_lines(empty), ngram_join.jaccard_components(empty), license_scan.scan(empty), packing.pack(empty), quality.score(empty, None)):
        assert got.count() == 0
    rows = mixing.measured(empty)
    assert mixing.taken_words(rows, mixing.plan_for(rows)).count() == 0


def test_kept_hash_is_of_the_kept_words(docs):
    from pyspark.sql import functions as F

    got = substring_dedup.dedup_substrings(docs, 50).select("kept", F.sha2("kept", 256).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
