"""Words that a public hash would take for each other."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from stallmark.llm import line_dedup, ngram_join, substring_dedup
from stallmark.llm.kernels import Words, keyed_hashes, segment_hashes, span_hashes
from stallmark.llm.tokens import WordIds

#: Two words with one polynomial hash modulo 2**64.
TWINS = ("aaaaaabeaacbacdbeaacabba", "bdcbcaaacaaadaaaaacacaaa")


def test_hashes():
    w = Words(pa.array([" ".join(TWINS), TWINS[0]]))
    plain, keyed = segment_hashes(w.buf, w.start, w.end), w.hashes()
    assert plain[0] == plain[1] and keyed[0] != keyed[1] and keyed[0] == keyed[2]
    assert len(keyed_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0 == len(Words(pa.array([None, ""])).hashes())


def test_spans_of_two_words():
    """Alternations by the parity of bits and their opposites: any polynomial modulo 2**64 takes them for each other."""
    bits = np.array([bin(i).count("1") & 1 for i in range(4096)])
    h = np.where(np.concatenate([bits, 1 - bits, bits]) == 1, np.uint64(3), np.uint64(9))
    a, b, c = span_hashes(h, np.array([0, 4096, 8192]), np.array([4096, 8192, 12288])).tolist()
    assert a == c != b


def test_operators_tell_them_apart(spark):
    a, b = (" ".join([w] * 60) for w in TWINS)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0}
    words = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1])], docs.schema)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(words).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(words).select("doc_id", "text").collect()} == dict(enumerate(TWINS, 1))
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, ends = WordIds(path).encode(pa.array(TWINS))
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in (0, 1)] == [Tokenizer.from_file(path).encode(w, add_special_tokens=False).ids for w in TWINS]
