"""Hard negatives, the conversation trie and token files against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallmark.llm import conversation_trie, hard_negatives, token_files
from stallmark.llm.byte_ids import ByteIds

BPE = public_tokenizers.path("byte_bpe_50k.json")


def every(n):
    return lambda i: i % n == 0


# Hard negatives


def brute_negatives(rows, step, positives=5, negatives=10):
    sound = [(i, str(y), [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if None not in (i, y, v) and None not in v and np.isfinite(v).all()]
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)
    anchors = {}
    for i, y, v in sound:
        if i % step == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, q) in anchors.items():
        met = sorted((-product(q, v), i, z) for i, z, v in sound if i != a and len(v) == len(q))
        for s, p, _ in [x for x in met if x[2] == y][:positives]:
            fit = [x for x in met if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def labelled():
    r = np.random.default_rng(5)
    lean = r.standard_normal((12, 12)) * np.linspace(4, 0.1, 12)
    rows = [(i, int(i % 3), [float(x) for x in np.float32(r.standard_normal(12) @ lean / 8)]) for i in range(300)]
    rows += [(300 + i, 1, rows[i % 4][2]) for i in range(40)] + [rows[20], rows[20], rows[33]]  # ties and repeated rows
    rows += [(1000, None, [1.0] * 12), (1010, 1, None), (1020, 1, [float("nan")] * 12), (1030, 1, []), (1040, 2, []), (1050, 0, [1.0] * 5), (1051, 0, [2.0] * 5), (1052, 1, [1.0] * 5), (1060, 1, [None] * 12), (1070, 1, [float("inf")] * 12), (None, 1, [1.0] * 12)]
    return rows + [(1080, 1, [0.0] * 12), (1081, 1, [1e12] + [1.0] * 11), (1090, 2, [1e11] * 12), (1091, 1, [1e30] + [0.5] * 11)]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 4000, "dims_per_block": 3}])
def test_hard_negatives(spark, options):
    rows = labelled()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, VEC_ID string, `a.b` int").repartition(3)
    got = hard_negatives.mine_negatives(table, every(10), **options)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine_negatives(table, every(10)).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0])], table.schema)
    assert hard_negatives.mine_negatives(alone, every(10)).count() == 0


def test_bounds_discard_without_loss():
    r = np.random.default_rng(2)
    m = np.floor(r.standard_normal((500, 32)) * np.linspace(300, 1, 32))
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    group = hard_negatives.Group(list(range(500)), ["a"] * 500, list(m), turn, 4)
    for q in m[:20]:
        turned, heads = group.heads(q[None])
        scores = (m @ q).astype(int)
        lo, hi = np.sort(scores)[[50, 430]].tolist()
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if lo <= s <= hi)[:7]
        assert group.best(np.arange(500), np.zeros(0, int), q, turned[0], heads[0], 7, lo, hi) == [(i, -s) for s, i in want]


# Conversation trie


def rebuilt(rows, base=lambda c: c - c % 100, head=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    return {c: own.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}


def brute_trie(conversations):
    members, children, ends, leaves, saved = (defaultdict(list) for _ in range(5))
    for c, v in conversations.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]].append((len(m) - 1) * len(k[-1][1]) if k else 0)
            leaves[k[:d]].append(k not in children)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), sum(leaves[k]), sum(saved[k]), sha(ends[k])) for k, m in list(members.items()))


def trie(df, **options):
    seqs = conversation_trie.branched(conversation_trie.sequences(df), lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, 5)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in conversation_trie.prefix_trie(seqs, **options).collect())


def chats():
    r = random.Random(3)
    rows = [(c, t, r.choice("ua"), r.choice(["x", "yy", "zé😀", None])) for c in r.sample(range(-50, 700), 150) for t in range(r.choice([1, 2, 3, 5, 9]))]
    rows += [(c, t, "u", "same") for c in range(1000, 1040) for t in range(8)]  # copies
    rows += [(1100, None, "u", "first"), (1100, 1, None, None), (1101, 1, "u", "a"), (1101, 1, "u", "b"), (1101, 1, "u", "b"), (None, 1, "u", "lost")]
    return rows + [(1200, t, "u", f"long {t}") for t in range(400)] + [(c, t, "u", f"long {t}") for c in (1207, 1213) for t in range(300 + c % 7)]


@pytest.mark.parametrize("block_bytes", [1, 400, 3000, conversation_trie.BLOCK_BYTES])
def test_prefix_trie(spark, block_bytes):
    rows = chats()
    df = spark.createDataFrame([(*x, 0, "y") for x in rows], "conv_id long, turn long, role string, text string, TURN int, `c.d` string").repartition(5)
    assert trie(df, block_bytes=block_bytes) == brute_trie(rebuilt(rows))


def test_trie_of_little(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(df) == []
    c = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 6)
    one = spark.createDataFrame([(c, 0, "u", "gone")], df.schema)  # its only turn is cut off, and there is no conversation 0
    assert trie(one) == brute_trie({c: []})


def test_lcps_and_intervals():
    r = random.Random(1)
    for _ in range(50):
        keys = sorted({b"".join(bytes([r.randint(0, 1)]) * 20 for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 12))})
        common = lambda a, b: next((i for i in range(0, min(len(a), len(b)), 20) if a[i : i + 20] != b[i : i + 20]), min(len(a), len(b))) // 20
        lcp = conversation_trie.lcps(keys)
        assert lcp.tolist() == [-1, *(common(a, b) for a, b in zip(keys, keys[1:], strict=False))]
        for left, right, depth, parent, low, equal in conversation_trie.intervals(lcp, list(range(len(keys)))):
            inside = lcp[left + 1 : right + 1]
            assert low == left and inside.min() == depth and (inside == depth).sum() == equal and max(lcp[left], [*lcp, -1][right + 1]) == parent < depth


# Token files


def texts():
    r = random.Random(9)
    odd = ["", None, " ", "\n\n x", "a  b", "don't 'sfoo, it's", "x<|endoftext|> y  <|endoftext|>", "é, né. 你好　世界   z  ", "tail  ", "\x1c\x85", "😀" * 50, "no" * 5000, "word " * 30000]
    return odd + ["".join(r.choice(" ab'.1\n\té <|S") for _ in range(r.randint(0, 60))) for _ in range(300)]


def test_byte_ids_equal_the_tokenizer():
    plain, some = Tokenizer.from_file(BPE), texts()
    for lo in (0, 5, 100):
        got = ByteIds(BPE).encode(pa.array(some[lo:]))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in some[lo:]]


@pytest.mark.parametrize("options", [{}, {"parts": 3, "shard_bytes": 500}])
def test_token_files(spark, tmp_path, options):
    plain = Tokenizer.from_file(BPE)
    rows = [(3 * i - 50, t) for i, t in enumerate(texts())] + [(7, "seven"), (7, "seven"), (None, "first"), (None, None)]
    encoded = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0]
    table = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, DOC_ID string, ids int").repartition(4)
    path = str(tmp_path / "corpus")
    manifest = token_files.write_corpus(table, path, BPE, **options)
    got = sorted(token_files.read_corpus(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0, np.array(encoded(t), "<u2").tobytes()) for i, t in rows), key=lambda x: x)
    assert [r.doc_id for r in got] == [i if some else None for some, i, _ in want]
    ids = [np.frombuffer(x, "<u2") for _, _, x in want]
    assert [r.ids for r in got] == [x.tolist() for x in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist() and [r.n_tokens for r in got] == [len(x) for x in ids]
    shards = sorted(manifest.collect(), key=lambda r: r.base)
    flat = np.concatenate([np.fromfile(f"{path}/{r.shard}.ids", "<u2") for r in shards])
    assert flat.tolist() == [x for own in ids for x in own.tolist()]
    first = token_files.Shard.open(path, shards[0].shard, shards[0].width)
    assert isinstance(first.ids, np.memmap) and first.document(1).tolist() == ids[1].tolist()
    if options:
        assert len(shards) > 3


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert token_files.write_corpus(spark.createDataFrame([], "doc_id long, text string"), path, BPE).count() == 0
    assert token_files.read_corpus(spark, path).count() == 0


def test_files_of_other_file_systems(tmp_path):
    other = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    token_files.put(other, "x.ids", b"\x01\x00", b"\x02\x00")
    assert token_files.get(other, "x.ids", "<u2").tolist() == [1, 2] and [f.base_name for f in other.get_file_info(fs.FileSelector(""))] == ["x.ids"]
