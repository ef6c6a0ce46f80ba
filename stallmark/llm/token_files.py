"""Token ids of a corpus as flat binary files, written and read back by tasks.

A corpus is a folder of shards and a manifest. `<shard>.ids` holds nothing but token ids, unsigned and little-endian, 16
bits wide where the vocabulary allows it and 32 else; `<shard>.offsets` holds 64-bit positions, one where each document
begins in the shard and one at its end; `<shard>.docs` holds the 64-bit document ids. The manifest (Parquet) has a row for
each shard with its base, the ids of all shards before it. So document i of a shard is ids[offsets[i]:offsets[i + 1]] of a
memory-mapped file and begins at base + offsets[i] of the corpus.

Tasks encode texts where they are read; only ids are shuffled, to parts that follow each other by document id. A part cuts
its documents into shards of bounded size and moves each file to its final name when it is whole, so a repeated task
writes the same files again. Bases are prefix sums over the shards: of the corpus, one small row a shard passes the driver.

Defined results: a null text counts as empty and has the end id alone; documents with a null id come first, and documents
with the same id follow each other by the bytes of their ids; an empty table gives a manifest without rows and no
documents; a document of any length lies in one shard; other columns of the table are ignored, whatever their names. Ids
of documents must fit a long, file names are taken from the part alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.llm.byte_ids import byte_ids
from stallmark.llm.kernels import plain

#: Bytes of ids after which a shard ends, of ids read at once, and of text encoded at once.
SHARD_BYTES, READ_BYTES, TEXT_BYTES = 64 << 20, 4 << 20, 8 << 20
MANIFEST = "shard string, part int, number int, documents long, nulls long, tokens long, width int"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def put(at: fs.FileSystem, path: str, *chunks: bytes) -> None:
    """A whole file under its final name, or none."""
    draft = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
    with at.open_output_stream(draft) as out:
        for c in chunks:
            out.write(c)
    at.move(draft, path)


def get(at: fs.FileSystem, path: str, of: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system is a local one or mounted, read as a whole else."""
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(path, of, "r") if at.get_file_info(path).size else np.zeros(0, of)
    with at.open_input_file(path) as f:
        return np.frombuffer(f.read(), of)


@dataclass
class Shard:
    """The documents of one shard; ids are read where they are asked for."""

    ids: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray

    @classmethod
    def open(cls, path: str, shard: str, width: int) -> Shard:
        at, root = place(path)
        return cls(get(at, f"{root}/{shard}.ids", f"<u{width}"), get(at, f"{root}/{shard}.offsets", "<i8"), get(at, f"{root}/{shard}.docs", "<i8"))

    def __len__(self) -> int:
        return len(self.docs)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their column holds about limit bytes."""
    have, size = [], 0
    for b in batches:
        have.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.concat_batches(have)
            have, size = [], 0
    if have:
        yield pa.concat_batches(have)


def _encode(tokenizer: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in gathered(batches, "text", TEXT_BYTES):
            ids = [x + end for x in encoder.encode(b["text"])]
            known = b["id"].fill_null(0).to_numpy()
            part = np.where(b["id"].is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, known, "right"))
            size = np.cumsum([len(x) for x in ids])
            lo = 0
            while lo < len(ids):
                hi = max(int(np.searchsorted(size, (size[lo - 1] if lo else 0) + READ_BYTES, "right")), lo + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part[lo:hi], pa.int32()), b["id"].slice(lo, hi - lo), pa.array(ids[lo:hi], pa.binary())], ["part", "id", "ids"])
                lo = hi

    return run


def _write(path: str, width: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = place(path)
        part, number, have, docs, size, nulls = None, 0, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, have, docs, size, nulls
            if docs:
                name = f"part-{part:06d}-{number:06d}"
                offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in have])]).astype("<i8")
                put(at, f"{root}/{name}.ids", *have)
                put(at, f"{root}/{name}.offsets", offsets.tobytes())
                put(at, f"{root}/{name}.docs", np.array(docs, "<i8").tobytes())
                yield pa.RecordBatch.from_pylist([{"shard": name, "part": part, "number": number, "documents": len(docs), "nulls": nulls, "tokens": int(offsets[-1]), "width": width}], schema)
            number, have, docs, size, nulls = number + 1, [], [], 0, 0

        schema = pa.schema([("shard", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())])
        for b in batches:
            for p, doc, ids in zip(b["part"].to_pylist(), b["id"].to_pylist(), b["ids"], strict=True):
                if p != part or size >= shard_bytes:
                    yield from flush()
                    number, part = (number, part) if p == part else (0, p)
                have.append(ids.as_py())
                docs.append(doc or 0)
                nulls += doc is None
                size += len(have[-1])
        yield from flush()

    return run


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of every text with end_id behind each, in ascending order of the document ids; the manifest. `path` is
    a folder that all executors reach by the same name; `tokenizer` a byte-level vocabulary file present on each of them.
    As many parts run at once as Spark's shuffles have partitions, unless `parts` says otherwise."""
    spark = docs.sparkSession
    rows = plain(docs, id_col, text_col, ())[0].select(F.col("id").cast("long").alias("id"), "text")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = rows.select(F.percentile_approx("id", cuts, max(10_000, 20 * parts))).first()[0] if cuts else None
    width = byte_ids(tokenizer).dtype.itemsize
    at, root = place(path)
    at.create_dir(root)
    ids = rows.mapInArrow(_encode(tokenizer, end_id, np.array(bounds or [], np.int64)), "part int, id long, ids binary")
    dealt = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "id", "ids")
    shards = sorted(dealt.mapInArrow(_write(path, width, shard_bytes), MANIFEST).collect(), key=lambda r: (r.part, r.number))
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in shards])]).astype(np.int64).tolist()
    spark.createDataFrame([(*r, base) for r, base in zip(shards, bases[:-1], strict=True)], f"{MANIFEST}, base long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _read(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard, lo = Shard.open(path, r["shard"], r["width"]), 0
                while lo < len(shard):
                    hi = max(int(np.searchsorted(shard.offsets, shard.offsets[lo] + READ_BYTES // r["width"], "right")) - 1, lo + 1)
                    offsets = np.asarray(shard.offsets[lo : hi + 1])
                    ids = shard.ids[offsets[0] : offsets[-1]].astype("<u4")
                    raw, at = memoryview(ids).cast("B"), (4 * (offsets - offsets[0])).tolist()
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    null = np.arange(lo, hi) < r["nulls"]
                    columns = [pa.array(np.asarray(shard.docs[lo:hi]), mask=null), pa.array(offsets[:-1] + r["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    lo = hi

    return run


def read_corpus(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of `path`, with_ids its ids too: start counts the
    ids of all documents before it, n_tokens its own with the end id, ids_crc32 is theirs as unsigned 32-bit integers."""
    shards = spark.read.parquet(f"{path}/manifest").repartition(F.col("shard"))
    return shards.mapInArrow(_read(path, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
