"""Captured API pages as a data source that Spark pushes filters into.

A store is a folder of bundles. A bundle holds the JSON bodies of neighbouring pages of one search on end; its index has
for each page the place of its body, its offset, how many items it holds, and their lowest and highest price. The manifest
(Parquet) has a row for each bundle with the same facts, with the first empty page and the total that its pages name, and
with its bytes.

Planning reads the manifest alone: bundles of other searches, past a search's end, or out of the asked range of prices or
places go to no partition. A partition holds as many of the others as make a task worth its start. A task reads the indexes
of its bundles, and of the bodies those whose prices and places may fit. Items are then held against the filters themselves,
so Spark need not filter again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from stallmark.functions.text import normalize_title

ITEM = "source string, slug string, seq long, id string, title string, price double, currency_id string, permalink string, thumbnail string"
BUNDLE = "bundle string, source string, slug string, first long, last long, pages long, low double, high double, empty long, total long, bytes long"
_MANIFEST = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in BUNDLE.split(", ")])
_ITEM = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in ITEM.split(", ")])
#: Bytes of bundles that make a task, and those that opening a bundle counts as.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Bytes of bodies whose items make a batch.
BATCH_BYTES = 1 << 20
_LEAST = {"price": float("-inf"), "seq": -(1 << 63)}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _put(at: fs.FileSystem, path: str, body: bytes) -> None:
    """The whole file or none: a repeated task puts the same file in its place."""
    draft = f"{path}.{id(body):x}"
    with at.open_output_stream(draft) as out:
        out.write(body)
    at.move(draft, path)


def _facts(body: str) -> tuple[int, float | None, float | None, int | None]:
    parsed = json.loads(body)
    prices = [float(x["price"]) for x in parsed.get("results") or [] if x.get("price") is not None]
    return len(parsed.get("results") or []), min(prices, default=None), max(prices, default=None), (parsed.get("paging") or {}).get("total")


def slug(query):
    """The path of a search: its normalized words, joined by hyphens."""
    return F.regexp_replace(normalize_title(query), r"\s+", "-")


def write_pages(pages: DataFrame, path: str, page: int = 50, bundle_pages: int = 256) -> DataFrame:
    """Stores pages (source, query, offset, body); the manifest. A bundle spans bundle_pages pages of one search."""
    at, root = _place(path)
    at.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = _place(path)
        key, bodies, index = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not index:
                return
            source, name, number = key
            bundle = f"{source}/{name}/{number:08d}"
            at.create_dir(f"{root}/{source}/{name}", recursive=True)
            _put(at, f"{root}/{bundle}.pages", b"".join(bodies))
            _put(at, f"{root}/{bundle}.index", "\n".join(map(json.dumps, index)).encode())
            prices, totals = [p for x in index for p in (x["low"], x["high"]) if p is not None], [x["total"] for x in index if x["total"] is not None]
            row = (bundle, source, name, index[0]["offset"], index[-1]["offset"], len(index), min(prices, default=None), max(prices, default=None), min((x["offset"] for x in index if not x["items"]), default=None), max(totals, default=None), index[-1]["start"] + index[-1]["length"])
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, row, strict=True))], _MANIFEST)

        for b in batches:
            for source, name, number, offset, body in zip(*(b[c].to_pylist() for c in ("source", "slug", "number", "offset", "body")), strict=True):
                if (source, name, number) != key:
                    yield from flush()
                    key, bodies, index = (source, name, number), [], []
                items, low, high, total = _facts(body)
                raw = body.encode()
                index.append({"offset": offset, "start": sum(map(len, bodies[-1:])) + (index[-1]["start"] if index else 0), "length": len(raw), "items": items, "low": low, "high": high, "total": total})
                bodies.append(raw)
        yield from flush()

    rows = pages.select("source", slug(F.col("query")).alias("slug"), F.floor(F.col("offset") / (page * bundle_pages)).alias("number"), F.col("offset").cast("long").alias("offset"), "body")
    rows.repartition("source", "slug", "number").sortWithinPartitions("source", "slug", "number", "offset").mapInArrow(write, BUNDLE).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(BUNDLE).parquet(f"{path}/manifest")


@dataclass
class Asked:
    """The conjunction of the filters that were pushed: bounds of price and place (value, whether itself is out), and names."""

    low: dict[str, tuple[float, bool]] = field(default_factory=dict)
    high: dict[str, tuple[float, bool]] = field(default_factory=dict)
    equal: dict[str, set] = field(default_factory=dict)
    present: set[str] = field(default_factory=set)

    def take(self, f: Filter) -> bool:
        """Whether f is now part of this."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull) and name in ("source", "slug", "seq", "price"):
            self.present.add(name)
        elif isinstance(f, EqualTo) and name in ("source", "slug"):
            self.equal.setdefault(name, {f.value}).intersection_update({f.value})
        elif isinstance(f, EqualTo) and name in ("seq", "price"):
            return self.take(GreaterThanOrEqual(f.attribute, f.value)) and self.take(LessThanOrEqual(f.attribute, f.value))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in ("seq", "price"):
            bound = (f.value, isinstance(f, GreaterThan))
            self.low[name] = max(self.low.get(name, bound), bound)
        elif isinstance(f, (LessThan, LessThanOrEqual)) and name in ("seq", "price"):
            bound = (f.value, not isinstance(f, LessThan))  # of equal bounds the strict one is less
            self.high[name] = min(self.high.get(name, bound), bound)
        else:
            return False
        return True

    def among(self, bundles: pa.Table, page: int) -> pa.Table:
        """The bundles that may hold items that are asked for, as far as names, prices and places tell."""
        for name, values in self.equal.items():
            bundles = bundles.filter(pc.is_in(bundles[name], pa.array(sorted(values), pa.string())))
        for name in self.present & {"source", "slug"}:
            bundles = bundles.filter(pc.is_valid(bundles[name]))
        for name, least, most, more in (("price", "low", "high", 0), ("seq", "first", "last", page - 1)):
            if name in self.present:
                bundles = bundles.filter(pc.is_valid(bundles[least]))
            if name in self.low:
                bundles = bundles.filter(pc.greater_equal(bundles[most], pa.scalar(max(self.low[name][0] - more, _LEAST[name]))))
            if name in self.high:
                bundles = bundles.filter(pc.less_equal(bundles[least], pa.scalar(self.high[name][0])))
        return bundles

    def spans(self, name: str, least: float | None, most: float | None) -> bool:
        """Whether a value from least to most may be asked for; without any, there is no such value but null."""
        if least is None:
            return not (name in self.low or name in self.high or name in self.present)
        return most >= self.low.get(name, (most, False))[0] and least <= self.high.get(name, (least, True))[0]

    def holds(self, name: str, value: float | None) -> bool:
        if value is None:
            return self.spans(name, None, None)
        low, high = self.low.get(name), self.high.get(name)
        return (low is None or value > low[0] or value == low[0] and not low[1]) and (high is None or value < high[0] or value == high[0] and high[1])


@dataclass
class Bundle:
    name: str
    source: str
    slug: str
    end: int | None


class Bundles(InputPartition):
    def __init__(self, bundles: list[Bundle]):
        super().__init__(None)
        self.bundles = bundles


class PagesReader(DataSourceReader):
    def __init__(self, path: str, page: int, cores: int = 1):
        self.path, self.page, self.cores, self.asked = path, page, cores, Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.asked.take(f)]

    def partitions(self) -> list[InputPartition]:
        at, root = _place(f"{self.path}/manifest")
        rows = pq.read_table(root, filesystem=at, schema=_MANIFEST)
        found = rows.group_by(["source", "slug"]).aggregate([("empty", "min"), ("total", "max")])
        ends = dict(zip(zip(found["source"].to_pylist(), found["slug"].to_pylist(), strict=True), pc.min_element_wise(found["empty_min"], found["total_max"]).to_pylist(), strict=True))
        kept, weight = [], 0  # bundles, each with the weight of those before it
        for b in self.asked.among(rows, self.page).to_batches():
            for name, source, slug, first, size in zip(*(b[c].to_pylist() for c in ("bundle", "source", "slug", "first", "bytes")), strict=True):
                end = ends[source, slug]
                if end is None or first < end:
                    kept.append((weight, Bundle(name, source, slug, end)))
                    weight += (size or 0) + OPEN_BYTES
        most = min(TASK_BYTES, -(-weight // self.cores))
        return [Bundles([x for _, x in task]) for _, task in groupby(kept, lambda x: x[0] // most)] or [Bundles([])]

    def read(self, partition: Bundles) -> Iterator[pa.RecordBatch]:
        at, root = _place(self.path)
        out, read = [], 0
        for bundle in partition.bundles:
            for size, items in self._pages(at, f"{root}/{bundle.name}", bundle):
                out += items
                read += size
                if out and read >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _ITEM)
                    out, read = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _ITEM)

    def _pages(self, at: fs.FileSystem, path: str, bundle: Bundle) -> Iterator[tuple[int, list[dict]]]:
        """Of each page of a bundle that may fit, its bytes and the items that do."""
        with at.open_input_stream(f"{path}.index") as f:
            index = [json.loads(x) for x in f.read().decode().split("\n")]
        with at.open_input_file(f"{path}.pages") as f:
            for x in index:
                offset = x["offset"]
                if bundle.end is not None and offset >= bundle.end or not x["items"] or not self.asked.spans("price", x["low"], x["high"]) or not self.asked.spans("seq", offset, offset + self.page - 1):
                    continue
                f.seek(x["start"])
                items = []
                for i, item in enumerate(json.loads(f.read(x["length"]))["results"][: self.page]):
                    price = None if item.get("price") is None else float(item["price"])
                    if self.asked.holds("price", price) and self.asked.holds("seq", offset + i):
                        items.append({"source": bundle.source, "slug": bundle.slug, "seq": offset + i, "price": price} | {c: item.get(c) for c in ("id", "title", "currency_id", "permalink", "thumbnail")})
                yield x["length"], items


class CapturedPages(DataSource):
    """Format `captured_pages`: options path (a store), page, the most items of a page (50), and cores, those to share the bundles."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options["path"], int(self.options.get("page", "50")), int(self.options.get("cores", "1")))


def read_pages(spark: SparkSession, path: str, page: int = 50) -> DataFrame:
    """Items of a store (source, slug, seq, ...), seq being their place in the search. A search ends before its first empty
    page, and with the page that reaches its total."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)
    # Spark keeps what it pushed for a query of the same DataFrame that pushes nothing, so each pushes something, true
    # of every item.
    return spark.read.format("captured_pages").option("page", page).option("cores", spark.sparkContext.defaultParallelism).load(path).where("seq is not null")
