"""Stores of captured pages: what the data source reads, and what it leaves unread."""

import json
from pathlib import Path

from stallmark.sources import pages


def body(first, prices, total=1000):
    return json.dumps({"results": [{"id": f"M{first + i}", "title": "x", "price": p} for i, p in enumerate(prices)], "paging": {"total": total}})


def store(spark, tmp_path):
    rows = [("mercadolivre", "Placa RTX", 2 * i, body(2 * i, [10.0 * i, None if i == 3 else 10.0 * i + 5])) for i in range(8)]
    rows += [("mercadolivre", "Civic  2020", 0, body(0, [7.0])), ("mercadolivre", "Civic 2020", 2, body(2, [])), ("mercadolivre", "Civic 2020", 4, body(4, [8.0]))]
    rows += [("olx", "placa rtx", 0, body(0, [1.0, 2.0], total=2)), ("olx", "placa rtx", 2, body(2, [3.0], total=2))]
    path = str(tmp_path / "store")
    manifest = pages.write_pages(spark.createDataFrame(rows, "source string, query string, offset long, body string"), path, page=2, bundle_pages=2)
    return path, manifest


def test_items_and_ends(spark, tmp_path):
    path, manifest = store(spark, tmp_path)
    assert manifest.count() == 4 + 2 + 1
    d = pages.read_pages(spark, path, page=2)
    every = {(r.source, r.slug, r.seq): r.price for r in d.collect()}
    want = {("mercadolivre", "placa-rtx", 2 * i + j): None if (i, j) == (3, 1) else 10.0 * i + 5 * j for i in range(8) for j in (0, 1)}
    assert every == want | {("mercadolivre", "civic-2020", 0): 7.0, ("olx", "placa-rtx", 0): 1.0, ("olx", "placa-rtx", 1): 2.0}
    for asked in ("price >= 20 and price < 45", "price > 20 and price <= 45", "price = 25", "price is null", "price is not null", "seq between 3 and 6", "price > 20 and price > 40 and seq < 12", "slug = 'civic-2020'", "slug = 'a' and slug = 'b'", "price > 5 or seq = 0", "source = 'olx' and price >= 2", "price > 1e9", "price >= 45 and price <= 45", "price > 45 and price < 45"):
        got = sorted(map(tuple, d.where(asked).select("source", "slug", "seq").collect()))
        rows = spark.createDataFrame([(*k, v) for k, v in every.items()], "source string, slug string, seq long, price double")
        assert got == sorted(map(tuple, rows.where(asked).select("source", "slug", "seq").collect())), asked
    assert d.count() == len(every)  # what an earlier query pushed is forgotten


def test_pruned_bundles_are_not_read(spark, tmp_path):
    path, manifest = store(spark, tmp_path)
    for r in manifest.where("source = 'mercadolivre' and slug = 'placa-rtx' and (high < 40 or low > 60)").collect():
        Path(f"{path}/{r.bundle}.pages").unlink()
        Path(f"{path}/{r.bundle}.index").unlink()
    asked = pages.read_pages(spark, path, page=2).where("slug = 'placa-rtx' and source = 'mercadolivre' and price between 40 and 55")
    plan = spark._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted")
    assert "* Filter" not in plan and "GreaterThanOrEqual(price,40.0)" in plan
    assert sorted(r.price for r in asked.collect()) == [40.0, 45.0, 50.0, 55.0] and asked.rdd.getNumPartitions() == 1


def test_unread_pages_of_a_bundle(spark, tmp_path):
    path, manifest = store(spark, tmp_path)
    r = manifest.where("slug = 'placa-rtx' and source = 'mercadolivre' and first = 8").first()
    file = Path(f"{path}/{r.bundle}.pages")
    index = [json.loads(x) for x in Path(f"{path}/{r.bundle}.index").read_text().split("\n")]
    raw = bytearray(file.read_bytes())
    raw[: index[0]["length"]] = b"!" * index[0]["length"]  # the page with prices 40 and 45 can no longer be parsed
    file.write_bytes(raw)
    assert [x.price for x in pages.read_pages(spark, path, page=2).where("slug = 'placa-rtx' and price >= 50 and price < 60").orderBy("price").collect()] == [50.0, 55.0]


def test_bundles_share_tasks(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(None if i % 7 == 0 else "olx", "placa rtx", 2 * i, body(2 * i, [float(i)])) for i in range(60)]
    assert pages.write_pages(spark.createDataFrame(rows, "source string, query string, offset long, body string"), path, page=2, bundle_pages=1).count() == 60
    d = pages.read_pages(spark, path, page=2)
    assert d.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # 60 before
    assert sorted(x.price for x in d.collect()) == [float(i) for i in range(60)]
    for asked, want in (("source is not null", lambda i: i % 7), ("seq >= -9223372036854775808 and price < 20", lambda i: i < 20), ("seq > 39", lambda i: i >= 20)):
        assert sorted(x.price for x in d.where(asked).collect()) == [float(i) for i in range(60) if want(i)], asked


def test_tasks_are_bounded(spark, tmp_path, monkeypatch):
    path, manifest = store(spark, tmp_path)
    monkeypatch.setattr(pages, "OPEN_BYTES", 1)
    sizes = {r.bundle: r.bytes for r in manifest.collect()}
    assert all(Path(f"{path}/{name}.pages").stat().st_size == n for name, n in sizes.items())
    for most in (1, 300, 600, 1 << 20):
        monkeypatch.setattr(pages, "TASK_BYTES", most)
        tasks = [[x.name for x in p.bundles] for p in pages.PagesReader(path, 2).partitions()]
        names = [x for t in tasks for x in t]
        assert len(set(names)) == len(names) == 6 and all(sum(sizes[x] + 1 for x in t[:-1]) < most for t in tasks)
    assert len(tasks) == 1
