"""Messages reach the outbox once, whatever fails between their writing and their commit."""

from pathlib import Path

import pyarrow as pa
import pytest

from stallmark.streaming import outbox

KIND = "notification_id long, at timestamp"


def broken():
    """A sink that commits nothing: as a driver that dies when the tasks have written."""

    class Dies(outbox.OutboxWriter):
        def commit(self, messages, batchId):
            raise RuntimeError("driver lost")

        def abort(self, messages, batchId):
            pass

    class Broken(outbox.Outbox):
        def streamWriter(self, schema, overwrite):
            return Dies(self.options["path"])

    return Broken


def messages(spark, where, ids, minute=0):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{minute:02d}:00") for i in ids], "notification_id long, at string")
    rows.selectExpr("notification_id", "cast(at as timestamp) at").write.mode("append").parquet(f"{where}/in")
    return spark.readStream.schema(KIND).parquet(f"{where}/in")


def sent(spark, where):
    return sorted(r.notification_id for r in outbox.read_outbox(spark, f"{where}/out", KIND).collect())


def test_each_message_once(spark, tmp_path):
    where = str(tmp_path)
    fill = lambda s: outbox.fill_outbox(s, f"{where}/out", f"{where}/check", "notification_id", "at", "10 minutes")
    fill(messages(spark, where, range(5))).awaitTermination()
    assert sent(spark, where) == [0, 1, 2, 3, 4]
    second = messages(spark, where, range(3, 8), 1)
    good = outbox.Outbox
    outbox.Outbox = broken()
    try:
        with pytest.raises(Exception, match="driver lost"):
            fill(second).awaitTermination()
    finally:
        outbox.Outbox = good
    assert sent(spark, where) == [0, 1, 2, 3, 4] and len(list(Path(where, "out/files").iterdir())) > 1  # written, not published
    fill(second).awaitTermination()
    assert sent(spark, where) == list(range(8))
    fill(second).awaitTermination()
    assert sent(spark, where) == list(range(8))


def test_a_published_batch_is_not_published_again(spark, tmp_path):
    writer = outbox.OutboxWriter(str(tmp_path))
    rows = lambda *ids: iter([pa.RecordBatch.from_pydict({"notification_id": list(ids)})])
    first, again, empty = writer.write(rows(1, 2)), writer.write(rows(1, 2)), writer.write(iter([]))
    writer.commit([first, empty, None], 0)
    writer.commit([again], 0)
    assert sorted(r.notification_id for r in outbox.read_outbox(spark, str(tmp_path), "notification_id long").collect()) == [1, 2]
    assert [p.name for p in (tmp_path / "files").iterdir()] == first.names
    assert outbox.read_outbox(spark, str(tmp_path / "none"), "notification_id long").count() == 0
