"""Series that share a state: a bucket holds all of its series' rows as two Arrow tables, so that a bucket, not a series, is what
a micro-batch fetches and writes back, and its series are worked on at once."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a bucket should meet in the whole stream.
ROWS = 10_000


def buckets_for(rows: int) -> int:
    return max(16, rows // ROWS)


def bucketed(stream: DataFrame, buckets: int, key: str = "listing_id"):
    """The stream grouped by bucket; a series keeps its bucket as long as their number stays."""
    return stream.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def pack(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpack(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(state)).read_pandas()


def before(rows: pd.DataFrame, last: pd.DataFrame, columns: list[str], time: list[str]) -> pd.DataFrame:
    """rows in order of series and time, with what the row before in the series had of the columns, as _column: of the first row
    what `last` has (a row a series at most), NaN without one; _end marks the last row of a series, _new rows are not of `last`."""
    both = pd.concat([last.assign(_new=False), rows.assign(_new=True)], ignore_index=True)
    both["_series"] = pd.factorize(both["listing_id"], use_na_sentinel=False)[0]
    both["_new"] = both["_new"].astype(bool)
    both = both.sort_values(["_series", "_new", *time], kind="stable")
    same = both["_series"].eq(both["_series"].shift())
    for c in columns:
        both[f"_{c}"] = both[c].shift().where(same)
    both["_end"] = ~same.shift(-1, fill_value=False)
    return both
