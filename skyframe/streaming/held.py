"""Rows of many keys that wait in one state: a bucket of keys is one entry, so what a state costs each time is shared by its keys."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many buckets keys are dealt into by hash: at most so many tasks share a batch, and the waiting rows of a bucket (of one chunk) fit into a task.
BUCKETS = 64
BUCKET = "skyframe_bucket"


def bucket(keys: list[str] | tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def packed(rows: pd.DataFrame) -> bytes:
    """A batch of rows as one value, in Arrow's stream format."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(values: list[bytes]) -> pd.DataFrame:
    """All rows of several values, in their order."""
    return pa.concat_tables([pa.ipc.open_stream(v).read_all() for v in values], promote_options="permissive").to_pandas()
