"""Functions of whole chunks on a stream: a chunk and its pad wait in state until the watermark is behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyframe.operators import chunks
from skyframe.streaming import held
from skyframe.streaming.windows import timed


class _Held(StatefulProcessor):
    """Rows of one bucket of keys and one chunk."""

    def __init__(self, keys: Sequence[str], row: Sequence[str], times: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], order: Sequence[str], columns: Sequence[str]):
        self.keys, self.row, self.times, self.function, self.order, self.columns = list(keys), list(row), list(times), function, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        close = None
        for batch in rows:
            self.rows.appendValue((held.packed(batch[[*self.keys, *self.row]]),))
            close = -(-int(batch["skyframe_close"].iloc[0]) // 1000)
        if close is not None:
            self.handle.registerTimer(close)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            return
        found = held.unpacked([bytes(r[0]) for r in self.rows.get()])
        for c in self.times:
            found[c] = pd.to_datetime(found[c], unit="us")
        self.rows.clear()
        found = found.sort_values([*self.keys, *self.order], kind="stable").reset_index(drop=True)
        out = self.function(found)
        if len(out):
            yield out.assign(chunk_id=key[-1])[self.columns]

    def close(self) -> None:
        pass


def per_chunk(
    stream: DataFrame, bounds: chunks.Bounds, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *keys: str, pad: str | None = None, time: str = "epoch", ties: tuple[str, ...] = (), late: str = "1 hour",
    together: bool = False, buckets: int = held.BUCKETS,
) -> DataFrame:
    """``keys``, ``chunk_id`` and what ``function`` makes of each key's rows of each chunk and its pad, in order of time, once these are whole.

    ``function`` takes all columns of the stream but ``keys``, and ``in_chunk``, and gives the columns of ``schema`` (DDL). A chunk is whole when the watermark, which is ``late``
    behind the latest time, has passed its end and pad; then its state goes. So the state holds the chunks that are open. Keys are dealt into
    ``buckets`` by hash, and a bucket's rows of a chunk have to fit into a task. With ``together`` ``function`` takes a chunk's rows of many keys at once, ordered by keys and
    then by time, with the columns ``keys``, and gives ``keys`` as well: it saves a call for each key. Keys may not be null. The state store has to be RocksDB, as :func:`skyframe.streaming.windows.run_once` sets it for ``stateful`` streams.
    """
    named = chunks.with_chunks(timed(stream, time, late), bounds, time, pad=pad)
    ends = {i: b for i, _, b in bounds.chunks()}
    reach = pd.Timedelta(pad or 0)
    close = F.create_map(*[F.lit(x) for i, b in ends.items() for x in (i, int((b + reach - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)))]) if ends else F.create_map()
    micros = [f.name for f in stream.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    plain = [c for c in stream.columns if c not in keys and c not in micros]
    own = [F.unix_micros(F.col(c).cast("timestamp")).alias(f"skyframe_us_{c}") for c in micros]
    taken = named.select(held.bucket(keys, buckets).alias(held.BUCKET), *keys, "chunk_id", *own, *plain, "in_chunk", close[F.col("chunk_id")].alias("skyframe_close"))
    kinds = {f.name: f.dataType for f in taken.schema}
    made = T._parse_datatype_string(schema)
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("chunk_id", T.IntegerType()), *made.fields])

    def called(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.rename(columns={f"skyframe_us_{c}": c for c in micros})
        if together or not keys:
            return function(rows)
        found = []
        for key, own_rows in rows.groupby(list(keys), sort=False):
            one = function(own_rows.drop(columns=list(keys)).reset_index(drop=True))
            if len(one):
                found.append(one.assign(**dict(zip(keys, key, strict=True))))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame()

    times = [f"skyframe_us_{c}" for c in micros]
    processor = _Held(keys, [*times, *plain, "in_chunk"], times, called, [f"skyframe_us_{time}", *ties], [f.name for f in out])
    return taken.groupBy(held.BUCKET, "chunk_id").transformWithStateInPandas(processor, out, "Append", "eventTime")
