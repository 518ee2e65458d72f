"""Orbits on a stream by the full rule: state keeps what the rule looks back at, event-time timers tell when a day is whole."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyframe.operators.orbits import BREAK_SHARE, DEFAULT_PERIOD_S, GAP_SHARE, LARGE_STEP, NEAR_ROWS, ORBIT_SHARE
from skyframe.session import known
from skyframe.streaming import held
from skyframe.streaming.windows import timed

_DAY_US = 86_400_000_000
#: What is carried from day to day: rows that were given out, as far as the rule looks back; whole rows that still wait for those
#: behind them; the last break; rows given out so far, the last typical step and the last orbit.
_START = {"told": [], "waits": [], "last": None, "n": 0, "step": None, "orbit": 1}


def _breaks(t: np.ndarray, v: np.ndarray, step: np.ndarray, first: int, span: float, period: float) -> np.ndarray:
    """Which rows (times in microseconds, values, typical steps) are breaks; ``first`` is the first row's number. The last row is no fall."""
    dv, dt = np.diff(v, prepend=np.nan), np.diff(t.astype(float), prepend=np.nan) / 1e6
    big = dv > LARGE_STEP * step
    odd = big & ~(dt * span < dv * period)
    fall = dv < -BREAK_SHARE * step
    norm = dt / period
    gap = (norm > 1) | ((norm > np.abs(dv) / span) & (norm > GAP_SHARE))
    near = lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, NEAR_ROWS), 2 * NEAR_ROWS + 1).any(axis=1)
    alone = np.append(~fall[1:], False)
    return gap | (fall & alone & ((first + np.arange(len(t)) < NEAR_ROWS) | ~near(big) | near(odd)))


def advance(carry: dict, days: Sequence[Sequence[tuple]], span: float, period: float, ended: bool) -> tuple[dict, list[tuple[tuple, int]]]:
    """Takes whole days of rows ``(t, v, ...)`` in order; gives what is carried on, and rows with their orbits.

    A row is given out once as many rows as the rule looks ahead at are whole, or when the record has ``ended``.
    """
    told, waits, step = list(carry["told"]), list(carry["waits"]), carry["step"]
    for day in days:
        inside = np.diff(np.array([np.nan if r[1] is None else r[1] for r in day], float))
        inside = inside[~np.isnan(inside)]
        step = float(np.median(inside)) if len(inside) else step
        waits += [(list(r), step) for r in day]
    rows = told + waits
    ready = len(rows) if ended else max(len(told), len(rows) - NEAR_ROWS)
    out, last, orbit, n = [], carry["last"], carry["orbit"], carry["n"]
    if ready > len(told):
        t = np.array([r[0][0] for r in rows], np.int64)
        v = np.array([np.nan if r[0][1] is None else r[0][1] for r in rows], float)
        steps = np.array([np.nan if r[1] is None else r[1] for r in rows], float)
        with np.errstate(invalid="ignore"):
            broken = _breaks(t, v, steps, n - len(told), span, period)
        for i in range(len(told), ready):
            if broken[i]:
                here = (int(t[i]), None if np.isnan(v[i]) else float(v[i]))
                # the first break of all stands; one less than an orbit behind the break before it is none
                orbit += last is None or (here[1] is not None and last[1] is not None and (here[0] - last[0]) / 1e6 / period - (here[1] - last[1]) / span > ORBIT_SHARE)
                last = here
            out.append((tuple(rows[i][0]), int(orbit)))
        n += ready - len(told)
    return {"told": rows[max(0, ready - NEAR_ROWS - 1) : ready], "waits": rows[ready:], "last": last, "n": n, "step": step, "orbit": int(orbit)}, out


class _Orbits(StatefulProcessor):
    """Rows of a bucket of keys wait in a list until their day is behind the watermark; what is carried for its keys is one value.

    One timer stands for the bucket, at the earliest time when any of its keys has something to give; what is due by then is done at once.
    """

    def __init__(self, keys: Sequence[str], row: T.StructType, span: float, period: float, close_us: int | None):
        self.keys, self.names, self.span, self.period, self.close_us = list(keys), row.names, span, period, close_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.carried = handle.getValueState("carried", "carry binary, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = None
        for batch in rows:
            self.waiting.appendValue((held.packed(batch[[*self.keys, *self.names]]),))
            # the earliest end of a day; a key's record that ends does so behind its last day
            first = (int(batch["t"].min()) // _DAY_US + 1) * _DAY_US
            if self.close_us is not None:
                first = min(first, int(batch["t"].min()) + self.close_us)
            due = first if due is None else min(due, first)
        if due is not None:
            carry, at = self.carried.get() if self.carried.exists() else (None, None)
            if at is None or due < at:
                self._expect(carry, at, due)
        yield from ()

    def _expect(self, carry: bytes | None, at: int | None, due: int | None) -> None:
        if at is not None and at != due:
            self.handle.deleteTimer(-(-at // 1000))
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        self.carried.update((carry, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        stored = self.carried.get()[0] if self.carried.exists() else None
        carries = pickle.loads(bytes(stored)) if stored is not None else {}  # noqa: S301 - written by this class
        values = [bytes(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        by_key: dict[tuple, list[tuple]] = {}
        rest, newest = None, {}
        if values:
            found = held.unpacked(values)
            width = len(self.keys)
            last = found["t"].groupby([found[k] for k in self.keys]).max() if width else None
            newest = {(k if isinstance(k, tuple) else (k,)): int(t) for k, t in last.items()} if width else {(): int(found["t"].max())}
            done = (found["t"] // _DAY_US + 1) * _DAY_US <= mark
            rest = found[~done]
            whole = found[done].sort_values([*self.keys, "t"], kind="stable")
            for r in zip(*[column.array.tolist() for _, column in whole.items()], strict=True):
                by_key.setdefault(r[:width], []).append(tuple(None if x is None or x != x else x for x in r[width:]))
        out, due = [], None if rest is None or not len(rest) else (int(rest["t"].min()) // _DAY_US + 1) * _DAY_US
        for one in {**dict.fromkeys(carries), **dict.fromkeys(newest)}:
            carry = carries.get(one, _START)
            times = [r[0][0] for r in carry["waits"]]
            latest = max([*times, newest[one]] if one in newest else times, default=None)
            ended = self.close_us is not None and latest is not None and latest + self.close_us <= mark
            rows = sorted(by_key.get(one, ()), key=lambda r: (r[0], tuple((x is not None, x) for x in r[2:])))
            if rows or (ended and carry["waits"]):
                days: dict[int, list[tuple]] = {}
                for r in rows:
                    days.setdefault(r[0] // _DAY_US, []).append(r)
                carries[one], given = advance(carry, list(days.values()), self.span, self.period, ended)
                out += [(*one, *r, o) for r, o in given]
            # rows that wait for others are given out when the record ends
            if self.close_us is not None and latest is not None and not ended and carries.get(one, _START)["waits"]:
                due = latest + self.close_us if due is None else min(due, latest + self.close_us)
        self.waiting.clear()
        if rest is not None and len(rest):
            self.waiting.appendValue((held.packed(rest),))
        self._expect(pickle.dumps(carries), None, due)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def cyclic_orbits(
    stream: DataFrame, variable: str, span: float, *keys: str, time: str = "epoch", period: float = DEFAULT_PERIOD_S, ties: tuple[str, ...] = (), late: str = "1 hour", close_after: str | None = None, buckets: int = held.BUCKETS
) -> DataFrame:
    """``keys``, time, ``variable``, ``ties`` and ``orbit`` of the rows of a stream, numbered as the batch form over the whole record numbers them.

    A row may come ``late``. It waits until its day is behind the watermark, as the typical step is that of a day, and until five rows behind
    it are whole. With ``close_after`` a record that has had no row for that long ends: the rows that wait are given out as its last ones, and what comes
    yet goes on from there. Rows without a time are dropped. Keys may not be null. The state store has to be RocksDB, as :func:`skyframe.streaming.windows.run_once`
    sets it for ``stateful`` streams. State holds the rows of days that are not whole, and some ten rows of each key besides;
    keys are dealt into ``buckets`` by hash, and what waits of a bucket has to fit into a task.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    row = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType()), *[T.StructField(c, kinds[c]) for c in ties]])
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], *row.fields, T.StructField("orbit", T.LongType())])
    taken = timed(stream.where(F.col(time).isNotNull()), time, late)
    taken = taken.select(held.bucket(keys, buckets).alias(held.BUCKET), *keys, time, F.unix_micros(time).alias("t"), known(F.col(variable).cast("double")).alias("v"), *ties)
    gap = None if close_after is None else int(pd.Timedelta(close_after).total_seconds() * 1e6)
    found = taken.groupBy(held.BUCKET).transformWithStateInPandas(_Orbits(keys, row, span, period, gap), out, "Append", "eventTime")
    return found.select(*keys, F.timestamp_micros("t").cast("timestamp_ntz").alias(time), F.col("v").alias(variable), *ties, "orbit")
