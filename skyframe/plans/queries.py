"""The library's operators applied to the test tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import arrays, coords
from skyframe.functions import time as times
from skyframe.meta import Meta
from skyframe.operators import align, chunks, files, orbits, rows
from skyframe.sources import synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an instrument: the tag is the type, the variable the value."""
    return table(spark, sf_dir, "events").withColumnRenamed("ts", "epoch")


# --- aggregates over time ------------------------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS day, event_type, min(ts) AS first_time, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def periodic_mean_by_day(spark, d):
    e = events(spark, d).withColumn("day", F.col("epoch").cast("date"))
    return chunks.periodic_mean(e, "value", "day", "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(ts AS DATE) AS day, max(value) AS most, min(value) AS least, count(*) AS n FROM events GROUP BY 1")
def daily_extremes(spark, d):
    return events(spark, d).groupBy(F.col("epoch").cast("date").alias("day")).agg(F.max("value").alias("most"), F.min("value").alias("least"), F.count("*").alias("n"))


@query("""
SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN value >= 100 THEN value END), 6) AS mean, round(median(value), 6) AS middle
FROM events WHERE value BETWEEN 50 AND 450 GROUP BY 1""")
def conditional_daily_mean(spark, d):
    e = events(spark, d).where(F.col("value").between(50, 450))
    return e.groupBy(F.col("epoch").cast("date").alias("day")).agg(
        F.round(F.avg(F.when(F.col("value") >= 100, F.col("value"))), 6).alias("mean"), F.round(F.median("value"), 6).alias("middle")
    )


@query("""
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS step FROM events)
SELECT event_type, day, min(step) / 1e6 AS resolution FROM s GROUP BY 1, 2""")
def time_resolution(spark, d):
    e = events(spark, d).withColumn("day", F.col("epoch").cast("date"))
    return times.resolution(e, "epoch", "event_type", "day")


@query("""
SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0), 6) AS resolution FROM events GROUP BY 1""")
def mean_resolution(spark, d):
    return times.resolution(events(spark, d), "epoch", "event_type", mean=True).withColumn("resolution", F.round("resolution", 6))


# --- chunks ----------------------------------------------------------------------------------------------------------

WEEKS = chunks.Bounds.of("2024-01-01", "2024-01-28", "7D", "7D")
SEASONS = chunks.Bounds.of(["2024-01-02", "2024-01-15"], ["2024-01-06", "2024-01-20"])
OVERLAPPING = chunks.Bounds.of("2024-01-01", "2024-01-20", "2D", "5D")


@query("""
WITH c AS (SELECT unnest(range(4)) AS chunk_id), b AS (SELECT chunk_id, TIMESTAMP '2024-01-01' + to_days(CAST(7 * chunk_id AS INTEGER)) AS a FROM c)
SELECT CAST(chunk_id AS INTEGER) AS chunk_id, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN b ON ts >= a AND ts < a + INTERVAL 7 DAY GROUP BY 1""")
def weekly_chunks(spark, d):
    return chunks.with_chunks(events(spark, d), WEEKS).groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
WHERE (ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-07') OR (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-21') GROUP BY 1, 2""")
def seasons(spark, d):
    e = chunks.with_chunks(events(spark, d), SEASONS)
    return e.groupBy(F.col("epoch").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT unnest(range(8)) AS chunk_id), c AS (SELECT chunk_id, TIMESTAMP '2024-01-01' + to_days(CAST(2 * chunk_id AS INTEGER)) AS a FROM b)
SELECT CAST(chunk_id AS INTEGER) AS chunk_id, a AS chunk_start, count(*) AS n FROM events JOIN c ON ts >= a AND ts < a + INTERVAL 5 DAY GROUP BY 1, 2""")
def overlapping_chunks(spark, d):
    return chunks.with_chunks(events(spark, d), OVERLAPPING).groupBy("chunk_id", "chunk_start").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT unnest(range(4)) AS chunk_id), b AS (SELECT chunk_id, TIMESTAMP '2024-01-01' + to_days(CAST(7 * chunk_id AS INTEGER)) AS a FROM c)
SELECT CAST(chunk_id AS INTEGER) AS chunk_id, ts >= a AND ts < a + INTERVAL 7 DAY AS in_chunk, count(*) AS n
FROM events JOIN b ON ts >= a - INTERVAL 6 HOUR AND ts < a + INTERVAL 7 DAY + INTERVAL 6 HOUR GROUP BY 1, 2""")
def padded_chunks(spark, d):
    return chunks.with_chunks(events(spark, d), WEEKS, pad="6 hours").groupBy("chunk_id", "in_chunk").agg(F.count("*").alias("n"))


# --- rows and columns ------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT event_id, user_id, ts AS epoch FROM n WHERE k >= 2 AND k < 5""")
def rows_by_position(spark, d):
    return rows.at_positions(events(spark, d), 2, 5, "user_id", order=["epoch", "event_id"]).select("event_id", "user_id", "epoch")


@query("SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 18:00:00'")
def rows_by_time(spark, d):
    return rows.between(events(spark, d), "2024-01-05 06:00:00", "2024-01-07 18:00:00", ["event_id", "value"])


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT event_id, user_id FROM n WHERE k % 10 = 0""")
def every_tenth(spark, d):
    return rows.every(events(spark, d), 10, "user_id", order=["epoch", "event_id"]).select("event_id", "user_id")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def column_range(spark, d):
    return rows.column_range(table(spark, d, "lineitem"), "l_quantity", "l_tax")


@query("SELECT event_id, CASE WHEN value > 400 THEN -1 ELSE value END AS value, user_id AS usr FROM events")
def assigned_and_renamed(spark, d):
    e = rows.assign(events(spark, d), "value", F.lit(-1.0), F.col("value") > 400)
    return rows.rename(e.select("event_id", "value", "user_id"), {"user_id": "usr"})


@query("""
SELECT ts AS epoch, value, NULL AS price FROM events UNION ALL SELECT o_orderdate, NULL, o_totalprice FROM orders""")
def concatenated(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("epoch"), F.col("o_totalprice").alias("price"))
    return rows.concat(events(spark, d).select("epoch", "value"), o)


@query("""
WITH b AS (SELECT user_id, ts, CAST(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS back FROM events)
SELECT user_id, count(ts) - count(DISTINCT ts) AS repeated, CAST(coalesce(sum(back), 0) AS BIGINT) AS backwards FROM b GROUP BY 1""")
def time_problems(spark, d):
    return rows.time_problems(events(spark, d), "user_id", order=["event_id"])


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       round(year(o_orderdate) + (dayofyear(o_orderdate) - 1 + (epoch_us(o_orderdate) - epoch_us(date_trunc('day', o_orderdate))) / 86400e6)
             / dayofyear(make_date(year(o_orderdate), 12, 31)), 9) AS dec_year,
       date_trunc('day', o_orderdate)::TIMESTAMP AS day, epoch_ms(o_orderdate) AS ms FROM orders""")
def time_functions(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", times.year_and_doy(t).alias("p"), F.round(times.decimal_year(t), 9).alias("dec_year"), times.day_of(t).alias("day"), times.epoch_encode(t).alias("ms")
    ).select("o_orderkey", "p.year", "p.doy", "dec_year", "day", "ms")


@query("""
SELECT o_orderkey, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) + to_days(CAST(dayofyear(o_orderdate) - 1 AS INTEGER)) + to_microseconds(CAST(round(o_totalprice * 1e6) AS BIGINT) % 86400000000) AS t
FROM orders""")
def time_from_parts(spark, d):
    o = table(spark, d, "orders")
    t = F.col("o_orderdate")
    uts = F.pmod(F.round(F.col("o_totalprice") * 1e6).cast("long"), F.lit(86_400_000_000)) / 1e6
    return o.select("o_orderkey", times.from_parts(F.year(t), F.dayofyear(t), uts=uts).alias("t"))


@query("SELECT event_id, CASE WHEN v < -180 THEN v + 360 ELSE v END AS longitude FROM (SELECT event_id, CASE WHEN value >= 180 THEN value - 360 ELSE value END AS v FROM events)")
def wrapped_longitude(spark, d):
    e = events(spark, d).select("event_id", F.col("value").alias("longitude"))
    return coords.with_longitude(e)


@query("""
WITH h AS (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + (epoch_us(ts) % 60000000) / 1e6) / 3600.0 + value / 15 AS h, ts FROM events)
SELECT event_id, round(h - 24 * floor(h / 24), 6) AS slt, round(h + 24 * date_diff('day', TIMESTAMP '2024-01-01', ts), 6) AS slt_from FROM h""")
def solar_local_time(spark, d):
    t, lon = F.col("epoch"), F.col("value")
    return events(spark, d).select(
        "event_id", F.round(coords.solar_local_time(t, lon), 6).alias("slt"), F.round(coords.solar_local_time(t, lon, modulus=False, ref_date="2024-01-01"), 6).alias("slt_from")
    )


@query("SELECT p_partkey, round(p_retailprice * 1000, 6) AS metres, round(p_retailprice * pi() / 180, 9) AS radians FROM part")
def scaled_units(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(p * coords.unit_factor("m", "km"), 6).alias("metres"), F.round(p * coords.unit_factor("rad", "deg"), 9).alias("radians"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer")
def replaced_fill(spark, d):
    return coords.replace_fill(table(spark, d, "customer").select("c_custkey", "c_nationkey"), {"c_nationkey": 7}, -1)


# --- orbits ----------------------------------------------------------------------------------------------------------

PERIOD_S, SPAN = 3 * 3600.0, 490.0


@query(f"""
WITH s AS (
  SELECT *, row_number() OVER w - 1 AS i, value - lag(value) OVER w AS dv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt
  FROM (SELECT event_id, user_id, ts, value, CAST(ts AS DATE) AS day FROM events) WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)
), m AS (
  SELECT *, median(dv) OVER (PARTITION BY user_id, day) AS m, count(*) OVER (PARTITION BY user_id, day) AS n FROM s
), f AS (
  SELECT *, coalesce(dv > 10 * m, false) AS big, coalesce(dt * {SPAN} < dv * {PERIOD_S}, false) AS fits, coalesce(dv < -0.2 * m, false) AS fall,
         coalesce(dt > {PERIOD_S}, false) OR coalesce(dt / {PERIOD_S} > abs(dv) / {SPAN} AND dt / {PERIOD_S} > 0.95, false) AS gap FROM m
), k AS (
  SELECT *, max(CAST(big AS INT)) OVER x AS anybig, max(CAST(big AND NOT fits AS INT)) OVER x AS anyok FROM f
  WINDOW x AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
), c AS (
  SELECT *, coalesce(lead(i) OVER (PARTITION BY user_id, day, fall ORDER BY ts, event_id), n) AS nx FROM k WHERE fall OR gap
), b AS (
  SELECT * FROM c WHERE gap OR (fall AND nx - i > 1 AND (i < 5 OR anybig = 0 OR anyok = 1))
), q AS (
  SELECT user_id, day, i, row_number() OVER w AS r,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} - (value - lag(value) OVER w) / {SPAN} AS far
  FROM b WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)
), z AS (SELECT user_id, day, i FROM q WHERE (r = 1 OR far > 0.97) AND i > 0)
SELECT s.event_id, s.user_id, s.day, 1 + count(z.i) OVER (PARTITION BY s.user_id, s.day ORDER BY s.i) AS orbit
FROM s LEFT JOIN z ON s.user_id = z.user_id AND s.day = z.day AND s.i = z.i""")
def cyclic_orbits(spark, d):
    e = events(spark, d).withColumn("day", F.col("epoch").cast("date"))
    out = orbits.cyclic_orbits(e.select("event_id", "user_id", "epoch", "value", "day"), "value", SPAN, "user_id", "day", period=PERIOD_S, ties=("event_id",))
    return out.select("event_id", "user_id", "day", "orbit")


@query(f"""
WITH b AS (
  SELECT event_id, user_id, ts,
         CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
              OR coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), o AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS orbit FROM b)
SELECT event_id, user_id FROM o WHERE orbit = 2""")
def orbit_next_and_previous(spark, d):
    e = events(spark, d).select("event_id", "user_id", "epoch", (F.col("value") - 245).alias("latitude"))
    found = orbits.continuous_polar_orbits(e, "latitude", "user_id", period=PERIOD_S, ties=("event_id",))
    return orbits.OrbitCursor(found).next().next().next().prev().rows().select("event_id", "user_id")


@query(f"""
WITH b AS (
  SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day,
         CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
              OR coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)
)
SELECT event_id, CAST(1 + sum(brk) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS BIGINT) AS orbit FROM b""")
def polar_orbits(spark, d):
    e = events(spark, d).select("event_id", "user_id", "epoch", F.col("epoch").cast("date").alias("day"), (F.col("value") - 245).alias("latitude"))
    return orbits.polar_orbits(e, "latitude", "user_id", "day", period=PERIOD_S, ties=("event_id",)).select("event_id", "orbit")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS INTEGER) AS orbit FROM orders")
def numbered_orbits(spark, d):
    o = table(spark, d, "orders").withColumn("number", F.col("o_orderdate").cast("date"))
    return orbits.numbered_orbits(o, "number", "o_custkey").select("o_orderkey", "orbit")


@query("""
WITH b AS (
  SELECT event_id, user_id, ts, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000, false) AS INT) AS brk FROM events
), s AS (SELECT event_id, user_id, ts, 1 + sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_time FROM s GROUP BY 1, 2""")
def gap_sessions(spark, d):
    s = orbits.gap_sessions(events(spark, d), 43_200.0, "user_id", ties=("event_id",))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("epoch").alias("first_time"))


# --- alignment -------------------------------------------------------------------------------------------------------

GRID = """
data AS (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2),
ends AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS epoch FROM ends),
p AS (SELECT g.event_type, g.epoch, d.ts AS pt, d.value AS pv FROM grid g ASOF LEFT JOIN data d ON g.event_type = d.event_type AND g.epoch >= d.ts),
n AS (SELECT g.event_type, g.epoch, d.ts AS nt, d.value AS nv FROM grid g ASOF LEFT JOIN data d ON g.event_type = d.event_type AND g.epoch <= d.ts),
near AS (SELECT p.event_type, p.epoch, pt, pv, nt, nv, epoch_us(p.epoch) - epoch_us(pt) AS back, epoch_us(nt) - epoch_us(p.epoch) AS ahead
         FROM p JOIN n ON p.event_type = n.event_type AND p.epoch = n.epoch)
"""


def _aligned(spark, d, method):
    e = events(spark, d).select("event_type", "epoch", "value")
    return align.align(align.time_grid(e, "1 hour", "event_type"), e, ["value"], method, "event_type")


@query(f"WITH {GRID} SELECT event_type, epoch, pv AS value FROM near")
def aligned_forward(spark, d):
    return _aligned(spark, d, "ffill")


@query(f"WITH {GRID} SELECT event_type, epoch, nv AS value FROM near")
def aligned_backward(spark, d):
    return _aligned(spark, d, "bfill")


@query(f"WITH {GRID} SELECT event_type, epoch, CASE WHEN nt IS NULL OR back <= ahead THEN pv ELSE nv END AS value FROM near")
def aligned_nearest(spark, d):
    return _aligned(spark, d, "nearest")


@query(f"WITH {GRID} SELECT event_type, epoch, round(CASE WHEN back + ahead = 0 THEN pv ELSE pv + (nv - pv) * back / (back + ahead) END, 6) AS value FROM near")
def aligned_linear(spark, d):
    return _aligned(spark, d, "linear").withColumn("value", F.round("value", 6))


@query("""
WITH g AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS epoch),
o AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS epoch, count(*) AS n FROM orders GROUP BY 1)
SELECT g.epoch, coalesce(n, -1) AS n FROM g LEFT JOIN o ON g.epoch = o.epoch""")
def aligned_exact(spark, d):
    grid = spark.range(1).select(F.explode(times.date_range("1992-01-01", "1998-12-31")).alias("epoch"))
    o = table(spark, d, "orders").groupBy(times.day_of(F.col("o_orderdate")).alias("epoch")).agg(F.count("*").alias("n"))
    return align.align(grid, o, ["n"], None, fills={"n": -1})


@query("SELECT min(step) AS resolution FROM (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS step FROM events)")
def least_resolution(spark, d):
    return times.least_step(events(spark, d), "epoch")


@query("""
WITH d AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS t, max(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 15 MINUTE)) AS epoch FROM d GROUP BY 1),
n AS (SELECT g.event_type, g.epoch, d.t, d.value FROM g ASOF LEFT JOIN d ON g.event_type = d.event_type AND g.epoch >= d.t)
SELECT event_type, epoch, CASE WHEN row_number() OVER (PARTITION BY event_type, t ORDER BY epoch) <= 3 THEN value END AS value FROM n""")
def aligned_forward_some_rows(spark, d):
    hour = F.timestamp_add("HOUR", F.hour("epoch"), F.col("epoch").cast("date").cast("timestamp_ntz"))
    data = events(spark, d).groupBy("event_type", hour.alias("epoch")).agg(F.max("value").alias("value"))
    return align.align(align.time_grid(data, "15 minutes", "event_type"), data, ["value"], "ffill", "event_type", limit_rows=2)


#: The greatest value of every type in each three hours, and a grid of hours over each type's record.
THREE_HOURS = "SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts)::TIMESTAMP AS t, max(value) AS y FROM events GROUP BY 1, 2"
HOURS = "SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS epoch FROM p GROUP BY 1"


def _three_hours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bins = F.timestamp_add("HOUR", F.floor(F.hour("epoch") / 3).cast("int") * 3, F.col("epoch").cast("date").cast("timestamp_ntz"))
    data = events(spark, d).groupBy("event_type", bins.alias("epoch")).agg(F.max("value").alias("value"))
    return align.time_grid(data, "1 hour", "event_type"), data


@query(f"""
WITH p AS ({THREE_HOURS}), g AS ({HOURS})
SELECT g.event_type, g.epoch, p.y AS value FROM g ASOF JOIN p ON g.event_type = p.event_type AND g.epoch >= p.t""")
def aligned_zero(spark, d):
    return align.align(*_three_hours(spark, d), ["value"], "zero", "event_type")


@query(f"""
WITH RECURSIVE p AS ({THREE_HOURS}), g AS ({HOURS}),
x AS (SELECT event_type, t, y, epoch(t) / 3600.0 AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM p WINDOW w AS (PARTITION BY event_type ORDER BY t)),
h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM x WINDOW w AS (PARTITION BY event_type ORDER BY i)),
e AS (
  SELECT event_type, i, n, lag(h) OVER w AS a, h AS c, 2 * (lag(h) OVER w + h) AS b, 6 * (s - lag(s) OVER w) AS r FROM h WINDOW w AS (PARTITION BY event_type ORDER BY i)
), m AS (
  SELECT event_type, i, n, r, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN a - c * c / a ELSE a END AS a,
         CASE WHEN i = 1 THEN b + a * (1 + a / c) WHEN i = n - 2 THEN b + c * (1 + c / a) ELSE b END AS b,
         CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN c - a * a / c ELSE c END AS c
  FROM e WHERE i BETWEEN 1 AND n - 2
), down AS (
  SELECT event_type, i, n, c / b AS c, r / b AS r FROM m WHERE i = 1
  UNION ALL
  SELECT m.event_type, m.i, m.n, m.c / (m.b - m.a * d.c), (m.r - m.a * d.r) / (m.b - m.a * d.c) FROM down d JOIN m ON m.event_type = d.event_type AND m.i = d.i + 1
), up AS (
  SELECT event_type, i, r AS k FROM down WHERE i = n - 2
  UNION ALL
  SELECT d.event_type, d.i, d.r - d.c * u.k FROM up u JOIN down d ON d.event_type = u.event_type AND d.i = u.i - 1
), inner_k AS (SELECT h.event_type, h.i, h.n, h.h, u.k FROM h LEFT JOIN up u USING (event_type, i)),
k AS (
  SELECT event_type, i, CASE
    WHEN i = 0 THEN lead(k) OVER w * (1 + h / lead(h) OVER w) - lead(k, 2) OVER w * h / lead(h) OVER w
    WHEN i = n - 1 THEN lag(k) OVER w * (1 + lag(h) OVER w / lag(h, 2) OVER w) - lag(k, 2) OVER w * lag(h) OVER w / lag(h, 2) OVER w
    ELSE k END AS k
  FROM inner_k WINDOW w AS (PARTITION BY event_type ORDER BY i)
), q AS (SELECT h.*, k.k AS k0, lead(k.k) OVER (PARTITION BY event_type ORDER BY i) AS k1, lead(h.y) OVER (PARTITION BY event_type ORDER BY i) AS y1 FROM h JOIN k USING (event_type, i))
SELECT event_type, epoch, round(CASE WHEN h IS NULL THEN y ELSE (k0 * (h - z) ** 3 + k1 * z ** 3) / (6 * h) + (y / h - k0 * h / 6) * (h - z) + (y1 / h - k1 * h / 6) * z END, 3) AS value
FROM (SELECT g.event_type, g.epoch, q.h, q.y, q.y1, q.k0, q.k1, epoch(g.epoch) / 3600.0 - q.x AS z FROM g ASOF JOIN q ON g.event_type = q.event_type AND g.epoch >= q.t)""")
def aligned_cubic(spark, d):
    found = align.align(*_three_hours(spark, d), ["value"], "cubic", "event_type")
    return found.select("event_type", "epoch", F.round("value", 3).alias("value"))


# --- file catalogs ---------------------------------------------------------------------------------------------------

NAMES = "'obs_' || strftime(o_orderdate, '%Y%m%d') || '_v' || (o_orderkey % 3) || '_r' || (o_custkey % 2) || '.nc'"
OBS = files.Template("obs_{year:04d}{month:02d}{day:02d}_v{version:1d}_r{revision:1d}.nc")


def _names(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("obs_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v"), F.col("o_orderkey") % 3, F.lit("_r"), F.col("o_custkey") % 2, F.lit(".nc"))
    return o.select(name.alias("file_name"))


@query(f"SELECT DISTINCT {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time, CAST(o_orderkey % 3 AS INTEGER) AS version FROM orders")
def parsed_file_names(spark, d):
    return files.parse_names(_names(spark, d).distinct(), OBS).select("file_name", "file_time", "version")


@query(f"""
WITH f AS (SELECT DISTINCT {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time, o_orderkey % 3 AS v, o_custkey % 2 AS r FROM orders)
SELECT file_time, arg_max(file_name, v * 10 + r) AS file_name FROM f GROUP BY 1""")
def latest_file_versions(spark, d):
    return files.latest_versions(files.parse_names(_names(spark, d).distinct(), OBS)).select("file_time", "file_name")


@query(f"""
SELECT DISTINCT {NAMES} AS file_name FROM orders WHERE {NAMES} NOT IN (SELECT {NAMES} FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')""")
def new_files(spark, d):
    all_of = _names(spark, d).distinct()
    return files.new_files(all_of, all_of.where("substr(file_name, 5, 4) < '1997'"))


@query(f"""
WITH f AS (SELECT o_custkey % 25 AS list, o_orderkey, {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time FROM orders)
SELECT list, arg_min(file_time, o_orderkey) AS first_time, arg_max(file_time, o_orderkey) AS last_time FROM f GROUP BY 1""")
def listed_ranges(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("remote/obs_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v"), F.col("o_orderkey") % 3, F.lit("_r"), F.col("o_custkey") % 2, F.lit(".nc"))
    listed = files.without_folder(o.select((F.col("o_custkey") % 25).alias("list"), "o_orderkey", name.alias("file_name")), "remote/")
    return files.listed_range(files.parse_names(listed, OBS), "o_orderkey", "list")


@query("""
WITH d AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::TIMESTAMP AS file_time)
SELECT strftime(file_time, 'obs_%Y_%j.nc') AS file_name, file_time FROM d WHERE file_time NOT IN (SELECT date_trunc('day', o_orderdate)::TIMESTAMP FROM orders WHERE o_custkey % 3 = 0)""")
def files_that_a_whole_archive_has(spark, d):
    whole = table(spark, d, "orders").select(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    held = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.concat(F.lit("obs_"), F.date_format("o_orderdate", "yyyy_DDD"), F.lit(".nc")).alias("file_name")).distinct()
    template = files.Template("obs_{year:04d}_{day:03d}.nc")
    return files.to_download(files.made_up(spark, template, *whole), files.parse_names(held, template)).select("file_name", "file_time")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 7 THEN -1.0 ELSE CAST(l_quantity AS DOUBLE) END AS quantity, CASE WHEN l_suppkey = 3 THEN NULL ELSE l_suppkey END AS supplier FROM lineitem""")
def fills_of_labels(spark, d):
    rows_of = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_suppkey").alias("supplier"))
    first = coords.replace_labelled_fill(Meta({"quantity": {"fill": 7.0}}).attach(rows_of), ["quantity"], -1.0)
    return coords.replace_labelled_fill(Meta({"supplier": {"fill": 3}}).attach(first), ["supplier"])


#: Names of blocks of no fixed width, some of which fit no template: a priority with a run of delimiters, and a day that is none.
LOOSE = "concat('in', o_custkey % 3, '_', CAST(year(o_orderdate) AS VARCHAR(4)), CASE WHEN o_orderkey % 7 = 0 THEN '__' ELSE '_' END, CAST(month(o_orderdate) AS VARCHAR(2)), '_', CAST(CASE WHEN o_orderkey % 11 = 0 THEN 32 ELSE day(o_orderdate) END AS VARCHAR(2)), '_', o_orderstatus, lower(substr(o_orderpriority, 3, 3)), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_rev' END, CAST(o_orderkey % 40 AS VARCHAR(2)), '_x.dat')"
LOOSE_NAMES = files.Template("*_{year:d}_{month:d}_{day:d}_{kind:1s}{order_class:s}_rev{rev_no:d}_*", delimiter="_")


@query(f"""
WITH n AS (SELECT o_orderkey, {LOOSE} AS file_name FROM orders),
p AS (SELECT *, string_split(regexp_replace(file_name, '_+', '_', 'g'), '_') AS b FROM n WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, make_timestamp(CAST(b[2] AS BIGINT), CAST(b[3] AS BIGINT), CAST(b[4] AS BIGINT), 0, 0, 0.0) AS file_time, b[5][1] AS kind, b[5][2:] AS order_class, CAST(b[6][4:] AS INTEGER) AS rev_no
FROM p WHERE CAST(b[4] AS INTEGER) < 32""")
def delimited_file_names(spark, d):
    named = table(spark, d, "orders").select("o_orderkey", F.expr(LOOSE.replace("AS VARCHAR(4)", "AS STRING").replace("AS VARCHAR(2)", "AS STRING")).alias("file_name"))
    return files.parse_names(named, LOOSE_NAMES).select("o_orderkey", "file_time", "kind", "order_class", "rev_no")


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS file_time, CAST(o_orderkey % 10 AS INTEGER) AS version FROM orders")
def file_names_from_the_end(spark, d):
    lead = F.concat(F.lit("some/"), F.lower("o_orderpriority"), F.lit("_"), F.col("o_totalprice").cast("string"))
    named = table(spark, d, "orders").select("o_orderkey", F.concat(lead, F.date_format("o_orderdate", "yyyyMMdd"), F.lit("v"), F.col("o_orderkey") % 10, F.lit(".cdf")).alias("file_name"))
    return files.parse_names(named, files.Template("{year:04d}{month:02d}{day:02d}v{version:1d}.cdf", from_end=True)).select("o_orderkey", "file_time", "version")


@query("""
WITH e AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY 1),
d AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT user_id, day FROM d WHERE (user_id, day) NOT IN (SELECT (user_id, CAST(ts AS DATE)) FROM events)""")
def missing_days(spark, d):
    return files.missing_days(events(spark, d), "user_id", time="epoch")


@query(f"""
WITH f AS (SELECT DISTINCT {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time FROM orders),
one AS (SELECT max(file_name) AS file_name FROM f WHERE file_name < 'obs_1998')
SELECT f.file_name, f.file_time, (SELECT count(*) FROM f g WHERE (g.file_time, g.file_name) < (f.file_time, f.file_name)) AS position FROM f JOIN one USING (file_name)""")
def file_position(spark, d):
    catalog = files.parse_names(_names(spark, d).distinct(), OBS).select("file_name", "file_time")
    return files.position(catalog, catalog.where("file_name < 'obs_1998'").agg(F.max("file_name")).first()[0])


@query(f"""
WITH f AS (SELECT DISTINCT {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time FROM orders),
s AS (SELECT 0 AS span, min(file_name) FILTER (file_name >= 'obs_1995') AS a, min(file_name) FILTER (file_name >= 'obs_1996') AS b FROM f
      UNION ALL SELECT 1, min(file_name) FILTER (file_name >= 'obs_199507'), min(file_name) FILTER (file_name >= 'obs_1997') FROM f)
SELECT file_name, CAST(span AS INTEGER) AS span FROM f JOIN s ON file_name BETWEEN a AND b""")
def files_between_names(spark, d):
    catalog = files.parse_names(_names(spark, d).distinct(), OBS).select("file_name", "file_time")
    starts = ("obs_1995", "obs_1996", "obs_199507", "obs_1997")
    a, b, x, y = catalog.agg(*[F.min(F.when(F.col("file_name") >= n, F.col("file_name"))) for n in starts]).first()
    return files.between_names(catalog, [(a, b), (x, y)]).select("file_name", "span")


@query("SELECT min(date_trunc('day', o_orderdate))::TIMESTAMP AS first_time, max(date_trunc('day', o_orderdate))::TIMESTAMP AS last_time, count(DISTINCT o_orderdate) AS n FROM orders")
def first_and_last_file(spark, d):
    return files.first_and_last(files.first_of_each_time(files.parse_names(_names(spark, d).distinct(), OBS)))


@query(f"""
WITH f AS (SELECT DISTINCT {NAMES} AS file_name, date_trunc('day', o_orderdate)::TIMESTAMP AS file_time FROM orders)
SELECT min(file_name) AS file_name, file_time FROM f WHERE file_time >= TIMESTAMP '1995-01-01' AND file_time < TIMESTAMP '1996-01-01' GROUP BY 2""")
def files_of_a_year(spark, d):
    catalog = files.parse_names(_names(spark, d).distinct(), OBS)
    return files.in_range(files.first_of_each_time(catalog), "1995-01-01", "1996-01-01")


@query(f"""
WITH f AS (SELECT DISTINCT {NAMES} AS file_name, date_trunc('month', o_orderdate)::TIMESTAMP AS file_time FROM orders), m AS (SELECT min(file_name) AS file_name, file_time FROM f GROUP BY 2)
SELECT file_name || '_' || strftime(day, '%Y-%m-%d') AS file_name, day AS file_time
FROM (SELECT file_name, unnest(generate_series(file_time, file_time + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM m)""")
def monthly_files_by_day(spark, d):
    catalog = files.parse_names(_names(spark, d).distinct(), OBS).withColumn("file_time", F.date_trunc("month", "file_time").cast("timestamp_ntz"))
    return files.daily(files.first_of_each_time(catalog), "1 month").select("file_name", "file_time")


# --- orbits over midnight, steps with a limit ------------------------------------------------------------------------


@query(f"""
WITH b AS (
  SELECT event_id, user_id, ts,
         CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
              OR coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
SELECT event_id, CAST(1 + sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS orbit FROM b""")
def continuous_polar_orbits(spark, d):
    e = events(spark, d).select("event_id", "user_id", "epoch", (F.col("value") - 245).alias("latitude"))
    return orbits.continuous_polar_orbits(e, "latitude", "user_id", period=PERIOD_S, ties=("event_id",)).select("event_id", "orbit")


@query(f"""
WITH b AS (
  SELECT event_id, user_id, ts,
         CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
              OR coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), o AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS orbit FROM b)
SELECT user_id, CAST(orbit AS BIGINT) AS orbit, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM o GROUP BY 1, 2 HAVING CAST(min(ts) AS DATE) < CAST(max(ts) AS DATE)""")
def orbits_over_midnight(spark, d):
    e = events(spark, d).select("event_id", "user_id", "epoch", (F.col("value") - 245).alias("latitude"))
    found = orbits.continuous_polar_orbits(e, "latitude", "user_id", period=PERIOD_S, ties=("event_id",))
    spans = found.groupBy("user_id", "orbit").agg(F.min("epoch").alias("first_time"), F.max("epoch").alias("last_time"), F.count("*").alias("n"))
    return spans.where(F.col("first_time").cast("date") < F.col("last_time").cast("date"))


#: One scan of each user's record by the rules of cyclic orbits; the typical step is that of the day.
CYCLIC_SCAN = f"""
WITH s AS (
  SELECT event_id, user_id, ts, value, CAST(ts AS DATE) AS day, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
         value - lag(value) OVER w AS dv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt,
         value - lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS inside
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), d AS (
  SELECT user_id, day, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS m FROM (SELECT user_id, day, median(inside) AS m FROM s GROUP BY 1, 2)
), f AS (
  SELECT s.*, coalesce(dv > 10 * m, false) AS big, coalesce(dt * {SPAN} < dv * {PERIOD_S}, false) AS fits, coalesce(dv < -0.2 * m, false) AS fall,
         coalesce(dt > {PERIOD_S}, false) OR coalesce(dt / {PERIOD_S} > abs(dv) / {SPAN} AND dt / {PERIOD_S} > 0.95, false) AS gap FROM s JOIN d USING (user_id, day)
), k AS (
  SELECT *, max(CAST(big AS INT)) OVER x AS anybig, max(CAST(big AND NOT fits AS INT)) OVER x AS anyok FROM f
  WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
), c AS (
  SELECT *, coalesce(lead(i) OVER (PARTITION BY user_id, fall ORDER BY i), n) AS nx FROM k WHERE fall OR gap
), b AS (
  SELECT * FROM c WHERE gap OR (fall AND nx - i > 1 AND (i < 5 OR anybig = 0 OR anyok = 1))
), q AS (
  SELECT user_id, i, row_number() OVER w AS r, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} - (value - lag(value) OVER w) / {SPAN} AS far
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i)
), z AS (SELECT user_id, i FROM q WHERE r = 1 OR far > 0.97),
o AS (SELECT s.event_id, s.user_id, s.ts, 1 + count(z.i) OVER (PARTITION BY s.user_id ORDER BY s.i) AS orbit FROM s LEFT JOIN z ON s.user_id = z.user_id AND s.i = z.i)
"""


def _cyclic(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "epoch", "value")
    return orbits.continuous_cyclic_orbits(e, "value", SPAN, "user_id", period=PERIOD_S, ties=("event_id",))


@query(CYCLIC_SCAN + "SELECT event_id, user_id, orbit FROM o")
def continuous_cyclic_orbits(spark, d):
    return _cyclic(spark, d).select("event_id", "user_id", "orbit")


@query(CYCLIC_SCAN + "SELECT user_id, orbit, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM o GROUP BY 1, 2 HAVING CAST(min(ts) AS DATE) < CAST(max(ts) AS DATE)")
def cyclic_orbits_over_midnight(spark, d):
    spans = _cyclic(spark, d).groupBy("user_id", "orbit").agg(F.min("epoch").alias("first_time"), F.max("epoch").alias("last_time"), F.count("*").alias("n"))
    return spans.where(F.col("first_time").cast("date") < F.col("last_time").cast("date"))


@query(CYCLIC_SCAN + "SELECT o.user_id, o.orbit, round(avg(e.value), 6) AS mean, max(e.value) AS most, count(*) AS n FROM o JOIN events e USING (event_id) GROUP BY 1, 2")
def means_of_orbits(spark, d):
    return _cyclic(spark, d).groupBy("user_id", "orbit").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, value - lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, day, round(median(step), 6) AS median_step FROM s GROUP BY 1, 2""")
def median_steps(spark, d):
    e = events(spark, d).withColumn("day", F.col("epoch").cast("date"))
    return times.median_step(e, "value", "user_id", "day", order=("epoch", "event_id")).select("user_id", "day", F.round("median_step", 6).alias("median_step"))


@query(f"""
WITH b AS (
  SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day,
         CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
              OR coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)
), o AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS orbit FROM b),
l AS (SELECT *, max(orbit) OVER (PARTITION BY user_id, day) AS last FROM o)
SELECT event_id FROM l WHERE orbit = last""")
def last_orbit_of_each_day(spark, d):
    e = events(spark, d).select("event_id", "user_id", "epoch", F.col("epoch").cast("date").alias("day"), (F.col("value") - 245).alias("latitude"))
    found = orbits.polar_orbits(e, "latitude", "user_id", "day", period=PERIOD_S, ties=("event_id",))
    return orbits.one_orbit(found, -1, "user_id", "day").select("event_id")


@query("""
WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 30 MINUTE)) AS epoch),
v AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT g.epoch, CASE WHEN g.epoch - v.ts <= INTERVAL 20 MINUTE THEN value END AS value FROM g ASOF LEFT JOIN v ON g.epoch >= v.ts""")
def aligned_forward_limited(spark, d):
    grid = spark.range(1).select(F.explode(times.date_range("2024-01-05", "2024-01-12", "30 minutes")).alias("epoch"))
    return align.align(grid, events(spark, d).where("event_type = 'view'"), ["value"], "ffill", limit="20 minutes")


# --- times -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS again FROM events")
def encoded_times(spark, d):
    ms = times.epoch_encode(F.col("epoch"))
    return events(spark, d).select("event_id", ms.alias("ms"), times.epoch_decode(ms, "ms").alias("again"))


@query("SELECT event_id, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 1e6 AS seconds FROM events")
def seconds_of_day(spark, d):
    return events(spark, d).select("event_id", times.seconds_of_day(F.col("epoch")).alias("seconds"))


@query("SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, ts AS epoch FROM events")
def time_from_day_of_year(spark, d):
    day = times.year_and_doy(F.col("epoch"))
    at = lambda uts=None: times.from_parts(day["year"], day["doy"], uts=uts)
    return events(spark, d).select("event_id", at().alias("day"), at(times.seconds_of_day(F.col("epoch"))).alias("epoch"))


# --- nested variables and synthetic sources --------------------------------------------------------------------------


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(embedding) AS value FROM embeddings")
def nested_to_long(spark, d):
    return arrays.to_long(table(spark, d, "embeddings"), "embedding", ["i"], "vec_id")


@query("SELECT vec_id, embedding FROM embeddings")
def long_to_nested(spark, d):
    return arrays.to_nested(arrays.to_long(table(spark, d, "embeddings"), "embedding", ["i"], "vec_id"), ["i"], "embedding", "vec_id")


@query("""
WITH s AS (SELECT unnest(range(86400)) AS s)
SELECT TIMESTAMP '2009-01-01' + to_seconds(s) AS epoch, round((s % 5820) * 24.0 / 5820, 9) AS mlt, round((s % 6240) * 360.0 / 6240, 9) AS longitude,
       CAST(floor((s + 31622400) / 5820) AS BIGINT) AS orbit_num FROM s""")
def synthetic_satellite(spark, d):
    return synthetic.satellite(spark, "2009-01-01").select("epoch", F.round("mlt", 9).alias("mlt"), F.round("longitude", 9).alias("longitude"), "orbit_num")


@query("""
WITH s AS (SELECT unnest(range(86400)) AS s), o AS (SELECT s, floor(s / 5820) AS k FROM s)
SELECT CAST(k + 1 AS BIGINT) AS orbit, min(TIMESTAMP '2009-01-01' + to_seconds(s)) AS first_time, max(TIMESTAMP '2009-01-01' + to_seconds(s)) AS last_time FROM o GROUP BY 1""")
def synthetic_orbits(spark, d):
    day = synthetic.satellite(spark, "2009-01-01").withColumn("day", F.col("epoch").cast("date"))
    found = orbits.cyclic_orbits(day, "mlt", 24.0, "day")
    return found.groupBy("orbit").agg(F.min("epoch").alias("first_time"), F.max("epoch").alias("last_time"))
