"""Whole pipelines: instruments, constellations and streams over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.arrays import element, to_long
from skyframe.meta import Meta
from skyframe.operators import axes, chunks, files
from skyframe.operators import orbits as batch_orbits
from skyframe.plans.instrument import Constellation, Cursor, Instrument
from skyframe.session import scratch
from skyframe.sources.archive import Archive, FileBounds
from skyframe.plans.orbit_record import OrbitRecord
from skyframe.plans.queries import CYCLIC_SCAN, PERIOD_S, SPAN
from skyframe.streaming import chunks as stream_chunks
from skyframe.streaming import orbits, windows
from skyframe.streaming.ingest import Follower

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


def _event_instrument(sf_dir: str, kind: str, **options) -> Instrument:
    def read(spark: SparkSession) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
        return e.select(F.col("ts").alias("epoch"), "event_id", "user_id", "value")

    return Instrument("events", kind, read, **options)


@query("""
SELECT event_id, ts AS epoch, value, value * 2 AS doubled FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND value > 20 AND value < 480""")
def instrument_load(spark, d):
    inst = _event_instrument(d, "click", clean={"clean": [F.col("value") > 20], "dirty": [F.col("value") < 480]})
    inst = inst.attach(lambda df, by: df.withColumn("doubled", F.col("value") * by), 2)
    return inst.load(spark, "2024-01-05", "2024-01-12", columns=["event_id", "epoch", "value", "doubled"])


@query("""
WITH w AS (
  SELECT event_id, user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events
  WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-04 12:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'
)
SELECT event_id, prior FROM w WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""")
def instrument_padded_load(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("epoch", "event_id")
    inst = _event_instrument(d, "view", pad="12 hours").attach(lambda df: df.withColumn("prior", F.lag("value").over(w)))
    return inst.load(spark, "2024-01-05", "2024-01-12", columns=["event_id", "prior"])


@query("""
WITH c AS (SELECT unnest(range(9)) AS chunk_id), b AS (SELECT chunk_id, TIMESTAMP '2024-01-01' + to_days(CAST(3 * chunk_id AS INTEGER)) AS a FROM c)
SELECT CAST(chunk_id AS INTEGER) AS chunk_id, max(value) AS most FROM events JOIN b ON ts >= a AND ts < a + INTERVAL 2 DAY WHERE event_type = 'click' GROUP BY 1""")
def instrument_iteration(spark, d):
    found = _event_instrument(d, "click").iterate(spark, chunks.Bounds.of("2024-01-01", "2024-01-26", "3D", "2D"))
    return found.groupBy("chunk_id").agg(F.max("value").alias("most"))


@query("""
WITH a AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS epoch, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS epoch, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
r AS (SELECT greatest((SELECT min(epoch) FROM a), (SELECT min(epoch) FROM b)) AS lo, least((SELECT max(epoch) FROM a), (SELECT max(epoch) FROM b)) AS hi),
g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS epoch FROM r)
SELECT g.epoch, x.value AS value_events_click, y.value AS value_events_view FROM g ASOF LEFT JOIN a x ON g.epoch >= x.epoch ASOF LEFT JOIN b y ON g.epoch >= y.epoch""")
def constellation_frame(spark, d):
    def hourly(df: DataFrame) -> DataFrame:
        hour = F.timestamp_add("HOUR", F.hour("epoch"), F.col("epoch").cast("date").cast("timestamp_ntz"))
        return df.groupBy(hour.alias("epoch")).agg(F.max("value").alias("value"))

    members = tuple(_event_instrument(d, kind, preprocess=hourly) for kind in ("click", "view"))
    return Constellation(members).to_frame(spark, step="1 hour", method="ffill")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def instrument_load_by_day_of_year(spark, d):
    return _event_instrument(d, "click").load(spark, yr=2024, doy=5, end_yr=2024, end_doy=9, columns=["event_id"])


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-06'")
def instrument_next_and_previous(spark, d):
    cursor = Cursor(_event_instrument(d, "click"), chunks.Bounds.of("2024-01-01", "2024-01-26", "3D", "2D"))
    return cursor.next().next().next().prev().load(spark, columns=["event_id"])


@query("""
WITH a AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS epoch, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(epoch) FROM a), (SELECT max(epoch) FROM a), INTERVAL 2 HOUR)) AS epoch)
SELECT g.epoch, x.value AS value_events_click, CAST(NULL AS DOUBLE) AS value_events_nothing FROM g ASOF LEFT JOIN a x ON g.epoch >= x.epoch""")
def constellation_with_an_empty_member(spark, d):
    def hourly(df: DataFrame) -> DataFrame:
        hour = F.timestamp_add("HOUR", F.hour("epoch"), F.col("epoch").cast("date").cast("timestamp_ntz"))
        return df.groupBy(hour.alias("epoch")).agg(F.max("value").alias("value"))

    members = tuple(_event_instrument(d, kind, preprocess=hourly) for kind in ("click", "nothing"))
    return Constellation(members).to_frame(spark, step="2 hours", method="ffill")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("""
SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2""")
def streamed_daily_means(spark, d):
    s = _stream(spark, d).withColumnRenamed("ts", "epoch")
    done = windows.run_once(windows.chunk_means(s, "value", "event_type"), "means", "complete")
    return done.select("start", "event_type", F.round("mean", 6).alias("mean"), "n")


@query("""
SELECT TIMESTAMP '2024-01-01' + to_days(CAST(7 * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) AS INTEGER)) AS start, round(avg(value), 6) AS mean, count(value) AS n
FROM events GROUP BY 1""")
def streamed_weekly_means(spark, d):
    s = _stream(spark, d).withColumnRenamed("ts", "epoch")
    done = windows.run_once(windows.chunk_means(s, "value", width="7 days", start="2024-01-01"), "weeks", "complete")
    return done.select("start", F.round("mean", 6).alias("mean"), "n")


@query("""
WITH b AS (SELECT user_id, ts, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 43200000000, false) AS INT) AS brk FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM b)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def streamed_sessions(spark, d):
    s = _stream(spark, d).withColumnRenamed("ts", "epoch")
    done = windows.run_once(windows.gap_session_counts(s, "12 hours", "user_id"), "sessions", "complete")
    return done.select("user_id", "start", "n")


@query("""
SELECT CAST(date_diff('day', DATE '2024-01-02', CAST(ts AS DATE)) - CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 ELSE 8 END AS INTEGER) AS chunk_id, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events
WHERE (ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-07') OR (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-21') GROUP BY 1, 2""")
def streamed_seasons(spark, d):
    s = chunks.with_chunks(_stream(spark, d).withColumnRenamed("ts", "epoch"), chunks.Bounds.of(["2024-01-02", "2024-01-15"], ["2024-01-06", "2024-01-20"]))
    means = s.groupBy("chunk_id", "event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    done = windows.run_once(means, "seasons", "complete")
    return done.select("chunk_id", "event_type", F.round("mean", 6).alias("mean"), "n")


@query("""
WITH a AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS epoch, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT time_bucket(INTERVAL 2 HOUR, ts)::TIMESTAMP AS epoch, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
s AS (SELECT min(step) AS step FROM (SELECT epoch - lag(epoch) OVER (ORDER BY epoch) AS step FROM a UNION ALL SELECT epoch - lag(epoch) OVER (ORDER BY epoch) FROM b)),
r AS (SELECT greatest((SELECT min(epoch) FROM a), (SELECT min(epoch) FROM b)) AS lo, least((SELECT max(epoch) FROM a), (SELECT max(epoch) FROM b)) AS hi),
g AS (SELECT unnest(generate_series(lo, hi, step)) AS epoch FROM r, s)
SELECT g.epoch, x.value AS value_events_click, y.value AS value_events_view FROM g ASOF LEFT JOIN a x ON g.epoch >= x.epoch ASOF LEFT JOIN b y ON g.epoch >= y.epoch""")
def constellation_at_the_finest_step(spark, d):
    def by_hours(n: int):
        hour = F.timestamp_add("HOUR", F.floor(F.hour("epoch") / n).cast("int") * n, F.col("epoch").cast("date").cast("timestamp_ntz"))
        return lambda df: df.groupBy(hour.alias("epoch")).agg(F.max("value").alias("value"))

    members = (_event_instrument(d, "click", preprocess=by_hours(1)), _event_instrument(d, "view", preprocess=by_hours(2)))
    return Constellation(members).to_frame(spark, method="ffill")


_PADDED_SQL = """
WITH c AS (SELECT unnest(range(12)) AS k), b AS (SELECT k, TIMESTAMP '2024-01-02' + to_days(CAST(2 * k AS INTEGER)) AS a FROM c),
p AS (
  SELECT k, a, event_id, user_id, ts, value FROM b JOIN events ON ts >= a - INTERVAL 6 HOUR AND ts < a + INTERVAL 3 DAY + INTERVAL 6 HOUR WHERE event_type = 'click'
)"""


def _late_stream(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream of five files, a week each; every 13th event of a week comes with the week after. Two more, of user -1, move time on."""
    at = scratch(spark, "late")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("epoch"))
    week = F.floor(F.datediff(F.col("epoch").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    dealt = e.withColumn("file", week + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
    low, high = dealt.agg(F.min("file"), F.max("file")).first()
    for k in range(low, high + 1):
        dealt.where(F.col("file") == k).drop("file").repartition(1).write.mode("append").parquet(at)
    end = e.agg(F.max("epoch").alias("epoch")).select(F.expr("-1L").alias("event_id"), F.expr("-1L").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), "epoch")
    for days in (100, 101):
        end.withColumn("epoch", F.col("epoch") + F.expr(f"interval {days} days")).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)


EVENT_SCHEMA = "event_id long, user_id long, event_type string, value double, epoch timestamp_ntz"


@query(CYCLIC_SCAN + "SELECT event_id, user_id, orbit FROM o")
def streamed_cyclic_orbits(spark, d):
    found = orbits.cyclic_orbits(_late_stream(spark, d), "value", SPAN, "user_id", period=PERIOD_S, ties=("event_id",), late="14 days", close_after="30 days")
    done = windows.run_once(found, "orbits", stateful=True)
    return done.where("user_id >= 0").select("event_id", "user_id", "orbit")


@query(_PADDED_SQL + """, w AS (SELECT *, lag(value) OVER (PARTITION BY k, user_id ORDER BY ts, event_id) AS prior FROM p)
SELECT CAST(k AS INTEGER) AS chunk_id, user_id, event_id, prior FROM w WHERE ts >= a AND ts < a + INTERVAL 3 DAY""")
def streamed_padded_chunks(spark, d):
    def prior(chunk):
        return chunk.assign(prior=chunk.groupby("user_id")["value"].shift()).loc[chunk["in_chunk"], ["user_id", "event_id", "prior"]]

    clicks = _late_stream(spark, d).where("event_type IN ('click', 'end')")
    bounds = chunks.Bounds.of("2024-01-02", "2024-01-26", "2D", "3D")
    found = stream_chunks.per_chunk(clicks, bounds, prior, "event_id long, prior double", "user_id", pad="6 hours", ties=("event_id",), late="14 days", together=True)
    return windows.run_once(found, "chunks", stateful=True)


@query(SQL["streamed_seasons"])
def streamed_seasons_as_they_end(spark, d):
    """Each chunk of the seasons once, when the watermark has passed it, whatever comes late until then."""

    def mean(chunk):
        return chunk.agg({"value": "mean"}).to_frame().T.rename(columns={"value": "mean"}).assign(n=chunk["value"].count())

    seasons = chunks.Bounds.of(["2024-01-02", "2024-01-15"], ["2024-01-06", "2024-01-20"])
    found = stream_chunks.per_chunk(_late_stream(spark, d), seasons, mean, "mean double, n long", "event_type", late="14 days")
    return windows.run_once(found, "seasons_ended", stateful=True).select("chunk_id", "event_type", F.round("mean", 6).alias("mean"), "n")


# --- files -----------------------------------------------------------------------------------------------------------

EVENT_FILES = files.Template("events_{year:04d}_{day:03d}_v{version:02d}.dat")


def _event_files(spark: SparkSession, d: str, format: str = "parquet", **options) -> Instrument:
    """All events as a file for each day, the first ten days in a second version with doubled values; an empty folder is tried first."""
    at = scratch(spark, "archive")
    archive = Archive((f"{at}/none", f"{at}/events"), EVENT_FILES, format, EVENT_SCHEMA, {"header": "true"} if format == "csv" else {})
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("epoch"))
    archive.write(e, folder=f"{at}/events", version=1)
    archive.write(e.where("epoch < timestamp_ntz'2024-01-11'").withColumn("value", F.col("value") * 2), folder=f"{at}/events", version=2)
    return Instrument("events", "files", catalog=archive.refresh(spark), **options)


_FILE_SQL = "SELECT event_id, user_id, event_type, ts AS epoch, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN value * 2 ELSE value END AS value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS n FROM events"


@query(f"SELECT event_id, value, format('events_2024_{{:03d}}_v{{:02d}}.dat', n + 1, CASE WHEN n < 10 THEN 2 ELSE 1 END) AS file_name FROM ({_FILE_SQL})")
def reissued_files(spark, d):
    """A first batch of all days in version 1; a second one of ten days in version 2, and of days in version 0, which come too late."""
    at = scratch(spark, "followed")
    archive = Archive((f"{at}/events",), EVENT_FILES, schema=EVENT_SCHEMA)
    follower = Follower(archive, f"{at}/table")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("epoch"))
    archive.write(e, version=1)
    follower.run(spark)
    archive.write(e.where("epoch < timestamp_ntz'2024-01-11'").withColumn("value", F.col("value") * 2), version=2)
    archive.write(e.where("epoch >= timestamp_ntz'2024-01-06'").withColumn("value", F.lit(0.0)), version=0)
    follower.run(spark)
    return follower.rows(spark).select("event_id", "value", "file_name")


@query(f"SELECT event_id, value FROM ({_FILE_SQL}) WHERE n BETWEEN 7 AND 12")
def files_loaded_by_name(spark, d):
    return _event_files(spark, d).load(spark, fname="events_2024_008_v02.dat", stop_fname="events_2024_013_v01.dat", columns=["event_id", "value"])


@query(f"SELECT event_id, value FROM ({_FILE_SQL}) WHERE epoch >= TIMESTAMP '2024-01-09 06:00:00' AND epoch < TIMESTAMP '2024-01-12 18:00:00'")
def files_loaded_by_time(spark, d):
    return _event_files(spark, d, "csv").load(spark, "2024-01-09 06:00:00", "2024-01-12 18:00:00", columns=["event_id", "value"])


@query(f"""
WITH f AS ({_FILE_SQL}), c AS (SELECT unnest(range(9)) AS k)
SELECT CAST(k AS INTEGER) AS chunk_id, event_type, count(*) AS n, max(value) AS most FROM c JOIN f ON n BETWEEN 2 + 2 * k AND 4 + 2 * k WHERE k < 9 GROUP BY 1, 2""")
def files_iterated(spark, d):
    found = _event_files(spark, d).iterate(spark, FileBounds.of("events_2024_003_v02.dat", "events_2024_021_v01.dat", step=2, width=3))
    return found.groupBy("chunk_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query(f"SELECT event_id FROM ({_FILE_SQL}) WHERE n IN (4, 5)")
def files_next_and_previous(spark, d):
    cursor = Cursor(_event_files(spark, d), FileBounds.of("events_2024_003_v02.dat", None, step=2, width=2))
    return cursor.next().next().next().prev().load(spark, columns=["event_id"])


@query(f"""
WITH f AS ({_FILE_SQL} WHERE event_type = 'view'), c AS (SELECT unnest(range(5)) AS k),
p AS (
  SELECT k, f.*, lag(value) OVER (PARTITION BY k, user_id ORDER BY epoch, event_id) AS prior
  FROM c JOIN f ON epoch >= TIMESTAMP '2024-01-03' + to_days(CAST(2 * k AS INTEGER)) - INTERVAL 12 HOUR AND epoch < TIMESTAMP '2024-01-06' + to_days(CAST(2 * k AS INTEGER)) + INTERVAL 12 HOUR
)
SELECT CAST(k AS INTEGER) AS chunk_id, event_id, prior FROM p WHERE n BETWEEN 2 + 2 * k AND 4 + 2 * k""")
def padded_files_iterated(spark, d):
    inst = _event_files(spark, d, preprocess=lambda df: df.where("event_type = 'view'"), pad="12 hours").attach(_prior)
    return inst.iterate(spark, FileBounds.of("events_2024_003_v02.dat", "events_2024_013_v01.dat", step=2, width=3)).select("chunk_id", "event_id", "prior")


# --- steps on chunks with a pad --------------------------------------------------------------------------------------


def _prior(df: DataFrame, chunk: tuple[str, ...]) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumn("prior", F.lag("value").over(Window.partitionBy(*chunk, "user_id").orderBy("epoch", "event_id")))


@query(_PADDED_SQL + """, w AS (SELECT *, lag(value) OVER (PARTITION BY k, user_id ORDER BY ts, event_id) AS prior FROM p)
SELECT CAST(k AS INTEGER) AS chunk_id, event_id, prior FROM w WHERE ts >= a AND ts < a + INTERVAL 3 DAY""")
def padded_iteration(spark, d):
    inst = _event_instrument(d, "click", pad="6 hours").attach(_prior)
    return inst.iterate(spark, chunks.Bounds.of("2024-01-02", "2024-01-26", "2D", "3D")).select("chunk_id", "event_id", "prior")


@query(_PADDED_SQL + """, w AS (
  SELECT *, avg(value) OVER (PARTITION BY k, user_id % 10 ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM p
)
SELECT CAST(k AS INTEGER) AS chunk_id, event_id, round(smooth, 6) AS smooth FROM w WHERE ts >= a AND ts < a + INTERVAL 3 DAY""")
def smoothed_in_pandas(spark, d):
    def smooth(chunk):
        chunk = chunk.sort_values(["epoch", "event_id"])
        return chunk.assign(smooth=chunk["value"].rolling(5, center=True, min_periods=1).mean())

    inst = _event_instrument(d, "click", pad="6 hours", preprocess=lambda df: df.withColumn("decade", F.col("user_id") % 10))
    inst = inst.attach_pandas(smooth, "epoch timestamp_ntz, event_id long, user_id long, value double, decade long, smooth double", "decade")
    return inst.iterate(spark, chunks.Bounds.of("2024-01-02", "2024-01-26", "2D", "3D")).select("chunk_id", "event_id", F.round("smooth", 6).alias("smooth"))


# --- orbits as they are stepped through ------------------------------------------------------------------------------


@query(f"""
WITH f AS ({_FILE_SQL}), b AS (
  SELECT event_id, epoch, CAST(coalesce((value - 245 >= 0) <> lag(value - 245 >= 0) OVER w, false)
         OR coalesce((epoch_us(epoch) - epoch_us(lag(epoch) OVER w)) / 1e6 / {PERIOD_S} > 0.95, false) AS INT) AS brk
  FROM f WINDOW w AS (ORDER BY epoch, event_id)
), o AS (SELECT event_id, sum(brk) OVER (ORDER BY epoch, event_id) AS orbit FROM b), l AS (SELECT max(orbit) AS last FROM o)
SELECT event_id, CASE orbit WHEN 1 THEN 'second' WHEN 40 THEN 'forty-first' ELSE 'last' END AS step FROM o, l WHERE orbit IN (1, 40, last)""")
def orbits_stepped_through(spark, d):
    def rule(df: DataFrame) -> DataFrame:
        return batch_orbits.continuous_polar_orbits(df.withColumn("latitude", F.col("value") - 245), "latitude", period=PERIOD_S, ties=("event_id",))

    player = OrbitRecord.build(spark, _event_files(spark, d), rule, ties=("event_id",)).cursor()
    steps = {"second": player.next().next().next().prev(), "forty-first": player[40], "last": player.prev()}
    found = [at.load(spark, columns=["event_id"]).withColumn("step", F.lit(name)) for name, at in steps.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- nested variables on common axes ---------------------------------------------------------------------------------


def _profiles(spark: SparkSession, d: str) -> list[DataFrame]:
    """Orders as profiles over two axes; those of odd keys lie on other coordinates."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    level = F.struct(F.col("l_linenumber").cast("double").alias("x"), F.array(F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 997).cast("double"), (F.col("l_discount") * 100).cast("double")).alias("v"))
    # in one aggregate; of equal line numbers the least level comes first and stays
    held = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(level)).alias("every"))
    held = held.select("l_orderkey", F.filter("every", lambda x, i: (i == 0) | ~x["x"].eqNullSafe(F.get("every", i - 1)["x"])).alias("levels"))
    odd = F.col("l_orderkey") % 2 == 1
    taken = held.select(
        "l_orderkey", odd.alias("odd"), F.transform("levels", lambda x: x["x"] * F.when(odd, 1.5).otherwise(1.0)).alias("height"),
        F.transform(F.array(*[F.lit(float(j)) for j in range(3)]), lambda j: j + F.when(odd, 0.5).otherwise(0.0)).alias("beam"), F.transform("levels", lambda x: x["v"]).alias("density"),
    )
    return [taken.where(~F.col("odd")), taken.where("odd")]


@query("""
WITH p AS (
  SELECT l_orderkey, l_linenumber, min({'q': CAST(l_quantity AS DOUBLE), 'p': CAST(l_extendedprice / 997 AS DOUBLE), 'd': CAST(l_discount * 100 AS DOUBLE)}) AS v FROM lineitem GROUP BY 1, 2
), x AS (
  SELECT l_orderkey, l_orderkey % 2 = 1 AS odd, l_linenumber * CASE WHEN l_orderkey % 2 = 1 THEN 1.5 ELSE 1.0 END AS x, [v.q, v.p, v.d] AS v FROM p
), ends AS (SELECT odd, min(x) AS lo, max(x) AS hi, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM x) GROUP BY 1),
span AS (SELECT max(lo) AS lo, min(hi) AS hi, CAST(floor((min(hi) - max(lo)) / min((hi - lo) / (n - 1))) AS BIGINT) + 1 AS n FROM ends),
heights AS (SELECT i, lo + i * (hi - lo) / (n - 1) AS t FROM (SELECT unnest(range(n)) AS i, lo, hi, n FROM span)),
beams AS (SELECT unnest([0, 1]) AS j, unnest([0.5, 2.0]) AS t),
b AS (
  SELECT l_orderkey, x, j, CASE WHEN u = floor(u) THEN v[CAST(u AS BIGINT) + 1] ELSE v[CAST(floor(u) AS BIGINT) + 1] + (v[CAST(floor(u) AS BIGINT) + 2] - v[CAST(floor(u) AS BIGINT) + 1]) * (u - floor(u)) END AS y
  FROM (SELECT x.*, j, t - CASE WHEN odd THEN 0.5 ELSE 0 END AS u FROM x, beams)
), n AS (
  SELECT l_orderkey, i, j, t, max(x) FILTER (WHERE x <= t) AS a, min(x) FILTER (WHERE x >= t) AS c, arg_max(y, x) FILTER (WHERE x <= t) AS ya, arg_min(y, x) FILTER (WHERE x >= t) AS yc
  FROM b, heights GROUP BY 1, 2, 3, 4
)
SELECT l_orderkey, CAST(i AS INTEGER) AS height, CAST(j AS INTEGER) AS beam, round(CASE WHEN a = c THEN ya ELSE ya + (yc - ya) * (t - a) / (c - a) END, 5) AS value FROM n WHERE a IS NOT NULL AND c IS NOT NULL""")
def aligned_profiles(spark, d):
    members = _profiles(spark, d)
    targets = axes.shared_axes(members, ["height", "beam"])
    moved = [axes.regrid(m, {"density": ("height", "beam")}, targets, "linear") for m in members]
    long = to_long(moved[0].unionByName(moved[1]), "density", ["height", "beam"], "l_orderkey")
    return long.where("value IS NOT NULL").select("l_orderkey", "height", "beam", F.round("value", 5).alias("value"))


@query("""
WITH p AS (
  SELECT l_orderkey, l_linenumber, min(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY 1, 2
), o AS (SELECT DISTINCT l_orderkey FROM p), t AS (SELECT unnest(range(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY l_orderkey)) + 1)) AS i),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM p)
SELECT o.l_orderkey, CAST(t.i - 1 AS INTEGER) AS place, coalesce(r.q, -9.0) AS value FROM o CROSS JOIN t LEFT JOIN r ON r.l_orderkey = o.l_orderkey AND r.i = t.i""")
def profiles_of_one_size(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("double")).alias("q"))
    held = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda r: r["q"]).alias("profile"))
    held = Meta({"profile": {"fill": -9.0}}).attach(held)
    return to_long(axes.equal_sizes(held, ["profile"]), "profile", ["place"], "l_orderkey")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, min({'q': CAST(l_quantity AS DOUBLE), 'p': CAST(l_extendedprice / 997 AS DOUBLE), 'd': CAST(l_discount * 100 AS DOUBLE)}) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p)
SELECT l_orderkey, max(CASE WHEN i = 2 THEN v.p END) AS second, max(CASE WHEN i = 1 THEN v.d END) AS first FROM r GROUP BY 1""")
def nested_elements(spark, d):
    members = _profiles(spark, d)
    both = members[0].unionByName(members[1])
    return both.select("l_orderkey", element(both, "density", 1, 1).alias("second"), element(both, "density", 0, 2).alias("first"))
