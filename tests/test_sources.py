import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import quality
from tidemark.sources import remote, ticks
from tidemark.streaming import bars as streaming

HEADER = ",".join(f.name for f in schema.tick_schema())


def tick_line(date, close, **more):
    return ",".join([date, *[str(more.get(f.name, close if f.name == "close" else "")) for f in schema.tick_schema()[1:]]])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ticks")
    good = [tick_line("2015-02-02 09:15:00+05:30", 10.5, high=11, low=10, volume=7, RSI14="NaN"), tick_line("nonsense", 9), tick_line("2015-02-02 09:16:00+05:30", 0), tick_line("2016-03-02 09:17:00+05:30", "", RSI14=55)]
    (folder / "A&B_minute_data_with_indicators.csv").write_text("\n".join([HEADER, *good]))
    (folder / "other.csv").write_text("\n".join([HEADER, tick_line("2015-02-02 09:15:00+05:30", 3)]))
    return folder


def test_csv_ticks(spark, files):
    rows = ticks.enrich(ticks.read_csv(spark, str(files))).collect()
    assert len(rows) == 5 and {r.stock_symbol for r in rows} == {"A&B", ""}
    first = next(r for r in rows if r.close == 10.5)
    assert first.timestamp == dt.datetime(2015, 2, 2, 3, 45) and (first.year, first.month, first.day) == (2015, 2, 2) and first.RSI14 is None and first.volume == 7
    assert [r.timestamp for r in rows if r.date == "nonsense"] == [None]
    clean = quality.clean(ticks.enrich(ticks.read_csv(spark, str(files))), "stock_symbol", "timestamp", "close")
    assert [r.close for r in clean.collect()] == [10.5]


def test_partitioned_sink_prunes(spark, files, tmp_path):
    table = quality.clean(ticks.enrich(ticks.read_csv(spark, str(files))), "stock_symbol", "timestamp", "close")
    ticks.write_partitioned(table, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    found = stored.filter("year = 2015 AND stock_symbol = 'A&B'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    size = ticks.stored_size(spark, str(tmp_path / "out")).first()
    assert size.n_files >= 1 and size.n_bytes > 0
    report = quality.conversion(table, stored, 1000, size.n_bytes).first()
    assert report.intact and report.source_rows == report.stored_rows == 1


def test_schema_counts():
    assert len(schema.tick_schema()) == 60 and len(schema.INDICATORS) == 54 and len(schema.PCA_INPUT) == 60 and len(schema.documented_schema()) == 63
    assert {len(schema.LSH_FINGERPRINT), len(schema.ASSOCIATION_ITEMS), len(schema.SIGNALS)} == {8, 6}


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    limiter = remote.RateLimiter(((60.0, 3), (3600.0, 5)), clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.acquire()
    assert not slept
    limiter.acquire()
    assert slept == [61.0]
    limiter.acquire()
    limiter.acquire()
    assert now[0] > 3600


def test_retry():
    slept, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("rate limit, wait 12 seconds" if len(calls) == 1 else "broken")
        return "ok"

    assert remote.with_retry(call, sleep=slept.append) == "ok" and slept == [17.0, 2.0]
    with pytest.raises(KeyError):
        remote.with_retry(lambda: {}["x"], attempts=2, sleep=slept.append)


def test_symbols():
    assert remote.parse_symbols("", list, ["x"]) == ["X"] and remote.parse_symbols("ALL", lambda: ["b"], []) == ["B"]
    assert remote.parse_symbols("a, b,a,", list, []) == ["A", "B"] and remote.parse_symbols("@f", list, [], lambda p: "# c\nq\n\nr") == ["Q", "R"]


def fetch(symbol, interval):
    yield from ((f"2024-01-{k % 28 + 1:02d} 09:{k:02d}:00", "1", "2", "0.5", "x" if k == 3 else "1.5", "10") for k in range(40 if symbol == "AAA" else 5))


def test_remote_source_and_normaliser(spark):
    spark.dataSource.register(remote.RemotePrices)
    raw = spark.read.format("remote_prices").option("fetch", "tests.test_sources:fetch").option("symbols", "aaa,bbb").load()
    assert raw.count() == 45 and raw.rdd.getNumPartitions() == 2
    rows = remote.normalise(raw).collect()
    assert len(rows) == 39 and {r.stock_symbol for r in rows} == {"AAA"} and rows[0].date.endswith("+07:00") and rows[0].volume == 10


def test_streamed_bars_are_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    to_ticks = lambda df: df.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), "event_id")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    streaming.write_bars(streaming.windowed_bars(to_ticks(stream)), str(tmp_path / "bars"), str(tmp_path / "state")).awaitTermination()
    streaming.write_bars(streaming.windowed_bars(to_ticks(stream)), str(tmp_path / "bars"), str(tmp_path / "state")).awaitTermination()  # nothing twice
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    end = events.agg(F.max("ts").cast("timestamp")).first()[0] - dt.timedelta(hours=1)
    want = {tuple(r) for r in streaming.windowed_bars(to_ticks(events)).collect() if r.start + dt.timedelta(days=1) <= end}
    assert got == want and got


def test_quality_reports(spark):
    rows = [(float(k), None if k % 2 else 1.0, float("nan") if k < 3 else 2.0) for k in range(20)] + [(1e6, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    lacks = {r.column: r.missing_count for r in quality.missing(df, ["a", "b", "c"]).collect()}
    assert lacks == {"a": 0, "b": 10, "c": 3}
    strays = quality.outliers(df, ["a"], exact=True).first()
    assert strays.n_outliers == 1 and strays.lower < 0 < strays.upper < 1e6
    whole = quality.completeness(df, ["a", "b", "c"])
    assert whole.first().completeness_score == 100.0
    told = quality.recommendations(quality.missing(df, ["a", "b", "c"]), quality.outliers(df, ["a"]), whole).collect()
    assert [(r.type, r.severity, r.n_columns) for r in told] == [("MISSING_DATA", "HIGH", 1)]
    fine = df.select("a").limit(20)
    assert quality.recommendations(quality.missing(fine, ["a"]), quality.outliers(fine, ["a"]), quality.completeness(fine, ["a"])).first().type == "OK"
    empty = df.limit(0)
    assert quality.completeness(empty, ["a"]).first().completeness_score == 0.0 and quality.missing(empty, ["a"]).first().missing_percentage is None
