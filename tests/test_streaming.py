import datetime as dt

import pytest

from lodewatch.streaming import live

SCHEMA = "session long, seq long, ts timestamp, kind string, host string, bytes double"
START = dt.datetime(2024, 1, 1)


def rows(n, step=1, session=1):
    return [(session, i, START + dt.timedelta(seconds=i * step), "read", f"h{i % 30}", 10.0) for i in range(n)]


@pytest.fixture
def stream(spark, tmp_path):
    folder = tmp_path / "in"

    def feed(batch):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(folder))

    def source():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))

    return feed, source


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_first_seen(stream):
    feed, source = stream
    feed(rows(40) + rows(40))
    assert len(drain(live.first_seen(source(), ["session", "host"]), "seen")) == 30


def test_mass_reads_and_sessions(stream):
    feed, source = stream
    feed(rows(200, 0.05) + [(1, 999, START + dt.timedelta(hours=5), "read", "x", 1.0)])
    feed([(2, 1000, START + dt.timedelta(hours=10), "read", "x", 1.0)])
    found = drain(live.mass_reads(source()), "mass")
    assert sorted(r.n for r in found) == [100, 100]
    visits = drain(live.sessions(source()), "visits")
    assert sorted((r.session, r.n) for r in visits) == [(1, 1), (1, 200)]


def test_chain_continues_over_batches(stream):
    feed, source = stream
    feed(rows(5))
    feed([(1, 100 + i, START + dt.timedelta(hours=1, seconds=i), "read", "h", 1.0) for i in range(5)])
    links = sorted(drain(live.chain(source()), "links"), key=lambda r: r.idx)
    assert [r.idx for r in links] == list(range(10))
    assert all(a.hash == b.previous_hash for a, b in zip(links, links[1:], strict=False))


def test_baseline_and_alerts(spark, stream, tmp_path):
    feed, source = stream
    feed(rows(40))
    baseline = spark.createDataFrame([(f"h{i}",) for i in range(25)], "host string")
    assert len(drain(live.not_in_baseline(source(), baseline, ["host"]), "new")) == 5
    got = []
    from pyspark.sql import functions as F

    q = live.alerts(source().withColumn("severity", F.when(F.col("seq") == 7, "critical").otherwise("info")), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.seq for r in got] == [7]
