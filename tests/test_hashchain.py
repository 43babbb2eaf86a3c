import hashlib

from lodewatch.operators import hashchain


def brute(rows):
    out, last = {}, {}
    for key, ts, seq, kind in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        idx, before = last.get(key, (0, hashchain.GENESIS))
        now = hashlib.sha256("|".join([str(idx), str(ts), str(seq), *([] if kind is None else [kind]), before]).encode()).hexdigest()
        out[key, idx] = (ts, seq, kind, before, now)
        last[key] = (idx + 1, now)
    return out


def chain(spark, rows):
    df = spark.createDataFrame(rows, "session long, seq long, ts long, kind string").repartition(4)
    return hashchain.build(df, "session", ["ts", "seq"], ["ts", "seq", "kind"])


def test_chains_stream_over_batches(spark):
    rows = [(i % 5 or None, i * 7 % 300, i, None if i % 11 == 0 else f"k{i % 3}") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = chain(spark, [(s, q, t, k) for s, t, q, k in rows])
        got = {(r.session, r.idx): (r.ts, r.seq, r.kind, r.previous_hash, r.hash) for r in made.collect()}
        assert got == brute(rows)
        assert hashchain.verify(made, "session", ["ts", "seq", "kind"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_group_is_collected(spark):
    plan = chain(spark, [(1, 1, 1, "a")])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Sort" in plan
