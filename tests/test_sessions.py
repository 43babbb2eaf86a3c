"""Scores of sessions and masking of single lines on small rows."""

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import functions as F

from lodewatch.operators import behaviors, dna


def test_evasion_score_adds_in_the_order_of_the_signals(spark):
    parts = [0.2, 0.7, 0.1, 0.4, 0.1]  # 1.5, and a little less from the back
    forward, back = reduce(add, parts), reduce(add, reversed(parts))
    assert (forward < 1.5) != (back < 1.5)
    rows = [(s, i, "t", x) for s, own in ((1, parts), (2, parts[::-1])) for i, x in enumerate(own)]
    want = {1: int(forward + 0.5), 2: int(back + 0.5)}
    for dealt in (rows, rows[::-1]):
        signals = spark.createDataFrame(dealt, "session long, seq long, type string, confidence double").coalesce(1)
        assert {r.session: r.score for r in behaviors.evasion_score(signals, {"t": 1.0}).collect()} == want


def test_risk_adds_types_in_the_order_in_which_they_are_first_seen(spark):
    parts = [("process_suspicious", 49), ("ai_prompt_sent", 36), ("git_history_read", 48), ("secrets_scanned", 41)]  # 97.5, or a little less
    rows, want = [], {}
    for s, own in enumerate(permutations(parts)):
        sure = {t: 0.5 + k / 100.0 for t, k in own}
        raw = reduce(add, [behaviors.WEIGHTS[t] * sure[t] for t, _ in own])
        want[s] = int(raw * 1.3 / 120 * 100 + 0.5)
        # each type first with less confidence, its best in the opposite order
        seen = [(t, 0.5) for t, _ in own] + [(t, sure[t]) for t, _ in reversed(own)]
        rows += [(s, i, i * 3600 * behaviors.SECOND, t, c) for i, (t, c) in enumerate(seen)]
    assert set(want.values()) == {97, 98}
    for dealt in (rows, rows[::-1]):
        b = spark.createDataFrame(dealt, "session long, seq long, ts long, type string, confidence double")
        assert {r.session: r.score for r in behaviors.risk(b).collect()} == want


def test_masked_line_keeps_code_only(spark):
    rows = spark.createDataFrame([("key=ab // note 1 'quoted'",), ("a = 'x' + `y` /* z */;",), ("  # all",)], "line string")
    assert [r.code for r in rows.select(dna.masked(F.col("line")).alias("code")).collect()] == ["key=ab ", 'a = "" + "" ;', ""]
