"""Session operators bound to events: a user is a session, the type a kind, the value bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, behaviors, hashchain
from ..operators.behaviors import SECOND, SEQUENCES, TECHNIQUES, WEIGHTS
from .tables import read

# What each event type stands for here.
TYPE_OF = {"error": "process_suspicious", "click": "ai_prompt_sent", "purchase": "code_upload", "view": "git_history_read", "signup": "secrets_scanned"}


def events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("host"), k % 10).alias("host"), (F.col("value") * 1000).alias("bytes"), k.alias("k")
    )


def acts(spark, sf_dir):
    """Behaviours: every event with its type and a confidence from its payload."""
    e = events(spark, sf_dir)
    return e.select("session", "seq", "ts", behaviors.lookup(F.col("kind"), TYPE_OF, "").alias("type"), (F.lit(0.5) + (F.col("k") % 50) / 100.0).alias("confidence"))


def case(column: str, values: dict, default="NULL") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {default} END"


EVENTS = "(SELECT user_id AS session, event_id AS seq, epoch_us(ts) AS ts, event_type AS kind, 'host' || ((props->>'$.k')::INT % 10) AS host, value * 1000 AS bytes, (props->>'$.k')::INT AS k FROM events)"
ACTS = f"(SELECT session, seq, ts, {case('kind', TYPE_OF)} AS type, 0.5::DOUBLE + (k % 50) / 100.0::DOUBLE AS confidence FROM {EVENTS})"
WEIGHT = case("type", WEIGHTS, 0)


def flow_classify(spark, sf_dir):
    e = events(spark, sf_dir)
    known, prompt = F.col("host").isin("host1", "host2", "host3"), F.col("kind") == "click"
    found = behaviors.flow_type(known, F.col("bytes"), prompt, F.col("kind") == "signup", F.col("host") == "host9", 100_000, 50_000)
    large, huge = F.col("bytes") > 100_000, F.col("bytes") > 300_000
    sure = behaviors.flow_confidence(known.cast("int") + prompt.cast("int"), F.lit(0), large, huge, F.col("host") == "host9")
    return e.select("seq", found.alias("type"), F.round(sure, 6).alias("confidence")).where("type is not null")


FLOW_SQL = f"""SELECT seq, type, confidence FROM (SELECT seq, CASE WHEN host = 'host9' THEN 'tls_suspicious' WHEN kind = 'signup' THEN 'dns_suspicious' WHEN known AND bytes > 100000 THEN 'code_upload' WHEN known AND kind = 'click' THEN 'ai_prompt_sent'
  WHEN known THEN 'suspicious_connection' WHEN kind = 'click' AND bytes > 50000 THEN 'code_upload' END AS type,
  round(least(0.99::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * (known::INT + (kind = 'click')::INT) + CASE WHEN bytes > 100000 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN bytes > 300000 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN host = 'host9' THEN 0.05 ELSE 0 END::DOUBLE), 6) AS confidence
  FROM (SELECT *, host IN ('host1', 'host2', 'host3') AS known FROM {EVENTS})) WHERE type IS NOT NULL"""


def process_intent_dim_join(spark, sf_dir):
    intents = F.broadcast(spark.createDataFrame([("error", "execute"), ("click", "interact"), ("purchase", "transfer"), ("view", "read")], "kind string, intent string"))  # a fixed table
    e = events(spark, sf_dir).join(intents, "kind", "left").withColumn("intent", F.coalesce("intent", F.when(F.col("host") == "host0", "network").otherwise("unknown")))
    return e.groupBy("session", "intent").agg(F.count("*").alias("n"))


def evidence_severity_union(spark, sf_dir):
    e = events(spark, sf_dir)
    flows = e.where("kind <> 'error'").select("seq", F.lit("flow").alias("source"), F.when(F.col("bytes") > 300_000, "critical").when((F.col("bytes") > 100_000) | (F.col("host") == "host1"), "warning").otherwise("info").alias("severity"))
    processes = e.where("kind = 'error'").select("seq", F.lit("process").alias("source"), F.when(F.col("k") > 80, "warning").otherwise("info").alias("severity"))
    return flows.unionByName(processes)


def rhythm_cv_by_user(spark, sf_dir):
    r = behaviors.rhythm(events(spark, sf_dir), most_cv=1.0)
    return r.select("session", "n", F.round(F.col("avg_gap") / SECOND, 3).alias("avg_gap"), F.round("cv", 6).alias("cv"), "artificial")


def protocol_hopping(spark, sf_dir):
    return behaviors.hopping(events(spark, sf_dir), least=4, changes=2, span=86_400 * SECOND)


def fragmented_traffic(spark, sf_dir):
    f = behaviors.fragmented(events(spark, sf_dir), 5, 200_000, 45_000, 86_400 * SECOND, 10)
    return f.select("session", "host", "n", F.round("bytes", 3).alias("bytes"), F.round("avg_chunk", 3).alias("avg_chunk"), "span_us")


def distributed_chain(spark, sf_dir):
    return behaviors.distributed(events(spark, sf_dir), 100_000)


def read_write_ratio(spark, sf_dir):
    return behaviors.read_write(events(spark, sf_dir), F.col("kind") == "view", F.col("kind") == "purchase", F.col("k") > 80, 10, 1.0, 2)


def mass_read_window(spark, sf_dir):
    return behaviors.mass_reads(events(spark, sf_dir).where("kind = 'view'"), 7 * 86_400 * SECOND, 5, 3)


def anti_evasion_score(spark, sf_dir):
    weights = {"process_suspicious": 4.0, "ai_prompt_sent": 2.0, "code_upload": 5.0}
    return behaviors.evasion_score(acts(spark, sf_dir).where("confidence > 0.9"), weights)


def inference_cascade(spark, sf_dir):
    a = acts(spark, sf_dir).where("confidence > 0.85")
    sent = events(spark, sf_dir).groupBy("session").agg(F.bool_or(F.col("bytes") > 350_000).alias("sent"))
    kinds = {"process_suspicious": "git_bundle_created", "ai_prompt_sent": "mass_file_read", "code_upload": "preparation_detected"}
    return behaviors.inferred(a.withColumn("type", F.coalesce(behaviors.lookup(F.col("type"), kinds, None), F.col("type"))), sent)


CASCADE_SQL = f"""WITH a AS (SELECT session, CASE type WHEN 'process_suspicious' THEN 'git_bundle_created' WHEN 'ai_prompt_sent' THEN 'mass_file_read' WHEN 'code_upload' THEN 'preparation_detected' ELSE type END AS type FROM {ACTS} WHERE confidence > 0.85),
  s AS (SELECT session, bool_or(type = 'git_bundle_created') AS bundle, bool_or(type = 'mass_file_read') AS mass, bool_or(type = 'git_history_read') AS history, bool_or(type = 'secrets_scanned') AS scanned, bool_or(type = 'preparation_detected') AS prep FROM a GROUP BY session),
  e AS (SELECT session, bool_or(bytes > 350000) AS sent FROM {EVENTS} GROUP BY session), j AS (SELECT s.*, coalesce(e.sent, false) AS sent FROM s LEFT JOIN e USING (session))
  SELECT session, 'r04' AS rule, 'full_repo_snapshot' AS type, 0.9::DOUBLE AS confidence FROM j WHERE bundle
  UNION ALL SELECT session, 'r05', 'full_repo_snapshot', 0.9 FROM j WHERE mass AND history AND NOT bundle
  UNION ALL SELECT session, 'r06', 'git_bundle_uploaded', 0.95 FROM j WHERE bundle AND sent
  UNION ALL SELECT session, 'r10', 'suspicious_connection', 0.8 FROM j WHERE prep AND sent
  UNION ALL SELECT session, 'r12', 'secrets_exfiltrated', 0.95 FROM j WHERE scanned AND sent"""


def risk_assessment(spark, sf_dir):
    return behaviors.risk(acts(spark, sf_dir).where("confidence > 0.8")).drop("confidence")


def risk_confidence(spark, sf_dir):
    return behaviors.risk(acts(spark, sf_dir)).select("session", "confidence")


def _every(types) -> str:
    return f"count(DISTINCT CASE WHEN type IN ({', '.join(repr(t) for t in types)}) THEN type END) = {len(types)}"


RISK_SQL = f"""SELECT session, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
  SELECT session, least(100, floor(raw * factor * CASE WHEN n < 2 THEN 1.0 WHEN span / (n - 1) < 30 THEN 1.5 WHEN span / (n - 1) < 120 THEN 1.3 WHEN span / (n - 1) < 600 THEN 1.1 ELSE 1.0 END::DOUBLE / 120 * 100 + 0.5))::INT AS score
  FROM (SELECT session, sum(({WEIGHT}) * confidence) AS raw, CASE WHEN count(*) >= 3 THEN 1.3 ELSE 1.0 END::DOUBLE * {' * '.join(f"CASE WHEN {_every(t)} THEN {x} ELSE 1.0 END::DOUBLE" for t, x in SEQUENCES)} AS factor
    FROM (SELECT session, type, max(confidence) AS confidence FROM {ACTS} WHERE confidence > 0.8 GROUP BY session, type) GROUP BY session)
  JOIN (SELECT session, count(*) AS n, (max(ts) - min(ts)) / 1000000.0::DOUBLE AS span FROM {ACTS} WHERE confidence > 0.8 GROUP BY session) USING (session))"""
SURE_SQL = f"""SELECT session, round(least(0.99::DOUBLE, round(avg(confidence), 8) * 0.75::DOUBLE + least(count(*) / 5.0::DOUBLE, 1) * 0.15::DOUBLE + least(count(DISTINCT type) / 3.0::DOUBLE, 1) * 0.1::DOUBLE + 0.1::DOUBLE), 6) AS confidence FROM {ACTS} GROUP BY session"""


def session_dna(spark, sf_dir):
    d = behaviors.session_dna(events(spark, sf_dir), acts(spark, sf_dir))
    return d.withColumn("bytes", F.round("bytes", 3))


DNA_SQL = f"""SELECT session, round(bytes, 3) AS bytes, hosts, kinds, top_type FROM (SELECT session, sum(bytes) AS bytes, count(DISTINCT host) AS hosts FROM {EVENTS} GROUP BY session)
  JOIN (SELECT session, count(*) AS kinds, arg_max(type, (w, type)) AS top_type FROM (SELECT session, type, round(sum(({WEIGHT}) * confidence), 6) AS w FROM {ACTS} GROUP BY session, type) GROUP BY session) USING (session)"""


def mitre_timeline(spark, sf_dir):
    return behaviors.stages(acts(spark, sf_dir))


TIMELINE_SQL = f"""SELECT session, technique, tactic, first(stage ORDER BY ts, stage) AS stage, min(ts) AS first_ts, count(*) AS n FROM {ACTS} JOIN (VALUES {', '.join(str(t) for t in TECHNIQUES)}) d(type, technique, tactic, stage) USING (type) GROUP BY session, technique, tactic"""


def sessionize_gap(spark, sf_dir):
    return behaviors.sessions(events(spark, sf_dir), 6 * 3600 * SECOND)


GAP_SQL = f"""SELECT session, visit, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, seq)::BIGINT AS visit
  FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, seq) > {6 * 3600 * SECOND})::INT, 0) AS new FROM {EVENTS})) GROUP BY session, visit"""


def dedup_within_key(spark, sf_dir):
    return behaviors.first_per_key(events(spark, sf_dir).select("session", "kind", "ts", "seq", "host"), ["session", "kind", "host"])


def hash_chain_build(spark, sf_dir):
    return hashchain.build(events(spark, sf_dir).select("session", "seq", "ts", "kind"), "session", ["ts", "seq"], ["ts", "seq", "kind"])


def hash_chain_verify(spark, sf_dir):
    chain = hash_chain_build(spark, sf_dir)
    tampered = chain.withColumn("kind", F.when(F.col("seq") % 97 == 0, "forged").otherwise(F.col("kind")))
    return hashchain.verify(tampered, "session", ["ts", "seq", "kind"])


CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT session, seq, ts, kind, (row_number() OVER (PARTITION BY session ORDER BY ts, seq) - 1)::INT AS idx FROM {EVENTS}),
  chain AS (SELECT session, seq, ts, kind, idx, repeat('0', 64) AS previous_hash, sha256(idx || '|' || ts || '|' || seq || '|' || kind || '|' || repeat('0', 64)) AS hash FROM e WHERE idx = 0
    UNION ALL SELECT e.session, e.seq, e.ts, e.kind, e.idx, c.hash, sha256(e.idx || '|' || e.ts || '|' || e.seq || '|' || e.kind || '|' || c.hash) FROM chain c JOIN e ON e.session = c.session AND e.idx = c.idx + 1)"""
VERIFY_SQL = CHAIN_SQL + """ SELECT session, idx, 'content' AS fault FROM (SELECT *, CASE WHEN seq % 97 = 0 THEN 'forged' ELSE kind END AS now FROM chain) WHERE sha256(idx || '|' || ts || '|' || seq || '|' || now || '|' || previous_hash) <> hash"""


def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    return asof.nearest(e.where("kind = 'purchase'").select("session", "seq", "ts"), e.where("kind = 'error'"), "session", "ts", "seq").select("seq", "nearest_id", "gap")


def asof_tolerance(spark, sf_dir):
    e = events(spark, sf_dir)
    return asof.nearest(e.where("kind = 'purchase'").select("session", "seq", "ts"), e.where("kind = 'error'"), "session", "ts", "seq", 12 * 3600 * SECOND).select("seq", "nearest_id", "gap")


def asof_sql(tolerance: int | None) -> str:
    keep = "" if tolerance is None else f"AND gap <= {tolerance}"
    return f"""WITH l AS (SELECT * FROM {EVENTS} WHERE kind = 'purchase'), r AS (SELECT * FROM {EVENTS} WHERE kind = 'error'),
      p AS (SELECT l.seq, r.seq AS id, abs(l.ts - r.ts) AS gap, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts - r.ts), r.ts, r.seq) AS rank FROM l JOIN r USING (session))
      SELECT l.seq, p.id AS nearest_id, p.gap FROM l LEFT JOIN p ON p.seq = l.seq AND rank = 1 {keep}"""


def asof_edges(spark, sf_dir):
    """Processes (views of a user) and what is laid to them: files made, tools used and reads, each within its reach."""
    e = events(spark, sf_dir).withColumn("ts", F.expr("ts div 200000"))  # so that the reaches bind
    processes = e.where("kind = 'view' and k <> 0")
    kinds = {"produced": e.where("kind = 'purchase' and k % 2 = 0"), "tool": e.where("kind = 'click'"), "inferred_read": e.where("kind = 'error'")}
    found = [asof.laid_to(rows, processes, "host", "ts", "seq", "seq", edge) for edge, rows in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).drop("host")


EDGE_SQL = f"""WITH e AS (SELECT * REPLACE (ts // 200000 AS ts) FROM {EVENTS}), p AS (SELECT host, seq, ts FROM e WHERE kind = 'view' AND k <> 0),
  a AS (SELECT *, CASE kind WHEN 'purchase' THEN 'produced' WHEN 'click' THEN 'tool' ELSE 'inferred_read' END AS edge FROM e WHERE kind IN ('click', 'error') OR (kind = 'purchase' AND k % 2 = 0)),
  pairs AS (SELECT p.seq AS process, a.seq AS act, edge, abs(a.ts - p.ts) AS gap, row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.ts - p.ts), p.ts, p.seq) AS rank FROM a JOIN p USING (host)
    WHERE abs(a.ts - p.ts) <= CASE edge {' '.join(f"WHEN '{k}' THEN {v}" for k, v in asof.REACH.items())} END)
  SELECT process, act, edge, gap FROM pairs WHERE rank = 1"""


def interval_join_top3(spark, sf_dir):
    e = events(spark, sf_dir)
    return asof.within(e.where("kind = 'signup'"), e, "session", "ts", 6 * 3600 * SECOND, 3, "seq", "seq").drop("session")


INTERVAL_SQL = f"""SELECT left_id, right_id, gap, rank::INT AS rank FROM (SELECT a.seq AS left_id, b.seq AS right_id, abs(a.ts - b.ts) AS gap, row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.ts - b.ts), b.seq) AS rank
  FROM {EVENTS} a JOIN {EVENTS} b ON a.session = b.session AND a.seq <> b.seq AND abs(a.ts - b.ts) <= {6 * 3600 * SECOND} WHERE a.kind = 'signup') WHERE rank <= 3"""


def secret_flow_semi(spark, sf_dir):
    """Sessions' secret reads that a transfer follows within a day."""
    e = events(spark, sf_dir)
    pairs = asof.within(e.where("kind = 'signup'"), e.where("kind = 'purchase'"), "session", "ts", 86_400 * SECOND, None, "seq", "seq")
    secret = e.where("kind = 'signup'").join(pairs.select(F.col("left_id").alias("seq")).distinct(), "seq", "left_semi")
    return secret.select("session", "seq", F.when(F.col("k") > 80, "CRITICAL").when(F.col("k") > 40, "HIGH").otherwise("MEDIUM").alias("severity"))


def observation_confidence(spark, sf_dir):
    bases = {"error": 40.0, "click": 60.0, "purchase": 70.0, "view": 35.0, "signup": 80.0}
    weights = {"error": 0.2, "click": 0.2, "purchase": 0.25, "view": 0.2, "signup": 0.15}
    return behaviors.observation_confidence(events(spark, sf_dir), bases, weights)


OBSERVED_SQL = f"""SELECT session, floor(sum(c * w) + 0.5)::INT AS confidence, round(count(*) FILTER (WHERE c >= 50) / 5.0::DOUBLE, 6) AS coverage FROM (SELECT session, kind, floor(avg(least(100, {case('kind', {"error": 40, "click": 60, "purchase": 70, "view": 35, "signup": 80}, 0)}::DOUBLE
  + CASE WHEN bytes > 0 THEN 5 ELSE 0 END + CASE WHEN host IS NOT NULL THEN 5 ELSE 0 END)) + 0.5) AS c, {case('kind', {"error": 0.2, "click": 0.2, "purchase": 0.25, "view": 0.2, "signup": 0.15}, 0)}::DOUBLE AS w FROM {EVENTS} GROUP BY session, kind) GROUP BY session"""


def threshold_analysis(spark, sf_dir):
    return behaviors.threshold(events(spark, sf_dir).where("k > 50"), 30, ["error", "purchase", "signup"])


def history_correlation_90d(spark, sf_dir):
    """The signals of a session in the 90 days before its last day whose type that day shows again."""
    e = events(spark, sf_dir)
    now = e.groupBy("session").agg(F.max("ts").alias("now"))
    rows = e.join(now, "session")
    today = F.col("now") - 86_400 * SECOND
    current = rows.where(F.col("ts") > today).select("session", "kind").distinct()
    older = rows.where((F.col("ts") <= today) & (F.col("ts") > F.col("now") - 90 * 86_400 * SECOND))
    return older.join(current, ["session", "kind"], "left_semi").groupBy("session", "kind").agg(F.count("*").alias("n"))


HISTORY_SQL = f"""WITH e AS (SELECT *, max(ts) OVER (PARTITION BY session) AS now FROM {EVENTS}) SELECT session, kind, count(*) AS n FROM e WHERE ts <= now - {86_400 * SECOND} AND ts > now - {90 * 86_400 * SECOND} AND (session, kind) IN
  (SELECT (session, kind) FROM e WHERE ts > now - {86_400 * SECOND}) GROUP BY session, kind"""


def capability_drift(spark, sf_dir):
    from ..operators import diffs

    e = events(spark, sf_dir).withColumn("late", F.col("ts") > F.lit(1705276800000000))
    counts = e.groupBy("session", "kind", "late").agg(F.count("*").alias("n"))
    before, after = counts.where("not late").drop("late"), counts.where("late").drop("late")
    return diffs.capability_drift(before, after, ["session"], "kind", "n")


DRIFT_SQL = f"""WITH c AS (SELECT session, kind, ts > 1705276800000000 AS late, count(*) AS n FROM {EVENTS} GROUP BY ALL)
  SELECT coalesce(b.session, a.session) AS session, coalesce(b.kind, a.kind) AS kind, CASE WHEN b.n IS NULL THEN 'NEW' WHEN a.n IS NULL THEN 'REMOVED' WHEN a.n > b.n THEN 'INCREASED' WHEN a.n < b.n THEN 'DECREASED' ELSE 'SAME' END AS change, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
  FROM (SELECT * FROM c WHERE NOT late) b FULL JOIN (SELECT * FROM c WHERE late) a ON a.session = b.session AND a.kind = b.kind"""


def stage_order_deviation(spark, sf_dir):
    from ..operators import trends

    order = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
    return trends.order_deviations(events(spark, sf_dir), "session", ["ts", "seq"], "kind", order)


STAGE = case("kind", {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4})
STAGE_SQL = f"""SELECT session, count(*) FILTER (WHERE next < stage) AS deviations, count(*) AS n FROM (SELECT session, {STAGE} AS stage, lead({STAGE}) OVER (PARTITION BY session ORDER BY ts, seq) AS next FROM {EVENTS}) GROUP BY session"""


def latency_percentiles(spark, sf_dir):
    from ..operators import evaluate

    return evaluate.percentiles(events(spark, sf_dir), ["kind"], "bytes")


LATENCY_SQL = f"""WITH r AS (SELECT kind, bytes, row_number() OVER (PARTITION BY kind ORDER BY bytes) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM {EVENTS})
  SELECT kind, any_value(n) AS n, round(avg(bytes), 6) AS mean, round(stddev_pop(bytes), 6) AS std, max(bytes) FILTER (WHERE rn = ceil(0.5 * n)) AS p50, max(bytes) FILTER (WHERE rn = ceil(0.95 * n)) AS p95, max(bytes) FILTER (WHERE rn = ceil(0.99 * n)) AS p99,
  max(bytes) FILTER (WHERE rn = floor(0.95 * n) + 1) AS q95 FROM r GROUP BY kind"""


def bayesian_relations(spark, sf_dir):
    from ..operators import evaluate

    return evaluate.bayes(events(spark, sf_dir).select(F.col("kind").alias("relation"), (F.col("k") > 70).alias("bad")))


BAYES_SQL = f"""SELECT relation, n, round(prior, 6) AS prior, round(likelihood, 6) AS likelihood, round(likelihood * prior / (likelihood * prior + (1 - likelihood) * (1 - prior)), 6) AS posterior
  FROM (SELECT kind AS relation, count(*) AS n, 0.9::DOUBLE * (count(*) FILTER (WHERE k > 70) / count(*)::DOUBLE) + 0.05::DOUBLE AS likelihood, count(*) / (sum(count(*)) OVER ())::DOUBLE AS prior FROM {EVENTS} GROUP BY kind)"""


def props_json_extract(spark, sf_dir):
    parsed = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"), F.json_object_keys("props").alias("keys"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.array_join("keys", ",").alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_classify, process_intent_dim_join, evidence_severity_union, rhythm_cv_by_user, protocol_hopping, fragmented_traffic, distributed_chain, read_write_ratio, mass_read_window, anti_evasion_score,
        inference_cascade, risk_assessment, risk_confidence, session_dna, mitre_timeline, sessionize_gap, dedup_within_key, hash_chain_build, hash_chain_verify, asof_nearest, asof_tolerance, asof_edges, interval_join_top3,
        secret_flow_semi, observation_confidence, threshold_analysis, history_correlation_90d, capability_drift, stage_order_deviation, latency_percentiles, bayesian_relations, props_json_extract,
    )
}
ORACLE_SQL = {
    "flow_classify": FLOW_SQL,
    "process_intent_dim_join": f"SELECT session, CASE kind WHEN 'error' THEN 'execute' WHEN 'click' THEN 'interact' WHEN 'purchase' THEN 'transfer' WHEN 'view' THEN 'read' ELSE CASE WHEN host = 'host0' THEN 'network' ELSE 'unknown' END END AS intent, count(*) AS n FROM {EVENTS} GROUP BY ALL",
    "evidence_severity_union": f"SELECT seq, CASE WHEN kind = 'error' THEN 'process' ELSE 'flow' END AS source, CASE WHEN kind = 'error' THEN CASE WHEN k > 80 THEN 'warning' ELSE 'info' END WHEN bytes > 300000 THEN 'critical' WHEN bytes > 100000 OR host = 'host1' THEN 'warning' ELSE 'info' END AS severity FROM {EVENTS}",
    "rhythm_cv_by_user": f"SELECT session, n, round(m / 1000000, 3) AS avg_gap, round(CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE s / m END, 6) AS cv, coalesce(n >= 20 AND m >= 10000 AND CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE s / m END < 1.0, false) AS artificial FROM (SELECT session, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM (SELECT session, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS gap FROM {EVENTS}) GROUP BY session)",
    "protocol_hopping": f"SELECT session, count(*) AS windows, max(hops)::BIGINT AS hops FROM (SELECT session, span, count(*) AS n, coalesce(sum(change), 0) AS hops FROM (SELECT session, ts // {86_400 * SECOND} AS span, (kind <> lag(kind) OVER (PARTITION BY session ORDER BY ts, seq))::INT AS change FROM {EVENTS}) GROUP BY session, span) WHERE n >= 4 AND hops >= 2 GROUP BY session",
    "fragmented_traffic": f"SELECT session, host, n, round(b, 3) AS bytes, round(b / n, 3) AS avg_chunk, span_us FROM (SELECT session, host, count(*) AS n, sum(bytes) AS b, max(ts) - min(ts) AS span_us FROM {EVENTS} GROUP BY session, host) WHERE n >= 5 AND b >= 200000 AND (b / n < 45000 OR (span_us > {86_400 * SECOND} AND n > 10))",
    "distributed_chain": f"SELECT session, count(DISTINCT CASE WHEN bytes > 100000 THEN host END) AS hosts FROM {EVENTS} GROUP BY session HAVING hosts >= 3",
    "read_write_ratio": f"SELECT session, reads, writes, sensitive, CASE WHEN sensitive >= 4 THEN 0.8 WHEN sensitive >= 2 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM (SELECT session, count(*) FILTER (WHERE kind = 'view') AS reads, count(*) FILTER (WHERE kind = 'purchase') AS writes, count(*) FILTER (WHERE kind = 'view' AND k > 80) AS sensitive FROM {EVENTS} GROUP BY session) WHERE reads >= 10 AND reads / greatest(writes, 1)::DOUBLE > 1.0 AND (sensitive >= 2 OR reads >= 25)",
    "mass_read_window": f"SELECT session, (ts // {7 * 86_400 * SECOND}) * {7 * 86_400 * SECOND} AS start, count(*) AS n, count(DISTINCT host) AS hosts FROM {EVENTS} WHERE kind = 'view' GROUP BY ALL HAVING n >= 5 AND hosts >= 3",
    "anti_evasion_score": f"SELECT session, greatest(0, least(100, floor(sum(CASE type WHEN 'process_suspicious' THEN 4.0 WHEN 'ai_prompt_sent' THEN 2.0 WHEN 'code_upload' THEN 5.0 ELSE 0 END::DOUBLE * confidence) + 0.5)))::INT AS score FROM {ACTS} WHERE confidence > 0.9 GROUP BY session",
    "inference_cascade": CASCADE_SQL,
    "risk_assessment": RISK_SQL,
    "risk_confidence": SURE_SQL,
    "session_dna": DNA_SQL,
    "mitre_timeline": TIMELINE_SQL,
    "sessionize_gap": GAP_SQL,
    "dedup_within_key": f"SELECT session, kind, host, min(ts) AS ts, arg_min(seq, (ts, seq)) AS seq FROM {EVENTS} GROUP BY session, kind, host",
    "hash_chain_build": CHAIN_SQL + " SELECT session, seq, ts, kind, idx, previous_hash, hash FROM chain",
    "hash_chain_verify": VERIFY_SQL,
    "asof_nearest": asof_sql(None),
    "asof_tolerance": asof_sql(12 * 3600 * SECOND),
    "asof_edges": EDGE_SQL,
    "interval_join_top3": INTERVAL_SQL,
    "secret_flow_semi": f"SELECT session, seq, CASE WHEN k > 80 THEN 'CRITICAL' WHEN k > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM {EVENTS} a WHERE kind = 'signup' AND EXISTS (SELECT 1 FROM {EVENTS} b WHERE b.session = a.session AND b.kind = 'purchase' AND abs(a.ts - b.ts) <= {86_400 * SECOND})",
    "observation_confidence": OBSERVED_SQL,
    "threshold_analysis": f"SELECT session, count(*) AS n, count(DISTINCT kind) AS types, max(ts) AS last_ts, CASE WHEN count(DISTINCT CASE WHEN kind IN ('error', 'purchase', 'signup') THEN kind END) > 2 THEN 'ESCALATING' WHEN count(*) >= 60 THEN 'ELEVATED' ELSE 'MONITOR' END AS trend FROM {EVENTS} WHERE k > 50 GROUP BY session HAVING n >= 30",
    "history_correlation_90d": HISTORY_SQL,
    "capability_drift": DRIFT_SQL,
    "stage_order_deviation": STAGE_SQL,
    "latency_percentiles": LATENCY_SQL,
    "bayesian_relations": BAYES_SQL,
    "props_json_extract": "SELECT event_id, (props->>'$.k')::INT AS k, array_to_string(json_keys(props), ',') AS keys FROM events",
}
