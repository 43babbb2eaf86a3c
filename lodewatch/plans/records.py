"""Build records, packages, datasets and replays bound to orders, part and the sample code files.

An order is a build record; its number picks tools, anomalies and counts so that every rule and branch
is reached. Projects of the sample files are packages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import audit, redteam, replay, scan
from .code import CODE, NODE_CTE, files
from .scan import quoted
from .tables import read
from .telemetry import lists, pick, picked

TOOLS = ["npm", "gcc", "make", "python", "curl", "tsc", "Cargo", "mystery", "yarn", "go"]
TEXTS = ["[HIGH] named pipe opened", "[MEDIUM] PATH priority changed", "[CRITICAL] injection", "LD_PRELOAD set", "[HIGH] syscall stub", "[MEDIUM] spawn of shell", "DoH host", "[HIGH] fileless memory", "ETW provider off", "tool hash differs", "data exfil", "plain"]
NAMES = ["gcc", "make", "node", "evil.exe", "python", "curl2", "npm", "ld"]
ATTACKS = [("pipe", ["DR-006", "DR-013"]), ("tool", ["DR-001", "DR-011", "DR-002"]), ("memory", ["DR-015", "DR-010", "DR-009", "DR-012", "DR-007"])]


def records(spark, sf_dir: str):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("build"), F.col("o_orderdate").alias("day"))
    b = F.col("build")
    cut = lambda values, start, n: F.slice(F.array(*map(F.lit, values)), (start % len(values) + 1).cast("int"), n.cast("int"))
    return o.select(
        "key", "build", "day", cut(TOOLS, b, b % 4).alias("tools"), cut(TEXTS, b * 5, b % 5 - F.when(b % 5 > 1, 1).otherwise(0)).alias("anomalies"), cut(NAMES, b * 3, b % 6).alias("process_names"),
        (b % 7).alias("network"), (b % 14).alias("dns"), (b % 53).alias("processes"), (b % 3).alias("modified"), (b % 4 - b % 2).alias("secrets"), F.when(b % 9 == 0, 2).otherwise(0).alias("violations"),
        (b % 2).alias("suspicious_hosts"), (b % 5).alias("hash_links"), (F.lit(1000) + b % 11 * 60).alias("duration"), F.when(b % 6 != 0, (b % 3).cast("string")).alias("inputs"),
        (b % 4).alias("input_modified"), (b % 3).alias("input_new"), (b % 2).alias("input_removed"),
        F.when(b % 8 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("gcc"), (b % 2).cast("string"), F.lit("ld"), F.lit("1"))).alias("tool_hashes"),
        F.create_map(F.lit("a.out"), (b % 3).cast("string"), F.lit("b.out"), F.lit("7")).alias("artifact_hashes"), (b % 13).alias("exfil"), (b % 100).alias("hermetic"), F.when(b % 10 == 0, 1).otherwise(0).alias("exit_code"),
    )


def cut_sql(values, start: str, n: str) -> str:
    return f"{lists(values)}[(({start}) % {len(values)} + 1)::INT:(({start}) % {len(values)} + ({n}))::INT]"


RECORDS = f"""(SELECT o_custkey AS key, b AS build, o_orderdate AS day, {cut_sql(TOOLS, 'b', 'b % 4')} AS tools, {cut_sql(TEXTS, 'b * 5', 'b % 5 - CASE WHEN b % 5 > 1 THEN 1 ELSE 0 END')} AS anomalies, {cut_sql(NAMES, 'b * 3', 'b % 6')} AS process_names,
  b % 7 AS network, b % 14 AS dns, b % 53 AS processes, b % 3 AS modified, b % 4 - b % 2 AS secrets, CASE WHEN b % 9 = 0 THEN 2 ELSE 0 END AS violations, b % 2 AS suspicious_hosts, b % 5 AS hash_links, 1000 + b % 11 * 60 AS duration, CASE WHEN b % 6 <> 0 THEN b % 3 END AS inputs,
  b % 4 AS input_modified, b % 3 AS input_new, b % 2 AS input_removed, b % 13 AS exfil, b % 100 AS hermetic, CASE WHEN b % 10 = 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT *, o_orderkey AS b FROM orders))"""
MENTION = lambda words: "len(list_filter(anomalies, lambda a: " + " OR ".join(f"contains(a, {quoted(w)})" for w in words) + ")) > 0"
TOOL = lambda names: f"len(list_filter(tools, lambda t: lower(t) IN ({', '.join(map(quoted, names))}))) > 0"
RULES = {
    "DR-001": f"len(list_filter(tools, lambda t: lower(t) NOT IN ({', '.join(map(quoted, redteam.KNOWN_TOOLS))}))) > 0",
    "DR-002": f"network > 0 AND NOT ({TOOL(redteam.NETWORK_TOOLS)})",
    "DR-003": f"secrets > 0 AND NOT ({TOOL(redteam.COMPILERS)})",
    "DR-004": "processes > 50 OR processes = 0",
    "DR-005": f"modified > 0 AND NOT ({TOOL(redteam.WRITERS)})",
    "DR-008": "violations > 0",
    **{rule: MENTION(words) for rule, words in redteam.WORDS.items()},
}
RULES["DR-014"] += " OR dns > 10"
FIRED = "(SELECT key, build, day, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in sorted(RULES.items())) + f"], lambda x: x IS NOT NULL)) AS rule FROM {RECORDS})"


def redteam_detections(spark, sf_dir):
    return redteam.fired(records(spark, sf_dir), "build")


def redteam_campaigns(spark, sf_dir):
    attacks = spark.createDataFrame(ATTACKS, "attack string, rules array<string>")
    return redteam.campaigns(records(spark, sf_dir), attacks, "key", ["day", "build"])


CAMPAIGN_SQL = f"""WITH w(attack, rule, of) AS (VALUES {', '.join(f"({quoted(a)}, {quoted(r)}, {len(rs)})" for a, rs in ATTACKS for r in rs)}),
  recent AS (SELECT key, build FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC, build DESC) AS r FROM {RECORDS}) WHERE r <= 10),
  hits AS (SELECT key, attack, count(*) AS hit FROM (SELECT DISTINCT f.key, f.rule FROM {FIRED} f JOIN recent USING (build)) JOIN w USING (rule) GROUP BY ALL)
  SELECT key, attack, rate, CASE WHEN rate >= 0.8 THEN 'detected' WHEN rate >= 0.3 THEN 'partial' ELSE 'missed' END AS state FROM (SELECT k.key, a.attack, round(coalesce(hit, 0) / a.of::DOUBLE, 6) AS rate FROM (SELECT DISTINCT key FROM recent) k, (SELECT DISTINCT attack, of FROM w) a LEFT JOIN hits h ON h.key = k.key AND h.attack = a.attack)"""


def build_auto_label(spark, sf_dir):
    r = records(spark, sf_dir)
    label = redteam.auto_label(F.col("anomalies"), F.when(F.col("exfil") == 12, 1).otherwise(0), F.col("hermetic"), F.col("violations"), F.col("exit_code"), F.col("secrets"))
    return r.select("build", label.alias("label"))


STARTS = lambda t: f"len(list_filter(anomalies, lambda a: starts_with(a, '{t}')))"
LABEL_SQL = f"""SELECT build, CASE WHEN len(list_filter(anomalies, lambda a: starts_with(a, '[CRITICAL]') OR contains(lower(a), 'exfil') OR contains(lower(a), 'injection'))) > 0 OR {STARTS('[HIGH]')} >= 3 OR exfil = 12 THEN 'malicious'
  WHEN {STARTS('[HIGH]')} > 0 OR {STARTS('[MEDIUM]')} >= 3 OR hermetic < 30 OR violations > 0 THEN 'anomalous' WHEN exit_code = 0 AND len(anomalies) = 0 AND secrets = 0 THEN 'normal' END AS label FROM {RECORDS}"""


def build_trust(spark, sf_dir):
    t = redteam.trust(records(spark, sf_dir), "key", ["day", "build"])
    return t.select("build", *redteam.TRUST, "trust", "purity", "deterministic")


TRUST_SQL = f"""WITH r AS (SELECT *, lag(build) OVER w AS p, lag(inputs) OVER w AS was_inputs, lag(duration) OVER w AS was_duration, row_number() OVER w = 1 AS first FROM {RECORDS} WINDOW w AS (PARTITION BY key ORDER BY day, build)),
  d AS (SELECT *, greatest(0, 100 - CASE WHEN build % 8 = 0 THEN 20 ELSE 0 END - CASE WHEN p IS NULL OR build % 8 = 0 OR p % 8 = 0 THEN 0 ELSE 15 * (build % 2 <> p % 2)::INT END)::INT AS toolchain_identity,
    CASE WHEN inputs IS NULL THEN 100 ELSE 100 - least(input_modified * 8 + (input_new + input_removed) * 5, 40) END::INT AS input_identity, (100 - CASE WHEN p IS NULL THEN 0 ELSE 10 * (build % 3 <> p % 3)::INT END)::INT AS artifact_integrity,
    (100 - least(len(anomalies) * 15, 45))::INT AS behavior, (100 - least(network * 5, 25) - CASE WHEN network > 0 AND suspicious_hosts > 0 THEN 25 ELSE 0 END)::INT AS network_, (100 - least(len(list_filter(process_names, lambda n: NOT regexp_matches(n, {quoted(redteam.PROCESS_NAMES)}))) * 5, 20))::INT AS graph,
    (80 + CASE WHEN hash_links > 0 THEN 10 ELSE 0 END + CASE WHEN first THEN 0 WHEN abs(duration - was_duration) / was_duration::DOUBLE * 100 < 10 THEN 10 WHEN abs(duration - was_duration) / was_duration::DOUBLE * 100 > 50 THEN -10 ELSE 0 END)::INT AS trend FROM r)
  SELECT build, toolchain_identity, input_identity, artifact_integrity, behavior, network_ AS network, graph, trend, floor(round(toolchain_identity * 0.18::DOUBLE + input_identity * 0.18::DOUBLE + artifact_integrity * 0.15::DOUBLE + behavior * 0.15::DOUBLE + network_ * 0.12::DOUBLE + graph * 0.12::DOUBLE + trend * 0.1::DOUBLE, 9) + 0.5)::INT AS trust,
    CASE WHEN len(tools) = 0 THEN 100 ELSE floor(len(list_filter(process_names, lambda n: list_contains(tools, n))) / len(tools)::DOUBLE * 100 + 0.5) END::INT AS purity, first OR inputs IS NULL OR was_inputs IS NULL OR inputs <> was_inputs OR build % 3 = p % 3 AS deterministic FROM d"""


def found(spark, sf_dir: str):
    return settle(scan.scan_files(files(spark, sf_dir), "path", "text", "project").withColumnRenamed("path", "file"))


def package_capabilities(spark, sf_dir):
    return audit.capabilities(found(spark, sf_dir), ["project"])


RANK = "CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
CAPABILITY_SQL = f"""SELECT project, capability, arg_max(risk, {RANK}) AS risk FROM (SELECT project, CASE type {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in audit.CAPABILITIES.items())} END AS capability,
  CASE WHEN intent = 'MALICIOUS' THEN 'CRITICAL' WHEN intent = 'VULNERABILITY' AND severity = 'CRITICAL' THEN 'HIGH' ELSE severity END AS risk FROM {CODE}) WHERE capability IS NOT NULL GROUP BY ALL"""


def facts(spark, sf_dir: str):
    return files(spark, sf_dir).select("project").distinct().select("project", F.when(F.col("project") % 5 == 0, F.col("project") % 4 + 6.5).alias("cvss"), (F.col("project") % 3).alias("vulnerabilities"), (F.col("project") % 7 == 0).alias("lookalike"))


def package_verdicts(spark, sf_dir):
    """Of each project only the findings of its script file count, so that all verdicts occur."""
    return audit.package_verdict(found(spark, sf_dir).where("file like '%main.py' and subcode not like 'WF%'"), facts(spark, sf_dir), ["project"])


VERDICT_SQL = f"""SELECT project, CASE WHEN coalesce(critical, false) OR coalesce(cvss >= 9, false) THEN 'MALICIOUS' WHEN coalesce(high, false) OR project % 7 = 0 OR project % 3 > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict
  FROM (SELECT project, CASE WHEN project % 5 = 0 THEN project % 4 + 6.5 END AS cvss FROM (SELECT DISTINCT doc_id // 8 AS project FROM documents)) LEFT JOIN (SELECT project, bool_or(severity = 'CRITICAL') AS critical, bool_or(severity = 'HIGH' OR type LIKE 'SECRET_%') AS high FROM {CODE} WHERE path LIKE '%main.py' AND subcode NOT LIKE 'WF%' GROUP BY project) USING (project)"""


def change_verdicts(spark, sf_dir):
    f = found(spark, sf_dir).where("risk_score > 0 and file like '%release.yaml'")
    return audit.change_verdict(f, scan.correlations(f, ["project"]), ["project"])


# In one file no category is in two files; what can correlate is one pair of subcodes or three categories.
CHANGE_SQL = f"""SELECT project, verdict, CASE verdict WHEN 'BLOCK' THEN 1.0 WHEN 'REVIEW' THEN 0.7 ELSE 0.3 END::DOUBLE AS weight FROM (SELECT project, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'BLOCK' WHEN bool_or(severity = 'HIGH') THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM {CODE} WHERE risk_score > 0 AND path LIKE '%release.yaml' GROUP BY project)"""


def contribution_signals(spark, sf_dir):
    return audit.signals(found(spark, sf_dir), ["project"])


SIGNAL_SQL = f"""SELECT project, array_to_string(list_filter({lists(audit.SIGNALS)}, lambda s: list_contains(seen, s)), ',') AS signals FROM (SELECT project, list(DISTINCT s) AS seen FROM (SELECT project, unnest(coalesce(CASE subcode {' '.join(f'WHEN {quoted(k)} THEN {lists(v)}' for k, v in audit.SUBCODE_SIGNALS.items())} END,
  CASE type {' '.join(f'WHEN {quoted(k)} THEN {lists(v)}' for k, v in audit.TYPE_SIGNALS.items())} END)) AS s FROM {CODE}) GROUP BY project)"""


def alert_cap(spark, sf_dir):
    return audit.alerts(found(spark, sf_dir), ["project"], 10)


ALERT_SQL = f"""SELECT project, place, file, line, subcode, lower(severity) AS level FROM (SELECT *, path AS file, row_number() OVER (PARTITION BY project ORDER BY {RANK.replace('risk', 'severity')} DESC, risk_score DESC, path, line, subcode, rule_no)::INT AS place FROM {CODE}) WHERE place <= 10"""
MANIFESTS = ['{"scripts": {"postinstall": "curl x | bash", "build": "tsc"}}', '{"scripts": {"prepare": "node scripts/run.js", "install": "make"}}', '{"scripts": {"preinstall": "cmd /c a", "test": "sh run"}}', '{"name": "x"}', "not json"]


def lifecycle_hooks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", pick(MANIFESTS, F.col("doc_id")).alias("text"))
    return audit.hooks(docs, ["doc_id"], "text")


HOOK_ROWS = [(i, "postinstall", "curl x | bash", True, "downloads or shells out") for i in (0,)] + [(0, "build", "tsc", False, "other script"), (1, "prepare", "node scripts/run.js", True, "runs a bundled script"), (1, "install", "make", False, "no pattern"), (2, "preinstall", "cmd /c a", True, "downloads or shells out"), (2, "test", "sh run", False, "other script")]
HOOK_SQL = f"SELECT doc_id, script, command, dangerous, reason FROM documents JOIN (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)}, {c}, {quoted(d)})' for i, a, b, c, d in HOOK_ROWS)}) h(i, script, command, dangerous, reason) ON i = doc_id % 5"


def installed_files(spark, sf_dir: str):
    """A file a document: a project of a hundred, a package by number, sometimes in a scope or below another."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id")
    name = F.concat(F.when(n % 3 == 0, "@s/").otherwise(""), F.lit("pkg"), n % 17)
    nested = F.when(n % 4 == 0, F.concat(F.lit("node_modules/base/node_modules/"), name)).when(n % 4 == 1, F.concat(F.lit("node_modules/"), name)).when(n % 4 == 2, F.concat(F.lit("node_modules/a/node_modules/b/node_modules/c/node_modules/"), name)).otherwise("src")
    return d.select(F.floor(n / 100).alias("project"), F.concat(nested, F.when(n % 5 < 3, "/package.json").otherwise(F.concat(F.lit("/f"), n, F.lit(".js")))).alias("path"))


INSTALLED = """(SELECT doc_id // 100 AS project, CASE doc_id % 4 WHEN 0 THEN 'node_modules/base/node_modules/' || n WHEN 1 THEN 'node_modules/' || n WHEN 2 THEN 'node_modules/a/node_modules/b/node_modules/c/node_modules/' || n ELSE 'src' END || CASE WHEN doc_id % 5 < 3 THEN '/package.json' ELSE '/f' || doc_id || '.js' END AS path
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '@s/' ELSE '' END || 'pkg' || (doc_id % 17) AS n FROM documents))"""


def installed_packages(spark, sf_dir):
    return audit.installed(installed_files(spark, sf_dir), ["project"], "path", 5, 2)


def dependency_tree(spark, sf_dir):
    return audit.dependency_tree(installed_files(spark, sf_dir), ["project"], "path")


PACKAGE = r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)/"
INSTALL_SQL = f"""SELECT project, path, package FROM (SELECT *, dense_rank() OVER (PARTITION BY project ORDER BY package) AS p, row_number() OVER (PARTITION BY project, package ORDER BY path) AS f FROM (SELECT *, regexp_extract(path, '{PACKAGE}', 1) AS package FROM {INSTALLED}) WHERE package <> '') WHERE p <= 5 AND f <= 2"""
TREE_SQL = f"""SELECT project, package, m.depth AS depth, m.place AS place FROM (SELECT project, package, min({{'depth': depth, 'place': path}}) AS m FROM (SELECT project, path, regexp_extract(path, '.*(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)/package\\.json$', 1) AS package, (len(string_split_regex(path, '(?:^|/)node_modules/')) - 1)::INT AS depth FROM {INSTALLED} WHERE path LIKE '%node_modules/%/package.json') WHERE depth <= 3 GROUP BY ALL)"""


def package_baseline_changes(spark, sf_dir):
    """Parts of even and odd number are a project's packages before and after."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("project"), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 40)).alias("package"), (F.col("p_size") % 3).alias("version"), F.col("p_brand").alias("hash"), (F.floor(F.col("p_partkey") / 10) % 4).alias("side"))
    one = lambda side: p.where(F.col("side") == side).drop("side")
    return audit.baseline_changes(one(0), one(1), ["project"])


CHANGES_SQL = """WITH p AS (SELECT p_partkey % 10 AS project, 'p' || (p_partkey // 40) AS package, p_size % 3 AS version, p_brand AS hash, p_partkey // 10 % 4 AS side FROM part), b AS (SELECT * FROM p WHERE side = 0), a AS (SELECT * FROM p WHERE side = 1)
  SELECT coalesce(b.project, a.project) AS project, coalesce(b.package, a.package) AS package, CASE WHEN b.project IS NULL THEN 'new' WHEN a.project IS NULL THEN 'removed' WHEN b.version <> a.version THEN 'version_drift' WHEN b.hash <> a.hash THEN 'code_drift' ELSE 'unchanged' END AS state FROM b FULL JOIN a ON a.project = b.project AND a.package = b.package"""


def capability_drift_verdict(spark, sf_dir):
    """States and risks of a part's capabilities by its number."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("project"), pick(sorted(set(audit.CAPABILITIES.values())), F.floor(F.col("p_partkey") / 500) + F.col("p_size")).alias("capability"), pick(["NEW", "INCREASED", "INCREASED", "DECREASED", "REMOVED"], F.col("p_size") * 3 + F.col("p_partkey")).alias("state"), (F.col("p_size") % 20).alias("before"), (F.col("p_size") % 31).alias("after"))
    return audit.drift_verdict(p, ["project"])


CAPS = sorted(set(audit.CAPABILITIES.values()))
DRIFT_SQL = f"""SELECT project, ['SAFE', 'SUSPICIOUS', 'MALICIOUS'][least(CASE WHEN danger THEN 2 WHEN more > 2 THEN 1 ELSE 0 END + CASE WHEN rise > 30 THEN 1 ELSE 0 END, 2) + 1] AS verdict FROM (SELECT project, bool_or(state = 'NEW' AND capability IN ('PROCESS_EXEC', 'DYNAMIC_EXEC', 'CREDENTIAL_LEAK')) AS danger, count(*) FILTER (WHERE state = 'INCREASED') AS more, sum(a - b) AS rise
  FROM (SELECT p_partkey % 500 AS project, {picked(CAPS, 'p_partkey // 500 + p_size')} AS capability, {picked(["NEW", "INCREASED", "INCREASED", "DECREASED", "REMOVED"], 'p_size * 3 + p_partkey')} AS state, p_size % 20 AS b, p_size % 31 AS a FROM part) GROUP BY project)"""


def trust_cache(spark, sf_dir):
    """An entry a part, as old as its price says."""
    return read(spark, sf_dir, "part").groupBy(audit.cache_state(F.floor(F.col("p_retailprice") * F.col("p_size") * 13).cast("long")).alias("state")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


CACHE_SQL = "SELECT CASE WHEN age >= 604800 THEN 'EXPIRED' WHEN age < 3600 THEN 'FRESH' WHEN age < 86400 THEN 'RECENT' ELSE 'STALE' END AS state, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, floor(p_retailprice * p_size * 13)::BIGINT AS age FROM part) GROUP BY 1"
TYPES = ["code_upload", "git_history_read", "secrets_scanned", "process_suspicious"]
LEVELS = ["LOW", "HIGH", "MEDIUM", "CRITICAL"]


def replayed(spark, sf_dir: str, shift: int):
    """session, score, level, types of a replay; `shift` makes another run of it."""
    n = F.col("o_orderkey") * 3 + shift * (F.col("o_orderkey") % 5)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session"), (n % 90).alias("score"), pick(LEVELS, n).alias("level"), F.slice(F.array(*map(F.lit, TYPES)), (n % 4 + 1).cast("int"), (n % 3).cast("int")).alias("types"))


def replayed_sql(shift: int) -> str:
    return f"(SELECT o_orderkey::VARCHAR AS session, n % 90 AS score, {picked(LEVELS, 'n')} AS level, {cut_sql(TYPES, 'n', 'n % 3')} AS types FROM (SELECT o_orderkey, o_orderkey * 3 + {shift} * (o_orderkey % 5) AS n FROM orders))"


def replay_compare(spark, sf_dir):
    return replay.compared(replayed(spark, sf_dir, 0).where("session % 3 <> 0"), replayed(spark, sf_dir, 1))


COMPARE_SQL = f"""SELECT session, a.score - b.score AS score_diff, a.level <> b.level AS level_changed, array_to_string(list_sort(list_filter(a.types, lambda x: NOT list_contains(b.types, x))), ',') AS added, array_to_string(list_sort(list_filter(b.types, lambda x: NOT list_contains(a.types, x))), ',') AS removed
  FROM {replayed_sql(1)} a JOIN {replayed_sql(0)} b USING (session) WHERE session::BIGINT % 3 <> 0"""


def replay_truth(spark, sf_dir):
    """A list of levels for some sessions, side-cars for others under an alias."""
    r = replayed(spark, sf_dir, 0)
    listed = r.where("session % 2 = 0").select("session", F.when(F.col("score") > 40, "HIGH").otherwise("LOW").alias("level"))
    own = r.where("session % 5 = 0").select(F.concat(F.lit("session-"), "session").alias("session"), F.lit("CRITICAL").alias("level"))
    return replay.against_truth(r.select("session", "level"), replay.truth_levels(listed, own))


TRUTH_SQL = f"""SELECT count(*) FILTER (WHERE g AND w) AS tp, count(*) FILTER (WHERE g AND NOT w) AS fp, count(*) FILTER (WHERE NOT g AND NOT w) AS tn, count(*) FILTER (WHERE NOT g AND w) AS fn FROM (SELECT level <> 'LOW' AS g, CASE WHEN session::BIGINT % 5 = 0 THEN true WHEN session::BIGINT % 2 = 0 THEN score > 40 ELSE false END AS w FROM {replayed_sql(0)})"""


def datasets(spark, sf_dir: str):
    return replayed(spark, sf_dir, 0).select(F.col("session").alias("id"), F.col("types").alias("expected"), pick(["CLEAN", "REVIEW", "BLOCK"], F.col("session").cast("long")).alias("expected_verdict"), F.when(F.col("session") % 4 != 0, F.col("score")).alias("expected_score"), pick(["low", "high", "critical"], F.col("score")).alias("severity"), F.when(F.col("session") % 3 != 0, pick(["spring", "summer"], F.col("score"))).alias("campaign"))


def replay_results(spark, sf_dir: str):
    return replayed(spark, sf_dir, 2).select(F.col("session").alias("id"), F.col("types").alias("found"), "score", pick(["CLEAN", "REVIEW", "BLOCK"], F.col("score")).alias("verdict"))


def replay_scores(spark, sf_dir):
    return replay.scored(datasets(spark, sf_dir), replay_results(spark, sf_dir))


SCORED = f"""(SELECT id, severity, campaign, verdict = expected_verdict AS match, CASE WHEN expected_score IS NULL THEN 0 ELSE score - expected_score END AS delta, missing, extra, round(CASE WHEN ne > 0 THEN (ne - missing) / ne::DOUBLE WHEN nf = 0 THEN 1.0 ELSE 0.0 END, 6) AS rate, extra > 0 AND ne = 0 AS false_alarm FROM (SELECT d.session AS id, {picked(["low", "high", "critical"], 'd.score')} AS severity,
  CASE WHEN session::BIGINT % 3 <> 0 THEN {picked(["spring", "summer"], 'd.score')} END AS campaign, {picked(["CLEAN", "REVIEW", "BLOCK"], 'r.score')} AS verdict, {picked(["CLEAN", "REVIEW", "BLOCK"], 'session::BIGINT')} AS expected_verdict, r.score AS score, CASE WHEN session::BIGINT % 4 <> 0 THEN d.score END AS expected_score,
  len(list_filter(d.types, lambda x: NOT list_contains(r.types, x)))::INT AS missing, len(list_filter(r.types, lambda x: NOT list_contains(d.types, x)))::INT AS extra, len(d.types)::INT AS ne, len(r.types)::INT AS nf FROM {replayed_sql(0)} d JOIN {replayed_sql(2)} r USING (session)))"""


def replay_report(spark, sf_dir):
    return replay.report(replay.scored(datasets(spark, sf_dir), replay_results(spark, sf_dir)))


REPORT_SQL = f"SELECT 'severity' AS kind, severity AS name, count(*) AS total, count(*) FILTER (WHERE match) AS detected FROM {SCORED} GROUP BY severity UNION ALL SELECT 'campaign', campaign, count(*), count(*) FILTER (WHERE match) FROM {SCORED} WHERE campaign IS NOT NULL GROUP BY campaign"


def technique_coverage(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("technique"), F.col("p_brand").alias("tactic"))
    covered = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("technique"), F.when(F.col("p_size") > 40, "covered").otherwise("partial").alias("state"))
    return replay.coverage(t, covered).groupBy("tactic", "state").agg(F.count("*").alias("n"))


PROFILES = [("p0", ["git"]), ("p1", ["curl", "git"]), ("p2", ["rare"]), ("p3", []), ("p4", ["git"])]


def corpus_profiles(spark, sf_dir):
    profiles = spark.createDataFrame(PROFILES, "profile string, requires array<string>")
    sessions = read(spark, sf_dir, "orders").where("o_orderkey % 7 < 2").select(F.concat(F.lit("p"), (F.col("o_orderkey") % 7) * 3).alias("profile"))
    return replay.corpus_coverage(profiles, sessions, ["git", "curl"])


def regression_suite(spark, sf_dir):
    tests = replayed(spark, sf_dir, 0).select(F.col("level").alias("expected"), F.when(F.col("session") % 11 != 0, pick(LEVELS, F.col("session").cast("long") * 3 + F.when(F.col("session") % 9 == 0, 1).otherwise(0))).alias("actual"))
    return replay.suite(tests)


SUITE_SQL = f"""SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM (SELECT CASE WHEN session::BIGINT % 11 = 0 THEN 'skipped' WHEN level = {picked(LEVELS, 'session::BIGINT * 3 + CASE WHEN session::BIGINT % 9 = 0 THEN 1 ELSE 0 END')} THEN 'passed' ELSE 'failed' END AS status FROM {replayed_sql(0)}) GROUP BY status"""


def feedback_retrain(spark, sf_dir):
    rows = replayed(spark, sf_dir, 0).select(F.col("session").cast("long").alias("n"), F.col("level").alias("predicted"), F.when((F.col("session") % 6 == 0) | (F.col("session") > 59_000), "LOW").otherwise(F.col("level")).alias("actual"))
    return replay.feedback(rows, ["n"])


FEEDBACK_SQL = f"""WITH f AS (SELECT session::BIGINT AS n, (level = CASE WHEN session::BIGINT % 6 = 0 OR session::BIGINT > 59000 THEN 'LOW' ELSE level END)::INT AS hit FROM {replayed_sql(0)}), r AS (SELECT count(*) AS recent, round(avg(hit), 6) AS recent_accuracy FROM (SELECT * FROM f ORDER BY n DESC LIMIT 20))
  SELECT accuracy, recent, recent_accuracy, recent >= 10 AND accuracy - recent_accuracy > 0.1 AS retrain FROM (SELECT round(avg(hit), 6) AS accuracy FROM f), r"""


def expectation_gaps(spark, sf_dir):
    expected = replayed(spark, sf_dir, 3).where("session % 4 = 0").select("session", F.col("types").alias("expected"))
    return replay.expectation_gap(replayed(spark, sf_dir, 0).where("session % 3 <> 0").select("session", "types"), expected)


GAP_SQL = f"""SELECT session, array_to_string(list_sort(list_filter(e.types, lambda x: NOT list_contains(t, x))), ',') AS missing, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(e.types, x))), ',') AS unexpected FROM (SELECT e.session, e.types, coalesce(r.types, []) AS t FROM {replayed_sql(3)} e LEFT JOIN (SELECT * FROM {replayed_sql(0)} WHERE session::BIGINT % 3 <> 0) r USING (session) WHERE e.session::BIGINT % 4 = 0) e"""


def driver_lookup(spark, sf_dir):
    """Findings beside the contribution of their subcode's card: none gives 0."""
    from ..operators import chains

    f = found(spark, sf_dir).where("risk_score > 0")
    return chains.with_contribution(f, scan.evidence_cards(f, ["project"]), ["project"]).select("project", "file", "line", "subcode", "contribution")


QUERIES = {
    f.__name__: f
    for f in (
        redteam_detections, redteam_campaigns, build_auto_label, build_trust, package_capabilities, package_verdicts, change_verdicts, contribution_signals, alert_cap, lifecycle_hooks, installed_packages, dependency_tree,
        package_baseline_changes, capability_drift_verdict, trust_cache, replay_compare, replay_truth, replay_scores, replay_report, technique_coverage, corpus_profiles, regression_suite, feedback_retrain, expectation_gaps, driver_lookup,
    )
}
ORACLE_SQL = {
    "redteam_detections": f"SELECT build, rule FROM {FIRED}",
    "redteam_campaigns": CAMPAIGN_SQL,
    "build_auto_label": LABEL_SQL,
    "build_trust": TRUST_SQL,
    "package_capabilities": CAPABILITY_SQL,
    "package_verdicts": VERDICT_SQL,
    "change_verdicts": CHANGE_SQL,
    "contribution_signals": SIGNAL_SQL,
    "alert_cap": ALERT_SQL,
    "lifecycle_hooks": HOOK_SQL,
    "installed_packages": INSTALL_SQL,
    "dependency_tree": TREE_SQL,
    "package_baseline_changes": CHANGES_SQL,
    "capability_drift_verdict": DRIFT_SQL,
    "trust_cache": CACHE_SQL,
    "replay_compare": COMPARE_SQL,
    "replay_truth": TRUTH_SQL,
    "replay_scores": f"SELECT * FROM {SCORED}",
    "replay_report": REPORT_SQL,
    "technique_coverage": "SELECT p_brand AS tactic, CASE WHEN p_size > 40 THEN 'covered' WHEN p_size > 25 THEN 'partial' ELSE 'not_covered' END AS state, count(*) AS n FROM part GROUP BY ALL",
    "corpus_profiles": "SELECT * FROM (VALUES ('p0', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0), false), ('p1', 0, false), ('p2', 0, true), ('p3', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 1), false), ('p4', 0, false)) v(profile, n, lacks)",
    "regression_suite": SUITE_SQL,
    "feedback_retrain": FEEDBACK_SQL,
    "expectation_gaps": GAP_SQL,
    "driver_lookup": f"WITH {NODE_CTE} SELECT project, file, line, subcode, contribution FROM nodes",
}
ORACLE_SQL["corpus_profiles"] = f"SELECT profile, CASE WHEN n > 0 THEN 'captured' WHEN lacks THEN 'unavailable' ELSE 'missing' END AS state, n::BIGINT AS n FROM ({ORACLE_SQL['corpus_profiles']})"
