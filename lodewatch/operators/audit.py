"""Packages: installed files to audit, what their findings let them do, verdicts and what to report of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import lookup, severity_rank

# The capability that a finding's type shows.
CAPABILITIES = {"NETWORK_ACTIVITY": "NETWORK", "OS_CAPABILITY": "PROCESS_EXEC", "ENV_ACCESS": "ENV_ACCESS", "UNSAFE_EVAL": "DYNAMIC_EXEC", "DOM_INJECTION": "DOM_MANIPULATION", "SANDBOX_ESCAPE": "PROCESS_EXEC"} | {
    f"SECRET_{x}": "CREDENTIAL_LEAK"
    for x in ("ENV_FILE", "CREDENTIALS_FILE", "SSH_KEY_FILE", "AWS_KEY_ID", "AWS_SECRET", "GITHUB_TOKEN", "STRIPE_KEY", "SENDGRID_KEY", "SSH_KEY", "SLACK_TOKEN", "JWT", "DB_PASSWORD", "ENCRYPTION_KEY", "API_KEY", "HARDCODED_PASSWORD", "HARDCODED_TOKEN")
}
# Scripts that a package manager runs by itself, and commands in them that are a risk.
HOOKS = ["preinstall", "install", "prepare", "prepublish", "prepublishOnly", "postinstall", "prepack", "postpack", "rebuild"]
HOOK_SHELL = r"curl|wget|\bbash\b|\bsh\s|powershell|\bcmd\s|iwr|invoke-webrequest"
HOOK_SCRIPT = r"node\s+[\w./'-]+\.(?:mjs|js|cjs|ts)"
# Signals that are reported of a finding: by subcode, else by type; in their own order.
SIGNALS = ["install_script", "network", "credential_access", "child_process", "runtime_execution", "obfuscation", "encoded_payload", "filesystem", "binary", "download", "config_tampering", "suspicious_url"]
TYPE_SIGNALS = {
    "UNSAFE_EVAL": ["runtime_execution"], "OS_CAPABILITY": ["child_process"], "NETWORK_ACTIVITY": ["network"], "ENV_ACCESS": ["credential_access"], "POTENTIAL_SECRET": ["encoded_payload"], "SANDBOX_ESCAPE": ["runtime_execution"],
    "DARKNET_ADDRESS": ["suspicious_url"], "GYP_COMMAND_SUBSTITUTION": ["runtime_execution"], "GYP_DOWNLOADER": ["download"], "LIFECYCLE_OBFUSCATED": ["install_script", "encoded_payload"], "OBFUSCATED_PAYLOAD": ["obfuscation"],
    "HIGH_ENTROPY": ["obfuscation"], "NODE_GYP_CAPABILITY": ["binary"], "TOKEN_RISK": ["credential_access"], "SECRET_SLACK_WEBHOOK": ["credential_access"],
} | {k: ["credential_access"] for k, v in CAPABILITIES.items() if v == "CREDENTIAL_LEAK"}
SUBCODE_SIGNALS = {"LIF-CURL-BASH": ["install_script", "download"], "LIF-SHELL": ["install_script"], "WF-004": ["config_tampering"], "WF-005": ["download"], "AS-002": ["filesystem"]}
PACKAGES, FILES_A_PACKAGE, DEEPEST = 120, 300, 3


def package_of(path: Column) -> Column:
    """The package of a file below node_modules; a scope is a part of the name."""
    return F.regexp_extract(path, r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)/", 1)


def installed(files: DataFrame, by: Sequence[str], path: str, packages: int = PACKAGES, per_package: int = FILES_A_PACKAGE) -> DataFrame:
    """The files of the first packages by name and the first files of each by path: a report of bounded size per project."""
    rows = files.withColumn("package", package_of(F.col(path))).where("package <> ''")
    nth = F.dense_rank().over(Window.partitionBy(*by).orderBy("package"))
    of = F.row_number().over(Window.partitionBy(*by, "package").orderBy(path))
    return rows.withColumns({"__p": nth, "__f": of}).where((F.col("__p") <= packages) & (F.col("__f") <= per_package)).drop("__p", "__f")


def dependency_tree(files: DataFrame, by: Sequence[str], path: str, deepest: int = DEEPEST) -> DataFrame:
    """by, package, depth, place: each package at its shallowest place (then the first by name), down to a depth."""
    manifests = files.where(F.col(path).rlike(r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json\z"))
    depth = F.size(F.split(path, "(?:^|/)node_modules/")) - 1
    name = F.regexp_extract(path, r".*(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)/package\.json\z", 1)
    rows = manifests.select(*by, name.alias("package"), depth.alias("depth"), F.col(path).alias("place")).where(F.col("depth") <= deepest)
    return rows.groupBy(*by, "package").agg(F.min(F.struct("depth", "place")).alias("m")).select(*by, "package", "m.depth", "m.place")


def capabilities(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, capability, risk: the highest risk of each; malice is critical, a critical accident is high."""
    risk = F.when(F.col("intent") == "MALICIOUS", "CRITICAL").when((F.col("intent") == "VULNERABILITY") & (F.col("severity") == "CRITICAL"), "HIGH").otherwise(F.col("severity"))
    rows = findings.withColumns({"capability": lookup(F.col("type"), CAPABILITIES, None), "risk": risk}).where("capability is not null")
    return rows.groupBy(*by, "capability").agg(F.max_by("risk", severity_rank(F.col("risk"))).alias("risk"))


def hook_risk(script: Column, command: Column) -> Column:
    """struct<dangerous, reason> of a script that a manifest names."""
    command = F.lower(command)
    out = lambda danger, why: F.struct(F.lit(danger).alias("dangerous"), F.lit(why).alias("reason"))
    return F.when(~script.isin(*HOOKS), out(False, "other script")).when(command.rlike(HOOK_SHELL), out(True, "downloads or shells out")).when(command.rlike(HOOK_SCRIPT), out(True, "runs a bundled script")).otherwise(out(False, "no pattern"))


def hooks(manifests: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """by, script, command, dangerous, reason from package manifests in JSON."""
    scripts = F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")
    return manifests.select(*by, F.explode(scripts).alias("script", "command")).withColumn("r", hook_risk(F.col("script"), F.col("command"))).select(*by, "script", "command", "r.*")


def package_verdict(findings: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, verdict: malicious with a critical finding or a CVSS from 9; suspicious with a high one, a secret, a look-alike name or any vulnerability.

    facts: by, cvss (the worst, null if none), vulnerabilities, lookalike.
    """
    worst = findings.groupBy(*by).agg(F.bool_or(F.col("severity") == "CRITICAL").alias("critical"), F.bool_or((F.col("severity") == "HIGH") | F.col("type").startswith("SECRET_")).alias("high"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = facts.join(worst, list(by), "left")
    verdict = F.when(flag(F.col("critical")) | flag(F.col("cvss") >= 9), "MALICIOUS").when(flag(F.col("high")) | F.col("lookalike") | (F.col("vulnerabilities") > 0), "SUSPICIOUS").otherwise("SAFE")
    return rows.select(*by, verdict.alias("verdict"))


def change_verdict(findings: DataFrame, correlations: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, verdict, weight of a change: critical blocks; high, or over two correlations, calls for a review."""
    worst = findings.groupBy(*by).agg(F.bool_or(F.col("severity") == "CRITICAL").alias("critical"), F.bool_or(F.col("severity") == "HIGH").alias("high"))
    many = correlations.groupBy(*by).agg(F.count("*").alias("n"))
    rows = worst.join(many, list(by), "left")
    verdict = F.when(F.col("critical"), "BLOCK").when(F.col("high") | (F.coalesce("n", F.lit(0)) > 2), "REVIEW").otherwise("PASS")
    return rows.select(*by, verdict.alias("verdict")).withColumn("weight", F.when(F.col("verdict") == "BLOCK", 1.0).when(F.col("verdict") == "REVIEW", 0.7).otherwise(0.3))


def signals(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, signals: what is reported of the findings, each once, in the fixed order."""
    listed = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.coalesce(listed(SUBCODE_SIGNALS)[F.col("subcode")], listed(TYPE_SIGNALS)[F.col("type")])
    seen = findings.select(*by, F.explode(found).alias("s")).groupBy(*by).agg(F.collect_set("s").alias("seen"))  # as many as there are signals
    order = F.array(*map(F.lit, SIGNALS))
    return seen.select(*by, F.array_join(F.filter(order, lambda s: F.array_contains("seen", s)), ",").alias("signals"))


def alerts(findings: DataFrame, by: Sequence[str], most: int = 100) -> DataFrame:
    """The most severe findings of each project, to be sent: a top-k report."""
    w = Window.partitionBy(*by).orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("risk_score"), "file", "line", "subcode", "rule_no")
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*by, "place", "file", "line", "subcode", F.lower("severity").alias("level"))


def baseline_changes(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, package, state: new, version_drift, code_drift (same version, other hash), removed or unchanged."""
    b = before.select(*by, "package", F.col("version").alias("v0"), F.col("hash").alias("h0"))
    a = after.select(*by, "package", F.col("version").alias("v1"), F.col("hash").alias("h1"))
    state = F.when(F.col("v0").isNull(), "new").when(F.col("v1").isNull(), "removed").when(F.col("v0") != F.col("v1"), "version_drift").when(F.col("h0") != F.col("h1"), "code_drift").otherwise("unchanged")
    return b.join(a, [*by, "package"], "full_outer").select(*by, "package", state.alias("state"))


def drift_verdict(drift: DataFrame, by: Sequence[str], dangerous: Sequence[str] = ("PROCESS_EXEC", "DYNAMIC_EXEC", "CREDENTIAL_LEAK")) -> DataFrame:
    """by, verdict from capability rows with state (NEW, INCREASED, ...) and the risk before and after.

    A new dangerous one is malicious, over two increased are suspicious; a rise of the summed risk by over 30 makes it a step worse.
    """
    rows = drift.groupBy(*by).agg(
        F.bool_or((F.col("state") == "NEW") & F.col("capability").isin(*dangerous)).alias("danger"), F.count_if(F.col("state") == "INCREASED").alias("more"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("rise")
    )
    step = F.when(F.col("danger"), 2).when(F.col("more") > 2, 1).otherwise(0) + F.when(F.col("rise") > 30, 1).otherwise(0)
    return rows.select(*by, F.get(F.array(*map(F.lit, ["SAFE", "SUSPICIOUS", "MALICIOUS"])), F.least(step, F.lit(2))).alias("verdict"))


def cache_state(age_seconds: Column, expires: int = 7 * 86_400) -> Column:
    return F.when(age_seconds >= expires, "EXPIRED").when(age_seconds < 3_600, "FRESH").when(age_seconds < 86_400, "RECENT").otherwise("STALE")


def threat_matches(changes: DataFrame, authors: DataFrame, hashes: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """id, by_author, by_hash, patterns: changes (id, author, hash, text) that known threats speak of.

    Authors and hashes meet by equality; the patterns are a short list of literals and are looked for
    in each text where it is.
    """
    a = authors.select("author").distinct().withColumn("by_author", F.lit(True))
    h = hashes.select("hash").distinct().withColumn("by_hash", F.lit(True))
    seen = F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col("text").contains(p), F.lit(p)) for p in patterns])), ",")
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = changes.join(a, "author", "left").join(h, "hash", "left").select("id", flag(F.col("by_author")).alias("by_author"), flag(F.col("by_hash")).alias("by_hash"), seen.alias("patterns"))
    return rows.where("by_author or by_hash or patterns <> ''")


def vault_stats(signals_: DataFrame) -> DataFrame:
    """signals, repos, authors, types of all stored signals."""
    return signals_.agg(F.count("*").alias("signals"), F.countDistinct("repo").alias("repos"), F.countDistinct("author").alias("authors"), F.countDistinct("type").alias("types"))


def most_frequent(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The values of a column that occur most; a top-k report, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)
