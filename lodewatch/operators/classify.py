"""What single events show: processes, files, git commands, canaries, connections, memory maps and lifetimes.

Every classifier is a column of the event's own fields, so it runs on tables and on streams alike.
Words and phrases are literals in generated code; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from .scan import lookup

#: The names by which a command may speak of the monitor itself.
MONITOR = "lodewatch"
# Process names of coding agents, tested as words.
AGENTS = [
    "grok", "grok-build", "cursor", "copilot", "claude", "codex", "gemini", "github-copilot", "copilot-agent", "claude-code", "tabby", "tabnine", "supermaven", "codeium", "windsurf", "aider",
    "open-interpreter", "swe-agent", "devin", "factory", "poolside", "mutable", "replit-agent",
]
# Git commands that copy a repository, with what each shows; a later one overrides.
SENSITIVE_GIT = [
    ("git bundle create", "git_bundle_created"), ("git archive", "git_archive_created"), ("git rev-list --all", "repo_indexed"), ("git pack-objects", "repo_indexed"),
    ("git clone --mirror", "repo_indexed"), ("git clone --bare", "repo_indexed"),
]
# Commands that look around first, git's and the system's, in the order of the test.
PREPARATION = [
    "git cat-file", "git rev-list", "git ls-tree", "git count-objects", "git show-ref", "git for-each-ref", "git diff --cached", "git stash list", "git stash", "git bundle list-heads",
    "whoami", "ipconfig", "netstat", "hostname", "arp", "route", "systeminfo", "nslookup",
]
# Names and phrases that look for monitors and debuggers; one word must be a whole token.
MONITOR_WORDS = ["procexp", "wireshark", "tcpview", "processmonitor", MONITOR, "debugger", "isdebuggerpresent", "checkremotedebugger", "vmwaretools", "virtualbox", "vboxservice", "isvm"]
MONITOR_PHRASES = ["process monitor", "get-process -name", "tasklist | find", "ps aux | grep"]
# Parts of a path that tell of secrets.
SECRET_PARTS = [".env", "secrets", "credentials", "api_key", "private_key", ".pem", ".p12", ".pfx", "password", "passwd", "token", "auth_key", ".ssh", "id_rsa", "id_ed25519", ".npmrc", ".netrc"]
# Paths of prompts.
PROMPT_PATHS = ["/v1/chat/completions", "/v1/messages", "/v1/complete", "/v1/completions", "/api/generate", "/api/chat", "/v1/responses", "/chat/completions"]
# What a git action shows; push only with a flag that takes everything along.
GIT_ACTIONS = {
    "bundle": "git_bundle_created", "archive": "git_archive_created", "rev-list": "git_history_read", "log": "git_history_read", "cat-file": "git_objects_read", "ls-tree": "git_objects_read",
    "show-ref": "git_objects_read", "for-each-ref": "git_objects_read",
}
PUSH_FLAGS = ["--mirror", "--all", "--force"]
# What a canary's event shows.
CANARY_EVENTS = {"decoy_file_read": "canary_read", "decoy_file_modified": "canary_modified", "fake_secret_read": "fake_secret_read", "contaminated_git_read": "contaminated_git_read", "decoy_exfiltrated": "canary_exfiltrated"}
SECRET_NAMES = ["key", "secret", "credential", "token", "aws"]
# Risk indicators of a process: the first agent, and every command.
INDICATOR_AGENTS = ["grok", "cursor", "copilot", "claude", "codex", "gemini", "continue", "tabby", "tabnine", "codeium", "windsurf", "aider"]
INDICATOR_COMMANDS = [
    "git bundle", "git archive", "git rev-list --all", "git pack-objects", "git clone --mirror", "git clone --bare", "curl", "wget", "gcloud storage", "gsutil", "aws s3", "nslookup", "whoami", "ipconfig",
    "netstat", "hostname", "arp", "route", "systeminfo",
]
# Signals that are evasion whatever their score.
EVASION_SIGNALS = ["artificial_rhythm", "fragmented_traffic", "protocol_hopping", "custom_compression", "memory_only_ops", "distributed_chain", "no_temp_files"]
# Hosts that answer name queries over HTTPS.
DOH_HOSTS = [
    "dns.cloudflare.com", "cloudflare-dns.com", "dns.google", "dns.google.com", "dns.quad9.net", "dns9.quad9.net", "dns.opendns.com", "dns.family.opendns.com", "dns.mullvad.net", "dns.adguard.com",
    "dns.adguard-dns.com", "doh.cleanbrowsing.org", "doh.dns.sb", "dns.nextdns.io", "doh.crypto.sx", "odvr.nic.cz",
]
TEMP_PARTS = ["/tmp/", "\\temp\\", "/temp/", "\\tmp\\", "c:\\windows\\temp", "/var/tmp/"]
CHAIN_AGENTS = ["cursor", "copilot", "claude", "codex", "gemini", "grok", "windsurf", "aider"]
CHAIN_TOOLS = ["curl", "wget", "python", "node", "git", "powershell", "bash"]
PHASE_COMMANDS = ["git cat-file", "git rev-list", "git ls-tree", "git pack-objects", "git count-objects", "git diff --cached", "git stash", "git bundle list-heads"]
WATCHED_PORTS = [443, 80, 8443, 8080, 3000, 5000]

AGENT_WORDS = r"(?i)\b(?:" + "|".join(sorted(AGENTS)) + r")\b"
KILLS = ["taskkill", "stop-process", "wmic process"]
UPLOAD_FLAGS = r"--data-binary|-(?:d|f|t)\b|--data(?:-raw)?\b|--upload-file\b"
TUNNEL = r"nslookup\s+.*\.(?:attacker|exfil|tunnel)"
TOKEN_BREAKS = r"[\s,;|&\"'()=/\\]+"


def any_of(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def first_of(text: Column, parts: Sequence[str]) -> Column:
    """The first of the parts that the text contains, else null."""
    return F.coalesce(*[F.when(text.contains(p), F.lit(p)) for p in parts])


def process_behavior(name: Column, command: Column) -> Column:
    """What a process shows, or null; a later test overrides an earlier one, and the monitor and its host's services are skipped."""
    name, command = F.lower(name), F.lower(command)
    agent = name.rlike(AGENT_WORDS) | command.rlike(AGENT_WORDS)
    kill = any_of(command, KILLS) & command.contains(MONITOR)
    words = F.arrays_overlap(F.split(command, TOKEN_BREAKS), F.array(*map(F.lit, MONITOR_WORDS)))
    aware = any_of(name, MONITOR_WORDS + MONITOR_PHRASES) | any_of(command, MONITOR_PHRASES) | words
    shown = F.when(agent, "process_suspicious").when(kill, "monitor_disabled").when(aware, "monitor_awareness_detected")
    for phrase, behavior in SENSITIVE_GIT:
        shown = F.when(command.contains(phrase), behavior).otherwise(shown)
    shown = F.when(command.contains("curl") & command.rlike(UPLOAD_FLAGS), "code_upload").otherwise(shown)
    tunnel = command.contains("nslookup") & (command.contains("-type=txt") | command.contains("-t=txt") | command.rlike(TUNNEL))
    shown = F.when(tunnel, "dns_suspicious").otherwise(shown)
    packed = command.contains("tar") & command.contains(".git") & any_of(command, ["-czf", "-zcf", "--create"])
    shown = F.when(packed, "git_archive_created").otherwise(shown)
    own = name.contains("node.exe") & command.contains("dist/cli/main.js")
    system = name.contains("mscopilot") | command.contains("\\microsoft\\copilot\\")
    return F.when(~(own | system), shown)


def process_confidence(behavior: Column) -> Column:
    return F.when(behavior == "monitor_awareness_detected", 0.85).when(behavior == "monitor_disabled", 0.9).when(behavior.isNotNull(), 0.8)


def preparation(command: Column) -> Column:
    """The first preparing command in the line, else null; its behaviour is preparation_detected with 0.8."""
    return first_of(F.lower(command), PREPARATION)


def file_behavior(path: Column) -> Column:
    """What a file access shows: bundle over git metadata over git objects; secrets only where it is none of these."""
    path = F.lower(path)
    git = path.contains(".git")
    found = F.when(path.endswith(".bundle") | path.endswith(".gitbundle"), "git_bundle_created")
    found = found.when(git & any_of(path, ["logs", "index", "config", "head"]), "git_history_read").when(git & path.contains("objects"), "git_objects_read")
    return found.when(any_of(path, SECRET_PARTS), "secrets_scanned")


def git_behavior(action: Column, command: Column) -> Column:
    everything = (action == "push") & any_of(F.lower(command), PUSH_FLAGS)
    return F.when(everything, "full_repo_snapshot").otherwise(lookup(action, GIT_ACTIONS, None))


def canary_behavior(event: Column) -> Column:
    return lookup(event, CANARY_EVENTS, None)


def canary_event(name: Column, operation: Column) -> Column:
    """The kind of event on a canary file of this name: secret-like names first."""
    secret = (name == ".secrets.env") | any_of(F.lower(name), SECRET_NAMES)
    return F.when(secret, "fake_secret_read").when(name == ".git_canary_commit", "contaminated_git_read").when(operation == "read", "decoy_file_read").otherwise("decoy_file_modified")


def canary_hits(accesses: DataFrame, canaries: DataFrame, path: str = "path", operation: str = "operation") -> DataFrame:
    """Accesses of a canary (name, place) by full path or base name; of several, the first by its order `no`.

    canaries is the short list that was laid out. It meets the accesses on two equal keys.
    """
    keyed = accesses.withColumns({"__path": F.lower(path), "__base": F.lower(basename(F.col(path)))}).withColumn("__row", F.monotonically_increasing_id())
    laid = canaries.select("no", "name", F.lower("place").alias("__path"), F.lower(basename(F.col("place"))).alias("__base"))
    by_path = keyed.join(laid.drop("__base"), "__path").select("__row", "no", "name")
    by_base = keyed.join(laid.drop("__path").where("__base <> ''"), "__base").select("__row", "no", "name")
    first = by_path.unionByName(by_base).groupBy("__row").agg(F.min_by("name", "no").alias("canary"))
    return keyed.join(first, "__row").drop("__row", "__path", "__base").withColumn("event", canary_event(F.col("canary"), F.col(operation)))


def risk_indicators(name: Column, command: Column) -> Column:
    """array<string>: `agent` once if one is named, and every dangerous command."""
    name, command = F.lower(name), F.lower(command)
    agent = any_of(name, INDICATOR_AGENTS) | any_of(command, INDICATOR_AGENTS)
    hits = F.array_compact(F.array(F.when(agent, F.lit("agent")), *[F.when(command.contains(c), F.lit(c)) for c in INDICATOR_COMMANDS]))
    return F.when(command.contains("\\microsoft\\copilot\\"), F.array().cast("array<string>")).otherwise(hits)


def signal_behavior(kind: Column, score: Column) -> Column:
    return (
        F.when(kind == "process_chain", "process_chain_detected")
        .when(kind == "monitor_awareness", "monitor_awareness_detected")
        .when(kind.isin(EVASION_SIGNALS) | (score >= 30), "anti_evasion_detected")
        .otherwise("process_suspicious")
    )


def flow_factors(sent: Column, received: Column, host: Column) -> Column:
    """array<struct<name, contribution>>: what a flow adds to the risk."""
    factor = lambda name, n: F.struct(F.lit(name).alias("name"), F.lit(n).alias("contribution"))
    return F.array_compact(
        F.array(
            F.when(sent > 10 * 2**20, factor("large_upload", 30)).when(sent > 2**20, factor("medium_upload", 15)),
            F.when(sent + received > 100 * 2**20, factor("high_volume_session", 20)),
            F.when(host.contains("storage.") | host.contains("bucket"), factor("storage_host", 15)),
        )
    )


def fileless(name: Column, command: Column) -> Column:
    command = F.coalesce(command, F.lit(""))
    return command.rlike(r"/dev/fd/\d+|pipe:\[\d+\]|socket:\[\d+\]") | (command.startswith("-") & (F.length(command) > 3)) | ((name == "sh") & command.contains("/dev/stdin"))


def dns_over_https(kind: Column, host: Column) -> Column:
    return (kind == "tcp") & any_of(host, DOH_HOSTS)


def is_private(ip: Column) -> Column:
    second = F.try_element_at(F.split(ip, r"\."), F.lit(2)).try_cast("int")
    return ip.isin("127.0.0.1", "::1") | ip.startswith("10.") | ip.startswith("192.168.") | (ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False)))


def is_watched_port(port: Column) -> Column:
    return port.isin(WATCHED_PORTS) | port.between(1024, 49151)


def lifetime_counts(processes: DataFrame, by: Sequence[str], start: str, end: str, thresholds: Sequence[int] = (25, 50, 100)) -> DataFrame:
    """by, under_<t> for each threshold in milliseconds: processes that ended so soon, in growing buckets."""
    lived = F.col(end) - F.col(start)
    return processes.groupBy(*by).agg(*[F.count_if((lived >= 0) & (lived < t)).alias(f"under_{t}") for t in thresholds])


def map_flags(line: Column) -> Column:
    """array<string> for a line of a memory map: rwx, wx, memfd, deleted; empty for a short line."""
    parts = F.split(F.trim(line), r"\s+")
    perms, path = F.get(parts, F.lit(1)), F.array_join(F.slice(parts, 6, 10_000), " ")
    flags = F.array_compact(
        F.array(
            F.when(perms.contains("rwx") & (path == ""), "rwx"),
            F.when(perms.contains("wx") & (path == ""), "wx"),
            F.when(path.contains("/memfd:") | path.contains("/delayed_free"), "memfd"),
            F.when(path.contains("(deleted)"), "deleted"),
        )
    )
    return F.when(F.size(parts) >= 5, flags).otherwise(F.array().cast("array<string>"))


def no_temp_files(accesses: DataFrame, by: Sequence[str], path: str, operation: str) -> DataFrame:
    """by, reads: at least 300 reads and not one access to a temporary folder; a signal of 15 with 0.6."""
    temp = any_of(F.lower(path), TEMP_PARTS)
    return accesses.groupBy(*by).agg(F.count_if(F.col(operation) == "read").alias("reads"), F.count_if(temp).alias("__temp")).where("__temp = 0 and reads >= 300").drop("__temp")


def process_chain(processes: DataFrame, by: Sequence[str], name: str, command: str) -> DataFrame:
    """by, agents, tools, confidence: an agent among at least three processes, and two further tools or more; a signal of 35."""
    counted = processes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(any_of(F.lower(name), CHAIN_AGENTS)).alias("agents"), F.count_if(any_of(F.lower(command), CHAIN_TOOLS)).alias("tools"))
    return counted.where("n >= 3 and agents > 0 and tools >= 2").select(*by, "agents", "tools", F.round(F.least(0.5 + F.col("tools") * 0.05, F.lit(0.9)), 6).alias("confidence"))


def preparation_phase(processes: DataFrame, by: Sequence[str], command: str) -> DataFrame:
    """by, commands (distinct, in order of name), n, confidence: preparing commands of a session; a signal of 30."""
    found = processes.withColumn("__c", first_of(F.lower(command), PHASE_COMMANDS)).where("__c is not null")
    rows = found.groupBy(*by).agg(F.array_sort(F.collect_set("__c")).alias("commands"), F.count("*").alias("n"))
    return rows.select(*by, F.array_join("commands", ",").alias("commands"), "n", F.round(F.least(0.5 + F.col("n") * 0.1, F.lit(0.95)), 6).alias("confidence"))


def process_drop(now: Column, before: Column) -> Column:
    """Whether the number of processes fell by more than five and below half of the sample before; a signal of 40 with 0.7."""
    return (before - now > 5) & (now < before * 0.5)


def evidence_chains(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, chain, steps, confidence from a session's flags and counts.

    flags: git_read, mass_read, packed, uploaded, bundle, embedded, ai, big_flow, some_flow (booleans), span
    (seconds between the first and the last step of an exfiltration), enumerations (git commands that
    list objects) and files (accesses). The steps are those that occurred, in the order of the method.
    """
    step = lambda *items: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in items])), ">")
    read = F.col("git_read") | F.col("mass_read")
    exfil = step((read, "repo_read"), (F.col("packed"), "compression"), (F.col("big_flow"), "connection_open"), (F.col("uploaded"), "data_transmit"))
    n = F.size(F.split(exfil, ">"))
    sure = F.least(0.5 + n * 0.1 + F.when(F.col("span") < 60, 0.2).otherwise(0.0), F.lit(0.95))
    named = lambda c, name, steps, conf: F.when(c, F.struct(F.lit(name).alias("chain"), steps.alias("steps"), F.round(conf, 6).alias("confidence")))
    many = F.least(F.col("enumerations"), F.lit(5)).cast("int")
    found = F.array_compact(
        F.array(
            named(read & F.col("uploaded"), "repository_exfiltration_chain", exfil, sure),
            named(
                F.col("enumerations") >= 2,
                "pre_operational_snapshot",
                F.array_join(F.array_compact(F.concat(F.array_repeat(F.lit("git_preparation"), many), F.array(F.when(F.col("bundle"), F.lit("archival")), F.when(F.col("uploaded"), F.lit("transmission"))))), ">"),
                F.when(F.col("uploaded"), 0.9).otherwise(0.7),
            ),
            named(F.col("mass_read") & (F.col("code_uploaded") | F.col("some_flow")), "full_snapshot_transfer", F.lit("mass_read>external_transmission"), F.lit(0.75)),
            named(F.col("embedded") & (F.col("ai") | (F.col("files") >= 100)), "ai_embedding_chain", step((F.lit(True), "embedding_generation"), (F.col("ai"), "ai_transmission")), F.lit(0.7)),
        )
    )
    return flags.select(*by, F.explode(found).alias("f")).select(*by, "f.*")


def chain_behavior(chain: Column) -> Column:
    return F.when(chain == "pre_operational_snapshot", "pre_operational_snapshot_detected").otherwise("evidence_chain_detected")


def detailed_log(command: Column) -> Column:
    """Whether a git command reads history with its contents."""
    return F.arrays_overlap(F.split(F.lower(command), r"\s+"), F.array(*map(F.lit, ["-p", "--patch", "--stat", "show"])))


def inferred_late(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, type, confidence: contaminated history, a connection after preparation, a prompt; one of each at most.

    sessions has booleans: history, detailed, watched (the history is marked), prepared, outward (a flow
    to no local address), prompt (a flow to a prompt path) and has_<type> for what is known already.
    """
    rule = lambda c, name, conf: F.when(c & ~F.col(f"has_{name}"), F.struct(F.lit(name).alias("type"), F.lit(conf).alias("confidence")))
    found = F.array_compact(
        F.array(
            rule(F.col("history") & F.col("detailed") & F.col("watched"), "contaminated_git_read", 0.9),
            rule(F.col("prepared") & F.col("outward"), "suspicious_connection", 0.8),
            rule(F.col("prompt"), "ai_prompt_sent", 0.9),
        )
    )
    return sessions.select(*by, F.explode(found).alias("f")).select(*by, "f.*")


def embedding_pattern(accesses: DataFrame, by: Sequence[str], order: str, ts: str) -> DataFrame:
    """by, n, gap, spread: at least 200 reads at regular gaps (in input order): the spread under half of the mean; 0.9.

    Gaps are whole milliseconds, so their sums are exact whatever the order of adding.
    """
    from pyspark.sql.window import Window

    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(order))
    rows = accesses.withColumn("__gap", gap).groupBy(*by).agg(F.count("*").alias("n"), F.count("__gap").alias("k"), F.sum("__gap").alias("s"), F.sum((F.col("__gap") * F.col("__gap")).cast("decimal(38,0)")).alias("q"))
    mean = F.col("s") / F.col("k")
    # k * q - s * s is k * k times the variance
    spread = F.sqrt((F.col("k") * F.col("q") - F.col("s").cast("decimal(38,0)") * F.col("s")).cast("double")) / F.col("k")
    regular = rows.select(*by, "n", F.round(mean, 6).alias("gap"), F.round(spread, 6).alias("spread"))
    return regular.where("n >= 200 and spread < 0.5 * gap")
