"""Process trees, timelines, compiler calls and likeness of builds bound to events, orders and part.

A session's events in order are the processes of a build: each is started by the one of half its
number, so that builds are trees; some parents are not there.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bits
from ..operators import audit, dna, processes
from ..operators import builds as builds_ops
from ..sources import artifacts
from .scan import quoted
from .sessions import EVENTS, events
from .tables import read
from .telemetry import pick, picked

TOOLS = ["make", "gcc", "ld", "curl", "node", "cmake", "ar", "strip", "sh", "python3", "tar"]
CALLS = [
    "gcc -O2 -c main.c -o main.o", 'g++ -DX="a b" -Iinc x.cpp', "clang -fplugin=x.so a.c @resp.txt", "ld -z execstack a.o -o 'my prog'", "gcc -", "gcc --version", "ar rcs lib.a x.o", "rustc -no-pie lib.rs", "cl.exe /Foout.obj /Iinc x.c", "gcc -x c -", "make all",
]
KINDS = ["SECRET_READ", "NETWORK_UPLOAD", "FILE_WRITE", "SPAWN"]


def builds(spark, sf_dir: str):
    """session, pid, ppid, name, ts, seq, k: processes."""
    e = events(spark, sf_dir)
    pid = F.row_number().over(Window.partitionBy("session").orderBy("ts", "seq")).cast("long")
    rows = e.select("session", "seq", "ts", "k", pid.alias("pid"))
    ppid = F.when(F.col("k") % 10 == 0, F.col("pid") + 10_000).otherwise(F.floor(F.col("pid") / 2))
    return rows.select("session", "pid", ppid.cast("long").alias("ppid"), pick(TOOLS, F.col("seq") + F.col("k")).alias("name"), "ts", "seq", "k")


BUILDS = f"(SELECT session, pid, CASE WHEN k % 10 = 0 THEN pid + 10000 ELSE pid // 2 END AS ppid, {picked(TOOLS, 'seq + k')} AS name, ts, seq, k FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS pid FROM {EVENTS}))"
TREE = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {BUILDS}), t AS (SELECT session, pid, name, 0 AS depth, pid AS root, format('{{:020d}}.{{:012d}}/', ts, pid) AS place, name AS chain FROM p WHERE (session, ppid) NOT IN (SELECT (session, pid) FROM p)
  UNION ALL SELECT p.session, p.pid, p.name, t.depth + 1, t.root, t.place || format('{{:020d}}.{{:012d}}/', p.ts, p.pid), t.chain || ' > ' || p.name FROM t JOIN p ON p.session = t.session AND p.ppid = t.pid WHERE t.depth < 10)"""


def spawned_edges(spark, sf_dir):
    return processes.spawned(builds(spark, sf_dir), ["session"])


def process_tree(spark, sf_dir):
    return processes.tree(builds(spark, sf_dir), ["session"]).select("session", "pid", "name", "depth", "root")


def process_descendants(spark, sf_dir):
    """Below the first process of each build."""
    b = builds(spark, sf_dir)
    placed = processes.tree(b, ["session"])
    return processes.descendants(placed, ["session"], b.groupBy("session").agg(F.min("pid").alias("root"))).select("session", "pid", "depth")


def tree_dna(spark, sf_dir):
    return processes.tree_signature(processes.tree(builds(spark, sf_dir), ["session"]), ["session"])


def story_chains(spark, sf_dir):
    b = builds(spark, sf_dir)
    return processes.chain_strings(processes.tree(b, ["session"]), processes.spawned(b, ["session"]), ["session"])


def timeline_events(spark, sf_dir: str):
    return events(spark, sf_dir).select("session", (F.col("k") % 5).alias("pid"), "ts", "seq", pick(KINDS, F.col("seq") + F.col("k")).alias("kind"))


TIMELINE = f"(SELECT session, k % 5 AS pid, ts, seq, {picked(KINDS, 'seq + k')} AS kind FROM {EVENTS})"


def process_timelines(spark, sf_dir):
    return processes.timelines(timeline_events(spark, sf_dir), ["session"]).select("session", "pid", "seq", "idx")


def exfil_timelines(spark, sf_dir):
    return processes.exfil_timelines(timeline_events(spark, sf_dir), ["session"])


def build_stages(spark, sf_dir):
    """Events by the elapsed share of their session."""
    e = events(spark, sf_dir).select("session", "ts")
    w = Window.partitionBy("session")
    span = F.max("ts").over(w) - F.min("ts").over(w)
    share = F.when(span == 0, 0.0).otherwise((F.col("ts") - F.min("ts").over(w)) / span)
    return e.withColumn("stage", processes.stage(share)).groupBy("session", "stage").agg(F.count("*").alias("n"))


def process_exits(spark, sf_dir):
    """Samples of a session are runs of five days; pids are small numbers of its events."""
    e = events(spark, sf_dir).groupBy("session", F.floor(F.col("ts") / (5 * 86_400_000_000)).alias("sample")).agg(F.collect_set(F.col("k") % 9).alias("pids"))
    return processes.exits(e, ["session"])


EXIT_SQL = f"""SELECT session, sample, array_to_string(gone, ',') AS gone FROM (SELECT session, sample, list_sort(list_filter(before, lambda x: NOT list_contains(pids, x))) AS gone FROM (SELECT *, lag(pids) OVER (PARTITION BY session ORDER BY sample) AS before FROM (SELECT session, ts // 432000000000 AS sample, list(DISTINCT k % 9) AS pids FROM {EVENTS} GROUP BY ALL)) WHERE before IS NOT NULL) WHERE len(gone) > 0"""


def calls(spark, sf_dir: str):
    e = events(spark, sf_dir).select("seq", pick(CALLS, F.col("seq")).alias("command"))
    return processes.compiler_calls(e.withColumn("name", F.split("command", " ")[0]), "seq")


def compiler_invocations(spark, sf_dir):
    listed = lambda c: F.array_join(c, "|").alias(c)
    return calls(spark, sf_dir).select("seq", "tool", *[listed(c) for c in ("response", "defines", "includes", "flags", "inputs", "outputs")], "stdin", "memfd").groupBy("tool", "response", "defines", "includes", "flags", "inputs", "outputs", "stdin", "memfd").agg(F.count("*").alias("n"))


#: tool, response, defines, includes, flags, inputs, outputs, stdin, memfd of each of CALLS, by hand.
CALL_ROWS = [
    (0, "gcc", "", "", "", "-O2|-c", "main.c|main.o", "main.o", True, False), (1, "g++", "", "-DX=a b", "-Iinc", "", "x.cpp", "", False, False), (2, "clang", "@resp.txt", "", "", "-fplugin=x.so", "a.c", "", False, False),
    (3, "ld", "", "", "", "-z", "a.o", "my prog", False, False), (4, "gcc", "", "", "", "-", "", "", True, False), (5, "gcc", "", "", "", "--version", "", "", False, True), (6, "ar", "", "", "", "", "lib.a|x.o", "", False, False),
    (7, "rustc", "", "", "", "-no-pie", "lib.rs", "", False, False), (8, "cl.exe", "", "", "/Iinc", "", "x.c", "out.obj", False, False), (9, "gcc", "", "", "", "-x|-", "", "", True, False),
]
CALL_SQL = f"""SELECT tool, response, defines, includes, flags, inputs, outputs, stdin, memfd, count(*) AS n FROM events JOIN (VALUES {', '.join('(' + ', '.join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in CALL_ROWS)}) c(i, tool, response, defines, includes, flags, inputs, outputs, stdin, memfd) ON i = event_id % {len(CALLS)} GROUP BY ALL"""


def weak_compiler_flags(spark, sf_dir):
    return processes.weak_flags(calls(spark, sf_dir), "seq").groupBy("tool", "flag").agg(F.count("*").alias("n"))


def build_tool_chain(spark, sf_dir):
    return processes.tool_chain(builds(spark, sf_dir), ["session"])


STEP = "CASE name " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in processes.TOOL_STEPS.items()) + " END"


def artifact_producers(spark, sf_dir):
    """Each part is an artifact; the first supplier line of its number made it."""
    artifacts = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 7).alias("build"), F.concat(F.lit("/out/a"), F.col("p_partkey") % 50).alias("artifact"))
    edges = read(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("build"), F.concat(F.lit("a"), F.col("p_partkey") % 40).alias("label"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("src"))
    return processes.producers(artifacts, edges, ["build"])


PRODUCER_SQL = "SELECT build, artifact, producer FROM (SELECT p_partkey % 7 AS build, '/out/a' || (p_partkey % 50) AS artifact, 'a' || (p_partkey % 50) AS label FROM part WHERE p_partkey % 3 = 0) LEFT JOIN (SELECT p_partkey % 7 AS build, 'a' || (p_partkey % 40) AS label, arg_min(p_size, p_partkey) AS producer FROM part GROUP BY ALL) USING (build, label)"


def pairs(spark, sf_dir: str):
    """Neighbouring orders as two builds."""
    n = F.col("o_orderkey")
    cut = lambda m, size: F.transform(F.sequence(F.lit(0), (m % size).cast("int")), lambda i: ((n + i * 3) % 11).cast("string"))
    a = read(spark, sf_dir, "orders").select(
        n.alias("build"), F.array_distinct(cut(n, 4)).alias("tools"), F.array_distinct(cut(n, 3)).alias("artifacts"), F.sha2((n % 5).cast("string").cast("binary"), 256).alias("graph"), F.array_distinct(cut(n, 2)).alias("hosts"),
        (n % 13).alias("operations"), (n % 40 + 10).alias("duration"), (n % 3).alias("anomalies"),
    )
    names = [c for c in a.columns if c != "build"]
    left = a.select("build", *[F.col(c).alias(f"{c}_a") for c in names])
    return left.join(a.select((F.col("build") - 1).alias("build"), *[F.col(c).alias(f"{c}_b") for c in names]), "build")


def build_likeness(spark, sf_dir):
    return pairs(spark, sf_dir).select("build", dna.mixed_likeness().alias("likeness"))


def _set_sql(size: int) -> str:
    return f"list_distinct(list_transform(range(0, n % {size} + 1), lambda i: (n + i * 3) % 11))"


def _jaccard_sql(x: str) -> str:
    return f"len(list_intersect(a.{x}, b.{x})) / len(list_distinct(list_concat(a.{x}, b.{x})))::DOUBLE"


def _number_sql(x: str) -> str:
    r = f"(least(a.{x}, b.{x}) / greatest(a.{x}, b.{x})::DOUBLE)"
    return f"CASE WHEN a.{x} = b.{x} OR greatest(a.{x}, b.{x}) = 0 THEN 1.0 WHEN {r} >= 0.85 THEN {r} ELSE greatest(0.0, {r} - 0.15::DOUBLE) / 0.85::DOUBLE END"


PIECES = lambda c: f"list_distinct(regexp_extract_all({c}, '.{{1,8}}'))"
LIKENESS_SQL = f"""WITH o AS (SELECT n, {_set_sql(4)} AS tools, {_set_sql(3)} AS artifacts, sha256((n % 5)::VARCHAR) AS graph, {_set_sql(2)} AS hosts, n % 13 AS operations, n % 40 + 10 AS duration, n % 3 AS anomalies FROM (SELECT o_orderkey AS n FROM orders))
  SELECT a.n AS build, floor(round({_jaccard_sql('tools')} * 0.25::DOUBLE + {_jaccard_sql('artifacts')} * 0.25::DOUBLE + (CASE WHEN a.graph = b.graph THEN 1.0 ELSE len(list_intersect({PIECES('a.graph')}, {PIECES('b.graph')})) / len(list_distinct(list_concat({PIECES('a.graph')}, {PIECES('b.graph')})))::DOUBLE END) * 0.2::DOUBLE
    + {_jaccard_sql('hosts')} * 0.1::DOUBLE + ({_number_sql('operations')}) * 0.1::DOUBLE + ({_number_sql('duration')}) * 0.05::DOUBLE + (CASE WHEN a.anomalies = b.anomalies THEN 1.0 ELSE 0.5 END) * 0.05::DOUBLE, 9) * 1000 + 0.5) / 1000.0::DOUBLE AS likeness FROM o a JOIN o b ON b.n = a.n + 1"""


def byte_entropy(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", dna.byte_entropy(F.col("text").cast("binary")).alias("bits"))


BYTE_SQL = """SELECT item_id, floor(coalesce((SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, octet_length(encode(b.text))::DOUBLE AS t FROM (SELECT unnest(regexp_extract_all(hex(encode(b.text)), '..')) AS h) GROUP BY h)), 0) * 100 + 0.5) / 100.0::DOUBLE AS bits FROM benchmark b"""


def input_fingerprints(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("hash"))
    return dna.input_fingerprint(rows, ["build"])


def integrity_chain(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("build"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return dna.integrity_chain(rows, ["key"], ["build"], ["build", "key", "status", "priority"]).select("build", "own", "previous")


INTEGRITY_SQL = """SELECT build, sha256(build || '|' || key || '|' || status || '|' || priority) AS own, coalesce(sha256(lag(row_) OVER (PARTITION BY key ORDER BY build)), '') AS previous FROM (SELECT o_custkey AS key, o_orderkey AS build, o_orderstatus AS status, o_orderpriority AS priority,
  '{"build":' || o_orderkey || ',"key":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS row_ FROM orders)"""


def snapshot_delta(spark, sf_dir):
    """Suppliers by nation, now and before: those of odd number came since."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("repo"), (F.col("s_suppkey") % 2).alias("odd"), (F.col("s_acctbal") < 0).cast("int").alias("critical"))
    count = lambda df: df.groupBy("repo").agg(F.count("*").alias("findings"), F.sum("critical").alias("critical"))
    return dna.snapshot_delta(count(s), count(s.where("odd = 0")), ["repo"], ["findings", "critical"])


def sensor_coverage(spark, sf_dir):
    """A sensor a supplier: its trust, capability and state by its number."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), (k % 5 / 10 + 0.5).alias("trust"), (k % 4 / 4 + 0.25).alias("capability"), (k % 3 != 0).alias("ok"), pick(["dns", "process", "file", "network"], k).alias("sees"))
    return dna.sensor_coverage(s, ["host"])


SENSOR_SQL = f"""SELECT host, round(sum(CASE WHEN ok THEN trust * capability * 100 ELSE 0 END) / count(*), 4) AS coverage, array_to_string(list_sort(coalesce(list(DISTINCT sees) FILTER (WHERE NOT ok), [])), ',') AS blind, CASE WHEN count(*) FILTER (WHERE ok) / count(*)::DOUBLE >= 0.8 THEN 'healthy' WHEN count(*) FILTER (WHERE ok) / count(*)::DOUBLE >= 0.5 THEN 'degraded' ELSE 'critical' END AS health
  FROM (SELECT s_nationkey AS host, k % 5 / 10.0::DOUBLE + 0.5::DOUBLE AS trust, k % 4 / 4.0::DOUBLE + 0.25::DOUBLE AS capability, k % 3 <> 0 AS ok, {picked(["dns", "process", "file", "network"], 'k')} AS sees FROM (SELECT *, s_suppkey AS k FROM supplier)) GROUP BY host"""


def artifact_findings(spark, sf_dir):
    k = F.col("p_partkey")
    hits = dna.artifact_findings(k % 20 / 10 + 6.2, k % 3 == 0, F.array(pick(["a.com", "b.ru", "c.tk"], k)), F.array(pick(["printf", "dlopen", "GetProcAddress", "malloc"], k)))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(hits).alias("finding"))


ARTIFACT_SQL = f"""SELECT p_partkey, unnest(list_filter([CASE WHEN e > 7.5 THEN 'packed' END, CASE WHEN k % 3 = 0 AND e > 7.8 THEN 'packed_code' END, CASE WHEN {picked(["a.com", "b.ru", "c.tk"], 'k')} <> 'a.com' THEN 'suspicious_host' END, CASE WHEN {picked(["printf", "dlopen", "GetProcAddress", "malloc"], 'k')} IN ('dlopen', 'GetProcAddress') THEN 'dynamic_load' END], lambda x: x IS NOT NULL)) AS finding
  FROM (SELECT p_partkey, p_partkey AS k, p_partkey % 20 / 10.0::DOUBLE + 6.2::DOUBLE AS e FROM part)"""


IMAGE_NAMES, IMAGE_STRINGS = "\0.text\0.dynstr\0.dynamic\0.shstrtab\0", "\0libc.so\0libdl_dlopen.so\0"


def image(spark, sf_dir):
    """Pages as binaries: an ELF file whose code is the page, with a table of names and, for odd ids, the libraries it asks for.

    Sections: none, .text (the html), .dynstr, .dynamic, .shstrtab.
    """
    number = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * size, "0"), F.lit(".."), F.lit(0))), ""))
    names, strings = IMAGE_NAMES, IMAGE_STRINGS
    code = F.coalesce("html", F.lit("")).cast("binary")
    n, odd = F.octet_length(code), F.col("page_id") % 2
    zero = lambda size: number(F.lit(0), size)
    entry = lambda tag, value: F.concat(number(F.lit(tag), 8), number(value, 8))
    dynamic = F.concat(entry(1, F.lit(1)), entry(1, F.when(odd == 1, F.lit(9)).otherwise(F.lit(1))), entry(0, F.lit(0)))
    at_strings, at_dynamic = 64 + n, 64 + n + len(strings)
    at_names = at_dynamic + 48
    table = at_names + len(names)
    head = F.concat(F.unhex(F.lit("7F454C46020101" + "00" * 9)), number(F.lit(2), 2), number(F.lit(62), 2), zero(4), zero(16), number(table, 8), zero(10), number(F.lit(64), 2), number(F.lit(5), 2), number(F.lit(4), 2))
    one = lambda name, kind, flags, at, size: F.concat(number(F.lit(name), 4), number(F.lit(kind), 4), number(F.lit(flags), 8), zero(8), number(at, 8), number(size, 8), zero(24))
    rows = [one(0, 0, 0, F.lit(0), F.lit(0)), one(1, 1, 6, F.lit(64), n), one(7, 3, 2, at_strings, F.lit(len(strings))), one(15, 6, 3, at_dynamic, F.lit(48)), one(24, 3, 0, at_names, F.lit(len(names)))]
    content = F.concat(head, code, F.lit(strings).cast("binary"), dynamic, F.lit(names).cast("binary"), *rows)
    return read(spark, sf_dir, "pages").select("page_id", content.alias("content"))


def artifact_sections(spark, sf_dir):
    return artifacts.section_rows(artifacts.parsed(image(spark, sf_dir))).where("section <> ''")


# Bytes as two hexadecimal digits each.
SECTION_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, hex(encode(coalesce(html, ''))) AS h FROM pages), bytes AS (SELECT page_id, unnest(list_transform(range(1, length(h), 2), lambda i: substr(h, i, 2))) AS b FROM p WHERE h <> ''),
  e AS (SELECT page_id, entropy(b) AS bits FROM bytes GROUP BY page_id)
  SELECT page_id, '.text' AS section, strlen(html)::BIGINT AS size, true AS executable, round(coalesce(bits, 0) + 1e-9::DOUBLE, 2) AS entropy FROM p LEFT JOIN e USING (page_id)
  UNION ALL SELECT page_id, '.dynstr', {len(IMAGE_STRINGS)}, false, {round(bits(IMAGE_STRINGS.encode()), 2)} FROM pages UNION ALL SELECT page_id, '.shstrtab', {len(IMAGE_NAMES)}, false, {round(bits(IMAGE_NAMES.encode()), 2)} FROM pages
  UNION ALL SELECT page_id, '.dynamic', 48, false, CASE page_id % 2 WHEN 1 THEN {round(bits(bytes([1, 1, 1, 9] + [0] * 44)), 2)} ELSE {round(bits(bytes([1] * 4 + [0] * 44)), 2)} END FROM pages"""


def artifact_changes(spark, sf_dir):
    """Each page's binary against that of the page before it."""
    rows = artifacts.parsed(image(spark, sf_dir))
    return artifacts.artifact_diff(rows.withColumn("page_id", F.col("page_id") + 1), rows, "page_id").select(
        "page_id", "changed", "entropy_delta", F.array_join("imports_added", ",").alias("imports_added"), F.array_join("imports_removed", ",").alias("imports_removed"), F.array_join("findings", ",").alias("findings")
    ).withColumn("changed", F.array_join("changed", ","))


def sanitised_lines(spark, sf_dir):
    """What is left of secrets, and what masking leaves as code, in lines made of a part's name and number."""
    n = F.col("p_partkey")
    line = F.concat(F.lit("key="), F.sha2(n.cast("string").cast("binary"), 256), F.lit(" // note "), n.cast("string"), F.lit(" 'quoted'"))
    return read(spark, sf_dir, "part").select("p_partkey", dna.sanitised(line).alias("safe"), dna.masked(line).alias("code"), dna.hash31(n.cast("string")).alias("hash"))


# The 31-hash of at most five digits needs no wrap.
SAFE_SQL = """SELECT p_partkey, 'key=' || substr(h, 1, 4) || '*** // note ' || p_partkey || ' ''quoted''' AS safe, 'key=' || h || ' ' AS code, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_partkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: a * 31 + c)::INT AS hash FROM (SELECT p_partkey, sha256(p_partkey::VARCHAR) AS h FROM part)"""

# A raw value of each feature: the order's number times the feature's place, folded to one and a half of its top.
def _folded(name: str, i: int) -> str:
    top = float(builds_ops.FEATURES[name].rstrip("+"))
    return f"((o_orderkey * {i + 3}) % {int(top * 1.5) + 1}) * 1.0" if top > 1 else f"((o_orderkey * {i + 3}) % 100) / 80.0"


def feature_records(spark, sf_dir: str):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("build"), *[F.expr(_folded(n, i)).cast("double").alias(n) for i, n in enumerate(builds_ops.FEATURES)])


FEATURE_ROWS = f"(SELECT o_orderkey AS build, {', '.join(f'({_folded(n, i)})::DOUBLE AS {n}' for i, n in enumerate(builds_ops.FEATURES))} FROM orders)"


def record_features(spark, sf_dir):
    return builds_ops.feature_vector(feature_records(spark, sf_dir), "build")


def learned_trust(spark, sf_dir):
    return builds_ops.learned_trust(feature_records(spark, sf_dir), "build")


def _scaled(name: str) -> str:
    top = builds_ops.FEATURES[name].rstrip("+")
    return f"round({f'least({name}, {top})' if builds_ops.FEATURES[name].endswith('+') else name} / {top}.0::DOUBLE, 8) AS {name}"


def _percent(name: str) -> str:
    return f"floor(least({name} / {builds_ops.FEATURES[name].rstrip('+')}.0::DOUBLE, 1) * 100 + 0.5)"


def touched(spark, sf_dir: str, kinds: int):
    """session, pid, tool, file of a build's file events: even ones are reads, odd ones writes."""
    return builds(spark, sf_dir).where(F.col("k") % 2 == kinds).select("session", "pid", F.col("name").alias("tool"), F.concat(F.lit("f"), F.col("k") % 6).alias("file"))


def provenance_edges(spark, sf_dir):
    return processes.provenance(touched(spark, sf_dir, 0), touched(spark, sf_dir, 1), ["session"])


KIND = f"CASE {STEP} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in processes.EDGE_KINDS.items()) + " ELSE 'produced' END"
PROVENANCE_SQL = f"""SELECT session, CASE WHEN k % 2 = 0 THEN 'file:f' || (k % 6) ELSE 'tool:' || name END AS src, CASE WHEN k % 2 = 0 THEN 'tool:' || name ELSE 'file:f' || (k % 6) END AS dst, CASE WHEN k % 2 = 0 THEN 'read' ELSE {KIND} END AS kind, count(*) AS n FROM {BUILDS} GROUP BY ALL"""


def causal_dag(spark, sf_dir):
    b = builds(spark, sf_dir)
    file = lambda n: touched(spark, sf_dir, n).select("session", "pid", F.col("file").alias("label"))
    return processes.causal_dag(processes.tree(b, ["session"]), ["session"], {"file": file(1), "network": file(0)})


DAG_SQL = f"{TREE} SELECT session, 'process' AS kind, name AS label, pid AS parent, depth FROM t UNION ALL SELECT session, CASE WHEN k % 2 = 1 THEN 'file' ELSE 'network' END, 'f' || (k % 6), pid, t.depth + 1 FROM t JOIN (SELECT session, pid, k FROM p) q USING (session, pid)"


def threat_matches(spark, sf_dir):
    """Orders as changes, their customers as authors; every fiftieth customer and some priorities are known."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), (F.col("o_orderkey") % 977).alias("hash"), F.col("o_orderpriority").alias("text"))
    bad = read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("author"))
    return audit.threat_matches(o, bad, spark.range(20).select((F.col("id") * 31).alias("hash")), ["URGENT", "LOW"])


THREAT_SQL = """SELECT * FROM (SELECT o_orderkey AS id, o_custkey % 50 = 0 AS by_author, o_orderkey % 977 % 31 = 0 AND o_orderkey % 977 < 620 AS by_hash, array_to_string(list_filter([CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'URGENT' END, CASE WHEN contains(o_orderpriority, 'LOW') THEN 'LOW' END], lambda x: x IS NOT NULL), ',') AS patterns FROM orders) WHERE by_author OR by_hash OR patterns <> ''"""


def vault_stats(spark, sf_dir):
    return audit.vault_stats(events(spark, sf_dir).select(F.col("host").alias("repo"), F.col("session").alias("author"), F.col("kind").alias("type")))


def frequent_authors(spark, sf_dir):
    return audit.most_frequent(events(spark, sf_dir), "session", 20)


QUERIES = {
    f.__name__: f
    for f in (
        spawned_edges, process_tree, process_descendants, tree_dna, story_chains, process_timelines, exfil_timelines, build_stages, process_exits, compiler_invocations, weak_compiler_flags, build_tool_chain, artifact_producers, build_likeness,
        byte_entropy, input_fingerprints, integrity_chain, snapshot_delta, sensor_coverage, artifact_findings, artifact_sections, artifact_changes, sanitised_lines, record_features, learned_trust,
        provenance_edges, causal_dag, threat_matches, vault_stats, frequent_authors,
    )
}
ORACLE_SQL = {
    "spawned_edges": f"WITH p AS (SELECT * FROM {BUILDS}) SELECT c.session, c.ppid AS src, c.pid AS dst, 95 AS confidence, 0.05::DOUBLE AS degradation FROM p c JOIN p ON p.session = c.session AND p.pid = c.ppid WHERE c.ppid <> c.pid AND p.ts <= c.ts",
    "process_tree": f"{TREE} SELECT session, pid, name, depth, root FROM t",
    "process_descendants": f"{TREE} SELECT session, pid, depth FROM t WHERE (session, root) IN (SELECT (session, min(pid)) FROM p GROUP BY session)",
    "tree_dna": f"{TREE} SELECT session, count(*)::INT AS processes, sha256(string_agg(repeat(' ', depth) || name, chr(10) ORDER BY place)) AS dna FROM t GROUP BY session",
    "story_chains": f"{TREE} SELECT session, pid AS leaf, chain FROM t WHERE (session, pid) NOT IN (SELECT (c.session, c.ppid) FROM p c JOIN p USING (session) WHERE p.pid = c.ppid AND c.ppid <> c.pid AND p.ts <= c.ts)",
    "process_timelines": f"SELECT session, pid, seq, (row_number() OVER (PARTITION BY session, pid ORDER BY ts, seq) - 1)::INT AS idx FROM {TIMELINE}",
    "exfil_timelines": f"SELECT session, pid, secrets, uploads, uploads * 4096 AS bytes, span FROM (SELECT session, pid, count(*) FILTER (WHERE kind = 'SECRET_READ') AS secrets, count(*) FILTER (WHERE kind = 'NETWORK_UPLOAD') AS uploads, max(ts) - min(ts) AS span FROM {TIMELINE} GROUP BY ALL) WHERE secrets > 0 AND uploads > 0",
    "build_stages": f"SELECT session, CASE WHEN s < 0.1 THEN 'initialization' WHEN s < 0.3 THEN 'configuration' WHEN s < 0.7 THEN 'compilation' ELSE 'finalization' END AS stage, count(*) AS n FROM (SELECT session, CASE WHEN max(ts) OVER w = min(ts) OVER w THEN 0 ELSE (ts - min(ts) OVER w) / (max(ts) OVER w - min(ts) OVER w)::DOUBLE END AS s FROM {EVENTS} WINDOW w AS (PARTITION BY session)) GROUP BY ALL",
    "process_exits": EXIT_SQL,
    "compiler_invocations": CALL_SQL,
    "weak_compiler_flags": f"SELECT tool, flag, count(*) AS n FROM events JOIN (VALUES (2, 'clang', '-fplugin'), (7, 'rustc', '-no-pie')) c(i, tool, flag) ON i = event_id % {len(CALLS)} GROUP BY ALL",
    "build_tool_chain": f"SELECT session, string_agg(step, '>' ORDER BY ts, pid) AS chain FROM (SELECT session, step, m.ts AS ts, m.pid AS pid FROM (SELECT session, step, min({{'ts': ts, 'pid': pid}}) AS m FROM (SELECT *, {STEP} AS step FROM {BUILDS}) WHERE step IS NOT NULL GROUP BY ALL)) GROUP BY session",
    "artifact_producers": PRODUCER_SQL,
    "build_likeness": LIKENESS_SQL,
    "byte_entropy": BYTE_SQL,
    "input_fingerprints": "SELECT l_orderkey AS build, count(*)::INT AS inputs, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT l_orderkey, 'f' || l_linenumber || ':' || sha256(l_partkey::VARCHAR) AS line FROM lineitem) GROUP BY 1",
    "integrity_chain": INTEGRITY_SQL,
    "snapshot_delta": "SELECT s_nationkey AS repo, count(*) - count(*) FILTER (WHERE s_suppkey % 2 = 0) AS findings_delta, (count(*) FILTER (WHERE s_acctbal < 0) - count(*) FILTER (WHERE s_acctbal < 0 AND s_suppkey % 2 = 0))::BIGINT AS critical_delta FROM supplier GROUP BY 1",
    "sensor_coverage": SENSOR_SQL,
    "artifact_findings": ARTIFACT_SQL,
    "artifact_sections": SECTION_SQL,
    "sanitised_lines": SAFE_SQL,
    "provenance_edges": PROVENANCE_SQL,
    "causal_dag": DAG_SQL,
    "threat_matches": THREAT_SQL,
    "vault_stats": f"SELECT count(*) AS signals, count(DISTINCT host) AS repos, count(DISTINCT session) AS authors, count(DISTINCT kind) AS types FROM {EVENTS}",
    "frequent_authors": f"SELECT session, count(*) AS n FROM {EVENTS} GROUP BY session ORDER BY n DESC, session LIMIT 20",
    "record_features": f"SELECT build, {', '.join(map(_scaled, builds_ops.FEATURES))} FROM {FEATURE_ROWS}",
    "learned_trust": f"SELECT build, floor(round({' + '.join(f'{_percent(n)} * {w}::DOUBLE' for n, w in builds_ops.LEARNED.items())}, 9) + 0.5)::INT AS trust FROM {FEATURE_ROWS}",
}
