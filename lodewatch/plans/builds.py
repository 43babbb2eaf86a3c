"""Build, graph, package and evaluation operators bound to the star schema and the labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import dealt, settle
from ..operators import builds, diffs, evaluate, graph, learn, supply, trends
from .scan import FINDINGS, corpus_findings
from .tables import read


def records(spark, sf_dir):
    """An order is a build: its key (customer), time, price, lines, quantity and share of returns."""
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax")
    lines = dealt(lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_suppkey").alias("tools"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_tax") > 0.06).alias("taxed")
    )
    joined = orders.join(lines, "o_orderkey", "left").na.fill(0, ["lines", "quantity", "tools", "returned", "open", "taxed"])
    return joined.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("build"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "lines", "quantity", "tools", "returned", "open", "taxed")


RECORDS = """(SELECT o_custkey AS key, o_orderkey AS build, epoch_us(o_orderdate) AS ts, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority, coalesce(lines, 0) AS lines, coalesce(quantity, 0) AS quantity,
  coalesce(tools, 0) AS tools, coalesce(returned, 0) AS returned, coalesce(l.open, 0) AS open, coalesce(taxed, 0) AS taxed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS tools,
  count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_tax > 0.06) AS taxed FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)"""
MEASURES = ["price", "lines", "quantity"]


def orphan_anti_join(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(customers, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


def baseline_stats(spark, sf_dir):
    b = trends.baseline(records(spark, sf_dir), "key", MEASURES)
    return b.select("key", "n", *[F.round(c, 6).alias(c) for c in b.columns if c not in ("key", "n")])


def _moments(m: str) -> str:
    v = f"round({m} * {trends.PLACES})::BIGINT"
    return f"sum({v})::DOUBLE / count({m}) / {trends.PLACES} AS {m}_mean, sqrt((count({m})::HUGEINT * sum({v}::HUGEINT * {v}::HUGEINT) - sum({v})::HUGEINT * sum({v})::HUGEINT)::DOUBLE) / count({m}) / {trends.PLACES} AS {m}_std"


def _stats(rows: str = RECORDS) -> str:
    return f"(SELECT key, count(*) AS n, {', '.join(f'{_moments(m)}, min({m}) AS {m}_min, max({m}) AS {m}_max' for m in MEASURES)} FROM {rows} GROUP BY key)"


def _z(m: str) -> str:
    return f"CASE WHEN coalesce({m}_std, 0) = 0 THEN 0 ELSE ({m} - {m}_mean) / {m}_std END"


def normality_zscores(spark, sf_dir):
    r = records(spark, sf_dir)
    n = trends.normality(r, trends.baseline(r, "key", MEASURES), "key", MEASURES)
    return n.select("build", *[F.round(f"z_{m}", 4).alias(f"z_{m}") for m in MEASURES], F.round("normality", 4).alias("normality"), "outlier")


NORMAL_SQL = f"SELECT build, {', '.join(f'round({_z(m)}, 4) AS z_{m}' for m in MEASURES)}, round(greatest(0, 1 - ({' + '.join(f'abs({_z(m)})' for m in MEASURES)}) / 9.0::DOUBLE), 4) AS normality, greatest({', '.join(f'abs({_z(m)})' for m in MEASURES)}) > 3 AS outlier FROM {RECORDS} JOIN {_stats()} USING (key)"


def baseline_deviation(spark, sf_dir):
    r = records(spark, sf_dir).select("key", "build", *MEASURES)
    d = trends.deviations(r, trends.baseline(r, "key", MEASURES), "key", MEASURES)
    return d.select("build", "measure", F.round("z", 4).alias("z"), "severity")


DEVIATION_SQL = " UNION ALL ".join(f"SELECT build, '{m}' AS measure, round({_z(m)}, 4) AS z, CASE WHEN abs({_z(m)}) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM {RECORDS} JOIN {_stats()} USING (key) WHERE n >= 3 AND abs({_z(m)}) > 2" for m in MEASURES)


def tool_uses(spark, sf_dir):
    """key, build, tool of each line; dealt by the build, so that its uses are counted where they are joined."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), (F.col("l_suppkey") % 12).alias("tool"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("build"))
    return dealt(lines, "build").join(dealt(orders, "build"), "build").select("key", "build", "tool")


def typical_tools(spark, sf_dir):
    t = trends.typical(tool_uses(spark, sf_dir), "key", "build", "tool", 0.5)
    return t.withColumn("share", F.round("share", 6))


USES = "(SELECT o_custkey AS key, o_orderkey AS build, l_suppkey % 12 AS tool FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TYPICAL_SQL = f"SELECT key, tool, round(n / records::DOUBLE, 6) AS share FROM (SELECT key, tool, count(DISTINCT build) AS n FROM {USES} GROUP BY key, tool) JOIN (SELECT key, count(DISTINCT build) AS records FROM {USES} GROUP BY key) USING (key) WHERE n / records::DOUBLE >= 0.5"


def trend_slope_ewma_cusum(spark, sf_dir):
    t = trends.trend(records(spark, sf_dir), "key", ["ts", "build"], "price")
    return t.select("key", "n", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("mean", "std", "slope", "ewma")], F.round("cusum", 6).alias("cusum"), "level")


TREND = f"""(WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY key) AS n, avg(price) OVER (PARTITION BY key) AS mean, stddev_samp(price) OVER (PARTITION BY key) AS std FROM {RECORDS} WINDOW w AS (PARTITION BY key ORDER BY ts, build)),
  s AS (SELECT *, sum(CASE WHEN coalesce(std, 0) = 0 THEN 0 ELSE (price - mean) / std - 0.5 END) OVER (PARTITION BY key ORDER BY i) AS s FROM r), c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY i)) AS c FROM s),
  a AS (SELECT key, count(*) AS n, avg(price) AS mean, coalesce(stddev_samp(price), 0) AS std, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(price, i), 0) END AS slope, sum(CASE WHEN i = 0 THEN 1.0 ELSE 0.3 END::DOUBLE * pow(0.7, n - 1 - i) * price) AS ewma, arg_max(c, i) AS cusum FROM c GROUP BY key)
  SELECT *, CASE WHEN drift > 0.2 THEN 'HIGH' WHEN drift > 0.1 THEN 'MEDIUM' WHEN drift > 0.03 THEN 'LOW' ELSE 'NONE' END AS level FROM (SELECT *, greatest(abs(slope) / abs(mean), cusum / (abs(mean) * n)) AS drift FROM a))"""


def trend_overall(spark, sf_dir):
    t = trends.trend(records(spark, sf_dir), "key", ["ts", "build"], "price")
    nation = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    return trends.overall(t.join(nation, "key"), ["c_nationkey"])


OVERALL_SQL = f"SELECT c_nationkey, arg_max(level, CASE level WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS level, {', '.join(f'''count(*) FILTER (WHERE level = '{x}') AS {x.lower()}''' for x in ('NONE', 'LOW', 'MEDIUM', 'HIGH'))} FROM {TREND} JOIN customer ON c_custkey = key GROUP BY c_nationkey"


def snapshot_direction(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("score", F.floor(F.col("price") / 10_000))
    return trends.direction(r, "key", ["ts", "build"], "score", "returned")


DIRECTION_SQL = f"""SELECT key, d_score, d_critical, CASE WHEN d_score < -5 OR d_critical < 0 THEN 'improving' WHEN d_score > 5 OR d_critical > 0 THEN 'worsening' ELSE 'stable' END AS direction FROM (SELECT key, max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2) AS d_score,
  max(returned) FILTER (WHERE r = 1) - max(returned) FILTER (WHERE r = 2) AS d_critical, count(*) AS k FROM (SELECT *, floor(price / 10000)::BIGINT AS score, row_number() OVER (PARTITION BY key ORDER BY ts DESC, build DESC) AS r FROM {RECORDS}) WHERE r <= 2 GROUP BY key) WHERE k = 2"""


def trust_dimensions(spark, sf_dir):
    r = records(spark, sf_dir)
    t = builds.trust(r, {"toolchain": 100 - 10 * F.col("tools"), "inputs": 100 - F.col("quantity") / 4, "artifacts": 100 - 25 * F.col("returned"), "network": 100 - 12 * F.col("open"), "process": 100 - 8 * F.col("lines"), "environment": F.when(F.col("status") == "F", 100.0).otherwise(60.0), "history": 100 - 20 * F.col("taxed")})
    return t.select("build", *builds.DIMENSIONS, "trust")


def _clamped(x: str) -> str:
    return f"floor(greatest(0, least(100, {x})) + 0.5)"


TRUST_SQL = f"""SELECT *, round(toolchain * 0.18::DOUBLE + inputs * 0.18::DOUBLE + artifacts * 0.15::DOUBLE + network * 0.15::DOUBLE + process * 0.12::DOUBLE + environment * 0.12::DOUBLE + history * 0.1::DOUBLE, 4) AS trust FROM (SELECT build, {_clamped('100 - 10 * tools')}::DOUBLE AS toolchain,
  {_clamped('100 - quantity / 4')}::DOUBLE AS inputs, {_clamped('100 - 25 * returned')}::DOUBLE AS artifacts, {_clamped('100 - 12 * open')}::DOUBLE AS network, {_clamped('100 - 8 * lines')}::DOUBLE AS process, CASE WHEN status = 'F' THEN 100 ELSE 60 END::DOUBLE AS environment, {_clamped('100 - 20 * taxed')}::DOUBLE AS history FROM {RECORDS})"""


def trust_score_verdict(spark, sf_dir):
    r = records(spark, sf_dir)
    score = builds.trust_score([(F.col("returned"), 15.0, 40.0), (F.col("open"), 5.0, 20.0), (F.col("taxed"), 10.0, 30.0)], F.when(F.col("status") == "F", 5.0).otherwise(0.0))
    return r.select("build", score.alias("score"), builds.trust_verdict(score).alias("verdict"))


def hermetic_score(spark, sf_dir):
    r = records(spark, sf_dir)
    score = builds.hermetic(F.col("open"), F.col("returned"), F.col("taxed"), F.lit(0), F.col("tools") - F.col("lines"), F.col("status") == "F", F.when(F.col("priority") == "1-URGENT", 1).otherwise(0))
    return r.select("build", score.cast("double").alias("score"))


def input_diff(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    before = part.where("p_size <> 7").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    after = part.where("p_size <> 9").select("p_partkey", F.when(F.col("p_size") == 3, "Brand#0").otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_retailprice") + F.when(F.col("p_size") == 5, 1.0).otherwise(0.001)).alias("p_retailprice"), "p_size")
    return diffs.snapshot(before, after, ["p_partkey"], ["p_brand", "p_retailprice", "p_size"], {"p_retailprice": 0.01})


INPUT_SQL = """SELECT * FROM (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'created' WHEN p_size = 9 THEN 'deleted' WHEN p_size IN (3, 5) THEN 'modified' END AS change, CASE WHEN p_size = 3 AND p_brand <> 'Brand#0' THEN 'p_brand' WHEN p_size = 5 THEN 'p_retailprice' ELSE '' END AS fields FROM part) WHERE change IS NOT NULL AND NOT (change = 'modified' AND fields = '')"""


def jaccard_similarity(spark, sf_dir):
    """Each build's tools against those of the build before it."""
    tools = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("build")).agg(F.collect_set(F.col("l_suppkey") % 12).alias("tools"))
    r = records(spark, sf_dir).select("key", "build", "ts").join(tools, "build")
    w = Window.partitionBy("key").orderBy("ts", "build")
    rows = r.withColumn("before", F.lag("tools").over(w)).where("before is not null")
    return rows.select("build", F.round(diffs.jaccard(F.col("tools"), F.col("before")), 6).alias("jaccard"))


JACCARD_SQL = f"""SELECT build, round(len(list_intersect(tools, before)) / len(list_distinct(list_concat(tools, before)))::DOUBLE, 6) AS jaccard FROM (SELECT build, t.tools, lag(t.tools) OVER (PARTITION BY key ORDER BY ts, build) AS before FROM {RECORDS} JOIN (SELECT l_orderkey AS build, list(DISTINCT l_suppkey % 12) AS tools FROM lineitem GROUP BY 1) t USING (build)) WHERE before IS NOT NULL"""


def multi_dna_fingerprint(spark, sf_dir):
    return builds.fingerprint(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_suppkey"))


def contract_violations(spark, sf_dir):
    return builds.contract(tool_uses(spark, sf_dir), "key", "build", "tool", 5)


CONTRACT_SQL = f"""SELECT key, tool, records, first_record, state FROM (SELECT *, CASE WHEN first_record = "last" THEN 'NEW_TOOL' WHEN records * 2 >= "all" THEN 'REQUIRED' END AS state FROM (SELECT key, tool, count(DISTINCT build) AS records, min(build) AS first_record FROM {USES} GROUP BY key, tool)
  JOIN (SELECT key, count(DISTINCT build) AS "all", max(build) AS "last" FROM {USES} GROUP BY key) USING (key) WHERE "all" >= 5) WHERE state IS NOT NULL"""


def nodes_edges(spark, sf_dir):
    """A graph an order: its lines in order are nodes; a line leads to the next if it is large, to the one after if alike."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ahead = lambda name, by: F.lead(name, by).over(w)
    rows = settle(read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.row_number().over(w).alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("q"), F.round(F.col("l_discount") + 0.5, 2).alias("confidence"),
        ahead("l_quantity", 1).alias("q1"), ahead("l_quantity", 2).alias("q2"), (ahead("l_returnflag", 2) == F.col("l_returnflag")).alias("alike"),
    ))  # fmt: skip  # sorted once; nodes and edges are read from it many times
    step = lambda by, cost, lost: F.struct((F.col("id") + by).alias("dst"), F.col(cost).alias("cost"), F.lit(lost).alias("degradation"))
    out = F.array_compact(F.array(F.when(F.col("q1") > 15, step(1, "q1", 0.05)), F.when(F.col("alike"), step(2, "q2", 0.25))))
    edges = rows.where("g is not null").select("g", F.col("id").alias("src"), F.explode(out).alias("e")).select("g", "src", "e.*")
    return rows.select("g", "id", "kind", "q", "confidence"), edges


NODES = "(SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS id, l_returnflag AS kind, l_quantity AS q, round(l_discount + 0.5, 2) AS confidence FROM lineitem)"
EDGES = f"(SELECT a.g, a.id AS src, b.id AS dst, b.q AS cost, CASE WHEN b.id = a.id + 1 THEN 0.05 ELSE 0.25 END::DOUBLE AS degradation FROM {NODES} a JOIN {NODES} b ON a.g = b.g AND ((b.id = a.id + 1 AND b.q > 15) OR (b.id = a.id + 2 AND a.kind = b.kind)))"
GRAPH = f"WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {NODES}), e AS MATERIALIZED (SELECT * FROM {EDGES}), roots AS (SELECT g, id FROM n WHERE (g, id) NOT IN (SELECT (g, dst) FROM e))"


def walk_sql(starts: str) -> str:
    return f"{GRAPH}, walk AS (SELECT g, id AS start, id AS \"end\", [id] AS nodes, 0 AS length, 0.0::DOUBLE AS cost FROM {starts} UNION ALL SELECT w.g, w.start, e.dst, list_append(w.nodes, e.dst), w.length + 1, w.cost + e.cost FROM walk w JOIN e ON e.g = w.g AND e.src = w.\"end\" WHERE NOT list_contains(w.nodes, e.dst) AND w.length < 10), paths AS MATERIALIZED (SELECT * FROM walk WHERE length > 0)"


def graph_build_edges(spark, sf_dir):
    return nodes_edges(spark, sf_dir)[1]


def graph_stats(spark, sf_dir):
    return graph.stats(*nodes_edges(spark, sf_dir))


STATS_SQL = GRAPH + """ SELECT n.g, n.nodes, coalesce(e.edges, 0)::BIGINT AS edges, coalesce(e.max_out, 0) AS max_out, round(coalesce(e.edges, 0) / n.nodes::DOUBLE, 6) AS avg_out, coalesce(r.roots, 0) AS roots, round(CASE WHEN n.nodes < 2 THEN 0 ELSE coalesce(e.edges, 0) / (n.nodes * (n.nodes - 1))::DOUBLE END, 4) AS density,
  round(CASE WHEN kinds < 2 THEN 0 ELSE bits / log2(kinds) END, 3) AS entropy FROM (SELECT g, count(*) AS nodes FROM n GROUP BY g) n LEFT JOIN (SELECT g, sum(o) AS edges, max(o) AS max_out FROM (SELECT g, src, count(*) AS o FROM e GROUP BY g, src) GROUP BY g) e USING (g) LEFT JOIN (SELECT g, count(*) AS roots FROM roots GROUP BY g) r USING (g)
  JOIN (SELECT g, sum(-p * log2(p)) AS bits, count(*) AS kinds FROM (SELECT g, kind, count(*) / sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS p FROM n GROUP BY g, kind) GROUP BY g) k USING (g)"""


def graph_components(spark, sf_dir):
    return graph.components(*nodes_edges(spark, sf_dir))


COMPONENTS_SQL = GRAPH + """, reach AS (SELECT g, id, id AS other FROM n UNION SELECT r.g, r.id, CASE WHEN e.src = r.other THEN e.dst ELSE e.src END FROM reach r JOIN e ON e.g = r.g AND (e.src = r.other OR e.dst = r.other)) SELECT g, id, min(other) AS component FROM reach GROUP BY g, id"""


def _root_paths(spark, sf_dir):
    nodes, edges = nodes_edges(spark, sf_dir)
    return nodes, edges, graph.walks(edges, graph.roots(nodes, edges))


def graph_paths(spark, sf_dir):
    _, _, paths = _root_paths(spark, sf_dir)
    return paths.groupBy("g", "start", "end").agg(F.count("*").alias("paths"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


def mesh(spark, sf_dir):
    """Graphs of 30 nodes: customers in order, each leading to the next, to the fourth after, and in every second graph some back."""
    nodes = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 30).alias("g"), (F.col("c_custkey") % 30).cast("int").alias("id"), F.col("c_nationkey").alias("kind"), F.col("c_custkey").alias("key"), F.round(F.lit(0.5) + F.col("c_custkey") % 5 / 10, 2).alias("confidence"))
    steps = F.array(F.when(F.col("key") % 11 != 3, F.struct(F.lit(1).alias("by"), (F.col("key") % 7 + 1).cast("double").alias("cost"), F.lit(0.05).alias("degradation"))), F.when(F.col("key") % 3 == 0, F.struct(F.lit(4).alias("by"), F.lit(9.0).alias("cost"), F.lit(0.25).alias("degradation"))), F.when((F.col("g") % 2 == 1) & (F.col("key") % 13 == 0), F.struct(F.lit(-6).alias("by"), F.lit(1.0).alias("cost"), F.lit(0.1).alias("degradation"))))
    edges = nodes.select("g", F.col("id").alias("src"), F.explode(F.array_compact(steps)).alias("s")).select("g", "src", (F.col("src") + F.col("s.by")).alias("dst"), "s.cost", "s.degradation")
    there = nodes.select("g", F.col("id").alias("dst"))
    return nodes, edges.join(there, ["g", "dst"], "left_semi").select("g", "src", "dst", "cost", "degradation")


# Distances by growing walks: a pair's first length is its distance; no simple path here has more than 29 edges.
REACH = """WITH RECURSIVE n AS MATERIALIZED (SELECT c_custkey // 30 AS g, (c_custkey % 30)::INT AS id, c_custkey AS key FROM customer),
  e AS MATERIALIZED (SELECT g, src, dst, cost FROM (SELECT g, id AS src, id + 1 AS dst, (key % 7 + 1)::DOUBLE AS cost FROM n WHERE key % 11 <> 3 UNION ALL SELECT g, id, id + 4, 9.0 FROM n WHERE key % 3 = 0 UNION ALL SELECT g, id, id - 6, 1.0 FROM n WHERE g % 2 = 1 AND key % 13 = 0) WHERE (g, dst) IN (SELECT (g, id) FROM n)),
  roots AS (SELECT g, id FROM n WHERE (g, id) NOT IN (SELECT (g, dst) FROM e)),
  walk AS (SELECT g, id AS s, id AS t, 0 AS d FROM n UNION SELECT w.g, w.s, e.dst, w.d + 1 FROM walk w JOIN e ON e.g = w.g AND e.src = w.t WHERE w.d < 29),
  dist AS MATERIALIZED (SELECT g, s, t, min(d) AS d FROM walk GROUP BY ALL)"""


def graph_closeness(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.closeness(nodes, graph.distances(nodes, edges))


def graph_betweenness(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.betweenness(nodes, edges)


# The number of shortest paths of a pair is the sum over its last edges.
BETWEEN_SQL = REACH + """, ways AS MATERIALIZED (WITH RECURSIVE w AS (SELECT g, s, t, d, 1.0::DOUBLE AS k FROM dist WHERE d = 0 UNION ALL SELECT x.g, x.s, x.t, x.d, sum(w.k) FROM w JOIN e ON e.g = w.g AND e.src = w.t JOIN dist x ON x.g = w.g AND x.s = w.s AND x.t = e.dst AND x.d = w.d + 1 GROUP BY x.g, x.s, x.t, x.d) SELECT * FROM w),
  raw AS (SELECT a.g, a.t AS id, sum(a.k * b.k / w.k) AS b FROM ways a JOIN ways b ON b.g = a.g AND b.s = a.t JOIN ways w ON w.g = a.g AND w.s = a.s AND w.t = b.t AND w.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.g, a.t)
  SELECT g, id, round(b / greatest(max(b) OVER (PARTITION BY g), 1) + 1e-9::DOUBLE, 3) AS betweenness FROM (SELECT n.g, n.id, coalesce(b, 0) AS b FROM n LEFT JOIN raw USING (g, id))"""


def resolved_nodes(spark, sf_dir):
    """Returned lines have a value of their own; others take that of the line found up their edges, smallest first."""
    nodes, edges = nodes_edges(spark, sf_dir)
    own = nodes.select("g", "id", F.when(F.col("kind") == "R", F.col("id") * 10).alias("pid"))
    return graph.resolved(own, edges.select("g", "src", "dst", F.col("src").alias("seq")), "pid").where("value is not null")


RESOLVED_SQL = GRAPH + """, walk AS (SELECT g, id, id AS cur, []::INT[] AS path FROM n UNION ALL SELECT w.g, w.id, e.src, list_append(path, e.src::INT) FROM walk w JOIN n x ON x.g = w.g AND x.id = w.cur AND x.kind <> 'R' JOIN e ON e.g = w.g AND e.dst = w.cur)
  SELECT w.g, w.id, arg_min(cur, path) * 10 AS value, arg_min(cur, path) AS source, len(min(path)) AS steps FROM walk w JOIN n ON n.g = w.g AND n.id = w.cur AND n.kind = 'R' GROUP BY w.g, w.id"""


def graph_strong_components(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.strong_components(nodes, edges)


STRONG_SQL = REACH + " SELECT a.g, a.s AS id, min(a.t) AS component FROM dist a JOIN dist b ON b.g = a.g AND b.s = a.t AND b.t = a.s GROUP BY a.g, a.s"


def graph_shape(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.shape(nodes, edges, graph.levels(nodes, edges))


# A node has a level if no cycle leads to it: no node that reaches itself by an edge reaches it.
LEVELS = """, cyclic AS (SELECT DISTINCT a.g, a.t AS id FROM dist a JOIN (SELECT DISTINCT d.g, d.s FROM dist d JOIN e ON e.g = d.g AND e.src = d.t AND e.dst = d.s) c ON c.g = a.g AND c.s = a.s),
  free AS (SELECT g, id FROM n WHERE (g, id) NOT IN (SELECT (g, id) FROM cyclic)),
  climb AS (SELECT g, id, 0 AS level FROM roots UNION SELECT c.g, e.dst, c.level + 1 FROM climb c JOIN e ON e.g = c.g AND e.src = c.id WHERE (e.g, e.dst) IN (SELECT (g, id) FROM free)),
  levels AS MATERIALIZED (SELECT g, id, max(level) AS level FROM climb GROUP BY ALL)"""
SHAPE_SQL = REACH + LEVELS + """ SELECT g, k = m AS acyclic, depth, round(coalesce(b, 0), 6) AS branching FROM (SELECT g, count(*) AS k FROM n GROUP BY g) JOIN (SELECT g, count(*) AS m, max(level) AS depth FROM levels GROUP BY g) USING (g) LEFT JOIN (SELECT g, count(*) / count(DISTINCT src)::DOUBLE AS b FROM e GROUP BY g) USING (g)"""


def graph_levels(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.levels(nodes, edges).where("level is not null")


def graph_dominators(spark, sf_dir):
    return graph.immediate_dominators(*mesh(spark, sf_dir))


# A node dominates another if no way from a root is left without it.
DOMINATED = """, without AS (SELECT n.g, n.id AS gone, r.id FROM n JOIN roots r ON r.g = n.g AND r.id <> n.id UNION SELECT w.g, w.gone, e.dst FROM without w JOIN e ON e.g = w.g AND e.src = w.id WHERE e.dst <> w.gone),
  reached AS (SELECT DISTINCT d.g, d.t AS id FROM dist d JOIN roots r ON r.g = d.g AND r.id = d.s),
  dom AS MATERIALIZED (SELECT a.g, a.id, b.id AS by FROM reached a JOIN reached b ON a.g = b.g WHERE (a.g, b.id, a.id) NOT IN (SELECT (g, gone, id) FROM without)),
  idoms AS MATERIALIZED (SELECT r.g, r.id, x.idom FROM reached r LEFT JOIN (SELECT d.g, d.id, arg_max(d.by, k.k) AS idom FROM dom d JOIN (SELECT g, id, count(*) AS k FROM dom GROUP BY ALL) k ON k.g = d.g AND k.id = d.by WHERE d.id <> d.by GROUP BY d.g, d.id) x USING (g, id))"""


def graph_dominance_frontier(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.tree_frontier(graph.immediate_dominators(nodes, edges), edges)


FRONTIER_SQL = REACH + DOMINATED + " SELECT DISTINCT d.g, d.by AS id, e.dst AS stop FROM e JOIN dom d ON d.g = e.g AND d.id = e.src WHERE (d.g, d.by, e.dst) NOT IN (SELECT (dom.g, dom.by, dom.id) FROM dom WHERE dom.id <> dom.by)"


def graph_dominant_node(spark, sf_dir):
    return graph.dominant(graph.immediate_dominators(*mesh(spark, sf_dir)))


DOMINANT_SQL = REACH + DOMINATED + " SELECT g, arg_max(idom, (n, -idom)) AS dominant, max(n) AS n FROM (SELECT g, idom, count(*) AS n FROM idoms WHERE idom IS NOT NULL GROUP BY ALL) GROUP BY g"


def graph_propagation(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.propagate(nodes, edges, graph.levels(nodes, edges))


def graph_seeded(spark, sf_dir):
    """From the first node of each graph."""
    nodes, edges = mesh(spark, sf_dir)
    return graph.seeded(nodes, edges, nodes.where("id = 0"))


def graph_subgraph(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.subgraph(edges, nodes.where("kind % 2 = 0")).groupBy("g").agg(F.count("*").alias("edges"), F.sum("cost").alias("cost"))


SUBGRAPH_SQL = REACH + ", k AS (SELECT n.g, n.id FROM n JOIN customer ON c_custkey = key WHERE c_nationkey % 2 = 0) SELECT g, count(*) AS edges, sum(cost) AS cost FROM e WHERE (g, src) IN (SELECT (g, id) FROM k) AND (g, dst) IN (SELECT (g, id) FROM k) GROUP BY g"


def graph_confidence_paths(spark, sf_dir):
    """Every path between two nodes of the small graphs with what is left of its start's confidence."""
    nodes, edges = nodes_edges(spark, sf_dir)
    paths = graph.walks(edges.withColumn("cost", F.log1p(-F.col("degradation"))), graph.roots(nodes, edges))
    rows = graph.path_confidence(paths.join(nodes.select("g", F.col("id").alias("start"), "confidence"), ["g", "start"]))
    return rows.select("g", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"), "confidence", "propagated", "lost_pct")


CONFIDENCE_SQL = f"""{GRAPH}, walk AS (SELECT g, id AS start, id AS last, [id] AS nodes, 1.0::DOUBLE AS kept FROM roots UNION ALL SELECT w.g, w.start, e.dst, list_append(w.nodes, e.dst), w.kept * (1 - e.degradation) FROM walk w JOIN e ON e.g = w.g AND e.src = w.last WHERE NOT list_contains(w.nodes, e.dst) AND len(w.nodes) < 11)
  SELECT w.g, array_to_string(nodes, '>') AS path, n.confidence, round(n.confidence * kept + 1e-9::DOUBLE, 4) AS propagated, round((1 - kept) * 100 + 1e-9::DOUBLE, 2) AS lost_pct FROM walk w JOIN n ON n.g = w.g AND n.id = w.start WHERE len(nodes) > 1"""


def temporal_critical_path(spark, sf_dir):
    nodes, edges = mesh(spark, sf_dir)
    return graph.critical_path(nodes, edges, graph.levels(nodes, edges))


# Acyclic graphs are the even ones and those odd ones without a cycle; best paths in order of levels.
CRITICAL_SQL = REACH + LEVELS + """, ok AS (SELECT g FROM n GROUP BY g HAVING count(*) = (SELECT count(*) FROM levels l WHERE l.g = n.g)),
  best AS (SELECT g, id, 0 AS level, 0.0::DOUBLE AS cost, [id] AS nodes FROM roots WHERE g IN (SELECT g FROM ok)
    UNION ALL SELECT b.g, e.dst, b.level + 1, b.cost + e.cost, list_append(b.nodes, e.dst) FROM best b JOIN e ON e.g = b.g AND e.src = b.id)
  SELECT g, array_to_string(arg_max(nodes, (cost, len(nodes), nodes)), '>') AS path, max(cost) AS cost FROM best WHERE len(nodes) > 1 AND (g, id) NOT IN (SELECT (g, src) FROM e) GROUP BY g"""


def graph_diff(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag"))
    return graph.graph_diff(uses.where("l_returnflag = 'A'"), uses.where("l_returnflag = 'N'"), ["src", "dst"])


DIFF_SQL = """WITH u AS (SELECT DISTINCT l_suppkey % 12 AS src, l_partkey % 50 AS dst, l_returnflag AS f FROM lineitem) SELECT coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst, CASE WHEN b.src IS NULL THEN 'added' WHEN a.src IS NULL THEN 'removed' ELSE 'kept' END AS state
  FROM (SELECT * FROM u WHERE f = 'A') b FULL JOIN (SELECT * FROM u WHERE f = 'N') a ON a.src = b.src AND a.dst = b.dst"""


def _predictions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    marks = F.length(F.regexp_replace("text", "[^#*$%&|!]", "")) / F.greatest(F.length("text"), F.lit(1))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (1 - F.col("quality")).alias("actual"), marks.alias("share"), (marks > 0.02).cast("int").alias("predicted"))


PREDICTIONS = "(SELECT doc_id, 1 - quality AS actual, length(regexp_replace(text, '[^#*$%&|!]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS share FROM labels JOIN documents USING (doc_id))"


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir))


CONFUSION_SQL = f"""SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(2 * p * r / (p + r), 6) AS f1, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(fn / (fn + tp)::DOUBLE, 6) AS fnr
  FROM (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM (SELECT count(*) FILTER (WHERE actual = 1 AND share > 0.02) AS tp, count(*) FILTER (WHERE actual = 0 AND share > 0.02) AS fp, count(*) FILTER (WHERE actual = 0 AND share <= 0.02) AS tn, count(*) FILTER (WHERE actual = 1 AND share <= 0.02) AS fn FROM {PREDICTIONS}))"""


def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_predictions(spark, sf_dir), "actual", "share")


AUC_SQL = f"""SELECT count(*) AS n, sum(actual)::BIGINT AS positives, round(sum(CASE WHEN actual = 1 THEN below + ties / 2 END) / (sum(actual) * sum(1 - actual))::DOUBLE, 6) AS auc FROM (SELECT actual, coalesce(sum(1 - actual) OVER (ORDER BY share RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) + 0 * share AS below0, share,
  coalesce(sum(1 - actual) OVER (ORDER BY share), 0) - coalesce(sum(1 - actual) OVER (PARTITION BY share), 0) AS below, coalesce(sum(1 - actual) OVER (PARTITION BY share), 0)::DOUBLE AS ties FROM {PREDICTIONS})"""


def feature_vector(spark, sf_dir):
    caps = {"price": 500_000.0, "lines": 8.0, "quantity": 300.0, "tools": 8.0, "returned": 4.0, "open": 8.0, "taxed": 6.0}
    return builds.features(records(spark, sf_dir), "build", caps)


FEATURE_SQL = f"SELECT build, {', '.join(f'round(least({c} / {x}::DOUBLE, 1), 8) AS {c}' for c, x in {'price': 500000.0, 'lines': 8.0, 'quantity': 300.0, 'tools': 8.0, 'returned': 4.0, 'open': 8.0, 'taxed': 6.0}.items())} FROM {RECORDS}"


def logistic_train_eval(spark, sf_dir):
    """Trains on two thirds of the labelled documents and evaluates on the rest."""
    rows = _predictions(spark, sf_dir).drop("predicted").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3)
    model = learn.train(rows.where("fold <> 0"), ["share"], "actual")
    return evaluate.confusion(learn.predict(model, rows.where("fold = 0"), ["share"]))


def coverage_rollup(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_brand", "p_type", (F.col("p_size") > 25).alias("covered"))
    sets = part.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type")
    return sets.agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") / F.count("*"), 6).alias("share"))


def campaign_summary(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("returned") == 0).alias("passed"), F.round(F.avg("price"), 2).alias("avg_risk"), F.round(F.avg("tools"), 4).alias("avg_coverage"), F.max("ts").alias("last_ts"))


RULES = {"DR-001": "returned > 1", "DR-002": "open > 3", "DR-003": "taxed > 2", "DR-004": "price > 400000", "DR-005": "lines > 6", "DR-006": "tools < lines"}


def redteam_rules_unpivot(spark, sf_dir):
    r = records(spark, sf_dir)
    return builds.detection_rate(builds.rules_fired(r, ["key", "build"], {k: F.expr(v) for k, v in RULES.items()}), r, "key", "build")


REDTEAM_SQL = f"SELECT key, rule, round(hits / n::DOUBLE, 6) AS rate, CASE WHEN hits / n::DOUBLE >= 0.8 THEN 'detected' WHEN hits / n::DOUBLE >= 0.3 THEN 'partial' ELSE 'missed' END AS status FROM (SELECT key, rule, count(DISTINCT build) AS hits FROM ({' UNION ALL '.join(f'''SELECT key, build, '{k}' AS rule FROM {RECORDS} WHERE {v}''' for k, v in RULES.items())}) GROUP BY key, rule) JOIN (SELECT key, count(DISTINCT build) AS n FROM {RECORDS} GROUP BY key) USING (key)"


def blindspot_stats(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupingSets([["priority"], ["status"], []], "priority", "status").agg(F.count("*").alias("total"), F.count_if(F.col("open") > 0).alias("open"), F.count_if(F.col("open") == 0).alias("resolved"))


def multi_author(spark, sf_dir):
    """Nations whose orders come from several market segments, with their five most frequent priorities."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    many = rows.groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("authors")).where("authors >= 2")
    top = rows.groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "o_orderpriority")
    return top.withColumn("rank", F.row_number().over(w)).where("rank <= 5").join(many, "c_nationkey")


MULTI_SQL = """WITH r AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_nationkey, o_orderpriority, n, rank::INT AS rank, authors FROM (SELECT c_nationkey, o_orderpriority, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, o_orderpriority) AS rank FROM (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM r GROUP BY ALL))
  JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS authors FROM r GROUP BY 1 HAVING authors >= 2) USING (c_nationkey) WHERE rank <= 5"""


def ownership_by_author(spark, sf_dir):
    authors = read(spark, sf_dir, "orders").select((F.col("o_orderkey")).alias("file"), (F.col("o_custkey") % 40).alias("author"))
    return supply.ownership(corpus_findings(spark, sf_dir), authors)


OWNER_SQL = f"SELECT author, count(DISTINCT file) AS files, sum(findings)::BIGINT AS findings, sum(risk)::BIGINT AS risk FROM (SELECT DISTINCT o_orderkey AS file, o_custkey % 40 AS author FROM orders) JOIN (SELECT file, count(*) AS findings, max(risk_score) AS risk FROM {FINDINGS} GROUP BY file) USING (file) GROUP BY author"
PATTERNS = ["*", "en", "de/*", "**/1", "fr/**", "**/1?.html", "en/1*.html", "*/9*", "fr/1", "**/html", "d/**", "en/5??"]


def page_paths(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/$", "").alias("path"))


def owned_patterns(spark, sf_dir) -> DataFrame:
    """seq, pattern, owner: fixed patterns of each kind and one for the pages that end in 7 of their own paths."""
    fixed = spark.createDataFrame([(k, p, f"@team{k % 5}") for k, p in enumerate(PATTERNS)], "seq long, pattern string, owner string")
    own = page_paths(spark, sf_dir).where("page_id % 10 = 7 and path <> ''").select((F.col("page_id") + 100).alias("seq"), F.col("path").alias("pattern"), F.concat(F.lit("@own"), F.col("page_id") % 3).alias("owner"))
    return fixed.unionByName(own)


def codeowners_glob_join(spark, sf_dir):
    found = supply.owned(page_paths(spark, sf_dir).where("path <> ''"), owned_patterns(spark, sf_dir))
    return found.groupBy("owner", "pattern").agg(F.countDistinct("path").alias("files"))


def last_owners(spark, sf_dir):
    """The pattern that decides for each path: the last one."""
    return supply.last_owner(supply.owned(page_paths(spark, sf_dir).where("path <> ''"), owned_patterns(spark, sf_dir)))


def team_totals(spark, sf_dir):
    files = page_paths(spark, sf_dir).where("path <> ''")
    author = F.col("page_id") % 7
    totals = files.groupBy(author.alias("author")).agg(F.count("*").alias("findings"), F.sum(F.col("page_id") % 100).alias("risk"))
    authored = files.select("path", author.alias("author")).distinct().join(totals, "author")
    return supply.teams(supply.owned(files, owned_patterns(spark, sf_dir)), authored)


PATH_CTE = "f AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/$', '') AS path FROM pages), files AS (SELECT * FROM f WHERE path <> '')"
OWNED_CTE = f"""{PATH_CTE}, patterns AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}', '@team{k % 5}')" for k, p in enumerate(PATTERNS))}) v(seq, pattern, owner)
  UNION ALL SELECT page_id + 100, path, '@own' || (page_id % 3) FROM files WHERE page_id % 10 = 7),
  owned AS (SELECT DISTINCT path, seq, pattern, owner FROM files JOIN patterns ON CASE WHEN starts_with(pattern, '**/') THEN ends_with(path, substr(pattern, 4)) OR contains(path, '/' || substr(pattern, 4))
    WHEN ends_with(pattern, '/**') THEN starts_with(path, left(pattern, -3)) WHEN contains(pattern, '*') THEN regexp_matches(path, '^' || replace(replace(replace(pattern, '.', '\\.'), '*', '[^/]*'), '?', '.') || '$') ELSE path = pattern OR starts_with(path, pattern || '/') END)"""
GLOB_SQL = f"WITH {OWNED_CTE} SELECT owner, pattern, count(DISTINCT path) AS files FROM owned GROUP BY owner, pattern"
LAST_SQL = f"WITH {OWNED_CTE} SELECT path, arg_max(pattern, seq) AS pattern, arg_max(owner, seq) AS owner FROM owned GROUP BY path"
TEAM_SQL = f"""WITH {OWNED_CTE}, totals AS (SELECT page_id % 7 AS author, count(*) AS findings, sum(page_id % 100) AS risk FROM files GROUP BY 1), authored AS (SELECT DISTINCT path, page_id % 7 AS author FROM files)
  SELECT owner AS team, count(DISTINCT path) AS files, sum(findings)::BIGINT AS findings, sum(risk)::BIGINT AS risk FROM (SELECT DISTINCT owner, path FROM owned) JOIN authored USING (path) JOIN totals USING (author) GROUP BY owner"""


def hosts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("name")).where("name <> ''")


def popular_names(spark, sf_dir) -> DataFrame:
    """Part names, and hosts with two pages or more."""
    many = hosts(spark, sf_dir).groupBy(F.col("name").alias("target")).agg(F.count("*").alias("n")).where("n >= 2").select("target")
    return many.unionByName(read(spark, sf_dir, "part").select(F.col("p_name").alias("target")).distinct())


def typosquat_join(spark, sf_dir):
    names = hosts(spark, sf_dir).select("name").unionByName(read(spark, sf_dir, "part").select(F.expr("substring(p_name, 2)").alias("name")))
    return supply.typosquats(names, popular_names(spark, sf_dir))


def lookalike_join(spark, sf_dir):
    """Hosts written with a look-alike: rn for an m, l for an i, or a letter left out."""
    k = F.col("page_id") % 4
    odd = F.when(k == 0, F.regexp_replace("name", "m", "rn")).when(k == 1, F.translate("name", "l", "i")).when(k == 2, F.expr("substring(name, 2)")).otherwise(F.col("name"))
    return supply.lookalikes(hosts(spark, sf_dir).select(odd.alias("name")), popular_names(spark, sf_dir))


POPULAR_CTE = """h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name FROM pages), hosts AS (SELECT * FROM h WHERE name <> ''),
  popular AS (SELECT DISTINCT lower(target) AS target FROM (SELECT name AS target FROM hosts GROUP BY name HAVING count(*) >= 2 UNION ALL SELECT p_name FROM part))"""
TYPO_SQL = f"""WITH {POPULAR_CTE}, odd AS (SELECT DISTINCT regexp_replace(lower(name), '^@', '') AS name FROM (SELECT name FROM hosts UNION ALL SELECT substring(p_name, 2) FROM part)),
  pairs AS (SELECT name, target, levenshtein(name, target) AS d, greatest(length(name), length(target)) AS n FROM odd, popular WHERE name NOT IN (SELECT target FROM popular) AND abs(length(name) - length(target)) <= 3)
  SELECT * FROM (SELECT name, target, d::INT AS distance, round(1 - d / n::DOUBLE, 2) AS confidence, row_number() OVER (PARTITION BY name ORDER BY d, target)::INT AS rank FROM pairs WHERE d <= CASE WHEN n <= 5 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END) WHERE rank <= 3"""
LETTER_ROWS = ", ".join(f"('{k}', '{x}')" for k, v in supply.LOOKALIKE_LETTERS.items() for x in v)
ALIKE_SQL = f"""WITH {POPULAR_CTE}, odd AS (SELECT DISTINCT lower(CASE page_id % 4 WHEN 0 THEN replace(name, 'm', 'rn') WHEN 1 THEN replace(name, 'l', 'i') WHEN 2 THEN substring(name, 2) ELSE name END) AS name FROM hosts),
  strange AS (SELECT * FROM odd WHERE name <> '' AND name NOT IN (SELECT target FROM popular)), places AS (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM strange),
  forms AS (SELECT name, substring(name, 1, k - 1) || x || substring(name, k + 1) AS target FROM places JOIN (VALUES {LETTER_ROWS}) l(c, x) ON substring(name, k, 1) = c
    UNION SELECT name, substring(name, 1, k - 1) || 'm' || substring(name, k + 2) FROM places WHERE substring(name, k, 2) = 'rn'),
  pairs AS (SELECT name, target, min(d) AS d FROM (SELECT name, target, 0 AS d FROM forms SEMI JOIN popular USING (target) UNION ALL SELECT name, target, levenshtein(name, target) FROM strange, popular WHERE abs(length(name) - length(target)) <= 2) WHERE d <= 2 GROUP BY ALL),
  ranked AS (SELECT *, round(1 - d / greatest(length(name), length(target))::DOUBLE, 2) AS c, row_number() OVER (PARTITION BY name ORDER BY d, target)::INT AS rank FROM pairs)
  SELECT name, target, d::INT AS distance, CASE d WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, first(c) OVER (PARTITION BY name ORDER BY rank) AS confidence, rank FROM ranked QUALIFY rank <= 5"""


def reputation_score(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    r = supply.reputation(rows, F.col("s_acctbal") / 10, F.col("s_nationkey") % 5, F.col("s_acctbal") < 0, F.col("s_nationkey") < 12)
    return r.select("s_suppkey", "score", "label", "factors")


REPUTATION_SQL = """SELECT s_suppkey, score, CASE WHEN score >= 50 THEN 'TRUSTED' WHEN score >= 0 THEN 'NEUTRAL' WHEN score >= -30 THEN 'SUSPICIOUS' ELSE 'DANGEROUS' END AS label, factors FROM (SELECT s_suppkey, CASE WHEN a > 365 THEN 20 ELSE 0 END + CASE WHEN a < 30 THEN -30 ELSE 0 END + CASE WHEN m >= 3 THEN 20 ELSE 0 END + CASE WHEN m <= 1 THEN -10 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN -40 ELSE 0 END + CASE WHEN s_nationkey < 12 THEN 10 ELSE 0 END AS score,
  array_to_string(list_filter([CASE WHEN a > 365 THEN 'old' END, CASE WHEN a < 30 THEN 'new' END, CASE WHEN m >= 3 THEN 'maintained' END, CASE WHEN m <= 1 THEN 'alone' END, CASE WHEN s_acctbal < 0 THEN 'deprecated' END, CASE WHEN s_nationkey < 12 THEN 'described' END], lambda x: x IS NOT NULL), ',') AS factors FROM (SELECT *, s_acctbal / 10 AS a, s_nationkey % 5 AS m FROM supplier))"""


def sbom_enrich(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("string").alias("version"))
    known = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.08").select(F.col("l_partkey").cast("string").alias("name"), (F.col("l_linenumber")).cast("string").alias("version"), F.concat(F.lit("V-"), "l_orderkey").alias("id"), F.round(F.col("l_tax") * 100, 2).alias("score"))
    return supply.bill_of_materials(parts, known)


SBOM_SQL = """SELECT p_partkey::VARCHAR AS name, p_size::VARCHAR AS version, coalesce(ids, '') AS vulnerabilities, coalesce(worst, 0)::DOUBLE AS worst FROM part LEFT JOIN (SELECT l_partkey, l_linenumber, array_to_string(list_sort(list(DISTINCT 'V-' || l_orderkey)), ',') AS ids, max(round(l_tax * 100, 2)) AS worst FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY ALL) ON l_partkey = p_partkey AND l_linenumber = p_size"""

QUERIES = {
    f.__name__: f
    for f in (
        orphan_anti_join, baseline_stats, normality_zscores, baseline_deviation, typical_tools, trend_slope_ewma_cusum, trend_overall, snapshot_direction, trust_dimensions, trust_score_verdict, hermetic_score, input_diff,
        jaccard_similarity, multi_dna_fingerprint, contract_violations, graph_build_edges, graph_stats, graph_components, graph_paths, graph_closeness, graph_betweenness, graph_dominators, graph_propagation,
        resolved_nodes, graph_strong_components, graph_shape, graph_levels, graph_dominance_frontier, graph_dominant_node, graph_seeded, graph_subgraph, graph_confidence_paths, temporal_critical_path, graph_diff, confusion_matrix, roc_auc, feature_vector, logistic_train_eval, coverage_rollup, campaign_summary, redteam_rules_unpivot, blindspot_stats, multi_author, ownership_by_author,
        codeowners_glob_join, last_owners, team_totals, typosquat_join, lookalike_join, reputation_score, sbom_enrich,
    )
}
ORACLE_SQL = {
    "orphan_anti_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "baseline_stats": f"SELECT key, n, {', '.join(f'round({m}_{s}, 6) AS {m}_{s}' for m in MEASURES for s in ('mean', 'std', 'min', 'max'))} FROM {_stats()}",
    "normality_zscores": NORMAL_SQL,
    "baseline_deviation": DEVIATION_SQL,
    "typical_tools": TYPICAL_SQL,
    "trend_slope_ewma_cusum": f"SELECT key, n, round(mean + 1e-8::DOUBLE, 6) AS mean, round(std + 1e-8::DOUBLE, 6) AS std, round(slope + 1e-8::DOUBLE, 6) AS slope, round(ewma + 1e-8::DOUBLE, 6) AS ewma, round(cusum, 6) AS cusum, level FROM {TREND}",
    "trend_overall": OVERALL_SQL,
    "snapshot_direction": DIRECTION_SQL,
    "trust_dimensions": TRUST_SQL,
    "trust_score_verdict": f"SELECT build, score, CASE WHEN score >= 80 THEN 'CLEAN' WHEN score >= 50 THEN 'REVIEW' ELSE 'BLOCK' END AS verdict FROM (SELECT build, greatest(0, least(100, 100 - least(returned * 15.0::DOUBLE, 40) - least(open * 5.0::DOUBLE, 20) - least(taxed * 10.0::DOUBLE, 30) + CASE WHEN status = 'F' THEN 5 ELSE 0 END)) AS score FROM {RECORDS})",
    "hermetic_score": f"SELECT build, greatest(0, least(100, 100 - least(8 * open, 30) - least(5 * returned, 20) - least(10 * taxed, 20) - least(10 * (tools - lines), 40) - CASE WHEN status = 'F' THEN 0 ELSE 15 END - CASE WHEN priority = '1-URGENT' THEN 8 ELSE 0 END))::DOUBLE AS score FROM {RECORDS}",
    "input_diff": INPUT_SQL,
    "jaccard_similarity": JACCARD_SQL,
    "multi_dna_fingerprint": "SELECT l_orderkey, len(items)::INT AS items, substr(sha256(array_to_string(items, '|')), 1, 16) AS dna FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS items FROM lineitem GROUP BY l_orderkey)",
    "contract_violations": CONTRACT_SQL,
    "graph_build_edges": f"SELECT * FROM {EDGES}",
    "graph_stats": STATS_SQL,
    "graph_components": COMPONENTS_SQL,
    "graph_paths": walk_sql("roots") + " SELECT g, start, \"end\", count(*) AS paths, min(length) AS shortest, max(length) AS longest FROM paths GROUP BY ALL",
    "graph_closeness": REACH + " SELECT n.g, n.id, round(coalesce(c, 0), 6) AS closeness FROM n LEFT JOIN (SELECT g, s AS id, count(*) / sum(d)::DOUBLE AS c FROM dist WHERE d > 0 GROUP BY ALL) USING (g, id)",
    "graph_strong_components": STRONG_SQL,
    "resolved_nodes": RESOLVED_SQL,
    "graph_shape": SHAPE_SQL,
    "graph_levels": REACH + LEVELS + " SELECT g, id, level FROM levels",
    "graph_dominance_frontier": FRONTIER_SQL,
    "graph_dominant_node": DOMINANT_SQL,
    "graph_subgraph": SUBGRAPH_SQL,
    "graph_confidence_paths": CONFIDENCE_SQL,
    "graph_betweenness": BETWEEN_SQL,
    "graph_dominators": REACH + DOMINATED + " SELECT g, id, idom FROM idoms",
    "temporal_critical_path": CRITICAL_SQL,
    "graph_diff": DIFF_SQL,
    "confusion_matrix": CONFUSION_SQL,
    "roc_auc": AUC_SQL,
    "feature_vector": FEATURE_SQL,
    "coverage_rollup": "SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS covered, round(count(*) FILTER (WHERE p_size > 25) / count(*)::DOUBLE, 6) AS share FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "campaign_summary": f"SELECT priority, count(*) AS n, count(*) FILTER (WHERE returned = 0) AS passed, round(avg(price), 2) AS avg_risk, round(avg(tools), 4) AS avg_coverage, max(ts) AS last_ts FROM {RECORDS} GROUP BY priority",
    "redteam_rules_unpivot": REDTEAM_SQL,
    "blindspot_stats": f"SELECT priority, status, count(*) AS total, count(*) FILTER (WHERE open > 0) AS open, count(*) FILTER (WHERE open = 0) AS resolved FROM {RECORDS} GROUP BY GROUPING SETS ((priority), (status), ())",
    "multi_author": MULTI_SQL,
    "ownership_by_author": OWNER_SQL,
    "codeowners_glob_join": GLOB_SQL,
    "last_owners": LAST_SQL,
    "team_totals": TEAM_SQL,
    "typosquat_join": TYPO_SQL,
    "lookalike_join": ALIKE_SQL,
    "reputation_score": REPUTATION_SQL,
    "sbom_enrich": SBOM_SQL,
}
