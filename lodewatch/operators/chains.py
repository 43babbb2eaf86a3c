"""The graph of findings, attack chains through it, the scenarios they fit, and how well findings match what was expected.

Findings are rows of one project (`by`) with seq (their order), file, line, subcode, category,
severity, risk_score and contribution. All projects advance together, a joined step a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up, ratio
from ..functions.tables import settle, shuffling
from .rules import AGENT_FILE, WORKFLOW_PATH
from .scan import lookup

# Which subcode enables which other in the same file.
PAIRS = [
    ("SEC-GITHUB-TOKEN", "TOK-001"), ("SEC-GITHUB-TOKEN", "TOK-002"), ("SEC-GITHUB-TOKEN", "TOK-003"), ("SEC-GITHUB-TOKEN", "TOK-004"),
    ("SEC-HARDCODED-TOKEN", "TOK-001"), ("SEC-HARDCODED-TOKEN", "TOK-003"),
    ("TOK-001", "WF-001"), ("TOK-001", "WF-003"), ("TOK-001", "WF-004"),
    ("TOK-002", "WF-002"), ("TOK-002", "WF-004"),
    ("TOK-003", "WF-001"), ("TOK-003", "WF-007"),
    ("TOK-004", "WF-001"), ("TOK-004", "WF-007"),
    ("WF-001", "AS-004"), ("WF-002", "AS-003"), ("WF-002", "AS-005"), ("WF-003", "AS-002"), ("WF-004", "AS-001"), ("WF-004", "AS-008"),
    ("WF-005", "AS-003"), ("WF-006", "AS-004"), ("WF-007", "AS-004"),
]
# The order of categories in one file; others stand with 2.
CATEGORY_ORDER = {"secret": 0, "token": 1, "malware": 1, "vulnerability": 2, "workflow": 2, "generic": 2, "agent": 3}
# Confidence of the three kinds of edges.
CAUSAL, CORRELATED, SAME_FILE = 0.9, 0.5, 0.3
#: Findings of a chain, at most; a documented bound on a listing of all paths.
LONGEST = 6

# Scenarios in the order of the test. Each has sets of subcodes of which one must occur,
# categories that must all occur, and the most findings of a chain (0: any number).
LIFECYCLE = ["LIF-CURL-BASH", "LIF-SHELL", "LIF-OBFUSCATED"]
SUBSTITUTION = ["GYP-SUBSTITUTION", "GYP-DOWNLOADER"]
SCENARIOS = [
    ("SCE-005", "Pull Request Comment Injection", [["WF-007"], ["AS-003", "AS-004"]], [], 0),
    ("SCE-008", "Workflow Self-Modification", [["WF-004"], ["AS-001", "AS-008"]], [], 0),
    ("SCE-009", "Root Privilege Agent Escape", [["WF-002"], ["AS-005"]], [], 0),
    ("SCE-002", "Supply Chain Injection", [LIFECYCLE + SUBSTITUTION, ["WF-001", "WF-002", "WF-003", "WF-004"]], [], 0),
    ("SCE-003", "Secret-Driven Privilege Escalation", [["TOK-001", "TOK-002", "TOK-003"], ["WF-001", "WF-002", "WF-003", "WF-007"]], ["secret"], 0),
    ("SCE-001", "Full Pipeline Takeover", [], ["secret", "token", "workflow", "agent"], 0),
    ("SCE-007", "Obfuscated Payload Delivery", [["OBF-PAYLOAD"], LIFECYCLE], [], 0),
    ("SCE-004", "Agent Policy Bypass via Workflow", [], ["workflow", "agent"], 0),
    ("SCE-010", "Dependency Confusion via Build Hooks", [[*SUBSTITUTION, "GYP-FILE"]], [], 0),
    ("SCE-006", "Credential Harvesting", [], ["secret"], 2),
]
# What to do about a scenario's evidence, by the subcode's beginning.
REMEDIES = [("SEC-", "rotate the credential"), ("TOK-", "narrow the token's permissions"), ("WF-", "restrict the workflow"), ("AS-", "review the agent's instructions"), ("LIF-", "remove the install script"), ("GYP-", "audit the native build")]


def is_workflow(file: Column) -> Column:
    return file.rlike(WORKFLOW_PATH)


def is_agent_file(file: Column) -> Column:
    return F.element_at(F.split(file, r"[/\\]"), -1).rlike(AGENT_FILE)


def with_contribution(findings: DataFrame, cards: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds each finding's contribution: that of its subcode's lowest card, 0 without one."""
    last = cards.groupBy(*by, "subcode").agg(F.max_by("contribution", "rank").alias("contribution"))
    return findings.join(last, [*by, "subcode"], "left").withColumn("contribution", F.coalesce("contribution", F.lit(0)))


def finding_edges(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, src, dst (both seq), kind, confidence: causal, correlated and same-workflow edges, each pair once.

    Causal: from a subcode to the best finding of one it enables, in the same file. Correlated: to
    the next finding of the file in the order of categories. Same-file: between the two best
    findings each of two workflow files, if their subcodes differ. "Best" is by contribution, ties
    by order.
    """
    by = list(by)
    spark = nodes.sparkSession
    pairs = F.broadcast(spark.createDataFrame(PAIRS, "subcode string, target string"))  # a fixed table
    source = nodes.select(*by, "file", "subcode", F.col("seq").alias("src")).join(pairs, "subcode")
    target = nodes.select(*by, "file", F.col("subcode").alias("target"), "contribution", F.col("seq").alias("dst"))
    first = target.groupBy(*by, "file", "target").agg(F.min_by("dst", F.struct(-F.col("contribution"), "dst")).alias("dst"))
    causal = source.join(first, [*by, "file", "target"]).select(*by, "src", "dst", F.lit("causal").alias("kind"), F.lit(CAUSAL).alias("confidence"))
    order = Window.partitionBy(*by, "file").orderBy(lookup(F.col("category"), CATEGORY_ORDER, 2), "seq")
    after = nodes.select(*by, F.col("seq").alias("src"), F.lead("seq").over(order).alias("dst")).where("dst is not null")
    correlated = after.join(causal.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti").select(*by, "src", "dst", F.lit("correlated").alias("kind"), F.lit(CORRELATED).alias("confidence"))
    best = Window.partitionBy(*by, "file").orderBy(F.desc("contribution"), "seq")
    tops = nodes.where(is_workflow(F.col("file"))).withColumn("place", F.row_number().over(best)).where("place <= 2")
    seen = tops.join(nodes.groupBy(*by, "file").agg(F.min("seq").alias("file_seq")), [*by, "file"])
    a = seen.select(*by, F.col("seq").alias("src"), F.col("subcode").alias("sub_a"), F.col("file_seq").alias("at_a"))
    b = seen.select(*by, F.col("seq").alias("dst"), F.col("subcode").alias("sub_b"), F.col("file_seq").alias("at_b"))
    across = a.join(b, by).where("at_a < at_b and sub_a <> sub_b").select(*by, "src", "dst", F.lit("same_file").alias("kind"), F.lit(SAME_FILE).alias("confidence"))
    return causal.unionByName(correlated).unionByName(across)


def severity(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 30, "HIGH").when(score >= 10, "MEDIUM").otherwise("LOW")


@shuffling
def attack_chains(nodes: DataFrame, edges: DataFrame, by: Sequence[str], longest: int = LONGEST) -> DataFrame:
    """by, nodes (seqs), length, confidence, score, severity: simple paths from findings that no causal edge enters.

    Every beginning of two findings or more of a path is a chain; its confidence is the product of
    its edges', its score the worst finding's, less for short chains.
    """
    by = list(by)
    nodes = settle(nodes.select(*by, "seq", "risk_score"))
    edges = settle(edges)
    entered = edges.where("kind = 'causal'").select(*by, F.col("dst").alias("seq")).distinct()
    walk = nodes.join(entered, [*by, "seq"], "left_anti").select(*by, F.col("seq").alias("last"), F.array("seq").alias("nodes"), F.lit(1.0).alias("confidence"), F.col("risk_score").alias("worst"))
    onward = edges.select(*by, F.col("src").alias("last"), "dst", F.col("confidence").alias("step")).join(nodes.select(*by, F.col("seq").alias("dst"), F.col("risk_score").alias("dst_risk")), [*by, "dst"])
    onward = settle(onward)
    levels = []
    for _ in range(longest - 1):
        joined = walk.join(onward, [*by, "last"]).where(~F.array_contains("nodes", F.col("dst")))
        walk = settle(joined.select(*by, F.col("dst").alias("last"), F.array_append("nodes", F.col("dst")).alias("nodes"), (F.col("confidence") * F.col("step")).alias("confidence"), F.greatest("worst", "dst_risk").alias("worst")))
        levels.append(walk)
        if walk.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, levels)
    n = F.size("nodes")
    confidence = F.round("confidence", 9)
    score = half_up(F.least(F.lit(100.0), F.col("worst") * confidence * F.least(n / 3.0, F.lit(1.0)))).cast("int")
    return rows.select(*by, "nodes", n.alias("length"), confidence.alias("confidence"), score.alias("score"), severity(score).alias("severity"))


def chain_findings(chains: DataFrame, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """chains with the arrays subcodes, categories and files of their findings, in their order."""
    by = list(by)
    chains = chains.withColumn("chain", F.array_join(F.col("nodes").cast("array<string>"), ">"))
    each = chains.select(*by, "chain", F.posexplode("nodes").alias("pos", "seq")).join(nodes.select(*by, "seq", "subcode", "category", "file"), [*by, "seq"])
    listed = each.groupBy(*by, "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "subcode", "category", "file"))).alias("found"))  # a chain's findings
    return chains.join(listed, [*by, "chain"]).withColumns({f"{c}s" if c != "category" else "categories": F.col(f"found.{c}") for c in ("subcode", "category", "file")}).drop("found", "chain")


def scenarios(chains: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first scenario that each chain fits; chains have subcodes, categories and files."""
    fit = F.lit(None).cast("struct<id:string,name:string>")
    for id_, name, sets, categories, most in reversed(SCENARIOS):
        conditions = [F.arrays_overlap("subcodes", F.array(*map(F.lit, one))) for one in sets] + [F.array_contains("categories", c) for c in categories]
        if most:
            conditions.append(F.size("subcodes") <= most)
        fit = F.when(reduce(lambda x, y: x & y, conditions), F.struct(F.lit(id_).alias("id"), F.lit(name).alias("name"))).otherwise(fit)
    return chains.withColumn("fit", fit).where("fit is not null").select(*by, F.col("fit.id").alias("scenario"), F.col("fit.name").alias("name"), "nodes", "subcodes", "files", "length", "confidence", "score", "severity")


def evidence_packs(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per scenario: its chains, best score, distinct files and subcodes, and what to do about them."""
    by = list(by)
    each = found.select(*by, "scenario", "score", F.explode(F.arrays_zip("subcodes", "files")).alias("f"))
    packs = each.groupBy(*by, "scenario").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("f.subcodes")).alias("subcodes"), F.countDistinct("f.files").alias("files"))
    begins = lambda start: F.exists("subcodes", lambda x: x.startswith(start))
    steps = F.array(*[F.when(begins(start), F.lit(text)) for start, text in REMEDIES])
    chains_ = found.groupBy(*by, "scenario").agg(F.count("*").alias("chains"))
    return packs.join(chains_, [*by, "scenario"]).select(*by, "scenario", "chains", "score", "files", F.array_join("subcodes", ",").alias("subcodes"), F.array_join(F.array_compact(steps), "; ").alias("remedy"))


def snapshot_tops(chains: DataFrame, by: Sequence[str], most: int = 5) -> DataFrame:
    """The best chains of each project by score, then confidence; a top-k report. Ties by their findings."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("confidence"), F.array_join(F.col("nodes").cast("array<string>"), ">"))
    return chains.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def precision_recall(rows: DataFrame) -> DataFrame:
    """file, precision, recall from arrays expected and found."""
    found = F.coalesce("found", F.array().cast("array<string>"))
    hit = F.size(F.array_intersect("expected", found))
    return rows.select("file", F.round(ratio(hit, F.size(found)), 6).alias("precision"), F.round(ratio(hit, F.size("expected")), 6).alias("recall"))
