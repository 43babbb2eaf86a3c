"""Scanning bound to documents, pages, conversations, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy
from ..operators import chains, scan
from ..operators.rules import CATEGORY_WEIGHT, LINE_RULES, SEVERITY_RANK, TOKEN_KINDS, UNKNOWN_TOKEN, Rule
from .tables import read

# The corpus is prose, so besides the security rules these broader ones give it findings.
CORPUS_RULES = [
    Rule("TEXT", "TXT-EMAIL", "secrets", "EXFILTRATION", "HIGH", "high", 70, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"),
    Rule("TEXT", "TXT-IP", "malware", "SUSPICIOUS", "MEDIUM", "high", 50, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    Rule("TEXT", "TXT-SHOUT", "obfuscation", "SUSPICIOUS", "HIGH", "medium", 65, r"!! [A-Z]{3,}"),
    Rule("TEXT", "TXT-TABLE", "supply-chain", "NEUTRAL", "LOW", "medium", 15, r"[a-z] \| [a-z]"),
    Rule("TEXT", "WF-MARKUP", "workflow", "SUSPICIOUS", "MEDIUM", "high", 40, r"\$\$\$ "),
    Rule("TEXT", "TOK-TEXT", "token", "EXFILTRATION", "CRITICAL", "high", 90, r"[Tt]oken = \"[0-9a-f]{16,}\""),
]
PAGE_RULES = [
    Rule("DOM_INJECTION", "DOM-SCRIPT", "injection", "SUSPICIOUS", "MEDIUM", "high", 40, r"<script"),
    Rule("DOM_INJECTION", "DOM-HANDLER", "injection", "SUSPICIOUS", "HIGH", "high", 60, r" on[a-z]+=[\"']"),
    Rule("DOM_INJECTION", "DOM-IFRAME", "injection", "SUSPICIOUS", "HIGH", "high", 65, r"<iframe"),
    Rule("NETWORK_ACTIVITY", "DOM-TRACK", "malware", "NEUTRAL", "LOW", "medium", 15, r"track\([0-9]+\)"),
    Rule("NETWORK_ACTIVITY", "DOM-REMOTE", "malware", "NEUTRAL", "LOW", "medium", 15, r"(src|href)=\"https?://"),
    *[r for r in LINE_RULES if r.subcode in ("SAST-EVAL", "SAST-DOM", "SEC-HARDCODED-TOKEN")],
]
AGENT_TEXT = [
    Rule("AGENT_RISK", "AS-TEXT-1", "agent", "MALICIOUS", "HIGH", "high", 70, r"(?i)ignore (all|the|previous)"),
    Rule("AGENT_RISK", "AS-TEXT-2", "agent", "SUSPICIOUS", "MEDIUM", "medium", 40, r"(?i)password|token"),
    Rule("AGENT_RISK", "AS-TEXT-3", "agent", "SUSPICIOUS", "LOW", "medium", 20, r"(?i)\?$"),
]


def quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def lines_sql(table: str, text: str, *keys: str) -> str:
    named = ", ".join(keys)
    return f"(SELECT {named}, line, content FROM (SELECT {named}, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT {named}, string_split({text}, chr(10)) AS l FROM {table})))"


def match_sql(lines: str, rules: list[Rule], keys: str, condition=None, more: str = "") -> str:
    """Rows of `lines` with each rule whose condition (by default: its pattern is in content) holds."""
    condition = condition or (lambda r: f"regexp_matches(content, {quoted(r.pattern)})")
    cases = ", ".join(f"CASE WHEN {condition(r)} THEN {i} END" for i, r in enumerate(rules))
    values = ", ".join(f"({i}, {', '.join(quoted(x) for x in (r.kind, r.subcode, r.category, r.intent, r.severity, r.confidence))}, {r.score})" for i, r in enumerate(rules))
    return f"""(SELECT {keys}, r.type, r.subcode, r.category, r.intent, r.severity, r.confidence, r.risk_score{more}
      FROM (SELECT *, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule_no FROM {lines}) h
      JOIN (VALUES {values}) r(i, type, subcode, category, intent, severity, confidence, risk_score) ON r.i = h.rule_no)"""


def documents(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "source", "text")


def corpus_findings(spark, sf_dir: str) -> DataFrame:
    return scan.match(scan.lines(documents(spark, sf_dir), "text", "file", "source"), CORPUS_RULES)


DOCS = "(SELECT doc_id AS file, source, text FROM documents)"
FINDINGS = match_sql(lines_sql(DOCS, "text", "file", "source"), CORPUS_RULES, "file, source, line")
RANK_SQL = "CASE severity " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in SEVERITY_RANK.items()) + " END"
WEIGHT_SQL = "CASE category " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in CATEGORY_WEIGHT.items()) + " ELSE 1.0 END"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY source ORDER BY risk_score DESC, file, line, subcode) AS rank FROM {FINDINGS} WHERE risk_score > 0)"
PART = f"floor(risk_score * pow(0.5, rank - 1) * ({WEIGHT_SQL})::DOUBLE + 0.5)"
CORRELATIONS = f"""(
  SELECT source, 'spread:' || category AS name, -5 * (count(DISTINCT file) - 1) AS adjustment FROM {FINDINGS} GROUP BY source, category HAVING count(DISTINCT file) >= 2
  UNION ALL SELECT source, 'supply+obfuscation', -12 FROM {FINDINGS} GROUP BY source HAVING bool_or(category IN ('supply-chain', 'token')) AND bool_or(category = 'obfuscation')
  UNION ALL SELECT source, 'obfuscation+malware', -10 FROM {FINDINGS} GROUP BY source HAVING bool_or(category = 'malware') AND bool_or(category = 'obfuscation')
  UNION ALL SELECT source, 'workflow', -9 FROM {FINDINGS} GROUP BY source HAVING count(*) FILTER (WHERE subcode LIKE 'WF-%' OR subcode LIKE 'TOK-%') >= 2
  UNION ALL SELECT source, 'mixed:' || file, -10 FROM {FINDINGS} GROUP BY source, file HAVING count(DISTINCT category) >= 3)"""
SCORES = f"""(SELECT source, score, CASE WHEN score >= 70 THEN 'BLOCK' WHEN score >= 30 THEN 'REVIEW' ELSE 'PASS' END AS verdict,
    CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS blast
  FROM (SELECT source, greatest(0, least(100, base + __EXTRA__))::INT AS score FROM (SELECT source, sum({PART}) AS base FROM {RANKED} WHERE rank <= 10 GROUP BY source)
  LEFT JOIN (SELECT source, sum(adjustment) AS extra FROM {CORRELATIONS} GROUP BY source) USING (source)))"""
ADJUSTED, PLAIN = SCORES.replace("__EXTRA__", "coalesce(extra, 0)"), SCORES.replace("__EXTRA__", "0")


def scan_lines_findings(spark, sf_dir):
    return scan.match(scan.lines(documents(spark, sf_dir), "text", "file"), LINE_RULES)


def scan_corpus_findings(spark, sf_dir):
    return corpus_findings(spark, sf_dir)


def scan_token_findings(spark, sf_dir):
    rows = scan.lines(documents(spark, sf_dir), "text", "file").withColumn("token", F.regexp_extract("content", r"[Tt]oken = \"([^\"]+)\"", 1)).where("token <> ''")
    return rows.select("file", "line", "token", scan.token_class(F.col("token")).alias("t")).select("file", "line", F.length("token").alias("n"), "t.kind", "t.score")


def token_cases(value: str, field: str) -> str:
    show = lambda t: t.score if field == "score" else quoted(t[TOKEN_FIELDS.index(field)])
    return f"CASE {' '.join(f'WHEN regexp_matches(trim({value}), {quoted(t.pattern)}) THEN {show(t)}' for t in TOKEN_KINDS)} ELSE {show(UNKNOWN_TOKEN)} END"


TOKEN_FIELDS = ("kind", "provider", "score", "confidence")
TOKEN_SQL = f"""SELECT file, line, length(token)::INT AS n, {token_cases('token', 'kind')} AS kind, {token_cases('token', 'score')} AS score
  FROM (SELECT file, line, regexp_extract(content, '[Tt]oken = "([^"]+)"', 1) AS token FROM {lines_sql(DOCS, 'text', 'file')}) WHERE token <> ''"""


def scan_entropy_size(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bits = entropy(F.col("text"))
    return docs.select("file", F.round(bits, 6).alias("entropy"), (bits > 6.0).alias("dense"), (F.length("text") > 500_000).alias("large"))


ENTROPY_SQL = f"""SELECT d.file, round(coalesce(e.bits, 0), 6) AS entropy, coalesce(e.bits, 0) > 6.0 AS dense, length(d.text) > 500000 AS large
  FROM {DOCS} d LEFT JOIN (SELECT file, entropy(c) AS bits FROM (SELECT file, unnest(string_split(text, '')) AS c FROM {DOCS}) GROUP BY file) e USING (file)"""


def scan_pages_dom(spark, sf_dir):
    return scan.match(scan.lines(read(spark, sf_dir, "pages"), "html", "page_id"), PAGE_RULES)


def scan_agent_phrases(spark, sf_dir):
    return scan.match(scan.lines(read(spark, sf_dir, "conversations"), "text", "conv_id", "turn"), [r for r in LINE_RULES if r.category == "agent"] + AGENT_TEXT)


def semantic_filter_flags(spark, sf_dir):
    rows = scan.lines(read(spark, sf_dir, "pages"), "html", "page_id", "url")
    flagged = scan.semantic_flags(rows, F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), F.col("content"))
    return flagged.groupBy("page_id").agg(*[F.count_if(c).alias(c) for c in ("in_test", "is_definition", "harmless_env", "is_comment")])


SEMANTIC_SQL = f"""SELECT page_id,
  count(*) FILTER (WHERE regexp_matches(lower(regexp_replace(url, '^[a-z]+://[^/]*/', '')), '(^|/)(tests?|__tests__|fixtures|spec)/|\\.(test|spec)\\.[a-z]+$')) AS in_test,
  count(*) FILTER (WHERE regexp_matches(content, '(regex|pattern|rule)s?\\s*[:=]')) AS is_definition,
  count(*) FILTER (WHERE regexp_matches(content, 'process\\.env\\.(NODE_ENV|CI|PATH|HOME)\\b')) AS harmless_env,
  count(*) FILTER (WHERE regexp_matches(trim(content), '^(//|#|\\*|/\\*)')) AS is_comment
  FROM {lines_sql('pages', 'html', 'page_id', 'url')} GROUP BY page_id"""


def agency_score_by_source(spark, sf_dir):
    return scan.agency_score(corpus_findings(spark, sf_dir), ["source"], adjust=False)


def agency_score_adjusted(spark, sf_dir):
    return scan.agency_score(corpus_findings(spark, sf_dir), ["source"])


def category_file_correlation(spark, sf_dir):
    return scan.correlations(corpus_findings(spark, sf_dir), ["source"])


def evidence_cards_top(spark, sf_dir):
    return scan.evidence_cards(corpus_findings(spark, sf_dir), ["source"])


def policy_gate(spark, sf_dir):
    found = corpus_findings(spark, sf_dir)
    return scan.policy(found, scan.agency_score(found, ["source"], adjust=False), ["source"])


def finding_delta_new_fixed(spark, sf_dir):
    """Two states of a code base: every pair of documents stands for one file before and after."""
    found = corpus_findings(spark, sf_dir).withColumn("side", F.col("file") % 2).withColumn("file", F.floor(F.col("file") / 2))
    return scan.finding_delta(found.where("side = 0"), found.where("side = 1"))


DELTA = f"(SELECT DISTINCT subcode, file // 2 AS file, line, file % 2 AS side FROM {FINDINGS})"
DELTA_SQL = f"""WITH f AS {DELTA} SELECT 'new' AS state, subcode, file, line FROM (SELECT subcode, file, line FROM f WHERE side = 1 EXCEPT SELECT subcode, file, line FROM f WHERE side = 0)
  UNION ALL SELECT 'fixed', subcode, file, line FROM (SELECT subcode, file, line FROM f WHERE side = 0 EXCEPT SELECT subcode, file, line FROM f WHERE side = 1)"""


def top_findings_global(spark, sf_dir):
    return scan.top_findings(corpus_findings(spark, sf_dir), 50).select("file", "line", "subcode", "severity", "risk_score")


def benchmark_precision_recall(spark, sf_dir):
    """Expected subcodes (from the benchmark texts, by length) against those found in the document of the same number."""
    expected = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.when(F.length("text") > 200, F.array(F.lit("TXT-EMAIL"), F.lit("TXT-IP"))).otherwise(F.array(F.lit("TXT-TABLE"))).alias("expected"))
    found = corpus_findings(spark, sf_dir).groupBy("file").agg(F.collect_set("subcode").alias("found"))
    return chains.precision_recall(expected.join(found, "file", "left"))


BENCHMARK_SQL = f"""SELECT file, round(CASE WHEN nf = 0 THEN 0 ELSE hit / nf END, 6) AS precision, round(CASE WHEN ne = 0 THEN 0 ELSE hit / ne END, 6) AS recall FROM (
  SELECT e.file, len(expected)::DOUBLE AS ne, len(coalesce(f.found, []))::DOUBLE AS nf, len(list_intersect(expected, coalesce(f.found, [])))::DOUBLE AS hit
  FROM (SELECT item_id AS file, CASE WHEN length(text) > 200 THEN ['TXT-EMAIL', 'TXT-IP'] ELSE ['TXT-TABLE'] END AS expected FROM benchmark) e
  LEFT JOIN (SELECT file, list(DISTINCT subcode) AS found FROM {FINDINGS} GROUP BY file) f USING (file))"""


QUERIES = {
    f.__name__: f
    for f in (
        scan_lines_findings, scan_corpus_findings, scan_token_findings, scan_entropy_size, scan_pages_dom, scan_agent_phrases, semantic_filter_flags, agency_score_by_source,
        agency_score_adjusted, category_file_correlation, evidence_cards_top, policy_gate, finding_delta_new_fixed, top_findings_global, benchmark_precision_recall,
    )
}
ORACLE_SQL = {
    "scan_lines_findings": f"SELECT * FROM {match_sql(lines_sql(DOCS, 'text', 'file'), LINE_RULES, 'file, line')}",
    "scan_corpus_findings": f"SELECT * FROM {FINDINGS}",
    "scan_token_findings": TOKEN_SQL,
    "scan_entropy_size": ENTROPY_SQL,
    "scan_pages_dom": f"SELECT * FROM {match_sql(lines_sql('pages', 'html', 'page_id'), PAGE_RULES, 'page_id, line')}",
    "scan_agent_phrases": f"SELECT * FROM {match_sql(lines_sql('conversations', 'text', 'conv_id', 'turn'), [r for r in LINE_RULES if r.category == 'agent'] + AGENT_TEXT, 'conv_id, turn, line')}",
    "semantic_filter_flags": SEMANTIC_SQL,
    "agency_score_by_source": f"SELECT * FROM {PLAIN}",
    "agency_score_adjusted": f"SELECT * FROM {ADJUSTED}",
    "category_file_correlation": f"SELECT source, name, adjustment::BIGINT AS adjustment FROM {CORRELATIONS}",
    "evidence_cards_top": f"SELECT source, file, line, subcode, rank, {PART}::INT AS contribution FROM {RANKED} WHERE rank <= 10",
    "policy_gate": f"""SELECT s.source, score, score >= 70 OR w.critical OR verdict = 'BLOCK' AS failed,
      array_to_string(list_filter([CASE WHEN score >= 70 THEN 'score' END, CASE WHEN w.critical THEN 'critical' END, CASE WHEN verdict = 'BLOCK' THEN 'verdict' END], lambda x: x IS NOT NULL), ';') AS reasons
      FROM {PLAIN} s LEFT JOIN (SELECT source, bool_or(severity = 'CRITICAL') AS critical FROM {FINDINGS} GROUP BY source) w USING (source)""",
    "finding_delta_new_fixed": DELTA_SQL,
    "top_findings_global": f"SELECT file, line, subcode, severity, risk_score FROM {FINDINGS} ORDER BY {RANK_SQL} DESC, risk_score DESC, file, line, subcode LIMIT 50",
    "benchmark_precision_recall": BENCHMARK_SQL,
}
