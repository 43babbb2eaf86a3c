"""Line scanning: texts become lines, lines become findings, findings become scores.

A finding is a row (file, line, subcode, category, severity, confidence, risk_score). Rules are
tested inside one projection of each line; no text meets the rules by a join.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import bounded, half_up
from ..functions.tables import settle
from ..functions.text import basename, entropy
from .rules import (
    BINARY_CHANGE, CATEGORY_WEIGHT, DENSE_BITS, ENTROPY_RULE, LARGE_CHARACTERS, LINE_RULES, NAME_RULES, PERMISSION_SCORES, SEVERITY_RANK, SIZE_RULE, TOKEN_KINDS, TOKEN_LEVELS, TOKEN_VALUES,
    UNKNOWN_TOKEN, WORKFLOW_PATH, WORKFLOW_TOKENS, Rule,
)

#: A pattern that begins with a repeated character class.
REPEATED_START = re.compile(r"^(\[(?:\\.|[^\[\]\\])+\])\+(?![+?])")


def lookup(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK, 0)


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, line (from 1), content: the text split at \\n, each line whole."""
    split = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    return split.select(*keys, (F.col("line") + 1).alias("line"), "content")


def tested(pattern: str) -> str:
    """A pattern that is met by the same lines, without the first class's repetition.

    Where `x+y` is met, `xy` is too, from the last x on; a long run of x then costs no square time.
    """
    return REPEATED_START.sub(r"\1", pattern)


def needed(pattern: str) -> list[str]:
    """Texts of which a line that meets the pattern holds at least one, in lower case; none where nothing of three letters is sure.

    Only what must stand is taken: runs of plain characters, and alternatives all of which have such a run.
    """

    def best(parts) -> list[str]:
        found, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind is sre.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            found, run = [*found, [run]], ""
            if kind is sre.SUBPATTERN:
                found.append(best(value[-1]))
            elif kind is sre.BRANCH:
                each = [best(one) for one in value[1]]
                found.append([x for one in each for x in one] if all(each) else [])
            elif kind is sre.MAX_REPEAT and value[0] > 0:
                found.append(best(value[-1]))
        return max((f for f in found if f and min(map(len, f)) > 2), key=lambda f: min(map(len, f)), default=[])

    return sorted(set(best(sre.parse(pattern.replace(r"\z", "$")))))


def may_meet(low: str, pattern: str) -> Column:
    """Whether a line in lower case holds what the pattern needs; a plain search that spares most lines the pattern itself."""
    return reduce(lambda x, y: x | y, [F.contains(F.col(low), F.lit(t)) for t in needed(pattern)], F.lit(False)) if needed(pattern) else F.lit(True)


def match(rows: DataFrame, rules: Sequence[Rule], content: str = "content", snippet: bool = False) -> DataFrame:
    """A finding for every rule that a line meets, once per line and rule; with the line's first 150 characters on request."""
    hits = F.array(
        *[
            F.when(
                may_meet("__low", r.pattern) & F.col(content).rlike(tested(r.pattern)),
                F.struct(
                    F.lit(r.kind).alias("type"), F.lit(r.subcode).alias("subcode"), F.lit(r.category).alias("category"), F.lit(r.intent).alias("intent"),
                    F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.score).alias("risk_score"),
                    *([F.lit(i).alias("rule_no")] if snippet else []),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    keys = [c for c in rows.columns if c != content]
    if snippet:
        rows, keys = rows.withColumn("snippet", F.substring(content, 1, 150)), [*keys, "snippet"]
    low = rows.withColumn("__low", F.lower(content))
    return low.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit")).select(*keys, "hit.*")


def patch_lines(df: DataFrame, patch: str, *keys: str) -> DataFrame:
    """keys, line, content of the added lines of a unified diff.

    A hunk header sets the line; context and added lines advance it, removed lines do not.
    """
    raw = df.select(*keys, F.posexplode(F.split(F.col(patch), "\n")).alias("pos", "content"))
    start = F.regexp_extract("content", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    raw = raw.withColumn("start", F.when(F.col("content").startswith("@@"), start.cast("int")))
    w = Window.partitionBy(*keys).orderBy("pos")
    raw = raw.withColumn("hunk", F.count("start").over(w)).withColumn("start", F.last("start", True).over(w))
    moves = (~F.col("content").startswith("-")) & (~F.col("content").startswith("@@"))
    raw = raw.withColumn("line", F.col("start") - 1 + F.sum(F.when(moves, 1).otherwise(0)).over(Window.partitionBy(*keys, "hunk").orderBy("pos")))
    added = F.col("content").startswith("+") & ~F.col("content").startswith("+++")
    return raw.where(added & (F.col("hunk") > 0)).select(*keys, F.col("line").cast("int").alias("line"), F.trim(F.substr("content", F.lit(2))).alias("content"))


def by_name(path: Column, pattern: str) -> Column:
    """Whether the base name, in lower case, meets the pattern; the whole path where the pattern has a folder."""
    return (path if "workflows" in pattern else F.lower(basename(path))).rlike(pattern)


def file_name_findings(df: DataFrame, path: str, *keys: str, patch: bool = True) -> DataFrame:
    """Findings that the name alone gives; whole files are not tested for credential and key names.

    A patch of binding.gyp is a build file and no further integration; a whole one is both.
    """
    rules = [r for r in NAME_RULES if patch or r.subcode not in ("SEC-CREDS-FILE", "SEC-SSH-FILE")]
    one = lambda r: by_name(F.col(path), r.pattern) & (F.lower(basename(F.col(path))) != "binding.gyp" if patch and r.subcode == "GYP-NODE" else F.lit(True))
    hits = F.array(*[F.when(one(r), rule_struct(r, i)) for i, r in enumerate(rules)])
    return df.select(*keys, path, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit")).select(*keys, path, "hit.*")


def rule_struct(r: Rule, i: int) -> Column:
    named = {"type": r.kind, "subcode": r.subcode, "category": r.category, "intent": r.intent, "severity": r.severity, "confidence": r.confidence, "risk_score": r.score, "rule_no": i}
    return F.struct(*[F.lit(v).alias(k) for k, v in named.items()])


def token_level(score: Column) -> Column:
    out = F.lit("LOW")
    for level, least in sorted(TOKEN_LEVELS, key=lambda x: x[1]):
        out = F.when(score >= least, level).otherwise(out)
    return out


def token_class(token: Column) -> Column:
    """struct(kind, provider, score, level, confidence) of a secret by its form, in order; unknown scores 0."""
    cases = lambda t: F.struct(F.lit(t.kind).alias("kind"), F.lit(t.provider).alias("provider"), F.lit(t.score).alias("score"), token_level(F.lit(t.score)).alias("level"), F.lit(t.confidence).alias("confidence"))
    found = cases(UNKNOWN_TOKEN)
    for t in reversed(TOKEN_KINDS):
        found = F.when(F.trim(token).rlike(t.pattern), cases(t)).otherwise(found)
    return found


def token_score(base: Column, permissions: Column) -> Column:
    """The base score with what each permission adds, from 0 to 100."""
    extra = F.aggregate(permissions, F.lit(0), lambda acc, p: acc + lookup(p, PERMISSION_SCORES, 0))
    return bounded(base + extra).cast("int")


def with_token_findings(findings: DataFrame, phase: int) -> DataFrame:
    """The findings, and a further one, of its own phase, for each secret whose token has a known form; findings have type, snippet and phase.

    Both come of one row, so that what finds them runs once.
    """
    value = F.lit(None).cast("string")
    for kind, pattern in TOKEN_VALUES.items():
        value = F.when(F.col("type") == kind, F.regexp_extract("snippet", pattern, 0)).otherwise(value)
    t = token_class(value)
    given = {"type": F.lit("TOKEN_RISK"), "subcode": F.lit("TOK-CLASS"), "category": F.lit("token"), "intent": F.lit("EXFILTRATION"), "severity": t["level"], "confidence": F.lit("high"), "risk_score": t["score"], "phase": F.lit(phase)}
    row = lambda new: F.struct(*[new.get(c, F.col(c)).alias(c) for c in findings.columns])
    known = (F.coalesce(value, F.lit("")) != "") & (t["score"] > 0)
    return findings.select(F.explode(F.array_compact(F.array(row({}), F.when(known, row(given))))).alias("each")).select("each.*")


def scan_files(files: DataFrame, path: str, text: str, *keys: str) -> DataFrame:
    """All findings of whole files: by name, by line, by entropy and size, by token form and by workflow permission.

    keys, path, line (0: the file), type, subcode, category, intent, severity, confidence, risk_score,
    snippet, phase and rule_no; the last two with line give the order of a file's findings.
    """
    at = lambda df, phase: df.withColumns({"line": F.lit(0), "snippet": F.lit(""), "phase": F.lit(phase)})
    found = with_token_findings(match(lines(files, text, *keys, path), LINE_RULES, snippet=True).withColumn("phase", F.lit(1)), 3)
    names = at(file_name_findings(files, path, *keys, patch=False), 0)
    whole = files.select(*keys, path, F.explode(F.array_compact(F.array(
        F.when(by_name(F.col(path), ENTROPY_RULE.pattern) & (entropy(F.col(text)) > DENSE_BITS), rule_struct(ENTROPY_RULE, 0)),
        F.when(F.length(text) > LARGE_CHARACTERS, rule_struct(SIZE_RULE, 1)),
    ))).alias("hit")).select(*keys, path, "hit.*")
    granted = files.where(F.col(path).rlike(WORKFLOW_PATH)).select(*keys, path, F.explode(F.array_compact(F.array(*[F.when(F.col(text).rlike(r.pattern), rule_struct(r, i)) for i, r in enumerate(WORKFLOW_TOKENS)]))).alias("hit")).select(*keys, path, "hit.*")
    parts = [names, found, at(whole, 2), at(granted, 4)]
    columns = [*keys, path, "line", "type", "subcode", "category", "intent", "severity", "confidence", "risk_score", "snippet", "phase", "rule_no"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def scan_patches(patches: DataFrame, path: str, patch: str, *keys: str) -> DataFrame:
    """All findings of patches: by name, of binary changes, by added line, by token form and by workflow permission."""
    at = lambda df, phase: df.withColumns({"line": F.lit(0), "snippet": F.lit(""), "phase": F.lit(phase)})
    found = with_token_findings(match(patch_lines(patches, patch, *keys, path).where("content <> ''"), LINE_RULES, snippet=True).withColumn("phase", F.lit(1)), 3)
    names = at(file_name_findings(patches, path, *keys), 0)
    hits = F.array(F.when(F.col(patch).rlike(BINARY_CHANGE.pattern), rule_struct(BINARY_CHANGE, 100)), *[F.when(F.col(path).rlike(WORKFLOW_PATH) & F.col(patch).rlike(r.pattern), rule_struct(r, i)) for i, r in enumerate(WORKFLOW_TOKENS)])
    whole = at(patches.select(*keys, path, F.explode(F.array_compact(hits)).alias("hit")).select(*keys, path, "hit.*"), 4)
    parts = [names, found, whole]
    columns = [*keys, path, "line", "type", "subcode", "category", "intent", "severity", "confidence", "risk_score", "snippet", "phase", "rule_no"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


# The categories that call for advice, in order.
ADVICE = [
    (("malware",), "remove what looks like malware"),
    (("secret", "secrets"), "take secrets out of the code"),
    (("ci-cd", "ci-supply-chain"), "pin actions and narrow permissions"),
    (("workflow",), "review the workflows"),
    (("obfuscation",), "make the code readable"),
    (("supply-chain",), "audit the dependencies"),
    (("agent",), "review the agents' instructions"),
    (("token",), "restrict the tokens"),
]


def advice(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, advice: what the categories of the ten worst findings call for, in a fixed order."""
    drivers = ranked(findings, by).where("rank <= 10")
    flags = drivers.groupBy(*by).agg(*[F.bool_or(F.col("category").isin(*c)).alias(f"f{i}") for i, (c, _) in enumerate(ADVICE)])
    steps = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(text)) for i, (_, text) in enumerate(ADVICE)])), "; ")
    return flags.select(*by, F.when(steps == "", "nothing to do").otherwise(steps).alias("advice"))


def correlations(findings: DataFrame, by: Sequence[str], file: str = "file") -> DataFrame:
    """by, name, adjustment: what several findings show together."""
    per_category = findings.groupBy(*by, "category").agg(F.countDistinct(file).alias("files")).where("files >= 2")
    spread = per_category.select(*by, F.concat(F.lit("spread:"), "category").alias("name"), (-5 * (F.col("files") - 1)).cast("long").alias("adjustment"))
    flags = findings.groupBy(*by).agg(
        F.bool_or(F.col("category").isin("supply-chain", "token")).alias("supply"),
        F.bool_or(F.col("category") == "obfuscation").alias("hidden"),
        F.bool_or(F.col("category") == "malware").alias("malware"),
        F.count_if(F.col("subcode").startswith("WF-") | F.col("subcode").startswith("TOK-")).alias("workflow"),
    )
    named = [("supply+obfuscation", F.col("supply") & F.col("hidden"), -12), ("obfuscation+malware", F.col("hidden") & F.col("malware"), -10), ("workflow", F.col("workflow") >= 2, -9)]
    together = flags.select(*by, F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(v).cast("long").alias("adjustment"))) for n, c, v in named]))).alias("c")).select(*by, "c.*")
    mixed = findings.groupBy(*by, file).agg(F.countDistinct("category").alias("n")).where("n >= 3").select(*by, F.concat(F.lit("mixed:"), F.col(file).cast("string")).alias("name"), F.lit(-10).cast("long").alias("adjustment"))
    return spread.unionByName(together).unionByName(mixed)


def ranked(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Findings with a positive score and their rank by score within `by`; ties by file, line and subcode."""
    w = Window.partitionBy(*by).orderBy(F.desc("risk_score"), "file", "line", "subcode")
    return findings.where("risk_score > 0").withColumn("rank", F.row_number().over(w))


def agency_score(findings: DataFrame, by: Sequence[str], adjust: bool = True) -> DataFrame:
    """by, score, verdict, blast: the ten worst findings, each counting half of the one before, plus correlations."""
    if adjust:  # four groupings follow; the lines are scanned once
        findings = settle(findings.select(*by, "file", "line", "subcode", "category", "risk_score"))
    part = half_up(F.col("risk_score") * F.pow(F.lit(0.5), F.col("rank") - 1) * lookup(F.col("category"), CATEGORY_WEIGHT, 1.0))
    base = ranked(findings, by).where("rank <= 10").groupBy(*by).agg(F.sum(part).alias("base"))
    if adjust:
        extra = correlations(findings, by).groupBy(*by).agg(F.sum("adjustment").alias("extra"))
        base = base.join(extra, list(by), "left")
    else:
        base = base.withColumn("extra", F.lit(0))
    score = bounded(F.col("base") + F.coalesce("extra", F.lit(0))).cast("int")
    return base.select(*by, score.alias("score")).withColumns({"verdict": verdict(F.col("score")), "blast": blast(F.col("score"))})


def verdict(score: Column) -> Column:
    return F.when(score >= 70, "BLOCK").when(score >= 30, "REVIEW").otherwise("PASS")


def blast(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def evidence_cards(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ten findings that drive each score with their contribution, largest first."""
    part = half_up(F.col("risk_score") * F.pow(F.lit(0.5), F.col("rank") - 1) * lookup(F.col("category"), CATEGORY_WEIGHT, 1.0)).cast("int")
    return ranked(findings, by).where("rank <= 10").select(*by, "file", "line", "subcode", "rank", part.alias("contribution"))


def policy(findings: DataFrame, scores: DataFrame, by: Sequence[str], least_score: int = 70, critical: bool = True, high: bool = False) -> DataFrame:
    """by, failed, reasons: whether the gate closes, and why."""
    worst = findings.groupBy(*by).agg(F.bool_or(F.col("severity") == "CRITICAL").alias("critical"), F.bool_or(F.col("severity") == "HIGH").alias("high"))
    joined = scores.join(worst, list(by), "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("score") >= least_score, "score"),
            F.when(F.lit(critical) & F.col("critical"), "critical"),
            F.when(F.lit(high) & F.col("high"), "high"),
            F.when(F.col("verdict") == "BLOCK", "verdict"),
        )
    )
    return joined.select(*by, "score", (F.size(reasons) > 0).alias("failed"), F.array_join(reasons, ";").alias("reasons"))


def finding_delta(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("subcode", "file", "line")) -> DataFrame:
    """state (new, fixed) with the keys: findings on one side only."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    new = a.join(b, list(keys), "left_anti").select(F.lit("new").alias("state"), *keys)
    return new.unionByName(b.join(a, list(keys), "left_anti").select(F.lit("fixed").alias("state"), *keys))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|fixtures|spec)/|\.(test|spec)\.[a-z]+$")


def semantic_flags(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Adds why a line's findings may be noise: a test path, a detector's own definition, a harmless environment read, a comment."""
    return df.withColumns(
        {
            "in_test": is_test_path(path),
            "is_definition": content.rlike(r"(regex|pattern|rule)s?\s*[:=]"),
            "harmless_env": content.rlike(r"process\.env\.(NODE_ENV|CI|PATH|HOME)\b"),
            "is_comment": F.trim(content).rlike(r"^(//|#|\*|/\*)"),
        }
    )


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The n worst findings of all: severity, then score, then place. A top-k report."""
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("risk_score"), "file", "line", "subcode").limit(n)
