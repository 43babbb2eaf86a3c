"""Writers: findings as a SARIF document, components as a bill of materials, upserts by rewriting keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """value: one SARIF result object a finding with a positive score, as JSON text; write it as lines."""
    place = F.struct(F.struct(F.struct(F.col("file").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("subcode").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.concat_ws(" ", "subcode", "severity").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.where("risk_score > 0").select(F.to_json(result).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """value: the distinct rules of the findings as SARIF rule objects."""
    return findings.where("risk_score > 0").groupBy("subcode").agg(F.min("category").alias("category")).select(F.to_json(F.struct(F.col("subcode").alias("id"), F.struct("category").alias("properties"))).alias("value"))


def components_json(bill: DataFrame) -> DataFrame:
    """value: a CycloneDX component object for each row of a bill of materials."""
    known = F.transform(F.filter(F.split("vulnerabilities", ","), lambda x: x != ""), lambda x: F.struct(x.alias("id")))
    return bill.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version").alias("purl"), known.alias("vulnerabilities"))).alias("value"))


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table with the changes' rows in place of those of the same key; the last by `order` wins."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    last = changes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return table.join(last.select(*key), key, "left_anti").unionByName(last)


def compact(record: DataFrame, arrays: dict[str, int], strings: dict[str, int]) -> DataFrame:
    """The rows with arrays and strings cut to the sizes a stored record may have."""
    return record.withColumns({c: F.slice(c, 1, n) for c, n in arrays.items()} | {c: F.substring(c, 1, n) for c, n in strings.items()})


def session_json(sessions: DataFrame) -> DataFrame:
    """value: each row as a JSON object, to be written as lines."""
    return sessions.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sessions.columns])).alias("value"))


def enriched_report(findings: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """by, value: a project's score, verdict and number of findings by severity as one JSON object."""
    counts = findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    rows = scores.join(counts, by, "left")
    body = [c for c in rows.columns if c not in by]
    return rows.select(*by, F.to_json(F.struct(*body)).alias("value"))


def changed(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with new values in the rows that meet the condition; write it over the partition it came from."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def purged(table: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet the condition; a null condition keeps its row."""
    return table.where(~F.coalesce(condition, F.lit(False)))
