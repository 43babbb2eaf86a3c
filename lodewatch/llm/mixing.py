"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The mean repetition rate of a source is its target share of the characters over its present
share. Each document draws its number of copies from a Poisson distribution of that mean by
inverting a uniform that is a hash of seed and doc_id, so a rerun or a lost executor gives the
same copies. Rates above PART are drawn as a sum of independent parts, each with a hash of its
own, so the table of cumulative chances stays short. Copies are then dealt to partitions and
ordered inside them by another hash: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, table

SEED = 20240607
#: Sources whose rates are broadcast at most (some 400 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Without given weights, a source's target is its characters to this power.
TEMPERATURE = 0.5
#: The largest mean drawn at once, and the terms of its cumulative chances (the rest is < 1e-18).
PART, TERMS = 4.0, 32


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, 48 bits of it."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate, parts, cumulative) a source: its mean copies and how to draw them.

    weights: target weight by source name; sources not named there get none. Without weights,
    characters to the power of `temperature`. A null source counts as the name ''.
    """
    sizes = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        target = F.pow(F.col("chars"), F.lit(float(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.create_map().cast("map<string,double>")
        target = F.coalesce(named[F.col("source")], F.lit(0.0))
    sizes = sizes.withColumn("target", F.when(F.col("chars") > 0, target).otherwise(0.0))
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("target").alias("all_target"))
    wanted = F.col("target") / F.nullif(F.col("all_target"), F.lit(0.0)) * F.col("all_chars") / F.nullif(F.col("chars"), F.lit(0.0))
    found = sizes.crossJoin(F.broadcast(total)).withColumn("rate", F.round(F.coalesce(wanted, F.lit(0.0)), 6))  # total is one row
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    term = "struct(acc.p * mean / (k + 1) as p, array_append(acc.c, acc.c[k] + acc.p * mean / (k + 1)) as c)"
    return found.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).select(
        "source",
        "rate",
        "parts",
        F.expr(f"aggregate(sequence(0, {TERMS}), struct(exp(-mean) as p, array(exp(-mean)) as c), (acc, k) -> {term}, acc -> acc.c)").alias("cumulative"),
    )


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Every document as often as drawn, with copy_no from 1, rate and mix_key; not yet shuffled.

    Rows with the same doc_id draw the same number. A null doc_id draws as the text 'null'.
    Columns copy_no, rate and mix_key of the input are replaced, all others are kept.
    """
    kept = [c for c in documents.columns if c not in ("copy_no", "rate", "mix_key")]
    name = F.coalesce("source", F.lit(""))
    # The rates have a row a source: they come to the documents while they are few, so that a source
    # with a third of all rows stays where it is and texts are shuffled only once, to be mixed.
    drawn = settle(rates(documents, weights, temperature).toDF("__name", "__rate", "__parts", "__cumulative"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], name.alias("__name"), key.alias("__key"))
    joined = rows.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_SOURCES else drawn, "__name")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda acc, part: acc + F.size(F.filter("__cumulative", lambda c: c <= uniform(F.lit(str(seed)), F.col("__key"), part))),
    )
    copies = joined.withColumn("__n", count).where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return copies.select(*[F.col(f"`{c}`") for c in kept], "copy_no", F.col("__rate").alias("rate"), F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "__key", "copy_no").cast("binary")).alias("mix_key"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Replicated and globally shuffled: dealt by a hash of doc_id and copy, ordered by it in each partition."""
    return replicate(documents, weights, temperature, seed).repartition("mix_key").sortWithinPartitions("mix_key")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy_no", "rate", F.length("text").cast("long").alias("n_chars"), "mix_key")


def replicated_to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as its source's rate draws, globally shuffled."""
    return mix(docs).select(*docs.columns)


#: The same draw in DuckDB's SQL.
SQL = f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1
), targets AS (
  SELECT *, CASE WHEN chars > 0 THEN pow(chars, {TEMPERATURE}) ELSE 0 END AS target FROM sizes
), rates AS (
  SELECT source, round(coalesce(target / nullif(sum(target) OVER (), 0) * sum(chars) OVER () / nullif(chars, 0), 0), 6) AS rate FROM targets
), means AS (
  SELECT *, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM rates
), cumulative AS (
  SELECT source, rate, parts, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS c
  FROM means, range(0, {TERMS + 2}) t(k)
), draws AS (
  SELECT d.doc_id, d.source, length(d.text) AS n_chars, r.rate, r.source AS name,
         ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || p.part), 1, 12))::BIGINT / {float(1 << 48)} AS u
  FROM documents d JOIN means r ON coalesce(d.source, '') = r.source, range(1, 1000) p(part) WHERE p.part <= r.parts
), counts AS (
  SELECT doc_id, any_value(source) AS source, any_value(n_chars) AS n_chars, any_value(rate) AS rate,
         sum((SELECT count(*) FROM cumulative c WHERE c.source = draws.name AND c.c <= draws.u)) AS n
  FROM draws GROUP BY doc_id
)
SELECT doc_id, source, copy.no::INT AS copy_no, rate, n_chars, md5('order{SEED}:' || doc_id || ':' || copy.no) AS mix_key
FROM counts, range(1, 200) copy(no) WHERE copy.no <= n
"""
