"""Personal data: exact base spans, and identifiers found by bootstrapped contexts, in DataFrame functions.

Base spans come from four patterns. Their positions follow from the lengths of what lies between
the matches and of the matches themselves. Bootstrapping then works on candidates: a token with
a digit behind a label and a delimiter. The label and delimiter are the lexical pattern, the
token the instance. Instances that are seeds (a base span, or a long hexadecimal key) have a
confidence of 1, others the best score of the accepted patterns they stand under, 0 at first. In
each round an open pattern's score is the mean confidence of its instances, pulled down where it
has few; those above a limit with enough confident instances are accepted and keep that score.
An open pattern never raises its own score, since only accepted ones lend confidence. Rounds end
when none accepts another; accepted patterns mark all their instances, seen or unseen.
Only narrow rows (no text) are shuffled, and a pattern's scores are summed up where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import let, row_key, settle, table

# Fixed patterns, kind by kind, in the order of the result. A match may begin at the start of a
# run or where the last match ended; possessive parts give the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign without which a text has no match of the kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = list(PATTERNS)
FOUND = "id"
# A value is a whole run of value characters with a digit in it. Where a long run has none, it is
# skipped but for its end, where the label of a next value may stand: linear time again.
_PLAIN = r"[^\s\"'<>,;#*$%&|0-9]"
_LABEL = r"(?<![\p{L}\p{N}_])([\p{L}_]{2,30}+\x20{0,2}[:=#]?\x20{0,2}[\"']?)"
_VALUE = rf"(?={_PLAIN}*+[0-9])([A-Za-z0-9+(][^\s\"'<>,;#*$%&|]{{5,}}+)"
_SKIP = rf"(?=[A-Za-z(+]{_PLAIN}{{50}}){_PLAIN}*(?={_PLAIN}{{40}}(?:[\s\"'<>,;#*$%&|]|\z))"
CANDIDATE = rf"{_LABEL}(?:{_VALUE}|{_SKIP})"
SEED_KEY = r"^[0-9a-f]{32,}$"
LEAST_SEEDS, LEAST_SCORE, DOUBT = 5, 0.7, 1.0
SPAN = "struct<start:int,kind:int,end:int>"
MATCHES = "array<struct<start:int,end:int,value:string>>"
#: Matches whose places are summed up in one list.
CHUNK = 128


def matched(text: Column, pattern: str, sign: str | None = None) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches, in code points.

    Places are sums over what came before, taken in two levels (chunks, then the matches of each),
    so a text with very many matches does not copy a growing list for each.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    items = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda x: x["value"].isNotNull())
    width = lambda x: x["gap"] + F.length(x["value"])

    def places(chunk: Column, begin: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(begin.alias("at"), F.array().cast(MATCHES).alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.array_append(acc["found"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + width(x)).alias("end"), x["value"].alias("value"))).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    def all_places(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK)), lambda i: F.slice(items, i + 1, CHUNK))
        begins = lambda cut: F.aggregate(
            cut,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
            lambda acc, c: F.struct((acc["at"] + F.aggregate(c, F.lit(0), lambda n, x: n + width(x))).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found")),
            lambda acc: acc["found"],
        )
        many = let(chunks, lambda cut: F.flatten(F.zip_with(cut, begins(cut), places)))
        return F.when(F.size(items) <= CHUNK, places(items, F.lit(0))).otherwise(many)

    return F.when(text.rlike(sign or pattern), let(items, all_places)).otherwise(F.array().cast(MATCHES))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def valid_spans(kind: str) -> Column:
    """The spans of the matches m_<kind> that pass."""
    return F.transform(F.filter(f"m_{kind}", lambda m: passes(kind, m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined; spans are ordered by start, then kind."""
    names = F.array(*[F.lit(k) for k in [*KINDS, FOUND]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def base_spans(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, base (ordered spans), and candidates with pattern, value and place; one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(*carry, text.alias("text"))
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(f"m_{kind}", matched(F.col("text"), PATTERNS[kind], SIGNS[kind]))
    rows = rows.withColumn("m_candidate", matched(F.col("text"), CANDIDATE, "[0-9]"))
    spans = [valid_spans(kind) for kind in KINDS]

    def candidate(m: Column) -> Column:
        value = F.regexp_extract(m["value"], CANDIDATE, 2)
        value = F.regexp_replace(value, r"(?<![.)!?:-])[.)!?:-]++$", "")
        label = F.regexp_extract(m["value"], CANDIDATE, 1)
        start = m["start"] + F.length(label)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.regexp_replace(F.lower(label), r"\x20+", " ").alias("pattern"), F.lower(value).alias("value"))

    return rows.select(*carry, F.array_sort(F.concat(*spans)).alias("base"), F.filter(F.transform("m_candidate", candidate), lambda c: c["value"] != "").alias("candidates"))


def marked(found: DataFrame) -> DataFrame:
    """(__row, pattern, value, start, end, in_base): each candidate, and whether it overlaps a base span.

    Spans become narrow rows and meet by two running extremes in the order of their starts, so
    the work grows with the spans of a text and not with their pairs.
    """
    found = found.where(F.size("candidates") > 0)
    cand = found.select("__row", F.explode("candidates").alias("c")).select("__row", "c.pattern", "c.value", "c.start", "c.end", F.lit(0).alias("base"))
    base = found.select("__row", F.explode("base").alias("b")).select("__row", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("value"), "b.start", "b.end", F.lit(1).alias("base"))
    before = Window.partitionBy("__row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col("base") == 1
    rows = cand.unionByName(base).withColumn("left", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("right", F.min(F.when(is_base, F.col("start"))).over(after))
    over = F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False))
    return settle(rows.where("base = 0").select("__row", "pattern", "value", "start", "end", over.alias("in_base")))


def accepted_patterns(candidates: DataFrame) -> DataFrame:
    """(pattern): the lexical patterns whose instances are identifiers."""
    seeded = F.col("in_base") | F.col("value").rlike(SEED_KEY)
    graph = settle(candidates.groupBy("pattern", "value").agg(F.max(seeded.cast("int")).alias("seed")))
    instances = graph.groupBy("value").agg(F.max("seed").cast("double").alias("confidence"))
    accepted = None
    while True:
        scores = graph.join(instances, "value").groupBy("pattern").agg((F.sum("confidence") / (F.count("*") + DOUBT)).alias("score"), F.count_if(F.col("confidence") >= LEAST_SCORE).alias("sure"))
        able = scores.where((F.col("sure") >= LEAST_SEEDS) & (F.col("score") >= LEAST_SCORE)).select("pattern", "score")
        new = settle(able if accepted is None else able.join(accepted, "pattern", "left_anti"))
        accepted = new.select("pattern") if accepted is None else accepted.unionByName(new.select("pattern"))
        if new.isEmpty():
            return accepted
        lent = graph.join(new, "pattern").groupBy("value").agg(F.max("score").alias("score"))
        instances = settle(instances.join(lent, "value", "left").select("value", F.greatest("confidence", F.coalesce("score", F.lit(0.0))).alias("confidence")))


def private_spans(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carry..., base, spans) for each row; spans adds the discovered ones and keeps every base one.

    A null text counts as empty. A discovered span never overlaps a base span. Repeated rows are
    searched each. Columns other than text and `carry` are ignored; an empty table gives an empty
    result. The parameters of discovery: a label has 2 to 30 letters, a pattern is accepted with
    LEAST_SEEDS sure instances and a score of LEAST_SCORE; rounds go on until none is accepted.
    """
    found = settle(base_spans(documents, carry).withColumn("__row", F.monotonically_increasing_id()))
    candidates = marked(found)
    one = candidates.where("not in_base").join(accepted_patterns(candidates), "pattern")
    extra = one.groupBy("__row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("extra"))
    joined = found.select("__row", *carry, "base").join(extra, "__row", "left")
    return joined.select(*carry, "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def op6_private_data(spark, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[counted(kind) for kind in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in [*KINDS, FOUND]])
    end = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"]))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(end)


def without_private_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; its private spans are replaced by their kinds, n_chars follows.

    Spans go back to the rows of their own id and text, so rows that share a doc_id keep apart.
    """
    keyed = docs.withColumn("__key", row_key())
    found = private_spans(keyed, ("__key",)).where("size(spans) > 0").groupBy("__key").agg(F.max("spans").alias("__spans"))  # equal for one key
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__spans")))
    joined = keyed.join(found, "__key", "left").withColumn("text", text)
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])
