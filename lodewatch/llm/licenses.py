"""License scans by ordered signature rules, with DataFrame functions only and without a shuffle.

A text becomes its words with one space after each. Words that are the anchor of some rule bring
that rule up (the keyword prefilter); it is tried only where the other words it needs stand near,
and its pattern only on the words around the anchor. Every rule that meets gives a detection, an
interval of words. Detections are then resolved by priority and containment: one that lies inside
another of at least its own priority is suppressed. Those of the base phrases always count.

A text is taken in chunks of whole words, each with enough words of its neighbours that a signature
across the border is found once, and suppressed there as in the middle: nothing holds an array of
all words of a long text, and a chunk's detections are resolved on their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import AFTER, BEFORE, Rule, rules
from .shared import free_name, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a chunk; a single longer word is a chunk of its own, and ends signatures.
CHUNK_CHARS = 65_536
#: A signature's most words; anchors so near to a chunk are looked at, too, to suppress what is inside.
LONGEST = BEFORE + AFTER
#: How sure a detection of each priority is.
WEIGHTS = {4: 0.9, 3: 1.0, 2: 0.8, 1: 0.5}

RULE = "struct<number:int,label:string,priority:int,base:boolean,need:array<string>,pattern:string>"


def n_words(spaced: Column) -> Column:
    """Of a string with one space after each word."""
    return (F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))).cast("long")


def spaced_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each with a space after it.

    Runs of other than ASCII characters become one letter: they make words, but no signature has them.
    """
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS, " ")
    return let(F.trim(F.regexp_replace(plain, r"[^\x00-\x7F]+", "ÿ")), lambda s: F.when(s == "", "").otherwise(F.concat(s, F.lit(" "))))


def by_anchor(found: list[Rule]) -> Column:
    """The inverted index, a constant: anchor to its rules."""
    index: dict[str, list[dict]] = {}
    for r in found:
        index.setdefault(r.anchor, []).append({"number": r.number, "label": r.label, "priority": r.priority, "base": r.base, "need": list(r.need), "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps(index)), f"map<string,array<{RULE}>>")


def matched(words: Column, at: Column, first_word: Column, index: Column) -> Column:
    """The detections of the rules that the word at `at` is the anchor of."""
    anchor = F.get(words, at)
    start = F.greatest(at - BEFORE, F.lit(0))
    before = F.array_join(F.slice(words, start + 1, at - start), " ")
    near = F.concat(F.lit(" "), before, F.when(at > start, " ").otherwise(""), F.lit("@"), F.array_join(F.slice(words, at + 1, F.lit(AFTER)), " "), F.lit(" "))

    def tried(rule: Column, window: Column) -> Column:
        def detection(met: Column) -> Column:
            first = first_word + at - n_words(F.substring_index(met, "@", 1)) + 1
            last = first + n_words(met) - 2
            return F.when(met != "", F.struct(first.alias("first"), (-last).alias("minus_last"), (-rule["priority"]).alias("minus_priority"), rule["number"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"), (first_word + at).alias("anchor")))

        return let(F.call_function("regexp_extract", window, rule["pattern"], F.lit(0)), detection)

    def candidates(window: Column) -> Column:
        due = F.filter(F.element_at(index, anchor), lambda r: F.forall(r["need"], lambda w: F.contains(window, w)))
        return F.filter(F.transform(due, lambda r: tried(r, window)), lambda d: d.isNotNull())

    return let(near, candidates)


def resolved(detections: Column) -> Column:
    """Detections in order with `kept`: false if one before it, of its priority or more, reaches as far.

    Whatever contains an interval stands before it in the order (start, then the longer, then the
    higher priority, then the rule's number), so the furthest ends so far, by priority, decide.
    """
    levels = sorted(WEIGHTS)
    empty = F.struct(F.array(*[F.lit(-1).cast("long") for _ in levels]).alias("ends"), F.filter(detections, lambda d: F.lit(False)).alias("seen"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        kept = d["base"] | (F.get(acc["ends"], priority - 1) < last)
        ends = F.transform(acc["ends"], lambda end, k: F.when(k < priority, F.greatest(end, last)).otherwise(end))
        return F.struct(ends.alias("ends"), acc["seen"].alias("seen"), F.array_append(acc["kept"], kept).alias("kept"))

    fold = F.aggregate(detections, empty, step, lambda acc: acc["kept"])
    return let(fold, lambda kept: F.transform(detections, lambda d, k: F.struct(d["first"].alias("first"), (-d["minus_last"]).alias("last"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"), d["rule"].alias("rule"), d["base"].alias("base"), F.get(kept, k).alias("kept"), d["anchor"].alias("anchor"))))


def detections(text_words: Column, found: list[Rule] | None = None) -> Column:
    """All detections in spaced words, in order: array of first, last, label, priority, rule, base, kept."""
    found = found or rules()
    index = by_anchor(found)
    anchors = F.array(*[F.lit(a) for a in sorted({r.anchor for r in found})])

    def of_chunk(chunks: Column, starts: Column, k: Column) -> Column:
        chunk = F.get(chunks, k)
        left = F.substring_index(F.coalesce(F.get(chunks, k - 1), F.lit("")), " ", -(LONGEST + BEFORE + 1))
        after = F.coalesce(F.get(chunks, k + 1), F.lit(""))
        right = F.when(n_words(after) <= LONGEST + AFTER, after).otherwise(F.concat(F.substring_index(after, " ", LONGEST + AFTER), F.lit(" ")))
        core, beyond = F.get(starts, k), F.get(starts, k + 1)

        def of_words(words: Column, before: Column) -> Column:
            first_word = core - before

            def of_present(present: Column) -> Column:
                def due(at: Column) -> Column:
                    place = first_word + at
                    return (place >= core - LONGEST) & (place < beyond + LONGEST) & F.array_contains(present, F.get(words, at))

                places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), due)
                return F.array_sort(F.flatten(F.transform(places, lambda at: matched(words, at, first_word, index))))

            none = F.size(F.array_intersect(words, anchors)) == 0
            hits = let(F.array_intersect(words, anchors), of_present)
            own = let(hits, lambda d: F.filter(resolved(d), lambda x: (x["anchor"] >= core) & (x["anchor"] < beyond)))
            return F.when(~none, own)

        return let(left, lambda side: let(F.split(F.concat(side, chunk, right), " "), lambda words: of_words(words, n_words(side))))

    def of_chunks(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + n_words(c)))
        each = lambda s: F.flatten(F.filter(F.transform(chunks, lambda c, k: of_chunk(chunks, s, k)), lambda x: x.isNotNull()))
        return let(starts, each)

    pieces = F.regexp_extract_all(text_words, F.lit(rf"(?s).{{0,{CHUNK_CHARS - 1}}} |[^ ]+ "), F.lit(0))
    return let(pieces, of_chunks)


def license_scan(documents: DataFrame, text: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """Every row with n_words and `licenses`: its detections, by first word, of the rules given.

    A null or empty text has no words and no detections. Rows are scanned each for itself, so null,
    repeated or clashing ids change nothing; columns n_words and licenses of the input are replaced,
    all others are kept. An empty table gives no rows. Of equal intervals the higher priority stands,
    then the earlier rule; equal phrases at two places are two detections. A word of over CHUNK_CHARS
    characters is part of no signature.
    """
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_words", "licenses")]
    name = free_name(documents, "spaced")
    spaced = documents.select(*kept, spaced_words(F.col(f"`{text}`")).alias(name))
    return spaced.select(*kept, n_words(F.col(name)).alias("n_words"), detections(F.col(name), found).alias("licenses"))


def summary(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) a row."""
    base = F.filter("licenses", lambda d: d["base"])
    standing = F.filter("licenses", lambda d: d["kept"])
    listed = lambda d: F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(standing).alias("labels"),
        F.coalesce(F.array_max(F.transform(standing, lambda d: F.element_at(weight, d["priority"]))), F.lit(0.0)).alias("score"),
        F.size("licenses").cast("long").alias("n_detections"),
    )


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """Null text: no words, no labels, score 0.0; see license_scan for the other cases."""
    return summary(license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def sql(found: list[Rule] | None = None) -> str:
    """The same scan in DuckDB's SQL, on whole word lists."""
    found = found or rules()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n  ".join(f"({r.number}, {quoted(r.label)}, {r.priority}, {str(r.base).lower()}, {quoted(r.anchor)}, [{', '.join(map(quoted, r.need))}]::VARCHAR[], {quoted(r.pattern)})" for r in found)
    weights = " ".join(f"WHEN {p} THEN {w}" for p, w in WEIGHTS.items())
    return f"""
WITH rules(rule, label, priority, base, anchor, need, pattern) AS (VALUES
  {values}
), words AS (
  SELECT doc_id, rowid_, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), places AS (
  SELECT rowid_, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
), hits AS (
  SELECT rowid_, i, ws[i] AS anchor,
         ' ' || array_to_string(list_concat(ws[greatest(i - {BEFORE}, 1):i - 1], list_concat(['@' || ws[i]], ws[i + 1:i + {AFTER - 1}])), ' ') || ' ' AS near
  FROM places WHERE ws[i] IN (SELECT anchor FROM rules)
), tried AS (
  SELECT rowid_, i, r.*, regexp_extract(near, r.pattern) AS met
  FROM hits JOIN rules r USING (anchor) WHERE len(list_filter(need, lambda w: NOT contains(near, w))) = 0
), found AS (
  SELECT rowid_, rule, label, priority, base,
         i - 1 - (length(split_part(met, '@', 1)) - length(replace(split_part(met, '@', 1), ' ', '')) - 1) AS first,
         i - 1 - (length(split_part(met, '@', 1)) - length(replace(split_part(met, '@', 1), ' ', '')) - 1) + length(met) - length(replace(met, ' ', '')) - 2 AS last
  FROM tried WHERE met <> ''
), kept AS (
  SELECT *, base OR NOT EXISTS (
    SELECT 1 FROM found t WHERE t.rowid_ = s.rowid_ AND t.first <= s.first AND t.last >= s.last AND t.priority >= s.priority
    AND (t.first < s.first OR t.last > s.last OR t.priority > s.priority OR t.rule < s.rule)) AS kept
  FROM found s
), by_row AS (
  SELECT rowid_, count(*) AS n_detections, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept) AS labels,
         max(CASE priority {weights} END) FILTER (kept) AS score
  FROM kept GROUP BY rowid_
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_detections, 0)::BIGINT AS n_detections
FROM words LEFT JOIN by_row USING (rowid_)
"""
