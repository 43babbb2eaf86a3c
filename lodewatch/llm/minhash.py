"""Near-duplicate documents by MinHash: one-permutation hashing, densified, banded, in stars.

One hash per shingle serves all bins (one permutation): its high part picks the bin, the bin
keeps the smallest hash. An empty bin borrows from the first filled bin in a fixed random order
of its own, the optimal densification, so two sets agree in any bin with a chance equal to
their similarity. Bands of bins become bucket keys; inside a bucket every member is paired with
one centre, so a bucket of m documents gives m - 1 candidates. Candidates are confirmed on
whole shingle sets.

Where members of one bucket are still in different components, every pair of them is settled in
one of two exact ways. Pairs that share a rare shingle are confirmed. Any other pair can only
share common shingles, and where both have enough of those, the members outside a bucket's largest
component become centres in an order given by a hash, in growing numbers, until each such pair has
been confirmed or ruled out. So no link between two members of a bucket is lost, no bucket is
capped, and none is sorted in one task.

Documents with equal sets are one class, and all of the above works on classes, numbered as nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import row_key, settle, table
from .words import Block, blocks, give_back, mix, signed

#: A pair at the limit of 0.75 shares no band with a chance of (1 - 0.75 ** 4) ** 40, about 2.5e-7.
BANDS, ROWS = 40, 4
SHINGLE_WORDS = 5
PERCENT = 75
#: Documents, of those in open buckets, that have a rare shingle at most.
RARE = 8
#: Centres that a bucket takes in its first round of turns; later rounds take four times as many.
CENTRES = 128
#: Sets below this size are compared whole without a look at their sketches.
SMALL = 100
#: Ids (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def shingle_sets(block: Block, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their offsets.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = block.words(lower=True)
    counts = words.counts()
    grams, inside = words.grams(size)
    owner = np.repeat(np.arange(len(block)), counts)[: len(grams)][inside]
    grams = grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for n in range(1, size):
            at = np.flatnonzero(counts[short] == n)
            total = np.full(len(at), n, np.uint64)
            for j in range(n):
                total = mix(total + words.hashes[words.offsets[short[at]] + j])
            whole[at] = total
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    first = np.ones(len(grams), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[first], grams[first]
    return grams, np.searchsorted(owner, np.arange(len(block) + 1))


_donors: dict[int, np.ndarray] = {}


def donors(bins: int) -> np.ndarray:
    """Row t: for each bin, the bin it asks for a value at attempt t. Each column is a permutation."""
    if bins not in _donors:
        rng = np.random.default_rng(bins)
        _donors[bins] = np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)
    return _donors[bins]


def band_keys(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of each set, and a sketch of four bits a bin, 16 bins a long; sets must not be empty."""
    bins, n = bands * rows, len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    mixed = mix(grams)
    bin_of = ((mixed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    slots = np.full(n * bins, empty)
    np.minimum.at(slots, owner * bins + bin_of.astype(np.int64), mix(mixed + np.uint64(1)))
    slots = slots.reshape(n, bins)
    filled = slots != empty
    row, column = np.nonzero(~filled)
    for ask in donors(bins):
        if not len(row):
            break
        found = filled[row, ask[column]]
        slots[row[found], column[found]] = slots[row[found], ask[column[found]]]
        row, column = row[~found], column[~found]
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (n, bands)).copy()
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + slots[:, j::rows])
    bits = np.zeros((n, -(-bins // 16) * 16), np.uint64)
    bits[:, :bins] = slots & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return keys, np.bitwise_or.reduce(bits.reshape(n, -1, 16) << shifts, axis=2)


DIGEST = ["digest_a", "digest_b", "n_shingles"]


def signatures(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The set size, a digest of the whole set, the band keys and the sketch of each document, beside `carry`."""
    own = documents.select(F.col("doc_id").cast("long"), *carry, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text"), "n_shingles long, digest_a long, digest_b long, keys array<long>, sketch array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                grams, offsets = shingle_sets(block)
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                a, b = digests(grams, offsets)
                keys, sketch, longs = np.empty((0, bands), np.uint64), np.empty((0, 0), np.uint64), -(-bands * rows // 16)
                if len(some):
                    keys, sketch = band_keys(grams, np.append(offsets[:-1][some], offsets[-1]), bands, rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((sizes > 0) * wide)), pa.int32()), pa.array(signed(x.ravel()))) for x, wide in ((keys, bands), (sketch, longs))]
                same = batch.slice(int(block.rows[0]), len(block)).select(["doc_id", *carry])
                columns = [*same.columns, pa.array(sizes.astype(np.int64)), pa.array(signed(a)), pa.array(signed(b)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *carry, "n_shingles", "digest_a", "digest_b", "keys", "sketch"])
        give_back()

    return own.mapInArrow(run, schema)


def digests(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, 0 for an empty one."""
    some = np.flatnonzero(np.diff(offsets))
    a, b = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    if len(some):
        starts = offsets[:-1][some]
        a[some] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
        b[some] = np.add.reduceat(mix(grams + np.uint64(0x14057B7EF767814F)), starts)
    return a, b


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The ids, written, and to be broadcast while they are few."""
    ids = settle(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose node is among the ids; long rows stay where they are while the ids are few."""
    return rows.join(few(ids.distinct()), "node", "left_semi")


def whole_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest_a, digest_b, shingles): the sorted set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                grams, offsets = shingle_sets(block)
                a, b = digests(grams, offsets)
                ids = batch.column("doc_id").slice(int(block.rows[0]), len(block))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(grams)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(signed(a)), pa.array(signed(b)), lists], names=["doc_id", "n_shingles", "digest_a", "digest_b", "shingles"])
        give_back()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, shingles array<long>")


def likely(pairs: DataFrame, reps: DataFrame, percent: int, bins: int) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and sketches leave room for a link.

    Two sets at the limit differ in a bin of the sketch with a chance of 15/16 of what they lack;
    a pair goes only if it differs in so many bins more that a link would do so with a chance of
    under 1e-8. Sketches of small sets say less, so a pair with one of them stays.
    """
    spread = (percent / 100 * (1 - percent / 100) / bins) ** 0.5
    most = int(bins * 15 / 16 * (1 - percent / 100 + 5.7 * spread)) + 1
    docs = reps.select("node", F.col("n_shingles").alias("n"), "sketch")
    side = lambda x: docs.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in docs.columns])
    joined = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    differs = F.lit(0)
    for i in range(-(-bins // 16)):
        x = F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differs = differs + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    close = (differs <= most) | (F.least("n_a", "n_b") < SMALL)
    return joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").where(close).select("a", "b").distinct()


def confirmed(sets: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int = PERCENT, bins: int = BANDS * ROWS) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union, as a written table.

    Only sets of documents that stand in a likely pair travel.
    """
    pairs = settle(likely(pairs, reps, percent, bins))
    sets = only(sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return settle(
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")
        .where(100 * shared >= percent * (F.size("shingles_a") + F.size("shingles_b") - shared))
        .select("a", "b")
    )


def open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with component, of the buckets whose members are in more than one component."""
    members = members.drop("component")
    labelled = members.join(found, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return labelled.join(split, "key")


def by_rare_shingles(sets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): members of different components that share a rare shingle; (node, n, common): set sizes.

    A shingle is rare if at most RARE open documents have it, so its pairs are few. `common`
    counts a document's other shingles: two documents without a rare one in common share at most
    the smaller of their `common`.
    """
    docs = members.select("node", "component").distinct()
    sets = settle(only(sets, docs.select("node")).join(docs, "node"))
    tokens = sets.select("node", "component", F.explode("shingles").alias("shingle"))
    rare = tokens.groupBy("shingle").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("many") <= RARE)
    light = tokens.join(rare, "shingle")
    counts = light.groupBy("node").agg(F.count("*").alias("rare"))
    sizes = sets.select("node", F.size("shingles").alias("n")).join(counts, "node", "left").select("node", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common"))
    mixed = light.where("low < high").groupBy("shingle").agg(F.collect_list(F.struct("node", "component")).alias("docs"))  # RARE at most
    pairs = F.expr("flatten(transform(docs, x -> transform(filter(docs, y -> y.node > x.node and y.component <> x.component), y -> struct(x.node as a, y.node as b))))")
    return settle(mixed.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()), settle(sizes)


def by_centres(members: DataFrame, found: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Open members that may still have a link in their bucket, with their turn as a centre.

    By common shingles alone, a set of n links with one of m only if both have percent * (n + m)
    / (100 + percent) of them. The members of a bucket's largest component need no turn, as every
    pair that matters has a member outside it; the others have a turn in (0, 1) from a hash, so
    that a share of them can be taken without ranking a bucket. `outside` counts them. `keys` has
    all of a member's buckets here, so that a pair can be left to the first bucket that both share.
    """
    rows = open_buckets(members.join(sizes, "node"), found)
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    able = rows.join(least, "key").where(f"(100 + {percent}) * common >= {percent} * (n + greatest(ceil({percent} * n / 100), least))").drop("least")
    able = open_buckets(able, found)
    sizes_in = able.groupBy("key", "component").agg(F.count("*").alias("of"))
    largest = sizes_in.groupBy("key").agg(F.max_by("component", F.struct("of", "component")).alias("largest"), (F.sum("of") - F.max("of")).alias("outside"))
    keys = able.groupBy("node").agg(F.collect_list("key").alias("keys"))  # one a band at most
    draw = (F.pmod(F.xxhash64("node", "key"), F.lit((1 << 40) - 1)) + 1) / float(1 << 40)
    turn = F.when(F.col("component") != F.col("largest"), draw)
    return settle(able.join(largest, "key").withColumn("turn", turn).join(keys, "node").select("key", "node", "n", "common", "turn", "outside", "keys"))


def grouped(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., n_shingles, group, component_id): group names the component, null for an empty set."""
    documents = documents.select(F.col("doc_id").cast("long"), *carry, "text")
    signed_docs = settle(signatures(documents, bands, rows, carry))
    classes = settle(signed_docs.where("n_shingles > 0").groupBy(*DIGEST).agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    named = classes.select(*DIGEST, F.col("first_id").alias("__first"), "node")
    stands = F.col("doc_id").eqNullSafe(F.col("__first"))
    reps = settle(signed_docs.join(named, DIGEST).where(stands).select("node", "doc_id", *DIGEST, "keys", "sketch"))
    if reps.count() > classes.count():  # rows that repeat a doc_id and its text
        reps = settle(reps.dropDuplicates(["node"]))
    members = reps.select(F.explode("keys").alias("key"), "node")
    centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("many")).where("many > 1").select("key", "centre")
    members = settle(members.join(centres, "key"))
    wanted = settle(only(reps.select("node", F.col("doc_id").alias("__id"), *DIGEST), members.select("node")))
    chosen = documents.join(few(wanted.select("__id").distinct()), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = whole_sets(chosen).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS // 8 else wanted, DIGEST).where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "shingles")
    sets = settle(sets)
    if sets.count() > wanted.count():
        sets = settle(sets.dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        return confirmed(sets, reps, pairs, percent, bands * rows)

    links = linked(members.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    found = components(links)
    open_members = settle(open_buckets(members.select("key", "node"), found))
    if not open_members.isEmpty():
        rare, sizes = by_rare_shingles(sets, open_members)
        # the member with the largest share of common shingles is the likeliest to be near the others
        rows_ = open_members.join(sizes, "node")
        best = rows_.groupBy("key").agg(F.max_by("node", F.struct(F.col("common") / F.col("n"), -F.col("node"))).alias("best"))
        hubs = rows_.join(best, "key").where("node <> best").select(F.least("best", "node").alias("a"), F.greatest("best", "node").alias("b"))
        links = settle(links.union(linked(rare.union(hubs))))
        found = components(links)
        able = by_centres(open_members.select("key", "node"), found, sizes, percent)
        last = able.agg(F.max("outside")).first()[0] or 0
        done, more = 0, CENTRES
        while done < last:
            labelled = able.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            share = lambda x: F.col("turn") * F.col("outside") > F.lit(float(x))
            hubs = labelled.where(share(done) & ~share(done + more))
            hubs = hubs.select("key", F.col("node").alias("a"), F.col("component").alias("of_a"), F.col("turn").alias("turn_a"), F.col("n").alias("n_a"), F.col("common").alias("common_a"), F.col("keys").alias("keys_a"))
            later = "(turn is null or turn > turn_a or (turn = turn_a and node > a))"
            meets = f"{later} and array_min(array_intersect(keys, keys_a)) = key and component <> of_a and (100 + {percent}) * least(common, common_a) >= {percent} * (n + n_a) and 100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
            new = linked(labelled.join(hubs, "key").where(meets).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
            if not new.isEmpty():
                links = settle(links.union(new))
                found = components(links)
            done, more = done + more, 4 * more

    by_class = settle(classes.join(found, "node", "left").select(*DIGEST, "first_id", F.coalesce("component", "node").alias("group")))
    least_id = by_class.groupBy("group").agg(F.min("first_id").alias("component_id"))
    joined = signed_docs.select("doc_id", *carry, *DIGEST).join(by_class.join(least_id, "group").drop("first_id"), DIGEST, "left")
    return joined.select("doc_id", *carry, "n_shingles", "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents with equal sets are one class; stars and confirmation work on classes, so copies are
    never expanded into pairs. A null or wordless text has an empty set, links with nothing and is
    kept. Rows that repeat a doc_id are compared each by its own text, so rows of one doc_id with
    different texts may be in different components. A null doc_id links like any other; its row
    is kept only if no row of its component has a doc_id, and component_id is then null. Extra
    columns are ignored. An empty table gives an empty result.
    """
    found = grouped(documents, bands, rows, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first_of_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates stays, that with the smallest doc_id.

    Of a group without any doc_id one row stays, and so does one of the rows that repeat both
    doc_id and text. Rows of one doc_id with different texts stay or go each with its own group.
    Wordless texts are in no group and stay.
    """
    keyed = docs.withColumn("__key", row_key())
    found = settle(grouped(keyed, carry=("__key",)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__key").alias("key"))
    first = found.where("group is not null").groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.key").alias("__key"))
    stay = first.union(found.where("group is null").select("__key"))
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
