"""Winnowing fingerprints with DataFrame functions only.

Tokens are runs between white space, lower-cased. Each run of GRAM tokens has a hash; of every
WINDOW consecutive hashes the smallest is chosen, the rightmost among equals, and kept with its
position. Texts that share GRAM + WINDOW - 1 consecutive tokens therefore share a fingerprint.
Hashes are ordered by their upper ORDER_BITS bits. In a text of fewer tokens than the other bits of
a long can count, order and complemented position are packed in one long, so that a plain minimum
picks the rightmost of equals; in a longer text the smallest is looked up in the window read
backwards, where the first place found is the rightmost one. Both choose the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import let, settle, table

GRAM, WINDOW = 3, 8
ORDER_BITS, PLACE_BITS = 39, 24
#: A block of neighbouring documents has about so many characters; the first places of FAN blocks are one group.
BLOCK_CHARS, FAN = 16_000_000, 512
#: Blocks whose first places are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_BLOCKS = 4_000_000


def sliding_least(values: Column, wide: int) -> Column:
    """The least of each value and the wide - 1 after it, as far as there are any, by doubling the width."""
    width = 1
    while width < wide:
        step = min(width, wide - width)
        values = let(values, least_after(step))
        width += step
    return values


def least_after(step: int):
    return lambda values: F.transform(values, lambda v, i: F.least(v, F.get(values, i + step)))


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW, place_bits: int = PLACE_BITS) -> Column:
    """array<struct<hash, place>>: the chosen hashes and their positions, in order of position.

    A text with fewer tokens than a gram has its whole sequence as one gram; without tokens it
    has no fingerprint. With fewer grams than a window, all grams are one window.
    """
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda t: t != "")
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - gram + 1, F.lit(1))
        one = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(gram)]), 1)
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))

    def places(g: Column) -> Column:
        """Of each window [i, i + wide) its rightmost smallest hash, counted from 1; each place once."""
        n, top = F.size(g), (1 << place_bits) - 1
        wide = F.least(n, F.lit(window))
        starts = F.sequence(F.lit(1), n - wide + 1)
        order = lambda x: F.shiftrightunsigned(x, 63 - ORDER_BITS)
        packed = F.transform(g, lambda x, i: F.shiftleft(order(x), place_bits) + (F.lit(top) - i))
        lowest = F.array_distinct(F.slice(sliding_least(packed, window), F.lit(1), n - wide + 1))
        short = F.transform(lowest, lambda x: (F.lit(top + 1) - x.bitwiseAND(F.lit(top))).cast("int"))
        back = lambda h, r: F.transform(starts, lambda i: (i + wide - F.array_position(F.slice(r, n - i - wide + 2, wide), F.array_min(F.slice(h, i, wide)))).cast("int"))
        long = let(F.transform(g, order), lambda h: let(F.reverse(h), lambda r: F.array_distinct(back(h, r))))
        return F.when(n <= top, short).otherwise(long)

    def kept(g: Column) -> Column:
        # positions beyond PLACE_BITS go the longer way, to the same places
        found = F.transform(places(g), lambda p: F.struct(F.get(g, p - 1).alias("hash"), (p - 1).alias("place")))
        return F.when(F.size(g) > 0, found).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))

    return let(let(hashed, grams), kept)


def written(fingerprint: Column) -> Column:
    """hash@position, in hexadecimal and decimal, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["place"].cast("string"))), ",")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets; 1 for two without any, 0 if one has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def block_firsts(rows: DataFrame, order: Column, size: Column, block: int) -> DataFrame:
    """(number, first): the first place in order of each block, numbered from 0; a row a block.

    Places are dealt by ranges and cut inside each range where the running sum of sizes passes a
    block, so blocks are even, however many there are, and no task sees more than a range of places.
    """
    narrow = settle(rows.select(order.alias("o"), size.alias("n")).repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = narrow.withColumn("sub", F.floor(before / block)).groupBy("part", "sub").agg(F.min("o").alias("first")).select("first").distinct()
    return firsts.withColumn("number", F.row_number().over(Window.orderBy("first")) - 1)  # a row a block


def beside_next(rows: DataFrame, key: str, carried: list[str], size: Column, block: int = BLOCK_CHARS, fan: int = FAN) -> DataFrame:
    """Adds next_<c> of the row that follows by key (after the last: the first), with one shuffle of the rows.

    Neighbours are brought together in blocks, each of about `block` of `size`. A row finds its block
    by the first places: in a short list of every fan-th, then in one group of them, which is joined
    to it. The first row of each block is also sent, marked, to the block before it, so that block's
    last row finds it there. Ties in key are ordered by a hash of the first carried column; a null key
    comes first.
    """
    order = F.struct(F.col(key).cast("long").alias("key"), F.xxhash64(carried[0]).alias("digest"))
    firsts = settle(block_firsts(rows, order, size, block))
    groups = settle(firsts.groupBy(F.floor(F.col("number") / fan).cast("int").alias("__group")).agg(F.array_sort(F.collect_list("first")).alias("__firsts")))
    blocks = firsts.count()
    tops = [r.top.asDict() for r in groups.select(F.get("__firsts", F.lit(0)).alias("top"), "__group").orderBy("__group").collect()]  # one of `fan` blocks
    listed = F.from_json(F.lit(json.dumps(tops)), "array<struct<key:bigint,digest:bigint>>")
    up_to = lambda list_: F.size(F.filter(list_, lambda x: x <= F.col("__order"))) - 1
    placed = rows.withColumn("__order", order).withColumn("__group", up_to(listed))
    placed = placed.join(F.broadcast(groups) if blocks <= BROADCAST_BLOCKS else groups, "__group").withColumn("__at", up_to(F.col("__firsts")))
    number = F.col("__group") * fan + F.col("__at")
    leads = F.get("__firsts", F.col("__at")) == F.col("__order")
    copy = lambda n, guest: F.struct(n.cast("int").alias("block"), F.lit(guest).alias("guest"))
    own, sent = copy(number, False), copy(F.when(number == 0, blocks - 1).otherwise(number - 1), True)
    dealt = placed.withColumn("__copy", F.explode(F.when(leads, F.array(own, sent)).otherwise(F.array(own)))).drop("__firsts", "__at", "__group")
    ahead = Window.partitionBy("__copy.block").orderBy("__copy.guest", "__order")
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in carried}).where("not __copy.guest")
    return found.drop("__order", "__copy")


def fingerprinted(documents: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, with fingerprints and likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document. A null text counts as empty. Of two rows with one doc_id, the order
    follows a hash of the text. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fp", chosen(F.col("text")))
    rows = beside_next(rows, "doc_id", ["text", "fp"], F.length("text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_fp", chosen(F.col("edited")))
    likely = lambda a, b: let(a, lambda x: let(b, lambda y: likeness(x, y)))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        likely(hashes(F.col("fp")), hashes(F.col("edited_fp"))).alias("near_edited"),
        likely(hashes(F.col("fp")), hashes(F.col("next_fp"))).alias("near_next"),
    )


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
