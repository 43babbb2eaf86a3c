"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. The chance of a
word is the sum, over all ways to cut it into pieces, of the product of their probabilities; a
forward pass over the word's bytes gives it, with a small chance for a byte that no piece
covers. A text's score is the product over its words, each of which begins with the word mark of
the vocabulary. Equal words of a block are scored once, all words of one length in step.

Training takes a bounded sample of labelled texts per language (`sample`), counts its words with
Spark, keeps the most frequent (`words`) and runs a few rounds of expectation-maximisation with
the forward-backward pass, one task per language over that bounded table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_name, settle, table
from .words import BYTE_CODES, SPACE, Block, blocks, give_back, mix

PIECES = public_tokenizers.path("piece_bpe_32k.model")
UNDETERMINED = "und"
#: Labelled texts a language that training looks at, and distinct words it keeps of them.
SAMPLE, WORDS = 3000, 30_000
ROUNDS = 3
#: The chance of a byte that no piece covers.
STRAY = 1e-6
#: Training looks at words in parts of so many characters.
TRAINED_CHARACTERS = 16
#: Ids of drawn texts that are broadcast at most (SAMPLE a language); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Distinct words whose scores a task remembers.
REMEMBERED = 200_000
#: Texts are scored in blocks of about so many bytes.
BLOCK = 1 << 20
WORD_MARK = 32
#: Longer words are scored in stretches, so many bytes each and so many stretches at a time.
LONG, STRETCH, STRETCHES = 1024, 512, 128
#: Leading bits of a hash that tell most places without a piece.
HEAD_BITS = 18
#: Bytes of words that are scored in step.
CELLS = 1 << 18
RATE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces that can stand in a lower-case run of letters, found by rolling hashes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        letter = lambda c: c == " " or c.isalpha() or unicodedata.category(c).startswith("M")
        self.pieces = sorted(x.encode() for x in pieces if x == x.lower() and x.lstrip(" ") and " " not in x[1:] and all(map(letter, x)))
        self.longest = max(map(len, self.pieces))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(x) for x in self.pieces}):
            ids = np.array([i for i, x in enumerate(self.pieces) if len(x) == length])
            hashes = self.hashes(np.frombuffer(b"".join(self.pieces[i] for i in ids), np.uint8).reshape(len(ids), length), length)[:, 0]
            order = np.argsort(hashes)
            heads = np.zeros(1 << HEAD_BITS, bool)
            heads[hashes >> np.uint64(64 - HEAD_BITS)] = True
            self.by_length[length] = hashes[order], ids[order].astype(np.int32), heads

    @staticmethod
    def hashes(rows: np.ndarray, length: int) -> np.ndarray:
        codes = BYTE_CODES[rows]
        h = codes
        for j in range(1, length):
            h = h[:, :-1] * RATE + codes[:, j:]
        return mix(h)

    def matches(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each piece length: the piece at each place of each row, or -1."""
        codes = BYTE_CODES[rows]
        h, found = codes, []
        for length in range(1, min(self.longest, rows.shape[1]) + 1):
            if length > 1:
                h = h[:, :-1] * RATE + codes[:, length - 1 :]
            if length in self.by_length:
                known, ids, heads = self.by_length[length]
                mixed = mix(h).ravel()
                places = np.flatnonzero(heads[mixed >> np.uint64(64 - HEAD_BITS)])  # the rest has no piece
                mixed = mixed[places]
                at = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
                out = np.full(h.size, -1, np.int32)
                out[places] = np.where(known[at] == mixed, ids[at], -1)
                found.append((length, out.reshape(h.shape)))
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def forward(own: Vocabulary, rows: np.ndarray, chances: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """log P of each row (a word's bytes after the word mark) under each language.

    chances: (pieces, languages); lengths: of the rows' words, if some are shorter than the rows. Only
    as many steps back as the longest piece has are kept; the pass rescales them now and then, so
    words of any length keep their value.
    """
    n, length = rows.shape
    lengths = np.full(n, length) if lengths is None else lengths
    back = own.longest + 1
    matches = own.matches(rows)
    ring = np.zeros((back, n, chances.shape[1]))
    ring[0] = 1.0
    scale = np.zeros((n, chances.shape[1]))
    out = np.zeros((n, chances.shape[1]))
    for end in range(1, length + 1):
        total = ring[(end - 1) % back] * STRAY
        for size, ids in matches:
            if size > end:
                break
            hit = np.flatnonzero(ids[:, end - size] >= 0)
            if len(hit):
                total[hit] += ring[(end - size) % back, hit] * chances[ids[hit, end - size]]
        ring[end % back] = total
        done = np.flatnonzero(lengths == end)
        out[done] = np.log(total[done]) + scale[done]
        if end % own.longest == 0 and end < length:
            top = ring.max(axis=0)
            scale += np.log(top)
            ring /= top
    return out


def forward_long(own: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chances: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """The same for words of any length, in time proportional to it.

    Words are cut into stretches. What a stretch does to the last steps before it is a matrix for
    each language, found for many stretches at once by one pass from each of those steps; the
    matrices are then applied in order. Memory is that of STRETCHES stretches, however long a word is.
    """
    back, languages = own.longest, chances.shape[1]
    table = np.vstack([chances, np.zeros(languages)])  # the last row is that of no piece, -1
    out = np.zeros((len(starts), languages))
    state = np.zeros((back, languages))
    pieces = [(w, at, min(stretch, int(size) - at)) for w, size in enumerate(ends - starts + 1) for at in range(0, int(size), stretch)]
    for first in range(0, len(pieces), STRETCHES):
        some = pieces[first : first + STRETCHES]
        rows = np.zeros((len(some), back - 1 + stretch), np.uint8)
        for row, (w, at, size) in zip(rows, some, strict=True):
            low = max(at - (back - 1), 0)  # offset 0 is the word mark
            row[back - 1 - (at - low) : back - 1 + size] = np.concatenate([[WORD_MARK], data[starts[w] : starts[w] + at + size - 1]])[low:] if not low else data[starts[w] + low - 1 : starts[w] + at + size - 1]
        for (w, at, size), (matrix, scale) in zip(some, stretch_matrices(own, rows, np.array([size for *_, size in some]), table), strict=True):
            if at == 0:
                state = np.full((back, languages), -np.inf)
                state[0] = 0.0
            with np.errstate(divide="ignore"):
                terms = np.log(matrix) + scale + state[: matrix.shape[1]]
            top = terms.max(axis=1, keepdims=True)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                state = top[:, 0] + np.log(np.exp(terms - top).sum(axis=1))
            out[w] = state[0]  # stands once the word's last stretch is done
    return out


def stretch_matrices(own: Vocabulary, rows: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stretch: [step back at its end, step back at its start, language], and the log scale [start, language].

    rows have the bytes that could begin a piece before the stretch, then its own.
    """
    back, n, languages = own.longest, len(rows), table.shape[1]
    matches = [(size, ids, (ids >= 0).sum(axis=0)) for size, ids in own.matches(rows)]
    matches = [x for x in matches if x[2].any()]
    base = max((size for size, *_ in matches), default=1)
    ring = np.zeros((back, n, base, languages))
    for j in range(base):
        ring[-j % back, :, j] = 1.0
    scale = np.zeros((n, base, languages))
    ended: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for end in range(1, int(sizes.max()) + 1):
        total = ring[(end - 1) % back] * STRAY
        for size, ids, some in matches:
            at = end - size + back - 1
            if 3 * some[at] > n:
                total += ring[(end - size) % back] * table[ids[:, at]][:, None, :]
            elif some[at]:
                hit = np.flatnonzero(ids[:, at] >= 0)
                total[hit] += ring[(end - size) % back, hit] * table[ids[hit, at]][:, None, :]
        ring[end % back] = total
        if end % back == 0:
            top = ring.max(axis=0)
            top[top == 0] = 1.0
            scale += np.log(top)
            ring /= top
        for k in np.flatnonzero(sizes == end):
            ended[k] = ring[[(end - i) % back for i in range(back)], k], scale[k].copy()
    for k in range(n):
        yield ended.pop(k)


def expected(own: Vocabulary, rows: np.ndarray, weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the rows, by forward-backward for one language."""
    n, length = rows.shape
    matches = own.matches(rows)
    alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    alpha[0], beta[length] = 1.0, 1.0
    for end in range(1, length + 1):
        alpha[end] = alpha[end - 1] * STRAY
        for size, ids in matches:
            if size <= end:
                at = ids[:, end - size]
                alpha[end] += alpha[end - size] * np.where(at >= 0, chances[at], 0.0)
    for start in range(length - 1, -1, -1):
        beta[start] = beta[start + 1] * STRAY
        for size, ids in matches:
            if start + size <= length:
                at = ids[:, start]
                beta[start] += beta[start + size] * np.where(at >= 0, chances[at], 0.0)
    uses = np.zeros(len(chances))
    for size, ids in matches:
        for start in range(length - size + 1):
            at = ids[:, start]
            hit = at >= 0
            share = alpha[start] * beta[start + size] / alpha[length] * weights
            np.add.at(uses, at[hit], (share[hit] * chances[at[hit]]))
    return uses


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their bytes after a word mark."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        length = int(lengths[group[0]])
        step = max(1, min(most, (1 << 20) // (length + 1)))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            rows = np.full((len(part), length + 1), WORD_MARK, np.uint8)
            rows[:, 1:] = data[starts[part][:, None] + np.arange(length)]
            yield part, rows


def by_size(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of about one length, their bytes after a word mark, and their lengths with it."""
    lengths = ends - starts
    class_ = np.where(lengths <= 16, lengths, 16 + np.ceil(np.log(np.maximum(lengths, 1) / 16) / np.log(1.25)).astype(int))
    order = np.lexsort((lengths, class_))
    for group in np.split(order, np.flatnonzero(np.diff(class_[order])) + 1):
        if not len(group):
            continue
        step = max(1, CELLS // (int(lengths[group[-1]]) + 1))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            longest = int(lengths[part].max())
            places = starts[part][:, None] + np.arange(longest)
            rows = np.full((len(part), longest + 1), WORD_MARK, np.uint8)
            rows[:, 1:] = np.where(places < ends[part][:, None], data[np.minimum(places, len(data) - 1)], 0)
            yield part, rows, lengths[part] + 1


def letters(text: str | Column) -> Column:
    """Lower-case runs of letters and marks, with single spaces between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def train(labelled: DataFrame, path: str = PIECES, sample: int = SAMPLE, words: int = WORDS) -> tuple[list[str], np.ndarray]:
    """The languages and the (pieces, languages) table of probabilities from (doc_id, text, lang).

    At most `sample` texts a language, chosen by a hash of doc_id, and of their words the `words`
    most frequent: bounded tables, which the ranking and the fit deal a task a language. Only ids
    and languages are shuffled to choose; the chosen texts are picked in the scan by their ids. The
    table that comes to the driver has a row a piece and language at most.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.select("doc_id", "lang", draw.alias("draw")).join(sizes, "lang").where(F.col("draw") * F.col("n") < 1.2 * sample)
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("rank") <= sample)
    ids = settle(ranked.select("doc_id", "lang").distinct())
    chosen = labelled.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "lang"], "left_semi")
    counted = chosen.select("lang", F.explode(F.regexp_extract_all(letters("text"), F.lit(f"[^ ]{{1,{TRAINED_CHARACTERS}}}"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    frequent = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= words)

    def fit(lang: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = vocabulary(path)
        texts = [w.encode() for w in rows["word"].sort_values()]
        weights = rows.sort_values("word")["n"].to_numpy(float)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        uses = np.zeros(len(own.pieces))
        for part, bytes_ in by_length(data, starts, ends):
            for _, ids in own.matches(bytes_):
                place = np.nonzero(ids >= 0)
                np.add.at(uses, ids[place], weights[part][place[0]])
        for _ in range(ROUNDS):
            chances = uses / max(uses.sum(), 1.0)
            uses = np.zeros(len(own.pieces))
            for part, bytes_ in by_length(data, starts, ends):
                uses += expected(own, bytes_, weights[part], chances)
        kept = np.flatnonzero(uses > 1e-6)
        return pd.DataFrame({"lang": lang[0], "piece": kept, "p": uses[kept] / max(uses.sum(), 1.0)})

    model = frequent.groupBy("lang").applyInPandas(fit, "lang string, piece int, p double").toPandas()
    languages = sorted(model["lang"].unique())
    chances = np.zeros((len(vocabulary(path).pieces), len(languages)))
    chances[model["piece"].to_numpy(int), model["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = model["p"]
    return languages, chances


def predict(documents: DataFrame, languages: list[str], chances: np.ndarray, path: str = PIECES, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the documents, from the text alone.

    score is the chance of the language named, all languages being equally likely beforehand.
    A text that is null or has no letter is `und` with a score of 0; so is every text if nothing
    was learned. Equal chances go to the first language by name. A null or repeated doc_id changes
    nothing; a run of letters of any length is scored whole. Columns lang_pred and score of
    the input are replaced; of the others `keep` stay (all, if not given).
    """
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    plain = free_name(documents, "letters")
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("text").rlike(r"\p{L}"), letters("text")).alias(plain))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != plain), "lang_pred string, score double"])
    names = pa.array([*languages, UNDETERMINED], pa.string())
    shared = documents.sparkSession.sparkContext.broadcast(chances)  # at most one float a piece and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary(path), shared.value)
        for batch in batches:
            texts = batch.column(plain)
            for block in blocks(texts, BLOCK):
                n = len(block)
                best, score = scorer.texts(block)
                same = batch.slice(int(block.rows[0]), n).select(kept)
                yield pa.RecordBatch.from_arrays([*same.columns, names.take(pa.array(best)), pa.array(score)], names=[*kept, "lang_pred", "score"])
        give_back()

    return rows.mapInArrow(run, schema)


class Scorer:
    """Scores blocks of texts; a worker remembers the words of a task up to a bound, then starts anew."""

    def __init__(self, own: Vocabulary, chances: np.ndarray) -> None:
        self.own, self.chances = own, chances
        self.known, self.logs = np.empty(0, np.uint64), np.empty((0, chances.shape[1]))

    def words(self, block: Block, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P of each word, (words, languages); hashes are distinct and in order."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        out = np.empty((len(hashes), self.chances.shape[1]))
        out[~new] = self.logs[at[~new]]
        places = np.flatnonzero(new)
        for part, bytes_, sizes in by_size(block.data, starts[places], ends[places]):
            out[places[part]] = forward(self.own, bytes_, self.chances, sizes)
        if len(places):
            if len(self.known) + len(places) > REMEMBERED:
                self.known, self.logs = hashes, out
            else:
                known = np.concatenate([self.known, hashes[places]])
                order = np.argsort(known)
                self.known, self.logs = known[order], np.concatenate([self.logs, out[places]])[order]
        return out

    def texts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each text of a block the best language (or one more than the last) and its chance."""
        n, languages = len(block), self.chances.shape[1]
        best, score = np.full(n, languages), np.zeros(n)
        starts, ends = block.runs(~SPACE[block.data])
        if len(starts) and languages:
            logs = np.empty((len(starts), languages))
            long = ends - starts > LONG
            short = np.flatnonzero(~long)
            if len(short):
                hashes, first, which = np.unique(block.range_hashes(starts[short], ends[short]), return_index=True, return_inverse=True)
                logs[short] = self.words(block, hashes, starts[short[first]], ends[short[first]])[which]
            if long.any():
                logs[long] = forward_long(self.own, block.data, starts[long], ends[long], self.chances)
            offsets = np.searchsorted(starts, block.offsets)
            some = np.flatnonzero(np.diff(offsets))
            sums = np.add.reduceat(logs, offsets[some], axis=0)
            best[some] = sums.argmax(axis=1)
            score[some] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return best, score


def fold(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are `und`; a null doc_id is not held out, nor learned from; see predict."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages, chances = train(documents.where(fold() != 1))
    found = predict(documents, languages, chances, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no language (null, or without a letter) go; lang becomes the one found."""
    languages, chances = train(docs)
    found = predict(docs, languages, chances).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
