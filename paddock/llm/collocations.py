"""Phrase collocations by broadcast double-array tries.

Candidates are made level by level: a phrase of k words is asked for only where the k - 1 words it
starts with and those it ends with are candidates, which a bitmap of fixed size answers (it may say
yes too often, never no). Its sum over all blocks of text must reach the least count. The candidates
become double-array tries of at most TRIE_PHRASES phrases each, which are broadcast one after the
other. In a trie the states of all text positions advance at once, a word at a time, accepting states
are counted by bincount in each task, and the tasks' counts are summed. Those counts are exact: words
and phrases are known by 64-bit hashes, and if any two that matter share one, all is done anew with
other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import checkpointed, mix, span_hashes, text_blocks

LEAST = 100
LONGEST = 5
TOP = 2000
BLOCK = 1 << 21
TRIE_PHRASES = 250_000
FILTER_BITS = 24
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)
CHUNK = 512


class Positions:
    """The words of a block of texts: symbols (hashes of language and word) and how many words go on in the piece."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, seed: int) -> None:
        inside = ~_BETWEEN[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1]))[: len(data)]
        after = np.concatenate((inside[1:], [False]))[: len(data)]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.document = np.searchsorted(offsets, self.start, "right") - 1
        langs = rows.column(1).to_pylist()
        salts = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8)).digest()) for lang in set(langs)}
        salt = np.array([salts[lang] for lang in langs], dtype=np.uint64)
        self.symbol = mix(span_hashes(data, self.start, self.end) + salt[self.document])
        breaks = np.cumsum(_BREAK[data])
        piece = breaks[self.start] if len(self.start) else np.zeros(0, dtype=np.int64)
        last = np.flatnonzero(np.append((np.diff(piece) != 0) | (np.diff(self.document) != 0), True)) if len(piece) else np.zeros(0, dtype=np.int64)
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece)) + 1

    def phrases(self, size: int) -> np.ndarray:
        """A hash of the `size` words from each position on; meaningless where fewer are left."""
        h = self.symbol
        for j in range(1, size):
            h = mix(h * _STEP + np.concatenate((self.symbol[j:], np.zeros(min(j, len(h)), dtype=np.uint64)))[: len(h)])
        return h


def _blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Positions]]:
    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        yield rows, data, Positions(rows, data, offsets, seed)


def _count_words(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in _blocks(batches, seed):
            symbol, first, n = np.unique(at.symbol, return_index=True, return_counts=True)
            found = [data[a:b].tobytes().lower().decode() for a, b in zip(at.start[first].tolist(), at.end[first].tolist())]
            langs = rows.column(1).take(pa.array(at.document[first]))
            yield pa.RecordBatch.from_arrays([langs, pa.array(found, pa.string()), pa.array(symbol.view(np.int64)), pa.array(n)], names=["lang", "word", "symbol", "n"])

    return run


def _count_phrases(size: int, known: Broadcast, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of `size` words whose first and last `size` - 1 words the bitmap knows, counted by block, with the low half of the last symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(known.value, bitorder="little").view(bool)
        for _, _, at in _blocks(batches, seed):
            shorter = at.phrases(size - 1)
            safe = bits[shorter >> np.uint64(64 - FILTER_BITS)]
            here = np.flatnonzero((at.left >= size) & safe & np.append(safe[1:], False))
            last = at.symbol[here + size - 1]
            columns = [mix(shorter[here] * _STEP + last), last & _LOW]
            order = np.argsort(columns[0])
            columns = [c[order].view(np.int64) for c in columns]
            first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))[: len(order)])
            columns = [*(c[first] for c in columns), np.diff(np.append(first, len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["phrase", "low", "n"])

    return run


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Which leading FILTER_BITS of the phrases' hashes occur: 2 ** FILTER_BITS bits, however many phrases."""
    bit = F.shiftrightunsigned("phrase", 64 - FILTER_BITS)
    found = phrases.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("bigint").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


class DoubleArrayTrie:
    """Slots of all prefixes of phrases of symbols: child = base[slot] + code where check[child] is the slot."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        """`symbols` has the phrases one after the other, `sizes` their numbers of words."""
        self.alphabet = np.unique(symbols)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        letters = len(self.alphabet)
        place = np.searchsorted(self.alphabet, symbols)
        inner = np.ones(len(symbols), dtype=bool)
        inner[first] = False
        # what follows other words most often has the smallest codes, so that families lie close
        self.code = np.empty(letters, dtype=np.int64)
        self.code[np.argsort(-np.bincount(place[inner], minlength=letters), kind="stable")] = np.arange(1, letters + 1)
        code = self.code[place]
        self.base, self.check = np.zeros(letters + 2, dtype=np.int32), np.full(letters + 2, -1, dtype=np.int32)
        self.slot = np.zeros(len(sizes), dtype=np.int64)  # of each phrase
        for depth in range(int(sizes.max(initial=0))):  # a level at a time
            rows = np.flatnonzero(sizes > depth)
            pair = self.slot[rows] * (letters + 1) + code[first[rows] + depth]
            pairs, back = np.unique(pair, return_inverse=True)
            parent, letter = pairs // (letters + 1), pairs % (letters + 1)
            self.slot[rows] = (letter if depth == 0 else self._place(parent, letter))[back]
            if depth == 0:
                self.check[letter] = 0

    def _room(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int32)))
            self.check = np.concatenate((self.check, np.full(more, -1, dtype=np.int32)))

    def _place(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Slots of the children (parent, letter), sorted by both: families from the largest on, then single children into the holes."""
        self.cursor = end = len(self.alphabet) + 1  # slots up to there belong to single words; no base is negative
        heads = np.flatnonzero(np.diff(parent, prepend=-1))
        sizes = np.diff(np.append(heads, len(parent)))
        slots = np.empty(len(parent), dtype=np.int64)
        for k in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            a, b = int(heads[k]), int(heads[k] + sizes[k])
            codes, owner = letter[a:b], parent[a]
            base = self.cursor
            while True:  # the next few bases at a time, until all children fall on free slots
                tries = base + np.arange(64 if b - a < 64 else 8)
                self._room(int(tries[-1] + codes[-1] + 1))
                fits = (self.check[tries[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    base = int(tries[np.argmax(fits)])
                    break
                base = int(tries[-1]) + 1 if b - a < 64 or base >= end else end
            self.cursor, end = base, max(end, base + int(codes[-1]) + 1)
            slots[a:b] = base + codes
            self.check[slots[a:b]] = owner
            self.base[owner] = base
        lone = heads[sizes == 1]
        start = len(self.alphabet) + 1
        holes = np.flatnonzero(self.check[start:] < 0)[: len(lone)] + start
        if len(holes) < len(lone):
            end = len(self.check)
            holes = np.concatenate((holes, end + np.arange(len(lone) - len(holes))))
        if len(lone):
            self._room(int(holes[-1]) + 1)
            slots[lone] = holes
            self.check[holes] = parent[lone]
            self.base[parent[lone]] = holes - letter[lone]
        return slots

    def count(self, at: Positions) -> np.ndarray:
        """How often each slot is reached from all positions."""
        place = np.minimum(np.searchsorted(self.alphabet, at.symbol), len(self.alphabet) - 1)
        code = np.where(self.alphabet[place] == at.symbol, self.code[place], 0)
        here = np.flatnonzero(code)
        state = code[here]
        total = np.bincount(state, minlength=len(self.check))
        for depth in range(1, LONGEST):
            more = at.left[here] > depth
            here, state = here[more], state[more]
            letter = code[here + depth]
            child = np.minimum(self.base[state] + letter, len(self.check) - 1)
            good = (letter > 0) & (self.check[child] == state)
            here, state = here[good], child[good]
            if not len(here):
                break
            total += np.bincount(state, minlength=len(self.check))
        return total


def _unmix(h: np.ndarray) -> np.ndarray:
    """What `mix` makes h of."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        h = h ^ (h >> np.uint64(shift)) ^ (h >> np.uint64(2 * shift))
        h = h * np.uint64(pow(factor, -1, 1 << 64))
    return h


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of all but the last word, from that of the phrase and the last symbol."""
    for batch in batches:
        phrase, last = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(((_unmix(phrase) - last) * _STEP_INVERSE).view(np.int64))], names=["phrase", "last", "word", "prefix"])


def _count_trie(shared: Broadcast, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, phrase = shared.value
        total = np.zeros(len(trie.check), dtype=np.int64)
        for _, _, at in _blocks(batches, seed):
            total += trie.count(at)
        n = np.zeros(-(-len(phrase) // CHUNK) * CHUNK, dtype=np.int64)
        n[: len(phrase)] = total[trie.slot]
        chunks = n.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        counts = pa.FixedSizeListArray.from_arrays(pa.array(chunks[some].ravel()), CHUNK).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), counts], names=["chunk", "counts"])

    return run


def _sum_chunks(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """Sums the tasks' counts of one chunk of phrases."""

    def run(parts: pa.Table) -> pa.Table:
        chunk = parts.column("chunk")[0].as_py()
        phrase = shared.value[1][chunk * CHUNK : (chunk + 1) * CHUNK]
        n = parts.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, CHUNK).sum(axis=0)[: len(phrase)]
        return pa.table({"phrase": phrase, "n": n})

    return run


def _candidates(texts: DataFrame, words: DataFrame, least: int, seed: int) -> DataFrame:
    """(phrase, symbols, lang, words): every phrase that can have the least count."""
    frequent = checkpointed(words.where(F.col("n") >= least).select("lang", "word", "symbol"))
    level = frequent.select(F.col("symbol").alias("phrase"), F.array("symbol").alias("symbols"), "lang", F.array("word").alias("words"))
    found, last = level, frequent.select(F.col("symbol").alias("last"), "word", F.col("symbol").bitwiseAND(F.lit(int(_LOW))).alias("low"))
    for size in range(2, LONGEST + 1):
        known = texts.sparkSession.sparkContext.broadcast(_bitmap(level))
        counted = texts.mapInArrow(_count_phrases(size, known, seed), "phrase bigint, low bigint, n bigint")
        enough = counted.groupBy("phrase", "low").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        before = level.select(F.col("phrase").alias("prefix"), "symbols", "lang", "words")
        # of the words that share the low half only the right one leads to a known prefix
        ended = enough.join(last, "low").select("phrase", "last", "word").mapInArrow(_prefixes, "phrase bigint, last bigint, word string, prefix bigint")
        longer = ended.join(before, "prefix")
        level = checkpointed(longer.select("phrase", F.concat("symbols", F.array("last")).alias("symbols"), "lang", F.concat("words", F.array("word")).alias("words")))
        found = found.unionByName(level)
    return found


def phrase_counts(documents: DataFrame, least: int = LEAST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n) for all phrases of at most LONGEST words with at least `least` occurrences, and (lang, n) with all word occurrences."""
    texts = documents.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text IS NOT NULL")
    counted = texts.mapInArrow(_count_words(seed), "lang string, word string, symbol bigint, n bigint")
    words = checkpointed(counted.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n")))
    found = _candidates(texts, words, least, seed)
    twice = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("of"), F.max("n").alias("n")).where(f"of > 1 AND n >= {least}")
    if not twice(words, "symbol").isEmpty() or not twice(found.withColumn("n", F.lit(least)), "phrase").isEmpty():
        return phrase_counts(documents, least, seed + 1)
    blocks, counts = found.count() // TRIE_PHRASES + 1, None
    for block in range(blocks):
        part = found.where(F.pmod("phrase", F.lit(blocks)) == block).select("phrase", "symbols").orderBy("phrase").toArrow()
        if not len(part):
            continue
        symbols = part.column("symbols").combine_chunks()
        trie = DoubleArrayTrie(symbols.flatten().to_numpy(zero_copy_only=False).view(np.uint64), symbols.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        shared = texts.sparkSession.sparkContext.broadcast((trie, part.column("phrase").to_numpy()))
        parts = texts.mapInArrow(_count_trie(shared, seed), "chunk bigint, counts array<bigint>")
        summed = parts.groupBy("chunk").applyInArrow(_sum_chunks(shared), "phrase bigint, n bigint")
        counts = summed if counts is None else counts.unionByName(summed)
    if counts is None:
        counts = texts.sparkSession.createDataFrame([], "phrase bigint, n bigint")
    exact = checkpointed(counts.where(F.col("n") >= least).join(found.drop("symbols"), "phrase").select("lang", "words", "n"))
    return exact, words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases of 2 to LONGEST words.

    a, l and r count the phrase and the parts of its worst cut, n all words of the language. Phrases
    inside a longer candidate that occurs as often are left out. Texts are lower-cased (A-Z); null texts
    are empty, rows that repeat count each, a null lang is `und`. Other columns are not looked at,
    ids neither. An empty table gives no rows.
    """
    counts, totals = phrase_counts(documents, least)
    text = lambda words: F.array_join(words, " ")
    parts = counts.select("lang", text("words").alias("part"), F.col("n").alias("f"))
    candidates = counts.where(F.size("words") > 1).select("lang", "words", text("words").alias("phrase"), F.col("n").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.withColumn("left", text(F.slice("words", F.lit(1), F.col("k")))).withColumn("right", text(F.slice("words", F.col("k") + 1, F.size("words"))))
    cut = cut.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("div(a1000 * wide_n, wide_l * wide_r)")
    scored = cut.join(totals, "lang").withColumns({"a1000": (F.col("a") * 1000).cast("decimal(19,0)"), "wide_n": wide("n"), "wide_l": wide("l"), "wide_r": wide("r")}).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    # a longer phrase that occurs as often has one of one word more inside it that does so, too
    inner = candidates.where(F.size("words") > 2).withColumn("phrase", F.explode(F.array(text(F.slice("words", F.lit(1), F.size("words") - 1)), text(F.slice("words", F.lit(2), F.size("words"))))))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    shown = left.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score").withColumn("rank", rank).where(F.col("rank") <= top)
    return shown.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
