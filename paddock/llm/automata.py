"""Removal of repeated word passages by suffix automata of reference shards.

What the automata hold is each passage that documents share, once, from the document with the
smallest id that has it. The reference passages are cut into shards of about SHARD_WORDS words. A
shard is sent to the tasks that stream the passages of other documents which may lie in it, a hot
shard to several, so no automaton and no task grows with the corpus. The automaton gives
the matching statistics of a stream: the longest suffix of what was read that the shard holds, and the
smallest document that has its last WINDOW words. Words are compared as bytes, so no hash decides.

Which shard may hold a window: equal windows have the same smallest hash among their word
GRAM-grams, so a window is asked for in the shard of the smallest document with that gram. What is
not found there (that document has the gram, but not the window) is asked for anew by hashes of
whole windows, until nothing is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import checkpointed, mix, span_hashes, text_blocks, words

WINDOW = 13
GRAM = 5
BLOCK = 1 << 19
SHARD_WORDS = 50_000
STREAM_WORDS = 1_000_000
_EXACT = np.arange(1, 257, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max
FRAGMENT = "owner bigint, id bigint, key bigint, start bigint, size bigint, words binary"


class SuffixAutomaton:
    """All factors of the added word sequences, with the smallest document of each state."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [_NONE]
        self.last = self.breaks = 0

    def _state(self, length: int, least: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _extend(self, code: int, document: int) -> None:
        next_, link, length = self.next, self.link, self.length
        new = self._state(length[self.last] + 1, document, 0, {})
        at, self.last = self.last, new
        while at >= 0 and code not in next_[at]:
            next_[at][code] = new
            at = link[at]
        if at < 0:
            return
        target = next_[at][code]
        if length[target] == length[at] + 1:
            link[new] = target
            return
        twin = self._state(length[at] + 1, _NONE, link[target], next_[target].copy())
        link[target] = link[new] = twin
        while at >= 0 and next_[at].get(code) == target:
            next_[at][code] = twin
            at = link[at]

    def add(self, sequence: list[bytes], document: int) -> None:
        codes = self.codes
        for word in sequence:
            self._extend(codes.setdefault(word, len(codes)), document)
        self.breaks -= 1  # a symbol of its own, so that no factor goes on into the next sequence
        self._extend(self.breaks, _NONE)

    def seal(self) -> None:
        """Hands the smallest documents down the links, and finds each state's suffix of `window` words."""
        link, length, least, window = self.link, self.length, self.least, self.window
        order = np.argsort(np.array(length), kind="stable").tolist()
        for state in reversed(order[1:]):
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]
        self.holder = holder = [-1] * len(link)
        for state in order[1:]:
            up = link[state]
            holder[state] = (state if length[up] < window else holder[up]) if length[state] >= window else -1

    def found(self, sequence: list[bytes], document: int) -> np.ndarray:
        """For each window of the sequence, by its first word: is it in a smaller document?"""
        next_, link, length, least, holder, window = self.next, self.link, self.length, self.least, self.holder, self.window
        code = self.codes.get
        hits = np.zeros(max(0, len(sequence) - window + 1), dtype=bool)
        state = size = 0
        for end, word in enumerate(sequence):
            c = code(word)
            if c is None:
                state = size = 0
                continue
            moves = next_[state]
            if c not in moves:
                while state > 0 and c not in next_[state]:
                    state = link[state]
                size, moves = length[state], next_[state]
            if c in moves:
                state, size = moves[c], size + 1
                if size >= window and least[holder[state]] < document:
                    hits[end - window + 1] = True
        return hits


def _runs(marks: np.ndarray, values: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the maximal runs of marks; a run ends where the values change."""
    edge = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [] if values is None else (np.flatnonzero(np.diff(values[a:b])) + a + 1).tolist()
        yield from zip([a, *cuts], [*cuts, b])


def _window_values(data: np.ndarray, offsets: np.ndarray, level: int) -> list[np.ndarray]:
    """Per text one value a window: its smallest gram hash at level 1, a hash of the whole window beyond."""
    start, end, first = words(data, offsets)
    word = span_hashes(data, start, end, _EXACT)
    if level > 1:
        word = mix(word + np.uint64(level))
    size = GRAM if level == 1 else WINDOW
    count = max(0, len(word) - WINDOW + 1)
    grams = word[: max(0, len(word) - size + 1)].copy()
    for j in range(1, size):
        grams = grams * _STEP + word[j : len(word) - size + 1 + j]
    grams = mix(grams)
    least = grams[:count].copy()
    for j in range(1, WINDOW - size + 1):
        np.minimum(least, grams[j : count + j], out=least)
    return [least[a : max(a, b - WINDOW + 1)].view(np.int64) for a, b in zip(first[:-1], first[1:])]


def _values(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            found = [np.unique(v) for v in _window_values(data, offsets, level)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(v) for v in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *[rows.column(i).take(at) for i in range(2)]], names=["value", "piece", "id"])

    return run


def _fragments(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            out: list[tuple] = []
            ids, keys, starts, known = (rows.column(i).to_pylist() if i < 3 else rows.column(4) for i in range(4))
            values = _window_values(data, offsets, level)
            for i, windows in enumerate(values):
                value = known[i].values.field("value").to_numpy(zero_copy_only=False)
                order = np.argsort(value)
                value, owner = value[order], known[i].values.field("owner").to_numpy(zero_copy_only=False)[order]
                at = np.minimum(np.searchsorted(value, windows), len(value) - 1)
                shared, owner = value[at] == windows, owner[at]
                if not shared.any():
                    continue
                tokens = data[offsets[i] : offsets[i + 1]].tobytes().split()
                for a, b in _runs(shared, owner):
                    out.append((int(owner[a]), ids[i], keys[i], starts[i] + a, b - a + WINDOW - 1, b" ".join(tokens[a : b + WINDOW - 1])))
            yield pa.RecordBatch.from_pylist([dict(zip(("owner", "id", "key", "start", "size", "words"), r)) for r in out], schema=_FRAGMENT)

    return run


_FRAGMENT = pa.schema([("owner", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("words", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted shards: an automaton grows from a shard's references, then its fragments run through it.

    Gives the covered words (start, stop) of each fragment, and as texts the runs of windows not found.
    """
    shard, automaton = None, None
    for batch in batches:
        out: list[tuple] = []
        for part, salt, is_query, id_, key, start, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            tokens = text.split(b" ")
            if (part, salt) != shard:
                shard, automaton, sealed = (part, salt), SuffixAutomaton(WINDOW), False
            if not is_query:
                automaton.add(tokens, id_)
                continue
            if not sealed:
                automaton.seal()
                sealed = True
            hits = automaton.found(tokens, id_)
            out += [(id_, key, start + a, start + b + WINDOW - 1, None) for a, b in _runs(hits)]
            out += [(id_, key, start + a, None, b" ".join(tokens[a : b + WINDOW - 1]).decode()) for a, b in _runs(~hits)]
        yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in out], schema=_FOUND)


def _shared_passages(pieces: DataFrame, level: int) -> DataFrame:
    """Runs of windows of the pieces (id, key, start, text) by the smallest document that has their value."""
    # pieces of one hash would only look for each other's values, too
    pieces = pieces.withColumn("piece", F.xxhash64("id", "key", "start"))
    values = pieces.select("piece", "id", "text").mapInArrow(_values(level), "value bigint, piece bigint, id bigint")
    owners = values.groupBy("value").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = values.select("value", "piece").join(owners.hint("merge"), "value").groupBy("piece").agg(F.collect_list(F.struct("value", "owner")).alias("known"))
    return checkpointed(pieces.join(known.hint("merge"), "piece").select("id", "key", "start", "text", "known").mapInArrow(_fragments(level), FRAGMENT))


def _stream(fragments: DataFrame) -> DataFrame:
    """(id, key, start, stop, text) of `_match` for all fragments of documents that do not own them."""
    total = fragments.where("id = owner").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    placed = fragments.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(total // SHARD_WORDS + 1)))
    queries = placed.where("id > owner")
    salts = queries.groupBy("shard").agg((F.floor(F.sum("size") / STREAM_WORDS) + 1).alias("salts"))
    # rows that repeat id and text give their reference once
    sources = placed.where("id = owner").groupBy("shard", "id", "key", "start").agg(F.max("words").alias("words"))
    references = sources.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    streams = queries.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.col("salts")))
    columns = ["shard", "salt", "is_query", "id", "key", "start", "words"]
    both = references.withColumn("is_query", F.lit(False)).select(columns).unionByName(streams.withColumn("is_query", F.lit(True)).select(columns))
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_query", "id")
    return checkpointed(dealt.mapInArrow(_match, "id bigint, key bigint, start bigint, stop bigint, text string"))


def covered_words(texts: DataFrame) -> DataFrame:
    """(id, key, spans): word ranges of the texts (id, key, text) that windows of smaller documents cover."""
    pieces, spans, level = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", "key", F.lit(0).cast("bigint").alias("start"), "text"), None, 1
    while level == 1 or not pieces.isEmpty():
        found = _stream(_shared_passages(pieces, level))
        covered = found.where("stop IS NOT NULL").select("id", "key", "start", "stop")
        spans = covered if spans is None else spans.unionByName(covered)
        pieces, level = found.where("stop IS NULL").select("id", "key", "start", "text"), level + 1
    return spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        counts, removed, kept = [], [], []
        for i, spans in enumerate(rows.column(2).to_pylist()):
            tokens = data[offsets[i] : offsets[i + 1]].tobytes().split()
            counts.append(len(tokens))
            if spans:
                gone = np.zeros(len(tokens) + 1, dtype=np.int64)
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["stop"] for s in spans], -1)
                tokens = [t for t, g in zip(tokens, np.cumsum(gone).tolist()) if not g]
            removed.append(counts[-1] - len(tokens))
            kept.append(b" ".join(tokens).decode())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_passages(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept for every row of (doc_id, text).

    Words are the maximal runs of characters other than space and 0x09-0x0D. A word goes if a window of
    WINDOW words that covers it also starts in a document with a smaller id, judged on the input. `kept` is
    what stays, joined by one space. Null and empty texts have no words. Rows without an id keep all and are no
    reference; rows of one id are no references of each other, and those with one id and text get one
    answer. An empty table gives no rows; other columns are not looked at.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    spans = covered_words(texts)
    return texts.join(spans.hint("merge"), ["id", "key"], "left").select("id", "text", "spans").mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
