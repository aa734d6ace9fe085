"""Benchmark passages in documents, found with DataFrame functions only.

Windows as long as an item are laid wherever enough of a document's shingles are the item's: a window
of similarity t shares t / (1 + t) of the shingles of both, so all other windows are out. A window and
an item get SimHash fingerprints of their shingles, a repeated one counted by its occurrences (shingle, k-th
time). Fingerprints are cut into BLOCKS blocks: two within RADIUS bits differ by at most
RADIUS // BLOCKS bits in some block, so looking up every item block with all such flips finds all
of them, among the items whose shingles the window has. What is within the radius is verified by the exact
weighted similarity of the shingles, their weights being how often they occur: sum of the lesser over sum
of the greater counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import SHINGLE, checkpointed

BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
PERCENT = 75
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(tokens: str, size: int) -> Column:
    """Hashes of all runs of `size` words in order; none if there are fewer words."""
    run = ", ".join(f"{tokens}[i + {j}]" for j in range(size))
    return F.expr(f"if(size({tokens}) < {size}, array(), transform(sequence(0, size({tokens}) - {size}), i -> xxhash64({run})))")


def _numbered(hashes: str) -> str:
    """The hashes as (hash, how many equal ones come before), so that all are distinct."""
    nth = f"size(filter(slice({hashes}, 1, i), y -> y = x))"
    return f"if(size(array_distinct({hashes})) = size({hashes}), transform({hashes}, x -> xxhash64(x, 0)), transform({hashes}, (x, i) -> xxhash64(x, if(i = 0, 0, {nth}))))"


def fingerprint(hashes: str) -> Column:
    """SimHash of 64 bits: the majority of each bit over the hashes."""
    majority = f"aggregate({hashes}, 0, (s, x) -> s + 2 * cast(shiftright(x, b) & 1 as int) - 1) > 0"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> if({majority}, shiftleft(1L, b), 0L)), 0L, (a, v) -> a | v)")


def _block(mark: str, number: str) -> str:
    return f"(shiftright({mark}, {BLOCK_BITS} * {number}) & {(1 << BLOCK_BITS) - 1})"


def _bounded(side: DataFrame) -> DataFrame:
    """The side of a join, broadcast if it is counted to be small; a shuffled join beyond."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, size, gram, marks, mark): a key, words, words in a shingle, shingles and fingerprint."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cases = F.coalesce(*[F.when(F.size("w") == n, shingles("w", n)) for n in range(1, SHINGLE)], shingles("w", SHINGLE))
    sized = rows.select("item_id", F.xxhash64("item_id", "w").alias("item"), F.size("w").alias("size"), F.least(F.size("w"), F.lit(SHINGLE)).alias("gram"), cases.alias("marks"))
    return sized.withColumn("numbered", F.expr(_numbered("marks"))).withColumn("mark", fingerprint("numbered")).drop("numbered")


def text_key(text: Column) -> Column:
    """Stands for a text; equal texts have equal keys."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat_ws(":", F.xxhash64(text), F.crc32(text.cast("binary")), F.length(text))


def _places(documents: DataFrame, items: DataFrame, gram: int, percent: int) -> DataFrame:
    """(key, places): per text the items (item, size, starts) with the windows that share enough shingles.

    Of h shingles at positions p that are the item's, a window needs `least`; windows over p[i] to p[i + least - 1]
    have them. Positions are bounded by the text."""
    index = items.select("item", "size", F.size("marks").alias("m"), F.explode(F.array_distinct("marks")).alias("hash")).distinct()
    tokens = documents.select(F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    hits = tokens.select("key", F.size("w").alias("n"), F.posexplode(shingles("w", gram)).alias("pos", "hash")).join(_bounded(index), "hash")
    held = hits.groupBy("key", "n", "item", "size", "m").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    held = held.withColumn("room", F.least("m", F.col("n") - gram + 1)).withColumn("least", F.expr(f"cast(({percent} * (m + room) + {99 + percent}) div {100 + percent} AS int)"))
    reach = "if(p[i + least - 1] - p[i] < room, sequence(greatest(0, p[i + least - 1] - room + 1), least(p[i], greatest(0, n - size))), cast(array() AS array<int>))"
    starts = F.expr(f"array_distinct(flatten(transform(sequence(0, size(p) - least), i -> {reach})))")
    found = held.where("size(p) >= least").withColumn("starts", starts).where("size(starts) > 0")
    return found.groupBy("key").agg(F.collect_list(F.struct("item", "size", "starts")).alias("places"))


def find_items(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity, distance): per row and item the best window.

    Words and shingles are those of the near-duplicate operators; an item of fewer than five words
    is one shingle and is compared with windows of as many words. A document shorter than an item
    is one window. Start counts words; of equal similarities the first window wins. Null, empty and
    short texts and items without words match nothing; null and repeated ids are kept, equal
    rows give one. Empty tables give no rows; other columns are not looked at.
    """
    documents, benchmark = documents.select("doc_id", "text"), benchmark.select("item_id", "text")
    items = checkpointed(_items(benchmark))  # used three times; one row per item
    grams = sorted(r["gram"] for r in items.select("gram").distinct().collect())  # at most five numbers
    out = None
    for gram in grams or [SHINGLE]:
        part = _find(documents, items.where(F.col("gram") == gram), gram, percent)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"))).alias("best")
    found = out.groupBy("doc_id", "text_key", "item_id").agg(best)
    return found.select("doc_id", "text_key", "item_id", (-F.col("best.back")).alias("start"), "best.similarity", (-F.col("best.near")).alias("distance"))


def _find(documents: DataFrame, items: DataFrame, gram: int, percent: int) -> DataFrame:
    limit = RADIUS // BLOCKS
    flips = [sum(1 << b for b in bits) for k in range(limit + 1) for bits in combinations(range(BLOCK_BITS), k)]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    listed = items.select("item_id", F.col("item").alias("item2"), F.col("marks").alias("theirs"), F.col("mark").alias("mark2"), blocks.alias("block2"))
    listed = listed.withColumn("flip", F.explode(F.array(*[F.lit(f) for f in flips]))).withColumn("value2", F.expr(_block("mark2", "block2")).bitwiseXOR(F.col("flip"))).drop("flip")
    places = _places(documents, items, gram, percent)
    rows = documents.withColumn("key", F.xxhash64("text")).join(places, "key").select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"), "places")
    near = rows.select("doc_id", "text_key", shingles("w", gram).alias("all"), F.explode("places").alias("place"))
    # windows are cut out before they become rows of their own
    cut = F.expr(f"transform(place.starts, s -> struct(s AS start, slice(all, s + 1, greatest(0, place.size - {gram - 1})) AS ours))")
    laid = near.select("doc_id", "text_key", "place.item", F.inline(cut))
    marked = laid.withColumn("numbered", F.expr(_numbered("ours"))).withColumn("mark", fingerprint("numbered")).drop("numbered")
    keyed = marked.withColumn("block", blocks).withColumn("value", F.expr(_block("mark", "block")))
    pairs = keyed.join(_bounded(listed), (F.col("item") == F.col("item2")) & (F.col("block") == F.col("block2")) & (F.col("value") == F.col("value2")))
    # a pair is taken at the first block that finds it
    first = F.expr(f"block = 0 or forall(sequence(0, block - 1), j -> bit_count({_block('(mark ^ mark2)', 'j')}) > {limit})")
    distance = F.expr("bit_count(mark ^ mark2)")
    count = lambda a, x: f"size(filter({a}, y -> y = {x}))"
    lesser = F.expr(f"aggregate(array_distinct(ours), 0, (s, x) -> s + least({count('ours', 'x')}, {count('theirs', 'x')}))")
    close = pairs.where(first).withColumn("distance", distance).where(F.col("distance") <= RADIUS).withColumn("lesser", lesser)
    greater = F.size("ours") + F.size("theirs") - F.col("lesser")
    return (
        close.where(F.col("lesser") * 100 >= greater * percent)
        .select("doc_id", "text_key", "item_id", F.col("start").cast("bigint").alias("start"), (F.col("lesser") / greater).alias("similarity"), F.col("distance").cast("bigint").alias("distance"))
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark item."""
    found = find_items(documents, benchmark, percent).select(F.col("text_key").alias("found_key")).distinct()
    return documents.join(found, text_key(F.col("text")) == F.col("found_key"), "left_anti")
