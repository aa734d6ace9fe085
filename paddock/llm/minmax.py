"""Near-duplicate texts by min-max hashing.

Each permutation of the 64-bit words gives two signature values per set, its minimum and its
maximum, so 64 evaluations give 128 values in 32 bands of four. Two large sets with similarity 0.75
share no band with a chance of 5e-6. The two values of a permutation depend on each other in small
sets, so sets of at most WHOLE shingles also have their shingles as buckets: two of them that link
share one. What shares a bucket is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import checkpointed, mix, shingle_hashes, text_blocks
from paddock.llm.components import components

PERMUTATIONS = 64
BAND_PERMUTATIONS = 2
PERCENT = 75
BROADCAST_IDS = 1_000_000  # ids of 8 bytes; more are joined by a shuffle
WHOLE = 16
_draw = np.random.default_rng(20240607)
_FACTOR = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of every permutation for non-empty sets: rows of 2 x PERMUTATIONS words."""
    values = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        image = values * _FACTOR[k] + _SHIFT[k]
        image ^= image >> np.uint64(32)
        out[:, 2 * k] = np.minimum.reduceat(image, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(image, first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of 2 x BAND_PERMUTATIONS neighbouring values."""
    width = 2 * BAND_PERMUTATIONS
    parts = signature.reshape(len(signature), -1, width)
    h = np.zeros(parts.shape[:2], dtype=np.uint64)
    for j in range(width):
        h = mix(h + parts[:, :, j])
    return h


def _buckets(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The buckets of non-empty sets: one of each band, and the shingles of small sets."""
    banded = mix(bands(min_max(sets)) + np.arange(1, PERMUTATIONS // BAND_PERMUTATIONS + 1, dtype=np.uint64))
    return [np.concatenate((row, mix(s))) if len(s) <= WHOLE else row for row, s in zip(banded, sets)]


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, "text"):
        sets = shingle_hashes(data, offsets)
        full = [i for i, s in enumerate(sets) if len(s)]
        found: list[np.ndarray | None] = [None] * len(sets)
        for i, row in zip(full, _buckets([sets[i] for i in full]) if full else []):
            found[i] = row.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n_shingles", "set_key", "buckets"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, "text"):
        sets = shingle_hashes(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set_key", "shingles"]
        )


def _stars(members: DataFrame) -> DataFrame:
    """(bucket, rep, centre): the members of buckets of at least two, without their centre, the one that meets most others."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = members.join(sizes.hint("merge"), "bucket")
    meets = sized.groupBy("rep").agg(F.sum("n").alias("meets"))
    met = checkpointed(sized.drop("n").join(meets.hint("merge"), "rep"))
    # counted from the least up, so that a hot bucket is combined before it is shuffled
    best = met.groupBy("bucket").agg(F.min(F.struct((-F.col("meets")).alias("meets"), "rep")).alias("best"))
    return met.drop("meets").join(best.select("bucket", F.col("best.rep").alias("centre")).hint("merge"), "bucket").where("rep <> centre")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t"))
    counted = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("common"))
    return counted.where(F.col("common") * 100 >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _open(stars: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, centre, rep, group) of the buckets whose members besides the centre are not all of one group.

    The group of a set is the smallest centre it links to, or that centre's; whole components would only
    leave out more."""
    to_centre = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    further = to_centre.select(F.col("node").alias("component"), F.col("component").alias("next"))
    group = to_centre.join(further.hint("merge"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    placed = checkpointed(stars.join(group.hint("merge"), F.col("rep") == F.col("node"), "left").select("bucket", "centre", "rep", F.coalesce("component", "rep").alias("group")))
    mixed = placed.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("bucket")
    return placed.join(mixed.hint("merge"), "bucket")


def _prefixes(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep): the shingles by which an exact prefix filter finds what the given reps link to.

    With its shingles ordered from the rarest among them, a set of n shares one of its first
    n - ceil(percent n / 100) + 1 with whatever it links to. Those of one set alone lead to nothing.
    """
    grams = checkpointed(reps.join(sets.hint("merge"), "rep").select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket")))
    often = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = grams.join(often.hint("merge"), "bucket").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "bucket"))).alias("known"))
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - (n - size(known))").cast("int")
    return known.withColumn("length", length).where("length > 0").select("rep", F.explode(F.expr("slice(known.bucket, 1, length)")).alias("bucket"))


def _pairs(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one family (centre, rep, group) that may link different groups.

    Seen from the centre a set is the shingles D in which it differs from it, and two sets of n and m
    shingles link if (100 + percent) |D ^ D'| <= (100 - percent) (n + m). With
    e = (100 + percent) |D| - (100 - percent) n that is e + e' <= 2 (100 + percent) |D & D'|. So the member with the
    least e links to all whose e is at most minus that, and any other link shares differences, at
    least as many as the least e it can meet asks for: the rarest of D but those are its buckets.
    """
    more, less = 100 + percent, 100 - percent
    s = sets.select("rep", F.col("shingles").alias("s"))
    c = sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("c"))
    seen = families.join(s.hint("merge"), "rep").join(c.hint("merge"), "centre")
    seen = seen.select("centre", "rep", "group", F.size("s").alias("n"), F.array_union(F.array_except("s", "c"), F.array_except("c", "s")).alias("d"))
    seen = checkpointed(seen.withColumn("e", more * F.size("d") - less * F.col("n")))
    least = seen.groupBy("centre").agg(F.min(F.struct("e", "rep")).alias("least"))
    seen = seen.join(least.hint("merge"), "centre").withColumn("certain", F.col("e") + F.col("least.e") <= 0)
    far = seen.where("NOT certain").groupBy("centre").agg(F.min("e").alias("far"))
    seen = seen.join(far.hint("merge"), "centre", "left")
    stars = seen.where(F.col("certain") & (F.col("rep") != F.col("least.rep"))).select(F.col("rep").alias("a"), F.col("least.rep").alias("b"))
    asked = F.greatest(F.lit(1), F.ceil((F.col("e") + F.when(F.col("certain"), F.col("far")).otherwise(F.col("least.e"))) / (2 * more)))
    able = seen.where("far IS NOT NULL").withColumn("length", (F.size("d") - asked + 1).cast("int")).where("length > 0")
    able = checkpointed(able.select("centre", "rep", "group", "n", "e", F.size("d").alias("size"), "length", "d"))
    grams = able.select("centre", "rep", "length", F.explode("d").alias("difference"))
    often = grams.groupBy("centre", "difference").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = grams.join(often.hint("merge"), ["centre", "difference"]).groupBy("centre", "rep", "length").agg(F.sort_array(F.collect_list(F.struct("df", "difference"))).alias("known"))
    # differences of one set alone are shared with none, so the rest bounds what a pair has in common
    known = known.join(able.drop("d", "length").hint("merge"), ["centre", "rep"]).withColumn("length", (F.col("length") - (F.col("size") - F.size("known"))).cast("int")).withColumn("size", F.size("known"))
    own = known.where("length > 0").select("centre", F.explode(F.expr("slice(known.difference, 1, length)")).alias("difference"), "rep", "group", "n", "e", "size")
    other = own.select(*[F.col(x).alias(x + "2") for x in own.columns])
    fits = (F.col("rep2") < F.col("rep")) & (F.col("group") != F.col("group2")) & (F.col("e") + F.col("e2") <= 2 * more * F.least("size", "size2"))
    met = own.join(other.hint("merge"), (F.col("centre") == F.col("centre2")) & (F.col("difference") == F.col("difference2")) & fits)
    return stars.unionByName(met.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))).distinct()


def find_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect whatever links among the members (bucket, rep) of the buckets.

    Members are compared with their bucket's centre. A bucket whose others are of one group then is done.
    The rest meets by its prefix shingles, is compared with the centres there, and what is still
    of different groups by what it differs in from them (`_pairs`). So neither copies nor pages that share a frame become all their pairs.
    """
    star = lambda s: s.select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    stars = checkpointed(_stars(members))
    links = checkpointed(_links(star(stars), sets, percent))
    still = _open(stars, links).select("rep").distinct()
    met = checkpointed(_prefixes(still, sets, percent))
    stars = checkpointed(_stars(met))
    links = links.unionByName(checkpointed(_links(star(stars), sets, percent)))
    families = checkpointed(_open(stars, links).select("centre", "rep", "group").distinct())
    return links.unionByName(checkpointed(_links(_pairs(families, sets, percent), sets, percent)))


def judge(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, set_key and chief for every row of (doc_id, text).

    Texts with the same set are one class, whose smallest id stands for it. The members of a
    bucket are compared as `find_links` says, so no link is lost and no group of copies is expanded
    into all pairs.
    `chief` marks the rows of the smallest id and set of each group. Empty and null texts link with
    nothing and have no set_key; rows without an id link with nothing and have no component.
    Different texts of one id are judged each for itself; rows that repeat id and set get the same
    answer. An empty table gives no rows; other columns are not looked at.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = checkpointed(rows.mapInArrow(_signatures, "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, buckets array<bigint>"))
    known = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"))
    # a node is an id and the number of the set among the sets for which that id stands, nearly always 0
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_key")) - 1
    classes = checkpointed(known.select("set_key", F.struct("doc_id", part.alias("part")).alias("rep"), "buckets"))
    members = classes.select("rep", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = checkpointed(members.join(shared.hint("merge"), "bucket"))
    met = members.select("rep").distinct()
    wanted = checkpointed(met.join(classes.select("rep", "set_key").hint("merge"), "rep").select("rep", "rep.doc_id", "set_key"))
    ids = wanted.select("doc_id").distinct()
    texts_of = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    found = texts_of.mapInArrow(_sets, "doc_id bigint, set_key binary, shingles array<bigint>").join(wanted.hint("merge"), ["doc_id", "set_key"])
    sets = checkpointed(found.select("rep", "shingles").dropDuplicates(["rep"]))
    label = components(find_links(members, sets, percent))
    found = F.coalesce("component", "rep")
    of_class = classes.join(label, F.col("rep") == F.col("node"), "left").select("set_key", found["doc_id"].alias("found"), (found == F.col("rep")).alias("first"))
    return (
        signed.drop("buckets").join(of_class, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
        .select("doc_id", "text_key", "n_shingles", "component_id", "set_key", F.coalesce(F.col("first") & (F.col("doc_id") == F.col("found")), F.lit(False)).alias("chief"))
    )


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id, text), see `judge`; rows without an id are not kept."""
    return judge(documents, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group with all its columns: the one with the smallest id.

    Texts without words and rows without an id stay as they are. Of the rows that repeat the id
    and the set of a group's chief one stays: of different texts that of the smallest hash, of equal
    texts the first by the other columns.
    """
    chiefs = judge(documents.select("doc_id", "text"), percent)
    lone = chiefs.where("doc_id IS NOT NULL AND set_key IS NULL").select("doc_id", "text_key", F.lit(True).alias("lone")).distinct()
    kept = chiefs.where("chief").groupBy("doc_id", "set_key").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key", F.lit(False).alias("lone"))
    keys = lone.unionByName(kept).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "lone")
    own = [F.col(f"d.`{c}`") for c in documents.columns]
    on = (F.col("d.doc_id") == F.col("kept_id")) & (F.xxhash64("d.text") == F.col("kept_key"))
    order = [c for c, f in zip(own, documents.schema) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    nth = F.row_number().over(Window.partitionBy("kept_id", "kept_key").orderBy(*order))
    chosen = documents.alias("d").join(keys, on).withColumn("nth of its kind", nth).where("lone OR `nth of its kind` = 1").select(*own)
    return chosen.unionByName(documents.where("doc_id IS NULL"))
