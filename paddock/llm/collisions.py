"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

Each table projects the unit vectors on one random direction and orders them by it within cells
given by the signs of further projections. Two vectors collide in a table if they lie in one cell
and one lies in the window of WIDTH around the other. At a cosine of 0.9 a pair collides in a
table with the chance `collision_chance` gives, so the number of tables in which it does is
binomial. A pair must collide LEAST times. Cells get one sign more for each doubling of the
vectors, so that about PER_CELL unrelated ones share a cell, and `tables_for` adds tables until
pairs at the cosine reach LEAST with the asked recall: work grows less than with the square of
the vectors. Pairs that reach the count are verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import checkpointed
from paddock.llm.components import components

PER_CELL = 8
LEAST = 2
WIDTH = 0.6
RECALL = 0.995
COSINE = 0.9


def collision_chance(cosine: float, bits: int, width: float = WIDTH) -> float:
    """Chance that two unit vectors with this cosine collide in one table."""
    same_cell = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    return same_cell * (math.erf(width / distance / math.sqrt(2)) if distance else 1.0)


def cell_bits(vectors: int) -> int:
    """Signs that make up a cell: about PER_CELL vectors share one."""
    return max(1, math.ceil(math.log2(max(2, vectors) / PER_CELL)))


def recall_of(tables: int, bits: int, cosine: float = COSINE, least: int = LEAST) -> float:
    """Chance that a pair at the cosine collides at least `least` times."""
    p = collision_chance(cosine, bits)
    return 1 - sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(least))


def tables_for(bits: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """The fewest tables that keep the recall."""
    tables = LEAST
    while recall_of(tables, bits, cosine) < recall:
        tables += 1
    return tables


def _projections(size: int, tables: int, bits: int) -> np.ndarray:
    """Random directions, the same in every task: per table one to sort by, then the cell's."""
    return np.random.default_rng(size).standard_normal((size, tables * (bits + 1)))


def _project(tables: int, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = frame["unit"].map(np.asarray)
            for size, part in vectors.groupby(vectors.map(len)):
                step = max(1, 1_000_000 // (tables * (bits + 1)))
                for a in range(0, len(part), step):
                    rows = part.iloc[a : a + step]
                    value = (np.stack(rows.to_list()) @ _projections(size, tables, bits)).reshape(len(rows), tables, bits + 1)
                    cell = (value[:, :, 1:] > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (size << bits)
                    yield pd.DataFrame(
                        {
                            "id": np.repeat(frame["id"].to_numpy()[rows.index], tables),
                            "cell": (cell * tables + np.arange(tables)).ravel(),
                            "value": value[:, :, 0].ravel(),
                        }
                    )

    return run


def _cosines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cosine = [float(np.dot(x, y)) for x, y in zip(frame["ua"], frame["ub"])]
        yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "cosine": np.array(cosine, dtype=np.float64)})


def _unit(vector) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    wide = np.asarray(vector, dtype=np.float64)  # null components become NaN
    top = np.abs(wide).max()
    if not np.isfinite(top) or not np.isfinite(wide).all() or top == 0:
        return None
    scaled = wide / top  # so that no square overflows or vanishes
    return scaled / np.sqrt(np.dot(scaled, scaled)) + 0.0


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"vec_id": frame["vec_id"], "unit": [_unit(v) for v in frame["embedding"]]})


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): vectors of length one in double precision; unit is null where a vector is
    null, empty, zero, or has a null or non-finite component."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # ids travel as texts, since pandas would make numbers next to nulls floating
    found = rows.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(_units, "vec_id string, unit array<double>")
    return found.withColumn("vec_id", F.col("vec_id").cast("bigint"))


def candidate_pairs(classes: DataFrame, tables: int, bits: int, count: int = LEAST, width: float = WIDTH) -> DataFrame:
    """Pairs (a < b) of classes (id, unit) that collide in at least `count` tables.

    Values are cut into bins as wide as the window, so a pair lies in one bin or in neighbours,
    and the join is on (cell, bin): skewed ones are split by the adaptive engine.
    """
    placed = classes.mapInPandas(_project(tables, bits), "id bigint, cell bigint, value double")
    placed = placed.withColumn("bin", F.floor(F.col("value") / width))
    right = placed.select(
        F.col("id").alias("id2"), F.col("cell").alias("cell2"), F.col("value").alias("value2"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin2")
    )
    after = (F.col("value2") > F.col("value")) | ((F.col("value2") == F.col("value")) & (F.col("id2") > F.col("id")))
    hits = placed.join(right, (F.col("cell") == F.col("cell2")) & (F.col("bin") == F.col("bin2"))).where(after & (F.col("value2") - F.col("value") <= width))
    return (
        hits.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count).select("a", "b")
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding).

    Equal unit vectors are one class and link with each other without being paired. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Rows without an id link with nothing and have no component;
    rows that repeat an id with an equal vector count as one. Other columns are not looked at.
    """
    rows = units(vectors)
    keyed = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    # the smallest id stands for its class; the class key is the vector itself
    classes = checkpointed(keyed.groupBy("unit").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n")))
    bits = cell_bits(classes.count())
    pairs = candidate_pairs(classes.select("id", "unit"), tables_for(bits, cosine), bits)
    left = classes.select(F.col("id").alias("a"), F.col("unit").alias("ua"))
    right = classes.select(F.col("id").alias("b"), F.col("unit").alias("ub"))
    links = checkpointed(pairs.join(left, "a").join(right, "b").where(F.size("ua") == F.size("ub")).mapInPandas(_cosines, "a bigint, b bigint, cosine double").where(F.col("cosine") >= cosine))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("id").alias("b"), "n")
    outside = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("outside"))
    found = (
        classes.join(outside, F.col("id") == F.col("a"), "left").join(components(links.select("a", "b")), F.col("id") == F.col("node"), "left")
        .select("unit", (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("found"))
    )
    usable = keyed.join(found, "unit").select("vec_id", F.col("links").alias("n_links"), F.col("found").alias("component_id"))
    rest = rows.where("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
