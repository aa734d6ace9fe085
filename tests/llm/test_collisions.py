import math

import numpy as np
import pytest

from paddock.llm import collisions


def by_hand(rows, cosine=0.9):
    units = []
    for i, v in rows:
        x = np.array([math.nan if c is None else c for c in v], dtype=np.float32).astype(float) if v else np.zeros(0)
        good = i is not None and len(x) and np.isfinite(x).all() and x.any()
        units.append(x / np.linalg.norm(x) if good else None)
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for k, a in enumerate(units):
        for j in range(k):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine and ids[k] != ids[j]:
                links[ids[k]].add(ids[j])
                links[ids[j]].add(ids[k])
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = None if i is None else min(seen)
        out.append((i, len(links[i]) if i is not None else 0, least, i is not None and i == least))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id bigint, embedding array<float>, label int, unit string, n double")


def result(spark, rows):
    return sorted((tuple(r) for r in collisions.near_vectors(table(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def near(rng, v, cosine):
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [v / np.linalg.norm(v) for v in rng.standard_normal((60, 32))]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (3 * near(rng, base[i % 60], 0.97)).tolist()) for i in range(120)]
    rows += [(400 + i, base[0].tolist()) for i in range(50)]
    rows += [(600, None), (601, []), (602, [0.0] * 32), (603, [math.nan] * 32), (604, [math.inf] + [0.0] * 31), (605, [None] + [1.0] * 31), (606, [1e-30] * 32), (607, [1e30] * 32), (608, [1.0, 2.0])]
    rows += [(None, base[0].tolist()), (5, base[5].tolist())]
    assert result(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("vectors", [100, 10_000, 1_000_000])
def test_recall_at_the_threshold_itself(vectors):
    """Pairs just above the threshold, judged by the tables without Spark."""
    rng = np.random.default_rng(2)
    bits = collisions.cell_bits(vectors)
    tables, found = collisions.tables_for(bits), 0
    directions = collisions._projections(64, tables, bits)
    for _ in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        x, y = ((v @ directions).reshape(tables, bits + 1) for v in (a, near(rng, a, 0.9)))
        found += (((x[:, 1:] > 0) == (y[:, 1:] > 0)).all(axis=1) & (np.abs(x[:, 0] - y[:, 0]) <= collisions.WIDTH)).sum() >= collisions.LEAST
    assert found >= 0.97 * 400


def test_recall_in_whole(spark):
    rng = np.random.default_rng(8)
    base = [v / np.linalg.norm(v) for v in rng.standard_normal((300, 64))]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, near(rng, v, 0.905).tolist()) for i, v in enumerate(base)]
    want = {r[0]: r[1] for r in by_hand(rows)}
    got = {r[0]: r[1] for r in result(spark, rows)}
    assert sum(got.values()) >= 0.97 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_tables_grow_slower_than_vectors():
    for vectors in (100, 10_000, 10**6, 10**8):
        bits = collisions.cell_bits(vectors)
        tables = collisions.tables_for(bits)
        assert collisions.recall_of(tables, bits) >= collisions.RECALL > collisions.recall_of(tables - 1, bits)
        assert vectors / 2**bits <= collisions.PER_CELL
    assert collisions.tables_for(collisions.cell_bits(10**8)) < 40 * collisions.tables_for(collisions.cell_bits(10**4))
