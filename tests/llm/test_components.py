import random

import pytest

from paddock.llm.components import components


def by_hand(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


CASES = {
    "none": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "chain": [(i, i + 1) for i in range(40)],
    "chain backwards": [(40 - i, 39 - i) for i in range(40)],
    "star": [(100, i) for i in range(60)],
    "repeated": [(5, 4), (4, 5), (5, 4), (9, -3)],
    "random": [(random.Random(7).randrange(1000) + i % 7, i) for i in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_union_find(spark, rows, name):
    edges = spark.createDataFrame(CASES[name], "a bigint, b bigint")
    assert rows(components(edges)) == sorted(by_hand(CASES[name]), key=repr)
