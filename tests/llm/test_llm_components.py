import random

import pytest

from keelson.llm.common import Scratch
from keelson.llm.components import connected_components

SCHEMA = "a long, b long"


def plain(edges):
    group = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((group[a], group[b]))
            group = {x: lo if g == hi else g for x, g in group.items()}
    return sorted((x, min(y for y in group if group[y] == g)) for x, g in group.items())


def graphs():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(150)]
    rng.shuffle(path)
    yield "random", [(rng.randrange(-80, 80), rng.randrange(-80, 80)) for _ in range(90)]
    yield "path", path
    yield "star", [(7, i) for i in range(200)]
    yield "odd", [(1, 1), (None, 2), (2, None), (5, 4), (4, 5), (4, 5), (2 ** 63 - 1, -(2 ** 63))]
    yield "empty", []


@pytest.mark.parametrize("name,edges", list(graphs()))
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges, SCHEMA).repartition(9)
    found = connected_components(df, Scratch(spark, "test")).collect()
    assert sorted((r.node, r.component) for r in found) == plain(edges)
