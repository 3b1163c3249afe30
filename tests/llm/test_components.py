import random

import pytest

from backhaul.llm.components import connected_components
from backhaul.llm.scratch import Scratch


def plain(edges):
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


random.seed(4)
GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 60)],
    "random": [(random.randrange(80), random.randrange(80)) for _ in range(60)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"),
                               Scratch(spark, "test")).collect()
    expected = plain([e for e in edges if e[0] != e[1]])
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    other = {}
    for node, root in expected.items():
        other.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))
    assert all(root in nodes for root, nodes in groups.items())
