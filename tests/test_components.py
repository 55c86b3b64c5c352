import random
from pathlib import Path

import pytest
from nichewright.operators.components import connected_components
from nichewright.plans import storage


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(3, 3), (None, 1), (5, 2), (2, 5), (9, 5)], [], [(random.Random(4).randrange(99), i) for i in range(99)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_work_folders_go_when_a_command_ends(spark, monkeypatch):
    monkeypatch.setattr(storage, "_made", [])
    table = storage.materialise(spark.range(3), "gone")
    place = Path(storage._made[0].removeprefix("file://"))
    assert table.count() == 3 and place.exists() and place.parent == Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert storage.discard(spark, keep=storage.made()) == 0 and place.exists()
    assert storage.discard(spark) == 1 and not place.exists() and storage.discard(spark) == 0
