import random

import pytest

from tallyforge.llm import components as module
from tallyforge.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("hub_edges", [1_000_000, 20])
def test_chains_hubs_and_random_graphs(spark, monkeypatch, hub_edges):
    """Also where hubs are dealt over parts."""
    monkeypatch.setattr(module, "HUB_EDGES", hub_edges)
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    hub = [(2000, 2000 + i) for i in range(1, 300)] + [(2500, 2001)]
    noise = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges = [*chain, *hub, *noise, *noise, (5000, 5000)]
    rng.shuffle(edges)
    key = lambda i: i.to_bytes(4, "big")
    got = {r.node: r.root for r in components(spark.createDataFrame([(bytearray(key(a)), bytearray(key(b))) for a, b in edges], "a binary, b binary")).collect()}
    assert {bytes(k): bytes(v) for k, v in got.items()} == {key(k): key(v) for k, v in brute(edges).items()}
    assert components(spark.createDataFrame([], "a binary, b binary")).collect() == []
