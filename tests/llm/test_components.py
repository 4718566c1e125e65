"""Connected components against brute force: chains, stars, cycles, empty."""

import random

from loanlens.llm.components import components


def brute(links):
    comp = {}
    find = lambda x: x if comp.setdefault(x, x) == x else find(comp[x])
    for a, b in links:
        ra, rb = find(a), find(b)
        comp[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in comp}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute([x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
