import random

from tidemark.llm.components import components


def test_chains_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(a, b) for a in range(300, 310) for b in range(300, 310)]
    names = {v: rng.getrandbits(62) * rng.choice([1, -1]) for e in edges for v in e}
    named = [(names[a], names[b]) if rng.random() < 0.5 else (names[b], names[a]) for a, b in edges]
    rng.shuffle(named)
    got = dict(map(tuple, components(spark.createDataFrame(named, "u long, v long")).collect()))
    for group in (range(0, 61), range(1000, 1200), range(300, 310)):
        least = min(names[v] for v in group)
        assert all(got.get(names[v], names[v]) == least for v in group)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
