import random

from usagelens.llm.components import components


def brute(links):
    label = {x: x for l in links for x in l}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)]
    rows = spark.createDataFrame([*links, links[0], (5, None), (None, None), (7, 7)], "x long, y long")
    got = {r.id: r.component for r in components(rows, "x", "y").collect()}
    assert got == brute([l for l in links if l[0] != l[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []
