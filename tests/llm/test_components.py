"""Components by stars: what they are, and how many steps and how large a plan they take."""

import numpy as np

from sievelight.llm import common


def _brute(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        top[b] = a
    return {x: find(x) for x in top}


def test_components_stop_at_stars_and_store_each_step(spark, monkeypatch):
    steps, plans, star, stored = [], [], common._star, common.stored

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return stored(df, name)

    monkeypatch.setattr(common, "_star", lambda links, large: steps.append(large) or star(links, large))
    monkeypatch.setattr(common, "stored", kept)
    table = lambda links: spark.createDataFrame([(int(u), int(v)) for u, v in links], "u long, v long")
    got = lambda links: {r.node: r.component for r in common.components(table(links)).collect()}
    hub = [(0, k) for k in range(1, 40)] + [(90, 50), (50, 60), (50, 60)]
    assert got(hub) == _brute(hub) and not steps  # stars already
    rng = np.random.default_rng(3)
    for links in ([(k, k + 1) for k in range(100, 130)], rng.integers(0, 90, (70, 2)), [(7, 7)], []):
        links = [(u, v) for u, v in links]
        rows = common.components(table(links)).collect()
        want = _brute([(u, v) for u, v in links if u != v])
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert steps and max(plans) == 1
