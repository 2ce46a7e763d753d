"""Merge bases against a walk of the whole graph."""

import random

import pytest
from pyspark.sql import functions as F

from mergelake.operators import history
from mergelake.sources import shared


def plain(parents, a, b):
    def ancestors(x):
        seen, todo = set(), [x]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += parents.get(c, [])
        return seen

    common = ancestors(a) & ancestors(b)
    return {c for c in common if not any(c != d and c in ancestors(d) for d in common)}


def graph(seed, n=60):
    r = random.Random(seed)
    return {f"c{k}": sorted({f"c{r.randrange(max(0, k - 12), k)}" for _ in range(r.choice([0, 1, 1, 2, 3]))}) if k else [] for k in range(n)}


def frames(spark, parents, pairs, ranks=True):
    rows = [(c, p, int(c[1:]) if ranks else None) for c, p in parents.items()]
    return spark.createDataFrame(rows, "commit string, parents array<string>, rank long"), spark.createDataFrame(pairs, "pair long, ours string, theirs string")


@pytest.mark.parametrize("seed,ranks", [(1, True), (2, True), (3, False)])
def test_merge_bases(spark, seed, ranks):
    parents, r = graph(seed), random.Random(seed)
    pairs = [(k, r.choice(list(parents)), r.choice(list(parents))) for k in range(120)] + [(200, "c5", "c5"), (201, "c5", "nowhere"), (202, None, "c5"), (203, "nowhere", "nowhere")]
    got = {}
    for row in history.merge_bases(*frames(spark, parents, pairs, ranks), shared.kept).collect():
        assert row.base not in got.setdefault(row.pair, set())
        got[row.pair].add(row.base)
    want = {k: plain(parents, a, b) for k, a, b in pairs if a and b}
    assert got == {k: x for k, x in want.items() if x} and any(len(x) > 1 for x in want.values())


def test_walk_stops_above_what_is_shared(spark):
    """Two commits just above the end of a chain of 2000: a few rounds, and nothing of the chain below is visited."""
    n, seen = 2000, []
    parents = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(n)} | {f"c{n}": [f"c{n - 1}"], f"c{n + 1}": [f"c{n - 2}"]}

    def counted(df):
        out = shared.kept(df)
        seen.append(out.count())
        return out

    got = history.merge_bases(*frames(spark, parents, [(1, f"c{n}", f"c{n + 1}")]), counted).collect()
    assert [tuple(r) for r in got] == [(1, f"c{n - 2}")] and len(seen) < 8 and seen[-1] < 8


def test_criss_cross_and_repeated_rows(spark):
    parents = {"c0": [], "c1": ["c0"], "c2": ["c0"], "c3": ["c1", "c2"], "c4": ["c2", "c1"]}
    commits, pairs = frames(spark, parents, [(1, "c3", "c4")])
    got = history.merge_bases(commits.union(commits), pairs, shared.kept).collect()
    assert {r.base for r in got} == {"c1", "c2"} and len(got) == 2
    assert history.merge_bases(commits.limit(0), pairs, shared.kept).count() == 0 and history.merge_bases(commits, pairs.limit(0), shared.kept).count() == 0


def test_generations(spark):
    parents = graph(7, 40)
    want = {}
    for c in parents:  # parents come first
        want[c] = 1 + max((want[p] for p in parents[c]), default=0)
    got = history.generations(frames(spark, parents, [(1, "c1", "c2")])[0], shared.kept).collect()
    assert {r.commit: r["rank"] for r in got} == want
    ranked = spark.createDataFrame(got).join(spark.createDataFrame(list(parents.items()), "commit string, parents array<string>"), "commit")
    assert ranked.filter(F.exists("parents", lambda p: p.isNull())).count() == 0
