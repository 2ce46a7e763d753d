"""Walks that end early, and a chunk of pairs by itself, split into parts."""

import random

import pyarrow as pa
import pyarrow.compute as pc
from test_history import graph, plain

from mergelake.operators import history
from mergelake.sources import shared


def test_a_pair_ends_when_one_side_has_nothing_left(spark):
    """A chain of 60 and a commit of a higher rank without parents have nothing in common: the chain is not walked."""
    rows, seen = [(f"c{k}", [f"c{k - 1}"] if k else [], k) for k in range(60)] + [("alone", [], 999)], []

    def counted(df):
        seen.append(df)
        return shared.kept(df)

    commits = spark.createDataFrame(rows, "commit string, parents array<string>, rank long")
    assert history.merge_bases(commits, spark.createDataFrame([(1, "c59", "alone")], "pair long, ours string, theirs string"), counted).count() == 0
    assert len(seen) < 8


def test_chunks_are_split_between_pairs(monkeypatch):
    monkeypatch.setattr(history, "CHUNK_ROWS", 40)
    parents, r = graph(5), random.Random(5)
    names = [*parents, "nowhere"]
    rank = lambda c: int(c[1:]) if c in parents else history.UNRANKED
    low = lambda c: max(map(rank, parents.get(c, [])), default=history.NO_PARENTS)
    pairs = [(k, r.choice(names), r.choice(names)) for k in range(120)]
    seeds = [(k, names.index(c), rank(c), low(c), paint) for k, a, b in pairs for c, paint in ({a: 3} if a == b else {a: 1, b: 2}).items()]
    todo = [history._first((pa.scalar("0"),), pa.table(dict(zip(("pair", "id", "rank", "low", "paint"), map(list, zip(*seeds, strict=True)), strict=True))))]
    got, chunks = {}, set()
    while todo:
        said = todo.pop()
        for row in said.filter(pc.equal(said["kind"], history.BASE)).to_pylist():
            assert names[row["id"]] not in got.setdefault(row["pair"], set())
            got[row["pair"]].add(names[row["id"]])
        for chunk in said.filter(pc.equal(said["kind"], history.STATE))["chunk"].to_pylist():
            chunks.add(chunk)
            own = said.filter(pc.equal(said["chunk"], chunk))
            asked = own.filter(pc.equal(own["kind"], history.QUESTION))["id"].to_pylist()
            edges = [(k, names.index(p), rank(p), low(p)) for k in asked for p in parents[names[k]]]
            answers = pa.table(dict(zip(("id", "parent", "parent_rank", "parent_low"), map(list, zip(*edges, strict=True)), strict=True)))
            todo.append(history._further((pa.scalar(chunk),), own.filter(pc.equal(own["kind"], history.STATE)), answers))
    assert got == {k: x for k, a, b in pairs if (x := plain(parents, a, b))} and len(chunks) > 3
