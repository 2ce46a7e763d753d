"""Decontamination, whitening and vector codes against plain versions, on awkward and empty tables, and against SQL."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import same

from mergelake.llm import codes, decontam, queries, vectors, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_leaks(texts, items, size=10, threshold=1.0, shingle=5):
    """[(n_words, hit places, sorted items)] of each text, every window against every item's windows."""
    records = {}
    for name, t in items:
        w = tokens(t)
        n = min(size or len(w), len(w))
        for a in range(len(w) - n + 1 if n else 0):
            records.setdefault(tuple(w[a : a + n]), set()).add("null" if name is None else str(name))
    sets = lambda w: {w[k : k + min(shingle, len(w))] for k in range(len(w) - min(shingle, len(w)) + 1)}
    out = []
    for t in texts:
        w, hit, named = tokens(t), set(), set()
        for r, names in records.items():
            needs = max(1, math.ceil(threshold * len(sets(r)) - 1e-9))
            for a in range(len(w) - len(r) + 1):
                x = tuple(w[a : a + len(r)])
                if x == r if threshold >= 1 else len(sets(x) & sets(r)) >= needs:
                    hit.update(range(a, a + len(r)))
                    named |= names
        out.append((len(w), hit, sorted(named)))
    return out


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)] + ["ñandú", "Éau", "x1"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, prose(40)), (2, prose(12)), (None, "short Item here"), (4, None), (5, ""), (6, "?! ..."), (7, "one"), (8, "a b c d e a b c d e"), (9, prose(25)), (9, prose(11)), (10, "loop " * 14)]
    items += [(30, items[0][1]), (11, items[0][1].split(" ", 3)[3])]
    texts = [None, "", "...", "one", "ONE two", prose(9), "b c d e a b c d e a", "b c d e a b c d e a b c d e", "loop " * 400, items[0][1], "x " + items[0][1].upper().replace(" ", "-- ") + " y"]
    for _, t in items[:2] + items[8:10]:
        w = t.split()
        texts += [prose(30) + " " + " ".join(w[2:12]) + " " + prose(20), " ".join(w[:9]) + " " + prose(5), prose(3) + " short, item: HERE " + prose(3), " ".join([*w[:5], "other", *w[6:]])]
    texts += [prose(600), prose(3000) + " " + items[8][1], texts[-1], texts[-1]]
    return items, texts


def leak_frames(spark, items, texts):
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(k, i, t, "i", "s", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "n long, doc_id long, text string, item string, spans string, id int")
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, words string")
    return docs.repartition(3), bench



@pytest.mark.parametrize("size,threshold,part_bytes", [(10, 1.0, 1 << 20), (10, 1.0, 150), (None, 1.0, 1 << 20), (10, 0.8, 1 << 20), (None, 0.6, 700), (4, 1.0, 1 << 20)])
def test_decontaminate(spark, leaks, size, threshold, part_bytes):
    items, texts = leaks
    docs, bench = leak_frames(spark, items, texts)
    got = decontam.decontaminate(docs, bench, size, threshold=threshold, part_bytes=part_bytes, id_col="n")
    got = sorted((r.n, r.n_words, r.n_hit, sorted(k for s in r.spans for k in range(s.start, s.end)), r["items"]) for r in got.collect())
    want = [(k, n, len(hit), sorted(hit), named) for k, (n, hit, named) in enumerate(plain_leaks(texts, items, size, threshold))]
    assert got == want
    assert sum(n for _, _, n, _, _ in want) > 100 and any(not n for _, _, n, _, _ in want)


def test_decontaminate_null_and_shared_ids(spark, leaks):
    items, texts = leaks
    docs, bench = leak_frames(spark, items, texts)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontam.decontaminate(docs, bench).collect())
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    assert got == sorted((str(i), n, len(hit)) for i, (n, hit, _) in zip(ids, plain_leaks(texts, items), strict=True))


def test_decontaminate_empty(spark, leaks):
    docs, bench = leak_frames(spark, *leaks)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    none = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.n_hit or r["items"] or r.spans for r in none)


def test_prefix_is_the_rarest(leaks):
    """At a threshold of 1 a record has one prefix token, its rarest; below it more, and never more than it must."""
    records = decontam.Records.of(["a b c d e f g h i j"], 5)[0]
    seen = {h: 10 + k for k, h in enumerate(records.hashes.tolist())}
    seen[int(records.hashes[3])] = 1
    assert decontam.Index(records, seen, 1.0).tokens.hashes.tolist() == [records.hashes[3]]
    assert set(decontam.Index(records, seen, 0.8).tokens.hashes.tolist()) == {records.hashes[3], records.hashes[0]}


def test_op12(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op12_benchmark_decontamination"](spark, sf_dir).collect()}
    records = {}
    for name, t in items:
        w = tokens(t)
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            records.setdefault(tuple(w[a : a + 10]), set()).add(str(name))
    found = 0
    for i, t in texts:
        w, hit, named = tokens(t), set(), set()
        for n in {len(r) for r in records}:
            for a in range(len(w) - n + 1):
                if (x := records.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    named |= x
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(named), digest, bool(hit))
        found += bool(hit)
    assert found and len(got) == len(texts)


@pytest.mark.parametrize("name", ["op12_benchmark_decontamination", "op13_vector_codes"])
def test_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]))


VECTORS = "vec_id long, embedding array<float>, label int, x string, id int, code string, n long, at int"


def vector_rows(n=60, dims=8, seed=3):
    """Vectors with nulls, infinities, other lengths, repeated rows, ties, shared and missing ids; a third of them is one vector."""
    r = np.random.RandomState(seed)
    hot = r.standard_normal(dims).round(2).tolist()
    out = [(None if k % 7 == 0 else 5 if k % 7 == 1 else 100 - k, hot if k % 3 == 0 else (r.standard_normal(dims) * r.choice([0.1, 3])).round(2).tolist(), None if k % 5 == 0 else k % 3) for k in range(n)]
    out += [(1, None, 1), (2, [None, *hot[1:]], 1), (3, [float("nan"), *hot[1:]], 1), (4, [float("inf"), *hot[1:]], 1), (6, hot[1:], 1), (7, [], 1), (8, [-0.0] * dims, 2), out[4], out[4], out[5]]
    return [(i, v, lab, "x", 1, "c", 2, 3) for i, v, lab in out]


def kept_plain(rows, dims, scale):
    f32 = lambda v: [float(np.float32(c)) for c in v]
    return [(i, [math.floor(scale * c) + 0 for c in f32(v)], lab) for i, v, lab, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def plain_codes(kept, n_parts, entries, rounds):
    """Codes, errors and codebooks by hand, every part against every entry."""
    width = -(-len(kept[0][1]) // n_parts)
    padded = [(i, v + [0] * (width * n_parts - len(v)), lab) for i, v, lab in kept]
    parts = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(n_parts)]
    first = sorted(padded, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[parts(v)[p] for _, v, _ in first] for p in range(n_parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((square(x, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        held = [{} for _ in range(n_parts)]
        for _, v, _ in padded:
            for p, x in enumerate(parts(v)):
                held[p].setdefault(near(p, x)[1], []).append(x)
        for p in range(n_parts):
            for e, xs in held[p].items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = [(i, lab, [near(p, x) for p, x in enumerate(parts(v))]) for i, v, lab in padded]
    return [(i, lab, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c)) for i, lab, c in out], books


@pytest.mark.parametrize("dims,n_parts,entries", [(8, 4, 16), (7, 4, 5), (8, 2, 256), (3, 3, 1)])
def test_codes(spark, dims, n_parts, entries):
    rows = vector_rows(dims=dims)
    got = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), n_parts, entries).collect()
    want, books = plain_codes(kept_plain(rows, dims, 1024), n_parts, entries, 4)
    by_label = {}
    for _, lab, _, e in want:
        by_label[lab] = by_label.get(lab, 0) + e
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == sorted((str(i), c, e, by_label[lab]) for i, lab, c, e in want)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_empty_and_extreme(spark):
    frame = spark.createDataFrame(vector_rows(), VECTORS)
    assert codes.compress(frame.limit(0)).count() == 0 and codes.compress(frame.filter("embedding IS NULL")).count() == 0
    huge = spark.createDataFrame([(k, [3e38, -3e38, float(k), 1.0], 1, "x", 1, "c", 2, 3) for k in range(4)], VECTORS)
    assert {r.error for r in codes.compress(huge).collect()} == {0}


def test_trie_shares_prefixes():
    """The walk gives every part's nearest entry, for sorted parts in many blocks, unsorted ones and large numbers."""
    r = np.random.RandomState(1)
    for scale in (3, 1 << 26):
        parts = np.unique(r.randint(-scale, scale, (1500, 5)), axis=0)
        book = r.randint(-scale, scale, (40, 5))
        for x in (parts, parts[r.permutation(len(parts))]):
            every = ((x[:, None].astype(object) - book[None]) ** 2).sum(axis=2).astype(np.int64)
            entry, distance = codes.nearest(x, book)
            assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    leaves, which = codes.sorted_distinct(np.array([[2, 1], [1, 5], [2, 1], [1, 4]]))
    assert leaves.tolist() == [[1, 4], [1, 5], [2, 1]] and which.tolist() == [2, 1, 2, 0]


def plain_whitening(kept, want=4):
    """By exact sums and the library's eigenvectors."""
    fit = sorted({tuple(v) for _, v, _ in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, object)
    v = ((n * x - np.array(total, object)).T @ (n * x - np.array(total, object))).astype(float) / n**3
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1][:want], vectors_[:, ::-1][:, :want]
    deviation = {tuple(y): sum((n * c - s) ** 2 for c, s in zip(y, total, strict=True)) for y in fit}
    white = lambda y: (np.array(y) - np.array([s / n for s in total])) @ vectors_ / np.sqrt(values)
    return n, values, values / np.trace(v), deviation, white


def check_whitening(got, kept, want=4):
    n, values, explained, deviation, white = plain_whitening(kept, want)
    by = sorted(((str(i), deviation[tuple(v)], tuple(np.abs(white(v)).round(7))) for i, v, _ in kept), key=str)
    rows = {}
    for r in got:
        assert r.n == n and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and 0 <= r.identity_error < 1e-9 and math.isclose(r.eigenvalue, values[r.component - 1], rel_tol=1e-10)
        rows.setdefault((str(r.vec_id), r.deviation), []).append((r.component, r.whitened))
    assert len(got) == len(kept) * len(values)
    flat = sorted((i, d, c, round(abs(w), 6)) for (i, d), x in rows.items() for c, w in x)
    assert np.allclose([x[3] for x in flat], [x[3] for x in sorted((i, d, k + 1, round(w, 6)) for i, d, ws in by for k, w in enumerate(ws))], atol=1e-5)
    signs = {}
    for _, v, _ in kept[:40]:
        for r in got:
            if r.deviation == deviation[tuple(v)] and abs(r.whitened) > 1e-3 and np.isclose(abs(r.whitened), abs(white(v)[r.component - 1]), atol=1e-6):
                signs.setdefault(r.component, set()).add(np.sign(r.whitened * white(v)[r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening(spark):
    rows = vector_rows()
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    check_whitening(got, kept_plain(rows, 8, 256))
    shifted = [(i, None if v is None else [None if c is None else c + 70_000 for c in v], *rest) for i, v, *rest in rows]
    check_whitening(whitening.whiten(spark.createDataFrame(shifted, VECTORS)).collect(), kept_plain(shifted, 8, 256))


def test_op11(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_whitening(queries.QUERIES["op11_embedding_whitening"](spark, sf_dir).collect(), kept_plain(rows, 64, 256))


def test_whitening_few_dimensions(spark):
    frame = spark.createDataFrame(vector_rows(), VECTORS)
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = spark.createDataFrame([(k, [1.0, 2.0], 1, "x", 1, "c", 2, 3) for k in range(5)], VECTORS)
    assert whitening.whiten(one).count() == 0  # no variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 1, "x", 1, "c", 2, 3) for k in range(5)], VECTORS)
    got = whitening.whiten(line).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and all(math.isclose(r.explained, 1, rel_tol=1e-9) for r in got)
    huge = spark.createDataFrame([(k, [3e38, float(k)], 1, "x", 1, "c", 2, 3) for k in range(3)], VECTORS)
    assert {r.n for r in whitening.whiten(huge).collect()} == {3}


@pytest.mark.parametrize("kind", ["plain", "ties", "close", "wide", "rank"])
def test_feast(kind):
    r = np.random.RandomState(2)
    dims = 30
    q, _ = np.linalg.qr(r.standard_normal((dims, dims)))
    values = {"plain": r.uniform(0, 10, dims), "ties": np.r_[[9.0] * 7, r.uniform(0, 1, dims - 7)], "close": 5 + np.arange(dims) * 1e-4, "wide": 10.0 ** -np.arange(dims) * 1e6, "rank": np.r_[3.0, 1.0, np.zeros(dims - 2)]}[kind]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.components(v, 4)
    want = np.sort(values)[::-1][: 2 if kind == "rank" else 4]
    assert np.allclose(got, want, rtol=1e-9) and np.allclose(x.T @ x, np.eye(len(want)), atol=1e-12)
    assert np.abs(v @ x - x * got).max() < 1e-11 * want[0]
    for shift in (values.min() - 1, np.median(values) + 1e-7, values.max() + 1):
        assert whitening.above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()


def test_inertia_takes_pivots_of_two():
    assert whitening.negatives(np.array([[0.0, 1], [1, 0]])) == 1
    assert whitening.negatives(np.zeros((3, 3))) == 0
    a = np.random.RandomState(5).standard_normal((20, 20))
    np.fill_diagonal(a, 0)
    assert whitening.negatives(a + a.T) == (np.linalg.eigvalsh(a + a.T) < 0).sum()


def test_exact_products():
    x = np.array([[1 << 40, 3], [5, -(1 << 41)]])
    assert whitening.product(x).tolist() == (x.T.astype(object) @ x.astype(object)).tolist()
    assert vectors.most(x, np.zeros(0)) == 1 << 41
    assert vectors.matrix(pa.chunked_array([[[1, 2]], [[3, 4]]]), 2).tolist() == [[1, 2], [3, 4]]
