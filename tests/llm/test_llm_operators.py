"""Each operator against a plain version on a small table with the awkward cases, and on an empty one."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelake.llm import imatch, katz, language, mixing, nearcopies, personal, pieces, queries, secrets, substrings, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_substrings(docs, raw, empty):
    words = [(i, WORD.findall(t or "")) for i, t in raw]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 300
    assert substrings.remove_repeats(empty).count() == 0


def plain_discounts(counts):
    """Katz's factors from counts of counts on a fitted line, by hand."""
    n = [sum(c == r for c in counts) + 1 / r**2 for r in range(1, 7)]
    x, y = [math.log(r) for r in range(1, 7)], [math.log(v) for v in n]
    mx, my = (sum(v * w for v, w in zip(n, z, strict=True)) / sum(n) for z in (x, y))
    slope = sum(w * (a - mx) * (b - my) for w, a, b in zip(n, x, y, strict=True)) / sum(w * (a - mx) ** 2 for w, a in zip(n, x, strict=True))
    line = lambda r: r ** min(slope, -1.1)
    whole = 6 * line(6) / line(1)
    return {r: ((r + 1) * line(r + 1) / (r * line(r)) - whole) / (1 - whole) for r in range(1, 6)}


def plain_katz(texts, trained, order):
    """log10 of texts' probabilities from dictionaries of grams, by recursion."""
    padded = [["<s>"] * (order - 1) + [*WORD.findall((t or "").translate(LOWER)), "</s>"] for t in texts]
    grams = {m: Counter() for m in range(1, order + 1)}
    contexts = Counter()
    for w, t in zip(padded, trained, strict=True):
        for k in range(order - 1, len(w)) if t else ():
            for m in grams:
                grams[m][tuple(w[k - m + 1 : k + 1])] += 1
                contexts[tuple(w[k - m + 1 : k])] += 1
    n, factor = sum(grams[1].values()), {m: plain_discounts(c.values()) for m, c in grams.items()}
    cut = lambda m, c: c * factor[m].get(c, 1.0)
    rest = max(1 - sum(cut(1, c) for c in grams[1].values()) / n, 1 / (n + 1))
    plain = (1 - rest) / (sum(cut(1, c) for c in grams[1].values()) / n)
    after = defaultdict(list)
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[g[:-1]].append((g, c))

    def p(g):
        m = len(g)
        if m == 1:
            return cut(1, grams[1][g]) / n * plain if grams[1][g] else rest
        if g[:-1] not in after:
            return p(g[1:])
        scale, weight = of_context(g[:-1])
        return cut(m, grams[m][g]) / contexts[g[:-1]] * scale if grams[m][g] else weight * p(g[1:])

    memo = {}

    def of_context(c):
        if c not in memo:
            kept, least = sum(cut(len(c) + 1, k) for _, k in after[c]) / contexts[c], 1 / (contexts[c] + 1)
            scale = (1 - least) / kept if 1 - kept < least else 1.0
            memo[c] = scale, (1 - kept * scale) / (1 - sum(p(g[1:]) for g, _ in after[c]))
        return memo[c]

    every = sum(p((*c, w)) for c in list(after)[:1] for (w,) in grams[1]) + of_context(list(after)[0])[1] * (rest if order == 2 else 0)
    assert order > 2 or math.isclose(every, 1, rel_tol=1e-9)
    return [sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w))) for w in padded], grams[1], n


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, raw, empty, order):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    scores, one, n = plain_katz([t for _, t in raw], [not held(i) for i, _ in raw], order)
    want = defaultdict(list)
    for (i, t), score in zip(raw, scores, strict=True):
        w = [(x,) for x in [*WORD.findall((t or "").translate(LOWER)), "</s>"]]
        want[i].append((held(i), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + len(one) + 1)) for x in w), score))
    got = defaultdict(list)
    for r in katz.score(docs, train, order).collect():
        got[r.doc_id].append((not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for i, rows in want.items():
        for g, x in zip(sorted(got[i]), sorted(rows), strict=True):
            assert g[:4] == x[:4] and math.isclose(g[4], x[4], rel_tol=1e-9) and math.isclose(g[5], x[5], rel_tol=1e-7)
    assert katz.score(empty, train, order).count() == 0
    assert katz.score(docs, F.lit(False), order).filter("abs(score) > 1e-9 or abs(base_score) > 1e-9").count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_tables_score_like_one_go(spark, docs, tmp_path, order):
    """Tables written, read again and asked for other documents give the same scores."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in katz.score(docs, train, order).collect())
    katz.train_tables(docs, train, str(tmp_path / "model"), order)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in katz.score_with(docs.repartition(5), str(tmp_path / "model"), order).collect())
    assert got == want
    assert spark.read.parquet(str(tmp_path / "model")).select("order").distinct().count() == order


def test_katz_hot_contexts_in_shards(spark):
    """A context with most of all tokens is dealt over partitions."""
    raw = [(k, " ".join(f"the w{(k * j) % 50}" for j in range(40))) for k in range(60)]
    docs = spark.createDataFrame(raw, "doc_id long, text string")
    scores, *_ = plain_katz([t for _, t in raw], [True] * 60, 2)
    got = {r.doc_id: r.score for r in katz.score(docs, F.lit(True), 2).collect()}
    assert all(math.isclose(got[k], s, rel_tol=1e-8) for k, s in enumerate(scores))


def test_discounts_at_any_counts():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [3, 90, 1, 7, 0, 100], [1000, 400, 200, 120, 80, 50], [10, 10, 10, 10, 10, 10]):
        d = katz.discounts(np.array(n))
        assert d[0] == 1 and all(0 < x < 1 for x in d[1:])


def test_mixing(docs, empty):
    out = mixing.replicate(docs, power=0.5, epochs=3.0)
    assert out.columns == [*docs.columns, "copy_no", "n_copies"]
    rate = {r.source: r.rate for r in mixing.rates(docs, power=0.5, epochs=3.0).collect()}
    drawn = Counter((tuple(r)[:-2], r.copy_no, r.n_copies) for r in out.collect())
    want, seen = Counter(), Counter()
    for r in docs.collect():  # inverted by hand
        key = hashlib.md5("|".join("null" if c is None else hashlib.md5(str(c).encode()).hexdigest() for c in r).encode()).hexdigest()
        seen[key] += 1
        parts = max(1, math.ceil(rate[r.source] / 16))
        n = 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"mix|{part}|{key}|{seen[key]}".encode()).hexdigest()[:13], 16) / 2**52
            p = total = math.exp(-rate[r.source] / parts)
            k = 0
            while total <= u:
                k += 1
                p *= rate[r.source] / parts / k
                total += p
            n += k
        want.update((tuple(r), c, n) for c in range(1, n + 1))
    assert drawn == want and max(seen.values()) > 1
    weights = docs.sparkSession.createDataFrame([("cold", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.replicate(docs, weights).select("source").distinct().collect()} <= {"cold"}
    assert mixing.replicate(empty).count() == 0


def test_mixing_null_and_equal_rows(spark):
    """A third of the rows has no id and a third is one row: each is drawn by itself, and no place is shared."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k:05}" if k % 3 != 1 else "the same ", "s") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    told = mixing.numbered(docs).select("__key", "__nth").collect()
    assert len(set(told)) == len(rows) and max(r["__nth"] for r in told) == 3000
    for rate in (3.0, 0.5):
        out = mixing.replicate(docs, epochs=rate)
        for where in ("doc_id IS NULL", "doc_id = 7", "doc_id IS NOT NULL AND doc_id <> 7"):
            # copies k of a row are there as often as rows have k or more: the mean of the draws, and of their squares
            copies = Counter(r.copy_no for r in out.filter(where).collect())
            mean = sum(copies.values()) / 3000
            square = sum((2 * k - 1) * n for k, n in copies.items()) / 3000
            assert abs(mean - rate) < 0.1 * rate + 0.02 and abs(square - mean**2 - rate) < 0.15 * rate + 0.05


def test_poisson_mean(spark):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.lit("s").alias("source"))
    assert abs(mixing.replicate(big, epochs=20.0).count() / 400_000 - 1) < 0.01


def test_imatch(docs, raw, empty):
    rows = imatch.fingerprint_all(docs, low=0.01, high=0.6).collect()
    assert len(rows) == len(raw)
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in raw), reverse=True)
    want = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        want.append((str(i), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    by_text = defaultdict(set)
    texts = dict(raw)
    for r in rows:
        by_text[texts[r.doc_id] or ""].add(tuple(r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert imatch.fingerprint_all(empty).count() == 0
    assert imatch.fingerprint_all(docs.filter("doc_id = 20"), low=0.0, high=1.0).first().near_next == 1.0


def test_imatch_short_texts_and_copies(spark):
    import random

    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    short = [" ".join(r.sample(vocabulary, r.randint(1, 6))) for _ in range(300)]
    rare = [f"alone{k} single{k} once{k}" for k in range(100)]
    copied = " ".join(r.sample(vocabulary, 40))
    texts = [*short, *rare, *[copied] * 200]
    rows = {x.doc_id: x for x in imatch.fingerprint_all(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    df = Counter(w for t in set(texts) for w in t.split())
    for k, t in enumerate(texts):
        assert bool(rows[k].fingerprint) == any(2 <= df[w] <= 0.2 * len(set(texts)) for w in t.split())
    assert all(rows[k].near_next == 0 for k in range(301, 400))  # the next one has the id below
    assert all(rows[k].near_next == 1 for k in range(401, 600)) and rows[400].near_next == 0
    assert all(0 < rows[k].near_edited < 1 for k in range(401, 600))
    assert all(x.near_edited == 0 for k, x in rows.items() if 300 < k < 400)


def plain_topk(raw, is_query, k=10):
    """Every query scored against every row."""
    tf = [(i, t, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in raw]
    df = Counter(w for *_, c in tf for w in c)
    mean = sum(sum(c.values()) for *_, c in tf) / len(tf)
    want, done = [], set()
    for q, text, asked in tf:
        if q is None or not is_query(q) or (q, text) in done:
            continue
        done.add((q, text))
        scores = []
        for i, _, c in tf:
            size = sum(c.values())
            s = sum(t * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, t in asked.items() if w in c)
            if s > 0:
                scores.append((-round(s, 7), i is None, i or 0))
        want += [(q, rank, None if none else i) for rank, (_, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(want, key=str)


def plain_imatch(raw, low, high):
    """Fingerprints by hand: a band of terms, their subsets by hash, each subset's sorted terms hashed."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    h64 = lambda x, seed=42: xxhash.xxh64(x, seed=seed).intdigest()
    terms = lambda t: set(re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " " + t.lower())) - {""}
    df = Counter(w for t in {t or "" for _, t in raw} for w in terms(t))
    n = len({t or "" for _, t in raw})
    subsets = {}
    for w in (w for w, c in df.items() if max(2, n * low) <= c <= n * high):
        h = h64(w.encode())
        subsets[w] = {signed(h) % 20} | {k for k in range(20, 60) if signed(h64(k.to_bytes(4, "little"), h)) % (1 << (6 + k % 5)) == 0}

    def fingerprint(t):
        of = defaultdict(list)
        for w in terms(t) & subsets.keys():
            for k in subsets[w]:
                of[k].append(w)
        return sorted(f"{k:02d}:{h64(' '.join(sorted(ws, key=str.encode)).encode()):x}" for k, ws in of.items())

    def like(a, b, same):
        held = len({x[:2] for x in a + b})
        return len(set(a) & set(b)) / held if held else float(same)

    order = sorted(((-(1 << 63) if i is None else i, signed(h64((t or "").encode())), (t or "").encode(), i) for i, t in raw), reverse=True)
    out = []
    for k, (_, _, t, i) in enumerate(order):
        text, after = t.decode(), order[(k + 1) % len(order)][2].decode()
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b, text == edited), 9), round(like(a, c, text == after), 9)))
    return sorted(out, key=str)


def fingerprinted(frame):
    return sorted(((r[0], r[1], r[2], list(r[3]), list(r[4]), round(r[5], 9), round(r[6], 9)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("band", [(0.002, 0.2), (0.01, 0.6)])
def test_imatch_against_plain(docs, raw, band):
    assert fingerprinted(imatch.fingerprint_all(docs, *band)) == plain_imatch(raw, *band)


def test_imatch_null_and_shared_ids(spark):
    """A third of the rows without an id and a third with one id: buckets split them by their texts, and neighbours stay right."""
    import random

    r = random.Random(5)
    raw = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 25)))) for k in range(240)]
    docs = spark.createDataFrame(raw, "doc_id long, text string").repartition(5)
    words = imatch.lexicon(docs)
    assert imatch.in_order(docs, 40, "doc_id", "text").select("bucket").distinct().count() > 25
    assert fingerprinted(imatch.fingerprints(docs, words, 40)) == plain_imatch(raw, 0.002, 0.2)


def test_topk(docs, raw, empty):
    got = [(r.query_id, r.rank, r.doc_id) for r in topk.search(docs, F.col("doc_id") % 5 == 0).collect()]
    assert sorted(got, key=str) == plain_topk(raw, lambda q: q % 5 == 0)
    assert topk.search(empty, F.lit(True)).count() == 0


def test_topk_null_and_shared_ids(spark):
    import random

    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(3000)]
    raw = [(None if k % 3 == 0 else 10 if k % 3 == 1 else k, " ".join(r.sample(words, 40))) for k in range(150)]
    got = [(x.query_id, x.rank, x.doc_id) for x in topk.search(spark.createDataFrame(raw, "doc_id long, text string"), F.col("doc_id") % 5 == 0).collect()]
    assert sorted(got, key=str) == plain_topk(raw, lambda q: q % 5 == 0)


def test_wand_prunes_whole_documents_as_queries(spark, sf_dir):
    """On the real table as one shard, a part of the postings is read and the results are those of scoring all."""
    import pyarrow as pa

    rows = queries.documents(spark, sf_dir.replace("sf0.001", "sf0.01")).select("doc_id", "text").toArrow()
    terms, term, doc, count, length = topk.doc_terms(rows["text"])
    df = np.bincount(term, minlength=len(terms))
    index = topk.Index([topk.packed_index(rows["text"], rows["doc_id"], df, len(length), int(length.sum()))], 1.2, 0.75)
    for q in range(0, len(length), 20):
        mine = doc == q
        found, scores = index.best(terms[term[mine]], count[mine].astype(float), 10)
        read = index.read
        every = index.whole(terms[term[mine]], count[mine].astype(float))
        index.read = read
        assert scores.tolist() == sorted(every[every > 0], reverse=True)[:10]
    assert index.read < index.all


def test_block_bounds_prune():
    import pyarrow as pa

    texts = pa.chunked_array([["rare word"] * 3 + [f"common filler {k}" for k in range(5000)]])
    df = np.bincount(topk.doc_terms(texts)[1])
    index = topk.Index([topk.packed_index(texts, pa.chunked_array([range(5003)]), df, 5003, 15006)], 1.2, 0.75)
    terms = topk.doc_terms(pa.chunked_array([["rare common"]]))[0]
    found, _ = index.best(terms, np.ones(2), 3)
    assert index.ids[found].tolist() == [0, 1, 2] and index.read < index.all / 5


def test_pieces(docs, raw, empty):
    import sentencepiece

    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = []
    for i, t in raw:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(i), ids, library.decode(ids)))
    got = [(str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in pieces.encode(docs, model).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.encode(empty, model).count() == 0


def test_pieces_fuzz():
    import random

    import sentencepiece

    model = queries.piece_model()
    library, own, r = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCoder(model), random.Random(1)
    for _ in range(2000):
        t = "".join(r.choice("aabbcdeehilnorst   \n\t,.-'éß😀▁0123²_<>()=") for _ in range(r.randint(0, 60)))
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist())


def plain_personal(x):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_personal(docs, raw, empty):
    model = personal.fit(1500)
    got = defaultdict(list)
    for r in personal.find(docs, model, redact=True).collect():
        got[r.doc_id].append((tuple(tuple(s) for s in r.spans), r.redacted))
    for i, t in raw:
        for spans, redacted in got[i]:
            assert [s for s in spans if s[0] < 4] == plain_personal(t or "")
            assert (redacted is None) == (t is None)
            assert not spans or "@" not in redacted
    assert personal.find(empty, model).count() == 0


def test_personal_fuzz():
    import random

    r = random.Random(3)
    for _ in range(5000):
        x = "".join(r.choice("ab@@..--_+12345 ()é%") for _ in range(r.randint(0, 40)))
        assert personal.base(x) == plain_personal(x)


def test_personal_method():
    model = personal.fit()
    found = lambda t: [personal.KINDS[k] for k, *_ in personal.spans(t, model)]
    assert found("call phone (212) 555-0187 now") == ["number"]
    assert found("my ssn 123-45-6789 ok") == ["identity"]
    assert found("write to mary.lamb (at) home.org today") == ["contact"]
    for clean in ("on 2024-01-15 we met", "version 1.22.333.4444 is out", "order 12345678 shipped", "plain words only"):
        assert found(clean) == []
    held = list(personal.labelled(1000, seed=99))
    kept = [(personal.Boosted.odds(model[0], np.array([personal.features(t, *c)], float))[0] >= model[1][c[0]], p) for t, c, p in held]
    assert sum(p for k, p in kept if k) / max(1, sum(k for k, _ in kept)) > 0.97


def test_personal_numbers_beside_numbers():
    model = personal.fit()
    found = lambda t: [(personal.KINDS[k], t[a:b]) for k, a, b in sorted(personal.spans(t, model), key=lambda s: s[1])]
    number, identity = (lambda x: ("number", x)), ("identity", "123-45-6789")
    assert found("call 212-555-0187 212-555-0199 now") == [number("212-555-0187"), number("212-555-0199")]
    assert found("phones (212) 555-0187 (212) 555-0199 (212) 555-0111") == [number(f"(212) 555-0{n}") for n in (187, 199, 111)]
    assert found("ssn 123-45-6789 (212) 555-0187 ok") == [identity, number("(212) 555-0187")]
    assert found("phone 2024 (212) 555-0187 x") == [number("(212) 555-0187")]
    assert found("tel 212-555-0187. 2024 was") == [number("212-555-0187")]
    assert found("ssn 123-45-6789. 3 of them") == [identity]
    assert found("we sold 12 33 1999 2000 4411 22 things") == []
    assert len(personal.candidates("1 " * 5000)) <= 10 * 5000
    for text in ("212-555-0187 212-555-0199", "x1 (23) 4567. 89 0 12y", "(123-45-6789)"):
        want = set()
        groups = [m.span() for m in re.finditer(r"[0-9]+", text)]
        for i, (a, _) in enumerate(groups):
            for _, b in groups[i:]:
                n = len(re.sub(r"[^0-9]", "", text[a:b]))
                if 7 <= n <= 15 and not re.search("[a-z]", text[max(0, a - 1) : b + 1]):
                    want |= {(k, a - (text[max(0, a - 1)] == "(" and ")" in text[a:b]), b) for k in (5, 6)[: 1 + (n == 9)]}
        assert set(personal.candidates(text)) == want


def test_language(docs, empty, sf_dir, spark):
    whole = queries.documents(spark, sf_dir)
    model = language.fit(whole, queries.fold(5) != 0)
    both = language.identify(whole, model).join(whole.select("doc_id", "lang"), "doc_id")
    assert both.filter("lang <> lang_pred").count() <= 0.03 * both.count()
    rows = {r.doc_id: r for r in language.identify(docs, model, keep=["text", "id", "rank"]).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0 and rows[0].rejected
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[4].rank == 3
    assert language.identify(empty, model).count() == 0
    assert language.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_models_sum_to_one():
    own = language.identifier([("en", "the cat sat on the mät"), ("en", "a dog ate the cat")], 2)
    model = own.models[0]
    for context in ("the", " ca", "zzz", "mät"):
        before = own.symbol(np.array([ord(c) for c in context], np.uint32)).astype(np.uint64)
        head = sum(int(x) << 16 * (3 - k) for k, x in enumerate(before))
        codes = np.array([head + s for s in range(own.symbols)], np.uint64)
        assert math.isclose(np.exp2(model.log2(codes)).sum(), 1, rel_tol=1e-9)


def plain_kneser_ney(texts, symbols):
    """log2 of a character after up to three others, from dictionaries."""
    clean = lambda t: re.sub(r" +", " ", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()))
    grams = {4: Counter()}
    for t in map(clean, texts):
        t = "   " + t
        grams[4].update(t[k : k + 4] for k in range(len(t) - 3))
    for n in (3, 2, 1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    seen = {n: Counter(c.values()) for n, c in grams.items()}
    cut = {n: c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5 for n, c in seen.items()}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / symbols
        total = sum(c for g, c in grams[n].items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        kinds = sum(g[:-1] == gram[:-1] for g in grams[n])
        return max(0, grams[n][gram] - cut[n]) / total + cut[n] * kinds / total * p(gram[1:])

    return lambda text: [math.log2(p(("   " + clean(text))[k : k + 4])) for k in range(len(clean(text)))]


def test_language_against_plain_kneser_ney():
    import pyarrow as pa

    texts = {"el": ["η γάτα κάθισε στο χαλί και η γάτα έφυγε", "ο σκύλος έφαγε"], "fr": ["Élan d'été, là où l'été est là", "le chat a été là"], "zh": ["我们都是一家人我们都好", "一家人都好"]}
    own = language.identifier([(g, t) for g in texts for t in texts[g]], 2)
    for text in ("Η ΓΑΤΑ έφαγε", "été où est le chat?", "我们一家", "xyz 42"):
        bits, sizes = own.entropies(pa.array([text]))
        for k, g in enumerate(own.langs):
            assert math.isclose(bits[0, k], -sum(plain_kneser_ney(texts[g], own.symbols)(text)) / sizes[0], rel_tol=1e-9)
    assert [own.langs[b] for b in own.predict(pa.array(["η γάτα έφαγε", "là où est le chat", "一家人"]))[0]] == ["el", "fr", "zh"]


def test_language_many_labels(spark):
    rows = [(k, f"text of {k}", f"l{k % 40:02d}" if k % 3 else "en") for k in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), fit_rows=5, tune_rows=2, max_langs=8)
    assert len(model.langs) == 8 and "en" in model.langs


def plain_groups(raw):
    first, sets, same = {}, {}, {}
    for i, t in sorted(raw):
        t = t or ""
        same[i] = first.setdefault(t, i)
        w = WORD.findall(t)
        if same[i] == i:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, same[i], find(same[i]), links[same[i]]) for i, _ in raw)


def test_near_copies(docs, raw, empty):
    got = sorted((tuple(r)[:4] for r in nearcopies.near_copies(docs).collect()), key=str)
    assert got == sorted(plain_groups([(i, t) for i, t in raw if i is not None]) + [(None, None, None, 0)], key=str)
    assert len({g[2] for g in got}) < len({g[1] for g in got})
    assert nearcopies.near_copies(empty).count() == 0


def test_large_group_in_blocks(spark):
    """More near copies than a block holds, and a chain of them: links are counted across blocks."""
    base = [f"w{k}" for k in range(150)]
    raw = [(k, " ".join([*base[: k % 7], *base[7:], f"end{k}"])) for k in range(450)]
    got = sorted(tuple(r)[:4] for r in nearcopies.near_copies(spark.createDataFrame(raw, "doc_id long, text string")).collect())
    assert got == plain_groups(raw)


def test_near_copies_null_and_shared_ids(spark):
    """A third of the rows has no id and a third one id: rows of different texts stay apart, and one row of each group is kept."""
    texts = [" ".join(f"w{k % 40}x{j}" for j in range(60)) for k in range(60)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else -k, texts[k] + (" tail" if k >= 40 else ""), k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = nearcopies.near_copies(docs).collect()
    assert len(got) == 60 and len({r.class_key for r in got}) == 40
    kept = nearcopies.keep_one(docs).collect()
    assert len(kept) == 40 and set(nearcopies.keep_one(docs).columns) == set(docs.columns)
    best = {}
    for i, t, k in rows:
        best.setdefault(k % 40, []).append((i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(x) for x in best.values())


def test_near_copies_of_hot_rows(spark):
    """A third of the rows is equal in id and text and a third has no id and one text: each of them is sent once, and links are what they are without the repeats."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base) if k % 3 == 0 else (None, base + " more") if k % 3 == 1 else (k, " ".join(f"v{k}x{j}" for j in range(30))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    slim = docs.select(F.col("doc_id").alias("id"), "text", nearcopies.text_key(F.col("text")).alias("key"))
    assert sorted(map(str, (r.id for r in nearcopies.distinct_rows(slim).collect()))) == sorted(map(str, {i for i, _ in rows}))
    got = nearcopies.near_copies(docs).collect()
    assert len(got) == 3000 and {(r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id in (7, None)} == {(7, 7, 1), (None, 7, 1)} and sum(r.n_links for r in got) == 2000
    assert nearcopies.keep_one(docs).count() == 1001


def test_banding():
    bands, rows = nearcopies.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_secrets(docs, raw, empty):
    model = secrets.fit(docs)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = defaultdict(list)
    for r in secrets.scan(docs, model).collect():
        got[r.doc_id].append(([tuple(s) for s in r.spans], r.redacted))
    for i, t in raw:
        x = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        want = sorted(want + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32])
        for spans, redacted in got[i]:
            assert [s for s in spans if s[1] < 3] == want
            assert not want or secrets.MASK in redacted and "hunter2secret" not in redacted
            assert spans or redacted == t
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_secrets_held_out(spark, sf_dir, seed):
    import random

    docs = queries.documents(spark, sf_dir)
    model = secrets.fit(docs)
    r = random.Random(seed)
    rows = [("".join(r.choice(secrets.ALPHABET[:62]) for _ in range(32)), True) for _ in range(50)]
    rows += [(w, False) for w in ("internationalization_of_things", "some_long_function_name_here", "averyveryverylongwordindeed", "getUserAccountInformation")]
    found = {x.text: len(x.spans) > 0 for x in secrets.scan(spark.createDataFrame(rows, "text string, secret boolean"), model).collect()}
    assert sum(found[t] for t, s in rows if s) >= 45
    assert not any(found[t] for t, s in rows if not s)


def test_secrets_in_long_texts(spark):
    """One run of 100 000 characters, and 6000 matches in one text: the time follows the length."""
    import random
    import time

    r = random.Random(1)
    run = "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(100_000))
    many = " ".join(f"token={k:08d}x and word" for k in range(6000))
    model = secrets.fit(spark.createDataFrame([(k, f"some plain words of text {k}") for k in range(50)], "doc_id long, text string"))
    began = time.time()
    found = {x.text[:5]: x for x in secrets.scan(spark.createDataFrame([(run,), (many,)], "text string"), model).collect()}
    assert time.time() - began < 30
    assert len(found["token"].spans) == 6000 and found["token"].redacted.count(secrets.MASK) == 6000 and found["token"].redacted.endswith(" and word")
    spans = [(s["start"], s["end"]) for s in found[run[:5]].spans]
    assert spans == [(0, 100_000)] and found[run[:5]].redacted == secrets.MASK


def test_planted_secrets_in_prose(spark, sf_dir):
    """Random strings put into held-out prose are found, words beside them are not."""
    import random

    r = random.Random(7)
    docs = queries.documents(spark, sf_dir).select("doc_id", "text")
    model = secrets.fit(docs)
    prose = [x.text for x in docs.filter("doc_id % 3 = 1").orderBy("doc_id").limit(60).collect()]
    keys = ["".join(r.choice(secrets.ALPHABET[:62]) for _ in range(r.choice((24, 32, 40)))) for _ in prose]
    rows = [(k, f"{t[: len(t) // 2]} key {key} {t[len(t) // 2 :]}") for k, (t, key) in enumerate(zip(prose, keys, strict=True))]
    got = {x.k: [x.text[s["start"] : s["end"]] for s in x.spans if s["rank"] == 3] for x in secrets.scan(spark.createDataFrame(rows, "k long, text string"), model).collect()}
    hits, extra = sum(keys[k] in v for k, v in got.items()), sum(len([x for x in v if x != keys[k]]) for k, v in got.items())
    assert hits >= 0.95 * len(keys) and extra <= 0.02 * len(keys)


def test_planted_personal_data_in_prose(spark, sf_dir):
    """Phones without a plus, identity numbers and accounts put into real prose with a cue are found."""
    import random

    r, model = random.Random(3), personal.fit()
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    prose = [x.text for x in queries.documents(spark, sf_dir).filter("doc_id % 3 = 1").orderBy("doc_id").limit(60).collect()]
    hits = extra = 0
    for k, t in enumerate(prose):
        item, cue = ((f"({d(3)}) {d(3)}-{d(4)}", "call"), (f"{d(3)}-{d(2)}-{d(4)}", "ssn"), (f"{d(3)}.{d(3)}.{d(4)}", "phone"))[k % 3]
        at = t.find(" ", len(t) // 2)
        at = len(t) if at < 0 else at
        text = f"{t[:at]} {cue} {item} {t[at:]}"
        old = {(kind, t[a:b]) for kind, a, b in personal.spans(t, model)}
        new = {(kind, text[a:b]) for kind, a, b in personal.spans(text, model)}
        hits += any(x == item for _, x in new)
        extra += len({x for _, x in new - old} - {item})
    assert hits >= 0.9 * len(prose) and extra <= 0.05 * len(prose)


def test_personal_time_is_linear():
    import time

    model = personal.fit(1500)
    took = []
    for n in (2000, 8000):
        text = " ".join(f"{k % 900 + 100}-{k % 90 + 10}-{k % 9000 + 1000} and" for k in range(n))
        began = time.process_time()
        personal.spans(text, model)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_mixing_sql(spark, sf_dir, duck):
    from compare import same

    same(queries.QUERIES["op3_source_mixing"](spark, sf_dir), duck.sql(queries.ORACLES["op3_source_mixing"]))
