"""Every stage of the pipeline on the awkward cases, each against a plain version of its rule."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from mergelake.llm import language, mixing, pieces, queries, secrets  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, rejected boolean, spans string, redacted string, lang_pred string, bits int, language int, found int, copy int, copy_no int, n_copies int, row string, rest int, class_id int, key string, text_key int, doc int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ba", "lo", "mi", "tur", "sen") for b in ("ne", "ra", "ti", "gul", "po", "das")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(150)
    texts = [prose(r.randint(20, 80)) for _ in range(30)] + [base] * 12 + [base + " more", "extra " + base, None, "", " 12 34 ", "a b", prose(6000)]
    texts += [prose(30) + " password = hunter2secret " + prose(20)]
    out = [(None if k % 5 == 0 else 3 if k % 5 == 1 else 100 + k, t, "en" if k % 3 else None, ["hot", "hot", "cold", None][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[7], out[7], out[0]]
    return [(*x, 0.5, False, "s", "r", "l", k, 2, 3, 4, 5, 6, "w", 7, 8, "k", 9, 10) for k, x in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS + EXTRA)


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_columns_and_empty_table(spark, docs, empty, sf_dir, name, stage):
    assert stage(spark, empty, sf_dir).count() == 0
    got = stage(spark, docs, sf_dir)
    assert got.columns == (docs.columns if name != "sentencepiece" else ["doc_id", "n_tokens", "ids"])


def everything(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_language_id(spark, docs, sf_dir):
    model = language.fit(docs, F.lit(True))
    import pyarrow as pa

    want = []
    for x in rows():
        if x[1] and any(c.isalpha() for c in x[1]):
            best, _, _, rejected = model.predict(pa.array([x[1]]))
            if not rejected[0]:
                want.append((*x[:2], model.langs[best[0]], *x[3:]))
    got = everything(pipeline.identify_language(spark, docs, sf_dir))
    assert got == sorted(want, key=str)


def test_near_duplicates(spark, docs, sf_dir):
    every = rows()
    texts = sorted({x[1] or "" for x in every})
    sets = {}
    for t in texts:
        w = WORD.findall(t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {t: t for t in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    best = {}
    for x in every:
        best.setdefault(group[x[1] or ""], []).append((x[0] is None, x[0] or 0))
    got = pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert {group[r.text or ""] for r in got} == set(best) and len(got) == len(best)
    assert all((r.doc_id is None, r.doc_id or 0) == min(best[group[r.text or ""]]) for r in got)
    assert set(every) >= {tuple(r) for r in got}


def test_secret_scan(spark, docs, sf_dir):
    got = pipeline.redact_secrets(spark, docs, sf_dir)
    rows_ = got.collect()
    assert got.count() == docs.count() and sum("[secret]" in (r.text or "") for r in rows_) == 1
    clean = {str(tuple(r)) for r in docs.collect() if not r.text or "password" not in r.text}
    assert {str(tuple(r)) for r in rows_ if not r.text or "[secret]" not in r.text} == clean
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows_)
    assert secrets.MASK == "[secret]"


def test_source_mixing(spark, docs, sf_dir):
    out = mixing.replicate(docs, results="mixed").collect()
    want = [tuple(r)[:-1] for r in out]
    assert max(r.mixed.n_copies for r in out) > 1
    got = [tuple(r) for r in pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sentencepiece(spark, docs, sf_dir):
    own = pieces.PieceCoder(queries.piece_model())
    want = [(x[0], own.encode(x[1] or "")) for x in rows()]
    got = [(r.doc_id, bytes(r.ids)) for r in pipeline.encode_pieces(spark, docs, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(np.frombuffer(i, "<u4")[0] == own.bos for _, i in got)


def test_run_is_its_stages(spark, sf_dir):
    """run() over the whole table, beside the stages applied one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    want = sorted((r.doc_id, bytes(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, bytes(r.ids)) for r in pipeline.run(spark, sf_dir).collect()) == want and want
