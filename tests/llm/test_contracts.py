"""The registered queries over a whole table, their columns and digests computed by hand from the texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import LOWER, WORD, plain_groups, plain_imatch, plain_katz, plain_personal, plain_topk

from mergelake.llm import queries


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").collect()]


def rows(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_op1(spark, sf_dir, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    scores, one, n = plain_katz([t for _, t in texts], [not held[i] for i, _ in texts], 2)
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op1_katz_scores")}
    better = []
    for (i, t), score in zip(texts, scores, strict=True):
        w, r = [*WORD.findall((t or "").translate(LOWER)), "</s>"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(one[(x,)] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((one[(x,)] + 1) / (n + len(one) + 1)) for x in w), rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)
        better.append(held[i] and r.score - r.base_score)
    assert sum(better) > 0  # on held-out texts


def test_op2(spark, sf_dir, texts):
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, sf_dir, "op2_substring_dedup")}
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        assert got[i] == (len(w), gone.sum(), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))


def test_op4(spark, sf_dir, texts):
    want = [(i, n, e, ",".join(a), ",".join(b), x, y) for i, n, e, a, b, x, y in plain_imatch(texts, 0.002, 0.2)]
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows(spark, sf_dir, "op4_imatch_fingerprints")]
    assert sorted(got, key=str) == want


def test_op5(spark, sf_dir, texts):
    got = [(r.query_id, r["rank"], r.doc_id) for r in rows(spark, sf_dir, "op5_bm25_topk")]
    assert sorted(got, key=str) == plain_topk(texts, lambda q: q % 50 == 0)


def test_op6(spark, sf_dir, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, sf_dir, "op6_sentencepiece")}
    for i, t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))


def digest(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def test_op7(spark, sf_dir, texts):
    kinds = ["email", "ip", "card", "phone"]
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op7_personal_data")}
    for i, t in texts:
        spans, r = plain_personal(t or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, *_ in spans) for j in range(4))
        assert r.base_sha256 == sha(digest(sorted(spans), kinds)) and set(digest(spans, kinds).split(",")) - {""} <= set(r.spans.split(","))


def test_op8(spark, sf_dir, texts):
    langs = {r.doc_id: r.lang for r in queries.documents(spark, sf_dir).select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op8_language_id")}
    right = [got[i].lang_pred == langs[i] for i, _ in texts if got[i].held_out]
    assert sum(right) >= 0.97 * len(right)
    for i, t in texts:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and got[i].lang_pred in {"und", *langs.values()}


def test_op9(spark, sf_dir, texts):
    got = sorted((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in rows(spark, sf_dir, "op9_ngram_jaccard_join"))
    assert got == plain_groups(texts)


def test_op10(spark, sf_dir, texts):
    kinds = ["assign", "access", "hex"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op10_secret_scan")}
    for i, t in texts:
        x, r = t or "", got[i]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        base = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == sha(base) and set(base.split(",")) - {""} <= set(r.spans.split(","))
