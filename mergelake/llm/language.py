"""Language ID with interpolated Kneser-Ney models of characters.

Each language's model holds its n-grams of characters as sorted arrays of codes, with the discounted
probability of each and the weight of each context.  A text gets the language whose model gives
the lowest cross-entropy for each character.  Characters are code points in lower case; a run of
anything but letters and marks is one space.  Models are fitted on a bounded sample of labelled rows: at
most fit_rows + tune_rows a language, the lowest hashes of the ids, of at most max_bytes each, for the max_langs
commonest languages.  The tune rows set the confidence's scale and the entropy above which a text is rejected.
Characters of the sample make the alphabet, each another symbol; any other character is symbol 0.

Edge cases: a null text, or one with no letter, gets ``und``, score 0 and is rejected; ties
between languages go to the first in alphabetical order; with no labelled rows every text gets
``und``; rows with a null language teach nothing; equal texts get equal results.  Only the id, the
text and, for learning, the language are read; other columns come back as they are, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import words as W

ORDER = 4
#: Bits of a symbol in a code of ORDER symbols, and the space's symbol.
SYMBOL_BITS, SPACE = 16, 1
SLICE_BYTES = 512 << 10
#: A text is rejected where its entropy is so many of the tune rows' spreads over their mean, plus what short texts vary by.
REJECT_SPREADS, REJECT_SHORT = 8.0, 12.0
RESULTS = {"lang_pred": StringType(), "score": DoubleType(), "bits": DoubleType(), "rejected": BooleanType()}


@lru_cache(1)
def lettered() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points that the models see, 0x20 for what is no letter, and the rows' offsets in them."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    data = np.where(lettered()[data], data, np.uint32(0x20)) if len(data) else data
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return data[keep], np.r_[0, np.cumsum(keep)][offsets]


def alphabet_of(data: np.ndarray) -> np.ndarray:
    """The sample's characters but the space, the commonest first where they outnumber the symbols."""
    chars, counts = np.unique(data[data != 0x20], return_counts=True)
    return np.sort(chars[np.lexsort((chars, -counts))][: (1 << SYMBOL_BITS) - 2])


def codes(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER symbols up to each one, as one number; before a row stand spaces."""
    out = symbols.astype(W.U64)
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        back = np.full(len(symbols), SPACE, W.U64)
        back[k:] = symbols[: max(0, len(symbols) - k)]
        back[place < k] = SPACE
        out |= back << W.U64(SYMBOL_BITS * k)
    return out


def lowest(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of a code."""
    return code & W.U64((1 << SYMBOL_BITS * n) - 1) if n < ORDER else code


@dataclass
class Model:
    """By order: sorted n-grams with their discounted probabilities, sorted contexts with their weights."""

    symbols: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fitted(cls, code: np.ndarray, symbols: int) -> Model:
        grams, contexts = [], []
        keys, counts = np.unique(code, return_counts=True)
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # lower orders count the different symbols before
                keys, counts = np.unique(lowest(longer, n), return_counts=True)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            cut = once / (once + 2 * twice) if once and twice else 0.5
            context = keys >> W.U64(SYMBOL_BITS)
            heads, first = np.unique(context, return_index=True)
            total = np.add.reduceat(counts, first)
            kinds = np.diff(np.r_[first, len(keys)])
            grams.append((keys, (counts - cut) / np.repeat(total, kinds)))
            contexts.append((heads, cut * kinds / total))
            longer = keys
        return cls(symbols, grams[::-1], contexts[::-1])

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of each last symbol's probability after those before it."""
        p = np.full(len(code), 1 / self.symbols)
        for n, ((keys, prob), (heads, weight)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            gram = lowest(code, n)
            p = found(keys, prob, gram, 0.0) + found(heads, weight, gram >> W.U64(SYMBOL_BITS), 1.0) * p
        return np.log2(p)


def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


@dataclass
class Identifier:
    alphabet: np.ndarray
    langs: list[str] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)
    limits: list[tuple[float, float]] = field(default_factory=list)
    scale: float = 1.0

    @property
    def symbols(self) -> int:
        return len(self.alphabet) + 2

    def symbol(self, data: np.ndarray) -> np.ndarray:
        """Each code point's symbol: 0 for those outside the alphabet, then the space, then the alphabet."""
        if not len(self.alphabet):
            return np.where(data == 0x20, SPACE, 0).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.alphabet, data), len(self.alphabet) - 1)
        return np.where(data == 0x20, SPACE, np.where(self.alphabet[at] == data, at + 2, 0)).astype(np.uint16)

    def learn(self, texts: list[str]) -> Model:
        data, offsets = points(pa.array(texts, pa.string()))
        return Model.fitted(codes(self.symbol(data), offsets), self.symbols)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each character of each row under each model, and the rows' characters."""
        data, offsets = points(column)
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.models)))
        if not len(data):
            return out, sizes
        keys, which = np.unique(codes(self.symbol(data), offsets), return_inverse=True)
        for k, model in enumerate(self.models):
            total = np.zeros(len(data) + 1)
            np.cumsum(model.log2(keys)[which], out=total[1:])
            out[:, k] = (total[offsets[:-1]] - total[offsets[1:]]) / np.maximum(sizes, 1)
        return out, sizes

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's best model, its confidence, its entropy and whether it is rejected."""
        bits, sizes = self.entropies(column)
        # Rounded, so that what stands beside a row in a batch decides no tie.
        bits = np.round(bits, 9)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(best)), best]
        z = np.exp2(-np.clip(self.scale * (bits - low[:, None]), 0, 1000))
        mean, spread = np.array(self.limits).T[:, best]
        rejected = low > mean + REJECT_SPREADS * spread + REJECT_SHORT / np.sqrt(np.maximum(sizes, 1))
        return best, 1 / z.sum(axis=1), low, rejected


def identifier(rows: list[tuple[str, str]], fit_rows: int) -> Identifier | None:
    """From (lang, text) rows in hash order: the first fit_rows of each language fit its model, the others tune."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    if not by:
        return None
    langs = sorted(by)
    tune = {g: by[g][fit_rows:] or by[g] for g in langs}
    out = Identifier(alphabet_of(np.concatenate([points(pa.array(by[g][:fit_rows], pa.string()))[0] for g in langs])), langs)
    out.models = [out.learn(by[g][:fit_rows]) for g in langs]
    gains, limits = [], []
    for k, g in enumerate(langs):
        bits, sizes = out.entropies(pa.array(tune[g], pa.string()))
        own = bits[sizes >= 30, k] if (sizes >= 30).any() else bits[:, k]
        middle = float(np.median(own))
        limits.append((middle, max(float(np.median(np.abs(own - middle))) * 1.4826, 0.02)))
        gains.append(bits - bits[:, [k]])
    out.limits = limits
    # The scale that makes the confidences of the tune rows likeliest.
    loss = lambda s: sum(float(np.log2(np.exp2(-np.clip(s * x, -500, 500)).sum(axis=1)).sum()) for x in gains)
    out.scale = min((2.0**k for k in range(0, 8)), key=loss)
    return out


def fit(
    docs: DataFrame, learn: Column, fit_rows: int = 250, tune_rows: int = 80, max_bytes: int = 16384, max_langs: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Identifier | None:
    """Models from a bounded sample: at most fit_rows + tune_rows labelled rows for which learn holds, of each of at most max_langs languages, those with the most of them."""
    most = fit_rows + tune_rows
    usable = docs.filter(learn).select(docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("h"))
    usable = usable.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * most / n))])
    part = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = sorted(tuple(r) for r in usable.withColumn("part", part).filter(F.col("part") < shares[F.col("lang")]).select("part", "h", "lang", "text").collect())
    taken: dict[str, int] = {}
    kept = []
    for _, _, lang, text in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= most:
            kept.append((lang, text))
    return identifier(kept, fit_rows)


def identify(docs: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), results: str | None = None) -> DataFrame:
    """One row per row: the id, lang_pred, score, bits (cross-entropy a character), rejected, and the input's columns in keep.

    With results, a name: the columns in keep, and the results as one struct of that name, so that no names clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch, 0, SLICE_BYTES):
                best, score, bits, rejected = model.predict(part.column(0))
                letters = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                pred = np.where(letters, np.array(model.langs, object)[best], "und")
                found = [pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, bits, 0.0)), pa.array(rejected | ~letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *RESULTS])

    # The text goes through once, also where it is kept.
    names = [c for c in dict.fromkeys([id_col, *keep]) if c != text_col]
    other = [docs[c].alias(f"keep{k}") for k, c in enumerate(names)]
    slim = docs.select(docs[text_col].alias("text"), F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"), *other)
    if model is None:
        out = slim.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.lit(True).alias("rejected"))
    else:
        out = slim.mapInArrow(run, StructType([*slim.schema.fields, *(StructField(n, t) for n, t in RESULTS.items())]))
    of = lambda c: F.col("text" if c == text_col else f"keep{names.index(c)}").alias(c)
    if results:
        return out.select(*map(of, keep), F.struct(*RESULTS).alias(results))
    return out.select(of(id_col), *RESULTS, *map(of, keep))
