"""Secret scans with character Markov models, in DataFrame functions alone.

Three fixed patterns give the base spans.  The method adds long runs of token characters that a
first-order Markov model of random strings explains better than one of ordinary identifiers: the
log-likelihood ratio for each character, against a threshold set on labelled samples held out from the model.
Random strings are generated (hashes in hexadecimal, base 64, base 32 and base 36), identifiers are the words of a
bounded sample of documents that no base pattern matches; the bound is a parameter.

Edge cases: a null text is empty and has no spans; spans are code points, the end exclusive; base
spans of different kinds may overlap, added ones overlap none (of a run that touches a base span the rest counts, if long enough); ties in the start go by kind in
the order of KINDS; repeated rows give equal results.  The input's columns are kept as they are; the results are
``spans`` and ``redacted``, which replace columns of those names, or one struct under a name of the caller's.  Time is linear in a text's
length and matches, but for copies of the text in memory, one for each span.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = r"[A-Za-z0-9+/_-]{20,}"
MASK = "[secret]"


def found(text: Column, pattern: str) -> Column:
    """The matches of a pattern: (match, start, end).

    Places are sums of lengths, folded into text and split again: an array that grew by each match would be copied each time.  A short
    text takes the new ones and is moved to the long one when it is full."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("piece"), matches.alias("match"))
    none = F.array().cast("array<struct<match:string,start:bigint,end:bigint>>")

    def step(s: Column, r: Column) -> Column:
        start = s["at"] + F.length(r["piece"])
        short = F.concat(s["short"], start.cast("string"), F.lit(","))
        full = F.length(short) > 2048
        return F.struct((start + F.length(r["match"])).alias("at"), F.when(full, F.lit("")).otherwise(short).alias("short"), F.when(full, F.concat(s["long"], short)).otherwise(s["long"]).alias("long"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("short"), F.lit("").alias("long"))
    starts = F.split(F.aggregate(rows, start, step, lambda s: F.concat(s["long"], s["short"])), ",")
    out = F.zip_with(matches, F.slice(starts, 1, F.size(matches)), lambda m, a: F.struct(m.alias("match"), a.cast("bigint").alias("start"), (a.cast("bigint") + F.length(m)).alias("end")))
    return F.when(text.rlike(pattern), out).otherwise(none)


def covered(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """A text with each of its sorted spans replaced; fill gets how many characters, and whether the span goes on one before it."""

    def step(s: Column, r: Column) -> Column:
        start = F.greatest(s["at"], r["start"])
        out = F.concat(s["out"], F.substring(s["rest"], F.lit(1), (start - s["at"]).cast("int")), fill((r["end"] - start).cast("int"), r["start"] < s["at"]))
        rest = F.substring(s["rest"], (r["end"] - s["at"] + 1).cast("int"), F.length(s["rest"]))
        more = r["end"] > s["at"]
        return F.struct(F.when(more, rest).otherwise(s["rest"]).alias("rest"), F.greatest(s["at"], r["end"]).alias("at"), F.when(more, out).otherwise(s["out"]).alias("out"))

    state = F.struct(text.alias("rest"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], s["rest"]))


def base_spans(text: Column) -> Column:
    """The spans of the base kinds, in the order of their kinds."""

    def of(kind: str, pattern: str, passes) -> Column:
        return F.transform(F.filter(found(text, pattern), passes), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))

    return F.concat(
        of("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 8),
        of("access", ACCESS, lambda m: F.length(m["match"]) >= 16),
        of("hex", HEX, lambda m: F.lit(True)),
    )


def ratio(word: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a word's neighbouring characters; pairs with another character count as 0."""
    values = F.expr("array(" + ",".join(f"{x:.5f}D" for x in table) + ")")
    places = F.expr("array(" + ",".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128)) + ")")
    n = len(ALPHABET)
    place = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.get(places, F.ascii(c))).otherwise(0))
    pair = F.zip_with(place, F.slice(place, 2, F.length(word)), lambda a, b: F.when((a > 0) & (b > 0), F.get(values, ((a - 1) * n + b - 1))).otherwise(0.0))
    return F.aggregate(pair, F.lit(0.0), lambda t, x: t + x) / (F.length(word) - 1)


def labelled(docs: DataFrame, sample_docs: int, samples: int, id_col: str, text_col: str) -> DataFrame:
    """(word, random, held): generated strings, and the words of about sample_docs documents, the ones with the lowest hashes; a quarter of all words is held out."""
    i = F.col("id").cast("string")
    longer = F.concat(F.sha2(i, 256), F.md5(i))
    forms = [
        F.substring(longer, 1, 40),
        F.regexp_replace(F.substring(F.base64(F.unhex(longer)), 1, 40), "=", ""),
        F.upper(F.translate(F.substring(longer, 3, 36), "01abcdef", "GHJKMNPQ")),
        F.regexp_replace(F.conv(F.substring(longer, 1, 15), 16, 36), "^0+", ""),
        F.lower(F.concat(F.conv(F.substring(longer, 1, 12), 16, 36), F.conv(F.substring(longer, 13, 12), 16, 36), F.conv(F.substring(longer, 30, 12), 16, 36))),
        F.concat(F.conv(F.substring(longer, 1, 12), 16, 36), F.lower(F.conv(F.substring(longer, 13, 12), 16, 36))),
    ]
    drawn = docs.sparkSession.range(samples).select(F.explode(F.array(*forms)).alias("word")).withColumn("random", F.lit(1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    # By id and text, so that neither many rows without an id nor many copies are in or out together.
    part = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.filter(part < min(1.0, sample_docs / max(total, 1))).select(text.alias("t"))
    some = some.filter(~F.col("t").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    # A word as it stands, and two joined by an underscore or as one name, as identifiers are.
    own = some.select(F.explode(F.split("t", r"[^A-Za-z0-9+/_-]+")).alias("word")).filter(F.length("word").between(4, 64))
    named = own.select(F.explode(F.array(F.col("word"), F.concat(F.lower("word"), F.lit("_"), F.lower("word")), F.concat(F.lower("word"), F.initcap("word")))).alias("word"))
    return drawn.unionByName(named.withColumn("random", F.lit(0))).withColumn("held", F.pmod(F.xxhash64("word"), F.lit(4)) == 0)


def fit(docs: DataFrame, sample_docs: int = 500, samples: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], float]:
    """The table of log-likelihood ratios of neighbouring characters, and the threshold."""
    words = labelled(docs, sample_docs, samples, id_col, text_col)
    pairs = words.filter("NOT held").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # at most two for each pair of ASCII characters
    n = len(ALPHABET)
    heads = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    p = lambda k, a, b: (counts.get((k, a + b), 0) + 0.5) / (heads[k, a] + 0.5 * n)
    table = [math.log(p(1, a, b) / p(0, a, b)) for a in ALPHABET for b in ALPHABET]
    # The threshold is set on words that the table has not seen.
    scored = words.filter("held").filter(F.length("word") >= 16).withColumn("ratio", ratio(F.col("word"), table))
    low, high = scored.agg(F.percentile_approx(F.when(F.col("random") == 0, F.col("ratio")), 0.999, 10000), F.percentile_approx(F.when(F.col("random") == 1, F.col("ratio")), 0.02, 10000)).first()
    low, high = (0.0 if low is None else low), (1.0 if high is None else high)
    return table, max(0.0, (low + high) / 2 if low < high else low)


def scan(docs: DataFrame, model: tuple[list[float], float], text_col: str = "text", results: str | None = None) -> DataFrame:
    """The input with spans, an array of (start, rank, end) where rank is the kind's place in KINDS, and redacted, the text with each run of spans replaced by MASK.

    With results, a name that the input has not, all columns of the input stay and the results are one struct of that name."""
    table, threshold = model
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[text_col].alias("own"))
    out = whole.withColumn("base", F.array_sort(base_spans(F.col("text"))))
    # What base spans cover is blank to the search, so that no run reaches into one; only its neighbours can.
    blank = F.when(F.size("base") > 0, covered(F.col("text"), F.col("base"), lambda n, again: F.repeat(F.lit(" "), n))).otherwise(F.col("text"))
    out = out.withColumn("blank", blank)
    runs = F.filter(found(F.col("blank"), RUN), lambda m: ratio(m["match"], table) > threshold)
    added = F.transform(runs, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), m["end"].alias("end")))
    out = out.withColumn("spans", F.array_sort(F.concat("base", added)))
    masked = covered(F.col("text"), F.col("spans"), lambda n, again: F.when(again, F.lit("")).otherwise(F.lit(MASK)))
    out = out.withColumn("redacted", F.when(F.size("spans") > 0, masked).otherwise(F.col("own")))
    if results:
        return out.select("doc.*", F.struct("spans", "redacted").alias(results))
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("spans", "redacted")], "spans", "redacted")


def named(span: Column) -> Column:
    """kind:start:end of a span."""
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), span["rank"] + 1), span["start"].cast("string"), span["end"].cast("string"))
