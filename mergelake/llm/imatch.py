"""Document fingerprints after I-Match, in DataFrame functions alone.

Terms are runs of letters and digits (and whatever is not ASCII), lower-cased.  The lexicon keeps terms
whose document frequency, counted over distinct texts, lies in a band.  Every term of it is in one of
COVER disjoint subsets, so that no text with such a term goes without a fingerprint; further randomised
subsets of falling size are for long texts, of whose terms these hold a few.  Each subset gives one hash of
a text's sorted distinct terms, which are gathered by exploding each term's few subsets.  Two fingerprints are as alike as the part of subsets with equal hashes, of
those that hold a term of either text.

The lexicon is broadcast: its terms have a document frequency of ``low`` of all distinct texts at least, so
there are at most (mean distinct terms of a text) / low of them, at any number of documents.

Edge cases: a null text is empty; a text without a lexicon term has an empty fingerprint, and two such
are alike by 1 if the texts are equal and else by 0; null ids come last in the order and ties go by the text's hash, then by the text; repeated rows are documents
of their own in the order, and one text in the lexicon's counts; a single document is its own next one.  Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, join_small
from .words import layout

# Fixed value: what separates terms.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The first COVER subsets share all terms out; each later subset k takes each term with probability 2 ** -(LEAST + k % SCALES): most texts hold one to three terms of many subsets.
SUBSETS, COVER, LEAST, SCALES = 60, 20, 6, 5
FINE = 64
#: Ranks that the buckets' edges are taken from, at most; more buckets than these lie between them.
POINTS = 4096
ABOUT = "struct<id:{},guest:int,n_chars:bigint,edited_sha256:string,same_edited:boolean,same_next:boolean>"


def terms(text: Column) -> Column:
    """The terms; every text also has the empty one, of the space put before it, so that no text is lost."""
    return F.split(F.lower(F.concat(F.lit(" "), text)), SEPARATOR, -1)


def weighted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(text, share) of one row for each distinct text, whose shares add up to 1 where equal rows stand for it; and the number of distinct texts, one row.

    Texts that several rows have are joined by 96 bits of hash: broadcast up to a checked number of them, salted beyond."""
    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), rank_of(id_col).alias("rank"))
    slim = slim.withColumn("h", F.struct(F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b")))
    rows = slim.groupBy("h", "rank").agg(F.count("*").alias("n"))
    texts = checkpointed(rows.groupBy("h").agg(F.min("rank").alias("first"), F.min_by("n", "rank").alias("of_first"), F.sum("n").alias("n")))
    several = texts.filter("n > 1").select("h", "first", "of_first")
    out = join_small(slim, several, "h", most=2_000_000).filter(F.col("first").isNull() | (F.col("rank") == F.col("first")))
    return out.select("text", (1 / F.coalesce("of_first", F.lit(1))).alias("share")), texts.agg(F.count("*").alias("total"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.002, high: float = 0.2, id_col: str = "doc_id") -> DataFrame:
    """(term, subsets): the terms of the band, and the subsets that each is in; the empty term has subset -1."""
    # Copies are one text: else the terms of a text that many rows hold would all be above the band.
    each, total = weighted(docs, id_col, text_col)
    each = each.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"), "share").filter("term != ''")
    counts = each.groupBy("term").agg(F.round(F.sum("share")).cast("bigint").alias("df"))
    band = counts.crossJoin(F.broadcast(total)).filter((F.col("df") >= F.greatest(F.lit(2), F.col("total") * low)) & (F.col("df") <= F.col("total") * high))
    inside = [F.pmod(F.xxhash64("term"), F.lit(COVER)).cast("int")]
    inside += [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1 << (LEAST + k % SCALES))) == 0, F.lit(k)) for k in range(COVER, SUBSETS)]
    # Written before it is used: else what later steps ask of the subsets, which depend on the term alone, is moved down to every word of every text.
    words = checkpointed(band.select("term", F.array_compact(F.array(*inside)).alias("subsets")))
    return words.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array(F.lit(-1)).alias("subsets")))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two fingerprints, arrays of subset and hash; same, whether the texts are equal, decides between empty ones."""
    subset = lambda x: x.substr(1, 2)
    held = F.size(F.array_union(F.transform(a, subset), F.transform(b, subset)))
    return F.when(held > 0, F.size(F.array_intersect(a, b)) / held).otherwise(same.cast("double"))


def rank_of(id_col: str) -> Column:
    """Ids in order, null ones below all others."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))


def bucket_of(tops: list[int], points: int, parts: int) -> Column:
    """A number that does not fall from one (rank, th) to a larger one; tops are the ranks at equal steps of the rows, repeated where many rows share a rank.

    Up to each top, ranks are dealt to parts buckets by their distance; a rank that several steps share is dealt by th, the hash of its text, to parts for each step."""
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")
    own = sorted(set(tops))
    often = [tops.count(t) if tops.count(t) > 1 else 0 for t in own]
    base = [0]
    for n in often:
        base.append(base[-1] + parts * (1 + n))
    # How many tops are below a rank: first of every FINE-th, then within these.
    rank, th = F.col("rank"), F.col("th")
    coarse = F.size(F.filter(longs(own[FINE - 1 :: FINE]), lambda t: t < rank))
    at = (coarse * FINE + F.size(F.filter(F.slice(longs(own), coarse * FINE + 1, FINE), lambda t: t < rank))) if own else F.lit(0)
    get = lambda xs, i: F.coalesce(F.get(longs(xs), i), F.lit(0)).cast("double")
    low, high = get(own, at - 1), get(own, at)
    share = F.when((at == 0) | (at >= len(own)), F.lit(0.0)).otherwise((rank.cast("double") - low) / F.greatest(high - low, F.lit(1.0)))
    hashed = th.cast("double") / F.lit(2.0**64) + 0.5
    within = lambda x, n: F.least((x * n).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint"))
    n = F.coalesce(F.get(longs(often), at), F.lit(0).cast("bigint"))
    hot = (n > 0) & (F.get(longs(own), at) == rank)
    start = F.coalesce(F.get(longs(base), at), F.lit(base[-1]).cast("bigint"))
    return start + F.when(hot, F.lit(parts) + within(hashed, n * parts)).otherwise(within(share, F.lit(parts)))


def in_order(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Documents in buckets of neighbours in the order of rank and then the text's hash; each bucket also has, as a guest, the document that follows its last one in descending order."""
    slim = docs.select(F.col(id_col).alias("id"), rank_of(id_col).alias("rank"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("th", F.xxhash64("text"))
    points = max(2, min(buckets, POINTS))
    tops = slim.agg(F.percentile_approx("rank", F.array(*[F.lit(k / points) for k in range(1, points)]), 100 * points)).first()[0] or []
    placed = slim.withColumn("bucket", bucket_of(tops, points, -(-buckets // points)))
    # The largest of each bucket follows the smallest of the next bucket that has any; the largest of all follows the smallest of all.
    largest = checkpointed(placed.groupBy("bucket").agg(F.max(F.struct("rank", "th", F.xxhash64("text", F.lit(1)).alias("th2"))).alias("top")))
    after = F.lead("bucket").over(Window.orderBy("bucket"))  # one small row for each bucket
    edges = largest.withColumn("to", after).crossJoin(F.broadcast(largest.agg(F.min("bucket").alias("lowest"))))
    edges = edges.select(F.struct("bucket", F.col("top.rank").alias("rank"), F.col("top.th").alias("th"), F.col("top.th2").alias("th2")).alias("edge"), F.coalesce("to", "lowest").alias("to"))
    keyed = placed.withColumn("edge", F.struct("bucket", "rank", "th", F.xxhash64("text", F.lit(1)).alias("th2")))
    guests = join_small(keyed, edges, "edge", most=2_000_000).filter("to IS NOT NULL").select("id", "rank", "text", "th", F.col("to").alias("bucket")).dropDuplicates(["bucket"])
    return placed.select("id", "rank", "text", "th", "bucket", F.lit(0).alias("guest")).unionByName(guests.withColumn("guest", F.lit(1)))


def fingerprints(docs: DataFrame, words: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_chars, edited (the text whose last half gave way to the next document's start), fingerprint and edited_fingerprint as arrays of subset:hash, near_edited and near_next."""
    order = Window.partitionBy("bucket").orderBy("guest", F.col("rank").desc(), F.col("th").desc(), F.col("text").desc())
    rows = in_order(docs, buckets, id_col, text_col)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    rows = rows.withColumn("next", F.coalesce("after", F.lit(""))).withColumn("same_next", F.coalesce(F.col("after") == F.col("text"), F.lit(True))).drop("after")
    n_chars = F.length("text")
    half = (n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n_chars.cast("long")).withColumn("edited", F.when(F.col("guest") == 0, edited).otherwise(F.lit("")))
    about = F.struct("id", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), (F.col("edited") == F.col("text")).alias("same_edited"), "same_next")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t"), about.alias("about")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"), F.lit(None).cast(ABOUT.format(docs.schema[id_col].dataType.simpleString())).alias("about")))
    # Flat before the terms are exploded: no text goes along with each of them, and what else is known of a document goes with one term alone, the empty one.
    flat = rows.select("bucket", "n", F.inline(sides).alias("side", "t", "about"))
    each = flat.select("bucket", "n", "side", F.posexplode(F.array_distinct(terms(F.col("t")))).alias("place", "term"), "about")
    each = each.select("bucket", "n", "side", "term", F.when(F.col("place") == 0, F.col("about")).alias("about"))
    each = each.join(F.broadcast(words), "term").select("bucket", "n", "side", "term", "about", F.explode("subsets").alias("k"))
    # The buckets stay where the window put them: neither grouping moves a row.
    hashed = F.lower(F.hex(F.xxhash64(F.array_join(F.sort_array(F.collect_list("term")), " "))))
    subsets = each.groupBy("bucket", "n", "side", "k").agg(hashed.alias("hash"), F.first("about", ignorenulls=True).alias("about"))
    entry = F.concat(F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(":"), "hash")
    of = lambda side: F.sort_array(F.collect_list(F.when((F.col("side") == side) & (F.col("k") >= 0), entry)))
    both = subsets.groupBy("bucket", "n").agg(F.first("about", ignorenulls=True).alias("about"), of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    both = both.select("bucket", "n", "about.*", "fingerprint", "edited_fingerprint")
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("n"))
    both = both.withColumn("after", after).filter("guest = 0")
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("same_edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("after", "fingerprint"), F.col("same_next")).alias("near_next"),
    )


def fingerprint_all(docs: DataFrame, low: float = 0.002, high: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints() with the lexicon of the documents themselves."""
    return fingerprints(docs, lexicon(docs, text_col, low, high, id_col), layout(docs, text_col).bins, id_col, text_col)
