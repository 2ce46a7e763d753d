"""N-gram Jaccard join by MinHash banding, and the groups its links make.

Texts are sets of runs of five words.  A set's signature is cut into bands; sets that share a band
meet in its bucket, and every pair that meets is verified on the full sets.  The band and row
counts are the cheapest that find a pair at the threshold with the target recall.

Nothing is enumerated that grows with the square of a group.  Equal texts are one class before
anything else.  Buckets with the same members are one bucket.  A large bucket is dealt to blocks,
each pair of blocks is a task of its own, and a task returns one row for each member (its number of
links, and a link that ties it to the others), never its pairs.  A pair that meets in several
buckets counts in the first only.

Edge cases: a null text equals an empty one; a text of 1 to 4 words is a set of one run; texts
without a word have an empty set and are linked to nothing, but equal ones are one class; words are
runs of anything but ASCII white space, unchanged; repeated rows are equal texts;
ids need be neither unique nor there: a distinct text is known by its smallest id and 128 bits of its hash;
ties take the smallest id, null ids last, and a group of null ids alone has a null class_id and still a class_key.
Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import checkpointed, join_small

BLOCK = 192
SLICE_BYTES = 512 << 10


def banding(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): of the pairs that reach the recall at the threshold, the one with the fewest chance meetings at half of it among those of at most 128 hashes."""
    best = None
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        chance = 1 - (1 - (threshold / 2) ** rows) ** bands
        if bands * rows <= 128 and (best is None or chance < best[0]):
            best = (chance, bands, rows)
    return best[1:]


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's runs of n words as sorted distinct hashes, row after row, and the rows' offsets in them."""
    w = W.words(column)
    ends = w.ends
    runs = np.zeros(len(w.hashes), W.U64)
    runs[: max(0, len(w.hashes) - n + 1)] = W.grams(w.hashes, n)
    keep = w.left() >= n
    for k in np.flatnonzero((w.counts > 0) & (w.counts < n)):  # a short text is one run
        a, b = ends[k] - w.counts[k], ends[k]
        runs[a], keep[a] = W.mixed(W.grams(w.hashes[a:b], int(b - a)))[0], True
    rows = np.repeat(np.arange(len(w.counts)), w.counts)[keep]
    runs = runs[keep]
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    new = np.r_[True, (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])][: len(runs)]
    runs, rows = runs[new], rows[new]
    return runs, np.searchsorted(rows, np.arange(len(w.counts) + 1))


def signatures(runs: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each row and band."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, bands), np.int64)
    if not len(filled):
        return out
    first = offsets[filled]
    draw = np.random.RandomState(11)
    for band in range(bands):
        total = np.zeros(len(filled), W.U64)
        for _ in range(rows):
            a, b = (W.U64(int(draw.randint(0, 1 << 62)) * 2 + 1) for _ in range(2))
            least = np.minimum.reduceat(runs * a + b >> W.U64(20), first)
            total = W.mixed(total * W.U64(W.BASE) + least)
        out[filled, band] = total.view(np.int64)
    return out


def links_of(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """One bucket, or two blocks of one: each member's links, counted, and a spanning set of them."""
    bucket, i, j = (k.as_py() for k in key)
    ids = rows["node"].to_pylist()
    first = {x: k for k, x in reversed(list(enumerate(ids)))}
    if len(first) < len(ids):  # a repeated row is one member
        rows = rows.take(pa.array(sorted(first.values())))
        ids = rows["node"].to_pylist()
    n = len(ids)
    block = rows["block"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["runs"]]
    size = np.array([len(s) for s in sets])
    # Members' sets in one column, so that one member meets all others at once; their buckets likewise.
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    starts = np.r_[0, np.cumsum(size)]
    lists = rows["buckets"].combine_chunks()
    every, bucket_codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    bucket_starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    this, none = int(np.searchsorted(every, bucket)), len(every)
    mark, bucket_mark = np.zeros(len(values), bool), np.zeros(len(every), bool)
    n_links = np.zeros(n, np.int64)
    group = np.arange(n)  # members tied so far share one number
    loose = np.arange(n)  # by group: the member of it without a tie
    tied: list[bytes | None] = [None] * n
    for a in range(n):
        if i != j and block[a] != i:
            continue
        mine, its = codes[starts[a] : starts[a + 1]], bucket_codes[bucket_starts[a] : bucket_starts[a + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes], starts[:-1])
        mark[mine] = False
        near = both >= threshold * (size + size[a] - both) - 1e-9
        near &= (block == j) if i != j else (np.arange(n) > a)
        if len(its) > 1 and near.any():  # a pair counts in the first bucket that both are in
            bucket_mark[its] = True
            near &= np.minimum.reduceat(np.where(bucket_mark[bucket_codes], bucket_codes, none), bucket_starts[:-1]) == this
            bucket_mark[its] = False
        n_links[a] += near.sum()
        n_links[near] += 1
        for other in np.unique(group[near]).tolist():
            if other != group[a]:  # one tie for each union
                tied[loose[other]] = ids[a]
                group[group == other] = group[a]
    kept = [k for k in range(n) if n_links[k] or tied[k] is not None]
    return pa.table({"node": pa.array([ids[k] for k in kept], pa.binary()), "links": pa.array(n_links[kept], pa.int64()), "tie": pa.array([tied[k] for k in kept], pa.binary())})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the smallest node each can reach.  Each round halves the distances; a round's table is checkpointed."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    now = checkpointed(both)
    for _ in range(most_rounds):
        # Every node ties its larger neighbours and itself to the smallest of all; then every node ties its smaller ones to the smallest.
        # The smallest is aggregated before it is joined: the centre of a large group is one key.
        least = now.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = now.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a").select("a", F.col("m").alias("b")))
        large = large.filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        new = checkpointed(small)
        sides = new.select("a").intersect(new.select("b"))
        twice = new.groupBy("a").count().filter("count > 1")
        if sides.isEmpty() and twice.isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = checkpointed(new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    raise RuntimeError("the groups did not settle")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null is empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def node_of(first_id: Column, key: Column) -> Column:
    """A distinct text: its smallest id and its key, so that nodes sort by the id, those without one last."""
    sign = F.lit(-(1 << 63)).cast("bigint")
    return F.when(first_id.isNull(), F.concat(F.unhex(F.lit("01" + "0" * 16)), key)).otherwise(F.concat(F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(first_id.bitwiseXOR(sign)), 16, "0"))), key))


def id_of(node: Column) -> Column:
    """The id in a node."""
    sign = F.lit(-(1 << 63)).cast("bigint")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(sign))


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, copy_of (the smallest id with the same text), class_id (the smallest id of its group), n_links (different texts within the threshold),
    class_key (one for each group, whatever its ids) and text_key."""
    bands, rows = banding(threshold, recall)
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    keyed = slim.select("id", "key")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("copy_of"))
    nodes = firsts.select("key", "copy_of", node_of(F.col("copy_of"), F.col("key")).alias("node"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch, 1, SLICE_BYTES):
                runs, offsets = shingles(part.column(1), n)
                sig = signatures(runs, offsets, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "bands"]).filter(pa.array(np.diff(offsets) > 0))

    # Copies of a text have the same bands: one of them stays for each task before anything is sent.
    signed = slim.select("key", "text").mapInArrow(sign, "key binary, bands array<long>").groupBy("key").agg(F.first("bands").alias("bands"))
    members = signed.join(nodes, "key").select("node", F.posexplode("bands").alias("band", "hash"))
    members = members.select("node", F.xxhash64("band", "hash").alias("bucket"))
    # A bucket is known by its members: their number, and two sums of their hashes.
    bits = F.xxhash64("node")
    sums = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.shiftright(bits, 24).cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2")).filter("size > 1")
    chosen = sums.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    held = checkpointed(members.join(chosen, "bucket").distinct())
    lists = held.groupBy("node").agg(F.collect_list("bucket").alias("buckets")).select("node", "buckets", id_of(F.col("node")).alias("id"), F.substring("node", 10, 16).alias("key"))

    def pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch, 1, SLICE_BYTES):
                runs, offsets = shingles(part.column(1), n)
                packed = [runs[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], ["node", "buckets", "runs"])

    # By id and key: the copies of one text are not gathered, and rows equal in both are one before any of them is sent.
    first = distinct_rows(slim).alias("d").join(lists.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.key") == F.col("l.key"))).select("l.node", "d.text", "l.buckets")
    sets = first.mapInArrow(pack_sets, "node binary, buckets array<long>, runs binary")
    # Blocks of a large bucket: a member goes to every pair of blocks that has its own.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = held.withColumn("blocks", blocks).withColumn("block", own).select("node", "bucket", "block", F.explode(pairs).alias("p")).select("node", "bucket", "block", "p.i", "p.j")
    tasks = dealt.join(sets, "node")
    found = checkpointed(tasks.groupBy("bucket", "i", "j").applyInArrow(lambda key, t: links_of(key, t, threshold), "node binary, links long, tie binary"))
    roots = components(found.filter("tie IS NOT NULL").select(F.col("node").alias("a"), F.col("tie").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = links.join(roots.withColumnRenamed("node", "tied"), F.col("node") == F.col("tied"), "left").select("node", "n_links", F.coalesce("root", "node").alias("class_node"))
    per_class = nodes.join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    per_class = per_class.select("key", "copy_of", id_of(F.col("class_node")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.hex(F.substring("class_node", 10, 16)).alias("class_key"))
    return keyed.join(per_class, "key").select(F.col("id").alias(id_col), "copy_of", "class_id", "n_links", "class_key", F.col("key").alias("text_key"))


def distinct_rows(slim: DataFrame) -> DataFrame:
    """One row for each id (null is one) and key of (id, text, key): only rows that are there several times are grouped, and each task sends one of them at most."""
    row = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary"), "key"))
    told = slim.withColumn("row", row)
    equal = told.groupBy("row").agg(F.count("*").alias("rows")).filter("rows > 1").withColumnRenamed("row", "of")
    told = join_small(told, equal, "row", "of")
    once = told.filter("rows IS NULL").select("id", "text", "key")
    often = told.filter("rows IS NOT NULL").groupBy("row").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("key").alias("key"))
    return once.union(often.select("id", "text", "key"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns: the smallest id (null ids last), then the smallest text key, then the smallest hash of the other columns; rows equal in all are one."""
    found = near_copies(docs, n, threshold, recall, id_col, text_col)
    chosen = found.groupBy("class_key").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("key"))).alias("best"))
    row = lambda i, key: F.sha2(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), F.hex(key)), 256)
    best = chosen.select(row(F.col("best.id"), F.col("best.key")).alias("row"))
    placed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row(docs[id_col], text_key(docs[text_col])).alias("row"), F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != text_col]))).alias("rest"))
    kept = placed.join(best, "row", "left_semi")
    return kept.groupBy("row").agg(F.min_by("doc", "rest").alias("doc")).select("doc.*")
