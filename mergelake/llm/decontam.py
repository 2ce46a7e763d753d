"""Benchmark decontamination by a prefix-filtered set join.

A record is a window of an item: so many consecutive words of it, or the whole item where it has fewer
(or where no size is given).  It is a set of shingles, ordered by rarity: by how often each stands in all
documents, counted over all of them.  A document's window of as many words as the record contains the record
if it has at least ``threshold`` of its shingles, so it has one of the rarest ``n - ceil(threshold * n) + 1``:
only these prefix tokens are joined.  A token's place bounds where the window can begin (at a threshold of 1 it fixes
it), a document shorter than the record has no window, and what is left is verified: at 1 word by word, below it by
counting shingles.

The records, which do not grow with the documents, are cut into parts of at most ``part_bytes``; a part is broadcast,
and the documents are read past it without a shuffle.  With several parts each is one pass, and what they hit is merged.

Edge cases: a null text has no words and no hits; an item without words has no window; items with one id are one item,
and those without an id are the item ``null``; equal windows of several items are one record that counts for each;
repeated rows and ids of documents are rows of their own, as are null ones; an empty table on either side hits nothing.  Columns other
than the ids and the texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .nearcopies import text_key
from .shared import checkpointed, join_small

#: Bytes between words, after A-Z are lower: all of ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = GAP[0x80:] = False
SLICE_BYTES = 1 << 20
PART_BYTES = 16 << 20
#: Pairs of a token and a record that are looked at in one go.
CHUNK = 1 << 20
FILTER_BITS = 20


class Text:
    """A column's words, their hashes, and runs of them."""

    def __init__(self, column: pa.Array):
        raw, offsets = W.text_bytes(column)
        self.raw = W.LOWER[raw]
        self.starts, self.ends, self.counts = W.runs_of(self.raw, offsets, GAP) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64))
        hashes = W.hashed(self.raw, self.starts, self.ends)
        up, self.down = W.GRAM_POWERS.to(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, W.U64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.last = np.cumsum(self.counts)  # by row: the place after its last word

    def hashes(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Of the n words from each place on."""
        return W.mixed((self.total[at + n] - self.total[at]) * self.down[at])

    def whole(self, n: int) -> np.ndarray:
        """The places from which n words of one row go on."""
        return np.flatnonzero(self.last[self.row] - np.arange(len(self.row)) >= n)

    def joined(self, a: int, b: int) -> bytes:
        return b" ".join([self.raw[i:j].tobytes() for i, j in zip(self.starts[a:b], self.ends[a:b], strict=True)])


class Tokens:
    """Sorted hashes and who is among them; a table of their top bits spares most searches."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.top = np.zeros(1 << FILTER_BITS, bool)
        self.top[hashes >> W.U64(64 - FILTER_BITS)] = True

    def among(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked are there, and at what place."""
        maybe = np.flatnonzero(self.top[asked >> W.U64(64 - FILTER_BITS)])
        k = np.searchsorted(self.hashes, asked[maybe])
        k[k == len(self.hashes)] = 0
        there = self.hashes[k] == asked[maybe] if len(self.hashes) else np.zeros(0, bool)
        return maybe[there], k[there]


@dataclass
class Records:
    """Windows of items and their shingles of n words, before any are chosen: one row a shingle and place."""

    n: int
    text: Text
    texts: np.ndarray
    record: np.ndarray
    offset: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str], shingle: int) -> list[Records]:
        """By the number of words of their shingles: a record shorter than a shingle is one."""
        counts = Text(pa.array(texts, pa.string())).counts
        out = []
        for n in range(1, shingle + 1):
            own = [t for t, c in zip(texts, counts, strict=True) if min(c, shingle) == n]
            if own:
                text = Text(pa.array(own, pa.string()))
                at = text.whole(n)
                record = text.row[at]
                out.append(cls(n, text, np.array([t.encode() for t in own], object), record, at - (text.last - text.counts)[record], text.hashes(at, n)))
        return out


class Index:
    """The prefix tokens of records, and what verifies a candidate."""

    def __init__(self, records: Records, seen: dict[int, int], threshold: float):
        self.n, self.threshold, self.texts = records.n, threshold, records.texts
        self.length = records.text.counts
        self.whole = records.text.hashes(records.text.last - self.length, self.length)
        order = np.lexsort((records.offset, records.hashes, records.record))
        record, offset, hashes = records.record[order], records.offset[order], records.hashes[order]
        first = np.r_[True, (record[1:] != record[:-1]) | (hashes[1:] != hashes[:-1])]
        record, offset, hashes = record[first], offset[first], hashes[first]
        size = np.bincount(record, minlength=len(self.texts))
        self.needs = np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int64), 1)
        self.sets, self.begins = hashes, np.r_[0, np.cumsum(size)]
        rarity = np.array([seen.get(h, 0) for h in hashes.tolist()], np.int64)
        order = np.lexsort((hashes, rarity, record))
        rank = np.arange(len(order)) - self.begins[record[order]]
        kept = order[rank < (size - self.needs + 1)[record[order]]]
        kept = kept[np.argsort(hashes[kept], kind="stable")]
        distinct, self.first = np.unique(hashes[kept], return_index=True)
        self.first = np.r_[self.first, len(kept)]
        self.tokens, self.record, self.offset = Tokens(distinct), record[kept], offset[kept]

    def found(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(record, place) of the windows of a column's rows that contain a record."""
        at = text.whole(self.n)
        which, token = self.tokens.among(text.hashes(at, self.n))
        at, out = at[which], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        many = self.first[token + 1] - self.first[token]
        upto = np.r_[0, np.cumsum(many)]
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, "right")) - 1)
            entry = np.arange(upto[a], upto[b]) - np.repeat(upto[a:b] - self.first[token[a:b]], many[a:b])
            out.append(self.verified(text, np.repeat(at[a:b], many[a:b]), entry))
            a = b
        record, place = (np.concatenate(x) for x in zip(*out, strict=True))
        return record, place

    def verified(self, text: Text, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates: the tokens' places, and the entries they met."""
        record, row = self.record[entry], text.row[at]
        if self.threshold >= 1:
            place = at - self.offset[entry]
        else:  # every window of the record's size that holds the token
            ways = self.length[record] - self.n + 1
            upto = np.cumsum(ways)
            back = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - ways, ways)
            record, row, place = np.repeat(record, ways), np.repeat(row, ways), np.repeat(at, ways) - back
        last = text.last[row]
        fits = (place >= last - text.counts[row]) & (place + self.length[record] <= last)
        record, place = record[fits], place[fits]
        if self.threshold >= 1:
            same = text.hashes(place, self.length[record]) == self.whole[record]
            pairs = np.unique(np.stack([record[same], place[same]], 1), axis=0)
            right = [self.texts[r] == text.joined(p, p + self.length[r]) for r, p in pairs.tolist()]
            pairs = pairs[np.array(right, bool)]
            return pairs[:, 0], pairs[:, 1]
        pairs = np.unique(np.stack([record, place], 1), axis=0)
        record, place = pairs[:, 0], pairs[:, 1]
        right = np.zeros(len(pairs), bool)
        for r in np.unique(record).tolist():
            own = np.flatnonzero(record == r)
            spread = np.arange(self.length[r] - self.n + 1)
            for k in range(0, len(own), max(1, CHUNK // len(spread))):
                some = own[k : k + max(1, CHUNK // len(spread))]
                held = np.sort(text.hashes(place[some][:, None] + spread, self.n), axis=1)
                once = np.c_[np.ones(len(some), bool), held[:, 1:] != held[:, :-1]]
                right[some] = (np.isin(held, self.sets[self.begins[r] : self.begins[r + 1]]) & once).sum(axis=1) >= self.needs[r]
        return record[right], place[right]


def windows(items: DataFrame, size: int | None, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the distinct windows of each item, their words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch, 1, SLICE_BYTES):
                text, names, out = Text(part.column(1)), part.column(0).to_pylist(), []
                for name, last, n in zip(names, text.last.tolist(), text.counts.tolist(), strict=True):
                    long = min(size or n, n)
                    out += [(name, text.joined(a, a + long).decode()) for a in range(last - n, last - long + 1)] if n else []
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(2)], ["item", "words"])

    named = items.select(F.coalesce(items[item_col].cast("string"), F.lit("null")).alias("item"), items[text_col].alias("text"))
    return named.mapInArrow(cut, "item string, words string").distinct()


def counted(texts: DataFrame, shingles: list[tuple[int, np.ndarray]]) -> dict[int, int]:
    """How often each shingle stands in all texts; a row for each that is there, as many as the part has at most."""
    asked = texts.sparkSession.sparkContext.broadcast([(n, Tokens(h)) for n, h in shingles])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in W.parts(batch, 0, SLICE_BYTES):
                text = Text(part.column(0))
                for n, tokens in asked.value:
                    h = text.hashes(text.whole(n), n)
                    found.append(h[tokens.among(h)[0]])
            values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, W.U64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    rows = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["shingle"].to_numpy().view(W.U64).tolist(), rows["n"].to_pylist(), strict=True))


def probed(texts: DataFrame, part: list[tuple[str, str]], shingle: int, threshold: float) -> DataFrame:
    """(id, key, n_words, items, spans) of texts (id, key, text) beside one part of (item, words)."""
    items: dict[str, list[str]] = {}
    for item, words in part:
        items.setdefault(words, []).append(item)
    records = Records.of(sorted(items), shingle)
    seen = counted(texts, [(r.n, np.unique(r.hashes)) for r in records]) if records else {}
    index = [Index(r, seen, threshold) for r in records]
    names = [[items[t.decode()] for t in i.texts] for i in index]
    held = texts.sparkSession.sparkContext.broadcast((index, names))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = held.value
        for batch in batches:
            for part in W.parts(batch, 2, SLICE_BYTES):
                text = Text(part.column(2))
                edge, hit = np.zeros(len(text.row) + 1, np.int64), [set() for _ in text.counts]
                for i, called in zip(index, names, strict=True):
                    record, place = i.found(text)
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + i.length[record], -1)
                    for row, r in set(zip(text.row[place].tolist(), record.tolist(), strict=True)):
                        hit[row].update(called[r])
                in_hit = np.cumsum(edge[:-1]) > 0
                same_row = np.r_[False, text.row[1:] == text.row[:-1]] if len(text.row) else np.zeros(0, bool)
                begins = np.flatnonzero(in_hit & ~(np.r_[False, in_hit[:-1]] & same_row))
                ends = np.flatnonzero(in_hit & ~np.r_[in_hit[1:] & same_row[1:], False]) + 1
                row, first = text.row[begins], text.last - text.counts
                spans = pa.StructArray.from_arrays([pa.array(begins - first[row]), pa.array(ends - first[row])], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(text.counts) + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text.counts.astype(np.int64)), pa.array([sorted(h) for h in hit], pa.list_(pa.string())), spans.cast(pa.list_(span))], ["id", "key", "n_words", "items", "spans"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(probe, f"id {kind}, key binary, n_words long, items array<string>, spans array<struct<start:long,end:long>>")


def merged(spans: F.Column) -> F.Column:
    """Spans as the fewest that cover the same words; those that only touch are one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(out: F.Column, s: F.Column) -> F.Column:
        top = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]), grown).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int | None = 10,
    shingle: int = 5,
    threshold: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit (words inside a window that contains a record), items (ids as strings, sorted) and spans (of hit words, from 0, end exclusive)."""
    pairs = checkpointed(windows(benchmark, size, item_col, item_text_col))
    # A record is held as text, as shingles and as prefix tokens; a pair as two strings.
    total = pairs.agg(F.sum(F.octet_length("item") + F.octet_length("words"))).first()[0] or 0
    n_parts = max(1, math.ceil(total / part_bytes))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(n_parts)))
    texts = docs.select(docs[id_col].alias("id"), (text_key(docs[text_col]) if n_parts > 1 else F.lit(None).cast("binary")).alias("key"), docs[text_col].cast("string").alias("text"))

    def one(k: int) -> DataFrame:
        rows = dealt.filter(F.col("part") == k).select("item", "words").toArrow()
        return probed(texts, list(zip(rows["item"].to_pylist(), rows["words"].to_pylist(), strict=True)), shingle, threshold)

    out = one(0)
    if n_parts > 1:
        # Equal texts have equal hits: one row for each text and part comes to the merge.
        rest = [one(k).filter(F.size("spans") > 0).groupBy("key").agg(F.first("items").alias("items"), F.first("spans").alias("spans")) for k in range(1, n_parts)]
        more = rest[0]
        for r in rest[1:]:
            more = more.union(r)
        more = more.groupBy("key").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
        out = join_small(out, more, "key")
        both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
        out = out.withColumn("items", F.array_sort(F.array_distinct(both("items", "more_items")))).withColumn("spans", merged(both("spans", "more_spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


#: The same in DuckDB's SQL, for windows of 10 words.
ORACLE = r"""
WITH of_documents AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
of_items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM of_items WHERE len(w) > 0),
records AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
places AS (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM of_documents, (SELECT DISTINCT n FROM records) WHERE len(w) >= n),
found AS (SELECT p.row_no, p.s, p.n, r.item FROM (SELECT row_no, s, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM places) p JOIN records r ON p.words = r.words AND p.n = r.n),
hit AS (SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT row_no, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT row_no, s, n FROM found)) GROUP BY row_no),
named AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items FROM (SELECT DISTINCT row_no, item FROM found) GROUP BY row_no)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM of_documents d LEFT JOIN hit h ON h.row_no = d.row_no LEFT JOIN named i ON i.row_no = d.row_no
"""
