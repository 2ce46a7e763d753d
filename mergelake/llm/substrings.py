"""Substring dedup with fixed-block anchors.

The index holds the non-overlapping blocks of (window + 1) // 2 words of every
document; a window of that many words always covers one of them whole.  Every
rolling block of every document probes the index.  A hit is extended over all
windows that hold it, each window's words are compared with those of all other
extended hits, and the union of the windows found elsewhere is the maximal
exact repeat, which is removed.

Edge cases: a null or empty text has no words; a text shorter than the window
keeps all its words; equal texts lose every word that a window covers, on both
sides, as do repeats within one text, overlapping ones included; repeated rows
count as separate documents.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

ASKED = "bin int, shard int, payload binary"


def _sent(bin_id: int, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table({"bin": pa.array([bin_id] * n, pa.int32()), "shard": pa.array(range(n), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _probes(text: pa.ChunkedArray, block: int, bits: int) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, which of them begin a rolling block, the distinct block hashes, and which of these each has."""
    w = W.words(text)
    starts = np.flatnonzero(w.left() >= block)
    hashes = W.grams(w.hashes, block)[starts] >> W.U64(64 - bits) if len(starts) else np.zeros(0, W.U64)
    distinct, which = np.unique(hashes, return_inverse=True)
    return w, starts, distinct, which


def _answer(rows: pa.Table, need_block: bool) -> pa.Table:
    """For each bin's hashes in a shard, whether the words stand in more than one place, an indexed block among them."""
    parts = [W.unpack(p.as_py()) for p in rows["payload"]]
    keys = np.concatenate([np.cumsum(p[0], dtype=W.U64) for p in parts])
    extra = np.concatenate([p[1] for p in parts])
    flags = np.concatenate([p[2] for p in parts])
    order = np.argsort(keys, kind="stable") if need_block else np.lexsort((extra, keys))
    keys, flags_in = keys[order], flags[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    if not need_block:
        new[1:] |= extra[order][1:] != extra[order][:-1]
    hit = np.zeros(len(keys), bool)
    if len(keys):
        first = np.flatnonzero(new)
        places = np.add.reduceat(1 + (flags_in & 1).astype(np.int64), first)
        blocks = np.bitwise_or.reduceat(flags_in, first) & 2
        hit[order] = np.repeat((places > 1) & ((blocks > 0) | (not need_block)), np.diff(np.r_[first, len(keys)]))
    cuts = np.cumsum([0] + [len(p[0]) for p in parts])
    bits = [W.pack(np.packbits(hit[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"bin": rows["bin"], "shard": rows["shard"], "payload": pa.array(bits, pa.binary())})


def _hits(answers: pa.Table, cuts: np.ndarray) -> np.ndarray:
    """The shards' answers, in the order of the distinct hashes."""
    out = np.zeros(cuts[-1], bool)
    for shard, payload in zip(answers["shard"].to_pylist(), answers["payload"], strict=True):
        a, b = cuts[shard], cuts[shard + 1]
        out[a:b] = np.unpackbits(W.unpack(payload.as_py())[0], count=b - a).astype(bool)
    return out


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", layout: W.Layout | None = None) -> DataFrame:
    """One row per row: the id, n_words, n_removed and kept_text, the words that no repeated window covers, joined by a space."""
    lay = layout or W.layout(docs, text_col)
    block = (window + 1) // 2
    # So many bits that a chance hit is rare at any size; a hit is only a candidate.
    bits = min(64, max(32, math.ceil(math.log2(lay.bytes + 2)) + 15))
    shard_bits = lay.shard_bits

    def ask_blocks(key, rows):
        w, starts, distinct, which = _probes(rows["text"], block, bits)
        flags = np.minimum(np.bincount(which, minlength=len(distinct)) - 1, 1).astype(np.uint8)
        flags[which[w.place()[starts] % block == 0]] |= 2
        cuts = W.slices(distinct, shard_bits, bits)
        none = np.zeros(0, np.uint8)
        return _sent(key[0].as_py(), [W.pack(W.gaps(distinct[a:b]), none, flags[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def windows(text, answers):
        """The words, the places of windows that hold a hit, and their two hashes."""
        w, starts, distinct, which = _probes(text, block, bits)
        hit = np.zeros(len(w.hashes) + 1, np.int32)
        hit[starts + 1] = _hits(answers, W.slices(distinct, shard_bits, bits))[which]
        seen = np.cumsum(hit)
        at = np.flatnonzero(w.left() >= window)
        at = at[seen[at + window - block + 1] > seen[at]]
        if not len(at):
            return w, at, np.zeros(0, W.U64), np.zeros(0, np.uint32)
        return w, at, W.grams(w.hashes, window)[at], (W.grams(w.hashes, window, W.GRAM_POWERS_2)[at] >> W.U64(32)).astype(np.uint32)

    def distinct_windows(one, two):
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return one[new], two[new], which

    def ask_windows(key, rows, answers):
        if not rows.num_rows:
            return _sent(key[0].as_py(), [])
        _, _, one, two = windows(rows["text"], answers)
        one, two, which = distinct_windows(one, two)
        flags = np.minimum(np.bincount(which, minlength=len(one)) - 1, 1).astype(np.uint8)
        cuts = W.slices(one, shard_bits)
        # A shard that nothing is asked of gets nothing; the first always does, so that every bin has an answer.
        return _sent(key[0].as_py(), [W.pack(W.gaps(one[a:b]), two[a:b], flags[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def removed(key, rows, blocks_and_windows):
        kinds = np.array(blocks_and_windows["kind"].to_pylist(), np.int64)
        blocks, wide = (blocks_and_windows.filter(pa.array(kinds == k)) for k in (0, 1))
        w, at, one, two = windows(rows["text"], blocks)
        one, _, which = distinct_windows(one, two)
        at = at[_hits(wide, W.slices(one, shard_bits))[which]]
        cover = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        total = np.r_[0, np.cumsum(gone)]
        ends = w.ends
        lost = total[ends] - total[ends - w.counts]
        raw, offsets = W.text_bytes(rows["text"])
        raw = raw.tobytes()
        kept = []
        for k in range(rows.num_rows):
            these = raw[offsets[k] : offsets[k + 1]].split()
            if lost[k]:
                these = [x for x, g in zip(these, gone[ends[k] - w.counts[k] : ends[k]].tolist(), strict=True) if not g]
            kept.append(b" ".join(these))
        return pa.table({"id": rows["id"], "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("bin", W.bin_of(lay.bins, "id", "text"))
    kind = slim.schema["id"].dataType.simpleString()
    by_bin = slim.groupBy("bin")
    blocks = by_bin.applyInArrow(ask_blocks, ASKED).groupBy("shard").applyInArrow(lambda t: _answer(t, True), ASKED)
    wide = by_bin.cogroup(blocks.groupBy("bin")).applyInArrow(ask_windows, ASKED).groupBy("shard").applyInArrow(lambda t: _answer(t, False), ASKED)
    both = blocks.withColumn("kind", F.lit(0)).unionByName(wide.withColumn("kind", F.lit(1)))
    return by_bin.cogroup(both.groupBy("bin")).applyInArrow(removed, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
