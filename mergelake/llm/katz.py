"""LM scoring with Katz backoff of any order.

A gram seen in training has its Good-Turing discounted frequency after its context, any other
the backoff weight of the context times the probability of its last token after one token of context less, and so on down to
single tokens, which are discounted in the same way, the rest going to unseen tokens as one class.  Weights are exact:
1 less the discounted frequencies of a context's seen successors, over 1 less their own lower probabilities.

Counts live in tables that are partitioned by the hash of the token (order 1) or of the context
(higher orders).  Each bin of documents asks each partition once for the counts of its distinct
tokens, then of its distinct pairs, and so on, and evaluates every token of its texts from the answers, lowest order first.  A context
that makes up more than one partition's share of all tokens has its grams dealt over all partitions, and its sums added up.

Good-Turing's counts of counts are always smoothed, by the line fitted to their logarithms (which is at most as flat as LEAST_SLOPE);
there is no other rule for any size or shape of corpus.

Edge cases: a null or empty text is its end token alone; with no training text every token has the
probability 1 (all mass is the unseen class) and the base formula gives the same; repeated rows
count as often as they stand; tokens are runs of anything but ASCII white space with A-Z lower-cased.
Only the id, the text and the training condition are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Counts up to it are discounted.
GT_MOST = 5
LEAST_SLOPE = -1.1
END, START = (W.mixed(np.array([x], W.U64)) for x in (0x45, 0x53))
#: Of a pair's second token so many bits of its hash are sent.  A first token has at most one partition's share of tokens
#: as successors in a partition, about a million at any size, so two of them meet with a chance of 1e-7.
SECOND_BITS = 44
#: Sums of probabilities are sent with so many bits of a double: a relative error of 1e-11.
SUM_BITS = 48
ASKED = "bin int, shard int, payload binary"


def discounts(n: np.ndarray) -> np.ndarray:
    """The factor of each count from 0 to GT_MOST after Katz, from how many things were seen 1, 2, ... GT_MOST + 1 times.

    Smoothed Good-Turing: the logarithms of the counts of counts lie on a line over that of the count, fitted with the counts as weights.  One
    thing in all is added along the inverse square, so that there is a line for any corpus; a slope below -1 makes every factor lie between 0 and 1."""
    r = np.arange(1, GT_MOST + 2)
    n = np.asarray(n, float) + 1.0 / r**2
    slope = min(np.polyfit(np.log(r), np.log(n), 1, w=np.sqrt(n))[0], LEAST_SLOPE)
    whole = r[-1] ** (1 + slope)
    return np.r_[1.0, ((r[1:] / r[:-1]) ** (1 + slope) - whole) / (1 - whole)]


def backoff(sums: np.ndarray, low: np.ndarray, context: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts seen so often: the scale of their seen successors' frequencies, and the weight of the others' own probabilities.

    A context whose successors were all seen too often to be discounted keeps one count's share for the others."""
    kept = ((factor[1:] * np.arange(1, GT_MOST + 1)) @ sums[:GT_MOST] + sums[GT_MOST]) / np.maximum(context, 1)
    seen = sums.sum(axis=0) > 0
    least = 1 / (context + 1.0)
    scale = np.where(seen & (1 - kept < least), (1 - least) / np.maximum(kept, 1e-300), 1.0)
    return scale, np.where(seen, (1 - kept * scale) / np.maximum(1 - low, 1e-300), 1.0)


class Unigrams:
    """Discounted token probabilities, from the sums over all partitions: tokens, distinct tokens, and tokens seen 1, 2, ... times."""

    def __init__(self, stats: np.ndarray):
        self.stats = stats
        self.total, self.distinct = int(stats[0]), int(stats[1])
        self.factor = discounts(stats[2:])
        seen = np.arange(GT_MOST + 1)[1:] * stats[2 : 2 + GT_MOST]
        self.rest = float(((1 - self.factor[1:]) * seen).sum()) / self.total if self.total else 1.0
        self.scale = 1.0
        if self.total and self.rest < 1 / (self.total + 1):  # the unseen class has one token's share at least
            self.scale, self.rest = (1 - 1 / (self.total + 1)) / (1 - self.rest), 1 / (self.total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        """The probability of tokens with these counts; of the unseen class for 0."""
        c = counts.astype(float)
        out = c * np.where(counts <= GT_MOST, self.factor[np.minimum(counts, GT_MOST)], 1.0) * (self.scale / max(self.total, 1))
        return np.where(counts == 0, self.rest, out)


class Tokens:
    """A bin's texts as indices of its distinct tokens; each row ends with END, and START stands before its first."""

    def __init__(self, rows: pa.Table):
        w = W.words(rows["text"], lower=True)
        n = w.counts + 1
        ends = np.cumsum(n)
        hashes = np.empty(int(ends[-1]) if len(ends) else 0, W.U64)
        is_end = np.zeros(len(hashes), bool)
        is_end[ends - 1] = True
        hashes[is_end] = END[0]
        hashes[~is_end] = w.hashes
        self.counts, self.ends = n, ends
        self.train = np.repeat(np.array(rows["train"].to_pylist(), bool), n)
        self.n_train_rows = int(np.sum(rows["train"].to_pylist()))
        self.hashes, which = np.unique(np.r_[hashes, START], return_inverse=True)
        self.which = which[:-1]
        self.start = int(which[-1])

    def asked(self) -> np.ndarray:
        """Training counts of the distinct tokens; START's is the number of training rows."""
        out = np.bincount(self.which[self.train], minlength=len(self.hashes))
        out[self.start] = self.n_train_rows
        return out

    def first(self) -> np.ndarray:
        """Where each row begins."""
        return self.ends - self.counts

    def before_by(self, x: np.ndarray, other) -> np.ndarray:
        """Each token's value of x at the token before it; other at a row's first."""
        out = np.empty(len(x), x.dtype)
        out[1:] = x[:-1]
        out[self.first()] = other
        return out

    def context(self, order: int) -> np.ndarray:
        """The hash of the order - 1 tokens before each token; START stands before a row."""
        token = self.hashes[self.which]
        out = token = self.before_by(token, START[0])
        for _ in range(order - 2):
            token = self.before_by(token, START[0])
            out = W.mixed(token * W.U64(W.BASE) + out)
        return out


def sent(bin_id: int, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table({"bin": pa.array([bin_id] * n, pa.int32()), "shard": pa.array(range(n), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def count_tokens(rows: pa.Table) -> pa.Table:
    """A partition's token counts: each bin's answer has the counts it asked for and the partition's sums."""
    parts = [W.unpack(p.as_py()) for p in rows["payload"]]
    keys = np.concatenate([np.cumsum(p[0], dtype=W.U64) for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    distinct, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
    real = total[distinct != START[0]]
    stats = np.r_[real.sum(), (real > 0).sum(), [(real == r).sum() for r in range(1, GT_MOST + 2)]].astype(np.int64)
    cuts = np.cumsum([0] + [len(p[0]) for p in parts])
    back = [W.pack(total[which[a:b]], stats) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"bin": rows["bin"], "shard": rows["shard"], "payload": pa.array(back, pa.binary())})


def shortened(x: np.ndarray) -> np.ndarray:
    """Doubles with the lowest bits off, as integers, which keep the order of positive ones."""
    return np.ascontiguousarray(x, np.float64).view(W.U64) >> W.U64(64 - SUM_BITS) << W.U64(64 - SUM_BITS)


def of_heads(firsts: np.ndarray, counts: np.ndarray, lower: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n first tokens: how many successors were seen 1, ... GT_MOST times, and the count of the others; their own probabilities' sum."""
    out = np.zeros((GT_MOST + 1, n), np.int64)
    for r in range(1, GT_MOST + 1):
        out[r - 1] = np.bincount(firsts[counts == r], minlength=n)
    big = counts > GT_MOST
    out[GT_MOST] = np.bincount(firsts[big], weights=counts[big], minlength=n)
    return out, np.bincount(firsts[counts > 0], weights=lower[counts > 0], minlength=n)


def count_grams(rows: pa.Table, order: int) -> pa.Table:
    """A partition's gram counts and its contexts' sums: each bin's answer follows the order of its question."""
    parts = [W.unpack(p.as_py()) for p in rows["payload"]]
    heads = [np.cumsum(p[0], dtype=W.U64) for p in parts]
    keys = np.concatenate([np.repeat(h, p[1]) for h, p in zip(heads, parts, strict=True)])
    seconds = np.concatenate([p[2] for p in parts])
    counts = np.concatenate([p[3] for p in parts]).astype(np.int64)
    # Only a bin that has the gram in training gives what the last token's lower probability is made of; all that do agree.
    given = np.concatenate([p[4] for p in parts])
    at = np.lexsort((seconds, keys))
    k, s = keys[at], seconds[at]
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])][: len(k)]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[at], first) if len(first) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(given[at], first) if len(first) else given[:0]
    low = Unigrams(parts[0][5]).p(most.astype(np.int64)) if order == 2 else most.view(np.float64)
    each = np.empty(len(k), np.int64)
    each[at] = np.repeat(total, np.diff(np.r_[first, len(k)]))
    distinct, which = np.unique(k[first], return_inverse=True)
    sums, lows = of_heads(which, total, low, len(distinct))
    stats = np.array([(total == r).sum() for r in range(1, GT_MOST + 2)], np.int64)
    back, done = [], 0
    for h, p in zip(heads, parts, strict=True):
        mine = np.searchsorted(distinct, h)
        got = np.zeros((GT_MOST + 1, len(h)), np.int64)
        got_low = np.zeros(len(h))
        if len(distinct):
            have = distinct[np.minimum(mine, len(distinct) - 1)] == h
            got[:, have], got_low[have] = sums[:, mine[have]], lows[mine[have]]
        back.append(W.pack(each[done : done + len(p[2])], got.ravel(), shortened(got_low), stats))
        done += len(p[2])
    return pa.table({"bin": rows["bin"], "shard": rows["shard"], "payload": pa.array(back, pa.binary())})


def answers(rows: pa.Table) -> list[list[np.ndarray]]:
    """A bin's answers in the order of the partitions."""
    order = np.argsort(rows["shard"].to_numpy())
    payloads = rows["payload"]
    return [W.unpack(payloads[int(k)].as_py()) for k in order]


def token_answers(rows: pa.Table) -> tuple[np.ndarray, Unigrams]:
    got = answers(rows)
    return np.concatenate([g[0] for g in got]), Unigrams(np.sum([g[1] for g in got], axis=0))


class Grams:
    """A bin's distinct grams of an order, and which partition each goes to; grams of hot contexts are dealt out one by one."""

    def __init__(self, tokens: Tokens, order: int, context_count: np.ndarray, total: int, shard_bits: int):
        self.contexts, of = np.unique(tokens.context(order), return_inverse=True)
        self.count = np.zeros(len(self.contexts), np.int64)
        self.count[of] = context_count
        code, self.which = np.unique(of * len(tokens.hashes) + tokens.which, return_inverse=True)
        self.firsts, self.seconds = code // len(tokens.hashes), tokens.hashes[code % len(tokens.hashes)]
        self.trained = np.bincount(self.which[tokens.train], minlength=len(code))
        hot = self.count * (1 << shard_bits) > max(total, 1)
        shard = (self.contexts >> W.U64(64 - shard_bits))[self.firsts].astype(np.int64)
        warm = hot[self.firsts]
        gram = W.mixed(self.contexts[self.firsts[warm]] * W.U64(W.BASE) + self.seconds[warm])
        shard[warm] = (gram >> W.U64(64 - shard_bits)).astype(np.int64)
        self.order = np.lexsort((np.arange(len(shard)), shard))
        self.cuts = np.searchsorted(shard[self.order], np.arange((1 << shard_bits) + 1))
        #: Hot contexts of the bin: every partition has a part of their sums.
        self.hot = np.flatnonzero(hot)

    def of_shard(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams that a partition is asked about; its contexts, hot ones included, in ascending order, and each one's number of grams."""
        mine = self.order[self.cuts[shard] : self.cuts[shard + 1]]
        heads, n = np.unique(self.firsts[mine], return_counts=True)
        both = np.union1d(heads, self.hot)
        counts = np.zeros(len(both), np.int64)
        counts[np.searchsorted(both, heads)] = n
        return mine, both, counts


class Evaluated:
    """A bin's tokens with what is known of them up to an order: how often each gram was seen, and each token's probability."""

    def __init__(self, rows: pa.Table, got: pa.Table):
        self.tokens = Tokens(rows)
        replies = got.filter(pa.array(np.array(got["kind"].to_pylist(), np.int64) == 1))
        self.counts, self.unigrams = token_answers(replies)
        self.seen = self.counts[self.tokens.which]
        self.p = self.unigrams.p(self.seen)
        self.order = 1

    def grams(self, shard_bits: int) -> Grams:
        """Those of the next order."""
        context = self.tokens.before_by(self.seen, self.counts[self.tokens.start])
        return Grams(self.tokens, self.order + 1, context, self.unigrams.total, shard_bits)

    def asked(self, shard_bits: int) -> list[bytes]:
        g, out = self.grams(shard_bits), []
        given = np.zeros(len(g.trained), np.uint32 if self.order == 1 else W.U64)
        given[g.which] = self.seen if self.order == 1 else shortened(self.p)
        given[g.trained == 0] = 0
        for shard in range(1 << shard_bits):
            mine, heads, n = g.of_shard(shard)
            out.append(W.pack(W.gaps(g.contexts[heads]), n.astype(np.uint32), g.seconds[mine] >> W.U64(64 - SECOND_BITS), g.trained[mine].astype(np.uint32), given[mine], self.unigrams.stats))
        return out

    def up(self, got: pa.Table, shard_bits: int) -> None:
        """Goes to the next order with its answers."""
        g, order = self.grams(shard_bits), self.order + 1
        seen = np.zeros(len(g.trained), np.int64)
        sums, low, stats = np.zeros((GT_MOST + 1, len(g.contexts)), np.int64), np.zeros(len(g.contexts)), np.zeros(GT_MOST + 1, np.int64)
        replies = got.filter(pa.array(np.array(got["kind"].to_pylist(), np.int64) == order))
        for shard, (each, of_each, lows, some) in enumerate(answers(replies)):
            mine, heads, _ = g.of_shard(shard)
            seen[mine] = each
            sums[:, heads] += of_each.reshape(GT_MOST + 1, -1)
            low[heads] += lows.view(np.float64)
            stats += some
        factor = discounts(stats)
        scale, weight = backoff(sums, low, g.count, factor)
        share = seen * np.where(seen <= GT_MOST, factor[np.minimum(seen, GT_MOST)], 1.0) * (scale / np.maximum(g.count, 1))[g.firsts]
        self.p = np.where(seen[g.which] > 0, share[g.which], weight[g.firsts][g.which] * self.p)
        self.seen, self.order = seen[g.which], order


def by_bins(docs: DataFrame, train: Column, bins: int, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return slim.withColumn("bin", W.bin_of(bins, "id", "text"))


def ask_tokens(bits: int):
    def ask(key, rows):
        t = Tokens(rows)
        counts = t.asked()
        cuts = W.slices(t.hashes, bits)
        return sent(key[0].as_py(), [W.pack(W.gaps(t.hashes[a:b]), counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    return ask


def ask_grams(order: int, bits: int):
    def ask(key, rows, got):
        if not rows.num_rows:
            return sent(key[0].as_py(), [])
        e = Evaluated(rows, got)
        while e.order < order - 1:
            e.up(got, bits)
        return sent(key[0].as_py(), e.asked(bits))

    return ask


def evaluate(order: int, bits: int):
    def scored(key, rows, got):
        e = Evaluated(rows, got)
        while e.order < order:
            e.up(got, bits)
        t, u = e.tokens, e.unigrams
        with np.errstate(divide="ignore"):
            logs = np.log10(e.p)
        base = np.log10((e.counts + 1) / (u.total + u.distinct + 1))[t.which]
        known = e.counts[t.which] > 0
        begins = t.first()
        row_sum = lambda x: np.add.reduceat(x, begins) if len(begins) else x[:0]
        return pa.table(
            {
                "id": rows["id"],
                "train": rows["train"],
                "n_tokens": pa.array(t.counts, pa.int64()),
                "n_known": pa.array(row_sum(known.astype(np.int64))),
                "train_tokens": pa.array(np.full(len(begins), u.total), pa.int64()),
                "base_score": pa.array(row_sum(base)),
                "score": pa.array(row_sum(logs)),
            }
        )

    return scored


def result(rows: DataFrame, got: DataFrame, order: int, bits: int, id_col: str) -> DataFrame:
    kind = f"id {rows.schema['id'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("bin").cogroup(got.groupBy("bin")).applyInArrow(evaluate(order, bits), kind).withColumnRenamed("id", id_col)


def score(docs: DataFrame, train: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text", layout: W.Layout | None = None) -> DataFrame:
    """One row per row: the id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (Katz of an order), both log10 of the text's probability.

    Fits and scores in one go: each partition answers from its counts as they meet, so grams are sent once.  train_tables and score_with do the two apart."""
    lay = layout or W.layout(docs, text_col)
    bits, rows = lay.shard_bits, by_bins(docs, train, lay.bins, id_col, text_col)

    def counted(n):
        return lambda rows: count_grams(rows, n)

    by_bin = rows.groupBy("bin")
    got = by_bin.applyInArrow(ask_tokens(bits), ASKED).groupBy("shard").applyInArrow(count_tokens, ASKED).withColumn("kind", F.lit(1))
    for n in range(2, order + 1):
        grams = by_bin.cogroup(got.groupBy("bin")).applyInArrow(ask_grams(n, bits), ASKED).groupBy("shard").applyInArrow(counted(n), ASKED)
        got = got.unionByName(grams.withColumn("kind", F.lit(n)))
    return result(rows, got, order, bits, id_col)


TABLE = "shard int, payload binary"


def token_table(rows: pa.Table) -> pa.Table:
    """A partition's tokens with their counts and its sums, as one packed row."""
    parts = [W.unpack(p.as_py()) for p in rows["payload"]]
    distinct, which = np.unique(np.concatenate([np.cumsum(p[0], dtype=W.U64) for p in parts]), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(distinct)).astype(np.int64)
    real = total[distinct != START[0]]
    stats = np.r_[real.sum(), (real > 0).sum(), [(real == r).sum() for r in range(1, GT_MOST + 2)]].astype(np.int64)
    return pa.table({"shard": rows["shard"][:1], "payload": pa.array([W.pack(W.gaps(distinct[total > 0]), total[total > 0], stats)], pa.binary())})


def tokens_found(rows: pa.Table, table: pa.Table) -> pa.Table:
    """Answers to bins from a partition's table."""
    gaps, total, stats = W.unpack(table["payload"][0].as_py()) if table.num_rows else (np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(GT_MOST + 3, np.int64))
    have, back = np.cumsum(gaps, dtype=W.U64), []
    for p in rows["payload"]:
        keys = np.cumsum(W.unpack(p.as_py())[0], dtype=W.U64)
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        back.append(W.pack(np.where(have[at] == keys, total[at], 0) if len(have) else np.zeros(len(keys), np.int64), stats))
    return pa.table({"bin": rows["bin"], "shard": rows["shard"], "payload": pa.array(back, pa.binary())})


def gram_table(rows: pa.Table, order: int) -> pa.Table:
    """A partition's contexts, each with its grams' last tokens and counts and its sums, as one packed row."""
    parts = [W.unpack(p.as_py()) for p in rows["payload"]]
    keys = np.concatenate([np.repeat(np.cumsum(p[0], dtype=W.U64), p[1]) for p in parts])
    seconds, counts, given = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    kept = np.flatnonzero(counts > 0)
    at = kept[np.lexsort((seconds[kept], keys[kept]))]
    k, s = keys[at], seconds[at]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])][: len(k)])
    total = np.add.reduceat(counts[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(given[at], first) if len(first) else given[:0]
    low = Unigrams(parts[0][5]).p(most.astype(np.int64)) if order == 2 else most.view(np.float64)
    contexts, which = np.unique(k[first], return_inverse=True)
    sums, lows = of_heads(which, total, low, len(contexts))
    stats = np.array([(total == r).sum() for r in range(1, GT_MOST + 2)], np.int64)
    packed = W.pack(W.gaps(contexts), np.bincount(which, minlength=len(contexts)).astype(np.uint32), s[first], total, sums.ravel(), shortened(lows), stats)
    return pa.table({"shard": rows["shard"][:1], "payload": pa.array([packed], pa.binary())})


def grams_found(rows: pa.Table, table: pa.Table) -> pa.Table:
    """Answers to bins from a partition's table."""
    none = [np.zeros(0, W.U64), np.zeros(0, np.uint32), np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, W.U64), np.zeros(GT_MOST + 1, np.int64)]
    gaps, n, seconds, total, sums, lows, stats = W.unpack(table["payload"][0].as_py()) if table.num_rows else none
    contexts, sums = np.cumsum(gaps, dtype=W.U64), sums.reshape(GT_MOST + 1, -1)
    have, back = (np.repeat(np.arange(len(contexts), dtype=W.U64), n) << W.U64(SECOND_BITS)) | seconds, []
    for p in rows["payload"]:
        heads, m, asked = (x := W.unpack(p.as_py()))[0].cumsum(dtype=W.U64), x[1], x[2]
        mine = np.minimum(np.searchsorted(contexts, heads), max(len(contexts) - 1, 0))
        known = contexts[mine] == heads if len(contexts) else np.zeros(len(heads), bool)
        got, low, each = np.zeros((GT_MOST + 1, len(heads)), np.int64), np.zeros(len(heads), W.U64), np.zeros(len(asked), np.int64)
        if len(contexts):
            got[:, known], low[known] = sums[:, mine[known]], lows[mine[known]]
            keys = (np.repeat(mine, m).astype(W.U64) << W.U64(SECOND_BITS)) | asked
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            each = np.where(np.repeat(known, m) & (have[at] == keys), total[at], 0)
        back.append(W.pack(each, got.ravel(), low, stats))
    return pa.table({"bin": rows["bin"], "shard": rows["shard"], "payload": pa.array(back, pa.binary())})


def tabled(n: int):
    return token_table if n == 1 else (lambda rows: gram_table(rows, n))


def stepped(rows: DataFrame, path: str, order: int, bits: int, write: bool) -> DataFrame:
    """The answers to all bins, order by order, from the tables in a folder, each of which is written first where asked for."""
    spark, by_bin, got = rows.sparkSession, rows.groupBy("bin"), None
    for n in range(1, order + 1):
        asks = by_bin.applyInArrow(ask_tokens(bits), ASKED) if n == 1 else by_bin.cogroup(got.groupBy("bin")).applyInArrow(ask_grams(n, bits), ASKED)
        if write:
            asks.groupBy("shard").applyInArrow(tabled(n), TABLE).withColumn("bits", F.lit(bits)).write.parquet(f"{path}/order={n}")
        table = spark.read.parquet(f"{path}/order={n}").select("shard", "payload")
        found = asks.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(tokens_found if n == 1 else grams_found, ASKED).withColumn("kind", F.lit(n))
        got = found if got is None else got.unionByName(found)
    return got


def train_tables(docs: DataFrame, train: Column, path: str, order: int = 2, id_col: str = "doc_id", text_col: str = "text", layout: W.Layout | None = None) -> None:
    """Writes a model's tables to a folder that all executors share, path/order=1, 2, ...: a row for each partition of the hashes, its grams by context with counts and with what the backoff weights are made of."""
    lay = layout or W.layout(docs, text_col)
    stepped(by_bins(docs, train, lay.bins, id_col, text_col), path, order, lay.shard_bits, True)


def score_with(docs: DataFrame, path: str, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score()'s columns for any documents, none of them training ones, from the tables of train_tables."""
    bits = docs.sparkSession.read.parquet(f"{path}/order=1").select("bits").first()[0]
    rows = by_bins(docs, F.lit(False), W.layout(docs, text_col).bins, id_col, text_col)
    return result(rows, stepped(rows, path, order, bits, False), order, bits, id_col)
