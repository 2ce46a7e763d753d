"""PII: fixed base kinds, and wider candidates that boosted trees accept or leave.

Generators with high recall propose spans that may overlap: within each run of digit groups every
span of consecutive ones with 7 to 15 digits, account numbers, addresses with the sign spelt out.
Trees over their format, the words before them and the digits beside them give each a log-odds, a
threshold that was calibrated on held-out labelled samples accepts it, and of overlapping ones the
likeliest stays.  Base spans always stay; added ones overlap none.
The labelled samples are generated, ``samples`` of them, with fixed seeds.

Edge cases: a null text is empty and has no spans; spans are code points, the end exclusive; ties in
the odds go to the earlier and then the longer span; repeated rows give equal results; the time is linear
in a text's length, long runs of one character included.  Only the id and the text are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The base kinds and, after them, those that the method adds.
KINDS = ["email", "ip", "card", "phone", "contact", "number", "identity", "account"]
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Generators: digit groups and what joins two of them, account numbers, spelt-out addresses.
GROUP = re.compile(r"[0-9]+")
JOINT = re.compile(r"[()./\x20-]{1,2}")
LEAST_DIGITS, MOST_DIGITS = 7, 15
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{2,63}){1,4}")
# Words before a candidate that speak for or against it.
CUES = [
    ("phone", "tel", "call", "mobile", "cell", "fax", "contact"),
    ("ssn", "social", "identity", "passport", "tax", "license"),
    ("iban", "account", "bank", "card", "payment"),
    ("mail", "write", "reach"),
    ("order", "invoice", "version", "isbn", "date", "ref", "page", "id", "build", "ticket", "no", "total", "price", "table", "on", "in"),
]
BEFORE = re.compile(r"[A-Za-z]+")
# The neighbours of a candidate: their digits, and what parts them from it.
LEFT = re.compile(r"(?P<digits>[0-9]+)(?P<joint>[()./\x20-]{0,2})\Z")
RIGHT = re.compile(r"(?P<joint>[()./\x20-]{0,2})(?P<digits>[0-9]+)")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # the run of local characters before each sign, then a host after it
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((0, start, done))
        elif start < at:
            done = max(done, at)  # what stands before a failed sign can't begin a later match: the sign is no local character
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every span of consecutive digit groups with LEAST_DIGITS to MOST_DIGITS digits; no letter touches a span.

    A bracket before the first group belongs to a span that also holds its end.  A group has a digit at
    least, so each start has MOST_DIGITS ends at most, in a run of any length.
    """
    groups = [m.span() for m in GROUP.finditer(text)]
    for k, (a, b) in enumerate(groups):
        if letter(text, a - 1):
            continue
        digits, n = b - a, k
        bracket = a > 0 and text[a - 1] == "(" and not (letter(text, a - 2) or (a > 1 and "0" <= text[a - 2] <= "9"))
        while digits <= MOST_DIGITS:
            end = groups[n][1]
            if digits >= LEAST_DIGITS and not letter(text, end):
                yield a - (bracket and ")" in text[a:end]), end, digits
            n += 1
            if n == len(groups) or groups[n][0] - end > 2 or not JOINT.fullmatch(text, end, groups[n][0]):
                break
            digits += groups[n][1] - groups[n][0]


def letter(text: str, at: int) -> bool:
    """Whether an ASCII letter stands at a place; none stands outside the text."""
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalpha()


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the generators propose."""
    out = []
    for start, end, digits in numbers(text):
        out.append((5, start, end))
        if digits == 9:
            out.append((6, start, end))
    out += [(7, m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    low = "(at)" in text or "[at]" in text
    return out + [(4, m.start(), m.end()) for m in SPELT.finditer(text)] if low else out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    digits = [c for c in s if "0" <= c <= "9"]
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    before = [w.lower() for w in BEFORE.findall(text[max(0, start - 32) : start])][-3:]
    after = text[end : end + 1]
    out = [kind, len(s), len(digits), len(groups), groups[0], groups[-1], max(groups), s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count("("), len(set(digits))]
    out += [float(bool(re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}", s))), float(bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s)))]
    out += [float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.]", s)) or bool(re.search(r"[-/.](?:19|20)[0-9]{2}\Z", s))), float(check_digits(s)), float(after in ("%", "€", "$"))]
    # The digit groups that a joint ties to its ends: how many digits, and whether a blank parts them.
    left, right = LEFT.search(text, max(0, start - 16), start), RIGHT.match(text, end, end + 16)
    for m in (left, right):
        out += [float(len(m["digits"])), float(" " in m["joint"])] if m else [0.0, 0.0]
    return out + [float(any(w in cue for w in before)) for cue in CUES]


def check_digits(s: str) -> bool:
    """Whether an account number's check digits hold."""
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Boosted:
    """Gradient-boosted trees of a fixed depth for log-odds; splits are at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.3):
        self.trees, self.rate = [], rate
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 24), method="lower")) for c in x.T]
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self.grown(x, y - p, p * (1 - p), cuts, np.arange(len(y)), depth)
            self.trees.append(tree)
            f += rate * self.leaf(tree, x)

    def grown(self, x, g, h, cuts, at, depth):
        value = g[at].sum() / (h[at].sum() + 1.0)
        best = (1e-6, None, None)
        if depth:
            whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
            for k, some in enumerate(cuts):
                left = x[at, k][:, None] <= some[None, :]
                gl, hl = g[at] @ left, h[at] @ left
                gain = gl**2 / (hl + 1.0) + (g[at].sum() - gl) ** 2 / (h[at].sum() - hl + 1.0) - whole
                if len(some) and gain.max() > best[0]:
                    best = (gain.max(), k, some[gain.argmax()])
        if best[1] is None:
            return value
        left = x[at, best[1]] <= best[2]
        return best[1], best[2], self.grown(x, g, h, cuts, at[left], depth - 1), self.grown(x, g, h, cuts, at[~left], depth - 1)

    def leaf(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self.leaf(tree[2], x[left]), self.leaf(tree[3], x[~left])
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self.leaf(t, x) for t in self.trees)


def labelled(samples: int, seed: int = 5) -> Iterator[tuple[str, tuple[int, int, int], bool]]:
    """(text, candidate, personal): generated texts with one item each, many of them with more numbers beside it."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "the", "ion", "de", "la", "st", "ou")) for _ in range(r.randint(1, 3)))

    def account() -> str:
        body, land = d(18), r.choice(("DE", "FR", "ES", "GB"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if r.random() < 0.5 else s

    good = [
        (5, 0, lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"))),
        (5, 0, lambda: r.choice((f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(6)}"))),
        (6, 1, lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        (7, 2, account),
        (4, 3, lambda: f"{word()}.{word()} {r.choice('([')}at{r.choice(')]')} {word()}.com"),
        (4, 3, lambda: f"{word()}{d(2)} (at) {word()} (dot) org"),
    ]
    bad = [
        lambda: f"{r.choice((19, 20))}{d(2)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}.{d(2)}.{r.choice((19, 20))}{d(2)}",
        lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(4)}",
        lambda: d(r.randint(7, 15)),
        lambda: f"{d(4)} {d(4)} {d(4)}",
        lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}",
        lambda: f"{d(3)}.{d(6)}",
        lambda: f"{d(5)}-{d(4)}",
        lambda: f"{r.choice(('DE', 'AB', 'XK'))}{d(2)}{d(14)}",
        lambda: f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)}",
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: " ".join(str(r.randint(0, 10 ** r.randint(1, 4))) for _ in range(r.randint(3, 12))),
        lambda: " ".join(f"{r.choice((19, 20))}{d(2)}" for _ in range(r.randint(2, 5))),
    ]

    def beside() -> tuple[str, int | None]:
        """What stands next to an item, and its kind if that is personal too."""
        if r.random() < 0.4:
            kind, _, make = r.choice(good[:3])
            return make(), kind
        return r.choice((f"{r.choice((19, 20))}{d(2)}", d(r.randint(1, 3)))), None

    for _ in range(samples):
        if r.random() < 0.5:
            kind, cue, make = r.choice(good)
            item, lead = make(), r.choice(CUES[cue]) if r.random() < 0.8 else word()
        else:
            kind, item, lead = None, r.choice(bad)(), r.choice(CUES[4]) if r.random() < 0.5 else word()
        parts = [(item, kind)]
        if kind in (5, 6):
            if r.random() < 0.3:
                parts = [beside(), *parts]
                lead = r.choice(CUES[4]) if r.random() < 0.3 else lead  # said of the neighbour
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                parts.append(beside())
        text, places = f"{word()} {word()} {lead}{r.choice((' ', ': ', ' '))}", []
        for k, (part, kind) in enumerate(parts):
            text += r.choice((" ", " ", ". ", "/")) if k and len(parts) > 1 else ""
            places.append((kind, len(text), len(text) + len(part)))
            text += part
        text += f" {word()}."
        for c in candidates(text):
            if c[1] < places[-1][2] and places[0][1] < c[2]:
                yield text, c, c in places


def fit(samples: int = 4000, precision: float = 0.995) -> tuple[Boosted, dict[int, float]]:
    """Trees from three quarters of the labelled samples, and for each kind the lowest log-odds that keeps the precision on the rest."""
    rows = list(labelled(samples))
    x = np.array([features(t, *c) for t, c, _ in rows], float)
    y = np.array([p for *_, p in rows], float)
    held = np.arange(len(y)) % 4 == 0
    trees = Boosted(x[~held], y[~held])
    odds, limits = trees.odds(x[held]), {}
    for kind in range(4, len(KINDS)):
        mine = x[held, 0] == kind
        o, t = odds[mine], y[held][mine]
        order = np.argsort(-o)
        exact = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(exact >= precision)
        limits[kind] = max(0.0, float(o[order][good[-1]])) if len(good) else float("inf")
    return trees, limits


def spans(text: str, model: tuple[Boosted, dict[int, float]]) -> list[tuple[int, int, int]]:
    """All spans of a text: the base ones by kind and start, then the added ones likewise."""
    fixed = base(text)
    proposed = candidates(text)
    if not proposed:
        return fixed
    taken = bytearray(len(text))  # a mark on each place, so that a look costs a span's length and not the number of spans
    for _, a, b in fixed:
        taken[a:b] = b"\1" * (b - a)
    open_ = [c for c in proposed if taken.find(1, c[1], c[2]) < 0]
    if not open_:
        return fixed
    trees, limits = model
    odds = np.concatenate([trees.odds(np.array([features(text, *c) for c in open_[k : k + 4096]], float)) for k in range(0, len(open_), 4096)])
    added: list[tuple[int, int, int]] = []
    for o, c in sorted(zip(odds.tolist(), open_, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if o >= limits[c[0]] and taken.find(1, c[1], c[2]) < 0:
            added.append(c)
            taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
    return fixed + sorted(added)


def find(docs: DataFrame, model: tuple[Boosted, dict[int, float]], id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row: the id and spans, an array of (kind, start, end), kind being a place in KINDS; with redact, also the text with every span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = [spans(t or "", model) for t in texts]
                columns = [part.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f] for f in found], kind)]
                if redact:
                    columns.append(pa.array([masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "spans", "redacted"][: len(columns)])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    result = f"id {slim.schema['id'].dataType.simpleString()}, spans array<struct<kind:int,start:int,end:int>>" + ", redacted string" * redact
    return slim.mapInArrow(run, result).withColumnRenamed("id", id_col)


def masked(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
