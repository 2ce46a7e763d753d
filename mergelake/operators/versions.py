"""Versions of a text: line diffs, patches, and three-way merges.

Both rest on a longest common subsequence of lines, found exactly.  Lines at either end that agree and lines that the other side has not are set aside;
for the rest a row of the dynamic program is one whole number with a bit for each line of the other side, so a step is a few operations on it.  Only every
square-root-th row is kept, and the rows between are made again on the way back: a pair of texts takes lines times lines / 64 steps and the square root of that in memory.

Edge cases: a null text is an empty one; lines end at line feeds alone, so a carriage return belongs to its line; a text without a line feed at its end
differs from one with it, and a diff says so; equal texts have an empty diff and merge to themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many places of a line are worth keeping as one number.
OFTEN = 64
NO_END = "\\ No newline at end of file"
HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: What surrounds a conflict in a merged text.
MARKERS = ("<<<<<<< ours", "||||||| base", "=======", ">>>>>>> theirs")
MERGED = "text string, n_conflicts int, n_taken int, hunks array<struct<start_line:int,end_line:int,ours:array<string>,theirs:array<string>,base:array<string>>>"
LINES = pa.list_(pa.string())
ARROW_MERGED = pa.struct({"text": pa.string(), "n_conflicts": pa.int32(), "n_taken": pa.int32(), "hunks": pa.list_(pa.struct({"start_line": pa.int32(), "end_line": pa.int32(), "ours": LINES, "theirs": LINES, "base": LINES}))})
#: Bytes of a batch that are Python objects at a time, a row at least.
PART_BYTES = 1 << 20


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """The places, in both, of a longest common subsequence."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    in_a, in_b = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    at_a = [i for i in range(head, len(a) - tail) if a[i] in in_b]
    at_b = [j for j in range(head, len(b) - tail) if b[j] in in_a]
    middle = [(at_a[i], at_b[j]) for i, j in _subsequence([a[i] for i in at_a], [b[j] for j in at_b])]
    ends = range(1, tail + 1)
    return [(k, k) for k in range(head)] + middle + [(len(a) - k, len(b) - k) for k in reversed(ends)]


def _subsequence(x: list[Hashable], y: list[Hashable]) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    places: dict[Hashable, list[int]] = {}
    for j, line in enumerate(y):
        places.setdefault(line, []).append(j)
    held: dict[Hashable, int] = {}

    def mask(line: Hashable) -> int:
        if line in held:
            return held[line]
        bits = 0
        for j in places[line]:
            bits |= 1 << j
        if len(places[line]) > OFTEN:
            held[line] = bits
        return bits

    every, width = (1 << len(y)) - 1, (len(y) + 7) // 8

    def step(row: int, line: Hashable) -> int:
        # A bit is 0 where one more line of y makes the subsequence longer.
        both = row & mask(line)
        return ((row + both) | (row - both)) & every

    stride = math.isqrt(len(x)) + 1
    kept, row = [every], every
    for i, line in enumerate(x):
        row = step(row, line)
        if (i + 1) % stride == 0:
            kept.append(row)
    out, i, j = [], len(x), len(y)
    for block in range(len(x) // stride, -1, -1):
        first, row = block * stride, kept[block]
        rows = [row.to_bytes(width, "little")]
        for line in x[first:i]:
            row = step(row, line)
            rows.append(row.to_bytes(width, "little"))
        bit = lambda i, j: rows[i - first][j >> 3] >> (j & 7) & 1  # noqa: B023, E731
        while j and i > first:
            if bit(i, j - 1):
                j -= 1
            else:
                i -= 1
                if bit(i, j - 1):  # longer with this line of x alone: it is matched
                    j -= 1
                    out.append((i, j))
        i = min(i, first)
    return out[::-1]


def changes(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to): the stretches of both sides between what they have in common."""
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def ended(text: str) -> list[str]:
    """A text's lines, each with its line feed; the last one may have none."""
    return [x + "\n" for x in text.split("\n")[:-1]] + ([last] if (last := text.rsplit("\n", 1)[-1]) else [])


def unified(path: str, old: str, new: str, context: int = 3) -> str:
    """The unified diff of a file, empty if nothing changed."""
    a, b = ended(old), ended(new)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    if not groups:
        return ""
    out = [f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}"]

    def add(sign: str, lines: list[str]) -> None:
        for x in lines:
            out.extend([sign + x[:-1]] if x.endswith("\n") else [sign + x, NO_END])

    for g in groups:
        i0, i1, j0, j1 = max(0, g[0][0] - context), min(len(a), g[-1][1] + context), max(0, g[0][2] - context), min(len(b), g[-1][3] + context)
        part = lambda first, n: f"{first + 1 if n else first}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{part(i0, i1 - i0)} +{part(j0, j1 - j0)} @@")
        at = i0
        for x0, x1, y0, y1 in g:
            add(" ", a[at:x0])
            add("-", a[x0:x1])
            add("+", b[y0:y1])
            at = x1
        add(" ", a[at:i1])
    return "\n".join(out) + "\n"


def patched(old: str, diff: str) -> str | None:
    """A text with a unified diff of one file applied; null if the diff is not of this text."""
    a, out, at = ended(old), [], 0
    body = diff.split("\n")
    k = 0
    while k < len(body):
        head = HEAD.match(body[k])
        k += 1
        if not head:
            continue
        first, n_old, n_new = int(head[1]), int(head[2] or 1), int(head[4] or 1)
        first -= n_old > 0  # without old lines the number is that of the line before
        if first < at or first + n_old > len(a):
            return None
        out += a[at:first]
        at = first
        while n_old or n_new:
            if k >= len(body):
                return None
            sign, line = body[k][:1], body[k][1:] + "\n"
            k += 1
            if k < len(body) and body[k].startswith("\\"):
                line, k = line[:-1], k + 1
            if sign in (" ", "-"):
                if at >= len(a) or a[at] != line:
                    return None
                at, n_old = at + 1, n_old - 1
            if sign in (" ", "+"):
                out.append(line)
                n_new -= 1
            if sign not in (" ", "-", "+"):
                return None
    return "".join(out + a[at:])


def aligned(base: list[str], ours: list[str], theirs: list[str]) -> list[tuple[list[str], list[str], list[str], bool]]:
    """(base, ours, theirs, stable) chunks in order: stable ones are lines that all three have, between them stands what changed."""
    here, there = dict(common(base, ours)), dict(common(base, theirs))
    out, i, x, y = [], 0, 0, 0
    stable = [k for k in range(len(base)) if k in here and k in there]
    for k in [*stable, None]:
        k, u, v = (len(base), len(ours), len(theirs)) if k is None else (k, here[k], there[k])
        if k > i or u > x or v > y:
            out.append((base[i:k], ours[x:u], theirs[y:v], False))
        if k < len(base):
            if out and out[-1][3]:
                out[-1][0].append(base[k])
            else:
                out.append(([base[k]],) * 3 + (True,))
        i, x, y = k + 1, u + 1, v + 1
    return out


def merged(base: str, ours: str, theirs: str) -> dict:
    """The merged text, with markers where both sides changed the same lines in different ways, and its conflicts."""
    lines, hunks, taken = [], [], 0
    for b, o, t, stable in aligned(*(x.split("\n") for x in (base, ours, theirs))):
        if stable or o == t or t == b:
            lines += o
        elif o == b:
            lines += t
        else:
            first = len(lines) + 1
            lines += [MARKERS[0], *o, *([MARKERS[1], *b] if b else []), MARKERS[2], *t, MARKERS[3]]
            hunks.append({"start_line": first, "end_line": len(lines), "ours": o, "theirs": t, "base": b})
            continue
        taken += not stable
    return {"text": "\n".join(lines), "n_conflicts": len(hunks), "n_taken": taken, "hunks": hunks}


def by_parts(f: Callable, kind: pa.DataType) -> Callable:
    """A function of a row's values as one of Arrow columns.  Only a part of a batch is held as Python objects, so that a worker's memory does not follow what a batch's texts and results take there."""

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        step = max(1, n * PART_BYTES // max(1, sum(c.nbytes for c in columns)))
        parts = [pa.array([f(*row) for row in zip(*(c.slice(at, step).to_pylist() for c in columns), strict=True)], kind) for at in range(0, n, step)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def diff(path: Column | str, old: Column | str, new: Column | str, context: int = 3) -> Column:
    """The unified diff of two versions of a file."""
    one = by_parts(lambda p, a, b: unified(p, a or "", b or "", context), pa.string())
    return F.arrow_udf(one, "string")(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")), old, new)


def patch(old: Column | str, diff_: Column | str) -> Column:
    """A version with a diff applied; null where the diff is of another text."""
    return F.arrow_udf(by_parts(lambda a, d: patched(a or "", d or ""), pa.string()), "string")(old, diff_)


def merge(base: Column | str, ours: Column | str, theirs: Column | str) -> Column:
    """Two versions and what both came from, as (text, n_conflicts, n_taken, hunks): the merge, its conflicts, and how many changes were taken without one."""
    return F.arrow_udf(by_parts(lambda b, o, t: merged(b or "", o or "", t or ""), ARROW_MERGED), MERGED)(base, ours, theirs)


def merge_files(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, merged) of three versions of a tree, each (path, content): a file that one side lacks is empty there, and one that both lack is not there."""
    name = lambda df, to: df.select("path", F.col("content").alias(to))
    both = name(ours, "ours").join(name(theirs, "theirs"), "path", "full").join(name(base, "base"), "path", "left")
    return both.select("path", merge("base", "ours", "theirs").alias("merged"))
