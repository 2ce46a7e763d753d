"""The resolver interface: batches of hunks to an outside model and back, over Arrow."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: From a prompt and the turn to (resolved lines, confidence).
Resolver = Callable[[str, list[str], list[str], int], tuple[list[str], float]]
ANSWER = pa.schema({"hunk_id": pa.string(), "resolved_lines": pa.list_(pa.string()), "confidence": pa.float64(), "turns": pa.int32(), "error": pa.string()})
#: Bytes of a batch that are Python objects at a time, a hunk at least.
PART_BYTES = 1 << 20


def mock(hunk_id: str, ours: list[str], theirs: list[str], turn: int) -> tuple[list[str], float]:
    """A pure stand-in: one side, by the id's hash, with a confidence that grows from turn to turn."""
    h = hashlib.md5(hunk_id.encode()).digest()
    return (ours if h[0] % 2 else theirs), min(1.0, h[1] / 255 + 0.2 * turn)


def flaky(hunk_id: str, ours: list[str], theirs: list[str], turn: int) -> tuple[list[str], float]:
    """The stand-in, but one id in sixteen always fails, and another one fails when asked again."""
    k = hashlib.md5(hunk_id.encode()).digest()[2] % 16
    if k == 0 or (k == 1 and turn):
        raise RuntimeError("the model is away")
    return mock(hunk_id, ours, theirs, turn)


def resolve(hunks: DataFrame, resolver: Resolver = mock, turns: int = 3, refine_below: float = 0.6, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """(hunk_id, ours, theirs) to (hunk_id, resolved_lines, confidence, turns, error): up to so many turns while the confidence is low and each one improves it; failed calls are retried with growing waits."""

    def call(row, turn):
        for attempt in range(retries + 1):
            try:
                return resolver(row["hunk_id"], list(row["ours"]), list(row["theirs"]), turn), ""
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if attempt < retries:
                    time.sleep(min(30.0, wait * 2**attempt))
        return None, error

    def answer(row):
        best, error = call(row, 0)
        used = 1
        while best is not None and best[1] < refine_below and used < turns:
            again, _ = call(row, used)
            used += 1
            if again is None or again[1] <= best[1]:
                break
            best = again
        return {"hunk_id": row["hunk_id"], "resolved_lines": best[0] if best else [], "confidence": best[1] if best else 0.0, "turns": used, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_pylist([answer(row) for row in batch.slice(at, step).to_pylist()], ANSWER)

    return hunks.select("hunk_id", "ours", "theirs").mapInArrow(run, "hunk_id string, resolved_lines array<string>, confidence double, turns int, error string")
