"""SentencePiece BPE encoding and decoding.

Exact merge-type encoding without a merge queue: an Aho-Corasick automaton
gives the longest piece at each position, a piece may follow another only if
merging their joined characters again gives back just these two, and a
position from which no such sequence reaches the end is marked in a bitfield
and never tried again.

Edge cases: a null or empty text encodes to the begin and end ids alone and
decodes to the empty text; a character that no piece holds becomes its UTF-8
byte pieces; rows are independent, so ties and repeated rows need no rule.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .words import parts

SPACE = "▁"
#: A text can be cut where no piece of the model has the two characters side by side, without touching a possible
#: merge: before a run of spaces, around a line end, and between letters and other characters.  Models are checked for it.
CHUNK = r" *(?:[^\W\d_{0}]+|(?:[\d_{0}]|[^\w \n])+)|\n| +"
#: Longer chunks are encoded anew each time; a full memo becomes the old one, whose entries come back as they are used: memory stays bounded.
MEMO_CHARS, MEMO_CHUNKS, MEMO_PAIRS, SLICE_BYTES = 32, 250_000, 150_000, 512 << 10


class PieceCoder:
    """Encodes and decodes texts with the pieces of one model; inside, a space stands for the space mark."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.bos, self.eos = p.bos_id(), p.eos_id()
        text = [p.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        self.id = {text[i]: i for i in plain}
        self.rank = {text[i]: p.get_score(i) for i in plain}
        self.cut = re.compile(CHUNK.format("".join(sorted({c for s in self.rank for c in s if c.isalnum() and not c.isalpha() and not c.isdecimal()})))).findall
        for s in self.rank:
            if self.cut(s) != [s]:
                raise ValueError(f"the piece {s!r} crosses a cut")
        # A byte above 127 decodes to a lone surrogate first, so that runs of them can be read as UTF-8 together.
        for b, i in self.byte_id.items():
            text[i] = bytes([b]).decode("utf-8", "surrogateescape")
        text[self.bos] = text[self.eos] = ""
        self.text = np.array(text, dtype=object)
        self.auto = ahocorasick.Automaton()
        for s in self.rank:
            self.auto.add_word(s, (len(s) - 1, s))
        self.auto.make_automaton()
        self.shorter = {s: next((s[:k] for k in range(len(s) - 1, 0, -1) if s[:k] in self.rank), None) for s in self.rank}
        self.forget()

    def forget(self) -> None:
        """Drops the memos: a worker that waits for its next task holds the model alone."""
        self.chunks, self.old_chunks = {}, {}
        self.pairs, self.old_pairs = {}, {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging: the best-ranked neighbours first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        joined = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while any(r is not None for r in joined):
            best = max(r for r in joined if r is not None)
            k = joined.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joined[k]
            if k < len(joined):
                joined[k] = rank.get(parts[k] + parts[k + 1])
            if k:
                joined[k - 1] = rank.get(parts[k - 1] + parts[k])
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether right can follow left."""
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.old_pairs, self.pairs = self.pairs, {}
            known = self.old_pairs.get(pair)
            known = self.pairs[pair] = self.merged(left + right) == [left, right] if known is None else known
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a chunk; a character that no piece begins with stands alone."""
        longest: dict[int, str] = {}  # the last match that starts at a position is the longest
        for end, (size, s) in self.auto.iter(text):
            longest[end - size] = s
        n, pos, out = len(text), 0, []
        failed = bytearray((n >> 3) + 1)
        s: str | None = longest.get(0) or text[:1]
        while pos < n:
            while s is not None and (failed[(e := pos + len(s)) >> 3] >> (e & 7) & 1 or out and not self.fits(out[-1], s)):
                s = self.shorter.get(s)
            if s is not None:
                out.append(s)
                pos += len(s)
                s = longest.get(pos) or text[pos : pos + 1]
                continue
            failed[pos >> 3] |= 1 << (pos & 7)
            if not out:
                raise ValueError("no sequence of pieces")
            s = out.pop()
            pos -= len(s)
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        ids: list[int] = []
        for s in self.pieces(chunk):
            i = self.id.get(s)
            ids += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text between the begin and end ids."""
        ids, memo = [np.array([self.bos], "<u4").tobytes()], self.chunks
        for chunk in self.cut(" " + text.replace(SPACE, " ")) if text else ():
            got = memo.get(chunk)
            if got is None:
                got = self.old_chunks.get(chunk) or self.encode_chunk(chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(memo) >= MEMO_CHUNKS:
                        self.old_chunks, memo = memo, {}
                        self.chunks = memo
                    memo[chunk] = got
            ids.append(got)
        ids.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8, and the space before the first word goes."""
        text = "".join(self.text[np.frombuffer(ids, "<u4")].tolist())
        if text[:1] == " ":
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text


@lru_cache(2)
def coder(model: bytes) -> PieceCoder:
    """One coder for each Python worker, for all its tasks; Spark deals tasks to all workers that are there, so memos last for one task."""
    return PieceCoder(model)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_tokens, ids (binary, little-endian 32-bit) and decoded, the text the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        try:
            for batch in batches:
                for part in parts(batch, 1, SLICE_BYTES):
                    ids = [own.encode(t) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.string())],
                        ["id", "n_tokens", "ids", "decoded"],
                    )
        finally:
            own.forget()

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
