"""Vector bin packing of examples into sequences by the dot-product heuristic.

Demands are tokens, segments and loss-bearing tokens. A task keeps a window of examples; a sequence
takes the example with the largest dot product of demand and room left that still fits, and when
none fits, the first part of the longest one. What cannot be filled to the full length is cut into
sequences whose lengths are powers of two, which need no padding. Each task packs what it reads, so
no row moves, and memory is the window's.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.tokens import encoder, trim

WINDOW = 512
TASK_SHIFT = 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    """Part of an example: its ids from ``start`` on; ``bearing`` marks ids that bear loss, or all if None."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    bearing: np.ndarray | None
    doc_tokens: int

    @property
    def loss(self) -> int:
        return len(self.ids) if self.bearing is None else int(self.bearing.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        bear = (None, None) if self.bearing is None else (self.bearing[:n], self.bearing[n:])
        return (Piece(self.doc_id, self.start, self.ids[:n], bear[0], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[n:], bear[1], self.doc_tokens))


class Packer:
    """Packs a stream of examples; ``add`` and ``close`` return finished sequences."""

    def __init__(self, limits: Limits, window: int = WINDOW):
        self.limits, self.window, self.pool = limits, window, []

    def add(self, piece: Piece) -> list[list[Piece]]:
        done = []
        full = self.limits.tokens
        while len(piece.ids) >= full and piece.bearing is None and full <= self.limits.loss:
            part, piece = piece.cut(full)
            done.append([part])
        if len(piece.ids):
            self.pool.append(piece)
        if len(self.pool) >= self.window:
            done += self._fill(self.window // 2)
        return done

    def close(self) -> list[list[Piece]]:
        return self._fill(0)

    def _fill(self, keep: int) -> list[list[Piece]]:
        """Fill sequences until at most ``keep`` pieces wait."""
        cap, pool, done = self.limits, self.pool, []
        sizes, losses = np.array([len(p.ids) for p in pool]), np.array([p.loss for p in pool])
        free = np.ones(len(pool), bool)
        most = np.array([cap.tokens, cap.segments, cap.loss], float)
        while free.sum() > keep:
            room = most.copy()
            taken: list[Piece] = []
            while room[1] >= 1 and room[0] >= 1 and free.any():
                fits = free & (sizes <= room[0]) & (losses <= room[2])
                if fits.any():
                    value = sizes * (room[0] / most[0] ** 2) + room[1] / most[1] ** 2 + losses * (room[2] / most[2] ** 2)
                    at = int(np.where(fits, value, -1.0).argmax())
                    piece = pool[at]
                    free[at] = False
                else:
                    at = int(np.where(free, sizes, -1).argmax())
                    n = min(int(room[0]), int(sizes[at]))
                    bears = pool[at].bearing
                    able = int(room[2]) if bears is None else int(np.searchsorted(np.cumsum(bears), int(room[2]), side="right"))
                    if (n := min(n, able)) < 1:
                        break
                    piece, pool[at] = pool[at].cut(n)
                    sizes[at], losses[at] = len(pool[at].ids), pool[at].loss
                    free[at] = sizes[at] > 0
                taken.append(piece)
                room -= (len(piece.ids), 1, piece.loss)
            done += self._whole(taken)
        self.pool = [p for p, f in zip(pool, free) if f]
        return done

    def _whole(self, pieces: list[Piece]) -> list[list[Piece]]:
        """The pieces as one full sequence, or as sequences of falling powers of two."""
        left = sum(len(p.ids) for p in pieces)
        if left == self.limits.tokens:
            return [pieces]
        out, todo = [], pieces[::-1]
        while left:
            room = size = 1 << (left.bit_length() - 1)
            left -= size
            out.append([])
            while room:
                piece = todo.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    todo.append(rest)
                out[-1].append(piece)
                room -= len(piece.ids)
        return out


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), end_id: int = 1, prompt_chars: str | None = None) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text), whose ids end with ``end_id``.

    Columns: doc_id, start and length of the piece in its document, ids_crc32 of its ids, doc_tokens,
    sequence_id, offset in the sequence, loss_tokens. ``prompt_chars`` names a column with the number
    of leading characters that bear no loss (null: none); without it all ids bear loss. A null or
    empty text is its end id alone. Rows that repeat a doc_id are packed as rows of their own. Other
    columns are ignored.
    """
    def packed(batches):
        trim()
        task, count = TaskContext.get().partitionId() << TASK_SHIFT, 0
        own, packer = encoder(vocabulary), Packer(limits)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

        def rows(sequences):
            nonlocal count
            out = []
            for pieces in sequences:
                at = 0
                for p in pieces:
                    out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, task + count, at, p.loss))
                    at += len(p.ids)
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)], names)

        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            done = []
            prompts = batch.column("prompt").to_pylist()
            for doc_id, text, prompt in zip(batch.column("doc_id").to_pylist(), batch.column("text"), prompts):
                text = text.as_py()
                ids = np.append(own.ids(text), np.array([end_id], "<u4"))
                bearing = None
                if prompt:
                    bearing = np.ones(len(ids), bool)
                    bearing[:len(own.ids((text or "")[:prompt]))] = False
                done += packer.add(Piece(doc_id, 0, ids, bearing, len(ids)))
            yield rows(done)
        yield rows(packer.close())

    prompt = F.col(prompt_chars).cast("int") if prompt_chars else F.lit(None).cast("int")
    return docs.select("doc_id", "text", prompt.alias("prompt")).mapInArrow(
        packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
