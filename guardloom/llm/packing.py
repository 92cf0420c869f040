"""Harmonic packing of documents into sequences of a fixed capacity.

A document of n tokens is of class k = capacity // n: its length is more than capacity /
(k + 1) and at most capacity / k, so a sequence of class k takes exactly k of them, whole.
Longer documents are cut at multiples of the capacity; what is left of them is of a class
like any other.  What a class's sequence leaves open is filled with the document that comes
next, cut where the sequence ends; its rest fills the sequences that close after it.  So
there is no padding, and few documents are cut more than once.

At its end a worker lays what its classes still hold end to end, cuts that into whole
sequences, and the last rest into sequences by the binary digits of its length: powers of
two, which need no padding either.

Workers pack on their own, in the task that reads the texts: no shuffle, and no state but
the open sequence of each class, of which there are about 2 * sqrt(capacity) at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import lean
from guardloom.llm.wordpiece import WordIds, encode, slices

CAPACITY = 4096
CLOSING_ID = 2
#: Bits of a sequence id below the worker's number.
WORKER_SHIFT = 40

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: doc_id, start, length, doc_tokens and the ids' bytes of a piece.
Piece = tuple[int | None, int, int, int, bytes]


def split(piece: Piece, length: int) -> tuple[Piece, Piece]:
    """The first ``length`` ids of a piece, and the rest."""
    doc, start, size, tokens, raw = piece
    return (doc, start, length, tokens, raw[: 4 * length]), (doc, start + length, size - length, tokens, raw[4 * length :])


class Packer:
    """The open sequences of one worker; ``out`` gets (piece, sequence_id, offset)."""

    def __init__(self, worker: int, out: list, capacity: int = CAPACITY):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.sequence, self.out = capacity, worker << WORKER_SHIFT, out
        self.open: dict[int, list[Piece]] = {}
        self.filling: list[Piece] = []  # a sequence that waits for ``gap`` tokens
        self.gap = 0
        self.rest: Piece | None = None  # of the document that fills gaps

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.out.append((p, self.sequence, at))
            at += p[2]
        self.sequence += 1

    def fill(self, piece: Piece) -> None:
        """Puts a piece into the gap; what it leaves over fills the next ones."""
        if piece[2] > self.gap:
            piece, self.rest = split(piece, self.gap)
        self.filling.append(piece)
        self.gap -= piece[2]
        if not self.gap:
            self.emit(self.filling)
            self.filling = []

    def add(self, piece: Piece) -> None:
        """A document, or what is left of one, of ``capacity`` tokens at most."""
        if self.gap:
            self.fill(piece)
            return
        count = self.capacity // piece[2]
        held = self.open.setdefault(count, [])
        held.append(piece)
        if len(held) == count:
            del self.open[count]
            self.gap = self.capacity - sum(p[2] for p in held)
            if not self.gap:
                self.emit(held)
                return
            self.filling = held
            if self.rest is not None:
                rest, self.rest = self.rest, None
                self.fill(rest)

    def close(self) -> None:
        held = self.filling + ([self.rest] if self.rest is not None else [])
        for pieces in self.open.values():
            held += pieces
        self.filling, self.gap, self.rest, self.open = [], 0, None, {}
        left = sum(p[2] for p in held)
        room, now = self._room(left), []
        for p in held:
            while p[2] >= room > 0:
                first, p = split(p, room)
                self.emit([*now, first])
                left -= sum(x[2] for x in now) + room
                room, now = self._room(left), []
            if p[2]:
                now.append(p)
                room -= p[2]

    def _room(self, left: int) -> int:
        """Of ``left`` tokens, how many the next closing sequence takes."""
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def _pack_batches(path: str, capacity: int, closing_id: int, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[Piece, int, int]] = []
        words, packer = WordIds(path), Packer(TaskContext.get().partitionId(), rows, capacity)

        def batch() -> pa.RecordBatch:
            long = lambda values: pa.array(values, pa.int64())
            pieces = [x[0] for x in rows]
            arrays = [
                *(long([p[i] for p in pieces]) for i in range(3)),
                long([zlib.crc32(p[4]) for p in pieces]),
                long([p[3] for p in pieces]),
                long([x[1] for x in rows]),
                long([x[2] for x in rows]),
                pa.array([p[4] if with_ids else None for p in pieces], pa.binary()),
            ]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

        for whole in batches:
            for first, end in slices(whole.column("text")):
                part = whole.slice(first, end - first)
                ids, ends = encode(part.column("text"), words, closing_id)
                doc_ids = part.column("doc_id").to_pylist()
                tokens = np.diff(ends, prepend=0)
                begins = (ends - tokens).tolist()
                view = memoryview(ids).cast("B")
                for doc_id, begin, n in zip(doc_ids, begins, tokens.tolist()):
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        piece = (doc_id, start, size, n, bytes(view[4 * (begin + start) : 4 * (begin + start + size)]))
                        if size == capacity:
                            packer.emit([piece])
                        else:
                            packer.add(piece)
                yield batch()
        packer.close()
        yield batch()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``docs`` needs doc_id and text; other columns are ignored.  ``ids`` are little-endian
    unsigned 32-bit ids (null without ``with_ids``).  A null or empty text is the closing
    id alone; a null doc_id stays null; repeated rows are packed as often as they occur; a
    text of any length is tokenized whole.  An empty table gives no rows.  ``capacity`` must
    be a power of two.  ``ids_crc32`` and lengths are of the piece, ``doc_tokens`` of its document.
    """
    path = tokenizer_path or default_tokenizer()
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(_pack_batches(path, capacity, closing_id, with_ids), SCHEMA)
