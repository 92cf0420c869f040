"""Token counts that follow edits, by segment trees over pre-tokens.

A text is split into pre-tokens and every LEAF of them are a leaf: its characters and its
tokens.  Sums of leaves form a binary tree in an array.  An edit descends to its place by
character sums and splits again only from a little before it to the first old leaf start
that the new split meets again; from there on the split is the old one, because a match
depends on nothing before its start.  Then the sums above the touched leaves are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import lean

LEAF = 64
#: Characters after its end that the split of a pre-token can depend on.
LOOKAHEAD = 4
CACHE_WORDS = 400_000

TREE = "doc_id long, text string, n_tokens long, n_pretokens long, leaf_chars array<int>, leaf_tokens array<int>, leaf_pretokens array<int>"
EDITED = TREE + ", encoded_chars long"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PreTokens:
    """Splits texts and knows how many tokens each pre-token has."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            n = self.known[piece] = len(self.coder._encode_single_piece(piece.encode("utf-8", "surrogatepass")))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            return [self.count(p) for p in pieces]


class SegmentTree:
    """Leaves (characters, tokens, pre-tokens) under sums, in arrays of twice a power of two."""

    def __init__(self, leaves: np.ndarray):
        size = 1
        while size < max(1, len(leaves)):
            size *= 2
        self.size, self.sums = size, np.zeros((2 * size, 3), dtype=np.int64)
        self.sums[size : size + len(leaves)] = leaves
        for level in range(size.bit_length() - 1, 0, -1):
            first = 1 << (level - 1)
            children = self.sums[2 * first : 4 * first]
            self.sums[first : 2 * first] = children[0::2] + children[1::2]

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf that holds the character, where the leaf starts); the last leaf if it is beyond."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if char - start < left or self.sums[2 * node + 1, 0] == 0:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.size, start

    def set(self, leaf: int, value: tuple[int, int, int]) -> None:
        node = leaf + self.size
        change = np.array(value, dtype=np.int64) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def leaves(self) -> np.ndarray:
        rows = self.sums[self.size :]
        return rows[rows[:, 0] > 0]


def build(text: str, pre: PreTokens) -> SegmentTree:
    pieces = pre.pattern.findall(text)
    if not pieces:
        return SegmentTree(np.zeros((0, 3), dtype=np.int64))
    starts = np.arange(0, len(pieces), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), starts)
    tokens = np.add.reduceat(np.array(pre.counts(pieces), dtype=np.int64), starts)
    sizes = np.diff(np.append(starts, len(pieces)))
    return SegmentTree(np.stack([chars, tokens, sizes], axis=1))


def edit(text: str, tree: SegmentTree, start: int, length: int, new: str, pre: PreTokens) -> tuple[str, SegmentTree, int]:
    """(new text, its tree, characters that were split again) after replacing a span.

    The span is brought within the text.
    """
    start = max(0, min(start, len(text)))
    end = max(start, min(start + max(0, length), len(text)))
    out = text[:start] + new + text[end:]
    shift = len(out) - len(text)
    leaf, begin = tree.find(max(0, start - LOOKAHEAD))
    # old starts of later leaves, in the new text, from the end of the edit on
    last, last_start = tree.find(end)
    chars, tokens, pieces, at = 0, 0, 0, begin
    follow, follow_start = last + 1, last_start + int(tree.sums[last + tree.size, 0]) + shift
    for m in pre.pattern.finditer(out, begin):
        while m.start() > follow_start and follow < tree.size:
            follow_start += int(tree.sums[follow + tree.size, 0])
            follow += 1
        if m.start() == follow_start and follow_start < len(out):
            break
        at = m.end()
        chars += m.end() - m.start()
        tokens += pre.count(m[0])
        pieces += 1
    else:
        follow = tree.size
    for i in range(leaf + 1, follow):
        if tree.sums[i + tree.size, 0]:
            tree.set(i, (0, 0, 0))
    tree.set(leaf, (chars, tokens, pieces))
    if pieces > 8 * LEAF:  # a leaf that has grown is split up again
        old = tree.sums[tree.size :]
        grown = build(out[begin:at], pre).leaves()
        tree = SegmentTree(np.concatenate([old[:leaf], grown, old[leaf + 1 :]]))
    return out, tree, chars


def _row(doc_id, text: str, tree: SegmentTree) -> tuple:
    leaves = tree.leaves()
    return doc_id, text, int(tree.total[1]), int(tree.total[2]), *(leaves[:, i].tolist() for i in range(3))


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.int64()]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def count_tokens(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, n_pretokens and the leaves' chars, tokens and pretokens for every
    row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  A null or
    empty text has no tokens and no leaves; repeated rows repeat; texts of any length are
    counted whole; an empty table gives no rows.
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [
                    _row(d, t or "", build(t or "", pre))
                    for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                ]
                yield _table(rows, _names(TREE))

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, TREE)


def _edited(doc_id, text: str, tree: SegmentTree, edits: list | None, pre: PreTokens) -> tuple:
    encoded = 0
    for e in edits or []:
        if e is not None:
            text, tree, n = edit(text, tree, e["start"] or 0, e["length"] or 0, e["new"] or "", pre)
            encoded += n
    return *_row(doc_id, text, tree), encoded


_EDITS = "array<struct<start:int,length:int,new:string>>"


def apply_edits(counted: DataFrame, edits: Column, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of count_tokens(), or of this, after ``edits``, and encoded_chars: how many characters were split again.

    ``edits`` is an array of (start int, length int, new string), applied in turn, each to
    the text that the one before left; spans are brought within the text, a null array or
    null entries change nothing.  Trees come from the rows' leaves, not from the text.  Texts of
    any length, repeated rows and empty tables are as in count_tokens().
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(i, 256).to_pylist():
                    leaves = np.array([r["leaf_chars"], r["leaf_tokens"], r["leaf_pretokens"]], np.int64).reshape(3, -1)
                    rows.append(_edited(r["doc_id"], r["text"] or "", SegmentTree(leaves.T), r["edits"], pre))
                yield _table(rows, _names(EDITED))

    need = counted.select(*_names(TREE), edits.cast(_EDITS).alias("edits"))
    return need.mapInArrow(run, EDITED)


def count_and_edit(docs: DataFrame, edits: Column, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """apply_edits() of count_tokens(), where the texts cross to Python once."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = [_edited(r["doc_id"], t := r["text"] or "", build(t, pre), r["edits"], pre) for r in batch.slice(i, 256).to_pylist()]
                yield _table(rows, _names(EDITED))

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(_EDITS).alias("edits"))
    return need.mapInArrow(run, EDITED)
