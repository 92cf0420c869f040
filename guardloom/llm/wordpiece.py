"""Token ids of whole texts by a tokenizer that never looks across ASCII white space.

Texts are split at ASCII white space, each distinct word of a slice is encoded once (or
found in a bounded cache), and the ids are gathered with array operations.  That gives
what ``Tokenizer.encode`` gives for the whole text as long as the tokenizer drops white
space and merges within words only; ``tests/llm`` holds it against that.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words in a generation of the cache; two generations are kept.
CACHE_WORDS = 200_000
#: Bytes of text handled at a time (one text alone may be longer).
SLICE_BYTES = 4 << 20


#: Words that the normaliser leaves as they are and the pattern keeps whole.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """Byte -> the code point that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class WordIds:
    """Word -> its ids as little-endian uint32 bytes, for one worker."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = [young.get(w) for w in words]
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            if (x := old.get(words[i])) is None:
                fresh.append(i)
            else:
                found[i] = young[words[i]] = x
        other = []
        for i in fresh:
            if _PLAIN.fullmatch(w := words[i]):
                ids = [x.id for x in self.merge(w.encode().decode("latin-1").translate(_BYTE_LETTERS))]
                found[i] = young[w] = array("I", ids).tobytes()
            else:
                other.append(i)
        coded = self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False) if other else []
        for i, x in zip(other, coded):
            found[i] = young[words[i]] = array("I", x.ids).tobytes()
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return found


def slices(texts: pa.Array):
    """(first, end) of runs of texts that together have SLICE_BYTES at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        start = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, start + SLICE_BYTES, "right")))
        yield first, end
        first = end


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def simplified(texts: pa.Array) -> pa.Array:
    """Texts with fewer distinct words and the same ids.

    ASCII and Latin-1 capitals become small, as the tokenizer's own normaliser does, and
    a space goes between such a letter and an ASCII mark after it, where its pattern
    always splits.  Texts that could hold a special token are left alone.
    """
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return texts
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].copy()
    before = np.concatenate([[0], buf[:-1]])
    high = (before == 0xC3) & (buf >= 0x80) & (buf != 0x97) & (buf != 0xB7)
    buf[(buf >= 65) & (buf <= 90) | high & (buf <= 0x9E)] += 0x20
    cuts = np.flatnonzero((_LETTER[buf] | high)[:-1] & _MARK[buf[1:]]) + 1
    starts = offsets - offsets[0]
    starts = starts + np.searchsorted(cuts, starts)
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.insert(buf, cuts, 32))
    )


def encode(texts: pa.Array, words: WordIds, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids uint32 of all texts, each closed by ``closing``; where each text ends)."""
    split = pc.ascii_split_whitespace(simplified(pc.fill_null(texts, "")))
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = split.flatten().dictionary_encode()
    known = words(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
    pool = np.frombuffer(b"".join(known), dtype="<u4")
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    lengths = sizes[codes]
    after = np.concatenate([[0], np.cumsum(lengths)])
    n = len(bounds) - 1
    ends = after[bounds[1:]] + np.arange(1, n + 1)
    out = np.empty(int(after[-1]) + n, dtype="<u4")
    body = np.ones(len(out), dtype=bool)
    body[ends - 1] = False
    out[ends - 1] = closing
    out[body] = pool[np.repeat(starts[codes] - after[:-1], lengths) + np.arange(after[-1])]
    return out, ends
