"""Byte-level BPE over a column of texts with content-defined chunk reuse (problem 6).

A batch's texts are one byte buffer.  A polynomial rolling hash over ``WINDOW``
bytes marks content-defined chunk ends, one in ``ONE_IN`` positions, so equal
passages in different texts get equal chunks, wherever they stand.  A chunk's
ids can differ from the ids of the whole text only around its two ends; each
join is therefore encoded again from the last *certain boundary* before it to
the first one after it.  At a certain boundary the vocabulary's splitting
pattern cuts whatever stands around it:

* between a character that is not white space and ASCII white space,
* between an ASCII digit and an ASCII character that is neither digit nor white
  space, either way round,
* between a kana or Han letter and a digit or a full-width comma, full stop,
  bracket, question or exclamation mark, either way round.

From such a boundary on the pattern sees only what follows, so ids of what lies
between two of them do not depend on their surroundings and agree exactly with
the whole text's; a join reaches outwards until it has met one on either side.

Chunk insides and joins are looked up by hash, compared byte by byte with the
one that was encoded, and their ids are kept for all texts of the Python worker.
What is new is taken apart at all its certain boundaries, and the words met
before are not encoded again either.  Both caches are bounded in bytes.

Null and empty texts give an empty list; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd

# Fixed value: the pattern that the byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_DIR = "/opt/tokenizers"
CHUNK_CACHE = 64 << 20  # bytes of chunks and their ids that a worker keeps
WORD_CACHE = 64 << 20  # bytes of words and their ids
LONGEST_KEPT = 16 << 10  # bytes of a piece that is kept at most
BLOCK_BYTES = 2 << 20
WINDOW = 32  # bytes in the rolling hash
ONE_IN = 256  # a chunk ends at one position in so many, a power of two

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII, 1 ASCII white space, 2 ASCII digit, 3 beyond ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[128:] = 3


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR):
    import tiktoken

    ranks = {}
    with open(os.path.join(directory, name + ".tiktoken"), "rb") as f:
        for line in f:
            piece, rank = line.split()
            ranks[base64.b64decode(piece)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n + 1).bit_length())
    return _powers(size)


def certain_boundaries(data: np.ndarray) -> np.ndarray:
    """Mask over positions 0..n-1: True where a cut just before that byte is certain."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    prev, here = kind[:-1], kind[1:]
    cut[1:] = ((prev == 0) | (prev == 2)) & (here == 1) | (prev == 2) & (here == 0) | (prev == 0) & (here == 2)
    # beyond ASCII before ASCII white space: certain unless that character is itself white space
    at = np.flatnonzero((prev == 3) & (here == 1)) + 1
    if len(at):
        b1, b2 = data[at - 1], data[np.maximum(at - 2, 0)]
        b3 = data[np.maximum(at - 3, 0)]
        blank = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A))
        cut[at[~blank]] = True
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xEF))
    lead = lead[lead + 2 < len(data)]
    if len(lead):
        wide = np.zeros(len(data), np.uint8)  # at a character's first byte: 1 letter, 2 mark
        wide[lead] = _wide(data[lead], data[lead + 1], data[lead + 2])
        at = np.flatnonzero(wide)
        before = np.where(at >= 3, wide[at - 3], 0)
        digit = (at >= 1) & (kind[at - 1] == 2)
        cut[at[(before > 0) & (before != wide[at]) | digit]] = True
        after = at[at + 3 < len(data)] + 3
        cut[after[kind[after] == 2]] = True
    return cut


def _wide(b1: np.ndarray, b2: np.ndarray, b3: np.ndarray) -> np.ndarray:
    """Of characters of three bytes: 1 for kana and Han letters (U+3041-3096, 30A1-30FA, 5000-8FFF), 2 for some marks."""
    low = (b2.astype(np.int32) & 0x3F) << 6 | (b3 & 0x3F)
    code = (b1.astype(np.int32) & 0x0F) << 12 | low
    letter = (code >= 0x3041) & (code <= 0x3096) | (code >= 0x30A1) & (code <= 0x30FA) | (code >= 0x5000) & (code <= 0x8FFF)
    # Ideographic comma and full stop, corner brackets; full-width exclamation mark, comma, question mark
    mark = np.isin(code, (0x3001, 0x3002, 0x300C, 0x300D, 0x300E, 0x300F, 0xFF01, 0xFF0C, 0xFF1F))
    return np.where(letter, 1, np.where(mark, 2, 0)).astype(np.uint8)


def _prefix(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def piece_starts(data: np.ndarray, doc_starts: np.ndarray, prefix: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Starts of chunk insides and of re-encoded joins, each text's start included."""
    n = len(data)
    sure = np.flatnonzero(certain_boundaries(data))
    if n <= WINDOW or not len(sure):
        return doc_starts
    roll = (prefix[WINDOW:] - prefix[:-WINDOW]) * down[: n + 1 - WINDOW] * _MIX
    hit = np.zeros(n + 1, np.int32)
    hit[WINDOW:] = (roll >> np.uint64(40)) & np.uint64(ONE_IN - 1) == 0
    upto = np.cumsum(hit, out=hit)
    here = upto[sure]
    own = here - upto[sure - 1]
    fresh = np.diff(here, prepend=0) > 0  # the first certain boundary at or after a chunk end
    last = np.append(np.diff(here) - own[1:] > 0, upto[-1] > here[-1]) | (own > 0)  # the last one at or before it
    keep = fresh | last
    mark = np.zeros(n + 1, bool)
    mark[sure[keep]] = True
    mark[doc_starts] = True
    return np.flatnonzero(mark[:n])


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class _Cache:
    """Ids of pieces met before, emptied when it holds more than ``limit`` bytes."""

    def __init__(self, limit: int):
        self.limit, self.held, self.ids = limit, 0, {}

    def put(self, piece: bytes, ids: np.ndarray) -> None:
        if len(piece) > LONGEST_KEPT:
            return
        self.held += len(piece) + ids.nbytes + 200  # objects and the table's entry
        if self.held > self.limit:
            self.ids.clear()
            self.held = len(piece) + ids.nbytes + 200
        self.ids[piece] = ids


def _kinds(data: np.ndarray, starts: np.ndarray, prefix: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of pieces, number of each one's content, first piece of each content); equal contents byte by byte."""
    size = np.diff(np.append(starts, len(data)))
    key = (prefix[starts + size] - prefix[starts]) * down[starts] + size.astype(np.uint64) * _MIX
    code, _ = pd.factorize(key)
    first = np.full(code.max() + 1, -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    # a piece whose bytes are not those of its code's first piece gets a code of its own
    like = first[code]
    bad = size != size[like]
    rest = np.flatnonzero(~bad)
    own = data if len(rest) == len(code) else data[_ragged(starts[rest], size[rest])]
    other = np.flatnonzero(own != data[_ragged(starts[like[rest]], size[rest])])
    if len(other):
        bad[rest[np.searchsorted(np.cumsum(size[rest]), other, "right")]] = True
    wrong = np.flatnonzero(bad)
    if len(wrong):
        code = code.copy()
        code[wrong] = len(first) + np.arange(len(wrong))
        first = np.append(first, wrong)
    return size, code, first


class ChunkEncoder:
    """Encodes batches; chunks met before in this worker are not encoded again."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR):
        self.encode = tokenizer(name, directory).encode_ordinary
        self.chunks, self.words = _Cache(CHUNK_CACHE), _Cache(WORD_CACHE)
        self.encoded = self.reused = 0  # bytes of chunks and joins

    def _word(self, piece: bytes) -> np.ndarray:
        ids = self.words.ids.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.decode("utf-8")), np.int32)
            self.words.put(piece, ids)
        return ids

    def _fresh(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Ids of pieces that lie one after another in ``data``, word by word."""
        mark = certain_boundaries(data)
        mark[starts] = True
        words = np.flatnonzero(mark)
        up, down = _power_tables(len(data))
        size, code, first = _kinds(data, words, _prefix(data, up), down)
        raw = data.tobytes()
        ids = [self._word(raw[s : s + z]) for s, z in zip(words[first].tolist(), size[first].tolist())]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        each = n[code]
        flat = np.concatenate(ids)[_ragged((np.cumsum(n) - n)[code], each)]
        return np.split(flat, np.cumsum(np.add.reduceat(each, np.searchsorted(words, starts)))[:-1])

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        lengths = np.diff(offsets)
        docs = len(lengths)
        full = np.flatnonzero(lengths > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        base = int(offsets[0])
        data = data[base : int(offsets[-1])]
        up, down = _power_tables(len(data))
        prefix = _prefix(data, up)
        starts = piece_starts(data, offsets[full] - base, prefix, down)
        size, code, first = _kinds(data, starts, prefix, down)
        raw = data.tobytes()
        pieces = [raw[s : s + z] for s, z in zip(starts[first].tolist(), size[first].tolist())]
        ids = [self.chunks.ids.get(p) for p in pieces]
        new = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
        if len(new):
            long = size[first[new]]
            for i, x in zip(new.tolist(), self._fresh(data[_ragged(starts[first[new]], long)], np.cumsum(long) - long)):
                ids[i] = x
                self.chunks.put(pieces[i], x.copy())
            self.encoded += int(long.sum())
            self.reused += len(data) - int(long.sum())
        else:
            self.reused += len(data)
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        per_piece = n_ids[code]
        at = np.searchsorted(starts, offsets[full] - base)
        counts = np.zeros(docs, np.int64)
        counts[full] = np.add.reduceat(per_piece, at)
        flat = np.concatenate(ids)
        return flat[_ragged((np.cumsum(n_ids) - n_ids)[code], per_piece)], counts

    def column(self, text) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts for an Arrow string column, block by block."""
        import pyarrow as pa

        text = text.cast(pa.large_string())
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        if text.null_count:
            text = text.fill_null("")
        _, off, dat = text.buffers()
        offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, counts, i = [], [], 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            if j == i + 1 and offsets[j] - offsets[i] > BLOCK_BYTES:
                parts = [self.block(data, np.array(ab)) for ab in self._parts(data, int(offsets[i]), int(offsets[j]))]
                ids.extend(p for p, _ in parts)
                counts.append(np.array([sum(len(p) for p, _ in parts)]))
            else:
                one, n = self.block(data, offsets[i : j + 1])
                ids.append(one)
                counts.append(n)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    @staticmethod
    def _parts(data: np.ndarray, start: int, end: int):
        """A very long text in parts that end at certain boundaries."""
        while start < end:
            stop, step = end, BLOCK_BYTES
            while start + step < end:
                sure = np.flatnonzero(certain_boundaries(data[start : start + step]))
                if len(sure):
                    stop = start + int(sure[-1])
                    break
                step *= 2
            yield start, stop
            start = stop


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> ChunkEncoder:
    """One per Python worker, so that tasks of a worker share its pieces."""
    return ChunkEncoder(name, directory)
