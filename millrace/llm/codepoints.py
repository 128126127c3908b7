"""Arrow text as flat numpy code-point arrays, and back.

A batch of n texts is ``(cps, offs)``: all code points in one uint32 array and n+1 offsets into it. Nulls are empty
ranges here; callers keep the validity themselves. Nothing in this module loops over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Flat = tuple[np.ndarray, np.ndarray]


def flatten(col: pa.Array | pa.ChunkedArray) -> Flat:
    """Copy an Arrow string column into one code-point array with row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, off_buf, data = col.buffers()
    boffs = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[boffs[0] : boffs[-1]] if data is not None else np.zeros(0, np.uint8)
    boffs = boffs - boffs[0]
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, boffs.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, starts[boffs].astype(np.int64)


def to_arrow(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Turn flat code points back into an Arrow string array; ``valid`` marks the rows that are not null."""
    cps = np.ascontiguousarray(cps, np.uint32)
    data = cps.tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    boffs = ends[offs].astype(np.int64)
    bitmap = None
    if valid is not None and not valid.all():
        bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(boffs.tobytes()), pa.py_buffer(data), bitmap)
    return out.cast(pa.string()) if len(data) < 2**31 - 1 else out


def validity(col: pa.Array) -> np.ndarray:
    return np.asarray(col.is_valid()) if not isinstance(col, pa.ChunkedArray) else np.asarray(col.combine_chunks().is_valid())


def rows_of(offs: np.ndarray) -> np.ndarray:
    """Row number of every code point."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def keep(cps: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> Flat:
    """Drop the code points where ``mask`` is false and move the offsets along."""
    before = np.concatenate([[0], np.cumsum(mask)])
    return cps[mask], before[offs]


def from_texts(texts: list[str | None]) -> Flat:
    return flatten(pa.array(texts, pa.large_string()))


def texts_of(cps: np.ndarray, offs: np.ndarray) -> list[str]:
    return to_arrow(cps, offs).to_pylist()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POW = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(cps: np.ndarray, offs: np.ndarray, n: int) -> Flat:
    """64-bit hashes of all n-grams of code points of each row, in order, with the rows' offsets into them."""
    lens = np.diff(offs)
    if len(cps) < n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    wide = cps.astype(np.uint64)
    h = np.zeros(len(cps) - n + 1, np.uint64)
    for j in range(n):
        h += wide[j : len(wide) - n + 1 + j] * _POW[j]
    ends = np.repeat(offs[1:], lens)
    ok = (np.arange(len(h)) + n) <= ends[: len(h)]
    counts = np.maximum(lens - n + 1, 0)
    return mix64(h[ok]), np.concatenate([[0], np.cumsum(counts)])


def slices(col: pa.Array, max_bytes: int = 2_000_000):
    """Row ranges (start, stop) of a string column of at most ``max_bytes`` each; a longer row stands alone."""
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    boffs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(boffs, boffs[at] + max_bytes, "right")) - 1)
        yield at, to
        at = to


def by_slices(col: pa.Array, f, max_bytes: int = 2_000_000) -> pa.Array:
    """A string column through a function of flat texts, slice by slice, so that memory follows the slice; nulls stay."""
    done = []
    for lo, hi in slices(col, max_bytes):
        part = col.slice(lo, hi - lo)
        done.append(to_arrow(*f(*flatten(part)), validity(part)).cast(pa.large_string()))
    whole = pa.concat_arrays(done) if done else pa.array([], pa.large_string())
    return whole.cast(pa.string()) if whole.nbytes < 2**31 - 1 else whole


def text_keys(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's text (int64)."""
    lens = np.diff(offs)
    pos = np.arange(len(cps), dtype=np.uint64) - np.repeat(offs[:-1], lens).astype(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = mix64((cps.astype(np.uint64) + np.uint64(1)) * np.uint64(seed) ^ mix64(pos + np.uint64(seed >> 7)))
        total = np.zeros(len(lens), np.uint64)
        full = lens > 0
        if full.any():
            total[full] = np.add.reduceat(h, offs[:-1][full])
        out.append(mix64(total + lens.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _unspaced() -> np.ndarray:
    """Code points of scripts written without spaces: each is a word of its own."""
    out = np.zeros(0x110000, bool)
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        out[a : b + 1] = True
    return out


UNSPACED = _unspaced()


def word_hashes(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of plain texts (words parted by U+0020; unspaced scripts by character), the rows' offsets
    into the words, and the position of each word's first code point."""
    if len(cps) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    solid = cps != 32
    lone = UNSPACED[cps]
    fresh = np.empty(len(cps), bool)
    fresh[0] = True
    fresh[1:] = ~solid[:-1] | lone[1:] | lone[:-1]
    fresh[offs[:-1][np.diff(offs) > 0]] = True
    begin = np.flatnonzero(fresh & solid)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), begin
    pos = np.arange(len(cps)) - np.maximum.accumulate(np.where(fresh, np.arange(len(cps)), 0))
    h = np.where(solid, (cps.astype(np.uint64) + np.uint64(7)) * _POW[pos & 63] * (pos.astype(np.uint64) | np.uint64(1)), np.uint64(0))
    return mix64(np.add.reduceat(h, begin)), np.searchsorted(begin, offs), begin


def sequence_hashes(words: np.ndarray, offs: np.ndarray, n: int) -> Flat:
    """Hashes of n consecutive words of each row; a row of fewer words has one hash of all of them."""
    lens = np.diff(offs)
    counts = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(offs[:-1], counts) + np.arange(out_offs[-1]) - np.repeat(out_offs[:-1], counts)
    end = np.repeat(offs[1:], counts)
    h = np.zeros(len(first), np.uint64)
    for j in range(n):
        at = first + j
        ok = at < end
        h[ok] += words[at[ok]] * _POW[j]
    return mix64(h), out_offs
