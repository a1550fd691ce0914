"""Vectorised text helpers for Arrow batches: word spans, rolling hashes, minimizers.

All of them work on the bytes of many documents at once and never copy a text into a Python string.
A batch is cut into slices of about ``SLICE_BYTES`` so that the arrays stay small whatever Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: The bytes that separate words, [\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_MULT = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0x2545F4914F6CDD1D) + U64(seed))


_CODES = {0: byte_codes(0x1234567), 1: byte_codes(0x89ABCDEF01)}
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``buf``."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_CODES[seed][buf] * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with about ``limit`` bytes; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(col))
        own = offsets[first : end + 1]
        yield first, end, whole[own[0] : own[-1]], own - own[0]
        first = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): spans of the words, and bounds[i]:bounds[i+1] are those of document i."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[buf]
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[1:] = inside
    edges = offsets[(offsets < len(buf))]
    left = after[:-1].copy()
    left[edges] = False
    right = np.append(inside[1:], False)
    cuts = offsets[(offsets > 0)] - 1
    right[cuts[cuts >= 0]] = False
    start = np.flatnonzero(inside & ~left)
    end = np.flatnonzero(inside & ~right) + 1
    return start, end, np.searchsorted(start, offsets)


def ngram_hash(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of each run of n codes; len(codes) - n + 1 of them (or none)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, U64(seed), dtype=np.uint64)
    for j in range(n):
        out *= _MULT
        out += codes[j : j + size]
    return mix(out)


def within(bounds: np.ndarray, n: int) -> np.ndarray:
    """True where n consecutive items starting there stay in one document; bounds as of words()."""
    total = int(bounds[-1])
    ok = np.ones(total, dtype=bool)
    if n > 1 and total:
        ends = bounds[1:]
        lo = np.maximum(ends - (n - 1), bounds[:-1])
        mark = np.zeros(total + 1, np.int64)
        np.add.at(mark, lo, 1)
        np.add.at(mark, ends, -1)
        ok = np.cumsum(mark[:-1]) == 0
    return ok[: max(0, total)]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: block prefix and suffix minima."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def minimizers(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some run of w grams; every tie is taken.

    valid[i]: the run of w grams that starts at i lies in one document. As only the run's content decides,
    equal runs choose the same places, so each repeated run has a chosen gram that is repeated too.
    """
    low = sliding_min(grams, w)
    if not len(low):
        return np.zeros(0, np.int64)
    low = np.where(valid[: len(low)], low, U64(0))
    # greatest minimum among the runs that hold a place; 0 stands for no run
    flipped = np.full(len(grams) + w - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    flipped[w - 1 : w - 1 + len(low)] = ~low
    top = ~sliding_min(flipped, w)[: len(grams)]
    return np.flatnonzero((top == grams) & (top != 0))


def runs(positions: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of what the spans [p, p + length) cover; positions ascend."""
    if not len(positions):
        none = np.zeros(0, np.int64)
        return none, none
    cut = np.flatnonzero(np.diff(positions) > length) + 1
    start = positions[np.concatenate([[0], cut])]
    end = positions[np.concatenate([cut - 1, [len(positions) - 1]])] + length
    return start, end


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def key_runs(batches: Iterator[pa.RecordBatch], run_rows: int, run_bytes: int) -> Iterator[tuple[pa.Table, bool]]:
    """Bounded runs of rows sorted by their first column: (rows of whole keys, False), or (a part of one key's rows, True)."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    cut_key = None  # the key of which a part was given

    def cut(last: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held, rows, size, cut_key
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        if cut_key is not None:
            stop = int(np.searchsorted(key != cut_key, True)) if (key != cut_key).any() else len(key)
            if stop:
                yield table.slice(0, stop), True
            table, key = table.slice(stop), key[stop:]
            if len(key):
                cut_key = None
        if len(key) and last:
            yield table, False
            table = table.slice(0, 0)
        elif len(key):
            begin = len(key) - int(np.argmax(np.append(key[::-1] != key[-1], True)))
            if begin:
                yield table.slice(0, begin), False
                table = table.slice(begin)
            if table.num_rows >= run_rows or table.nbytes >= run_bytes:
                cut_key = key[-1]
                yield table, True
                table = table.slice(0, 0)
        held = table.to_batches() if table.num_rows else []
        rows, size = table.num_rows, table.nbytes if table.num_rows else 0

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            held.append(piece)
            rows += piece.num_rows
            size += piece.nbytes
            if rows >= run_rows or size >= run_bytes:
                yield from cut(False)
    if held:
        yield from cut(True)
