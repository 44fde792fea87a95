"""Sets of hashed word runs of many texts at once, by numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = int(_rng.integers(1, 2**63)) | 1
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_WORD = np.zeros(256, bool)
for _span in (b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"_"):
    _WORD[list(_span)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of a public splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[:] = np.uint64(_STEP)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text in order, and the number of the text it is in. Texts are lower-cased already; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, off, raw = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    off = off - off[0]
    inside = _WORD[data]
    fresh, last = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data) > 1:
        fresh[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
    edge = off[1:-1]
    fresh[edge[edge < len(data)]] = True
    last[edge[edge > 0] - 1] = True
    start, end = np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = end - start
    chars = data[inside]
    first = np.cumsum(length) - length
    place = np.arange(len(chars)) - np.repeat(first, length)
    words = np.add.reduceat(_BYTE[chars] * _powers(int(length.max()))[place], first)
    return mix(words + length.astype(np.uint64)), np.searchsorted(off, start, "right") - 1


#: Bytes that a run's hash is kept in. Two sets of n runs are mistaken in one of them with a chance of n * n / 2 ** 56.
RUN_BYTES = 7
_KEPT = np.uint64((1 << 64) - (1 << (64 - 8 * RUN_BYTES)))


def pack_runs(run: np.ndarray) -> bytes:
    """Hashes of runs without the bytes that are always zero."""
    return run.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - RUN_BYTES :].tobytes()


def unpack_runs(packed: bytes | list[bytes]) -> np.ndarray:
    raw = np.frombuffer(packed if isinstance(packed, bytes) else b"".join(packed), np.uint8).reshape(-1, RUN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - RUN_BYTES :] = raw
    return out.view("<u8").reshape(-1).astype(np.uint64, copy=False)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of k words of each text: (hashes sorted within each text, the text of each, how many each text has)."""
    words, text = word_hashes(texts)
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    run = np.zeros(n, np.uint64)
    for i in range(k):
        run = mix(run * _MIX[0] + words[i : i + n] + _MIX[1])
    same = text[:n] == text[k - 1 :]
    run, text = run[same] & _KEPT, text[:n][same]
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    run, text = run[new], text[new]
    return run, text, np.bincount(text, minlength=len(texts))


def class_ids(run: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over each text's set; equal sets have equal ids. Only texts with a run count."""
    has = count > 0
    first = (np.cumsum(count) - count)[has]
    out = []
    for salt in (_MIX[2], _MIX[3]):
        h = np.zeros(len(count), np.uint64)
        if len(first):
            h[has] = mix(np.add.reduceat(mix(run * salt + salt), first) + count[has].astype(np.uint64) * salt)
        out.append(h.view(np.int64))
    return out[0], out[1]
