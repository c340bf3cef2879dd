"""Word shingles of whole texts as sorted 64-bit hashes, computed in numpy over slices of a text's bytes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SLICE = 1 << 20  # bytes of text worked on at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = np.random.RandomState(20_240_501)


def _random(n: int) -> np.ndarray:
    return _R.randint(0, 2**32, n, dtype=np.uint64) << np.uint64(32) | _R.randint(0, 2**32, n, dtype=np.uint64)


_BYTE = _random(256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(_random(1)[0] | np.uint64(1))
_MIX = _random(8) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, _known: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(_known[0]) < n:
        _known[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, _STEP)]).astype(np.uint64))
    return _known[0][:n]


def _words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``data`` (bytes of texts one after the other) and the place where it starts."""
    text = ~_SPACE[data]
    begin = text.copy()
    begin[1:] &= ~text[:-1]
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
    begin[inner] = text[inner]  # no word runs from one text into the next
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(text)
    first = np.flatnonzero(begin[at])  # where each word starts among the bytes that are no space
    lens = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lens)
    h = np.add.reduceat(_BYTE[data[at]] * _powers(int(lens.max()))[place], first)
    return _mix(h + lens.astype(np.uint64) * _MIX[5]), starts


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slice by slice, cut at white space."""
    out, start = [], 0
    while start < len(data):
        end = start + SLICE
        while end < len(data):
            space = np.flatnonzero(_SPACE[data[end : end + SLICE]])
            if len(space):
                end += int(space[0])
                break
            end += SLICE
        out.append(_words(data[start:end], np.zeros(0, np.int64))[0])
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows; of fewer words, one hash of them all."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        h = np.uint64(0)
        for w in words:
            h = _mix(np.array([h * _MIX[6] + w + np.uint64(n) * _MIX[7]], np.uint64))[0]
        return np.array([h], np.uint64)
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h += words[i : n - width + 1 + i] * (_MIX[i % 5] + np.uint64(2 * (i // 5)))
    return np.unique(_mix(h))


def sets_of(column, width: int = 5):
    """The shingle set of each text of an Arrow string array (null: empty)."""
    with np.errstate(over="ignore"):
        n = len(column)
        i = 0
        while i < n:
            group, size = [], 0
            while i < n and (not group or size < SLICE):
                value = column[i]
                data = value.as_buffer() if value.is_valid else b""
                if len(data) > SLICE:
                    break
                group.append(data)
                size += len(data)
                i += 1
            if group:
                lens = np.array([len(g) for g in group])
                starts = np.concatenate([[0], np.cumsum(lens)])
                words, at = _words(np.frombuffer(b"".join(group), np.uint8), starts[:-1])
                cuts = np.searchsorted(at, starts)
                for a, b in zip(cuts, cuts[1:]):
                    yield _windows(words[a:b], width)
            else:
                yield _windows(_long_words(np.frombuffer(column[i].as_buffer(), np.uint8)), width)
                i += 1


def node_of(tokens: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1
