"""Vectorised word and shingle hashes over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
#: White space beyond ASCII that str.split() splits on.
_WIDE = tuple("\x1c\x1d\x1e\x1f\x85\xa0     　") + tuple(map(chr, range(0x2000, 0x200B)))
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Separators of a tokenisation that also drops ASCII punctuation.
PUNCTUATED = _SPACE.copy()
PUNCTUATED[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")] = True
_SEGMENT = 1 << 20
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) of an unsigned array; the input is left alone."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, _SEGMENT + (1 << 16))
        for k, base in (("p", _P), ("q", _INV)):
            a = np.full(size, _U(base))
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["q"][:n]


def plain(text: str | None, lower: bool = True) -> bytes:
    """UTF-8 bytes with every white space character that str.split() knows as an ASCII one."""
    t = text or ""
    for c in _WIDE:
        if c in t:
            t = t.replace(c, " ")
    return (t.lower() if lower else t).encode("utf-8", "surrogatepass")


def word_hashes(texts: Iterable[str | None], lower: bool = True, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash of every word of every text, in order; number of words of each text; a hash array for each prefix length.

    Words stand between the bytes that ``space`` marks. A prefix is so many bytes of a word, or the word if shorter.
    """
    raw = [plain(t, lower) for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = b"\n".join(raw) + b"\n"
    ends_of = np.cumsum(sizes)
    found, at, pos, more = [], [], 0, [[] for _ in prefixes]
    while pos < len(data):
        cut = pos + _SEGMENT
        if cut < len(data):  # cut behind the next white space, so that no word is divided
            nxt = min((i for i in (data.find(b" ", cut), data.find(b"\n", cut)) if i >= 0), default=len(data) - 1)
            cut = nxt + 1
        buf = np.frombuffer(data, np.uint8, min(cut, len(data)) - pos, pos)
        inside = np.empty(len(buf) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(space[buf], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[0::2], edge[1::2]
        p, q = _powers(len(buf) + 1)
        c = np.empty(len(buf) + 1, _U)
        c[0] = 0
        np.cumsum((buf.astype(_U) + _U(1)) * p[:-1], out=c[1:])
        found.append(mix((c[e] - c[s]) * q[s] + (e - s).astype(_U)))
        for out, m in zip(more, prefixes, strict=True):
            to = np.minimum(e, s + m)
            out.append(mix((c[to] - c[s]) * q[s] + _U(m << 32) + (to - s).astype(_U)))
        at.append(s + pos)
        pos = min(cut, len(data))
    words = np.concatenate(found) if found else np.empty(0, _U)
    starts = np.concatenate(at) if at else np.empty(0, np.int64)
    upto = np.searchsorted(starts, ends_of)
    return words, np.diff(upto, prepend=0), *(np.concatenate(x) for x in more)


def content_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    first = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - np.repeat(first, counts)).astype(_U)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
        x = np.concatenate([[_U(0)], np.cumsum(mix(words + mix(place * _U(salt) + _U(salt))))])
        out.append(mix(x[first + counts] - x[first] + counts.astype(_U) * _U(salt)))
    return out[0], out[1]


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of each text, and their number; a shorter text with words has one, itself."""
    n_out = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    first = np.cumsum(counts) - counts
    padded = np.concatenate([words, np.zeros(size, _U)])
    start = np.repeat(first, n_out) + (np.arange(n_out.sum()) - np.repeat(np.cumsum(n_out) - n_out, n_out))
    left = np.repeat(first + counts, n_out) - start  # words from here to the text's end
    acc = np.zeros(len(start), _U)
    c = _U(_P)
    for j in range(size):
        w = padded[start + j]
        acc += (w if j == 0 else np.where(left > j, w, _U(0))) * c
        c = _U(int(c) * _P & 0xFFFFFFFFFFFFFFFF)
    return mix(acc), n_out


def cells(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multiset to set: the m-th repetition of a hash within a text becomes an element of its own. Returns elements, text index."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    rep = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return np.where(rep > 0, mix(h + rep.astype(_U) * _U(0xA0761D6478BD642F)), h), d
