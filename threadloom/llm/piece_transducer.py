"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._batches import sliced

_SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MEMO_SIZE, _MEMO_CHARS, _CHARS = 250_000, 40, 1 << 18
_SEGMENT = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; bytes for length-delimited fields."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


# -- machines -------------------------------------------------------------------


class _Arcs:
    """Arcs of a machine: numbers by key, in open addressing, looked up many at once. -1 where there is no arc."""

    def __init__(self, arcs: dict[int, int]):
        bits = max(4, (4 * len(arcs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _NO_KEY), np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(arcs, np.uint64, len(arcs))
        values = np.fromiter(arcs.values(), np.int64, len(arcs))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == _NO_KEY
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of several the last one stays
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found != _NO_KEY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != _NO_KEY)]
        return out


_NO_KEY, _SPREAD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


class Normaliser:
    """A transducer over characters: blanks as U+2581, one in front of a text, and, if asked for, no others at the ends and no runs.

    States: nothing but blanks so far, behind another character, behind a blank that is held back. ``arcs`` gives for a state and a
    class (blank or not) what is written, where 0 stands for the character itself; a state follows from the last class alone.
    """

    LEAD, WORD, GAP = 0, 1, 2

    def __init__(self, dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        mark = ord(_SPACE) if escape else 32
        front = (mark,) if dummy_prefix else ()
        self.dummy_prefix, self.remove_extra, self.escape = dummy_prefix, remove_extra, escape
        if remove_extra:
            blank = {self.LEAD: (), self.WORD: (), self.GAP: ()}
            other = {self.LEAD: (*front, 0), self.WORD: (0,), self.GAP: (mark, 0)}
            self.start = ()
        else:
            blank = dict.fromkeys((self.LEAD, self.WORD, self.GAP), (mark,))
            other = dict.fromkeys((self.LEAD, self.WORD, self.GAP), (0,))
            self.start = front
        self.arcs = [[blank[s], other[s]] for s in (self.LEAD, self.WORD, self.GAP)]
        size = max(len(w) for row in self.arcs for w in row)
        self.written = np.array([[len(w) for w in row] for row in self.arcs])
        self.symbols = np.array([[[*w, *[0] * (size - len(w))] for w in row] for row in self.arcs], np.uint32).reshape(3, 2, size)

    def __call__(self, text: str) -> str:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(c):
            return ""
        other = (c != 32).astype(np.int64)
        before = np.concatenate([[self.LEAD], np.where(other[:-1] == 1, self.WORD, self.GAP)])
        before = np.where(np.cumsum(other) - other == 0, self.LEAD, before)
        n, out = self.written[before, other], self.symbols[before, other]
        out = np.where(out == 0, c[:, None], out)[np.arange(out.shape[1]) < n[:, None]]
        return np.concatenate([np.array(self.start, np.uint32), out.astype(np.uint32)]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class PieceTransducer:
    """Weighted transducers of a model, and their composition with inputs: normaliser, pieces with byte fallback, pairs.

    * The normaliser (``Normaliser``) writes the marked text.
    * The piece machine reads characters along a trie and writes a piece at each end of one, weighing its negated score
      in a unigram model and nothing in a BPE model. A character that is no piece takes an arc of its bytes.
    * The pair machine accepts pieces one after the other. In a unigram model it accepts all. In a BPE model its arc
      from one piece to the next weighs nothing if merging their joined text by the model's ranks gives back just
      those two, and infinitely much otherwise. That leaves exactly one path of finite weight, the one that merging takes.

    Inputs are composed with the machines lazily, many segments side by side: arcs of the trie from every place, then
    shortest distances in the tropical semiring (minimum, plus) from front to end, then the way back.
    """

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        model_type, normal = _UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2):
            raise ValueError("models with a character map are not supported")
        if model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        if _USER in self.kinds:
            raise ValueError("models with user-defined symbols are not supported")
        self.bpe = model_type == _BPE
        self.normalise = Normaliser(bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (_NORMAL, _UNUSED)}
        self.unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.split = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._compile()
        self._out = [self._spelled(i) for i in range(len(self.pieces))]

    # -- compiling --------------------------------------------------------

    def _compile(self) -> None:
        """Symbols are the pieces, then the characters that occur in pieces but are none, then all others as one."""
        n = len(self.pieces)
        alone = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.symbol = self.ids | {c: n + k for k, c in enumerate(alone)}
        self.foreign = n + len(alone)
        floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.weight = np.zeros(self.foreign + 1)
        if self.bpe:
            self._compile_pairs(alone)
        else:
            self.weight[:n] = [-s for s in self.scores]
            self.weight[n:] = -floor
        states, self.ends, count = {}, [-1], 1
        for text, t in self.symbol.items():
            if self.bpe and not self.reached[t]:
                continue  # merging never makes it
            at = 0
            for c in text:
                key = at << 21 | ord(c)
                nxt = states.get(key)
                if nxt is None:
                    nxt, count = count, count + 1
                    states[key] = nxt
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = t
        self.trie, self.ends = _Arcs(states), np.array(self.ends)

    def _compile_pairs(self, alone: list[str]) -> None:
        """For each symbol: whether merging its text gives it back, the two parts of its last merge, and its rank; and what two symbols merge to."""
        size = self.foreign + 1
        self.reached, self.rank = np.zeros(size, bool), np.full(size, -1)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.place = np.full(size, 1 << 60)  # pieces of one score share a place, and the leftmost of them is merged first
        known = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        self.place[known] = np.unique(-np.array(self.scores)[known], return_inverse=True)[1]
        merged = {}
        for text, t in self.symbol.items():
            for k in range(1, len(text)):
                x, y = self.symbol.get(text[:k]), self.symbol.get(text[k:])
                if x is not None and y is not None:
                    merged[x << 32 | y] = t
            if len(text) == 1:
                self.reached[t] = True
                continue
            steps = self._merged(text, trace=True)
            if len(steps[-1]) == 1:
                self.reached[t] = True
                self.left[t], self.right[t] = (self.symbol[x] for x in steps[-2])
                self.rank[t] = self.place[t]
        self.merges = _Arcs(merged)

    def _merged(self, s: str, trace: bool = False) -> list:
        """What merging leaves of a short string: best rank first, then the leftmost; with ``trace`` all steps."""
        parts = list(s)
        steps = [list(parts)]
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = self.scores[i], k
            if best is None:
                return steps if trace else parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if trace:
                steps.append(list(parts))

    def _follows(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the pair machine of a BPE model has an arc of finite weight, for many pairs (-1: the start).

        Takes merges at the seam back, latest first, and looks for one across it that would have come earlier.
        """
        ok = np.ones(len(p), bool)
        todo = np.flatnonzero((p >= 0) & (p < self.foreign) & (t < self.foreign))
        a, b, limit = p[todo], t[todo], np.full(len(todo), 1 << 60)
        while len(todo):
            both = self.merges.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            cut = (both >= 0) & (self.place[both] < limit)
            ok[todo[cut]] = False
            go = ~cut & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            todo, a, b = todo[go], a[go], b[go]
            ra, rb = self.rank[a], self.rank[b]
            # of equal ranks the left one was merged first: a merge at the seam comes behind those on its left and before those on its right
            limit = np.where(ra > rb, ra, rb + 1)
            a, b = np.where(ra > rb, self.right[a], a), np.where(ra > rb, b, self.left[b])
        return ok

    # -- encoding ---------------------------------------------------------

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null and empty text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; segments that several hold are composed once."""
        marked = [self.normalise(t or "") for t in texts]
        # no piece has a mark behind another character, so none crosses from a word into the marks after it
        parts = [_SEGMENT.findall(m) if self.split else [m] if m else [] for m in marked]
        if len(self._memo) >= _MEMO_SIZE:
            self._old, self._memo = self._memo, {}
        memo, old, fresh = self._memo, self._old, {}
        for x in set().union(*parts).difference(memo):
            known = old.get(x)
            if known is None:
                fresh[x] = None
            else:
                memo[x] = known
        names = sorted(fresh, key=len)
        at = 0
        while at < len(names):
            to, size = at, 0
            while to < len(names) and size < _CHARS:
                size += len(names[to])
                to += 1
            fresh.update(zip(names[at:to], self.shortest_paths(names[at:to]), strict=True))
            at = to
        memo.update((x, v) for x, v in fresh.items() if len(x) <= _MEMO_CHARS)
        fresh = {x: v for x, v in fresh.items() if len(x) > _MEMO_CHARS}
        if fresh:
            return [np.frombuffer(b"".join([memo[x] if x in memo else fresh[x] for x in p]), "<u4") for p in parts]
        return [np.frombuffer(b"".join([memo[x] for x in p]), "<u4") for p in parts]

    def shortest_paths(self, segments: list[str]) -> list[bytes]:
        """Ids on the shortest path of each non-empty segment through the composition, as little-endian 32-bit bytes."""
        c = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(x) for x in segments])
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        # the input's places: one before each character and one at the end of each segment
        place, stop = np.arange(len(c)) + owner, end[owner]
        src, dst, sym = [], [], []
        reading, state, depth = np.arange(len(c)), np.zeros(len(c), np.int64), 0
        single = np.full(len(c), False)
        while len(reading):
            state = self.trie.get(state.astype(np.uint64) << np.uint64(21) | c[reading + depth])
            on = state >= 0
            reading, state = reading[on], state[on]
            depth += 1
            t = self.ends[state]
            hit = t >= 0
            src.append(place[reading[hit]])
            dst.append(src[-1] + depth)
            sym.append(t[hit])
            if depth == 1:
                single[reading[hit]] = True
            more = reading + depth < stop[reading]
            reading, state = reading[more], state[more]
        others = np.flatnonzero(~single)
        src.append(place[others])
        dst.append(src[-1] + 1)
        sym.append(np.full(len(others), self.foreign))
        src, dst, sym = (np.concatenate(x) for x in (src, dst, sym))
        first = end - size + np.arange(len(size))
        where = np.zeros(len(c) + len(size), np.int64)  # of each place in its segment
        where[place] = place - first[owner]
        last_place = first + size
        where[last_place] = size
        # by place in the segment, then by end, then by start: no two arcs have both in common
        upto, span = where[dst], int((dst - src).max()) + 1
        order = np.argsort((upto * len(where) + dst) * span - (dst - src))
        src, dst, sym = src[order], dst[order], sym[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(upto, minlength=int(size.max()) + 1)[1:])])
        far, back, said = np.full(len(where), np.inf), np.full(len(where), -1), np.full(len(where), -1)
        far[first] = 0.0
        for a, b in zip(cuts, cuts[1:], strict=False):
            x, y, t = src[a:b], dst[a:b], sym[a:b]
            w = far[x] + self.weight[t]
            if self.bpe:
                live = np.flatnonzero(np.isfinite(w))
                w[live[~self._follows(said[x[live]], t[live])]] = np.inf
            heads = np.flatnonzero(np.diff(y, prepend=-1))
            least = np.minimum.reduceat(w, heads)
            best = np.flatnonzero(w == np.repeat(least, np.diff(np.append(heads, len(y)))))
            best = best[np.diff(y[best], prepend=-1) != 0]  # of equal weights the one that begins first
            far[y[best]], back[y[best]], said[y[best]] = w[best], x[best], t[best]
        steps, at, mine = [], last_place, np.arange(len(size))
        while len(at):
            steps.append((mine, at))
            at = back[at]
            on = at != first[mine]
            at, mine = at[on], mine[on]
        mine, at = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        order = np.argsort(mine, kind="stable")
        mine, at = mine[order], at[order]
        told = said[at]
        odd = np.flatnonzero(told >= len(self.pieces))
        n = np.ones(len(told), np.int64)
        if len(odd):  # characters that stand for their bytes
            chars = "".join(segments)
            each = [self._fallback(chars[p]) for p in (at[odd] - mine[odd] - 1).tolist()]
            n[odd] = [len(e) for e in each]
            ids = np.repeat(told, n)
            first_id = np.cumsum(n) - n
            for i, e in zip(first_id[odd].tolist(), each, strict=True):
                ids[i : i + len(e)] = e
        else:
            ids = told
        n = np.bincount(mine, n, len(size)).astype(np.int64)
        raw, upto = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
        return [raw[x:y] for x, y in zip(upto, upto[1:], strict=False)]

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    # -- decoding ---------------------------------------------------------

    def _spelled(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == _BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == _CONTROL:
            return b""
        text = " ⁇ " if kind == _UNKNOWN else self.pieces[i]
        return (text.replace(_SPACE, " ") if self.normalise.escape else text).encode()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces joined to characters, each byte that fits none as U+FFFD, the first blank taken off."""
        raw = b"".join([self._out[i] for i in ids.tolist()])
        first = next((i for i in ids.tolist() if self.kinds[i] != _CONTROL), None)
        if self.normalise.dummy_prefix and first is not None and self.pieces[first].startswith(_SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_loaded: dict[str, PieceTransducer] = {}


def transducer(path: str | None = None) -> PieceTransducer:
    """Transducer of a model file (default: the 32k model of ``public_tokenizers``), kept per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = PieceTransducer(f.read())
    return _loaded[path]


def encode_documents(docs: DataFrame, model_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every row of ``docs``.

    Ids are those of the model for the whole text; null and empty text have none and decode to the empty text.
    Repeated rows stay, other columns are ignored, an empty table gives no row. ``model_path`` must exist on the
    executors.
    """
    cols = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        fst = transducer(model_path)
        for batch in sliced(batches):
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                ids = fst.encode_many(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([fst.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, round_trip`` of every row: digests of what ``encode_documents`` gives."""
    cols = docs.select("doc_id", "text")

    def run(batches):
        fst = transducer(model_path)
        for batch in sliced(batches):
            n, crc, same, texts = [], [], [], batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                some = texts[a : a + 64]
                for t, ids in zip(some, fst.encode_many(some), strict=True):
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    same.append(fst.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
