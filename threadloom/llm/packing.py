"""Token counts of whole documents and their packing into few fixed windows, with certified bounds."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._batches import sliced
from threadloom.llm._store import written

_MEMO_SIZE, _MEMO_CHARS = 500_000, 48
_loaded: dict[str, _Encoder] = {}
_PIECE = "uid long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


#: The normaliser and the splitting rules under which white-space free chunks can be encoded by themselves.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class _Encoder:
    """A tokenizer file with a bounded memory of what white-space free chunks encode to.

    Files of other rules than the fixed ones above encode each whole text. Those rules lower the case, drop white space and never join what stands on both sides of it, so
    chunks between blanks and line ends are encoded once each and put together again. A chunk of Latin-1 letters is one
    word to these rules, as is one with full stops or commas behind it without them; such words are encoded many
    at once, and the tokenizer tells which ids are whose.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_chunks = (rules["normalizer"], rules["pre_tokenizer"]) == (_NORMAL, _SPLIT) and not any(set(t["content"]) & set(" \t\r\n") for t in rules["added_tokens"])
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit bytes."""
        if not self.by_chunks:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.memo) > _MEMO_SIZE:
            self.old, self.memo = self.memo, {}
        memo, out, later, new = self.memo, [], [], set()
        for text in texts:
            chunks = _parted(text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            try:
                out.append(b"".join([memo[c] for c in chunks]))
            except KeyError:
                new.update(chunks)
                later.append((len(out), chunks))
                out.append(b"")
        got = self._resolve(new.difference(memo))
        memo.update(got)
        for i, chunks in later:
            out[i] = b"".join([memo[c] for c in chunks])
        for c in [c for c in got if len(c) > _MEMO_CHARS]:
            del memo[c]
        return out

    def _resolve(self, new: set[str]) -> dict[str, bytes]:
        old, memo, words, rest, ends = self.old, self.memo, {}, [], []
        got = {c: old[c] for c in new.intersection(old)}
        for c in new.difference(got):
            if c.isalpha() and c.islower() and _latin(c):
                words[c] = None
                continue
            base = c.rstrip(".,")
            if base.isalpha() and _latin(base):
                base, end = base.lower(), c[len(base) :]
                if base not in words:
                    words[base] = memo.get(base) or old.get(base) or got.get(base)
                ends.append((c, base, end))
            else:
                rest.append(c)
        rest += sorted({e for _, _, e in ends if e and e not in memo and e not in got} - set(rest))
        for c, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False), strict=True):
            got[c] = np.array(e.ids, "<u4").tobytes()
        unknown = [w for w, b in words.items() if b is None]
        for a in range(0, len(unknown), 5_000):
            some = unknown[a : a + 5_000]
            e = self.tok.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            cut = (4 * np.searchsorted(owner, np.arange(len(some) + 1))).tolist()
            raw = ids.tobytes()
            words.update(zip(some, [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)], strict=True))
        got.update(words)
        for c, base, end in ends:
            got[c] = words[base] + (memo.get(end) or got[end] if end else b"")
        return got


#: Latin-1 characters by kind: 1 for marks, 0 for letters, digits and white space.
_MARKS = bytes(int(not (chr(i).isspace() and not 0x1C <= i <= 0x1F) and unicodedata.category(chr(i))[0] not in "LN") for i in range(256))


def _parted(text: str) -> str:
    try:
        kinds = text.encode("latin-1").translate(_MARKS)
    except UnicodeEncodeError:
        return text
    return text if b"\1\1" in kinds else text.lower().replace(",", " , ").replace(".", " . ")


def _latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode_texts(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit bytes, by the tokenizer of a file; kept per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path].encode(texts)


def _pieces(window: int, end_id: int, path: str | None, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 1 << 21):
                    chars += len(texts[to] or "")
                    to += 1
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, raw in enumerate(encode_texts(texts[at:to], path), at):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * window)):
                        part = raw[a : a + 4 * window]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(part)
                cols = [pa.array(range(uid, uid + len(row)), pa.int64()), ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                uid += len(row)
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = to
    return run


def best_fit_decreasing(lengths: np.ndarray, window: int) -> np.ndarray:
    """Bin of each length by best-fit decreasing; ties keep the order of input. Lengths of 1 to ``window``."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(window + 1)]  # open bins by free space
    mask, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = mask >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, b = window, n
            n += 1
        bins[i] = b
        space -= size
        if space:
            free[space].append(b)
            mask |= 1 << space
    return bins


def lower_bound(hist: np.ndarray) -> int:
    """Bins that any packing of these lengths needs, by dual feasible functions; ``hist[x]`` counts length x.

    Takes the best of the area bound, the threshold functions (lengths above window - a count a whole bin, those
    below a nothing) for all a, and the rounding functions of order 1 to 31.
    """
    window = len(hist) - 1
    x = np.arange(window + 1)
    best = -(-int((hist * x).sum()) // window)
    half = window // 2
    count, area = np.cumsum(hist), np.cumsum(hist * x)
    a = np.arange(1, half + 1)
    big = count[-1] - count[window - a]
    mid = count[window - a] - count[half]
    mid_area, small_area = area[window - a] - area[half], area[half] - area[a - 1]
    best = max(best, int((big + mid + np.maximum(0, -((mid * window - mid_area - small_area) // window))).max()))
    for k in range(1, 32):
        up = (k + 1) * x
        f = np.where(up % window == 0, x * k, up // window * window)  # scaled by k
        best = max(best, -(-int((hist * f).sum()) // (window * k)))
    return best


def _packer(window: int, keep_open: int | None, round_no: int):
    """Packs one partition by best-fit decreasing and certifies it: ``certified`` if it has no more bins than its own bound."""

    def run(key, table):
        n = table.num_rows
        lengths = table.column("length").to_numpy()
        order = np.argsort(table.column("uid").to_numpy(), kind="stable")
        bins = np.empty(n, np.int64)
        bins[order] = best_fit_decreasing(lengths[order], window)
        used = np.bincount(bins, lengths).astype(np.int64)
        certified = len(used) <= lower_bound(np.bincount(lengths, minlength=window + 1))
        gaps = np.flatnonzero(used < window)
        loose = gaps[np.argsort(used[gaps], kind="stable")][:keep_open]
        is_open = np.zeros(len(used), bool)
        is_open[loose] = True
        by = np.lexsort((table.column("uid").to_numpy(), bins))
        upto = np.cumsum(lengths[by])
        first = np.searchsorted(bins[by], np.arange(len(used)))
        offset = np.empty(n, np.int64)
        offset[by] = upto - lengths[by] - (upto - lengths[by])[first][bins[by]]
        base = (round_no << 48) | (key[0].as_py() << 26)
        out = table.drop_columns(["grp"])
        for name, col in (("sequence_id", base + bins), ("offset", offset), ("is_open", is_open[bins]), ("certified", np.full(n, certified))):
            out = out.append_column(name, pa.array(col))
        return out
    return run


def pack_documents(
    docs: DataFrame, window: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False, group_pieces: int = 20_000, keep_open: int | None = None,
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then ``end_id``; only longer ones are cut, into pieces of ``window`` ids and a rest.
    Null text counts as empty and gives the end id alone; repeated rows are documents of their own, and null
    ``doc_id`` stays null. ``with_ids`` adds the ids as bytes. An empty table gives no row; other columns are ignored.

    Pieces are dealt at random into partitions of about ``group_pieces``, each packed by best-fit decreasing. Dual
    feasible functions give each partition a bound on its bins. A partition that meets its bound is certified: its packing stands and isn't
    opened again while others exchange. The others open their bins with a gap (at most ``keep_open`` of the least filled ones,
    if given), and the pieces in them are dealt and packed anew, until every partition is certified or a round saves
    no bin, whose packing is then the one before it. The same functions bound the bins that all pieces need. Only if
    the whole packing has more than that, the certified partitions' bins with a gap join one more such exchange among all.
    """
    cols = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _PIECE.format(id=cols.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    left = written(cols.mapInArrow(_pieces(window, end_id, tokenizer_path, with_ids), schema), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for r in left.groupBy("length").count().toLocalIterator():  # at most one row a length
        hist[r["length"]] = r["count"]
    bound, n = lower_bound(hist), int(hist.sum())
    names = [c for c in left.columns if c != "uid"]
    if not n:
        return left.select(*names, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    out_schema = f"{schema}, sequence_id long, offset long, is_open boolean, certified boolean"
    held = _Pool()  # bins with gaps of certified partitions
    pool, settled, closed, among_all, round_no = _Pool([left], n, None), [], 0, False, 0
    while pool.pieces:
        groups = -(-pool.pieces // group_pieces)
        dealt = pool.rows().select("uid", *names).withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)))
        packed = written(dealt.groupBy("grp").applyInArrow(_packer(window, keep_open, round_no), out_schema), "packed")
        told = packed.groupBy("is_open", "certified").agg(F.countDistinct("sequence_id").alias("b"), F.count("*").alias("n")).collect()
        bins = {(r["is_open"], r["certified"]): (r["b"], r["n"]) for r in told}
        if pool.bins is None or sum(b for b, _ in bins.values()) < pool.bins:
            settled.append(packed.where("not is_open"))
            closed += sum(b for (is_open, _), (b, _) in bins.items() if not is_open)
            mine = _Pool([packed.where("is_open and certified")], bins.get((True, True), (0, 0))[1], bins.get((True, True), (0, 0))[0])
            pool = _Pool([packed.where("is_open and not certified")], bins.get((True, False), (0, 0))[1], bins.get((True, False), (0, 0))[0])
            if among_all:
                pool = pool.plus(mine)
            else:
                held = held.plus(mine)
            stuck = not pool.pieces or groups == 1
        else:
            stuck = True  # nothing saved: what was packed before stands
        round_no += 1
        if closed + held.bins + pool.bins <= bound or stuck and (among_all or not held.pieces):
            break
        if stuck:
            pool, held, among_all = pool.plus(held), _Pool(), True
    done = None
    for part in [*settled, *held.parts, *pool.parts]:
        part = part.select(*names, "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
    return done


@dataclass
class _Pool:
    """Pieces that lie in bins with gaps: tables, number of pieces, number of bins (None before the first packing)."""

    parts: list[DataFrame] = field(default_factory=list)
    pieces: int = 0
    bins: int | None = 0

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def plus(self, other: _Pool) -> _Pool:
        return _Pool(self.parts + other.parts, self.pieces + other.pieces, self.bins + other.bins)
