"""Removal of repeated substrings by a distributed, hash-compared suffix sort.

Texts are UTF-8 bytes. A byte goes if a LENGTH-byte string that covers it also starts earlier: in a smaller doc_id, or in the
same document at an earlier start. Judged on the input, exactly.

Which suffixes must be compared: each LENGTH-byte window has an anchor, the least of its GRAM-byte hashes (leftmost of equal
ones), so equal windows have equal anchors at equal offsets, and on average 35 windows in a row share one. An anchor
occurrence is described by the hash of its gram and that of the whole span of its windows. Occurrences with equal spans, by
their hashes and then byte by byte, are settled by that: all but the earliest go. Only where one gram stands in different
spans, at the ends of repeats, are suffixes sorted: a mergesort in which two suffixes are compared in logarithmic time, by a
binary search for their common extension over polynomial prefix hashes. Neighbours with a common extension of LENGTH are one class, verified byte by byte; all
but its earliest go.

At scale: anchors are pre-aggregated in each block of the scan (an occurrence with an earlier equal one in the block is
settled there, while the block's texts are at hand), then shuffled as packed columns by gram. A gram with very many spans is
split: the offsets of its windows are dealt into PIECES ranges, and an occurrence goes, for each range, to the sort of the bytes
that all windows of the range have in common. Equal windows have those bytes, so they still meet. Texts without repeats never leave the scan; which those are is told by a bit map of fixed size, whose false hits
cost time only, or by a join where half of its bits are set.

Nulls are empty texts, and texts under LENGTH bytes have no windows. A null doc_id comes before all others. Rows of one doc_id
with different texts are ordered by the hash of the text; rows that repeat both are one document, judged once, and each has
its result. An empty table gives an empty result; further columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.common import bucketed, cut, drop_cut, free_names, partitions, release, table, trim, utf8

LENGTH, GRAM = 100, 32
#: Bytes of a text worked on at a time; positions within fit in 20 bits.
CHUNK = 1 << 19
#: Anchors that a scan task gathers before it sends them.
FLUSH = 1 << 17
#: Bits of a span's hash. Fewer cost time only: bytes decide.
SPAN_BITS = 48
#: Windows sorted at a time, but for those of one gram at one offset.
WINDOWS = 1 << 16
#: Spans of one gram in a scan task's block, or its occurrences in all, from which the gram is split.
HOT, SPLIT = 512, 1 << 14
#: Ranges of offsets that a split gram's windows are dealt into.
PIECES = 8
#: Bytes of spans that a task gathers before it sends them.
SPANS = 8 << 20
#: Bits of the map of documents with repeats.
MAP_BITS = 1 << 24


def _random(n: int, name: bytes) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(name + b"%d" % i).digest()[:8], "little") for i in range(n)], np.uint64)


class Prefix:
    """Polynomial prefix hashes modulo 2**64 with random values for bytes; the hash of any range in a step or two."""

    tables: dict[bytes, tuple[np.ndarray, np.uint64, np.uint64]] = {}
    powers: dict[tuple[bytes, bool], np.ndarray] = {}

    def __init__(self, data: np.ndarray, name: bytes = b"one"):
        if name not in self.tables:
            base = int(_random(1, name + b" base")[0]) | 1
            self.tables[name] = _random(256, name + b" byte"), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        values, base, inverse = self.tables[name]
        n = len(data)
        self.back = self._power(name, True, inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * self._power(name, False, base, n + 1)[:n], out=self.sums[1:])

    def _power(self, name: bytes, back: bool, base: np.uint64, n: int) -> np.ndarray:
        have = self.powers.get((name, back))
        if have is None or len(have) < n:
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
            self.powers[name, back] = have
        return have

    def of(self, a, b) -> np.ndarray:
        """Hashes of the ranges [a, b)."""
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def sliding(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays (gram hash, span hash, position, first window, last window), a row for each anchor of a text's windows."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        prefix = Prefix(part)
        grams = mix(prefix.sliding(gram))
        low = np.uint64((1 << 20) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least, width, need = keys, 1, length - gram + 1
        while 2 * width <= need:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < need:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        pos = place[first]
        span = mix(prefix.of(first, last + length) ^ mix(((pos - first) * 256 + last - first).astype(np.uint64)))
        # least hashes are small numbers; mixed anew they spread over the buckets evenly
        out.append((mix(grams[pos] + np.uint64(0x632BE59BD9B4E019)), span, pos + at, first + at, last + at))
    return [np.concatenate(x) for x in zip(*out)] if out else None


_ANCHOR = [("h", "<u8", 6), ("s", "<u8", 6), ("doc", "<i8", 8), ("pos", "<u4", 4), ("back", "u1", 1), ("ahead", "i1", 1)]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c, d).view(np.uint8).reshape(len(c), -1)[:, :w].T).tobytes() for c, (_, d, w) in zip(columns, _ANCHOR)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(columns[0])) + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(data[:8].view("<i8")[0]), 8, []
    for _, d, w in _ANCHOR:
        full = np.zeros((n, np.dtype(d).itemsize), np.uint8)
        full[:, :w] = data[at : at + n * w].reshape(w, n).T
        out.append(full.reshape(-1).view(d))
        at += n * w
    return out


#: salt: 0, or in a split gram what stands for the bytes that its windows share; split: whether the gram is.
_FINE = np.dtype([("h", "<u8"), ("s", "<u8"), ("salt", "<u4"), ("split", "u1"), ("pos", "<u4"), ("back", "u1"), ("ahead", "i1")])
_META = "<QQIBIBb"


def _rows(kind: int, docs: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """A row for each element of data."""
    width = data.dtype.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    blob = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(data), kind, np.int32)), pa.array(docs.astype(np.int64)), blob], ["kind", "doc", "data"])


def union_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the ranges [a, b)."""
    order = np.argsort(a, kind="stable")
    a, upto = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > upto[:-1]))
    return a[new], upto[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]


def _ranges(docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A row for each document, with its ranges as pairs of 64-bit numbers."""
    order = np.lexsort((a, docs))
    docs, a, b = docs[order], a[order].astype(np.int64), b[order].astype(np.int64)
    # neighbours that follow or overlap are one range, without a look across documents
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (a[1:] > b[:-1]))) if len(docs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    a, b, docs = a[at], np.maximum.reduceat(b, at) if len(at) else b, docs[at]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    offsets = np.concatenate((first, [len(docs)])).astype(np.int32) * 16
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.column_stack((a, b)).astype("<i8").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int32)), pa.array(docs[first].astype(np.int64)), blob], ["kind", "doc", "data"])


def _order(h, s, doc, pos, *rest):
    """The columns in the order of h, s and place, each occurrence once."""
    order = np.lexsort((pos, doc, s, h))
    columns = [x[order] for x in (h, s, doc, pos, *rest)]
    return [x[np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)))] for x in columns] if len(order) else columns


def _settled(group: np.ndarray, back: np.ndarray, ahead: np.ndarray, span) -> np.ndarray:
    """Which occurrences have the bytes, span(i), of the first of their group: groups stand together, each in the order of
    places. One whose hashes are equal but not its bytes is not settled."""
    new = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = ~new & (back == back[head]) & (ahead == ahead[head])
    at = np.flatnonzero(out)
    out[at] = [span(i) == span(j) for i, j in zip(at.tolist(), head[at].tolist())]
    return out


def _scan(buckets: int, length: int, hot_spans: int, span_bits: int = SPAN_BITS):
    """Of a block of texts: packed anchors by bucket (kind 1), ranges (kind 0) and occurrences of hot grams (kind 2)."""

    def send(held, texts):
        *first, base = _order(*(np.concatenate(x) for x in zip(*held)))
        h, s, doc, pos, back, ahead = first
        data, at = b"".join(texts), pos.astype(np.int64)
        a, b = (base + at - back).tolist(), (base + at - ahead + length).tolist()
        again = _settled(np.cumsum(np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))), back, ahead, lambda i: data[a[i] : b[i]])
        if again.any():
            yield _ranges(doc[again], (at - back)[again], (at - ahead)[again] + length)
        first = [x[~again] for x in first]
        h = first[0]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        group = np.cumsum(new) - 1
        hot = np.bincount(group)[group] > hot_spans
        if hot.any():
            x = [c[hot] for c in first]
            fine = np.zeros(len(x[0]), _FINE)
            fine["h"], fine["s"], fine["split"], fine["pos"], fine["back"], fine["ahead"] = x[0], x[1], 1, x[3], x[4], x[5]
            yield _rows(2, x[2], fine)
            mark = hot & new
            marks = [np.where(mark, v, c)[mark | ~hot] for c, v in zip(first, (h, np.uint64(0), first[2], first[3], np.uint8(0), np.int8(-128)))]
            first = marks
        bucket = (((first[0] >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        edges = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)])).tolist() if len(bucket) else [0]
        packed = [(int(bucket[a]), pack([c[a:b] for c in first])) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(packed), pa.int32()), pa.array([k for k, _ in packed], pa.int64()), pa.array([p for _, p in packed], pa.binary())], ["kind", "doc", "data"])

    def run(batches):
        held, texts, n, base = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("t")):
                found = anchors(np.frombuffer(text.as_buffer(), np.uint8), length)
                if found is None:
                    continue
                h, s, pos, first, last = found
                held.append((h >> np.uint64(16), s >> np.uint64(64 - span_bits), np.full(len(h), doc, np.int64), pos.astype(np.uint32), (pos - first).astype(np.uint8), (pos - last).astype(np.int8), np.full(len(h), base, np.int64)))
                texts.append(text.as_py())
                base += len(texts[-1])
                n += len(h)
                if n >= FLUSH:
                    yield from send(held, texts)
                    held, texts, n, base = [], [], 0, 0
                    trim()
        if n:
            yield from send(held, texts)
        trim()

    return run


def _meet(split_spans: int):
    """Of a bucket's packed anchors: those of grams that occur again, to be compared by their bytes (kind 2)."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        blobs = [x for x, k in zip(group.column("data").to_pylist(), group.column("kind").to_pylist()) if k == 1]
        kept = group.filter(pa.compute.not_equal(group.column("kind"), 1)).select(["kind", "doc", "data"])
        if blobs:
            h, s, doc, pos, back, ahead = (np.concatenate(x) for x in zip(*map(unpack, blobs)))
            marks = ahead == -128
            split = np.unique(h[marks])
            h, s, doc, pos, back, ahead = _order(*(x[~marks] for x in (h, s, doc, pos, back, ahead)))
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            group_of = np.cumsum(new) - 1
            size = np.bincount(group_of)[group_of] if len(h) else np.zeros(0, np.int64)
            told = np.isin(h, split)
            many = (size > 1) | told
            fine = np.zeros(int(many.sum()), _FINE)
            fine["h"], fine["s"], fine["split"] = h[many], s[many], (told | (size > split_spans))[many]
            fine["pos"], fine["back"], fine["ahead"] = pos[many], back[many], ahead[many]
            out.append(_rows(2, doc[many], fine))
        trim()
        return pa.concat_tables([kept, *[pa.Table.from_batches([x]).cast(kept.schema) for x in out]])

    return run


class Suffixes:
    """Suffixes of a buffer, compared over `length` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = np.concatenate((data, np.zeros(length, np.uint8))), length
        self.prefix = Prefix(self.data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes, `length` at most, the suffixes at i and j have in common: a binary search."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length, np.int64)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) // 2
            same = self.prefix.of(i, i + mid) == self.prefix.of(j, j + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        whole = n >= self.length
        n = np.minimum(n, self.length - 1)
        return np.where(whole, or_equal, self.data[i + n] < self.data[j + n])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A stable mergesort of the suffixes `at` within segments, which stand together: the order as indexes. All merges
        of a round are done together; an element's place is its own rank plus its rank in the other run."""
        order, n = np.arange(len(at)), len(at)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        sizes = np.diff(np.concatenate((first, [n])))
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            todo = np.flatnonzero(size > width)
            rank = todo - start[todo]
            base = start[todo] + rank // (2 * width) * (2 * width)
            right = rank // width % 2 == 1
            end = start[todo] + size[todo]
            low = np.where(right, base, np.minimum(base + width, end))
            high = np.where(right, base + width, np.minimum(base + 2 * width, end))
            stop, mine, other = low.copy(), at[order[todo]], low.copy()
            lo, hi = low, high
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                before = self.less(at[order[mid]], mine[open_], right[open_])
                lo[open_[before]] = mid[before] + 1
                hi[open_[~before]] = mid[~before]
                open_ = open_[lo[open_] < hi[open_]]
            other = lo - stop
            own = todo - np.where(right, np.minimum(base + width, end), base)
            then = order.copy()
            then[base + own + other] = order[todo]
            order, width = then, 2 * width
        return order


def classes(data: np.ndarray, at: np.ndarray, segment: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order within segments, and where in it a new class of equal `length`-byte strings starts. Elements of a
    class keep their order. Equal hashes are verified byte by byte; a collision is settled by the bytes."""
    suffixes = Suffixes(data, length)
    order = suffixes.sort(at, segment)
    i, j = at[order[:-1]], at[order[1:]]
    same = (segment[order[:-1]] == segment[order[1:]]) & (suffixes.extension(i, j) >= length)
    check = np.flatnonzero(same)
    for a in range(0, len(check), 1 << 15):
        k = check[a : a + (1 << 15)]
        if (suffixes.data[i[k][:, None] + np.arange(length)] != suffixes.data[j[k][:, None] + np.arange(length)]).any():
            raw = [suffixes.data[x : x + length].tobytes() for x in at.tolist()]
            order = np.array(sorted(range(len(at)), key=lambda x: (segment[x], raw[x])), np.int64)
            return order, np.array([True] + [segment[x] != segment[y] or raw[x] != raw[y] for x, y in zip(order[:-1], order[1:])])
    return order, np.concatenate(([True], ~same)) if len(at) else np.zeros(0, bool)


def _sorted(length: int):
    """Of occurrences with the bytes of their spans: the ranges of windows that some earlier one equals."""

    def part(meta, doc, spans, low=0, high=length):
        """The windows at offsets from low to high from their anchors."""
        data = np.frombuffer(b"".join(spans), np.uint8)
        starts = np.cumsum([0, *map(len, spans)])[:-1]
        pos, back, ahead = (meta[c].astype(np.int64) for c in ("pos", "back", "ahead"))
        skip = np.maximum(back - high, 0)
        n = np.maximum(back - skip - np.maximum(ahead, low) + 1, 0)
        row = np.repeat(np.arange(len(meta)), n)
        if not len(row):
            return
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + skip[row]
        p, at, d = (pos - back)[row] + step, starts[row] + step, back[row] - step
        key = np.lexsort((p, doc[row], d, meta["salt"][row], meta["h"][row]))
        row, p, at, d = row[key], p[key], at[key], d[key]
        h, salt = meta["h"][row], meta["salt"][row]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (d[1:] != d[:-1])))
        segment = np.cumsum(new)
        order, head = classes(data, at, segment, length)
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = (doc[row[order]] != doc[row[lead]]) | (p[order] != p[lead])
        x = order[later]
        yield _ranges(doc[row[x]], p[x], p[x] + length)

    def run(group: pa.Table) -> pa.Table:
        metas, docs, sizes, parts = zip(*map(unpack_spans, group.column("data").to_pylist()))
        meta, doc, spans = np.concatenate(metas), np.concatenate(docs), b"".join(parts)
        upto = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        order = np.lexsort((meta["pos"], doc, meta["s"], meta["salt"], meta["h"]))
        meta, doc, upto, since = meta[order], doc[order], upto[order].tolist(), (upto - np.concatenate(sizes))[order].tolist()
        new = np.flatnonzero(np.concatenate(([True], (meta["h"][1:] != meta["h"][:-1]) | (meta["salt"][1:] != meta["salt"][:-1]))))
        windows = np.cumsum(np.concatenate(([0], meta["back"].astype(np.int64) - meta["ahead"] + 1)))
        out, at, ends = [], 0, np.concatenate((new[1:], [len(meta)])).tolist()
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or windows[ends[k + 1]] - windows[at] > WINDOWS:
                here = [spans[a:b] for a, b in zip(since[at:end], upto[at:end])]
                m, d = meta[at:end], doc[at:end]
                group_of = np.cumsum(np.concatenate(([True], np.any([m[c][1:] != m[c][:-1] for c in ("h", "salt", "s")], axis=0))))
                again = _settled(group_of, m["back"], m["ahead"], here.__getitem__)
                if again.any():
                    p = m["pos"][again].astype(np.int64)
                    out.append(_ranges(d[again], p - m["back"][again], p - m["ahead"][again] + length))
                m, d, here = m[~again], d[~again], [x for x, settled in zip(here, again.tolist()) if not settled]
                n = int((m["back"].astype(np.int64) - m["ahead"] + 1).sum())
                each = max(1, WINDOWS // len(m)) if n > WINDOWS else length
                for low in range(0, length, each):
                    out.extend(part(m, d, here, low, low + each - 1))
                at = end
        trim()
        return pa.Table.from_batches(out, _NOTHING.schema)

    return run


_NOTHING = _rows(0, np.zeros(0, np.int64), np.zeros(0, _FINE))


def _pieces(h: int, split: int, pos: int, back: int, ahead: int, text: bytes, length: int):
    """(salt, back, ahead) of the parts in which an occurrence is sorted."""
    if not split:
        yield 0, back, ahead
        return
    most = length - GRAM + 1
    for k in range(PIECES):
        low, high = most * k // PIECES, most * (k + 1) // PIECES - 1
        if max(ahead, low) <= min(back, high):
            shared = text[pos - low : pos - high + length]
            yield xxhash.xxh32_intdigest(shared, k), min(back, high), max(ahead, low)


def pack_spans(metas: list[bytes], docs: list[int], spans: list[bytes]) -> bytes:
    sizes = np.array([len(x) for x in spans], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(b"".join((struct.pack("<q", len(spans)), *metas, np.array(docs, "<i8").tobytes(), sizes.tobytes(), *spans)))


def unpack_spans(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    width = _FINE.itemsize
    at = 8 + n * width
    return np.frombuffer(data, _FINE, n, 8), np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n), data[at + 12 * n :]


_KINDS = "kind int, doc long, data binary"


def _numbered(docs: DataFrame, doc: str, spent: list[DataFrame]) -> DataFrame:
    """docs with a column `doc`, a number in the order of documents: doc_id where each row has its own, else one made for it."""
    clash = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if clash.isEmpty():
        return docs.withColumn(doc, F.col("doc_id").cast("long"))
    key, of, id_ = free_names(docs, "key", "of", "id")
    keyed = docs.withColumn(key, F.sha2(utf8("text"), 256))
    ids = keyed.select(F.col("doc_id").alias(id_), F.col(key).alias(of)).distinct().orderBy(F.asc_nulls_first(id_), of)
    ids = cut(ids.withColumn(doc, F.monotonically_increasing_id()), "ids")
    spent += [ids, numbered := cut(keyed.join(ids, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(of))).drop(key, id_, of), "numbered")]
    return numbered


def _bit(docs: np.ndarray) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)


def _marks(batches):
    """The words of the map that this partition's documents set, each once."""
    words = np.zeros(MAP_BITS // 64, np.uint64)
    for batch in batches:
        bits = _bit(batch.column("doc").to_numpy())
        np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])


class Repeats:
    """What a corpus repeats: `rest`, rows without any; `flagged`, rows with some or falsely marked; `ranges`, of each
    document with repeats the ranges to remove."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, hot: int = HOT, split: int = SPLIT, span_bits: int = SPAN_BITS, filled: float = 0.5):
        if length <= GRAM or length - GRAM > 120:
            raise ValueError("length must be from 33 to 152")
        spark, spent = docs.sparkSession, []
        self.doc, self.found, there = free_names(docs, "doc", "ranges", "there")
        docs = _numbered(docs, self.doc, spent)
        rows = docs.select(F.col(self.doc).alias("doc"), utf8("text").alias("t"))
        parts = rows.rdd.getNumPartitions()
        # few rows for each block of the scan while there are few blocks; then a bucket for each, so that none outgrows a task
        buckets = max(64, min(4 * parts, 60_000), parts)
        sent = rows.mapInArrow(_scan(buckets, length, hot, span_bits), _KINDS)
        sent = sent.withColumn("to", F.when(F.col("kind") == 1, F.col("doc")).otherwise(F.pmod(F.xxhash64("doc"), F.lit(buckets))))
        met = cut(sent.groupBy("to").applyInArrow(_meet(split), _KINDS), "met")
        release(spark)

        marks = met.select("doc").mapInArrow(_marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(MAP_BITS // 64, np.uint64)
        words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
        if int(np.bitwise_count(words).sum()) > filled * MAP_BITS:
            ids = met.select(F.col("doc").alias(there)).distinct()
            marked = cut(docs.join(ids, F.col(self.doc) == F.col(there), "left"), "marked")
            self.rest = marked.where(F.col(there).isNull()).drop(there)
            flagged = marked.where(F.col(there).isNotNull()).drop(there)
        else:
            held, key = spark.sparkContext.broadcast(words), self.doc

            def pick(marked: bool):
                def run(batches):
                    for batch in batches:
                        bits = _bit(batch.column(key).to_numpy())
                        on = (held.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
                        yield batch.filter(pa.array((on == 1) == marked))

                return run

            self.rest = docs.mapInArrow(pick(False), docs.schema)
            flagged = docs.mapInArrow(pick(True), docs.schema)
        # texts are dealt out once, for the two joins that need them
        self.flagged = bucketed(flagged, self.doc, max(parts, partitions(spark)), "flagged")
        release(spark)

        want = met.where("kind = 2").groupBy("doc").agg(F.collect_list("data").alias("want"))
        texts = self.flagged.select(F.col(self.doc).alias("doc"), utf8("text").alias("t")).dropDuplicates(["doc"])

        def extract(batches):
            held, size = {}, 0
            for batch in batches:
                for doc, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "want"))):
                    for x in np.frombuffer(b"".join(want), _FINE):
                        h, s, _, split, pos, *edges = x.tolist()
                        for salt, back, ahead in _pieces(h, split, pos, *edges, text, length):
                            to = held.setdefault((h * 31 + salt * 7919) % buckets, ([], [], []))
                            to[0].append(struct.pack(_META, h, s, salt, split, pos, back, ahead))
                            to[1].append(doc)
                            to[2].append(text[pos - back : pos - ahead + length])
                            size += length + back - ahead
                    if size > SPANS:
                        yield sent_spans(held)
                        held, size = {}, 0
            if held:
                yield sent_spans(held)
            trim()

        def sent_spans(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pack_spans(*x) for x in held.values()], pa.binary())], ["to", "data"])

        spans = texts.join(want, "doc").mapInArrow(extract, "to long, data binary")
        fine = cut(spans.groupBy("to").applyInArrow(_sorted(length), _KINDS), "sorted")
        release(spark)
        ranges = met.where("kind = 0").select("doc", "data").union(fine.select("doc", "data"))
        self.ranges = cut(ranges.groupBy("doc").agg(F.collect_list("data").alias("ranges")), "ranges")
        drop_cut(met, fine)
        self.spent = spent

    def judged(self) -> DataFrame:
        """The flagged rows with their ranges in the column `found`, null where there are none."""
        doc = f"{self.doc}_k"
        return self.flagged.join(self.ranges.toDF(doc, self.found), F.col(self.doc) == F.col(doc), "left").drop(doc)


def runs_of(ranges: list[bytes] | None) -> list[tuple[int, int]]:
    if not ranges:
        return []
    pairs = np.frombuffer(b"".join(ranges), "<i8").reshape(-1, 2)
    a, b = union_of(pairs[:, 0], pairs[:, 1])
    return list(zip(a.tolist(), b.tolist()))


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _digest(batches):
    for batch in batches:
        rows = []
        ranges = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * batch.num_rows
        for text, found in zip(batch.column("t").to_pylist(), ranges):
            runs = runs_of(found)
            rows.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest()))
        n, removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with what repeats cut out of text. A character of which some bytes go goes whole. Null texts stay null."""
    found = Repeats(docs, length)
    ranges_of, key = found.found, found.doc
    kind = [f for f in docs.schema.fields if f.name == "text"][0].dataType

    def edit(batches):
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column(ranges_of).to_pylist()):
                runs = runs_of(ranges)
                texts.append(without(text.encode(), runs).decode("utf-8", "ignore") if runs else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns([ranges_of, key])

    assert kind.simpleString() == "string"
    return found.rest.drop(key).union(found.judged().mapInArrow(edit, docs.schema))


def digests(found: Repeats) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = found.rest.select("doc_id", utf8("text").alias("t")).mapInArrow(_digest, schema)
    return whole.union(found.judged().select("doc_id", utf8("text").alias("t"), F.col(found.found).alias("ranges")).mapInArrow(_digest, schema))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(Repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier document or place has; a document of which nothing is left goes. n_chars follows."""
    text = deduplicate(docs)
    left = text.where("text is null or text <> ''")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
