"""Media columns: payloads in ISO base media containers, read by walking boxes and sample tables.

The writer stores bytes as 8-bit samples of one uncompressed track: ftyp, moov with its nested boxes, mdat. The reader
needs only the boxes: of each track it finds codec, duration, where each sample lies, when it is shown and which samples are
keyframes, and gives byte ranges without decoding a payload. It takes any order of boxes, 64-bit box sizes, boxes that run to
the end, both offset tables, uniform, listed and compact sample sizes, decoding and composition times, edit lists, and files
with several tracks or none. A keyframe's time is that of its presentation, in units of the track's timescale. Memory is
bounded by the file: a table must lie within its box, samples within the file, and no count is believed before.

Null text counts as empty. A payload is never empty: it is padded with bytes 0 to a positive multiple of 64. Rows are
independent, so ties and repeated rows give equal values, an empty table an empty result, and further columns are ignored.
A broken container raises ValueError from read_container; probe_media() gives null instead, and replaces a column `media` (read from one, it
stays under a free name).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailquarry.llm.common import free_names, table, utf8

UNIT = 64
TIMESCALE = 8000
#: Samples in a chunk; the first of each is a keyframe.
CHUNK = 16
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes, unit: int = UNIT, timescale: int = TIMESCALE) -> bytes:
    """A container whose one track holds the payload, a multiple of `unit` bytes, as 8-bit samples in groups of `unit`."""
    n, rest = divmod(len(payload), unit)
    if rest or not n:
        raise ValueError("the payload is not a positive multiple of the unit")
    chunks = -(-n // CHUNK)
    short = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if short == CHUNK else ([(1, CHUNK, 1)] if chunks > 1 else []) + [(chunks, short, 1)]
    duration = n * unit
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, timescale << 16))

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, unit)),
            _full(b"stss", struct.pack(f">{chunks + 1}I", chunks, *range(1, n + 1, CHUNK))),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">3I", *r) for r in runs]),
            _full(b"stsz", struct.pack(">2I", unit, n)),
            _full(b"stco", struct.pack(f">{chunks + 1}I", chunks, *range(first, first + len(payload), CHUNK * unit))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4IHH", 0, 0, timescale, duration, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, duration), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">4IIH", 0, 0, timescale, duration, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    first = len(ftyp) + len(moov(0)) + 8
    if first + len(payload) >= 1 << 32:
        raise ValueError("the payload needs 64-bit offsets")
    return b"".join((ftyp, moov(first), struct.pack(">I4s", 8 + len(payload), b"mdat"), payload))


def walk(data: bytes, most: int = 32):
    """(path, start, end) of each box's content, parents before children, `most` levels deep at most."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        at, end, path = todo.pop()
        if at == end:
            continue
        if end - at < 8:
            raise ValueError(f"a box header at {at} is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"a box header at {at} is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"the box at {at} does not fit")
        here = (*path, kind)
        yield here, at + head, at + size
        todo.append((at + size, end, path))
        if kind in _PARENTS:
            if len(here) > most:
                raise ValueError(f"the box at {at} is nested too deep")
            todo.append((at + head, at + size, here))


class Track:
    """A track's tables. Samples are numbered from 0; nothing is kept for each but what the file lists."""

    def __init__(self, data: bytes, box: dict[bytes, tuple[int, int]], movie_scale: int):
        self.data, self.box = data, box
        at, _ = box[b"mdhd"]
        self.timescale, self.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">2I", data, at + 12)
        self.codec = bytes(data[box[b"stsd"][0] + 12 : box[b"stsd"][0] + 16]).decode("latin-1")
        self._read_sizes()
        self._read_chunks()
        self.decoding = self._runs(b"stts", ">u4") if b"stts" in box else None
        self.composed = self._runs(b"ctts", ">i4" if b"ctts" in box and data[box[b"ctts"][0]] else ">u4") if b"ctts" in box else None
        self.shift = self._edits(movie_scale)
        if b"stss" in box:
            (n,) = struct.unpack_from(">I", data, box[b"stss"][0] + 4)
            self.keys = self._table(b"stss", 8, n, ">u4").astype(np.int64) - 1
            if len(self.keys) and not (0 <= self.keys.min() and self.keys.max() < self.n):
                raise ValueError("a keyframe is not a sample")
        else:
            self.keys = np.arange(self.n)

    def _table(self, kind: bytes, skip: int, count: int, dtype: str) -> np.ndarray:
        at, end = self.box[kind]
        if at + skip + count * np.dtype(dtype).itemsize > end:
            raise ValueError(f"the table {kind!r} does not fit its box")
        return np.frombuffer(self.data, dtype, count, at + skip)

    def _read_sizes(self) -> None:
        self.sums = None
        if b"stsz" in self.box:
            self.uniform, self.n = struct.unpack_from(">2I", self.data, self.box[b"stsz"][0] + 4)
            if self.uniform:
                if self.n * self.uniform > len(self.data):
                    raise ValueError("more samples than bytes")
                return
            sizes = self._table(b"stsz", 12, self.n, ">u4")
        else:
            field, self.n = struct.unpack_from(">II", self.data, self.box[b"stz2"][0] + 4)
            if field == 4:
                packed = self._table(b"stz2", 12, -(-self.n // 2), "u1")
                sizes = np.column_stack((packed >> 4, packed & 15)).reshape(-1)[: self.n]
            elif field in (8, 16):
                sizes = self._table(b"stz2", 12, self.n, f">u{field // 8}")
            else:
                raise ValueError(f"sample sizes of {field} bits")
        self.uniform, self.sums = 0, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def _read_chunks(self) -> None:
        kind, dtype = (b"co64", ">u8") if b"co64" in self.box else (b"stco", ">u4")
        (m,) = struct.unpack_from(">I", self.data, self.box[kind][0] + 4)
        self.offsets = self._table(kind, 8, m, dtype).astype(np.int64)
        (k,) = struct.unpack_from(">I", self.data, self.box[b"stsc"][0] + 4)
        runs = self._table(b"stsc", 8, 3 * k, ">u4").reshape(k, 3).astype(np.int64)
        firsts = np.concatenate((runs[:, 0], [m + 1]))
        if k and (firsts[0] != 1 or (np.diff(firsts) <= 0).any()) or not k and m:
            raise ValueError("the chunk table is out of order")
        each = np.repeat(runs[:, 1], np.diff(firsts)) if k else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(each)))
        if self.first[-1] != self.n:
            raise ValueError(f"the chunk table places {self.first[-1]} of {self.n} samples")
        ends = self.offsets + self._before(self.first[1:]) - self._before(self.first[:-1])
        if len(ends) and (self.offsets.min() < 0 or ends.max() > len(self.data)):
            raise ValueError("a sample lies outside the file")

    def _before(self, i: np.ndarray) -> np.ndarray:
        """Bytes of the samples before sample i."""
        return self.sums[i] if self.sums is not None else i * self.uniform

    def _runs(self, kind: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sample, value, sum of values before) of each run of a table of times."""
        (k,) = struct.unpack_from(">I", self.data, self.box[kind][0] + 4)
        counts = self._table(kind, 8, 2 * k, ">u4")[::2].astype(np.int64)
        values = self._table(kind, 8, 2 * k, dtype)[1::2].astype(np.int64)
        upto = np.cumsum(counts)
        if (int(upto[-1]) if k else 0) < self.n:
            raise ValueError(f"the table {kind!r} has too few samples")
        return upto - counts, values, np.cumsum(counts * values) - counts * values

    def _edits(self, movie_scale: int) -> int:
        """What the edit list adds to times: an empty edit delays, the first other edit starts at its media time."""
        if b"elst" not in self.box:
            return 0
        at, _ = self.box[b"elst"]
        (k,) = struct.unpack_from(">I", self.data, at + 4)
        wide = self.data[at] == 1
        edits = self._table(b"elst", 8, k, ">u8,>i8,>u4" if wide else ">u4,>i4,>u4")
        delay = 0
        for length, start, _ in edits.tolist():
            if start >= 0:
                return delay * self.timescale // max(1, movie_scale) - start
            delay += length
        return 0

    def locate(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, size, time) of samples."""
        chunk = np.searchsorted(self.first, i, "right") - 1
        offset = self.offsets[chunk] + self._before(i) - self._before(self.first[chunk])
        time = np.full(len(i), self.shift)
        if self.decoding:
            first, step, base = self.decoding
            run = np.searchsorted(first, i, "right") - 1
            time = time + base[run] + (i - first[run]) * step[run]
        if self.composed:
            first, extra, _ = self.composed
            time = time + extra[np.searchsorted(first, i, "right") - 1]
        return offset, self._before(i + 1) - self._before(i), time

    def keyframes(self) -> list[tuple[int, int, int]]:
        """(offset, size, time) of each keyframe."""
        return list(zip(*(x.tolist() for x in self.locate(self.keys))))

    def payload(self) -> bytes:
        """The samples in order, copied from where the tables say they are."""
        sizes = self._before(self.first[1:]) - self._before(self.first[:-1])
        return b"".join([self.data[o : o + s] for o, s in zip(self.offsets.tolist(), sizes.tolist())])


def read_container(data: bytes) -> list[Track]:
    """The tracks of a file."""
    boxes: list[dict[bytes, tuple[int, int]]] = []
    movie_scale = 0
    try:
        for path, a, b in walk(data):
            if path == (b"moov", b"mvhd"):
                (movie_scale,) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
            elif path[-1] == b"trak":
                boxes.append({})
            elif b"trak" in path and boxes:
                boxes[-1].setdefault(path[-1], (a, b))
        return [Track(data, box, movie_scale) for box in boxes]
    except (KeyError, struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"a track lacks a table or has a broken one: {e}") from e


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


_KEYFRAMES = "array<struct<offset:long,size:long,time:long>>"
PROBED = f"array<struct<track:int,codec:string,timescale:long,duration:long,n_samples:long,keyframes:{_KEYFRAMES}>>"
_FRAME = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])
_FOUND = pa.list_(pa.struct([("track", pa.int32()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(_FRAME))]))


def _frames(track: Track) -> list[dict[str, int]]:
    return [{"offset": o, "size": s, "time": t} for o, s, t in track.keyframes()]


def probe_media(df: DataFrame, column: str) -> DataFrame:
    """df with a column `media`: what the boxes say of each track, null where the container is broken."""
    out = df
    if column == "media":
        (column,) = free_names(df, "media")
        out = df.withColumnRenamed("media", column)
    out = out.drop("media")

    def probe(batches):
        for batch in batches:
            found = []
            for data in batch.column(column).to_pylist():
                try:
                    found.append([{"track": i, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": t.n, "keyframes": _frames(t)} for i, t in enumerate(read_container(data or b""))])
                except ValueError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], [*batch.schema.names, "media"])

    return out.mapInArrow(probe, StructType([*out.schema.fields, *StructType.fromDDL(f"media {PROBED}").fields]))


_COLUMNS = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes {_KEYFRAMES}"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_LONG, _TEXT = pa.int64(), pa.string()
_ARROW = [_LONG, _LONG, _TEXT, _LONG, _LONG, _TEXT, _TEXT, _TEXT, _LONG, _LONG, pa.list_(_FRAME)]


def _stored(batches):
    for batch in batches:
        rows = []
        for text in batch.column("t").to_pylist():
            media = write_container(pad(text))
            track = read_container(media)[0]
            back, frames = track.payload(), _frames(track)
            ranges = ",".join(f"{f['offset']}+{f['size']}" for f in frames)
            feature = f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={track.n};keyframes={len(frames)};ranges_crc32={zlib.crc32(ranges.encode()):08x}"
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, track.codec.strip(), track.timescale, track.duration, frames))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), _ARROW)] if rows else [pa.array([], k) for k in _ARROW]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_NAMES])


def _contained(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([write_container(pad(t)) for t in batch.column("t").to_pylist()], pa.binary())], ["doc_id", "media_bytes"])


def contain(docs: DataFrame) -> DataFrame:
    """(doc_id, media_bytes binary): each text's UTF-8 bytes in a container."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t")).mapInArrow(_contained, "doc_id long, media_bytes binary")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t"))
    return docs.mapInArrow(_stored, f"doc_id long, {_COLUMNS}")


QUERIES = {"op7_media_columns": op7_media_columns}
