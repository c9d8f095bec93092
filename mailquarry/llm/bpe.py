"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts each text where its low bits are zero, so a passage that documents share falls
into the same chunks wherever it stands. Encoded alone, the ends of two neighbouring chunks need not be what the whole text
would give; at each join the window from the last point in the left chunk to the first in the right one at which chunk-wise
and whole encoding must agree is encoded anew, as a chunk of its own. Such a point is a space between characters that are
no white space, of any script, or an East Asian stop behind a Chinese character: the pre-tokenizer of byte-level BPE starts a
piece there whatever stands around, and no piece crosses it. Where a chunk has no such point the window grows over it, at worst to the whole text. So the ids are exactly
those of the whole text, however it is cut.

Chunks are shared by all documents of a corpus. A first scan counts their 128-bit hashes, combined in each task before they
are shuffled; a bit map of fixed size tells which occur more than once. In a second scan chunks that do not are encoded where
they stand; the others are gathered by hash, encoded once in the whole cluster, and their ids joined back. A text without
such chunks is finished in the scan; equal texts are one, by a 128-bit hash. The map's false hits cost time only, and where it
fills up more chunks travel.

Chunks of characters below U+0250 without a special token go through a second implementation of the same merges, which is
about three times as fast: on those characters the two read the pre-tokenizer's classes alike, which a test goes through. Any
other chunk, and every chunk if a file's ids are not in the order of its merges, goes through the tokenizers library.

Null counts as the empty text, which has no tokens. Rows are independent: repeated rows give equal rows, an empty table an
empty result, and further columns are ignored. Strings of special tokens in a text become those tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mailquarry.llm.common import cut, release, table, utf8

TOKENIZER = "byte_bpe_50k.json"
#: A chunk has 2 ** CHUNK_BITS bytes on average.
CHUNK_BITS = 11
#: A chunk of fewer bytes, such as the window over a join, costs less to encode again than to fetch.
LEAST = 256
#: Bits of the map of shared chunks.
MAP_BITS = 1 << 24
#: Chunks, or texts, that a task remembers at a time.
FLUSH = 1 << 17
_GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:4], "little") for i in range(256)], np.uint32)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies on this machine: every machine has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Where chunks end: after each byte at which the rolling hash of the last 32 has `bits` low zeros."""
    h, width = _GEAR[data], 1
    while width < 32:
        then = h.copy()
        then[width:] += h[:-width] << np.uint32(width)
        h, width = then, 2 * width
    # the oldest bytes are shifted furthest, so the hash forgets what is over 32 bytes back; its high bits see them all
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


#: White space beyond ASCII, and full stops and commas of East Asian scripts, by the bytes of UTF-8 as numbers.
_SPACES = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_STOPS = np.array([int.from_bytes(c.encode()) for c in "、。！，：；？"])

#: The bytes that those begin with: texts without them, as in Latin and Cyrillic letters, need no closer look.
_LEADS = [bytes([x]) for x in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF)]


def _read(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The bytes from each place as a number, 0 where they reach beyond the ends."""
    out, inside = np.zeros(len(at), np.int64), (at >= 0) & (at + size <= len(data))
    for i in range(size):
        out[inside] = out[inside] << 8 | data[at[inside] + i]
    return out


def safe_points(data: np.ndarray) -> np.ndarray:
    """Where a piece of the pre-tokenizer starts in any context: at a space between characters that are no white space, since
    no piece goes on over it and it leads the piece behind it; and at an East Asian stop behind a Chinese character, since a
    run of letters ends there."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    spaces = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[spaces - 1], data[spaces + 1]
    spaces = spaces[(before > 0x20) & (before != 0x7F) & (after > 0x20) & (after != 0x7F)]
    raw = data.tobytes()
    if not any(lead in raw for lead in _LEADS):
        return spaces
    good = np.ones(len(spaces), bool)
    for near, step in ((np.flatnonzero(data[spaces + 1] >= 0x80), 1), (np.flatnonzero(data[spaces - 1] >= 0x80), -1)):
        for size in (2, 3):
            good[near] &= ~np.isin(_read(data, spaces[near] + (1 if step > 0 else -size), size), _SPACES)
    stops = np.flatnonzero((data == 0xE3) | (data == 0xEF))
    stops = stops[stops >= 3]
    # U+5000 to U+8FFF are letters throughout
    stops = stops[(data[stops - 3] >= 0xE5) & (data[stops - 3] <= 0xE8)]
    stops = stops[np.isin(_read(data, stops, 3), _STOPS)]
    return np.sort(np.concatenate((spaces[good], stops))) if len(stops) else spaces[good]


def segments(data: bytes, bits: int = CHUNK_BITS) -> list[tuple[int, int]]:
    """[from, to) ranges that cover the text: what of each chunk stands on its own, and the windows over the joins."""
    n = len(data)
    grid = np.frombuffer(data, np.uint8)
    cuts, safe = cut_points(grid, bits), safe_points(grid)
    cuts = cuts[cuts < n]
    if not len(cuts):
        return [(0, n)] if n else []
    bounds = np.concatenate(([0], safe, [n]))
    left = bounds[np.searchsorted(bounds, cuts, "right") - 1]
    right = bounds[np.minimum(np.searchsorted(bounds, cuts, "left"), len(bounds) - 1)]
    out, at = [], 0
    for a, b in zip(left.tolist(), right.tolist()):
        if a > at:
            out.append((at, a))
        elif out and a < at:
            a = out.pop()[0]
        else:
            a = at
        if b > a:
            out.append((a, b))
        at = max(at, b)
    if at < n:
        out.append((at, n))
    return out


class Codec:
    """A tokenizer with both implementations."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_truncation()
        self.inner.no_padding()
        self.pieces, self.special, ordered = token_bytes(path)
        self.quick = _merger(self.pieces, self.special) if ordered else None

    def encode_chunks(self, chunks: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of each different chunk, encoded alone."""
        out, rest = {}, []
        for c in dict.fromkeys(chunks):
            text = c.decode()
            if self.quick and (text.isascii() or max(text) < "\u0250") and not any(s in c for s in self.special.values()):
                out[c] = np.array(self.quick(text), "<u4")
            else:
                rest.append((c, text))
        encoded = self.inner.encode_batch_fast([t for _, t in rest], add_special_tokens=False) if rest else []
        return out | {c: np.array(e.ids, "<u4") for (c, _), e in zip(rest, encoded)}

    def encode(self, texts: list[bytes], bits: int = CHUNK_BITS) -> list[np.ndarray]:
        """The ids of whole texts, from their chunks."""
        cuts = [[t[a:b] for a, b in segments(t, bits)] for t in texts]
        ids = self.encode_chunks([c for cs in cuts for c in cs])
        return [np.concatenate([np.zeros(0, "<u4"), *map(ids.__getitem__, cs)]) for cs in cuts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def token_bytes(path: str) -> tuple[list[bytes], dict[int, bytes], bool]:
    """The bytes of each id, those of special tokens, and whether ids are in the order of the merges. In the file a byte is
    written as the character of its code if that is visible Latin-1, else as one of those from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab = said["model"]["vocab"]
    out = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
    special = {t["id"]: t["content"].encode() for t in said["added_tokens"]}
    out |= special
    pairs = (m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"])
    ordered = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and len(vocab) - len(special) <= 256 + len(said["model"]["merges"])
    return [out.get(i, b"") for i in range(max(out) + 1)], special, ordered


def _merger(pieces: list[bytes], special: dict[int, bytes]):
    import public_tokenizers
    import tiktoken

    ranks = {t: i for i, t in enumerate(pieces) if i not in special}
    return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _hash(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(chunk))


def _bits_of(hashes: list[tuple[int, int]]) -> np.ndarray:
    return np.array([c1 for c1, _ in hashes], np.int64).view(np.uint64) % np.uint64(MAP_BITS)


def _counts(batches):
    """(c1, c2, n): how often each chunk occurs in a part of the partition."""
    seen: dict[tuple[int, int], int] = {}

    def send():
        c1, c2 = zip(*seen)
        return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["c1", "c2", "n"])

    for batch in batches:
        for text in batch.column("t").to_pylist():
            for a, b in segments(text):
                if b - a >= LEAST:
                    c = _hash(text[a:b])
                    seen[c] = seen.get(c, 0) + 1
        if len(seen) > FLUSH:
            yield send()
            seen = {}
    if seen:
        yield send()


def _marks(batches):
    """The words of the map that this partition's chunks set."""
    words = np.zeros(MAP_BITS // 64, np.uint64)
    for batch in batches:
        bits = batch.column("c1").to_numpy().view(np.uint64) % np.uint64(MAP_BITS)
        np.bitwise_or.at(words, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])


def _shared(texts: DataFrame) -> np.ndarray:
    """The map of chunks that occur more than once in texts (t)."""
    again = texts.select("t").mapInArrow(_counts, "c1 long, c2 long, n long").groupBy("c1", "c2").agg(F.sum("n").alias("n")).where("n > 1")
    found = again.select("c1").mapInArrow(_marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(MAP_BITS // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


WHOLE, OWN, SHARED, CHUNK = 0, 1, 2, 3
_PIECES = "kind int, t1 long, t2 long, seq int, c1 long, c2 long, data binary"


def _pieces(tokenizer: str, held, finish):
    """Of each different text of a task: what is finished (WHOLE), or its own runs of ids (OWN) and what it takes from shared
    chunks (SHARED); and each shared chunk's bytes (CHUNK)."""

    def run(batches):
        codec, pack, words = _codec(tokenizer_path(tokenizer)), zstandard.ZstdCompressor(level=1).compress, held.value
        texts, chunks = set(), set()
        for batch in batches:
            rows, cuts = [], []
            for t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "t"))):
                if (t1, t2) not in texts:
                    texts.add((t1, t2))
                    cuts.append((t1, t2, [text[a:b] for a, b in segments(text)]))
            known = list(dict.fromkeys(c for _, _, cs in cuts for c in cs))
            hashes = {c: _hash(c) for c in known if len(c) >= LEAST}
            bits = _bits_of(list(hashes.values()))
            on = words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1) == 1
            common = {c for c, x in zip(hashes, on.tolist()) if x}
            ids = codec.encode_chunks([c for c in known if c not in common])
            for t1, t2, cs in cuts:
                if common.isdisjoint(cs):
                    rows.append((WHOLE, t1, t2, 0, None, None, finish(codec, np.concatenate([np.zeros(0, "<u4"), *map(ids.__getitem__, cs)]))))
                    continue
                for is_common, run_ in groupby(enumerate(cs), lambda x: x[1] in common):
                    run_ = list(run_)
                    if not is_common:
                        rows.append((OWN, t1, t2, run_[0][0], None, None, pack(np.concatenate([ids[c] for _, c in run_]).tobytes())))
                    else:
                        rows.extend((SHARED, t1, t2, i, *hashes[c], None) for i, c in run_)
            for c, h in hashes.items():
                if c in common and h not in chunks:
                    chunks.add(h)
                    rows.append((CHUNK, None, None, None, *h, pack(c)))
            if len(texts) > FLUSH or len(chunks) > FLUSH:
                texts, chunks = set(), set()
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _PIECES.split(", ")])

    return run


def _chunk_ids(tokenizer: str):
    def run(batches):
        codec, pack, unpack = _codec(tokenizer_path(tokenizer)), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            chunks = [unpack(x) for x in batch.column("data").to_pylist()]
            ids = codec.encode_chunks(chunks)
            yield pa.RecordBatch.from_arrays([batch.column("c1"), batch.column("c2"), pa.array([pack(ids[c].tobytes()) for c in chunks], pa.binary())], ["c1", "c2", "ids"])

    return run


def _assembled(tokenizer: str, finish):
    def run(batches):
        codec, unpack = _codec(tokenizer_path(tokenizer)), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            done = [finish(codec, np.frombuffer(b"".join([unpack(p["data"]) for p in parts]), "<u4")) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(done, pa.binary())], ["t1", "t2", "data"])

    return run


def _finished(docs: DataFrame, key: str, tokenizer: str, finish) -> DataFrame:
    """(key, data) for each row of docs (key, text): what finish(codec, ids) makes of the ids of the text."""
    t = utf8("text")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2"), t.alias("t"))
    held = docs.sparkSession.sparkContext.broadcast(_shared(rows))
    pieces = cut(rows.select("t1", "t2", "t").mapInArrow(_pieces(tokenizer, held, finish), _PIECES), "pieces")
    release(docs.sparkSession)
    chunks = pieces.where(F.col("kind") == CHUNK).groupBy("c1", "c2").agg(F.any_value("data").alias("data"))
    ids = chunks.mapInArrow(_chunk_ids(tokenizer), "c1 long, c2 long, ids binary")
    place = ["t1", "t2", "seq"]
    taken = pieces.where(F.col("kind") == SHARED).select(*place, "c1", "c2").join(ids, ["c1", "c2"]).select(*place, F.col("ids").alias("data"))
    own = pieces.where(F.col("kind") == OWN).select(*place, "data")
    # each task sends a text's pieces once; what several tasks send is one again before a text's list is made, in one shuffle
    once = own.union(taken).repartition("t1", "t2").groupBy(*place).agg(F.any_value("data").alias("data"))
    parts = once.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    whole = pieces.where(F.col("kind") == WHOLE).groupBy("t1", "t2").agg(F.any_value("data").alias("data"))
    every = whole.union(parts.mapInArrow(_assembled(tokenizer, finish), "t1 long, t2 long, data binary"))
    return rows.select("k", "t1", "t2").join(every, ["t1", "t2"]).select(F.col("k").alias(key), "data")


def encode_documents(docs: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids array<int>) for each row of docs (key, text)."""

    def unpack(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    found = _finished(docs, key, tokenizer, lambda codec, ids: ids.tobytes())
    return found.mapInArrow(unpack, StructType([found.schema[key], StructField("ids", ArrayType(IntegerType()))]))


def decode_documents(encoded: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, text) for each row of encoded (key, ids); null ids count as none."""

    def run(batches):
        codec = _codec(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("text", StringType())]))


def _digest(codec: Codec, ids: np.ndarray) -> bytes:
    """The number of ids, and SHA-256 of the ids and of the text decoded from them."""
    return struct.pack(">q", len(ids)) + hashlib.sha256(ids.tobytes()).digest() + hashlib.sha256(codec.decode(ids).encode()).digest()


def digest_documents(docs: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded, decoded from the ids, and hashed where the ids are."""
    found = _finished(docs, key, tokenizer, _digest)
    number = F.conv(F.hex(F.substring("data", 1, 8)), 16, 10).cast("long")
    return found.select(key, number.alias("n_tokens"), F.lower(F.hex(F.substring("data", 9, 32))).alias("ids_sha256"), F.lower(F.hex(F.substring("data", 41, 32))).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that is left."""
    return digest_documents(docs)


QUERIES = {"op6_bpe": op6_bpe}
