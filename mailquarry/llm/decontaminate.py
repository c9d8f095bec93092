"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of digits, lower-cased Latin letters and characters above ASCII. A window is 13 consecutive words of an item,
or the whole of a shorter item that has words. Documents are scanned for windows whose words all occur in the benchmark,
each is looked up by a rolling hash, and each hit is verified word for word.

The set is broadcast only below `max_bytes` of benchmark text. It is held in flat arrays, at most 12 bytes for each byte of
text in the driver and in each Python worker (60 while it is built). A larger benchmark is dealt into blocks by
item, each under the bound unless one item alone is over it, and the documents are scanned once for each block, one block
after the other. Null or word-less texts have no words and are never contaminated; a null item_id counts as the string
`null`; items with equal texts are all reported. Repeated rows give equal rows. An empty benchmark hits nothing, an empty
table gives an empty result, and further columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailquarry.llm.common import cut, free_names, table, utf8

N = 13
#: Bytes of benchmark text in one broadcast set.
MAX_BYTES = 2 << 20
_WORD_BYTES = bytes(x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))
_RUN = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _odd(n: int) -> np.ndarray:
    """n odd 64-bit numbers, always the same."""
    return np.array([int.from_bytes(hashlib.sha256(b"window %d" % i).digest()[:8], "little") | 1 for i in range(n)], np.uint64)


class Windows:
    """The windows of some items: by length, sorted hashes, where in the items' words each window stands, and its items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.words = np.concatenate([np.zeros(0, np.int32), *texts])
        starts = np.cumsum([0, *map(len, texts)])
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item, _), ids, start in zip(items, texts, starts.tolist()):
            if size := min(n, len(ids)):
                found.setdefault(size, []).append((np.arange(start, start + len(ids) - size + 1), number[item]))
        self.sets = []
        for size, of in sorted(found.items()):
            at = np.concatenate([x for x, _ in of])
            owner = np.repeat(np.array([i for _, i in of], np.int32), [len(x) for x, _ in of])
            odd = _odd(size)
            hashes = self._hash(self.words, at, odd)
            # by hash and then by words, so that equal windows stand together
            order = np.lexsort((owner, *(self.words[at + k] for k in reversed(range(size))), hashes))
            at, owner, hashes = at[order], owner[order], hashes[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            for k in range(size):
                new[1:] |= self.words[at[1:] + k] != self.words[at[:-1] + k]
            once = new | np.concatenate(([True], owner[1:] != owner[:-1]))
            first = np.flatnonzero(new)
            bounds = np.concatenate(([0], np.cumsum(once)))[np.concatenate((first, [len(at)]))]
            self.sets.append((size, odd, hashes[first], at[first], bounds, owner[once]))

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Of the window at each place."""
        hashes, each = np.zeros(len(at), np.uint64), ids.astype(np.uint64)
        for k in range(len(odd)):
            x = each[at + k]
            hashes += x * x * odd[k] + x * odd[len(odd) - 1 - k]
        return hashes

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, odd, keys, where, bounds, owners in self.sets:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            hashes = self._hash(ids, at, odd)
            place = np.searchsorted(keys, hashes)
            while True:
                # windows of one hash stand together: each is compared, word by word
                live = np.flatnonzero(place < len(keys))
                live = live[keys[place[live]] == hashes[live]]
                if not len(live):
                    break
                at, hashes, place = at[live], hashes[live], place[live]
                same = np.ones(len(at), bool)
                for k in range(size):
                    same &= self.words[where[place] + k] == ids[at + k]
                for k in range(size):
                    hit[at[same] + k] = True
                for w in np.unique(place[same]).tolist():
                    items.update(owners[bounds[w] : bounds[w + 1]].tolist())
                place = place + 1
        return hit, {self.items[i] for i in items}


def _blocks(benchmark: DataFrame, n: int, max_bytes: int):
    """Functions that give Windows, each of about max_bytes of text at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), utf8("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-2 * total // max_bytes) if total > max_bytes else 1

    def block(k: int) -> Windows:
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k)
        return Windows([(r.item, bytes(r.t)) for r in rows.toLocalIterator()], n)

    return [partial(block, k) for k in range(blocks)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", n: int = N, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, n_words, runs, items) for each row of docs (key, text): runs are the maximal [from, to) ranges of hit words."""

    def scanner(windows):
        def run(batches):
            for batch in batches:
                out = []
                for text in batch.column("t").to_pylist():
                    words = words_of(text)
                    hit, items = windows.value.scan(words)
                    out.append((len(words), [{"a": a, "b": b} for a, b in _runs(hit)], sorted(items)))
                counts, runs, items = zip(*out) if out else ((), (), ())
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], ["k", "n_words", "runs", "items"])

        return run

    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("k"), utf8("text").alias("t"))
    blocks = _blocks(benchmark, n, max_bytes)
    if len(blocks) > 1:
        rows = rows.withColumn("k", F.struct("k", F.sha2("t", 256).alias("of")))
    schema = StructType([rows.schema["k"], *StructType.fromDDL("n_words long, runs array<struct<a:long,b:long>>, items array<string>").fields])
    if len(blocks) == 1:
        return rows.mapInArrow(scanner(context.broadcast(blocks[0]())), schema).withColumnRenamed("k", key)
    every = None
    for block in blocks:
        held = context.broadcast(block())
        found = cut(rows.mapInArrow(scanner(held), schema), "hits")
        held.destroy()
        every = found if every is None else every.union(found)
    together = every.groupBy("k", "n_words").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(blocks)).cast("int").alias("rows"))
    start = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")

    def merge(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] <= F.get(done, F.size(done) - 1)["b"]), joined).otherwise(F.concat(done, F.array(x)))

    merged = together.withColumn("runs", F.aggregate("runs", start, merge))
    return merged.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(F.col("k.k").alias(key), "n_words", "runs", "items")


def judge(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words are hit."""
    hits = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    out = scanned.withColumn("n_hit", hits).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text less the ranges of words: each goes from its first word's first byte to its last word's last."""
    data = text.encode()
    spans = [m.span() for m in _RUN.finditer(data.translate(_WORD_BYTES))]
    out, at = [], 0
    for a, b in runs:
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with the hit words of contaminated ones cut out
    (remove="spans"). Nothing is joined or shuffled unless the benchmark needs several blocks: then each different text is
    scanned a block at a time, and what was found is joined back by a hash of the text."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    blocks = _blocks(benchmark, n, max_bytes)
    names, several = free_names(docs, "text_key", "runs"), len(blocks) > 1
    if not several:
        held = docs.sparkSession.sparkContext.broadcast(blocks[0]())
        marked, runs_of = docs, lambda batch: [_contaminating(held.value.scan(words_of((t or "").encode()))[0]) for t in batch.column("text").to_pylist()]
    else:
        found = judge(scan(docs.select(F.sha2(utf8("text"), 256).alias("k"), "text").dropDuplicates(["k"]), benchmark, "k", n, max_bytes))
        found = found.where("contaminated").select(F.col("k").alias(f"{names[0]}_k"), F.col("runs").alias(names[1]))
        keyed = docs.withColumn(names[0], F.sha2(utf8("text"), 256))
        marked, runs_of = keyed.join(found, F.col(names[0]) == F.col(f"{names[0]}_k"), "left").drop(f"{names[0]}_k", names[0]), lambda batch: [[(r["a"], r["b"]) for r in x or []] for x in batch.column(names[1]).to_pylist()]

    def run(batches):
        for batch in batches:
            runs = runs_of(batch)
            if several:
                batch = batch.drop_columns([names[1]])
            if remove == "documents":
                yield batch.filter(pa.array([not x for x in runs], pa.bool_()))
            else:
                texts = [without_runs(t, x) if x else t for t, x in zip(batch.column("text").to_pylist(), runs)]
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return marked.mapInArrow(run, docs.schema)


def _contaminating(hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of hit words, none if they are under a twentieth of the text."""
    return _runs(hit) if hit.any() and 20 * int(hit.sum()) >= len(hit) else []


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
