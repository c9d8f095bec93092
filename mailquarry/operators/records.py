"""Deduplication, assembly of archives, and operations on keyed records."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from mailquarry.functions import text as T
from mailquarry.operators import rewriting as W
from mailquarry.shared import bound_batches, written


def signature(c: str, n: int | None = 240) -> Column:
    """The first n characters, or all, in small letters and single spaces."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[ \\t\\r\\n\\f]+", " "))
    return plain if n is None else F.substring(plain, 1, n)


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key: an aggregate, so copies are combined before they are shuffled."""
    columns = [c for c in df.columns if c != order]
    least = F.min_by(F.struct(*columns), F.struct(order, *columns)).alias("r")
    return df.groupBy(key.alias("_key")).agg(F.min(order).alias(order), least).select(order, *[f"r.{c}" for c in columns])


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id of each of docs (doc_id, text) that contains one of the passages (passage). The pieces of a passage between
    spaces, but for the first and the last, are whole pieces of any text that contains it: they meet on the first three of
    those. Passages with fewer are looked for in every text by one automaton for all of them, in blocks of bounded size."""
    pieces = F.split("passage", "\\s+")
    key = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    asked = passages.distinct().withColumn("w", pieces)
    long, short = asked.where(F.size("w") >= 5).select("passage", key(F.col("w"), F.lit(1)).alias("k")), asked.where(F.size("w") < 5).select("passage")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: key(F.col("w"), i))
    # the text stays behind while its pieces are met: only ids travel, and a text is joined back once
    grams = docs.select("doc_id", F.split("text", "\\s+").alias("w")).select("doc_id", F.explode(F.array_distinct(triples)).alias("k"))
    met = grams.join(long, "k").select("doc_id", "passage").distinct().join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id")
    known = docs.where("text is not null")
    empty = known.join(F.broadcast(short.where("passage = ''").limit(1)), F.lit(True)).select("doc_id")
    return met.union(known.where(W.holds_any(short, "text")).select("doc_id")).union(empty).distinct()


def set_classes(rows: DataFrame) -> DataFrame:
    """(id, class) of each row (id, toks) with tokens: class is the least id with an equal token set, the one by which
    similar_sets names the set. Empty sets are like nothing and have no class."""
    sets, _ = written(rows.where(F.size("toks") > 0).select("id", _set_key("toks").alias("k")), "sets")
    return sets.join(sets.groupBy("k").agg(F.min("id").alias("class")), "k").select("id", "class")


def _set_key(toks: str) -> Column:
    """A hash of all of a token set, by which sets are told apart: the tokens stay where they are. Each is led by its length, so
    that no two sets are joined to one text."""
    led = F.transform(F.array_sort(toks), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))
    return F.unhex(F.sha2(F.concat_ws("", led), 256))


#: Hash buckets by whose counts tokens are put in order, and bits of a set's parity.
BUCKETS, BITS = 1 << 18, 1024
#: Tokens of a unit's sets, two of which meet in a cell, and tokens that are compared at a time.
UNIT, STRIP = 1 << 17, 4096


def _profiles(counts: np.ndarray, least: float):
    """Of each set (id, h), h its tokens' hashes: its size, its parity (each token flips a bit), its first tokens in the order of
    counts, but for those no other set has, and how many tokens follow each of them."""

    def run(batches):
        for batch in batches:
            ids, sizes, parities, firsts, lefts = [], [], [], [], []
            for i, h in enumerate(batch.column("h")):
                h = h.values.to_numpy(zero_copy_only=False)
                n = counts[h & (BUCKETS - 1)]
                order = np.lexsort((h, n))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]
                at = np.flatnonzero(n[order] > 1)
                bits = np.bincount((h >> 20) & (BITS - 1), minlength=BITS) & 1
                ids.append(i)
                sizes.append(len(h))
                parities.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                firsts.append(h[order[at]])
                lefts.append((len(h) - at).astype(np.int32))
            if ids:
                lists = [pa.array(x, pa.list_(kind)) for x, kind in ((parities, pa.int64()), (firsts, pa.int64()), (lefts, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), *lists], ["id", "size", "parity", "first", "left"])

    return run


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of distinct token sets (id, toks) with at least that similarity, a < b, once a pair; a and b stand for
    all rows of their classes (set_classes). Sets meet on one of
    their rarest tokens: two that similar share one of the first |s| - ceil(least * |s|) + 1 in any common order, here that of a
    bounded table of counts by hash. At the first one they share, what is left of either must hold all they need in common. Of
    a pair that meets, the parities differ in no more bits than the sets in tokens; whole sets travel only for pairs whose
    parities are near, a set once a unit of such sets and not once a pair, and decide."""
    sets, _ = written(keep_first(rows.where(F.size("toks") > 0).select("id", "toks"), _set_key("toks"), "id").where("id is not null"), "sets")
    hashes = F.transform("toks", lambda t: F.xxhash64(t))
    counted = sets.select(F.explode(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    bound_batches(rows.sparkSession)
    kind = StructType([sets.schema["id"], *StructType.fromDDL("size int, parity array<bigint>, first array<bigint>, left array<int>")])
    profiles, _ = written(sets.select("id", hashes.alias("h")).mapInArrow(_profiles(counts, least), kind), "profiles")
    keyed = profiles.select("id", "size", F.explode(F.arrays_zip("first", "left")).alias("f")).select("id", "size", "f.left", F.col("f.first").alias("t"))
    a, b = keyed.toDF("a", "m", "p", "t"), keyed.toDF("b", "n", "q", "t")
    near = (F.col("m") * least <= F.col("n") + 1e-9) & (F.col("n") * least <= F.col("m") + 1e-9)
    near = near & (F.least("p", "q") >= least / (1 + least) * (F.col("m") + F.col("n")) - 1e-9)
    # a pair meets on many tokens but is compared once
    met = a.join(b, "t").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    parity = profiles.select("id", "size", "parity")
    both = met.join(parity.toDF("a", "m", "x"), "a").join(parity.toDF("b", "n", "y"), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs, _ = written(both.where(apart <= (1 - least) / (1 + least) * (F.col("m") + F.col("n")) + 1e-9).select("a", "b"), "pairs")
    # near sets mostly have one least neighbour in common, or its own least neighbour: they come together once a unit, not once a pair
    homes, _ = written(pairs.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("c")).groupBy("id").agg(F.min("c").alias("c")), "homes")
    for _ in range(4):
        homes, _ = written(homes.join(homes.toDF("c", "up"), "c").select("id", F.col("up").alias("c")), "homes")
    tokens = homes.join(profiles.select("id", "size"), "id").groupBy("c").agg(F.sum("size").alias("n"))
    units = F.xxhash64("c", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / UNIT)))
    homes, _ = written(homes.join(tokens, "c").select("id", units.alias("u")), "units")
    cell = F.xxhash64(F.least("x", "y"), F.greatest("x", "y"))
    dealt, _ = written(pairs.join(homes.toDF("a", "x"), "a").join(homes.toDF("b", "y"), "b").select("a", "b", cell.alias("cell")), "dealt")
    asked = dealt.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "toks"), "id")
    held = asked.groupBy("cell").agg(F.collect_list(F.struct("id", "toks")).alias("s")).select("cell", F.col("s.id").alias("ids"), F.col("s.toks").alias("sets"))
    # hashed by pairs, so that sets are not sorted
    found = dealt.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("p"))
    cells = held.join(found.hint("shuffle_hash"), "cell").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "ids", "sets")
    return cells.mapInArrow(_similarities(least), StructType([*dealt.schema.fields[:2], *StructType.fromDDL("jaccard double")]))


def _similarities(least: float):
    """The pairs of each cell (a, b, ids, sets) that are similar: what two sets share is a product of matrices, a strip of tokens
    at a time."""

    def run(batches):
        for batch in batches:
            for a, b, ids, sets in zip(*[batch.column(c) for c in ("a", "b", "ids", "sets")]):
                lengths = pc.list_value_length(sets.values).to_numpy()
                codes = sets.values.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy()
                rows, shared = np.repeat(np.arange(len(lengths)), lengths), np.zeros((len(lengths), len(lengths)))
                order = np.argsort(codes, kind="stable")
                codes, rows = codes[order], rows[order]
                for at in range(0, int(codes[-1]) + 1, STRIP):
                    i, j = np.searchsorted(codes, [at, at + STRIP])
                    x = np.zeros((len(lengths), STRIP), np.float32)
                    x[rows[i:j], codes[i:j] - at] = 1
                    shared += x @ x.T
                i, j = (pc.index_in(x.values, value_set=ids.values).to_numpy() for x in (a, b))
                jaccard = shared[i, j] / (lengths[i] + lengths[j] - shared[i, j])
                near = pa.array(jaccard >= least)
                yield pa.RecordBatch.from_arrays([x.filter(near) for x in (a.values, b.values, pa.array(jaccard))], ["a", "b", "jaccard"])

    return run


def hash_order(key: Column, seed: int) -> Column:
    """A shuffle that any engine can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, uniformly and without replacement; 0 or less keeps all."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n) if n > 0 else df


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of one key those of new."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, "r.*")


def handles(messages: DataFrame, thread: str, position: str) -> DataFrame:
    """Message handles e1, e2, ... in the order of threads and positions, null threads first. Threads are counted first, so that
    numbers within a thread need only that thread. Whole numbers are put in order in blocks of 4,096; threads of other types in
    ranges of a sorted table, which is written so that the ranges stay."""
    sizes = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(messages.schema[thread].dataType, IntegralType):
        blocks = sizes.withColumn("_b", F.floor(F.col(thread) / 4096))
    else:
        blocks, _ = written(sizes.repartitionByRange(F.col(thread).asc()).withColumn("_b", F.spark_partition_id().cast("long")), "threads")
    base = blocks.groupBy("_b").agg(F.sum("_n").alias("_m")).select(F.col("_b").alias("_kb"), (F.sum("_m").over(Window.orderBy("_b")) - F.col("_m")).alias("_base"))
    inner = F.sum("_n").over(Window.partitionBy("_b").orderBy(thread)) - F.col("_n")
    starts = blocks.withColumn("_in", inner).join(base, F.col("_b").eqNullSafe(F.col("_kb"))).select(F.col(thread).alias("_kt"), (F.col("_base") + F.col("_in")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(thread).orderBy(position))
    numbered_ = messages.withColumn("_p", place).join(starts, F.col(thread).eqNullSafe(F.col("_kt")))
    return numbered_.withColumn("handle", F.concat(F.lit("e"), (F.col("_start") + F.col("_p")).cast("string"))).drop("_p", "_start", "_kt")


def numbered(df: DataFrame, order: list, block: Column, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Column out: 1, 2, ... within keys in the given order. Rows are numbered in blocks, and a block starts where the counts of
    those before it end: block must not fall as the order goes on, so that no key's rows meet in one task."""
    b = df.withColumn("_b", block)
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), (F.sum("_n").over(w) - F.col("_n")).alias("_start"))
    on = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return b.withColumn("_r", nth).join(starts, on).withColumn(out, F.col("_start") + F.col("_r")).drop("_b", "_kb", "_r", "_start", *[f"_k{i}" for i in range(len(keys))])


def proper_subsets(n: int) -> Column:
    """Masks of all nonempty proper subsets of n things."""
    return F.sequence(F.lit(1), F.lit((1 << n) - 2))


def members(mask: Column, most: int = 16) -> Column:
    """The places from 1 of a mask's set bits."""
    return F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.getbit(mask.cast("long"), i - 1) == 1)


def fit_budget(items: Column, budget: int) -> Column:
    """Greedy with skips over array<struct<pos,size,must>> in order: an item enters if it must or still fits, so a small one
    may follow one that did not. The positions kept."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(s, x):
        fits = x["must"] | (s["used"] + x["size"] <= budget)
        return F.when(fits, F.struct((s["used"] + x["size"]).alias("used"), F.concat(s["kept"], F.array(x["pos"].cast("long"))).alias("kept"))).otherwise(s)

    return F.aggregate(items, start, step)["kept"]


def rewritten(df: DataFrame, rules: list[tuple[str, str]], texts: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Ordered rules over all text fields of records, and over the entries of list fields; nulls stay."""
    one = {c: F.when(F.col(c).isNotNull(), T.replace_all(F.col(c), rules)) for c in texts}
    many = {c: F.transform(c, lambda x: T.replace_all(x, rules)) for c in lists}
    return df.withColumns(one | many)


def regrounded_message(m: Column, kind: StructType, full: dict[str, str], first: dict[str, str], firm: Sequence[tuple[str, str]] = ()) -> Column:
    """A message with names for labels: full ones in from, to and cc, first ones in subject and body, and the same in the message
    that it forwards, to any depth its type has. Other fields, nulls and what is not there stay."""
    of = lambda x, names: F.when(x.isNotNull(), T.reground(x, names, firm))
    done = []
    for f in kind.fields:
        x = m.getField(f.name)
        if f.name == "from":
            x = of(x, full)
        elif f.name in ("subject", "body"):
            x = of(x, first)
        elif f.name in ("to", "cc"):
            x = F.transform(x, lambda one: of(one, full))
        elif f.name == "forward" and isinstance(f.dataType, StructType):
            x = regrounded_message(x, f.dataType, full, first, firm)
        done.append(x.alias(f.name))
    return F.when(m.isNotNull(), F.struct(*done))


def regrounded(df: DataFrame, full: dict[str, str], firm: Sequence[tuple[str, str]] = (), clues: str | None = "clues", atoms: str | None = "atoms", texts: Sequence[str] = ()) -> DataFrame:
    """Records with names for labels: in the plots and messages of their clues, the facts of their atoms (arrays of structs) and the
    columns `texts`, which hold answers. full: label to full name; its first word is the first name."""
    first = {label: name.split()[0] for label, name in full.items()}
    out = {c: F.when(F.col(c).isNotNull(), T.reground(c, full, firm)) for c in texts}
    if clues:
        kind = df.schema[clues].dataType.elementType

        def clue(c: Column) -> Column:
            if "plot" in kind.names:
                c = c.withField("plot", F.when(c["plot"].isNotNull(), T.reground(c["plot"], full, firm)))
            if "messages" in kind.names:
                one = kind["messages"].dataType.elementType
                c = c.withField("messages", F.transform(c["messages"], lambda m: regrounded_message(m, one, full, first, firm)))
            return c

        out[clues] = F.transform(clues, clue)
    if atoms:
        out[atoms] = F.transform(atoms, lambda a: a.withField("fact", F.when(a["fact"].isNotNull(), T.reground(a["fact"], full, firm))))
    return df.withColumns(out)
