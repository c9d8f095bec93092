"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Search is by the general pigeonhole principle: the bits are dealt into m groups of correlated bits with thresholds
t_1..t_m that sum to tau - m + 1, each at least -1; two fingerprints within tau agree within t_i on some group i, else they
would differ in at least sum(t_i + 1) = tau + 1 bits. m and the thresholds come from a dynamic program over the estimated
cost of each group's probes and candidates, which are counted on a bounded sample of pairs. Each candidate is verified on all 64 bits, so the links are exact.

Nulls and empty texts: no words, fingerprint zero, linked like any other. Equal texts share a fingerprint, which is searched
for once however many rows have it. Rows with a null doc_id get a fingerprint and the smallest doc_id of their group, null
if none has one. Repeated rows stay repeated. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut, free_names, table, utf8
from mailquarry.llm.graph import components

BITS, TAU, SHINGLE, SEED = 64, 4, 4, 42
#: A bucket of more rows than this is dealt out further, a smaller one searched by a join.
HOT = 256
#: Fingerprints of a crowd that one block holds.
BLOCK = 2048
#: Shingles hashed at a time, which bounds the memory for a very long text.
SLICE = 1 << 16
#: Fingerprints in the sample by which candidates are estimated.
SAMPLE = 4096
#: Relative cost of a row shuffled for a probe, in verified candidates.
PROBE_COST = 30


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        shingles = [joined[a:b] for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        fps = [fingerprint(x) for x in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(fps, pa.int64())], ["doc_id", "t1", "t2", "fp"])


def _text_key() -> tuple[Column, Column]:
    """128 bits that stand for the text; null is as empty."""
    return F.xxhash64(utf8("text")), F.xxhash64(F.lit("second"), utf8("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, fp) for each row: fp is the fingerprint, t1 and t2 stand for the text."""
    t1, t2 = _text_key()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), utf8("text").alias("t")).mapInArrow(_fingerprints, "doc_id long, t1 long, t2 long, fp long")


def _together(batches):
    """How often each pair of bits is set together in this partition."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
        for at in range(0, len(fps), SLICE):
            x = np.unpackbits(fps[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and the 64 x 64 counts of bits set together: at most 4096 rows reach the driver."""
    together = np.zeros((BITS, BITS))
    for r in distinct.mapInArrow(_together, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    return distinct.count(), together


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits: each starts with the free bit most correlated with any other and takes, one at a
    time, the free bit most correlated with the group, so that what depends on each other stays together."""
    p = together.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size, left = BITS // m + (k < BITS % m), sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def sampled(distinct: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """At most `most` fingerprints, those with the least hashes: they serve to estimate costs and nothing else."""
    rows = distinct.select("fp").orderBy(F.xxhash64(F.lit("sample"), "fp"), "fp").limit(most).collect()
    return np.array([r.fp for r in rows], np.int64).view(np.uint64)


def pairs_within(n: int, p: np.ndarray, groups: list[list[int]], sample: np.ndarray, tau: int = TAU) -> list[list[float]]:
    """For each group and t from 0 to tau the expected pairs of n fingerprints that differ in at most t of the group's bits: the
    share of such pairs in the sample, which sees how the bits depend on each other. Shares that the sample is too small to
    show are those of bits that do not; a group of dependent bits has no fewer."""
    out, pairs = [], n * (n - 1) / 2
    for group in groups:
        apart = np.ones(1)
        for b in group:
            differ = 2 * p[b] * (1 - p[b])
            apart = np.convolve(apart, [1 - differ, differ])
        least = np.cumsum(apart)
        seen, mask = np.zeros(BITS + 1), np.uint64(sum(1 << b for b in group))
        keys = sample & mask
        for i in range(1, len(keys)):
            seen += np.bincount(np.bitwise_count(keys[:i] ^ keys[i]), minlength=BITS + 1)
        seen = np.cumsum(seen) / max(len(keys) * (len(keys) - 1) / 2, 1)
        out.append([pairs * max(float(seen[t]), float(least[min(t, len(least) - 1)])) for t in range(tau + 1)])
    return out


def allocate(n: int, groups: list[list[int]], within: list[list[float]], tau: int = TAU) -> tuple[float, list[int]]:
    """The least cost, and the thresholds of the groups that have it: a dynamic program over groups and what is left of
    tau - m + 1. A group's cost at t is its probes and the candidates, the pairs within t on its bits."""
    m, most = len(groups), tau - len(groups) + 1
    costs = []
    for group, pairs in zip(groups, within):
        cost, probes = {-1: 0.0}, 1
        for t in range(0, tau + 1):
            probes += 0 if t == 0 else len(list(combinations(range(len(group)), t))) / 2 if t <= 3 else 1e9
            cost[t] = n * PROBE_COST * probes + pairs[t]
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in cost.items():
                if used + t not in then or c + more < then[used + t][0]:
                    then[used + t] = (c + more, [*ts, t])
        best = then
    assert m > tau + 1 or most in best
    return best[most]


def plan(n: int, together: np.ndarray, sample: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The groups of bits and their thresholds, for the number of groups at which the estimated cost is least."""
    p = together.diagonal() / max(n, 1)
    options = []
    for m in range(2, tau + 2):
        groups = group_bits(n, together, m)
        cost, thresholds = allocate(n, groups, pairs_within(n, p, groups, sample, tau), tau)
        options.append((cost, m, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits(bits: list[int]) -> Column:
    return F.lit(_signed(sum(1 << b for b in bits)))


def _flipped(part: int, key: Column, group: list[int], t: int) -> Column:
    """(part, key) of each key above `key` that differs in 1 to t bits of the group."""
    flips = F.array(*[_bits(list(c)) for k in range(1, t + 1) for c in combinations(group, k)])
    near = F.filter(F.transform(flips, lambda f: key.bitwiseXOR(f)), lambda x: x > key)
    return F.transform(near, lambda x: F.struct(F.lit(part).alias("part"), x.alias("key")))


def _keys(parts: list[tuple[list[int], int]], probes: bool) -> Column:
    """An array of (part, key): the group's own bits, or those and each key above it that differs in at most t bits. Of two
    fingerprints that differ there, the one with the lower key finds the other."""
    out = []
    for part, (group, t) in enumerate(parts):
        key = F.col("fp").bitwiseAND(_bits(group))
        out.append(F.array(F.struct(F.lit(part).alias("part"), key.alias("key"))))
        if probes and t > 0:
            out.append(_flipped(part, key, group, t))
    return F.concat(*out)


def _deal(bits: list[int], m: int) -> list[list[int]]:
    """The bits in m groups of about equal size."""
    return [g for g in (bits[k::m] for k in range(m)) if g]


def _finer(rows: DataFrame, parts: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """rows (part, key, fp) under finer keys: the bits outside the group are dealt into tau + 1 groups, on one of which at
    least two fingerprints within tau agree."""
    of = []
    for group, _ in parts:
        outside = [b for b in range(BITS) if b not in group]
        of.append(F.array(*[F.struct(F.lit(j).alias("sub"), F.col("fp").bitwiseAND(_bits(g)).alias("subkey")) for j, g in enumerate(_deal(outside, tau + 1))]))
    subs = F.explode(F.element_at(F.array(*of), F.col("part") + 1)).alias("s")
    return rows.select("part", "key", "fp", subs).select("part", "key", "s.sub", "s.subkey", "fp")


def _forest(key, pdf, tau: int):
    """Edges that join all fingerprints of a block pair which links of tau bits join: at most one fewer than there are."""
    left = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= tau
            found = left[near]
            if len(found):
                left = left[~near]
                todo.extend(found)
                a.extend(repeat(x, len(found)))
                b.extend(found)
    import pandas as pd

    return pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})


def _meet(near: DataFrame, base: DataFrame, by: list[str], masks: list[Column], tau: int) -> DataFrame:
    """Verified links (a, b) of rows that share `by`: a of near, b of base. A pair with equal keys is given once."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    mask = F.element_at(F.array(*masks), F.col("part") + 1)
    once = (F.col("a").bitwiseAND(mask) != F.col("b").bitwiseAND(mask)) | (F.col("a") < F.col("b"))
    return near.withColumnRenamed("fp", "a").join(base.withColumnRenamed("fp", "b"), by).where(close & once).select("a", "b")


def links(distinct: DataFrame, tau: int = TAU, parts: list[tuple[list[int], int]] | None = None, spent: list[DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between the fingerprints of `distinct` (column fp, no repeats, a table): all pairs within tau bits that
    meet in a bucket of at most HOT rows. A larger bucket is dealt out by the bits outside its group; where that still
    leaves over HOT, as among very many near copies, it is searched in blocks, which give as many edges as join the same
    fingerprints. parts: groups of bits with thresholds, else those of plan(). Tables that the edges are read from are added
    to `spent`."""
    n, together = bit_counts(distinct)
    if not n:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = parts or plan(n, together, sampled(distinct), tau)
    masks = [_bits(group) for group, _ in parts]
    base = distinct.select("fp", F.explode(_keys(parts, False)).alias("k")).select("k.part", "k.key", "fp")
    near = distinct.select("fp", F.explode(_keys(parts, True)).alias("k")).select("k.part", "k.key", "fp")
    key = ["part", "key"]
    # probes land in a bucket beside its own rows, so both count
    hot = cut(near.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot-buckets")
    spent = [] if spent is None else spent
    spent.append(hot)
    found = _meet(near, base.join(hot, key, "left_anti"), key, masks, tau)
    if hot.isEmpty():
        return found
    fine = [*key, "sub", "subkey"]
    near, base = (_finer(x.join(hot, key, "left_semi"), parts, tau) for x in (near, base))
    crowds = cut(near.groupBy(*fine).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot-buckets")
    spent.append(crowds)
    found = found.union(_meet(near, base.join(crowds, fine, "left_anti"), fine, masks, tau))
    if crowds.isEmpty():
        return found
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    crowd = near.join(crowds, fine).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    pairs = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*fine, "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dense = pairs.groupBy(*fine, "i", "j").applyInPandas(lambda key, pdf: _forest(key, pdf, tau), "a long, b long")
    return found.union(dense)


def _components(rows: DataFrame, tau: int) -> DataFrame:
    """(fp, root) of a table with a column fp: root is the smallest fingerprint reachable over links."""
    distinct = cut(rows.select("fp").distinct(), "classes")
    spent: list[DataFrame] = []
    roots = components(links(distinct, tau, spent=spent))
    drop_cut(*spent)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text): component_id is the smallest doc_id reachable over
    fingerprints at most tau bits apart."""
    rows = cut(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = cut(least.join(_components(rows, tau), "fp"), "roots")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the smallest doc_id, of several texts under one id that with the smallest
    text hash, and a document without an id only where no other has one. Of rows that repeat an id and its text one stays."""
    rows = cut(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("t1"), F.col("t2"))
    # the least of each fingerprint first: a fingerprint that a third of the rows share is one row of the join
    least = rows.groupBy("fp").agg(F.min(order).alias("k")).join(_components(rows, TAU), "fp")
    keep = least.groupBy("root").agg(F.min("k").alias("k")).select("k.d", "k.t1", "k.t2")
    names = free_names(docs, "d", "t1", "t2")
    t1, t2 = _text_key()
    keyed = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: t1, names[2]: t2})
    on = [F.col(mine).eqNullSafe(F.col(f"{mine}_k")) for mine in names]
    left = keyed.join(keep.toDF(*[f"{x}_k" for x in names]), on, "left_semi")
    repeated = rows.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (left if repeated.isEmpty() else left.dropDuplicates(names)).select(*docs.columns)


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
