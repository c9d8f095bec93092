"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of their letter n-grams, n = 1 to 3, by presence: for each n the n-grams that
both have over the geometric mean of the numbers each has, averaged over n. Nystroem features against landmark texts turn it
into vectors, on which one ridge regression for each language is fitted against the rest. Whole texts are scored, a batch at
a time, as products of a 0/1 matrix of n-grams with the landmarks' and then with the regression's weights.

Letters are lower-cased; a run of anything else is one boundary. All n-grams of all texts count: what two texts share is found
among the landmarks' n-grams, whose number is that of a few texts, and a text's own number is that of all its different ones.
The fit uses a bounded sample: of each language at most PER_LANGUAGE labelled texts, fewer where MAX_SAMPLE texts in all would
be passed, but one at least, chosen by a hash of doc_id and read whole. About LANDMARKS of them are landmarks, at least one for
each language: the first by that hash of those with up to LONG different n-grams, then the shortest others. The driver gets the
landmarks' n-grams and the sample's kernel with them, a row of about LANDMARKS numbers a text. Prediction reads every text.

A text that is null or has no letter is `und` with score 0, as is every text where nothing was learnt. Rows with a null
doc_id are scored and not held out, and never learnt from. Ties go to the language that sorts first. Repeated rows give equal
rows, an empty table an empty result; further columns are ignored, or kept by identify(), which replaces columns named
lang_pred and score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mailquarry.llm.common import cut, drop_cut, table

NS = (1, 2, 3)
PER_LANGUAGE, MAX_SAMPLE, LANDMARKS = 250, 8000, 160
LONG, RIDGE = 1 << 14, 1e-2
#: Code points take so many bits in an n-gram's key.
POINT_BITS = 21
#: Columns of a 0/1 matrix at a time.
BLOCK = 1 << 14
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, else 0."""
    if not _TABLES:
        out = np.zeros(0x110000, np.int32)
        for x in range(0x110000):
            c = chr(x)
            if c.isalpha():
                low = c.lower()
                out[x] = ord(low) if len(low) == 1 else ord(low[0])
        _TABLES.append(out)
    return _TABLES[0]


def letters(text: str) -> np.ndarray:
    """The text's letters as code points, with a 0 before, after and for each run of anything else within."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points > 0
    keep[1:] |= keep[:-1]
    points = points[keep]
    return np.concatenate((np.zeros(1, np.int32), points, np.zeros(0 if len(points) and points[-1] == 0 else 1, np.int32)))


def gram_keys(points: np.ndarray, n: int) -> np.ndarray:
    """The different n-grams of a text's letters, as sorted numbers of POINT_BITS bits a letter."""
    out = points[: max(0, len(points) - n + 1)].astype(np.int64)
    for k in range(1, n):
        out = out << POINT_BITS | points[k : len(points) - n + 1 + k]
    return np.unique(out)


def grams(text: str | None) -> dict[int, np.ndarray] | None:
    """A text's n-grams by n, none for one without a letter."""
    points = letters(text or "")
    return {n: gram_keys(points, n) for n in NS} if points.any() else None


class Landmarks:
    """The n-grams of the landmark texts, and by bits which of the texts has which."""

    def __init__(self, texts: list[dict[int, np.ndarray]]):
        self.count = len(texts)
        self.keys, self.bits, self.sizes = {}, {}, {}
        for n in NS:
            self.sizes[n] = np.array([len(t[n]) for t in texts])
            self.keys[n], at = np.unique(np.concatenate([t[n] for t in texts]), return_inverse=True)
            owner = np.repeat(np.arange(self.count), self.sizes[n])
            self.bits[n] = np.zeros((len(self.keys[n]), -(-self.count // 8)), np.uint8)
            np.bitwise_or.at(self.bits[n], (at, owner // 8), (128 >> owner % 8).astype(np.uint8))

    def kernel(self, texts: list[dict[int, np.ndarray]]) -> np.ndarray:
        """Of each text with each landmark."""
        out = np.zeros((len(texts), self.count), np.float32)
        for n in NS:
            keys, sizes = self.keys[n], np.array([len(t[n]) for t in texts])
            found, row = np.concatenate([t[n] for t in texts]), np.repeat(np.arange(len(texts)), sizes)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            known = keys[at] == found
            at, row = at[known], row[known]
            shared = np.zeros((len(texts), self.count), np.float32)
            for start in range(0, len(keys), BLOCK):
                has = np.unpackbits(self.bits[n][start : start + BLOCK], axis=1, count=self.count).astype(np.float32)
                here = (at >= start) & (at < start + BLOCK)
                x = np.zeros((len(texts), len(has)), np.float32)
                x[row[here], at[here] - start] = 1
                shared += x @ has
            out += shared / np.sqrt(np.maximum(np.outer(sizes, self.sizes[n]), 1))
        return out / len(NS)


def chosen_landmarks(sizes: list[int], languages: list[str]) -> list[int]:
    """The places of the landmarks in a sample in order; sizes: the numbers of different n-grams."""
    by: dict[str, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (max(0, sizes[i] - LONG), i)):
        by.setdefault(languages[i], []).append(i)
    each = max(1, LANDMARKS // max(1, len(by)))
    return [i for g in sorted(by) for i in by[g][:each]]


class Model:
    """A fitted classifier, from the landmarks, the kernel of the sample with them, the sample's languages, and which of the sample
    the landmarks are. It has no languages if the sample is empty."""

    def __init__(self, landmarks: Landmarks | None, k: np.ndarray, languages: list[str], which: list[int]):
        self.landmarks, self.languages = landmarks, sorted(set(languages))
        if not languages:
            return
        value, vector = np.linalg.eigh(k[which])
        some = value > 1e-6 * value.max()
        to_features = vector[:, some] / np.sqrt(value[some])
        features = np.hstack([k @ to_features, np.ones((len(k), 1))])
        y = np.array([[1.0 if g == h else -1.0 for h in self.languages] for g in languages])
        count = {g: languages.count(g) for g in self.languages}
        weight = np.array([len(k) / (len(count) * count[g]) for g in languages])[:, None]
        ridge = RIDGE * np.eye(features.shape[1])
        ridge[-1, -1] = 1e-9
        beta = np.linalg.solve(features.T @ (weight * features) + ridge, features.T @ (weight * y))
        self.weights, self.offset = (to_features @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for at in range(0, len(texts), batch):
            held = [(at + i, g) for i, t in enumerate(texts[at : at + batch]) if (g := grams(t)) is not None]
            if not held:
                continue
            value = self.landmarks.kernel([g for _, g in held]) @ self.weights + self.offset
            best = value.argmax(1)
            top = np.sort(value, axis=1)
            lead = (top[:, -1] - top[:, -2]) / 2 if value.shape[1] > 1 else (top[:, -1] + 1) / 2
            for (i, _), b, s in zip(held, best.tolist(), np.clip(lead, 0, 1).tolist()):
                names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(texts: list[str], languages: list[str]) -> Model:
    """A model of a few texts at hand."""
    rows = [(t, g) for t, g in zip(map(grams, texts), languages) if t is not None]
    if not rows:
        return Model(None, np.zeros((0, 0)), [], [])
    which = chosen_landmarks([sum(map(len, t.values())) for t, _ in rows], [g for _, g in rows])
    landmarks = Landmarks([rows[i][0] for i in which])
    return Model(landmarks, landmarks.kernel([t for t, _ in rows]), [g for _, g in rows], which)


def _sizes(batches):
    for batch in batches:
        found = [None if (g := grams(t)) is None else sum(map(len, g.values())) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("r"), pa.array(found, pa.int64())], ["lang", "r", "size"])


def _keys(batches):
    for batch in batches:
        found = [grams(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([g[n] for g in found], pa.list_(pa.int64())) for n in NS]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("r"), *columns], ["lang", "r", *[f"k{n}" for n in NS]])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MAX_SAMPLE) -> Model:
    """A model of the documents that are not held out and have text, lang and doc_id, of per_language texts of a language at most,
    of `most` in all unless there are more languages."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return learn([], [])
    each = max(1, min(per_language, most // len(counts)))
    slots = 1 << 24
    most_of = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(slots, 1 + 2 * each * slots // r.n)))])
    likely = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < most_of[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    chosen = likely.select("lang", "text", rank.alias("r")).where(F.col("r") <= each)
    sample = cut(chosen, "languages")
    rows = sorted((r.lang, r.r, r.size) for r in sample.mapInArrow(_sizes, "lang string, r int, size long").where("size is not null").collect())
    if not rows:
        drop_cut(sample)
        return learn([], [])
    languages = [g for g, _, _ in rows]
    which = chosen_landmarks([n for _, _, n in rows], languages)
    names = docs.sparkSession.createDataFrame([rows[i][:2] for i in which], "lang string, r int")
    keys = sample.join(F.broadcast(names), ["lang", "r"], "left_semi").mapInArrow(_keys, "lang string, r int, " + ", ".join(f"k{n} array<long>" for n in NS)).toArrow().to_pylist()
    by = {(x["lang"], x["r"]): {n: np.array(x[f"k{n}"], np.int64) for n in NS} for x in keys}
    landmarks = Landmarks([by[rows[i][:2]] for i in which])
    held = docs.sparkSession.sparkContext.broadcast(landmarks)

    def kernels(batches):
        for batch in batches:
            found = [grams(t) for t in batch.column("text").to_pylist()]
            some = [i for i, g in enumerate(found) if g is not None]
            if some:
                k = held.value.kernel([found[i] for i in some])
                kept = batch.take(pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column("lang"), kept.column("r"), pa.array(list(k), pa.list_(pa.float32()))], ["lang", "r", "k"])

    got = sample.mapInArrow(kernels, "lang string, r int, k array<float>").toArrow()
    order = sorted(range(got.num_rows), key=list(zip(got.column("lang").to_pylist(), got.column("r").to_pylist())).__getitem__)
    k = got.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, landmarks.count)[order]
    held.destroy()
    drop_cut(sample)
    return Model(landmarks, k.astype(np.float64), languages, which)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; only the column text is looked at."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, `und`, go; one in several languages has one of them and stays. Rows keep their columns."""
    held = spark.sparkContext.broadcast(fit(docs))

    def run(batches):
        for batch in batches:
            names, _ = held.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op4_language_id": op4_language_id}
