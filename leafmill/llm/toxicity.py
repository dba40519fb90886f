"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled documents, with absolute discounts
and continuation counts at the lower order. Both back off to the same counts: those of each word
in the whole corpus, so a rare expression gets no odds from one class's small sample alone. A
document is compared by length-normalised log-likelihood ratios: the mean per word, the highest
mean over ten consecutive words, and the mean weight of words at which the models clearly part. A
logistic function fitted on labelled documents that the models haven't seen turns them into a
score.

Every word and pair of the samples is kept. Words are counted over the whole corpus in a table, of
which the models hold the rows of the samples' words; the backoff of any other word is the same in
both models and so leaves their ratio alone.

The models are fitted on at most MAX_TOXIC and MAX_ORDINARY labelled documents and the logistic
function on at most MAX_FIT, taken in order of a hash of the id; equal texts count once. Corpus
counts and scores cover every document and whole texts.

Defined cases: a null or empty text scores as a text without evidence; null or missing labels
teach nothing; several labels of one id count as its highest; labels of one class only, or none,
give every document the labels' mean (0 without labels); extra columns stay unless named as the
columns added; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import Scratch, small_batches, tidy

#: Bounds of the labelled samples.
MAX_TOXIC, MAX_ORDINARY, MAX_FIT = 3000, 6000, 6000
DISCOUNT, THRESHOLD, WINDOW, CLEAR = 0.75, 0.3, 10, 2.5
#: Labels of rows with this remainder of crc32(id) by 4 are never learned from; the other remainders'
#: last fits the logistic function, the rest the models.
HELD_OUT, FIT = 2, 3
#: Rows of the models' tables that come to the driver at once.
SLICE = 200_000
#: Words of texts that are scored at once.
BUNCH = 50_000
#: Distinct expressions a task holds before it hands them on.
FLUSH = 100_000

tokens = re.compile(r"[^\W_]+").findall


def fold(doc_id) -> F.Column:
    return F.coalesce((F.crc32(doc_id.cast("string")) % 4).cast("int"), F.lit(-1))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that few texts are Python objects at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["toxic", "v", "w", "n"])
        seen.clear()
        return batch

    for batch in _parts(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = tokens(text.lower())
            seen.update(zip(repeat(toxic), ["", *words], words))
            if len(seen) >= FLUSH:
                yield out()
    if seen:
        yield out()
    tidy()


class Model:
    """Tables of both models over the vocabulary of the sample; word 0 is any other, word 1 the text's start.

    Pairs stand as counts of the least width that holds them, discounted when looked up: every worker has a copy.
    """

    def __init__(self, vocabulary: dict[str, int], uni: np.ndarray, keys: np.ndarray, times: np.ndarray, mass: np.ndarray) -> None:
        self.vocabulary, self.uni, self.keys, self.times, self.mass = vocabulary, uni, keys, times, mass
        rest = np.ones_like(uni)
        for start in range(0, len(keys), SLICE):
            v = keys[start : start + SLICE] // uni.shape[1]
            for k in (0, 1):
                rest[k] -= np.bincount(v, self.share(k, slice(start, start + SLICE), v), uni.shape[1])
        self.rest = np.maximum(rest, 1e-6)
        self.ratio = np.log(uni[1] / uni[0])
        self.weights, self.mean, self.scale = np.zeros(5), np.zeros(4), np.ones(4)

    def share(self, k: int, at: np.ndarray | slice, v: np.ndarray) -> np.ndarray:
        """Discounted shares of the pairs at these places among the pairs of class k that begin with v."""
        return np.maximum(self.times[k][at] - DISCOUNT, 0) / self.mass[k][v]

    @property
    def seen(self) -> list[np.ndarray]:
        """The shares of all pairs in either class."""
        return [self.share(k, slice(None), self.keys // len(self.ratio)) for k in (0, 1)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row of four numbers for each text. Texts are taken in bunches of BUNCH words or one text, whose pairs are
        looked up in sorted order: neighbours lie near in the table."""
        out, bunch, held = np.zeros((len(texts), 4)), [], 0
        for k, text in enumerate(texts):
            words = tokens((text or "").lower())
            if not words:
                continue
            ids = np.empty(len(words) + 1, np.int64)
            ids[0] = 1
            ids[1:] = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
            bunch.append((k, ids))
            held += len(words)
            if held >= BUNCH:
                self._compare(bunch, out)
                bunch, held = [], 0
        if bunch:
            self._compare(bunch, out)
        return out

    def _compare(self, bunch: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        v = np.concatenate([ids[:-1] for _, ids in bunch])
        w = np.concatenate([ids[1:] for _, ids in bunch])
        key = v * len(self.ratio) + w
        order = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.keys, key[order])
        np.minimum(at, len(self.keys) - 1, out=at)
        known = self.keys[at] == key
        p = [np.where(known, self.share(c, at, v), 0.0) + self.rest[c][v] * self.uni[c][w] for c in (0, 1)]
        every, ratios = np.clip(np.log(p[1] / p[0]), -2, 8), self.ratio[w]
        start = 0
        for k, ids in bunch:
            n = len(ids) - 1
            both, single = every[start : start + n], ratios[start : start + n]
            start += n
            sums = np.concatenate([[0.0], np.cumsum(np.clip(single, -1, 9))])
            window = (sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW if n >= WINDOW else sums[-1] / n
            out[k] = both.mean(), window, (single > CLEAR).mean() * 10, np.log1p(n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a, w = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]), np.zeros(5)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(5), a.T @ (y - p) - 0.05 * w)
        self.weights = w


class Constant:
    """The score of every document when the labels hold one class at most."""

    def __init__(self, value: float) -> None:
        self.value = value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def _sample(labels: DataFrame, docs: DataFrame, condition: str, most: int) -> DataFrame:
    """Texts of at most ``most`` labelled documents, equal texts once. The ids are bounded, so broadcast."""
    picked = labels.filter(condition).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(picked), "_id").groupBy("_text").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | Constant:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_fold", fold(F.col("_id")))
    known = scratch.save(known.filter(F.col("_fold") != HELD_OUT), "labels")
    learn = f"_fold != {FIT}"
    pick = _sample(known, texts, f"{learn} and toxic = 1", MAX_TOXIC).unionByName(_sample(known, texts, f"{learn} and toxic = 0", MAX_ORDINARY))
    grams = pick.select("_text", "toxic").mapInArrow(_bigrams, "toxic int, v string, w string, n bigint")
    c = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0))
    grams = scratch.save(grams.groupBy("v", "w").agg(c(0).alias("c0"), c(1).alias("c1")), "bigrams")
    has = lambda k: F.count(F.when(F.col(f"c{k}") > 0, 1))
    totals = grams.agg(has(0).alias("t0"), has(1).alias("t1")).first()
    if not totals.t0 or not totals.t1:
        mean = known.agg(F.avg("toxic")).first()[0]
        return Constant(float(mean or 0.0))
    # From here on, what comes to the driver is bounded by the sample.
    words = grams.groupBy("w").agg(has(0).alias("n0"), has(1).alias("n1"))
    types = words.agg(has_words(0), has_words(1)).first()
    # The places of words in the saved table tell them apart, so that their pairs are collected as numbers.
    corpus = scratch.save(corpus_counts(texts), "corpus-words")
    whole = corpus.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    words = scratch.save(words.join(corpus, "w").withColumn("_word", F.monotonically_increasing_id()), "words")
    place, counted, names = _words_of(words)
    vocabulary = {w: k + 2 for k, w in enumerate(names.to_pylist())}
    del names
    size = len(vocabulary) + 2
    counts = np.zeros((2, size))
    counts[:, 2:] = counted[:2]
    shared = np.zeros(size)
    shared[2:] = counted[2]
    backoff = (shared + 0.5) / (whole.n + 0.5 * (whole.kinds + 1))
    total = np.array([totals.t0, totals.t1], float)
    kinds = np.array([types[0], types[1]], float)
    uni = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[:, None] * backoff) / total[:, None]
    start = grams.sparkSession.createDataFrame([("", -1)], "v string, _before bigint")
    after = words.select(F.col("w").alias("v"), F.col("_word").alias("_before")).unionByName(start)
    numbers = lambda ids: np.where(ids < 0, 1, np.searchsorted(place, ids) + 2)
    contexts = grams.groupBy("v").agg(F.sum("c0").alias("m0"), F.sum("c1").alias("m1")).join(after, "v").select("_before", "m0", "m1").toArrow()
    mass = np.ones((2, size))
    at = numbers(contexts["_before"].to_numpy())
    mass[0, at], mass[1, at] = np.maximum(contexts["m0"].to_numpy(), 1), np.maximum(contexts["m1"].to_numpy(), 1)
    pairs = scratch.save(grams.join(words.select("w", "_word"), "w").join(after, "v").select("_before", "_word", F.col("c0").cast("int"), F.col("c1").cast("int")), "pairs")
    keys, times = _pairs(pairs, numbers, size)
    model = Model(vocabulary, uni, keys, times, mass)
    del keys, times
    fit = _sample(known, texts, f"not ({learn})", MAX_FIT)
    shared_model = fit.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(m.features(b.column(0).to_pylist()).tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])
        tidy()

    rows = fit.select("_text", "toxic").mapInArrow(features, "x array<double>, toxic int").toPandas().sort_values(["toxic", "x"], key=lambda s: s.map(str)).reset_index(drop=True)
    if rows["toxic"].nunique() < 2:
        mean = known.agg(F.avg("toxic")).first()[0]
        return Constant(float(mean or 0.0))
    model.fit(np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float))
    shared_model.destroy()
    return model


def _slices(table: DataFrame, keys: list[str], columns: list[str]) -> Iterator[pa.Table]:
    """Rows of a saved table in slices of about SLICE, so that neither the driver's JVM nor Python holds the whole twice."""
    slices = max(1, -(-table.count() // SLICE))
    part = F.pmod(F.xxhash64(*keys), F.lit(slices))
    for k in range(slices):
        yield table.filter(part == k).select(*columns).toArrow()
        pa.default_memory_pool().release_unused()


def _words_of(words: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words' places in ascending order, with their counts n0, n1 and n, and themselves."""
    places, counts, texts = [], [], []
    for got in _slices(words, ["_word"], ["_word", "n0", "n1", "n", "w"]):
        places.append(got["_word"].to_numpy())
        counts.append(np.array([got[c].to_numpy() for c in ("n0", "n1", "n")]))
        texts += got["w"].chunks
        del got
    place = np.concatenate(places)
    order = np.argsort(place)
    return place[order], np.concatenate(counts, axis=1)[:, order], pa.chunked_array(texts, pa.string()).combine_chunks().take(pa.array(order))


def _pairs(pairs: DataFrame, numbers: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs in ascending order and their counts in both classes, in the least type that holds them."""
    keys, times = [np.empty(0, np.int64)], [np.empty((2, 0), np.uint8)]
    for got in _slices(pairs, ["_before", "_word"], ["_before", "_word", "c0", "c1"]):
        keys.append(numbers(got["_before"].to_numpy()) * size + numbers(got["_word"].to_numpy()))
        counted = np.array([got[c].to_numpy() for c in ("c0", "c1")])
        times.append(counted.astype(np.min_scalar_type(counted.max(initial=0))))
        del got, counted
    if len(keys) == 1:
        return np.zeros(1, np.int64), np.zeros((2, 1), np.uint8)
    key, time = np.concatenate(keys), np.concatenate(times, axis=1)
    del keys, times
    order = np.argsort(key)
    return key[order], time[:, order]


def has_words(k: int) -> F.Column:
    """Distinct words of class k."""
    return F.count(F.when(F.col(f"n{k}") > 0, 1))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
        seen.clear()
        return batch

    for batch in _parts(batches):
        for text in batch.column(0).to_pylist():
            seen.update(tokens(text.lower()))
            if len(seen) >= FLUSH:
                yield out()
    if seen:
        yield out()
    tidy()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """Columns w and n: the occurrences of every word in the whole corpus."""
    return texts.select("_text").mapInArrow(_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model | Constant, text_col: str = "text", name: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add the score of each row's text; ``keep`` names the columns that stay, all by default."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _parts(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(m.scores(texts), pa.float64())], names=[*kept, name])
        tidy()

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark))
    out = score(docs, model, keep=("doc_id",))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES = {}
