"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the
weights of its words' features (the word and its beginnings, as stems carry over
to words never seen); the document's is their noisy-or, so one offending
sentence suffices and labels of whole documents train sentence scores. Training
is full-batch gradient descent on a bounded sample of labelled documents: at
most SAMPLE of them, chosen by a hash of the id, and no more than come to
SAMPLE_BYTES of text together, however many rows share an id and however long
they are. Features are 32-bit hashes. Those in fewer than LEAST sampled
documents, or in a share of them above MOST, are left out, and so are those that
are rare (below SHARE) both among the toxic ones and among all. The gradient is
summed over chunks of documents, so the driver's memory is bounded by the
sample, and it is given back after the fit. The model, at most one weight per sampled feature, is broadcast, and
every whole text is scored.

Defined results: a null or empty text, or one without words, has score 0. A
label row without doc_id or label is not learned from; several label rows for a
doc_id count as one, toxic if any is. Without labels of both classes every
score is 0. Rows that share a doc_id are scored each. A null doc_id counts as
the empty string in the hold-out rule. An empty table gives an empty result;
extra columns are ignored by the score and kept by `clean`. Rows equal in id and
text count once in the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.llm.shared import arrow_rows, release, stage

#: Bounds on the labelled documents that the model is fitted on: their number, and the bytes of their texts.
SAMPLE, SAMPLE_BYTES, LEAST, SHARE, MOST, ROUNDS, FOLDS = 8_000, 16 << 20, 5, 0.002, 0.2, 100, 5
#: Features whose gradient is summed at a time.
CHUNK = 1 << 19
#: Lengths of the beginnings that are features of a word besides itself.
STEMS = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")
_CACHE = 1 << 18


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def _features(word: str) -> list[int]:
    """Signed 32-bit hashes."""
    return [zlib.crc32(f.encode()) - (1 << 31) for f in (word, *(f"{n} {word[:n]}" for n in STEMS if len(word) > n))]


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, toxic): at most `sample` different labelled documents outside the hold-out, of `most_bytes` together."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    # lengths only, until the rows are few: any number of rows may share a sampled id
    slim = docs.select("doc_id", F.xxhash64("text").alias("__key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("__size")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).distinct()
    few = slim.orderBy(F.xxhash64("doc_id"), "doc_id", "__key").limit(sample)
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "__key").rowsBetween(Window.unboundedPreceding, 0)
    chosen = few.withColumn("upto", F.sum("__size").over(upto)).where(F.col("upto") <= most_bytes).select("__id", F.col("__key").alias("__rk"), F.col("__toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__rk")))
    return rows.groupBy("doc_id", "__rk").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).drop("__rk")


class Bags:
    """A chunk of documents: sentences per document, features per sentence, and features as places in the vocabulary."""

    def __init__(self, toxic, per_doc, per_sentence, features):
        self.positive = np.asarray(toxic) == 1
        self.doc_of = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
        self.sentence_of = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
        self.features = np.asarray(features, np.int32)

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Of minus the log-likelihood of the documents' labels under noisy-or."""
        z = bias + np.bincount(self.sentence_of, w[self.features], len(self.doc_of))
        sigma = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        total = np.bincount(self.doc_of, np.logaddexp(0, z), len(self.positive))
        slope = np.where(self.positive, -1 / np.expm1(np.clip(total, 1e-9, 60)), 1.0)
        g = slope[self.doc_of] * sigma
        return np.bincount(self.features, g[self.sentence_of], len(w)), float(g.sum())


def sample_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, list[Bags]]:
    """(the vocabulary: sorted feature hashes, the sampled documents in chunks)."""

    def hashed(each: Iterator[dict]) -> Iterator[tuple]:
        for doc in each:
            sentences = [[f for x in w for f in _features(x)] for m in _SENTENCE.finditer(doc["text"] or "") if (w := _words(m[0]))]
            yield doc["doc_id"], doc["toxic"], [len(f) for f in sentences], [f for s in sentences for f in s]

    schema = "doc_id long, toxic int, sizes array<int>, features array<int>"
    bags = stage(arrow_rows(sampled(docs, labels, sample, most_bytes), schema, hashed, 256), "toxicity-sample")
    n, n_toxic = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    spread = bags.select("toxic", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    telling = spread.where(((F.col("n") >= max(LEAST, SHARE * n)) | (F.col("t") >= max(LEAST, SHARE * n_toxic))) & (F.col("n") <= max(LEAST, MOST * n)))
    vocabulary = np.sort(telling.select("f").toArrow().column("f").to_numpy())
    kept = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def narrowed(each: Iterator[dict]) -> Iterator[tuple]:
        known = kept.value
        for bag in each:
            features = np.array(bag["features"], np.int32)
            at = np.searchsorted(known, features)
            held = at < len(known)
            held[held] = known[at[held]] == features[held]
            of = np.repeat(np.arange(len(bag["sizes"])), bag["sizes"])
            yield bag["doc_id"], bag["toxic"], np.bincount(of[held], minlength=len(bag["sizes"])).tolist(), at[held].tolist()

    # in one order, so that sums of doubles agree between runs
    table = arrow_rows(bags, schema, narrowed, 256).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    release(bags)
    return vocabulary, list(_chunks(table))


def _chunks(table: pa.Table) -> Iterator[Bags]:
    upto = np.cumsum(pc.list_value_length(table.column("features")).to_numpy())
    start = 0
    while start < len(table):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CHUNK, "right")))
        part = table.slice(start, stop - start).combine_chunks()
        sizes, features = part.column("sizes").combine_chunks(), part.column("features").combine_chunks()
        yield Bags(part.column("toxic").to_numpy(), pc.list_value_length(sizes).to_numpy(), sizes.flatten().to_numpy(), features.flatten().to_numpy())
        start = stop


class _Weights(dict):
    """Weights of words, worked out when first asked for."""

    def __init__(self, features: dict[int, float]):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        w = self[word] = math.fsum(self.features.get(f, 0.0) for f in _features(word))
        return w


class Model:
    """bias and weights by feature hash."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights
        self._known = _Weights(weights)

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence with words, in code points."""
        weight = self._known.__getitem__
        for m in _SENTENCE.finditer(text or ""):
            if words := _words(m[0]):
                yield m.start(), m.end(), self.bias + math.fsum(map(weight, words))


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z)) if z > -700 else 0.0


def noisy_or(odds: list[float]) -> float:
    """1 - prod(1 - sigmoid(z))"""
    return -math.expm1(-math.fsum(map(_softplus, odds)))


def train(vocabulary: np.ndarray, bags: list[Bags], rounds: int = ROUNDS, rate: float = 1.0, sparsity: float = 2e-4, decay: float = 1e-5) -> Model:
    """Gradient descent (per-weight steps, soft thresholds) on the noisy-or likelihood of the documents' labels."""
    n, n_toxic, sentences = (sum(x) for x in zip((0, 0, 0), *((len(b.positive), int(b.positive.sum()), len(b.doc_of)) for b in bags)))
    if n_toxic in (0, n):
        return Model(-1000.0, {})
    w, step = np.zeros(len(vocabulary)), np.full(len(vocabulary), 1e-8)
    share = n_toxic / max(n_toxic + 1, sentences)
    # low enough that a long harmless document does not add up to a toxic one; words have to make the difference
    bias, bias_step = math.log(share / (1 - share)) - 4, 1e-8
    for _ in range(rounds):
        gw, gb = decay * n * w, 0.0
        for bag in bags:
            part = bag.gradient(w, bias)
            gw, gb = gw + part[0], gb + part[1]
        step += gw * gw
        pace = rate / np.sqrt(step)
        w -= pace * gw
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * sparsity * n)
        bias_step += gb * gb
        bias -= rate * gb / math.sqrt(bias_step)
    strong = np.abs(w) > 1e-4
    return Model(float(bias), dict(zip(vocabulary[strong].tolist(), w[strong].tolist())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    vocabulary, bags = sample_features(docs, labels, sample, most_bytes)
    # Arrow keeps what it has freed, several times the sample, and the driver's Python lives as long as the application
    pool = pa.default_memory_pool()
    pool.release_unused()
    model = train(vocabulary, bags)
    del bags
    pool.release_unused()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, rk, score, offending): offending holds the sentences that are likelier toxic than not, as code point ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        m = shared.value
        for doc in each:
            sentences = list(m.sentences(doc["text"]))
            yield doc["doc_id"], doc["rk"], noisy_or([z for *_, z in sentences]), [{"start": s, "end": e} for s, e, z in sentences if z >= 0]

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))
    return arrow_rows(picked, "doc_id long, rk long, score double, offending array<struct<start:int,end:int>>", rows)


def clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score stays below `least`."""
    rejected = score(docs, fit(docs, labels)).where(F.col("score") >= least).select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__rk")), "left_anti")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
