"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word gives two terms, its letters and its shape (letters folded to A, a and 0, runs
folded to one), and markers for words that repeat. Terms share 2**15 slots. A slot's vector is the
sum of the sparse ternary index vectors of the terms beside it, in a bounded sample of labelled
texts; a document's vector is the mean over its terms. A small numpy network on it
is trained on the same sample, and its temperature is set on a part held back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolens.llm.common import crc_mod, discard, hash_sample, mix, range_hash, slices, small_batches, stored, table, text_bytes, with_field, word_spans
from foliolens.llm.quality_rules import labelled
from foliolens.sources.files import spread

SAMPLE = 3000
SLOTS, SHAPES, MARKS = 1 << 15, 1 << 12, 8
WIDTH, HIDDEN, NONZERO = 48, 32, 6
THRESHOLD = 0.3

_SHAPE = np.full(256, ord("u"), np.uint8)  # parts of letters beyond ASCII
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = ord("A"), ord("a"), ord("0")
_SHAPE[128:] = ord("a")


def terms(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string array: word slots, shape slots, marker slots (one a word), words per text."""
    data, cuts = text_bytes(texts)
    starts, ends, counts = word_spans(data, cuts)
    words = range_hash(data, starts, ends)
    folded = _SHAPE[data]
    first = np.ones(len(folded), bool)
    first[1:] = folded[1:] != folded[:-1]
    first[starts] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    shapes = range_hash(folded[first], kept[starts], kept[ends])
    # A word is marked by how far back it last stood (1, 2 or 3 words) and if the three words up to it came before.
    mark = np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k in (3, 2, 1):
        again = np.zeros(len(words), bool)
        again[k:] = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
        mark[again] = k
    if len(words) > 2:
        window = mix(words[2:] ^ mix(words[1:-1] ^ mix(words[:-2] ^ owner[2:].astype(np.uint64))))
        order = np.argsort(window, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = window[order][1:] == window[order][:-1]
        again = np.zeros(len(words), bool)
        again[2:][order[same]] = True
        again[2:] &= owner[2:] == owner[:-2]
        mark[again] += 4
    return (words % np.uint64(SLOTS)).astype(np.int64), SLOTS + (shapes % np.uint64(SHAPES)).astype(np.int64), SLOTS + SHAPES + mark, counts


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each slot, the same in every run."""
    rng = np.random.default_rng(5)
    out = np.zeros((SLOTS + SHAPES + MARKS, WIDTH), np.float32)
    at = np.argsort(rng.random((len(out), WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return out


#: Slots are summed in blocks of so many, one row for each task and block.
BLOCK = 2048


def neighbours(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each slot, the sum of the index vectors of terms beside it, and how often it stood."""
    index = index_vectors()
    total, seen = np.zeros_like(index), np.zeros(len(index), np.float32)
    for a, n in slices(texts):
        words, shapes, marks, counts = terms(texts.slice(a, n))
        owner = np.repeat(np.arange(len(counts)), counts)
        beside = owner[1:] == owner[:-1]
        a, b = np.flatnonzero(beside), np.flatnonzero(beside) + 1
        for x, y in ((words, words), (words, shapes), (shapes, shapes)):
            np.add.at(total, x[a], index[y[b]])
            np.add.at(total, y[b], index[x[a]])
            np.add.at(seen, x[a], 1)
            np.add.at(seen, y[b], 1)
        np.add.at(total, marks, index[shapes])
        np.add.at(seen, marks, 1)
    return total, seen


def word_vectors(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each slot's own index vector, plus those of terms beside it, scaled by how often it stood."""
    return (2 * index_vectors() + total / np.maximum(1, np.sqrt(seen))[:, None] / 4).astype(np.float32)


def pooled(texts, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean vectors of words, shapes and markers, and the logarithm of its length."""
    words, shapes, marks, counts = terms(texts)
    out = np.zeros((len(counts), 3 * WIDTH + 1), np.float32)
    full = np.flatnonzero(counts)
    at = (np.cumsum(counts) - counts)[full]
    ends = np.cumsum(counts)[full]
    for k, slots in enumerate((words, shapes, marks)):
        for i, a, b in zip(full, at, ends, strict=True):
            own = slots[a:b]
            if k and b - a > 64:  # few kinds of shapes and markers: count them first
                kinds, n = np.unique(own, return_counts=True)
                out[i, k * WIDTH : (k + 1) * WIDTH] = n.astype(np.float32) @ vectors[kinds] / (b - a)
            else:
                out[i, k * WIDTH : (k + 1) * WIDTH] = vectors[own].mean(axis=0)
    out[:, -1] = np.log1p(counts)
    return out


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - net["mean"]) / net["spread"]) @ net["w1"] + net["b1"])
    return hidden, hidden @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = 400) -> dict:
    """Adam on the rows not held, then the temperature with the least loss on those held."""
    rng = np.random.default_rng(6)
    net = {"mean": x.mean(axis=0), "spread": x.std(axis=0) + 1e-3, "w1": rng.normal(0, 0.1, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.1, HIDDEN), "b2": 0.0, "temperature": 1.0}
    a, b = x[~held], y[~held].astype(float)
    names, m, v = ("w1", "b1", "w2", "b2"), {}, {}
    scaled = (a - net["mean"]) / net["spread"]
    for step in range(1, steps + 1):
        hidden, z = _forward(net, a)
        err = (1 / (1 + np.exp(-z)) - b) / len(b)
        back = np.outer(err, net["w2"]) * (1 - hidden**2)
        grads = {"w2": hidden.T @ err + 1e-4 * net["w2"], "b2": err.sum(), "w1": scaled.T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0)}
        for n in names:
            m[n] = 0.9 * m.get(n, 0) + 0.1 * grads[n]
            v[n] = 0.999 * v.get(n, 0) + 0.001 * grads[n] ** 2
            net[n] = net[n] - 0.01 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    if held.any():
        z, t = _forward(net, x[held])[1], y[held]
        loss = lambda k: np.logaddexp(0, np.where(t, -z, z) / k).mean()
        net["temperature"] = min(np.geomspace(0.25, 8, 41), key=loss)
    return net


def predict(net: dict | None, x: np.ndarray) -> np.ndarray:
    if net is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(np.clip(-_forward(net, x)[1] / net["temperature"], -500, 500)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sums): of each block of slots, vectors' sums and counts over all of a task's texts. All are whole numbers, so their order does not matter."""
    total, seen = np.zeros((SLOTS + SHAPES + MARKS, WIDTH), np.float32), np.zeros(SLOTS + SHAPES + MARKS, np.float32)
    for batch in batches:
        for x, y in zip((total, seen), neighbours(batch.column("text")), strict=True):
            x += y
    both = np.concatenate([total, seen[:, None]], axis=1)
    for k in range(0, len(both), BLOCK):
        if both[k : k + BLOCK].any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "sums": pa.array([both[k : k + BLOCK].tobytes()], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x.as_py(), np.float32) for x in table.column("sums"))
    return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})


def _features(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        x = np.concatenate([np.zeros((0, 3 * WIDTH + 1), np.float32), *(pooled(texts.slice(a, n), shared.value) for a, n in slices(texts))])
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("good"), pa.array([r.tobytes() for r in x], pa.binary())], ["place", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, allowed: F.Column, limit: int = SAMPLE) -> tuple[np.ndarray, dict | None]:
    """(slots' vectors, network) from about limit labelled rows at most, of those allowed (a condition on doc_id).

    Texts stay on the executors: the driver gets the sums of vectors (7 MB at most) and a row of 145 numbers for each
    text. Equal rows of one id count once. A document labelled more than once counts as good if all its labels are.
    With labels of one kind only, or none, there is no network and every score is 0.5.
    """
    spark = docs.sparkSession
    rows = labelled(docs, labels, limit, allowed).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "good", F.xxhash64(F.lit(5), "doc_id", "text").alias("place")).distinct()
    sample = stored(hash_sample(rows, 2 * limit, "place").coalesce(8), "sample")
    both = np.zeros((SLOTS + SHAPES + MARKS, WIDTH + 1), np.float32)
    for r in sample.select("text").mapInArrow(_summed, "block int, sums binary").groupBy("block").applyInArrow(_added, "block int, sums binary").collect():
        own = np.frombuffer(r.sums, np.float32).reshape(-1, WIDTH + 1)
        both[r.block * BLOCK : r.block * BLOCK + len(own)] = own
    vectors = word_vectors(both[:, :-1], both[:, -1])
    shared = spark.sparkContext.broadcast(vectors)
    rows = sorted(sample.mapInArrow(partial(_features, shared), "place long, good boolean, x binary").collect())
    discard(sample)
    good = np.array([r.good for r in rows], bool)
    if good.all() or not good.any():
        return vectors, None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    return vectors, fit(x, good, np.arange(len(good)) % 5 == 4)


def _score(vectors, net, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors = vectors.value
    for batch in batches:
        texts = batch.column("text")
        scores = np.concatenate([np.zeros(0), *(predict(net, pooled(texts.slice(a, n), vectors)) for a, n in slices(texts))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def scored(docs: DataFrame, model: tuple[np.ndarray, dict | None]) -> DataFrame:
    """docs with score, a probability that the text is good; a narrow operation.

    Only text is looked at, and the whole of it however long. Null and empty texts are scored as texts without words.
    Null ids are kept, an empty table gives no rows. Repeated rows get equal scores; a column of docs named score is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model[0])  # 7 MB, whatever the data
    return docs.mapInArrow(partial(_score, shared, model[1]), with_field(docs, "score", T.DoubleType()))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = scored(spread(docs.select("doc_id", "text")), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
