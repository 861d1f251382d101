"""Near-duplicates by SimHash, with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits. Of two
fingerprints that differ in at most two bits, one segment is equal (three segments, two
errors), and the segment after it differs in at most two bits. Padded to 23 bits, that
one is decoded with the perfect Golay code: two words at distance two have a word between them whose
codeword is within distance four of both. So the codewords within distance four (one or
six of them) give keys of which any such pair shares one. Keys of (equal segment,
codeword) are joined and verified; only distinct fingerprints take part.

A key that very many fingerprints share is handled exactly in another way: each of them
names the 65 words within one bit, and those that share such a word are linked to the
smallest of them, so no bucket is ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import LOWER, discard, small_batches, stored, table
from foliolens.sources.files import spread

SHIFTS, WIDTHS = (0, 21, 42), (21, 21, 22)
#: A key with more distinct fingerprints than this goes the other, exact way.
CROWDED = 2000
_GENERATOR = 0xAE3


_GOLAY: list[tuple] = []


def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome the patterns of weight four or less (six, -1 where none), and how many."""
    if _GOLAY:
        return _GOLAY[0]

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _GENERATOR << (k - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int32)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    bits = [remainder(1 << k) for k in range(23)]
    for weight in range(5):
        for c in combinations(range(23), weight):
            s = 0
            for k in c:
                s ^= bits[k]
            found[s].append(sum(1 << k for k in c))
    table = np.full((1 << 11, 6), -1, np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    _GOLAY.append((low, high, table, np.array([len(x) for x in found], np.int32)))
    return _GOLAY[0]


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (which word, index of 12 bits) of each codeword within distance four."""
    low, high, patterns, counts = golay()
    syndrome = low[x & 4095] ^ high[x >> 12]
    n = counts[syndrome]
    which = np.repeat(np.arange(len(x)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, (x[which] ^ patterns[syndrome[which], nth]) >> 11


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) pairs: three places for the equal segment, with each codeword of the next."""
    prints = prints.view(np.uint64)
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    who, keys = [], []
    for k in range(3):
        which, code = codewords(parts[(k + 1) % 3])
        who.append(which)
        keys.append((np.int64(k) << 40) | (parts[k][which] << 12) | code)
    return np.concatenate(who), np.concatenate(keys)


def shingle_hashes(text: bytes, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of words, lower-cased and joined by a space."""
    from xxhash import xxh64_intdigest as xxh

    found = text.translate(bytes(LOWER)).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= size:
        return [xxh(joined, 42)]
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    return list(map(xxh, [joined[a : b - 1] for a, b in zip(starts, starts[size:])], repeat(42)))


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """A signed 64-bit fingerprint for each text, of its runs of size words; zero where there is no word."""
    out = np.zeros(len(texts), np.int64)
    at, hashes, counts = [], [], []

    def flush() -> None:
        if not at:
            return
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        n = np.array(counts)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[at] = np.packbits(ones * 2 > n[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
        at.clear(), hashes.clear(), counts.clear()

    for k, text in enumerate(texts):
        if own := shingle_hashes(text, size):
            at.append(k)
            hashes += own
            counts.append(len(own))
            if len(hashes) > 250_000:
                flush()
    flush()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts))], ["doc_id", "fp"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(prints), 1 << 14):
            own = prints[k : k + (1 << 14)]
            which, keys = keys_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[which])], ["key", "fp"])


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(prints), 1 << 13):
            own = prints[k : k + (1 << 13)]
            near = (own.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(own, 65))], ["near", "fp"])


def document_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Distinct (a, b), a < b, of fingerprints that differ in one or two bits.

    prints: distinct fp. Every pair is found, or, within a crowded key, a chain of
    such pairs through the smallest fingerprint around each shared word.
    """
    keys = stored(prints.mapInArrow(_key_batches, "key long, fp long"), "keys")  # read four times
    many = stored(keys.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    if many.isEmpty():
        usual, rest = keys, None
    else:
        usual = keys.join(many, "key", "left_anti")
        rest = keys.join(many, "key", "left_semi").select("fp").distinct()
    a, b = usual.select("key", F.col("fp").alias("a")), usual.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    if rest is not None:
        near = rest.mapInArrow(_neighbour_batches, "near long, fp long")
        first = near.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("near", "a")
        pairs = pairs.unionByName(near.join(first, "near").where("fp > a").select("a", F.col("fp").alias("b")))
    found = stored(pairs.distinct(), "links")
    discard(keys)
    discard(many)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is the component's smallest node.

    Large-star and small-star rounds in turn, until the edges stay the same. Each round's edges are a
    table in the shared folder; hubs are never gathered, only joined to their minimum.
    """
    edges = stored(edges, "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: the node, b: its neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("other"))  # each node and its smaller neighbours
        least = down.groupBy("node").agg(F.min("other").alias("m"))
        small = down.join(least, "node").select(F.col("m").alias("a"), F.explode(F.array("node", "other")).alias("b")).where("a < b").distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        mark = tuple(now)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links of two bits or fewer reach. Equal
    fingerprints are linked, zeros (null, empty and blank texts) like any other. Repeated
    rows stay; a null doc_id is never a component_id unless its whole component has none.
    Very long texts are fingerprinted whole, an empty table gives no rows. Other columns are not read.
    """
    prints = stored(document_prints(docs), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(distinct.select("fp"))
    roots = components(found)
    discard(found)
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")
