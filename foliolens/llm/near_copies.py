"""Near copies by the true similarity of shingle sets: SimHash first, then a prefix-filtered join, all verified.

A text is the set of its runs of five words; equal sets are one node. SimHash fingerprints of these runs,
joined by their Golay-code keys, link most of what is almost equal at little cost. They reach few pairs near
the limit, so what they leave is found by prefixes: of two sets with a Jaccard similarity of 0.8 or more
whose members are put in one order, the first n - ceil(0.8 n) + 1 have one in common. So
these are a text's keys, and no such pair is missed whatever the order. Runs that are common in
a sample of the texts come last in it, so keys are rare. Pairs of a key are narrowed by size, place
and a sketch of the sets (folded to 128 bits within the join on keys, whole after it), and every link is verified on the whole sets.

Nodes that are connected already need no further link, so such pairs are left out. A key of many nodes is not expanded into pairs:
its nodes are held against a few of them first, and then only those outside its largest component against all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolens.llm import simhash
from foliolens.llm.common import discard, quoted, release, stored
from foliolens.llm.simhash import components, fingerprints, shingle_hashes

SIZE = 5
#: The similarity that links, as a fraction.
SIMILAR = (4, 5)
SAMPLE, COMMON = 2000, 3
#: A key with more nodes than this is not expanded into pairs at first.
CROWDED = 8
REPRESENTATIVES = 2
#: Ids of eight bytes that are broadcast at most; more of them are joined by a shuffle.
FEW = 1_000_000
#: Pairs of one hub that a task gets, about.
SPREAD = 500
#: Digests that a task remembers at most.
REMEMBERED = 1_000_000


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _bytes_of(texts) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def _all_shingles(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in _bytes_of(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, size).view(np.int64))], ["shingle"])


def common_shingles(docs: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, places in order of how often) of shingles that several texts of a bounded sample have."""
    share = docs.count() // SAMPLE + 1
    some = docs.select(F.col("text").cast("string")).where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(share)) == 0)
    found = some.mapInArrow(partial(_all_shingles, size), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).toArrow()
    hashes, counts = (found.column(k).to_numpy() for k in (0, 1))
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.lexsort((hashes, counts))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_hash = np.argsort(hashes)
    return hashes[by_hash], place[by_hash]


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The first members of a sorted set in the common order, of which any similar set shares one."""
    keep = len(own) + (-len(own) * similar[0] // similar[1]) + 1 if len(own) else 0
    hashes, places = common
    if not len(hashes):
        return own[:keep]
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    rank = np.where(hashes[at] == own, places[at], -1)
    return own[np.argsort(rank, kind="stable")[:keep]]


def _sketch(own: np.ndarray) -> bytes:
    """The parity of a set's members in each of 512 bins, or of as many as it has members: two sets differ in as many members, at least, as their sketches in bits.

    The number of bins is a power of two, so a sketch can be folded to that of a smaller set.
    """
    bins = 1 << max(9, int(len(own) - 1).bit_length())
    counts = np.bincount((own >> np.uint64(20) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes) -> tuple[int, int]:
    """A sketch folded to 128 bits, as two signed numbers; what holds of differing bits holds of these too."""
    words = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, 2), axis=0).view(np.int64)
    return int(words[0]), int(words[1])


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    if len(a) != len(b):
        n = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _with_nodes(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts = _bytes_of(pc.struct_field(batch.column("row"), "text"))
        sets = [shingle_set(x, size) for x in texts]
        columns = [pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fingerprints(texts, size), pa.int64()), pa.array(sketches := [_sketch(x) for x in sets], pa.binary())]
        folded = np.array([_folded(x) for x in sketches], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(folded[:, 0]), pa.array(folded[:, 1])], [*batch.schema.names, "node", "n", "fp", "sketch", "s0", "s1"])


#: What a key says of a node (its first eight bytes, its size, and where the key stands in its prefix).
_KEY_DDL = "key long, nid long, n int, place int"


def _keys(size: int, similar: tuple[int, int], shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common, seen = shared.value, set()
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            nodes, texts = part.column("node").to_pylist(), _bytes_of(part.column("text"))
            new = [k for k, x in enumerate(nodes) if x not in seen and not seen.add(x)]  # copies within a task give their keys once
            sets = [shingle_set(texts[k], size) for k in new]
            keys = [prefix(x, common, similar) for x in sets]
            counts = np.array([len(x) for x in keys], np.int64)
            which = np.repeat(np.arange(len(keys)), counts)
            nids = np.array([_nid(nodes[k]) for k in new], np.int64)
            sizes = np.array([len(x) for x in sets], np.int32)
            place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(nids[which]), pa.array(sizes[which]), pa.array(place.astype(np.int32))], ["key", "nid", "n", "place"])
            if len(seen) > REMEMBERED:
                seen.clear()


def _nid(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def nid_of(node: str) -> F.Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _placed(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole set of each text, with the hub that it goes to; a text that goes to several stands in rows that follow each other."""
    last, own = None, b""
    for batch in batches:
        sets = []
        for node, text in zip(batch.column("node").to_pylist(), _bytes_of(batch.column("text")), strict=True):
            if node != last:
                last, own = node, shingle_set(text, size).tobytes()
            sets.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("hub", "salt", "member", "node")), pa.array(sets, pa.binary())], ["hub", "salt", "member", "node", "own"])


def _against(similar: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds members against their hub, which comes first; there are two only where two nodes share a nid."""
    at, hubs = None, []
    for batch in batches:
        a, b = [], []
        for hub, salt, member, node, own in zip(*(batch.column(k).to_pylist() for k in ("hub", "salt", "member", "node", "own")), strict=True):
            if (hub, salt) != at:
                at, hubs = (hub, salt), []
            x = np.frombuffer(own, np.uint64)
            if not member:
                hubs.append((node, x))
                continue
            for other, y in hubs:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if other != node and similar[1] * both >= similar[0] * (len(x) + len(y) - both):
                    a.append(min(other, node))
                    b.append(max(other, node))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _sketched(similar: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out pairs whose sketches differ in more bits than similar sets can in members."""
    p, q = similar
    for batch in batches:
        if not len(batch):
            continue
        differ = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)], np.int64)
        sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        # |x - y| + |y - x| <= (1 - s) / (1 + s) * (|x| + |y|) for a similarity s = p / q or more.
        yield batch.select(["a", "b"]).filter(pa.array((q + p) * differ <= (q - p) * sizes))


def held(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """(a, b), the nodes of those pairs of nids whose whole sets are similar; stored.

    Sets move once, to the pair's first node, the hub. A hub of many pairs is spread over several tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPREAD)).cast("int").alias("k"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("nid"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "k").cast("int").alias("salt"), F.lit(1).alias("member"))
    hubs = sizes.select(F.col("a").alias("nid"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("member"))
    places = stored(members.unionByName(hubs).join(nodes.select("nid", "node", "rid"), "nid").select("rid", "node", "hub", "salt", "member"), "places")
    few = F.broadcast(places) if places.count() <= FEW else places  # 50 MB at most; texts then need not move
    texts = rows.select("rid", F.col("row.text").cast("string").alias("text")).join(few, "rid")
    sets = texts.select("hub", "salt", "member", "node", "text").mapInArrow(partial(_placed, size), "hub long, salt int, member int, node binary, own binary")
    found = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(partial(_against, similar), "a binary, b binary")
    found = stored(found.distinct(), "links")
    discard(places)
    release(rows.sparkSession)
    return found


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Enough of the links among pairs of nids to connect all that they connect.

    First each node is held against one other; then the pairs that are not connected by that.
    """
    a, b = (nodes.select(F.col("nid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    pairs = stored(pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(partial(_sketched, similar), "a long, b long").distinct(), "pairs")
    release(rows.sparkSession)
    if pairs.isEmpty():
        return pairs.select(F.lit(b"").alias("a"), F.lit(b"").alias("b")).limit(0)
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = held(star, rows, nodes, size, similar)
    root = rooted(nodes.select("nid").distinct(), components(found))
    rest = pairs.join(star, ["a", "b"], "left_anti").join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").where("ra <> rb").select("a", "b")
    rest = stored(rest, "rest")
    if not rest.isEmpty():
        found = found.unionByName(held(rest, rows, nodes, size, similar))
    discard(pairs)
    discard(rest)
    return found


def _pairs(left: DataFrame, right: DataFrame, similar: tuple[int, int], once: bool = True) -> DataFrame:
    """(a, b), a < b, of rows of both sides that share a key, are not connected yet, and that size, place and folded sketch let be similar."""
    p, q = similar
    a = left.select("key", F.col("nid").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("root").alias("rx"), F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    b = right.select("key", F.col("nid").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("root").alias("ry"), F.col("s0").alias("y0"), F.col("s1").alias("y1"))
    fits = F.expr(f"{q} * least(nx, ny) >= {p} * greatest(nx, ny) and {p + q} * least(nx - px, ny - py) >= {p} * (nx + ny) and rx <> ry and {p + q} * (bit_count(x0 ^ y0) + bit_count(x1 ^ y1)) <= {q - p} * (nx + ny)")
    differ = F.col("x") < F.col("y") if once else F.col("x") != F.col("y")
    return a.join(b, "key").where(differ & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def rooted(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """keys with root: the component of its node as far as known, or the node itself. Nodes with one nid and two roots count as not connected."""
    known = roots.groupBy(nid_of("node").alias("nid")).agg(F.min("root").alias("root"), F.max("root").alias("last")).where("root = last").select("nid", nid_of("root").alias("root"))
    return keys.join(known, "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): nids whose fingerprints are equal or linked within two bits, as far as is needed to connect them."""
    prints = stored(rows.select("fp", nid_of("node").alias("nid")).distinct(), "prints")
    first = prints.groupBy("fp").agg(F.min("nid").alias("a"))
    # One neighbour each: a large group has links without number, and what stays apart by this is found by prefixes.
    near = simhash.links(first.select("fp")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    same = prints.join(first, "fp").select("a", F.col("nid").alias("b"))
    other = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(rows: DataFrame, nodes: DataFrame, common, size: int = SIZE, similar: tuple[int, int] = SIMILAR, crowded: int | None = None) -> DataFrame:
    """(a, b) of similar nodes: enough of them to connect all that are connected.

    nodes: a row for each distinct set, with the rid of one of its rows.
    """
    crowded, spark = CROWDED if crowded is None else crowded, rows.sparkSession
    found = verified(simhash_pairs(rows), rows, nodes, size, similar)
    every = rows.select("node", F.col("row.text").cast("string").alias("text")).mapInArrow(partial(_keys, size, similar, spark.sparkContext.broadcast(common)), _KEY_DDL)
    # Most keys are those of one node only; they go before anything is joined.
    shared = stored(every.groupBy("key").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo < hi").select("key"), "shared")
    release(spark)
    folded = nodes.select("nid", "s0", "s1").distinct()  # nodes of one nid are held by each of their sketches
    keys = stored(rooted(every.join(shared, "key", "left_semi").distinct(), components(found)).join(folded, "nid"), "keys")
    discard(shared)
    release(spark)
    # A key all of whose nodes are connected has nothing to add.
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    counts = stored(counts.select("key", "c"), "counts")
    some = keys.join(counts.where(F.col("c") <= crowded).select("key"), "key", "left_semi")
    members = stored(keys.join(counts.where(F.col("c") > crowded).select("key"), "key", "left_semi"), "members")
    pairs = _pairs(some, some, similar)
    if members.isEmpty():
        more = verified(pairs, rows, nodes, size, similar)
        for x in (keys, counts, members):
            discard(x)
        return found.unionByName(more)
    first = members.groupBy("key").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64(F.lit(k), "nid").alias("h"), "nid", "n", "place", "root", "s0", "s1")) for k in range(REPRESENTATIVES)))).alias("r"))
    first = first.select("key", F.explode("r").alias("r")).select("key", "r.nid", "r.n", "r.place", "r.root", "r.s0", "r.s1").distinct()
    found = found.unionByName(verified(pairs.unionByName(_pairs(first, members, similar, once=False)), rows, nodes, size, similar))
    discard(keys)
    named = stored(rooted(members.drop("root"), components(found)), "named")
    main = named.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    rest = named.join(main, "key").where("root <> main").select("key", "nid", "n", "place", "root", "s0", "s1")
    more = verified(_pairs(rest, named, similar, once=False), rows, nodes, size, similar)
    for x in (counts, members, named):
        discard(x)
    return found.unionByName(more)


def survivors(docs: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of each component of texts linked by similarity; all of docs' columns.

    It is that with the smallest doc_id, nulls last; of rows that share it, that with the smallest
    hash of its text. Texts of fewer words than a shingle are similar if their words are equal,
    texts without words (null ones too) always. Ids play no part in what is linked, so rows that share or
    lack an id are dropped only as copies. Columns may have any name and type; very long texts are compared whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"))
    more = [T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("s0", T.LongType()), T.StructField("s1", T.LongType())]
    rows = stored(own.mapInArrow(partial(_with_nodes, size), T.StructType([*own.schema.fields, *more])), "rows")
    nodes = stored(rows.groupBy("node", "n", "sketch", "s0", "s1").agg(F.min("rid").alias("rid")).withColumn("nid", nid_of("node")), "nodes")
    roots = components(links(rows, nodes, common_shingles(docs, size), size, similar))
    others = [F.to_json(F.struct(F.col(f"row.{quoted(c)}").alias(c))) if isinstance(docs.schema[c].dataType, T.MapType | T.ArrayType | T.StructType | T.VariantType) else F.col(f"row.{quoted(c)}").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.struct(F.col("row.doc_id").isNull().alias("i"), F.col("row.doc_id").alias("d"), F.md5(F.col("row.text").cast("binary")).alias("t"), F.xxhash64(F.lit(1), *others).alias("o"), F.col("rid").alias("rid"))
    light = rows.select("node", "rid", rank.alias("rank")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = light.groupBy("root").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", F.col("first.rid").alias("stays"))
    gone = stored(light.select("root", "rid").join(first, "root").where("rid <> stays").select("rid"), "gone")
    release(spark)
    return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, "rid", "left_anti").select("row.*")
