"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space folded. An item that may have k
errors is split into k + 1 pieces; where it stands in a text with k errors at most, one piece is
there exactly. An automaton finds all pieces of all items in one pass over the text, and each hit is verified
with Myers' bit-parallel distance over the window that the piece's place implies.

Items are taken in blocks of bounded size. A block is broadcast once and held against all documents in a
narrow pass; where there are several, what a pass found is written before the next, so a task holds
one automaton at a time.

An item of under LEAST characters is no passage but a word or less, as "the", and is not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import discard, quoted, small_batches, stored, table
from foliolens.sources.files import spread

#: Errors allowed, as a share of an item's characters, and the shortest piece.
RATE, SHORTEST = 0.06, 8
#: The shortest item that is looked for, in characters with its white space folded: one piece.
LEAST = SHORTEST
#: About so many characters of items are in a block at most (one longer item is a block).
BLOCK = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    """Errors allowed in an item of that length: each of budget + 1 pieces has SHORTEST characters at least."""
    return max(0, min(int(length * rate), length // SHORTEST - 1))


def split(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: str, masks: dict[str, int], window: str, k: int) -> int:
    """The least edit distance of item to any part of window (Myers 1999); k + 1 if it is over k."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in window:
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus, h_minus = minus | (full & ~(d0 | plus)), plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus, h_minus = h_plus << 1, h_minus << 1  # a match may begin anywhere, so nothing is carried in
        plus, minus = (h_minus | ~(d0 | h_plus)) & full, h_plus & d0
        if score < best:
            best = score
            if not best:
                break
    return min(best, k + 1)


class Matcher:
    """The automaton of a block of (item_id, normal text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = LEAST) -> None:
        import ahocorasick

        self.items, places = [], {}
        for item_id, item in items:
            if len(item) < max(1, least):
                continue
            k = budget(len(item), rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            for offset, piece in split(item, k):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, item, k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """The least distance of each item that text holds."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        done: dict[int, list[int]] = {}  # by item: starts of windows that were verified
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                item_id, item, k, masks = self.items[n]
                if found.get(item_id) == 0:
                    continue
                start = end + 1 - size - offset
                seen = done.setdefault(n, [])
                if seen and start in seen[-8:]:
                    continue
                seen.append(start)
                if text.startswith(item, max(0, start)) and start >= 0:
                    got = 0
                else:
                    got = distance(item, masks, text[max(0, start - k) : start + len(item) + k], k)
                if got <= k:
                    found[item_id] = min(got, found.get(item_id, got))
        return found


_HITS = "array<struct<item_id: bigint, distance: int>>"


def _search(shared, rate: float, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(shared.value, rate, least)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    for batch in batches:
        before = batch.column("hits").to_pylist()
        hits = [old + [{"item_id": i, "distance": d} for i, d in sorted(matcher.find(normal(t)).items())] for t, old in zip(batch.column("text").to_pylist(), before, strict=True)]
        columns = [pa.array(hits, kind) if n == "hits" else batch.column(k) for k, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Items as (item_id, normal text), in blocks by hash of the id; null ids and items without words are left out."""
    known = benchmark.where("item_id is not null and text is not null")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // most + 1
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").distinct().collect()
        yield sorted((r.item_id, normal(r.text)) for r in rows)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """docs with hits: the items that each text holds within their error budget, with the least distance.

    Null and empty texts hold none; very long ones are searched whole. Null ids are kept and repeated rows treated alike; other columns are
    carried, and one named hits is replaced. Items with equal texts are all reported, items of under least characters never. Without items no row has hits.
    """
    out = docs.select(*(F.col(quoted(n)) for n in docs.columns if n != "hits"), F.array().cast(_HITS).alias("hits"))
    schema, before = out.schema, None
    for k, items in enumerate(blocks(benchmark, block)):
        if k:
            out = stored(out, "hits")
            if before is not None:
                discard(before)
            before = out
        out = out.mapInArrow(partial(_search, docs.sparkSession.sparkContext.broadcast(items), rate, least), schema)
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaked, n_items, item_ids, min_distance) for every document; min_distance is null where nothing is found."""
    small_batches(spark)
    out = matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("leaked"), F.size("hits").cast("long").alias("n_items"), F.array_sort("hits.item_id").alias("item_ids"), F.array_min("hits.distance").alias("min_distance"))
