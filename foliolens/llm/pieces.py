"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is written with "▁" for spaces and one in front, and cut where no piece can cross:
before each run of "▁", and between two characters that stand side by side in no piece. So units
can be solved alone. Distinct units of equal length advance together: at each place the
hashes of all substrings that end there are probed in the sorted keys of the pieces, and
the best sum of scores and its piece are stored for all units at once. Characters without a
piece fall back to their bytes. Decoding gives back the exact text, literal "▁" and runs of
white space included.

A model of merges (BPE) has ranks in place of scores. Its encoding is the only sequence
of pieces in which each two neighbours, merged anew, would stay as they are; every prefix of a
unit has one such sequence. So there a step scores 0 if the piece may follow the one that ends
where it begins, and nothing otherwise, and the maximum gives the ids of the merges themselves.
Verdicts on pairs of pieces are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliolens.llm.common import mix, small_batches, table, with_field
from foliolens.sources.files import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = "▁", "\udc81"  # the second, which no text holds, stands for a literal mark
#: Units that a task remembers; when there are more it starts anew.
REMEMBERED = 400_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_R = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)  # so that the leading bits of short substrings differ too
_CROSSING = re.compile(f"[^{MARK}]{MARK}")


class Pieces:
    """A vocabulary: sorted hashes of pieces with their ids and scores, byte ids, and bytes of each id.

    merges: scores are ranks, the highest merges first. Pieces are then known by their place in the
    sorted keys: rank (-1: a single character), left and right (the two that merge to it).
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], merges: bool = False) -> None:
        bytes_too = set(byte_ids)
        usable = [i for i in range(len(pieces)) if i not in special and i not in bytes_too and pieces[i]]
        if any(_CROSSING.search(pieces[i]) for i in usable):
            raise ValueError("a piece holds a space after another character; units cannot be cut at spaces")
        if merges:
            halves = _halves({pieces[i]: scores[i] for i in usable})
            usable = [i for i in usable if pieces[i] in halves]
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        keys = np.array([self._hash(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        self.scores = np.array([scores[i] for i in usable], np.float64)[order]
        self.lengths = np.array([len(pieces[i]) for i in usable], np.int64)[order]
        self.byte_ids = np.array(byte_ids, np.int64)
        self.fallback = float(self.scores.min() if len(usable) else -10.0) - 1.0  # of each byte
        self.spelled = [b"" if i in special else pieces[i].replace(MARK, " ").encode() for i in range(len(pieces))]
        for byte, i in enumerate(byte_ids):
            self.spelled[i] = bytes([byte])
        #: Pairs of characters that stand side by side in a piece.
        self.inner = np.unique(np.array([ord(a) << 32 | ord(b) for i in usable for a, b in zip(pieces[i], pieces[i][1:])], np.int64))
        self.merges = merges
        if merges:
            place = {pieces[usable[k]]: n for n, k in enumerate(order.tolist())}
            own = [pieces[usable[k]] for k in order.tolist()]
            by_score = np.argsort(-self.scores, kind="stable")
            self.rank = np.empty(len(own), np.int64)
            self.rank[by_score] = np.arange(len(own))
            self.rank[self.lengths == 1] = -1
            self.left = np.array([place[halves[x][0]] if halves[x] else -1 for x in own], np.int64)
            self.right = np.array([place[halves[x][1]] if halves[x] else -1 for x in own], np.int64)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        bytes_of = {int(model.id_to_piece(i)[1:-1], 16): i for i in n if model.is_byte(i)}
        if len(bytes_of) < 256:
            raise ValueError("the model has no byte fallback, so not every text can be given back")
        special = {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        scores = [model.get_score(i) for i in n]
        merges = all(float(scores[i]).is_integer() for i in n if i not in special and not model.is_byte(i))
        return cls([model.id_to_piece(i) for i in n], scores, [bytes_of[b] for b in range(256)], special, merges)

    def shared(self, spark: SparkSession):
        """A broadcast of plain arrays and lists: some MB at most, whatever the data."""
        return spark.sparkContext.broadcast(vars(self))

    @classmethod
    def of(cls, shared) -> Pieces:
        p = object.__new__(cls)
        vars(p).update(shared.value)
        return p

    @staticmethod
    def _hash(piece: str) -> int:
        x, power = 0, 1
        for c in piece:
            x = (x + (ord(c) + 1) * int(_SPREAD) * power) & (2**64 - 1)
            power = power * int(_R) & (2**64 - 1)
        return x

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces (places in keys; -1 for a character without one): do merges leave them as they are?

        Merges are undone from the latest on, on either side of the cut; the pieces that meet at
        the cut must not have merged before the next one was made.
        """
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x, y, limit = a[at], b[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            both = self.keys[x] + self.keys[y] * _POWERS[self.lengths[x]]
            found = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
            merged = np.where(self.keys[found] == both, self.rank[found], np.iinfo(np.int64).max)
            crossed = merged < limit
            ok[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry
            go = ~crossed & (first | (ry >= 0))
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            at, x, y, limit = at[go], x[go], y[go], limit[go]
        return ok


_POWERS = np.array([pow(int(_R), k, 1 << 64) for k in range(256)], np.uint64)


def _halves(scores: dict[str, float]) -> dict[str, tuple[str, str] | None]:
    """For each piece that merges can make of its own characters, the two pieces of the last merge (None: a character)."""
    found: dict[str, tuple[str, str] | None] = {}
    for piece in scores:
        parts, last = list(piece), None
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (scores.get(parts[k] + parts[k + 1], -np.inf), -k))
            if parts[best] + parts[best + 1] not in scores:
                break
            last = (parts[best], parts[best + 1])
            parts[best : best + 2] = ["".join(last)]
        if len(parts) == 1:
            found[piece] = last
    return found


class Pairs:
    """A direct-mapped memory of may_follow(): a pair's slot holds the last pair that was put there."""

    SIZE = 1 << 20

    def __init__(self, p: Pieces) -> None:
        self.p, self.keys, self.said = p, np.full(self.SIZE, -1, np.int64), np.zeros(self.SIZE, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a + 1) << 24 | b
        slot = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out, miss = self.said[slot], np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            said = self.p.may_follow((new >> 24) - 1, new & 0xFFFFFF)
            out[miss] = said[which]
            slot = (mix(new.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.keys[slot], self.said[slot] = new, said
            # Where two new pairs share a slot, numpy keeps one key; its verdict must be its own.
            self.said[slot] = said[np.searchsorted(new, self.keys[slot])]
        return out


def best_pieces(p: Pieces, units: list[str], pairs: Pairs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many) of the units' best segmentations; of equal sums the one with the longer last piece."""
    pairs = pairs or (Pairs(p) if p.merges else None)
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes, at = np.unique(lengths[order], return_index=True)
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    # Where the sorted keys with certain leading bits begin, and how many there are at most; most substrings meet none.
    leading = (p.keys >> np.uint64(44)).astype(np.int64)
    begins = np.full(1 << 20, -1, np.int32)
    begins[leading[::-1]] = np.arange(len(leading), dtype=np.int32)[::-1]
    together = int(np.bincount(leading).max()) if len(leading) else 0
    flat, counts = [], []
    for k, n in enumerate(sizes):
        group = order[at[k] : at[k + 1] if k + 1 < len(at) else len(order)]
        width = max(1, (1 << 17) // int(n))
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        for b in range(0, len(group), width):
            own = group[b : b + width]
            codes = np.frombuffer("".join([units[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
            sums = np.zeros((n + 1, len(own)), np.uint64)
            np.cumsum((codes.T.astype(np.uint64) + np.uint64(1)) * (up[:n, None] * _SPREAD), axis=0, dtype=np.uint64, out=sums[1:])
            size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))).T
            total = np.full((n + 1, len(own)), -np.inf)
            total[0] = 0
            step, piece = np.zeros((n + 1, len(own)), np.int32), np.full((n + 1, len(own)), -1, np.int64)  # piece: a place in keys
            rows = np.arange(len(own))
            for j in range(1, n + 1):
                first = max(0, j - p.longest)  # the longest substring first, so that it wins ties
                hashes = (sums[j] - sums[first:j]) * down[first:j, None]
                found = begins[(hashes >> np.uint64(44)).view(np.int64)]
                x, y = np.nonzero(found >= 0)
                probe, found = hashes[x, y], found[x, y]
                good = p.keys[found] == probe
                for more in range(1, together):
                    rest = np.flatnonzero(~good)
                    at_rest = np.minimum(found[rest] + more, len(p.keys) - 1)
                    hit = p.keys[at_rest] == probe[rest]
                    found[rest[hit]], good[rest[hit]] = at_rest[hit], True
                x, y, found = x[good], y[good], found[good]
                here, last = np.full(hashes.shape, -np.inf), np.full(hashes.shape, -1, np.int64)
                here[-1] = total[j - 1] + size[j - 1] * p.fallback
                last[x, y] = found
                if p.merges:
                    here[x, y] = np.where(pairs(piece[first + x, y], found), 0.0, -np.inf)
                else:
                    here[x, y] = total[first + x, y] + p.scores[found]
                best = np.argmax(here, axis=0)
                total[j], step[j], piece[j] = (0.0 if p.merges else here[best, rows]), j - first - best, last[best, rows]
            # All units walk back together; a place without a piece is spelled in bytes.
            where, steps = np.full(len(own), n), []
            while len(rows):
                steps.append((rows, piece[where, rows], codes[rows, where - 1]))
                where = where - step[where, rows]
                rows, where = rows[where > 0], where[where > 0]
            who, ids, last = (np.concatenate([s[c] for s in steps[::-1]]) for c in range(3))
            sort = np.argsort(who, kind="stable")
            who, ids, last = who[sort], ids[sort], last[sort]
            ids = np.where(ids < 0, -1, p.ids[ids] if len(p.ids) else -1)
            if (bare := ids < 0).any():
                spelled = {c: p.byte_ids[list((MARK if chr(c) == LITERAL else chr(c)).encode())] for c in np.unique(last[bare]).tolist()}
                longer = np.ones(len(ids), np.int64)
                longer[bare] = [len(spelled[c]) for c in last[bare].tolist()]
                who, bare, last, ids = (np.repeat(v, longer) for v in (who, bare, last, ids))
                ids[bare] = _spell(spelled, last[bare])
            flat.append(ids.astype(np.int32))
            counts.append(np.bincount(who, minlength=len(own)))
    # Back to the units' own order.
    how_many = np.zeros(len(units), np.int64)
    if not len(units):
        return np.zeros(0, np.int32), how_many
    flat, counts = np.concatenate(flat), np.concatenate(counts)
    starts = np.empty(len(units), np.int64)
    starts[order], how_many[order] = np.cumsum(counts) - counts, counts
    return taken(flat, starts, how_many), how_many


def _spell(spelled: dict[int, np.ndarray], last: np.ndarray) -> np.ndarray:
    """Byte ids of characters, each of which stands as often as it has bytes."""
    out, k = np.empty(len(last), np.int64), 0
    while k < len(last):
        own = spelled[int(last[k])]
        out[k : k + len(own)] = own
        k += len(own)
    return out


def taken(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at begins, one after the other."""
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)]


#: A unit longer than this is cut again, wherever no piece has the two characters at the cut.
LONG = 24


def _units(p: Pieces, text: str) -> list[str]:
    if not text:
        return []
    found = _UNIT.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))
    if max(map(len, found)) <= LONG:
        return found
    return [part for u in found for part in ([u] if len(u) <= LONG else _parted(p, u))]


def _parted(p: Pieces, unit: str) -> list[str]:
    codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pair = codes[:-1] << 32 | codes[1:]
    at = np.minimum(np.searchsorted(p.inner, pair), len(p.inner) - 1)
    cuts = [0, *(np.flatnonzero(p.inner[at] != pair) + 1).tolist(), len(unit)] if len(p.inner) else list(range(len(unit) + 1))
    return [unit[a:b] for a, b in zip(cuts, cuts[1:])]


class Known:
    """Units that were solved: their numbers, and the ids of each."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.pairs: Pairs | None = None
        self.flat, self.begins, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, p: Pieces, new: list[str]) -> None:
        if p.merges and self.pairs is None:
            self.pairs = Pairs(p)
        flat, counts = best_pieces(p, new, self.pairs)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(counts) - counts])
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])


def encode(p: Pieces, texts: list[str | None], known: Known | None = None) -> list[np.ndarray]:
    """Ids of each text; null and empty texts have none."""
    known = known or Known()
    split = [_units(p, t or "") for t in texts]
    if len(known.number) > REMEMBERED:
        known.__init__()
    number = known.number
    flat = list(chain.from_iterable(split))
    if new := list(set(flat) - number.keys()):
        known.learn(p, new)
    which = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    counts = known.counts[which]
    ids = taken(known.flat, known.begins[which], counts)
    cuts = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(u) for u in split], dtype=np.int64)])]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def decode(p: Pieces, ids) -> str:
    """The text that encode() was given."""
    return b"".join(map(p.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _encoded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, known = Pieces.of(shared), Known()
    for batch in batches:
        ids = encode(p, batch.column("text").to_pylist(), known)
        sizes = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs with ids, an array for each text; a narrow operation.

    Null and empty texts have no ids. Repeated rows are encoded alike, other columns are carried; a
    column of docs named ids is replaced.
    """
    docs = docs.drop("ids")
    shared = pieces.shared(docs.sparkSession)
    return docs.mapInArrow(partial(_encoded, shared), with_field(docs, "ids", T.ArrayType(T.IntegerType())))


def _decoded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = Pieces.of(shared)
    for batch in batches:
        ids = batch.column("ids")
        flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = [decode(p, flat[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with decoded, the text of each row's ids."""
    rows = rows.drop("decoded")
    shared = pieces.shared(rows.sparkSession)
    return rows.mapInArrow(partial(_decoded, shared), with_field(rows, "decoded", T.StringType()))


def _digested(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, known = Pieces.of(shared), Known()
    spelled_by_byte = np.zeros(len(p.spelled), bool)
    spelled_by_byte[p.byte_ids] = True
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = encode(p, texts, known)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(spelled_by_byte[x].sum()) for x in ids], pa.int64()),
             pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array([decode(p, x.tolist()) == t for x, t in zip(ids, texts, strict=True)])],
            ["doc_id", "n_ids", "n_byte_ids", "ids_sha256", "round_trip"],
        )


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Encodes every whole text and decodes it again: (doc_id, n_ids, n_byte_ids, ids_sha256, round_trip).

    Null and empty texts have no ids and round_trip true. Null ids and repeated rows are kept, an empty table gives
    no rows, other columns are not read. Very long texts are encoded whole, in time in proportion to their length.
    """
    small_batches(spark)
    shared = Pieces.load(model).shared(spark)
    rows = spread(table(spark, sf_dir, "documents")).selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(partial(_digested, shared), "doc_id long, n_ids long, n_byte_ids long, ids_sha256 string, round_trip boolean")
