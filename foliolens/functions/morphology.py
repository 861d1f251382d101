"""Japanese tokens: a longest-match tokenizer over a dictionary, as an Arrow-batched function and as a table function.

A tokenizer is anything with tokenize(text) -> list of Token. Dictionaries are parameters and
are sent to executors once. Without one, Japanese fails rather than count nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions.text import bound

TOKEN = "struct<surface:string,pos1:string,pos2:string,cform:string,goshu:string,lemma:string,start:int>"
#: Tokens that a task holds at once, about, besides those of one row.
HELD_TOKENS = 20_000


class Token(NamedTuple):
    surface: str
    pos1: str = "名詞"
    pos2: str = ""
    cform: str = ""
    goshu: str = ""
    lemma: str = ""
    start: int = 0


class Morphology(Protocol):
    def tokenize(self, text: str) -> list[Token]: ...


class Dictionary:
    """Takes the longest known surface at each place (of equals the first given); other characters are nouns of one."""

    def __init__(self, entries: list[Token]) -> None:
        self.by_surface: dict[str, Token] = {}
        for e in entries:
            if e.surface:
                self.by_surface.setdefault(e.surface, e)
        self.lengths: dict[str, list[int]] = {}  # of the surfaces that begin with a character, the longest first
        for x in sorted(self.by_surface, key=len, reverse=True):
            own = self.lengths.setdefault(x[0], [])
            if len(x) not in own:
                own.append(len(x))

    @classmethod
    def of(cls, spec: str) -> Dictionary:
        """From items surface|pos1|pos2|cform|goshu|lemma with spaces between; * is empty, and later fields may be left out."""
        return cls([Token(*("" if x == "*" else x for x in item.split("|"))) for item in spec.split()])

    def tokenize(self, text: str) -> list[Token]:
        out, at = [], 0
        while at < len(text):
            c = text[at]
            for n in self.lengths.get(c, ()):
                known = self.by_surface.get(text[at : at + n])
                if known:
                    out.append(Token(*known[:6], at))
                    at += n
                    break
            else:
                if not c.isspace():  # as a real analyser, white space gives no token
                    out.append(Token(c, "補助記号", {"、": "読点", "。": "句点"}[c], start=at) if c in "、。" else Token(c, start=at))
                at += 1
        return out


def _token_arrays(rows: list[list[list[Token]]]) -> pa.Array:
    """Tokens of the texts of each row as an Arrow array, built by column."""
    texts = [text for row in rows for text in row]
    tokens = [t for text in texts for t in text]
    kinds = [pa.string()] * 6 + [pa.int32()]
    columns = [pa.array([t[k] for t in tokens], kind) for k, kind in enumerate(kinds)]
    ends = lambda x: pa.array(list(accumulate(map(len, x), initial=0)), pa.int32())
    return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(texts), pa.StructArray.from_arrays(columns, list(Token._fields))))


def token_batches(morphology: Morphology, batches: Iterator[pa.Array], most: int = HELD_TOKENS) -> Iterator[pa.Array]:
    """Tokens of arrays of texts, in batches of about so many tokens: a batch of many or long rows is not held whole."""
    for batch in batches:
        rows, held = [], 0
        for k in range(len(batch)):
            rows.append([morphology.tokenize(x or "") for x in batch[k].as_py() or ()])
            held += sum(map(len, rows[-1]))
            if held >= most:
                yield _token_arrays(rows)
                rows, held = [], 0
        if rows or not len(batch):
            yield _token_arrays(rows)


def tokens_of(morphology: Morphology):
    """A column function: array<string> of texts to array<array<token>>."""

    @F.arrow_udf(f"array<array<{TOKEN}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from token_batches(morphology, batches)

    return run


def tokenizer(morphology: Morphology | None):
    """A function that adds block_tokens, body_tokens and prose_tokens to parsed documents; each block is analysed once."""
    if morphology is None:
        raise ValueError("Japanese needs a dictionary")
    run = tokens_of(morphology)

    def add(parsed: DataFrame) -> DataFrame:
        d = parsed.withColumn("block_tokens", run(F.transform("blocks", lambda b: b["text"])))
        of = lambda *kinds: F.flatten(F.filter(F.transform("block_tokens", lambda t, i: F.when(F.get("blocks", i)["kind"].isin(*kinds), t)), lambda t: t.isNotNull()))
        return bound(d, body_tokens=of("Prose", "ListItem"), prose_tokens=of("Prose"))

    return add


def token_table(morphology: Morphology):
    """A table function over one text, for LATERAL joins: (pos, surface, pos1, pos2, cform, goshu, lemma, start)."""

    class Tokens:
        def eval(self, text: str):
            for k, t in enumerate(morphology.tokenize(text or "")):
                yield (k, *t)

    return F.udtf(Tokens, returnType="pos int, surface string, pos1 string, pos2 string, cform string, goshu string, lemma string, start int")
