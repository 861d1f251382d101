"""Chat formatting: a finite-state machine over roles, and a declarative template.

A conversation's turns are sorted and streamed, never gathered: formatting keeps the
machine's state, reading back keeps the bytes of one turn. So a conversation may be
longer than any memory. The output is a stream of segments, each with a loss flag; put
together they are the conversation's text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import partitions, small_batches, table


@dataclass(frozen=True)
class Template:
    """What stands around a turn. controls are escaped in texts, so that none of them is left there."""

    open: str = "### "
    after_role: str = ":\n"
    close: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> {role: next state}; a turn that has no transition is an error, and the machine goes on from its role.
    turns: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"},
    })
    ends: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> tuple[str, ...]:
        return tuple(x.strip() for x in (self.open, self.close))

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for x in self.controls():
            text = text.replace(x, self.escape + x)
        return text

    def escaped_role(self, role: str) -> str:
        return self.escaped(role).replace(":", self.escape + ":")

    def unescaped(self, text: str) -> str:
        """What escaped() was given: an escape sign stands before each sign or control that it escapes."""
        out, at = [], 0
        while (k := text.find(self.escape, at)) >= 0:
            out.append(text[at:k])
            at = k + len(self.escape) * 2 if text.startswith(self.escape, k + len(self.escape)) else k + len(self.escape)
            if at == k + len(self.escape) * 2:
                out.append(self.escape)
        out.append(text[at:])
        return "".join(out)

    def find(self, control: str, text: str, at: int = 0) -> int:
        """Where a control stands that is not escaped, or -1."""
        while (k := text.find(control, at)) >= 0:
            n, j = 0, k
            while j >= len(self.escape) and text.startswith(self.escape, j - len(self.escape)):
                n, j = n + 1, j - len(self.escape)
            if n % 2 == 0:
                return k
            at = k + 1
        return -1


_SEGMENTS = "conv_id long, seq long, text string, loss boolean, ends boolean, error string"


def _format(t: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, state, seq, error = none, "start", 0, None
        rows: list[tuple] = []

        def ended() -> list[tuple]:
            said = error or (None if state in t.ends else f"ends after {state}")
            return [(at, seq, "", False, True, said)] if at is not none else []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "seq", "text", "loss", "ends", "error"])

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if at is none or conv != at:
                    rows += ended()
                    at, state, seq, error = conv, "start", 0, None
                role, text = role or "", text or ""
                after = t.turns.get(state, {}).get(role)
                if after is None:
                    error = error or f"turn {turn}: {role!r} after {state}"
                    after = role
                state = after
                for piece, loss in ((t.open + t.escaped_role(role) + t.after_role, False), (t.escaped(text), role in t.loss_roles), (t.close, False)):
                    rows.append((at, seq, piece, loss, False, None))
                    seq += 1
            yield batch_of(rows)
            rows = []
        yield batch_of(ended())

    return run


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, seq, text, loss, ends, error): a row for each segment, in order within its partition.

    turns: (conv_id, turn, role, text). Rows are taken by turn, ties by role, then text;
    repeated rows are kept as turns. Null texts and roles are empty; a null turn comes
    first; rows without conv_id make one conversation. Other columns are not read. Each
    conversation ends with a row that has ends and, if its roles are out of order, the
    first error; it is formatted all the same.
    """
    chosen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = chosen.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template), _SEGMENTS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"


def _read_back(t: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
        names = [x.split()[0] for x in _READ.split(", ")]

        def fresh() -> dict:
            return {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "text": [], "kept": []}

        s = fresh()
        for batch in batches:
            rows = []
            for conv, text, loss, ends, error in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "ends", "error")), strict=True):
                if ends:
                    if s["text"]:
                        raise ValueError(f"conversation {conv} ends inside a turn")
                    rows.append((conv, s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], error is None, error))
                    s = fresh()
                    continue
                s["chars"] += len(text)
                s["text"].append(text)
                if loss:
                    s["kept"].append(text)
                if not text.endswith(t.close):
                    continue
                whole = "".join(s["text"])
                end = t.find(t.close, whole)
                if end < 0:
                    continue
                if end + len(t.close) != len(whole) or not whole.startswith(t.open):
                    raise ValueError(f"conversation {conv}: a turn does not end where it should")
                middle = t.find(t.after_role, whole)
                role, said = t.unescaped(whole[len(t.open) : middle]), t.unescaped(whole[middle + len(t.after_role) : end])
                s["turns"] += 1
                s["all"].update(f"{role}\n{said}\n".encode())
                kept = t.unescaped("".join(s["kept"]))
                s["loss"].update(kept.encode())
                s["loss_chars"] += len(kept)
                s["text"], s["kept"] = [], []
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def read_chats(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parses what format_chats gave (rows must still be in its order) and digests each conversation."""
    return segments.mapInArrow(_read_back(template), _READ)


ODD = r"\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    own = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_chats(format_chats(turns))


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}')),
s as (
  select *, coalesce(lag(role) over w, 'start') as state, lead(role) over w is null as last,
         length('### ') + length(replace({_ESCAPED.format("role")}, ':', '\\:')) + 2 + length({_ESCAPED.format("text")}) + 8 as chars
  from t window w as (partition by conv_id order by turn, role, text)),
c as (
  select *, case when state = 'start' and role in ('system', 'user') or state = 'system' and role = 'user' or state = 'user' and role = 'assistant'
                   or state = 'assistant' and role = 'user' then null
                 else 'turn ' || turn || ': ''' || role || ''' after ' || state end as error
  from s)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars,
       coalesce(min_by(error, turn) filter (error is not null), max('ends after ' || role) filter (last and role <> 'assistant')) is null as valid,
       coalesce(min_by(error, turn) filter (error is not null), max('ends after ' || role) filter (last and role <> 'assistant')) as error
from c group by conv_id
"""
