"""Queries over the driver's tables, one for each operator, and the SQL they are held against.

The tables hold plain prose. markdown_docs() and MD build the same Markdown documents from them in
both engines: sentences of each text take turns in some two dozen constructs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T
from foliolens.operators import corpus, metrics, parse, profiles, rules, structure, terms
from foliolens.plans import report
from foliolens.sources.files import spread

# --- the Markdown corpus -------------------------------------------------------------------------

_NL = "chr(10)"
_FORMS = [
    "s || '.'", "{n} || '## 2. Numbers'", "s || ' is currently so. Soon it ends.'", "s || ' came in 2024-05 and recently. The latest v1.2 holds'", "{n} || 'There are three ways to do it.'",
    "'- ' || s || '.'", "'- ' || s", "'- 1. ' || s || ', etc.'", "{n} || 'Consider the following two steps:'", "'1. ' || s", "'  * ' || s || ' and so on'", "{n} || '### Empty heading'",
    "'## Motivation'", "'```python' || {n} || '# no heading' || {n} || s || {n} || '```'", "s || ' works like a charm, for example'", "'> quoted ' || s", "'| a | ' || s || ' |'",
    "'{{{{< highlight go >}}}}' || {n} || s || {n} || '{{{{< /highlight >}}}}'", "s || ' with <b>bold</b> and [link](http://x.y/z), `code_span` and ' || chr(92) || '*escaped' || chr(92) || '*'",
    "'We tried a thing. We found that ' || s", "{n} || 'In order:'", "'* ' || s", "'* ' || s || '!'", "s || '. A b c d. E f g h! I j k l. M n o p? Q r s t. U v w x. Y z a b'",
    "'Over the last three months ' || s", "'The JSON API uses HTTP Gateway here, see ' || s",
]
_CASE = "case i % 26 " + " ".join(f"when {k} then {x.format(n=_NL)}" for k, x in enumerate(_FORMS)) + " end"
_TYPE = "case doc_id % 5 when 0 then 'design' when 1 then 'howto' when 2 then 'readme' when 3 then 'decision' end"
_MATTER = f"case when doc_id % 5 < 4 then '---' || {_NL} || 'doctype: ' || ({_TYPE}) || {_NL} || '---' || {_NL} else '' end || '# Guide ' || doc_id || {_NL}"
_SPARK_MD = rf"{_MATTER} || array_join(transform(filter(split(coalesce(text, ''), '[.\n]+'), s -> s rlike '[A-Za-z]'), (s, i) -> {_CASE}), {_NL})"
_DUCK_MD = rf"{_MATTER} || coalesce(array_to_string(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[.\n]+'), lambda s: regexp_matches(s, '[A-Za-z]')), lambda s, k: list_transform([k - 1], lambda i: {_CASE})[1]), {_NL}), '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).where("doc_id is not null")
    return d.select("doc_id", "lang", F.col("source").alias("domain"), F.expr(_SPARK_MD).alias("source"), F.expr(_TYPE).alias("doctype"))


def parsed_docs(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return parse.parse(markdown_docs(spark, sf_dir), "source", *parts)


_W = T.UWS
#: Blocks of the Markdown corpus. Its fences and shortcodes are never nested, so parity tells what is inside.
MD = rf"""
md as (select doc_id, lang, source as domain, {_DUCK_MD} as source, {_TYPE} as doctype from documents where doc_id is not null),
l0 as (select doc_id, unnest(string_split(replace(source, chr(13) || chr(10), chr(10)), chr(10))) as x, generate_subscripts(string_split(replace(source, chr(13) || chr(10), chr(10)), chr(10)), 1) as line, doctype is not null as fm from md),
l1 as (select doc_id, line, case when fm and line <= 3 then '' else x end as x from l0),
l2 as (select *, regexp_matches(x, '^[{_W}]{{0,3}}(```|~~~)') as f, starts_with(x, '{{{{< ') as c from l1),
l3 as (select *, count(*) filter (f) over w % 2 = 1 or f as in_f, count(*) filter (c) over w % 2 = 1 or c as in_c from l2 window w as (partition by doc_id order by line)),
code as (select doc_id, line from l3 where in_f or in_c),
t1 as (select doc_id, regexp_replace(string_agg(case when in_f or in_c then '' else x end, chr(10) order by line), '\\([.\-+*_#`\[\]()<>|])', '\1', 'g') as t from l3 group by doc_id),
t2 as (select doc_id, string_split_regex(t, '<[^>]+>') as g, regexp_extract_all(t, '<[^>]+>') as m from t1),
t3 as (select doc_id, string_split(array_to_string(list_transform(range(1, len(g) + 1), lambda k: g[k] || coalesce(repeat(chr(10), length(m[k]) - length(replace(m[k], chr(10), ''))), '')), ''), chr(10)) as l from t2),
r0 as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as line from t3),
r1 as (select *, lag(raw) over (partition by doc_id order by line) as prev from r0),
r2 as (select doc_id, line, raw, prev is null or not regexp_matches(prev, '[^{_W}]') as blank_before,
  regexp_matches(raw, '(?s)^ {{0,3}}#{{1,6}}[{_W}]+(.*)$') as h, regexp_matches(raw, '(?s)^([{_W}]*)([-*+]|\p{{Nd}}+[.)])[{_W}]+(.*)$') as li,
  regexp_replace(raw, '^[{_W}]+|[{_W}]+$', '', 'g') as tr from r1 where regexp_matches(raw, '[^{_W}]')),
r3 as (select *, case when h then 'Heading' when li then 'ListItem' when starts_with(tr, '|') then 'Table' when starts_with(tr, '>') then 'Quote' else 'Prose' end as kind,
  case when h then regexp_extract(raw, '(?s)^ {{0,3}}#{{1,6}}[{_W}]+(.*)$', 1) when li then regexp_extract(raw, '(?s)^([{_W}]*)([-*+]|\p{{Nd}}+[.)])[{_W}]+(.*)$', 3) else tr end as t,
  regexp_extract(raw, '(?s)^([{_W}]*)([-*+]|\p{{Nd}}+[.)])[{_W}]+(.*)$', 1) as ind, regexp_extract(raw, '(?s)^([{_W}]*)([-*+]|\p{{Nd}}+[.)])[{_W}]+(.*)$', 2) as mark from r2),
blocks as (select doc_id, row_number() over (partition by doc_id order by line)::int as seq, kind, line::int as line,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`[^`]*`', '', 'g'), '\*\*([^*]*)\*\*|\*([^*]*)\*', '\1\2', 'g'), '^[{_W}]+|[{_W}]+$', '', 'g') as text,
  case when kind = 'ListItem' then (length(regexp_replace(ind, '[^ ]', '', 'g')) + 2 * length(regexp_replace(ind, '[^\t]', '', 'g'))) // 2 else 0 end::int as depth,
  kind = 'ListItem' and mark not in ('-', '*', '+') as ordered, raw, blank_before from r3)"""


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rows_of(parsed_docs(spark, sf_dir, "blocks"), "blocks", "doc_id")


def md_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rows_of(parsed_docs(spark, sf_dir, "paragraphs"), "paragraphs", "doc_id")


_PARAGRAPHS = """
p0 as (select *, lag(kind) over w is distinct from 'Prose' or blank_before as b from blocks window w as (partition by doc_id order by seq)),
p1 as (select *, sum(case when b then 1 else 0 end) over (partition by doc_id order by seq) as pid from p0),
paragraphs as (select doc_id, min(line)::int as line, string_agg(text, ' ' order by seq) as text from p1 where kind = 'Prose' group by doc_id, pid)"""


def md_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rows_of(parsed_docs(spark, sf_dir, "outline"), "outline", "doc_id")


_OUTLINE = """
h0 as (select doc_id, seq, line, text, length(regexp_extract(raw, '^ *(#*)', 1))::int as level from blocks where kind = 'Heading'),
h1 as (select *, lead(line) over w as next_line, lead(level) over w as next_level, lead(seq) over w as next_seq from h0 window w as (partition by doc_id order by seq)),
n as (select doc_id, max(seq) as most from blocks group by doc_id),
outline as (select h1.doc_id, seq, line, level, text, coalesce(next_seq, most + 1) - seq > 1 or exists (select 1 from code c where c.doc_id = h1.doc_id and c.line > h1.line and c.line < coalesce(next_line, 1000000000)) as has_body,
  coalesce(next_level > level, false) as has_child from h1 join n using (doc_id))"""


def md_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rows_of(parsed_docs(spark, sf_dir, "lists"), "lists", "doc_id")


def md_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.metrics_en(parsed_docs(spark, sf_dir, "prose", "body"), "doc_id")
    return d.withColumn("value", F.round("value", 9))


_SIMILES = " + ".join(f"(length(low) - length(replace(low, '{m}', ''))) // {len(m)}" for m in V.SIMILE_MARKERS)
_METRICS = rf"""
b1 as (select doc_id, coalesce(string_agg(case when kind in ('Prose', 'ListItem') then text end, chr(10) order by seq), '') as body, coalesce(string_agg(case when kind = 'Prose' then text end, chr(10) order by seq), '') as prose,
  count(*) filter (kind = 'ListItem') as items, count(*) as n from blocks group by doc_id),
b2 as (select *, lower(body) as low, length(regexp_replace(body, '[{_W}]+', '', 'g')) as bc, length(regexp_replace(prose, '[{_W}]+', '', 'g')) as pc,
  list_filter(list_transform(string_split_regex(body, '[{_W}]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: w <> '') as ws from b1),
tok as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as p, len(ws) as n from b2),
seen as (select *, coalesce(lag(p) over (partition by doc_id, w order by p), -1) as q from tok),
mattr as (select doc_id, case when any_value(n) < 100 then count(distinct w) / any_value(n) else sum(greatest(0, least(p, n - 100) - greatest(0, p - 99, q + 1) + 1)) / 100 / (any_value(n) - 99) end as v from seen group by doc_id),
metrics as (
  select doc_id, 'en.mattr100' as metric, coalesce(v, 0) as value from b2 left join mattr using (doc_id)
  union all select doc_id, 'en.prose_ratio', case when bc = 0 then 0 else pc / bc end from b2
  union all select doc_id, 'en.list_ratio', items / n from b2
  union all select doc_id, 'en.simile_marker_per_1k', ({_SIMILES}) / len(ws) * 1000 from b2 where len(ws) >= 1250)"""


def md_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents out of range, by the thresholds of their type, and what to do about them."""
    d = parsed_docs(spark, sf_dir, "prose", "body").withColumn("_type", F.coalesce("doctype", F.lit("")))
    measured = metrics.metrics_en(d, "doc_id", "_type")
    out = metrics.out_of_range(measured, profiles.by_doctype(profiles.builtin(spark)).withColumnRenamed("doctype", "_type"), "_type")
    return out.select("doc_id", F.col("_type").alias("doctype"), "metric", F.round("value", 9).alias("value"), "threshold", "direction", "severity", "guidance")


def _values(rows) -> str:
    literal = lambda x: "null" if x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else f"{x}::double" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


_PROFILE = f"""
th(metric, threshold, direction, severity, guidance) as (values {_values(V.THRESHOLDS)}),
dt(doctype, metric, value) as (values {_values(V.DOCTYPE_THRESHOLDS)}),
ty(doctype) as (values {_values([("",), *((d,) for d in V.DOCTYPES)])}),
profile as (select ty.doctype, th.metric, coalesce(dt.value, th.threshold) as threshold, direction, severity, guidance from ty cross join th left join dt on dt.doctype = ty.doctype and dt.metric = th.metric where dt.metric is null or dt.value is not null)"""


def profile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.by_doctype(profiles.builtin(spark))


def md_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the maintainability rules, at most twenty a rule."""
    d, found = rules.maintainability(parsed_docs(spark, sf_dir, "lists", "outline"), "en")
    return rules.positions(rules.findings(d, found, "doc_id"), "doc_id").select("doc_id", "rule_id", "n", "line", "column", "text")


_TIME = "(?i)\\b(" + "|".join(V.TIME_DEPENDENT["en"]) + ")\\b"
_PERIOD = V.RELATIVE_PERIOD["en"]


def _hits(pattern: str, where: str, name: str) -> str:
    return f"""
{name}0 as (select doc_id, seq, line, text, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from nb where {where} and regexp_matches(text, '{pattern}')),
{name}1 as (select doc_id, seq, line, text, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'s': list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), 'w': m[k]}})) as x from {name}0),
{name} as (select doc_id, line, (x.s + 1)::int as col, x.w || '｜' || case when x.s > 20 then '…' else '' end || substring(text, greatest(x.s - 20, 0)::int + 1, (least(x.s + length(x.w) + 20, length(text)) - greatest(x.s - 20, 0))::int) || case when x.s + length(x.w) + 20 < length(text) then '…' else '' end as t,
  regexp_extract(substring(text, 1, x.s::int), '[^.!?]*$') || regexp_extract(substring(text, x.s::int + 1), '^[^.!?]*[.!?]?') as sentence from {name}1)"""


_FINDINGS = rf"""
nb as (select *, lead(kind) over w as nk, lead(text) over w as nt, lead(raw) over w as nr, lag(kind) over w as pk, lag(text) over w as pt, lag(line) over w as pl, lag(seq) over w as ps,
  last_value(case when kind = 'Heading' then length(regexp_extract(raw, '^ *(#*)', 1)) end ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as here,
  sum(case when kind <> 'ListItem' then 1 else 0 end) over (partition by doc_id order by seq) as gid, sum(case when kind = 'Heading' then 1 else 0 end) over (partition by doc_id order by seq) as hn
  from blocks window w as (partition by doc_id order by seq)),
{_hits(V.ITEM_COUNT["en"], f"kind = 'Prose' and (regexp_matches(text, '{V.FORWARD['en']}') or nk in ('ListItem', 'Table') or (nk = 'Heading' and (here is null or length(regexp_extract(nr, '^ *(#*)', 1)) > here)) or (nk = 'Prose' and regexp_matches(nt, '{V.ENUMERATION['en']}')))", "m2")},
{_hits(_TIME, "true", "m6a")}, {_hits(_PERIOD, "true", "m6b")},
m6 as (select doc_id, line, col, min_by(t, k) as t from (select *, 0 as k from m6a union all select *, 1 from m6b) where not regexp_matches(sentence, '{V.ANCHOR}') group by doc_id, line, col),
groups as (select doc_id, gid, min(seq) as first, count(*) as n, count(distinct regexp_matches(text, '[.!?]$')) as kinds from nb where kind = 'ListItem' group by doc_id, gid),
allp as (
  select nb.doc_id, 0 as ro, nb.ps as o1, 0 as o2, pl as line, 1 as col, substring(pt, 1, 60) as t from groups g join nb on nb.doc_id = g.doc_id and nb.seq = g.first where pk = 'Prose' and ends_with(pt, ':') and not regexp_matches(lower(pt), '{"|".join(V.LEAD_IN_MARKERS)}')
  union all select doc_id, 1, line, col, line, col, t from m2
  union all select doc_id, 2, line, 0, line, 1, substring(text, 1, 60) from nb where kind = 'Heading' and not (hn = 1 and starts_with(ltrim(raw, ' '), '# ')) and regexp_matches(regexp_replace(raw, '^[{_W}]+|[{_W}]+$', '', 'g'), '{V.NUMBERED_HEADING}')
  union all select doc_id, 3, line, 0, line, 1, substring(text, 1, 60) from nb where kind = 'ListItem' and regexp_matches(raw, '{V.MANUAL_NUMBER}')
  union all select nb.doc_id, 4, line, 0, line, 1, substring(text, 1, 60) from groups g join nb on nb.doc_id = g.doc_id and nb.seq = g.first where g.kinds > 1
  union all select doc_id, 5, line, col, line, col, t from m6
  union all select doc_id, 6, case when kind = 'ListItem' then 0 else 1 end, line, line, 1, substring(text, 1, 60) from nb where kind in ('ListItem', 'Prose') and regexp_matches(text, '{V.TRAILING_ETC["en"]}')),
ranked as (select *, row_number() over (partition by doc_id, ro order by o1, o2) - 1 as n from allp)"""
_RULE_NAMES = "case ro " + " ".join(f"when {k} then '{r[0]}'" for k, r in enumerate(V.MAINT_RULES)) + " end"


def md_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all structure rules."""
    d, found = structure.structure(parsed_docs(spark, sf_dir), "en")
    return rules.positions(rules.findings(d, found, "doc_id"), "doc_id").select("doc_id", "rule_id", "message", "n", "line", "text")


def md_empty_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure rules that SQL expresses: empty and missing sections."""
    return md_structure(spark, sf_dir).where(F.col("rule_id").isin("structure/empty-section", "structure/missing-section")).select("doc_id", "rule_id", "line", "text")


_SECTIONS = [(d, k, s[1], s[2], s[4][0], "|".join(n.lower() for n in s[3] + s[4])) for d, sections in V.DOCTYPES.items() for k, s in enumerate(sections)]


def md_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.terms(parsed_docs(spark, sf_dir, "blocks"), "en", 2)


def md_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports as Markdown, cut to a budget of 2,000 tokens, with the worst severity."""
    docs = markdown_docs(spark, sf_dir)
    out, found = report.check(docs, "doc_id")
    r = report.trim_reports(report.reports(docs, out, found, "doc_id"), 2000)
    return r.select("doc_id", report.worst().alias("worst"), report.markdown().alias("markdown"))


def md_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds calibrated from the corpus, and metrics that give none."""
    kept, rejected = profiles.calibrate(metrics.metrics_en(parsed_docs(spark, sf_dir, "prose", "body"), "doc_id"), profiles.builtin(spark))
    d = kept.select("metric", F.round("threshold", 9).alias("threshold"), "direction", F.lit("").alias("reason")).unionByName(rejected.select("metric", F.round("threshold", 9).alias("threshold"), F.lit("").alias("direction"), "reason"))
    return d


_HINGES = """(select metric, len(v) as n, case when len(v) // 2 = 0 then null else (v[(len(v) // 2 + 1) // 2] + v[(len(v) // 2) // 2 + 1]) / 2 end as q1,
  case when len(v) // 2 = 0 then null else (v[len(v) - len(v) // 2 + (len(v) // 2 + 1) // 2] + v[len(v) - len(v) // 2 + (len(v) // 2) // 2 + 1]) / 2 end as q3 from (select metric, list(value order by value) as v from metrics group by metric))"""


def md_firing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)
    d, found = rules.maintainability(parse.parse(docs, "source", "lists", "outline"), "en")
    hits = rules.findings(d, found, "doc_id").select("doc_id", "rule_id", (F.size("positions") + F.col("truncated")).alias("n"))
    return corpus.firing_rates(docs, hits, "doc_id", "doctype").withColumn("share", F.round("share", 9))


def price_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinges and fences of prices by return flag, by rank: no group is gathered."""
    d = profiles.ranked_tukey(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return d.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")))


def balance_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by the exclusive method, by nation, looked up by rank."""
    d = profiles.ranked_quantiles(table(spark, sf_dir, "customer"), "c_acctbal", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "c_nationkey")
    return d.select("c_nationkey", *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")))


def _counts(spark: SparkSession, sf_dir: str, *groups: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(groups, word, n). only: of other words one a document is kept, so that each group has a row."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *groups)).where("doc_id is not null")
    d = T.bound(d.select("doc_id", "text", *groups), w=T.reference_words(F.coalesce("text", F.lit(""))))
    words = F.col("w") if only is None else F.filter("w", lambda x, i: x.isin(*only) | (i == 0))
    return corpus.word_counts(d, words, *groups, documents=False)


_WORDS = rf"""
wd as (select doc_id, lang, source, list_filter(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[{_W}]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: w <> ''), lambda w: regexp_matches(w, '\p{{L}}')) as ws from documents where doc_id is not null),
wt as (select doc_id, lang, source, unnest(ws) as word from wd)"""


def language_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency table of words that two sources or more have."""
    return corpus.reference_table(_counts(spark, sf_dir, "source"), "source", least_domains=2, least=3)


def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rare_everywhere(_counts(spark, sf_dir, "lang").where("lang is not null"), "lang", 40.0).withColumn("most", F.round("most", 6))


def words_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every language has three times or more."""
    return corpus.in_all(_counts(spark, sf_dir, "lang").where("lang is not null"), "lang", 3)


def quality_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that good documents use far more or far less than others, by label."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    docs = spread(table(spark, sf_dir, "documents")).join(labels, "doc_id")
    d = corpus.word_counts(T.bound(docs.select("doc_id", "q", "text"), w=T.reference_words(F.coalesce("text", F.lit("")))), F.col("w"), "q")
    k = corpus.keyness(d.where("q = 1"), d.where("q = 0"))
    return k.select("word", "a", "b", F.round("g2", 6).alias("g2"), F.round("log_ratio", 6).alias("log_ratio"), "side")


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    words = F.array_distinct(T.reference_words(F.coalesce("text", F.lit(""))))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", "turn", words.alias(name))
    return side("user", "theirs").join(side("assistant", "ours").withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


_PAIRS = rf"""
cw as (select conv_id, turn, role, list_distinct(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[{_W}]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: regexp_matches(w, '\p{{L}}'))) as w from conversations),
pairs as (select row_number() over () as id, u.w as theirs, a.w as ours from cw u join cw a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
o as (select id, unnest(ours) as word from pairs), t as (select id, unnest(theirs) as word from pairs)"""


def turn_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say where assistants have another word."""
    d = corpus.substitutes(_turn_pairs(spark, sf_dir), "ours", "theirs")
    return d.select("word", "instead", "support", F.round("lift", 9).alias("lift"), "rank")


def turn_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dice_pairs(_turn_pairs(spark, sf_dir), "theirs", "ours").withColumn("dice", F.round("dice", 9))


_PATTERNS = {"comma": ",", "question": r"[?]", "digits": "[0-9]+", "symbols": "[#*$%&|<>]"}


def pattern_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.pattern_rates(spread(table(spark, sf_dir, "documents").select("lang", "text")).where("lang is not null").withColumn("text", F.coalesce("text", F.lit(""))), "text", _PATTERNS, "lang")
    return d.withColumn("rate", F.round("rate", 9))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their tags taken out, lines kept: a digest and the number of lines."""
    d = T.bound(table(spark, sf_dir, "pages").select("page_id", "html"), t=parse.strip_html(F.coalesce("html", F.lit(""))))
    return d.select("page_id", F.md5("t").alias("digest"), (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).cast("long").alias("line_ends"))


def page_doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents by the longest prefix of their path: here of urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.lit("").alias("source"))
    return structure.resolve_doctype(pages, path="url", paths=_PREFIXES).select("page_id", "doctype")


_PREFIXES = {"http": "reference", "https://": "readme", "https://www": "howto", "http://www": "overview"}


def doctype_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each type of document asks for."""
    rows = [(d, k, s[0], s[1], s[2], json.dumps(s[4])) for d, sections in V.DOCTYPES.items() for k, s in enumerate(sections)]
    return spark.createDataFrame(rows, "doctype string, ord int, section string, required boolean, lead_ok boolean, names string")


QUERIES = {f.__name__: f for f in (
    md_blocks, md_paragraphs, md_outline, md_list_groups, md_metrics, md_flagged, profile_thresholds, md_findings, md_structure, md_empty_and_missing, md_terms, md_check, md_calibration, md_firing_rates,
    price_fences, balance_quartiles, language_reference, rare_words, words_in_all, quality_keyness, turn_substitutes, turn_dice, pattern_rates, html_text, page_doctypes, doctype_sections,
)}

_G2 = "2 * ((case when a > 0 then a * ln(a / (n1 * (a + b) / (n1 + n2))) else 0 end) + (case when b > 0 then b * ln(b / (n2 * (a + b) / (n1 + n2))) else 0 end))"
SQL = {
    "md_blocks": f"with {MD} select * from blocks",
    "md_paragraphs": f"with {MD}, {_PARAGRAPHS} select * from paragraphs",
    "md_outline": f"with {MD}, {_OUTLINE} select doc_id, seq, line, level, text, has_body, has_child from outline",
    "md_list_groups": f"with {MD}, g as (select *, sum(case when kind <> 'ListItem' then 1 else 0 end) over (partition by doc_id order by seq) as gid from blocks) select doc_id, min(seq)::int as first, max(seq)::int as last from g where kind = 'ListItem' group by doc_id, gid",
    "md_metrics": f"with {MD}, {_METRICS} select doc_id, 'en' as lang, metric, round(value, 9) as value from metrics",
    "md_flagged": f"with {MD}, {_METRICS}, {_PROFILE} select doc_id, coalesce(md.doctype, '') as doctype, metric, round(value, 9) as value, threshold, direction, severity, guidance from metrics join md using (doc_id) join profile p on p.doctype = coalesce(md.doctype, '') and p.metric = metrics.metric where case when direction = 'above' then value > threshold else value < threshold end".replace("coalesce(md.doctype, '') as doctype, metric,", "coalesce(md.doctype, '') as doctype, metrics.metric,"),
    "profile_thresholds": f"with {_PROFILE} select * from profile",
    "md_findings": f"with {MD}, {_FINDINGS} select doc_id, {_RULE_NAMES} as rule_id, n::int as n, line, col as \"column\", t as text from ranked where n < 20",
    "md_empty_and_missing": rf"""with {MD}, {_OUTLINE}, {_PARAGRAPHS},
sec(doctype, ord, required, lead_ok, name, names) as (values {_values(_SECTIONS)}),
rest as (select *, row_number() over (partition by doc_id order by seq) as k from outline), rest2 as (select * from rest where not (k = 1 and level = 1)),
top as (select doc_id, min(line) filter (level = m) as first from (select *, min(level) over (partition by doc_id) as m from rest2) group by doc_id),
lead as (select distinct p.doc_id from paragraphs p left join top using (doc_id) where top.first is null or p.line < top.first),
e as (select doc_id, line, text, row_number() over (partition by doc_id order by seq) as k from outline where not has_body and not has_child)
select doc_id, 'structure/empty-section' as rule_id, line, text from e where k <= 20
union all select md.doc_id, 'structure/missing-section', 1, sec.name || '｜' from md join sec using (doctype) where required and not (ord = 0 and lead_ok and md.doc_id in (select doc_id from lead)) and not exists (select 1 from outline o where o.doc_id = md.doc_id and list_bool_or(list_transform(string_split(sec.names, '|'), lambda n: contains(lower(o.text), n))))""",
    "md_calibration": f"""with {MD}, {_METRICS}, {_PROFILE}, c as (select h.metric, n, direction, case when direction = 'above' then q3 + 1.5 * (q3 - q1) else q1 - 1.5 * (q3 - q1) end as f from {_HINGES} h join th on th.metric = h.metric)
select metric, round(f, 9) as threshold, case when n < 4 or (direction = 'below' and f <= 0) then '' else direction end as direction, case when n < 4 then 'too few' when direction = 'below' and f <= 0 then 'unreachable' else '' end as reason from c""",
    "md_firing_rates": f"""with {MD}, {_FINDINGS}, d as (select doctype, count(*) as docs from md group by doctype), f as (select doc_id, {_RULE_NAMES} as rule_id, count(*) as n from ranked group by all)
select d.doctype, rule_id, any_value(d.docs) as docs, count(*) as fired, round(count(*) / any_value(d.docs), 9) as share, sum(f.n)::bigint as findings from f join md using (doc_id) join d on d.doctype = md.doctype group by d.doctype, rule_id""",
    "price_fences": f"""with metrics as (select l_returnflag as metric, l_extendedprice as value from lineitem where l_extendedprice is not null)
select metric as l_returnflag, n, round(q1, 4) as q1, round(q3, 4) as q3, round(q1 - 1.5 * (q3 - q1), 4) as low, round(q3 + 1.5 * (q3 - q1), 4) as high from {_HINGES} h""",
    "balance_quartiles": "with v as (select c_nationkey, list(c_acctbal order by c_acctbal) as v from customer group by c_nationkey having count(*) > 1), q as (select c_nationkey, list_transform([0.25, 0.5, 0.75], lambda p: list_transform([greatest(1, least(floor((len(v) + 1) * p)::int, len(v) - 1))], lambda k: v[k] * (1 - ((len(v) + 1) * p - k)) + v[k + 1] * ((len(v) + 1) * p - k))[1]) as q from v) select c_nationkey, round(q[1], 6) as q1, round(q[2], 6) as q2, round(q[3], 6) as q3 from q",
    "language_reference": f"with {_WORDS} select word, count(*) as n, count(distinct source) as domains from wt where word is not null group by word having count(distinct source) >= 2 and count(*) >= 3",
    "rare_words": f"with {_WORDS}, c as (select lang, word, count(*) as n from wt where lang is not null group by all), t as (select lang, sum(n) as total from c group by lang) select word, round(max(n * 1e6 / total), 6) as most from c join t using (lang) group by word having max(n * 1e6 / total) < 40",
    "words_in_all": f"with {_WORDS}, c as (select lang, word, count(*) as n from wt where lang is not null group by all) select word, sum(n)::bigint as n from c where n >= 3 group by word having count(*) = (select count(distinct lang) from c)",
    "quality_keyness": f"""with {_WORDS}, q as (select doc_id, min(quality) as q from labels where doc_id is not null and quality is not null group by doc_id),
c as (select word, count(*) filter (q = 1) as a, count(*) filter (q = 0) as b, count(distinct case when q = 1 then doc_id end) as da, count(distinct case when q = 0 then doc_id end) as db from wt join q using (doc_id) group by word),
t as (select c.*, (select sum(a) from c)::double as n1, (select sum(b) from c)::double as n2 from c), g as (select *, {_G2} as g2, log2(((a + 0.5) / n1) / ((b + 0.5) / n2)) as lr, a / n1 > b / n2 as over from t)
select word, a, b, round(g2, 6) as g2, round(lr, 6) as log_ratio, case when over then 'over' else 'under' end as side from g where g2 >= 15.13 and case when over then da else db end >= 3""",
    "turn_substitutes": f"""with {_PAIRS}, only_o as (select * from o where not exists (select 1 from t where t.id = o.id and t.word = o.word)), only_t as (select * from t where not exists (select 1 from o where t.id = o.id and t.word = o.word)),
n as (select word, count(*) as n from only_o group by word), df as (select word as instead, count(*) as df from t group by word), c as (select a.word, b.word as instead, count(*) as support from only_o a join only_t b using (id) group by all having count(*) >= 2),
s as (select *, (support / n) / (df / (select count(*) from pairs)) as lift from c join n using (word) join df using (instead)), k as (select *, row_number() over (partition by word order by support * ln(lift) desc, instead) as rank from s where lift >= 2)
select word, instead, support, round(lift, 9) as lift, rank::int as rank from k where rank <= 3""",
    "turn_dice": f"with {_PAIRS}, dp as (select word as pv, count(*) as dp from t group by word), dw as (select word, count(*) as dw from o group by word), h as (select t.word as pv, o.word, count(*) as hits from t join o using (id) group by all having count(*) >= 3) select pv as \"pivot\", word, hits, round(2 * hits / (dp + dw), 9) as dice from h join dp using (pv) join dw using (word) where 2 * hits / (dp + dw) >= 0.25",
    "pattern_rates": " union all ".join(f"select lang, '{n}' as pattern, sum(len(regexp_extract_all(coalesce(text, ''), '{p}')))::bigint as hits, sum(length(coalesce(text, '')))::bigint as chars, round(sum(len(regexp_extract_all(coalesce(text, ''), '{p}'))) * 10000.0 / sum(length(coalesce(text, ''))), 9) as rate from documents where lang is not null group by lang" for n, p in _PATTERNS.items()),
    "html_text": """with h as (select page_id, string_split_regex(coalesce(html, ''), '<[^>]+>') as g, regexp_extract_all(coalesce(html, ''), '<[^>]+>') as m from pages),
t as (select page_id, array_to_string(list_transform(range(1, len(g) + 1), lambda k: g[k] || coalesce(repeat(chr(10), length(m[k]) - length(replace(m[k], chr(10), ''))), '')), '') as t from h) select page_id, md5(t) as digest, (length(t) - length(replace(t, chr(10), '')))::bigint as line_ends from t""",
    "page_doctypes": "select page_id, case " + " ".join(f"when starts_with(url, '{p}') then '{_PREFIXES[p]}'" for p in sorted(_PREFIXES, key=len, reverse=True)) + " end as doctype from pages",
    "doctype_sections": f"with s(doctype, ord, section, required, lead_ok, names) as (values {_values([(d, k, s[0], s[1], s[2], json.dumps(s[4])) for d, sections in V.DOCTYPES.items() for k, s in enumerate(sections)])}) select * from s",
}
