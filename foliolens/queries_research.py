"""Queries of corpus research and of Japanese, and the SQL they are held against.

Japanese documents are made of the words of each text: word k of so many letters becomes one of fourteen
tokens, none of which begins another, so both engines know the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T
from foliolens.functions.morphology import Dictionary, token_table, tokenizer
from foliolens.operators import corpus, metrics, parse, research, rules, structure, terms
from foliolens.plans import report
from foliolens.queries import _FINDINGS, _METRICS, _OUTLINE, _PARAGRAPHS, _PROFILE, _WORDS, MD, _counts, _values, markdown_docs, parsed_docs, table
from foliolens.sources.files import spread

_W = T.UWS

# --- structure and terms, in SQL -----------------------------------------------------------------


def _sentences(text: str) -> str:
    """The English count of sentences as a fold over the parts that stops end."""
    parts = f"string_split(regexp_replace({text}, '([.!?])([{_W}]|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    zero = "{'n': 0::bigint, 'w': 0::bigint}"
    each = f"list_transform({parts}, lambda x: {{'n': 0::bigint, 'w': length(x) - length(regexp_replace(x, '[{_W}]+', '', 'g'))}})"
    return f"list_reduce(list_prepend({zero}, {each}), lambda s, x: case when s.w + x.w >= 2 then {{'n': s.n + 1, 'w': 0::bigint}} else {{'n': s.n, 'w': s.w + x.w}} end).n"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_LEADS = " union all ".join(
    f"select doc_id, 'structure/lead-opener' as rule_id, '{_quoted(message)}' as message, 0 as o, line, substring(head, 1, 40) as text from lead where regexp_matches(head, '{_quoted(p)}')" + "".join(f" and not regexp_matches(head, '{_quoted(q)}')" for q, _ in V.LEAD_OPENERS["en"][:k])
    for k, (p, message) in enumerate(V.LEAD_OPENERS["en"])
)
_NOTES = " union all ".join(
    f"select doc_id, 'structure/work-note', '{_quoted(message)}', line, line, substring(text, length(string_split_regex(text, '{_quoted(p)}')[1])::int + 1, 36) from paragraphs join md using (doc_id) where doctype is not null and doctype not in ({', '.join(repr(x) for x in V.WORK_NOTES_OK)}) and regexp_matches(text, '{_quoted(p)}')" for p, message in V.WORK_NOTES["en"]
)
_SECTIONS = [(d, k, s[1], s[2], s[4][0], "|".join(n.lower() for n in s[3] + s[4])) for d, sections in V.DOCTYPES.items() for k, s in enumerate(sections)]
_STRUCTURE = rf"""
sec(doctype, ord, required, lead_ok, name, names) as (values {_values(_SECTIONS)}),
rest as (select * from (select *, row_number() over (partition by doc_id order by seq) as k from outline) where not (k = 1 and level = 1)),
sections as (select *, row_number() over (partition by doc_id order by seq) - 1 as i from (select *, min(level) over (partition by doc_id) as top from rest) where level = top),
lead as (select doc_id, line, regexp_replace(text, '^[{_W}]+', '') as head from (select p.*, row_number() over (partition by p.doc_id order by p.line) as k from paragraphs p left join (select doc_id, min(line) as first from sections group by doc_id) s using (doc_id) where first is null or p.line < first) where k = 1),
fits as (select md.doc_id, sec.*, (select min(i) from sections s where s.doc_id = md.doc_id and list_bool_or(list_transform(string_split(sec.names, '|'), lambda n: contains(lower(s.text), n)))) as pl,
  exists (select 1 from outline s where s.doc_id = md.doc_id and list_bool_or(list_transform(string_split(sec.names, '|'), lambda n: contains(lower(s.text), n)))) as nested from md join sec using (doctype)),
ordered as (select *, lag(pl) over (partition by doc_id order by ord) as earlier from fits where pl is not null),
every as (
  select doc_id, 'structure/long-paragraph' as rule_id, '{_quoted(V.LONG_PARAGRAPH[2])}' as message, line as o, line, n || '文｜' || substring(text, 1, 40) as text from (select *, {_sentences("text")} as n from paragraphs) where n > {V.MAX_SENTENCES}
  union all select doc_id, 'structure/empty-section', '{_quoted(V.EMPTY_SECTION[2])}', line, line, text from outline where not has_body and not has_child
  union all {_LEADS}
  union all select doc_id, 'structure/missing-section', '{_quoted(V.MISSING_SECTION[2])}', ord, 1, name || '｜' from fits where required and pl is null and not nested and not (ord = 0 and lead_ok and doc_id in (select doc_id from lead))
  union all select ordered.doc_id, 'structure/section-order', '{_quoted(V.SECTION_ORDER[2])}', ord, s.line, s.text || '｜{V.SECTION_ORDER_NOTE}' from ordered join sections s on s.doc_id = ordered.doc_id and s.i = ordered.pl where pl < earlier
  union all {_NOTES}),
kept as (select * from (select *, row_number() over (partition by doc_id, rule_id, message order by o) - 1 as n from every) where n < 20)"""
_STRUCTURE_SQL = rf"""with {MD}, {_OUTLINE}, {_PARAGRAPHS}, {_STRUCTURE} select doc_id, rule_id, message, n::int as n, line, text from kept"""

_RUN = "{'g': x.g, 'w': x.w, 'leading': s.leading and x.g = '' and x.caps, 'run': case when not fit then '' when x.g <> '' or s.run = '' then x.w else s.run || ' ' || x.w end, 'out': case when (x.g <> '' or not fit) and s.run <> '' then list_append(s.out, s.run) else s.out end, 'caps': x.caps, 'capital': x.capital}"
_FIT = "(x.caps or (x.capital and not (s.leading or regexp_matches(x.g, '[.!?]$'))))"
_TERMS_SQL = rf"""with {MD},
tb as (select doc_id, seq, regexp_extract_all(text, '{terms.WORD.replace("'", "''")}') as ws, string_split_regex(text, '{terms.WORD.replace("'", "''")}') as gs from blocks where kind in ('Prose', 'ListItem', 'Heading') and regexp_matches(text, '[A-Z]')),
te as (select doc_id, seq, list_transform(range(1, len(ws) + 1), lambda k: {{'g': regexp_replace(gs[k], '^[{_W}]+|[{_W}]+$', '', 'g'), 'w': ws[k], 'leading': true, 'run': '', 'out': []::varchar[], 'caps': regexp_matches(ws[k], '^[A-Z0-9-]{{2,}}$') and regexp_matches(ws[k], '[A-Z]'), 'capital': regexp_matches(ws[k], '(?s)^[A-Z].+$')}}) as xs from tb where len(ws) > 0),
tr as (select list_reduce(list_prepend({{'g': '', 'w': '', 'leading': true, 'run': '', 'out': []::varchar[], 'caps': false, 'capital': false}}, xs), lambda s, x: {_RUN.replace("fit", _FIT)}) as r from te),
tw as (select unnest(case when r.run <> '' then list_append(r.out, r.run) else r.out end) as word from tr
  union all select w from (select regexp_replace(unnest(regexp_extract_all(raw, '`([^`\n]+)`', 1)), '^[{_W}]+|[{_W}]+$', '', 'g') as w from blocks) where regexp_matches(w, '^[A-Za-z][A-Za-z0-9_:.\-]*$'))
select word, 'en' as lang, count(*) as count from tw group by word having count(*) >= 2"""

# --- chunks, sections, status, measures ------------------------------------------------------------


def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = markdown_docs(spark, sf_dir)
    return parse.rows_of(T.bound(d, c=research.chunks(F.col("source"))), "c", "doc_id")


_CHUNKS = rf"""
cb as (select doc_id, regexp_replace(regexp_replace(source, '(?s)^---\n.*?\n---\n', ''), '(?s)<!--.*?-->', '', 'g') as b from md),
cl as (select doc_id, unnest(string_split(b, chr(10))) as x, generate_subscripts(string_split(b, chr(10)), 1) as line from cb),
cf as (select *, regexp_matches(x, '^[{_W}]*```') as f, count(*) filter (regexp_matches(x, '^[{_W}]*```')) over (partition by doc_id order by line) as fences from cl),
ct as (select *, case when f or fences % 2 = 1 then 'c' when regexp_matches(x, '[^{_W}]') then 'p' else 'b' end as typ from cf),
cs as (select *, sum(case when (f and fences % 2 = 1) or (typ = 'p' and before is distinct from 'p') then 1 else 0 end) over (partition by doc_id order by line) as id from (select *, lag(typ) over (partition by doc_id order by line) as before from ct)),
cg as (select doc_id, id - 1 as idx, string_agg(x, chr(10) order by line) as text, regexp_replace(string_agg(x, chr(10) order by line), '^[{_W}]+', '') as s from cs where typ <> 'b' group by doc_id, id),
chunks as (select doc_id, idx::int as idx, case when starts_with(s, '```') then 'code' when starts_with(s, '#') then 'heading' when starts_with(s, '{{{{') then 'shortcode' when starts_with(s, '|') then 'table' when regexp_matches(s, '^([-*+]|\p{{Nd}}+[.)])[{_W}]') then 'list' else 'prose' end as kind, text from cg)"""


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their cleaned heading and what they are made of."""
    d = T.bound(markdown_docs(spark, sf_dir), s=research.readme_sections(F.col("source")))
    d = d.select("doc_id", F.posexplode("s").alias("idx", "s"))
    d = T.bound(d.select("doc_id", "idx", research.clean_heading(F.col("s.heading")).alias("heading"), F.col("s.body").alias("body")), c=research.composition(F.col("body")))
    return d.select("doc_id", "idx", "heading", F.length("body").alias("length"), *(F.col(f"c.{k}").cast("long").alias(k) for k in ("chars", "code", "bullets", "tables", "prose", "subheadings")))


_SECTION_SQL = rf"""with {MD},
sh as (select doc_id, regexp_extract_all(source, '(?m)^(#{{2,3}})\s+(.+?)\s*#*$', 2) as hs, string_split_regex(source, '(?m)^(#{{2,3}})\s+(.+?)\s*#*$') as bs from md),
ss as (select doc_id, unnest(range(0, len(hs))) as idx, hs, bs from sh),
sb as (select doc_id, idx, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(hs[idx + 1], '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '[*_`~#:]', '', 'g'))) as heading, bs[idx + 2] as body from ss),
sp as (select *, regexp_replace(body, '(?s)```.*?```', '', 'g') as plain from sb),
sl as (select *, list_filter(string_split(plain, chr(10)), lambda x: regexp_matches(x, '[^{_W}]')) as ls from sp)
select doc_id, idx::int as idx, heading, length(body)::int as length, length(plain)::bigint as chars, (len(regexp_extract_all(body, '(?m)^```')) // 2)::bigint as code, len(list_filter(ls, lambda x: regexp_matches(x, '^[{_W}]*(?:[-*+][{_W}]|[0-9]+[.)][{_W}])')))::bigint as bullets,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[{_W}]*\|')))::bigint as tables, len(list_filter(ls, lambda x: not regexp_matches(x, '^[{_W}]*(?:[-*+][{_W}]|[0-9]+[.)][{_W}]|\||#|>)')))::bigint as prose, len(regexp_extract_all(body, '(?m)^#{{3,4}}\s'))::bigint as subheadings from sl"""


def md_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of English without a parser; the excess words are three common ones."""
    d = research.research_en(markdown_docs(spark, sf_dir), "source", "doc_id", excess=_EXCESS)
    return d.withColumn("value", F.round("value", 6))


_EXCESS = ("the", "of", "and")


def _replaced(column: str, pairs) -> str:
    for pattern, new in pairs:
        column = f"regexp_replace({column}, '{_quoted(pattern)}', '{new.replace('$', chr(92))}', 'g')"
    return column


_LIST = rf"([-*+]|\p{{Nd}}+[.)])[{_W}]"
_RESEARCH_SQL = rf"""with {MD},
ra as (select doc_id, {_replaced("source", V.MARKUP["md"])} as raw from md),
rl as (select *, list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(x, '^[{_W}]+|[{_W}]+$', '', 'g')), lambda s: s <> '' and not regexp_matches(s, '^(#{{1,6}}[{_W}]|{_LIST}|\||>)')) as keep, list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '[^{_W}]')) as ls from ra),
rp as (select *, {_replaced("array_to_string(keep, chr(10))", V.MARKUP_INLINE)} as prose from rl),
rw as (select *, list_filter(list_transform(string_split_regex(prose, '[{_W}]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: w <> '') as ws, regexp_extract_all(raw, '(?m)^([^\n]{{6,}}):[{_W}]*\n[{_W}]*(?:[-*+]|\p{{Nd}}+[.)])[{_W}]', 1) as leads from rp),
rv as (select *, len(list_filter(leads, lambda x: regexp_matches(x, '{V.GOOD_LEAD}'))) as good from rw),
rm as (select doc_id, unnest([
  {{'metric': 'timeless_violation_1k', 'c': len(list_filter(ws, lambda w: w in ({", ".join(repr(x) for x in V.TIMELESS)}))) + len(regexp_extract_all(prose, '{_quoted(V.TIMELESS_PHRASE)}')), 'n': len(ws), 'k': 1000}},
  {{'metric': 'emdash_1k', 'c': len(regexp_extract_all(prose, '—| -- ')), 'n': len(ws), 'k': 1000}}, {{'metric': 'bold_1k', 'c': len(regexp_extract_all(raw, '\*\*[^*]+\*\*')), 'n': len(ws), 'k': 1000}},
  {{'metric': 'excess_1k', 'c': len(list_filter(ws, lambda w: w in ({", ".join(repr(x) for x in _EXCESS)}))), 'n': len(ws), 'k': 1000}}, {{'metric': 'simile_marker_1k', 'c': len(regexp_extract_all(prose, '{V.SIMILE_RESEARCH}')), 'n': len(ws), 'k': 1000}},
  {{'metric': 'count_declaration', 'c': len(regexp_extract_all(prose, '{V.COUNT_DECLARATION}')), 'n': 1, 'k': 1}}, {{'metric': 'bad_list_lead', 'c': len(leads) - good, 'n': 1, 'k': 1}}, {{'metric': 'good_list_lead', 'c': good, 'n': 1, 'k': 1}},
  {{'metric': 'list_ratio', 'c': len(list_filter(ls, lambda x: regexp_matches(x, '^[{_W}]*{_LIST}'))), 'n': greatest(len(ls), 1), 'k': 1}}]) as x from rv)
select doc_id, x.metric as metric, round(case when x.n = 0 then 0 else x.c / x.n * x.k end, 6) as value from rm"""


def md_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often sentences tell the state of the work, by class."""
    d = T.bound(markdown_docs(spark, sf_dir), s=research.readme_sections(F.col("source")))
    d = T.bound(d.select("domain", "s"), x=research.status_sentences(F.col("s")))
    return d.select("domain", F.explode("x.class").alias("class")).groupBy("domain", "class").agg(F.count(F.lit(1)).alias("n"))


_STATUS_SQL = rf"""with {MD},
sh as (select domain, regexp_extract_all(source, '(?m)^(#{{2,3}})\s+(.+?)\s*#*$', 2) as hs, string_split_regex(source, '(?m)^(#{{2,3}})\s+(.+?)\s*#*$') as bs from md),
ss as (select domain, unnest(list_transform(range(1, len(hs) + 1), lambda k: {{'h': hs[k], 'b': bs[k + 1]}})) as s from sh),
sq as (select domain, s.h as h, unnest(string_split_regex(regexp_replace(s.b, '([.!?])[{_W}]+', '\1' || chr(1), 'g'), chr(1) || '|\n[{_W}]*\n|\n[{_W}]*[-*+][{_W}]+')) as x from ss),
st as (select domain, h, regexp_replace(regexp_replace(x, '[{_W}]+', ' ', 'g'), '^[{_W}]+|[{_W}]+$', '', 'g') as x from sq)
select domain, case when regexp_matches(h, '{_quoted(V.SIGNPOST)}') then 'signposted' when regexp_matches(x, '{V.ADDRESSED}') then 'addressed' when regexp_matches(x, '{V.ABOUT_THE_WORK}') then 'about_work' else 'plain' end as class, count(*) as n from st where regexp_matches(x, '{V.STATUS_MARKERS}') group by all"""


def md_led_to_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a colon at the end of prose is followed by a list, by type of document."""
    d = research.led_to_lists(parsed_docs(spark, sf_dir, "blocks").select("doctype", "blocks"), ":$", "doctype")
    return d.withColumn("share", F.round("share", 9))


def documents_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what corpora admit: language, and text beside the template."""
    text = F.coalesce("text", F.lit(""))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", research.in_target_language(text).alias("language"), research.is_written(text).alias("written"), T.detect_lang(text).alias("detected"), T.detect_style(text).alias("style"))
    return d


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often either of two words stands in each source."""
    pairs = spark.createDataFrame(_WORD_PAIRS, "ours string, theirs string")
    return research.pair_counts(_counts(spark, sf_dir, "source", only=_PAIRED).where("source is not null"), pairs, "source")


_WORD_PAIRS = [("the", "der"), ("and", "und"), ("of", "de"), ("zzz", "and")]
_PAIRED = tuple(sorted({w for p in _WORD_PAIRS for w in p}))

def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports as lines of text: metrics out of range, then places to mend."""
    out, found = report.check_any(markdown_docs(spark, sf_dir), "doc_id", lang="en")
    return report.text_lines(found, "doc_id", out).select("doc_id", "value")


def md_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of each document, and if it makes a check fail."""
    docs = markdown_docs(spark, sf_dir)
    out, found = report.check(docs, "doc_id")
    r = report.reports(docs, out, found, "doc_id")
    return r.groupBy("doc_id").agg(F.first(report.worst()).alias("worst"), report.exit_status(r).alias("status"))


_RULES = [(k, r[0], r[1], r[2]) for k, r in enumerate(V.MAINT_RULES)]
_SEVERITIES = [(r[0], r[1]) for r in (V.LONG_PARAGRAPH, V.EMPTY_SECTION, V.LEAD_OPENER, V.MISSING_SECTION, V.SECTION_ORDER, V.WORK_NOTE)]
_CHECK = rf"""with {MD}, {_METRICS}, {_PROFILE}, {_FINDINGS}, {_OUTLINE}, {_PARAGRAPHS}, {_STRUCTURE},
mr(ro, rule_id, severity, message) as (values {_values(_RULES)}), sv(rule_id, severity) as (values {_values(_SEVERITIES)}),
flagged as (select doc_id, metrics.metric as metric, severity, guidance from metrics join md using (doc_id) join profile p on p.doctype = coalesce(md.doctype, '') and p.metric = metrics.metric where case when direction = 'above' then value > threshold else value < threshold end),
told as (select doc_id, line, col, message, rule_id, severity from ranked join mr using (ro) where n < 20 union all select doc_id, line, 1, message, kept.rule_id, severity from kept join sv on sv.rule_id = kept.rule_id)"""


def md_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections against an agreed plan of three headings."""
    plot = F.array(*(F.lit(h) for h in _PLOT))
    d = parsed_docs(spark, sf_dir).withColumn("plot", plot)
    return T.bound(d, p=structure.plot_mismatch("plot")).select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.line", "p.text")


_PLOT = ["2. Numbers", "Motivation", "Never written"]


def md_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a section, and where it first appears."""
    outline = parse.rows_of(parsed_docs(spark, sf_dir, "outline"), "outline", "doc_id")
    out = corpus.section_presence(outline, "doc_id", _NAMES, table(spark, sf_dir, "documents").where("doc_id is not null"))
    return out.withColumns({"share": F.round("share", 9), "mean_place": F.round("mean_place", 9)})


_NAMES = {"numbers": ["numbers"], "why": ["motivation", "why"], "empty": ["empty"]}


def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the documents of a source agree on a language."""
    d = corpus.convergence(table(spark, sf_dir, "documents").where("source is not null and lang is not null"), "source", "lang")
    return d.withColumn("top_share", F.round("top_share", 9))


def word_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of which the new one is clearly in use, over all documents."""
    pairs = spark.createDataFrame([(a, b) for b, a in _WORD_PAIRS] + [("zzz", "the")], "old string, new string")
    return corpus.adoption(pairs, _counts(spark, sf_dir, only=_PAIRED).select("word", "n"))


def pattern_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of patterns in English against those in German."""
    d = corpus.pattern_rates(table(spark, sf_dir, "documents").where("lang is not null").withColumn("text", F.coalesce("text", F.lit(""))), "text", _SIGNS, "lang")
    return corpus.rate_ratio(d, "lang", "en", "de").select("pattern", *(F.round(c, 6).alias(c) for c in ("ours", "theirs", "ratio")))


_SIGNS = {"comma": ",", "digits": "[0-9]+", "never": "zqzq"}


def turn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which form of a word users and assistants took, turn by turn."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", "turn", F.col("text").alias(name))
    pairs = side("user", "theirs").join(side("assistant", "ours").withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])
    return research.term_agreement(pairs, "ours", "theirs", _FORMS_OF)


_FORMS_OF = {"in": ["in", "ing"], "the": ["the", "The", "that"]}

# --- Japanese --------------------------------------------------------------------------------------

#: surface, pos1, pos2, cform, goshu, lemma
_TOKENS = [
    ("利用者", "名詞", "普通名詞", "", "漢", "利用者"), ("書き", "動詞", "", "連用形-一般", "和", "書く"), ("、", "補助記号", "読点", "", "", ""), ("て", "助詞", "接続助詞", "", "和", "て"), ("これ", "代名詞", "", "", "和", "これ"), ("こと", "名詞", "", "", "和", "こと"), ("を", "助詞", "格助詞", "", "和", "を"),
    ("使う", "動詞", "", "終止形", "和", "使う"), ("三", "名詞", "数詞", "", "漢", "三"), ("者", "接尾辞", "", "", "漢", "者"), ("サーバー", "名詞", "", "", "外", "サーバー"), ("確認", "名詞", "", "", "漢", "確認"), ("。", "補助記号", "句点", "", "", ""), ("静か", "形状詞", "", "", "和", "静か"),
]


def _dictionary() -> Dictionary:
    return Dictionary.of(" ".join("|".join(x or "*" for x in t) for t in _TOKENS if t[0] not in "、。"))


def japanese_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).where("doc_id is not null")
    surfaces = F.array(*(F.lit(t[0]) for t in _TOKENS))
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return d.select("doc_id", "lang", F.array_join(F.transform(words, lambda w, i: F.get(surfaces, F.pmod(F.length(w) + i, F.lit(len(_TOKENS))).cast("int"))), "").alias("source"))


def ja_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.metrics_ja(tokenizer(_dictionary())(parse.parse(japanese_docs(spark, sf_dir), "source", "prose", "body")), "doc_id")
    return d.withColumn("value", F.round("value", 6))


def ja_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.terms(tokenizer(_dictionary())(parse.parse(japanese_docs(spark, sf_dir), "source", "prose", "body")), "ja", 2)


def ja_verb_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.verb_breadth(tokenizer(_dictionary())(parse.parse(japanese_docs(spark, sf_dir), "source", "prose", "body")).where("lang is not null"), "body_tokens", "lang", 20)
    return d.withColumn("breadth", F.round("breadth", 9))


def ja_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by part of speech, through the table function."""
    spark.udtf.register("foliolens_tokens", token_table(_dictionary()))
    return spark.sql("select pos1, goshu, count(*) as n, sum(start) as starts from {docs}, lateral foliolens_tokens(source) group by pos1, goshu", docs=japanese_docs(spark, sf_dir))


def ja_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of nouns with a loan word in use, and of native words far over the reference."""
    d = tokenizer(_dictionary())(parse.parse(japanese_docs(spark, sf_dir), "source", "prose", "body"))
    d = T.bound(d, k=rules.prefer_katakana("block_tokens"))
    d = rules.rare_wago(d, "block_tokens", spark.createDataFrame(_REFERENCE, "lemma string, n long"))
    label = lambda c, rule: F.transform(c, lambda p: F.struct(F.lit(rule).alias("rule"), p["column"].alias("column"), F.split(p["text"], "｜")[0].alias("label")))
    return d.select("doc_id", F.inline(F.concat(label("k", "katakana"), label("rare_wago", "wago"))))


_REFERENCE = [("使う", 90_000), ("これ", 3)]


def ja_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that a glossary rejects, and other forms of defined names."""
    d = parse.parse(japanese_docs(spark, sf_dir), "source", "blocks")
    d = T.bound(d, v=rules.glossary_variant([("確認", "検査", ["確認。"], False)]), n=rules.defined_names([("使用者", ["利用者"], "名前")]))
    label = lambda c, rule: F.transform(c, lambda p: F.struct(F.lit(rule).alias("rule"), p["column"].alias("column"), F.split(p["text"], "｜")[0].alias("label")))
    return d.select("doc_id", F.inline(F.concat(label("v", "variant"), label("n", "name"))))


_JA = f"""
jt(k, surface, pos1, pos2, cform, goshu, lemma) as (values {_values([(k, *t) for k, t in enumerate(_TOKENS)])}),
jw as (select doc_id, lang, string_split(coalesce(text, ''), ' ') as ws from documents where doc_id is not null),
jp as (select doc_id, lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: (length(ws[i]) + i - 1) % {len(_TOKENS)})) as k, generate_subscripts(ws, 1) - 1 as p, len(ws) as n from jw),
ja as (select doc_id, lang, p, n, jt.*, lead(jt.surface) over (partition by doc_id order by p) as next, sum(length(jt.surface)) over (partition by doc_id order by p) - length(jt.surface) as start from jp join jt using (k))"""
_JA_METRICS = f"""with {_JA},
seen as (select *, coalesce(lag(p) over (partition by doc_id, surface order by p), -1) as q from ja),
mattr as (select doc_id, case when any_value(n) < 100 then count(distinct surface) / any_value(n) else sum(greatest(0, least(p, n - 100) - greatest(0, p - 99, q + 1) + 1)) / 100 / (any_value(n) - 99) end as v from seen group by doc_id),
a as (select doc_id, sum(length(surface)) as c, count(*) filter (pos1 = '動詞' and starts_with(cform, '連用形') and next = '、') as renyo, count(*) filter (surface in ('て', 'で') and pos2 = '接続助詞' and next = '、') as te,
  count(*) filter (pos1 = '名詞' and surface in ({", ".join(repr(x) for x in V.FORMAL_NOUNS)})) as formal, count(*) filter (surface in ({", ".join(repr(x) for x in V.DEMONSTRATIVES)})) as demo,
  count(*) filter (pos1 in ({", ".join(repr(x) for x in V.CONTENT_POS)}) and goshu in ('和', '漢', '外', '混')) as kinds, count(*) filter (pos1 in ({", ".join(repr(x) for x in V.CONTENT_POS)}) and goshu = '漢') as kango,
  sum(length(regexp_replace(surface, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'))) as kanji, sum(length(regexp_replace(surface, '[^\\x{{3040}}-\\x{{30FF}}]', '', 'g'))) as kana from ja group by doc_id),
m as (
  select doc_id, 'ja.mattr100' as metric, v as value from mattr union all select doc_id, 'ja.prose_ratio', 1 from a union all select doc_id, 'ja.list_ratio', 0 from a
  union all select doc_id, 'ja.renyo_te_ratio', renyo / te from a where te / c * 1000 >= {V.MIN_TE_FOR_RATIO} and te > 0
  union all select doc_id, 'ja.renyo_per_1k', renyo / c * 1000 from a union all select doc_id, 'ja.te_per_1k', te / c * 1000 from a union all select doc_id, 'ja.keishiki_meishi_per_1k', formal / c * 1000 from a
  union all select doc_id, 'ja.demonstrative_per_1k', demo / c * 1000 from a union all select doc_id, 'ja.kango_ratio', case when kinds = 0 then 0 else kango / kinds end from a
  union all select doc_id, 'ja.kanji_ratio', case when kanji + kana = 0 then 0 else kanji / (kanji + kana) end from a)
select doc_id, 'ja' as lang, metric, round(value, 6) as value from m"""
_JA_TERMS = f"""with {_JA},
f as (select *, pos1 = '名詞' and pos2 <> '数詞' as noun, (pos1 = '名詞' and pos2 <> '数詞') or pos1 = '接尾辞' as fits from ja),
i as (select *, sum(case when fits then 0 else 1 end) over (partition by doc_id order by p) as island from f),
r as (select *, sum(case when noun then 1 else 0 end) over (partition by doc_id, island order by p) as nouns from i where fits),
w as (select doc_id, island, string_agg(surface, '' order by p) as word, count(*) as k from r where nouns > 0 group by doc_id, island)
select word, 'ja' as lang, count(*) as count from w where length(word) >= 2 and not (k = 1 and word in ({", ".join(repr(x) for x in V.FORMAL_NOUNS)})) group by word having count(*) >= 2"""
_JA_BREADTH = f"""with {_JA},
t as (select lang, surface as noun, pos1, lead(surface, 1) over w as b, lead(pos1, 2) over w as c, lead(lemma, 2) over w as verb from ja window w as (partition by doc_id order by p)),
v as (select lang, verb, noun from t where lang is not null and pos1 = '名詞' and b = 'を' and c = '動詞')
select lang, verb, count(*) as n, count(distinct noun) as nouns, round(count(distinct noun) / count(*), 9) as breadth from v group by lang, verb having count(*) >= 20"""

QUERIES = {f.__name__: f for f in (md_chunks, md_sections, md_research, md_status, md_led_to_lists, documents_admitted, source_pairs, ja_metrics, ja_terms, ja_verb_breadth, ja_token_counts, ja_register, ja_glossary, md_lines, md_worst, md_plots, md_presence, source_agreement, word_adoption, pattern_ratios, turn_agreement)}
_T = "coalesce(text, '')"
_N = lambda letters: f"length(regexp_replace({_T}, '[^{letters}]+', '', 'g'))"
_HAS = lambda x: f"(length({_T}) - length(replace({_T}, '{x}', ''))) // {len(x)}"
SQL = {
    "md_structure": _STRUCTURE_SQL,
    "md_terms": _TERMS_SQL,
    "md_chunks": f"with {MD}, {_CHUNKS} select * from chunks",
    "md_sections": _SECTION_SQL,
    "md_research": _RESEARCH_SQL,
    "md_status": _STATUS_SQL,
    "md_led_to_lists": f"with {MD}, n as (select *, lead(kind) over (partition by doc_id order by seq) as nk from blocks) select doctype, count(*) filter (nk = 'ListItem') as with_list, count(*) filter (nk is distinct from 'ListItem') as without, round(count(*) filter (nk = 'ListItem') / count(*), 9) as share from n join md using (doc_id) where kind = 'Prose' and regexp_matches(raw, ':$') group by doctype",
    "documents_admitted": rf"""select doc_id, not ({_N(r"\x{4E00}-\x{9FFF}")} > 200 and {_N(r"\x{3040}-\x{30FF}")} * 10 < {_N(r"\x{4E00}-\x{9FFF}")}) and ({_N("A-Za-z")} > 200 or {_N(r"\x{3040}-\x{30FF}")} > 200) as language,
  {_HAS("<!--")} <= 8 and {" + ".join(_HAS(m) for m in V.TEMPLATE_MARKS)} <= 2 and length(regexp_replace(regexp_replace({_T}, '(?s)<!--.*?-->', '', 'g'), '(?s)```.*?```', '', 'g')) >= 2000 as written,
  case when {_N(r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}")} * 20 > length({_T}) then 'ja' else 'en' end as detected, case when not regexp_matches({_T}, '(?:です|ます|ました|ません|でしょう|ください|である|だ|た)。') then 'unknown' else 'dearu' end as style from documents""",
    "source_pairs": f"with {_WORDS}, q(ours, theirs) as (values {_values(_WORD_PAIRS)}), c as (select source, word, count(*) as n from wt where source is not null group by all), s as (select distinct source from c) select ours, theirs, s.source, coalesce((select n from c where c.source = s.source and word = ours), 0)::bigint as ours_n, coalesce((select n from c where c.source = s.source and word = theirs), 0)::bigint as theirs_n from q cross join s",
    "md_lines": f"{_CHECK} select doc_id, doc_id || ': ' || metric || ' ' || guidance as value from flagged union all select doc_id, doc_id || ':' || line || ':' || col || ': ' || message || ' [' || rule_id || ']' from told",
    "md_worst": f"{_CHECK}, s as (select doc_id, max(case severity when 'error' then 3 when 'warning' then 2 else 1 end) as k from (select doc_id, severity from flagged union all select doc_id, severity from told) group by doc_id) select md.doc_id, case k when 3 then 'error' when 2 then 'warning' when 1 then 'info' end as worst, case when k = 3 then 1 else 0 end as status from md left join s using (doc_id)",
    "md_plots": rf"""with {MD}, {_OUTLINE}, rest as (select * from (select *, row_number() over (partition by doc_id order by seq) as k from outline) where not (k = 1 and level = 1)),
sections as (select * from (select *, min(level) over (partition by doc_id) as top from rest) where level = top), p(h) as (values {_values([(h,) for h in _PLOT])})
select doc_id, 1 as line, '{V.PLOT_ONLY}｜' || h as text from md cross join p where not exists (select 1 from sections s where s.doc_id = md.doc_id and s.text = h) union all select doc_id, line, '{V.BODY_ONLY}｜' || text from sections where text not in (select h from p)""",
    "md_presence": rf"""with {MD}, {_OUTLINE}, h as (select doc_id, line, lower(trim(regexp_replace(text, '[*_`~#:]', '', 'g'))) as h from outline),
c as (select doc_id, min(line) as line, name from (select *, case {" ".join("when " + " or ".join(f"h = '{f}' or starts_with(h, '{f} ') or ends_with(h, ' {f}')" for f in forms) + f" then '{n}'" for n, forms in _NAMES.items())} end as name from h) where name is not null group by doc_id, name),
p as (select *, row_number() over (partition by doc_id order by line, name) as place from c) select name, count(*) as docs, round(count(*) / (select count(*) from md), 9) as share, round(avg(place), 9) as mean_place, count(*) filter (place = 1) as first from p group by name""",
    "source_agreement": "with c as (select source, lang, count(*) as c from documents where source is not null and lang is not null group by all) select source, sum(c)::bigint as n, count(*) as kinds, round(max(c) / sum(c), 9) as top_share from c group by source",
    "word_adoption": f"with {_WORDS}, p(old, new) as (values {_values([(a, b) for b, a in _WORD_PAIRS] + [('zzz', 'the')])}), c as (select word, count(*) as n from wt group by word), j as (select old, new, coalesce(a.n, 0) as old_n, coalesce(b.n, 0) as new_n from p left join c a on a.word = old left join c b on b.word = new) select * from j where old_n + new_n >= 20 and old_n <= 60 and (old_n = 0 or new_n >= 2 * old_n)",
    "pattern_ratios": "with r as (" + " union all ".join(f"select '{n}' as pattern, lang, sum(len(regexp_extract_all({_T}, '{p}'))) * 10000.0 / sum(length({_T})) as rate from documents where lang is not null group by lang" for n, p in _SIGNS.items()) + "), v as (select pattern, coalesce(max(rate) filter (lang = 'en'), 0) as a, coalesce(max(rate) filter (lang = 'de'), 0) as b from r group by pattern) select pattern, round(a, 6) as ours, round(b, 6) as theirs, round(case when b > 0 then a / b when a > 0 then 'infinity'::double end, 6) as ratio from v",
    "turn_agreement": "with p as (select u.text as theirs, a.text as ours from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' and u.text is not null and a.text is not null), f as (" + " union all ".join(f"select '{t}' as term, " + ", ".join("case " + " ".join(f"when contains({side}, '{x}') then '{x}'" for x in sorted(reversed(forms), key=len, reverse=True)) + f" end as {side}_form" for side in ("ours", "theirs")) + " from p" for t, forms in _FORMS_OF.items()) + ") select term, ours_form, theirs_form, count(*) as n from f where ours_form is not null group by all",
    "ja_register": f"""with {_JA}, kp(lemma, kata) as (values {_values(list(V.KATAKANA_PAIRS.items()))}), rf(lemma, n) as (values {_values(_REFERENCE)}),
o as (select *, lag(pos1) over (partition by doc_id order by p) as before from ja), w as (select doc_id, count(*) as n1 from ja where pos1 in ({", ".join(repr(x) for x in V.CONTENT_POS)}) group by doc_id),
t as (select doc_id, lemma, count(*)::double as a from ja where pos1 in ({", ".join(repr(x) for x in V.CONTENT_POS)}) and goshu = '和' and pos2 <> '数詞' group by doc_id, lemma having count(*) >= {V.MIN_OCCURRENCES}),
g as (select t.doc_id, t.lemma, a, coalesce(rf.n, 0)::double as b, n1::double as n1, {V.REFERENCE_CONTENT_WORDS}::double as n2 from t join w using (doc_id) left join rf using (lemma)),
v as (select doc_id, lemma from g where a / n1 > b / n2 and 2 * (a * ln(a / (n1 * (a + b) / (n1 + n2))) + case when b > 0 then b * ln(b / (n2 * (a + b) / (n1 + n2))) else 0 end) >= {V.G2_CRITICAL} and log2(((a + 0.5) / n1) / ((b + 0.5) / n2)) >= {V.LOG_RATIO_MIN})
select doc_id, 'katakana' as rule, (start + 1)::int as "column", lemma || '→' || kata as label from o join kp using (lemma) where pos1 = '名詞' and goshu = '漢' and before is distinct from '名詞'
union all select ja.doc_id, 'wago', (start + 1)::int, lemma from ja join v using (doc_id, lemma) where pos1 in ({", ".join(repr(x) for x in V.CONTENT_POS)}) and goshu = '和' and pos2 <> '数詞'""",
    "ja_glossary": f"""with {_JA} select doc_id, 'variant' as rule, (start + 1)::int as "column", '確認→検査' as label from ja where surface = '確認' and next is distinct from '。' union all select doc_id, 'name', (start + 1)::int, '利用者→使用者（名前）' from ja where surface = '利用者'""",
    "ja_metrics": _JA_METRICS,
    "ja_terms": _JA_TERMS,
    "ja_verb_breadth": _JA_BREADTH,
    "ja_token_counts": f"with {_JA} select pos1, goshu, count(*) as n, sum(start)::bigint as starts from ja group by pos1, goshu",
}
