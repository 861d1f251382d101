import pytest
from pyspark.sql import functions as F

from foliolens.operators.metrics import measured_en
from foliolens.operators.parse import parse
from foliolens.operators.rules import defined_names, findings, maintainability
from foliolens.operators.structure import structure

SOURCE = """# Guide
In recent years things changed.

The reasons are:
- one.
- two
- 1. three, etc.

There are three ways to do it.
* a
* b

The following two steps matter. We found that it is soon. As of 2024-05 it is currently so.
Over the past few months it grew, and so on

## 2. Numbers
Soon soon.

## Empty

## Motivation
A. B c d. E f g! H i j. K l m. N o p. Q r s. T u v.
"""


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, SOURCE, "design"), (2, None, None), (3, "", "howto")], "doc_id long, source string, doctype string")
    parsed, m = maintainability(parse(docs), "en")
    parsed, s = structure(parsed, "en")
    rows = findings(parsed, m + s, "doc_id").collect()
    return {(r.doc_id, r.rule_id, r.message): [(p.line, p.column, p.text) for p in r.positions] for r in rows}


def of(found, rule, doc=1):
    return [p for (d, r, _), ps in found.items() if d == doc and r == rule for p in ps]


def test_maintainability(found):
    assert of(found, "maint/list-lead-in") == [(4, 1, "The reasons are:")]
    assert [(x, y) for x, y, _ in of(found, "maint/item-count")] == [(9, 11), (13, 15)]
    assert of(found, "maint/item-count")[0][2] == "three ways｜There are three ways to do it."
    assert of(found, "maint/numbered-heading") == [(16, 1, "2. Numbers")]
    assert of(found, "maint/manual-number") == [(7, 1, "1. three, etc.")]
    assert of(found, "maint/parallel-items") == [(5, 1, "one.")]
    assert [(x, y) for x, y, _ in of(found, "maint/time-dependent")] == [(13, 53), (14, 1), (17, 1), (17, 6)]
    assert of(found, "maint/trailing-etc") == [(7, 1, "1. three, etc."), (14, 1, "Over the past few months it grew, and so on")]


def test_structure(found):
    assert of(found, "structure/empty-section") == [(19, 1, "Empty")]
    assert of(found, "structure/lead-opener") == [(2, 1, "In recent years things changed.")]
    assert of(found, "structure/long-paragraph") == [(22, 1, "7文｜A. B c d. E f g! H i j. K l m. N o p. Q ")]
    assert of(found, "structure/missing-section") == [(1, 1, "Design｜")]
    assert of(found, "structure/missing-section", 3) == [(1, 1, "Prerequisites｜")]
    assert of(found, "structure/work-note") == []
    assert {d for d, _, _ in found} == {1, 3}


def test_positions_are_capped_and_counted(spark):
    docs = spark.createDataFrame([(1, "\n".join(["soon"] * 25))], "doc_id long, source string")
    parsed, m = maintainability(parse(docs), "en")
    row = findings(parsed, m, "doc_id").first()
    assert len(row.positions) == 20 and row.truncated == 5


def test_defined_names(spark):
    docs = parse(spark.createDataFrame([(1, "use foo and foo\n# foo")], "doc_id long, source string"))
    assert [tuple(p) for p in docs.select(defined_names([("Bar", ["foo"], "n")])).first()[0]] == [(1, 5, "foo→Bar（n）"), (1, 13, "foo→Bar（n）")]


def test_metrics(spark):
    words = [f"w{i % 7}" if i % 3 else f"x{i}" for i in range(130)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b a"), (3, None), (4, "like a fish\n- item")], "doc_id long, source string")
    rows = {r.doc_id: r for r in measured_en(parse(docs)).collect()}
    naive = [len(set(words[k : k + 100])) / 100 for k in range(31)]
    assert abs(rows[1].mattr100 - sum(naive) / 31) < 1e-12
    assert rows[2].mattr100 == 2 / 3 and rows[3].mattr100 == 0 and rows[3].prose_ratio == 0
    assert rows[4].similes == 1 and rows[4].list_ratio == 0.5 and rows[4].prose_ratio == 9 / 13


def test_profiles_need_no_python_on_executors(spark):
    from foliolens.operators import profiles

    frame = profiles.by_doctype(profiles.builtin(spark))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and frame.count() > 90 and {r.severity for r in frame.collect()} <= {"error", "warning", "info"}


def test_check_goes_over_the_texts_once(spark):
    from foliolens.plans import report

    docs = spark.createDataFrame([(k, "# T\nIt is so currently.\n- a\n", None) for k in range(20)], "doc_id long, source string, doctype string")
    out, found = report.check(docs, "doc_id")
    r = report.reports(docs, out, found, "doc_id")
    assert {len(x.local) > 0 for x in r.collect()} == {True}
    plan = r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("struct(blocks") == 1 and "ReusedExchange" in plan


def test_cheap_tests_let_all_matches_through(spark):
    from foliolens import fixed_values as V
    from foliolens.functions import text as T

    texts = ["It is ſo far", "İn the future", "CURRENTLY", "as of this writing", "newer", "over the LAST two dayſ", "next week", "The following", "Two steps", "2 ways", "we tried", "It turned out", "step 2 is done", "it used to be", "x etc.", "and more ", "nothing here", "", "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in V.NEEDED:
        got = rows.select("t", T.fits(F.col("t"), pattern).alias("a"), F.col("t").rlike(T.unicode(pattern)).alias("b")).collect()
        assert all(r.a == r.b for r in got), pattern
        assert any(r.b for r in got), pattern


def test_markup_that_only_begins_is_left_as_it_is(spark):
    from foliolens.operators.parse import parse

    source = "a [b](c) ![d](e) [f] (g) `h` i` **j** *k* l*\n\u3000\u2003 x \u0085\n~~~\nin\n~~~\n{{< highlight go >}}\nin\n{{< /highlight >}}\nlast\n```\nopen"
    r = parse(spark.createDataFrame([(1, source)], "doc_id long, source string"), "source", "blocks").first()
    assert [(b.line, b.text) for b in r.blocks] == [(1, "a b d [f] (g)  i` j k l*"), (2, "x"), (9, "last")]
