from foliolens.operators.parse import field, front_matter, parse


def parsed(spark, source):
    docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
    return parse(docs).first()


def kinds(row):
    return [(b.line, b.kind, b.text) for b in row.blocks]


def test_lines_survive_what_is_removed(spark):
    row = parsed(spark, "---\ndoctype: design\n---\n# T\n\n```py\n# no heading\n```\n- a\n* b\n\n1. c\n<b\nclass=x>bold</b> t\n| x |\n> q")
    assert kinds(row) == [(4, "Heading", "T"), (9, "ListItem", "a"), (10, "ListItem", "b"), (12, "ListItem", "c"), (14, "Prose", "bold t"), (15, "Table", "| x |"), (16, "Quote", "> q")]
    assert row.code_lines == [6, 7, 8]
    assert [b.blank_before for b in row.blocks] == [True, True, False, True, True, False, False]
    assert [b.ordered for b in row.blocks][1:4] == [False, False, True]
    assert [tuple(x) for x in row.lists] == [(2, 4)]


def test_fences(spark):
    row = parsed(spark, "````\n```\nx\n````\ny\n~~~\n```\nz")
    assert kinds(row) == [(5, "Prose", "y")]
    assert row.code_lines == [1, 2, 3, 4, 6, 7, 8]
    assert kinds(parsed(spark, "    ```\ny")) == [(1, "Prose", "`"), (2, "Prose", "y")]


def test_shortcodes(spark):
    row = parsed(spark, '{{< highlight go >}}\ncode\nend {{< /highlight >}}\n{{< note >}}\nprose\n{{< tab "x" codelang="sh" >}}\nls\n{{< /tab >}}\n{{< mermaid >}}\nleft')
    assert row.code_lines == [1, 2, 3, 6, 7, 8]
    assert [b.line for b in row.blocks] == [4, 5, 9, 10]


def test_inline_and_escapes(spark):
    row = parsed(spark, r"a \*b\* [t](u) ![i](v) `c` **d** *e*" + "\n\\# no heading\n## h\n    # deep")
    assert kinds(row) == [(1, "Prose", "a b t i  d e"), (2, "Heading", "no heading"), (3, "Heading", "h"), (4, "Prose", "# deep")]


def test_paragraphs_outline_and_lead(spark):
    row = parsed(spark, "# T\nlead\nmore\n\nnext\n## A\n### B\ntext\n## C\n## D\n```\nx\n```\n- i\nafter")
    assert [(p.line, p.text) for p in row.paragraphs] == [(2, "lead more"), (5, "next"), (8, "text"), (15, "after")]
    assert [(o.text, o.level, o.has_body, o.has_child) for o in row.outline] == [("T", 1, True, True), ("A", 2, False, True), ("B", 3, True, False), ("C", 2, False, False), ("D", 2, True, False)]
    assert [o.text for o in row.sections] == ["A", "C", "D"]
    assert row.lead.text == "lead more"


def test_empty_and_null_sources(spark):
    for source in (None, "", "\n\n", "```"):
        row = parsed(spark, source)
        assert row.blocks == [] and row.paragraphs == [] and row.sections == [] and row.lead is None and row.non_empty_lines == 0


def test_front_matter_field(spark):
    docs = spark.createDataFrame([('---\ntitle: x\ndoctype: "howto"\n---\n',), ("doctype: no",)], "s string")
    assert [r[0] for r in docs.select(field(front_matter(docs.s), "doctype")).collect()] == ["howto", None]
