"""Streams: documents checked as they arrive, running counts, firing rates by event time, and a request stream.

Checking is a stateless map; terms and rates keep counts as state, by key or by window.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.operators import metrics, parse, rules, structure, terms
from foliolens.plans import brief, report


def findings_of(docs: DataFrame, key: str, source: str = "source", lang: str = "en") -> DataFrame:
    """Findings of a batch or a stream of documents; no shuffle and no state."""
    if "doctype" not in docs.columns:
        docs = structure.resolve_doctype(docs, source)
    d, found = rules.maintainability(parse.parse(docs, source), lang)
    d, more = structure.structure(d, lang)
    return rules.findings(d, found + more, key)


def check_stream(docs: DataFrame, key: str, path: str, checkpoint: str):
    """Writes findings of a stream as Parquet, of all that is there now."""
    return findings_of(docs, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_terms(docs: DataFrame, source: str = "source") -> DataFrame:
    """(word, count) so far: state is one count for each term."""
    return parse.parse(docs, source).select(F.explode(terms.terms_of_en()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def running_metrics(docs: DataFrame, key: str, source: str = "source") -> DataFrame:
    return metrics.metrics_en(parse.parse(docs, source), key)


def windowed_rates(events: DataFrame, time: str, kind: str, fired, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, fired, share) by tumbling windows of event time; state goes once the watermark has passed."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    w = d.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(fired, 1)).alias("fired"))
    return w.select(F.col("w.start").alias("start"), kind, "n", "fired", (F.col("fired") / F.col("n")).alias("share"))


_TOOLS = [{"name": "check", "description": "Check a document", "inputSchema": {"type": "object", "properties": {"text": {"type": "string"}, "path": {"type": "string"}}}}, {"name": "brief", "description": "Rules to write by", "inputSchema": {"type": "object", "properties": {"doctype": {"type": "string"}}}}]


def respond(spark, line: str, documents=None) -> str | None:
    """The answer to one JSON-RPC line; None for blank lines and notifications.

    A tool that fails answers with isError, as a result. documents(path) gives the text of a path.
    """
    if not line.strip():
        return None
    made = lambda i, **x: json.dumps({"jsonrpc": "2.0", "id": i, **x}, ensure_ascii=False)
    try:
        request = json.loads(line)
    except json.JSONDecodeError as e:
        return made(None, error={"code": -32700, "message": f"parse error: {e}"})
    if not isinstance(request, dict) or "id" not in request:
        return None
    i, method, params = request["id"], request.get("method", ""), request.get("params") or {}
    if method == "initialize":
        return made(i, result={"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "foliolens", "version": "0.1"}})
    if method == "ping":
        return made(i, result={})
    if method == "tools/list":
        return made(i, result={"tools": _TOOLS})
    if method != "tools/call":
        return made(i, error={"code": -32601, "message": f"unknown method: {method}"})
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in ("check", "brief"):
        return made(i, error={"code": -32602, "message": f"unknown tool: {name}"})
    try:
        if name == "brief":
            text = brief.brief(spark, args.get("lang", "auto"), args.get("detail", "balanced"), args.get("doctype"))
        else:
            if ("text" in args) == ("path" in args):
                raise ValueError("exactly one of text and path is needed")
            source = args["text"] if "text" in args else documents(args["path"])
            docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
            out, found = report.check(docs, "doc_id")
            text = report.reports(docs, out, found, "doc_id").select(report.markdown()).first()[0]
    except Exception as e:
        return made(i, result={"content": [{"type": "text", "text": str(e)}], "isError": True})
    return made(i, result={"content": [{"type": "text", "text": text}], "isError": False})
