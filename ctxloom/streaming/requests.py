"""JSON-RPC requests, one a line: dispatch as a stream or a table, and the loop that serves them on stdio."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL = "codebase-retrieval"
PARSE, INVALID, UNKNOWN = -32700, -32600, -32601


def as_requests(conversations: DataFrame) -> DataFrame:
    """Conversations as request lines: user turns ask, others notify, some are broken."""
    method = F.when(F.col("role") == "user", "tools/call").when(F.col("turn") % 2 == 0, "ping").otherwise("notifications/initialized")
    asked = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.concat("conv_id", F.lit("-"), "turn").alias("id"), method.alias("method")))
    told = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), method.alias("method")))
    line = F.when(F.col("conv_id") % 17 == 0, "{broken").when(method == "notifications/initialized", told).otherwise(asked)
    return conversations.select(line.alias("value"))


def dispatched(lines: DataFrame) -> DataFrame:
    """(value) -> (kind, n): what each line gets; notifications get no reply. Works on streams as on tables."""
    r = F.from_json("value", "jsonrpc string, id string, method string", {"mode": "PERMISSIVE"})
    rows = lines.select(r.alias("r"), F.get_json_object("value", "$").isNotNull().alias("parsed"))
    kind = (F.when(~F.col("parsed"), F.lit(f"error {PARSE}")).when(F.col("r.method").isNull(), F.lit(f"error {INVALID}"))
            .when(F.col("r.id").isNull(), F.lit("silent")).when(F.col("r.method").isin("initialize", "tools/list", "tools/call", "ping"), F.concat(F.lit("result "), "r.method")).otherwise(F.lit(f"error {UNKNOWN}")))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


DISPATCH_SQL = """
select kind, count(*) as n from (select case when conv_id % 17 = 0 then 'error -32700' when role = 'user' then 'result tools/call'
  when turn % 2 = 0 then 'result ping' else 'silent' end as kind from conversations) group by kind"""


LISTED = {"tools": [{"name": TOOL, "description": "Code and tests that a task is about", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}}]}


def parsed(lines: DataFrame) -> DataFrame:
    """(value) -> (value, id, method, tool, query, protocol, kind): kind is silent for what gets no reply, call for the tool, an error's number, or a method.

    id is the JSON of the request's id as it was sent, so numbers stay numbers."""
    v = F.try_parse_json("value")
    rows = lines.select("value", v.alias("v"))
    text = lambda path: F.try_variant_get("v", path, "string")
    id_, method = F.to_json(F.try_variant_get("v", "$.id", "variant")), text("$.method")
    isa = F.schema_of_variant("v")
    is_object, named = isa.startswith("OBJECT"), F.schema_of_variant(F.try_variant_get("v", "$.method", "variant")) == "STRING"
    kind = (F.when(F.col("v").isNull(), str(PARSE)).when(~is_object | ~F.coalesce(named, F.lit(False)), str(INVALID)).when(id_.isNull(), "silent")
            .when(method == "tools/call", "call").when(method.isin("initialize", "ping", "tools/list"), method).otherwise(str(UNKNOWN)))
    return rows.select("value", F.when(is_object, id_).alias("id"), F.when(is_object, method).alias("method"), text("$.params.name").alias("tool"), text("$.params.arguments.query").alias("query"),
                       text("$.params.protocolVersion").alias("protocol"), kind.alias("kind"))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def replies(lines: DataFrame, answers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(value) -> (value, reply) of all lines that get one. answers: (qid, query) -> (qid, text) for all calls of the lines at once.

    A query that gets no answer, a call of another tool or one without a query is a result with isError, no protocol error."""
    rows = parsed(lines)
    good = (F.col("kind") == "call") & (F.col("tool") == TOOL) & F.col("query").isNotNull()
    rows = rows.withColumn("qid", F.when(good, F.xxhash64("query")))
    told = answers(rows.where("qid is not null").groupBy("qid").agg(F.first("query").alias("query"))).select(F.col("qid").alias("q"), F.col("text").alias("told"))
    rows = rows.join(told, F.col("qid") == F.col("q"), "left")
    bad = F.when(~F.coalesce(F.col("tool") == TOOL, F.lit(False)), F.concat(F.lit("ValueError: unknown tool "), F.coalesce("tool", F.lit("None")))).otherwise("KeyError: no answer")
    say = F.coalesce("told", bad)
    result = F.concat(F.lit('{"content":[{"type":"text","text":'), quoted(say), F.lit('}],"isError":'), F.col("told").isNull().cast("string"), F.lit("}"))
    hello = F.concat(F.lit('{"protocolVersion":'), quoted(F.coalesce("protocol", F.lit("2024-11-05"))), F.lit(',"capabilities":{"tools":{}},"serverInfo":{"name":"ctxloom","version":"0.1.0"}}'))
    body = (F.when(F.col("kind") == "call", result).when(F.col("kind") == "initialize", hello).when(F.col("kind") == "tools/list", json.dumps(LISTED, separators=(",", ":"))).when(F.col("kind") == "ping", "{}"))
    wrong = F.when(F.col("kind") == str(PARSE), "parse error").when(F.col("kind") == str(INVALID), "invalid request").otherwise(F.concat(F.lit("unknown method "), "method"))
    tail = F.when(body.isNotNull(), F.concat(F.lit('"result":'), body)).otherwise(F.concat(F.lit('"error":{"code":'), F.col("kind"), F.lit(',"message":'), quoted(wrong), F.lit("}")))
    reply = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("id", F.lit("null")), F.lit(","), tail, F.lit("}"))
    return rows.where("kind <> 'silent'").select("value", reply.alias("reply"))


def serve_stream(lines: DataFrame, answers: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """A stream of request lines -> replies in folders batch=N of target; answers what there is, and ends.

    A micro-batch is answered in one job and written to the folder of its number, over what an interrupted run may have left
    there, so a restart from the checkpoint neither loses nor doubles a reply."""

    def answer(batch: DataFrame, number: int) -> None:
        batch.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        replies(batch, answers).write.mode("overwrite").parquet(f"{target}/batch={number}")

    lines.select("value").writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Server:
    """Answers one request a line. retrieve(query) -> text or raises; a failing tool is a result with isError, no protocol error."""

    def __init__(self, retrieve: Callable[[str], str], name: str = "ctxloom", version: str = "0.1.0"):
        self.retrieve, self.name, self.version = retrieve, name, version

    def reply(self, line: str) -> str | None:
        try:
            r = json.loads(line)
        except ValueError:
            return self._error(None, PARSE, "parse error")
        if not isinstance(r, dict) or not isinstance(r.get("method"), str):
            return self._error(r.get("id") if isinstance(r, dict) else None, INVALID, "invalid request")
        if "id" not in r:
            return None
        method, params = r["method"], r.get("params") or {}
        if method == "initialize":
            return self._result(r["id"], {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": self.version}})
        if method == "ping":
            return self._result(r["id"], {})
        if method == "tools/list":
            return self._result(r["id"], LISTED)
        if method != "tools/call":
            return self._error(r["id"], UNKNOWN, f"unknown method {method}")
        try:
            if params.get("name") != TOOL:
                raise ValueError(f"unknown tool {params.get('name')}")
            text, bad = self.retrieve(params["arguments"]["query"]), False
        except Exception as e:
            text, bad = f"{type(e).__name__}: {e}", True
        return self._result(r["id"], {"content": [{"type": "text", "text": text}], "isError": bad})

    @staticmethod
    def _result(id_, result) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "result": result})

    @staticmethod
    def _error(id_, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}})

    def serve(self, lines, write: Callable[[str], None]) -> None:
        for line in lines:
            if line.strip() and (out := self.reply(line)) is not None:
                write(out + "\n")
