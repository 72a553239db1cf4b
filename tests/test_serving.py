"""Replies over a stream and embedding in batches: what a restart finds, and that it loses and doubles nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import store
from ctxloom.streaming import requests, sync


def call(id_, query, name=requests.TOOL):
    return json.dumps({"jsonrpc": "2.0", "id": id_, "method": "tools/call", "params": {"name": name, "arguments": {"query": query}}})


LINES = ['{"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-01-01"}}', '{"id": 2, "method": "initialize"}', '{"id": "x", "method": "ping"}', '{"method": "ping"}', '{"id": 3, "method": "tools/list"}', "{broken",
         "[1, 2]", '"text"', '{"id": 4}', '{"id": 5, "method": 7}', '{"id": null, "method": "ping"}', '{"id": 6, "method": "no/such"}', call(7, 'where is the "keel"\n?'), call(8, "nowhere"), call("9", "x", "other"), '{"id": 10, "method": "tools/call"}']


def upper(queries):
    return queries.where("query <> 'nowhere'").select("qid", F.upper("query").alias("text"))


def test_replies_equal_those_of_the_loop(spark):
    def retrieve(q):
        if q == "nowhere":
            raise KeyError("no answer")
        return q.upper()

    server = requests.Server(retrieve)
    rows = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r["value"]: json.loads(r["reply"]) for r in requests.replies(rows, upper).collect()}
    for line in LINES:
        want = server.reply(line)
        assert (line in got) == (want is not None), line
        if want is None:
            continue
        want = json.loads(want)
        if "result" in want and want["result"].get("isError"):
            assert got[line]["id"] == want["id"] and got[line]["result"]["isError"] is True
        else:
            assert got[line] == want, line


def test_a_restarted_stream_neither_loses_nor_doubles(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put = lambda a, b: spark.createDataFrame([(call(i, f"q{i}"),) for i in range(a, b)], "value string").coalesce(1).write.mode("append").text(source)
    stream = lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)
    put(0, 5)
    requests.serve_stream(stream(), upper, target, checkpoint)
    put(5, 9)
    put(9, 12)
    calls = []

    def failing(queries):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return upper(queries)

    with pytest.raises(Exception, match="lost"):
        requests.serve_stream(stream(), failing, target, checkpoint)
    requests.serve_stream(stream(), upper, target, checkpoint)
    got = [json.loads(r["reply"]) for r in spark.read.parquet(target).collect()]
    assert sorted(r["id"] for r in got) == list(range(12)) and all(r["result"]["content"][0]["text"] == f"Q{r['id']}" for r in got)


def test_a_killed_embedding_goes_on_after_its_last_batch(spark, tmp_path):
    log, broken = str(tmp_path / "log"), str(tmp_path / "broken")
    os.makedirs(log)
    open(broken, "w").close()

    def embed(texts):
        if os.path.exists(broken) and "text 25" in texts:
            raise RuntimeError("killed")
        for t in texts:
            with open(f"{log}/{t}", "a") as f:
                f.write("x")
        return [[float(len(t)), 1.0] for t in texts]

    held = store.Snapshots(spark, str(tmp_path / "db"))
    chunks = spark.createDataFrame([(f"c{i:03}", f"text {i}") for i in range(40)], "chunk string, text string").repartition(3)
    with pytest.raises(Exception, match="killed"):
        sync.embed_pending(chunks, held, embed, batch_bytes=70)
    landed = {r["chunk"] for r in held.table("vectors").collect()}
    assert 0 < len(landed) < 26
    os.remove(broken)
    more = chunks.unionByName(spark.createDataFrame([("c900", "text 900")], "chunk string, text string"))
    assert sync.embed_pending(more, held, embed, batch_bytes=70) == 41 - len(landed)
    rows = held.table("vectors").collect()
    assert len(rows) == 41 == len({r["chunk"] for r in rows})
    for i in landed:
        assert os.path.getsize(f"{log}/text {int(i[1:])}") == 1
    assert sync.embed_pending(more, held, embed) == 0
    assert sync.embed_pending(more.unionByName(spark.createDataFrame([("c901", "text 901")], "chunk string, text string")), held, embed) == 1
