"""Trace, evidence, text and file operators against plain Python on small and odd inputs."""

import datetime
import json
import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trailgrid.functions import answers as an
from trailgrid.operators import evidence, traces
from trailgrid.plans import trace_queries
from trailgrid.sinks import files as sinks
from trailgrid.sources import texts


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_results_go_to_the_earliest_waiting_call(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for trace in range(20):
        waiting = []
        for pos in range(30):
            kind = rng.choice(["user", "assistant", "tool", "tool", "calls"])
            calls = [{"name": "f", "arguments": f"{trace}-{pos}-{i}"} for i in range(rng.randrange(1, 3))] if kind == "calls" else None
            rows.append((trace, pos, "assistant" if calls else kind, None if kind == "calls" else f"r{pos}", calls))
            if calls:
                for c in calls:
                    want[c["arguments"]] = None
                    waiting.append(c["arguments"])
            elif kind == "tool" and waiting:
                want[waiting.pop(0)] = f"r{pos}"
    messages = spark.createDataFrame(rows, "trace int, pos int, role string, content string, calls array<struct<name string, arguments string>>")
    assert {r.content: r.result for r in traces.actions(messages).where("kind = 'tool'").collect()} == want
    assert traces.pairs(traces.actions(messages.limit(0))).count() == 0


def test_lenient_json(spark):
    cases = {'```json\n{"a": 1}\n``` and ```{"b": 2}```': {"a": 1}, 'so {"a": [1, 2]} it is': {"a": [1, 2]}, "[1, 2] yes": [1, 2], "none": None, "": None, None: None, "```\nnot json\n```": None}
    for text, want in cases.items():
        got = one(spark, an.lenient_json, text)
        assert (got if got is None else json.loads(got)) == want


def test_calls_and_answers(spark):
    text = '<think><tool_call>{"tool": "no"}</tool_call></think><tool_call>{"tool": "grep", "params": {"p": "x"}}</tool_call><tool_call>{"name": "head", "arguments": {"n": 1}}</tool_call>'
    assert [(c["name"], json.loads(c["arguments"])) for c in one(spark, an.tool_calls, text)] == [("grep", {"p": "x"}), ("head", {"n": 1})]
    assert [c["name"] for c in one(spark, an.tool_calls, '<tool_call>{"tool": "cut", "params": {}}')] == ["cut"]
    assert tuple(one(spark, an.answer_of, '<answer>{"answer": "5 t", "data_source": ["a.csv"]}</answer>')) == ("5 t", ["a.csv"])
    assert tuple(one(spark, an.answer_of, 'I say {"answer": "6"} now')) == ("6", [])
    assert tuple(one(spark, an.answer_of, " plain ")) == ("plain", [])
    assert one(spark, lambda t: an.answer_issues(an.answer_of(t)), "") == ["answer is empty", "data_source is empty"]


def test_numbers(spark):
    grouped = re.compile(r"(?<![\d.])[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\d,])")
    rng = random.Random(9)
    many = ["".join(rng.choice("0123456789,,..- %x") for _ in range(14)) for _ in range(400)] + ["101.1,100.6", "264,500 and 1,234,567.89", "1,2,3", "", None]
    df = spark.createDataFrame([(t,) for t in many], "t string")
    for r in df.select("t", an.numbers_and_percents(F.col("t")).alias("x")).where("t is not null").collect():
        plain = grouped.sub(lambda m: m[0].replace(",", ""), r.t)
        values = {float(x) for x in re.findall(r"(?<!\d)(-?\d+\.\d+)(?!\d)", plain)} | {float(x) for x in re.findall(r"(?<![\d.])(-?\d+)(?![\d.])", plain)}
        assert set(r.x["values"]) == values and set(r.x["percents"]) == {float(x) for x in re.findall(r"(-?\d+\.?\d*)\s*%", plain)}
    assert one(spark, an.amounts_in, "约1.5亿元, 16.96% 和 3,000辆") == [1.5e8, 16.96, 3000.0]


def test_ledger(spark):
    items = spark.createDataFrame(
        [(1, "a", 1, "raw_value", "120", 1.0, ["t.csv"], [], None), (1, "b", 2, "raw_value", "100", 1.0, [], [], None), (1, "g", 3, "derived_value", "20%", 2.0, [], ["a", "b"], "growth"), (1, "x", 4, "text_fact", "Paris branch", 1.0, [], [], None), (2, "n", 1, "raw_value", None, 1.0, None, None, None)],
        "sq int, item string, pos int, kind string, value string, weight double, tables array<string>, inputs array<string>, operation string",
    )
    steps = spark.createDataFrame(
        [(1, 1, "sum 100", "", ["t.csv"], "grep", True), (1, 2, "it is 120", "", ["other.csv"], "grep", True), (1, 3, "now 120, growth", "20", ["T.CSV"], "python", True), (1, 4, "paris branch", "", [], "grep", False)],
        "sq int, step int, text string, code string, sources array<string>, tool string, success boolean",
    )
    found = evidence.verified_at(items, steps)
    assert {(r.sq, r.item): r.at for r in found.collect()} == {(1, "a"): 3, (1, "b"): 1, (1, "g"): 3, (1, "x"): None, (2, "n"): None}
    assert [(r.step, r.coverage) for r in evidence.coverage(found).orderBy("step").collect()] == [(1, 0.2), (3, 0.8)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,y\n1,2\n".encode())
    (tmp_path / "b.txt").write_bytes("年月\n日".encode("gbk"))
    rows = {(r.path.split("/")[-1], r.line_no): (r.encoding, r.content) for r in texts.text_lines(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", 1): ("utf-8-sig", "x,y"), ("a.csv", 2): ("utf-8-sig", "1,2"), ("b.txt", 1): ("gbk", "年月"), ("b.txt", 2): ("gbk", "日")}
    run = {"task": "t", "response": "done", "conversation_trace": [{"messages": []}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "", "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}]}]}
    (tmp_path / "trace_1.json").write_text(json.dumps(run))
    got = texts.traces(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.role, r.content, r.calls and r.calls[0]["name"]) for r in got] == [("user", "q", None), ("assistant", "", "f"), ("assistant", "done", None)]
    sinks.json_lines(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_streams_of_a_folder_of_unordered_parts(spark, tmp_path):
    """70 files, more than one batch, the latest days first: no row is late, and repeats over batches count once."""
    (tmp_path / "events.parquet").mkdir()
    for k in range(70):
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=3 * (69 - k))
        rows = {"event_id": [2 * k, 2 * k + 1], "ts": [day, day + datetime.timedelta(hours=30)], "user_id": [k % 2, 2], "event_type": ["click", "view"], "value": [1.0 + k, 0.5], "props": [f"p{k % 5}", "same"]}
        at = tmp_path / "events.parquet" / f"part-{k:05d}.parquet"
        pq.write_table(pa.table(rows), at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    made = trace_queries.stream_tumbling(spark, str(tmp_path)).collect()
    assert sum(r.n for r in made) == 140 and len(made) == 140 and sum(r.total for r in made) == sum(1.5 + k for k in range(70))
    once = {(r.user_id, r.event_type): r.n for r in trace_queries.stream_first_calls(spark, str(tmp_path)).collect()}
    assert once == {(0, "click"): 5, (1, "click"): 5, (2, "view"): 1}
