"""Claims, dependencies, segments and curation on small rows with nulls, empty texts, ties and empty tables."""

import datetime
import json
import random
import struct

from pyspark.sql import functions as F

from trailgrid.functions import claims
from trailgrid.operators import curation, dependencies, segments
from trailgrid.plans import curation_queries

STEP = "array<struct<type:string,plan:string,calls:array<struct<id:string,name:string,arguments:string>>,observations:array<struct<id:string,content:string>>>>"


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1e16, 1e15, 0.0001, 0.00001, 2.0, 1e22, 1e23, 9.007199254740993e15, float("inf"), float("-inf"), float("nan"), None, 123456789012345680.0]
    values += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(2000)) if x == x and 1e-300 < abs(x) < 9.2e18] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 19) for _ in range(4000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", claims.python_number(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != (None if r.v is None else repr(r.v))] == []


def test_claims_of_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("-3%，下降到5%，负增长2个百分点",)], "t string")
    got = [r[0] for r in df.select(claims.signed_percents(F.col("t"))).collect()]
    assert got[:2] == [[], []] and [(x.value, x.unit, x.kind) for x in got[2]] == [(-3.0, "percent", "change"), (5.0, "percent", "level"), (-2.0, "percentage_point", "change")]
    for f in (claims.references, claims.entities, claims.metrics, claims.constraints, claims.times, claims.value_tokens):
        assert [r[0] for r in df.limit(2).select(f(F.col("t"))).collect()] == [[], []]
    assert [r[0] for r in df.select(claims.computation(F.col("t"))).collect()] == [None] * 3


def test_plans_lose_error_clauses(spark):
    plans = ["出现了错误：BFloat16。换一种方法：读取文件", "读取文件，出现错误，列出", None, "", "Got unsupported ScalarType. 重试：列出目录"]
    df = spark.createDataFrame([(p,) for p in plans], "p string")
    assert [r[0] for r in df.select(curation.clean_plan(F.col("p"))).collect()] == ["读取文件", "读取文件，列出", None, "", "列出目录"]


def test_failed_calls(spark):
    call = lambda i: (i, "t", "{}")
    steps = [
        ("tool_call", "p", [call("a"), call("b")], [("a", "BFloat16"), ("b", "fine")]), ("tool_call", "出现错误，做", [call("c")], [("c", "ScalarType")]), ("tool_call", "出现错误，做", [call("d")], [("d", None)]),
        ("tool_call", "q", [], []), ("tool_call", None, [call(None)], [(None, "BFloat16")]), ("final_answer", None, None, None),
    ]
    df = one(spark, f"s {STEP}", steps)
    kept = df.select(curation.without_failed_calls(F.col("s"))).first()[0]
    assert [([c.id for c in s.calls or []], s.plan) for s in kept] == [(["b"], "p"), (["d"], "做"), ([], "q"), ([None], None), ([], None)]
    assert [s.type for s in df.select(curation.without_orphans(curation.without_failed_calls(F.col("s")))).first()[0]] == ["tool_call"] * 3 + ["final_answer"]
    assert one(spark, f"s {STEP}", None).select(curation.without_failed_calls(F.col("s"))).first()[0] is None


def test_loose_calls(spark):
    texts = {
        None: None, "": None, '{"name": "a", "arguments": "{\\"x\\": 1}"}': ("a", {"x": "1"}), '{"arguments": {}}': None, '<head>{"n": 2}</head>': ("head", {"n": "2"}),
        '<tool name="t"><param name="q">1</param><param name="q">2</param>': ("t", {"q": "2"}), '<parameter name="query">x</parameter>': ("table_selector", {"query": "x"}), "<name>z</name>": ("name", {}), "<tool>x <name> z </name>": ("name", {}), "words": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(curation.loose_call(F.col("t"))).collect()]
    assert [g and (g.name, g.arguments) for g in got] == list(texts.values())


def test_call_issues(spark):
    schema = {"t": {"x": {"type": "number", "required": True}}, "bare": {}}
    calls = spark.createDataFrame([(1, 0, 0, "a", "t", '{"x": true}'), (1, 1, 0, "a", "t", None), (1, 2, 0, None, "t", "{}"), (1, 3, 0, "b", None, "{}"), (1, 4, 0, "c", "bare", "[]"), (1, 5, 0, "d", "bare", "{}")], "scope int, step int, pos int, call_id string, tool string, arguments string")
    seen = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 0, None), (1, 5, "z")], "scope int, step int, call_id string")
    got = sorted((r.call_id or "", r.issue) for r in curation.call_issues(calls, seen, schema).collect())
    assert got == sorted([("a", "type:x"), ("a", "repeated id"), ("a", "bad arguments"), ("", "no id"), ("b", "no tool"), ("c", "bad arguments"), ("c", "no observation"), ("d", "no observation"), ("a", "repeated observation"), ("", "observation without id"), ("z", "no call")])
    assert curation.call_issues(calls.limit(0), seen.limit(0), schema).count() == 0


def test_links_are_those_that_tiers_count(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.choice(["raw_value", "derived_value", "text_fact"]), rng.choice(["e", "f", None]), rng.choice(["t", "u", None])) for i in range(80)]
    items = spark.createDataFrame(rows, "sample int, item int, kind string, entity string, time string")
    counts = {r.item: r.inputs for r in dependencies.link_tiers(items).collect()}
    found = {}
    for r in dependencies.links(items).collect():
        found.setdefault(r.item, set()).add(r.input)
    for s, i, kind, e, t in rows:
        if kind == "derived_value":
            raw = [x for x in rows if x[0] == s and x[2] == "raw_value"]
            tries = [[x for x in raw if e and t and x[3:] == (e, t)], [x for x in raw if e and x[3] == e], [x for x in raw if t and x[4] == t], raw]
            want = {x[1] for x in next((y for y in tries if y), [])}
            assert found.get(i, set()) == want and counts[i] == len(want)


def test_numeric_needs_only_of_turns_whose_evidence_names_the_metric(spark):
    turns = spark.createDataFrame([("s", 1, "产量", None, ["产量为5"]), ("s", 2, "产量", None, []), ("s", 3, "产量 北京", ["a", None], None), ("s", 4, None, ["a"], None)], "sample string, pos int, text string, tables array<string>, values array<string>")
    got = {(r.boundary, r.needed_by, r.kind): (r.what, r.sources) for r in dependencies.future_dependencies(turns).collect()}
    assert got == {(1, 2, "numeric_fact"): ("产量", 1), (2, 3, "numeric_fact"): ("产量", 1), (1, 3, "numeric_fact"): ("产量", 1), (3, 4, "table_ref"): ("a", 1)}


def test_segments_and_tokens(spark):
    runs = spark.createDataFrame([("r", [1.0, 2.0], "a", 4.0, 0.5), ("q", None, None, None, None)], "rollout string, rewards array<double>, answer string, answer_reward double, memory_reward double")
    segs = segments.segments(runs, gamma=0.5)
    assert sorted((r.kind, r.step, r.value) for r in segs.collect()) == [("answer", -1, 4.0), ("memory", -1, 0.5), ("tool", 0, 3.0), ("tool", 1, 4.0)]
    steps = [(0, "call", False, [("ok", True), (None, None)]), (1, None, True, None)]
    talk = segments.conversation(one(spark, "rollout string, system string, question string, steps array<struct<step:int,response:string,invalid:boolean,observations:array<struct<content:string,success:boolean>>>>, answer string", "r", None, "q", steps, "a b"))
    assert [m.content for m in talk.orderBy("pos").collect()] == ["", "q", "call", "[Tool Result] ok", "[ERROR] ", "", "[ERROR] Multiple tool calls detected...", "a b"]
    made = segments.token_arrays(segments.with_advantages(talk, segs), F.filter(F.split("content", " "), lambda x: x != ""), 6)
    row = made.first()
    assert row.ids == ["q", "call", "[Tool", "Result]", "ok", "[ERROR]"] and row.advantages == [0.0, 3.0, 0.0, 0.0, 0.0, 0.0] and row.trainable == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_segments_of_every_event_as_a_fold(spark, tmp_path):
    """Odd ids, small values and more than 40 steps: no event goes."""
    events = [(i, u, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i * 37 % 101), float(i % 13) - 2) for u, n in ((1, 3), (2, 55), (3, 90)) for i in range(1000 * u, 1000 * u + n)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u in (1, 2, 3):
        rewards = [r[3] for r in sorted((r for r in events if r[1] == u), key=lambda r: (r[2], r[0]))]
        g = best = max(rewards)
        want[(u, "answer", -1)] = best
        for t in reversed(range(len(rewards))):
            g = rewards[t] + 0.5 * g
            want[(u, "tool", t)] = g
    got = {(r.rollout, r.kind, r.step): r.value for r in curation_queries.training_segments(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_token_advantages_up_to_the_limit_of_the_reference(spark, tmp_path):
    talk = [("a", 1, "user", "uu " * 150), ("a", 2, "assistant", "xyz\n" * 250), ("b", 1, "user", "q"), ("b", 2, "assistant", "w " * 5000)]
    spark.createDataFrame(talk, "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in curation_queries.token_advantages(spark, str(tmp_path)).select("conv_id", "tokens", "id_sum", "advantage_sum", "trained").collect()}
    assert got == {("a", 400, 1050, 500.0, 250.0), ("b", 4096, 4096, 8190.0, 4095.0)}


def test_gates(spark):
    schema = f"sample int, sq int, user string, steps {STEP}, answer string, tables array<string>"
    rows = [(1, 1, "q", [("final_answer", None, None, None)], "a", ["t"]), (1, 2, " ", None, None, None), (1, 3, "q", [("tool_call", None, None, [("i", "BFloat16")])], "a", ["t"])]
    got = {r.sq: r.failures for r in curation.gate_failures(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [], 2: ["no question", "no final step", "no answer", "no source"], 3: ["no final step", "marked error"]}


def test_presentations_of_the_final_answer_go(spark):
    say = lambda answer: json.dumps({"code": "import json\nprint(json.dumps(" + json.dumps({"answer": answer, "data_source": ["t"]}) + "))"})
    tool = "python_code_executor"
    steps = [
        ("tool_call", None, [("a", tool, say("12 cars")), ("b", "other", say("12 cars")), ("c", tool, '{"code": "print(1 + 1)"}')], [("a", "x"), ("b", "y"), (None, "z")]),
        ("tool_call", None, [("d", tool, say("12 cars"))], [("d", "x")]), ("tool_call", None, [("e", tool, say("other words")), ("f", tool, None)], [("e", "x")]), ("final_answer", None, None, None),
    ]
    schema = f"k int, steps {STEP}, final struct<answer:string,data_source:array<string>>"
    df = spark.createDataFrame([(1, steps, ("12 cars", ["t"])), (2, steps, None), (3, None, None), (4, [], ("a", None))], schema)
    got = {r.k: r.steps and [([c.id for c in s.calls or []], [o.id for o in s.observations or []]) for s in r.steps] for r in curation.without_presentations(df).collect()}
    every = [(["a", "b", "c"], ["a", "b"]), (["d"], ["d"]), (["e", "f"], ["e"]), ([], [])]
    assert got == {1: [(["b", "c"], ["b"]), *every[2:]], 2: every, 3: None, 4: []}
