"""Operators without SQL, and odd inputs of those with it, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgrid.functions import checks, plugins
from trailgrid.operators import curation, gold, grid, memory, reports, retrieval, rewards, sessions
from trailgrid.sinks import files as sinks
from trailgrid.sources import tables, texts


def test_texts_that_hold_one_another(spark):
    rng = random.Random(1)
    words = ["ab", "ba", "abc", "cab", "x", "价格", "a" * 9, ""]
    small = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(60)]
    large = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(80)]
    got = gold.contained(spark.createDataFrame(small, "a int, text string"), spark.createDataFrame(large, "b int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, s in small for b, t in large if s and s in t)


def test_samples_with_ties_and_misses(spark):
    samples = spark.createDataFrame([(5, "how many cars"), (3, "cars"), (4, "how many cars were sold in May"), (1, " how many cars "), (2, None), (6, "")], "pos int, task string")
    traces = spark.createDataFrame([("a", "how many cars"), ("b", "many cars were sold"), ("c", "nothing alike"), ("d", None), ("e", "  ")], "trace string, query string")
    first = {r.trace: r.pos for r in gold.first_sample(traces, samples).collect()}
    best = {r.trace: r.pos for r in gold.best_sample(traces, samples).collect()}
    assert first == {"a": 1, "b": 3, "c": None, "d": 2, "e": 2} and best == {"a": 1, "b": 4, "c": None, "d": None, "e": None}


def test_anchors_by_normal_form_and_evaluated_query(spark):
    messages = spark.createDataFrame([("t", 0, "system", "s"), ("t", 1, "user", "How many？"), ("t", 2, "user", "how many cars, please"), ("t", 3, "user", "last one"), ("t", 4, "user", "How many？")], "trace string, pos int, role string, content string")
    items = spark.createDataFrame([("t", 1, "how many"), ("t", 2, "how many cars"), ("t", 3, "unlike all"), ("t", 4, "How many？"), ("t", 5, " ")], "trace string, sq int, item string")
    asked = spark.createDataFrame([("t", 1, "not said"), ("t", 2, "LAST ONE!")], "trace string, step int, query string")
    got = {r.sq: (r.at, r.how) for r in gold.find_anchors(messages, items, asked).collect()}
    assert got == {1: (None, "claimed"), 2: (2, "substring"), 3: (3, "asked"), 4: (1, "exact")}


def test_the_middle_of_values(spark):
    rng = random.Random(2)
    rows = [(k, v) for k in range(5) for v in ([rng.choice([0.0, 1.5, rng.random() * 10**k]) for _ in range(rng.randrange(1, 300))])] + [(9, 2.0), (9, None), (8, None)]
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted(v for j, v in rows if j == k and v is not None)
        want[k] = (len(vs), vs[0], vs[-1], vs[len(vs) // 2])
    got = {r.k: (r.n, r.lo, r.hi, r.middle) for r in reports.middle(spark.createDataFrame(rows, "k int, v double"), "v", "k").collect()}
    assert got == want


@pytest.mark.parametrize("gamma", [0.95, 0.2])
def test_returns_of_long_and_short_histories(spark, gamma):
    rng = random.Random(3)
    rows = [(k, t, rng.random() * 10) for k, n in ((1, 1), (2, 7), (3, 8), (4, 700)) for t in range(n)]
    want = {}
    for k in (1, 2, 3, 4):
        g = 0.0
        for _, t, r in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            g = r + gamma * g
            want[k, t] = g
    rng.shuffle(rows)
    got = {(r.k, r.t): r.g for r in rewards.returns(spark.createDataFrame(rows, "k int, t int, r double"), "k", ["t"], "r", gamma, 8).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 * max(1, want[x]) for x in want)


def test_row_blocks_as_packed_by_hand(spark):
    lines = [(p, i, " ".join(["w"] * n)) for p, ns in (("a", [2, 2, 3, 4, 50, 1, 1]), ("b", [1]), ("c", [1, 1, 2])) for i, n in enumerate(ns, 1)]
    blocks = retrieval.row_blocks(spark.createDataFrame(lines, "path string, line_no int, content string"), 20).collect()
    # The header costs ten words; a block starts again with its last line; a line over the budget stands with the one before.
    assert sorted((r.path, r.row, r.n) for r in blocks) == [("a", 3, 2), ("a", 4, 2), ("a", 5, 2), ("a", 6, 2), ("c", 3, 1)]
    assert all(r.text.startswith("Header data:\nw") and r.text.count("\n") == 4 + r.n for r in blocks)


def test_vector_lists_and_hashes(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, [0.0] * 8)], "id long, v array<double>")
    centres, lists = retrieval.build_lists(corpus)
    assert centres.count() == 40 and lists.count() == 401
    queries = spark.createDataFrame([(1, x[3].tolist()), (2, x[7].tolist())], "qid int, q array<double>")
    retrieval.save_lists(lists, centres, f"{tmp_path}/index")
    centres, lists = retrieval.load_lists(spark, f"{tmp_path}/index")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q, i in ((1, 3), (2, 7)):
        exact = [int(j) for j in np.argsort(-(u @ u[i]), kind="stable")[:5]]
        every = [r.id for r in retrieval.search_lists(lists, centres, queries, 5, probes=40).where(F.col("qid") == q).orderBy("rank").collect()]
        some = [r.id for r in retrieval.search_lists(lists, centres, queries, 5, probes=10).where(F.col("qid") == q).collect()]
        assert every == exact and len(set(some) & set(exact)) >= 3
    near = [r.id for r in retrieval.near_by_hash(corpus, x[3].tolist(), 5).collect()]
    assert near[0] == 3 and len(near) == 5


def test_too_many_for_a_broadcast_is_refused(spark):
    tokens = spark.range(20).select(F.col("id").alias("qt"), F.array(F.lit(1.0)).alias("q"))
    with pytest.raises(ValueError):
        retrieval.max_sim(tokens, tokens.select(F.col("qt").alias("id"), F.col("q").alias("v")), most=10)


def test_rerank_and_search_by_name(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (3, [9.0, 9.0])], "id int, v array<double>")
    found = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    query = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qt int, q array<double>")
    assert [tuple(r) for r in retrieval.rerank(found, query, docs, 2).collect()] == [(1, 2.0), (2, 1.0)]
    texts_ = spark.createDataFrame([(1, "red cars"), (2, "blue boats")], "doc_id int, text string")
    assert retrieval.search(texts_, "cars", 1).first().id == 1
    known = retrieval.with_vectors(texts_, spark.createDataFrame([("x", [1.0])], "hash string, v array<double>"))
    assert known.where("v is null").count() == 2 and retrieval.unencoded(texts_.union(texts_), known.selectExpr("'y' as hash")).count() == 2


def test_folder_trees(spark):
    tree = lambda paths, n: tables.folder_tree(spark.createDataFrame([(p,) for p in paths], "path string"), n)
    paths = ["b.csv", "a/x.csv", "a/d/y.csv", "a/d/z.csv", "c/w.csv"]
    assert tree(paths, 10) == "├── 📁 a/\n│   ├── 📁 d/\n│   │   ├── 📄 y.csv\n│   │   └── 📄 z.csv\n│   └── 📄 x.csv\n├── 📁 c/\n│   └── ...\n└── 📄 b.csv\n... (1 more files not shown)"
    assert tree(paths, 4) == "├── 📁 a/\n│   ├── 📁 d/\n│   │   └── ...\n│   └── ... (1 files omitted)\n├── 📁 c/\n│   └── ...\n└── 📄 b.csv\n... (4 more files not shown)"
    assert tree(paths, 2) == "├── 📁 a/\n│   └── ...\n├── 📁 c/\n│   └── ...\n└── ... (1 files omitted)\n... (5 more files not shown)"
    assert tree([], 3) == ""


def test_previews_and_lines_of_files(spark, tmp_path):
    assert texts.preview_lines("﻿a \nb\x0cc\n".encode(), 2) == ["a", "b\x0cc"] and texts.preview_lines("价格".encode("gbk")) == ["价格"]
    with pytest.raises(ValueError):
        texts.preview_lines(b"\xff\xff\xff")
    (tmp_path / "f.csv").write_bytes("a\x0cb c\r\nd\n\n".encode())
    (tmp_path / "e.csv").write_bytes(b"")
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.content) for r in texts.text_lines(spark, str(tmp_path)).collect())
    assert got == [("f.csv", 1, "a\x0cb c"), ("f.csv", 2, "d"), ("f.csv", 3, "")]


def test_find_by_name_and_unseen(spark):
    files = spark.createDataFrame([("d/a/x.csv", "x.csv"), ("d/b/x.csv", "x.csv"), ("d/y.csv", "y.csv")], "path string, name string")
    wanted = spark.createDataFrame([("x.csv", "b/"), ("x.csv", None), ("z.csv", "d")], "name string, hint string")
    assert {(r.name, r.hint): r.path for r in texts.find_by_name(wanted, files).collect()} == {("x.csv", "b/"): "d/b/x.csv", ("x.csv", None): "d/a/x.csv", ("z.csv", "d"): None}
    samples = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "pos int, task string")
    assert sorted(r.pos for r in texts.unseen(samples, spark.createDataFrame([("c",), ("c",)], "task string")).collect()) == [1, 2]


STEP = "array<struct<type:string,plan:string,calls:array<struct<id:string,name:string,arguments:string>>,observations:array<struct<id:string,content:string>>>>"


def test_all_stages_of_cleaning(spark):
    call, tool = (lambda i, a="{}": (i, "t", a)), "tool_call"
    one = [(tool, "p", [call("a"), call("b")], [("a", "x"), ("b", "y")]), (tool, "p", [call("a", '{"n": 1}')], [("a", "z")]), (tool, "p", [call("c")], [("c", "ScalarType BFloat16")]), (tool, "p", [call(""), call("d")], [("", "q"), ("d", "w")]), ("final_answer", None, None, None)]
    two = [(tool, "p", [call("a")], [("a", "x")]), (tool, None, [], []), ("final_answer", None, None, None)]
    rows = [("k", 1, one, ("12", ["t"])), ("k", 2, two, None), ("n", 1, None, None), ("e", 1, [], None)]
    made = curation.cleaned(spark.createDataFrame(rows, f"dialog string, sq int, steps {STEP}, final struct<answer:string,data_source:array<string>>"))
    got = {(r.dialog, r.sq): ([[c.id for c in s.calls or []] for s in r.steps or []], [[o.id for o in s.observations or []] for s in r.steps or []], r.conflicts) for r in made.collect()}
    calls = [["call_k_1_000", "call_k_1_001"], ["call_k_1_002", "call_k_1_003"], []]
    # An observation without an id goes where presentations are looked for: it belongs to no call that stays.
    assert got == {("k", 1): (calls, [calls[0], ["call_k_1_003"], []], ["a"]), ("k", 2): ([["call_k_2_004"], []], [["call_k_2_004"], []], []), ("n", 1): ([], [], None), ("e", 1): ([], [], [])}


def test_numbers_past_a_thousand(spark):
    calls = spark.range(1200).select(F.lit(1).alias("scope"), F.col("id").alias("step"), F.lit(0).alias("pos"))
    made = sessions.repair_ids(calls, 3)
    assert made.select("call_id").distinct().count() == 1200 and made.where("step = 1100").first().call_id == "repair_call_3_1100"


def test_faithful_facts_and_contradictions(spark):
    after = '{"key_facts": [{"text": "sold 1234 cars", "value": "1234", "provenance": "cars.csv", "entity": "e", "time": "t"}, {"text": "unseen words here", "provenance": "cars.csv"}, "seen words"], "tables": ["cars.csv"]}'
    row = spark.createDataFrame([(after, '{"key_facts": []}')], "a string, b string")
    seen = F.array(F.struct(F.lit("cars.csv says 1234 and Seen Words").alias("content"), F.lit(None).cast("string").alias("file")))
    none = F.array().cast("array<string>")
    held = row.select(F.explode(memory.facts(F.col("a"))).alias("f"), memory.facts(F.col("b")).alias("before"))
    assert [r[0] for r in held.select(memory.faithful(F.col("f"), F.col("before"), seen, none, none)).collect()] == [True, False, True, True]
    verified = F.array(F.struct(F.lit("i").alias("item"), F.lit("e").alias("entity"), F.lit("t").alias("time"), F.lit(None).cast("string").alias("metric"), F.lit("1000").alias("value"), none.alias("tables")))
    assert not row.select(memory.conflicts(memory.facts(F.col("a")), verified)).first()[0]
    assert row.select(memory.conflicts(F.slice(memory.facts(F.col("a")), 1, 1), verified)).first()[0]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("[1]",), ("{}",), ("{x",), ('{"a": 1}',)], "m string").select(memory.unparseable(F.col("m"))).collect()] == [True] * 5 + [False]


def test_boundaries_are_drawn_alike(spark):
    rows = spark.range(20000).withColumn("k", F.col("id") % 7)
    drawn = rows.where(reports.executes(0.25, 5, "id", "k")).count()
    assert abs(drawn - 5000) < 400 and drawn == rows.repartition(3).where(reports.executes(0.25, 5, "id", "k")).count()


def test_one_header_row_and_bad_ones(spark):
    cells = spark.createDataFrame([("s", r, c, t) for r, row in enumerate([["a", "b"], ["1", None]], 1) for c, t in enumerate(row, 1)], "sheet string, row_no int, col_no int, text string")
    assert [r.cells for r in grid.merged_rows(cells, 1).orderBy("row_no").collect()] == [["0", "1"], ["a", "b"], ["1", ""]]
    assert grid.header_issues(cells, 3).first().issue == "fewer rows than header rows" and grid.merged_rows(cells, 3).count() == 0 and grid.header_issues(cells, 0).first().issue


def test_contexts_paths_and_styles(spark):
    said = spark.createDataFrame([([("user", "hi", None), ("assistant", "", [("f", "{}")]), ("odd", None, None)],)], "m array<struct<role:string,content:string,calls:array<struct<name:string,arguments:string>>>>")
    show = lambda **k: said.select(checks.history_text(F.col("m"), **k)).first()[0]
    assert show() == "Conversation History:\nUser: hi\nAssistant: Call tool: f({})\nodd: "
    assert show(style="xml", most=1) == '<conversation_history>\n  <message role="odd"></message>\n</conversation_history>' and show(style="markdown", header=False, most=1) == "**odd**: \n"
    paths = {"/a/./b/../c": "/a/c", "../x": "../x", "/../x": "/x", "a//b/": "a/b", "../../x/../y": "../../y"}
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", checks.normal_path(F.col("p")).alias("n")).collect()}
    assert got == paths


def test_reports_and_schemas(spark):
    text = sinks.report("T", ("A", spark.createDataFrame([(1, 0.5, "x|y")], "a int, b double, c string")), ("B", spark.range(0)))
    assert "| 1 | 0.5000 | x\\|y |" in text and "## B" in text
    assert plugins.tool_schema("grep_search")["function"]["parameters"]["required"] == ["path", "pattern"]
    told = plugins.descriptions(spark.createDataFrame([("b", "general", "y"), ("a", "general", "x")], "name string, listed string, about string")).first()
    assert told.text == "- a: x\n- b: y" and re.match("general", told.listed)


def test_scans_of_folders(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    for name in ("a/x.CSV", "a/y.txt", "z.xlsx", "a/node_modules/w.csv"):
        (tmp_path / name).write_text("1")
    found = tables.scan_files(spark, str(tmp_path))
    assert sorted((r.name, r.extension, r.size) for r in found.collect()) == [("w.csv", "csv", 1), ("x.CSV", "csv", 1), ("z.xlsx", "xlsx", 1)]
    assert [r.name for r in tables.searchable(found, ("csv",)).collect()] == ["x.CSV"] and tables.searchable(found, name_pattern="^X").count() == 0


def test_json_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"b": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(map(str, (r.a for r in texts.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()))) == ["1", "None"]
    assert texts.json_lines(spark, str(tmp_path / "c.jsonl"), "a int").count() == 0
    assert sorted(r.a for r in texts.json_documents(spark, str(tmp_path / "b.json"), "a int").collect()) == [1, 2]


def test_empty_tables(spark):
    empty = lambda kind: spark.createDataFrame([], kind)
    assert gold.first_sample(empty("trace string, query string"), empty("pos int, task string")).count() == 0
    assert gold.find_anchors(empty("trace string, pos int, role string, content string"), empty("trace string, sq int, item string")).count() == 0
    assert reports.middle(empty("k int, v double"), "v", "k").count() == 0 and rewards.returns(empty("k int, t int, r double"), "k", ["t"], "r").count() == 0
    cells = empty("sheet string, row_no int, col_no int, text string")
    assert grid.parsed_rows(cells).count() == grid.merged_rows(cells, 2).count() == grid.flattened_rows(cells).count() == 0
    assert retrieval.row_blocks(empty("path string, line_no int, content string")).count() == 0
    assert curation.cleaned(empty(f"dialog string, sq int, steps {STEP}, final struct<answer:string,data_source:array<string>>")).count() == 0
    assert reports.run_summary(empty("success boolean, turns int, tokens int, success_rate double, parallelism double")).first().runs == 0
