"""What others add to the engine: tools with their parameters, metrics as Column builders, functions for SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Groups of tools; a tool of another group is listed under the last.
CATEGORIES = ("location", "understanding", "retrieval", "reasoning", "general")
TOOLS: dict[str, dict] = {}
METRICS: dict[str, Callable[..., Column]] = {}


def tool(name: str, about: str, category: str = "general", **parameters: dict):
    """Registers a tool: its parameters are {name: {"type", "description", "required"}}."""
    TOOLS[name] = {"name": name, "about": about, "category": category, "parameters": parameters}


def metric(name: str):
    """Registers a builder of an aggregate under a name."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        METRICS[name] = f
        return f

    return put


def tool_schema(name: str) -> dict:
    """A tool as models are told of it."""
    t = TOOLS[name]
    told = {k: {"type": p.get("type", "string"), "description": p.get("description", "")} for k, p in t["parameters"].items()}
    return {"type": "function", "function": {"name": name, "description": t["about"], "parameters": {"type": "object", "properties": told, "required": [k for k, p in t["parameters"].items() if p.get("required")]}}}


def registry(spark: SparkSession) -> DataFrame:
    """(name, category, listed, required array, schema JSON) of all tools; `listed` is the group that a tool is shown in."""
    rows = [(t["name"], t["category"], t["category"] if t["category"] in CATEGORIES else CATEGORIES[-1], [k for k, p in t["parameters"].items() if p.get("required")], json.dumps(tool_schema(t["name"]), ensure_ascii=False)) for t in TOOLS.values()]
    return spark.createDataFrame(rows, "name string, category string, listed string, required array<string>, schema string")


def descriptions(tools: DataFrame) -> DataFrame:
    """(listed, text): tools (name, listed, about) by group, one line each, by name."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), "name", F.lit(": "), "about")))
    return tools.groupBy("listed").agg(F.array_join(lines, "\n").alias("text"))


def missing_parameters(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (…, tool, arguments JSON) with `missing`, the required parameters that they lack; null for an unknown tool. The registry is small."""
    given = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    known = tools.select(F.col("name").alias("tool"), "required")
    return calls.join(F.broadcast(known.limit(10_000)), "tool", "left").withColumn("missing", F.when(F.col("required").isNotNull(), F.array_except("required", given))).drop("required")


def evaluate(df: DataFrame, names: list[str], *keys: str, **columns: str) -> DataFrame:
    """(keys, a column each) of registered metrics over df."""
    return df.groupBy(*keys).agg(*[METRICS[n](**columns).alias(n) for n in names])


@metric("coverage")
def _coverage(coverage: str = "coverage", **_) -> Column:
    return F.round(F.avg(F.coalesce(F.col(coverage).cast("double"), F.lit(0.0))), 6)


@metric("passed")
def _passed(coverage: str = "coverage", **_) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(F.col(coverage) >= 1, F.lit(False))), F.lit(False))


@metric("steps")
def _steps(**_) -> Column:
    return F.count("*")


@udtf(returnType="line_no bigint, content string")
class MatchingLines:
    """The lines of a text that hold a pattern, for use in SQL: `lateral matching_lines(text, pattern)`."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[int, str]]:
        import re

        if text is not None and pattern is not None:
            found = re.compile(pattern, re.IGNORECASE)
            for no, line in enumerate(text.split("\n"), 1):
                if found.search(line):
                    yield no, line


def register(spark: SparkSession) -> None:
    """Makes the engine's functions known to SQL."""
    spark.udtf.register("matching_lines", MatchingLines)


tool("table_selector", "files whose content a question asks for", "semantic_search", query={"type": "string", "required": True}, folder_path={"type": "string", "required": True}, top_k={"type": "integer"})
tool("semantic_row_retriever", "rows nearest to a question", "retrieval", path={"type": "string", "required": True}, query={"type": "string", "required": True}, top_k={"type": "integer"})
tool("semantic_column_retriever", "columns nearest to a question", "retrieval", path={"type": "string", "required": True}, query={"type": "string", "required": True}, top_k={"type": "integer"})
tool("grep_search", "lines that hold a pattern", "exact_search", path={"type": "string", "required": True}, pattern={"type": "string", "required": True}, context_lines={"type": "integer"})
tool("table_head_reader", "the first lines of a file", "table_process", file_path={"type": "string", "required": True}, start={"type": "integer"}, n={"type": "integer"})
tool("header_merger", "header rows merged into one", "table_process", csv_path={"type": "string", "required": True}, header_rows={"type": "integer", "required": True})
tool("complex_table_parser_v2", "irregular grids made regular", "table_process", csv_path={"type": "string", "required": True})
tool("xlsx_to_csv_converter", "sheets as CSV", "table_process", xlsx_path={"type": "string", "required": True})
