"""Writers of JSON lines, model requests, tables by sheet, and a report of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def json_lines(df: DataFrame, to: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(to)


def requests(df: DataFrame, to: str, model: str, id_col: str = "custom_id", messages_col: str = "messages") -> None:
    """One request for a model a line, instead of a call."""
    body = F.struct(F.lit(model).alias("model"), F.col(messages_col).alias("messages"))
    df.select(F.to_json(F.struct(F.col(id_col).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body")))).write.mode("overwrite").text(to)


def tables_by_sheet(rows: DataFrame, to: str, sheet: str = "sheet") -> None:
    """CSV with one folder a sheet, named safely; a sheet's rows may stand in several files, so that large ones are written in parallel."""
    rows.withColumn(sheet, safe_name(F.col(sheet))).write.mode("overwrite").partitionBy(sheet).option("header", True).csv(to)


def with_header(df: DataFrame, names: list[str], to: str) -> None:
    df.toDF(*names).write.mode("overwrite").option("header", True).csv(to)


def call_text(calls: Column) -> Column:
    """Calls (array<struct<name, arguments>>) as tagged text for trainers that hold no structured calls."""
    each = lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), F.coalesce(c["arguments"], F.lit("{}")), F.lit("}\n</tool_call>"))
    return F.array_join(F.transform(calls, each), "\n")


def markdown(title: str, row: Row) -> str:
    """A report of one row of figures."""
    cells = [(k, f"{v:.4f}" if isinstance(v, float) else str(v)) for k, v in row.asDict().items()]
    return "\n".join([f"# {title}", "", "| Metric | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in cells], ""])


def report(title: str, *sections: tuple[str, DataFrame], most: int = 1000) -> str:
    """A report of a few small frames: a heading and a grid for each; a frame of more than `most` rows is refused."""
    out = [f"# {title}", ""]
    for heading, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{heading}: more than {most} rows")
        show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {heading}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}", *[f"| {' | '.join(map(show, r))} |" for r in rows], ""]
    return "\n".join(out)
