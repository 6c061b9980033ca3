"""Text files of any of some encodings, their chunks and previews, traces, and files found by name."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in the order tried; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "gbk", "gb2312", "gb18030", "utf-16", "latin-1")
#: Encodings of a preview in the order tried; none takes any bytes.
PREVIEWED = ("utf-8-sig", "utf-8", "gbk", "gb2312")
#: A trace as agents write it.
TRACE = "task string, response string, conversation_trace array<struct<messages: array<struct<role: string, content: string, tool_call_id: string, tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>>>>>"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if executors are threads of the driver."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='trailgrid-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def decoded(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """A file's text and encoding; a mark of byte order is dropped."""
    for name in encodings:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {encodings} reads this")


def preview_lines(raw: bytes, most: int = 100) -> list[str]:
    """The first lines of a small file for a model, trailing white space dropped; of fewer encodings than a full read tries."""
    return [line.rstrip() for line in decoded(raw, PREVIEWED)[0].split("\n")[:most]]


def text_lines(spark: SparkSession, folder: str, glob: str = "*.{csv,tsv,txt}") -> DataFrame:
    """(path, encoding, line_no, content) of the files below a folder. A file is read by one task; files are small tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                text, encoding = decoded(bytes(raw))
                # Lines end as in the line view of text columns: at line feeds, not at form feeds or other separators.
                rows = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []
                yield pd.DataFrame({"path": path, "encoding": encoding, "line_no": range(1, len(rows) + 1), "content": rows})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, encoding string, line_no long, content string")


def chunks(lines: DataFrame, size: int = 200, *keys: str) -> DataFrame:
    """(keys, chunk_no from 0, n, content): lines in chunks of `size`, joined by line feeds."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "content")))
    return lines.groupBy(*keys, F.floor((F.col("line_no") - 1) / size).alias("chunk_no")).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["content"]), "\n").alias("content"))


def within_budget(lines: DataFrame, budget: int, key: str) -> DataFrame:
    """Lines from the first on whose characters, a line feed each, stay within the budget of their text."""
    spent = F.sum(F.char_length("content") + 1).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("spent", spent).where(F.col("spent") <= budget).drop("spent")


def find_by_name(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (name, hint) with the best path of files (path, name): one that holds the hint before others, then the first by path."""
    fits = wanted.join(files, "name", "left").withColumn("other", F.coalesce(~F.contains("path", "hint"), F.lit(True)))
    return fits.groupBy("name", "hint").agg(F.min(F.when(F.col("path").isNotNull(), F.struct("other", "path")))["path"].alias("path"))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """(trace, pos, role, content, calls) of the last conversation of each trace file, the response as its last message."""
    read = spark.read.schema(TRACE).option("multiLine", True).option("pathGlobFilter", "trace_*.json").json(folder).withColumn("trace", F.col("_metadata.file_name"))
    messages = F.coalesce(F.try_element_at("conversation_trace", F.lit(-1))["messages"], F.from_json(F.lit("[]"), "array<struct<role: string, content: string, tool_call_id: string, tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>>>"))
    rows = read.select("trace", "response", F.size(messages).alias("n"), F.posexplode_outer(messages).alias("pos", "m"))
    calls = F.transform("m.tool_calls", lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    said = rows.where("pos is not null").select("trace", "pos", "m.role", "m.content", calls.alias("calls"))
    last = rows.where("coalesce(pos, 0) = 0 and response != ''").select("trace", F.greatest(F.col("n"), F.lit(0)).alias("pos"), F.lit("assistant").alias("role"), F.col("response").alias("content"), F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("calls"))
    return said.unionByName(last)


def unseen(samples: DataFrame, done: DataFrame, key: str = "task") -> DataFrame:
    """Samples whose key has no finished run; of equal keys the first by position stays."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return samples.join(done.select(key).distinct(), key, "left_anti").withColumn("rn", first).where("rn = 1").drop("rn")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file or folder of JSON lines in a given schema; what isn't there is empty, and a line that is no JSON has no row."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON object, or an array of them, each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
