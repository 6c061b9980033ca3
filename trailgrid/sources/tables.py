"""Tables and the line view of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that no search enters.
SKIPPED = ("__pycache__", ".git", "node_modules", ".venv")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer (a small file of one row group); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, keep..., line_no from 1, content): physical lines of each text; a null text has none."""
    return documents.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "content")).select(id_col, *keep, (F.col("pos") + 1).alias("line_no"), "content")


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("csv", "xlsx", "xls", "tsv")) -> DataFrame:
    """(path, name, extension, size) of files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return named.where(F.col("extension").isin(*extensions)).select("path", "name", "extension", "size")


def folder_totals(files: DataFrame, root: str) -> DataFrame:
    """(folder, depth, files, size, direct): files at or below each folder of (path, size), and those right in it; the root is `.`, depth 0."""
    inner = F.regexp_replace(F.substr("path", F.instr("path", root) + len(root)), "^/+", "")
    parts = F.split(inner, "/")
    depth = F.size(parts) - 1
    names = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(F.when(k == 0, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("folder"), k.alias("depth"), (k == depth).cast("int").alias("direct")))
    below = files.where(F.contains("path", F.lit(root))).select("size", F.explode(names).alias("n"))
    return below.groupBy("n.folder", "n.depth").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("n.direct").alias("direct"))


def searchable(files: DataFrame, extensions: tuple[str, ...] = ("csv", "xlsx", "xls", "tsv", "txt", "py"), name_pattern: str | None = None) -> DataFrame:
    """files (path, ...) of the extensions, outside skipped folders, whose names a pattern (case counts) finds."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    return kept.where(name.rlike(name_pattern)) if name_pattern else kept


def preview_texts(lines: DataFrame, key: str = "path", start: int = 1, n: int = 5) -> DataFrame:
    """(key, text): the first n lines of each file numbered from `start`, under its name, lines in all, and lines not shown."""
    shown = F.array_sort(F.collect_list(F.when(F.col("line_no") <= n, F.struct("line_no", F.rtrim("content").alias("content")))))
    per = lines.groupBy(key).agg(F.count("*").alias("n"), shown.alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.format_string("%3d| %s", x["line_no"].cast("long") + (start - 1), x["content"])), "\n")
    name = F.regexp_extract(F.col(key).cast("string"), r"[^/]*$", 0)
    return per.select(key, F.concat(F.lit("["), name, F.lit("] Total rows: "), F.col("n").cast("string"), F.lit(", remaining rows not shown: "), (F.col("n") - F.size("s")).cast("string"), F.lit("\n" + "─" * 40 + "\n"), body).alias("text"))


def matches_page(hits: DataFrame, start: int, most: int, *order: str) -> DataFrame:
    """hits from number `start` (from 0) on in an order, at most `most`: those before are counted in a sort that keeps start + most rows a task."""
    first = hits.orderBy(*order).limit(start + most)
    return first.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") > start).drop("_n")  # start + most rows


def sheet_previews(lines: DataFrame, most: int = 3, *keys: str) -> DataFrame:
    """(keys, head array, total_rows) of each sheet: its first lines, and its lines but the header."""
    first = F.array_sort(F.collect_list(F.when(F.col("line_no") <= most, F.struct("line_no", "content"))))
    return lines.groupBy(*keys).agg(F.transform(first, lambda x: x["content"]).alias("head"), F.greatest(F.count("*") - 1, F.lit(0)).alias("total_rows"))


def merged_context(lines: DataFrame, hit: str, k: int = 2, key: str = "path") -> DataFrame:
    """(key, line_no, content, is_match): lines within k of a hit, each once; before a gap a line 0 with '...', placed by `after`, the line that follows it."""
    order = Window.partitionBy(key).orderBy("line_no")
    near = lines.withColumn("near", F.max(F.col(hit).cast("int")).over(order.rowsBetween(-k, k))).where("near = 1")
    gap = near.withColumn("gap", F.col("line_no") > F.lag("line_no").over(order) + 1)
    real = gap.select(key, F.col("line_no").alias("after"), F.lit(1).alias("part"), F.col("line_no").cast("long").alias("line_no"), "content", F.col(hit).alias("is_match"))
    marks = gap.where("gap").select(key, F.col("line_no").alias("after"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("line_no"), F.lit("...").alias("content"), F.lit(False).alias("is_match"))
    return real.unionByName(marks)


def folder_tree(files: DataFrame, most: int = 10) -> str:
    """A drawing of a folder (relative paths): folders first, then files by name; the top level up to `most` entries, then the first folder of each level while entries are left.

    Only what is drawn, and counts of the rest, come to the driver: at most `most` entries a level.
    """
    parts = files.select(F.split("path", "/").alias("p"))
    total, shown, left = files.count(), 0, most
    drawn: list[tuple[int, list[tuple[str, bool]], int]] = []
    base: list[str] = []
    while True:
        depth = len(base)
        inside = parts.where((F.size("p") > depth) & (F.slice("p", 1, depth) == F.array(*map(F.lit, base)).cast("array<string>"))) if depth else parts
        level = inside.groupBy(F.get("p", F.lit(depth)).alias("name"), (F.size("p") > depth + 1).alias("folder")).agg(F.count("*").alias("n"))
        count = level.count()
        here = [(r["name"], r["folder"]) for r in level.orderBy(F.desc("folder"), "name").limit(left).collect()]
        left -= len(here)
        shown += sum(not f for _, f in here)
        drawn.append((depth, here, count))
        folder = next((n for n, f in here if f), None)
        if folder is None or left <= 0 or count > len(here):
            break
        base.append(folder)
    out: list[str] = []

    def draw(k: int, prefix: str) -> None:
        _, entries, count = drawn[k]
        more, opened = count - len(entries), False
        for i, (name, is_folder) in enumerate(entries):
            last = i == len(entries) - 1 and not more
            out.append(f"{prefix}{'└── ' if last else '├── '}{'📁 ' if is_folder else '📄 '}{name}{'/' if is_folder else ''}")
            if is_folder:
                below = prefix + ("    " if last else "│   ")
                if not opened and k + 1 < len(drawn) and drawn[k + 1][1]:
                    draw(k + 1, below)
                else:
                    out.append(f"{below}└── ...")
                opened = True
        if more:
            out.append(f"{prefix}└── ... ({more} files omitted)")

    if total:
        draw(0, "")
    if shown < total:
        out.append(f"... ({total - shown} more files not shown)")
    return "\n".join(out)
