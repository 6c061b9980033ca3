"""Repair of irregular grids held as (row_no, col_no, text) cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_junk, number


def drop_junk(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Without leading all-junk rows, then without all-junk columns."""
    real = ~is_junk(F.col("text"))
    first = cells.where(real).groupBy(sheet).agg(F.min("row_no").alias("first_row"))
    rows = cells.join(first, sheet).where("row_no >= first_row").drop("first_row")
    return rows.join(rows.where(real).select(sheet, "col_no").distinct(), [sheet, "col_no"], "left_semi")


def merge_header(cells: DataFrame, header_rows: int | Column, sheet: str = "sheet") -> DataFrame:
    """(sheet, col_no, name): levels of the first rows joined by '-'. An empty cell takes the value above
    without adding a level, or else the nearest resolved value to its left."""
    own = F.when(~is_junk(F.col("text")), F.trim("text"))
    down = Window.partitionBy(sheet, "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    left = Window.partitionBy(sheet, "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    head = cells.where(F.col("row_no") <= header_rows).withColumn("own", own)
    head = head.withColumn("base", F.last("own", ignorenulls=True).over(down)).withColumn("beside", F.last("base", ignorenulls=True).over(left))
    level = F.coalesce("own", F.when(F.col("base").isNull(), F.col("beside")))
    levels = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "level"))), lambda x: x["level"])
    return head.withColumn("level", level).groupBy(sheet, "col_no").agg(F.array_join(F.array_distinct(levels), "-").alias("name"))


def flatten_groups(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Group rows, whose cells are all equal, become a column `grp` carried down to the rows below them."""
    per_row = cells.groupBy(sheet, "row_no").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy(sheet).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = per_row.withColumn("mark", F.when((F.col("a") == F.col("b")) & (F.col("n") > 1), F.col("a"))).withColumn("grp", F.last("mark", ignorenulls=True).over(order))
    return cells.join(marked.where("mark is null").select(sheet, "row_no", "grp"), [sheet, "row_no"])


def rows_of(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, row_no, cells array): each row's texts by column, '' where a cell is missing."""
    rows = cells.groupBy(sheet, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("text")))).alias("m"), F.min("col_no").alias("lo"), F.max("col_no").alias("hi"))
    width = rows.groupBy(sheet).agg(F.min("lo").alias("first"), F.max("hi").alias("width"))
    return rows.join(width, sheet).select(sheet, "row_no", F.transform(F.sequence("first", "width"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("cells"))


def header_issues(cells: DataFrame, header_rows: int | Column, sheet: str = "sheet") -> DataFrame:
    """(sheet, issue): null where the first header_rows rows can be merged."""
    height = F.lit(header_rows) if isinstance(header_rows, int) else F.max(header_rows)
    issue = F.when(height < 1, "header rows must be 1 at least").when(F.max("row_no") - F.min("row_no") + 1 < height, "fewer rows than header rows")
    return cells.groupBy(sheet).agg(issue.alias("issue"))


def merged_rows(cells: DataFrame, header_rows: int | Column, sheet: str = "sheet") -> DataFrame:
    """(sheet, row_no, cells): the merged header as row 0, then the rows below it, numbered from 1; sheets with issues have none.

    header_rows may be a column of cells, the same for all cells of a sheet. With one header row nothing is merged, and a
    line of column numbers from 0 stands before all rows, as the reference writes it.
    """
    height = F.lit(header_rows) if isinstance(header_rows, int) else header_rows
    given = cells.withColumn("_h", height)
    enough = F.max("row_no") - F.min("row_no") + 1 >= F.max("_h")
    heights = given.groupBy(sheet).agg(F.max("_h").alias("_h"), F.min("col_no").alias("a"), F.max("col_no").alias("b"), enough.alias("fine")).where("fine and _h >= 1").drop("fine")
    rows = rows_of(cells, sheet).join(heights.select(sheet, "_h"), sheet)
    names = merge_header(cells.join(heights.where("_h > 1").select(sheet, "_h"), sheet), F.col("_h"), sheet).select(sheet, "col_no", F.col("name").alias("text"), F.lit(0).alias("row_no"))
    numbers = heights.where("_h = 1").select(sheet, F.explode(F.sequence("a", "b")).alias("col_no"), "a")
    numbers = numbers.select(sheet, "col_no", (F.col("col_no") - F.col("a")).cast("string").alias("text"), F.lit(0).alias("row_no"))
    above = F.when(F.col("_h") == 1, 0).otherwise(F.col("_h"))
    body = rows.where(F.col("row_no") > above).select(sheet, (F.col("row_no") - above).cast("long").alias("row_no"), "cells")
    return rows_of(names.unionByName(numbers), sheet).withColumn("row_no", F.col("row_no").cast("long")).unionByName(body)


def classify(cells: DataFrame, look: int = 100, sheet: str = "sheet") -> DataFrame:
    """(sheet, kind, header_rows) by rule, in place of a model: A if a row below the first holds one text in all its (two or more) cells, else B; header_rows counts the rows before the first with numbers in half of its cells (1 at least)."""
    seen = cells.where((F.col("row_no") <= look) & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    per = seen.groupBy(sheet, "row_no").agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b"), F.count_if(number(F.col("text")).isNotNull()).alias("numbers"))
    group = (F.col("row_no") > 1) & (F.col("n") > 1) & (F.col("a") == F.col("b")) & (F.col("numbers") == 0)
    found = per.groupBy(sheet).agg(F.coalesce(F.max(group), F.lit(False)).alias("grouped"), F.min(F.when(F.col("numbers") * 2 >= F.col("n"), F.col("row_no"))).alias("data"))
    return found.select(sheet, F.when(F.col("grouped"), "A").otherwise("B").alias("kind"), F.greatest(F.coalesce(F.col("data") - 1, F.lit(1)), F.lit(1)).cast("int").alias("header_rows"))


def flattened_rows(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, row_no, cells): rows of a grouped sheet with their group in front, the header's `group`; each as wide as the header."""
    flat = flatten_groups(cells, sheet)
    rows = rows_of(flat.drop("grp"), sheet).join(flat.select(sheet, "row_no", "grp").distinct(), [sheet, "row_no"])
    head = rows.groupBy(sheet).agg(F.min("row_no").alias("top"))
    fitted = F.concat(F.array(F.when(F.col("row_no") == F.col("top"), "group").otherwise(F.coalesce("grp", F.lit("")))), "cells")
    wide = rows.join(head, sheet).select(sheet, "row_no", fitted.alias("cells"))
    return wide


def parsed_rows(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, kind, row_no, cells): each sheet flattened or with its header merged, by what it is; there may be any number of sheets."""
    told = cells.join(classify(cells, sheet=sheet).select(sheet, "kind", "header_rows"), sheet)
    flat = flattened_rows(told.where("kind = 'A'").drop("kind", "header_rows"), sheet).select(sheet, F.lit("A").alias("kind"), F.col("row_no").cast("long").alias("row_no"), "cells")
    merged = merged_rows(told.where("kind = 'B'").drop("kind"), F.col("header_rows"), sheet)
    return flat.unionByName(merged.select(sheet, F.lit("B").alias("kind"), "row_no", "cells"))


def repeated_to_rows(df: DataFrame, fixed: list[str], groups: list[list[str]], names: list[str]) -> DataFrame:
    """Fixed columns with one row for each repeated group of columns: (fixed, group from 1, names)."""
    each = F.array(*[F.struct(F.lit(i).alias("group"), *[F.col(c).cast("string").alias(n) for c, n in zip(g, names, strict=True)]) for i, g in enumerate(groups, 1)])
    return df.select(*fixed, F.explode(each).alias("x")).select(*fixed, "x.*")


def description(path: Column, about: Column, columns: Column) -> Column:
    """A file's path, description and columns (array<struct<name, type, about>>) as text; parts that are null are left out."""
    said = F.transform(columns, lambda c: F.concat(F.lit("  - "), F.coalesce(c["name"], F.lit("Unknown")), F.lit(" ("), F.coalesce(c["type"], F.lit("")), F.lit("): "), F.coalesce(c["about"], F.lit(""))))
    listed = F.when(columns.isNotNull(), F.array_join(F.concat(F.array(F.lit("Column information:")), said), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("File path: "), path), F.concat(F.lit("Table description: "), about), listed)
