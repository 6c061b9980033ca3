"""Queries of workbooks, folders and recorded code over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.code import presentation
from ..sinks.workbooks import workbooks
from ..sources.tables import folder_totals, read
from ..sources.workbooks import workbook_cells, workbook_lines
from .registry import query


def _books(s, d):
    """Customers: a workbook a market segment, a sheet a nation."""
    c = read(s, d, "customer")
    cells = F.array(F.col("c_custkey").cast("string"), "c_name", F.format_string("a \"%d\", b", F.col("c_custkey") % 7))
    return workbooks(c.select(F.concat(F.lit("x/"), F.coalesce("c_mktsegment", F.lit("none")), F.lit(".xlsx")).alias("path"), F.concat(F.lit("n & "), F.col("c_nationkey").cast("string")).alias("sheet"), F.col("c_custkey").alias("row_no"), cells.alias("cells")))


@query("workbook_cells", """with c as (select 'x/' || coalesce(c_mktsegment, 'none') || '.xlsx' as path, 'n & ' || c_nationkey as sheet, c_custkey, c_name from customer), r as (select *, row_number() over (partition by path, sheet order by c_custkey) as row_no from c)
 select path, sheet, row_no, unnest([1, 2, 3]) as col_no, unnest([c_custkey::varchar, c_name, 'a "' || c_custkey % 7 || '", b']) as value from r""")
def cells(s, d):
    return workbook_cells(_books(s, d))


@query("workbook_lines", """with c as (select coalesce(c_mktsegment, 'none') || '.xlsx::n & ' || c_nationkey as "table", c_custkey, c_name from customer)
 select "table", row_number() over (partition by "table" order by c_custkey) as line_no, c_custkey || ',' || c_name || ',"a ""' || c_custkey % 7 || '"", b"' as content from c""")
def sheet_lines(s, d):
    return workbook_lines(_books(s, d)).drop("path")


@query("folder_totals", """with f as (select string_split(regexp_extract(url, '://(.*)$', 1), '/') as p, length(url) as size from pages where url like '%://%'), n as (select size, len(p) - 1 as depth, p, unnest(range(0, len(p))) as k from f)
 select case k when 0 then '.' else array_to_string(p[1:k], '/') end as folder, k as depth, count(*) as files, sum(size) as size, count(*) filter (where k = depth) as direct from n group by 1, 2""")
def folders(s, d):
    """Addresses of pages stand for paths."""
    return folder_totals(read(s, d, "pages").where("url like '%://%'").select(F.col("url").alias("path"), F.length("url").alias("size")), "://")


@query("presented_code", """select o_orderkey, o_orderkey % 4 < 2 as only_presents, case o_orderkey % 4 when 0 then o_orderkey::varchar when 1 then 'n ' || o_orderkey end as answer from orders""")
def presented_code(s, d):
    k = F.col("o_orderkey").cast("string")
    forms = F.array(
        F.concat(F.lit('import json\nx = "'), k, F.lit('"\nr = {"answer": x, "data_source": ["t"]}\nprint(json.dumps(r))')), F.concat(F.lit("import json\nn = "), k, F.lit('\nprint(json.dumps({"answer": f"n {n}"}))')),
        F.concat(F.lit("import json\nx = 1 + "), k, F.lit('\nprint(json.dumps({"answer": x}))')), F.concat(F.lit("print("), k, F.lit(")")),
    )
    made = read(s, d, "orders").select("o_orderkey", presentation(F.get(forms, (F.col("o_orderkey") % 4).cast("int"))).alias("p"))
    return made.select("o_orderkey", "p.only_presents", F.get_json_object("p.answer", "$.answer").alias("answer"))
