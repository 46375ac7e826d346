"""Queries over tables in documents.  Each brand's parts are a table; each customer's orders are a document's elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.operators import tables as T
from sedgewood.plans.registry import query, table

_CELLS_SQL = "['key', 'name', '', 'size']"
_ROWS = """rows AS (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS i,
    [CAST(p_partkey AS VARCHAR), replace(p_name, ' ', chr(10)), ' ', CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END] AS cells FROM part)"""
_LINE = "'| ' || array_to_string(list_transform(cells, lambda c: replace(coalesce(c, ''), chr(10), ' ')), ' | ') || ' |' || chr(10)"


def brand_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_brand, header, rows, colors: a header row in colour and a row for each part, with a blank column."""
    cells = F.array(F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit(" "), F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")))
    body = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    header = F.array(F.array(F.lit("key"), F.lit("name"), F.lit(""), F.lit("size")))
    return body.select("p_brand", header.alias("header"), "rows", F.concat(header, "rows").alias("cells"), F.concat(F.array(F.lit("grey")), F.transform("rows", lambda _: F.lit(None).cast("string"))).alias("colors"))


_BODY = f"""SELECT p_brand, string_agg({_LINE}, '' ORDER BY i) AS body FROM rows GROUP BY p_brand"""


@query(f"WITH {_ROWS}, b AS ({_BODY}) SELECT p_brand, '| key | name |  | size |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || body AS markdown FROM b")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown, the first row as header."""
    return brand_tables(spark, sf_dir).select("p_brand", T.markdown(F.col("cells")).alias("markdown"))


@query(f"""WITH {_ROWS}, b AS (SELECT p_brand, string_agg({_LINE} || CASE WHEN i = 2 THEN '| --- | --- | --- | --- |' || chr(10) ELSE '' END, '' ORDER BY i) AS body FROM rows GROUP BY p_brand)
SELECT p_brand, '| key | name |  | size |' || chr(10) || body AS markdown FROM b""")
def table_markdown_colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the first three rows share the header's colour."""
    colors = F.transform("cells", lambda _, i: F.when(i < 3, F.lit("grey")))
    return brand_tables(spark, sf_dir).select("p_brand", T.markdown(F.col("cells"), T.header_rows(colors)).alias("markdown"))


@query(f"WITH {_ROWS}, b AS (SELECT p_brand, string_agg('| ' || array_to_string(list_transform([cells[1], cells[2], cells[4]], lambda c: replace(coalesce(c, ''), chr(10), ' ')), ' | ') || ' |' || chr(10), '' ORDER BY i) AS body FROM rows GROUP BY p_brand) SELECT p_brand, '| key | name | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS markdown FROM b")
def table_drop_blank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without their blank column."""
    return brand_tables(spark, sf_dir).select("p_brand", T.markdown(T.drop_blank_columns(F.col("cells"))).alias("markdown"))


@query("SELECT p_brand, CAST(greatest(1, least(count(*), ascii(right(p_brand, 1)) % 4)) AS INTEGER) AS n_header FROM part GROUP BY p_brand")
def table_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading rows of the header's colour: as many as the brand's name says, or no colour; a later row of that colour is none."""
    colors = F.expr("transform(cells, (x, i) -> case when i < ascii(right(p_brand, 1)) % 4 then 'grey' when i = ascii(right(p_brand, 1)) % 4 then if(i = 0, null, 'white') when i % 2 = 0 then 'grey' end)")
    return brand_tables(spark, sf_dir).select("p_brand", T.header_rows(colors).alias("n_header"))


_BOX = "SELECT l_orderkey AS page, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS box_id, CAST(l_linenumber * 10 AS DOUBLE) AS x0, CAST(l_linenumber * 5 AS DOUBLE) AS top, l_linenumber * 10 + l_quantity AS x1, l_linenumber * 5 + l_quantity AS bottom FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line of an order, of a size from its quantity."""
    n = F.col("l_linenumber")
    shape = (n * 10.0).alias("x0"), (n * 5.0).alias("top"), (n * 10 + F.col("l_quantity")).alias("x1"), (n * 5 + F.col("l_quantity")).alias("bottom")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), *shape)


@query(f"""WITH b AS (SELECT DISTINCT page, x0, top, x1, bottom FROM ({_BOX}))
SELECT * FROM b AS a WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.page = a.page AND o.x0 - 1 <= a.x0 AND o.top - 1 <= a.top AND o.x1 + 1 >= a.x1 AND o.bottom + 1 >= a.bottom
AND (o.x1 - o.x0) * (o.bottom - o.top) > (a.x1 - a.x0) * (a.bottom - a.top))""")
def table_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no larger box of their page contains."""
    return T.outermost(boxes(spark, sf_dir).distinct(), ["page"])


@query(f"""WITH b AS (SELECT DISTINCT page, top, bottom FROM ({_BOX})), g AS (SELECT *, row_number() OVER w AS position,
coalesce(max(bottom) OVER (PARTITION BY page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM b WINDOW w AS (PARTITION BY page ORDER BY top, bottom))
SELECT *, top > reached + 1 AS text_before FROM g""")
def table_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where text stands between the tables of a page."""
    return T.reading_gaps(boxes(spark, sf_dir).select("page", "top", "bottom").distinct(), ["page"])


_RECT = "SELECT o_orderkey AS page, CAST(o_custkey % 50 AS DOUBLE) AS top, CAST(o_custkey % 50 + 20 AS DOUBLE) AS bottom, 0.0::DOUBLE AS x0, 40.0::DOUBLE AS x1, o_orderpriority AS color, o_custkey AS ordinal FROM orders"


@query(f"""WITH r AS (SELECT DISTINCT page, x0, top, x1, bottom, x0 * 1000 + bottom AS row_id FROM ({_BOX})), c AS ({_RECT}),
h AS (SELECT r.page, r.row_id, color, ordinal, greatest(0, least(r.bottom, c.bottom) - greatest(r.top, c.top)) / (r.bottom - r.top) AS o FROM r JOIN c ON r.page = c.page AND c.x0 < r.x1 AND c.x1 > r.x0)
SELECT r.page, r.row_id, r.top, r.bottom, b.background FROM r LEFT JOIN (SELECT page, row_id, arg_max(color, o) AS background FROM h WHERE o > 0.5 GROUP BY page, row_id) AS b ON r.page = b.page AND r.row_id = b.row_id""")
def table_row_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour behind a row: that of the rectangle over most of its height."""
    rows = boxes(spark, sf_dir).distinct().withColumn("row_id", F.col("x0") * 1000 + F.col("bottom"))
    top = (F.col("o_custkey") % 50).cast("double")
    rects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), top.alias("top"), (top + 20).alias("bottom"), F.lit(0.0).alias("x0"), F.lit(40.0).alias("x1"), F.col("o_orderpriority").alias("color"), F.col("o_custkey").alias("ordinal"))
    return T.row_background(rows, rects, ["page"]).select("page", "row_id", "top", "bottom", "background")


_ELEMENTS = """e AS (SELECT o_custkey AS doc, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderstatus <> 'P' AS is_table, CAST(2 + o_orderkey % 2 AS INTEGER) AS width,
CASE WHEN o_orderpriority < '3' THEN 'grey' END AS first_color, CASE WHEN o_orderpriority < '4' THEN 'grey' END AS last_color FROM orders)"""


@query(f"""WITH RECURSIVE {_ELEMENTS}, f AS (SELECT doc, seq, i, is_table, width, last_color, 0 AS run FROM e WHERE i = 1 UNION ALL
SELECT e.doc, e.seq, e.i, e.is_table, CASE WHEN g THEN f.width ELSE e.width END, e.last_color, CASE WHEN g THEN run ELSE run + 1 END FROM f JOIN (SELECT * FROM e) AS e ON e.doc = f.doc AND e.i = f.i + 1,
LATERAL (SELECT f.is_table AND e.is_table AND (e.first_color IS NULL OR (f.last_color IS NOT NULL AND e.first_color IS NOT NULL AND f.width = e.width)) AS g))
SELECT doc, seq, CAST(run AS BIGINT) AS run FROM f""")
def table_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on across elements."""
    grey = F.lit("grey")
    e = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "P").alias("is_table"), (2 + F.col("o_orderkey") % 2).cast("int").alias("width"),
        F.when(F.col("o_orderpriority") < "3", grey).alias("first_color"), F.when(F.col("o_orderpriority") < "4", grey).alias("last_color"),
    )
    return T.merge_runs(e, "doc")


_TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))"


@query(f"""WITH RECURSIVE {_ROWS}, h AS (SELECT {_TOKENS.format("'| key | name |  | size |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)")} AS head),
c AS (SELECT p_brand, i, {_TOKENS.format(_LINE)} AS cost FROM rows),
f AS (SELECT p_brand, i, cost AS used, 0 AS part FROM c WHERE i = 1 UNION ALL
SELECT c.p_brand, c.i, CASE WHEN used + cost + head > 256 THEN cost ELSE used + cost END, CASE WHEN used + cost + head > 256 THEN part + 1 ELSE part END FROM f JOIN c ON c.p_brand = f.p_brand AND c.i = f.i + 1, h)
SELECT p_brand, CAST(part AS BIGINT) AS part, min(i) - 1 AS first_row, count(*) AS n_rows FROM f GROUP BY p_brand, part""")
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tables under a token budget."""
    return T.split_parts(brand_tables(spark, sf_dir), ["p_brand"], budget=256)
