"""Tables in documents: Markdown, header rows, merging across pages, and parts under a token budget.

A table is a column of rows of cells, ``array<array<string>>``; row colours are strings, null where a row has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgewood.functions.text import count_tokens


def markdown_row(row: Column) -> Column:
    cells = F.transform(row, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))


def header_rows(colors: Column) -> Column:
    """How many rows from the top share the first row's colour; 1 where there is none."""
    first = F.get(colors, F.lit(0))
    run = F.aggregate(colors, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, c: F.struct((a["n"] + F.when(a["on"] & c.eqNullSafe(first), 1).otherwise(0)).alias("n"), (a["on"] & c.eqNullSafe(first)).alias("on")))["n"]
    return F.when(first.isNull(), F.lit(1)).otherwise(run).cast("int")


def markdown(rows: Column, headers: Column | int = 1) -> Column:
    """A table as Markdown; the separator follows the header rows and has the first row's width."""
    n = F.lit(headers) if isinstance(headers, int) else headers
    line = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(rows, F.lit(0)))), " | "), F.lit(" |\n"))
    text = F.array_join(F.transform(F.slice(rows, F.lit(1), n), markdown_row), "")
    rest = F.array_join(F.transform(F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0))), markdown_row), "")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(F.concat(text, line, rest))


def drop_blank_columns(rows: Column) -> Column:
    """The table without columns that are null or blank in every row."""
    width = F.size(F.get(rows, F.lit(0)))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: F.exists(rows, lambda r: F.coalesce(F.trim(F.get(r, i)), F.lit("")) != ""))
    # bound once a table: a lambda that names ``kept`` itself would search all rows again for each row
    bound = F.array(F.struct(rows.alias("rows"), kept.alias("kept")))
    return F.get(F.transform(bound, lambda t: F.transform(t["rows"], lambda r: F.transform(t["kept"], lambda i: F.get(r, i)))), F.lit(0))


def outermost(boxes: DataFrame, page: list[str], tolerance: float = 1.0) -> DataFrame:
    """Boxes(page.., box_id, x0, top, x1, bottom) that no strictly larger box of their page contains."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    a, b = boxes.withColumn("area", area).alias("a"), boxes.withColumn("area", area).alias("b")
    t = F.lit(tolerance)
    inside = (F.col("b.x0") - t <= F.col("a.x0")) & (F.col("b.top") - t <= F.col("a.top")) & (F.col("b.x1") + t >= F.col("a.x1")) & (F.col("b.bottom") + t >= F.col("a.bottom"))
    same = F.lit(True)
    for c in page:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, same & inside & (F.col("b.area") > F.col("a.area")), "left_anti").drop("area")


def reading_gaps(tables: DataFrame, page: list[str]) -> DataFrame:
    """tables(page.., top, bottom, ..) in reading order with ``reached``, how far the page was read before, and ``text_before``."""
    w = Window.partitionBy(*page).orderBy("top", "bottom")
    reached = F.coalesce(F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return tables.withColumn("position", F.row_number().over(w).cast("long")).withColumn("reached", reached).withColumn("text_before", F.col("top") > F.col("reached") + 1)


def row_background(rows: DataFrame, rects: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """rows(keys.., row_id, x0, top, x1, bottom) with the colour of the rect(keys.., ordinal, ..) that overlaps most of their height."""
    r, c = rows.alias("r"), rects.alias("c")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"r.{k}") == F.col(f"c.{k}")
    overlap = F.greatest(F.lit(0.0), F.least("r.bottom", "c.bottom") - F.greatest("r.top", "c.top")) / (F.col("r.bottom") - F.col("r.top"))
    hit = r.join(c, on & (F.col("c.x0") < F.col("r.x1")) & (F.col("c.x1") > F.col("r.x0")) & (overlap > least))
    best = hit.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r.row_id").alias("row_id")).agg(F.max_by("c.color", F.struct(overlap.alias("o"), (-F.col("c.ordinal")).alias("n"))).alias("background"))
    return rows.join(best, [*keys, "row_id"], "left")


def merge_runs(elements: DataFrame, doc: str) -> DataFrame:
    """elements(doc, seq, is_table, width, first_color, last_color) with ``run``: elements of one run are one table.

    A table goes on in the next one if that starts without colour, whatever its width, or if one ends and the next
    starts coloured and the next is as wide as the run's first.  A document's elements are folded in order.
    """
    fields = ["seq", "is_table", "width", "first_color", "last_color"]
    start = F.struct(F.lit(-1).alias("run"), F.lit(False).alias("is_table"), F.lit(0).alias("width"), F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<seq:bigint,run:int>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        goes_on = a["is_table"] & e["is_table"] & (e["first_color"].isNull() | (a["last"].isNotNull() & e["first_color"].isNotNull() & (a["width"] == e["width"])))
        run = F.when(goes_on, a["run"]).otherwise(a["run"] + 1)
        width = F.when(goes_on, a["width"]).otherwise(e["width"])
        return F.struct(run.alias("run"), e["is_table"].alias("is_table"), width.alias("width"), e["last_color"].alias("last"), F.concat(a["out"], F.array(F.struct(e["seq"].alias("seq"), run.alias("run")))).alias("out"))

    ordered = elements.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    return ordered.select(doc, F.explode(F.aggregate("e", start, step)["out"]).alias("o")).select(doc, "o.seq", F.col("o.run").cast("long").alias("run"))


def split_parts(tables: DataFrame, keys: list[str], rows: str = "rows", header: str = "header", budget: int = 1024) -> DataFrame:
    """keys.., part, first_row, n_rows: body rows in parts that, with the header, stay under a token budget.

    A row over the budget stands alone; a table without body rows is one empty part.
    """
    head = count_tokens(markdown(F.col(header), F.size(header)))
    cost = F.transform(F.col(rows), lambda r: count_tokens(markdown_row(r)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array(F.lit(0)).alias("sizes"))

    def step(a: Column, c: Column) -> Column:
        last = F.element_at(a["sizes"], -1)
        new = (a["used"] + c + F.col("head") > budget) & (last > 0)
        grown = F.concat(F.slice(a["sizes"], F.lit(1), F.size(a["sizes"]) - 1), F.array(last + 1))
        return F.struct(F.when(new, c).otherwise(a["used"] + c).alias("used"), F.when(new, F.concat(a["sizes"], F.array(F.lit(1)))).otherwise(grown).alias("sizes"))

    folded = tables.withColumn("head", head).withColumn("cost", cost).select(*keys, F.aggregate("cost", start, step)["sizes"].alias("sizes"))
    return folded.select(*keys, "sizes", F.posexplode("sizes").alias("part", "n_rows")).select(
        *keys, F.col("part").cast("long").alias("part"), F.aggregate(F.slice("sizes", F.lit(1), F.col("part")), F.lit(0), lambda a, x: a + x).cast("long").alias("first_row"), F.col("n_rows").cast("long").alias("n_rows")
    )
