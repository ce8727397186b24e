"""Reading order of positioned blocks (doc, page, block_no, x0, y0, x1, y1, text, page_width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

#: Shares of the page's width, and of its qualifying blocks.
FULL, QUALIFYING, MAJORITY = 0.65, 0.15, 0.5
#: Last page that can be a table of contents, and its headings.
TOC_PAGES, TOC_TITLES = 6, ["contents", "table of contents"]


def is_full(width_share: float = FULL) -> Column:
    return (F.col("x1") - F.col("x0")) > width_share * F.col("page_width")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with layout ("single" or "double") and ord, the place on the page from 1.

    Single: by y0. Double: full-width blocks cut the page into bands; within a band the left column comes
    first, then by y0, and the band's full-width block last. Ties are in the order of block_no.
    """
    page = Window.partitionBy("doc", "page")
    qualifies = is_full(QUALIFYING)
    n_full, n_all = F.sum((qualifies & is_full()).cast("int")).over(page), F.sum(qualifies.cast("int")).over(page)
    marked = blocks.withColumn("layout", F.when((n_all > 0) & (n_full / F.greatest(n_all, F.lit(1)) > MAJORITY), "single").otherwise("double")).withColumn("_wide", is_full())
    above = F.sum(F.col("_wide").cast("int")).over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.sum(F.col("_wide").cast("int")).over(page.orderBy("y0", "block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    side = ((F.col("x0") + F.col("x1")) / 2 >= F.col("page_width") / 2).cast("int")
    single = F.col("layout") == "single"
    keyed = marked.withColumn("_band", F.when(single, 0).when(F.col("_wide"), nth).otherwise(above)).withColumn("_last", F.when(single, 0).otherwise(F.col("_wide").cast("int"))).withColumn("_side", F.when(single | F.col("_wide"), 0).otherwise(side))
    return keyed.withColumn("ord", F.row_number().over(page.orderBy("_band", "_last", "_side", "y0", "block_no"))).drop("_wide", "_band", "_last", "_side")


def pages(ordered: DataFrame) -> DataFrame:
    """(doc, page, text, is_toc) of ordered blocks; blank blocks are left out."""
    some = ordered.where(strip(F.col("text")) != "")
    made = some.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("text")))), lambda b: b["text"]), "\n").alias("text"))
    return made.withColumn("is_toc", is_toc(F.col("text"), F.col("page")))


def is_toc(text: Column, page: Column) -> Column:
    first = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != ""), F.lit(0))
    return F.coalesce((page <= TOC_PAGES) & F.lower(first).isin(TOC_TITLES), F.lit(False))
