"""Synthetic invoices as single- and multi-page samples. All values come from hashes of the seed, the page
and what is drawn, so any part of a data set can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import bind, money
from quire.schema import PAGE_TOKEN, PROMPT_MULTI, PROMPT_SINGLE

PRODUCTS = ("bolt", "cog", "gear", "hinge", "nut", "pin", "washer")
CUSTOMERS = ("North", "South", "East", "West")


def draw(seed: int, page: Column, what: Column | str) -> Column:
    """A number from 0 to 2^32 - 1."""
    key = F.concat_ws(":", F.lit(str(seed)), page.cast("string"), F.lit(what) if isinstance(what, str) else what)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def items(seed: int, page: Column) -> Column:
    """Three different products with a quantity of 1 to 6 and a price of 3.50 to 39.90."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, PRODUCTS)), lambda n: F.struct(draw(seed, page, n).alias("k"), n.alias("name"))))
    cents = lambda n: 350 + draw(seed, page, F.concat(n, F.lit(":price"))) % 3641
    qty = lambda n: (1 + draw(seed, page, F.concat(n, F.lit(":qty"))) % 6).cast("int")
    return F.transform(F.slice(order, 1, 3), lambda x: F.struct(x["name"].alias("name"), qty(x["name"]).alias("qty"), (cents(x["name"]) / 100.0).alias("price")))


def total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["qty"] * x["price"])


def invoice_markdown(title: Column, number: Column, date: Column, customer: Column, lines: Column, note: Column) -> Column:
    """An invoice's page: heading, three lines of its data, a table with a row for each item and for the
    total, the total as a formula, and a note. lines: an array of (name, qty, price)."""
    cell = lambda *c: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c), F.lit("</tr>"))
    head = F.concat(F.lit("# "), title, F.lit("\n\nInvoice ID: "), number, F.lit("\nDate: "), date, F.lit("\nCustomer: "), customer)
    names = "".join(f"<th>{n}</th>" for n in ("Item", "Qty", "Price", "Amount"))

    def body(own: Column, shown: Column) -> Column:
        rows = F.array_join(F.transform(own, lambda x: cell(x["name"], x["qty"].cast("string"), money(x["price"]), money(x["qty"] * x["price"]))), "\n")
        table = F.concat(F.lit(f"<table>\n<tr>{names}</tr>\n"), rows, F.lit("\n"), cell(F.lit("Total"), F.lit(""), F.lit(""), shown), F.lit("\n</table>"))
        return F.concat(table, F.lit("\n\n$$\n\\mathrm{Total} = "), shown, F.lit("\n$$"))

    inner = bind(lines, lambda own: bind(money(total(own)), lambda shown: body(own, shown)))
    return F.concat(head, F.lit("\n\n"), inner, F.lit("\n\n"), note)


def page(seed: int, at: Column) -> Column:
    number = lambda n: F.lpad(at.cast("string"), n, "0")
    day = F.concat(F.lit("2026-07-"), F.lpad((at % 28 + 1).cast("string"), 2, "0"))
    customer = F.concat(F.lit("Customer "), F.get(F.array(*map(F.lit, CUSTOMERS)), (draw(seed, at, "customer") % len(CUSTOMERS)).cast("int")))
    return invoice_markdown(F.concat(F.lit("Invoice "), number(4)), F.concat(F.lit("INV-"), number(5)), day, customer, items(seed, at), F.lit("A made-up page that tests the pipeline."))


def samples(spark: SparkSession, singles: int = 8, multis: int = 2, pages: int = 2, seed: int = 20260707) -> DataFrame:
    """(id, mode, target_type, images, prompt, target, source): single pages, then samples of several pages,
    each page of these behind a page mark. Pages are numbered over all samples."""
    # named i, for within a lambda an id would be the new column of that name
    own = F.lpad(F.col("i").cast("string"), 4, "0")
    one = spark.range(singles).select(F.col("id").alias("i")).select(
        F.lit(0).alias("part"), "i", F.concat(F.lit("single_"), own).alias("id"), F.lit("single_gundam").alias("mode"), F.array(F.concat(F.lit("images/single_"), own, F.lit(".png"))).alias("images"),
        F.lit(PROMPT_SINGLE).alias("prompt"), page(seed, F.col("i")).alias("target"), F.lit("synthetic_markdown").alias("source"),
    )
    serial = F.lpad(F.col("i").cast("string"), 4, "0")
    leaf = spark.range(multis * pages).select(F.col("id").alias("at"))
    leaf = leaf.select(F.floor(F.col("at") / pages).alias("i"), (F.col("at") % pages).alias("p"), page(seed, F.col("at") + singles).alias("t"))
    many = leaf.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("x"))
    many = many.select(
        F.lit(1).alias("part"), "i", F.concat(F.lit("multi_"), serial).alias("id"), F.lit("multi_base").alias("mode"),
        F.transform("x", lambda x: F.concat(F.lit("images/multi_"), serial, F.lit("_page_"), F.lpad((x["p"] + 1).cast("string"), 2, "0"), F.lit(".png"))).alias("images"), F.lit(PROMPT_MULTI).alias("prompt"),
        F.array_join(F.transform("x", lambda x: F.concat(F.lit(f"{PAGE_TOKEN}\n"), x["t"])), "\n").alias("target"), F.lit("synthetic_multi_page_markdown").alias("source"),
    )
    return one.unionByName(many).orderBy("part", "i").select("id", "mode", F.lit("page_markdown").alias("target_type"), "images", "prompt", "target", "source")
