"""Building, normalising and validating unified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.pages import fixed_groups, sequence_ids
from quire.schema import IMAGE_TOKEN, META, PAGE_BREAK, PRESETS, PROMPT_MERGE, PROMPT_MULTI, PROMPT_PAGE, PROMPT_SINGLE, SAMPLE


def images_of(images: Column, image: Column) -> Column:
    """images if there are any, else image as the only one, else null."""
    return F.when(F.size(images) > 0, images).when(F.coalesce(image, F.lit("")) != "", F.array(image))


def resolved(images: Column, root: str) -> Column:
    return F.transform(images, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{root}/"), p)))


def meta(**fields: Column) -> Column:
    """A sample's meta with the given fields, the others null."""
    return F.struct(*((fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in META))


def normalised(df: DataFrame, root: str) -> DataFrame:
    """Defaults filled in, images unified and resolved, and error: the first rule a row breaks, or null.

    Defaults are for absent keys. Where the input has given (the keys of its line), a key that is set to
    null stays null, and a null mode is an error; without given, null means absent.
    """
    given = lambda name: F.array_contains("given", name) if "given" in df.columns else F.lit(False)
    default = lambda name, value: F.when(F.col(name).isNull() & ~given(name), value).otherwise(F.col(name))
    mode = default("mode", F.lit("single_gundam"))
    images = images_of(F.col("images"), F.col("image"))
    prompt = default("prompt", F.when(mode.startswith("multi"), PROMPT_MULTI).otherwise(PROMPT_SINGLE))
    error = (
        F.when(mode.isNull() | ~mode.isin(*PRESETS), "mode")
        .when(images.isNull(), "images")
        .when(mode.startswith("single") & (F.size(images) != 1), "single")
        .when(F.coalesce(strip(F.col("target")), F.lit("")) == "", "target")
        .when(~F.coalesce(placeholders_fit(prompt, images, mode), F.lit(False)), "placeholder")
    )
    rest = [default("meta", meta()).alias("meta")] if "meta" in df.columns else []
    return df.select(
        default("id", F.concat(F.lit("row_"), "ln")).alias("id"), mode.alias("mode"), resolved(images, root).alias("images"), prompt.alias("prompt"), F.col("target").cast("string").alias("target"), *rest, error.alias("error")
    )


def placeholders_fit(prompt: Column, images: Column, mode: Column) -> Column:
    n = F.size(F.split(prompt, IMAGE_TOKEN)) - 1
    return F.when(mode.startswith("multi"), n == 1).otherwise(n == F.size(images))


def checked(df: DataFrame) -> DataFrame:
    """Fails on the first row with an error, as a loader does, and on an empty set of samples."""
    if df.isEmpty():
        raise ValueError("no samples")
    return df.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("invalid sample "), F.coalesce("id", F.lit("?")), F.lit(": "), "error")).cast("boolean"))).drop("error")


def unified(df: DataFrame, **columns: Column) -> DataFrame:
    """Samples of the unified schema from the given columns, the others null."""
    return df.select(*((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLE))


def page_samples(pages: DataFrame, source: str, prefix: str = "page_", digits: int = 6, probe: bool = False) -> DataFrame:
    """A sample for each page, with dense ids in order. Probe samples don't keep the page's own id."""
    d = sequence_ids(pages, "ord", prefix, digits, "sample_id")
    fields = {
        "chunk": F.col("chunk"), "arcname": F.col("member"), "img_w": F.col("img_w"), "img_h": F.col("img_h"), "char_len": F.length("natural_text"),
        "language": F.col("primary_language"), "is_table": F.col("is_table"), "is_diagram": F.col("is_diagram"), "license": F.lit("odc-by"),
    }
    return unified(
        d, id=F.col("sample_id"), source=F.lit(source), image=F.concat(F.lit("images/"), "sample_id", F.lit(".png")), mode=F.lit("single_gundam"), prompt=F.lit(PROMPT_PAGE), target=F.col("natural_text"),
        target_format=F.lit("natural_text_or_html"), task=F.lit("full_page_parse"), meta=meta(**fields, **({} if probe else {"page_id": F.col("id")})),
    )


def multipage_samples(samples: DataFrame, pages: int, order: str = "id", of: list[str] | None = None) -> DataFrame:
    """Samples of so many pages in a row, joined by page marks; an incomplete rest is dropped. A sample
    takes its source from its first page."""
    g = fixed_groups(samples, order, pages, "target", PAGE_BREAK, of, ("id", "source", "image"))
    g = g.withColumn("serial", F.concat_ws("_", *(of or []), F.lpad(F.col("group").cast("string"), 6, "0")))
    return unified(
        g, id=F.concat(F.lit("multi_"), "serial"), source=F.coalesce(F.get("rows", F.lit(0))["source"], F.lit("")), images=F.transform("rows", lambda r: r["image"]), mode=F.lit("multi_base"), prompt=F.lit(PROMPT_MULTI),
        target=F.col("joined"), target_format=F.lit("natural_text_or_html"), task=F.lit("multi_page_parse"), meta=meta(n_pages=F.lit(pages), page_ids=F.transform("rows", lambda r: r["id"])),
    )


def merge_samples(docs: DataFrame, key: str, pages: str, target: str) -> DataFrame:
    """Samples that merge a document's pages into its text."""
    return unified(
        docs, id=F.col(key), mode=F.lit("multi_base"), prompt=F.lit(PROMPT_MERGE), target=F.col(target), task=F.lit("multi_page_merge"), meta=meta(n_pages=F.col(pages), arxiv_id=F.col(key)),
    )
