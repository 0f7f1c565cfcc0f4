"""Constants and types of the unified sample."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_TOKEN, IMAGE_TOKEN_ID, PAGE_TOKEN, IGNORE = "<image>", 128815, "<PAGE>", -100
#: mode -> base size, tile size, whether pages are cut in tiles
PRESETS = {"single_gundam": (1024, 640, True), "single_base": (1024, 1024, False), "multi_base": (1024, 1024, False)}
PAGE_BREAK = f"\n{PAGE_TOKEN}\n"
PROMPT_SINGLE, PROMPT_MULTI, PROMPT_MERGE = f"{IMAGE_TOKEN}Read this page.", f"{IMAGE_TOKEN}Read these pages.", f"{IMAGE_TOKEN}Merge these pages."
PROMPT_PAGE = PROMPT_SINGLE

META = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("chunk", T.StringType()),
            ("arcname", T.StringType()),
            ("page_id", T.StringType()),
            ("img_w", T.IntegerType()),
            ("img_h", T.IntegerType()),
            ("char_len", T.IntegerType()),
            ("language", T.StringType()),
            ("is_table", T.BooleanType()),
            ("is_diagram", T.BooleanType()),
            ("license", T.StringType()),
            ("n_pages", T.IntegerType()),
            ("page_ids", T.ArrayType(T.StringType())),
            ("arxiv_id", T.StringType()),
        )
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("mode", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("target_format", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("meta", META),
    ]
)
