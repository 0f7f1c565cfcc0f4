"""Which of a model's parameters are trained: a table of names and sizes in, a flag for each out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYER = r"^model\.layers\.[0-9]+\."
ATTENTION = r"self_attn\.[qkvo]_proj"
DENSE = r"mlp\.(?:gate|up|down)_proj"
SHARED = r"mlp\.shared_experts\.(?:gate|up|down)_proj"
MODES = tuple("lora_attn lora_decoder full_backbone full_decoder full_lm".split())


def trained(name: Column, mode: str, embeddings: bool = False) -> Column:
    """Whether a mode trains a parameter (full modes), or adapts a module (lora modes). Routed experts are
    part of full_decoder and full_lm only; embeddings adds the token embeddings to full_lm."""
    if mode == "lora_attn":
        return name.rlike(f"{LAYER}{ATTENTION}$")
    if mode in ("lora_decoder", "full_backbone"):
        return name.rlike(f"{LAYER}(?:{ATTENTION}|{DENSE}|{SHARED}){'$' if mode == 'lora_decoder' else '[.]'}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}, not one of {MODES}")
    hit = name.startswith("model.layers.")
    if mode == "full_lm":
        hit = hit | name.startswith("lm_head")
        if embeddings:
            hit = hit | name.contains("embed_tokens")
    return hit


def applied(df: DataFrame, mode: str, name: str = "name", embeddings: bool = False) -> DataFrame:
    """df with trained; raises if the mode meets no name, as a wrong prefix would have it."""
    d = df.withColumn("trained", trained(F.col(name), mode, embeddings))
    if d.where("trained").isEmpty():
        raise ValueError(f"{mode} meets no {name}")
    return d


def totals(df: DataFrame, size: str = "numel") -> DataFrame:
    """Trained and all parameters, the share in percent, and how many names are met."""
    part, every = F.coalesce(F.sum(F.when(F.col("trained"), F.col(size))), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))
    return df.agg(part.alias("trainable"), every.alias("total"), (100 * part / F.greatest(every, F.lit(1))).alias("pct"), F.count_if("trained").alias("hits"))


def classes(name: Column) -> Column:
    """A module's class: attn, shared, routed, or dense."""
    return F.when(name.contains("self_attn"), "attn").when(name.contains("shared_experts"), "shared").when(name.contains(".experts."), "routed").otherwise("dense")


def rates(df: DataFrame, lr: float, head_lr: float | None = None, name: str = "name") -> DataFrame:
    """The trained parameters with their rate: the head's own, if there is one."""
    head = F.col(name).startswith("lm_head")
    return df.where("trained").withColumn("lr", F.when(head, lr if head_lr is None else head_lr).otherwise(lr))


def steps(df: DataFrame, accumulate: int, peak: float, warmup: int, save_every: int, micro: str = "micro", loss: str = "loss") -> DataFrame:
    """A run's optimiser steps from its micro-batches (numbered from 0 over all epochs): step, loss (the last
    micro-batch's), lr, and whether a checkpoint is saved after it, which the last step never is. An
    incomplete step at the end isn't one."""
    from quire.functions.tokens import learning_rate

    d = df.groupBy((F.floor(F.col(micro) / accumulate) + 1).alias("step")).agg(F.max_by(loss, micro).alias("loss"), F.count("*").alias("n")).where(F.col("n") == accumulate)
    most = d.agg(F.max("step")).first()[0] or 0  # one number
    save = (F.col("step") % save_every == 0) & (F.col("step") < most) if save_every else F.lit(False)
    return d.select("step", "loss", learning_rate(F.col("step"), peak, warmup, F.lit(most)).alias("lr"), save.alias("saved"))
