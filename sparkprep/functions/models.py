"""Closed forms for the size and work of transformer models, as column expressions over a table of configurations.

The formulas are fixed: they have to give the numbers that such models are compared by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def layer_parameters() -> Column:
    """Parameters of all layers, from layers, hidden, ffn, heads, groups, head_dim, experts and gated."""
    ratio = c("head_dim") * c("heads") / c("hidden")
    attention = (1 + c("groups") / c("heads")) * ratio
    mlp = c("ffn") / c("hidden") * c("experts") * F.when(c("gated"), 1.5).otherwise(1.0)
    return 2.0 * c("layers") * c("hidden") * c("hidden") * (attention + mlp + 2.0 / c("hidden") + 1.0 / (c("layers") * c("hidden")))


def weight_and_optimizer_bytes() -> Column:
    """Bytes of weights and optimizer on the fullest shard; adds vocab, tied, tensor, pipeline, data and distributed."""
    embedding = c("hidden") * c("vocab")
    shard = (layer_parameters() / c("pipeline") + embedding) / c("tensor")
    shard = shard + F.when(~c("tied") & (c("pipeline") == 1), embedding / c("tensor")).otherwise(0.0)
    return shard * F.when(c("distributed"), 6 + 12 / c("data")).otherwise(18.0)


def activation_bytes() -> Column:
    """Bytes of activations on the first pipeline stage with selective recomputation; adds seq, micro and microbatches."""
    tokens = (c("seq") * c("micro")).cast("double")
    total = tokens * c("hidden") * (18 + 4.0 * c("ffn") / c("hidden")) * c("layers") + 8 * tokens * c("pipeline") + tokens * c("hidden") * c("pipeline")
    total = total * F.when(c("pipeline") > 1, F.least(F.lit(1.0), c("microbatches") / c("pipeline"))).otherwise(1.0)
    return (total + F.when(c("pipeline") == 1, tokens * c("hidden") * 4 * (1 + c("vocab") / c("hidden"))).otherwise(0.0)) / c("tensor")


def transformer_flops() -> Column:
    """Floating-point operations of one training step over ``batch`` sequences: three passes, causal attention, output layer."""
    query = c("heads") * c("head_dim")
    attention = 2.0 * c("hidden") * (query + 2 * c("groups") * c("head_dim") + query) + 2.0 * query * c("seq")
    mlp = 2.0 * c("hidden") * c("ffn") * c("experts") * F.when(c("gated"), 3).otherwise(2)
    return 3.0 * c("batch") * c("seq") * (c("layers") * (attention + mlp) + 2.0 * c("hidden") * c("vocab"))


def vision_flops() -> Column:
    """Operations of one training step of a vision encoder over ``patches`` and of its merger into ``out_hidden``."""
    each = 8.0 * c("hidden") * c("hidden") + 4.0 * c("hidden") * c("patches") + 4.0 * c("hidden") * c("ffn")
    unit = c("merge") * c("merge")
    wide = (c("hidden") * unit).cast("double")
    merger = F.floor(c("patches") / unit) * (2 * wide * wide + 2 * wide * c("out_hidden"))
    return (each * c("patches") * c("layers") + merger) * c("batch") * 3


def attention_layer_flops(tokens: Column, seq: Column) -> Column:
    """Forward operations of an attention layer over ``tokens`` of sequences of length ``seq``; head_dim null means hidden / heads."""
    ratio = F.coalesce(c("head_dim") * c("heads") / c("hidden"), F.lit(1.0))
    return 4.0 * tokens * c("hidden") * ratio * (c("hidden") + c("hidden") * (c("groups") / c("heads")) + seq / 2)


def mlp_layer_flops(tokens: Column) -> Column:
    """Forward operations of a dense MLP layer that widens by ``expansion``."""
    return 4.0 * c("expansion") * F.when(c("gated"), 1.5).otherwise(1.0) * tokens * c("hidden") * c("hidden")


def expert_layer_flops(tokens: Column) -> Column:
    """Forward operations of a layer of experts: ``topk`` routed ones of width expert_ffn, on ``latent`` places if that isn't null, and shared ones."""
    scale = F.when(c("gated"), 1.5).otherwise(1.0)
    width = F.coalesce(c("latent"), c("hidden"))
    routed = 4.0 * tokens * width * c("expert_ffn") * c("topk") * scale
    latent = F.when(c("latent").isNotNull(), 4.0 * tokens * c("hidden") * c("latent")).otherwise(0.0)
    return routed + latent + 4.0 * tokens * c("hidden") * c("shared_ffn") * scale


def state_space_layer_flops(tokens: Column) -> Column:
    """Forward operations of a state-space layer: projections in and out, and the scan."""
    inner = 2.0 * c("hidden")
    heads = F.when(c("ssm_heads") > 0, c("ssm_heads")).otherwise(F.floor(inner / c("ssm_head_dim")))
    return 2.0 * tokens * c("hidden") * (2 * inner + 2 * c("ssm_groups") * c("ssm_state") + heads) + 7.0 * tokens * inner * c("ssm_state") + 2.0 * tokens * inner * c("hidden")


def delta_layer_flops(tokens: Column) -> Column:
    """Forward operations of a gated delta layer."""
    qk, v = c("delta_qk_dim") * c("delta_qk_heads"), c("delta_v_dim") * c("delta_v_heads")
    return 2.0 * tokens * (c("hidden") * (2 * qk + 2 * v + 2 * c("delta_v_heads")) + c("delta_conv") * (2 * qk + v) + c("delta_v_heads") * c("delta_v_dim") * c("delta_v_dim") * 4 + c("hidden") * v)


def layer_counts(pattern: Column) -> dict[str, Column]:
    """Layers of each kind in a pattern of letters: * attention, M state space, - MLP, E experts, G delta."""
    marks = {"attention": "*", "state_space": "M", "mlp": "-", "experts": "E", "delta": "G"}
    return {name: (F.length(pattern) - F.length(F.replace(pattern, F.lit(mark), F.lit("")))).cast("long") for name, mark in marks.items()}


def hybrid_flops(pattern: Column) -> Column:
    """Operations of one training step of a model whose layers are of several kinds, and of its output layers (one, and one for each predicted token beyond)."""
    tokens = (c("batch") * c("seq")).cast("double")
    n = layer_counts(pattern)
    layers = n["attention"] * attention_layer_flops(tokens, c("seq")) + n["mlp"] * mlp_layer_flops(tokens) + n["state_space"] * state_space_layer_flops(tokens) + n["experts"] * expert_layer_flops(tokens) + n["delta"] * delta_layer_flops(tokens)
    return 3.0 * (layers + 2.0 * tokens * c("hidden") * c("vocab") * (1 + c("predicted")))


def vocabulary_divisor(n: Column) -> Column:
    """The greatest power of two up to 128 that divides ``n``."""
    return F.greatest(*(F.when(n % d == 0, d).otherwise(1) for d in (1, 2, 4, 8, 16, 32, 64, 128))).cast("long")
