"""What a model file is, told from the names and shapes of its tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names (lower case) that show a part; ^ marks the start and $ the end.
SIGNS = {
    "lora": (r"^lora_", r"\.lora_", r"\.lora\.", r"\.hada_", r"\.lokr_"),
    "unet_in": (r"^model\.diffusion_model\.input_blocks\.0\.0\.weight$", r"^unet\.conv_in\.weight$"),
    "unet_out": (r"^model\.diffusion_model\.out\.2\.weight$", r"^unet\.conv_out\.weight$"),
    "encoder": (r"^first_stage_model\.encoder\.", r"^vae\.encoder\."),
    "decoder": (r"^first_stage_model\.decoder\.", r"^vae\.decoder\."),
    "text": (r"^cond_stage_model\.transformer\.", r"^conditioner\.embedders\.0\.transformer\.", r"^text_encoder\."),
    "text2": (r"^conditioner\.embedders\.1\.", r"^text_encoder_2\."),
    "hint": (r"^controlnet_cond_embedding\.", r"^input_hint_block\.", r"^control_model\.input_hint_block\."),
    "down": (r"^controlnet_down_blocks\.", r"^zero_convs\.", r"^control_model\.zero_convs\."),
    "middle": (r"^controlnet_mid_block\.", r"^middle_block_out\.", r"^control_model\.middle_block_out\."),
}
ATTENTION = r"attn2\.to_k\.weight\z"
WIDTHS = {768: "sd15", 2048: "sdxl"}


def classified(tensors: DataFrame, key: str, network: Column | None = None) -> DataFrame:
    """(key, family, role) of tensors (`key`, name, shape); `network` is the module a file's notes name, if any.

    A family needs one width of all cross attentions, 768 only without a second text encoder.
    """
    name = F.lower("name")
    width = F.when(name.rlike(ATTENTION) & (F.size("shape") == 2), F.col("shape")[1])
    found = tensors.groupBy(key).agg(
        *[F.bool_or(name.rlike("|".join(signs).replace("$", r"\z"))).alias(part) for part, signs in SIGNS.items()],
        F.min(width).alias("least"), F.max(width).alias("most"),
        F.bool_or(F.coalesce(F.lower(network).rlike("lora|lycoris"), F.lit(False)) if network is not None else F.lit(False)).alias("named"),
    )
    c = F.col
    alone = c("least") == c("most")
    family = F.when(alone & (c("most") == 768) & ~c("text2"), WIDTHS[768]).when(alone & (c("most") == 2048), WIDTHS[2048])
    control = c("hint") & c("down") & c("middle") & ~c("encoder") & ~c("decoder") & ~c("text") & ~c("text2")
    base = c("unet_in") & c("unet_out") & c("encoder") & c("decoder") & c("text") & ~c("hint") & ((c("family") == "sd15") | c("text2"))
    known = c("family").isNotNull()
    role = F.when(c("lora") | c("named"), "lora").when(known & control, "control").when(known & base, "base").otherwise("unknown")
    return found.withColumn("family", family).select(key, "family", role.alias("role"))
