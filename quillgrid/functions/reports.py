"""Reports of named values as text and JSON, and the names they go by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of generation parameters as reports show them.
PARAMETER_NAMES = {
    "Steps": "步数 Steps", "steps": "步数 Steps",
    "CFG scale": "CFG / Guidance", "cfg": "CFG / Guidance", "guidance": "CFG / Guidance",
    "Seed": "种子 Seed", "seed": "种子 Seed", "noise_seed": "种子 Seed",
    "Sampler": "采样器 Sampler", "sampler_name": "采样器 Sampler",
    "scheduler": "调度器 Scheduler", "Schedule type": "调度器 Scheduler",
    "Model": "模型 Model", "ckpt_name": "模型 Model",
    "Size": "尺寸 Size",
    "denoise": "降噪 Denoise", "Denoising strength": "降噪 Denoise",
}


def parameter_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PARAMETER_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def text_report(title: Column, values: Column) -> Column:
    """A title and the lines `name: value` of an array of (name, value) that have a value; empty without any."""
    lines = F.transform(F.filter(values, lambda x: F.trim(x["value"]) != ""), lambda x: F.concat(x["name"], F.lit(": "), x["value"]))
    return F.when(F.size(lines) > 0, F.concat(title, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
