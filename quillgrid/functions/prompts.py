"""Texts around generated images: parameter lines, and scene prompts from captions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import by_row

PARAMETERS = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("negative", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
_KEY = r"[\w .\-/]+:"
_STARTS = re.compile(r"(?:Steps|Sampler|CFG scale|Seed|Size):\s")
_KEYS = re.compile(rf"(?:^|,\s*){_KEY}")
_PARTS = re.compile(rf'"(?:\\.|[^"\\])*(?:"|\Z)|[\[({{]|[\])}}]|,(?=\s*{_KEY})', re.S)

# What a caption's words stand for in a prompt, first match first; words not wanted beside them.
SCENES = (
    (("city", "cities", "street", "building", "architecture"), (), "coherent street architecture, varied windows, layered balconies, reflected daylight"),
    (("forest", "tree", "garden", "plant"), ("room", "window", "indoor"), "overlapping leaves and branches, varied foliage, dappled daylight"),
    (("sea", "beach", "ocean", "water"), (), "coastal scenery, rippling water, rocks and soft reflected daylight"),
    (("mountain", "landscape", "hill"), (), "layered landscape, textured rocks and foliage, natural depth and soft shadows"),
)
OTHER_SCENE = "quiet room, wooden window frames, a few leafy plants, soft side lighting"
STYLES = (
    (("anime", "cartoon", "drawing", "illustration"), "illustration, clean coherent linework, matching original shading"),
    (("photo", "photograph", "photography"), "photograph, realistic surface detail, natural lighting"),
)
OTHER_STYLE = "matching the original visual style, consistent colors and lighting"


def split_fields(line: str) -> list[str]:
    """Cut at commas before a key, outside quotes and brackets."""
    commas, depth = [], 0
    for m in _PARTS.finditer(line):
        if m[0] in "[({":
            depth += 1
        elif m[0] in "])}":
            depth = max(0, depth - 1)
        elif m[0] == "," and not depth:
            commas.append(m.start())
    return [line[a + 1 : b].strip() for a, b in zip([-1, *commas], [*commas, len(line)])]


def parse_parameters(text: str | None) -> tuple[str, str, dict[str, str]]:
    """Prompt, negative prompt and named values; values stay texts, so that seeds of 64 bits keep their digits."""
    lines = (text or "").replace("\r\n", "\n").rstrip("\0").split("\n")
    at = next((i for i in reversed(range(len(lines))) if _STARTS.match(lines[i]) and len(_KEYS.findall(lines[i])) > 1), len(lines))
    prompt, negative = "\n".join(lines[:at]), ""
    if found := re.search(r"(?:^|\n)Negative prompt:\s*", prompt):
        prompt, negative = prompt[: found.start()].rstrip(), prompt[found.end() :]
    fields = {}
    for part in split_fields("\n".join(lines[at:])):
        name, colon, value = part.partition(":")
        if name and colon:
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] == '"':
                try:
                    value = json.loads(value)
                except json.JSONDecodeError:
                    pass
            fields[name.strip()] = value
    return prompt, negative, fields


parameters = by_row(parse_parameters, PARAMETERS)


def has_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whole words or phrases, also with -s or -es, in any script's word boundaries."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(terms)})(s|es)?(?![\p{{L}}\p{{N}}_])")


def scene_prompt(caption: Column) -> Column:
    text = F.lower(caption)
    scene, style = F.lit(OTHER_SCENE), F.lit(OTHER_STYLE)
    for terms, not_beside, out in reversed(SCENES):
        scene = F.when(has_term(text, terms) & (~has_term(text, not_beside) if not_beside else F.lit(True)), out).otherwise(scene)
    for words, out in reversed(STYLES):
        style = F.when(text.rlike("|".join(words)), out).otherwise(style)
    return F.concat_ws(", ", scene, style)
