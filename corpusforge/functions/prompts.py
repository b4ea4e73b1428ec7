"""Prompt rendering, chat request/response JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.config import IM_END, IM_START
from corpusforge.functions.text import sanitize_text

ASSISTANT_MARK = f"{IM_START}assistant"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def training_prompt(instruction, text, answer) -> Column:
    """<|im_start|>user\\nI:\\nT\\n<|im_end|>\\n<|im_start|>assistant\\nS\\n<|im_end|>."""
    instr = F.lit(instruction) if isinstance(instruction, str) else instruction  # literal or Column
    return F.concat(F.lit(f"{IM_START}user\n"), instr, F.lit(":\n"), _c(text),
                    F.lit(f"\n{IM_END}\n{IM_START}assistant\n"), _c(answer), F.lit(f"\n{IM_END}"))


_FIELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def render_template(df: DataFrame, template: str) -> Column:
    """fill '{field}' slots from the record's columns (parsed once on the driver)."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name not in df.columns:
            raise KeyError(f"template field {name!r} is not a column")
        parts.append(F.col(name).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def prompt_prefix(prompt) -> Column:
    """text before the first '<|im_start|>assistant'; null when the marker is absent."""
    p = _c(prompt)
    i = F.locate(ASSISTANT_MARK, p)
    return F.when(i > 0, F.substring_index(p, ASSISTANT_MARK, 1))


def marker_in_text(text) -> Column:
    """the text itself holds a chat control marker."""
    return F.instr(_c(text), IM_START) > 0


def chat_request(model, prompt) -> Column:
    """{"model": ..., "messages": [{"role": "user", "content": ...}]} as JSON text."""
    msg = F.struct(F.lit("user").alias("role"), _c(prompt).alias("content"))
    return F.to_json(F.struct(_c(model).alias("model"), F.array(msg).alias("messages")))


def chat_reply_content(reply) -> Column:
    """F8: choices[0].message.content, stripped of surrounding whitespace; null if absent."""
    content = F.get_json_object(_c(reply), "$.choices[0].message.content")
    return F.regexp_replace(content, r"^[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+|[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+$", "")


__all__ = ["training_prompt", "render_template", "prompt_prefix", "marker_in_text",
           "chat_request", "chat_reply_content", "sanitize_text"]
