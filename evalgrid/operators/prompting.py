"""Prompt assembly (P2, P3), config predicates (P1) and the prompt-file parser (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import is_mcq_split
from ..functions.text import py_strip

# ---- fixed values: the separator between examples and template, the template slot ----
SEPARATOR = "|||"
SLOT = "{}"
# ---- end fixed values ----


def question_block(split: Column, question: Column, options: Column) -> Column:
    """MCQ splits get question + newline + options (blank lines collapsed once); others question + newline."""
    q = py_strip(question)
    opts = F.replace(py_strip(F.coalesce(options, F.lit(""))), F.lit("\n\n"), F.lit("\n"))
    return F.when(is_mcq_split(split), F.concat(q, F.lit("\n"), opts)).otherwise(F.concat(q, F.lit("\n")))


def _slot_parts(template: Column) -> Column:
    """The template around its slots, with doubled braces kept apart from single ones."""
    marked = F.replace(F.replace(template, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    return F.split(marked, r"\{\}", -1)


def one_slot(template: Column) -> Column:
    """Whether a template has exactly one slot; ``str.format`` with one value needs that."""
    return F.size(_slot_parts(template)) == 2


def assemble_prompt(examples: Column, template: Column, block: Column) -> Column:
    """``examples + template.format(block)``: doubled braces of the template become single ones, braces
    inside the block stay inert."""
    def plain(part):
        return F.replace(F.replace(part, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    parts = _slot_parts(template)
    return F.concat(examples, plain(F.get(parts, F.lit(0))), block, plain(F.get(parts, F.lit(1))))


def prompts_for(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """J2 + P3: every item x every prompt file of its split; files whose template hasn't one slot are left out.

    Prompt texts have no bound on their size, so nothing is forced: AQE broadcasts them if their measured size
    allows, else it splits a hot split's items over tasks.
    """
    p = prompts.where(F.col("valid") & one_slot(F.col("template"))).select("split", "shot", "examples", "template")
    j = items.join(p, "split")
    block = question_block(F.col("split"), F.col("question"), F.col("options"))
    return j.withColumn("prompt", assemble_prompt(F.col("examples"), F.col("template"), block))


def parse_prompt_text(text: Column) -> dict[str, Column]:
    """S3: strip, split on the literal ``|||``; valid = exactly two parts, neither blank."""
    raw = py_strip(text)
    parts = F.split(raw, r"\|\|\|", -1)
    n = F.size(parts)
    ex, tp = F.element_at(parts, 1), F.element_at(parts, 2)
    two = n == 2
    valid = two & (py_strip(ex) != "") & (py_strip(F.coalesce(tp, F.lit(""))) != "")
    reason = (
        F.when(~two, F.lit("must contain exactly one '|||' separator"))
        .when(~valid, F.lit("empty examples or template"))
    )
    return {
        "n_parts": n,
        "examples": F.when(two, ex),
        "template": F.when(two, tp),
        "valid": valid,
        "reason": reason,
    }


# ---- fixed values: messages of the argument checks ----
BAD_BATCHED_TOKENS = "max_batched_tokens must be positive"
BAD_MAX_TOKENS = "max_tokens must be positive"
BAD_TEMPERATURE = "temperature must be non-negative"
BAD_TOP_P = "top_p must be in [0, 1]"
# ---- end fixed values ----


def config_reject_reason(runs: DataFrame) -> Column:
    """The first failing argument check, in the reference's order; null when the config is valid."""
    c = F.col
    return (
        F.when(c("max_batched_tokens") <= 0, F.lit(BAD_BATCHED_TOKENS))
        .when(c("max_tokens") <= 0, F.lit(BAD_MAX_TOKENS))
        .when(c("temperature") < 0, F.lit(BAD_TEMPERATURE))
        .when(~((c("top_p") >= 0) & (c("top_p") <= 1)), F.lit(BAD_TOP_P))
    )
