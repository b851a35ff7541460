"""Prompt templates and the task registry.

Convention for every template: one instruction paragraph (no blank line
inside), a blank line, then the payload.  Model backends that only look at
the payload split on the first blank line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_SEP = "\n\n"

CHUNK_INSTRUCTION = "Condense the passage below into a short summary that keeps every gene, protein and effect it names."

ARTICLE_INSTRUCTION = "Write a summary of the scientific article below."

# Task registry: task name -> fixed instruction.  One task, as in the reference.
TASKS = {
    "e3-ligase": (
        "Which E3 ligase acts on which substrate in the text below? "
        "JSON only, one object per pair: E3_ligase, substrate (protein identifiers)."
    ),
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def with_payload(instruction, payload) -> Column:
    return F.concat(_lit(instruction), F.lit(PAYLOAD_SEP), _c(payload))


def chunk_prompt(text) -> Column:
    return with_payload(CHUNK_INSTRUCTION, text)


def article_prompt(article, custom_instruction=None) -> Column:
    """Default summary instruction, or a custom (task) instruction, then the article."""
    instr = _lit(ARTICLE_INSTRUCTION) if custom_instruction is None else _lit(custom_instruction)
    return with_payload(instr, article)


def annotation_prompt(gene, process, abstracts) -> Column:
    """One sentence about a gene, written from its abstracts."""
    instr = F.concat(
        F.lit("The abstracts below mention "), _c(gene), F.lit(". Name its part in "), _lit(process),
        F.lit(" in a single sentence; add nothing that they do not say."),
    )
    return with_payload(instr, abstracts)


def gene_summary_prompt(gene, process, data) -> Column:
    """One paragraph about a gene and a process, from the statements about the gene."""
    instr = F.concat(
        F.lit("Each statement below is a curated finding. Merge the findings on "), _c(gene),
        F.lit(" that bear on "), _lit(process), F.lit(" into one paragraph."),
    )
    return with_payload(instr, data)


def gene_line(gene, summary) -> Column:
    return F.concat(F.lit("Gene "), _c(gene), F.lit(": "), _c(summary))


def process_prompt(process, gene_lines) -> Column:
    """A text on a process over all genes of a set; ``gene_lines`` is the newline-joined list."""
    instr = F.concat(
        F.lit("Topic: "), _lit(process),
        F.lit(". Every line below sums up one gene. Tell how the genes that matter to the topic work together, and say how each might act."),
    )
    return with_payload(instr, gene_lines)


def task_instruction(task: str) -> str:
    if task not in TASKS:
        raise KeyError(f"unknown task {task!r}; known: {sorted(TASKS)}")
    return TASKS[task]


def payload_of(prompt) -> Column:
    """Text after the first blank line (the whole prompt when there is none)."""
    p = _c(prompt)
    pos = F.instr(p, PAYLOAD_SEP)
    return F.when(pos > 0, p.substr(pos + F.lit(len(PAYLOAD_SEP)), F.length(p))).otherwise(p)
