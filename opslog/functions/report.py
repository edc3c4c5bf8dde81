"""Markdown reports and prompts for incidents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opslog.functions.text import PROMPT_CHARS
from opslog.functions.times import iso_format

# The wording of the reports and the prompt.
RCA_HEADING = "### Root Cause Analysis"
ACTIONS_HEADING = "### Recommended Actions"
SIGNAL_HEADING = "### Model Signal"
GUIDANCE_HEADING = "### Relevant runbook guidance"
SIGNAL_INTRO = "%s anomaly detection flagged a %s log from `%s` at `%s`. The triggering message was:"
TEMPLATE_LINE = "Parsed template: `%s`"
SCORE_LINE = "- Isolation Forest decision score: `%.6f`"
LENGTH_LINE = "- Template sequence length: `%d`"
UNIQUE_LINE = "- Unique templates in sequence: `%d`"
SEQUENCE_LINE = "- Template sequence: `%s`"
SIGNAL_ACTIONS = (
    "1. Inspect the emitting service and recent deploy activity.",
    "2. Check resource pressure and dependency health for the affected host.",
    "3. Attach the relevant runbook once FAISS-backed RAG retrieval is enabled.",
)
SIGNAL_END = "_Generated placeholder RCA at %s+00:00._"
PATTERN_LINE = "The triggering log pattern `%s` aligns with a likely operational issue in the application stack."
TRIGGER_LINE = "Triggering log: `%s`"
GUIDANCE_ENTRY = "%d. **%s** (%s)\n   - %s"
FALLBACK_ACTIONS = (
    "1. Validate the failing service and recent deploy activity.",
    "2. Inspect resource saturation and dependency health for the affected host.",
    "3. Apply the matching runbook steps and confirm the fix with targeted checks.",
)
UNKNOWN_SEQUENCE = "unknown template sequence"
PROMPT_INTRO = (
    "You are the %s incident RCA assistant. Analyze the triggering log and use the relevant runbooks "
    "to produce a concise Markdown incident report."
)
PROMPT_LOG = "Template sequence: %s\nTriggering log: %s"
PROMPT_RUNBOOKS = "Relevant runbooks:\n%s"
PROMPT_ENTRY = "Runbook %d: %s (%s)\n%s"
PROMPT_END = (
    "Return only a polished Markdown document with sections '### Root Cause Analysis', "
    "'### Recommended Actions', and a brief summary."
)
UNKNOWN_PROMPT_SEQUENCE = "unknown"
NO_RUNBOOKS = "No runbook matches were found."

# Name of the system that signs the texts; pass another one to brand them.
SYSTEM = "Log analytics"

fill = F.format_string


def _paragraphs(*parts: Column | str) -> Column:
    """The parts with a blank line between them; NULL parts are left out."""
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(*parts: str) -> str:
    return "\n".join(parts)


def _named(sequence: Column, unknown: str) -> Column:
    return F.coalesce(F.nullif(sequence, F.lit("")), F.lit(unknown))


def signal_context(score: Column, seq_len: Column, unique_templates: Column, sequence: Column) -> Column:
    """The section that shows what the model saw."""
    return fill(
        _lines(SIGNAL_HEADING, SCORE_LINE, LENGTH_LINE, UNIQUE_LINE, SEQUENCE_LINE, ""),
        score, seq_len, unique_templates, sequence,
    )


def rca_signal_markdown(
    level: Column, host: Column, ts: Column, message: Column, template: Column,
    generated_at: Column, context: Column | None = None, system: str = SYSTEM,
) -> Column:
    """The first report of an incident; ``context`` adds the model's section."""
    return _paragraphs(
        RCA_HEADING,
        fill(SIGNAL_INTRO, F.lit(system), level, host, iso_format(ts)),
        fill("`%s`", message),
        fill(TEMPLATE_LINE, F.coalesce(template, F.lit("None"))),
        F.lit(None).cast("string") if context is None else context,
        _lines(ACTIONS_HEADING, *SIGNAL_ACTIONS),
        fill(SIGNAL_END, iso_format(generated_at)),
    )


def runbook_lines(index: Column, title: Column, category: Column, snip: Column) -> Column:
    """One numbered entry of the runbook list."""
    return fill(GUIDANCE_ENTRY, index, title, category, snip)


def rca_fallback_markdown(sequence: Column, message: Column, lines: Column) -> Column:
    """Report with runbook guidance; ``lines`` holds the list entries in order."""
    return _paragraphs(
        RCA_HEADING,
        fill(PATTERN_LINE, _named(sequence, UNKNOWN_SEQUENCE)),
        fill(TRIGGER_LINE, message),
        F.when(F.size(lines) > 0, F.concat(F.lit(GUIDANCE_HEADING + "\n"), F.array_join(lines, "\n"))),
        _lines(ACTIONS_HEADING, *FALLBACK_ACTIONS),
    )


def prompt_entry(index: Column, title: Column, category: Column, content: Column) -> Column:
    """One runbook as the prompt shows it."""
    return fill(PROMPT_ENTRY, index, title, category, F.substring(content, 1, PROMPT_CHARS))


def rca_prompt(sequence: Column, message: Column, entries: Column, system: str = SYSTEM) -> Column:
    """Prompt for an external writer; no call is made here."""
    runbooks = F.when(F.size(entries) > 0, F.array_join(entries, "\n\n")).otherwise(F.lit(NO_RUNBOOKS))
    return _paragraphs(
        fill(PROMPT_INTRO, F.lit(system)),
        fill(PROMPT_LOG, _named(sequence, UNKNOWN_PROMPT_SEQUENCE), message),
        fill(PROMPT_RUNBOOKS, runbooks),
        PROMPT_END,
    )
