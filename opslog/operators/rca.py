"""Root-cause reports for incidents from the runbooks found for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.functions import report, text
from opslog.operators import incidents as inc
from opslog.operators.retrieve import TOP_K, attach_runbooks, search_runbooks
from opslog.operators.vectors import hashed_bag
from opslog.session import stage


def _runbook_lists(found: DataFrame, runbooks: DataFrame, entry, content) -> DataFrame:
    """Per query, its report entries in rank order; at most ``top_k`` of them.

    Content is cut to what an entry shows before it is shuffled.
    """
    books = runbooks.select("id", "title", "category", content.alias("content"))
    shown = attach_runbooks(found, books).select(
        "query_id", "rank",
        entry(F.col("rank"), F.col("title"), F.col("category"), F.col("content")).alias("entry"),
    )
    return shown.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "entry"))), lambda e: e["entry"]).alias("entries")
    )


def _texts(queries: DataFrame, lists: DataFrame, build) -> DataFrame:
    none = F.array().cast("array<string>")
    return queries.join(lists, "query_id", "left").select(
        "query_id", build(F.col("sequence"), F.col("raw_message"), F.coalesce("entries", none)).alias("text")
    )


def fallback_reports(queries: DataFrame, found: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Markdown report per query from its ranked runbooks."""
    lists = _runbook_lists(found, runbooks, report.runbook_lines, text.snippet(F.col("content")))
    return _texts(queries, lists, report.rca_fallback_markdown)


def prompts(queries: DataFrame, found: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Prompt per query for an external writer."""
    cut = F.substring("content", 1, text.PROMPT_CHARS)
    lists = _runbook_lists(found, runbooks, report.prompt_entry, cut)
    return _texts(queries, lists, report.rca_prompt)


def incident_queries(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """What each incident asks: template id and message of its trigger log, or empty texts."""
    trigger = inc.trigger_logs(incidents, logs).select(
        F.col("id").alias("trigger_log_id"), F.col("raw_message").alias("_message"),
        F.col("template_id").cast("string").alias("_sequence"),
    )
    return inc.join_triggers(incidents, trigger).select(
        F.col("id").alias("query_id"),
        F.coalesce("_sequence", F.lit("")).alias("sequence"),
        F.coalesce("_message", F.lit("")).alias("raw_message"),
    )


def incident_rca(queries: DataFrame, runbooks: DataFrame, vectors: DataFrame, top_k: int = TOP_K,
                 encoder=hashed_bag) -> DataFrame:
    """Search and report in one job: query_id, text."""
    found = stage(search_runbooks(queries, runbooks, vectors, top_k, encoder), "found")
    return fallback_reports(queries, found, runbooks)


def backfill_rca(incidents: DataFrame, logs: DataFrame, runbooks: DataFrame, vectors: DataFrame,
                 top_k: int = TOP_K, encoder=hashed_bag) -> DataFrame:
    """The incidents table with a report wherever it was missing or a placeholder."""
    queries = incident_queries(inc.needs_rca(incidents), logs)
    made = incident_rca(queries, runbooks, vectors, top_k, encoder)
    return inc.replace_reports(
        incidents, made.select(F.col("query_id").alias("id"), F.col("text").alias("rca_markdown"))
    )
