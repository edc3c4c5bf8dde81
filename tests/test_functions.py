from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslog.functions import report, rules, sequence as seq, text, times


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def one(spark, value, make, kind="string"):
    return values(spark, [(value,)], f"x {kind}", make(F.col("x")))[0][0]


@pytest.mark.parametrize("message,strict,loose", [
    ("a Fatal thing", "ERROR", "INFO"), ("it failed", "INFO", "ERROR"), ("NullException", "INFO", "ERROR"),
    ("warning", "WARN", "WARN"), ("slow disk", "INFO", "WARN"), ("fine", "INFO", "INFO"), (None, "INFO", "INFO"),
    ("warn then error", "ERROR", "ERROR"),
])
def test_levels(spark, message, strict, loose):
    assert one(spark, message, rules.level_strict) == strict
    assert one(spark, message, rules.level_loose) == loose


def test_blocks(spark):
    assert one(spark, "x blk_-12 blk_3", rules.extract_block_id) == "blk_-12"
    assert one(spark, "none", rules.extract_block_id) is None
    assert one(spark, "blk_1 blk_12 blk_1", rules.block_mentions) == ["blk_1", "blk_12"]


@pytest.mark.parametrize("message,severity,title", [
    ("FATAL error", "CRITICAL", "ERROR anomaly from h"),
    ("an error", "HIGH", "ERROR anomaly from h"),
    ("calm", "MEDIUM", "ERROR anomaly from h"),
    ("Connection lost", "CRITICAL", "PostgreSQL Connection Pool Exhaustion"),
    ("no free slot", "MEDIUM", "PostgreSQL Connection Pool Exhaustion"),
])
def test_severity_and_title(spark, message, severity, title):
    assert one(spark, message, rules.classify_severity) == severity
    assert one(spark, message, lambda c: rules.incident_title(F.lit("ERROR"), F.lit("h"), c)) == title


def test_needs_rca(spark):
    rows = [(None,), ("",), ("once FAISS-backed RAG retrieval is enabled",), ("done",)]
    assert values(spark, rows, "x string", rules.needs_rca(F.col("x"))) == [(True,), (True,), (True,), (False,)]


def test_snippet_is_cut_after_220_characters(spark):
    assert one(spark, "a" * 220, text.snippet) == "a" * 220
    assert one(spark, "a" * 221, text.snippet) == "a" * 220 + "..."
    assert one(spark, "  a\t\n b  c ", text.snippet) == "a b c"


@pytest.mark.parametrize("raw", ["\t x  y\r", "  a  ", "\x1cq\x85", ""])
def test_strip_and_collapse_follow_python(spark, raw):
    assert one(spark, raw, text.strip) == raw.strip()
    assert one(spark, raw, text.collapse) == " ".join(raw.split())


def test_mask(spark):
    assert one(spark, "got blk_-7 from /10.0.0.2:50010 in 42.5ms x9", text.mask_template) == (
        "got <*> from <*> in <*>ms x<*>"
    )


def test_tokens_and_overlap(spark):
    assert sorted(one(spark, "The DB, the db-pool é2x abc", text.tokenize)) == ["abc", "pool", "the"]
    assert one(spark, None, text.tokenize) == []
    rows = [(["a1x", "b1x"], ["b1x", "c1x"]), ([], ["b1x"]), (["a1x"], [])]
    got = values(spark, rows, "q array<string>, d array<string>", text.lexical_score(F.col("q"), F.col("d")))
    assert got == [(0.5,), (0.0,), (0.0,)]


def test_texts(spark):
    row = [("t", "", "c")]
    cols = [F.col(c) for c in "abc"]
    assert values(spark, row, "a string, b string, c string", text.runbook_text(*cols)) == [("t c",)]
    assert values(spark, row, "a string, b string, c string", text.runbook_search_text(*cols)) == [
        ("Title: t\nCategory: \nc",)
    ]


def test_semantic_score(spark):
    rows = [(0.0,), (3.0,), (float("inf"),), (float("nan"),)]
    got = values(spark, rows, "d double", text.semantic_score(F.col("d")))
    assert got == [(1.0,), (0.25,), (0.0,), (0.0,)]


def test_times(spark):
    rows = [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),), (None,)]
    got = values(spark, rows, "t timestamp", times.iso_format(F.col("t")), times.bucket_label(F.col("t")))
    assert got[0] == ("2024-01-02T03:04:05", "2024-01-02T03:04:05")
    assert got[1][0] == rows[1][0].isoformat()
    assert got[2][1] == "unknown"
    now = datetime(2024, 1, 8, 12, 30)
    assert times.window_start("1h", now) == (datetime(2024, 1, 8, 11, 30), "hour")
    assert times.window_start("7d", now) == (datetime(2024, 1, 1, 12, 30), "day")
    with pytest.raises(ValueError):
        times.window_start("2h", now)


def test_sequence_stats(spark):
    rows = [(["E1", "", "E2", "E1"],), ([],), (None,)]
    got = values(spark, rows, "t array<string>", seq.sequence_stats(F.col("t")))
    assert [tuple(g[0]) for g in got] == [("E1 E2 E1", 3, 2), ("E0", 1, 1), ("E0", 1, 1)]


def test_ngrams(spark):
    rows = [(["E1", "x", "e2", "E3"],), (["E1"],), ([],)]
    got = values(spark, rows, "t array<string>", seq.ngrams(F.col("t"), 3))
    assert got[0][0] == ["E1", "e2", "E3", "E1 e2", "e2 E3", "E1 e2 E3"]
    assert got[1][0] == ["E1"]
    assert got[2][0] == []


def test_first_report(spark):
    at = datetime(2024, 1, 1, 10, 0, 0)
    row = [("ERROR", "h", at, "boom", None, at)]
    schema = "l string, h string, t timestamp, m string, p string, g timestamp"
    cols = [F.col(c) for c in "lhtmpg"]
    context = report.signal_context(F.lit(-0.1234567), F.lit(3), F.lit(2), F.lit("E1 E2 E1"))
    got = values(spark, row, schema, report.rca_signal_markdown(*cols, context=context, system="Watch"))[0][0]
    assert got.startswith("### Root Cause Analysis\n\nWatch anomaly detection flagged a ERROR log from `h`")
    assert "at `2024-01-01T10:00:00`" in got and "Parsed template: `None`" in got
    assert "decision score: `-0.123457`" in got and "length: `3`" in got
    assert got.endswith("_Generated placeholder RCA at 2024-01-01T10:00:00+00:00._")


def test_fallback_report_without_runbooks(spark):
    rows = [("", "boom", [])]
    cols = [F.col(c) for c in "sml"]
    got = values(spark, rows, "s string, m string, l array<string>", report.rca_fallback_markdown(*cols))[0][0]
    assert "unknown template sequence" in got and "guidance" not in got
    prompt = values(spark, rows, "s string, m string, l array<string>", report.rca_prompt(*cols))[0][0]
    assert "No runbook matches were found." in prompt and "Template sequence: unknown" in prompt
