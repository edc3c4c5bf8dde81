"""Runbook search: nearest vectors, then word overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslog.functions import text
from opslog.operators.ranking import top_k_per_query
from opslog.operators.skew import SPLIT_ROWS, hot_of, skew_join
from opslog.operators.vectors import DIGITS, hashed_bag, knn_l2
from opslog.session import stage

TOP_K = 3
WIDEN = 5


def attach_runbooks(candidates: DataFrame, runbooks: DataFrame, split_rows: int = SPLIT_ROWS,
                    hot: DataFrame | None = None) -> DataFrame:
    """Join candidates to their runbooks; candidates without one are dropped.

    Few runbooks may answer most incidents, so popular ones are split.
    """
    books = runbooks.withColumnRenamed("id", "runbook_id")
    return skew_join(candidates, books, "runbook_id", "query_id", "inner", split_rows, hot)


def rerank(candidates: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Score = 5 * word overlap + 1 / (1 + distance); best ``top_k`` per query."""
    lexical = text.lexical_score(F.col("query_tokens"), F.col("tokens"))
    score = text.combined_score(lexical, text.semantic_score(F.col("distance")))
    scored = candidates.select("query_id", "runbook_id", "distance", F.round(score, DIGITS).alias("score"))
    return top_k_per_query(
        scored, "query_id", [F.desc("score"), F.col("distance"), F.col("runbook_id")], top_k
    )


def search_runbooks(queries: DataFrame, runbooks: DataFrame, vectors: DataFrame, top_k: int = TOP_K,
                    encoder=hashed_bag, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Best runbooks of every incident: query_id, runbook_id, distance, score, rank.

    ``queries`` holds query_id, sequence and raw_message, and may bring its own
    embedding. Incidents repeat messages, so each different embedding is searched
    once and each different pair of words and embedding ranked once. The candidates meet only the token
    sets of the runbooks; their texts are never shuffled here.
    """
    queries = queries.withColumn("_query", text.query_text(F.col("sequence"), F.col("raw_message")))
    if "embedding" not in queries.columns:
        queries = queries.withColumn("embedding", encoder(F.col("_query")))
    asked = stage(
        queries.withColumn("query_tokens", F.array_sort(text.tokenize(F.col("_query")))).select(
            "query_id", "query_tokens", "embedding", F.xxhash64("query_tokens", "embedding").alias("_key")
        ),
        "queries",
    )
    points = stage(
        asked.groupBy("_key", "query_tokens", "embedding").agg(F.min("query_id").alias("point")).withColumn(
            "_place", F.xxhash64("embedding")), "points"
    )
    places = stage(points.groupBy("_place", "embedding").agg(F.count("*").alias("n")).withColumn(
        "place", F.monotonically_increasing_id()), "places")
    near = stage(knn_l2(places.select("place", "embedding"), vectors, WIDEN * top_k, "place").drop("rank"), "near")
    lists = near.groupBy("place").agg(F.collect_list(F.struct("runbook_id", "distance")).alias("near")).join(
        places.select("place", "_place", F.col("embedding").alias("_embedding")), "place")

    def found(rows: DataFrame) -> DataFrame:
        """An embedding may serve many questions, so its list of bounded length is given to each."""
        return skew_join(rows, lists, "_place", "point", "inner", split_rows).where(
            F.col("embedding") == F.col("_embedding")).select(F.col("point").alias("query_id"), "query_tokens", F.inline("near"))

    # a query id that comes with several questions has the nearest of all of them
    repeated = stage(points.groupBy("point").agg(F.count("*").alias("n")).where("n > 1").select("point"), "repeated")
    if repeated.isEmpty():
        candidates = found(points)
    else:
        several = points.join(repeated, "point", "left_semi")
        shared = top_k_per_query(found(several), "query_id", [F.col("distance"), F.col("runbook_id")], WIDEN * top_k)
        candidates = found(points.join(repeated, "point", "left_anti")).unionByName(
            shared.select("query_id", "runbook_id", "distance").join(
                several.select(F.col("point").alias("query_id"), "query_tokens"), "query_id"))
    tokens = runbooks.select(
        "id",
        text.tokenize(text.runbook_text(F.col("title"), F.col("category"), F.col("content"))).alias("tokens"),
    )
    asks = near.join(places.select("place", "n"), "place").groupBy("runbook_id").agg(F.sum("n").alias("_n"))
    hot = hot_of(asks, "runbook_id", "_n", split_rows)
    best = rerank(attach_runbooks(candidates, tokens, split_rows, hot), top_k)
    lists = best.groupBy("query_id").agg(
        F.collect_list(F.struct("runbook_id", "distance", "score", "rank")).alias("best")  # top_k entries
    ).withColumnRenamed("query_id", "point")
    answers = points.join(lists, "point").select(
        "_key", F.col("query_tokens").alias("_tokens"), F.col("embedding").alias("_embedding"), "best"
    )
    joined = skew_join(asked, answers, "_key", "query_id", "inner", split_rows).where(
        (F.col("query_tokens") == F.col("_tokens")) & (F.col("embedding") == F.col("_embedding"))
    )
    return joined.select("query_id", F.inline("best"))
