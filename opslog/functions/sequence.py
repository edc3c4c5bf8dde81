"""Expressions over template sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Form of a template token and the token of an empty sequence.
TOKEN_PATTERN = "^[eE][0-9]+$"
EMPTY_TOKEN = "E0"


def template_token(template_id: Column) -> Column:
    """``E<id>``, or NULL for an unknown template."""
    return F.concat(F.lit("E"), template_id.cast("string"))


def clean_tokens(tokens: Column) -> Column:
    """Drop empty tokens; an empty sequence becomes the one empty-sequence token."""
    kept = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(EMPTY_TOKEN)))


def sequence_stats(tokens: Column) -> Column:
    """Struct of the joined sequence, its length and its number of templates."""
    clean = clean_tokens(tokens)
    return F.struct(
        F.array_join(clean, " ").alias("sequence"),
        F.size(clean).alias("seq_len"),
        F.size(F.array_distinct(clean)).alias("unique_templates"),
    )


def term_tokens(tokens: Column) -> Column:
    """The tokens that count as terms, case kept."""
    return F.filter(tokens, lambda t: t.rlike(TOKEN_PATTERN))


def ngrams(tokens: Column, n_max: int) -> Column:
    """All word n-grams of 1 to ``n_max`` tokens, shorter ones first."""
    terms = term_tokens(tokens)

    def of_size(n: int) -> Column:
        starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, n), " "))

    return F.concat(terms, *[of_size(n) for n in range(2, n_max + 1)])
