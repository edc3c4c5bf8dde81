"""Text expressions: trimming, masking, tokens, snippets, search texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space, as text and as a
# pattern, and the limits of tokens and snippets.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_PATTERN = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
MIN_TOKEN = 3
SNIPPET_CHARS = 220
PROMPT_CHARS = 800
WILDCARD = "<*>"

# Variable parts of a message, masked in this order.
MASKS = (
    "blk_-?[0-9]+",
    "/?[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+(:[0-9]+)?",
    "[0-9]+([.][0-9]+)?",
)


def strip(text: Column) -> Column:
    """Trim all white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Replace each run of white space by one blank and trim."""
    return F.btrim(F.regexp_replace(text, WHITESPACE_PATTERN, " "), F.lit(" "))


def snippet(content: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = collapse(content)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def mask_template(message: Column) -> Column:
    """Replace block ids, addresses and numbers by the wildcard; all of them have a digit."""
    masked = message
    for pattern in MASKS:
        masked = F.regexp_replace(masked, pattern, WILDCARD)
    return F.when(message.rlike("[0-9]"), masked).otherwise(message)


def tokenize(text: Column) -> Column:
    """Different lower-case ASCII words of three characters or more; NULL has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= MIN_TOKEN))


def lexical_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """Share of the query's tokens that the document holds; 0 without any."""
    # Spark hashes the second array, so the short one goes there.
    shared = F.size(F.array_intersect(doc_tokens, query_tokens)).cast("double")
    return F.when(F.size(query_tokens) > 0, shared / F.size(query_tokens)).otherwise(F.lit(0.0))


def runbook_text(title: Column, category: Column, content: Column) -> Column:
    """Text for word overlap: the parts that are not empty."""
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in (title, category, content)])


def runbook_search_text(title: Column, category: Column, content: Column) -> Column:
    """Text that is embedded for a runbook."""
    return F.concat(F.lit("Title: "), title, F.lit("\nCategory: "), category, F.lit("\n"), content)


def query_text(sequence: Column, message: Column) -> Column:
    """Text that is embedded and tokenized for an incident."""
    return F.concat(F.lit("Template sequence: "), sequence, F.lit("\nProblem message: "), message)


def semantic_score(distance: Column) -> Column:
    finite = distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) != float("inf"))
    return F.when(finite, 1.0 / (1.0 + distance)).otherwise(F.lit(0.0))


def combined_score(lexical: Column, semantic: Column) -> Column:
    return lexical * 5.0 + semantic
