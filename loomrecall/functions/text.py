"""Tokenisers as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-z0-9_./\\\x{80}-\x{10FFFF}-][A-Za-z0-9_./\\:\x{80}-\x{10FFFF}-]*"
PART = r"[_\-.:]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: ``$`` would also match before a line separator, which runs may hold.
NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)\z"
#: Runs without a match are plain words: no separator, digit or camel boundary.
SPECIAL = r"[_\-./\\:0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"
IDENTIFIER = r"[_\-.:]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"


def ascii_lower(text: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def bow_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, two characters at least; null gives none."""
    cleaned = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(cleaned, " "), lambda t: F.length(t) >= 2)


def token_kind(run: Column) -> Column:
    return (
        F.when(run.rlike(r"[/\\]"), "path").when(run.rlike(NUMBER), "number").when(run.rlike(IDENTIFIER), "identifier").otherwise("word")
    )


def standard_tokens(text: Column, parts: bool = True) -> Column:
    """Array of (text, kind): every run, and after an identifier that is no option flag
    its parts. The position of a token is its place in the array."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))

    def of(run: Column) -> Column:
        kind = token_kind(run)
        body = F.when(kind == "number", run).otherwise(F.regexp_replace(run, r"[.:]+\z", ""))
        whole = F.array(F.struct(ascii_lower(body).alias("text"), kind.alias("kind")))
        if not parts:
            return whole
        pieces = F.filter(F.split(body, PART), lambda p: p != "")
        single = (F.size(pieces) == 1) & (F.element_at(pieces, 1) == body)
        inner = F.transform(
            pieces,
            lambda p: F.struct(ascii_lower(p).alias("text"), F.when(p.rlike(NUMBER), "number").otherwise("word").alias("kind")),
        )
        split = (kind == "identifier") & ~body.rlike("^-[^0-9]") & ~single & (body != "")
        return F.when(split, F.concat(whole, inner)).otherwise(whole)

    def fast(run: Column) -> Column:
        """Most runs are plain words and need one match only."""
        plain = F.array(F.struct(ascii_lower(run).alias("text"), F.lit("word").alias("kind")))
        return F.when(run.rlike(SPECIAL), of(run)).otherwise(plain)

    return F.filter(F.flatten(F.transform(runs, fast)), lambda t: t["text"] != "")


def standard_terms(text: Column) -> Column:
    return F.transform(standard_tokens(text), lambda t: t["text"])


def passthrough_terms(text: Column) -> Column:
    """White-space split, case kept."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def char_ngrams(token: Column, n: int) -> Column:
    size = F.length(token)
    return F.when(size < n, F.array(token)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(token, i, F.lit(n)))
    )
