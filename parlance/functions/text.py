"""Text expressions that mean the same in Spark and in RE2-based engines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://[^\s]+"
MENTION = r"@[\p{L}\p{N}_]+"
SIGN_OFF = r"([\^~*\-/]\s?[A-Za-z]{1,3}|-\s?[A-Z][a-z]{2,10})\s*$"
PRIVATE = "dm|direct message|private message|pm us|secured? link"


def bounded(pattern: str) -> str:
    """``pattern`` between word bounds, for tests only: it takes in the neighbouring characters."""
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{pattern})($|[^\p{{L}}\p{{N}}_])"


def has(text: Column, pattern: str) -> Column:
    """Whether lower-cased text holds the pattern as whole words."""
    return F.lower(text).rlike(bounded(pattern))


def masked(text: Column) -> Column:
    """Links and mentions masked, white space collapsed, trimmed, lower-cased."""
    t = F.regexp_replace(F.regexp_replace(text, URL, "<URL>"), MENTION, "<USER>")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def stripped(text: Column) -> Column:
    """Links, mentions and a trailing sign-off removed, white space collapsed, lower-cased."""
    t = F.regexp_replace(F.regexp_replace(text, URL, " "), MENTION, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), SIGN_OFF, "")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """White-space tokens; none for blank text."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


#: Latin letters with marks, and the letters without them.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) == 2)
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)


def shingle_set(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, a blank one none."""

    def grams(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(each))

    return F.transform(F.array(tokens(text)), grams)[0]  # a list of one, so that the tokens are computed once


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 0 where either is empty."""

    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x["a"], x["b"])))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of)[0]


def echoes(reply: Column, source: Column, n: int = 6) -> Column:
    """Whether any n-token window of ``source`` stands in ``reply``, ignoring case."""
    def grams(t: Column, n: int, first: int = 1, last: int = 0) -> Column:
        """Joined runs of n tokens that start at ``first`` or later and end ``last`` tokens before the end or earlier."""
        upto = F.size(t) - (n - 1) - last
        return F.when(upto >= first, F.transform(F.sequence(F.lit(first), F.greatest(upto, F.lit(first))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def found(x: Column) -> Column:
        # a window's inner words stand in the reply as whole words, so texts that share no run of them need no search
        shared = F.arrays_overlap(grams(x["source"], n - 2, 2, 1), grams(x["words"], n - 2))
        return shared & F.exists(grams(x["source"], n), lambda w: F.contains(x["reply"], w))

    low = F.lower(reply)
    once = F.array(F.struct(tokens(F.lower(source)).alias("source"), F.split(low, " ").alias("words"), low.alias("reply")))
    return F.coalesce(F.exists(once, found), F.lit(False))  # a list of one, so that each part is computed once


def first_match(text: Column, families: dict[str, str], otherwise: str) -> Column:
    """The first family, in order, whose pattern the text holds."""
    out = None
    for name, pattern in families.items():
        out = F.when(has(text, pattern), name) if out is None else out.when(has(text, pattern), name)
    return out.otherwise(otherwise)


def matches(text: Column, families: dict[str, str]) -> dict[str, Column]:
    return {name: has(text, pattern) for name, pattern in families.items()}
