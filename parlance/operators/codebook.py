"""A codebook as data: nested JSON with intents, fields and rules, from which prompts, roles and the check of annotations are made.

    {"version": "...",
     "intents": [{"name", "definition", "escalation_role", "confusable_with": [...]}],
     "boundary_rules": [{"id", "test"}],
     "fields": [{"name", "values": [...], "blank_if": {"field", "value"}}],
     "cross_rules": [{"id", "field", "value", "other", "allowed": [...], "refused": [...]}]}

A field may be blank only where another has the value of its ``blank_if``.  A cross rule says which values another field may have
(``allowed``, where given) or must not have (``refused``) where a field has a value.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """version string, intents array<struct<name: string, definition: string, escalation_role: string, confusable_with: array<string>>>, boundary_rules array<struct<id: string, test: string>>,
    fields array<struct<name: string, values: array<string>, blank_if: struct<field: string, value: string>>>, cross_rules array<struct<id: string, field: string, value: string, other: string, allowed: array<string>, refused: array<string>>>"""


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """One row with the nested parts of a codebook file; fails where the file isn't JSON."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parsed(json: DataFrame, column: str = "json") -> DataFrame:
    """One row as of ``read_codebook`` for each codebook that is held as text."""
    return json.select(F.from_json(column, SCHEMA, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def part(book: DataFrame, name: str) -> DataFrame:
    """The entries of one part with their place in the codebook."""
    return book.select(F.posexplode(name).alias("place", "x")).select("place", "x.*")


def prompt_parts(book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intents (place, name, definition, confusable) and rules (place, id, test) as ``decisions.codebook_prompt`` takes them."""
    intents = part(book, "intents").select("place", "name", "definition", F.coalesce("confusable_with", F.array().cast("array<string>")).alias("confusable"))
    return intents, part(book, "boundary_rules")


def roles(book: DataFrame) -> dict[str, str]:
    """The escalation role of each intent."""
    return {r.name: r.escalation_role for r in part(book, "intents").collect()}  # one row an intent


def checks(book: DataFrame) -> dict[tuple[str, str], Column]:
    """What is wrong with a row, by (field, error), from the fields and cross rules of the codebook; blanks around values don't count.

    Errors are ``empty``, ``domain`` and the ids of cross rules.
    """
    said = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    out: dict[tuple[str, str], Column] = {}
    for f in part(book, "fields").orderBy("place").collect():  # one row a field
        blank = said(f.name) == ""
        spared = said(f.blank_if.field) == f.blank_if.value if f.blank_if else F.lit(False)
        out[f.name, "empty"] = blank & ~spared
        out[f.name, "domain"] = ~blank & ~said(f.name).isin(*f["values"])
    for r in part(book, "cross_rules").orderBy("place").collect():  # one row a rule
        wrong = F.lit(False)
        if r.allowed is not None:
            wrong = wrong | ~said(r.other).isin(*r.allowed)
        if r.refused is not None:
            wrong = wrong | said(r.other).isin(*r.refused)
        out[r.other, r.id] = (said(r.field) == r.value) & wrong
    return out


def violations(rows: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """(key, field, error) for everything wrong with the annotated ``rows``; a row whose fields are all blank isn't annotated yet."""
    found = checks(book)
    fields = {f for f, error in found if error == "empty"}
    filled = reduce(or_, (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "" for f in sorted(fields)), F.lit(False))
    each = F.array_compact(F.array(*(F.when(wrong, F.struct(F.lit(f).alias("field"), F.lit(error).alias("error"))) for (f, error), wrong in found.items())))
    return rows.where(filled).select(key, F.explode(each).alias("x")).select(key, "x.*")
