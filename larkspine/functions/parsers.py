"""Parsers of what language models answer: pure expressions, so they run where the answers are."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspine.functions.text import jaccard, jtrim, word_set

#: Names and words that answers are searched for.
INTENTS = ("FACTUAL", "DEFINITION", "HOW_TO", "COMPARISON", "LIST", "INFORMATIONAL")
GRADES = ("CORRECT", "AMBIGUOUS", "INCORRECT")
HIGH = ("high", "relevant", "相关")
MEDIUM = ("medium", "一般")
LOW = ("low", "irrelevant", "不相关")
NEGATED = ("irrelevant", "not relevant", "不相关")
LABELS = ("相关内容", "提取的内容", "以下是")
QUERY_LABEL, FILTER_LABEL, NOTHING = "语义查询", "过滤条件", ("无", "none")


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(operator.or_, [c.contains(w) for w in words])


def rating(answer: Column, strict_parity: bool = False) -> Column:
    """A score from 0 to 10: the first number, else by words (8, 5, 2), else 5.

    Negated words count as low; with ``strict_parity`` "irrelevant" counts by the "relevant" in it.
    """
    number = F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1)
    low = F.lower(answer)
    words = F.when(_has(low, HIGH), 8.0).when(_has(low, MEDIUM), 5.0).when(_has(low, LOW), 2.0).otherwise(5.0)
    words = words if strict_parity else F.when(_has(low, NEGATED), 2.0).otherwise(words)
    return F.when(number != "", F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.nullif(number, F.lit("")).cast("double")))).otherwise(words)


def grade(answer: Column) -> Column:
    """struct<grade, reason> of ``grade|reason``; a grade found in the first part otherwise, AMBIGUOUS if there is none."""
    parts = F.split(jtrim(answer), r"\|", 2)
    head = F.upper(jtrim(parts[0]))
    guess = F.when(head.contains("CORRECT") & ~head.contains("INCORRECT"), "CORRECT").when(head.contains("INCORRECT") | head.contains("不相关"), "INCORRECT").otherwise("AMBIGUOUS")
    return F.struct(F.when(head.isin(*GRADES), head).otherwise(guess).alias("grade"), F.coalesce(jtrim(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("reason"))


def strip_fence(answer: Column) -> Column:
    """Without code fences, with or without a language."""
    return jtrim(F.regexp_replace(F.regexp_replace(jtrim(answer), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def sql_of(answer: Column) -> Column:
    return jtrim(F.regexp_replace(strip_fence(answer), r"(?i)^sql\s*:\s*", ""))


def clean_extract(answer: Column) -> Column:
    """Without opening labels and code fences."""
    out = answer
    for label in LABELS:
        out = F.regexp_replace(out, f"^({label}[:：]?\\s*)", "")
    return jtrim(F.regexp_replace(out, r"```\w*\n?", ""))


def structured(answer: Column) -> Column:
    """struct<sort_by, order, limit, query> of a JSON answer, with defaults."""
    raw = F.from_json(strip_fence(answer), "sortBy string, order string, limit int, query string")
    return F.struct(
        F.when(raw["sortBy"].isin("date", "view_count", "length", "score", "price"), raw["sortBy"]).alias("sort_by"),
        F.coalesce(F.lower(raw["order"]), F.lit("desc")).alias("order"),
        F.coalesce(raw["limit"], F.lit(1)).alias("limit"),
        raw["query"].alias("query"),
    )


def _lines(answer: Column) -> Column:
    return F.transform(F.split(answer, "\n"), jtrim)


def variations(answer: Column) -> Column:
    """Lines without their numbering, longer than 5 characters."""
    return F.filter(F.transform(_lines(answer), lambda x: jtrim(F.regexp_replace(x, r"^\d+[.、)]\s*", ""))), lambda x: F.length(x) > 5)


def bullets(answer: Column, query: Column) -> Column:
    """Lines that open with a bullet, without it, other than the query."""
    marked = F.filter(_lines(answer), lambda x: x.rlike("^[-•]"))
    return F.filter(F.transform(marked, lambda x: jtrim(F.regexp_replace(x, r"^[-•]\s*", ""))), lambda x: (x != "") & (x != query))


def keywords(answer: Column) -> Column:
    return F.filter(_lines(answer), lambda x: (x != "") & (F.length(x) <= 20))


def intent(answer: Column) -> Column:
    name = F.regexp_replace(F.upper(answer), "[^A-Z_]", "")
    return F.when(name.isin(*INTENTS), name).otherwise("INFORMATIONAL")


def rewrite_guard(query: Column, rewritten: Column, most: float = 3.0, least: int = 3) -> Column:
    """The query where its rewriting is over ``most`` times as long, or shorter than ``least``."""
    text = jtrim(rewritten)
    return F.when((F.length(text) > most * F.length(query)) | (F.length(text) < least), query).otherwise(text)


def step_back_guard(query: Column, answer: Column) -> Column:
    """Null where the broader question equals the query or contains its first 10 characters."""
    text = jtrim(answer)
    return F.when((text != query) & ~text.contains(F.substring(query, 1, 10)), text)


def drop_similar(query: Column, found: Column, most: float = 0.8) -> Column:
    """Variations whose words are no more similar to the query's than ``most``."""
    return F.filter(found, lambda v: jaccard(word_set(v), word_set(query)) <= most)


def relevant(answer: Column) -> Column:
    """Whether an answer says relevant and not the opposite; an answer that is missing keeps the document."""
    low = F.lower(answer)
    return F.coalesce(_has(low, ("relevant", "相关")) & ~_has(low, NEGATED), F.lit(True))


def self_query(answer: Column) -> Column:
    """struct<query, conditions> of an answer with a query line and a block of ``- field: operator=value`` lines.

    Unknown operators, gte and lte among them, count as EQUALS.
    """
    none = lambda c: F.lower(c).isin(*NOTHING)
    query = jtrim(F.regexp_extract(answer, rf"(?s){QUERY_LABEL}[:：]\s*(.+?)(?:\n|{FILTER_LABEL}|$)", 1))
    block = jtrim(F.regexp_extract(answer, rf"(?s){FILTER_LABEL}[:：](.+?)(?:\n\n|$)", 1))
    line = r"-?\s*(\w+)[:：]\s*(\w+)=(.+?)(?:\n|$)"
    found = F.regexp_extract_all(F.when(none(block), F.lit("")).otherwise(block), F.lit(line), F.lit(0))
    names = {"ne": "NOT_EQUALS", "contains": "CONTAINS", "gt": "GREATER_THAN", "lt": "LESS_THAN", "in": "IN"}

    def one(text: Column) -> Column:
        op = F.lower(F.regexp_extract(text, line, 2))
        name = F.lit("EQUALS")
        for k, v in names.items():
            name = F.when(op == k, v).otherwise(name)
        return F.struct(F.regexp_extract(text, line, 1).alias("key"), name.alias("op"), jtrim(F.regexp_extract(text, line, 3)).alias("value"))

    conditions = F.filter(F.transform(found, one), lambda c: c["value"] != "")
    return F.struct(F.when(none(query), F.lit("")).otherwise(query).alias("query"), conditions.alias("conditions"))
