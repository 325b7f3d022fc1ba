"""Checks of answers against labels and of texts against constraints; all run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, squad

__all__ = ["after_thinking", "best_f1", "boxed", "braces", "last_number", "number_match", "squad", "tag", "tagged_f1", "token_f1", "words"]

NUMBER = r"([-+]?[0-9]*\.[0-9]+|[0-9]+)"


def after_thinking(text: Column) -> Column:
    """What follows the last end of thinking, without answer tags."""
    out = F.substring_index(text, "</think>", -1)
    return F.trim(F.replace(F.replace(out, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))


def last_number(text: Column) -> Column:
    """The last number of a text, thousands separators dropped; the text itself if it has none."""
    bare = F.regexp_replace(text, "([0-9]),([0-9])", "$1$2")
    found = F.regexp_extract_all(bare, F.lit(NUMBER), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(bare)


def number_match(text: Column, label: Column) -> Column:
    return F.lower(last_number(text)) == F.lower(label)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the tokens of two normalised texts, as multisets; 0 if either is empty."""
    wa, wb = words(squad(a)), words(squad(b))
    count = lambda of, w: F.size(F.filter(of, lambda x: x == w))
    both = F.aggregate(F.array_intersect(wa, wb), F.lit(0), lambda n, w: n + F.least(count(wa, w), count(wb, w)))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(wa) + F.size(wb)))


def best_f1(text: Column, labels: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(labels, lambda x: token_f1(text, x))), F.lit(0.0))


def tag(text: Column, name: str) -> Column:
    """What a tag holds; empty without it."""
    return F.trim(F.regexp_extract(text, f"(?s)<{name}>(.*?)</{name}>", 1))


def tagged_f1(text: Column, labels: Column) -> Column:
    """0 without an answer tag or with an empty one, 0.1 if no token is right, else the best F1."""
    answer = tag(text, "answer")
    score = best_f1(answer, labels)
    return F.when(answer == "", 0.0).when(score == 0, 0.1).otherwise(score)


def braces(depth: int = 4) -> str:
    """A pattern of balanced braces' content, nested up to `depth`."""
    out = r"[^{}]*"
    for _ in range(depth):
        out = r"(?:[^{}]|\{" + out + r"\})*"
    return out


def boxed(text: Column) -> Column:
    """The content of the last box, null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\\boxed\{(" + braces() + r")\}"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))
