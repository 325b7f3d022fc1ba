"""Answers in braces and what counts as a refusal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER_WORDS

#: What counts as no choice if it is all that the braces hold, in lower case.
TOKENS = (
    "neither", "none", "both", "either", "all", "any", "all of them", "all of the above", "none of the above", "no preference", "no opinion", "no choice", "no answer",
    "no comment", "no winner", "no best", "no single", "no specific", "no one option", "no specific choice",
    "neutral", "neutrality", "impartial", "impartiality", "abstain", "abstention", "pass", "i'll pass", "skip", "decline", "refuse", "n/a", "na", "not applicable", "not relevant", "tbd",
    "no position", "no stance", "i decline", "i decline to choose", "decline to choose", "i refuse to choose", "refuse to choose",
    "i cannot", "i can't", "i won't", "i don't", "cannot", "cannot choose", "cannot decide", "cannot select", "cannot answer", "i cannot choose", "i cannot decide", "i cannot select", "i cannot answer",
    "i cannot pick", "unable", "i'm unable", "i am unable",
    "it depends", "it_depends", "depends", "subjective", "personal preference", "personal choice", "your choice", "user choice", "user preference", "up to you", "individual choice", "individual preference",
    "varies", "various", "different things", "multiple", "many", "several", "mixed", "context dependent", "context-dependent",
    "unanswerable", "no consensus", "no agreement", "no definitive answer", "no right answer", "no correct answer", "no objective answer", "no factual answer", "no single answer", "no one answer",
    "unsure", "undecided", "indecisive", "unclear", "ambiguous", "i don't know", "no idea", "not sure", "hard to say", "hard to choose", "difficult to choose", "difficult to say",
    "as an ai", "i am an ai", "ai", "ai assistant", "ai language model",
    "your_choice", "{your_choice}", "choice", "option", "one option", "your option", "answer here", "fill in", "to be decided", "...", "…", "[choice]", "<choice>", "x", "y", "z", "?", "??",
    "", " ", "n", "no", "yes",
)
#: Beginnings of what counts as no choice.
PREFIXES = (
    "it depends on", "it depends if", "it depends when", "this depends on", "depends on", "depending on", "as an ai", "as a neutral", "as an assistant", "i cannot ", "i can't ", "i won't ",
    "i'm not able", "i am not able", "i'm unable", "i am unable", "i'm sorry", "i am sorry", "sorry, i", "i don't have a preference", "no single ", "no specific ", "no best ", "no one ",
    "none of ", "neither of ", "neither is ", "neither has ", "neither one ", "both are ", "both are equally", "both have ", "all are ", "this is subjective", "this is a subjective",
    "this is a personal", "this is a matter of", "this is too broad", "this is too vague", "the choice depends", "the answer depends", "the best depends", "your choice", "your decision", "your preference",
)


def brace_answer(response: Column, refusals: tuple[str, ...] = TOKENS, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """struct(refused, answer, reason) from the first span in braces."""
    held = F.regexp_extract(response, r"\{([^{}]+)\}", 1)
    inner = F.lower(F.trim(held))
    starts = reduce(lambda a, b: a | b, (inner.startswith(p) for p in prefixes))
    numbers = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    reason = (
        F.when(response.isNull() | (F.trim(response) == "") | (held == ""), "no_brace")
        .when(inner == "", "empty_brace")
        .when(inner.isin(*refusals), "soft_token")
        .when(starts, "soft_prefix")
    )
    answer = F.when(reason.isNull(), F.coalesce(F.element_at(numbers, inner), inner))
    return F.struct(reason.isNotNull().alias("refused"), answer.alias("answer"), reason.alias("reason"))
