"""What a passage is (formula, code, stock phrase, list), and whether a text repeats itself block by block."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Signs and shapes of formulas and code.
SIGNS = "=+-*/^()[]{}<>|&~!@#$%\\"
FORMULA = (r"\w+\([^)]*\)", r"\w+\s*=\s*\w+", r"\d+/\d+", r"[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*", r"[a-zA-Z_]\w*\s*[=<>!]+\s*[a-zA-Z_]\w*")
#: Beginnings of statements, read without regard to case.
STATEMENT = (
    r"^import\s+", r"^from\s+\w+\s+import", r"^return\s+", r"^return\s+\w+", r"^\w+\s*\+\s*=\s*\d+", r"^\w+\s*-\s*=\s*\d+", r"^\w+\s*\*\s*=\s*\d+", r"^\w+\s*/\s*=\s*\d+",
    r"^for\s+", r"^while\s+", r"^if\s+", r"^def\s+", r"^class\s+", r"^\w+\.\w+\(", r"^\w+\s*=\s*\w+\(",
)
#: An opening bracket that stays open, a closing one that was never opened, and a closed pair.
OPEN, CLOSED_ONLY, PAIRED = r"[\(\[\{][^\)\]\}]*$", r"^[^\(\[\{]*[\)\]\}]", r"[\(\[\{][^\(\[\{\)\]\}]*[\)\]\}]"
#: Shapes of longer formulas.
COMPLEX = (
    r"math\.\w+\([^)]*\)", r"\w+\*\*[0-9]+", r"[0-9]+\s*[+\-*/]\s*[0-9]+", r"[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*", r"def\s+\w+\([^)]*\):", r"lambda\s+[^:]+:", r"\[[^\]]*for[^\]]*\]",
    r"\{[^}]*for[^}]*\}", r"\([^)]*for[^)]*\)",
)
#: What a text must hold one of to match the shape in the same place.
COMPLEX_MARKS = (("math.",), ("**",), tuple("+-*/"), tuple("+-*/"), ("def",), ("lambda",), ("[",), ("{",), ("(",))
#: Phrases; a text that holds one anywhere counts as short.
PHRASES = (
    "not sure", "wait no", "i think", "maybe", "probably", "yes", "no", "ok", "okay", "right", "wrong", "correct", "incorrect", "true", "false", "good", "bad", "nice", "great", "awesome", "terrible",
    "wow", "oh", "hmm", "um", "uh", "well", "so", "now", "then", "here", "there", "this", "that", "these", "those", "it", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "can", "cannot", "cant", "dont", "doesnt", "isnt", "arent", "second < b", "we can use:", "we can use", "first < a", "third < c", "fourth < d", "a < b", "b < c", "c < d",
    "d < e", "e < f", "f < g", "g < h", "x < y", "y < z", "i < j", "j < k", "k < l", "l < m", "m < n", "n < o", "o < p", "p < q", "q < r", "r < s", "s < t", "t < u", "u < v", "v < w", "w < x",
    "return none", "return true", "return false", "return 0", "return 1", "return -1", "return null", "return undefined",
)
COMPARISON, CODE_WORDS = r"^\w+\s*[<>]\s*\w+$", ("import", "from", "return", "def", "class", "if", "for", "while")
#: Words that open a step of an argument.
TRANSITIONS = ("alternatively,", "therefore,", "however,")
NUMBERED, BULLET = r"^\d+\.\s", r"^[\-\*•]\s"

_any = lambda patterns, flags=0: re.compile("|".join(f"(?:{p})" for p in patterns), flags)
_STATEMENT, _COMPLEX = _any(STATEMENT, re.I), [(m, re.compile(p)) for m, p in zip(COMPLEX_MARKS, COMPLEX, strict=True)]
_PHRASES = re.compile("|".join(map(re.escape, PHRASES)))
_OPEN, _CLOSED, _PAIRED, _COMPARISON = map(re.compile, (OPEN, CLOSED_ONLY, PAIRED, COMPARISON))
_BRACKET = re.compile(r"[()\[\]{}]")
_SIGNS = re.compile("[" + re.escape(SIGNS) + "]")
_NUMBERED, _BULLET = re.compile(NUMBERED), re.compile(BULLET)


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split("\n\n")) if p]


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split("[.!?]+", text)) if s]


def is_formula(text: str) -> bool:
    return bool(_SIGNS.search(text))  # every shape in FORMULA holds one of the signs


def is_statement(text: str) -> bool:
    """A statement by its beginning, or a fragment with an unmatched bracket and no closed pair."""
    if _BRACKET.search(text) and (_OPEN.search(text) or _CLOSED.match(text)) and not _PAIRED.search(text):
        return True
    return bool(_STATEMENT.match(text))  # all begin with ^


def is_phrase(text: str) -> bool:
    low = text.lower().strip()
    return bool(_PHRASES.search(low)) or bool(_COMPARISON.match(text.strip()) and not any(w in low for w in CODE_WORDS))


def is_complex(text: str) -> bool:
    return any(p.search(text) for marks, p in _COMPLEX if any(m in text for m in marks))


def is_transition(text: str) -> bool:
    return text.lower().strip() in TRANSITIONS


def is_list(text: str) -> bool:
    """Two numbered lines or two bullets."""
    if "\n" not in text:
        return False
    lines = [x.strip() for x in text.split("\n")]
    return len(lines) > 1 and max(sum(bool(p.match(x)) for x in lines) for p in (_NUMBERED, _BULLET)) >= 2


@dataclass
class Repeat:
    block: str
    total: int = 0
    run: int = 0  # longest run of neighbours
    last: int = -2
    now: int = 0

    def see(self, at: int) -> None:
        self.now = self.now + 1 if at == self.last + 1 else 1
        self.total, self.last, self.run = self.total + 1, at, max(self.run, self.now)


def repeats(blocks: list[str], shortest: int) -> list[Repeat]:
    """Blocks of `shortest` code points or more that occur twice, in the order in which they were first seen."""
    seen: dict[str, Repeat] = {}
    for at, b in enumerate(blocks):
        if len(b) >= shortest:
            seen.setdefault(b, Repeat(b)).see(at)
    return [r for r in seen.values() if r.total > 1]


def _excused(block: str) -> bool:
    return is_statement(block) or is_complex(block) or is_transition(block)


def repetition(text: str | None, paragraph: int = 25, sentence: int = 40, consecutive: int = 20) -> tuple[str, str] | None:
    """Why a text repeats itself, and the block: paragraphs come before sentences, the block that was seen first before others.

    Thresholds grow with the kind of block: three times in texts with lists, four times for blocks of several lines, twice for formulas
    (the largest factor counts). Paragraphs never next to each other need twice as many, 30 at most; a stock phrase only counts in runs
    of twice `consecutive`; single words never do."""
    text = text or ""
    listed = 3 if is_list(text) else 1
    for r in repeats(paragraphs(text), 10):
        if (r.run == 1 and len(r.block) < 20) or _excused(r.block):
            continue
        need = paragraph * max(listed, 4 if "\n" in r.block else 1, 2 if is_formula(r.block) else 1)
        if r.total >= (min(2 * need, 30) if r.run == 1 else need):
            return f"paragraph_repeated_{r.total}x", r.block
    for r in repeats(sentences(text), 5):
        if len(r.block.split()) < 2:
            continue
        if is_phrase(r.block):
            if r.run >= 2 * consecutive:
                return f"line_repeated_{r.total}x_consecutive_short_phrase", r.block
            continue
        if _excused(r.block):
            continue
        factor = max(listed, 2 if is_formula(r.block) else 1)
        if r.run >= consecutive * factor:
            return f"line_repeated_{r.total}x_consecutive", r.block
        if r.total >= sentence * factor and len(r.block) >= 10:
            return f"line_repeated_{r.total}x", r.block
    return None


def periodic_run(ids: list[int], longest: int = 13, least: int = 3) -> tuple[int, int, int]:
    """(period, repeats, start) of the run with most repeats of one period of up to `longest` tokens (ties: the shorter period, then the
    earlier start); repeats 0 below `least`."""
    best = (0, 0, 0)
    n = len(ids)
    for period in range(1, min(longest, n // least) + 1):
        at = 0
        while at + period < n:
            if ids[at] != ids[at + period]:
                at += 1
                continue
            end = at
            while end + period < n and ids[end] == ids[end + period]:
                end += 1
            times = (end - at) // period + 1
            if times >= least and times > best[1]:
                best = (period, times, at)
            at = end + 1
    return best
