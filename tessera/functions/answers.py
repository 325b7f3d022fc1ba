"""Forms of short answers, and when two of them are the same answer; all run inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, NUMBER_WORDS, STOPWORDS, stem

#: Number words and ordinals that stand for digits in answers.
COUNT_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty").split()
ORDINAL_WORDS = ("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth").split()
ORDINALS = {f"{i}{'st' if i == 1 else 'nd' if i == 2 else 'rd' if i == 3 else 'th'}": w for i, w in enumerate(ORDINAL_WORDS, 1)}
#: Nouns and the verbs that they count as.
VERBS = dict(pair.split(":") for pair in """
defense:defend offense:offend pretense:pretend expense:expend decision:decide incision:incise destruction:destroy construction:construct production:produce reduction:reduce
introduction:introduce instruction:instruct obstruction:obstruct deduction:deduce education:educate investigation:investigate preparation:prepare examination:examine explanation:explain
translation:translate evaluation:evaluate violation:violate creation:create imagination:imagine operation:operate presentation:present transportation:transport registration:register
preservation:preserve concentration:concentrate comparison:compare competition:compete completion:complete selection:select election:elect rejection:reject protection:protect
detection:detect infection:infect correction:correct connection:connect permission:permit admission:admit submission:submit transmission:transmit emission:emit omission:omit
expansion:expand extension:extend intention:intend ascension:ascend discussion:discuss discovery:discover recovery:recover delivery:deliver argument:argue agreement:agree judgment:judge
encouragement:encourage improvement:improve achievement:achieve involvement:involve requirement:require treatment:treat enjoyment:enjoy settlement:settle development:develop movement:move
payment:pay removal:remove approval:approve denial:deny trial:try refusal:refuse survival:survive arrival:arrive betrayal:betray censorship:censor membership:member sponsorship:sponsor
leadership:lead ownership:own partnership:partner writer:write speaker:speak reader:read teacher:teach advisor:advise investor:invest creator:create performer:perform publisher:publish
""".split())
#: Rows of a lemma table that may be written into an expression.
MOST_LEMMAS = 5000
ANSWER_TOKEN = "\\b(?:" + "|".join(ORDINALS) + ")\\b|[a-zA-Z]+|\\d+"

Lemma = Callable[[Column], Column]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def regular(token: Column) -> Column:
    """The singular of a regular plural; what stands in for a lemma table where none is given."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return F.when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & token.rlike("(ss|sh|ch|x|z)es$"), cut(2)).when((n > 3) & token.endswith("s") & ~token.rlike("(ss|us|is)$"), cut(1)).otherwise(token)


def table_lemma(rows: list[tuple[str, str, str]]) -> Lemma:
    """A lemma function from rows (word, noun lemma, verb lemma): the verb's if only it differs from the word, the noun's if only it
    does, the shorter (then smaller) if both do. Words outside the table are read by `regular`. Larger tables are joined by the caller."""
    if len(rows) > MOST_LEMMAS:
        raise ValueError(f"more than {MOST_LEMMAS} lemmas: join the table instead")
    best = {}
    for word, noun, verb in rows:
        changed = sorted({x for x in (noun, verb) if x and x != word}, key=lambda x: (len(x), x))
        best[word] = changed[0] if changed else word
    return (lambda t: F.coalesce(_lookup(best, t), regular(t))) if best else regular


def lemma_tokens(answer: Column, lemma: Lemma = regular) -> Column:
    """Tokens of an answer: hyphens part words, ordinals and small numbers become words, nouns of VERBS their verbs."""
    low = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), "[-_]", " "))
    found = F.regexp_extract_all(low, F.lit("(" + ANSWER_TOKEN.replace(r"\b", EDGE) + ")"), 1)
    numbers = {str(i): w for i, w in enumerate(COUNT_WORDS)} | ORDINALS

    def form(t: Column) -> Column:
        own = lemma(t)
        return F.when(t.rlike("^[a-z]+$"), F.coalesce(_lookup(VERBS, own), own)).otherwise(F.coalesce(_lookup(numbers, t), t))

    return F.transform(found, form)


def forms(answer: Column, lemma: Lemma = regular) -> Column:
    """struct(words, stems): what same() compares. Compute it once a row, then match."""
    words = lemma_tokens(answer, lemma)
    return F.struct(words.alias("words"), F.transform(words, stem).alias("stems"))


def same(a: Column, b: Column) -> Column:
    """Whether two forms are the same answer: equal lemmas, equal stems, or one word set inside the other; never for empty ones."""
    wa, wb = a["words"], b["words"]
    inside = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return (F.size(wa) > 0) & (F.size(wb) > 0) & ((wa == wb) | (a["stems"] == b["stems"]) | inside)


def surface_match(a: Column, b: Column, lemma: Lemma = regular) -> Column:
    return same(forms(a, lemma), forms(b, lemma))


def canonical(answer: Column, lemma: Lemma = regular) -> Column:
    """Lower-case lemmas without stop words, joined by a space; the lower-case answer if nothing is left."""
    found = F.filter(F.regexp_extract_all(F.lower(answer), F.lit("([a-zA-Z0-9]+)"), 1), lambda t: ~t.isin(*STOPWORDS))
    joined = F.array_join(F.transform(found, lambda t: F.when(t.rlike("^[a-z]+$"), lemma(t)).otherwise(t)), " ")
    return F.when(joined == "", F.lower(answer)).otherwise(joined)


def cluster_match(response: Column, cluster: Column, lemma: Lemma = regular) -> Column:
    """Whether a response belongs to a cluster (canonical, surface_forms map, lemma_keys): by an exact or case-blind surface form, or
    as the same answer as its name or one of its keys."""
    trimmed, own = F.trim(response), forms(response, lemma)
    texts = F.map_keys(cluster["surface_forms"])
    exact = F.array_contains(texts, response) | F.exists(texts, lambda t: F.lower(F.trim(t)) == F.lower(trimmed))
    near = F.exists(F.concat(F.array(cluster["canonical"]), cluster["lemma_keys"]), lambda k: same(forms(k, lemma), own))
    return (trimmed != "") & (exact | near)


def digits(answer: Column) -> Column:
    """The answer, or the digits that its number word stands for."""
    return F.coalesce(_lookup(NUMBER_WORDS, answer), answer)


def plain(answer: Column) -> Column:
    """Lower case without marks, single spaces, number words as digits; null as empty."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return digits(F.trim(F.regexp_replace(F.regexp_replace(low, "[.,;:!?\"'`]", ""), r"\s+", " ")))


def key_words(answer: Column) -> Column:
    """Distinct words of a prompt that tell it from others, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, ("choose", "a", "random", "of", "the", "type", "kind")))))


def pair_key(a: Column, b: Column) -> Column:
    """One key of an unordered pair."""
    return F.concat(F.least(a, b), F.lit("\x1f"), F.greatest(a, b))
