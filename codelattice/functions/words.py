"""Words of questions and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no search looks for, words that no question is about, and words that name an action rather than its subject.
STOP_WORDS = ("with", "from", "that", "this", "have", "will", "should", "would", "could", "need", "want")
QUESTION_WORDS = ("what", "how", "where", "is", "are", "the", "a", "an", "in", "on", "for", "to", "of", "does", "do", "this", "that", "which", "who", "when")
ACTION_WORDS = (
    "maintenance", "search", "create", "update", "delete", "merge", "wizard", "inquiry", "report", "list", "view", "edit", "add", "replace", "contact", "history", "status", "detail",
    "summary", "lookup", "entry", "results", "conflicts", "process", "manage", "import", "export", "validate", "verify", "approve", "reject",
)


def keywords(text: Column, most: int = 10, longer: int = 3) -> Column:
    """The words between white space that are longer than ``longer`` and no stop words, in lower case, distinct, in order."""
    words = F.split(F.lower(text), r"\s+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer) & ~F.array_contains(stop, w))), 1, most)


def compound(words: Column) -> Column:
    """struct(subject, actions): the words that name no action, joined, and those that do, in lower case."""
    actions, low = F.array(*map(F.lit, ACTION_WORDS)), F.transform(words, F.lower)
    return F.struct(
        F.array_join(F.filter(low, lambda w: ~F.array_contains(actions, w)), "").alias("subject"),
        F.filter(low, lambda w: F.array_contains(actions, w)).alias("actions"),
    )


# Types of questions by the phrases that they contain, in order.
QUESTIONS = (
    ("what class|what module|what component|list|show me all|what entities", "structural"), ("how does|how is|what happens when|explain how", "functional"),
    ("where is|where are|find|locate|which file", "locational"), ("depends on|dependency|uses|calls|imports|what calls|who calls", "dependency"),
    ("pattern|design|architecture|structure", "pattern"),
)


def question_type(text: Column) -> Column:
    from codelattice.functions.ladders import first_match

    return first_match(F.lower(text), QUESTIONS, "general")


def question_keywords(text: Column, most: int = 10) -> Column:
    """Words of a question that it is about, then quoted terms, CamelCase and snake_case names; of words
    that differ in case only the first, ``most`` at most."""
    words = F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"), F.lit(1))
    stop = F.array(*map(F.lit, QUESTION_WORDS))
    every = F.concat(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w))), identifiers(text))
    first = F.filter(every, lambda w, i: F.array_position(F.transform(every, F.lower), F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


def identifiers(text: Column) -> Column:
    """Quoted terms, CamelCase and snake_case names, in that order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"[\"']([^\"']+)[\"']", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+_[a-z_]+)\b")]
    return F.concat(*found)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def cut_to_tokens(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, tokens * 4)


def head_and_tail(text: Column, longest: int = 1000, part: int = 500) -> Column:
    """Long texts keep their first and last ``part`` characters."""
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(part)), F.lit("\n...\n"), F.right(text, F.lit(part)))).otherwise(text)
