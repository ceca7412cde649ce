"""Fuzzy row search: strategies as predicates, words of the term combined by all or any."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from minnow.errors import QuerySpecError
from minnow.functions import text as X

# From how many characters on a word is compared fuzzily, and what counts as near.
LEAST_FUZZY, MOST_EDITS, LEAST_DIFFERENCE, LEAST_TRIGRAM = 3, 2, 3, 0.3
MOST_TERM = 100


@dataclass(frozen=True)
class Strategy:
    """How a column is compared with a word, and where that applies."""

    test: Callable[[Column, str], Column]
    #: Characters that a word needs.
    least: int = 1
    #: Whether it is used when a caller names none, provided Spark has the functions it needs.
    usual: bool = False
    needs: tuple[str, ...] = ()
    #: Whether it looks at columns flagged for full text only.
    flagged: bool = False


def near_sound(c: Column, word: str) -> Column:
    return F.coalesce(F.exists(X.split_words(c), lambda w: X.difference(w, F.lit(word)) >= LEAST_DIFFERENCE), F.lit(False))


KNOWN: dict[str, Strategy] = {
    "exact": Strategy(lambda c, w: c == F.lit(w)),
    "prefix": Strategy(lambda c, w: F.startswith(F.lower(c), F.lit(w.lower()))),
    "contains": Strategy(lambda c, w: F.contains(F.lower(c), F.lit(w.lower())), usual=True),
    "soundex": Strategy(lambda c, w: X.soundex_any(c, F.lit(w)), LEAST_FUZZY, True, ("soundex",)),
    "difference": Strategy(near_sound, LEAST_FUZZY, needs=("soundex",)),
    "levenshtein": Strategy(lambda c, w: X.distance_min(c, F.lit(w)) <= MOST_EDITS, LEAST_FUZZY, True, ("levenshtein",)),
    "trigram": Strategy(lambda c, w: X.trigram_similarity(c, F.lit(w)) >= LEAST_TRIGRAM, LEAST_FUZZY, True, ("array_intersect",)),
    "fulltext": Strategy(lambda c, w: F.arrays_overlap(X.tokens(c), X.tokens(F.lit(w))), usual=True, flagged=True),
}
STRATEGIES = tuple(KNOWN)
DEFAULT = tuple(name for name, s in KNOWN.items() if s.usual)


def available(spark: SparkSession) -> tuple[str, ...]:
    """The usual strategies whose functions this session has."""
    return tuple(name for name in DEFAULT if all(spark.catalog.functionExists(f) for f in KNOWN[name].needs))


def words_of(term: str, most: int = 5) -> tuple[str, ...]:
    """Distinct words of a search term."""
    found = tuple(dict.fromkeys(term.split()))
    if not found or len(term) > MOST_TERM:
        raise QuerySpecError(f"a search term has 1 to {MOST_TERM} characters and a word")
    if len(found) > most:
        raise QuerySpecError(f"a search term has at most {most} words")
    return found


def search_test(columns: dict[str, Column], words: Iterable[str], strategies: Iterable[str] = DEFAULT, match: str = "all", fulltext: Iterable[str] | None = None) -> Column:
    """Whether a row has the words (all of them or any), each in some column by some strategy.

    fulltext names the columns flagged for full text, all of them without it. A word that no strategy applies to is
    looked for as a part of the text.
    """
    chosen = tuple(strategies)
    for s in chosen:
        if s not in KNOWN:
            raise QuerySpecError(f"unknown strategy {s!r}", STRATEGIES)
    joined_by = {"all": operator.and_, "any": operator.or_}.get(match)
    if joined_by is None:
        raise QuerySpecError("match is all or any", ("all", "any"))
    flagged = set(columns if fulltext is None else fulltext)

    def found(word: str) -> Column:
        fitting = [KNOWN[s] for s in chosen if len(word) >= KNOWN[s].least]
        pairs = [(s, c) for s in fitting for name, c in columns.items() if name in flagged or not s.flagged]
        return reduce(operator.or_, [s.test(c, word) for s, c in pairs or [(KNOWN["contains"], c) for c in columns.values()]])

    return reduce(joined_by, map(found, words))
