"""Text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for retrieval, and where names change case.
STOPWORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who with".split()
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
NO_DISTANCE = 1_000_000


def soundex(word: Column) -> Column:
    """American Soundex of the letters A-Z; null without any."""
    letters = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    return F.when(letters != "", F.soundex(letters))


def split_words(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def soundex_any(value: Column, token: Column) -> Column:
    """Whether a word of value sounds like token; false for null."""
    return F.coalesce(F.exists(split_words(value), lambda w: F.coalesce(soundex(w) == soundex(token), F.lit(False))), F.lit(False))


def distance(a: Column, b: Column, bound: int | None = None) -> Column:
    """Edit distance; bound + 1 beyond bound."""
    if bound is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, bound)
    return F.when(d == -1, bound + 1).otherwise(d)


def distance_min(value: Column, token: Column) -> Column:
    """Least edit distance of the lower-cased token to a word of value; NO_DISTANCE without words."""
    return F.coalesce(F.array_min(F.transform(split_words(F.lower(value)), lambda w: F.levenshtein(w, F.lower(token)))), F.lit(NO_DISTANCE))


def difference(a: Column, b: Column) -> Column:
    """Equal places of two Soundex codes, 0 to 4."""
    x, y = soundex(a), soundex(b)
    same = [F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(1, 5)]
    return F.when(x.isNotNull() & y.isNotNull(), sum(same[1:], same[0]))


def trigrams(value: Column) -> Column:
    """Distinct trigrams of each lower-cased word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Words of names and prose: split at case changes and punctuation, lower-cased, in the singular, without stopwords."""
    raw = F.split(F.lower(F.regexp_replace(text, CAMEL, " ")), "[^a-z0-9]+")
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))
    end = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.transform(kept, lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(end(t, 3), F.lit("y"))).when(t.endswith("sses"), end(t, 2)).when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), end(t, 1)).otherwise(t))


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
