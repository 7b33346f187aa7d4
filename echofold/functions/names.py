"""Column expressions over names: normalising, splitting, affixes, near matches, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning at either end of a name.
AFFIXES = ("get", "set", "handle", "on", "try", "do", "make", "create", "build", "update", "process", "render", "load", "save", "init", "is", "has", "can", "should")

#: Names that every project repeats by convention.
IGNORED_NAMES = (
    "constructor", "render", "destroy", "componentDidMount", "componentWillUnmount", "setupEventListeners", "attachEventListeners", "addEventListeners",
    "open", "close", "cleanup", "clear", "initialize", "init", "getInstance",
    "toString", "valueOf", "main", "handler", "handleEvent",
    "new", "default", "fmt", "from", "drop", "clone", "eq", "hash", "deref", "deref_mut",
)


def normalised(name: Column) -> Column:
    """Lower case without underscores and dollar signs."""
    return F.regexp_replace(F.lower(name), "[_$]", "")


def name_words(name: Column) -> Column:
    """The words of a camelCase, snake_case, SCREAMING_CASE or digit-separated name, lower-cased."""
    boundary = "[_$\\s]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    return F.transform(F.filter(F.split(name, boundary), lambda w: w != ""), F.lower)


def without_affixes(words: Column) -> Column:
    """words without affixes at both ends; where all are affixes, the last one stays."""
    listed = F.array(*map(F.lit, AFFIXES))
    where = F.transform(words, lambda w, i: F.when(F.array_contains(listed, w), F.lit(None)).otherwise(i))
    first, last = F.array_min(where), F.array_max(where)
    return F.when(F.size(words) == 0, words).when(first.isNull(), F.slice(words, -1, 1)).otherwise(F.slice(words, F.coalesce(first, F.lit(0)) + 1, F.coalesce(last - first, F.lit(0)) + 1))


def set_key(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), "|")


def within_edits(a: Column, b: Column, edits: int = 2) -> Column:
    """Whether two strings are at most so many edits apart."""
    return (F.abs(F.length(a) - F.length(b)) <= edits) & (F.levenshtein(a, b, edits) >= 0)


def half_up(x: Column, places: int) -> Column:
    """Rounded half up towards positive infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def language_of(file: Column) -> Column:
    return F.when(F.lower(file).endswith(".rs"), "rust").otherwise("js")
