"""Text functions, Column to Column; all native."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import vocab


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though the body uses it in many places; keeps plans small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds one of the terms, as they are: one pattern, so that plans stay small."""
    return text.rlike("|".join(rf"\Q{t}\E" for t in terms)) if terms else F.lit(False)


def says(text: Column, term: str) -> Column:
    """Whether the lower-cased text says a term in any of its variants."""
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), vocab.variants(term))


def matches(text: Column, terms: Sequence[str]) -> Column:
    """The given terms that the text says, in their order. Terms and variants are one folded constant, so that plans stay small."""
    if not terms:
        return F.array().cast("array<string>")
    forms = F.from_json(F.lit(json.dumps([list(dict.fromkeys((t, *vocab.variants(t)))) for t in terms])), "array<array<string>>")
    said = lambda low: F.filter(forms, lambda f: F.exists(f, lambda v: F.contains(low, v)))
    return F.transform(let(F.lower(F.coalesce(text, F.lit(""))), said), lambda f: F.get(f, F.lit(0)))


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def prose_words(text: Column) -> Column:
    """How many words there are once boilerplate is taken out."""
    return F.regexp_count(F.regexp_replace(F.coalesce(text, F.lit("")), vocab.BOILERPLATE, " "), F.lit(r"[^ \t\n\r\f]+"))


def is_prose(text: Column, least: int = 20) -> Column:
    """Real sentences, not chrome: enough words."""
    return prose_words(text) >= least


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slug(value: Column, most: int = 128) -> Column:
    """An id of letters, digits, dots, dashes and underscores; a long one ends in a digest of the whole."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.-]", "_"), "_+", "_"), "^[_.]+|[_.]+$", "")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 13), F.lit("_"), F.substring(digest(value), 1, 12))).otherwise(flat)


def garbage(text: Column) -> Column:
    """Whether a text of 100 characters or more is binary: under 90 % printable, or over 5 % control or replacement characters."""
    size = F.length(text)
    odd = size - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFD]", ""))
    return F.coalesce((size >= 100) & ((odd / size > 0.05) | ((size - odd) / size < 0.9)), F.lit(False))


def stack_signal(text: Column, required: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """excluded, missing, matched or unconstrained."""
    flat = normal(F.coalesce(text, F.lit("")))
    hit = contains_any(flat, excluded)
    return F.when(hit, "excluded").when(F.lit(not required), "unconstrained").when(contains_any(flat, required), "matched").otherwise("missing")
