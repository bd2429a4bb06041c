"""Similarity of vectors, and the deterministic embedder used where no model is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import tokens

SLOTS = 512


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if either is zero or empty, NULL if either is NULL."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.when(norm.isNotNull(), F.lit(0.0)))


def slots(text: Column) -> Column:
    """Slots of the token-indicator vector of a text: one per distinct word, out of 512."""
    return F.array_distinct(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.hash(w), F.lit(SLOTS))))


def slot_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token-indicator vectors given by their slots; 0 if either is empty."""
    norm = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(norm > 0, F.size(F.array_intersect(a, b)) / norm).otherwise(0.0)


def embedding(text: Column) -> Column:
    """The token-indicator vector of a text at length one, as ARRAY<FLOAT>."""
    own = slots(text)
    value = F.when(F.size(own) > 0, 1.0 / F.sqrt(F.size(own).cast("double"))).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.when(F.array_contains(own, i), value).otherwise(0.0).cast("float"))


Embedder = Callable[[Column], Column]
EMBEDDERS: dict[str, Embedder] = {"token-slots": embedding}


def register_embedder(name: str, embedder: Embedder) -> None:
    """Makes an embedder, a function from a text column to a vector column, known by name."""
    EMBEDDERS[name] = embedder


def embedder(name: str) -> Embedder:
    """The embedder of that name; an unknown one is an error."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}")
    return EMBEDDERS[name]
