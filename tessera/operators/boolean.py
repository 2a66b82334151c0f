"""Documents by conditions on their terms and fields, put together with &, | and ~:

    matches(index, {"a": (term("red") | prefix("gre")) & ~term("blue") & field(F.col("path").endswith(".md"))})

Whatever the conditions, the postings of their terms are read once and come together once by document, as one flag a term."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .index import Index
from .search import PUSHED_TERMS


@dataclass(frozen=True)
class Condition:
    """kind: term, prefix, field, and, or, not."""

    kind: str
    word: str = ""
    column: Column | None = None
    parts: tuple[Condition, ...] = ()

    def __and__(self, other: Condition) -> Condition:
        return Condition("and", parts=(self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("or", parts=(self, other))

    def __invert__(self) -> Condition:
        return Condition("not", parts=(self,))

    def leaves(self) -> set[tuple[str, str]]:
        """The conditions on terms in it: kind and word."""
        own = {(self.kind, self.word)} if self.kind in ("term", "prefix") else set()
        return own.union(*(p.leaves() for p in self.parts))

    def holds_without_terms(self) -> bool:
        """Whether a document that has none of its terms may fulfil it."""
        if self.kind == "and":
            return all(p.holds_without_terms() for p in self.parts)
        if self.kind == "or":
            return any(p.holds_without_terms() for p in self.parts)
        return self.kind in ("not", "field")

    def over(self, flags: Mapping[tuple[str, str], Column]) -> Column:
        if self.kind in ("term", "prefix"):
            return flags[self.kind, self.word]
        if self.kind == "field":
            return F.coalesce(self.column, F.lit(False))
        inner = [p.over(flags) for p in self.parts]
        return ~inner[0] if self.kind == "not" else inner[0] & inner[1] if self.kind == "and" else inner[0] | inner[1]


def term(word: str) -> Condition:
    """Documents with this token (ASCII letters and digits, in any case)."""
    low = "".join(c.lower() if c.isascii() else c for c in word)
    if not low or not all(c.isascii() and c.isalnum() for c in low):
        raise ValueError(f"{word!r} is not one token")
    return Condition("term", low)


def prefix(word: str) -> Condition:
    """Documents with a token that begins so."""
    return Condition("prefix", term(word).word)


def field(column: Column) -> Condition:
    """Documents of which a condition on the columns of the index' stats (doc_id, path, body_len, token_count) is true."""
    return Condition("field", column=column)


def _of(kind: str, word: str) -> Column:
    return F.col("term") == word if kind == "term" else F.col("term").startswith(word)


def matches(index: Index, queries: Mapping[str, Condition]) -> DataFrame:
    """query_id and doc_id of the documents that fulfil each condition; those without tokens, too, where it allows."""
    leaves = sorted(set().union(*(q.leaves() for q in queries.values()))) if queries else []
    if len(leaves) > PUSHED_TERMS:
        raise ValueError(f"more than {PUSHED_TERMS} terms")
    stats = index.stats
    if leaves:
        any_leaf = reduce(lambda a, b: a | b, (_of(*leaf) for leaf in leaves))
        rows = index.postings.where(any_leaf).select("term", "doc_id") if index.blocks is None else packed.unpacked(index.blocks.where(any_leaf), with_offsets=False).select("term", "doc_id")
        flags = rows.groupBy("doc_id").agg(*[F.max(_of(*leaf)).alias(f"flag{i}") for i, leaf in enumerate(leaves)])
        # documents without any of the terms are looked at only if a condition may hold of them
        docs = stats.join(flags, "doc_id", "left" if any(q.holds_without_terms() for q in queries.values()) else "inner")
    else:
        docs = stats
    of_leaf = {leaf: F.coalesce(f"flag{i}", F.lit(False)) for i, leaf in enumerate(leaves)}
    met = F.array(*[F.when(q.over(of_leaf), F.lit(name)) for name, q in queries.items()]) if queries else F.array().cast("array<string>")
    return docs.select(F.explode(F.array_compact(met)).alias("query_id"), "doc_id")
