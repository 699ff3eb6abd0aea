"""Scalar functions of the domain as expressions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped(column: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """Looks a value up; unmapped values become ``default`` (null where none is given)."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.element_at(table, column)
    return found if default is None else F.coalesce(found, default)


def mapped_strictly(column: Column, names: dict[str, str]) -> Column:
    """As ``mapped``; a value that isn't null and isn't mapped fails the query."""
    found = mapped(column, names)
    return F.when(column.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unmapped value: "), column)))


def normal_name(column: Column) -> Column:
    """Lower case, signs to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def first_label(*columns: Column, key: Column | None = None) -> Column:
    """The first label that isn't empty, else the first eight signs of the key."""
    labels = [F.when(F.trim(c) != "", c) for c in columns]
    return F.coalesce(*labels, *([F.substring(key.cast("string"), 1, 8)] if key is not None else []))


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def edge_id(*parts: Column, longest: int = 200) -> Column:
    """The parts joined by colons; where that is too long, the start of its SHA-256."""
    literal = F.concat_ws(":", *parts)
    return F.when(F.length(literal) > longest, F.substring(F.sha2(literal, 256), 1, 16)).otherwise(literal)


def doi_key(column: Column) -> Column:
    """A DOI without resolver and prefix, lower case; null where nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare != "", bare)


def words(column: Column) -> Column:
    """Distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"([a-z]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigrams(column: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one behind."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, 3)))
    return F.array_distinct(F.flatten(cut))


def least_rotation(nodes: Column) -> Column:
    """The rotation of a cycle that comes first in order."""
    n = F.size(nodes)
    turned = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.slice(nodes, k, n), F.slice(nodes, F.lit(1), k - 1)))
    return F.array_min(turned)


def path_key(nodes: Column) -> Column:
    """A path's nodes, read from the smaller end."""
    return F.when(F.element_at(nodes, 1) > F.element_at(nodes, -1), F.reverse(nodes)).otherwise(nodes)


def core_term(column: Column, modifiers: list[str]) -> Column:
    """The last three words of a term that are neither modifiers nor digits."""
    parts = F.filter(F.split(normal_name(column), " "), lambda w: (w != "") & ~w.isin(*modifiers) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), " ")


def first_keyword(column: Column, table: dict[str, list[str]], default: str) -> Column:
    """The first class, in the table's order, one of whose keywords the text contains."""
    out = F.lit(default)
    for name, keys in reversed(table.items()):
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(F.lower(column), F.lit(key))
        out = F.when(hit, name).otherwise(out)
    return out


def clamp(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))
