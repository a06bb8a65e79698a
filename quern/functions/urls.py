"""Addresses as column expressions: their parts, and references made absolute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query and fragment of any address; a part that is absent is empty.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, number: int) -> Column:
    """Part 1 to 5 with its signs: authority with its slashes, query with its question mark, fragment with its hash."""
    return F.regexp_extract(url, PARTS, number)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def without_dots(path: Column) -> Column:
    """A rooted path without the segments . and .., which takes the segment before it along."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, none,
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    closed = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(closed & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, reference: Column) -> Column:
    """The reference as seen from ``base``, which has a scheme and an authority. References that name a scheme or
    an authority stay as they are."""
    scheme, authority, path, query, fragment = (part(reference, i) for i in range(1, 6))
    root = F.concat(part(base, 1), F.lit(":"), part(base, 2))
    own_path = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    merged = F.concat(F.regexp_replace(own_path, r"[^/]*$", ""), path)
    tail = F.concat(query, fragment)
    return (
        F.when(scheme != "", reference)
        .when(authority != "", F.concat(part(base, 1), F.lit(":"), authority, path, tail))
        .when(path.startswith("/"), F.concat(root, without_dots(path), tail))
        .when(path != "", F.concat(root, without_dots(merged), tail))
        .when(query != "", F.concat(root, part(base, 3), tail))
        .otherwise(F.concat(root, part(base, 3), part(base, 4), fragment))
    )
