"""Text functions (F-31 to F-37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(pairs: list[tuple[Column, str | Column]]) -> Column:
    """F-32: array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in pairs]))


def joined(items: Column, separator: str = "; ") -> Column:
    """F-31."""
    return F.array_join(items, separator)


def sorted_set(x: Column | str, separator: str = ", ") -> Column:
    """A-40, A-41: the distinct values, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_set(x)), separator)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """F-34: SHA-256 of the compact JSON object with its keys in order; NULLs are written."""
    record = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def safe_name(x: Column) -> Column:
    """F-33: plain file names only."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9_.-]+$") & ~x.contains(".."), F.lit(False))


def accepts(kinds: Column, kind: Column) -> Column:
    """F-37: membership whatever the case."""
    return F.array_contains(F.transform(kinds, F.upper), F.upper(kind))


def nested(json: Column, path: str) -> Column:
    """F-36."""
    return F.get_json_object(json, path)
