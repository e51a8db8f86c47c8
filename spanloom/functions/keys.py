"""Keys of results: JSON in one form whatever the order of its fields, and its digest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "key-v1"
#: Parts of a name that a key must not hold.
SENSITIVE = ("path", "token", "credential", "secret", "password")


def canonical_json(text: Column) -> Column:
    """A JSON text without white space, the fields of every object by name; a text that is no JSON, or repeats a field, is an error."""
    return F.to_json(F.parse_json(text))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical form, lower-case hex."""
    return F.sha2(canonical_json(text), 256)


def result_key(fields: Mapping[str, Column], duration: Column, extra: Mapping[str, Column] | None = None, version: str = VERSION) -> Column:
    """A versioned key of a result: the same fields give one key in whatever order they are named.

    ``fields`` must be texts that are not blank and ``duration`` null or a finite number from 0 up, else the row is an error; names in ``extra`` that
    hold a sensitive word are refused.
    """
    for name in extra or {}:
        if any(word in name.lower() for word in SENSITIVE):
            raise ValueError(f"a key cannot hold the field {name!r}")
    bad = ~F.coalesce((duration >= 0) & (duration < float("inf")), duration.isNull())
    for c in fields.values():
        bad = bad | F.coalesce(F.trim(c) == "", F.lit(True))
    plain = {"ignoreNullFields": "false"}
    more = F.to_json(F.struct(*[c.alias(n) for n, c in (extra or {}).items()]), plain) if extra else F.lit("{}")
    body = F.to_json(F.struct(F.lit(version).alias("version"), duration.cast("double").alias("duration"), *[c.alias(n) for n, c in fields.items()]), plain)
    whole = F.concat(F.lit('{"fields":'), body, F.lit(',"extra":'), more, F.lit("}"))
    return F.when(bad, F.raise_error(F.lit("a key needs texts that are not blank and a finite length"))).otherwise(fingerprint(whole))
