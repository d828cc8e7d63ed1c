"""Name-based ids (version 5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
#: Fixed value: the published namespace for URLs; ids of requests that are no UUID are named under it.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: Column, name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), name.cast("binary")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.lower(F.hex(nibble)), part(18, 3), F.lit("-"), part(21, 12))


def span_id(request_id: Column, start: Column, end: Column) -> Column:
    """The id of a span: named under its request, whose own id is first named under the URL namespace if it is no UUID."""
    space = F.when(request_id.rlike(UUID), request_id).otherwise(uuid5(F.lit(URL_NAMESPACE), request_id))
    return uuid5(space, F.concat_ws(":", start.cast("string"), end.cast("string")))
