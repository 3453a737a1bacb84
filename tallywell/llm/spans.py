"""Span columns shared by the detectors of personal data and of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span: code points, end exclusive; base: found by the plain pattern of its kind.
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def in_order(found: list[tuple[str, int, int, bool]], kinds: tuple[str, ...]) -> list[tuple[str, int, int, bool]]:
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, in their order, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many base spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
