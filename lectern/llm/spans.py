"""Spans of patterns in a text as column expressions: code-point offsets, ends exclusive.

Patterns must be free of repeated groups: Java runs those by recursion, and a long text would exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

CHUNK = 64


def running_totals(lengths: Column) -> Column:
    """Inclusive running totals of an integer array, in chunks, so that long arrays cost far less than n² steps."""

    def total(values):
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def within(values):
        return F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i + 1)))

    def by_chunks(values):
        count = F.ceil(F.size(values) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))

        def joined(chunks):
            def shifted(sums):
                return F.flatten(
                    F.zip_with(
                        chunks,
                        F.transform(sums, lambda s, i: total(F.slice(sums, F.lit(1), i))),
                        lambda chunk, before: F.transform(within(chunk), lambda x: x + before),
                    )
                )

            return let(F.transform(chunks, total), shifted)

        return let(chunks, joined)

    return let(lengths, lambda v: F.when(F.size(v) <= CHUNK, within(v)).otherwise(by_chunks(v)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, hit>>.

    The hits and the gaps between them come from the same search; a text without a hit is searched once.
    """

    none = F.array().cast("array<struct<start:int,stop:int,hit:string>>")

    def placed(text, hits):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        stops = running_totals(F.zip_with(gaps, hits, lambda g, h: F.char_length(g) + F.char_length(h)))
        return F.zip_with(
            hits,
            stops,
            lambda h, stop: F.struct((stop - F.char_length(h)).alias("start"), stop.alias("stop"), h.alias("hit")),
        )

    def searched(text):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(hits, lambda found: F.when(F.size(found) > 0, placed(text, found)).otherwise(none))

    return let(text, searched)


def digest(spans: Column, kinds: list[str]) -> Column:
    """Spans with a ``kind`` as kind:start:stop, by start, then kind as listed, then stop, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("n"), s["stop"].alias("stop"),
            s["kind"].alias("kind"),
        ),
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
