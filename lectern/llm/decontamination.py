"""Benchmark decontamination: pigeonhole pieces, exact hits, verification with Myers' bit-parallel distance.

A test item that occurs in a text with at most ``k`` edits leaves at least one of ``k + 1`` disjoint pieces of it
untouched. So the pieces of all items are searched exactly, in one pass over every text, and around each hit the
whole item is compared with Myers' algorithm. Texts and items are compared in lower case, with every run of
characters other than letters and digits as one blank.

The items are a stated query set: they are taken in blocks of bounded size, each block is searched in all texts, and
only matches leave a task. Texts are neither shuffled nor grouped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column, slices, text_of

#: Share of an item's characters that may be edited.
RATE = 0.06
#: Items below this length must occur exactly, between blanks.
SHORT = 32
BLOCK_CHARS = 8_000_000
OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, single blanks, and a blank at either end."""
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate) if len(item) >= SHORT else 0


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """Error budget plus one pieces of about equal length, with their offsets."""
    count = budget(item, rate) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where the first such part ends.

    Myers' algorithm: one integer holds a column of the comparison table as differences of its neighbours.
    """
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for at, char in enumerate(text, 1):
        eq = masks.get(char, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Searcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            body = normal(text)
            if not body.strip():
                continue  # an item without letters or digits occurs nowhere
            body = body if len(body) < SHORT else body.strip()
            masks: dict[str, int] = {}
            for i, char in enumerate(body):
                masks[char] = masks.get(char, 0) | 1 << i
            for offset, piece in pieces(body, rate):
                by_piece.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((key, body, masks, budget(body, rate)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if by_piece:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Item key -> (edits, occurrences verified) for the items in the text."""
        if self.automaton is None:
            return {}
        body = normal(text)
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(body):
            for item, offset in uses:
                starts.setdefault(item, []).append(end + 1 - size - offset)
        out: dict[int, tuple[int, int]] = {}
        for item, found in starts.items():
            key, wanted, masks, k = self.items[item]
            checked = last = None
            for start in sorted(found):
                if checked is not None and start - checked <= k:
                    continue  # the window of the last check holds this one's, within its margin
                checked = start
                low = max(0, start - 2 * k)
                edits, end = best_match(wanted, masks, body[low : start + len(wanted) + 2 * k])
                if edits <= k:
                    least, times = out.get(key, (edits, 0))
                    # An item that repeats itself is hit at several places of one occurrence. The next one ends at
                    # least a shortest occurrence later.
                    if last is None or low + end >= last + len(wanted) - k:
                        last, times = low + end, times + 1
                    out[key] = min(least, edits), times
        return out


def _search(items: list[tuple[int, str]], rate: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, rate)
        for batch in slices(batches):
            found = [searcher.find(t) for t in column(batch, "text")]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("times", pa.int32())]))
            lists = [[{"item_id": i, "edits": e, "times": n} for i, (e, n) in sorted(x.items())] for x in found]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, kind)], [*names, "found"])

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``BLOCK_CHARS`` characters; null ids and null texts are no items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    items = items.filter(F.col("item_id").isNotNull() & (F.col("text") != "")).distinct()
    chars = items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    blocks = chars // BLOCK_CHARS + 1
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``edits``, ``times``.

    Null or empty texts hold nothing; repeated documents each have their rows; an item that occurs twice with the same
    id but different texts is searched in both forms and reported per form. Empty tables give no rows.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, found array<struct<item_id:bigint,edits:int,times:int>>"
    parts = [
        texts.mapInArrow(_search(items, rate), schema).select("doc_id", F.inline("found"))
        for items in item_blocks(benchmark)
    ]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows whose text holds no item; all columns as they are."""
    out, names = docs, docs.columns
    for items in item_blocks(benchmark):
        own = {c: f"_{i}" for i, c in enumerate(names)}
        rows = out.select(*[F.col(c).alias(n) for c, n in own.items()], text_of().alias("text"))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
        found = rows.mapInArrow(_search(items, rate), f"{fields}, found array<struct<item_id:bigint,edits:int,times:int>>")
        out = found.filter(F.size("found") == 0).select(*[F.col(n).alias(c) for c, n in own.items()])
    return out


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)
