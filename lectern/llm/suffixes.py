"""Suffix-array removal of repeated strings, across all texts and within each.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else. To bring equal strings
together without sending every position, each string of that length is assigned to one anchor inside it: the start of
its least ``GRAM``-byte hash, the leftmost of equals. Equal strings have equal anchors at the same offset. The strings
of one anchor start next to each other; the bytes they cover are the anchor's context.

1. Chunks of texts ask, for each distinct context, a bucket of hash ranges. A context seen twice repeats as a whole; an
   anchor seen once does not repeat at all. Hot passages are asked for once per chunk.
2. What is left are anchors with different contexts. The bucket gets the bytes of those contexts (one copy of each
   repeated one) and cuts them into cells of ``CELL`` bytes, counted from the anchor, so that equal strings are cut
   alike. Cells are the symbols of a sequence whose suffix array is built by ``grouping.suffix_array``. Neighbours in
   the array that share all the cells a string surely holds are candidates, and the few bytes at either end decide.
   An anchor with more than ``MOST_CONTEXTS`` contexts is not looked at in one place: each of its strings goes, as
   ``HOT_BITS`` bits of its hash, to the bucket of that hash, where it is counted. A chunk sends a string once.
3. The chunk joins what it learned to spans and drops them.

A chunk sends rows only to buckets that its hashes fall into, so rows grow with the texts and the buckets need no cap.
Chunks send their texts along, compressed, so that rows need no key: repeated rows and null ids are no special case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import bucket_of, filled, in_batches, packed, packed_sorted, small, unpacked, unpacked_sorted
from lectern.llm.common import column, slices, text_of
from lectern.llm.grouping import suffix_array

LENGTH = 200
GRAM = 48
CELL = 16
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Buckets that a task of a shuffle answers.
BUCKETS_PER_TASK = 4
SEGMENT = 1 << 22
#: Context bytes that are sorted at a time; the contexts of one anchor stay together.
SORTED_BYTES = 1 << 20
#: Distinct contexts of one anchor that are sorted together; these have less than SORTED_BYTES.
MOST_CONTEXTS = 2048
#: Bits that tell the strings of hotter anchors apart, and the contexts whose strings are hashed at a time.
HOT_BITS = 96
HASHED_AT_ONCE = 1024
#: Cells that every string of LENGTH bytes holds whole, from its first cell border on.
WHOLE = (LENGTH - CELL + 1) // CELL
EDGE = LENGTH - WHOLE * CELL
SENT = "bucket long, chunk long, payload binary"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
ONCE, REPEATED, OPEN, REPEATED_AND_ASKED, HOT, REPEATED_AND_HOT = range(6)


class _Powers:
    """Powers of the hash base and of its inverse, kept for the longest text seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size * 2, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:size], self.down[:size]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _spread(least: np.ndarray) -> np.ndarray:
    """Least hashes lie near zero; these numbers, as distinct as they are, fill all 64 bits and so all buckets alike."""
    with np.errstate(over="ignore"):
        x = least * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, powers: _Powers) -> tuple[np.ndarray, ...]:
    """Per anchor: its hash, its place, and the first and last start of the strings assigned to it."""
    found = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = np.frombuffer(data, np.uint8)[begin : begin + SEGMENT + LENGTH - 1]
        up, down = powers.of(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[:-1], dtype=np.uint64)))
            grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
            grams ^= grams >> np.uint64(32)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        owner = (_least(keys, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.append(first[1:], len(owner)) - 1
        place = owner[first]
        found.append((_spread(grams[place]), place + begin, first + begin, last + begin))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: hash, hash of the context, number of the text, offset of the anchor, start and stop."""
    powers, parts = _Powers(), []
    for number, data in enumerate(texts):
        if len(data) < LENGTH:
            continue
        grams, place, first, last = anchors(data, powers)
        stop = last + LENGTH
        view = memoryview(data)
        whole = [
            xxhash.xxh64_intdigest(view[a:b], seed=p - a)
            for a, b, p in zip(first.tolist(), stop.tolist(), place.tolist(), strict=True)
        ]
        parts.append((grams, np.array(whole, np.uint64), np.full(len(first), number), place - first, first, stop))
    if not parts:
        return *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _distinct(grams: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct contexts in order: hashes, counts, and for every context its place in that order."""
    order = np.lexsort((whole, grams))
    g, w = grams[order], whole[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])))[: len(g)]
    number = np.cumsum(new) - 1
    at = np.empty(len(g), np.int64)
    at[order] = number
    return g[new], w[new], np.bincount(number, minlength=int(new.sum())), at


def _load(payload: bytes) -> tuple[list, list[bytes], int]:
    """A chunk's ids and texts, and how many buckets there are."""
    ids, sizes, body, size, buckets = pickle.loads(payload)
    whole = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tolist()
    return ids, [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], buckets


def _asked(buckets: int):
    """Chunks of texts, and what each asks the buckets."""

    def rows(chunk: int, ids: list, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        body = b"".join(texts)
        sent = pa.compress(body, codec="zstd", asbytes=True) if body else b""
        yield -1 - chunk, chunk, pickle.dumps((ids, [len(t) for t in texts], sent, len(body), buckets))
        grams, whole, *_ = _contexts(texts)
        grams, whole, counts, _ = _distinct(grams, whole)
        named, (cuts,) = filled(bucket_of(grams, 64, buckets))
        for i, b in enumerate(named.tolist()):
            part = slice(cuts[i], cuts[i + 1])
            yield b, chunk, pickle.dumps([packed_sorted(grams[part]), packed(whole[part]), packed(small(counts[part]))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, ids, texts, size = TaskContext.get().partitionId() << 24, 0, [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids.append(doc_id)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield from in_batches(rows(base + number, ids, texts))
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from in_batches(rows(base + number, ids, texts))

    return run


def _replies(group: pa.Table, payloads: list[bytes]) -> pa.Table:
    return pa.table({"bucket": group["bucket"], "chunk": group["chunk"], "payload": pa.array(payloads, pa.binary())})


def _answer(group: pa.Table, most: int = MOST_CONTEXTS) -> pa.Table:
    """Tells every chunk which of its contexts repeat, which cannot, and which have to be looked at, and how."""
    if group["bucket"][0].as_py() < 0:
        return group
    asked = [pickle.loads(p.as_py()) for p in group["payload"]]
    parts = [[f(a[i]) for a in asked] for i, f in enumerate((unpacked_sorted, unpacked, unpacked))]
    sizes = [len(x) for x in parts[0]]
    grams, whole, counts = (np.concatenate(x) for x in parts)
    g, _, _, at = _distinct(grams, whole)
    total = np.bincount(at, counts, len(g)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[: len(g)]
    contexts = np.diff(np.append(starts, len(g)))
    single = np.add.reduceat((total == 1).astype(np.int64), starts) if len(g) else np.zeros(0, np.int64)
    several = np.repeat((contexts > 1) & (single > 0), contexts)
    hot = np.repeat(contexts > most, contexts)
    state = np.where(total > 1, REPEATED, np.where(several, np.where(hot, HOT, OPEN), ONCE))[at]
    # Of a repeated context that others are to be compared with, the first chunk that asked sends the bytes.
    _, first = np.unique(at, return_index=True)
    asked_for = (total > 1) & several
    state[first[asked_for]] = np.where(hot[asked_for], REPEATED_AND_HOT, REPEATED_AND_ASKED)
    replies = np.split(state.astype(np.uint8), np.cumsum(sizes)[:-1])
    return _replies(group, [packed(r) for r in replies])


def _by_bucket(group: pa.Table) -> tuple[bytes, list[bytes]]:
    """The chunk's own payload, then the buckets' in order."""
    order = np.argsort(np.array(group["bucket"]), kind="stable").tolist()
    payloads = group["payload"]
    return payloads[order[0]].as_py(), [payloads[i].as_py() for i in order[1:]]


def _strings(texts: list[bytes], number: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every string of some contexts: two parts of its hash, the number of its text and where it starts."""
    found = []
    for begin in range(0, len(number), HASHED_AT_ONCE):
        some = slice(begin, begin + HASHED_AT_ONCE)
        counts = stop[some] - start[some] - LENGTH + 1
        of = np.repeat(number[some], counts)
        where = np.repeat(start[some] - (np.cumsum(counts) - counts), counts) + np.arange(len(of))
        digests = [xxhash.xxh3_128_digest(texts[n][a : a + LENGTH]) for n, a in zip(of.tolist(), where.tolist(), strict=True)]
        parts = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        found.append((parts[:, 0].copy(), (parts[:, 1] >> np.uint64(128 - HOT_BITS)).astype(np.uint32), of, where))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hot_rows(found: tuple[np.ndarray, ...], is_open: np.ndarray, buckets: int) -> tuple[list, np.ndarray]:
    """(bucket, payload) with each distinct string once, and which of the strings repeat among themselves."""
    key, rest, number, where = found
    key, rest, counts, at = _distinct(key, rest)
    _, first = np.unique(at, return_index=True)
    again, asks = counts > 1, is_open[first]
    named, (cuts,) = filled(bucket_of(key, 64, buckets))
    rows = []
    for b, low, high in zip(named.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = first[low:high]
        arrays = [rest[low:high], again[low:high], asks[low:high], small(number[x]), small(where[x])]
        rows.append((b, pickle.dumps((None, 0, [packed_sorted(key[low:high]), *map(packed, arrays)]))))
    return rows, again[at]


def _opened(group: pa.Table) -> pa.Table:
    """A chunk marks what repeats as a whole, and sends on the contexts that have to be looked at."""
    own, replies = _by_bucket(group)
    chunk = group["chunk"][0].as_py()
    _, texts, buckets = _load(own)
    grams, whole, number, offset, start, stop = _contexts(texts)
    g, _, counts, at = _distinct(grams, whole)
    state = np.concatenate([unpacked(r) for r in replies]) if replies else np.zeros(0, np.uint8)
    mine = state[at]
    known = np.isin(mine, (REPEATED, REPEATED_AND_ASKED, REPEATED_AND_HOT))
    marked = [x[known] for x in (number, start, stop)]
    rows = []
    # One row of each distinct context that is sent: of an open one it is the only one here or anywhere.
    _, first = np.unique(at, return_index=True)
    hot = first[np.isin(state, (HOT, REPEATED_AND_HOT))] if len(g) else first
    if len(hot):
        found = _strings(texts, number[hot], start[hot], stop[hot])
        is_open = np.repeat(mine[hot] == HOT, stop[hot] - start[hot] - LENGTH + 1)
        hot_rows, here = _hot_rows(found, is_open, buckets)
        rows += [(bucket, chunk, payload) for bucket, payload in hot_rows]
        _, _, of, where = (x[here] for x in found)
        marked = [np.concatenate(x) for x in zip(marked, (of, where, where + LENGTH), strict=True)]
    rows.append((-1 - chunk, chunk, pickle.dumps((own, [packed(small(x)) for x in marked]))))
    sent = first[np.isin(state, (OPEN, REPEATED_AND_ASKED))] if len(g) else first
    named, (where,) = filled(bucket_of(grams[sent], 64, buckets))
    for i, b in enumerate(named.tolist()):
        part = sent[where[i] : where[i + 1]]
        spans = zip(number[part].tolist(), start[part].tolist(), stop[part].tolist(), strict=True)
        body = b"".join(texts[n][a:z] for n, a, z in spans)
        arrays = [number[part], start[part], stop[part] - start[part], offset[part], mine[part] == OPEN]
        arrays = [packed_sorted(grams[part]), *[packed(small(x)) for x in arrays]]
        packed_body = pa.compress(body, codec="zstd", asbytes=True)
        rows.append((b, chunk, pickle.dumps((packed_body, len(body), arrays))))
    return pa.Table.from_batches(list(in_batches(rows)))


def _rank(cells: np.ndarray) -> np.ndarray:
    """A number per row of bytes, equal for equal rows."""
    padded = np.zeros((len(cells), -(-cells.shape[1] // 8) * 8), np.uint8)
    padded[:, : cells.shape[1]] = cells
    words = padded.view(np.uint64)
    rank = np.zeros(len(cells), np.int64)
    for i in range(words.shape[1]):
        _, word = np.unique(words[:, i], return_inverse=True)
        _, rank = np.unique(rank * (len(cells) + 1) + word, return_inverse=True)
    return rank


def repeated_starts(body: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each context, one after another in ``body``: whether the string at each start repeats in another context.

    ``offsets`` are the anchors' places in their contexts. The result is flat: ``size - LENGTH + 1`` per context.
    """
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    begin = offsets % CELL
    cells = (sizes - begin) // CELL
    rows_of = np.lib.stride_tricks.sliding_window_view
    context = np.repeat(np.arange(len(sizes)), cells)
    within = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    border = begin[context] + within * CELL  # of each cell, in its context
    symbol = _rank(rows_of(body, CELL)[base[context] + border]) + 1
    # The sequence: the cells of a context, then a mark that no cell equals.
    spot = np.arange(len(symbol)) + context
    sequence = np.zeros(len(symbol) + len(sizes), np.int64)
    sequence[spot] = symbol
    array = suffix_array(sequence)
    held = np.full(len(sequence), -1)
    held[spot] = np.arange(len(symbol))
    cell = held[array]
    left = (cells[context] - within)[cell]
    usable = (cell >= 0) & (left >= WHOLE)
    same = usable[1:] & usable[:-1]
    for step in range(WHOLE):
        a, b = array[:-1] + step, array[1:] + step
        at = np.flatnonzero(same)
        same[at] = sequence[a[at]] == sequence[b[at]]
    label = np.concatenate(([0], np.cumsum(~same)))[: len(array)]
    counts = np.bincount(label, minlength=1)
    use = usable & (counts[label] > 1)
    cell, label = cell[use], label[use]
    starts = sizes - LENGTH + 1
    out_base = np.cumsum(starts) - starts
    out = np.zeros(int(starts.sum()), bool)
    for back in range(CELL):
        start = border[cell] - back
        fits = (start >= 0) & (start < starts[context[cell]])
        rows, where, of = cell[fits], start[fits], label[fits]
        if not len(rows):
            continue
        first = base[context[rows]] + where
        ends = [rows_of(body, n)[at] for n, at in ((back, first), (EDGE - back, first + back + WHOLE * CELL)) if n]
        ends = _rank(np.concatenate(ends, axis=1))
        _, key, times = np.unique(of * (len(rows) + 1) + ends, return_inverse=True, return_counts=True)
        out[out_base[context[rows]] + where] |= times[key] > 1
    return out


def _by_anchor(body: np.ndarray, grams: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``repeated_starts`` for some anchors at a time: strings of different anchors are never equal."""
    order = np.argsort(grams, kind="stable")
    base = np.cumsum(sizes) - sizes
    starts = sizes - LENGTH + 1
    out_base = np.cumsum(starts) - starts
    out = np.zeros(int(starts.sum()), bool)
    new = np.flatnonzero(np.concatenate(([True], np.diff(grams[order]) > 0)))
    reach = np.cumsum(sizes[order])
    first = 0
    for last in [*new[1:].tolist(), len(order)]:
        if last < len(order) and reach[last - 1] - (reach[first - 1] if first else 0) < SORTED_BYTES:
            continue
        part = order[first:last]
        data = np.concatenate([body[b : b + n] for b, n in zip(base[part].tolist(), sizes[part].tolist(), strict=True)])
        found = repeated_starts(data, sizes[part], offsets[part])
        at = np.repeat(out_base[part] - (np.cumsum(starts[part]) - starts[part]), starts[part]) + np.arange(len(found))
        out[at] = found
        first = last
    return out


def _compared(group: pa.Table) -> pa.Table:
    """Tells each chunk which strings of its own repeat, of the open contexts and of the hot strings of a bucket."""
    if group["bucket"][0].as_py() < 0:
        return group
    sent = [pickle.loads(p.as_py()) for p in group["payload"]]
    is_hot = np.array([body is None for body, *_ in sent])
    replies = np.empty(len(sent), object)
    for kind, of in ((_counted, is_hot), (_looked_at, ~is_hot)):
        if of.any():
            replies[of] = kind([x for x, mine in zip(sent, of.tolist(), strict=True) if mine])
    return _replies(group, replies.tolist())


def _counted(sent: list[tuple]) -> list[bytes]:
    """For each chunk the spans of its hot strings that another chunk has too."""
    parts = [[unpacked_sorted(arrays[0]), *[unpacked(x) for x in arrays[1:]]] for _, _, arrays in sent]
    key, rest, again = (np.concatenate([p[i] for p in parts]) for i in range(3))
    _, _, counts, at = _distinct(key, rest)
    # What repeats in its own chunk is marked there.
    repeats = np.split((counts[at] > 1) & ~again, np.cumsum([len(p[0]) for p in parts])[:-1])
    out = []
    for (*_, asks, number, where), found in zip(parts, repeats, strict=True):
        number, where = (x[found & asks].astype(np.int64) for x in (number, where))
        out.append(pickle.dumps([packed(small(x)) for x in (number, where, where + LENGTH)]))
    return out


def _looked_at(sent: list[tuple]) -> list[bytes]:
    """For each chunk the spans of its open contexts that repeat."""
    bodies, parts = [], []
    for body, size, arrays in sent:
        bodies.append(np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), np.uint8))
        parts.append([unpacked_sorted(arrays[0]), *[unpacked(x).astype(np.int64) for x in arrays[1:]]])
    grams, number, start, sizes, offsets, is_open = (np.concatenate(x) for x in zip(*parts, strict=True))
    is_open = is_open > 0
    repeats = _by_anchor(np.concatenate(bodies), grams, sizes, offsets)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.flatnonzero(repeats & is_open[owner])
    owner, where = owner[at], (at - np.repeat(np.cumsum(counts) - counts, counts)[at])
    # Neighbouring starts of one context make one span.
    new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner) > 0)))[: len(at)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    owner_of = owner[first]
    spans = (number[owner_of], start[owner_of] + where[first], start[owner_of] + where[last] + LENGTH)
    cuts = np.searchsorted(owner_of, np.cumsum([len(p[0]) for p in parts])[:-1])
    split = [np.split(x, cuts) for x in spans]
    return [pickle.dumps([packed(small(x[i])) for x in split]) for i in range(len(parts))]


def _dropped(group: pa.Table) -> pa.Table:
    """A chunk's texts without the bytes that repeat."""
    own, replies = _by_bucket(group)
    own, marks = pickle.loads(own)
    ids, texts, _ = _load(own)
    spans = [[unpacked(x).astype(np.int64) for x in marks]]
    spans += [[unpacked(x).astype(np.int64) for x in pickle.loads(r)] for r in replies]
    number, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.lexsort((start, number))
    number, start, stop = number[order], start[order], stop[order]
    cuts = np.searchsorted(number, np.arange(len(texts) + 1))
    out: dict[str, list] = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for i, data in enumerate(texts):
        a, b = start[cuts[i] : cuts[i + 1]], stop[cuts[i] : cuts[i + 1]]
        reach = np.maximum.accumulate(b) if len(b) else b
        new = np.concatenate(([True], a[1:] > reach[:-1]))[: len(a)]
        first = np.flatnonzero(new)
        lows = a[first].tolist()
        highs = reach[np.append(first[1:], len(a))[: len(first)] - 1].tolist()
        kept = b"".join(data[x:y] for x, y in zip([0, *highs], [*lows, len(data)], strict=True))
        out["n_bytes"].append(len(data))
        out["n_removed"].append(len(data) - len(kept))
        out["n_spans"].append(len(lows))
        out["kept"].append(kept)
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes that stay).

    A null or empty text has no bytes; a text shorter than ``LENGTH`` loses none. Repeated rows repeat each other's
    strings. Null ids are kept as they are, and an empty table stays empty.

    The rows must come in one order whenever they are read, as those of a table do: a lost task is run again and has to
    cut the same chunks. Write the result of a shuffle before it is given here.
    """
    spark = docs.sparkSession
    body = text_of()
    size = docs.select(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(size // BUCKET_BYTES, BUCKETS_PER_TASK * partitions))
    tasks = buckets // BUCKETS_PER_TASK  # grows with the texts, so that a task does not
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    most = MOST_CONTEXTS

    def step(sent: DataFrame, key: str, function, schema: str) -> DataFrame:
        return sent.repartition(tasks, key).groupBy(key).applyInArrow(function, schema)

    answered = step(rows.mapInArrow(_asked(buckets), SENT), "bucket", lambda group: _answer(group, most), SENT)
    opened = step(answered, "chunk", _opened, SENT)
    compared = step(opened, "bucket", _compared, SENT)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return step(compared, "chunk", _dropped, schema)


#: The same over all documents with different ids for DuckDB, every string counted. Bytes are pairs of hexadecimal digits.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m
      FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
marked AS (SELECT doc_id, i, coalesce(i > {LENGTH} + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS fresh FROM w SEMI JOIN again USING (m)),
numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS low, max(i) + {LENGTH} AS high FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS start, low AS stop FROM runs
         UNION ALL SELECT doc_id, 1099511627776, coalesce(max(high), 0), any_value(length(h) // 2) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY low) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM runs r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id)"""


def op8(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
