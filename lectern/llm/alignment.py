"""Alignment of two tokenizers' tokens: windows between whitespace tokens, remembered by their ids.

Both tokenizers encode every text whole; their tokens are byte ranges of the same bytes (a space and the text). Where
both end at the same byte and both next tokens begin with a space, the text is cut into windows. A window is known by
its two tuples of token ids alone: where its tokens end together, which of them overlap and how that is written down
is worked out once for each pair of tuples and remembered. What a document needs is put together from its windows.

Neither vocabulary has a token that goes on over a single space between two other characters, so the tokens of a text
are those of its pieces between such spaces. Pieces seen before are not encoded again, new ones are encoded many at a
time, and no long text needs all its tokens in memory.

How many documents hold a pair of ids linked is counted over the whole table: a chunk of texts sends each of its pairs
once, with the number of its documents that hold it, and gets back each pair's count and whether that is the highest of
its first id. Only these counts are shuffled, texts are read once.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.arrays import packed, small, unpacked
from lectern.llm.common import column, slices, text_of, written

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are worked on at a time, and of new pieces that are encoded as one text.
BATCH = 1 << 20
TOGETHER = 1 << 12
#: Remembered pieces and windows, and their characters; they bound the memory of a task.
REMEMBERED = 200_000
CHARACTERS = 1 << 25
#: Pairs and characters of a chunk, and pairs in one row.
PAIRS = 1_500_000
CHUNK = 1 << 26
SENT = 50_000

# How the first tokenizer cuts a text before it merges, and the characters on which two regex engines
# with tables of different age agree (Latin, its punctuation and the euro sign).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_SCRIPT = re.compile("[^\x00-ɏ‐-‧€]")
SPACE_MARK = "▁"

CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoders:
    """Both tokenizers of one task: ids of a text, and for every id its bytes."""

    def __init__(self, folder: str):
        path = os.path.join(folder, FIRST)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in model["added_tokens"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        self.first = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        # Merging by rank gives the same tokens here: every token is what merging makes of its own bytes (tested).
        ranks = {b: i for i, b in self.first.items()}
        self.fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, SECOND))
        self.second = {}
        for i in range(self.pieces.get_piece_size()):
            name = self.pieces.id_to_piece(i)
            hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", name) if self.pieces.is_byte(i) else None
            self.second[i] = bytes([int(hexed[1], 16)]) if hexed else name.replace(SPACE_MARK, " ").encode()
        self.tables = [_Table(self.first), _Table(self.second)]

    def encode_first(self, text: str) -> list[int]:
        """Ids of a space and the text."""
        if OTHER_SCRIPT.search(text):
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def encode_second(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


@cache
def _encoders(folder: str) -> Encoders:
    """Loaded once for all tasks of a worker."""
    return Encoders(folder)


class _Table:
    """Per id: its bytes, how many they are and whether they begin with a space."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.bytes = [tokens.get(i, b"") for i in range(size)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in self.bytes])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def encoded(pieces: list[str], encoders: Encoders) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Both tokenizers' ids of pieces laid end to end, as if a space stood before each, and the bytes at which they end.

    Returns the pieces in the order in which they are laid, and leaves out those whose bytes do not come back. Pieces of
    plain letters and signs are encoded some together.
    """
    plain = [p for p in pieces if p == p.strip() and not OTHER_SCRIPT.search(p)]
    single = [p for p in pieces if p != p.strip() or OTHER_SCRIPT.search(p)]
    size = np.cumsum([len(p) + 1 for p in plain]) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(plain)] if plain else [0]
    parts = [plain[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
    one, two = encoders.tables
    laid, first, second, ends, total = [], [], [], [], 0

    def lay(part: list[str], text: str, a: list[int], b: list[int]) -> bool:
        nonlocal total
        body = b" " + text.encode("utf-8", "surrogatepass")
        if one.joined(a) != body or two.joined(b) != body:
            return False
        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        stops = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in part])
        if len(part) > 1 and not (_ends_at(one.sizes[a], stops) and _ends_at(two.sizes[b], stops)):
            return False
        laid.extend(part)
        first.append(a)
        second.append(b)
        ends.append(stops + total)
        total += len(body)
        return True

    texts = [" ".join(part) for part in parts]
    for part, text, b in zip(parts, texts, encoders.encode_second(texts) if texts else (), strict=True):
        if not lay(part, text, encoders.encode_first(text), b):
            single += part
    for p in single:
        lay([p], p, encoders.encode_first(p), encoders.encode_second([p])[0])
    if not laid:
        return [], *[np.zeros(0, np.uint32)] * 2, np.zeros(0, np.int64)
    return laid, np.concatenate(first), np.concatenate(second), np.concatenate(ends)


def _ends_at(sizes: np.ndarray, stops: np.ndarray) -> bool:
    """Whether a token ends at each of the bytes."""
    ends = np.cumsum(sizes)
    return bool((ends[np.searchsorted(ends, stops)] == stops).all())


def windows(a: np.ndarray, b: np.ndarray, stops: np.ndarray, tables: list[_Table]) -> tuple[np.ndarray, ...]:
    """Where windows end in the joined tokens of some pieces: in ``a``, in ``b``, and at which byte.

    A window ends at a byte where both have a token's end and both next tokens begin with a space, or where a piece
    does; ``stops`` are the bytes at which pieces end.
    """
    ends_a, ends_b = np.cumsum(tables[0].sizes[a]), np.cumsum(tables[1].sizes[b])
    total = int(stops[-1])
    at_a, at_b = np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32)
    at_a[ends_a] = np.arange(1, len(a) + 1)
    at_b[ends_b] = np.arange(1, len(b) + 1)
    shared = np.flatnonzero((at_a > 0) & (at_b > 0))
    next_a = np.append(tables[0].spaced[a], True)[at_a[shared]]
    next_b = np.append(tables[1].spaced[b], True)[at_b[shared]]
    last = np.zeros(total + 1, bool)
    last[stops] = True
    cuts = shared[(next_a & next_b) | last[shared]]
    return at_a[cuts].astype(np.int64), at_b[cuts].astype(np.int64), cuts


def aligned(a: np.ndarray, b: np.ndarray, stops: np.ndarray, tables: list[_Table]):
    """Windows laid end to end, worked out together: per window its groups as text, their number and that of its links,
    and the links of all, ``first id << 32 | second id``. ``stops`` are the bytes at which windows end.

    Between two neighbouring token ends, of either side, lies exactly one overlap.
    """
    ends_a, ends_b = np.cumsum(tables[0].sizes[a]), np.cumsum(tables[1].sizes[b])
    every = np.union1d(ends_a, ends_b)
    links = a[np.searchsorted(ends_a, every)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, every)]
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n_links = np.diff(np.searchsorted(every, stops, "right"), prepend=0)
    last_group = np.searchsorted(shared, stops, "right")
    # Tokens in the order in which they are written: group by group, the first tokenizer's before the second's.
    last_a, last_b = np.searchsorted(ends_a, shared, "right"), np.searchsorted(ends_b, shared, "right")
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    place_a = np.arange(len(a)) + np.concatenate(([0], last_b))[group_a]
    place_b = np.arange(len(b)) + last_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a - 1]], mark[place_b[last_b - 1]] = ord("|"), ord(";")
    width = len(str(int(ids.max()))) if len(ids) else 1
    tens = 10 ** np.arange(width - 1, -1, -1)
    signs = np.empty((len(ids), width + 1), np.uint8)
    signs[:, :width] = ids[:, None] // tens % 10 + ord("0")
    signs[:, width] = mark
    shown = np.ones(signs.shape, bool)
    shown[:, : width - 1] = ids[:, None] >= tens[:-1]
    written_ = signs[shown].tobytes().decode("ascii")
    tail = np.cumsum(shown.sum(axis=1))[place_b[last_b[last_group - 1] - 1]].tolist()
    texts = [written_[s : e - 1] for s, e in zip([0, *tail[:-1]], tail, strict=True)]
    return texts, np.diff(last_group, prepend=0), n_links, links


class _Memory:
    """What is remembered of pieces and windows, and the numbers that the chunk's pairs have."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.pairs: dict[int, int] = {}
        self.documents = np.zeros(0, np.int64)
        self.forget()

    def forget(self) -> None:
        #: Windows by their ids; per window the text of its groups, and its tokens, groups, links and their pairs.
        self.windows: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.groups, self.links, self.flat = (np.zeros(0, np.int64) for _ in range(5))
        #: Pieces by their characters, -1 if their bytes do not come back; per piece its windows.
        self.pieces: dict[str, int] = {}
        self.parts, self.of_piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.characters = 0

    def full(self) -> bool:
        return max(len(self.windows), len(self.pieces)) > REMEMBERED or self.characters > CHARACTERS

    def numbers(self, pieces: list[str]) -> np.ndarray:
        known = self.pieces
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            self._learn(new)
        return np.array([known[p] for p in pieces], np.int64)

    def _learn(self, new: list[str]) -> None:
        laid, a, b, stops = encoded(new, self.encoders)
        if len(laid) < len(new):
            self.pieces.update(dict.fromkeys(new, -1))
        self.characters += sum(map(len, new))
        if not laid:
            return
        stop_a, stop_b, cuts = windows(a, b, stops, self.encoders.tables)
        body_a, body_b = a.tobytes(), b.tobytes()
        to_a, to_b = (stop_a * 4).tolist(), (stop_b * 4).tolist()
        keys = [
            (body_a[i:j], body_b[k:m]) for i, j, k, m in zip([0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, strict=True)
        ]
        self._align([k for k in dict.fromkeys(keys) if k not in self.windows])
        known = self.windows
        self.of_piece = np.append(self.of_piece, np.array([known[k] for k in keys], np.int64))
        self.pieces.update(zip(laid, range(len(self.parts), len(self.parts) + len(laid)), strict=True))
        self.parts = np.append(self.parts, np.bincount(np.searchsorted(stops, cuts), minlength=len(laid)))

    def _align(self, new: list[tuple[bytes, bytes]]) -> None:
        if not new:
            return
        a, b = (np.frombuffer(b"".join([k[i] for k in new]), np.uint32) for i in (0, 1))
        n_a, n_b = (np.array([len(k[i]) for k in new]) // 4 for i in (0, 1))
        tables = self.encoders.tables
        texts, groups, n_links, links = aligned(a, b, np.cumsum(tables[0].sizes[a])[np.cumsum(n_a) - 1], tables)
        distinct, at = np.unique(links, return_inverse=True)
        pairs = self.pairs
        number = np.array([pairs.setdefault(p, len(pairs)) for p in distinct.tolist()], np.int64)
        self.windows.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        self.characters += sum(map(len, texts))
        for name, values in (("n_a", n_a), ("n_b", n_b), ("groups", groups), ("links", n_links), ("flat", number[at])):
            setattr(self, name, np.append(getattr(self, name), values))


def _spread(values: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of these lengths) that are asked for, one behind the other."""
    begin, count = np.cumsum(counts) - counts, counts[which]
    return values[np.repeat(begin[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _batch(ids: list, texts: list[str], held: _Memory) -> dict:
    """The documents of one batch: their own columns, and for each its distinct pairs with how often it has them."""
    n = len(texts)
    out = {"ids": ids, "sha": [""] * n, "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    out |= {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "sizes")}
    cut = [CUT.split(t) if t else [] for t in texts]
    piece = held.numbers([p for pieces in cut for p in pieces])
    doc = np.repeat(np.arange(n), [len(pieces) for pieces in cut])
    good = np.bincount(doc, minlength=n) > 0
    good[doc[piece < 0]] = False
    piece, doc = piece[good[doc]], doc[good[doc]]
    if not len(piece):
        return out
    window, doc = _spread(held.of_piece, held.parts, piece), np.repeat(doc, held.parts[piece])
    use = np.flatnonzero(good)
    starts = np.searchsorted(doc, use)
    for column_, values in (("n_a", held.n_a), ("n_b", held.n_b), ("n_groups", held.groups), ("n_links", held.links)):
        out[column_][use] = np.add.reduceat(values[window], starts)
    name, listed = held.texts, window.tolist()
    for i, s, e in zip(use.tolist(), starts.tolist(), [*starts[1:].tolist(), len(listed)], strict=True):
        out["sha"][i] = hashlib.sha256(";".join([name[w] for w in listed[s:e]]).encode()).hexdigest()
    # Every document's pairs.
    codes = np.repeat(doc, held.links[window]) * len(held.pairs) + _spread(held.flat, held.links, window)
    codes.sort()
    new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    out["times"], codes = np.diff(np.append(new, len(codes))), codes[new]
    out["pairs"], out["sizes"] = codes % len(held.pairs), np.bincount(codes // len(held.pairs), minlength=n)
    documents = np.bincount(out["pairs"], minlength=len(held.pairs))
    documents[: len(held.documents)] += held.documents
    held.documents = documents
    return out


CHUNKS = "chunk long, payload binary, place array<int>, pair array<long>, documents array<long>"
_CHUNK = pa.schema(
    [
        ("chunk", pa.int64()), ("payload", pa.binary()), ("place", pa.list_(pa.int32())),
        ("pair", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())),
    ]
)


def _row(chunk: int, payload: bytes | None, place, pair, documents) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip([chunk, payload, place, pair, documents], _CHUNK, strict=True)],
        schema=_CHUNK,
    )


def _chunks(folder: str):
    """Chunks of texts: packed documents, and the chunk's pairs with the number of its documents that hold each."""

    def pack(found: dict) -> bytes:
        arrays = [packed(small(found[k])) for k in ("n_a", "n_b", "n_groups", "n_links", "sizes", "pairs", "times")]
        return pickle.dumps((found["ids"], found["sha"], arrays))

    def close(chunk: int, held: _Memory) -> Iterator[pa.RecordBatch]:
        pairs = np.fromiter(held.pairs, np.int64, len(held.pairs))
        for start in range(0, len(pairs), SENT):
            part = slice(start, start + SENT)
            place = np.arange(start, min(start + SENT, len(pairs)), dtype=np.int32)
            yield _row(chunk, None, place, pairs[part], held.documents[part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(folder)
        chunk, held, size = TaskContext.get().partitionId() << 24, _Memory(encoders), 0
        ids, texts, length = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, size, ids, texts, length
            if ids:
                yield _row(chunk, pack(_batch(ids, texts, held)), None, None, None)
                size += length
            ids, texts, length = [], [], 0
            if held.full():
                held.forget()
            if len(held.pairs) > PAIRS or size > CHUNK:
                yield from close(chunk, held)
                chunk, held, size = chunk + 1, _Memory(encoders), 0

        for batch in slices(batches, 64):
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids.append(doc_id)
                texts.append(text)
                length += len(text) + 1
                if length >= BATCH:
                    yield from flush()
        yield from flush()
        yield from close(chunk, held)

    return run


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _counted(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk with what the table knows of their pairs."""
    place = np.asarray(answers["place"], np.int64)
    count, best = (np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64) for _ in range(2))
    count[place] = np.asarray(answers["count"], np.int64)
    best[place] = np.asarray(answers["best"], np.int64)
    out: list[list] = [[] for _ in range(8)]
    for payload in documents["payload"]:
        ids, sha, arrays = pickle.loads(payload.as_py())
        n_a, n_b, n_groups, n_links, sizes, pairs, times = (unpacked(x).astype(np.int64) for x in arrays)
        ends = np.cumsum(sizes)
        sums = []
        for known in (best, count):
            total = np.concatenate(([0], np.cumsum(known[pairs] * times)))
            sums.append(total[ends] - total[ends - sizes])
        for target, values in zip(out, (ids, n_a, n_b, n_groups, n_links, *sums, sha), strict=True):
            target.extend(values if isinstance(values, list) else values.tolist())
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``.

    A null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros and an empty
    hash. Repeated rows are documents of their own and count as such; ids may be null. Long texts are aligned whole.
    Other columns are not read. ``folder`` holds both vocabularies and must be found by every executor.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    chunks = written(rows.mapInArrow(_chunks(folder), CHUNKS), "alignment-chunks")
    item = F.explode(F.arrays_zip("place", "pair", "documents")).alias("x")
    sent = chunks.filter("payload IS NULL").select("chunk", item).select("chunk", "x.place", "x.pair", "x.documents")
    counts = sent.groupBy("pair").agg(F.sum("documents").alias("count"))
    counts = counts.withColumn("first", F.shiftright("pair", 32).cast("int"))
    counts = written(counts, "alignment-counts")
    # One row for each id of the first vocabulary at most.
    highest = counts.groupBy("first").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "first").select(
        F.col("pair").alias("known"), "count", (F.col("count") == F.col("highest")).cast("int").alias("best")
    )
    answers = sent.join(counts.hint("merge"), F.col("pair") == F.col("known")).select("chunk", "place", "count", "best")
    answers = answers.select(*[F.col(c).alias(c) for c in answers.columns])
    documents = chunks.filter("payload IS NOT NULL").select(F.col("chunk").alias("chunk"), "payload")
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_counted, RESULT)


def op12(docs: DataFrame) -> DataFrame:
    return align(docs)
