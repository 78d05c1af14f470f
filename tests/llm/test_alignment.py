"""Token alignment against a plain walk over byte ranges, and the facts about the vocabularies it rests on."""

import collections
import hashlib
import random

import pytest

from lectern.llm import alignment

NAMES = [c.split()[0] for c in alignment.RESULT.split(", ")]


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(alignment.FOLDER)


def expected(rows, encoders):
    first, second = encoders.first, encoders.second
    found = []
    for _, text in rows:
        a = encoders.slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = encoders.pieces.encode(text) if text else []
        body = (" " + (text or "")).encode()
        if not text or b"".join(first[i] for i in a) != body or b"".join(second[i] for i in b) != body:
            found.append(None)
            continue
        spans = []
        for ids, table in ((a, first), (b, second)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        found.append((len(a), len(b), groups, links))
    counts = collections.Counter(p for f in found if f for p in set(f[3]))
    highest = collections.Counter()
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    out = []
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((
            doc_id, a, b, len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    parts = ["th", "tion", "Été", "ñ", "ü", "ing", "er", "'s", "1234", "!!", "a", "Be", "€", "x y"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\t", "\n\n   ", " ▁"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 80)))
        rows.append((i, text))
    rows += [(70, None), (71, ""), (72, " "), (73, "  two  spaces "), (74, "日本語 text 🎉👩‍👩‍👧 ok"), (75, "<|endoftext|> <s> <unk>")]
    rows += [(76, "▁mark"), (77, "ﬁ ligature ½ Å"), (78, "\x00\x01 control"), (None, "a b c"), (None, "a b c")]
    rows += [(79, "Привет мир, как дела?"), (80, "word " * 3000), (3, rows[3][1]), (81, "x" * 5000)]
    return rows


def plain(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_byte_ranges(make, encoders):
    rows = corpus()
    assert plain(alignment.op12(make(rows))) == expected(rows, encoders)


def test_pieces_batches_and_chunks(make, encoders, monkeypatch):
    """Bounds of memory change nothing in the result."""
    for name, value in (("TOGETHER", 50), ("BATCH", 300), ("REMEMBERED", 20), ("PAIRS", 60), ("SENT", 7)):
        monkeypatch.setattr(alignment, name, value)
    rows = corpus()
    assert plain(alignment.op12(make(rows))) == expected(rows, encoders)


def test_empty(make):
    assert alignment.op12(make([(1, "a")]).limit(0)).collect() == []
    assert plain(alignment.op12(make([(1, ""), (None, None)]))) == sorted(
        [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str
    )


def test_merging_by_rank_is_merging_by_rules(encoders):
    """Every token is what the rules make of its own bytes, so both ways of merging agree on all texts."""
    letters = {b: c for c, b in alignment.byte_letters().items()}
    model = encoders.slow.model
    for i, token in encoders.first.items():
        assert [t.id for t in model.tokenize("".join(letters[b] for b in token))] == [i]


def test_both_encoders_cut_alike(encoders):
    """Around every character on which the fast encoder is used."""
    kept = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    for c in kept:
        for text in (f"a{c}b", f"a {c} b", f"1{c}{c}2", f"{c}", f"  {c}x\n{c}\n", f"x'{c}s {c}9{c}."):
            assert not alignment.OTHER_SCRIPT.search(text)
            slow = encoders.slow.encode(" " + text, add_special_tokens=False).ids
            assert encoders.encode_first(text) == slow, repr(text)


def test_no_token_goes_on_over_a_word_break(encoders):
    for table in (encoders.first, encoders.second):
        assert not [t for t in table.values() if alignment.CUT.search(t.decode(errors="replace"))]


def test_windows_are_cut_at_shared_spaces(encoders):
    text = "One two  three\nfour"
    pieces = alignment.CUT.split(text)
    assert pieces == ["One", "two  three\nfour"]
    laid, first, second, ends = alignment.encoded(pieces, encoders)
    assert sorted(laid) == sorted(pieces)
    a, b, cuts = alignment.windows(first, second, ends, encoders.tables)
    body = "".join(" " + p for p in laid).encode()
    words = [body[s:e] for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
    assert b" One" in words and b" two" in words and b"".join(words) == body
    assert a[-1] == len(first) and b[-1] == len(second)
