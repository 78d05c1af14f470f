"""Pigeonhole matching against the full table of edit distances."""

import random

from lectern.llm import decontamination as dc


def distance_to_any_part(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        new = [0]
        for i, c in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != char)))
        row = new
        best = min(best, row[-1])
    return best


def masks_of(item):
    out = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.5:
            text = text[:40] + item[:5] + item[6:] + text[40:]
        assert dc.best_match(item, masks_of(item), text)[0] == distance_to_any_part(item, text)


def brute(docs, items):
    out = set()
    for d, text in docs:
        body = dc.normal(text or "")
        for i, item in items:
            wanted = dc.normal(item or "")
            if not wanted.strip():
                continue
            wanted = wanted if len(wanted) < dc.SHORT else wanted.strip()
            if distance_to_any_part(wanted, body) <= dc.budget(wanted, dc.RATE):
                out.add((d, i))
    return out


def cases():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "Ab"), (None, "lost item")]
    docs = []
    for d in range(80):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["x"], [item[at], "y"]])
            body.insert(len(body) // 2, "".join(item).upper() if d % 2 else "".join(item).replace(" ", ",\n"))
        docs.append((d, " ".join(body)))
    docs += [(90, None), (91, ""), (92, "so AB, it is"), (93, "cab abs"), (94, "word " * 50_000), (0, docs[0][1])]
    return docs, items


def test_matches_and_clean(make, spark):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute([d for d in docs if d[0] != 94], [i for i in items if i[0] is not None])
    got = dc.op6(make(docs), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert any(r["edits"] > 0 for r in got) and any(r["edits"] == 0 for r in got)
    left = dc.clean(make(docs), table)
    assert left.columns == make(docs).columns
    bad = {d for d, _ in want}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert {r["doc_id"]: r["text"] for r in left.collect()}[90] is None


def test_items_in_blocks_give_the_same(make, spark, monkeypatch):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, dc.op6(make(docs), table).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 300)
    assert sorted(map(str, dc.op6(make(docs), table).collect())) == whole
    assert dc.clean(make(docs), table).count() == len(docs) - len({r["doc_id"] for r in dc.op6(make(docs), table).collect()}) - 1


def test_empty_tables(make, spark):
    table = spark.createDataFrame([(1, "some item text")], "item_id long, text string")
    assert dc.op6(make([(1, "a")]).limit(0), table).collect() == []
    assert dc.op6(make([(1, "a")]), table.limit(0)).collect() == []
    assert dc.clean(make([(1, "a")]), table.limit(0)).count() == 1


def test_an_item_that_repeats_itself_is_counted_once_per_occurrence():
    item = "abcd " * 20
    searcher = dc.Searcher([(0, item)], dc.RATE)
    assert searcher.find("one " + item + "two") == {0: (0, 1)}
    assert searcher.find(item + "x y z " + item.replace("abcd", "abce", 2) + "w " + item) == {0: (0, 3)}
    assert searcher.find("nothing of it") == {}
