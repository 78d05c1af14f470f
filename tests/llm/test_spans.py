"""Personal data and secrets against the rules written out with Python's re."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import pii, secret_scan
from lectern.llm.spans import running_totals

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def base_pii(text):
    out = []
    for kind, rule, keep in (
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 10 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), pii.BASE_KINDS.index(kind), m.end(), kind) for m in rule.finditer(text) if keep(m[0])]
    return sorted(out)


def base_secrets(text):
    out = []
    for kind, rule, keep in (
        ("assign", ASSIGN, lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ):
        kinds = secret_scan.BASE_KINDS
        out += [(m.start(), kinds.index(kind), m.end(), kind) for m in rule.finditer(text) if keep(m)]
    return sorted(out)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def odd_texts():
    rng = random.Random(5)
    pieces = [
        "a@b.c", "x.y@", "@", ".", "..", "a-b", "_", "%", "é", "😀", "\n", " ", "-", "+", "1", "22", "255", "256", "007",
        "1.2.3.4", "+1 (202) 555-0173", "4111 1111 1111 1111", "4111-1111-1111-1112", "token", "=", ": ", "'", '"',
        "password", "API_KEY", "apikey", "Secret", "abcdefgh12", "AKIA", "ABCDEF0123456789", "deadbeef" * 5, "sha:",
        "c.d.e", "mail", "K", "ſecret=abcdefghijk",
    ]
    texts = [None, "", " ", "a@b.c_d@e.f", "a@b..c", ".@q.r", "x@y.z.@q.r.s", "1.1.1.1.1.1.1.1", "+1 2"]
    texts += ["9" * 5000, "1 " * 4000, "a." * 3000 + "@b" + ".c" * 3000, "token=token:abcdefgh12", "x" * 50_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += [" ".join(["10.0.0.1"] * 500), "4111 1111 1111 1111, " * 200]
    return texts


@pytest.fixture(scope="module")
def docs(make):
    texts = odd_texts()
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    return make(rows + rows[:5])


@pytest.mark.parametrize(
    ("op", "base", "kinds"),
    [(pii.op2, base_pii, pii.BASE_KINDS), (secret_scan.op10, base_secrets, secret_scan.BASE_KINDS)],
)
def test_base_spans_match_the_rules(docs, op, base, kinds):
    got = sorted(
        (str(r["doc_id"]), *[r[f"n_{k}"] for k in kinds], r["base_sha256"]) for r in op(docs).collect()
    )
    want = []
    for r in docs.collect():
        found = base(r["text"] or "")
        sha = hashlib.sha256(joined(found).encode()).hexdigest()
        want.append((str(r["doc_id"]), *[sum(f[3] == k for f in found) for k in kinds], sha))
    assert got == sorted(want)


@pytest.mark.parametrize(("op", "base"), [(pii.op2, base_pii), (secret_scan.op10, base_secrets)])
def test_base_spans_stay_among_all(make, op, base):
    texts = odd_texts()
    rows = op(make(list(enumerate(texts)))).collect()
    for r in rows:
        have = r["spans"].split(",")
        assert all(s in have for s in joined(base(texts[r["doc_id"]] or "")).split(",") if s)


@pytest.mark.parametrize("op", [pii.op2, secret_scan.op10])
def test_empty_table(make, op):
    assert op(make([(1, "a")]).limit(0)).collect() == []


def test_running_totals(spark):
    values = [i % 7 for i in range(1000)]
    row = spark.createDataFrame([(values,), ([],), ([3],)], "v array<int>").select(running_totals(F.col("v"))).collect()
    assert row[0][0][-1] == sum(values) and row[0][0][499] == sum(values[:500])
    assert row[1][0] == [] and row[2][0] == [3]


def plain_entropy(s, w):
    import math
    from collections import Counter

    return max(
        -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)
    )


def test_entropy_is_that_of_the_best_window(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef0123") for _ in range(rng.randint(20, 90))) for _ in range(30)] + ["ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.best_entropy(F.col("t")))
    for t, h in rows.collect():
        assert h is None if len(t) < 20 else abs(h - plain_entropy(t, 20)) < 1e-9


def test_entropy_adds_random_strings_and_spares_known_ones(make):
    rows = secret_scan.op10(
        make([
            (1, "key Zx81Qp0vLm73Ty6Rw2Ka9 end"), (2, "uuid 123e4567-e89b-12d3-a456-426614174000"),
            (3, "Donaudampfschifffahrtsgesellschaft"), (4, "z" * 100 + "1"), (5, "f00d" * 6),
        ])
    ).collect()
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans == {1: "entropy_alnum:4:25", 2: "", 3: "", 4: "", 5: ""}


def test_labelers_add_spans_and_redaction_uses_them(make):
    rows = [(i, f"call my phone 202-555-{1000 + i} now") for i in range(40)]
    rows += [(100 + i, f"order {200 + i}-655-{1000 + i}") for i in range(5)]
    rows += [(200, "mail me: jo (at) mail (dot) com or jo@mail.com"), (201, None), (202, "card 4111111111111111")]
    found = pii.find_pii(make(rows))
    spans = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["pii"]] for r in found.collect()}
    assert spans[3] == [("phone", "202-555-1003")]
    assert ("email", "jo@mail.com") in spans[200]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert texts[3] == "call my phone <PHONE> now" and texts[201] is None and texts[202] == "card <CARD>"


def test_secrets_match_sql_on_odd_texts(make):
    import duckdb
    import pandas as pd

    rng = random.Random(11)
    alphabet = "abcdef0123456789", "ABCdefGHIjkl0123456789xyz", "aZ09+/_-bY18cX27"
    texts = [t for t in odd_texts() if t is None or len(t) < 3000]
    texts += [
        " ".join("".join(rng.choice(a) for _ in range(rng.randint(15, 60))) + rng.choice(["", "=", "=="]) for a in alphabet)
        for _ in range(60)
    ]
    texts += ["token=" + "q9Z" * 12 + " x=" + "Ab1+Cd2/Ef3-Gh4_Ij5Kl6", "uuid 123e4567-e89b-12d3-a456-426614174000 sample1234567890abcdeFGH"]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in secret_scan.op10(make(rows)).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(secret_scan.SQL).fetchall())
    assert got == want
    assert sum("entropy" in r[-1] for r in got) > 30
