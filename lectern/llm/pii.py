"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

One pass counts the candidates by kind, votes and span features: a table whose size is bounded by the number of
categories, not by the data. Expectation-maximisation on the vote counts estimates how reliable each labeler is per
kind; the posteriors are the soft labels of a naive Bayes span classifier over the features. A second pass over the
texts scores every candidate with the trained weights, as column expressions. Spans that pass the fixed rules are
always kept; the classifier adds others, such as numbers that fail a checksum but stand behind "card".
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let, once
from lectern.llm import spans
from lectern.llm.common import text_of

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ssn", "iban"]

# Fixed rules, each made safe for long texts. Before the search, a dot that cannot join two parts of a domain becomes
# a percent sign and a separator that does not stand between digits a letter: both keep every offset, and a repeated
# group becomes a plain run of characters. A look-behind (or the end of the last match) stands for "no earlier start".
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
LOOSE_DOT = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]+"
LOOSE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Candidates beyond the fixed rules.
SPELLED_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[a-z0-9-]{1,63}+){1,4}"
LOCAL_PHONE = r"(?<![0-9+.()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"

# Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
DIAL_CODES = ("1", "33", "34", "39", "44", "49", "61", "81", "86", "91")
ISSUERS = ("3", "4", "5", "6")
IBAN_LANDS = ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "BE", "CH", "PT")

#: Words shortly before a span that speak for its kind.
CUES = {
    "email": r"mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|visa|master|amex|credit|debit|pay|konto|tarjeta|carte",
    "phone": r"phone|tel\b|call|mobile|fax|contact|reach",
    "ssn": r"ssn|social|security|tax",
    "iban": r"iban|account|bank|konto|cuenta|compte",
}
#: Words that speak against any kind.
AGAINST = r"version|order|ref(?:erence)?\b|isbn|release|build|invoice|part no"
REACH = 32
LABELERS = ("regex", "gazetteer", "context")
FEATURES = ("size", "digits", "left", "right", *LABELERS)
SPAN = "struct<kind:string,start:int,stop:int,value:string,fixed:boolean>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def weighed(d, i):
        doubled = d * F.when((i % 2) == 1, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(values, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def _as_spans(text: Column, kind: str, found: Column, fixed) -> Column:
    """The hits as spans; the value is read from the text itself, since the search may have run on a safe form."""
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
            F.substring(text, m["start"] + 1, m["stop"] - m["start"]).alias("value"),
            fixed(m["hit"]).alias("fixed"),
        ),
    )


def _ip_rule(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255"))
    return F.forall(parts, small)


def _candidates(text: Column) -> Column:
    """All candidate spans; ``fixed`` marks those that pass the fixed rules."""
    none = F.array().cast(f"array<{SPAN}>")

    def when(needed, found):
        return F.when(needed, found).otherwise(none)

    def size(hit):
        return F.char_length(_digits(hit))

    def card_rule(hit):
        return F.when(size(hit).between(14, 19), _luhn(_digits(hit))).otherwise(False)

    def likely_number(m):
        return size(m["hit"]).between(13, 19)

    has_digit = text.rlike("[0-9]")
    loose = F.regexp_replace(text, LOOSE_DOT, "%")
    strict = F.regexp_replace(text, LOOSE_SEPARATOR, "x")
    never, always = (lambda hit: F.lit(False)), (lambda hit: F.lit(True))
    base = F.concat(
        when(F.contains(text, F.lit("@")), _as_spans(text, "email", spans.matches(loose, EMAIL), always)),
        when(has_digit, _as_spans(text, "ip", spans.matches(text, IP), _ip_rule)),
        when(has_digit, _as_spans(text, "card", F.filter(spans.matches(strict, CARD), likely_number), card_rule)),
        when(
            F.contains(text, F.lit("+")),
            _as_spans(text, "phone", spans.matches(text, PHONE), lambda hit: size(hit).between(10, 15)),
        ),
    )
    others = F.concat(
        when(F.contains(F.lower(text), F.lit("at")) & text.rlike(r"(?i)[\[(]at[\])]"),
             _as_spans(text, "email", spans.matches(text, SPELLED_EMAIL), never)),
        when(has_digit, _as_spans(text, "phone", spans.matches(text, LOCAL_PHONE), never)),
        when(has_digit, _as_spans(text, "ssn", spans.matches(text, SSN), never)),
        when(has_digit, _as_spans(text, "iban", spans.matches(text, IBAN), never)),
    )

    def merged(base):
        fixed = F.filter(base, lambda s: s["fixed"])
        free = F.filter(F.concat(base, others), lambda s: ~s["fixed"])
        return let(fixed, lambda keep: F.concat(keep, F.filter(free, lambda s: ~spans.overlaps(s, keep))))

    return let(base, merged)


def _pick(kind: Column, by_kind: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in by_kind.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("yes")).when(no, F.lit("no")).otherwise(F.lit("none"))


def _described(text: Column, s: Column) -> Column:
    """Votes and features of one span, every one a value out of a short list."""
    kind, value = s["kind"], s["value"]
    digits = _digits(value)
    before = F.lower(F.substring(text, F.greatest(s["start"] - REACH + 1, F.lit(1)), F.least(s["start"], F.lit(REACH))))
    shape = _pick(
        kind,
        {
            "ssn": ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$"),
            "iban": F.char_length(value).between(15, 34),
            "phone": F.char_length(digits).between(7, 15),
            "email": value.rlike(r"(?i)[\[(]dot[\])]"),
        },
        F.lit(False),
    )
    listed = _pick(
        kind,
        {
            "email": F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*DOMAINS),
            "ip": ~value.rlike(r"^(0|127|255)\."),
            "card": F.left(digits, F.lit(1)).isin(*ISSUERS),
            "phone": value.rlike(r"^\+(" + "|".join(DIAL_CODES) + ")") | value.rlike(r"555|^\(?[2-9]"),
            "ssn": ~value.rlike("^(000|666|9)"),
            "iban": F.left(value, F.lit(2)).isin(*IBAN_LANDS),
        },
        F.lit(False),
    )
    cue = _pick(kind, {k: before.rlike(v) for k, v in CUES.items()}, F.lit(False))
    size = F.char_length(value)

    def side(char):
        return (
            F.when(char == "", "edge").when(char.rlike(r"[0-9]"), "digit").when(char.rlike(r"\s"), "blank")
            .when(char.rlike(r"\w"), "letter").otherwise("mark")
        )

    return F.struct(
        kind.alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), value.alias("value"),
        s["fixed"].alias("fixed"),
        _vote(s["fixed"] | shape, F.lit(True)).alias("regex"),
        _vote(listed, F.lit(True)).alias("gazetteer"),
        _vote(cue, before.rlike(AGAINST)).alias("context"),
        F.when(size < 10, "s").when(size < 16, "m").when(size < 25, "l").otherwise("xl").alias("size"),
        F.when(F.char_length(digits) * 2 < size, "few").when(digits == value, "all").otherwise("most").alias("digits"),
        side(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(F.lit(""))).alias("left"),
        side(F.substring(text, s["stop"] + 1, F.lit(1))).alias("right"),
    )


def _with_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    found = let(text_of(text), lambda t: F.transform(_candidates(t), lambda s: _described(t, s)))
    return docs.withColumn(out, found)


@dataclass(frozen=True)
class Model:
    """What the labelers are worth, and the weights of the span classifier."""

    reliability: dict[tuple[str, str], float]
    weights: dict[str, float]
    prior: dict[str, float]


def fit(docs: DataFrame, text: str = "text", rounds: int = 30) -> Model:
    """Estimate labelers and classifier from the candidates of all rows.

    The driver gets one row per combination of kind, votes and features: at most 6 kinds x 27 votes x 4 x 3 x 5 x 5
    combinations, whatever the input. Rows with no candidate, and empty tables, give the starting values.
    """
    spans_of = _with_spans(docs.select(F.col(text).alias("text")), "text", "_spans").select(
        F.explode(once(F.col("_spans"))).alias("s")
    )
    keys = ["kind", "fixed", *FEATURES]
    rows = spans_of.groupBy(*[F.col("s")[k].alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((tuple(r[k] for k in keys), r["n"]) for r in rows)
    votes: dict[tuple, int] = defaultdict(int)
    for (kind, _, *features), n in rows:
        votes[(kind, *features[-3:])] += n
    prior, agree = _em(votes, rounds)
    post = {key: _posterior(key, prior, agree) for key in votes}
    weights = _naive_bayes(rows, post)
    reliability = {(k, name): agree[k, name, "yes", 1] for k in KINDS for name in LABELERS}
    return Model(reliability, weights, prior)


def _posterior(key: tuple, prior: dict, agree: dict) -> float:
    kind, *votes = key
    yes, no = prior[kind], 1 - prior[kind]
    for name, vote in zip(LABELERS, votes, strict=True):
        yes *= agree[kind, name, vote, 1]
        no *= agree[kind, name, vote, 0]
    return yes / (yes + no)


def _em(votes: dict[tuple, int], rounds: int) -> tuple[dict, dict]:
    """Class prior per kind, and per labeler the chance of each vote given the class."""
    start = {("yes", 1): 0.6, ("no", 1): 0.1, ("none", 1): 0.3, ("yes", 0): 0.1, ("no", 0): 0.5, ("none", 0): 0.4}
    agree = {(k, name, v, c): p for k in KINDS for name in LABELERS for (v, c), p in start.items()}
    prior = dict.fromkeys(KINDS, 0.5)
    strength = 10.0  # the starting values weigh as much as ten spans
    for _ in range(rounds):
        mass: dict = defaultdict(float)
        for key, n in votes.items():
            p = _posterior(key, prior, agree)
            kind, *given = key
            for c, share in ((1, p * n), (0, (1 - p) * n)):
                mass[kind, c] += share
                for name, vote in zip(LABELERS, given, strict=True):
                    mass[kind, name, vote, c] += share
        prior = {k: (mass[k, 1] + strength / 2) / (mass[k, 1] + mass[k, 0] + strength) for k in KINDS}
        agree = {
            (k, name, v, c): (mass[k, name, v, c] + strength * start[v, c]) / (mass[k, c] + strength)
            for (k, name, v, c) in agree
        }
    return prior, agree


def _naive_bayes(rows: list, post: dict) -> dict[str, float]:
    """Log-odds of each feature value per kind, and the log prior odds, learned from the posteriors."""
    mass: dict = defaultdict(float)
    for (kind, _, *features), n in rows:
        p = post[(kind, *features[-3:])]
        for c, share in ((1, p * n), (0, (1 - p) * n)):
            mass[kind, c] += share
            for name, value in zip(FEATURES, features, strict=True):
                mass[kind, name, value, c] += share
    weights = {}
    for kind in KINDS:
        weights[kind] = math.log((mass[kind, 1] + 1) / (mass[kind, 0] + 1))
    for kind, name, value in sorted({k[:3] for k in mass if len(k) == 4}):
        yes = (mass[kind, name, value, 1] + 1) / (mass[kind, 1] + 5)
        no = (mass[kind, name, value, 0] + 1) / (mass[kind, 0] + 5)
        weights[f"{kind}|{name}|{value}"] = math.log(yes / no)
    return weights


def find_pii(
    docs: DataFrame, text: str = "text", out: str = "pii", model: Model | None = None, least: float = 0.5
) -> DataFrame:
    """The rows with ``out``: array<struct<kind, start, stop, value, fixed, score>>.

    Fixed spans have score 1. A null or empty text has none. Rows are neither joined nor grouped: repeated rows and
    null keys stay; a column already named ``out`` is replaced. Without a model one is fitted on the rows given.
    """
    model = model or fit(docs, text)
    table = F.create_map(*[F.lit(x) for kv in sorted(model.weights.items()) for x in kv])

    def score(s):
        total = F.coalesce(F.element_at(table, s["kind"]), F.lit(0.0))
        for name in FEATURES:
            key = F.concat_ws("|", s["kind"], F.lit(name), s[name])
            total = total + F.coalesce(F.element_at(table, key), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scored(s):
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"),
            s["fixed"].alias("fixed"), F.when(s["fixed"], F.lit(1.0)).otherwise(score(s)).alias("score"),
        )

    kept = let(F.transform(F.col(out), scored), lambda rows: F.filter(rows, lambda s: s["score"] >= least))
    return _with_spans(docs, text, out).withColumn(out, kept)


def redact(docs: DataFrame, text: str = "text", found: str = "pii") -> DataFrame:
    """The rows with every found span replaced by its kind in angle brackets; overlapping spans become one mark."""
    ordered = F.array_sort(
        F.transform(
            F.col(found),
            lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")),
        )
    )
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"),
        )

    marked = F.aggregate(
        ordered, start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(body, acc["at"] + 1)),
    )
    return docs.withColumn(text, F.when(F.size(F.col(found)) > 0, marked).otherwise(body))


def digest_columns(found: Column) -> dict[str, Column]:
    base = F.filter(found, lambda s: s["fixed"])
    return {f"n_{kind}": spans.count_of(base, kind) for kind in BASE_KINDS} | {"base_sha256": F.sha2(spans.digest(base, KINDS), 256), "spans": spans.digest(found, KINDS)}


def op2(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(name) for name, c in digest_columns(F.col("pii")).items()])
