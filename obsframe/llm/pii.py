"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Only DataFrame functions are used. For each kind one ``regexp_replace`` puts marks around
the matches (leftmost, not overlapping) and a split at the marks gives the texts between
and inside them, whose lengths are summed to positions. All positions are code points, the
end exclusive. The patterns are possessive and start only where a match can start, so that no long run is scanned twice.

Spans of the four base kinds (email, ip, card, phone) are never dropped for their
score. The method adds ``iban`` (letters and digits whose remainder modulo 97 is 1) and
``payment`` (13 to 15 digits that pass Luhn), which need ``ENOUGH`` score: an iban has it from
its checksum unless words nearby speak against it, a payment number only beside words that speak for it.

A null text is an empty one and has no spans. Each row is worked on by itself, so ties,
repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.columns import own, spare

MARK, NO_MARK = "\x01", "\x02"   # a mark in the text itself is read as another control character of equal length
STEP = 256                       # pieces whose lengths are summed one by one
NEARBY = 40                      # code points before a span in which words count
ENOUGH = 0.6
BASE = ["email", "ip", "card", "phone"]

# What the kinds are, possessive so that they run in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
GATES = {"email": "@", "ip": ".", "phone": "+"}   # without it a text has no match
#: Score of a confirmed span, and words before it that add to or take from it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "payment": 0.4}
FOR = {
    "email": r"\b(e-?mail|mail|contact|write)\b", "ip": r"\b(ip|host|server|address|client)\b",
    "card": r"\b(card|credit|debit|visa|amex|pay|payment)\b", "phone": r"\b(phone|tel|call|mobile|fax)\b",
    "iban": r"\b(iban|bank|account|konto|cuenta|compte)\b", "payment": r"\b(card|credit|debit|visa|amex|pay|payment)\b",
}
AGAINST = r"\b(version|release|serial|isbn|order|invoice|example|test)\b"
ADDS, TAKES = 0.25, 0.3


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _pieces(plain: Column, kind: str) -> Column:
    """Texts between and inside matches, in turn."""
    marked = F.split(F.regexp_replace(plain, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(plain.contains(GATES[kind]), marked) if kind in GATES else marked


def _steps(lengths: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")),
                       lambda s: F.slice(lengths, s * STEP + 1, F.lit(STEP)))


def _starts(steps: Column, sums: Column) -> Column:
    """Position of each piece: sums inside its step on top of sums of whole steps.

    ``sums`` is bound as an element of an array, since the optimizer would move a column that is read once into the loop.
    """
    return F.flatten(F.flatten(F.transform(F.array(sums), lambda held: F.transform(steps, lambda own, s: F.transform(
        own, lambda _, i: _add(F.slice(held, F.lit(1), s)) + _add(F.slice(own, F.lit(1), i)))))))


def _matches(pieces: Column, starts: Column) -> Column:
    """All matches as structs of start, end, value and the text before, back to the last match at most."""
    return F.when(F.size(pieces) > 2, F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(
        starts[i].alias("start"), starts[i + 1].alias("end"), pieces[i].alias("value"),
        F.lower(F.right(pieces[i - 1], F.lit(NEARBY))).alias("before"))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end and letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def push(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), push)


def _parts_fit(value: Column) -> Column:
    """No part above 255, however many zeros lead or digits follow."""
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))


CONFIRM = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: _parts_fit(s["value"]),
    "card": lambda s: F.char_length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"])),
    "phone": lambda s: F.char_length(_digits(s["value"])).between(8, 15),
    "iban": lambda s: F.char_length(F.replace(s["value"], F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(s["value"]) == 1),
    "payment": lambda s: F.char_length(_digits(s["value"])).between(13, 15) & F.call_function("luhn_check", _digits(s["value"])),
}


def _scored(kind: str, found: Column) -> Column:
    def score(span: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind])
                       + F.when(span["before"].rlike(FOR[kind]), ADDS).otherwise(0.0)
                       - F.when(span["before"].rlike(AGAINST), TAKES).otherwise(0.0))), 2)

    confirmed = F.filter(found, CONFIRM[kind])
    scored = F.transform(confirmed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                       s["value"].alias("value"), score(s).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= ENOUGH)


def find(docs: DataFrame, name: str = "spans") -> DataFrame:
    """All columns of ``docs`` and the spans of ``text``; an existing column ``name`` is replaced.

    A span is (kind, start, end, value, score); kinds come in the order of ``BASE``, then the
    added ones, each by start. Every step is a column of its own that several later ones read, so each is worked out once.
    """
    at = spare(docs, "_pii")
    plain = f"{at}_plain"

    def step(number: int, kind: str) -> str:
        return f"{at}_{kind}_{number}"

    out = docs.withColumn(plain, F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(NO_MARK)))
    for number, make in enumerate([
        lambda k: _pieces(F.col(plain), k),
        lambda k: F.transform(step(0, k), F.char_length),
        lambda k: _steps(F.col(step(1, k))),
        lambda k: F.transform(step(2, k), _add),
        lambda k: _starts(F.col(step(2, k)), F.col(step(3, k))),
        lambda k: _matches(F.col(step(0, k)), F.col(step(4, k))),
    ]):
        out = out.withColumns({step(number, kind): make(kind) for kind in PATTERNS})
    empty = F.expr("cast(array() as array<struct<kind: string, start: int, end: int, value: string, score: double>>)")
    found = [F.coalesce(_scored(kind, F.col(step(5, "card" if kind == "payment" else kind))), empty) for kind in SCORES]
    return out.select(*own(docs.drop(name)), F.concat(*found).alias(name))


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans and their scores: one row per row."""
    found = find(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))
