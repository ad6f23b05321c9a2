"""Spans against plain regular expressions and checksums in Python."""
import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    good = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
        "phone": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good[k](m.group(0))]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        wanted = base(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in wanted)
        found = [s for s in out[i].spans.split(",") if s and s.split(":")[0] in pii.BASE]
        assert found == [s for s in written.split(",") if s], text
        assert out[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in wanted) for k in pii.BASE]
        assert len(out[i].scores) == len([s for s in out[i].spans.split(",") if s])
    return [out[i] for i in range(len(texts))]


TEXTS = [
    None, "", "a@b.co_x@d.com", "x@y x@y.z.w. @a.b", "😀é me.you+z%@mail-1.example.com, 10.0.0.1", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 12.3.4",
    "00000000000000000255.1.1.1 99999999999999999999.1.1.1 1234567890255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111 1111 1111 1111 4111 1111 1111 1111", "+1 (017) 555-7713 +49 30 123456, +12 ++123456789", "a\x01b@c.de\x01 4111111111111111\x01",
    "+4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "٣٤٥٦ ４１１１", "a@b.c" * 700, "+1 555 123 4567 , " * 900,
]


def test_base_spans(spark):
    check(spark, TEXTS)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a0146.@+-( )_é", max_size=60), min_size=40, max_size=60))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [r.text for r in docs.select("text").collect()])


def test_long_runs_take_linear_time(spark):
    began = time.time()
    check(spark, ["1." * 60_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "1 " * 200_000])
    docs = spark.createDataFrame([(1, "a" * 400_000 + " @")], "doc_id long, text string")  # too slow for the plain pattern
    assert pii.span_digests(docs).first().spans == ""
    assert time.time() - began < 60


def test_checksums_and_words_nearby(spark):
    iban, amex = "GB82 WEST 1234 5698 7654 32", "378282246310005"
    texts = [f"my iban {iban}", iban.replace("82", "83"), f"test {iban}", f"amex {amex}", amex, f"card {amex[:-1]}6", "card 4111 1111 1111 1111",
             "4111 1111 1111 1111", "version 1.2.3.4"]
    out = check(spark, texts)
    kinds = [[s.split(":")[0] for s in r.spans.split(",") if s] for r in out]
    assert kinds == [["iban"], [], [], ["payment"], [], [], ["card"], ["card"], ["ip"]]
    assert out[0].spans == "iban:8:35" and out[0].scores == [1.0]
    assert out[6].scores > out[7].scores and out[8].scores == [0.2]


def test_odd_tables(documents):
    docs = documents([(None, "x@y.zz"), (None, None), (1, "x@y.zz"), (1, "x@y.zz")])
    out = pii.find(docs, name="score")
    assert set(out.columns) == set(docs.columns) and sorted(len(r.score) for r in out.collect()) == [0, 1, 1, 1]
    assert pii.span_digests(documents([])).count() == 0


def test_no_python_in_the_plan(documents):
    plan = pii.span_digests(documents(TEXTS and [(1, "a")], extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
