import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm import warc

SAME, NASTY = "same payload " * 20, "a\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n" * 30
PAGES = [(5, SAME), (3, SAME), (9, SAME), (1, "tiny"), (2, "tiny"), (4, None), (6, ""), (7, "é漢😀" * 60_000), (8, NASTY),
         (10, "x" * 99), (11, "x" * 99), (12, "y" * 100), (13, "y" * 100)]


def brute(pages):
    out = []
    for i, html in pages:
        data = (html or "").encode()
        first = min(j for j, other in pages if (other or "").encode() == data)
        again = len(data) >= 100 and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None))
    return sorted(out, key=repr)


@pytest.fixture
def table(spark):
    def make(pages):
        return spark.createDataFrame([(i, None if i == 5 else f"http://h.example/{i}", h, "digest") for i, h in pages],
                                     "page_id long, url string, html string, digest string")
    return make


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_framing(payload, size):
    assert warc.unframe(warc.frame(payload, size)) == payload


@pytest.mark.parametrize("broken", [b"", b"5\r\nab", b"zz\r\n", b"2\r\nabX\r\n0\r\n\r\n", b"-1\r\n\r\n"])
def test_broken_framing(broken):
    with pytest.raises(ValueError):
        warc.unframe(broken)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=400), st.integers(7, 200))
def test_records(payload, segment):
    found = list(warc.page_records("7", "http://a\r\nb/", payload, hashlib.sha256(payload).hexdigest(), None, segment))
    records = list(warc.parse(b"".join(r + b"\r\n\r\n" for r in found)))
    assert len({r[4] for r in records}) == len(records) and records[0][0] == "7"
    block = b"".join(r[-1] for r in records)
    assert warc._payload(block) == (payload, None)
    if len(records) > 1:
        assert [r[6] for r in records] == list(range(1, len(records) + 1)) and records[-1][7] == len(block)
        assert {r[5] for r in records[1:]} == {records[0][4]}


@pytest.mark.parametrize("segment, per_file", [(warc.SEGMENT, warc.PER_FILE), (300, 3)])
def test_round_trip(table, rows, segment, per_file):
    assert rows(warc.round_trip(table(PAGES).repartition(3), segment, per_file)) == brute(PAGES)


def test_payloads(spark, table, tmp_path):
    warc.write(table(PAGES), f"{tmp_path}/w", segment=5000)
    found = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    for i, html in PAGES:
        if found[i].record_type == "response":
            assert bytes(found[i].payload) == (html or "").encode() and found[i].problem is None
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert sum(1 for _ in warc.parse(raw)) > len(PAGES)


def test_lost_and_damaged_segments(spark, rows):
    payload = b"z" * 1000
    found = [list(warc.parse(r + b"\r\n\r\n"))[0] for r in warc.page_records("1", "u", payload, hashlib.sha256(payload).hexdigest(), None, 300)]
    damaged = [r[:-1] + (r[-1] + b"!" if r[6] == 2 else r[-1],) for r in found]

    def problem(records):
        row, = warc.reassemble(spark.createDataFrame(records, warc.RECORD)).collect()
        return row.problem

    assert problem(found[::-1]) is None
    assert problem(found[:1] + found[2:]) == "segments [1, 3, 4]"
    assert "instead of" in problem(damaged)


def test_odd_tables(table, rows):
    odd = [(None, SAME), (None, SAME), (3, "tiny"), (3, "tiny"), (4, SAME), (4, SAME), (2 ** 60 + 1, SAME)]
    digest = hashlib.sha256(SAME.encode()).hexdigest()
    out = rows(warc.round_trip(table(odd)), "page_id", "record_type", "refers_to")
    assert out == sorted([(None, "revisit", 4)] * 2 + [(3, "response", None)] * 2 + [(4, "response", None)] * 2
                         + [(2 ** 60 + 1, "revisit", 4)], key=repr)
    assert {r[0] for r in rows(warc.round_trip(table([(None, SAME), (None, SAME)])), "payload_digest")} == {digest}
    assert warc.round_trip(table([])).count() == 0
