import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import queries, warc

PAGES = "page_id bigint, url string, html string, payload_digest string, top int, record_type string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.text("AbC-", min_size=1, max_size=5), st.text("xyz :é", max_size=8).map(str.strip), max_size=3), st.binary(max_size=300)), max_size=8), st.integers(1, 50))
def test_monolithic_and_member_streams_hold_the_same_records(given_records, step):
    records = [warc.Record("response", h, b) for h, b in given_records]
    whole = warc.deflate(b"".join(r.dump() for r in records), 1)
    members = [warc.deflate(r.dump(), 6) for r in records]
    for data in (whole, b"".join(members)):
        chunks = (data[i : i + step] for i in range(0, len(data), step))
        assert list(warc.parse_stream(warc.inflate(chunks))) == records
    for r, m in zip(records, members):
        assert list(warc.parse_stream(warc.inflate(iter([m])))) == [r]


def test_broken_streams_are_reported():
    data = warc.Record("response", {}, b"abc").dump()
    for bad in (data[:-6], b"HTTP/1.1 200\r\n\r\n", data[:10]):
        try:
            list(warc.parse_stream(iter([bad])))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_round_trip_and_revisits(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a", big), (7, "http://b", big), (3, None, big), (None, "http://n", big), (4, "u", small), (5, "u", small), (6, "http://x\r\ny", None), (8, "", ""), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (2, "u", "y" * 1000)]
    found = warc.round_trip(spark.createDataFrame([(*r, "d", 1, "t") for r in rows], PAGES), "page_id", "url", "html").collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = {big: 7, "y" * 1000: 9}.get(h)
        again = top is not None and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert warc.round_trip(spark.createDataFrame([], PAGES), "page_id", "url", "html").collect() == []


def test_files_and_index(spark):
    """Archives are whole-file gzip, roll over by size, and become one member a record with a sidecar."""
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abc", k=5000)), "d", 1, "t") for i in range(40)], PAGES).coalesce(1)
    archives = warc.write_monolithic(warc.assign(pages, "page_id", "url", "html").coalesce(1), warc.page_record, warc.shared_folder(spark, "t"), most=50_000)
    assert archives.count() > 2 and archives.groupBy().sum("records").first()[0] == 40
    index = warc.normalise(archives, warc.shared_folder(spark, "t")).collect()
    assert len(index) == 40
    for path in {r.path for r in index}:
        data = open(path.removeprefix("file://"), "rb").read()
        lines = open(path.removeprefix("file://") + ".idx").read().splitlines()
        own = sorted((r for r in index if r.path == path), key=lambda r: r.offset)
        assert len(lines) == len(own) and sum(r.length for r in own) == len(data)
        for r in own:
            assert next(warc.parse_stream(warc.inflate(iter([data[r.offset : r.offset + r.length]])))).headers["WARC-Record-ID"] == r.record_id


def test_equals_sql(agree):
    agree(queries.QUERIES["op3_warc_normaliser"], queries.ORACLES["op3_warc_normaliser"])
