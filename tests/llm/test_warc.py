import base64
import glob
import gzip
import hashlib

import pytest

from noteloom.llm.warc import RecordStream, archive_pages, read_member, read_records

ROWS = [
    (1, "u", "a\r\n"), (2, None, "a\r\n"), (3, "http://x\r\ny", "b\r\n\r\nWARC/1.0\r\n\r\n"), (4, "u", None), (5, "u", ""),
    (None, "n", "a\r\n"), (None, "n", "zz"), (6, "u", "é" * 100_000 + "\r\n\r\n\r\n"), (1, "u", "a\r\n"), (7, "u", "\r\n\r\n"),
] + [(i, f"u{i}", f"text {i}" * (i % 11)) for i in range(10, 60)] + [(i, "u", "copy") for i in range(100, 130)]


def expected():
    first = {}
    for i, _, text in ROWS:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, _, text in ROWS:
        payload = (text or "").encode()
        leader = first.get(text or "")
        revisit = leader is not None and leader != i
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield i, len(payload), digest, "revisit" if revisit else "response", leader if revisit else None


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "a")
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    return folder, archive_pages(pages, folder).collect()


def test_index_against_plain_python(archived):
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived[1]]
    assert sorted(got, key=repr) == sorted(expected(), key=repr)


def test_every_record_is_a_member_at_its_offset(archived):
    folder, index = archived
    for r in index:
        with open(f"{folder}/members/{r.archive}", "rb") as file:
            file.seek(r.offset)
            member = file.read(r.length)
        offset, record = read_member(member)
        assert offset == r.offset and record == gzip.decompress(member) and record.startswith(b"WARC/1.1\r\n")
        assert r.page_id is None or b"X-Page-Id: %d\r\n" % r.page_id in record


def test_normalising_changes_no_record(archived):
    def records(pattern):
        out = []
        for path in glob.glob(f"{archived[0]}/{pattern}"):
            with gzip.open(path) as file:
                stream = RecordStream()
                out += stream.feed(file.read())
                stream.close(path)
        return sorted(out)

    assert records("monolithic/*.gz") == records("members/part*")


def test_payloads_come_back(spark, archived):
    got = read_records(spark, f"{archived[0]}/members", with_payload=True).where("record_type = 'response'").collect()
    assert sorted({bytes(r.payload) for r in got}) == sorted({(t or "").encode() for _, _, t in ROWS})


def test_records_survive_any_cut():
    body = b"x\r\n\r\ny"
    stream = b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n" for _ in range(3))
    for size in (1, 3, 7, 1000):
        reader, out = RecordStream(), []
        for i in range(0, len(stream), size):
            out += reader.feed(stream[i:i + size])
        reader.close("a")
        assert b"".join(out) == stream and len(out) == 3
    reader = RecordStream()
    assert list(reader.feed(stream[:-9])) != []
    with pytest.raises(ValueError):
        reader.close("a")


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
