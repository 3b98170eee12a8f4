"""Round trips through the archives, and the revisit rule."""

import glob
import hashlib
import io
import struct

import pytest
import zstandard

from terrascope.llm import warc_dictionary as wd
from terrascope.session import shared_path


@pytest.fixture(scope="module")
def pages(spark):
    body = lambda k, n: f"<html><body>{k} " + "<p>same old boilerplate</p>" * n + "é</body></html>"
    rows = [(i, f"http://x/{i}", body(i, 40 + i % 5)) for i in range(120)]
    rows += [(200 + i, "http://copy", body("copy", 60)) for i in range(50)]  # a crowd of copies
    rows += [(300 + i, None, "tiny") for i in range(5)]
    rows += [(400, "http://a\r\nb", None), (401, None, ""), (None, "http://n", body("copy", 60)), (None, None, body("alone", 70)), (7, "http://x/7", body(7, 42))]
    rows += [(500, "http://long", "\r\n\r\nWARC/1.1 " * 300_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(4), rows


def expected(rows):
    last = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 1000:
            last[html] = max([x for x in (last.get(html), page_id) if x is not None], default=None)
    for page_id, url, html in rows:
        payload = (html or "").encode()
        first = last.get(html)
        again = first is not None and page_id != first
        yield (page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None)


def test_round_trip(pages):
    table, rows = pages
    key = lambda r: tuple((x is None, x) for x in r)
    got = wd.archive_and_read(table).collect()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)
    assert all(r.intact for r in got)
    assert {r.url for r in got if r.page_id == 400} == {"http://a%0D%0Ab"}


def test_archive_layout(spark, pages):
    """A skippable frame with the dictionary comes first, then one frame per record."""
    table, _ = pages
    folder = "file://" + shared_path(spark, "layout")
    index = wd.write_archives(wd.decided(table), folder).collect()
    files = glob.glob(folder[7:] + "/*.warc.zst")
    assert sorted(files) == sorted(r.path for r in index) and not glob.glob(folder[7:] + "/*.open")
    for r in index:
        data = open(r.path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        rest, frames = data[8 + size :], 0
        while rest:
            part = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            assert part.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, frames = part.unused_data, frames + 1
        assert frames == r.records


def test_too_few_records_for_a_dictionary():
    sink = io.BytesIO()
    wd.write_archive(sink, [wd.record(1, None, b"abc", "d", None)])
    sink.seek(0)
    ((headers, block),) = list(wd.read_archive(sink))
    assert headers["WARC-Record-ID"] == "<urn:page:1>" and block.endswith(b"\r\n\r\nabc")


def test_empty_table(spark):
    assert wd.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
