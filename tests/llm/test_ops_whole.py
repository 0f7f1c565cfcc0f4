"""Inputs that the operators once passed over in part."""

import itertools
import zlib

import pytest

from quire.llm import licenses, pii, warc
from quire.llm.common import fresh_dir


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_long_urls(spark, gzip):
    rows = [(1, "u", "a" * 50), (2, "data:," + "x" * 70_000, "b" * 200), (3, "\U0001f600" * 9_000, "c" * 300), (4, "u" * 65_530, "b" * 200), (5, "u", "d")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archive(d, fresh_dir(spark, "w"), gzip=gzip)
    for size in (1000, 1 << 20):
        got = {r["page_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_archive(files, size).collect()}
        assert got == {1: ("response", 50), 2: ("response", 200), 3: ("response", 300), 4: ("revisit", 200), 5: ("response", 1)}


def test_warc_broken_chains_raise(spark, tmp_path):
    data = b"".join(warc.record_bytes(i, "u", b"q" * i, "ab" * 32, None) for i in range(1, 20))
    path = tmp_path / "x.warc"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data), 20)], "path string, bytes long, records long")
    with pytest.raises(ValueError, match="archives"):
        warc.read_archive(files, 500)
    at = data.rindex(b"WARC/1.")
    path.write_bytes(data[:at] + b"X" + data[at + 1 :])
    with pytest.raises(ValueError, match="archives"):
        warc.read_archive(warc.local_files(spark, [str(path)]), 500)


@pytest.mark.parametrize("text", ["CC-Zero 1.0 Universal", "cc_zero", "CC\nZERO", "cc  zero", "cc zero", "CC0"])
def test_licenses_cc_zero_however_parted(text):
    assert {x[0] for x in licenses.Scanner().scan(f"Given away, {text}.")[2]} == {"cc0"}


def test_redact_ignores_false_hits_of_the_bit_set(spark):
    rows = [(i, f"please dial hotline +1 (555) 000-{1000 + i} now") for i in range(20)]
    shared = {zlib.crc32(f"phone {p}".encode()) % pii.BITS for p in ("hotline", "dial hotline")}
    word = next(w for w in (f"w{i}x" for i in itertools.count()) if zlib.crc32(f"phone {w}".encode()) % pii.BITS in shared)
    rows += [(100, "please dial hotline 555 777 1234 now"), (101, f"the {word} 555 777 9999 now"), (102, None), (102, "hotline 555 777 1234, dial hotline 555 777 4321")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in pii.redact(d).where("doc_id >= 100 AND text IS NOT NULL").collect())
    assert got == [(100, "please dial hotline [PHONE] now"), (101, rows[21][1]), (102, "hotline [PHONE], dial hotline [PHONE]")]
    assert pii.redact(d).where("text IS NULL").count() == 1
