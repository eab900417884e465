from __future__ import annotations

import hashlib
import zipfile

import pytest
from pyarrow import fs

from tableweave.llm import warc_zip as Z


def brute(pages):
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        same = [j for j, h in pages if (h or "").encode() == raw] if len(raw) >= 1000 else [i]
        first = max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return out


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = [(k, h) for k, h in enumerate([None, "", "small", "small", big, big, big, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "\r\n\r\nWARC/1.1\r\n" * 100, "\x00\x01"])]
    df = spark.createDataFrame([(i, f"http://h/{i}\n" if i else None, h, 1) for i, h in pages], "page_id long, url string, html string, digest int")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Z.archive_round_trip(df).collect())
    assert got == brute(pages)
    archives = Z.write_archives(df, f"file://{tmp_path}/w", archive_bytes=3000)
    back = {r.page_id: r for r in Z.read_archives(archives, range_bytes=500).collect()}
    assert len(back) == len(pages)
    assert all(bytes(back[i].payload) == (h or "").encode() for i, h in pages if back[i].record_type == "response")
    assert Z.archive_round_trip(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    big = "y" * 2000
    df = spark.createDataFrame([(7, "u", big), (7, "u", big), (None, "u", big), (None, None, None)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in Z.archive_round_trip(df).collect())
    assert got == [("7", "response", "None"), ("7", "response", "None"), ("None", "response", "None"), ("None", "revisit", "7")]


@pytest.mark.parametrize("wide", [False, True])
def test_directories_are_read_as_they_are_written(tmp_path, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(4):
            z.writestr(f"m{k}ü.bin", bytes([k]) * (100 + k))
        z.writestr("packed", b"z" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    file = fs.LocalFileSystem().open_input_file(str(path))
    found = Z.zip_members(file)
    assert set(found) == {f"m{k}ü.bin" for k in range(4)}
    for k in range(4):
        header, size = found[f"m{k}ü.bin"]
        file.seek(Z.member_data(file, header))
        assert file.read(size) == bytes([k]) * (100 + k)
