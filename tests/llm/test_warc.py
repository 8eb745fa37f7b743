import base64
import glob
import gzip
import hashlib

import pytest

from tabsift.llm.warc import archive, chunk_rows, read_records, read_segments, write_archive

ROWS = [
    (1, "http://a/\r\nX: y", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None),
    (4, "http://c", ""), (5, "http://d", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://e", "ends\r\n"), (7, "http://f", "é\n\r" * 700), (8, "http://g", "é\n\r" * 700),
    (9, "http://h", "a\r\n" * 100), (None, "http://i", "<p>one</p>"), (11, "http://j", "x" * 50),
    (11, "http://j", "x" * 50), (12, "http://k", "\r"), (0, "http://l", "\r\r\n\n"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(
        [(*r, "z", 1) for r in rows], "page_id long, url string, html string, data string, uid int")


def plain(rows, least=0):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    firsts, out = {}, []
    for i in sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, i)):
        page, b = data[i]
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        if len(b) >= least and b in firsts:
            out.append((page, len(b), digest, "revisit", firsts[b]))
        else:
            firsts.setdefault(b, page)
            out.append((page, len(b), digest, "response", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, chunk, least):
    got = archive(pages(spark), least, chunk).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(ROWS, least)


def test_chunk_rows_carry_running_digests(spark):
    df = chunk_rows(pages(spark), 10)
    by = {}
    for r in df.collect():
        by.setdefault(r.uid, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.chunk)
        so_far = b""
        for r in rows:
            assert len(r.data) <= 10
            so_far += bytes(r.data)
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
            assert r.bytes_so_far == len(so_far)
        assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    assert len(by) == len(ROWS)


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(pages(spark), path)
    seen = 0
    for file in glob.glob(f"{path}/*.gz"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(fields[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            data, seen = rest[size + 4:], seen + 1
    assert seen == len(ROWS)


def test_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(pages(spark), path, min_revisit_bytes=10**9, chunk_bytes=13)
    by = {}
    for r in read_segments(spark, path).collect():
        by.setdefault(r.record, []).append((r.segment or 1, bytes(r.data)))
    got = sorted(b"".join(d for _, d in sorted(v)) for v in by.values())
    assert got == sorted((h or "").encode() for _, _, h in ROWS)


def test_a_damaged_archive_fails(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(pages(spark, ROWS[:1]), path)
    file = glob.glob(f"{path}/*.gz")[0]
    data = gzip.open(file).read().replace(b"<p>one", b"<p>two")
    bad = tmp_path / "bad"
    bad.mkdir()
    with gzip.open(bad / "a.txt.gz", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="differs from its digest"):
        read_records(spark, str(bad)).collect()


def test_empty_table(spark):
    assert archive(pages(spark, [])).count() == 0
