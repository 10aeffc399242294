import base64
import hashlib

import pytest

from recollect.llm import warc as W


def test_round_trip_with_magic_inside_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://x/{i}", fake * (i % 5) + "é" * i + ("x" * 5000 if i % 7 == 0 else "")) for i in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nb", ""), (102, "u", rows[9][2]), (103, "u", rows[9][2]), (9, "again", rows[9][2]), (None, "n", "lone"), (None, "n", rows[9][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    path = f"file://{tmp_path}/w"
    W.write_warc(df, path)
    for split in (256, 4096, 1 << 20):
        got = W.read_warc(spark, path, split_bytes=split).collect()
        assert len(got) == len(rows)
        text = {}
        for i, _, h in rows:
            text.setdefault(i, []).append(h or "")
        for r in got:
            i = r.record_id[len("<urn:x-page:") : -1]
            want = text[int(i) if i else None]
            assert any(r.payload_bytes == len(t.encode()) and r.digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in want)
            if r.record_type == "response":
                assert r.payload.decode() in want
    out = W.archive_round_trip(df, split_bytes=512).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    by = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in out)
    want = []
    for i, _, h in rows:
        f = first.get(h or "")
        rev = f is not None and (i is None or i > f)
        want.append((-1 if i is None else i, "revisit" if rev else "response", f if rev else -1))
    assert by == sorted(want)


def test_broken_chains_are_told(spark, tmp_path):
    record = lambda body, kind="response": b"WARC/1.1\r\nWARC-Type: " + kind.encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    good, n = record(b"h\r\n\r\none"), len(record(b"h\r\n\r\none"))
    files = {"whole": good * 9, "hole": good * 3 + b"no record here\r\n\r\n" + good * 3, "cut": (good * 3)[:-9], "none": b"nothing at all", "empty": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for split in (64, 1 << 20):
        assert W.read_warc(spark, f"file://{tmp_path}/whole", split_bytes=split).count() == 9
        got = sorted((r.path.rsplit("/", 1)[1], r.off, r.record_type) for r in W.read_warc(spark, f"file://{tmp_path}", split_bytes=split, strict=False).collect())
        ok = lambda name, k: [(name, i * n, "response") for i in range(k)]
        assert got == sorted([*ok("whole", 9), *ok("hole", 3), ("hole", 3 * n, "broken"), *ok("cut", 2), ("cut", 2 * n, "broken"), ("none", 0, "broken")])
    with pytest.raises(Exception, match="breaks at byte"):
        W.read_warc(spark, f"file://{tmp_path}/hole")


def test_empty(spark):
    assert W.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_small_payloads_are_not_compared(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in W.archive_round_trip(df, min_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_payloads_of_nothing_but_magic_are_read_in_a_line(tmp_path):
    import time

    magic = b"WARC/1.1\r\n"
    record = magic + b"Content-Length: 3\r\nX: y\r\n\r\n"
    for filler in (magic, magic + b"no field\r\n", magic + b"a: b\r\n"):
        data = filler * (4_000_000 // len(filler)) + record + b"abc\r\n\r\n"
        path = tmp_path / "f"
        path.write_bytes(data)
        f = W._File(f"file://{path}", len(data))
        for loaded in (len(data), 1000):  # also where a head runs on beyond what the split holds
            f.load(0, loaded)
            t = time.perf_counter()
            places = [k for k in range(0, min(loaded, 4_000_000 // len(filler) * len(filler)), len(filler)) if f.header(k)]
            assert not places and time.perf_counter() - t < 10
        assert f.header(len(data) - len(record) - 7) == ({"content-length": "3", "x": "y"}, len(data) - 7)
    cut = tmp_path / "cut"
    cut.write_bytes(record[:-2])
    assert W._File(f"file://{cut}", len(record) - 2).header(0) is None
