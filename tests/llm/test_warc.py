"""Archives written and read back: payloads byte by byte, verdicts against plain Python, marks of the format inside payloads."""

import base64
import gzip
import hashlib
import random

import pytest

from quillon.llm import common, warc

KIND = "page_id long, url string, html string, id int, type string, _id int, _html string, value string"
MARK = warc.BETWEEN


def sha1(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, least=0):
    most = {}
    for i, _, t in rows:
        if i is not None:
            most[t or ""] = max(i, most.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        to = most.get(t) if len(t.encode()) >= least and most.get(t) != i else None
        out.append((i, len(t.encode()), sha1(t), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "t", 2, "h", "v") for r in rows], KIND).repartition(parts)


def through(spark, rows, folder, parts=3, with_payload=True, **kw):
    warc.write_archives(frame(spark, rows, parts), folder, **kw)
    return warc.assemble(warc.read_records(spark, folder, with_payload))


PAGES = [
    (1, "http://a.org/x?y#z", "<p>same</p>"),
    (2, "https://b.org", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (4, "", None),
    (5, "no scheme\r\nEvil: header", ""),
    (6, "http://c.org/", "ünï 日本語\r\n\r\n"),
    (7, "http://c.org/", f"a{MARK}b"),
    (8, "http://c.org/", MARK),
    (9, "http://c.org/", f"{MARK}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc{MARK}{MARK}"),
    (10, "http://c.org/", "WARC/1.1\r\nWARC-Type: metadata\r\n\r\n"),
    (11, "http://c.org/", "\r\n\r\n\r\n\r\n"),
    (-12, "http://c.org/", "long " * 1_000_000),
    (13, "http://c.org/", "tie"),
    (13, "http://c.org/", "tie"),
    (13, "http://d.org/", "other"),
    (None, "http://e.org/", "other"),
    (None, "http://e.org/", "only null ids"),
    (None, "http://e.org/", "only null ids"),
]


@pytest.mark.parametrize(("rows", "bound", "least"), [(PAGES, 100_000, 0), (PAGES, 0, 0), (PAGES, 100_000, 4), ([(i, "http://h.org/", "hot" if i % 3 else f"p{i % 5}") for i in range(300)], 0, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, rows, bound, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    out = through(spark, rows, str(tmp_path / "w"), least=least)
    got = warc.captures(out)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least)
    texts = [t or "" for i, _, t in rows]
    for r in out.collect():
        assert r.request.uri == r.metadata.uri == r.response.uri and r.response.digest_ok in (True, None)
        if r.response.type == "response":
            assert bytes(r.response.payload).decode() in texts
        else:
            assert r.response.payload is None
    assert out.select("id").distinct().count() == len(rows)


def test_other_readers_agree(spark, tmp_path):
    """The files are a plain sequence of records, each as long as it says."""
    warc.write_archives(frame(spark, PAGES, 1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.gz")
    data, kinds = gzip.decompress(file.read_bytes()), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        data = rest[n + 4 :]
    assert sorted(kinds) == sorted(["request", "metadata"] * len(PAGES) + [x[3] for x in brute(PAGES)])


def test_pieces_cut_anywhere():
    rng = random.Random(3)
    blocks = [b"", b"x" * 50, MARK.encode() * 2, b"\r\n" * 9, b"tail"]
    whole = b"".join(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for b in blocks)
    pieces = whole.split(MARK.encode())
    for _ in range(20):  # a reader may miss some marks
        some, out, s = list(pieces), [], warc._Stream()
        for _ in range(rng.randrange(len(some))):
            i = rng.randrange(len(some) - 1) if len(some) > 1 else 0
            some[i : i + 2] = [MARK.encode().join(some[i : i + 2])]
        for p in some:
            out += [b for _, b in s.feed(p)]
        s.close()
        assert out == blocks
    for bad in (whole[:-20], whole.replace(b"Content-Length: 50", b"Content-Length: 40")):
        with pytest.raises(ValueError):
            s = warc._Stream()
            for p in bad.split(MARK.encode()):
                list(s.feed(p))
            s.close()


def test_empty(spark, tmp_path):
    out = through(spark, [], str(tmp_path / "w"), with_payload=False)
    assert not out.collect() and warc.captures(out).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
