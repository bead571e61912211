import hashlib

from lexiweave.llm import warc


def expected(rows):
    best = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        refers = best[h] if h in best and i is not None and best[h] != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/1", "<p>é</p>" * 300), (2, "http://a/2", "<p>é</p>" * 300), (3, None, None), (4, "http://b/ x\r\ny", "short"), (5, "u", "short"),
    (6, "u", FAKE * 3), (7, "u", "before " + FAKE + " after"), (8, "u", "WARC/1.0\r\n"), (9, "u", "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 60), (10, "u", "\r\n\r\n" * 400),
    (11, "u", "\r\n\r\n" * 400), (12, "u", ""), (None, "u", "x" * 2000), (13, "u", "x" * 2000), (14, "u", FAKE * 40), (15, "u", FAKE * 40), (16, "u", "WARC/1.0\r"), (17, "u", "W"), (18, "u", "x" * 999 + "y"), (19, "u", "x" * 999 + "y"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, file string").repartition(3)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    got = warc.archive(frame(spark, ROWS), path=path)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(ROWS)
    payloads = {r.page_id: r.payload for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in ROWS if i in payloads)


def test_splits(spark, tmp_path):
    rows = [(i, "u", f"page {i} " + (FAKE if i % 3 == 0 else "text ") * (i % 17)) for i in range(50)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        warc.write(frame(spark, rows), f"file://{tmp_path}/w", files=2)
        for size in ("997", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read(spark, f"file://{tmp_path}/w").drop("uri", "payload")
            assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damage_is_noticed(spark, tmp_path):
    warc.write(frame(spark, [(1, "u", "some payload")]), f"file://{tmp_path}/w", files=1)
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    part.write_bytes(part.read_bytes().replace(b"some payload", b"same payload"))
    (tmp_path / "w" / f".{part.name}.crc").unlink()
    import pytest

    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, f"file://{tmp_path}/w").collect()


def test_empty(spark):
    assert warc.archive(frame(spark, ROWS).limit(0)).collect() == []


def test_archives_of_others(spark, tmp_path):
    import base64
    import gzip

    def record(version, kind, name, block, extra=""):
        head = f"WARC/{version}\r\nwarc-type: {kind}\r\nWarc-Record-Id: <urn:uuid:{name}>\r\nwarc-target-uri: http://x/{name}\r\n{extra}content-length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    body = "<p>été WARC/1.1\r\n</p>".encode()
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    parts = [
        record("1.0", "warcinfo", "a", b"software: y\r\n"), record("1.1", "response", "b", http, f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha}\r\n"),
        record("1.1", "response", "c", body), record("1.0", "revisit", "d", b"", f"WARC-Payload-Digest: sha1:{sha.lower()}\r\n"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/one.warc").write_bytes(b"".join(parts))
    (tmp_path / "w/two.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = sorted(tuple(r) for r in warc.read(spark, f"file://{tmp_path}/w").select("record_id", "record_type", "payload_bytes", "payload_digest", "payload", "uri").collect())
    hexed, text = hashlib.sha1(body).hexdigest(), body.decode()
    want = [("urn:uuid:a", "warcinfo", None, None, None), ("urn:uuid:b", "response", len(body), hexed, text), ("urn:uuid:c", "response", len(body), hexed, text), ("urn:uuid:d", "revisit", None, hexed, None)]
    assert got == sorted((*w, f"http://x/{w[0][-1]}") for w in want for _ in range(2))


def test_long_lists_are_joined_by_salted_shuffles(spark, tmp_path, monkeypatch):
    from lexiweave.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = warc.archive(frame(spark, ROWS), path=f"file://{tmp_path}/w")
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(ROWS)


def test_a_very_long_payload(spark, tmp_path):
    rows = [(1, "u", "long " * 400_000 + FAKE), (2, "u", "x")]
    got = warc.archive(frame(spark, rows), path=f"file://{tmp_path}/w")
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
