import hashlib

import pytest

from socspan.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        rev = h in first and first[h] != i
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if rev else "response", first[h] if rev else None))
    return sorted(out, key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None)],
    [(5, "u", "x" * 200), (2, "u\r\nWARC/1.1", "x" * 200), (2, "u", "x" * 200), (None, "u", "x" * 200), (9, None, "x" * 99), (10, None, "x" * 99), (2**60 + 1, "v", "é" * 70)],
    [(i, f"u{i}", FAKE * (i % 4) + f"<p>{i % 7}</p>" + FAKE * (i % 3) + "y" * 50) for i in range(120)],
])
def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 4096)
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, digest string, first int")
    got = warc.read_warc(warc.write_warc(df.repartition(2)))
    got = got.select("page_id", "payload_bytes", "digest", "kind", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_long_urls(spark):
    rows = [(i, "u" * n, f"<p>{i}</p>" * 30) for i, n in enumerate([5, 4091, 70_000, 8, 1 << 20, *range(3990, 4010), 3])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.read_warc(warc.write_warc(df)).select("page_id", "url", "payload_bytes", "digest", "kind", "refers_to").collect()
    assert {r.page_id: r.url for r in got} == {i: u for i, u, _ in rows}
    assert sorted((r.page_id, *r[2:]) for r in got) == sorted(brute(rows))


def test_broken_chain_raises(spark, tmp_path):
    good = warc._record("response", 1, "u", b"abc", "0", None)
    for name, data in (("cut", good + good[:-9]), ("junk", good + b"no record here")):
        (tmp_path / name).write_bytes(data)
        manifest = spark.createDataFrame([(str(tmp_path / name), len(data), 2)], warc.MANIFEST)
        with pytest.raises(ValueError, match=name):
            warc.read_warc(manifest)
