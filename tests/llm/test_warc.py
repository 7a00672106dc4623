import gzip
import io
import random

import pytest

from lumitide.llm import warc as W

from .conftest import SF


def make(rng, plain):
    """Archive bytes, the good records' blocks, and whether each record was harmed."""
    out, good = b"", []
    for k in range(rng.randint(1, 12)):
        block = bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) + (b"WARC/1.0\r\nfake\r\n\r\n\x1f\x8b\x08" if rng.random() < 0.3 else b"")
        data = W.record({"WARC-Type": "resource", "WARC-Record-ID": f"<r{k}>"}, block, compress=not plain)
        harm = rng.choice(["", "", "byte", "cut", "junk"])
        data = W.damage(data, harm, rng.randrange(10**6))
        if harm in ("", "junk"):
            good.append(block)
        out += data
    return out, good


def slow(data):
    """Tries every byte as the start of a record."""
    at, found = 0, []
    while at < len(data):
        src = W._Source(io.BytesIO(data[at:]))
        try:
            e = W._member(src, 0) if data[at : at + 3] == W.GZIP else W._plain(src, 0)
            found.append((at, e.length, e.block))
            at += e.length
        except W.Failed:
            at += 1
    return found


@pytest.mark.parametrize("seed", range(30))
def test_salvage(seed):
    rng = random.Random(seed)
    data, good = make(rng, seed % 2 == 0)
    got = list(W.salvage(io.BytesIO(data)))
    at = 0
    for e in got:  # every byte is in one entry
        assert e.offset == at and e.length > 0 and (e.reason is None) == (e.kind == "record")
        at += e.length
    assert at == len(data)
    records = [(e.offset, e.length, e.block) for e in got if e.kind == "record"]
    assert records == slow(data)
    blocks = [b for _, _, b in records]
    assert all(b in blocks for b in good)


def test_reasons():
    good = W.record({"WARC-Type": "x"}, b"abc")
    plain = W.record({"WARC-Type": "x"}, b"abc", compress=False)
    for data, why in ((good[:-3], "damaged"), (b"junk", "no version"), (plain.replace(b"abc", b"abd"), "digest"), (plain.replace(b"Content-Length: 3", b"Content-Length: x"), "content length"), (plain[:-2], "content length"), (gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), "content length"), (b"WARC/1.0\r\nbad header\r\n\r\n", "malformed"), (b"WARC/1.0\r\n" + b"a: b\r\n" * 200_000, "header block")):
        got = list(W.salvage(io.BytesIO(data + good)))
        assert got[0].kind == "gap" and why in got[0].reason, (why, got[0].reason)
        assert got[-1].kind == "record" and got[-1].block == b"abc"


def test_an_archive_that_ends_within_a_record():
    plain = W.record({"WARC-Type": "x"}, b"abc", compress=False)
    assert [(e.kind, e.reason) for e in W.salvage(io.BytesIO(plain[:-2]))] == [("gap", "record is cut off")]
    assert [(e.kind, e.reason) for e in W.salvage(io.BytesIO(W.record({}, b"abc")[:-3]))] == [("gap", "member is cut off")]
    assert list(W.salvage(io.BytesIO(b""))) == []


def test_large_records_cross_the_buffer():
    blocks = [bytes([k]) * (3 * W.CHUNK + k) for k in range(3)]
    for compress in (True, False):
        data = b"".join(W.record({"WARC-Type": "x"}, b, compress) for b in blocks)
        assert [e.block for e in W.salvage(io.BytesIO(data))] == blocks
        hurt = data[:100] + b"\0" + data[101:]
        assert [e.block for e in W.salvage(io.BytesIO(hurt)) if e.kind == "record"] == blocks[1:]


def test_pages_round_trip(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: r.html for r in df.collect()}
    out = W.salvage_pages(df, harm_every=10**9).collect()
    assert {r.page_id: r.html for r in out} == want and all(r.kind == "record" for r in out)
    hurt = W.salvage_pages(df, per_archive=8, harm_every=3).collect()
    back = {r.page_id: r.html for r in hurt if r.kind == "record"}
    assert back and all(want[k] == v for k, v in back.items()) and any(r.kind == "gap" for r in hurt)
    import hashlib

    for k in want:
        h = int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=6).digest(), "big")
        if h % 3 or W.DAMAGES[h // 3 % 5] == "junk":
            assert k in back


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(W.record({"WARC-Type": "x"}, b"one") + b"dirt" + W.record({"WARC-Type": "x"}, b"two"))
    out = W.read_files(spark, [str(tmp_path / "a.warc.gz")]).orderBy("offset").collect()
    assert [(r.kind, r.block and bytes(r.block)) for r in out] == [("record", b"one"), ("gap", None), ("record", b"two")]
    assert W.read_files(spark, []).count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray()), (None, bytearray(b"dirt")), ("c", bytearray(W.record({}, b"")))], "archive string, content binary")
    out = sorted((r.archive or "", r.kind, r.length) for r in W.read_column(df).collect())
    assert out[0] == ("", "gap", 4) and out[1][:2] == ("c", "record") and len(out) == 2
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u v", "<p>", "x"), (None, "u", "h", "x"), (2, "u", "long " * 300_000, "x")], "page_id long, url string, html string, archive string")
    got = W.salvage_pages(pages, harm_every=10**9).collect()
    assert sorted((r.page_id, len(r.html)) for r in got) == [(1, 0), (1, 3), (2, 1_500_000)]
    assert W.salvage_pages(pages.where("false")).count() == 0


def test_digests_and_versions_of_other_writers():
    import hashlib

    block = b"abc"
    sha = hashlib.sha1(block)
    plain = W.record({"WARC-Type": "x"}, block, compress=False)
    good = [W.digest(block), W.digest(block).lower(), "sha1:" + sha.hexdigest(), "SHA1:" + sha.hexdigest().upper(), "sha256:00"]
    for d in good:
        for version in (b"0.17", b"0.18", b"1.0", b"1.1"):
            data = plain.replace(W.digest(block).encode(), d.encode()).replace(b"WARC/1.0", b"WARC/" + version)
            for x in (data, gzip.compress(data)):
                assert [(e.kind, e.block) for e in W.salvage(io.BytesIO(b"dirt" + x + x))] == [("gap", None), ("record", block), ("record", block)], (d, version)
    bad = plain.replace(W.digest(block).encode(), b"sha1:" + hashlib.sha1(b"abd").hexdigest().encode())
    assert [(e.kind, e.reason) for e in W.salvage(io.BytesIO(bad))] == [("gap", "block digest differs")]


def test_long_header_blocks_and_limits(monkeypatch):
    long = W.record({"WARC-Type": "x", "Note": "n" * 200_000}, b"abc", compress=False)
    assert [e.block for e in W.salvage(io.BytesIO(long + gzip.compress(long)))] == [b"abc"] * 2
    monkeypatch.setattr(W, "BLOCK_BYTES", 1000)
    rows = [W.record({"WARC-Type": "x"}, b"z" * n, c) for n in (1000, 1001) for c in (True, False)]
    assert [(e.kind, e.reason, e.length) for e in W.salvage(io.BytesIO(b"".join(rows)))][2:] == [("gap", "block is too long for a row", len(rows[2] + rows[3]))]


def test_a_damaged_length_does_not_read_the_archive():
    class Counting(io.BytesIO):
        most = 0

        def read(self, n=-1):
            got = super().read(n)
            self.most = max(self.most, len(got))
            return got

    first = W.record({"WARC-Type": "x"}, b"abc", compress=False).replace(b"Content-Length: 3", b"Content-Length: 30000000")
    f = Counting(first + W.record({"WARC-Type": "x"}, b"ok", compress=False) + b"\0" * 40_000_000)
    assert [e.kind for e in W.salvage(f)] == ["gap", "record", "gap"] and f.most <= W.CHUNK + W.HEADER_BYTES + 4
