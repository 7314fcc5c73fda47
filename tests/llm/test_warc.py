import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import warc as W
from chronofold.llm._common import shared_dir


def archive(n=8, compress=True, seed=0):
    r = random.Random(seed)
    return [W.write_record(k, f"http://x/{k}", bytes(r.randrange(256) for _ in range(r.randrange(0, 4000))), None, compress) for k in range(n)]


def pages(found):
    return [W.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, W.Record)]


def covers(found, data):
    at = 0
    for x in found:
        assert x.begin == at
        at = x.end
    assert at == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_clean_and_damaged(compress):
    parts = archive(compress=compress)
    data = b"".join(parts)
    found = list(W.salvage(io.BytesIO(data)))
    assert pages(found) == list(range(8)) and not any(isinstance(x, W.Gap) for x in found)
    covers(found, data)
    for hurt in (0, 3, 7):
        at = sum(map(len, parts[:hurt])) + len(parts[hurt]) // 2
        bad = bytearray(data)
        bad[at] ^= 0x55
        found = list(W.salvage(io.BytesIO(bytes(bad))))
        assert pages(found) == [k for k in range(8) if k != hurt]
        assert len([x for x in found if isinstance(x, W.Gap)]) == 1
        covers(found, bad)


def test_every_damaged_byte_of_a_header_is_found():
    head, block = W.record_parts(17, "http://x/y", b"payload", (18,))
    after = W.write_record(3, "u", b"", None, False)
    for k in range(len(head)):
        for flip in (0x01, 0x20, 0x80):
            bad = bytearray(head + block + b"\r\n\r\n")
            bad[k] ^= flip
            found = list(W.salvage(io.BytesIO(bytes(bad) + after)))
            assert pages(found) == [3] and found[0].end == len(bad) and isinstance(found[0], W.Gap), (k, flip)


def test_ids_of_others_are_no_pages(spark, tmp_path):
    """Odd ids of foreign archives are null, never an error."""
    ids = ["<urn:uuid:1>", "<urn:pages:x>", "", "urn:page", "<other:page:1:A>"]
    head = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {0}\r\nWARC-Refers-To: {0}\r\nX-Payload-Length: ²\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes("".join(head.format(x) for x in ids).encode())
    rows = W.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.warc",)], "path string")).collect()
    assert [(r.gap_reason, r.page_id, r.refers_to, r.payload_bytes) for r in rows] == [(None, None, None, None)] * len(ids)
    assert W.page_of(f"<urn:page:{1 << 63}:{'A' * 32}>") is None and W.page_of(f"<urn:page:{-1 << 63}:{'A' * 32}>") == -1 << 63


def test_gaps_and_missing_records_are_errors(spark):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k}") for k in range(9)], "page_id long, url string, html string")
    files = W.write_archives(W.plan_records(df), shared_dir(spark, "t")).persist()
    assert W.checked(W.read_archives(files), files).count() == 9
    path = files.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0x55
    open(path, "wb").write(data)
    with pytest.raises(RuntimeError, match="gaps"):
        W.checked(W.read_archives(files), files)


def test_junk_truncation_and_false_starts():
    parts = archive()
    junk = b"WARC/1.1\r\nContent-Length: 999999\r\n\r\n" + W.GZIP + b"\x00" * 20 + b"WARC/1.\x00"
    data = junk + parts[0] + parts[1][:50] + parts[2] + junk + parts[3][:-3]
    found = list(W.salvage(io.BytesIO(data)))
    assert pages(found) == [0, 2]
    covers(found, data)
    assert list(W.salvage(io.BytesIO(b""))) == []
    assert [type(x) for x in W.salvage(io.BytesIO(b"nothing here"))] == [W.Gap]
    assert pages(W.salvage(io.BytesIO(b"".join(parts)), most=10)) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.binary(min_size=1, max_size=30), st.booleans())
def test_any_damage_spares_the_others(place, patch, compress):
    parts = archive(5, compress)
    data = bytearray(b"".join(parts))
    place %= len(data)
    data[place : place + len(patch)] = patch
    found = list(W.salvage(io.BytesIO(bytes(data))))
    covers(found, data)
    at, untouched = 0, []
    for k, p in enumerate(parts):
        if bytes(data[at : at + len(p)]) == p:
            untouched.append(k)
        at += len(p)
    assert set(untouched) <= set(pages(found))


def test_rows_of_all_kinds(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://b c\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 300_000), (None, "u", "same"), (7, "u", "other"), (7, "u", "other")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "page_id long, url string, html string, digest string, refers int")
    files = W.write_archives(W.plan_records(df), shared_dir(spark, "t")).persist()
    got = sorted((tuple(r) for r in W.read_archives(files, payloads=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=str)
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        raw, first = (h or "").encode(), p == top[h or ""]
        want.append((p, len(raw), W.sha1_base32(raw), "response" if first else "revisit", None if first else top[h or ""], (h or "") if first else None))
    assert got == sorted(want, key=str)
    assert W.read_archives(W.write_archives(W.plan_records(df.limit(0)), shared_dir(spark, "t"))).count() == 0


def test_own_archives_are_read_whole(spark):
    df = spark.createDataFrame([(1, "http://x/" + "a" * 70_000, "one"), (2, "\x01" * 30_000, "two"), (3, "http://x/3", "three" * 1000), (4, "u" * 1_000_000, "four")], "page_id long, url string, html string")
    files = W.write_archives(W.plan_records(df), shared_dir(spark, "t")).persist()
    for found in (W.read_archives(files), W.read_archives(files, most=10)):
        assert sorted((r.page_id, r.payload_bytes) for r in found.where("gap_reason is null").collect()) == [(1, 3), (2, 3), (3, 5000), (4, 4)]
    assert W.read_archives(files.select("path")).where("gap_reason is not null").count() > 0
