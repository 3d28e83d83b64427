import gzip
import hashlib
import random
import time

from ordina.llm import warc
from ordina.llm.warc import MEMBER, base32_sha1, digest_of, member, read_warc, record, salvage, write_warc


def rec(i, payload=b"<p>x</p>", refers=None):
    return record(str(i), f"http://h/{i} x", payload, hashlib.sha1(payload).digest(), refers, "2024-01-01T00:00:00Z")


def found_in(data, step=7):
    """What is salvaged from the data in pieces of a few bytes, which is the same in one piece."""
    found = list(salvage([data[i : i + step] for i in range(0, len(data), step)], len(data)))
    assert found == list(salvage([data])) == list(salvage([data], len(data)))
    return found


def ids(found):
    return [x[5]["warc-record-id"].split(":")[-1][:-1] for x in found if x[0] == "record"]


def gaps(found):
    return [x[5] for x in found if x[0] == "gap"]


def covers(data, found):
    at = 0
    for x in found:
        if x[2] is None:  # inside a member
            continue
        assert x[1] >= at and data[at : x[1]].strip(b"\r\n") == b""
        at = x[2]
    assert data[at:].strip(b"\r\n") == b""


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    html = [("<p>%d</p>" % i) * rng.randrange(1, 50) for i in range(30)] + ["", None, "WARC/1.1\r\n\r\n", "é\r\n\r\n", "x" * 300_000]
    rows = [(i, None if i % 7 == 0 else f"http://h/{i}", rng.choice(html)) for i in range(300)] + [(None, "u\r\nEvil: 1", "lonely"), (None, None, html[0]), (0, None, "again"), (0, None, "again")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    write_warc(df, str(tmp_path / "w"), records_per_file=40)
    back = read_warc(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in back} == {"record", "member"}
    back = [r for r in back if r.kind == "record"]
    assert len(back) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(((i, len((h or "").encode()), base32_sha1((h or "").encode()), None if first.get(h or "", i) == i else first[h or ""]) for i, _, h in rows), key=repr)
    number = lambda s: int(s.split(":")[-1][:-1]) if s and s.split(":")[-1] != ">" else None
    assert sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, number(r.refers_to)) for r in back), key=repr) == want
    full = {number(r.record_id): bytes(r.payload).decode() for r in back if r.record_type == "response"}
    assert all(full[i] == (h or "") for i, _, h in rows if i and i in full)


def test_least_bytes_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    write_warc(df, str(tmp_path / "w"), least_bytes=3)
    assert sorted(r.record_type for r in read_warc(spark, str(tmp_path / "w")).where("kind = 'record'").collect()) == ["response"] * 3 + ["revisit"]
    write_warc(df.limit(0), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).isEmpty()


def test_salvage_after_damage():
    good = [rec(i, b"p%d" % i * 9) for i in range(6)]
    broken = bytearray(good[1])
    broken[-8] ^= 1
    wrong = good[3].replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(good[3]) - good[3].index(b"HTTP") - 4), b"Content-Length: 7\r\n\r\nHTTP")
    data = good[0] + bytes(broken) + good[2] + wrong + good[4] + b"tail junk"
    found = found_in(data)
    assert ids(found) == ["0", "2", "4"] and gaps(found) == ["block digest differs", "length doesn't end at a record's end", "no version line"]
    covers(data, found)


def test_salvage_of_members():
    zipped = [member(rec(i)) for i in range(5)]
    data = zipped[0] + zipped[1][: len(zipped[1]) // 2] + zipped[2] + b"\0" * 50 + zipped[3] + rec(9) + zipped[4][:-3]
    found = found_in(data)
    assert ids(found) == ["0", "2", "3", "9", "4"] and sum(x[0] == "gap" for x in found) == 3  # the last lacks its checksum only
    covers(data, found)


def test_member_of_many_records():
    """The whole archive compressed at once, with a damaged record inside, then another member of two."""
    wrong = bytearray(rec(2))
    wrong[-8] ^= 1
    inside = rec(0) + rec(1) + bytes(wrong) + rec(3)
    data = gzip.compress(inside) + gzip.compress(rec(4) + b"\r\n" + rec(5))
    found = found_in(data)
    assert ids(found) == ["0", "1", "3", "4", "5"] and gaps(found) == ["block digest differs"]
    assert [x[0] for x in found] == ["record", "record", "gap", "record", "member", "record", "record", "member"]
    gap = next(x for x in found if x[0] == "gap")
    assert (gap[1], gap[3], gap[4]) == (0, len(rec(0) + rec(1)), len(rec(0) + rec(1) + rec(2)))
    covers(data, found)


def test_cut_member_gives_its_records():
    rng = random.Random(4)
    many = b"".join(rec(i, rng.randbytes(3000)) for i in range(40))
    cut = gzip.compress(many)[:60_000]
    data = cut + member(rec(99)) + rec(98)
    found = found_in(data, 10_007)
    kept = ids(found)
    assert kept[-2:] == ["99", "98"] and kept[:-2] == [str(i) for i in range(len(kept) - 2)] and len(kept) >= 20
    covers(data, found)


def test_digest_forms_and_folded_lines():
    payload = b"<p>x</p>"
    one = rec(1, payload)
    b32 = base32_sha1(payload).encode()
    block = one[one.index(b"HTTP/1.1") : -4]
    forms = [one.replace(b"sha1:" + b32, b"SHA-1:" + hashlib.sha1(payload).hexdigest().encode()), one.replace(b32, b32.lower()), one.replace(b"sha1:" + b32, b"blake3:xyz"), one.replace(b"WARC-Date: ", b"WARC-Date:\r\n\t")]
    forms += [one.replace(b"sha1:" + base32_sha1(block).encode(), b"sha256:" + hashlib.sha256(block).hexdigest().upper().encode())]
    assert len(set(forms)) == 5 and one not in forms
    for data in forms:
        found = found_in(data)
        assert ids(found) == ["1"] and gaps(found) == []
    assert found_in(forms[3])[0][5]["warc-date"] == "2024-01-01T00:00:00Z"
    bad = one.replace(b"sha1:" + base32_sha1(block).encode(), b"sha256:" + b"0" * 64)
    assert gaps(found_in(bad)) == ["block digest differs"]
    no_block = one.replace(b"WARC-Block-Digest", b"X-Digest").replace(b32, base32_sha1(b"other").encode())
    assert gaps(found_in(no_block)) == ["payload digest differs"]
    assert digest_of("md5:d41d8cd98f00b204e9800998ecf8427e")[0] == "md5" and digest_of("sha1:short") is None and digest_of("") is None


def test_salvage_never_fails():
    rng = random.Random(3)
    base = b"".join(rec(i) if i % 2 else member(rec(i) + rec(i + 20)) for i in range(8))
    for _ in range(200):
        data = bytearray(base)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        cut = bytes(data[: rng.randrange(len(data))])
        covers(cut, found_in(cut, 501))
    assert list(salvage([])) == []


def test_bogus_starts_take_linear_time():
    begun = time.perf_counter()
    for part in (b"WARC/1.1\r\n", MEMBER, member(b"")[:9] + b"\x03", MEMBER + b"\x08\0\0\0\0\0\x03a", b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n", b"\r\n"):
        covers(data := part * (1_000_000 // len(part)), list(salvage([data], len(data))))
    assert time.perf_counter() - begun < 20


def test_files_come_in_ranges(spark, tmp_path, monkeypatch):
    """Plain and compressed files larger than a range, with damage."""
    rng = random.Random(6)
    monkeypatch.setattr(warc, "RANGE", 5000)
    good = [rec(i, rng.randbytes(rng.randrange(9000))) for i in range(60)]
    (tmp_path / "a.warc").write_bytes(b"".join(good[:20]) + b"junk" * 2000 + b"".join(good[20:30]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(good[30:50])) + b"".join(map(member, good[50:])))
    (tmp_path / "c.warc").write_bytes(b"")
    back = read_warc(spark, str(tmp_path)).collect()
    assert sorted(int(r.record_id.split(":")[-1][:-1]) for r in back if r.kind == "record") == list(range(60))
    assert [(r.end - r.start, r.reason) for r in back if r.kind == "gap"] == [(8000, "no version line")]
