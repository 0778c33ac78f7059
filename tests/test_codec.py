"""Golden bytes, round trips, cut-off and corrupted input."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.functions import codec
from keyfold.schema import Corruption, InvalidArgument, NotSupported

OPS = st.lists(st.tuples(st.sampled_from([0, 1]), st.binary(max_size=20), st.binary(max_size=20)), min_size=1, max_size=12)


def test_crc32c():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert codec.crc32c(b"") == 0
    parts = [b"123456789", b"", b"a" * 100, b"\x00"]
    assert codec.crc32c_many(parts).tolist() == [codec.crc32c(p) for p in parts]
    assert codec.crc32c_many([]).tolist() == []


def test_internal_key():
    assert codec.internal_key(b"a", 0x010203, 1) == bytes.fromhex("610103020100000000")
    assert codec.parse_internal_key(codec.internal_key(b"", 7, 0)) == (b"", 7, 0)
    ordered = [(b"a", 9, 1), (b"a", 7, 1), (b"a", 7, 0), (b"a", 3, 1), (b"b", 100, 1)]
    raw = [codec.internal_key(*k) for k in ordered]
    assert sorted(reversed(raw), key=codec.internal_order) == raw
    for bad in (b"short", b"a" + struct.pack("<Q", 1 << 8 | 2)):
        with pytest.raises(Corruption):
            codec.parse_internal_key(bad)
    with pytest.raises(InvalidArgument):
        codec.internal_key(b"a", 1 << 56, 1)


def test_physical_key_and_names():
    assert codec.physical_key(10, "default", b"k") == b"data/10/default/k"
    assert codec.parse_physical_key(b"data/10/default/k", 1, "default") is None
    assert codec.parse_physical_key(b"data/10/default/k", 10, "default") == b"k"
    assert codec.file_name(7, "sst") == "000007.sst"
    assert codec.parse_file_name("1234567.sst.tmp") == (1234567, "sst.tmp")
    assert [codec.parse_file_name(n) for n in ("000000.log", "x.log", "1.txt", ".log", "MANIFEST")] == [None] * 5
    assert codec.index_key(258) == bytes(6) + b"\x01\x02"
    assert codec.parse_hard_state(codec.hard_state(3, 2, 9)) == (3, 2, 9)
    assert codec.parse_hard_state(None) == codec.parse_hard_state(b"x") == (0, 0, 0)


def test_write_batch_golden():
    raw = codec.write_batch(1, [(1, b"a", b"x"), (0, b"b", None)])
    assert raw.hex() == "0100000000000000" "02000000" "01" "01000000" "61" "01000000" "78" "02" "01000000" "62"
    assert codec.parse_write_batch(raw) == [(1, 1, b"a", b"x"), (2, 0, b"b", None)]


@given(OPS, st.integers(1, 1 << 40))
@settings(max_examples=60, deadline=None)
def test_write_batch_round_trip(ops, seq):
    raw = codec.write_batch(seq, ops)
    want = [(seq + i, op, k, v if op else None) for i, (op, k, v) in enumerate(ops)]
    assert codec.parse_write_batch(raw) == want
    for cut in range(len(raw)):
        with pytest.raises(Corruption):
            codec.parse_write_batch(raw[:cut])
    with pytest.raises(Corruption):
        codec.parse_write_batch(raw + b"\0")


def test_write_batch_refuses():
    for seq, ops in ((1, []), (0, [(1, b"a", b"")]), (1, [(5, b"a", b"")]), ((1 << 56) - 1, [(1, b"a", b"")] * 2)):
        with pytest.raises(InvalidArgument):
            codec.write_batch(seq, ops)


def test_log_torn_at_every_byte():
    payloads = [b"first", b"second payload", b"x"]
    raw = b"".join(map(codec.log_record, payloads))
    ends = [0, 13, 13 + 22, 13 + 22 + 9]
    for cut in range(len(raw) + 1):
        got = [p for _, p in codec.log_records(raw[:cut])]
        assert got == payloads[: sum(e <= cut for e in ends[1:])]


def test_log_corruption():
    raw = codec.log_record(b"abc") + codec.log_record(b"def")
    broken = bytearray(raw)
    broken[-1] ^= 1
    got = []
    with pytest.raises(Corruption):
        for _, p in codec.log_records(bytes(broken)):
            got.append(p)
    assert got == [b"abc"]
    with pytest.raises(Corruption):
        list(codec.log_records(bytes(16)))
    with pytest.raises(InvalidArgument):
        codec.log_record(b"")


def test_bloom():
    assert codec.bloom_build([]) == bytes(8) + b"\x06"
    assert not codec.bloom_may_contain([b"", b"a"], codec.bloom_build([])).any()
    keys = [struct.pack("<I", i) for i in range(1000)]
    f = codec.bloom_build(keys)
    assert len(f) == 1251
    assert codec.bloom_may_contain(keys, f).all()
    assert codec.bloom_may_contain([struct.pack("<I", i) for i in range(1_000_000, 1_010_000)], f).sum() < 200
    for unknown in (b"", b"\x06", bytes(8) + b"\x00", bytes(8) + b"\x1f"):
        assert codec.bloom_may_contain([b"a"], unknown).all()
    odd = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde" * 9]
    assert codec.bloom_may_contain(odd, codec.bloom_build(odd)).all()


def _rows(n):
    out = []
    for i in range(n):
        key = f"key{i:05d}".encode()
        out += [(key, 2 * i + 2, 0 if i % 7 == 0 else 1, b"" if i % 7 == 0 else b"v" * (i % 50)), (key, 2 * i + 1, 1, b"old")]
    return out


def test_table_round_trip():
    rows = _rows(500)
    raw, meta = codec.table(rows)
    assert (meta.file_size, meta.entries) == (len(raw), 1000)
    t = codec.TableFile(raw, verify=True)
    assert list(t.rows()) == rows
    assert len(t.index) > 3
    assert t.get(b"key00003") == ("value", b"v" * 3)
    assert t.get(b"key00003", 7) == ("value", b"old")
    assert t.get(b"key00007") == ("deleted", None)
    assert t.get(b"key00003", 6) == t.get(b"nothing") == t.get(b"key00003x") == ("absent", None)
    assert codec.parse_internal_key(meta.smallest)[0] == b"key00000" and codec.parse_internal_key(meta.largest)[0] == b"key00499"


def test_table_corruption():
    raw, _ = codec.table(_rows(50))
    with pytest.raises(Corruption):
        codec.TableFile(raw[:-1])
    with pytest.raises(Corruption):
        codec.TableFile(b"")
    wrong = bytearray(raw)
    wrong[-40] = 9
    with pytest.raises(NotSupported):
        codec.TableFile(bytes(wrong))
    data = bytearray(raw)
    data[3] ^= 1
    with pytest.raises(Corruption):
        list(codec.TableFile(bytes(data), verify=True).rows())
    with pytest.raises(InvalidArgument):
        codec.table([])
    with pytest.raises(InvalidArgument):
        codec.table([(b"b", 1, 1, b""), (b"a", 1, 1, b"")])


def _meta(number, low, high):
    return codec.TableMeta(number, 100, codec.internal_key(low, 9, 1), codec.internal_key(high, 1, 1))


def test_manifest_round_trip_and_versions():
    m = codec.Manifest(5, 3, [[_meta(1, b"a", b"z"), _meta(2, b"b", b"c")], [_meta(3, b"a", b"d"), _meta(4, b"e", b"z")], []])
    raw = m.encode()
    assert codec.Manifest.decode(raw) == m
    for i in range(0, len(raw), 3):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(Corruption):
            codec.Manifest.decode(bytes(bad))
    old = bytearray(codec.Manifest(5, 3, [[_meta(1, b"a", b"z")], [], []]).encode()[:-4])
    old[8] = 1
    old = bytes(old[:-8])
    assert codec.Manifest.decode(old + codec.fixed32(codec.crc32c(old))).levels[1:] == [[], []]


@pytest.mark.parametrize(
    "levels",
    [
        [[], [_meta(1, b"alpha", b"delta"), _meta(2, b"delta", b"omega")], []],
        [[], [_meta(1, b"hotel", b"zulu"), _meta(2, b"alpha", b"india")], []],
        [[_meta(1, b"a", b"b")], [_meta(1, b"c", b"d")], []],
        [[], [_meta(1, b"", b""), _meta(2, b"", b"alpha")], []],
        [[], [], [_meta(1, b"hotel", b"zulu"), _meta(2, b"alpha", b"india")]],
        [[_meta(1, b"z", b"a")], [], []],
        [[_meta(0, b"a", b"b")], [], []],
    ],
)
def test_manifest_layouts_refused(levels):
    assert codec.Manifest(1, 1, levels).problem()
    with pytest.raises(InvalidArgument):
        codec.Manifest(1, 1, levels).encode()


def test_seek_by_index_and_restarts():
    rows_ = [(b"k%05d" % (i // 3), 100 - i % 3, i % 2, b"v%d" % i if i % 2 else b"") for i in range(3000)]
    raw, _ = codec.table(rows_, 512)
    t = codec.TableFile(raw, True)
    assert list(t.rows()) == rows_
    for key in (b"", b"k00000", b"k00500", b"k00500x", b"k00999", b"z"):
        assert list(t.seek(key))[:4] == [r for r in rows_ if r[0] >= key][:4]
    assert next(t.seek(b"k00007", 99)) == next(r for r in rows_ if r[0] == b"k00007" and r[1] <= 99)
    for i in (0, 1, 998, 999):
        newest = rows_[3 * i]
        assert t.get(b"k%05d" % i) == (("value", newest[3]) if newest[2] else ("deleted", None))
    assert t.get(b"k") == ("absent", None) and t.get(b"k00000", 1) == ("absent", None)


def test_log_in_pieces():
    payloads = [bytes([i % 251]) * (i * 37 % 900 + 1) for i in range(200)]
    raw = codec.log_records_of(payloads)
    assert raw == b"".join(map(codec.log_record, payloads))
    import io

    for piece in (7, 100, 1 << 20):
        assert list(codec.log_stream(io.BytesIO(raw).read, piece)) == list(codec.log_records(raw))
        assert len(list(codec.log_stream(io.BytesIO(raw[:-3]).read, piece))) == len(payloads) - 1
        broken = bytearray(raw)
        broken[len(raw) // 2] ^= 1
        with pytest.raises(Corruption):
            list(codec.log_stream(io.BytesIO(bytes(broken)).read, piece))
