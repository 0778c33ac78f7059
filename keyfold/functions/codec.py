"""Byte formats of keys, batches, log records, filters and tables.

The formats are fixed; numbers are little-endian unless named otherwise. All
decoders refuse what they can't read completely with ``Corruption``.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from ..schema import DELETE, LEVELS, MAX_SEQUENCE, PUT, Corruption, InvalidArgument, NotSupported

# Fixed values of the formats.
CRC32C_POLYNOMIAL = 0x82F63B78
BLOOM_SEED = 0xBC9F1D34
BLOOM_MULTIPLIER = 0xC6A4A793
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 6
BLOOM_LEAST_BITS = 64
BLOOM_MOST_PROBES = 30
TABLE_MAGIC = b"LSMTREE1"
TABLE_VERSION = 1
TABLE_FOOTER = 48
BLOCK_BYTES = 4096
RESTART_ENTRIES = 16
MANIFEST_MAGIC = b"LSMMAN01"
MANIFEST_VERSION = 3
MOST_RECORD_BYTES = 64 << 20
REGION_PREFIX = b"data/"
BATCH_PUT, BATCH_DELETE = 1, 2


# -- numbers and checksums ------------------------------------------------------
def fixed32(n: int) -> bytes:
    return struct.pack("<I", n)


def fixed64(n: int) -> bytes:
    return struct.pack("<Q", n)


def index_key(idx: int) -> bytes:
    """Big-endian, so that byte order is number order."""
    return struct.pack(">Q", idx)


def hard_state(term: int, vote: int, commit_index: int) -> bytes:
    return struct.pack(">QQQ", term, vote, commit_index)


def parse_hard_state(raw: bytes | None) -> tuple[int, int, int]:
    """(term, vote, commit index); zeros for a missing or short state."""
    return struct.unpack(">QQQ", raw[:24]) if raw is not None and len(raw) >= 24 else (0, 0, 0)


def _crc_table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, (n >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), n >> 1).astype(np.uint32)
    return n


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32 with the Castagnoli polynomial."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC_LIST[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings at once: one step per byte position over all of them."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right") if sizes.max() else []
    c = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for k, n in enumerate(active):
        c[:n] = _CRC[(c[:n] ^ data[begin[:n] + k]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


class Reader:
    """Takes values from the front of a byte string."""

    def __init__(self, raw: bytes, what: str):
        self.raw, self.at, self.what = bytes(raw), 0, what

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Corruption(f"{self.what} is cut off at byte {self.at}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def sized(self) -> bytes:
        return self.take(self.u32())

    @property
    def rest(self) -> int:
        return len(self.raw) - self.at


# -- keys -----------------------------------------------------------------------
def internal_key(user_key: bytes, seq: int, op: int) -> bytes:
    """User key and tag (sequence * 256 + operation)."""
    if not 0 <= seq <= MAX_SEQUENCE or op not in (DELETE, PUT):
        raise InvalidArgument("sequence or operation is out of range")
    return bytes(user_key) + fixed64(seq << 8 | op)


def parse_internal_key(raw: bytes) -> tuple[bytes, int, int]:
    if len(raw) < 8:
        raise Corruption("internal key is shorter than its tag")
    (tag,) = struct.unpack("<Q", raw[-8:])
    if tag & 0xFF not in (DELETE, PUT):
        raise Corruption("internal key has an unknown operation")
    return bytes(raw[:-8]), tag >> 8, tag & 0xFF


def internal_order(raw: bytes) -> tuple[bytes, int]:
    """Sort key: user key ascending, tag descending."""
    key, seq, op = parse_internal_key(raw)
    return key, -(seq << 8 | op)


def physical_key(region_id: int, cf: str, user_key: bytes) -> bytes:
    return REGION_PREFIX + str(region_id).encode() + b"/" + cf.encode() + b"/" + bytes(user_key)


def parse_physical_key(raw: bytes, region_id: int, cf: str) -> bytes | None:
    """The user key if ``raw`` lies under the prefix of region and cf."""
    prefix = physical_key(region_id, cf, b"")
    return bytes(raw[len(prefix) :]) if bytes(raw).startswith(prefix) else None


def file_name(number: int, kind: str) -> str:
    """Name of a numbered file; ``kind`` is log, sst or sst.tmp."""
    if kind not in ("log", "sst", "sst.tmp") or number <= 0:
        raise InvalidArgument("no such kind of file, or number")
    return f"{number:06d}.{kind}"


def parse_file_name(name: str) -> tuple[int, str] | None:
    stem, _, kind = name.partition(".")
    if kind not in ("log", "sst", "sst.tmp") or not stem.isascii() or not stem.isdigit():
        return None
    number = int(stem)
    return (number, kind) if 0 < number < 1 << 64 else None


# -- write batches ----------------------------------------------------------------
def write_batch(seq: int, ops: Iterable[tuple[int, bytes, bytes | None]]) -> bytes:
    """Encode (op, key, value) in order; the i-th has sequence ``seq + i``."""
    ops = list(ops)
    if not ops or not 0 < seq <= MAX_SEQUENCE or seq + len(ops) - 1 > MAX_SEQUENCE:
        raise InvalidArgument("empty batch, or sequence out of range")
    out = [fixed64(seq), fixed32(len(ops))]
    for op, key, value in ops:
        if op not in (DELETE, PUT):
            raise InvalidArgument("unknown operation")
        out += [bytes([BATCH_PUT if op == PUT else BATCH_DELETE]), fixed32(len(key)), bytes(key)]
        if op == PUT:
            value = b"" if value is None else bytes(value)
            out += [fixed32(len(value)), value]
    raw = b"".join(out)
    if len(raw) > MOST_RECORD_BYTES:
        raise InvalidArgument("batch exceeds 64 MiB")
    return raw


def parse_write_batch(raw: bytes) -> list[tuple[int, int, bytes, bytes | None]]:
    """(sequence, op, key, value) of all operations, or Corruption for the whole batch."""
    r = Reader(raw, "write batch")
    seq, count = r.u64(), r.u32()
    if not count or not 0 < seq <= MAX_SEQUENCE or seq + count - 1 > MAX_SEQUENCE:
        raise Corruption("write batch has no operations or a sequence out of range")
    out = []
    for i in range(count):
        kind, key = r.u8(), r.sized()
        if kind not in (BATCH_PUT, BATCH_DELETE):
            raise Corruption("write batch has an unknown operation")
        op = PUT if kind == BATCH_PUT else DELETE
        out.append((seq + i, op, key, r.sized() if op == PUT else None))
    if r.rest:
        raise Corruption("write batch has bytes after its last operation")
    return out


# -- log records --------------------------------------------------------------------
def log_record(payload: bytes) -> bytes:
    if not 0 < len(payload) <= MOST_RECORD_BYTES:
        raise InvalidArgument("log record must have 1 byte to 64 MiB")
    return fixed32(len(payload)) + fixed32(crc32c(payload)) + payload


def log_records_of(payloads: list[bytes]) -> bytes:
    """Records of several payloads, their checksums computed together."""
    if any(not 0 < len(p) <= MOST_RECORD_BYTES for p in payloads):
        raise InvalidArgument("log record must have 1 byte to 64 MiB")
    return b"".join(x for p, c in zip(payloads, crc32c_many(payloads).tolist(), strict=True) for x in (fixed32(len(p)), fixed32(c), p))


def log_stream(read, piece: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a file that ``read(n)`` gives piece by piece, so a long log needs little memory."""
    held, at = b"", 0
    while True:
        more = read(piece)
        held += more
        if not more:
            yield from ((at + o, p) for o, p in log_records(held))
            return
        # Whole records that are there; a wrong length is left for the check at the end.
        end = 0
        while end + 8 <= len(held):
            (size,) = struct.unpack_from("<I", held, end)
            if not 0 < size <= MOST_RECORD_BYTES:
                yield from ((at + o, p) for o, p in log_records(held))
                return
            if end + 8 + size > len(held):
                break
            end += 8 + size
        yield from ((at + o, p) for o, p in log_records(held[:end]))
        held, at = held[end:], at + end


def log_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record. A cut-off tail ends the log; a wrong record is Corruption."""
    found, at, error = [], 0, None
    while at + 8 <= len(raw):
        size, checksum = struct.unpack_from("<II", raw, at)
        if not 0 < size <= MOST_RECORD_BYTES:
            error = f"log record of {size} bytes at offset {at}"
            break
        if at + 8 + size > len(raw):
            break
        found.append((at, raw[at + 8 : at + 8 + size], checksum))
        at += 8 + size
    right = crc32c_many([p for _, p, _ in found])
    for (at, payload, checksum), own in zip(found, right.tolist(), strict=True):
        if checksum != own:
            raise Corruption(f"log record checksum mismatch at offset {at}")
        yield at, payload
    if error:
        raise Corruption(error)


# -- Bloom filters ------------------------------------------------------------------
def bloom_hashes(keys: list[bytes]) -> np.ndarray:
    """32-bit hash of each key, over keys of equal length together."""
    out = np.zeros(len(keys), np.uint32)
    by_size: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_size.setdefault(len(k), []).append(i)
    mul = np.uint32(BLOOM_MULTIPLIER)
    for size, rows in by_size.items():
        h = np.full(len(rows), (BLOOM_SEED ^ (size * BLOOM_MULTIPLIER)) & 0xFFFFFFFF, np.uint32)
        data = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), size).astype(np.uint32)
        whole = size // 4 * 4
        for k in range(0, whole, 4):
            word = data[:, k] | data[:, k + 1] << 8 | data[:, k + 2] << 16 | data[:, k + 3] << 24
            h = (h + word) * mul
            h ^= h >> np.uint32(16)
        if size > whole:
            for shift, k in zip((0, 8, 16), range(whole, size), strict=False):
                h = h + (data[:, k] << np.uint32(shift))
            h = h * mul
            h ^= h >> np.uint32(24)
        out[rows] = h
    return out


def _bloom_bits(h: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit numbers (key by probe); the step of a key is its hash rotated right by 17."""
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    return (h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint32)).astype(np.uint32) % np.uint32(bits)


def bloom_build(keys: list[bytes]) -> bytes:
    size = (max(len(keys) * BLOOM_BITS_PER_KEY, BLOOM_LEAST_BITS) + 7) // 8
    out = np.zeros(size, np.uint8)
    bits = _bloom_bits(bloom_hashes(keys), size * 8, BLOOM_PROBES).ravel() if keys else np.zeros(0, np.uint32)
    np.bitwise_or.at(out, bits // 8, (1 << (bits % 8)).astype(np.uint8))
    return out.tobytes() + bytes([BLOOM_PROBES])


def bloom_may_contain(keys: list[bytes], encoded: bytes) -> np.ndarray:
    """False where a key is surely absent; an encoding that isn't known may contain all."""
    probes = encoded[-1] if len(encoded) > 1 else 0
    if not 0 < probes <= BLOOM_MOST_PROBES or not keys:
        return np.ones(len(keys), bool)
    table = np.frombuffer(encoded[:-1], np.uint8)
    bits = _bloom_bits(bloom_hashes(keys), table.size * 8, probes)
    return ((table[bits // 8] >> (bits % 8).astype(np.uint8)) & 1).all(axis=1)


# -- blocks and tables --------------------------------------------------------------
def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def block(entries: Iterable[tuple[bytes, bytes]], restart: int = RESTART_ENTRIES) -> bytes:
    """Entries with the length shared with the key before, restart offsets and their count."""
    out, restarts, size, last = [], [0], 0, b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i and i % restart == 0:
            restarts.append(size)
        elif i:
            shared = shared_prefix(last, key)
        piece = struct.pack("<III", shared, len(key) - shared, len(value)) + key[shared:] + value
        out.append(piece)
        size += len(piece)
        last = key
    return b"".join(out) + b"".join(map(fixed32, restarts)) + fixed32(len(restarts))


def block_entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(raw) < 8:
        raise Corruption("block is too short")
    (count,) = struct.unpack("<I", raw[-4:])
    end = len(raw) - 4 - 4 * count
    if count == 0 or end < 0:
        raise Corruption("block has wrong restart offsets")
    r, last = Reader(raw[:end], "block"), b""
    while r.rest:
        shared, own, size = r.u32(), r.u32(), r.u32()
        if shared > len(last):
            raise Corruption("block entry shares more than the key before it")
        last = last[:shared] + r.take(own)
        yield last, r.take(size)


def block_seek(raw: bytes, target: tuple[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the first internal key at or after ``target`` on: a binary search over the restarts, then one run of entries."""
    if len(raw) < 8:
        raise Corruption("block is too short")
    (count,) = struct.unpack("<I", raw[-4:])
    end = len(raw) - 4 - 4 * count
    if count == 0 or end < 0:
        raise Corruption("block has wrong restart offsets")
    restarts = struct.unpack_from(f"<{count}I", raw, end)
    low, high = 0, count - 1
    while low < high:  # the last restart whose key is before the target
        middle = (low + high + 1) // 2
        if restarts[middle] >= end:
            raise Corruption("block has wrong restart offsets")
        shared, own, _ = struct.unpack_from("<III", raw, restarts[middle])
        if shared:
            raise Corruption("a restart shares with the key before it")
        key = raw[restarts[middle] + 12 : restarts[middle] + 12 + own]
        low, high = (middle, high) if internal_order(key) < target else (low, middle - 1)
    first = restarts[low]
    rest = raw[first:end] + fixed32(0) + fixed32(1)
    for key, value in block_entries(rest):
        if internal_order(key) >= target:
            yield key, value


def _load(raw: bytes, offset: int, size: int, verify: bool) -> bytes:
    if offset + size + 5 > len(raw) - TABLE_FOOTER:
        raise Corruption("block lies outside of its table")
    payload, kind = raw[offset : offset + size], raw[offset + size]
    if verify and crc32c(raw[offset : offset + size + 1]) != struct.unpack_from("<I", raw, offset + size + 1)[0]:
        raise Corruption("table block checksum mismatch")
    if kind:
        raise Corruption("block has an unknown compression")
    return payload


@dataclass
class TableMeta:
    """What a manifest tells of a table; keys are internal keys."""

    number: int
    file_size: int
    smallest: bytes
    largest: bytes
    entries: int = 0


def table(rows: Iterable[tuple[bytes, int, int, bytes]], block_bytes: int = BLOCK_BYTES) -> tuple[bytes, TableMeta]:
    """Encode (user key, sequence, op, value) in strict internal order as one table file."""
    blocks, index, keys, current, size, estimate = [], [], [], [], 0, 0
    first = last = None

    def add(payload: bytes) -> bytes:
        nonlocal size
        handle = fixed64(size) + fixed64(len(payload))
        blocks.append(payload + b"\0")  # no compression
        size += len(payload) + 5
        return handle

    def flush():
        nonlocal current, estimate
        if current:
            index.append((current[-1][0], add(block(current))))
            current, estimate = [], 0

    n = 0
    for key, seq, op, value in rows:
        ik = internal_key(key, seq, op)
        if last is not None and internal_order(last) >= internal_order(ik):
            raise InvalidArgument("table rows are not in strict internal order")
        first = ik if first is None else first
        shared = shared_prefix(last, ik) if current and len(current) % RESTART_ENTRIES else 0
        last = ik
        keys.append(bytes(key))
        current.append((ik, b"" if value is None else bytes(value)))
        estimate += 12 + len(ik) - shared + len(current[-1][1])
        n += 1
        restarts = (len(current) - 1) // RESTART_ENTRIES + 1
        if estimate + 4 * restarts + 4 >= block_bytes:
            flush()
    flush()
    if first is None:
        raise InvalidArgument("a table holds at least one row")
    handles = [add(bloom_build(keys)), add(block(index))]
    # The checksums of all blocks together.
    out = [x for raw, c in zip(blocks, crc32c_many(blocks).tolist(), strict=True) for x in (raw, fixed32(c))]
    out.append(TABLE_MAGIC + fixed32(TABLE_VERSION) + fixed32(0) + b"".join(handles))
    return b"".join(out), TableMeta(0, size + TABLE_FOOTER, first, last, n)


class TableFile:
    """A table file: filter and index are always verified, data blocks if asked."""

    def __init__(self, raw: bytes, verify: bool = False):
        self.raw, self.verify = raw, verify
        if len(raw) < TABLE_FOOTER:
            raise Corruption("table is shorter than its footer")
        foot = Reader(raw[-TABLE_FOOTER:], "table footer")
        if foot.take(8) != TABLE_MAGIC:
            raise Corruption("not a table file")
        if foot.u32() != TABLE_VERSION:
            raise NotSupported("table version is not supported")
        if foot.u32():
            raise Corruption("table footer has a reserved field that is not zero")
        self.filter = _load(raw, foot.u64(), foot.u64(), True)
        self.index = [(k, struct.unpack("<QQ", v)) for k, v in block_entries(_load(raw, foot.u64(), foot.u64(), True))]

    def rows(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for _, (offset, size) in self.index:
            for ik, value in block_entries(_load(self.raw, offset, size, self.verify)):
                key, seq, op = parse_internal_key(ik)
                yield key, seq, op, value

    def _from(self, target: tuple[bytes, int]) -> Iterator[tuple[bytes, int, int, bytes]]:
        """Rows from an internal key on: binary searches in the index and in one block, then blocks as they are needed."""
        at = bisect_left(self.index, target, key=lambda x: internal_order(x[0]))
        for i, (_, (offset, size)) in enumerate(self.index[at:]):
            raw = _load(self.raw, offset, size, self.verify)
            for ik, value in block_entries(raw) if i else block_seek(raw, target):
                yield (*parse_internal_key(ik), value)

    def seek(self, key: bytes, seq: int = MAX_SEQUENCE) -> Iterator[tuple[bytes, int, int, bytes]]:
        """Rows in internal order from the first version of ``key`` up to ``seq``, or of the next key there is."""
        return self._from((bytes(key), -(seq << 8 | PUT)))

    def get(self, key: bytes, seq: int = MAX_SEQUENCE) -> tuple[str, bytes | None]:
        """('absent' | 'value' | 'deleted', value) of the newest version up to ``seq``."""
        if not bloom_may_contain([key], self.filter)[0]:
            return "absent", None
        for found, _, op, value in self.seek(key, seq):
            if found != key:
                break
            return ("value", value) if op == PUT else ("deleted", None)
        return "absent", None


# -- manifests ------------------------------------------------------------------------
@dataclass
class Manifest:
    flushed_sequence: int = 0
    oldest_wal_number: int = 1
    levels: list[list[TableMeta]] = field(default_factory=lambda: [[] for _ in range(LEVELS)])

    def problem(self) -> str | None:
        """Why the layout is refused, or None."""
        if not 0 <= self.flushed_sequence <= MAX_SEQUENCE:
            return "flushed sequence is out of range"
        if self.oldest_wal_number <= 0:
            return "log number must be positive"
        seen: set[int] = set()
        for level, tables in enumerate(self.levels):
            before = None
            for t in tables:
                if t.number <= 0 or t.file_size <= 0:
                    return "table without number or size"
                if t.number in seen:
                    return "table number occurs twice"
                seen.add(t.number)
                try:
                    low, high = internal_order(t.smallest), internal_order(t.largest)
                except Corruption:
                    return "table has no valid key range"
                if high < low:
                    return "table has no valid key range"
                if level and before is not None and before >= low[0]:
                    return "tables of a sorted level overlap or are out of order"
                before = high[0]
        return None

    def encode(self) -> bytes:
        if why := self.problem():
            raise InvalidArgument(why)
        out = [MANIFEST_MAGIC, fixed32(MANIFEST_VERSION), fixed64(self.flushed_sequence), fixed64(self.oldest_wal_number)]
        for tables in self.levels:
            out.append(fixed32(len(tables)))
            for t in tables:
                out += [fixed64(t.number), fixed64(t.file_size), fixed32(len(t.smallest)), t.smallest, fixed32(len(t.largest)), t.largest]
        raw = b"".join(out)
        if len(raw) + 4 > MOST_RECORD_BYTES:
            raise InvalidArgument("manifest exceeds 64 MiB")
        return raw + fixed32(crc32c(raw))

    @classmethod
    def decode(cls, raw: bytes) -> Manifest:
        """Versions 1 to 3 list one, two or three levels."""
        if len(raw) > MOST_RECORD_BYTES or len(raw) < 36:
            raise Corruption("manifest has a wrong size")
        if crc32c(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise Corruption("manifest checksum mismatch")
        r = Reader(raw[:-4], "manifest")
        if r.take(8) != MANIFEST_MAGIC:
            raise Corruption("not a manifest")
        version = r.u32()
        if not 1 <= version <= MANIFEST_VERSION:
            raise Corruption("manifest version is not supported")
        out = cls(r.u64(), r.u64())
        for level in range(version):
            for _ in range(r.u32()):
                out.levels[level].append(TableMeta(r.u64(), r.u64(), r.sized(), r.sized()))
        if r.rest:
            raise Corruption("manifest has bytes after its last table")
        if why := out.problem():
            raise Corruption(why)
        return out
