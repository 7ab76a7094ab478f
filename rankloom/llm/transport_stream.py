"""MPEG transport streams as a media column: write payloads into packets, and parse streams back.

A stream is a run of 188-byte packets (ISO/IEC 13818-1). Packet 0 holds the program association table, packet 1 the program
map table, the rest one elementary stream of private data in PES packets. Each PES packet has a timestamp of the 90 kHz
clock; its first packet is marked as a random-access point and carries a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, STREAM_TYPE = 0x100, 0x101, 0x06  # 6: PES packets with private data
UNIT = 16_384  # payload bytes of a PES packet
TICK = 3_600  # clock ticks from one PES packet to the next, 40 ms
ROOM = PACKET - 4


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (n := len(body) + 9) >> 8, n & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
)


def _stamp(t: int) -> bytes:
    """A timestamp of 33 bits in the 5 bytes of a PES header."""
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one elementary stream."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT) or (0,)):
        part = payload[at : at + UNIT]
        t = k * TICK & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(t) + part
        # the first packet: an adaptation field of 8 bytes with the random-access flag and the clock reference, more if it is the last one too
        head = bytes([0x50]) + (t << 15 | 0x7E00).to_bytes(6, "big")
        first = min(len(pes), ROOM - 8)
        fill = ROOM - 8 - first
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter, 7 + fill]) + head + b"\xff" * fill + pes[:first])
        counter = (counter + 1) & 15
        rest = len(pes) - first
        if rest > 0:
            whole, last = divmod(rest, ROOM)
            block = np.empty((whole, PACKET), np.uint8)
            if whole:
                block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
                block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
                block[:, 4:] = np.frombuffer(pes, np.uint8, whole * ROOM, first).reshape(whole, ROOM)
                out.append(block.tobytes())
                counter = (counter + whole) & 15
            if last:
                gap = ROOM - last  # one byte of length, then flags and stuffing
                field = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
                out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter]) + field + pes[first + whole * ROOM :])
                counter = (counter + 1) & 15
    return b"".join(out)


class Stream:
    """What a transport stream holds: programs, elementary streams, their packets, timestamps and errors."""

    def __init__(self, data: bytes):
        self.programs: dict[int, int] = {}
        self.streams: dict[int, int] = {}
        self.pes: list[tuple[int, int | None, bool, bytes]] = []  # pid, timestamp, random-access point, payload
        self.packets = self.lost_sync = self.counter_errors = self.crc_errors = self.duplicates = 0
        self.size = len(data)
        self._parse(data)

    def payload(self, pid: int | None = None) -> bytes:
        """The elementary stream ``pid``, of the first program's first stream by default."""
        pid = next(iter(self.streams), None) if pid is None else pid
        return b"".join(p[3] for p in self.pes if p[0] == pid)

    def feature(self) -> str:
        stamps = [p[1] for p in self.pes if p[1] is not None]
        points = ",".join(str(p[1]) for p in self.pes if p[2] and p[1] is not None)
        mark = zlib.crc32(points.encode())
        programs = "+".join(f"{n}@{pid}" for n, pid in sorted(self.programs.items()))
        streams = "+".join(f"{pid}:{kind}" for pid, kind in sorted(self.streams.items()))
        return (
            f"programs={programs};streams={streams};packets={self.packets};pes={len(self.pes)};lost_sync={self.lost_sync};counter_errors={self.counter_errors}"
            f";duplicates={self.duplicates};crc_errors={self.crc_errors};random_access={sum(p[2] for p in self.pes)};first_pts={stamps[0] if stamps else ''};last_pts={stamps[-1] if stamps else ''};points_crc32={mark}"
        )

    def _packets(self, data: bytes) -> np.ndarray:
        """Packets in step with the sync byte; where it is missing, bytes are skipped up to two sync bytes a packet apart."""
        parts, at, raw = [], 0, np.frombuffer(data, np.uint8)
        while len(data) - at >= PACKET:
            n = (len(data) - at) // PACKET
            block = raw[at : at + n * PACKET].reshape(n, PACKET)
            bad = np.flatnonzero(block[:, 0] != SYNC)
            good = int(bad[0]) if len(bad) else n
            parts.append(block[:good])
            at += good * PACKET
            if good == n:
                break
            self.lost_sync += 1
            at = data.find(SYNC, at + 1)
            while at >= 0 and at + PACKET < len(data) and data[at + PACKET] != SYNC:
                at = data.find(SYNC, at + 1)
            if at < 0:
                break
        return np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)

    def _parse(self, data: bytes) -> None:
        p = self._packets(data)
        self.packets = len(p)
        if not len(p):
            return
        pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        control, counter = p[:, 3] >> 4 & 3, p[:, 3] & 15
        field = np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0)
        begin = np.minimum(4 + field, PACKET)
        has = (control & 1 == 1) & (p[:, 1] & 0x80 == 0)
        unit = p[:, 1] & 0x40 != 0
        point = (field > 1) & (p[:, 5] & 0x40 != 0)
        broken = (field > 1) & (p[:, 5] & 0x80 != 0)  # a discontinuity that the stream announces
        self._tables(p, pid, begin, unit, has)
        for own in self.streams:
            self._elementary(own, p, np.flatnonzero((pid == own) & has), counter, begin, unit, point, broken)

    def _sections(self, p, rows, begin, unit) -> list[bytes]:
        """Whole sections of a pid; each may go over several packets."""
        found, buffer = [], b""
        for i in rows:
            body = p[i, begin[i] :].tobytes()
            if unit[i]:
                cut = body[0] + 1 if body else 0
                self._cut(buffer + body[1:cut], found)  # what a section still lacked comes before the pointer's end
                buffer, body = b"", body[cut:]
            buffer = self._cut(buffer + body, found)
        return found

    @staticmethod
    def _cut(buffer: bytes, found: list[bytes]) -> bytes:
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            n = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
            if len(buffer) < n:
                return buffer
            found.append(buffer[:n])
            buffer = buffer[n:]
        return b""

    def _valid(self, p, rows, begin, unit, table_id) -> list[bytes]:
        out = []
        for s in self._sections(p, rows, begin, unit):
            if s[0] == table_id and len(s) >= 12:
                if section_crc(s):
                    self.crc_errors += 1
                else:
                    out.append(s)
        return out

    def _tables(self, p, pid, begin, unit, has) -> None:
        for s in self._valid(p, np.flatnonzero((pid == 0) & has), begin, unit, 0):
            for at in range(8, len(s) - 4, 4):
                number, target = s[at] << 8 | s[at + 1], (s[at + 2] & 0x1F) << 8 | s[at + 3]
                if number:
                    self.programs[number] = target
        for target in dict.fromkeys(self.programs.values()):
            for s in self._valid(p, np.flatnonzero((pid == target) & has), begin, unit, 2):
                at = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while at + 5 <= len(s) - 4:
                    self.streams[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                    at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])

    def _elementary(self, own, p, rows, counter, begin, unit, point, broken) -> None:
        if not len(rows):
            return
        c = counter[rows].astype(np.int32)
        step = (c[1:] - c[:-1]) % 16
        same = np.zeros(len(rows), bool)
        if (step == 0).any():
            again = np.flatnonzero(step == 0) + 1
            same[again] = (p[rows[again]] == p[rows[again - 1]]).all(axis=1)  # a packet may be sent twice
        self.duplicates += int(same.sum())
        self.counter_errors += int(((step != 1) & ~same[1:] & ~broken[rows[1:]]).sum())
        rows = rows[~same]
        starts = np.flatnonzero(unit[rows])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            mine, at = rows[a:b], begin[rows[a:b]]
            plain = at == 4
            if plain[1:-1].all() and len(mine) > 2:
                pes = p[mine[0], at[0] :].tobytes() + p[mine[1:-1], 4:].tobytes() + p[mine[-1], at[-1] :].tobytes()
            else:
                pes = b"".join(p[i, k:].tobytes() for i, k in zip(mine, at, strict=True))
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                continue
            size, head = pes[4] << 8 | pes[5], 9 + pes[8]
            t = None
            if pes[7] & 0x80 and len(pes) >= 14:
                t = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
            self.pes.append((own, t, bool(point[mine[0]]), pes[head : 6 + size if size else None]))


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\x00")


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded, in a transport stream. Null text: empty."""

    def rows(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_stream(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return kept.mapInArrow(tidy(rows), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Parse the ``media`` column: payload and stream digests and a feature string, beside doc_id and n_bytes.

    A null or empty stream has no packets and an empty payload. Bytes out of step with the sync byte are skipped and
    counted; so are jumps of the continuity counters, repeated packets and tables with a wrong checksum. Equal streams give
    equal values; a null id stays null; an empty table gives none.
    """

    def rows(batches):
        for b in batches:
            done = []
            for data in b.column(2).to_pylist():
                data = data or b""
                s = Stream(data)
                payload = s.payload()
                done.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), s.feature()))
            cols = list(zip(*done, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(rows), schema)
