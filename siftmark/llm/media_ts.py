"""Media columns as MPEG transport streams.

A payload is stored as one program with one elementary stream of private data: access
units of ``UNIT`` bytes in PES packets with timestamps, cut into transport packets of 188
bytes with continuity counters. A program association table and a program map table stand
before each random-access point, so that reading can begin there. Reading goes the whole
way back: it parses the tables (with their checksums) to find the stream, checks the
continuity counters of tables and stream, reassembles the PES packets and returns the
payload with the timestamp, place and random-access mark of each unit. A stream with a
damaged table, a cut packet or a gap in its counters is an error, unless gaps are asked for
as a number.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.llm.shared import ship

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0x0000, 0x1000, 0x0100, 0xBD, 0x06
#: Payload is padded to a multiple of BLOCK; bytes of an access unit; 90 kHz ticks between units; units between random-access points.
BLOCK, UNIT, TICKS, RANDOM_ACCESS = 192, 16 * 192, 3600, 8
PES_HEAD = 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The sections' checksum: polynomial 0x04C11DB7, most significant bit first."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packets(pid: int, section: bytes) -> list[bytes]:
    """The packet of a table for each value of its continuity counter."""
    return [(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | k, 0]) + section).ljust(PACKET, b"\xff") for k in range(16)]


_PAT = _table_packets(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packets(
    PMT_PID, _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload; one unit at least, so that an empty payload is stored too."""
    out = []
    counter = 0
    for i, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit = payload[at : at + UNIT]
        t = i * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + unit
        if i % RANDOM_ACCESS == 0:
            out += [_PAT[i // RANDOM_ACCESS & 15], _PMT[i // RANDOM_ACCESS & 15]]
            # adaptation field with the random-access mark and a clock reference
            field = bytes([0x50]) + (t << 15 | 0x7E00).to_bytes(6, "big")
        else:
            field = b""
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        pos, start = 0, True
        # packets up to the one that needs stuffing
        while pos < len(pes):
            left = len(pes) - pos
            if not start and left >= 184:
                n = left // 184
                block = np.empty((n, PACKET), np.uint8)
                block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
                block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
                block[:, 4:] = np.frombuffer(pes, np.uint8, n * 184, pos).reshape(n, 184)
                out.append(block.tobytes())
                pos, counter = pos + n * 184, counter + n & 15
                continue
            here = field if start else b""
            room = 184 - (len(here) + 1 if here else 0)
            if left >= room:
                adapt = bytes([len(here)]) + here if here else b""
            else:
                stuff = 184 - left - 1
                here = here or (b"\x00" if stuff else b"")
                adapt = bytes([stuff]) + here.ljust(stuff, b"\xff")
            data = pes[pos : pos + 184 - len(adapt)]
            head = bytes([SYNC, (0x40 if start else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adapt else 0x10) | counter])
            out.append(head + adapt + data)
            pos, counter, start = pos + len(data), counter + 1 & 15, False
    return b"".join(out)


def _sections(packets: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> bytes:
    """Body of the section of a table, its checksum verified; all packets of it say the same."""
    at = np.flatnonzero(pid == wanted)
    if not len(at):
        raise ValueError(f"no packet of table {table}")
    if (packets[at, 4:] != packets[at[0], 4:]).any():
        raise ValueError(f"table {table} is damaged")
    raw = packets[at[0]].tobytes()
    section = raw[5 + raw[4] :]
    size = int.from_bytes(section[1:3], "big") & 0x0FFF
    section = section[: 3 + size]
    if section[0] != table or crc32_mpeg(section):
        raise ValueError(f"table {table} is damaged")
    return section[8:-4]


def _gaps(packets: np.ndarray) -> int:
    """How often the continuity counter of one stream doesn't go on by one."""
    return int(((np.diff((packets[:, 3] & 15).astype(np.int16)) & 15) != 1).sum())


def demux(stream: bytes, gaps: bool = False) -> dict:
    """payload, pts (array), place of each unit in the payload, random (array of 0 and 1), entries, packets, discontinuities.

    ``stream`` may begin at any of its entries (numbers of packets from which on it can be read). Without ``gaps``
    a discontinuity is a ValueError.
    """
    if len(stream) % PACKET or not stream:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs = _sections(packets, pid, PAT_PID, 0x00)
    pmt = next(int.from_bytes(programs[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(programs), 4) if programs[k : k + 2] != b"\0\0")
    streams = _sections(packets, pid, pmt, 0x02)
    k = 4 + (int.from_bytes(streams[2:4], "big") & 0x0FFF)
    data_pid = None
    while k + 5 <= len(streams) and data_pid is None:
        if streams[k] == PRIVATE_TYPE:
            data_pid = int.from_bytes(streams[k + 1 : k + 3], "big") & 0x1FFF
        k += 5 + (int.from_bytes(streams[k + 3 : k + 5], "big") & 0x0FFF)
    mine = packets[pid == data_pid]
    breaks = sum(_gaps(packets[pid == k]) for k in (PAT_PID, pmt, data_pid))
    if breaks and not gaps:
        raise ValueError(f"{breaks} discontinuities")
    adapt = (mine[:, 3] & 0x20) > 0
    skip = 4 + np.where(adapt, 1 + mine[:, 4].astype(np.int32), 0)
    starts = np.flatnonzero(mine[:, 1] & 0x40)
    # bytes of every packet behind its header and adaptation field, in order
    flat = mine[np.arange(PACKET) >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    first = np.concatenate([[0], ends])[starts]
    units, pts, place, random = [], [], [], []
    at = 0
    for j, s in enumerate(starts):
        lo, hi = int(first[j]), int(first[j + 1]) if j + 1 < len(starts) else len(flat)
        if flat[lo : lo + 3] != b"\x00\x00\x01" or flat[lo + 3] != PRIVATE_STREAM:
            raise ValueError("a PES packet is damaged")
        size = int.from_bytes(flat[lo + 4 : lo + 6], "big")
        if lo + 6 + size != hi:
            raise ValueError("a PES packet is cut")
        b = flat[lo + 9 : lo + 14]
        pts.append((b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1)
        unit = flat[lo + 9 + flat[lo + 8] : hi]
        place.append(at)
        at += len(unit)
        units.append(unit)
        random.append(int(adapt[s] and mine[s, 4] > 0 and mine[s, 5] & 0x40 > 0))
    return {"payload": b"".join(units), "pts": pts, "place": place, "random": random, "entries": np.flatnonzero(pid == PAT_PID).tolist(), "packets": len(packets), "discontinuities": breaks}


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of BLOCK."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


SCHEMA = pa.schema([
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64()),
    ("discontinuities", pa.int64()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("media", pa.binary()),
])
DDL = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_packets long, discontinuities long, pts array<long>, random_access array<long>, media binary"
)


def describe(text: str, media: bytes | None = None) -> dict:
    """Stores a text and reads it back; with ``media`` reads that instead."""
    raw = text.encode()
    media = mux(padded(raw)) if media is None else media
    got = demux(media)
    payload = got["payload"]
    marks = [p for p, r in zip(got["place"], got["random"], strict=True) if r]
    histogram = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    share = ",".join(str(int(n)) for n in histogram * 1000 // max(1, len(payload)))
    feature = f"units={len(got['pts'])};last_pts={got['pts'][-1]};random_access={len(marks)};discontinuities={got['discontinuities']};nibbles={share}"
    return {
        "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "n_packets": got["packets"],
        "discontinuities": got["discontinuities"], "pts": got["pts"], "random_access": marks, "media": media,
    }


def media_columns(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """doc_id and, of every text as a transport stream, the chosen ``columns`` of SCHEMA (all by default, ``media`` too).

    Takes doc_id and text; other columns are not read. A null text counts as empty; an empty
    text is a payload of BLOCK spaces; rows that repeat give equal values; texts may be of
    any length. random_access holds places in the payload. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    chosen = columns or SCHEMA.names
    fields = [SCHEMA.field(n) for n in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [describe(t or "") for t in part.column(1).to_pylist()]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *chosen])

    kinds = dict(x.split(" ") for x in DDL.split(", "))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {kinds[n]}" for n in chosen))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document, with timestamps and random-access points, without the stored bytes themselves."""
    columns = [n for n in SCHEMA.names if n != "media"]
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns)
