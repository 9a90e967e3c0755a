"""MPEG transport streams as a media column.

``mux`` stores each payload as a single-program transport stream (PAT, PMT, then packetised elementary
packets of a private stream, one access unit per 32 payload blocks); ``demux`` parses the program tables,
checks continuity counters, reassembles the elementary packets and reports timestamps and random-access points. It reads streams of
others too: sections that go over several packets or follow each other in one, several programs (the first with streams is read) and
new versions of its map, packets sent twice (dropped), signalled discontinuities (no error), packets marked as broken (left out),
and lost or foreign bytes between packets (it finds the packets again).

Defined results: null or empty text gives one block of padding; repeated rows give equal streams; extra columns are
not read; an empty table gives an empty table; a damaged stream gives counts in ``n_cc_errors``, ``n_sync_errors``, ``n_table_errors``
and ``n_damaged_units`` and the bytes that could be reassembled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import byte_values

BLOCK = 576
PACKET = 188
UNIT = 32 * BLOCK
PMT_PID = 0x1000
ES_PID = 0x0100
STREAM_TYPE = 0x06  # private PES data
STREAM_ID = 0xBD
CLOCK = 90_000
TICKS = 3_600  # 25 access units a second
FIRST_PTS = CLOCK

STREAM_SCHEMA = "media binary"
DEMUX_FIELDS = (
    "program_number int, pmt_pid int, es_pid int, stream_type int, n_packets long, n_units long, n_cc_errors long, "
    "n_sync_errors long, n_table_errors long, n_programs long, n_streams long, n_duplicates long, n_damaged_units long, first_pts long, last_pts long, random_access_units array<long>"
)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(
        0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    )
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


_TABLES = _tables()


def _stamp(pts: int) -> bytes:
    return bytes(
        [0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 255, 0x01 | (pts << 1) & 0xFE]
    )


def _clock_field(pts: int) -> bytes:
    base = (pts - CLOCK // 10) & 0x1FFFFFFFF
    return bytes([7, 0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big")


def pad(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of the block size."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\xff")


def build_stream(payload: bytes) -> bytes:
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts = (FIRST_PTS + k * TICKS) & 0x1FFFFFFFF
        data = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        field = _clock_field(pts)
        room = 184 - len(field)
        out.append(bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter]) + field + pes[:room])
        counter = counter + 1 & 15
        whole, rest = divmod(len(pes) - room, 184)
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, whole * 184, room).reshape(whole, 184)
            out.append(block.tobytes())
            counter = (counter + whole) & 15
        if rest:
            stuffing = 184 - rest - 1
            fill = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([0x47, ES_PID >> 8, ES_PID & 255, 0x30 | counter]) + fill + pes[-rest:])
            counter = counter + 1 & 15
    return b"".join(out)


def packets_of(media: bytes) -> tuple[np.ndarray, int]:
    """The packets of a stream and how often they had to be looked for: a packet begins with the sync byte and another follows it, or the end."""
    n, rest = divmod(len(media), PACKET)
    if not rest:
        whole = np.frombuffer(media, np.uint8).reshape(n, PACKET)
        if (whole[:, 0] == 0x47).all():
            return whole, 0
    starts, at, lost = [], 0, 0
    follows = lambda p: p + PACKET == len(media) or p + PACKET < len(media) and media[p + PACKET] == 0x47
    while at + PACKET <= len(media):
        if media[at] == 0x47 and follows(at):
            starts.append(at)
            at += PACKET
            continue
        lost += 1
        if media[at] == 0x47 and starts and starts[-1] == at - PACKET:  # the last before a gap
            starts.append(at)
        at = media.find(b"\x47", at + 1)
        while at >= 0 and at + PACKET <= len(media) and not follows(at):
            at = media.find(b"\x47", at + 1)
        if at < 0:
            break
    else:
        lost += at < len(media)
    return np.frombuffer(b"".join(media[p : p + PACKET] for p in starts), np.uint8).reshape(-1, PACKET), lost


def _sections(packets: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """The bodies of a PID's sections of one table, put together over packets, that are in force and whole; and how many aren't whole."""
    found, broken, held = [], 0, b""

    def take(data: bytes) -> bytes:
        """The sections at the start of ``data``; what is left is one that goes on."""
        nonlocal broken
        while len(data) >= 3 and data[0] != 0xFF:
            end = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < end:
                return data
            section, data = data[:end], data[end:]
            if end < 12 or crc32_mpeg(section):
                broken += 1
            elif section[0] == table_id and section[5] & 1:
                found.append(section[8:-4])
        return b"" if not data or data[0] == 0xFF else data

    last: bytes | None = None
    for row in packets:
        p = row.tobytes()
        if not p[3] & 0x10 or p == last:
            continue
        last = p
        data = p[4 + (p[4] + 1 if p[3] & 0x20 else 0) :]
        if p[1] & 0x40:
            if not data:
                continue
            pointer, data = data[0], data[1:]
            if held:
                broken += bool(take(held + data[:pointer]))
            held = take(data[pointer:])
        elif held:
            held = take(held + data)
    return found, broken + bool(held)


def parse_stream(media: bytes) -> tuple[bytes, dict]:
    """The elementary payload of the first stream of the first program that has one, and what the stream says of it."""
    packets, lost = packets_of(media)
    info = {
        "program_number": None, "pmt_pid": None, "es_pid": None, "stream_type": None, "n_packets": len(packets), "n_units": 0, "n_cc_errors": 0, "n_sync_errors": lost,
        "n_table_errors": 0, "n_programs": 0, "n_streams": 0, "n_duplicates": 0, "n_damaged_units": 0, "first_pts": None, "last_pts": None, "random_access_units": [],
    }
    broken = (packets[:, 1] & 0x80) > 0
    info["n_sync_errors"] += int(broken.sum())
    packets = packets[~broken]
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    tables, bad = _sections(packets[pids == 0], 0x00)
    programs: dict[int, int] = {}
    for body in tables:
        for at in range(0, len(body) - 3, 4):
            number = int.from_bytes(body[at : at + 2], "big")
            if number:
                programs[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    info["n_programs"], info["n_table_errors"] = len(programs), bad
    es_pids: list[int] = []
    for number, pmt_pid in programs.items():
        maps, bad = _sections(packets[pids == pmt_pid], 0x02)
        info["n_table_errors"] += bad
        streams: dict[int, int] = {}
        for body in maps:  # a later map takes the place of an earlier one; the first stream of each carries the payload
            at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            first = True
            while at + 5 <= len(body):
                pid = int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
                streams.setdefault(pid, body[at])
                if first and not info["n_streams"] and pid not in es_pids:
                    es_pids.append(pid)
                first = False
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)
        if streams and not info["n_streams"]:
            info |= {"program_number": number, "pmt_pid": pmt_pid, "es_pid": es_pids[0], "stream_type": streams[es_pids[0]], "n_streams": len(streams)}
    if not es_pids:
        return b"", info | {"n_table_errors": max(1, info["n_table_errors"])}
    own = packets[np.isin(pids, es_pids)]
    if not len(own):
        return b"", info
    if len(es_pids) == 1:  # a packet with a payload may come twice, byte for byte
        same = (own[1:, 3] == own[:-1, 3]) & ((own[1:, 3] & 0x10) > 0)
        same[same] = (own[1:][same] == own[:-1][same]).all(axis=1)
        info["n_duplicates"] = int(same.sum())
        own = own[np.r_[True, ~same]]
    control = own[:, 3]
    loaded = (control & 0x10).astype(bool)
    has_field = ((control & 0x20) > 0) & (own[:, 4] > 0)
    own_pid = (own[:, 1].astype(np.int32) & 0x1F) << 8 | own[:, 2]
    for pid in es_pids:
        at = own_pid == pid
        counters = (control[at] & 0x0F).astype(np.int16)
        step = (counters[1:] - counters[:-1]) & 15
        signalled = (has_field[at] & ((own[at, 5] & 0x80) > 0))[1:]
        info["n_cc_errors"] += int(((step != loaded[at][1:]) & ~signalled).sum())
    first = np.where((control & 0x20) > 0, 5 + own[:, 4].astype(np.int32), 4)
    first[~loaded] = PACKET
    first = np.minimum(first, PACKET)
    begins = (own[:, 1] & 0x40).astype(bool) & loaded
    access = has_field & ((own[:, 5] & 0x40) > 0)
    data = own[np.arange(PACKET)[None, :] >= first[:, None]].tobytes()
    ends = np.cumsum(PACKET - first)
    begin_at = (ends - (PACKET - first))[begins].tolist()
    parts, units = [], 0
    for a, b, is_random in zip(begin_at, [*begin_at[1:], len(data)], access[begins].tolist(), strict=True):
        if data[a : a + 3] != b"\x00\x00\x01" or b - a < 9:
            info["n_damaged_units"] += 1
            continue
        size, flags, header = int.from_bytes(data[a + 4 : a + 6], "big"), data[a + 7], data[a + 8]
        if flags & 0x80:
            s = data[a + 9 : a + 14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
            info["first_pts"] = pts if info["first_pts"] is None else info["first_pts"]
            info["last_pts"] = pts
            if is_random:
                info["random_access_units"].append(pts)
        info["n_damaged_units"] += bool(size) and b < a + 6 + size
        parts.append(data[a + 9 + header : min(b, a + 6 + size) if size else b])
        units += 1
    info["n_units"] = units
    return b"".join(parts), info


def mux(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: the stored form of every text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(byte_values(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([build_stream(pad(t)) for t in texts], pa.binary())],
                ["key", "n_bytes", "media"],
            )

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


def demux(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of ``df`` but the stream itself, and what the stream holds: digests of payload and of the stored form,
    program tables, counts and timestamps."""
    rest = [f for f in df.schema.fields if f.name != media]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, " + DEMUX_FIELDS
    names = [x.strip().split()[0] for x in DEMUX_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in byte_values(b.column(b.num_columns - 1)):
                payload, info = parse_stream(m)
                rows.append(
                    {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-32:]),
                        "media_bytes": len(m),
                        "media_sha256": hashlib.sha256(m).hexdigest(),
                    }
                    | info
                )
            types = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "random_access_units": pa.list_(pa.int64())}
            ints = {"program_number", "pmt_pid", "es_pid", "stream_type"}
            cols = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", *names]
            made = [pa.array([r[c] for r in rows], types.get(c, pa.int32() if c in ints else pa.int64())) for c in cols]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *made], [*(f.name for f in rest), *cols])

    return df.select(*(f.name for f in rest), media).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The result of query op1: every text stored and read back."""
    d = demux(mux(docs))
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in ("program_number", "es_pid", "n_packets", "n_units", "n_cc_errors", "first_pts", "last_pts")),
        F.concat(F.lit("random_access="), F.size("random_access_units").cast("string")),
    )
    return d.select(
        F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"), "n_packets", "n_units", "n_cc_errors", "n_sync_errors", "first_pts", "last_pts", "random_access_units",
    )
