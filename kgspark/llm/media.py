"""Media columns as MPEG transport streams.

A payload is stored as the private data of one elementary stream: a program
association table and a program map table, then one packetised elementary
packet for each access unit, cut into 188-byte transport packets with
continuity counters.  Each access unit begins with a random-access point that
carries a clock reference and a presentation time stamp.  Reading checks the
sync bytes, the tables with their checksums and the counters, reassembles the
elementary packets and returns the payload, the time stamps and the places of
the random-access points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, extended, map_blocks, table

PAD_TO = 576
#: Bytes of payload in an access unit.
UNIT = 8 * PAD_TO
#: Ticks of the 90 kHz clock from one access unit to the next.
TICKS = 3600
# Fixed values of the transport stream format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
PES_HEAD = 14


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        out.append(value)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ CRC[value >> 24 ^ byte]
    return value


def _section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A table of one section in a transport packet of its own."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


TABLES = _section(PAT_PID, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(
    PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamps(times: np.ndarray) -> np.ndarray:
    """Five bytes for each presentation time stamp."""
    out = np.empty((len(times), 5), np.uint8)
    out[:, 0] = 0x21 | (times >> 30 & 7) << 1
    out[:, 1] = times >> 22 & 255
    out[:, 2] = times >> 14 & 254 | 1
    out[:, 3] = times >> 7 & 255
    out[:, 4] = times << 1 & 254 | 1
    return out


def _packets(units: np.ndarray, first: int) -> np.ndarray:
    """Transport packets (without counters) of access units of one size."""
    count, size = units.shape
    times = (first + np.arange(count, dtype=np.int64)) * TICKS
    pes = np.empty((count, PES_HEAD + size), np.uint8)
    length = size + 8
    pes[:, :9] = [0, 0, 1, PRIVATE_STREAM, length >> 8, length & 255, 0x84, 0x80, 5]
    pes[:, 9:PES_HEAD] = _stamps(times)
    pes[:, PES_HEAD:] = units
    total = pes.shape[1]
    rest = max(0, total - 176)
    number = 1 + -(-rest // 184)
    out = np.empty((count, number, PACKET), np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = DATA_PID >> 8
    out[:, :, 2] = DATA_PID & 255
    out[:, :, 3] = 0x10
    head = min(total, 176)
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    out[:, 0, 4] = 183 - head
    out[:, 0, 5] = 0x50
    out[:, 0, 6] = times >> 25 & 255
    out[:, 0, 7] = times >> 17 & 255
    out[:, 0, 8] = times >> 9 & 255
    out[:, 0, 9] = times >> 1 & 255
    out[:, 0, 10] = (times & 1) << 7 | 0x7E
    out[:, 0, 11] = 0
    out[:, 0, 12 : PACKET - head] = 255
    out[:, 0, PACKET - head :] = pes[:, :head]
    whole = rest // 184
    if whole:
        out[:, 1 : 1 + whole, 4:] = pes[:, head : head + whole * 184].reshape(count, whole, 184)
    left = rest - whole * 184
    if left:
        last = out[:, -1]
        last[:, 3] = 0x30
        last[:, 4] = 183 - left
        last[:, 5 : PACKET - left] = 255
        if left < 183:
            last[:, 5] = 0
        last[:, PACKET - left :] = pes[:, total - left :]
    return out.reshape(-1, PACKET)


def mux(payload: bytes) -> bytes:
    """Transport stream that holds ``payload``."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts = []
    if whole:
        parts.append(_packets(data[: whole * UNIT].reshape(whole, UNIT), 0))
    if whole * UNIT < len(data):
        parts.append(_packets(data[whole * UNIT :][None, :], whole))
    if not parts:
        return TABLES
    packets = np.concatenate(parts)
    packets[:, 3] |= (np.arange(len(packets)) & 15).astype(np.uint8)
    return TABLES + packets.tobytes()


def _pieces(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the packets of one id: their numbers without duplicates, where payloads begin, which end a gap, which are random-access points.

    The counter of a packet with payload follows the last one's; one without
    payload repeats it; a packet may be sent twice in a row; and a flag in the
    adaptation field announces that the counter starts anew.
    """
    control = packets[:, 3] >> 4 & 3
    extra = control & 2 > 0
    loaded = control & 1 > 0
    flags = np.where(extra & (packets[:, 4] > 0), packets[:, 5], 0)
    skip = np.where(extra, 5 + packets[:, 4].astype(np.int64), 4)
    at = np.flatnonzero(loaded)
    counter = packets[at, 3] & 15
    same = np.append(False, (counter[1:] == counter[:-1]) & (packets[at[1:], 4:] == packets[at[:-1], 4:]).all(axis=1))[: len(at)]
    # a third packet with the same counter is no duplicate any more
    same &= ~np.append(False, same[:-1])[: len(at)]
    at, counter = at[~same], counter[~same]
    anew = np.maximum.accumulate(np.where(flags & 0x80 > 0, np.arange(len(packets)), -1))[at] if len(at) else at
    gap = np.append(False, (counter[1:] != (counter[:-1] + 1 & 15)) & ~(anew[1:] > at[:-1]))[: len(at)]
    return at, skip[at], gap, flags[at] & 0x40 > 0


def _sections(packets: np.ndarray, table_id: int) -> list[bytes]:
    """Bodies of the sections of a table, which may run over several packets; checksums are verified."""
    at, skip, gap, _ = _pieces(packets)
    out, held = [], None
    for k, begin, broken in zip(at.tolist(), skip.tolist(), gap.tolist()):
        raw = packets[k].tobytes()
        data = raw[begin:]
        held = None if broken else held
        if raw[1] & 0x40:
            rest, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            held = _closed(out, held + rest, table_id) if held is not None else None
            held = b""
        if held is not None:
            held = _closed(out, held + data, table_id)
    if not out:
        raise ValueError("a program table is missing")
    return out


def _closed(out: list[bytes], held: bytes, table_id: int) -> bytes:
    """Takes whole sections off ``held`` into ``out``; returns what is left."""
    while len(held) >= 3 and held[0] != 0xFF:
        end = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < end:
            return held
        if held[0] == table_id:
            if crc32_mpeg(held[:end]):
                raise ValueError("a program table is damaged")
            if held[5] & 1:  # in force
                out.append(held[8 : end - 4])
        held = held[end:]
    return held if held[:1] != b"\xff" else b""


def programs(packets: np.ndarray, pids: np.ndarray) -> list[tuple[int, int, int]]:
    """(program number, packet id, stream type) of all elementary streams, from the program tables."""
    out = []
    for body in dict.fromkeys(_sections(packets[pids == PAT_PID], 0)):
        for k in range(0, len(body), 4):
            number, pid = int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
            if not number:  # the network's own table
                continue
            for streams in dict.fromkeys(_sections(packets[pids == pid], 2)):
                at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
                while at < len(streams):
                    out.append((number, int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF, streams[at]))
                    at += 5 + (int.from_bytes(streams[at + 3 : at + 5], "big") & 0xFFF)
    return list(dict.fromkeys(out))


#: Stream ids whose packets have no optional header.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def demux(stream: bytes, pid: int | None = None) -> dict:
    """Payload, time stamps and random-access points of an elementary stream: that of ``pid``, or the first of the tables.

    ``continuity_errors`` counts packets before which some are missing.
    ``damaged`` numbers the elementary packets that lack a part or whose length
    isn't as told; what there is of them is in the payload.  What comes before
    the first start of an elementary packet is no part of it.
    """
    packets = np.frombuffer(stream, np.uint8)
    if len(packets) % PACKET:
        raise ValueError("the stream ends within a packet")
    packets = packets.reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    known = programs(packets, pids)
    kinds = {p: kind for _, p, kind in reversed(known)}
    pid = known[0][1] if pid is None else pid
    at = np.flatnonzero(pids == pid)
    sent = packets[at]
    chosen, skip, gap, access = _pieces(sent)
    own = sent[chosen]
    data = own[np.arange(PACKET)[None, :] >= skip[:, None]]
    ends = np.cumsum(PACKET - skip)
    opens = np.flatnonzero(own[:, 1] & 0x40 > 0)
    starts = (ends - (PACKET - skip))[opens]
    bounds = [*starts.tolist(), len(data)]
    lost = np.append(0, np.cumsum(gap))
    parts, times, damaged = [], [], []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        head = data[a : a + PES_HEAD].tobytes()
        if head[:3] != b"\0\0\1":
            raise ValueError("an elementary packet has no start code")
        first, after = int(opens[k]), int(opens[k + 1]) if k + 1 < len(opens) else len(own)
        length = int.from_bytes(head[4:6], "big")
        # a gap right before the next start may have taken this one's end
        short = length and b - a != length + 6
        if lost[after] > lost[first + 1] or short:
            damaged.append(k)
        if head[3] in BARE:
            parts.append(data[a + 6 : b])
            continue
        if head[7] & 0x80:
            p = head[9:14]
            times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(data[a + 9 + head[8] : b])
    payload = np.concatenate(parts).tobytes() if parts else b""
    return {
        "payload": payload,
        "stream_type": kinds.get(pid),
        "n_packets": len(sent),
        "continuity_errors": int(gap.sum()),
        "damaged": damaged,
        "pts": times,
        "random_access": at[chosen[access]].tolist(),
    }


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of a text (null: empty) with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw.ljust(max(PAD_TO, -(-len(raw) // PAD_TO) * PAD_TO), b"\xff")


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Transport stream of each text: (id, n_bytes, media binary).

    Null and empty texts give one block of padding.  Every input row gives one
    row; null and repeated ids pass through; other columns are left behind.
    """

    def step(block: pa.RecordBatch) -> dict[str, list]:
        texts = block.column(1).to_pylist()
        return {"id": block.column(0), "n_bytes": [len((t or "").encode()) for t in texts], "media": [mux(padded(t)) for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_blocks(df.select(id_col, text_col), step, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


MEDIA_FIELDS = "payload binary, stream_type int, n_packets long, continuity_errors long, damaged array<long>, pts array<long>, random_access array<long>"


def load(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read transport streams back; all columns of ``df`` stay, MEDIA_FIELDS are added.

    A null stream gives nulls.  Streams without sync bytes or program tables
    raise; lost packets are told (``demux``).  Columns that are named
    like one of MEDIA_FIELDS already are replaced.
    """
    arrow = _arrow_schema(df.sparkSession, MEDIA_FIELDS)
    df = df.drop(*arrow.names)
    kept = df.columns
    spot = kept.index(media_col)

    def step(block: pa.RecordBatch) -> dict[str, list]:
        read = [demux(m) if m is not None else {} for m in block.column(spot).to_pylist()]
        columns = {name: block.column(k) for k, name in enumerate(kept)}
        return columns | {f.name: [x.get(f.name) for x in read] for f in arrow}

    return map_blocks(df, step, extended(df, MEDIA_FIELDS), text=spot)


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a transport stream, read it back, digest both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = load(store(docs))
    size = F.octet_length("payload")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("n_packets")),
        F.concat(F.lit("units="), F.size("pts")),
        F.concat(F.lit("last_pts="), F.element_at("pts", -1)),
        F.concat(F.lit("access="), F.concat_ws(",", "random_access")),
        F.concat(F.lit("errors="), F.col("continuity_errors")),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("pts"),
        F.col("random_access"),
    )
