"""Operator 1: media columns in the Ogg container.

``write_ogg`` stores a byte payload as unsigned 8-bit samples in two logical
streams (the first and the second half of the payload), with pages interleaved
in time order. ``read_ogg`` is a general reader: it verifies the checksum of
each page, separates the logical streams by serial number, joins packets from
their lacing values across pages, and derives a timestamp for each packet from
the granule positions. ``probe`` applies the reader to a binary column,
``store_texts`` stores texts and describes what is read back.

Nulls: a null text is an empty text; a null id stays null; a null media value gives status 'null'.
Damaged media give the status 'damaged' with what could be read before it. Repeated rows are stored as they come, equal texts as equal media;
a long text is as many pages as it needs, held whole while it is stored. An empty table gives an empty table; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns, text_bytes

RATE = 8000
PACKET = 5000  # samples in a packet
PAGE_SEGMENTS = 64
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIQQ")  # magic, rate, samples in this stream, offset of its first sample
_MAGIC = b"\x80pcm-u8\x00"
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04c11db7, most significant bit first, start and end 0) by zlib's mirrored one."""
    raw = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, samples: bytes, offset: int, rate: int) -> list[tuple[float, bytes]]:
    """(time, page) of one logical stream. Packets run over page ends where lacing values require it."""
    ident = _IDENT.pack(_MAGIC, rate, len(samples), offset)
    out = [(-1.0, _page(2, 0, serial, 0, bytes([len(ident)]), ident))]
    lacing, ends = bytearray(), []  # ends: (segment index after the packet, granule)
    for at in range(0, len(samples), PACKET):
        n = min(PACKET, len(samples) - at)
        lacing += b"\xff" * (n // 255) + bytes([n % 255])
        ends.append((len(lacing), at + n))
    taken = done = e = 0
    for s in range(0, len(lacing), PAGE_SEGMENTS):
        part = bytes(lacing[s : s + PAGE_SEGMENTS])
        size = sum(part)
        granule = -1
        while e < len(ends) and ends[e][0] <= s + len(part):
            granule = ends[e][1]
            e += 1
        flags = (1 if s and lacing[s - 1] == 255 else 0) | (4 if s + PAGE_SEGMENTS >= len(lacing) else 0)
        out.append((done / rate, _page(flags, granule, serial, len(out), part, samples[taken : taken + size])))
        taken += size
        done = granule if granule >= 0 else done
    return out


def write_ogg(payload: bytes, rate: int = RATE) -> bytes:
    half = len(payload) // 2
    pages = _stream_pages(1, payload[:half], 0, rate) + _stream_pages(2, payload[half:], half, rate)
    pages.sort(key=lambda p: p[0])  # stable: streams alternate, first pages before all others
    return b"".join(p for _, p in pages)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # at the end of each packet; -1: not given
    pages: int = 0
    partial: bytes = b""
    ended: bool = False
    next_seq: int = 0


def read_ogg(data: bytes) -> tuple[dict[int, Stream], list[str]]:
    """Logical streams by serial number, and what is wrong. A page with a wrong checksum is passed over,
    and a packet of which it held a part is dropped, as the format demands."""
    streams: dict[int, Stream] = {}
    faults: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            nxt = data.find(b"OggS", at + 1)
            faults.append(f"no page at {at}")
            if nxt < 0:
                break
            at = nxt
            continue
        _, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if len(lacing) < n or len(page) < end - at or version or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            faults.append(f"bad page at {at}")
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if seq != s.next_seq:
            faults.append(f"stream {serial}: page {s.next_seq} is missing")
            s.partial = b""
        skip = bool(flags & 1) and not s.partial and seq != 0  # goes on with a packet whose start is lost
        if not flags & 1 and s.partial:
            faults.append(f"stream {serial}: a packet has no end")
            s.partial = b""
        body, first = 27 + n, len(s.packets)
        start = body
        for v in lacing:
            body += v
            if v < 255:
                if not skip:
                    s.packets.append(s.partial + page[start:body])
                    s.granules.append(-1)
                s.partial, start, skip = b"", body, False
        if start < body:
            s.partial = b"" if skip else s.partial + page[start:body]
        if len(s.packets) > first and granule >= 0:
            s.granules[-1] = granule  # that of the last packet which ends on the page
        s.pages += 1
        s.next_seq = seq + 1
        s.ended = s.ended or bool(flags & 4)
        at = end
    return streams, faults


def packet_times(s: Stream, rate: int, length=len) -> list[float]:
    """Start of each packet in seconds. Granules name the end of a page's last packet; earlier packets on the
    page count back from it by their own lengths."""
    ends, known = [0] * len(s.packets), None
    for i in range(len(s.packets) - 1, -1, -1):
        known = s.granules[i] if s.granules[i] >= 0 else (known - length(s.packets[i + 1]) if known is not None else 0)
        ends[i] = known
    return [(e - length(p)) / rate for e, p in zip(ends, s.packets)]


def read_samples(data: bytes) -> tuple[bytes, dict]:
    """The payload of ``write_ogg`` again, and what the container says."""
    streams, faults = read_ogg(data)
    parts, n_packets, n_pages, last = [], 0, 0, 0.0
    for s in streams.values():
        magic, rate, n, offset = _IDENT.unpack(s.packets[0])
        if magic != _MAGIC:
            faults.append("unknown codec")
            continue
        body = Stream(s.serial, s.packets[1:], s.granules[1:])
        times = packet_times(body, rate)
        order = sorted(range(len(times)), key=times.__getitem__)
        joined = b"".join(body.packets[i] for i in order)
        if len(joined) != n:
            faults.append(f"stream {s.serial}: {len(joined)} of {n} samples")
        parts.append((offset, joined))
        n_packets += len(s.packets)
        n_pages += s.pages
        last = max([last, *(t + len(p) / rate for t, p in zip(times, body.packets))])
    parts.sort()
    return b"".join(p for _, p in parts), {"streams": len(streams), "packets": n_packets, "pages": n_pages, "seconds": last, "faults": faults}


def sample_features(samples: bytes) -> str:
    """Level, crossings of the middle, flatness and entropy of unsigned 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "rms=0.000000;crossings=0;delta=0.000000;entropy=0.000000"
    hist = np.bincount(x, minlength=256)
    v = np.arange(256) - 128.0
    rms = float(np.sqrt((hist * v * v).sum() / len(x)))
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    delta = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    p = hist[hist > 0] / len(x)
    return f"rms={rms:.6f};crossings={crossings};delta={delta:.6f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f}"


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])


def _store(cols: dict, keep_media: bool) -> dict:
    out: dict[str, list] = {n: [] for n in _STORED.names}
    for doc_id, text in zip(cols["doc_id"], cols["text"]):
        raw = text_bytes(text)
        media = write_ogg(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
        back, info = read_samples(media)
        if info["faults"]:
            raise ValueError(f"what was stored for {doc_id} can't be read back: {info['faults'][:3]}")
        row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(),
               f"streams={info['streams']};packets={info['packets']};pages={info['pages']};seconds={info['seconds']:.6f};{sample_features(back)}", media if keep_media else None)
        for n, v in zip(_STORED.names, row):
            out[n].append(v)
    return out


def store_texts(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, text -> the stored medium and what is read back from it. One narrow stage: no shuffle."""
    out = map_columns(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), lambda c: _store(c, keep_media), _STORED)
    return out if keep_media else out.drop("media")


_PROBED = pa.schema([("id", pa.int64()), ("status", pa.string()), ("serial", pa.int64()), ("packet", pa.int64()), ("granule", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


def _probe(cols: dict) -> dict:
    out: dict[str, list] = {n: [] for n in _PROBED.names}
    for i, media in zip(cols["id"], cols["media"]):
        streams, faults = read_ogg(media) if media is not None else ({}, [])
        status = "null" if media is None else "damaged" if faults else "ok" if streams else "empty"
        rows = [(i, status, s.serial, k, g, len(p), hashlib.sha256(p).hexdigest()) for s in streams.values() for k, (p, g) in enumerate(zip(s.packets, s.granules))]
        for row in rows or [(i, status, None, None, None, None, None)]:
            for n, v in zip(_PROBED.names, row):
                out[n].append(v)
    return out


def probe(df: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """One row for each packet of each Ogg value: stream, number, granule position, size and digest."""
    return map_columns(df.select(df[id_column].cast("bigint").alias("id"), df[media_column].alias("media")), _probe, _PROBED)
