"""MPEG audio streams: frame headers, tags, variable-bitrate tables and checksums.

`wrap` stores bytes losslessly: each is the ancillary data of silent Layer III frames, the format's own place
for other data, with a checksum in every frame, a tag that tells the number of bytes and their SHA-256, and a
Xing table. A frame's checksum covers its header and side information only, so `unwrap` verifies the digest too.
`scan` reads any MPEG-1, 2 or 2.5 stream of Layers I to III: it skips tags, looks for a header that another
follows, finds its way back after damage, and verifies the checksums of all three layers.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

# Fixed values of the format: kbit/s by bitrate index, Hz by rate index, samples of a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


#: Layer II, fixed values of the format: bits of each subband's allocation, as (bits, subbands) from the lowest on.
ALLOCATIONS = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


class Header(NamedTuple):
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    mono: bool
    side: int
    #: Subbands that hold both channels apart; the rest share an allocation.
    bound: int


@lru_cache(1 << 12)
def header(raw: bytes) -> Header | None:
    """What four bytes say, or None where they begin no frame (free-format streams count as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    index, rate_index, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or raw[3] & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    bitrate, rate, samples = BITRATES[family, layer][index] * 1000, RATES[version][rate_index], SAMPLES[family, layer]
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 1 else (9 if mono else 17))
    bound = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
    return Header(version, layer, not raw[1] & 1, bitrate, rate, length, samples, mono, side, bound)


@lru_cache(1 << 12)
def crc16(raw: bytes) -> int:
    """The frame checksum: polynomial 0x8005, first value 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _crc_bits(raw: bytes, bits: int) -> int:
    """The checksum of so many leading bits."""
    crc = crc16(raw[: bits // 8])
    for k in range(bits % 8):
        top = (crc >> 15 ^ raw[bits // 8] >> (7 - k)) & 1
        crc = (crc << 1 ^ 0x8005 if top else crc << 1) & 0xFFFF
    return crc


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in Layer II, by version, rate and bitrate for each channel."""
    each = h.bitrate // (1 if h.mono else 2) // 1000
    if h.version != 1:
        name = "low"
    elif each in (32, 48):
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATIONS[name] for _ in range(n)]


def checksum(raw: bytes, at: int, h: Header) -> int:
    """What a protected frame's checksum should be: over the header's last bytes, then Layer III's side information, Layer I's allocations, or Layer II's allocations and selections."""
    body, channels = raw[at + 6 : at + h.length], 1 if h.mono else 2
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (32 if h.mono else 2 * h.bound + (32 - h.bound))
    else:
        value, size, bits, used = int.from_bytes(body[:48], "big"), 8 * min(48, len(body)), 0, 0
        for band, width in enumerate(_allocation(h)):
            for _ in range(channels if band < h.bound else 1):
                bits += width
                if bits > size:
                    return -1
                # A band that shares its allocation has a selection for each channel.
                used += (channels if band >= h.bound else 1) * bool(value >> (size - bits) & ((1 << width) - 1))
        bits += 2 * used
    if bits > 8 * len(body):
        return -1
    return _crc_bits(raw[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def text_tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.4 tag with a user text frame for each field."""
    body = b""
    for k, v in fields.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


#: The frames that wrap() makes: mono Layer III at 32 kHz, whose lengths are whole for every bitrate.
_SIZES = [144 * BITRATES[1, 3][i] * 1000 // 32000 for i in range(1, 15)]


@lru_cache(16)
def _head(index: int) -> bytes:
    raw = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    return raw + crc16(raw[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def _frame(data: bytes) -> bytes:
    index = next(i for i, size in enumerate(_SIZES, 1) if size - 23 >= len(data))
    return (_head(index) + data).ljust(_SIZES[index - 1], b"\0")


def wrap(payload: bytes) -> bytes:
    """A stream that holds the payload."""
    room = _SIZES[-1] - 23
    head = _head(14)
    frames = [head + payload[i : i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := len(payload) % room:
        frames.append(_frame(payload[-rest:]))
    sizes = [len(f) for f in frames]
    first = _SIZES[6]
    total = first + sum(sizes)
    toc, seen = bytearray(), [first]
    for s in sizes:
        seen.append(seen[-1] + s)
    for percent in range(100):
        toc.append(min(255, 256 * seen[percent * len(sizes) // 100] // total))
    table = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc) + (0).to_bytes(4, "big")
    return b"".join([text_tag({"payload_bytes": str(len(payload)), "payload_sha256": hashlib.sha256(payload).hexdigest()}), (_head(7) + table).ljust(first, b"\0"), *frames])


class Stream(NamedTuple):
    tags: dict[str, str]
    vbr: dict | None
    #: Offsets of the frames, without a table's own frame.
    offsets: list[int]
    headers: list[Header]
    skipped: int
    checked: int
    failed: int

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return sum((Fraction(n, rate) for rate, n in self._by_rate().items()), Fraction(0))

    def _by_rate(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for h in self.headers:
            out[h.rate] = out.get(h.rate, 0) + h.samples
        return out


def _tags(raw: bytes) -> tuple[dict[str, str], int]:
    """User texts of the ID3v2 tags at the start, and where the audio begins."""
    tags, at = {}, 0
    while raw[at : at + 3] == b"ID3" and at + 10 <= len(raw):
        major, flags, size = raw[at + 3], raw[at + 5], _unsyncsafe(raw[at + 6 : at + 10])
        k, end = at + 10, min(len(raw), at + 10 + size)
        while k + 10 <= end and raw[k : k + 4].isalnum():
            n = _unsyncsafe(raw[k + 4 : k + 8]) if major == 4 else int.from_bytes(raw[k + 4 : k + 8], "big")
            if raw[k : k + 4] == b"TXXX" and raw[k + 10 : k + 11] in (b"\0", b"\x03"):
                name, _, value = raw[k + 11 : k + 10 + n].partition(b"\0")
                tags[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            k += 10 + n
        at += 10 + size + (10 if flags & 0x10 else 0)
    return tags, at


def _vbr(raw: bytes, at: int, h: Header) -> dict | None:
    k = at + 4 + 2 * h.protected + h.side
    if raw[k : k + 4] in (b"Xing", b"Info"):
        flags, k, out = int.from_bytes(raw[k + 4 : k + 8], "big"), k + 8, {"kind": raw[k : k + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(raw[k : k + 4], "big")
                k += 4
        if flags & 4:
            out["toc"] = list(raw[k : k + 100])
        return out
    k = at + 36
    if raw[k : k + 4] == b"VBRI":
        entries, scale, width = (int.from_bytes(raw[k + a : k + a + 2], "big") for a in (18, 20, 22))
        toc = [scale * int.from_bytes(raw[k + 26 + i * width : k + 26 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(raw[k + 10 : k + 14], "big"), "frames": int.from_bytes(raw[k + 14 : k + 18], "big"), "toc": toc}
    return None


def scan(raw: bytes) -> Stream:
    tags, at = _tags(raw)
    end = len(raw) - (128 if len(raw) >= 128 and raw[-128:-125] == b"TAG" else 0)
    vbr, offsets, headers, skipped, checked, failed, locked = None, [], [], 0, 0, 0, False
    while at + 4 <= end:
        h = header(raw[at : at + 4])
        nxt = at + h.length if h else 0
        good = h is not None and nxt <= end and (nxt == end or locked or nxt + 4 > end or header(raw[nxt : nxt + 4]) is not None)
        if not good:
            locked = False
            found = raw.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            skipped += found - at
            at = found
            continue
        if h.protected:
            checked += 1
            failed += checksum(raw, at, h) != int.from_bytes(raw[at + 4 : at + 6], "big")
        if not offsets and vbr is None and (vbr := _vbr(raw, at, h)) is not None:
            pass
        else:
            offsets.append(at)
            headers.append(h)
        at, locked = nxt, nxt == end or header(raw[nxt : nxt + 4]) is not None
    return Stream(tags, vbr, offsets, headers, skipped, checked, failed)


def unwrap(raw: bytes, stream: Stream | None = None) -> bytes:
    """The bytes that wrap() stored; an error where the stream doesn't hold them whole."""
    s = stream or scan(raw)
    size = int(s.tags["payload_bytes"])
    if s.failed or s.skipped:
        raise ValueError("the stream is damaged")
    out = b"".join([raw[a + 4 + 2 * h.protected + h.side : a + h.length] for a, h in zip(s.offsets, s.headers, strict=True)])
    if len(out) < size:
        raise ValueError("the stream is cut short")
    out = out[:size]
    if hashlib.sha256(out).hexdigest() != s.tags["payload_sha256"]:
        raise ValueError("the payload isn't the one that was stored")
    return out
