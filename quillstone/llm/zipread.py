"""Reads ZIP archives by range: the end record, its ZIP64 counterpart and the central directory, then stored members in place."""

from __future__ import annotations

import struct
from typing import NamedTuple


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header_at: int


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """values: size, packed size, header offset; those at their limit stand in the ZIP64 field, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i] = struct.unpack_from("<Q", field, k)[0]
                    k += 8
            break
        at += 4 + n
    return values


def directory(source) -> dict[str, Member]:
    """The members of an archive. source has size() and read_at(n, offset)."""
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = source.read_at(size - tail_at, tail_at)
    at = len(tail) - 22
    while at >= 0:  # the comment may hold the signature: its length must reach the end exactly
        at = tail.rfind(b"PK\x05\x06", 0, at + 4)
        if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if (entries == 0xFFFF or 0xFFFFFFFF in (length, offset)) and end_at >= 20:
        locator = source.read_at(20, end_at - 20)
        if locator[:4] == b"PK\x06\x07":
            record = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = source.read_at(length, offset), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header_at = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header_at = _zip64(raw[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, header_at])
        out[name] = Member(name, method, full, packed, header_at)
        at += 46 + n_name + n_extra + n_comment
    return out


def place(source, member: Member) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes within the archive."""
    if member.method != 0:
        raise ValueError(f"{member.name} isn't stored")
    header = source.read_at(30, member.header_at)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + n_name + n_extra, member.size
