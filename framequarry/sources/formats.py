"""The wire formats of captures, as functions over bytes: classic and next-generation, reading and writing.

Format numbers are the public specification's. Reading honours each section's byte order, each interface's time
resolution and offset, and never looks past a block: what a damaged or cut-off file holds before the damage is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

SHB, IDB, PB, SPB, NRB, ISB, EPB, DSB, CB, CB_NOCOPY = 0x0A0D0D0A, 1, 2, 3, 4, 5, 6, 0x0A, 0xBAD, 0x40000BAD
BYTE_ORDER = 0x1A2B3C4D
#: Classic files: magic to (byte order, nanoseconds).
MAGICS = {b"\xa1\xb2\xc3\xd4": (">", False), b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\x3c\x4d": (">", True), b"\x4d\x3c\xb2\xa1": ("<", True)}
OPT_END, OPT_COMMENT, OPT_TSRESOL, OPT_TSOFFSET = 0, 1, 9, 14


@dataclass
class Block:
    number: int
    kind: int
    size: int
    body: bytes
    order: str
    section: int


@dataclass
class Interface:
    linktype: int
    snaplen: int
    ticks: int = 1_000_000
    offset: int = 0


@dataclass
class Packet:
    frame_no: int
    section: int
    interface_id: int
    linktype: int
    ts_ns: int
    caplen: int
    origlen: int
    frame: bytes
    comment: str | None = None
    custom: bool = False
    pen: int | None = None


def blocks(data: bytes) -> Iterator[Block]:
    """The blocks of a next-generation capture; ends quietly where a block does not fit."""
    at, number, order, section = 0, 0, "<", -1
    while at + 12 <= len(data):
        kind = struct.unpack_from("<I", data, at)[0]
        if kind == SHB:
            order = "<" if struct.unpack_from("<I", data, at + 8)[0] == BYTE_ORDER else ">"
            section += 1
        else:
            kind = struct.unpack_from(order + "I", data, at)[0]
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if size < 12 or size % 4 or at + size > len(data):
            return
        yield Block(number, kind, size, data[at + 8 : at + size - 4], order, section)
        at, number = at + size, number + 1


def options(body: bytes, order: str) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == OPT_END or at + 4 + size > len(body):
            break
        out.append((code, body[at + 4 : at + 4 + size]))
        at += 4 + size + -size % 4
    return out


def interface_of(b: Block) -> Interface:
    linktype, _, snaplen = struct.unpack_from(b.order + "HHI", b.body)
    i = Interface(linktype, snaplen)
    for code, v in options(b.body[8:], b.order):
        if code == OPT_TSRESOL and v:
            i.ticks = 1 << (v[0] & 0x7F) if v[0] & 0x80 else 10 ** v[0]
        elif code == OPT_TSOFFSET and len(v) == 8:
            i.offset = struct.unpack(b.order + "q", v)[0]
    return i


def _comment(body: bytes, order: str) -> str | None:
    return next((v.decode("utf-8", "replace") for c, v in options(body, order) if c == OPT_COMMENT), None)


def packet_of(b: Block, interfaces: list[Interface], number: int, compat: bool = False) -> Packet | None:
    """The packet that a block holds, as number `number`; None for other blocks."""
    if b.kind == EPB and len(b.body) >= 20:
        iface, hi, lo, cap, orig = struct.unpack_from(b.order + "IIIII", b.body)
        cap = min(cap, len(b.body) - 20)
        frame, rest = b.body[20 : 20 + cap], b.body[20 + cap + -cap % 4 :]
        comment = _comment(rest, b.order)
    elif b.kind == PB and len(b.body) >= 20:
        iface, _, hi, lo, cap, orig = struct.unpack_from(b.order + "HHIIII", b.body)
        cap = min(cap, len(b.body) - 20)
        frame, comment = b.body[20 : 20 + cap], _comment(b.body[20 + cap + -cap % 4 :], b.order)
    elif b.kind == SPB and len(b.body) >= 4:
        iface, hi, lo, comment = 0, 0, 0, None
        orig = struct.unpack_from(b.order + "I", b.body)[0]
        limit = interfaces[0].snaplen if interfaces and interfaces[0].snaplen else orig
        frame = b.body[4 : 4 + min(orig, limit, len(b.body) - 4)]
    elif b.kind in (CB, CB_NOCOPY) and len(b.body) >= 4:
        return Packet(number, b.section, 0, 0xFFFF, 0, len(b.body) - 4, len(b.body) - 4, b.body[4:], None, True, struct.unpack_from(b.order + "I", b.body)[0])
    else:
        return None
    i = interfaces[iface] if iface < len(interfaces) else Interface(1, 0)
    ticks = hi << 32 | lo
    per, add = (1_000_000, 0) if compat else (i.ticks, i.offset)
    return Packet(number, b.section, iface, i.linktype, ticks * 1_000_000_000 // per + add * 1_000_000_000 if ticks else 0, len(frame), orig, frame, comment)


def is_packet(kind: int, body: int) -> bool:
    """Whether a block of a type and of so many bytes of body holds a packet."""
    return kind in (EPB, PB) and body >= 20 or kind in (SPB, CB, CB_NOCOPY) and body >= 4


def packets(data: bytes, compat: bool = False) -> Iterator[Packet]:
    """The packets of either format, numbered from 1. With compat, every timestamp is read as microseconds."""
    if data[:4] in MAGICS:
        yield from _classic(data)
        return
    interfaces: list[Interface] = []
    section, number = -1, 0
    for b in blocks(data):
        if b.section != section:
            section, interfaces = b.section, []
        if b.kind == IDB and len(b.body) >= 8:
            interfaces.append(interface_of(b))
            continue
        p = packet_of(b, interfaces, number + 1, compat)
        if p is not None:
            number += 1
            yield p


def _classic(data: bytes) -> Iterator[Packet]:
    order, nano = MAGICS[data[:4]]
    if len(data) < 24:
        return
    linktype = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at, number = 24, 0
    while at + 16 <= len(data):
        sec, sub, cap, orig = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + cap > len(data):
            return
        number += 1
        yield Packet(number, 0, 0, linktype, sec * 1_000_000_000 + (sub if nano else sub * 1000), cap, orig, data[at + 16 : at + 16 + cap])
        at += 16 + cap


def hex_text(text: str) -> bytes:
    """The bytes of a hex dump: plain or spaced digits, or lines with an offset, digits and an ASCII column."""
    out = bytearray()
    for line in text.splitlines() or [text]:
        words = line.split()
        if words and len(words) > 1 and len(words[0].rstrip(":")) >= 4 and all(c in "0123456789abcdefABCDEF" for c in words[0].rstrip(":")) and all(len(w) == 2 for w in words[1:2]):
            words = words[1:17]
            line = line[line.index(words[0], 4) :][:48]
            words = line.split("  ")[0].split() if len(line.split("  ")[0].split()) >= 8 else line.split()
        for w in words:
            if len(w) % 2 or any(c not in "0123456789abcdefABCDEF" for c in w):
                break
            out += bytes.fromhex(w)
    return bytes(out)


# ---- writing --------------------------------------------------------------------------------------------


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def option_bytes(opts: list[tuple[int, bytes]]) -> bytes:
    """Options with their end mark, or nothing if there are none."""
    return b"".join(struct.pack("<HH", c, len(v)) + _pad(v) for c, v in opts) + (struct.pack("<HH", 0, 0) if opts else b"")


def block(kind: int, body: bytes) -> bytes:
    size = struct.pack("<I", 12 + len(body))
    return struct.pack("<I", kind) + size + body + size


def section_header(opts: list[tuple[int, bytes]] | None = None) -> bytes:
    return block(SHB, struct.pack("<IHHq", BYTE_ORDER, 1, 0, -1) + option_bytes(opts or []))


def interface_description(linktype: int = 1, snaplen: int = 0xFFFF, opts: list[tuple[int, bytes]] | None = None) -> bytes:
    return block(IDB, struct.pack("<HHI", linktype, 0, snaplen) + option_bytes(opts or []))


#: The option that says times are in nanoseconds.
NANOSECONDS = (OPT_TSRESOL, b"\x09")


def enhanced_packet(frame: bytes, ticks: int = 0, origlen: int | None = None, interface_id: int = 0, opts: list[tuple[int, bytes]] | None = None) -> bytes:
    head = struct.pack("<IIIII", interface_id, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame) if origlen is None else origlen)
    return block(EPB, head + _pad(frame) + option_bytes(opts or []))


def simple_packet(frame: bytes, origlen: int | None = None) -> bytes:
    return block(SPB, struct.pack("<I", len(frame) if origlen is None else origlen) + _pad(frame))


def name_resolution(names: list[tuple[bytes, list[str]]], opts: list[tuple[int, bytes]] | None = None) -> bytes:
    """Records of addresses (4 or 16 bytes) and their names."""
    out = b""
    for address, hosts in names:
        v = address + b"".join(h.encode() + b"\0" for h in hosts)
        out += struct.pack("<HH", 1 if len(address) == 4 else 2, len(v)) + _pad(v)
    return block(NRB, out + struct.pack("<HH", 0, 0) + option_bytes(opts or []))


def interface_statistics(interface_id: int, ticks: int, received: int | None = None, dropped: int | None = None) -> bytes:
    opts = [(c, struct.pack("<Q", v)) for c, v in ((4, received), (5, dropped)) if v is not None]
    return block(ISB, struct.pack("<III", interface_id, ticks >> 32, ticks & 0xFFFFFFFF) + option_bytes(opts))


def decryption_secrets(kind: int, secret: bytes) -> bytes:
    return block(DSB, struct.pack("<II", kind, len(secret)) + _pad(secret))


def custom_block(pen: int, data: bytes, copy: bool = True, opts: list[tuple[int, bytes]] | None = None) -> bytes:
    return block(CB if copy else CB_NOCOPY, struct.pack("<I", pen) + _pad(data) + option_bytes(opts or []))


@dataclass
class Writer:
    """Bytes of a next-generation capture, one interface for each link type that comes up; times in nanoseconds."""

    snaplen: int = 0xFFFF
    known: dict[tuple[int, int], int] = field(default_factory=dict)

    def start(self) -> bytes:
        return section_header()

    def packet(self, frame: bytes, linktype: int = 1, ts_ns: int = 0, origlen: int | None = None, comment: str | None = None, interface_id: int = 0) -> bytes:
        out = b""
        key = (interface_id, linktype)
        if key not in self.known:
            self.known[key] = len(self.known)
            out = interface_description(linktype, self.snaplen, [NANOSECONDS])
        opts = [(OPT_COMMENT, comment.encode())] if comment else []
        return out + enhanced_packet(frame, ts_ns, origlen, self.known[key], opts)
