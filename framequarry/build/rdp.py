"""Messages of remote desktop sessions (MS-RDPBCGR over T.125, T.124 and X.224), and whole sessions made of them.

Sessions are lists of steps (from the client?, message); packets.rdp_session() makes frames of them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from framequarry.build import packets as P

#: The first MCS user id, to which others are relative, and the I/O channel (fixed values of T.125 and MS-RDPBCGR).
FIRST_USER, IO_CHANNEL = 1001, 1003
#: Kinds of share-control and share-data messages, and of input events (fixed values of MS-RDPBCGR).
DEMAND_ACTIVE, CONFIRM_ACTIVE, DATA = 0x11, 0x13, 0x17
CONTROL, INPUT, SYNCHRONIZE, SHUTDOWN_REQUEST, FONT_LIST, FONT_MAP = 0x14, 0x1C, 0x1F, 0x24, 0x27, 0x28
SCANCODE, MOUSE = 4, 0x8001


@dataclass
class Desktop:
    """What both ends agree on."""

    user: str = "user"
    password: str = ""
    domain: str = ""
    client_name: str = "CLIENT"
    width: int = 1024
    height: int = 768
    protocol: int = 1
    user_id: int = 1007
    share_id: int = 0x000103EA
    channels: list[str] = field(default_factory=lambda: ["cliprdr", "rdpdr"])


def _utf16(s: str, size: int | None = None) -> bytes:
    """Text as UTF-16, padded or cut to size bytes with a closing zero."""
    b = s.encode("utf-16-le")
    return b if size is None else b[: size - 2].ljust(size, b"\0")


def _per_length(n: int) -> bytes:
    return bytes([n]) if n < 128 else struct.pack(">H", 0x8000 | n)


def _block(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, 4 + len(body)) + body


# ---- connecting -----------------------------------------------------------------------------------------


def client_blocks(d: Desktop) -> bytes:
    """The client's core, cluster, security and network data."""
    core = struct.pack("<IHHHHII", 0x00080004, d.width, d.height, 0xCA01, 0xAA03, 0x0409, 2600) + _utf16(d.client_name, 32)
    core += struct.pack("<III", 4, 0, 12) + bytes(64) + struct.pack("<HHIHHH", 0xCA01, 1, 0, 24, 7, 1) + bytes(64) + struct.pack("<BBI", 0, 0, d.protocol)
    names = b"".join(c.encode()[:7].ljust(8, b"\0") + struct.pack("<I", 0xC0000000) for c in d.channels)
    return _block(0xC001, core) + _block(0xC004, struct.pack("<II", 0x0D, 0)) + _block(0xC002, struct.pack("<II", 0, 0)) + _block(0xC003, struct.pack("<I", len(d.channels)) + names)


def server_blocks(d: Desktop) -> bytes:
    ids = struct.pack(f"<HH{len(d.channels)}H", IO_CHANNEL, len(d.channels), *(IO_CHANNEL + 1 + i for i in range(len(d.channels))))
    return _block(0x0C01, struct.pack("<II", 0x00080004, d.protocol)) + _block(0x0C03, ids + bytes(len(ids) % 4)) + _block(0x0C02, struct.pack("<II", 0, 0))


def _conference(head: bytes, user_data: bytes) -> bytes:
    """A T.124 conference message with user data, in aligned PER."""
    body = head + _per_length(len(user_data)) + user_data
    return bytes.fromhex("000500147c0001") + _per_length(len(body)) + body


def conference_request(user_data: bytes) -> bytes:
    return _conference(bytes.fromhex("000800100001c000") + b"Duca", user_data)


def conference_response(user_data: bytes) -> bytes:
    return _conference(bytes.fromhex("14760a01010001c000") + b"McDn", user_data)


def _domain(channels: int, users: int, tokens: int, size: int) -> bytes:
    return P.ber_sequence(*(P.ber_integer(v) for v in (channels, users, tokens, 1, 0, 1, size, 2)))


def mcs_connect_initial(d: Desktop) -> bytes:
    one = P.ber_octets(b"\1")
    body = one + one + P.ber_boolean(True) + _domain(34, 2, 0, 65535) + _domain(1, 1, 1, 1056) + _domain(65535, 64535, 65535, 65535) + P.ber_octets(conference_request(client_blocks(d)))
    return P.rdp_data(b"\x7f\x65" + P.ber_length(len(body)) + body)


def mcs_connect_response(d: Desktop) -> bytes:
    body = P.ber(10, b"\0") + P.ber_integer(0) + _domain(34, 3, 0, 65528) + P.ber_octets(conference_response(server_blocks(d)))
    return P.rdp_data(b"\x7f\x66" + P.ber_length(len(body)) + body)


def erect_domain() -> bytes:
    return P.rdp_data(bytes([1 << 2]) + b"\1\0\1\0")


def attach_user_request() -> bytes:
    return P.rdp_data(bytes([10 << 2]))


def attach_user_confirm(d: Desktop) -> bytes:
    return P.rdp_data(bytes([11 << 2 | 2, 0]) + struct.pack(">H", d.user_id - FIRST_USER))


def channel_join_request(d: Desktop, channel: int) -> bytes:
    return P.rdp_data(bytes([14 << 2]) + struct.pack(">HH", d.user_id - FIRST_USER, channel))


def channel_join_confirm(d: Desktop, channel: int) -> bytes:
    return P.rdp_data(bytes([15 << 2 | 2, 0]) + struct.pack(">HHH", d.user_id - FIRST_USER, channel, channel))


def disconnect() -> bytes:
    """Disconnect provider ultimatum, at the user's request."""
    return P.rdp_data(b"\x21\x80")


# ---- data ----------------------------------------------------------------------------------------------


def send_data(d: Desktop, body: bytes, up: bool, channel: int = IO_CHANNEL) -> bytes:
    head = bytes([(25 if up else 26) << 2]) + struct.pack(">HH", (d.user_id if up else 1002) - FIRST_USER, channel)
    return P.rdp_data(head + b"\x70" + _per_length(len(body)) + body)


def share_control(d: Desktop, kind: int, body: bytes, up: bool) -> bytes:
    return send_data(d, struct.pack("<HHH", 6 + len(body), kind, d.user_id if up else 1002) + body, up)


def share_data(d: Desktop, kind: int, body: bytes, up: bool) -> bytes:
    return share_control(d, DATA, struct.pack("<IBBHBBH", d.share_id, 0, 1, 4 + len(body), kind, 0, 0) + body, up)


def client_info(d: Desktop) -> bytes:
    texts = [_utf16(s) for s in (d.domain, d.user, d.password, "", "")]
    flags = 0x1 | 0x2 | 0x10 | 0x40 | (0x8 if d.password else 0)
    body = struct.pack("<HHII5H", 0x0040, 0, 0, flags, *map(len, texts)) + b"".join(t + b"\0\0" for t in texts)
    return send_data(d, body, True)


def capabilities(d: Desktop) -> bytes:
    """General, bitmap, pointer and input capabilities."""
    sets = [
        (1, struct.pack("<6HI2BH", 1, 3, 0x0200, 0, 0, 0x040D, 0, 0, 0, 0)),
        (2, struct.pack("<8H2B2H", 24, 1, 1, 1, d.width, d.height, 0, 1, 1, 0, 0, 1)),
        (8, struct.pack("<HHH", 1, 20, 20)),
        (13, struct.pack("<HHIIII", 0x0035, 0, 0x0409, 4, 0, 12) + bytes(64)),
    ]
    return struct.pack("<HH", len(sets), 0) + b"".join(_block(k, b) for k, b in sets)


def demand_active(d: Desktop) -> bytes:
    caps = capabilities(d)
    return share_control(d, DEMAND_ACTIVE, struct.pack("<IHH", d.share_id, 4, len(caps)) + b"RDP\0" + caps + bytes(4), False)


def confirm_active(d: Desktop) -> bytes:
    caps = capabilities(d)
    return share_control(d, CONFIRM_ACTIVE, struct.pack("<IHHH", d.share_id, 1002, 6, len(caps)) + b"MSTSC\0" + caps, True)


def synchronize(d: Desktop, up: bool) -> bytes:
    return share_data(d, SYNCHRONIZE, struct.pack("<HH", 1, 1002 if up else d.user_id), up)


def control(d: Desktop, action: int, up: bool) -> bytes:
    """action: 1 asks for control, 2 grants it, 4 is willing to share it."""
    return share_data(d, CONTROL, struct.pack("<HHI", action, d.user_id if action == 2 else 0, 1002 if action == 2 else 0), up)


def font_list(d: Desktop) -> bytes:
    return share_data(d, FONT_LIST, struct.pack("<HHHH", 0, 0, 3, 50), True)


def font_map(d: Desktop) -> bytes:
    return share_data(d, FONT_MAP, struct.pack("<HHHH", 0, 0, 3, 4), False)


def input_events(d: Desktop, events: list[tuple[int, int, int, int]], time: int = 0) -> bytes:
    """events: (kind, flags, key code or x, y)."""
    return share_data(d, INPUT, struct.pack("<HH", len(events), 0) + b"".join(struct.pack("<IHHHH", time, *e) for e in events), True)


def key(d: Desktop, code: int, down: bool = True) -> bytes:
    return input_events(d, [(SCANCODE, 0 if down else 0x8000, code, 0)])


def mouse(d: Desktop, x: int, y: int, flags: int = 0x0800) -> bytes:
    return input_events(d, [(MOUSE, flags, x, y)])


def clipboard(d: Desktop, kind: int, body: bytes, up: bool, ok: bool = True) -> bytes:
    """A message on the clipboard's channel: 2 offers formats, 4 asks for data, 5 gives it."""
    message = struct.pack("<HHI", kind, int(ok) if kind in (3, 5) else 0, len(body)) + body
    return send_data(d, struct.pack("<II", len(message), 3) + message, up, IO_CHANNEL + 1 + d.channels.index("cliprdr"))


# ---- sessions -------------------------------------------------------------------------------------------

Steps = list[tuple[bool, bytes]]
#: Scan codes of letters, digits and a few more keys, row by row of a US keyboard (fixed values).
_ROWS = {2: "1234567890", 16: "qwertyuiop", 30: "asdfghjkl", 44: "zxcvbnm"}
SCANCODES = {c: first + i for first, row in _ROWS.items() for i, c in enumerate(row)} | {"\n": 28, " ": 57, ",": 51, ".": 52, "-": 12}


def login(d: Desktop) -> Steps:
    """From the connection request to the font map, after which the desktop is there."""
    out: Steps = [(True, P.rdp_connection_request(d.user, d.protocol)), (False, P.rdp_connection_confirm(d.protocol)), (True, mcs_connect_initial(d)), (False, mcs_connect_response(d)), (True, erect_domain()), (True, attach_user_request()), (False, attach_user_confirm(d))]
    for channel in (d.user_id, IO_CHANNEL, *(IO_CHANNEL + 1 + i for i in range(len(d.channels)))):
        out += [(True, channel_join_request(d, channel)), (False, channel_join_confirm(d, channel))]
    out += [(True, client_info(d)), (False, demand_active(d)), (True, confirm_active(d)), (True, synchronize(d, True)), (True, control(d, 4, True)), (True, control(d, 1, True)), (True, font_list(d))]
    return [*out, (False, synchronize(d, False)), (False, control(d, 4, False)), (False, control(d, 2, False)), (False, font_map(d))]


def typing(d: Desktop, text: str) -> Steps:
    """A key down and up for each character that has a key; capitals hold shift."""
    out: Steps = []
    for c in text:
        code = SCANCODES.get(c.lower())
        if code is not None:
            shift = c.isupper()
            out += [(True, key(d, 42))] * shift + [(True, key(d, code)), (True, key(d, code, False))] + [(True, key(d, 42, False))] * shift
    return out


def pointing(d: Desktop, path: list[tuple[int, int]], click: bool = True) -> Steps:
    """Moves along a path, and a click with the left button at its end."""
    out: Steps = [(True, mouse(d, x, y)) for x, y in path]
    if click and path:
        out += [(True, mouse(d, *path[-1], 0x9000)), (True, mouse(d, *path[-1], 0x1000))]
    return out


def copying(d: Desktop, text: str, up: bool = True) -> Steps:
    """Text offered by one end (the client, if up), asked for by the other and given."""
    offer = struct.pack("<I", 13) + bytes(32)  # Unicode text under no name
    return [(up, clipboard(d, 2, offer, up)), (not up, clipboard(d, 3, b"", not up)), (not up, clipboard(d, 4, struct.pack("<I", 13), not up)), (up, clipboard(d, 5, _utf16(text) + b"\0\0", up))]


def logout(d: Desktop) -> Steps:
    return [(True, share_data(d, SHUTDOWN_REQUEST, b"", True)), (True, disconnect())]


def session(client: str, server: str, d: Desktop | None = None, text: str = "", path: list[tuple[int, int]] | None = None, copied: str = "", sport: int = 50000) -> list[bytes]:
    """Frames of a whole session: login, typing, pointing, copying, logout."""
    d = d or Desktop()
    steps = [*login(d), *typing(d, text), *pointing(d, path or []), *(copying(d, copied) if copied else []), *logout(d)]
    return P.rdp_session(client, server, steps, sport)
