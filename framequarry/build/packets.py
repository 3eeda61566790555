"""Packet builders: bytes of frames and application messages, with correct checksums."""

from __future__ import annotations

import os
import struct

TCP_FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "E": 64, "C": 128}


def checksum(b: bytes) -> int:
    """RFC 1071."""
    b += b"\0" * (len(b) % 2)
    s = sum(struct.unpack(f">{len(b) // 2}H", b))
    while s >> 16:
        s = (s & 0xFFFF) + (s >> 16)
    return ~s & 0xFFFF


def ip(s: str | int | bytes) -> bytes:
    if isinstance(s, bytes):
        return s
    return s.to_bytes(4, "big") if isinstance(s, int) else bytes(int(p) for p in s.split("."))


def mac(s: str | bytes) -> bytes:
    return s if isinstance(s, bytes) else bytes(int(p, 16) for p in s.split(":"))


def ethernet(payload: bytes, src: str | bytes = "02:00:00:00:00:02", dst: str | bytes = "02:00:00:00:00:01", kind: int = 0x0800, vlan: int | None = None) -> bytes:
    tag = struct.pack(">HH", 0x8100, vlan) if vlan is not None else b""
    return mac(dst) + mac(src) + tag + struct.pack(">H", kind) + payload


def ipv4(payload: bytes, src: str | int, dst: str | int, proto: int, ttl: int = 64, ident: int = 1, flags: int = 0, offset: int = 0, tos: int = 0) -> bytes:
    """flags: 1 more fragments, 2 do not fragment; offset in bytes."""
    head = struct.pack(">BBHHHBBH", 0x45, tos, 20 + len(payload), ident & 0xFFFF, flags << 13 | offset // 8, ttl, proto, 0) + ip(src) + ip(dst)
    return head[:10] + struct.pack(">H", checksum(head)) + head[12:] + payload


def ipv6(payload: bytes, src: bytes, dst: bytes, proto: int, hops: int = 64) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, hops) + src + dst + payload


def _pseudo(src: bytes, dst: bytes, proto: int, size: int) -> bytes:
    return src + dst + struct.pack(">HH", proto, size) if len(src) == 4 else src + dst + struct.pack(">II", size, proto)


def tcp(payload: bytes, src: str | int | bytes, dst: str | int | bytes, sport: int, dport: int, seq: int = 0, ack: int = 0, flags: int | str = "A", win: int = 65535, options: bytes = b"") -> bytes:
    if isinstance(flags, str):
        flags = sum(TCP_FLAGS[c] for c in flags)
    options += b"\0" * (-len(options) % 4)
    head = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, ack & 0xFFFFFFFF, (20 + len(options)) // 4 << 4, flags, win, 0, 0) + options
    whole = head + payload
    c = checksum(_pseudo(ip(src), ip(dst), 6, len(whole)) + whole)
    return whole[:16] + struct.pack(">H", c) + whole[18:]


def udp(payload: bytes, src: str | int | bytes, dst: str | int | bytes, sport: int, dport: int) -> bytes:
    whole = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    c = checksum(_pseudo(ip(src), ip(dst), 17, len(whole)) + whole) or 0xFFFF
    return whole[:6] + struct.pack(">H", c) + whole[8:]


def icmp(kind: int = 8, code: int = 0, ident: int = 1, seq: int = 1, payload: bytes = b"") -> bytes:
    whole = struct.pack(">BBHHH", kind, code, 0, ident, seq) + payload
    return whole[:2] + struct.pack(">H", checksum(whole)) + whole[4:]


def tcp_frame(src: str, dst: str, sport: int, dport: int, payload: bytes = b"", **k) -> bytes:
    return ethernet(ipv4(tcp(payload, src, dst, sport, dport, **k), src, dst, 6))


def udp_frame(src: str, dst: str, sport: int, dport: int, payload: bytes = b"") -> bytes:
    return ethernet(ipv4(udp(payload, src, dst, sport, dport), src, dst, 17))


def icmp_frame(src: str, dst: str, **k) -> bytes:
    return ethernet(ipv4(icmp(**k), src, dst, 1))


def arp_frame(src_mac: str, src: str, dst: str, op: int = 1, dst_mac: str = "00:00:00:00:00:00") -> bytes:
    body = struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + mac(src_mac) + ip(src) + mac(dst_mac) + ip(dst)
    return ethernet(body, src_mac, "ff:ff:ff:ff:ff:ff" if op == 1 else dst_mac, 0x0806)


def mss_segments(payload: bytes, mss: int = 1460) -> list[bytes]:
    return [payload[i : i + mss] for i in range(0, len(payload), mss)] or [b""]


# ---- DNS, DHCP, NTP -------------------------------------------------------------------------------------


def dns_name(name: str) -> bytes:
    return b"".join(bytes([len(p)]) + p.encode() for p in name.split(".") if p) + b"\0"


def dns_question(name: str, kind: int = 1, cls: int = 1) -> bytes:
    return dns_name(name) + struct.pack(">HH", kind, cls)


def dns_record(name: str, data: bytes, kind: int = 1, ttl: int = 60, cls: int = 1) -> bytes:
    return dns_name(name) + struct.pack(">HHIH", kind, cls, ttl, len(data)) + data


def dns_query(name: str, ident: int = 1, kind: int = 1) -> bytes:
    return struct.pack(">HHHHHH", ident, 0x0100, 1, 0, 0, 0) + dns_question(name, kind)


def dns_response(name: str, address: str, ident: int = 1, rcode: int = 0, ttl: int = 60) -> bytes:
    answers = 0 if rcode else 1
    return struct.pack(">HHHHHH", ident, 0x8180 | rcode, 1, answers, 0, 0) + dns_question(name) + (dns_record(name, ip(address), 1, ttl) if answers else b"")


def dhcp(kind: int, xid: int, client: str, yours: str = "0.0.0.0", server: str = "0.0.0.0", options: list[tuple[int, bytes]] | None = None) -> bytes:
    """kind: 1 discover, 2 offer, 3 request, 5 ack."""
    op = 2 if kind in (2, 5, 6) else 1
    head = struct.pack(">BBBBIHH", op, 1, 6, 0, xid, 0, 0x8000) + ip("0.0.0.0") + ip(yours) + ip(server) + ip("0.0.0.0") + mac(client) + b"\0" * (10 + 64 + 128)
    opts = [(53, bytes([kind])), *(options or [])]
    return head + b"\x63\x82\x53\x63" + b"".join(bytes([c, len(v)]) + v for c, v in opts) + b"\xff"


def dhcp_discover(xid: int, client: str) -> bytes:
    return dhcp(1, xid, client, options=[(55, bytes([1, 3, 6, 15]))])


def dhcp_offer(xid: int, client: str, yours: str, server: str, lease: int = 86400) -> bytes:
    return dhcp(2, xid, client, yours, server, [(54, ip(server)), (51, struct.pack(">I", lease)), (1, ip("255.255.255.0"))])


def ntp(mode: int = 3, seconds: float = 0.0, stratum: int = 0) -> bytes:
    whole = int((seconds + 2208988800) * (1 << 32)) if seconds else 0
    return struct.pack(">BBBb", 0x20 | mode, stratum, 6, -20) + b"\0" * 36 + struct.pack(">Q", whole)


# ---- TLS, SSH, HTTP/2 -----------------------------------------------------------------------------------


def tls_record(kind: int, data: bytes, version: int = 0x0303) -> bytes:
    return struct.pack(">BHH", kind, version, len(data)) + data


def _handshake(kind: int, body: bytes) -> bytes:
    return tls_record(22, bytes([kind]) + len(body).to_bytes(3, "big") + body)


def tls_client_hello(server_name: str = "", random: bytes | None = None, ciphers: tuple[int, ...] = (0x1301, 0x1302, 0xC02F)) -> bytes:
    ext = b""
    if server_name:
        n = server_name.encode()
        sni = struct.pack(">HBH", len(n) + 3, 0, len(n)) + n
        ext = struct.pack(">HH", 0, len(sni)) + sni
    suites = b"".join(struct.pack(">H", c) for c in ciphers)
    return _handshake(1, struct.pack(">H", 0x0303) + (random or os.urandom(32)) + b"\0" + struct.pack(">H", len(suites)) + suites + b"\x01\x00" + struct.pack(">H", len(ext)) + ext)


def tls_server_hello(random: bytes | None = None, cipher: int = 0xC02F) -> bytes:
    return _handshake(2, struct.pack(">H", 0x0303) + (random or os.urandom(32)) + b"\0" + struct.pack(">HB", cipher, 0))


def tls_certificate(der: bytes) -> bytes:
    one = len(der).to_bytes(3, "big") + der
    return _handshake(11, len(one).to_bytes(3, "big") + one)


def tls_change_cipher_spec() -> bytes:
    return tls_record(20, b"\x01")


def tls_finished(verify: bytes = b"\0" * 12) -> bytes:
    return _handshake(20, verify)


def tls_application_data(data: bytes) -> bytes:
    return tls_record(23, data)


def tls_stream(data: bytes, most: int = 16384) -> bytes:
    return b"".join(tls_application_data(data[i : i + most]) for i in range(0, len(data), most))


def ssh_packet(kind: int, body: bytes) -> bytes:
    pad = 8 - (6 + len(body)) % 8
    pad += 8 if pad < 4 else 0
    return struct.pack(">IBB", len(body) + pad + 2, pad, kind) + body + b"\0" * pad


def ssh_kexinit(algorithms: tuple[str, ...] = ("curve25519-sha256", "ssh-ed25519", "aes128-ctr", "aes128-ctr", "hmac-sha2-256", "hmac-sha2-256", "none", "none", "", ""), cookie: bytes = b"\0" * 16) -> bytes:
    lists = b"".join(struct.pack(">I", len(a)) + a.encode() for a in algorithms)
    return ssh_packet(20, cookie + lists + b"\0" + b"\0\0\0\0")


def ssh_newkeys() -> bytes:
    return ssh_packet(21, b"")


HTTP2_PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"


def http2_frame(kind: int, flags: int, stream: int, body: bytes) -> bytes:
    return len(body).to_bytes(3, "big") + struct.pack(">BBI", kind, flags, stream) + body


def http2_settings(values: dict[int, int] | None = None) -> bytes:
    return http2_frame(4, 0, 0, b"".join(struct.pack(">HI", k, v) for k, v in (values or {}).items()))


def hpack_literal(headers: list[tuple[str, str]]) -> bytes:
    """Literal headers without indexing, lengths below 127."""
    return b"".join(b"\0" + bytes([len(k)]) + k.encode() + bytes([len(v)]) + v.encode() for k, v in headers)


def http2_headers(stream: int, headers: list[tuple[str, str]], end: bool = True) -> bytes:
    return http2_frame(1, 4 | int(end), stream, hpack_literal(headers))


def http2_data(stream: int, data: bytes, end: bool = True) -> bytes:
    return http2_frame(0, int(end), stream, data)


# ---- RDP and ASN.1 --------------------------------------------------------------------------------------


def tpkt(data: bytes) -> bytes:
    return struct.pack(">BBH", 3, 0, 4 + len(data)) + data


def rdp_connection_request(cookie: str = "user", protocols: int = 1) -> bytes:
    body = f"Cookie: mstshash={cookie}\r\n".encode() + struct.pack("<BBHI", 1, 0, 8, protocols)
    return tpkt(bytes([6 + len(body), 0xE0]) + b"\0\0\0\0\0" + body)


def rdp_connection_confirm(protocol: int = 1) -> bytes:
    body = struct.pack("<BBHI", 2, 0, 8, protocol)
    return tpkt(bytes([6 + len(body), 0xD0]) + b"\0\0\x12\x34\0" + body)


def rdp_data(body: bytes) -> bytes:
    return tpkt(b"\x02\xf0\x80" + body)


def rdp_key(code: int, down: bool = True) -> bytes:
    return rdp_data(struct.pack("<HHHHH", 4, 0 if down else 0x8000, code, 0, 0))


def rdp_mouse(x: int, y: int, flags: int = 0x0800) -> bytes:
    return rdp_data(struct.pack("<HHHHH", 0x8001, flags, x, y, 0))


def rdp_session(client: str, server: str, steps: list[tuple[bool, bytes]], sport: int = 50000, dport: int = 3389) -> list[bytes]:
    """Frames of a session: handshake, the steps (from the client?, message), the end."""
    from framequarry.build.session import TcpSession

    s = TcpSession(client, server, sport, dport)
    return [*s.handshake(), *(f for up, m in steps for f in s.send(m, up)), *s.close()]


def ber_length(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    b = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(b)]) + b


def ber(tag: int, data: bytes) -> bytes:
    return bytes([tag]) + ber_length(len(data)) + data


def ber_integer(v: int, tag: int = 2) -> bytes:
    return ber(tag, v.to_bytes(v.bit_length() // 8 + 1, "big", signed=True))


def ber_boolean(v: bool) -> bytes:
    return ber(1, b"\xff" if v else b"\0")


def ber_octets(v: bytes) -> bytes:
    return ber(4, v)


def ber_sequence(*parts: bytes) -> bytes:
    return ber(0x30, b"".join(parts))


def ber_context(n: int, data: bytes, constructed: bool = True) -> bytes:
    return ber(0x80 | 0x20 * constructed | n, data)


def hexdump(data: bytes) -> str:
    out = []
    for i in range(0, len(data), 16):
        row = data[i : i + 16]
        out.append(f"{i:04x}  {row.hex(' '):<47}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}")
    return "\n".join(out)
