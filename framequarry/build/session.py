"""TCP sessions that number themselves, and the shell's language for composing packets."""

from __future__ import annotations

import ast
import random
import re
from dataclasses import dataclass, field

from framequarry.build import packets as P
from framequarry.dissect.language import Registry, show


@dataclass
class TcpSession:
    """Frames of one connection with sequence and acknowledgement numbers kept."""

    client: str
    server: str
    sport: int
    dport: int
    client_seq: int = 1000
    server_seq: int = 5000
    mss: int = 1460

    def frame(self, up: bool, flags: str, data: bytes = b"") -> bytes:
        a, b = (self.client, self.server) if up else (self.server, self.client)
        ports = (self.sport, self.dport) if up else (self.dport, self.sport)
        seq, ack = (self.client_seq, self.server_seq) if up else (self.server_seq, self.client_seq)
        f = P.tcp_frame(a, b, *ports, data, seq=seq, ack=ack if "A" in flags else 0, flags=flags)
        step = len(data) + ("S" in flags) + ("F" in flags)
        if up:
            self.client_seq = (self.client_seq + step) % (1 << 32)
        else:
            self.server_seq = (self.server_seq + step) % (1 << 32)
        return f

    def syn(self) -> bytes:
        return self.frame(True, "S")

    def syn_ack(self) -> bytes:
        return self.frame(False, "SA")

    def ack(self, up: bool = True) -> bytes:
        return self.frame(up, "A")

    def handshake(self) -> list[bytes]:
        return [self.syn(), self.syn_ack(), self.ack()]

    def send(self, data: bytes, up: bool = True) -> list[bytes]:
        """Segments of at most mss bytes and the other side's acknowledgement."""
        return [*(self.frame(up, "PA", s) for s in P.mss_segments(data, self.mss)), self.ack(not up)]

    def client_fin(self) -> bytes:
        return self.frame(True, "FA")

    def server_fin_ack(self) -> bytes:
        return self.frame(False, "FA")

    def close(self) -> list[bytes]:
        return [self.client_fin(), self.server_fin_ack(), self.ack()]


class ShellError(ValueError):
    """A script line that does not follow the language."""


@dataclass
class Layer:
    kind: str
    values: dict = field(default_factory=dict)


class Packet:
    """Layers put on each other with `/`."""

    def __init__(self, layers: list[Layer]):
        self.layers = layers

    def __truediv__(self, other: Packet) -> Packet:
        return Packet([*self.layers, *other.layers])

    def one(self, kind: str) -> dict | None:
        return next((x.values for x in self.layers if x.kind == kind), None)

    def build(self) -> bytes:
        """Raw data innermost, in a TLS record if there is one, then transport, network and link; no Ether: from the IP header."""
        body = b"".join(x.values["load"] for x in self.layers if x.kind in ("Raw", "DNS"))
        if (t := self.one("TLS")) is not None:
            body = P.tls_record(t.get("type", 23), body, t.get("version", 0x0303))
        ip = self.one("IP") or {}
        src, dst = ip.get("src", "127.0.0.1"), ip.get("dst", "127.0.0.1")
        proto = ip.get("proto", 0)
        if (t := self.one("TCP")) is not None:
            proto, body = 6, P.tcp(body, src, dst, t.get("sport", 20), t.get("dport", 80), t.get("seq", 0), t.get("ack", 0), t.get("flags", "S"), t.get("window", 8192), bytes(t.get("options", b"")))
        elif (u := self.one("UDP")) is not None:
            proto, body = 17, P.udp(body, src, dst, u.get("sport", 53), u.get("dport", 53))
        elif (i := self.one("ICMP")) is not None:
            proto, body = 1, P.icmp(i.get("type", 8), i.get("code", 0), i.get("id", 1), i.get("seq", 1), body)
        if self.one("IP") is not None:
            body = P.ipv4(body, src, dst, proto, ip.get("ttl", 64), ip.get("id", 1))
        if (e := self.one("Ether")) is not None:
            body = P.ethernet(body, e.get("src", "02:00:00:00:00:02"), e.get("dst", "02:00:00:00:00:01"), e.get("type", 0x0800), e.get("vlan"))
        return body

    def show(self) -> str:
        return "\n".join(f"###[ {x.kind} ]###" + "".join(f"\n  {k} = {v}" for k, v in x.values.items()) for x in self.layers)


_LAYERS = ("Ether", "IP", "TCP", "UDP", "ICMP", "TLS", "Raw")


class Shell:
    """Runs scripts: $x = Ether()/IP(dst="10.0.0.1")/TCP(dport=80), for $i in range(3) { ... }, protocol ... end, functions.

    Expressions are Python's, with $names for variables and layers stacked by `/`; only the names given here exist.
    packets gathers what send() and wrpcap() were given, lines what print() and show() have written.
    """

    def __init__(self, registry: Registry | None = None, seed: int | None = None):
        self.registry = registry or Registry()
        self.vars: dict[str, object] = {}
        self.packets: list[bytes] = []
        self.lines: list[str] = []
        self.random = random.Random(seed)
        self.names = {n: self._layer(n) for n in _LAYERS} | {
            "range": self._range,
            "send": self._send,
            "raw": lambda p: self._bytes(p),
            "hexdump": lambda p: self._say(P.hexdump(self._bytes(p))),
            "show": self._show,
            "print": lambda *a: self._say(" ".join(map(str, a))),
            "fromhex": bytes.fromhex,
            "len": len,
            "RandShort": lambda: self.random.randrange(1 << 16),
            "DNS": self._dns,
            "DNSQR": lambda qname="", qtype=1, qclass=1: ("q", qname, qtype, qclass),
            "DNSRR": lambda rrname="", rdata="", type=1, ttl=60, rclass=1: ("r", rrname, rdata, type, ttl, rclass),
            "TCPSession": lambda src, dst, sport=40000, dport=80: TcpSession(src, dst, sport, dport),
            "TLS_client_hello": P.tls_client_hello,
            "TLS_server_hello": P.tls_server_hello,
            "TLS_certificate": P.tls_certificate,
            "TLS_change_cipher_spec": P.tls_change_cipher_spec,
            "TLS_finished": P.tls_finished,
            "TLS_application_data": P.tls_application_data,
            "SSH_kexinit": P.ssh_kexinit,
            "SSH_newkeys": P.ssh_newkeys,
        }

    # -- functions

    def _layer(self, kind: str):
        def make(*args, **values) -> Packet:
            if args:
                values["load"] = args[0]
            if kind == "Raw":
                load = values.get("load", b"")
                values["load"] = load.encode() if isinstance(load, str) else bytes(load)
            return Packet([Layer(kind, values)])

        return make

    @staticmethod
    def _range(*args: int):
        """One argument counts from 1 and includes it; two and three are half open."""
        return range(1, args[0] + 1) if len(args) == 1 else range(*args)

    def _bytes(self, p) -> bytes:
        return p.build() if isinstance(p, Packet) else p.encode() if isinstance(p, str) else bytes(p)

    def _send(self, *items) -> None:
        for p in items:
            self.packets += [self._bytes(x) for x in p] if isinstance(p, list) else [self._bytes(p)]

    def _say(self, text: str) -> str:
        self.lines.append(text)
        return text

    def _show(self, p, data=None) -> str:
        return self._say(show(self.registry, p, self._bytes(data)) if data is not None else p.show() if isinstance(p, Packet) else repr(p))

    def _dns(self, id: int = 0, qr: int = 0, rcode: int = 0, rd: int = 1, flags: int | None = None, qd=None, an=None) -> Packet:
        kinds = {"A": 1, "NS": 2, "CNAME": 5, "PTR": 12, "MX": 15, "TXT": 16, "AAAA": 28}
        qs, rs = ([x] if isinstance(x, tuple) else list(x or []) for x in (qd, an))
        word = flags if flags is not None else qr << 15 | rd << 8 | rcode
        out = id.to_bytes(2, "big") + word.to_bytes(2, "big") + len(qs).to_bytes(2, "big") + len(rs).to_bytes(2, "big") + b"\0\0\0\0"
        for _, name, kind, cls in qs:
            out += P.dns_question(name, kinds.get(kind, kind), cls)
        for _, name, data, kind, ttl, cls in rs:
            kind = kinds.get(kind, kind)
            raw = P.ip(data) if kind == 1 else P.dns_name(data) if kind in (2, 5, 12) else data.encode() if isinstance(data, str) else data
            out += P.dns_record(name, raw, kind, ttl, cls)
        return Packet([Layer("DNS", {"load": out})])

    # -- the language

    def run(self, text: str) -> Shell:
        lines = [x.rstrip() for x in text.splitlines()]
        self._block(lines, 0, len(lines))
        return self

    def _block(self, lines: list[str], i: int, end: int) -> None:
        while i < end:
            s = lines[i].strip()
            i += 1
            if not s or s.startswith("#"):
                continue
            if re.match(r"protocol\s+\w+$|Object<", s):
                stop = next((j for j in range(i, end) if lines[j].strip() == "end"), None)
                if stop is None:
                    raise ShellError("protocol without end")
                self.registry.load("\n".join(lines[i - 1 : stop]))
                i = stop + 1
            elif m := re.match(r"for\s+\$(\w+)\s+in\s+(.+?)\s*(?:\{|:)$", s):
                depth, stop = 1, i
                while stop < end and depth:
                    t = lines[stop].strip()
                    depth += bool(re.match(r"for\s.*[{:]$", t)) - (t in ("}", "endfor"))
                    stop += 1
                if depth:
                    raise ShellError("for without its end")
                for v in self.value(m[2]):
                    self.vars[m[1]] = v
                    self._block(lines, i, stop - 1)
                i = stop
            elif m := re.match(r"\$(\w+)\s*=(?!=)\s*(.+)$", s):
                self.vars[m[1]] = self.value(m[2])
            else:
                self.value(s)

    def value(self, expr: str):
        names: dict[str, object] = dict(self.names)

        def var(m: re.Match) -> str:
            if m[1] not in self.vars:
                raise ShellError(f"${m[1]} is not set")
            names[f"v_{m[1]}"] = self.vars[m[1]]
            return f"v_{m[1]}"

        try:
            tree = ast.parse(re.sub(r"\$(\w+)", var, expr), mode="eval")
        except SyntaxError as e:
            raise ShellError(f"{expr!r}: {e.msg}") from None
        return self._eval(tree.body, names)

    def _eval(self, n: ast.AST, names: dict):
        ev = lambda x: self._eval(x, names)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise ShellError(f"unknown name {n.id}")
            return names[n.id]
        if isinstance(n, ast.BinOp):
            a, b = ev(n.left), ev(n.right)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b if isinstance(a, Packet) else a // b}
            if type(n.op) in ops:
                return ops[type(n.op)]()
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -ev(n.operand)
        if isinstance(n, (ast.List, ast.Tuple)):
            return [ev(x) for x in n.elts]
        if isinstance(n, ast.Call):
            f = ev(n.func)
            return f(*(ev(a) for a in n.args), **{k.arg: ev(k.value) for k in n.keywords})
        if isinstance(n, ast.Attribute) and not n.attr.startswith("_"):
            target = ev(n.value)
            if isinstance(target, TcpSession):
                return getattr(target, n.attr)
        raise ShellError(f"{ast.unparse(n)!r} is not part of the language")
