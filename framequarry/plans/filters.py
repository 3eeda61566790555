"""Packet filters: text to a syntax tree, and the tree to a Spark column.

Two dialects share one tree. `display` filters speak about dissected fields, `capture` filters about raw layers
(slices as numbers, masks, len(), byte search, aliases with arguments). A filter becomes one boolean column that is never
null, so `not` is two-valued and Catalyst can push, reorder and fold it. Fields that may occur more than once
are true if any occurrence is, for `!=` too.

The binder says what a filter needs: header columns only, dissected fields, or TCP state; operators add no more
than that, and split conjunctions so that header conditions are applied before anything costly.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from framequarry.functions.bits import be, hex_number, ipv4_text, ipv6_text, mac_text


class FilterSyntaxError(ValueError):
    """The filter's text does not follow the grammar."""


# ---- the tree ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ref:
    """A field, with what is applied to it: a slice, a mask or a function."""

    name: str
    start: int | None = None
    length: int | None = None  # None with a start: to the end
    mask: int | None = None
    function: str | None = None


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class And:
    a: object
    b: object


@dataclass(frozen=True)
class Or:
    a: object
    b: object


@dataclass(frozen=True)
class Not:
    a: object


@dataclass(frozen=True)
class Exists:
    ref: Ref


@dataclass(frozen=True)
class Compare:
    ref: Ref
    op: str
    value: str
    symbol: bool = False  # the value is lookup(NAME)


# ---- text to tokens --------------------------------------------------------------------------------------

_SYMBOLS = ["&&", "||", "==", "!=", ">=", "<=", "!", ">", "<", "(", ")", "{", "}", "[", "]", ",", "&"]
_OPS = {"eq": "==", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<=", "contains": "contains", "matches": "matches"}
_WORD = re.compile(r"[A-Za-z0-9_.:/\-$*+%^~]+")
_FUNCTIONS = ("len", "upper", "lower", "lookup")


@dataclass
class Token:
    kind: str  # word, string, a symbol, or end
    text: str


def tokens(text: str, dialect: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if c == '"':
            end = text.find('"', i + 1)
            end = len(text) if end < 0 else end
            out.append(Token("string", text[i + 1 : end]))
            i = end + 1
            continue
        if m := _WORD.match(text, i):
            word, i = m[0], m.end()
            if dialect == "capture" and word in _FUNCTIONS and text[i : i + 1] == "(":
                end = text.find(")", i)
                end = len(text) if end < 0 else end
                out.append(Token("function", f"{word}:{text[i + 1 : end].strip()}"))
                i = end + 1
                continue
            out.append(Token("word", word))
            if text[i : i + 1] == "[":
                end = text.find("]", i)
                if end < 0:
                    raise FilterSyntaxError("expected ']'")
                out += [Token("[", "["), Token("slice", text[i + 1 : end].strip()), Token("]", "]")]
                i = end + 1
            continue
        for s in _SYMBOLS:
            if text.startswith(s, i):
                if s == "&" and dialect == "display":
                    raise FilterSyntaxError("a mask is not part of display filters")
                out.append(Token(s, s))
                i += len(s)
                break
        else:
            if dialect == "capture":
                raise FilterSyntaxError(f"unexpected character {c!r}")
            i += 1  # display filters pass over characters they do not know
    return [*out, Token("end", "")]


# ---- tokens to the tree -----------------------------------------------------------------------------------


@dataclass
class Aliases:
    """Names that stand for expressions or fields. Expressions may take words: $1, $2; `\\$` is a dollar sign."""

    expressions: dict[str, str] = field(default_factory=dict)
    fields: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Aliases:
        """Lines `name = expression` or `name = field, field`; `#` starts a comment line."""
        a = cls()
        for line in text.splitlines():
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                name, _, to = line.partition("=")
                a.add(name.strip(), to.strip())
        return a

    def add(self, name: str, to: str) -> None:
        parts = [p.strip() for p in to.split(",")]
        if all(re.fullmatch(r"[A-Za-z_][\w.]*", p) for p in parts) and (len(parts) > 1 or "." in parts[0]):
            self.fields[name] = parts
        else:
            self.expressions[name] = to

    def expand(self, text: str) -> str:
        """Replaces alias names outside strings, with the words that follow as arguments; up to 16 levels."""
        for _ in range(16):
            changed = False
            for name, to in self.expressions.items():
                n = max([int(x) for x in re.findall(r"(?<!\\)\$(\d)", to)], default=0)
                pattern = rf"(?<![\w.]){re.escape(name)}(?![\w.])" + r"\s+(\"[^\"]*\"|[^\s()]+)" * n
                parts = re.split(r'("[^"]*")', text) if not n else [text]
                for i, p in enumerate(parts):
                    if n or not p.startswith('"'):
                        new = re.sub(pattern, lambda m, to=to: f"({self._fill(to, m.groups())})", p)
                        changed |= new != p
                        parts[i] = new
                text = "".join(parts)
            if not changed:
                return text
        raise FilterSyntaxError("aliases refer to each other")

    @staticmethod
    def _fill(to: str, args: tuple) -> str:
        return re.sub(r"(?<!\\)\$(\d)", lambda m: args[int(m[1]) - 1], to).replace("\\$", "$")


class _Parser:
    def __init__(self, text: str, dialect: str, aliases: Aliases):
        self.t, self.i, self.dialect, self.aliases = tokens(text, dialect), 0, dialect, aliases

    @property
    def cur(self) -> Token:
        return self.t[self.i]

    def step(self) -> Token:
        t = self.cur
        self.i += t.kind != "end"
        return t

    def is_word(self, *names: str) -> bool:
        return self.cur.kind == "word" and (self.cur.text in names or self.dialect == "display" and self.cur.text.lower() in names and self.cur.text.isupper())

    def whole(self) -> object:
        if self.cur.kind == "end":
            return All()
        n = self.either()
        if self.cur.kind != "end":
            raise FilterSyntaxError(f"unexpected {self.cur.text!r}")
        return n

    def either(self) -> object:
        n = self.both()
        while self.cur.kind == "||" or self.is_word("or"):
            self.step()
            n = Or(n, self.both())
        return n

    def both(self) -> object:
        n = self.negated()
        while self.cur.kind == "&&" or self.is_word("and"):
            self.step()
            n = And(n, self.negated())
        return n

    def negated(self) -> object:
        if self.cur.kind == "!" or self.is_word("not"):
            self.step()
            return Not(self.negated())
        return self.primary()

    def primary(self) -> object:
        if self.cur.kind == "(":
            self.step()
            n = self.either()
            if self.cur.kind == ")":
                self.step()
            elif self.dialect == "display":
                raise FilterSyntaxError("expected ')'")
            return n
        ref = self.ref()
        if self.is_word("in"):
            self.step()
            return self.members(ref)
        op = self.cur.kind if self.cur.kind in ("==", "!=", ">", "<", ">=", "<=") else _OPS.get(self.cur.text) if self.cur.kind == "word" else None
        if op is None:
            return Exists(ref)
        self.step()
        v = self.step()
        if v.kind == "function" and v.text.startswith("lookup:"):
            return Compare(ref, op, v.text[7:], symbol=True)
        if v.kind not in ("word", "string"):
            raise FilterSyntaxError("expected a value after the operator")
        return Compare(ref, op, v.text)

    def ref(self) -> Ref:
        t = self.step()
        if t.kind == "function":
            name, _, inner = t.text.partition(":")
            r = Ref(inner, function=name)
        elif t.kind in ("word", "string") and (t.kind == "word" or self.dialect == "capture"):
            r = Ref(t.text)
        else:
            raise FilterSyntaxError("expected a field name")
        if self.cur.kind == "[":
            self.step()
            r = replace(r, **self.slice(self.step().text))
            self.step()
        if self.cur.kind == "&":
            self.step()
            r = replace(r, mask=_number(self.step().text))
        return r

    def slice(self, s: str) -> dict:
        """i, i:n, :n, i: and, in display filters, i-j."""
        if m := re.fullmatch(r"(-?\d+)?:(\d+)?", s):
            n = int(m[2]) if m[2] else None
            return {"start": int(m[1] or 0), "length": n}
        if (m := re.fullmatch(r"(\d+)-(\d+)", s)) and self.dialect == "display":
            return {"start": int(m[1]), "length": max(0, int(m[2]) - int(m[1]) + 1)}
        if re.fullmatch(r"-?\d+", s):
            return {"start": int(s), "length": 1}
        raise FilterSyntaxError("expected a slice like [0:4]")

    def members(self, ref: Ref) -> object:
        closing = {"{": "}", "(": ")"}.get(self.cur.kind)
        if closing:
            self.step()
        elif self.dialect == "display":
            raise FilterSyntaxError("expected '{' after in")
        out = None
        while self.cur.kind in ("word", "string"):
            v = self.step().text
            if ".." in v:
                lo, _, hi = v.partition("..")
                n = And(Compare(ref, ">=", lo), Compare(ref, "<=", hi))
            else:
                n = Compare(ref, "==", v)
            out = Or(out, n) if out else n
            if self.cur.kind == ",":
                self.step()
            if not closing:
                break
        if closing and self.cur.kind == closing:
            self.step()
        elif closing:
            raise FilterSyntaxError(f"expected {closing!r}")
        if out is None:
            raise FilterSyntaxError("empty set")
        return out


def parse(text: str, dialect: str = "display", aliases: Aliases | None = None) -> object:
    """The tree of a filter; blank text matches everything. Raises FilterSyntaxError."""
    aliases = aliases or Aliases()
    return _Parser(aliases.expand(text), dialect, aliases).whole()


# ---- fields ----------------------------------------------------------------------------------------------


def _number(s: str) -> int:
    """Decimal or 0x digits at the start, 0 without any; within 64 bits."""
    m = re.match(r"0[xX]([0-9a-fA-F]+)|(\d+)", s)
    return min((1 << 64) - 1, int(m[1], 16) if m and m[1] else int(m[2]) if m else 0)


@dataclass(frozen=True)
class Field:
    """What a name means: its type, its column, or the element of the dissected fields it is."""

    vtype: str  # uint, ipv4, ipv6, mac, str, bytes, none
    column: Column | None
    needs: str = "headers"


def _flag(bit: int) -> Column:
    return F.shiftright("tcp_flags", bit).bitwiseAND(F.lit(1))


def header_fields(dialect: str) -> dict[str, Field]:
    c = F.col
    v4, v6 = c("ip_v") == 4, c("ip_v") == 6
    only = lambda cond, x: F.when(cond, x)
    i4, i6 = only((c("l4_proto") == 1), c("icmp_type")), only((c("l4_proto") == 58), c("icmp_type"))
    f = {
        "frame.cap_len": ("uint", F.length("frame")),
        "frame.len": ("uint", c("origlen") if dialect == "display" else F.length("frame")),
        "frame.number": ("uint", c("frame_no")),
        "eth": ("none", c("eth_dst").isNotNull()),
        "eth.dst": ("mac", c("eth_dst")),
        "eth.src": ("mac", c("eth_src")),
        "eth.type": ("uint", only(c("eth_dst").isNotNull(), be("frame", 12, 2)) if dialect == "display" else only(c("eth_dst").isNotNull(), c("eth_type"))),
        "vlan": ("none", c("vlan_id").isNotNull()),
        "vlan.id": ("uint", c("vlan_id")),
        "ip": ("none", v4),
        "ip.version": ("uint", only(v4, c("ip_v"))),
        "ip.hdr_len": ("uint", only(v4, c("ip_ihl"))),
        "ip.dsfield": ("uint", c("ip_dsfield")),
        "ip.len": ("uint", only(v4, c("ip_len"))),
        "ip.id": ("uint", c("ip_id")),
        "ip.flags": ("uint", c("ip_flags")),
        "ip.frag_offset": ("uint", c("ip_frag")),
        "ip.ttl": ("uint", only(v4, c("ip_ttl"))),
        "ip.proto": ("uint", only(v4, c("ip_proto"))),
        "ip.checksum": ("uint", c("ip_checksum")),
        "ip.src": ("ipv4", only(v4, c("ip_src"))),
        "ip.dst": ("ipv4", only(v4, c("ip_dst"))),
        "ipv6": ("none", v6),
        "ipv6.src": ("ipv6", only(v6, c("ip_src"))),
        "ipv6.dst": ("ipv6", only(v6, c("ip_dst"))),
        "ipv6.plen": ("uint", only(v6, c("ip_len") - 40)),
        "ipv6.nxt": ("uint", only(v6, c("ip_proto"))),
        "ipv6.hlim": ("uint", only(v6, c("ip_ttl"))),
        "arp": ("none", c("arp_op").isNotNull()),
        "arp.opcode": ("uint", c("arp_op")),
        "arp.src.hw_mac": ("mac", c("arp_src_hw")),
        "arp.src.proto_ipv4": ("ipv4", c("arp_src_ip")),
        "arp.dst.hw_mac": ("mac", c("arp_dst_hw")),
        "arp.dst.proto_ipv4": ("ipv4", c("arp_dst_ip")),
        "tcp": ("none", c("tcp_seq").isNotNull()),
        "tcp.srcport": ("uint", only(c("tcp_seq").isNotNull(), c("sport"))),
        "tcp.dstport": ("uint", only(c("tcp_seq").isNotNull(), c("dport"))),
        "tcp.seq": ("uint", c("tcp_seq")),
        "tcp.ack": ("uint", c("tcp_ack")),
        "tcp.hdr_len": ("uint", c("tcp_hlen")),
        "tcp.flags": ("uint", c("tcp_flags")),
        "tcp.window_size": ("uint", c("tcp_win")),
        "tcp.checksum": ("uint", c("tcp_checksum")),
        "tcp.urgent_pointer": ("uint", c("tcp_urgent")),
        "udp": ("none", c("udp_len").isNotNull()),
        "udp.srcport": ("uint", only(c("udp_len").isNotNull(), c("sport"))),
        "udp.dstport": ("uint", only(c("udp_len").isNotNull(), c("dport"))),
        "udp.length": ("uint", c("udp_len")),
        "udp.checksum": ("uint", c("udp_checksum")),
        "icmp": ("none", i4.isNotNull()),
        "icmp.type": ("uint", i4),
        "icmp.code": ("uint", only(i4.isNotNull(), c("icmp_code"))),
        "icmp.checksum": ("uint", only(i4.isNotNull(), c("icmp_checksum"))),
        "icmpv6": ("none", i6.isNotNull()),
        "icmpv6.type": ("uint", i6),
        "icmpv6.code": ("uint", only(i6.isNotNull(), c("icmp_code"))),
    }
    for i, names in enumerate(("fin", "syn", "reset rst", "push psh", "ack", "urg", "ece", "cwr")):
        for n in names.split():
            f[f"tcp.flags.{n}"] = ("uint", _flag(i))
    if dialect == "display":
        f["frame"] = ("none", F.lit(True))
    for new, old in {"tcp.window_size_value": "tcp.window_size", "udp.len": "udp.length", "arp.op": "arp.opcode"}.items():
        f[new] = f[old]
    out = {k: Field(*v) for k, v in f.items()}
    for k in ("ip.checksum.bad", "tcp.checksum.bad", "udp.checksum.bad"):
        col = c("ip_checksum_bad") if k[0] == "i" else only(c("tcp_seq" if k[0] == "t" else "udp_len").isNotNull(), c("l4_checksum_bad"))
        out[k] = Field("uint", F.when(col, 1), "checksums")
    out["communityid"] = out["community.id"] = Field("str", c("community_id"), "community")
    for k in STATE_FLAGS:
        out[f"tcp.analysis.{k}"] = Field("uint", c(f"a_{k}").cast("bigint"), "state")
    return out


#: What TCP analysis with state tells of a packet.
STATE_FLAGS = ["retransmission", "fast_retransmission", "spurious_retransmission", "out_of_order", "lost_segment", "duplicate_ack", "duplicate_ack_num", "window_update", "zero_window", "zero_window_probe", "zero_window_probe_ack", "keep_alive", "keep_alive_ack", "bytes_in_flight"]

#: Names that stand for several fields.
_SEVERAL = {
    "ip.addr": ["ip.src", "ip.dst"],
    "ipv6.addr": ["ipv6.src", "ipv6.dst"],
    "eth.addr": ["eth.src", "eth.dst"],
    "tcp.port": ["tcp.srcport", "tcp.dstport"],
    "udp.port": ["udp.srcport", "udp.dstport"],
}
#: Other spellings of dissected fields.
_SAME = {
    "dns.qry.name": "dns.qname",
    "http.request.method": "http.method",
    "http.request.uri": "http.uri",
    "http.response.code": "http.status_code",
    "tls.handshake.extensions_server_name": "tls.server_name",
}


@dataclass
class Compiled:
    """A filter as a column, and what the column needs: any of headers, fields, state, checksums, community."""

    column: Column
    needs: frozenset[str]
    node: object


class Binder:
    """Turns trees into columns. providers: names to columns the user supplies (strings). symbols: for lookup(NAME)."""

    def __init__(self, dialect: str = "display", aliases: Aliases | None = None, providers: dict[str, Column] | None = None, symbols: dict[str, int] | None = None, compat: bool = False, fields_column: str = "fields"):
        self.dialect, self.aliases, self.providers, self.symbols, self.compat = dialect, aliases or Aliases(), providers or {}, symbols or {}, compat
        self.known = header_fields(dialect)
        self.fields_column = fields_column
        self.needs: set[str] = set()

    # -- names

    def names(self, name: str) -> list[str]:
        if name.startswith("ip6.") or name == "ip6":
            name = "ipv6" + name[3:]
        if name == "ipv6.proto":
            name = "ipv6.nxt"
        if name in self.aliases.fields:
            return [x for n in self.aliases.fields[name] for x in self.names(n)]
        return _SEVERAL.get(name, [name])

    def hits(self, name: str) -> list[Field]:
        """The header fields that a name means; empty if it is none of them."""
        out = [self.known[n] for n in self.names(name) if n in self.known]
        self.needs.update(f.needs for f in out)
        return out

    # -- the tree

    def bind(self, n: object) -> Column:
        if isinstance(n, All):
            return F.lit(True)
        if isinstance(n, And):
            return self.bind(n.a) & self.bind(n.b)
        if isinstance(n, Or):
            return self.bind(n.a) | self.bind(n.b)
        if isinstance(n, Not):
            return ~self.bind(n.a)
        if isinstance(n, Exists):
            return F.coalesce(self.exists(n.ref), F.lit(False))
        return F.coalesce(self.compare(n), F.lit(False))

    def _any(self, columns: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in columns], F.lit(False))

    def exists(self, r: Ref) -> Column:
        if r.function or self.dialect == "capture" and (r.start is not None or r.mask is not None):
            v = self.computed(r)
            return v[1].isNotNull() if v else F.lit(False)
        if r.name in self.providers:
            return self.providers[r.name].isNotNull()
        found = [f.column if f.vtype == "none" else f.column.isNotNull() for f in self.hits(r.name)]
        rest = [n for n in self.names(r.name) if n not in self.known]
        if rest and self.dialect == "display":
            self.needs.add("fields")
            found.append(F.exists(self.fields_column, lambda x: x["abbrev"].isin(*self._spellings(rest))))
        return self._any(found)

    @staticmethod
    def _spellings(names: list[str]) -> list[str]:
        return [s for n in names for s in dict.fromkeys([n, _SAME.get(n, n)])]

    def compare(self, n: Compare) -> Column:
        r, value = n.ref, n.value
        if n.symbol:
            if value not in self.symbols:
                return F.lit(False)
            value = str(self.symbols[value])
        if self.dialect == "capture":
            if n.op == "contains" and r.start is None and not r.function and (at := self.layer(r.name)) is not None:
                pattern = byte_pattern(value)
                return F.contains(F.substring("frame", at + 1, F.length("frame") - at), F.lit(bytes(pattern))) if pattern else F.lit(False)
            if r.start is not None or r.mask is not None or r.function:
                v = self.computed(r)
                return self.test(v[0], v[1], n.op, value) if v else F.lit(False)
        if r.name in self.providers:
            return self.provided(self.providers[r.name], n.op, value)
        if r.start is not None:
            tests = [self.sliced(f, r, n.op, value) for f in self.hits(r.name)]
        else:
            tests = [self.test(f.vtype, f.column, n.op, value) for f in self.hits(r.name)]
        rest = [x for x in self.names(r.name) if x not in self.known]
        if rest and self.dialect == "display":
            self.needs.add("fields")
            names = self._spellings(rest)
            tests.append(F.exists(self.fields_column, lambda x: x["abbrev"].isin(*names) & F.coalesce(self.element(x, r, n.op, value), F.lit(False))))
        return self._any(tests)

    # -- values

    def element(self, x: Column, r: Ref, op: str, value: str) -> Column:
        """A dissected field, whose type is known only at run time."""
        kind = x["vtype"]
        if r.start is not None:
            return self.byte_test(x["b"], r, op, value)
        if op == "matches":
            text = F.when(F.length(x["s"]) > 0, x["s"]).when(kind == "uint", x["u"].cast("string")).otherwise(F.lower(F.hex(x["b"])))
            return _matches(text, value)
        out = F.when(kind == "uint", self.test("uint", x["u"], op, value)).when(kind == "str", self.test("str", x["s"], op, value))
        out = out.when(kind == "ipv4", self.test("ipv4", x["b"], op, value)).when(kind == "mac", self.test("mac", x["b"], op, value))
        return out.when(kind == "ipv6", self.test("ipv6", x["b"], op, value)).otherwise(F.lit(False))

    def test(self, vtype: str, c: Column, op: str, value: str) -> Column:
        if vtype == "none":
            return F.lit(False)
        if vtype == "uint":
            if op == "contains":
                return F.lit(False)
            if op == "matches":
                return _matches(c.cast("string"), value) if self.dialect == "display" else F.lit(False)
            v = _number(value)
            return _ordered(c, op, F.lit(v)) if v < 1 << 63 else F.lit(op in ("!=", "<", "<=")) & c.isNotNull()
        if vtype == "str":
            if op == "contains":
                return F.contains(c, F.lit(value))
            return _matches(c, value) if op == "matches" else _ordered(c, op, F.lit(value))
        if op == "matches":
            if self.dialect == "capture":
                return F.lit(False)
            return _matches({"ipv4": ipv4_text, "ipv6": ipv6_text, "mac": mac_text}.get(vtype, lambda b: F.lower(F.hex(b)))(c), value)
        if vtype == "ipv4":
            return self.address(c, op, value, 4)
        if vtype == "ipv6":
            if self.compat and self.dialect == "display" or op == "contains":
                text = ipv6_text(c)
                return F.contains(text, F.lit(value)) if op == "contains" else _ordered(text, op, F.lit(value))
            return self.address(c, op, value, 16)
        if vtype == "mac":
            parts = value.split(":")
            if len(parts) != 6 or not all(re.fullmatch(r"[0-9a-fA-F]{1,2}", p) for p in parts) or op == "contains":
                return F.lit(False)
            return _ordered(c, op, F.lit(bytes(int(p, 16) for p in parts)))
        return F.lit(False)

    def address(self, c: Column, op: str, value: str, size: int) -> Column:
        text, _, prefix = value.partition("/")
        try:
            a = (ipaddress.IPv4Address if size == 4 else ipaddress.IPv6Address)(text)
        except ValueError:
            return F.lit(False)
        raw, bits = a.packed, 8 * size
        if op in ("==", "!="):
            p = min(bits, max(0, int(prefix))) if re.fullmatch(r"-?\d+", prefix) else bits
            whole, rest = divmod(p, 8)
            same = F.substring(c, 1, whole) == F.lit(raw[:whole]) if whole else c.isNotNull()
            if rest:
                mask = 0xFF << (8 - rest) & 0xFF
                same = same & (be(c, whole, 1).bitwiseAND(F.lit(mask)) == raw[whole] & mask)
            return same if op == "==" else ~same
        return _ordered(c, op, F.lit(raw)) if op in (">", "<", ">=", "<=") else F.lit(False)

    def provided(self, c: Column, op: str, value: str) -> Column:
        """A provider's text: compared as the address, number or text that it looks like."""
        text = c.cast("string")
        if op in ("contains", "matches"):
            return self.test("str", text, op, value)
        number = text.rlike(r"^(0[xX][0-9a-fA-F]+|\d+)$")
        as_number = F.when(text.rlike("^0[xX]"), hex_number(F.substring(text, 3, 16))).otherwise(text.try_cast("bigint"))
        v4 = text.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
        raw = F.unhex(F.concat(*[F.lpad(F.hex(F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint")), 2, "0") for i in range(1, 5)]))
        mac = text.rlike(r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$")
        out = F.when(v4, self.test("ipv4", raw, op, value)).when(mac, self.test("mac", F.unhex(F.regexp_replace(text, ":", "")), op, value))
        return out.when(number, self.test("uint", as_number, op, value)).otherwise(self.test("str", text, op, value))

    # -- slices, masks and functions

    def layer(self, name: str) -> Column | None:
        """Where a layer begins in the frame (null where it is absent)."""
        self.needs.add("headers")
        c = F.col
        return {
            "frame": F.lit(0),
            "eth": F.when(c("eth_dst").isNotNull(), 0),
            "ip": F.when(c("ip_v") == 4, c("l3_off")),
            "ip6": F.when(c("ip_v") == 6, c("l3_off")),
            "ipv6": F.when(c("ip_v") == 6, c("l3_off")),
            "tcp": F.when(c("tcp_seq").isNotNull(), c("l4_off")),
            "udp": F.when(c("udp_len").isNotNull(), c("l4_off")),
            "icmp": F.when((c("l4_proto") == 1) & c("icmp_type").isNotNull(), c("l4_off")),
            "icmpv6": F.when((c("l4_proto") == 58) & c("icmp_type").isNotNull(), c("l4_off")),
        }.get(name)

    def computed(self, r: Ref) -> tuple[str, Column] | None:
        """Type and column of a capture filter's slice, mask or function."""
        if r.start is not None:
            parts = {"eth.dst": ("eth", 0), "eth.src": ("eth", 6), "ip.src": ("ip", 12), "ip.dst": ("ip", 16), "ip6.src": ("ip6", 8), "ip6.dst": ("ip6", 24)}
            layer, add = parts.get(r.name, (r.name, 0))
            at = self.layer(layer)
            n = 1 if r.length is None else r.length
            if at is None or not 1 <= n <= 8:
                return None
            base = at + add
            off = base + r.start if r.start >= 0 else F.when(F.length("frame") + r.start >= base, F.length("frame") + r.start)
            v = be("frame", off, n) if n < 8 else F.shiftleft(be("frame", off, 4), 32).bitwiseOR(be("frame", off + 4, 4))
            return "uint", v if r.mask is None else v.bitwiseAND(_as_long(r.mask))
        if r.function == "len":
            c = F.col
            v4 = c("ip_v") == 4
            known = {
                "frame": F.length("frame"),
                "ip": F.when(v4, c("ip_len")),
                "ip.payload": F.when(v4, F.greatest(F.lit(0), c("ip_len") - c("ip_ihl"))),
                "tcp": c("tcp_hlen"),
                "tcp.payload": F.when(v4 & c("tcp_seq").isNotNull(), F.greatest(F.lit(0), c("ip_len") - c("ip_ihl") - c("tcp_hlen"))),
                "udp": c("udp_len"),
                "udp.payload": F.when(c("udp_len").isNotNull(), F.greatest(F.lit(0), c("udp_len") - 8)),
            }
            self.needs.add("headers")
            if r.name in known:
                return "uint", known[r.name].cast("bigint")
            text = self.text(r.name)
            return None if text is None else ("uint", F.length(text).cast("bigint"))
        if r.function in ("upper", "lower"):
            text = self.text(r.name)
            return None if text is None else ("str", F.upper(text) if r.function == "upper" else F.lower(text))
        if r.function == "lookup":
            return ("uint", F.lit(self.symbols[r.name])) if r.name in self.symbols else None
        if r.mask is not None:
            found = [f for f in self.hits(r.name) if f.vtype == "uint"]
            return ("uint", found[0].column.cast("bigint").bitwiseAND(_as_long(r.mask))) if found else None
        return None

    def text(self, name: str) -> Column | None:
        if name in self.providers:
            return self.providers[name].cast("string")
        found = [f for f in self.hits(name) if f.vtype == "str"]
        return found[0].column if found else None

    def sliced(self, f: Field, r: Ref, op: str, value: str) -> Column:
        """A display filter's slice of a header field: of its bytes."""
        return self.byte_test(f.column, r, op, value) if f.vtype in ("ipv4", "ipv6", "mac", "bytes") else F.lit(False)

    def byte_test(self, b: Column, r: Ref, op: str, value: str) -> Column:
        want = hex_bytes(value)
        if want is None or r.start < 0:
            return F.lit(False)
        n = F.length(b) - r.start if r.length is None else F.lit(r.length)
        part = F.substring(b, F.lit(r.start + 1), n)
        inside = (n >= 0) & (F.lit(r.start) + n <= F.length(b))
        if op == "contains":
            return inside & F.contains(part, F.lit(want))
        return inside & (_ordered(part, op, F.lit(want)) if op != "matches" else F.lit(False))


def _as_long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


def _ordered(c: Column, op: str, v: Column) -> Column:
    return {"==": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


#: POSIX bracket classes in Java's words (fixed values).
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r" \t", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}"}


def extended_regex(pattern: str) -> str | None:
    """A POSIX extended expression in Java's syntax, or None if it is not one."""
    try:
        re.compile(re.sub(r"\[:\w+:\]", "a", pattern))
    except re.error:
        return None
    return re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], ""), pattern)


def _matches(c: Column, pattern: str) -> Column:
    java = extended_regex(pattern)
    return F.lit(False) if java is None else c.rlike(java)


def byte_pattern(value: str) -> bytes:
    """What `contains` searches for: 0x digits (8 bytes at most), hex bytes between colons, or the text's bytes; 64 at most."""
    if re.match(r"0[xX]", value):
        digits = re.match(r"[0-9a-fA-F]*", value[2:])[0]
        return bytes(int(digits[i : i + 2], 16) for i in range(0, len(digits), 2))[:8]
    if ":" in value:
        return bytes(int(re.match(r"[0-9a-fA-F]*", p)[0] or "0", 16) & 0xFF for p in value.split(":"))[:64]
    return value.encode()[:64]


def hex_bytes(value: str) -> bytes | None:
    """Hex digits, as one run (0x or not) or between : - . as separators."""
    if re.fullmatch(r"[0-9a-fA-F]{1,2}([:.\-][0-9a-fA-F]{1,2})+", value):
        return bytes(int(p, 16) for p in re.split(r"[:.\-]", value))
    digits = value[2:] if value[:2] in ("0x", "0X") else value
    if not re.fullmatch(r"[0-9a-fA-F]+", digits):
        return None
    return bytes.fromhex(digits if len(digits) % 2 == 0 else "0" + digits)


def conjuncts(n: object) -> list[object]:
    return [*conjuncts(n.a), *conjuncts(n.b)] if isinstance(n, And) else [n]


def compile_filter(text: str | object, dialect: str = "display", **options) -> Compiled:
    """A filter's text (or tree) as a column; options as for Binder."""
    node = parse(text, dialect, options.get("aliases")) if isinstance(text, str) else text
    b = Binder(dialect, **options)
    column = b.bind(node)
    return Compiled(column, frozenset(b.needs), node)


def validate_filter(text: str, dialect: str = "display", aliases: Aliases | None = None) -> str | None:
    """None if the text is a filter, else what is wrong."""
    try:
        parse(text, dialect, aliases)
    except FilterSyntaxError as e:
        return str(e)
    return None
