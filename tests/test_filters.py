"""Capture and display filters against byte fixtures."""

import pytest
from pyspark.sql import functions as F

from framequarry.operators.headers import with_headers
from framequarry.operators.select import display_filter
from framequarry.plans.filters import Aliases, FilterSyntaxError, compile_filter, parse, validate_filter

#: Frames (fixed values).
FRAMES = {
    "syn": "ffffffffffff aabbccddeeff 0800 45000028 00010000 40060000 c0a80101 0a000001 30390050 00000000 00000000 5002ffff 00000000",
    "push": "deadbeef0001 001122334455 0800 45000028 00040000 80060000 ac100001 ac100002 c35001bb 00000001 00000001 50182000 00000000",
    "rst": "000102030405 060708090a0b 0800 45000028 00050000 40060000 0a000002 0a000001 0050d431 00000001 00000001 50140000 00000000",
    "dns": "ffffffffffff 001122334455 0800 4500001c 00020000 40110000 0a000005 08080808 d4310035 00080000",
    "ntp": "001122334455 66778899aabb 0800 4500001c 00030000 40110000 c0a8000a 81060f1c 9c40007b 00080000",
    "icmp": "000102030405 aabbccddeeff 0800 4500001c 00060000 40010000 0a0a0005 01010101 0800f7ff 00010001",
    "arp": "ffffffffffff aabbccddeeff 0806 00010800 06040001 aabbccddeeff c0a80101 000000000000 c0a801fe",
    "tcp6": "000102030405 060708090a0b 86dd 60000000 00140640 fd000000000000000000000000000001 fd000000000000000000000000000002 ea601f90 00000000 00000000 5002ffff 00000000",
    "ssh": "112233445566 778899aabbcc 0800 45000028 00070000 40060000 c6336401 cb00710a 80000016 00000000 00000000 5002ffff 00000000",
    "vlan": "112233445566 aabbccddeeff 8100 0064 0800 45000028 000a0000 40060000 c0a80101 0a000001 30390050 00000000 00000000 5002ffff 00000000",
    "icmp6": "000102030405 060708090a0b 86dd 60000000 00083a40 fd000000000000000000000000000001 fd000000000000000000000000000002 80000000 00010001",
}

#: Filter: the frames it matches out of those listed after the bar (fixed values: what each must mean).
CAPTURE = """
tcp : syn tcp6 | syn dns tcp6
udp : dns | syn dns
ip : syn dns | syn dns tcp6
ip6 : tcp6 | syn tcp6
ipv6 : tcp6 | syn tcp6
icmp : icmp | icmp syn icmp6
icmpv6 : icmp6 | icmp6 tcp6 icmp
arp : arp | arp syn
ip.src == 192.168.1.1 : syn vlan | syn dns vlan
ip.addr == 10.0.0.1 : syn rst vlan | syn rst vlan dns
ip.src == 192.168.1.0/24 : syn | syn ssh
ip.dst == 172.16.0.0/12 : push | syn push
ip.dst == 8.8.8.0/24 : dns | dns syn
ip.src == foo : | syn dns
ip.src != foo : | syn dns
tcp.port == 80 : syn rst | syn rst push
tcp.port != 80 : syn push | syn push
tcp.dstport == 22 : ssh | ssh syn
udp.port == 53 : dns | dns ntp
tcp.flags == 0x18 : push | syn push rst
tcp.flags.syn == 1 : syn | syn push
tcp.flags.rst == 1 : rst | syn push rst
tcp.flags.fin == 0 : syn | syn dns
tcp.flags.psh == 1 : push | syn push
ip.proto == 17 : dns | dns syn icmp
ip.ttl > 64 : push | syn push
eth.type == 0x86dd : tcp6 | tcp6 syn arp
eth.dst == ff:ff:ff:ff:ff:ff : syn arp | syn arp push
eth.addr == aa:bb:cc:dd:ee:ff : syn icmp | syn icmp push
icmp.type == 8 : icmp | icmp icmp6
icmpv6.type == 128 : icmp6 | icmp icmp6
tcp and ip.src == 192.168.1.2 : | syn
tcp or udp : syn dns | syn dns icmp
not tcp : dns | syn dns
!udp && tcp : syn | syn dns
(tcp or icmp) and ip.ttl == 64 : icmp syn | icmp syn dns
tcp.dstport in {80 443 8080} : syn push | syn push ssh
tcp.dstport in {80, 443} : syn push | syn push ssh
tcp.dstport in (443, 8080) : push | syn push
tcp.dstport in {22, 80..90, 443} : syn push ssh | syn push ssh dns
tcp.dstport in {81..1024} : push | syn push
ip.ttl in {65..255} : push | syn push
ip[9] == 17 : dns | syn dns
ip[0] == 0x45 : syn | syn tcp6
tcp[13] == 0x14 : rst | syn rst push
tcp[0:2] == 12345 : syn | syn push
ip[12:4] == 0xc0a80101 : syn | syn push
eth[12:2] == 0x0806 : arp | syn arp
frame[23] == 6 : syn | syn dns
tcp[13]&0x02 == 0x02 : syn | syn push rst
ip[6:2]&0x1fff == 0 : syn dns | syn dns arp
tcp[100] == 0 : | syn
frame[200] == 0 : | syn
tcp[0] == 0 : | dns
tcp[2:2] == 8080 : tcp6 | syn tcp6
tcp[-7] == 0x02 : syn | syn push
ip6.addr == fd00::2 : tcp6 | tcp6 syn
ip6.src == fd00::/64 : tcp6 | tcp6 syn
ip6.src == fe80::/64 : | tcp6
ip6.src == fd00::1/128 : tcp6 | tcp6
vlan.id == 100 : vlan | vlan syn
vlan.id in {200, 300} : | vlan
frame contains 0xc0a80101 : syn | syn push
ip contains 0x0a000001 : syn | syn push
tcp contains 0x0050 : syn | syn push dns
udp contains 0x0035 : dns | dns syn
ip.src matches "192\\." : | syn
ip.src matches "[invalid" : | syn
len(frame) == 54 : syn | syn dns
len(ip) == 28 : dns | dns syn arp
len(ip.payload) == 20 : syn | syn dns
len(tcp) : syn | syn dns
len(tcp.payload) == 0 : syn push | syn push dns
len(udp.payload) == 0 : dns | dns syn
lower(ip.src) == "192.168.1.1" : | syn
lower(noexist.field) == "test" : | syn
tcp.flags & 0x02 == 0x02 : syn | syn push
tcp.flags & 0x02 != 0 : syn | syn push
ip.proto & 0xf0 == 0x10 : | syn
frame.len == 42 : dns | dns syn
tcp.ack > 0 : push | syn push
tcp.window_size == 8192 : push | syn push
arp.opcode == 1 : arp | arp syn
arp.src.proto_ipv4 == 192.168.1.1 : arp | arp syn
arp.dst.hw_mac == 00:00:00:00:00:00 : arp | arp syn
"""

DISPLAY = """
frame and eth : syn arp | syn arp
tcp.flags.push == 1 and not tcp.flags.reset == 1 : push | push rst syn
ip.src[0:2] == c0a8 : syn ntp | syn ntp dns
eth.src[0-1] == aa:bb : syn arp | syn arp dns
eth.dst[4:] == 04:05 : icmp rst | icmp rst syn
ip.dst contains 8 : | dns
ip.dst matches "^8\\.8" : dns | dns syn
tcp.dstport in {22, 80..90} : syn ssh | syn ssh push
ipv6.src == fd00::1 : tcp6 | tcp6 syn
TCP OR udp : dns | dns
"""


def cases(text, dialect):
    for line in text.strip().splitlines():
        left, _, listed = line.rpartition(" | ")
        expr, _, wanted = left.rpartition(" :")
        yield pytest.param(expr, dialect, set(wanted.split()), set(listed.split()), id=f"{dialect}: {expr}")


@pytest.fixture(scope="module")
def matched(spark):
    """All filters evaluated in one pass: filter to the frames it matches."""
    rows = [(k, bytearray.fromhex(v.replace(" ", ""))) for k, v in FRAMES.items()]
    df = spark.createDataFrame(rows, "name string, frame binary").withColumns({"linktype": F.lit(1), "origlen": F.length("frame").cast("bigint"), "frame_no": F.lit(1)})
    df = with_headers(df).withColumn("d", F.struct(F.array().cast("array<struct<abbrev: string, vtype: string, u: bigint, s: string, b: binary>>").alias("fields")))
    every = [p.values[:2] for p in (*cases(CAPTURE, "capture"), *cases(DISPLAY, "display"))]
    got = {}
    for at in range(0, len(every), 30):
        part = every[at : at + 30]
        cols = [compile_filter(e, d, fields_column="d.fields").column.alias(f"m{i}") for i, (e, d) in enumerate(part)]
        for r in df.select("name", *cols).collect():
            for i, key in enumerate(part):
                assert r[f"m{i}"] is not None
                if r[f"m{i}"]:
                    got.setdefault(tuple(key), set()).add(r.name)
    return got


@pytest.mark.parametrize(("expr", "dialect", "wanted", "listed"), [*cases(CAPTURE, "capture"), *cases(DISPLAY, "display")])
def test_matches(matched, expr, dialect, wanted, listed):
    assert matched.get((expr, dialect), set()) & listed == wanted


@pytest.mark.parametrize("expr", ["ip.src ==", "tcp.port in {}", "@badfield == 1", "tcp and", "tcp.port in {80"])
def test_capture_errors(expr):
    with pytest.raises(FilterSyntaxError):
        parse(expr, "capture")


@pytest.mark.parametrize("expr", ["(tcp", "ip.src[0:2 == 1", "tcp.port in 80", "tcp.flags & 2 == 2", "== 3"])
def test_display_errors(expr):
    assert validate_filter(expr) is not None


def test_blank_matches_all_and_valid_is_none(spark):
    assert validate_filter("") is None and validate_filter("tcp && !udp") is None


def test_alias_arguments_and_fields(spark):
    a = Aliases.parse("# comment\nweb = tcp.port in {80, 443}\nboth = ip.addr == $1 and ip.addr == $2\nends = ip.src, ip.dst\n")
    assert a.expand("web") == "(tcp.port in {80, 443})"
    assert parse("both 10.0.0.1 192.168.1.1", "capture", a) == parse("(ip.addr == 10.0.0.1 and ip.addr == 192.168.1.1)", "capture")
    assert a.fields["ends"] == ["ip.src", "ip.dst"]
    loop = Aliases(expressions={"x": "y or tcp", "y": "x or udp"})
    with pytest.raises(FilterSyntaxError):
        loop.expand("x")


def test_providers_and_symbols(spark):
    df = spark.createDataFrame([(1, bytearray.fromhex(FRAMES["syn"].replace(" ", "")), "0x41"), (2, bytearray.fromhex(FRAMES["dns"].replace(" ", "")), "open")], "frame_no int, frame binary, state string")
    df = df.withColumns({"linktype": F.lit(1), "origlen": F.length("frame").cast("bigint")})
    got = lambda e, **k: [r.frame_no for r in display_filter(df, e, "capture", **k).collect()]
    own = {"my.state": F.col("state")}
    assert got("my.state == lookup(CREATED)", providers=own, symbols={"CREATED": 0x41}) == [1]
    assert got('upper(my.state) == "OPEN"', providers=own) == [2]
    assert got("my.state matches \"^o\" and len(my.state) == 4", providers=own) == [2]


def test_header_filters_need_no_python(spark):
    df = spark.createDataFrame([(1, bytearray.fromhex(FRAMES["syn"].replace(" ", "")))], "frame_no int, frame binary").withColumns({"linktype": F.lit(1), "origlen": F.lit(54)})
    plan = display_filter(df, "tcp.dstport == 80 and ip.src == 192.168.0.0/16")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_sample_aliases():
    from framequarry.plans.samples import sample_aliases

    a = sample_aliases()
    assert len(a.expressions) > 10
    for name, to in a.expressions.items():
        word = " cafe" if "$1" in to else ""
        assert validate_filter(f"not ({name}{word}) or udp", "display", a) is None
        assert parse(name + word, "display", a) == parse(to.replace("$1", "cafe"))
