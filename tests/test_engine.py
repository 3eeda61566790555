"""Headers, decoders, captures, streams, state, builders and the shell."""

import struct

import pytest
from pyspark.sql import functions as F

from framequarry.build import packets as P
from framequarry.build.session import Shell, ShellError, TcpSession
from framequarry.dissect.engine import Dissector, default_registry, dissect, field_column, sticky
from framequarry.dissect.language import DecoderSyntaxError, Registry, Tree, show
from framequarry.functions import bits
from framequarry.functions.community import community_id
from framequarry.operators import analytics, objects, reassembly
from framequarry.operators.headers import verified, with_headers
from framequarry.operators.select import display_filter, limit_after, match_filters
from framequarry.operators.tcp_state import Side, advance, tcp_analysis_full
from framequarry.sources import captures, formats


def frames(spark, items, linktype=1):
    rows = [(i, 1_700_000_000_000_000_000 + i * 1_000_000, linktype, len(f), bytearray(f)) for i, f in enumerate(items, 1)]
    return spark.createDataFrame(rows, "frame_no bigint, ts_ns bigint, linktype int, origlen bigint, frame binary").withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint")))


# ---- column functions ----------------------------------------------------------------------------------


def test_bits(spark):
    b = bytes(range(1, 20))
    df = spark.createDataFrame([(bytearray(b),)], "b binary")
    r = df.select(
        bits.be("b", 0, 2).alias("be"), bits.le("b", 0, 4).alias("le"), bits.be("b", 18, 2).alias("past"), bits.u64_bits("b", 0).alias("u64"), bits.mac_text(F.substring("b", 1, 6)).alias("mac"),
        bits.ipv4_text(F.substring("b", 1, 4)).alias("v4"), bits.ipv6_text(F.substring("b", 1, 16)).alias("v6"), bits.ipv6_text(F.substring("b", 1, 16), padded=False).alias("short"), bits.checksum_of("b").alias("sum"),
    ).first()
    assert (r.be, r.le, r.past) == (0x0102, 0x04030201, None)
    assert r.u64 == 0x0102030405060708 and r.mac == "01:02:03:04:05:06" and r.v4 == "1.2.3.4"
    assert r.v6.startswith("0102:0304") and r.short.startswith("102:304") and r["sum"] == P.checksum(b)


def test_community_id_public_vector(spark):
    df = spark.createDataFrame([(P.ip("128.232.110.120"), P.ip("66.35.250.204"), 6, 34855, 80), (P.ip("66.35.250.204"), P.ip("128.232.110.120"), 6, 80, 34855)], "ip_src binary, ip_dst binary, l4_proto int, sport int, dport int")
    assert {r[0] for r in df.select(community_id()).collect()} == {"1:LQU9qZlK+B5F3KDmev6m5PMibrg="}


# ---- headers -------------------------------------------------------------------------------------------


def test_link_types(spark):
    ip = P.ipv4(P.udp(b"hi", "10.0.0.1", "10.0.0.2", 5, 6), "10.0.0.1", "10.0.0.2", 17)
    six = P.ipv6(P.tcp(b"", b"\1" * 16, b"\2" * 16, 7, 8), b"\1" * 16, b"\2" * 16, 6)
    kinds = [(1, P.ethernet(ip)), (1, P.ethernet(ip, vlan=7)), (1, P.ethernet(struct.pack(">HH", 9, 0x0800) + ip, kind=0x8100, vlan=7)), (101, ip), (101, six), (228, ip), (229, six), (0, struct.pack("<I", 2) + ip), (0, struct.pack("<I", 30) + six), (113, b"\0" * 14 + b"\x08\x00" + ip), (1, b"short")]
    df = spark.createDataFrame([(i, lt, bytearray(f)) for i, (lt, f) in enumerate(kinds)], "frame_no int, linktype int, frame binary")
    got = {r.frame_no: r for r in with_headers(df).collect()}
    assert [got[i].sport for i in range(11)] == [5, 5, 5, 5, 7, 5, 7, 5, 7, 5, None]
    assert got[2].vlan_stack == [7, 9] and got[1].vlan_id == 7 and got[0].pay_len == 2 and got[4].ip_v == 6


def test_padding_is_not_payload(spark):
    f = P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 2) + b"\0" * 6
    assert with_headers(frames(spark, [f])).first().pay_len == 0


def test_checksums(spark):
    good, bad = P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 2, b"abc"), bytearray(P.udp_frame("1.1.1.1", "2.2.2.2", 1, 2, b"abc"))
    bad[-1] ^= 1
    got = verified(with_headers(frames(spark, [good, bytes(bad)]))).orderBy("frame_no").collect()
    assert [(r.ip_checksum_bad, r.l4_checksum_bad) for r in got] == [(False, False), (False, True)]


# ---- decoders ------------------------------------------------------------------------------------------

#: Decoder, payload, and what its fields must be (fixed values; frames of the public sample captures, cut to their headers).
SAMPLES = [
    ("BFD", "20440521000000010000000000 0f4240000f424000000000".replace(" ", ""), {"bfd.detect_mult": 5, "bfd.my_discriminator": 1, "bfd.desired_min_tx_interval": 1000000}),
    ("OSPF", "0201002cc0a8aa0800000001273b000000000000000000 00".replace(" ", ""), {"ospf.version": 2, "ospf.type": 1}),
    ("IGMP", "1164ee9b00000000", {"igmp.type": 0x11, "igmp.max_resp_time": 100}),
    ("CDP", "01b4dff0", {"cdp.version": 1, "cdp.ttl": 180}),
    ("DCCP", "80041389050008db0100", {"dccp.source_port": 32772, "dccp.dest_port": 5001}),
    ("DHCPv6", "01123456", {"dhcpv6.msg_type": 1}),
    ("BGP", "ff" * 16 + "001304", {"bgp.length": 19, "bgp.type": 4}),
    ("TFTP", "00040007", {"tftp.opcode": 4, "tftp.block": 7}),
    ("TFTP", "0003000148656c6c6f", {"tftp.block": 1}),
    ("MQTT", "300700036162630102", {"mqtt.packet_type": 3, "mqtt.topic_name": "abc"}),
    ("RADIUS", "01050014" + "00" * 16, {"radius.code": 1, "radius.identifier": 5}),
    ("STUN", "000100002112a442" + "00" * 12, {"stun.message_type": 1}),
    ("SNMP", "308181020100" + "0406" + b"public".hex() + "a274" + "020400010203" + "020100" + "020105" + "3066" + "3064" + "06082b06010201010100" + "0458" + "41" * 88, {"snmp.community": "public", "snmp.request_id": 0x10203, "snmp.error_index": 5, "snmp.pdu": 0xA2}),
    ("LDAP", "3084000000100201056384000000070400aabbccddee", {"ldap.message_id": 5, "ldap.protocol_op": 0x63}),
    ("KRB5", "6a81823081 7fa103020105a20302010a".replace(" ", "") + "00" * 119, {"krb5.pvno": 5, "krb5.msg_type": 10}),
    ("NTP", "240206e9" + "00" * 8 + "4c4f434c" + "00" * 32, {"ntp.vn": 4, "ntp.mode": 4, "ntp.stratum": 2, "ntp.li_vn_mode": 0x24}),
    ("QUIC", "c000000001" + "0411223344" + "00" + "4a4b", {"quic.header_form": 1, "quic.version": 1, "quic.destination_connection_id_length": 4}),
    ("MPLS", "00010140", {"mpls.label": 16, "mpls.bottom_of_stack": 1, "mpls.ttl": 64}),
    ("RTP", "80600001000000020000000 3aa".replace(" ", ""), {"rtp.version": 2, "rtp.payload_type": 96, "rtp.ssrc": 3}),
]


@pytest.mark.parametrize(("name", "data", "want"), SAMPLES, ids=[f"{s[0]}-{i}" for i, s in enumerate(SAMPLES)])
def test_samples(name, data, want):
    t = Tree()
    assert default_registry().decode(name, bytes.fromhex(data), 0, t, -1)
    got = {n.abbrev: n.s if n.vtype == "str" else n.u for n in t.nodes}
    assert {k: got.get(k) for k in want} == want


def tree(frame, **k):
    t = Dissector(**k).dissect(frame)
    return t, {n.abbrev: n for n in reversed(t.nodes)}


def test_dns_http_tls_dhcp():
    t, f = tree(P.udp_frame("10.0.0.1", "8.8.8.8", 5000, 53, P.dns_response("www.example.com", "1.2.3.4", 7)))
    assert t.proto == "DNS" and f["dns.qname"].s == "www.example.com" and f["dns.rdata"].s == "1.2.3.4" and f["dns.qr"].u == 1
    t, f = tree(P.tcp_frame("10.0.0.1", "10.0.0.2", 5000, 80, b"GET /x HTTP/1.1\r\nHost: h\r\nA: b\r\n\r\n"))
    assert t.proto == "HTTP" and f["http.method"].s == "GET" and f["http.uri"].s == "/x" and t.info == "GET /x HTTP/1.1"
    t, f = tree(P.tcp_frame("10.0.0.1", "10.0.0.2", 80, 5000, b"HTTP/1.1 404 Not Found\r\n\r\nbody"))
    assert f["http.status_code"].s == "404"
    t, f = tree(P.tcp_frame("10.0.0.1", "10.0.0.2", 5000, 9443, P.tls_client_hello("my.host") + P.tls_application_data(b"zz")))
    assert t.proto == "TLS" and f["tls.server_name"].s == "my.host" and sum(n.abbrev == "tls.record" for n in t.nodes) == 2
    t, f = tree(P.udp_frame("0.0.0.0", "255.255.255.255", 68, 67, P.dhcp_offer(9, "02:00:00:00:00:09", "10.0.0.9", "10.0.0.1")))
    assert f["dhcp.message_type"].u == 2 and f["dhcp.yiaddr"].s == "10.0.0.9" and f["dhcp.lease_time"].u == 86400


def test_plain_payload_arp_icmp_and_fragments():
    t, f = tree(P.tcp_frame("10.0.0.1", "10.0.0.2", 5000, 80, b"just words"))
    assert t.proto == "TCP" and f["data.data"].b == b"just words"
    t, f = tree(P.arp_frame("02:00:00:00:00:01", "10.0.0.1", "10.0.0.2"))
    assert t.info == "Who has 10.0.0.2? Tell 10.0.0.1" and f["arp.opcode"].u == 1
    t, f = tree(P.ethernet(P.ipv4(b"x" * 16, "1.1.1.1", "2.2.2.2", 17, offset=800)))
    assert "udp" not in f and f["data.len"].u == 16
    for n in range(0, 60):  # cut anywhere, never an error
        Dissector().dissect(P.udp_frame("10.0.0.1", "8.8.8.8", 5000, 53, P.dns_query("a.b"))[:n])


LANGUAGE = r'''
Lookup COLOUR
    red = 1
protocol Demo
    abbrev "demo"
    info "%s %d %x" kind, count, flags
    required uint8 kind
        Alpha = 1
    required uint8 count
    required le_uint16 flags mask 0x0fff hex "Flags"
        bits flags high 12 4
    repeat count - 1 as pair "Pair"
        label "%s=%s" k, v
        required uint8 k lookup COLOUR
        required uint8 n
        required str[n] v
    when kind == 1 and count > 2:
        required uint8 extra
    else:
        required uint8 other
    required string word until "|" "Word"
    when word == "stop":
        required uint8 stopped
    seek 0
    required uint8 again
'''


def test_language():
    r = Registry()
    assert r.load(LANGUAGE) == ["Demo"]
    data = bytes([1, 3, 0x34, 0xF2, 1, 2]) + b"hi" + bytes([9, 1]) + b"x" + bytes([7]) + b"stop|" + bytes([5])
    t = Tree()
    r.decode("Demo", data, 0, t, -1)
    f = {n.abbrev: n for n in t.nodes}
    assert f["demo.flags"].u == 0x234 and f["demo.high"].u == 0xF and f["demo.extra"].u == 7 and f["demo.stopped"].u == 5 and f["demo.again"].u == 1
    assert [n.label for n in t.nodes if n.abbrev == "demo.pair"] == ["red=hi", "9=x"]
    assert t.info == "Alpha 3 f234" and "demo.other" not in f
    assert "kind: Alpha (1)" in show(r, "Demo", data) and r.source("Demo").startswith("protocol Demo")
    for bad in ("protocol X\n    nonsense here", "protocol X\n    required string s", "rule what => X", "stray"):
        with pytest.raises(DecoderSyntaxError):
            Registry().load(bad)


def test_rules_order_and_sticky(spark):
    r = Registry()
    r.load('protocol A\n    required uint8 x\nprotocol B\n    required uint8 y\nrule tcp.port == 7 => A\nrule tcp.content "B" => B\nrule ip4.src in 10.9.0.0/16 => B')
    d = Dissector(r)
    d.dissect(P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 7, b"zz"))
    assert d.matched == "A"
    d.dissect(P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 7, b"Bz"))
    assert d.matched == "B"
    d.dissect(P.tcp_frame("10.9.1.1", "2.2.2.2", 1, 7, b"zz"))
    assert d.matched == "B"
    df = frames(spark, [P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 99, b"zz"), P.tcp_frame("1.1.1.1", "2.2.2.2", 1, 99, b"Bz"), P.tcp_frame("2.2.2.2", "1.1.1.1", 99, 1, b"zz")])
    got = sticky(df, r).orderBy("frame_no").select("matched").collect()
    assert [x.matched for x in got] == [None, "B", "B"]


def test_dissect_frames_and_filters(spark):
    df = frames(spark, [P.udp_frame("10.0.0.1", "8.8.8.8", 5000, 53, P.dns_query("a.example.com")), P.tcp_frame("10.0.0.1", "10.0.0.2", 5000, 80, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n")])
    got = dissect(df).select("frame_no", "d.proto", field_column("dns.qname").alias("q")).orderBy("frame_no").collect()
    assert [(r.proto, r.q) for r in got] == [("DNS", "a.example.com"), ("HTTP", None)]
    ids = lambda e: [r.frame_no for r in display_filter(df, e).collect()]
    assert ids("dns") == [1] and ids('http.request.method == "GET" && tcp') == [2] and ids('dns.qname matches "example\\.com$"') == [1]
    assert ids("dns.questions == 1") == [1] and ids('host.name contains "example"') == [1] and ids("frame.number > 1 and tcp") == [2]  # other spellings, stored columns
    assert ids("not dns and frame") == [2] and ids("dns.id in {0..5} or tcp.analysis.retransmission == 1") == [1]
    m = match_filters(df, ["dns", "tcp", "udp and not http"]).orderBy("frame_no").collect()
    assert [(r.m0, r.m1, r.m2) for r in m] == [(True, False, True), (False, True, False)]
    assert limit_after(df, "tcp", 5).count() == 1


# ---- captures ------------------------------------------------------------------------------------------


def test_next_generation_round_trip(spark, tmp_path):
    w = formats.Writer()
    data = w.start() + w.packet(b"abc", 1, 1_700_000_000_123_456_789, 10, "note") + formats.simple_packet(b"defgh") + formats.custom_block(77, b"data") + w.packet(b"raw", 101, 5) + formats.block(0x99, b"1234")
    data += formats.section_header() + formats.interface_description(228) + formats.enhanced_packet(b"later", 1_000_000)
    got = list(formats.packets(data))
    assert [(p.frame, p.linktype, p.section) for p in got] == [(b"abc", 1, 0), (b"defgh", 1, 0), (b"data", 0xFFFF, 0), (b"raw", 101, 0), (b"later", 228, 1)]
    assert got[0].ts_ns == 1_700_000_000_123_456_789 and got[0].origlen == 10 and got[0].comment == "note" and got[2].pen == 77 and got[4].ts_ns == 1_000_000_000
    for n in range(0, len(data), 7):
        list(formats.packets(data[:n]))
    (tmp_path / "a.pcapng").write_bytes(data)
    df = captures.read_capture(spark, f"file://{tmp_path}/a.pcapng")
    assert df.count() == 5 and captures.capture_blocks(spark, f"file://{tmp_path}/a.pcapng").where("block_type = 153").count() == 1
    captures.register(spark)
    df.where("not custom").write.format("capture").mode("overwrite").save(f"{tmp_path}/out")
    back = spark.read.format("capture").load(f"{tmp_path}/out")
    assert sorted(bytes(r.frame) for r in back.collect()) == [b"abc", b"defgh", b"later", b"raw"]


def test_big_endian_and_classic():
    body = struct.pack(">IHHq", formats.BYTE_ORDER, 1, 0, -1)
    big = lambda kind, b: struct.pack(">II", kind, 12 + len(b)) + b + struct.pack(">I", 12 + len(b))
    data = big(formats.SHB, body) + big(1, struct.pack(">HHI", 1, 0, 99)) + big(6, struct.pack(">IIIII", 0, 0, 7, 4, 4) + b"wxyz")
    assert [(p.frame, p.ts_ns) for p in formats.packets(data)] == [(b"wxyz", 7000)]
    frame = P.udp_frame("10.0.0.1", "10.0.0.2", 12345, 53, b"hi")
    for magic, order, ns in ((b"\xd4\xc3\xb2\xa1", "<", 5000), (b"\xa1\xb2\x3c\x4d", ">", 5)):
        head = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
        p = list(formats.packets(head + struct.pack(order + "IIII", 1_700_000_000, 5, len(frame), len(frame)) + frame + b"cut"))
        assert len(p) == 1 and p[0].frame == frame and p[0].ts_ns == 1_700_000_000_000_000_000 + ns


def test_other_blocks_and_hex():
    assert len(formats.name_resolution([(P.ip("1.2.3.4"), ["a", "bc"])])) % 4 == 0
    assert list(formats.blocks(formats.section_header() + formats.interface_statistics(0, 5, 10, 2) + formats.decryption_secrets(0x544C534B, b"k")))[1].kind == formats.ISB
    assert formats.hex_text("01 02 0a") == formats.hex_text("01020a") == b"\1\2\n"
    assert formats.hex_text("0000   45 00 00 1c 00 01 00 00 40 11 00 00 0a 00 00 01   E.......@.......\n0010   0a 00 00 02") == bytes.fromhex("4500001c00010000401100000a0000010a000002")


def test_export_replace_comment(spark):
    df = frames(spark, [b"one", b"two", b"three"]).withColumns({"comment": F.lit(None).cast("string"), "interface_id": F.lit(0).cast("bigint"), "caplen": F.col("origlen")})
    picks = spark.createDataFrame([(3, 0), (1, 1), (9, 2)], "frame_no bigint, ordinal int")
    content = captures.export_capture(df, picks).collect()
    assert [p.frame for p in formats.packets(bytes(content[0].content))] == [b"three", b"one"]
    assert [bytes(r.frame) for r in captures.replace_packet(df, 2, b"new!").orderBy("frame_no").collect()] == [b"one", b"new!", b"three"]
    assert captures.commented(captures.set_comment(df, 1, "hi")).count() == 1
    assert captures.snapped(df, 2).first().caplen == 2


def test_remote_desktop_sessions():
    from framequarry.build import rdp

    d = rdp.Desktop(user="bob", password="pw", channels=["cliprdr"])
    steps = [*rdp.login(d), *rdp.typing(d, "Hi 2"), *rdp.pointing(d, [(5, 6), (7, 8)]), *rdp.copying(d, "text"), *rdp.logout(d)]
    for up, m in steps:  # every message is a packet of its length, and its inner lengths agree
        assert m[:2] == b"\3\0" and int.from_bytes(m[2:4], "big") == len(m)
        if m[4:7] == b"\x02\xf0\x80" and m[7] in (0x64, 0x68):
            n, at = (m[13], 14) if m[13] < 128 else (int.from_bytes(m[13:15], "big") & 0x7FFF, 15)
            assert (m[7] == 0x64) == up and n == len(m) - at
            if m[10:12] == (1003).to_bytes(2, "big") and m[at : at + 2] != b"\x40\0":
                assert int.from_bytes(m[at : at + 2], "little") == n
    initial = rdp.mcs_connect_initial(d)
    at = initial.index(b"Duca") + 4
    assert int.from_bytes(initial[at : at + 2], "big") & 0x7FFF == len(initial) - at - 2
    kinds, at = [], at + 2
    while at < len(initial):  # the client's blocks follow each other to the end
        kind, size = struct.unpack_from("<HH", initial, at)
        kinds.append(kind)
        at += size
    assert kinds == [0xC001, 0xC004, 0xC002, 0xC003] and at == len(initial)
    assert sum(m[7] == 0x38 for _, m in steps[4:] if len(m) == 12) == 3 and rdp._utf16("text") in steps[-3][1]
    assert len(rdp.typing(d, "Hi 2")) == 4 + 2 + 2 + 2 and steps[-1][1].endswith(b"\x21\x80")
    f = rdp.session("10.0.0.1", "10.0.0.2", d, "a", [(1, 2)], "c")
    t, found = tree(f[3])
    assert t.proto == "RDP" and found["rdp.cookie"].s == "Cookie: mstshash=bob"


# ---- TCP state -----------------------------------------------------------------------------------------

A, S, F_, R = 16, 2, 1, 4


def play(*steps):
    """Steps (from a?, flags, seq, ack, window, size) to the flags that each earns."""
    a, b = Side(), Side()
    return [advance(*((a, b) if up else (b, a)), flags, seq, ack, win, size) for up, flags, seq, ack, win, size in steps]


def test_retransmission_and_order():
    g = play((1, S, 1000, 0, 9, 0), (1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (1, A, 1001, 1, 9, 100), (1, A, 1101, 1, 9, 50), (1, A, 1120, 1, 9, 50), (1, A, 1001, 1, 9, 50))
    assert ["retransmission" in x for x in g] == [False, True, False, True, False, False, True] and "out_of_order" in g[5]


def test_duplicate_ack_and_window():
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (0, A, 1, 1101, 8, 0), (0, A, 1, 1101, 8, 0), (0, A, 1, 1101, 8, 0), (0, A, 1, 1101, 4096, 0))
    assert [x.get("duplicate_ack_num", 0) for x in g] == [0, 0, 0, 1, 2, 0] and "window_update" in g[5]


def test_zero_window_keep_alive():
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 8192, 0), (0, A, 1, 1001, 0, 0), (1, A, 1001, 1, 9, 1), (0, A, 1, 1002, 0, 0))
    assert "zero_window" in g[2] and "zero_window_probe" in g[3] and "zero_window_probe_ack" in g[4]
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (0, A, 1, 1101, 9, 0), (1, A, 1100, 1, 9, 0), (0, A, 1, 1101, 9, 0), (1, A, 1101, 1, 9, 50))
    assert "keep_alive" in g[3] and "keep_alive_ack" in g[4] and "keep_alive" not in g[5]


def test_fast_spurious_flight_lost():
    ack = (0, A, 1, 1101, 9, 0)
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (1, A, 1101, 1, 9, 100), ack, ack, ack, ack, (1, A, 1101, 1, 9, 100))
    assert "fast_retransmission" in g[7] and "retransmission" in g[7] and "spurious_retransmission" not in g[7]
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), ack, (1, A, 1001, 1, 9, 100))
    assert "spurious_retransmission" in g[3] and "fast_retransmission" not in g[3]
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (1, A, 1101, 1, 9, 200), ack, (1, A, 1301, 1, 9, 50), (0, A, 1, 1351, 9, 0), (1, A, 1351, 1, 9, 0))
    assert g[4]["bytes_in_flight"] == 250 and g[6]["bytes_in_flight"] == 0
    g = play((1, S, 1000, 0, 9, 0), (1, A, 1001, 1, 9, 100), (1, A, 1301, 1, 9, 50), (1, A, 1351, 1, 9, 0))
    assert "lost_segment" in g[2] and "retransmission" not in g[2] and "lost_segment" not in g[3]
    assert play((1, S, 1000, 0, 9, 0), (1, R, 1001, 0, 0, 0), (1, A, 1001, 1, 9, 10))[2] == {}


def test_state_over_frames(spark):
    k = {"src": "10.0.0.1", "dst": "10.0.0.2", "sport": 1234, "dport": 80}
    items = [P.tcp_frame(**k, flags="S", seq=1000), P.tcp_frame(**k, payload=b"x" * 100, flags="A", seq=1001), P.tcp_frame(**k, payload=b"x" * 100, flags="A", seq=1001), P.udp_frame("1.1.1.1", "2.2.2.2", 1, 2)]
    got = tcp_analysis_full(frames(spark, items)).orderBy("frame_no").collect()
    assert [r.a_retransmission for r in got] == [0, 0, 1, 0]
    assert [r.frame_no for r in display_filter(frames(spark, items), "tcp.analysis.retransmission == 1", "capture").collect()] == [3]


# ---- reassembly ----------------------------------------------------------------------------------------


def test_defragment(spark):
    body = bytes(i & 0xFF for i in range(500))
    piece = lambda i, a, b, more: P.ethernet(P.ipv4(body[a:b], "10.0.0.1", "10.0.0.2", 17, ident=i, flags=int(more), offset=a))
    items = [piece(1, 400, 500, False), piece(2, 0, 104, True), piece(1, 0, 200, True), piece(2, 104, 200, False), piece(1, 200, 400, True), piece(3, 0, 200, True), P.udp_frame("1.1.1.1", "2.2.2.2", 1, 2, b"x")]
    got = {r.frame_no: bytes(r.packet) for r in reassembly.defragment(frames(spark, items)).collect()}
    assert set(got) == {5, 4, 7} and got[5][20:] == body and len(got[5]) == 520 and got[4][20:] == body[:200]
    assert P.checksum(got[5][:20]) == 0 and got[5][6:8] == b"\0\0"


def test_half_stream():
    h = reassembly.HalfStream()
    assert h.add(0xFFFFFFF0, b"", True) == b"" and h.add(0xFFFFFFF1, b"a" * 15, False) == b"a" * 15
    assert h.add(5, b"late", False) == b"" and h.add(0, b"01234", False) == b"01234late" and h.add(3, b"34late!", False) == b"!"
    few = reassembly.HalfStream(hold=2, cap=6)
    few.add(0, b"", True)
    assert [few.add(s, b"xx", False) for s in (5, 3, 7)] == [b"", b"", b""] and few.add(1, b"ab", False) == b"abxxxx"


def test_follow_and_objects(spark):
    s = TcpSession("10.0.0.1", "10.0.0.2", 4000, 80, mss=10)
    page = b"<html>hello</html>"
    ask = b"GET /a/page.html?x=1 HTTP/1.1\r\nHost: h.example\r\n\r\nGET /b HTTP/1.1\r\nHost: h.example\r\n\r\n"
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(page) + page
    answer += b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Disposition: attachment; filename=\"f.bin\"\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    items = [*s.handshake(), *s.send(ask), *s.send(answer, up=False), *s.close()]
    items[4], items[6] = items[6], items[4]
    df = frames(spark, items)
    r = reassembly.follow_stream(df).first()
    assert bytes(r.client) == ask and bytes(r.server) == answer
    got = sorted((o.filename, o.hostname, bytes(o.data), o.complete) for o in objects.extract_objects(df).collect())
    assert got == [("f.bin", "h.example", b"abcde", True), ("page.html", "h.example", page, True)]
    c = analytics.conversations(df).first()
    assert (c.packets, c.addr_a, c.port_b) == (len(items), "10.0.0.1", 80)
    p = reassembly.stream_packets(df, 1).orderBy("frame_no").collect()
    assert p[0].flags == "SYN" and p[0].to_server and not p[1].to_server


def test_smb_objects():
    def message(command, mid, response, body):
        return b"\xfeSMB" + struct.pack("<HHIHHIIQ", 64, 0, 0, command, 1, int(response), 0, mid) + b"\0" * 32 + body

    def framed(m):
        return b"\0" + len(m).to_bytes(3, "big") + m

    name, fid, data = "dir\\file.txt".encode("utf-16-le"), b"F" * 16, b"contents here"
    create = b"\0" * 44 + struct.pack("<HH", 64 + 56, len(name)) + b"\0" * 8 + name
    created = b"\0" * 48 + struct.pack("<Q", len(data)) + b"\0" * 8 + fid + b"\0" * 8
    read = b"\0" * 8 + struct.pack("<Q", 0) + fid + b"\0" * 16
    answer = b"\x11\0" + bytes([64 + 16, 0]) + struct.pack("<I", len(data)) + b"\0" * 8 + data
    got = objects.smb_objects(framed(message(5, 1, 0, create)) + framed(message(8, 2, 0, read)), framed(message(5, 1, 1, created)) + framed(message(8, 2, 1, answer)))
    assert [(o.filename, o.data, o.complete) for o in got] == [("file.txt", data, True)]


# ---- builders and the shell ----------------------------------------------------------------------------


def test_builders():
    assert P.ber_integer(300) == b"\x02\x02\x01\x2c" and P.ber_sequence(P.ber_boolean(True), P.ber_octets(b"x")) == b"\x30\x06\x01\x01\xff\x04\x01x"
    assert len(P.ssh_newkeys()) % 8 == 0 and P.http2_settings({3: 100})[3] == 4
    assert P.rdp_connection_request()[:2] == b"\x03\0" and len(P.rdp_session("1.1.1.1", "2.2.2.2", [(True, P.rdp_key(30))])) == 8
    t, f = tree(P.tcp_frame("1.1.1.1", "2.2.2.2", 50000, 3389, P.rdp_connection_request("bob")))
    assert f["rdp.cookie"].s == "Cookie: mstshash=bob"


def test_shell():
    s = Shell(seed=1).run(
        """
# a comment
$base = Ether()/IP(src="10.0.0.1", dst="10.0.0.2")
for $i in range(3) {
    $p = $base/TCP(sport=1000 + $i * 2, dport=80, flags="S")
    send($p)
}
send($base/UDP(dport=53)/DNS(id=5, qd=DNSQR(qname="a.b")))
protocol Mini
    required uint8 v
        One = 1
end
show("Mini", fromhex("01"))
$t = TCPSession("1.1.1.1", "2.2.2.2", 5, 6)
send($t.syn())
send($t.send(raw("data")))
"""
    )
    ports = [struct.unpack(">H", f[34:36])[0] for f in s.packets[:3]]
    assert ports == [1002, 1004, 1006] and len(s.packets) == 7 and "v: One (1)" in s.lines[0]
    assert tree(s.packets[3])[1]["dns.qname"].s == "a.b"
    for bad in ("$x", "nope()", "__import__('os')", "for $i in range(2) {", "(1).__class__"):
        with pytest.raises(ShellError):
            Shell().run(bad)


# ---- analytics -----------------------------------------------------------------------------------------


def test_analytics_invariants(spark):
    s = TcpSession("10.0.0.1", "10.0.0.2", 1, 2)
    df = frames(spark, [*s.handshake(), *s.send(b"abc"), P.arp_frame("02:00:00:00:00:01", "10.0.0.1", "10.0.0.2"), P.icmp_frame("10.0.0.1", "10.0.0.1")])
    e = analytics.endpoints(df).collect()
    assert sum(r.packets for r in e) == 2 * 6 and sum(r.tx_bytes for r in e) == sum(r.rx_bytes for r in e)
    h = {r.path: r.packets for r in analytics.protocol_hierarchy(df).collect()}
    assert h["Ethernet"] == 7 and h["Ethernet/IPv4/TCP"] == 5 and h["Ethernet/ARP"] == 1 and h["Ethernet/IPv4/ICMP"] == 1
    assert analytics.start_time(df).first().ts_ns == 1_700_000_000_001_000_000
    g = analytics.io_graph(df, {"arp": F.col("arp_op").isNotNull()}).collect()
    assert sum(r.packets for r in g) == 7 and sum(r.arp for r in g) == 1


# ---- streams -------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    from framequarry.streaming import flows

    s = TcpSession("10.0.0.1", "10.0.0.2", 4000, 80)
    body = bytes(range(200))
    pieces = [P.ethernet(P.ipv4(body[104:], "9.9.9.9", "10.0.0.2", 17, ident=4, offset=104)), P.ethernet(P.ipv4(body[:104], "9.9.9.9", "10.0.0.2", 17, ident=4, flags=1))]
    w = formats.Writer()
    shake = s.handshake()
    again = s.frame(True, "PA", b"zz")
    items = [*shake, again, again, *pieces]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcapng").write_bytes(w.start() + b"".join(w.packet(f, 1, 1_700_000_000_000_000_000 + i) for i, f in enumerate(items)))

    def drained(df, mode):
        q = df.writeStream.format("memory").queryName(f"q{abs(hash(mode + str(df.columns)))}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c{abs(hash(str(df.columns)))}").trigger(once=True).start()
        q.awaitTermination(120)  # operators with timeouts would run empty batches for ever
        return spark.table(q.name).collect()

    source = lambda: captures.read_capture_stream(spark, f"file://{tmp_path}/in")
    assert 5 in {r.packets for r in drained(flows.conversation_totals(source()), "complete")}
    state = drained(flows.tcp_analysis_stream(source()), "append")
    assert sum(r.a_retransmission for r in state) == 1
    whole = drained(flows.defragment_stream(source()), "append")
    assert any(bytes(r.packet)[20:] == body for r in whole)
    seen = []
    q = flows.capture_loop(spark, f"file://{tmp_path}/in", lambda b, n: seen.extend(r.frame_no for r in b.collect()), "tcp", count=3, checkpoint=f"{tmp_path}/loop")
    assert q.awaitTermination(120)  # it ends by itself
    assert seen == [1, 2, 3]
