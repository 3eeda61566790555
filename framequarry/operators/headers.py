"""Link, network and transport headers of raw frames as plain columns.

Everything here is column expressions over `frame` and `linktype`, so header-only queries never start a Python worker
and unused fields are pruned away. Conditions on stored columns (file, time) belong before with_headers(), where they
reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions.bits import hex_number, piece

#: Link types that are understood (fixed values, the public registry's numbers).
NULL, ETHERNET, RAW, SLL, IPV4, IPV6 = 0, 1, 101, 113, 228, 229

#: Nested tags that are looked for first; a frame that has so many is looked through for more.
FEW_TAGS = 4

COLUMNS = [
    "eth_dst", "eth_src", "eth_type", "vlan_stack", "vlan_id", "l3_off", "ip_v", "ip_ihl", "ip_dsfield", "ip_len", "ip_id", "ip_flags", "ip_frag", "ip_ttl", "ip_proto", "ip_checksum", "ip_src", "ip_dst",
    "l4_off", "l4_end", "l4_proto", "sport", "dport", "tcp_seq", "tcp_ack", "tcp_hlen", "tcp_flags", "tcp_win", "tcp_checksum", "tcp_urgent", "udp_len", "udp_checksum", "icmp_type", "icmp_code", "icmp_checksum",
    "arp_op", "arp_src_hw", "arp_src_ip", "arp_dst_hw", "arp_dst_ip", "pay_off", "pay_len",
]


def capture_columns(df: DataFrame) -> list[str]:
    """The columns that tell captures apart: frame numbers and conversations are those of one file."""
    return [c for c in ("file",) if c in df.columns]


def _be(off, n: int) -> Column:
    """n bytes of the frame as a number; callers check that they are there.

    The offset is named once: filters are pushed below these projections, and every repetition multiplies there.
    """
    return hex_number(F.hex(F.substring(F.col("frame"), off + 1, F.lit(n))))


def _once(c: Column) -> Column:
    """c, computed in its own projection: the optimiser neither merges it with later ones nor copies it into filters.

    Offsets depend on offsets; copied into every place that names them, they would grow past what can be compiled.
    """
    return c + F.spark_partition_id() * 0


def _bytes(off, n: int) -> Column:
    return F.substring(F.col("frame"), off + 1, F.lit(n))


def _link(df: DataFrame) -> DataFrame:
    """eth_*, vlan_stack, eth_type (the innermost), l3_off, ip_v."""
    lt, f = F.col("linktype"), F.col("frame")
    eth = (lt == ETHERNET) & (F.length(f) >= 14)
    # possessive and without a branch, so a run of any length is matched in a loop; hex of whole frames only where all the first tags are taken
    run = "^((?:(?=8100|88A8).{8})*+)"
    few = F.regexp_extract(F.hex(F.substring(f, 13, 4 * FEW_TAGS)), run, 1)
    df = df.withColumn("_tags", F.when(eth, few))
    df = df.withColumn("_tags", F.when(F.length("_tags") == 8 * FEW_TAGS, F.regexp_extract(F.hex(F.substring(f, 13, 1 << 30)), run, 1)).otherwise(F.col("_tags")))
    size = F.length("_tags")
    kind = F.when(eth, hex_number(F.hex(F.substring(f, (13 + size / 2).cast("int"), F.lit(2))))).when(lt == SLL, _be(F.lit(14), 2))
    l3 = F.when(lt == ETHERNET, 14 + size / 2).when(lt == SLL, 16).when(lt == NULL, 4).when(lt.isin(RAW, IPV4, IPV6), 0)
    ids = F.transform(F.sequence(F.lit(0), (size / 8 - 1).cast("int")), lambda i: hex_number(F.substring(F.col("_tags"), (i * 8 + 5).cast("int"), F.lit(4))).bitwiseAND(F.lit(0x0FFF)).cast("int"))
    df = df.withColumns(
        {
            "eth_dst": F.when(eth, F.substring(f, 1, 6)),
            "eth_src": F.when(eth, F.substring(f, 7, 6)),
            "eth_type": kind.cast("int"),
            "vlan_stack": F.when(size > 0, ids).otherwise(F.array().cast("array<int>")),
            "vlan_id": F.when(size > 0, hex_number(F.substring("_tags", 5, 4)).bitwiseAND(F.lit(0x0FFF)).cast("int")),
            "l3_off": _once(l3.cast("int")),
        }
    )
    typed = lambda t: ~lt.isin(ETHERNET, SLL) | (F.col("eth_type") == t)
    room = F.length(f) - F.col("l3_off")
    nibble = F.substring(F.hex(F.substring(f, F.col("l3_off") + 1, F.lit(1))), 1, 1)
    ip_v = F.when((nibble == "4") & typed(0x0800) & (room >= 20), 4).when((nibble == "6") & typed(0x86DD) & (room >= 40), 6)
    return df.withColumn("ip_v", _once(ip_v)).drop("_tags")


def _network(df: DataFrame) -> DataFrame:
    f, o, v = F.col("frame"), F.col("l3_off"), F.col("ip_v")
    either = lambda a, b: F.when(v == 4, a).when(v == 6, b)
    at = lambda four, six, n: F.when(v.isNotNull(), _be(o + F.when(v == 4, four).otherwise(six), n))
    df = df.withColumns(
        {
            "ip_ihl": either(_be(o, 1).bitwiseAND(F.lit(15)) * 4, F.lit(40)).cast("int"),
            "ip_dsfield": F.when(v == 4, _be(o + 1, 1)).cast("int"),
            "ip_len": (at(2, 4, 2) + F.when(v == 6, 40).otherwise(0)).cast("int"),
            "ip_id": F.when(v == 4, _be(o + 4, 2)).cast("int"),
            "ip_flags": F.when(v == 4, F.shiftright(_be(o + 6, 1), 5)).cast("int"),
            "ip_frag": F.when(v == 4, _be(o + 6, 2).bitwiseAND(F.lit(0x1FFF))).cast("int"),
            "ip_ttl": at(8, 7, 1).cast("int"),
            "ip_proto": at(9, 6, 1).cast("int"),
            "ip_checksum": F.when(v == 4, _be(o + 10, 2)).cast("int"),
            "ip_src": either(_bytes(o + 12, 4), _bytes(o + 8, 16)),
            "ip_dst": either(_bytes(o + 16, 4), _bytes(o + 24, 16)),
        }
    )
    arp = (F.col("eth_type") == 0x0806) & (F.length(f) >= o + 28)
    return df.withColumns(
        {
            "l4_off": _once((o + F.col("ip_ihl")).cast("int")),
            # what the packet says it has, and no more than was captured; 0 (offload) means all
            "l4_end": F.when(F.col("ip_len") <= F.col("ip_ihl"), F.length(f)).when(F.col("ip_len").isNotNull(), F.least(F.length(f), o + F.col("ip_len"))).cast("int"),
            "l4_proto": F.col("ip_proto"),
            "arp_op": F.when(arp, _be(o + 6, 2)).cast("int"),
            "arp_src_hw": F.when(arp, _bytes(o + 8, 6)),
            "arp_src_ip": F.when(arp, _bytes(o + 14, 4)),
            "arp_dst_hw": F.when(arp, _bytes(o + 18, 6)),
            "arp_dst_ip": F.when(arp, _bytes(o + 24, 4)),
        }
    )


def _transport(df: DataFrame) -> DataFrame:
    """A later fragment's bytes are no transport header."""
    f, o, p = F.col("frame"), F.col("l4_off"), F.col("l4_proto")
    room = F.length(f) - o
    first = F.coalesce("ip_frag", F.lit(0)) == 0
    kind = F.when((p == 6) & (room >= 20) & first, 6).when((p == 17) & (room >= 8) & first, 17).when(F.when(F.col("ip_v") == 4, p == 1).otherwise(p == 58) & (room >= 4) & first, 1)
    df = df.withColumn("_l4", _once(kind))
    k = F.col("_l4")
    tcp, udp, icmp, two = k == 6, k == 17, k == 1, k > 1
    df = df.withColumns(
        {
            "sport": F.when(two, _be(o, 2)).cast("int"),
            "dport": F.when(two, _be(o + 2, 2)).cast("int"),
            "tcp_seq": F.when(tcp, _be(o + 4, 4)),
            "tcp_ack": F.when(tcp, _be(o + 8, 4)),
            "tcp_hlen": F.when(tcp, F.shiftright(_be(o + 12, 1), 4) * 4).cast("int"),
            "tcp_flags": F.when(tcp, _be(o + 13, 1)).cast("int"),
            "tcp_win": F.when(tcp, _be(o + 14, 2)).cast("int"),
            "tcp_checksum": F.when(tcp, _be(o + 16, 2)).cast("int"),
            "tcp_urgent": F.when(tcp, _be(o + 18, 2)).cast("int"),
            "udp_len": F.when(udp, _be(o + 4, 2)).cast("int"),
            "udp_checksum": F.when(udp, _be(o + 6, 2)).cast("int"),
            "icmp_type": F.when(icmp, _be(o, 1)).cast("int"),
            "icmp_code": F.when(icmp, _be(o + 1, 1)).cast("int"),
            "icmp_checksum": F.when(icmp, _be(o + 2, 2)).cast("int"),
        }
    )
    off = o + F.when(tcp, F.greatest(F.lit(20), F.col("tcp_hlen"))).when(udp, 8)
    df = df.withColumn("pay_off", off.cast("int"))
    return df.withColumn("pay_len", F.when(F.col("pay_off").isNotNull(), F.greatest(F.lit(0), F.col("l4_end") - F.col("pay_off"))).cast("int")).drop("_l4")


def with_headers(packets: DataFrame) -> DataFrame:
    """packets (frame, linktype, ...) with COLUMNS. Frames too short for a header have nulls from there on."""
    if "linktype" not in packets.columns:
        packets = packets.withColumn("linktype", F.lit(ETHERNET))
    return _transport(_network(_link(packets)))


def payload() -> Column:
    """The transport payload of a row of with_headers()."""
    return F.when(F.col("pay_off").isNotNull(), F.substring("frame", F.col("pay_off") + 1, F.col("pay_len")))


def verified(df: DataFrame) -> DataFrame:
    """Adds ip_checksum_bad and l4_checksum_bad (null where there is nothing to verify; a UDP checksum of 0 is not verified)."""
    from framequarry.functions.bits import ones_complement_sum, to_bytes

    head = piece("frame", F.col("l3_off"), F.col("ip_ihl"))
    body = piece("frame", F.col("l4_off"), F.col("l4_end") - F.col("l4_off"))
    size = F.col("l4_end") - F.col("l4_off")
    pseudo = F.concat("ip_src", "ip_dst", to_bytes(F.col("l4_proto"), 2), to_bytes(size, 2))
    whole = (F.col("ip_len") + F.col("l3_off") <= F.length("frame")) & (F.coalesce("ip_frag", F.lit(0)) == 0)
    checked = whole & ((F.col("l4_proto") == 6) & F.col("tcp_seq").isNotNull() | (F.col("l4_proto") == 17) & (F.col("udp_checksum") != 0))
    return df.withColumns(
        {
            "ip_checksum_bad": F.when(F.col("ip_v") == 4, ones_complement_sum(head) != 0xFFFF),
            "l4_checksum_bad": F.when(checked, ones_complement_sum(F.concat(pseudo, body)) != 0xFFFF),
        }
    )
