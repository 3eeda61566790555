"""Labels of frames by tables of address prefixes and of payload signatures: joins on equal keys, for tables of any size.

An address is in a prefix if its first bits are the prefix's. For every length that the table has (161 at most) an address has one key, so
the longest prefix is found by an equi-join and a maximum. The same goes for signatures, by each place and length that occurs. Addresses are looked up once
each, not for every frame. Rules are rows of a table, read by Spark like any other; a small one is broadcast by Spark itself.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.operators.headers import capture_columns, payload, with_headers


def _ready(df: DataFrame) -> DataFrame:
    return df if "l4_off" in df.columns else with_headers(df)


def _parsed(cidr: str | None) -> tuple[bytes, int] | None:
    """The network and length of a prefix; bits beyond the length do not matter; an address alone is a prefix of all its bits."""
    if cidr is None:
        return None
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    return net.network_address.packed, net.prefixlen


def _key(address: Column, bits: Column | int, length: int) -> Column:
    """The first `bits` of an address of `length` bytes, as text that tells families and lengths apart."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    # the bytes that are whole, and of the next one its first bits
    whole, rest = F.floor(bits / 8).cast("int"), bits % 8
    part = F.conv(F.hex(F.substring(address, whole + 1, F.lit(1))), 16, 10).cast("int")
    kept = F.when(rest == 0, "").otherwise(F.floor(part / F.pow(F.lit(2), 8 - rest)).cast("int").cast("string"))
    return F.concat_ws("/", F.lit(str(length)), bits.cast("string"), F.hex(F.substring(address, F.lit(1), whole)), kept)


def prefixes(rules: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """rules with family (4 or 16 bytes), bits and key of each prefix. A text that is no prefix is an error, a null one matches nothing."""
    parse = F.udf(_parsed, "struct<net: binary, bits: int>", useArrow=True)
    df = rules.withColumn("_p", parse(F.col(cidr_col)))
    df = df.where(F.col("_p").isNotNull()).withColumns({"family": F.length("_p.net"), "bits": F.col("_p.bits")})
    return df.withColumn("key", F.when(F.col("family") == 4, _key(F.col("_p.net"), F.col("bits"), 4)).otherwise(_key(F.col("_p.net"), F.col("bits"), 16))).drop("_p")


def address_labels(addresses: DataFrame, rules: DataFrame, ip_col: str = "ip", cidr_col: str = "cidr", label_col: str = "label", order_col: str | None = None) -> DataFrame:
    """ip_col (binary, distinct), label, bits: of every address that a prefix holds, the longest one's label; of equal ones the first by order_col, else by the label."""
    known = prefixes(rules, cidr_col)
    by = F.col(order_col) if order_col else F.col(label_col)
    known = known.select("family", "bits", "key", F.col(label_col).alias("label"), by.alias("by"))
    known = known.groupBy("family", "bits", "key").agg(F.min_by("label", "by").alias("label"))
    lengths: dict[int, list[int]] = {4: [], 16: []}
    for r in known.select("family", "bits").distinct().collect():  # 33 and 129 rows at most
        lengths[r.family].append(r.bits)
    ip = F.col(ip_col)
    keys = lambda n: F.array(*[F.struct(F.lit(b).alias("bits"), _key(ip, b, n).alias("key")) for b in sorted(lengths[n])]).cast("array<struct<bits: int, key: string>>")
    once = addresses.select(ip_col).where(ip.isNotNull()).distinct()
    asked = once.select(ip_col, F.explode(F.when(F.length(ip) == 4, keys(4)).when(F.length(ip) == 16, keys(16))).alias("k")).select(ip_col, "k.*")
    met = asked.join(known.select("key", "label"), "key")
    return met.groupBy(ip_col).agg(F.max_by("label", "bits").alias("label"), F.max("bits").alias("bits"))


def labelled_by_address(frames: DataFrame, rules: DataFrame, cidr_col: str = "cidr", label_col: str = "label", order_col: str | None = None) -> DataFrame:
    """frames (with headers) and src_label, dst_label: of the longest prefix that holds the address; null where none does."""
    df = _ready(frames)
    ends = df.select(F.col("ip_src").alias("ip")).union(df.select(F.col("ip_dst").alias("ip")))
    got = address_labels(ends, rules, "ip", cidr_col, label_col, order_col).select("ip", "label")
    out = df
    for side in ("src", "dst"):
        out = out.join(got.select(F.col("ip").alias(f"_{side}"), F.col("label").alias(f"{side}_label")), F.col(f"ip_{side}") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out


def signature_labels(frames: DataFrame, rules: DataFrame, off_col: str = "off", bytes_col: str = "bytes", label_col: str = "label", order_col: str = "no", proto_col: str | None = None) -> DataFrame:
    """file (if frames has it), frame_no, label: of the first rule, by order_col, whose bytes stand at its offset of the frame's transport payload.

    A rule with a protocol (6, 17) in proto_col is for that one only; null or 0 is for any. A payload has a key for each pair of an
    offset and a length that the rules have. Rules without bytes match nothing.
    """
    df = _ready(frames)
    own = capture_columns(df)
    proto = F.coalesce(F.col(proto_col), F.lit(0)).cast("int") if proto_col else F.lit(0)
    known = rules.where(F.length(bytes_col) > 0).select(F.col(off_col).cast("int").alias("off"), F.length(bytes_col).alias("n"), F.hex(bytes_col).alias("sig"), proto.alias("proto"), F.col(label_col).alias("label"), F.col(order_col).alias("no"))
    known = known.groupBy("off", "n", "sig", "proto").agg(F.min_by("label", "no").alias("label"), F.min("no").alias("no"))
    places = known.select("off", "n").distinct().collect()
    body = df.where(F.col("pay_len") > 0).select(*own, "frame_no", "l4_proto", F.hex(payload()).alias("data"))
    cut = lambda r: F.when(F.length("data") >= 2 * (r.off + r.n), F.struct(F.lit(r.off).alias("off"), F.lit(r.n).alias("n"), F.substring("data", 2 * r.off + 1, 2 * r.n).alias("sig")))
    keys = F.array_compact(F.array(*[cut(r) for r in sorted(places)])) if places else F.array().cast("array<struct<off: int, n: int, sig: string>>")
    asked = body.select(*own, "frame_no", "l4_proto", F.explode(keys).alias("k")).select(*own, "frame_no", "l4_proto", "k.*")
    met = asked.join(known, ["off", "n", "sig"]).where((F.col("proto") == 0) | (F.col("proto") == F.col("l4_proto")))
    return met.groupBy(*own, "frame_no").agg(F.min_by("label", "no").alias("label"))
