"""Fixed analyses of captures: conversations, endpoints, hierarchy, TCP windows, series, summaries, counts.

Inputs are frames (frame_no, ts_ns, linktype, frame, ...); whatever has no header columns yet gets them. All of it is
groupBy with partial sums and minima, or windows per direction; nothing is collected. Frames with a column `file` are
those of several captures: conversations, streams and times are those of one file (captures.merged() makes one capture of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from framequarry.functions.bits import ip_text
from framequarry.functions.community import community_id
from framequarry.operators.headers import capture_columns, with_headers

#: Names of transport protocols (fixed values, the public registry's).
PROTO_NAMES = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 33: "DCCP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 88: "EIGRP", 89: "OSPF", 103: "PIM", 112: "VRRP", 115: "L2TP", 132: "SCTP"}


def _ready(df: DataFrame) -> DataFrame:
    return df if "l4_off" in df.columns else with_headers(df)


def proto_name(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    table = F.create_map(*[F.lit(x) for k, v in PROTO_NAMES.items() for x in (k, v)])
    return F.coalesce(table[p], F.concat(F.lit("IP proto "), p.cast("string")))


def conversation_key() -> Column:
    """The same for both directions: the lower and the higher (address, port), and the protocol."""
    a = F.struct(F.col("ip_src").alias("ip"), F.col("sport").alias("port"))
    b = F.struct(F.col("ip_dst").alias("ip"), F.col("dport").alias("port"))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col("l4_proto").alias("proto"))


def _u32(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def _after(a: Column, b: Column) -> Column:
    """a - b in 32-bit serial arithmetic, signed."""
    return F.pmod(a - b + (1 << 31), F.lit(1 << 32)) - (1 << 31)


#: Frames of a capture whose part of a direction is gone through by one task.
FLOW_BLOCK = 1 << 22


def unwrapped(seq: Column, order: WindowSpec) -> Column:
    """Sequence numbers as distances from the first of the window: the signed steps from frame to frame, summed. No distance is too far."""
    return F.sum(F.coalesce(_after(seq, F.lag(seq).over(order)), F.lit(0).cast("bigint"))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def tcp_analysis(frames: DataFrame, padding: bool = False, block: int = FLOW_BLOCK) -> DataFrame:
    """frames with retransmission, out_of_order, dup_ack (booleans, false for what is not TCP).

    Per direction and in frame order: data whose end was seen, or that starts before the highest end, is a
    retransmission; data that starts beyond it is out of order; an ACK without data, SYN or FIN whose number equals that of
    the direction's previous ACK is a duplicate. Sequence numbers are unwrapped from frame to frame, so a direction
    may carry any number of bytes. With `padding`, bytes after the IP length count as data.

    A direction is gone through in blocks of `block` frame numbers, so one huge flow is the work of many tasks. Each block sums up where its
    sequence numbers begin, end and reach, and its last ACK; of these few rows a window makes what a block must know of all earlier ones.
    """
    df = _ready(frames)
    own = capture_columns(df)
    tcp = F.col("tcp_seq").isNotNull()
    size = F.greatest(F.lit(0), F.length("frame") - F.col("pay_off")) if padding else F.col("pay_len")
    flag = lambda bit: F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0
    syn, fin, ack = flag(2), flag(1), flag(16)
    # captures by a text that is never null: joins on it need no other shuffle than the windows
    files = {f"_{c}": F.coalesce(F.concat(F.lit("/"), c), F.lit("")) for c in own}
    key = [*files, "ip_src", "sport", "ip_dst", "dport", "l4_proto"]
    cell = F.floor(F.col("frame_no") / block)
    order = Window.partitionBy(*key, "_cell").orderBy("frame_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def placed(rows: DataFrame) -> DataFrame:
        """_seq and _end from the first sequence number of the block."""
        rows = rows.withColumns({**files, "_cell": cell, "_len": F.when(tcp, size)})
        rows = rows.withColumn("_seq", F.when(tcp, unwrapped(F.col("tcp_seq"), order)))
        return rows.withColumn("_end", F.col("_seq") + F.col("_len") + F.when(syn | fin, 1).otherwise(0))

    acked = F.when(ack, F.col("frame_no"))
    blocks = placed(df.where(tcp)).groupBy(*key, "_cell").agg(
        F.min_by("tcp_seq", "frame_no").alias("_first"),
        F.max_by(F.struct("tcp_seq", "_seq"), "frame_no").alias("_last"),
        F.max("_end").alias("_most"),
        F.max_by("tcp_ack", acked).alias("_ack"),
    )
    blocks = _carried(blocks, key).select(*key, "_cell", "_before", "_acked")
    df = placed(df)
    df = df.withColumns({"_max": F.max("_end").over(before), "_prev": F.last(F.when(ack, F.col("tcp_ack")), ignorenulls=True).over(before)})
    df = df.join(blocks, [*key, "_cell"], "left").select(*df.columns, "_before", "_acked")
    most, prev = F.greatest("_max", "_before"), F.coalesce("_prev", "_acked")
    data = (F.col("_len") > 0) & most.isNotNull()
    again = data & ((F.col("_end") <= most) | (F.col("_seq") < most))
    out = data & (F.col("_seq") > most)
    dup = ack & (F.col("_len") == 0) & ~syn & ~fin & (prev == F.col("tcp_ack"))
    no = F.lit(False)
    df = df.withColumns({"retransmission": F.coalesce(again, no), "out_of_order": F.coalesce(out, no), "dup_ack": F.coalesce(dup, no)})
    return df.drop("_cell", "_len", "_seq", "_end", "_max", "_prev", "_before", "_acked", *files)


def _carried(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Of a direction's blocks in order: _before, the highest end of all earlier ones, from this one's first sequence number; _acked, their last ACK."""
    order = Window.partitionBy(*key).orderBy("_cell")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.lag("_last._seq").over(order) + _after(F.col("_first"), F.lag("_last.tcp_seq").over(order))
    rows = blocks.withColumn("_jump", F.coalesce(jump, F.lit(0).cast("bigint")))
    rows = rows.withColumn("_base", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_top", F.max(F.col("_base") + F.col("_most")).over(earlier))
    return rows.withColumns({"_before": F.col("_top") - F.col("_base"), "_acked": F.last("_ack", ignorenulls=True).over(earlier)})


def conversations(frames: DataFrame, analysis: bool = True) -> DataFrame:
    """One row for each conversation: file (if frames has it), id (its first frame), proto, addr_a, port_a, addr_b, port_b (a sent first), packets, bytes, retransmissions, dup_acks, out_of_order.

    Frames with IP addresses and ports count; bytes are captured bytes.
    """
    df = _ready(frames).where(F.col("sport").isNotNull())
    if analysis:
        df = tcp_analysis(df)
    else:
        df = df.withColumns({c: F.lit(False) for c in ("retransmission", "out_of_order", "dup_ack")})
    own = capture_columns(df)
    a, b = F.struct("ip_src", "sport"), F.struct("ip_dst", "dport")
    # a flag instead of addresses, so that all that is aggregated has a fixed size: that is hashed, not sorted
    start = F.min_by(a <= b, "frame_no")
    got = (
        df.withColumn("k", conversation_key())
        .groupBy("k", *own)
        .agg(
            F.min("frame_no").alias("id"),
            start.alias("_low"),
            F.count("*").alias("packets"),
            F.sum(F.length("frame").cast("bigint")).alias("bytes"),
            *[F.count_if(F.col(c)).alias(n) for c, n in (("retransmission", "retransmissions"), ("dup_ack", "dup_acks"), ("out_of_order", "out_of_order"))],
        )
    )
    end = lambda low: F.when(F.col("_low") == low, F.col("k.lo")).otherwise(F.col("k.hi"))
    a, b = end(True), end(False)
    return got.select(*own, "id", proto_name("k.proto").alias("proto"), ip_text(a["ip"]).alias("addr_a"), a["port"].alias("port_a"), ip_text(b["ip"]).alias("addr_b"), b["port"].alias("port_b"), "packets", "bytes", "retransmissions", "dup_acks", "out_of_order")


def endpoints(frames: DataFrame) -> DataFrame:
    """address, packets, bytes, tx_packets, tx_bytes, rx_packets, rx_bytes of every IP address; what it sends itself counts twice."""
    df = _ready(frames).where(F.col("ip_v").isNotNull())
    size = F.length("frame").cast("bigint")
    ends = df.select(F.explode(F.array(F.struct(F.col("ip_src").alias("ip"), F.lit(True).alias("tx"), size.alias("n")), F.struct(F.col("ip_dst").alias("ip"), F.lit(False).alias("tx"), size.alias("n")))).alias("e")).select("e.*")
    got = ends.groupBy("ip").agg(
        F.count("*").alias("packets"),
        F.sum("n").alias("bytes"),
        F.count_if("tx").alias("tx_packets"),
        F.sum(F.when(F.col("tx"), F.col("n")).otherwise(0)).alias("tx_bytes"),
        F.count_if(~F.col("tx")).alias("rx_packets"),
        F.sum(F.when(~F.col("tx"), F.col("n")).otherwise(0)).alias("rx_bytes"),
    )
    return got.select(ip_text("ip").alias("address"), *got.columns[1:])


def layer_path() -> Column:
    """The names of a frame's layers from the headers, outermost first."""
    net = F.when(F.col("ip_v") == 4, "IPv4").when(F.col("ip_v") == 6, "IPv6").when(F.col("arp_op").isNotNull(), "ARP")
    l4 = F.when(F.col("tcp_seq").isNotNull(), "TCP").when(F.col("udp_len").isNotNull(), "UDP").when(F.col("icmp_type").isNotNull(), F.when(F.col("ip_v") == 4, "ICMP").otherwise("ICMPv6")).when(F.col("ip_v").isNotNull() & ~F.col("l4_proto").isin(1, 6, 17, 58), proto_name("l4_proto"))
    data = F.when(F.col("pay_len") > 0, "Data")
    return F.array_compact(F.array(F.when(F.col("eth_dst").isNotNull(), "Ethernet"), F.when(F.col("vlan_id").isNotNull(), "802.1Q"), net, l4, data))


def protocol_hierarchy(frames: DataFrame, path: Column | None = None) -> DataFrame:
    """path (names joined by `/`), depth, name, packets, bytes of every chain of layers that some frame starts with."""
    df = _ready(frames).select((path if path is not None else layer_path()).alias("p"), F.length("frame").cast("bigint").alias("n"))
    # whole paths first: there are few, so their prefixes cost nothing
    whole = df.groupBy("p").agg(F.count("*").alias("packets"), F.sum("n").alias("bytes")).where(F.size("p") > 0)
    each = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("q"), "packets", "bytes")
    got = each.groupBy("q").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    return got.select(F.array_join("q", "/").alias("path"), F.size("q").alias("depth"), F.element_at("q", -1).alias("name"), "packets", "bytes")


def io_graph(frames: DataFrame, series: dict[str, Column], width: str = "1 second", ts_col: str = "ts") -> DataFrame:
    """start of each interval, packets, bytes, and for each named condition how many frames meet it."""
    df = _ready(frames)
    got = df.groupBy(F.window(ts_col, width)).agg(F.count("*").alias("packets"), F.sum(F.length("frame").cast("bigint")).alias("bytes"), *[F.count_if(c).alias(n) for n, c in series.items()])
    return got.select(F.col("window.start").alias("start"), *got.columns[1:])


def session_flows(frames: DataFrame, gap: str = "60 seconds", ts_col: str = "ts") -> DataFrame:
    """Conversations cut where nothing is sent for `gap`: addresses, ports, protocol, first and last time, packets, bytes."""
    df = _ready(frames).where(F.col("sport").isNotNull()).withColumn("k", conversation_key())
    own = capture_columns(df)
    got = df.groupBy("k", *own, F.session_window(ts_col, gap).alias("w")).agg(F.count("*").alias("packets"), F.sum(F.length("frame").cast("bigint")).alias("bytes"), F.max(ts_col).alias("last"))
    return got.select(*own, ip_text("k.lo.ip").alias("addr_lo"), F.col("k.lo.port").alias("port_lo"), ip_text("k.hi.ip").alias("addr_hi"), F.col("k.hi.port").alias("port_hi"), proto_name("k.proto").alias("proto"), F.col("w.start").alias("first"), "last", "packets", "bytes")


def flag_text(flags: Column | str = "tcp_flags") -> Column:
    f = F.col(flags) if isinstance(flags, str) else flags
    names = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]
    return F.concat_ws(" ", *[F.when(f.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)])


def summaries(frames: DataFrame) -> DataFrame:
    """frame_no, src, dst, proto, length, info from the headers: what a packet list shows."""
    df = _ready(frames)
    ports = F.concat(F.col("sport").cast("string"), F.lit(" -> "), F.col("dport").cast("string"))
    tcp = F.concat(ports, F.lit(" ["), flag_text(), F.lit("] Seq="), F.col("tcp_seq").cast("string"), F.lit(" Ack="), F.col("tcp_ack").cast("string"), F.lit(" Win="), F.col("tcp_win").cast("string"), F.lit(" Len="), F.col("pay_len").cast("string"))
    arp = F.when(F.col("arp_op") == 1, F.concat(F.lit("Who has "), ip_text("arp_dst_ip"), F.lit("? Tell "), ip_text("arp_src_ip"))).otherwise(F.concat(ip_text("arp_src_ip"), F.lit(" is at "), F.lower(F.hex("arp_src_hw"))))
    info = F.when(F.col("tcp_seq").isNotNull(), tcp).when(F.col("udp_len").isNotNull(), F.concat(ports, F.lit(" Len="), (F.col("udp_len") - 8).cast("string"))).when(F.col("icmp_type").isNotNull(), F.concat(F.lit("Type="), F.col("icmp_type").cast("string"), F.lit(" Code="), F.col("icmp_code").cast("string"))).when(F.col("arp_op").isNotNull(), arp)
    proto = F.when(F.col("arp_op").isNotNull(), "ARP").when(F.col("ip_v").isNotNull(), proto_name("l4_proto")).otherwise("Ethernet")
    return df.select(*capture_columns(df), "frame_no", F.coalesce(ip_text("ip_src"), ip_text("arp_src_ip")).alias("src"), F.coalesce(ip_text("ip_dst"), ip_text("arp_dst_ip")).alias("dst"), proto.alias("proto"), F.length("frame").alias("length"), F.coalesce(info, F.lit("")).alias("info"))


#: Frames that relative_time() looks through at once for the time before.
TIME_BLOCK = 1 << 16


def relative_time(frames: DataFrame) -> DataFrame:
    """frames with rel_ns: time since their file's first frame with a time; frames without one repeat the time before.

    The base is one minimum for each file, joined as a small table. Frames with a time need nothing else; for the others the
    last time is looked up within blocks of TIME_BLOCK frames, and from block to block over one row for each.
    """
    own = capture_columns(frames)
    key = [f"_{c}" for c in (*own, "k")]
    df = frames.withColumns({"_k": F.lit(0), **{f"_{c}": F.col(c) for c in own}})
    timed, other = F.col("ts_ns") != 0, F.coalesce(F.col("ts_ns") == 0, F.lit(True))
    base = df.where(timed).groupBy(*key).agg(F.min_by("ts_ns", "frame_no").alias("_base"))
    done = df.where(timed).join(base, key, "left").withColumn("rel_ns", F.coalesce(F.col("ts_ns") - F.col("_base"), F.lit(0).cast("bigint")))
    cells = df.select(*key, "frame_no", F.when(timed, F.col("ts_ns")).alias("_t"), F.floor(F.col("frame_no") / TIME_BLOCK).alias("_cell"))
    last = F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("frame_no")))
    blocks = cells.groupBy(*key, "_cell").agg(last.alias("_last"))
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    gaps = cells.where(F.col("_t").isNull()).select(*key, "_cell").distinct()
    within = Window.partitionBy(*key, "_cell").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    # only blocks that have a frame without a time
    looked = cells.join(gaps, [*key, "_cell"], "left_semi").withColumn("_seen", F.last("_t", ignorenulls=True).over(within)).where(F.col("_t").isNull())
    found = looked.join(carried, [*key, "_cell"], "left").select(*key, "frame_no", F.coalesce("_seen", "_carried").alias("_seen"))
    rest = df.where(other).join(found, [*key, "frame_no"], "left").join(base, key, "left").withColumn("rel_ns", F.coalesce(F.col("_seen") - F.col("_base"), F.lit(0).cast("bigint")))
    return done.select(*frames.columns, "rel_ns").union(rest.select(*frames.columns, "rel_ns"))


def start_time(frames: DataFrame) -> DataFrame:
    """ts_ns of the first frame that has a time."""
    return frames.where("ts_ns <> 0").agg(F.min_by("ts_ns", "frame_no").alias("ts_ns"))


def with_community_id(frames: DataFrame, seed: int = 0) -> DataFrame:
    return _ready(frames).withColumn("community_id", community_id(seed))


def capture_stats(frames: DataFrame, passed: Column) -> DataFrame:
    """received, passed, filtered."""
    return frames.agg(F.count("*").alias("received"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("filtered"))
