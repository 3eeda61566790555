"""Community ID version 1 of a flow, as the public specification has it, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framequarry.functions.bits import to_bytes

#: Protocols whose ports take part (fixed values: TCP, UDP, DCCP, SCTP).
WITH_PORTS = (6, 17, 33, 132)


def community_id(seed: int = 0, src: str = "ip_src", dst: str = "ip_dst", proto: str = "l4_proto", sport: str = "sport", dport: str = "dport") -> Column:
    """`1:` and the base64 of SHA-1 over seed, lower and higher end, protocol and ports; null without addresses."""
    s, d, p = F.col(src), F.col(dst), F.col(proto)
    ports = p.isin(*WITH_PORTS) & F.col(sport).isNotNull()
    sp, dp = (F.coalesce(F.when(ports, F.col(x)), F.lit(0)) for x in (sport, dport))
    forward = (s < d) | ((s == d) & (sp <= dp))
    head = F.concat(F.lit(seed.to_bytes(2, "big")), F.when(forward, s).otherwise(d), F.when(forward, d).otherwise(s), to_bytes(p, 1), F.lit(b"\0"))
    tail = F.when(ports, F.concat(F.when(forward, to_bytes(sp, 2)).otherwise(to_bytes(dp, 2)), F.when(forward, to_bytes(dp, 2)).otherwise(to_bytes(sp, 2)))).otherwise(F.lit(b""))
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.concat(head, tail)))))
