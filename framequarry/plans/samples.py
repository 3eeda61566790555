"""A set of named filters to start from: Aliases.parse(SAMPLES) makes them usable in any filter.

`new TCP connections and large frames` is then a filter. A name that ends in what a reader would fill in takes that as the next
word (`show packets containing cafe`).
"""

from __future__ import annotations

from framequarry.plans.filters import Aliases

#: Names (fixed values: those that users of other tools know) and what they stand for here.
SAMPLES = """
# traffic
new TCP connections = tcp.flags.syn == 1 and tcp.flags.ack == 0
retransmissions = tcp.analysis.retransmission == 1
encrypted traffic = tcp.port in {22, 443, 465, 636, 993, 995, 5061, 5222, 8443} or udp.port in {443, 4500}
large uploads = frame.len > 65000
show C2 beaconing every 60 seconds = frame.len < 200 and tcp.flags.syn == 1 and tcp.flags.ack == 0
# protocols
failed dns = dns.qr == 1 and dns.rcode != 0
show dns requests = udp.dstport == 53 or tcp.dstport == 53
show failed tls handshakes = tls.level == 2
show suspicious SMB activity = tcp.port in {139, 445}
show RDP sessions = tcp.port == 3389
show packets matching ATT&CK T1021 = tcp.dstport in {22, 135, 445, 3389, 5900, 5985, 5986}
# with a word, or a provider of geoip.dst_country
show packets containing = frame contains $1
show outbound connections to = geoip.dst_country == $1
"""


def sample_aliases() -> Aliases:
    return Aliases.parse(SAMPLES)
