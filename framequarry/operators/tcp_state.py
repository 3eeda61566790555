"""TCP analysis with the state of both directions: a grouped map in batch, a stateful operator in streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators.headers import capture_columns, with_headers
from framequarry.plans.filters import STATE_FLAGS

_MOD, _HALF = 1 << 32, 1 << 31


def serial(a: int, b: int) -> int:
    """a - b modulo 2**32, as a signed number."""
    return (a - b + _HALF) % _MOD - _HALF


@dataclass
class Side:
    """What is known of one direction."""

    isn: int = -1  # -1: no SYN seen
    top: int = 0  # the highest sequence number seen, plus one
    acked: int = -1  # -1: no ACK yet
    window: int = 0
    dups: int = 0
    zero: bool = False
    probe: bool = False  # a window probe awaits its answer
    keep: bool = False  # the other side's keep-alive awaits an answer

    def closed(self) -> None:
        """A reset: everything but the last acknowledgement is forgotten."""
        self.isn, self.top, self.dups, self.zero, self.probe, self.keep = -1, 0, 0, False, False, False


def advance(me: Side, other: Side, flags: int, seq: int, ack: int, win: int, size: int) -> dict[str, int]:
    """Takes one packet of direction `me`; the flags that it earns (those of STATE_FLAGS that are not 0)."""
    fin, syn, rst, has_ack = flags & 1, flags & 2, flags & 4, flags & 16
    out: dict[str, int] = {}
    if rst:
        me.closed()
        return out
    if syn:
        if me.isn == seq:
            out["retransmission"] = 1
        else:
            me.isn, me.top = seq, (seq + 1) % _MOD
        if has_ack:
            me.acked = ack
        me.window = win
        return out
    me.zero = win == 0
    if me.zero:
        out["zero_window"] = 1
    known = me.isn >= 0
    bare = bool(has_ack) and size == 0 and not fin
    if size == 1 and other.zero and known:
        out["zero_window_probe"] = 1
        me.probe = True
    answered = False
    if bare and me.zero and other.probe:
        out["zero_window_probe_ack"] = 1
        other.probe, answered = False, True
    if not fin and size <= 1 and known and other.acked >= 0 and seq == (other.acked - 1) % _MOD:
        out["keep_alive"] = 1
        other.keep = True
    if bare and me.keep:
        out["keep_alive_ack"] = 1
        me.keep, answered = False, True
    if has_ack:
        further = me.acked < 0 or serial(ack, me.acked) > 0
        if bare and not answered:
            if further:
                me.dups = 0
            elif win == me.window:
                me.dups += 1
                out["duplicate_ack"], out["duplicate_ack_num"] = 1, me.dups
            else:
                out["window_update"] = 1
                me.dups = 0
        elif not bare:
            me.dups = 0
        if further:
            me.acked = ack
        me.window = win
    if (size or fin) and known:
        end = (seq + size + (1 if fin else 0)) % _MOD
        ahead = serial(seq, me.top)
        if ahead < 0:
            if serial(end, me.top) <= 0:
                out["retransmission"] = 1
                if other.acked >= 0 and serial(other.acked, seq) > 0:
                    out["spurious_retransmission"] = 1
                if other.dups >= 3:
                    out["fast_retransmission"] = 1
            else:
                out["out_of_order"] = 1
                me.top = end
        else:
            if ahead > 0:
                out["lost_segment"] = 1
            me.top = end
    if known and other.acked >= 0:
        out["bytes_in_flight"] = max(0, serial(me.top, other.acked))
    return out


_COLUMNS = [f"a_{k}" for k in STATE_FLAGS]
_NEEDED = ["ip_src", "ip_dst", "sport", "dport", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_win"]


def _sent() -> F.Column:
    """Bytes of data that a segment has by its IP length, captured or not; where that says nothing, those that were captured."""
    told = F.col("l3_off") + F.col("ip_len") - F.col("pay_off")
    return F.when(F.col("ip_len") > F.col("ip_ihl"), F.greatest(F.lit(0), told)).otherwise(F.col("pay_len")).alias("pay_len")


def _key() -> F.Column:
    a, b = F.struct(F.col("ip_src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("ip_dst").alias("ip"), F.col("dport").alias("port"))
    return F.concat(F.hex(F.least(a, b)["ip"]), F.lit("/"), F.least(a, b)["port"].cast("string"), F.lit("/"), F.hex(F.greatest(a, b)["ip"]), F.lit("/"), F.greatest(a, b)["port"].cast("string"))


def flags_by_frame(frames: DataFrame) -> DataFrame:
    """file (if frames has it), frame_no and a column a_<flag> for each of STATE_FLAGS, of every TCP frame.

    A conversation is one of one file, in frame order. Only the ten numbers that matter are shuffled, sorted within a conversation, and read in batches with a state of a
    few numbers per conversation: a conversation of any length needs no more memory than a batch.
    """
    df = frames if "l4_off" in frames.columns else with_headers(frames)
    own = capture_columns(df)
    slim = df.where(F.col("tcp_seq").isNotNull()).select(_key().alias("k"), "frame_no", *_NEEDED, _sent(), *own)
    dealt = slim.repartition(*own, "k").sortWithinPartitions(*own, "k", "frame_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, {}
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            out: list[list[int]] = [[] for _ in STATE_FLAGS]
            for k, _, src, dst, sp, dp, flags, seq, ack, win, size, *file in zip(*rows, strict=True):
                if (k, file) != key:
                    key, sides = (k, file), {}
                me, other = sides.setdefault((src, sp), Side()), sides.setdefault((dst, dp), Side())
                got = advance(me, other, flags, seq, ack, win, size)
                for i, f in enumerate(STATE_FLAGS):
                    out[i].append(got.get(f, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[11:], b.column(1), *(pa.array(x, pa.int64()) for x in out)], names=[*own, "frame_no", *_COLUMNS])

    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in own), "frame_no bigint", *(f"{c} bigint" for c in _COLUMNS)]))


def tcp_analysis_full(frames: DataFrame) -> DataFrame:
    """frames with a_<flag> columns (0 for what is not TCP). Where the frames themselves are not wanted, flags_by_frame() spares the join."""
    own = capture_columns(frames)
    flags = flags_by_frame(frames).withColumnsRenamed({c: f"_{c}" for c in (*own, "frame_no")})
    same = F.col("frame_no") == F.col("_frame_no")
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    # merged, not broadcast: what an optimiser knows of the flags' size is no more than that of the table they come from
    return frames.join(flags.hint("merge"), same, "left").drop("_frame_no", *(f"_{c}" for c in own)).fillna(0, _COLUMNS)


def stateful_analysis(frames: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The same flags in a stream: file (if frames has it), frame_no and the a_<flag> columns; a conversation's state ends after `idle` without packets."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    df = frames if "l4_off" in frames.columns else with_headers(frames)
    own = capture_columns(df)
    slim = df.where(F.col("tcp_seq").isNotNull()).select(_key().alias("k"), "frame_no", *_NEEDED, _sent(), *own)
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    fields = list(Side.__dataclass_fields__)
    state_schema = "ends string, " + ", ".join(f"{x}_{f} bigint" for x in "ab" for f in fields)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sides: dict[str, Side] = {}
        if state.exists:
            ends, *values = state.get
            n = len(fields)
            for i, end in enumerate(ends.split("|")):
                sides[end] = Side(*(bool(v) if f in ("zero", "probe", "keep") else int(v) for f, v in zip(fields, values[i * n : (i + 1) * n], strict=True)))
        out = []
        rows = pd.concat(list(parts)).sort_values("frame_no")
        for r in rows.itertuples(index=False):
            here, there = f"{bytes(r.ip_src).hex()}/{r.sport}", f"{bytes(r.ip_dst).hex()}/{r.dport}"
            got = advance(sides.setdefault(here, Side()), sides.setdefault(there, Side()), r.tcp_flags, r.tcp_seq, r.tcp_ack, r.tcp_win, r.pay_len)
            out.append([*key[1:], r.frame_no, *(got.get(f, 0) for f in STATE_FLAGS)])
        pairs = list(sides.items())[:2]
        while len(pairs) < 2:
            pairs.append((pairs[0][0], pairs[0][1]))
        state.update(("|".join(e for e, _ in pairs), *(int(getattr(s, f)) for _, s in pairs for f in fields)))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=[*own, "frame_no", *_COLUMNS])

    schema = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in own), "frame_no bigint", *(f"{c} bigint" for c in _COLUMNS)])
    return slim.groupBy("k", *own).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)
