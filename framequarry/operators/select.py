"""Filters applied to frames: the cheapest plan that a filter needs.

Conditions on header columns come first and stay in generated code; only rows they let through are dissected, and
only the layers that names in the filter ask for; TCP state costs one shuffle of ten numbers a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.dissect.engine import default_registry, dissect
from framequarry.functions.community import community_id
from framequarry.operators.headers import COLUMNS, verified, with_headers
from framequarry.operators.tcp_state import tcp_analysis_full
from framequarry.plans.filters import STATE_FLAGS, Aliases, And, Compare, Exists, Not, Or, compile_filter, conjuncts, parse

_CHEAP = frozenset(["headers"])
#: Fields that are columns of a capture, not of its frames' headers.
_STORED = frozenset(["frame.number", "frame.len", "frame.cap_len"])


def with_spellings(aliases: Aliases | None, registry=None) -> Aliases:
    """The caller's aliases before those that come with the registry's decoders."""
    out = Aliases()
    for name, to in (registry or default_registry()).aliases:
        out.add(name, to)
    for own in (aliases,) if aliases else ():
        out.expressions.update(own.expressions)
        out.fields.update(own.fields)
    return out


def field_names(node: object) -> set[str]:
    """The names that a filter's tree speaks of."""
    if isinstance(node, (And, Or)):
        return field_names(node.a) | field_names(node.b)
    if isinstance(node, Not):
        return field_names(node.a)
    return {node.ref.name} if isinstance(node, (Exists, Compare)) else set()


def _prepared(df: DataFrame, needs: set[str], registry, wanted: frozenset[str] | None) -> DataFrame:
    if "checksums" in needs:
        df = verified(df)
    if "community" in needs:
        df = df.withColumn("community_id", community_id())
    if "state" in needs:
        df = tcp_analysis_full(df)
    if "fields" in needs and "d" not in df.columns:
        df = dissect(df, registry, wanted)
    return df


def display_filter(frames: DataFrame, expr: str, dialect: str = "display", registry=None, keep_tree: bool = False, **options) -> DataFrame:
    """The frames that a filter matches, with the columns they came with; keep_tree adds d (and dissects if need be).

    options: aliases, providers, symbols, compat, as for the filter's binder. TCP state is built from all frames, as
    packets that a filter drops still moved it; so nothing is filtered before that.
    """
    options["aliases"] = with_spellings(options.get("aliases"), registry)
    node = parse(expr, dialect, options.get("aliases"))
    options["fields_column"] = "d.fields"
    parts = [compile_filter(n, dialect, **options) for n in conjuncts(node)]
    columns = frames.columns
    df = frames if "l4_off" in columns else with_headers(frames)
    needs = set().union(*(p.needs for p in parts)) | ({"fields"} if keep_tree else set())
    if "state" not in needs:
        stored = [p for p in parts if p.needs <= _CHEAP and field_names(p.node) <= _STORED]
        if stored and df is not frames:  # conditions on stored columns stay below the headers, where they reach the scan
            df = frames
            for p in stored:
                df = df.where(p.column)
            df = with_headers(df)
            parts = [p for p in parts if not any(p is q for q in stored)]
        for p in parts:
            if p.needs <= _CHEAP:
                df = df.where(p.column)
        parts = [p for p in parts if not p.needs <= _CHEAP]
    wanted = None if keep_tree else frozenset(field_names(node))
    df = _prepared(df, needs, registry, wanted)
    for p in parts:
        df = df.where(p.column)
    extra = [c for c in COLUMNS if c not in columns] + [f"a_{k}" for k in STATE_FLAGS] + ["ip_checksum_bad", "l4_checksum_bad", "community_id", "matched"]
    df = df.drop(*(c for c in extra if c not in columns))
    return df if keep_tree or "d" in columns else df.drop("d")


def match_filters(frames: DataFrame, exprs: list[str], dialect: str = "display", registry=None, **options) -> DataFrame:
    """frames with m0, m1, ...: whether each filter matches. One pass and one dissection for all of them.

    A filter that does not parse raises FilterSyntaxError.
    """
    options["aliases"] = with_spellings(options.get("aliases"), registry)
    nodes = [parse(e, dialect, options["aliases"]) for e in exprs]
    options["fields_column"] = "d.fields"
    got = [compile_filter(n, dialect, **options) for n in nodes]
    df = frames if "l4_off" in frames.columns else with_headers(frames)
    needs = set().union(*(c.needs for c in got))
    df = _prepared(df, needs, registry, frozenset().union(*(field_names(n) for n in nodes)))
    return df.withColumns({f"m{i}": c.column for i, c in enumerate(got)})


def limit_after(frames: DataFrame, expr: str, n: int, dialect: str = "capture", **options) -> DataFrame:
    """The first n frames that a filter matches."""
    return display_filter(frames, expr, dialect, **options).orderBy("frame_no").limit(n)


def filter_columns(exprs: dict[str, str], dialect: str = "display", **options) -> dict[str, F.Column]:
    """Named conditions as columns over header columns, for io_graph()."""
    return {k: compile_filter(e, dialect, **options).column for k, e in exprs.items()}
