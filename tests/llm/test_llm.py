"""The text operators against brute force, round trips and held-out labels, and on odd input."""

import collections
import functools
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequarry.llm import bottomk, bpe, common, decontaminate, fourier_quality, kneser_ney, ppm, repeats, tagpaths, tokenfiles, topk

try:
    import public_tokenizers as tokenizers_home
except ImportError:
    tokenizers_home = None
with_tokenizers = pytest.mark.skipif(tokenizers_home is None, reason="no vocabulary files here")

DOCS = "doc_id bigint, text string, lang string, extra int"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(rng, n, vocabulary=400):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, edited copies, shared passages, nulls, empties, one long text, repeated rows."""
    rng = np.random.default_rng(5)
    passage = " ".join(words(rng, 60))
    base = words(rng, 150)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(rng, int(rng.integers(3, 120)))), "en", 1))
    for i in range(60, 120):  # a large group of edited copies
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(10000)}"
        rows.append((i, " ".join(w), "en", 1))
    for i in range(120, 150):
        rows.append((i, f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 15))}", None, 1))
    for i in range(150, 156):
        rows.append((i, rows[3][1], "en", None))
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, "  \n\t ", None, 1), (203, "one two", "en", 1), (204, "One TWO", "en", 1), (205, " ".join(words(rng, 30000)), "en", 1)]
    rows += [(3, rows[3][1], "en", 1), (206, "É été ÀB à x 　 z\u0000y", "fr", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 9: near duplicates --------------------------------------------------------------------------------


def brute_components(corpus, percent=85, k=5):
    sets = {}
    for n, (_, t, *_rest) in enumerate(corpus):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[n] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            i = len(sets[a] & sets[b])
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    low = {}
    for n in sets:
        low[find(n)] = min(low.get(find(n), 1 << 60), corpus[n][0])
    return sorted((corpus[n][0], len(sets[n]), low[find(n)]) for n in sets)


@pytest.mark.parametrize("hot", [4, 32, 1000])
def test_near_duplicates_match_brute_force(docs, corpus, hot):
    got = sorted((r.id, r.n, r.component) for r in bottomk.near_duplicates(docs, percent=85, hot=hot).collect())
    assert got == brute_components(corpus)


@pytest.mark.parametrize("hot", [4, 32])
def test_near_duplicates_with_a_union_just_over_the_sketch(spark, hot):
    rows = []
    for i in range(40):  # 64 to 70 words, one in the middle changed: sets of up to k with a union of more
        n = 64 + i % 7
        w = [f"p{i}w{j}" for j in range(n)]
        rows += [(2 * i, " ".join(w), "en", 1), (2 * i + 1, " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]]), "en", 1)]
    got = sorted((r.id, r.n, r.component) for r in bottomk.near_duplicates(spark.createDataFrame(rows, DOCS), percent=85, hot=hot).collect())
    assert got == brute_components(rows)


def test_near_duplicates_of_nothing_and_nulls(spark):
    assert bottomk.near_duplicates(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "x", 1), (7, "a b c d e f", "x", 1), (None, "solo text", "x", 1)], DOCS)
    got = sorted(((r.id, r.component) for r in bottomk.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (None, None)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(20)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    from framequarry.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{50 + i: 50 for i in range(20)}, 100: 50, 200: 200, 201: 200}


@pytest.mark.parametrize("one_task", [0, 5, 1 << 18])
def test_components_by_steps_and_by_one_task(spark, monkeypatch, one_task):
    from framequarry.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (130, 2))] + [(i + 1, i) for i in range(1000, 1030)] + [(None, 3), (4, 4)]
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == low
    assert components.connected_components(df.where("a is null")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    from framequarry.llm.components import connected_components

    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        assert {r.component for r in connected_components(edges).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("limit", [0, 4 << 20])
def test_near_duplicates_of_repeated_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(bottomk, "BROADCAST_BYTES", limit)  # 0: joined by shuffles
    monkeypatch.setattr(bottomk, "SKETCH_BYTES", limit)
    rng = np.random.default_rng(8)
    base, rows = words(rng, 100), []
    for i in range(25):  # edited copies of one text, beyond `hot`, most rows thrice
        w = list(base)
        for at in rng.integers(0, 100, i % 4):
            w[at] = f"e{i}"
        rows += [(i, " ".join(w), "en", 1)] * (3 if i % 5 else 1)
    rows += [(7, "another text under an id that is taken already", "en", 1)] * 2 + [(40, None, "en", 1)]
    got = sorted((r.id, r.n, r.component) for r in bottomk.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), percent=85, hot=4).collect())
    assert got == brute_components(rows)


def test_near_duplicates_leave_one_work_table(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(common, "work_dir", lambda s, label, f=common.work_dir: made.append(f(s, label)) or made[-1])
    got = bottomk.near_duplicates(docs, percent=85)
    there = [p for p in made if (h := common._hadoop_path(spark, p))[1].exists(h[0])]
    assert there == [got._fq_stash]
    common.drop(got)


def test_near_duplicates_keep_a_task_for_each_partition_of_the_last_join(spark, docs):
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = bottomk.near_duplicates(docs, percent=85)
        assert len(got.inputFiles()) > 2 * spark.sparkContext.defaultParallelism  # one task's hashed joins would add up
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sketches_whose_upper_halves_agree_by_chance(spark):
    a = [1, 2, 3, *(i << 32 for i in range(1, 17)), 90 << 32]
    b = [*a[:-1], 91 << 32]  # 19 of 21 in common, of which three agree in their upper 32 bits
    reps = spark.createDataFrame([(1, 20, 1, a), (2, 20, 2, b)], "id bigint, n bigint, f1 bigint, sketch array<bigint>")
    m = bottomk._Matcher(empty(spark), reps, 5, 85, 64, "doc_id", "text")
    assert [tuple(r) for r in m.estimated(spark.createDataFrame([(1, 2)], "a bigint, b bigint")).collect()] == [(1, 2)]


def test_near_duplicate_stage_takes_similarity_from_80_percent(spark):
    import corpus_pipeline

    w = [f"s{j}" for j in range(60)]
    texts = [w, [*w[:30], "changed", *w[31:]], [*w[:20], "one", *w[21:40], "two", *w[41:]]]  # 51 of 61 shingles, 46 of 66 with the first
    docs = spark.createDataFrame([(i, " ".join(t), "en", "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


# ---- 4: repeats ----------------------------------------------------------------------------------------


def brute_repeats(corpus, length):
    first = {}
    for i, t, *_ in corpus:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, 1 << 60), i)
    out = []
    for i, t, *_ in corpus:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                m[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_kept(corpus, length):
    """The texts that are left, by id (ids are unique here)."""
    first = {}
    for i, t, *_ in corpus:
        b = t.encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], 1 << 60), i)
    out = {}
    for i, t, *_ in corpus:
        b = t.encode()
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                m[p : p + length] = b"\1" * length
        out[i] = bytes(x for x, y in zip(b, m, strict=True) if not y).decode()
    return out


@pytest.mark.parametrize(("length", "chunk", "hot"), [(50, 1 << 22, 64), (50, 3000, 64), (50, 3000, 2), (12, 3000, 64), (12, 3000, 1)])
def test_repeats_match_brute_force(docs, corpus, monkeypatch, length, chunk, hot):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    here = repeats.__dict__.copy()
    monkeypatch.setattr(repeats, "shared_minimisers", functools.partial(here["shared_minimisers"], hot=hot))
    got = repeats.remove_repeats(docs, length, k=max(4, length // 2))
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(corpus, length)


def test_repeats_keep_columns_and_text(docs, corpus):
    got = repeats.remove_repeats(docs, with_text=True, keep=("extra", "lang")).collect()
    assert sorted((r.doc_id, r.extra or 0, r.lang or "") for r in got) == sorted((i, x or 0, y or "") for i, _, y, x in corpus)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_shuffle_texts_once(docs, corpus):
    got = repeats.remove_repeats(docs, with_text=True, keep=("extra",))
    assert len(got.collect()) == len(corpus)
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_repeats_of_nothing_and_nulls(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0
    t = "z" * 80
    rows = spark.createDataFrame([(None, t, "x", 1), (2, t, "x", 1), (1, t + "q", "x", 1)], DOCS)
    assert {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(rows).collect()} == {(None, 0), (2, 80), (1, 0)}


def test_interval_tree():
    text = np.frombuffer(b"banana$ananas$", np.uint8)
    start = np.arange(13)
    end = np.where(start < 7, 6, 13)
    order, lcp = repeats.suffix_order(text, start, end)
    suffixes = [bytes(text[s:e]) for s, e in zip(start[order], end[order], strict=True)]
    assert suffixes == sorted(suffixes)
    want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in itertools.pairwise(suffixes)]
    assert lcp.tolist() == want
    value = np.random.default_rng(1).permutation(13)
    found = repeats.intervals(lcp, 1, value)
    assert len(found) == len(set(found)) > 3
    for a, b, depth, low in found:
        assert min(lcp[a + 1 : b + 1]) == depth and low == min(value[a : b + 1])
        assert (a == 0 or lcp[a] < depth) and (b == len(lcp) - 1 or lcp[b + 1] < depth)


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 22, 64), (400, 64), (400, 1)])
def test_maximal_repeats(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "shared_minimisers", functools.partial(repeats.shared_minimisers, hot=hot))
    rng = np.random.default_rng(8)
    p, q = " ".join(words(rng, 60)), " ".join(words(rng, 9))
    texts = [f"aa {p} bb", f"cc {p} dd {q}", f"ee {p[:55]}", f"{q} mid {p[40:200]} {q}", *(" ".join(words(rng, 30)) for _ in range(8)), f"x{q}y{q}z"]
    once = " ".join(words(rng, 50))
    texts += [f"one {once} up", f"two!{once}, down"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = repeats.maximal_repeats(docs, 20, k=8).collect()
    where = lambda w: sorted((i, m.start()) for i, t in enumerate(texts) for m in re.finditer(f"(?={re.escape(w)})", t))
    groups = {}
    for r in got:
        o = [(x.id, x.start) for x in r.occurrences]
        w = texts[o[0][0]][o[0][1] : o[0][1] + r.size]
        assert o == where(w) and len(o) > 1 and w not in groups and w.startswith(bytes(r.text).decode())
        groups[w] = o
    around = lambda o, d: {texts[i][s + d : s + d + 1] if s + d >= 0 else f"start{i}" for i, s in o}
    windows = {t[s : s + 20] for t in texts for s in range(len(t) - 19)}
    for w in windows:
        o = where(w)
        if len(o) > 1:  # each repeated window is part of a repeat with the same occurrences
            assert any(len(g) == len(o) and w in v for v, g in groups.items())
    for w, o in groups.items():  # nothing more on either side, unless what follows or precedes occurs elsewhere too
        left, right = around(o, -1), around(o, len(w))
        assert len(left) > 1 or len(where((left.pop() + w)[:20])) > len(o)
        assert len(right) > 1 or right == {""} or len(where((w + right.pop())[-20:])) > len(o)
    assert groups[once] == [(13, 4), (14, 4)]


# ---- 2: decontamination --------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination_matches_brute_force(spark, docs, corpus):
    texts = dict((i, t) for i, t, *_ in corpus)
    passage = texts[120].split()
    items = [(1, " ".join(passage[25:45]), 0), (2, "ONE two", 0), (3, None, 0), (4, "!!!", 0), (10, " ".join(passage[30:41]), 0), (2, "one, two", 0), (5, "never seen words at all in there", 0), (None, "solo", 0), (6, "É été", 0), (7, "É ÉTÉ", 0)]
    bench = spark.createDataFrame(items, "item_id bigint, text string, extra int")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
    want = collections.Counter()
    for i, t, *_ in corpus:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for item, text, _ in items:
            iw = WORD.findall(lower(text))
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        if item is not None:
                            ids.add(str(item))
        want[i, len(w), len(hit), tuple(sorted(ids))] += 1
    assert got == want


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), none).count() == 0


def test_decontamination_is_native(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    plan = decontaminate.contamination(docs.where("doc_id < 0"), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "a x b y c", "", 1), (2, "a b c", "", 1), (3, "a x x x x x x b c", "", 1)], DOCS)
    q = spark.createDataFrame([(9, "c a b")], "query_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.proximity_matches(rows, q, 4).collect())
    assert got == [(9, 1, 0, 4), (9, 2, 0, 2)]


def test_proximity_of_repeated_words(spark):
    rng = np.random.default_rng(6)
    texts = ["b a x b c", *(" ".join(rng.choice(list("abcxyz"), 25)) for _ in range(12))]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], DOCS)
    got = {tuple(r) for r in decontaminate.proximity_matches(docs, spark.createDataFrame([(9, "a b c")], "query_id bigint, text string"), 3).collect()}
    holds = lambda w, f, e: set("abc") <= set(w[f : e + 1])
    every = {(9, i, f, e) for i, t in enumerate(texts) for w in [t.split()] for f in range(len(w)) for e in range(f, min(f + 4, len(w))) if holds(w, f, e)}
    least = {(q, i, f, e) for q, i, f, e in every for w in [texts[i].split()] if not holds(w, f + 1, e) and not holds(w, f, e - 1)}
    assert (9, 0, 1, 4) in got and least <= got <= every


# ---- 5: top k ------------------------------------------------------------------------------------------


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], 0) for i in range(200)]
    rows += [(i, [0.5] * 6, 0) for i in range(200, 260)] + [(300, None, 0), (301, [None] * 6, 0), (302, [float("nan")] * 6, 0), (303, [1.0, 2.0], 0), (350, [0.0] * 6, 0), (400, [float("inf")] * 6, 0), (450, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(3)
    q = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i, v in q.items():
        if i % 50 == 0:
            s = sorted((-int(v @ w), j) for j, w in q.items() if j != i and len(w) == len(v))[:5]
            want |= {(i, r, j, -x) for r, (x, j) in enumerate(s, 1)}
    got = topk.search(df, F.col("id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    X = rng.integers(-100, 100, (4000, 3))
    X[77] = 1000
    _, scores, depth = topk.SortedLists(np.arange(4000), X).search(np.array([5.0, 3.0, 1.0]), -1, 1)
    assert depth < 4000 and scores[0] == 9000


# ---- 7 and 8: tokens -----------------------------------------------------------------------------------

ODD = ["", None, "it's I'll 've don''t", "a\tb\n\n  c \r\n d", "x" * 3000, " " * 500, "é‘’“”—  ½ ² ª 東京 🙂", "<|endoftext|> <|endoftext|>", "a  ,b ;  1 2.5%%% ### ok", "\n\n\n"]


def odd_docs(spark, corpus):
    return spark.createDataFrame([*corpus, *((1000 + i, t, None, 1) for i, t in enumerate(ODD))], DOCS).repartition(3)


@with_tokenizers
def test_bpe_is_the_library_and_round_trips(spark, corpus):
    import tiktoken

    path = tokenizers_home.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=tokenizers_home.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    df = odd_docs(spark, corpus)
    ids = bpe.encode(df, path, tokenizers_home.PATTERN)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    assert got == collections.Counter((i, tuple(e.encode_ordinary(t))) for i, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(ids, path, tokenizers_home.PATTERN).collect()) == collections.Counter((i, t.encode()) for i, t in rows)
    assert bpe.round_trip(empty(spark), path, tokenizers_home.PATTERN).count() == 0


@with_tokenizers
def test_pieces_are_safe():
    import regex

    p = regex.compile(tokenizers_home.PATTERN)
    for t in ODD:
        if t:
            assert [m for x in bpe.safe_pieces(t) for m in p.findall(x)] == p.findall(t)


@with_tokenizers
def test_token_files(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers_home.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert 50256 in t.encode("x <|endoftext|> y", add_special_tokens=False).ids
    df = odd_docs(spark, corpus)
    manifest = tokenfiles.write_token_files(df, path, f"file://{tmp_path}/tok", seq_len=64, rows=8, partitions=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_documents(manifest).collect())
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: r[0])
    at, stream, want = 0, [], []
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
        stream.append(ids)
    key = lambda r: (r[1], r[2], r[3])  # noqa: E731  rows of one id may come in either order
    assert sorted(map(key, got)) == sorted(map(key, want)) and [r[0] for r in got] == [r[0] for r in want]
    files = manifest.orderBy("part").collect()
    back = []
    for f in files:
        n = -(-f.n_tokens // 64)
        for i in range(n):
            ids, mask = tokenfiles.read_sequence(f.data, i)
            assert len(ids) == 64 and mask.true_count == min(64, f.n_tokens - 64 * i)
            back.append(ids[: mask.true_count])
    assert sorted(np.concatenate(back).tolist()) == sorted(np.concatenate(stream).tolist())
    assert tokenfiles.read_documents(tokenfiles.write_token_files(empty(spark), path)).count() == 0


@with_tokenizers
def test_tasks_that_write_token_files_write_no_table(spark, corpus):
    df = odd_docs(spark, corpus)
    manifest = tokenfiles.write_token_files(df, tokenizers_home.path("byte_bpe_50k.json"), partitions=5)
    rows = manifest.collect()
    assert len(rows) == 5 and sorted(r.part for r in rows) == list(range(5)) and len(manifest.inputFiles()) == 1
    assert sum(r.n_docs for r in rows) == df.count() == tokenfiles.read_documents(manifest).count()
    assert [r.first_doc for r in sorted(rows)] == sorted(r.first_doc for r in rows)


# ---- 3: languages --------------------------------------------------------------------------------------

LANGS = {"en": "the and of to in that it is was for on are with as his they be at", "de": "der und die das nicht von sie ist des sich mit dem dass er es ein", "es": "el la de que y en un ser se no haber por con su para como"}


def language_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang].split(), int(rng.integers(4, 60)))), lang, 1))
    return rows


def test_language_held_out(spark):
    rows = [*language_rows(), (900, None, "en", 1), (901, "", None, 1), (902, "12 34 !!", "en", 1), (903, "the and of", None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    model = ppm.train(df, ~common.held_out("doc_id"))
    got = {r.doc_id: r for r in ppm.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows[:240]]) > 0.99
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in ppm.predict(df, ppm.train(empty(spark), F.lit(True))).collect()} == {"und"}


def test_code_lengths_are_exact():
    texts = {"a": b"abracadabra banana", "b": b"bandana cab"}
    counts = [[collections.Counter(int.from_bytes(bytes([n]) + t[i : i + n], "big") for i in range(len(t) - n + 1)) for t in texts.values()] for n in (1, 2, 3)]
    m = ppm.Model(list(texts), [[dict(c) for c in level] for level in counts])
    probe = b"banabracab xyz"
    got = m.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0]

    def cost(text, i, n):
        if n < 0:
            return 8.0
        ctx = probe[i - n : i]
        follow = collections.Counter(text[j + n] for j in range(len(text) - n) if text[j : j + n] == ctx)
        if not follow:
            return cost(text, i, n - 1)
        total = sum(follow.values()) + len(follow)
        if probe[i] in follow:
            return -np.log2(follow[probe[i]] / total)
        return -np.log2(len(follow) / total) + cost(text, i, n - 1)

    want = [sum(cost(t, i, min(i, 2)) for i in range(len(probe))) for t in texts.values()]
    assert np.allclose(got, want, rtol=1e-5)


# ---- 6 and 10: classifiers ------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = np.random.default_rng(9)
    stems = ["vukk", "zarg", "plomt"]
    docs, labels = [], []
    for i in range(n):
        w = words(rng, int(rng.integers(20, 150)), 200)
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(5):
                w[int(rng.integers(len(w)))] = rng.choice(stems) + f"{rng.integers(30)}"
        t = " ".join(w)
        docs.append((i, t.upper() + "!!! $$$" * 5 if bad else t, "en", 1))
        labels.append((i, int(not bad), int(toxic), 5))
    labels += [(10_000, 1, 1, 5), (None, 1, 0, 5), (5, None, None, 5)]
    docs += [(9000, None, "en", 1), (9001, "", "en", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, extra int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    feats = fourier_quality.features(docs)
    model = fourier_quality.train(feats, labels, ~common.held_out("doc_id"))
    got = fourier_quality.score(feats, model).join(labels, "doc_id").where(common.held_out("doc_id")).collect()
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in got if r.quality is not None]) > 0.97
    every = fourier_quality.score(feats, model).collect()
    assert len(every) == 602 and all(0 <= r.score <= 1 for r in every)
    assert {r.score for r in fourier_quality.score(feats, fourier_quality.train(feats, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_quality_does_not_change_with_the_sample(spark):
    rng = np.random.default_rng(4)
    stats = rng.normal(size=(12000, fourier_quality.N_STATS))
    y = (rng.random(12000) < 1 / (1 + np.exp(-1.2 * stats[:, 0] - 2))).astype(int)
    ids = np.arange(12000)
    feats = spark.createDataFrame(pa.table({"doc_id": ids, "stats": list(stats)}))
    labels = spark.createDataFrame(pa.table({"doc_id": ids, "quality": pa.array(y, pa.int32())}))
    scores = []
    for cap in (20000, 1500):  # all rows; both classes thinned, each at its own rate
        model = fourier_quality.train(feats, labels, F.lit(True), per_class=cap)
        scores.append(model.score(stats))
    assert min(y.sum(), len(y) - y.sum()) > 1500
    assert abs(scores[0].mean() - y.mean()) < 0.03 and abs(scores[1].mean() - y.mean()) < 0.03
    assert np.mean((scores[0] >= 0.3) != (scores[1] >= 0.3)) < 0.05


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = kneser_ney.train(docs, labels, ~common.held_out("doc_id"))
    got = kneser_ney.score(docs, model).join(labels, "doc_id").where(common.held_out("doc_id")).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got if r.toxic is not None]) > 0.95
    every = kneser_ney.score(docs, model).collect()
    assert len(every) == 602 and all(0 <= r.score <= 1 for r in every)
    assert {r.score for r in kneser_ney.score(docs, kneser_ney.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_isotonic():
    begin, end, value = fourier_quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    assert begin.tolist() == [0, 1, 3] and end.tolist() == [0, 2, 5] and np.allclose(value, [0, 1 / 2, 2 / 3])


# ---- 1: pages -------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A title</h1><p>First &amp; second,\n  third.<p>Short.<script>var a='<p>no</p>'</script></article><aside>Ads</aside><footer>&copy; me</footer>", "A title\nFirst & second, third.\nShort."),
    ("<body><div class='header'>Menu</div><div id=content><p>A long paragraph, with words; and marks. More of it, here.</p><p>Tiny.</p><form><p>Sign up, please, now.</p></form></div><div class=comments><p>I, reader, think so. And so.</p></div></body>", "A long paragraph, with words; and marks. More of it, here.\nTiny."),
    ("<!-- <p>x</p> --><main><p>Caf&eacute; &#x41;&#66;, ok <b>bold</b> text.</p></main><div class='ad banner'>buy, buy, buy.</div>", "Café AB, ok bold text."),
    ("", ""),
    (None, ""),
    ("<nav><a>only</a></nav>", ""),
    ("<article><p>cut off <b>here, and", "cut off here, and"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in tagpaths.extract(df).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert tagpaths.extract(df.limit(0)).count() == 0


ARTICLE = "<h1>A title of it</h1><p>The first paragraph, which is long enough; it has marks. And more, of it.</p><p>The second one, also with words, and marks: many. So it goes on, and on.</p><p>Tiny.</p>"
ARTICLE_TEXT = "A title of it\nThe first paragraph, which is long enough; it has marks. And more, of it.\nThe second one, also with words, and marks: many. So it goes on, and on.\nTiny."
COMMENT = "<div id=comments><article class=comment-body><p>" + "I think, as a reader, that it is so; and more. " * 20 + "</p></article></div>"


@pytest.mark.parametrize(
    ("before", "after"),
    [("<body class='has-sidebar'>", ""), ("<body class='page header-fixed'>", ""), ("<html class='no-cookie'>", ""), ("<body class='reader-mode'>", ""), ("<body id='search-page'>", "")]
    + [("<article class='post has-related'>", "</article>"), ("<form id=all class=form>", "</form>"), ("<div class=sidebar-layout>", "</div>"), ("<html><head><title>x</title><body>", "")]
    + [("<div id=w><div class=content>", "</div><div class=sidebar><p>Side, text. Here, too.</p></div></div>"), ("<div id=c>", "</div><div class=cookie-notice>We use these, so. Accept, please.</div>"), ("<main>", "</main><div>Subscribe now, please. Or else.</div>"), ("<article>", "</article>" + COMMENT)],
)
def test_names_only_lower_scores(before, after):
    menu = "<nav><ul><li><a href=a>Home</a><li><a href=b>Other</a></ul></nav>"
    assert tagpaths.extract_main_text(before + menu + ARTICLE + after + "<footer>&copy; us, now.</footer>") == ARTICLE_TEXT


def test_pages_of_several_parts():
    one, two = "Some words, of one. And more, of it, here. " * 9, "Other words, of two. And so on. " * 4
    for parts in (f"<article><h2>One</h2><p>{one}</p></article><article><h2>Two</h2><p>{two}</p></article>", f"<div><div><h2>One</h2><p>{one}</div><div><h2>Two</h2><p>{two}</div></div>", f"<main><section><h2>One</h2>{one}</section><section><h2>Two</h2>{two}</section></main>"):
        assert tagpaths.extract_main_text(f"<body><div class=menu>Not, this.</div>{parts}") == f"One\n{one.strip()}\nTwo\n{two.strip()}"


def test_path_scores_match_brute_force():
    p = tagpaths.Page("<div><h1>Title, of</h1><p>One, two. Three</p><ul><li>a<li>b, c</ul><p>Four five six, seven; eight</p></div><p>Other. Text")
    of = np.array([e for e, _, _ in p.nodes])
    size = np.array([len(s.strip()) for _, _, s in p.nodes])
    marks = np.array([len(re.findall("[,.;:!?]", s)) for _, _, s in p.nodes])

    def path(e):
        return () if e < 0 else (*path(p.parent[e]), p.tag[e])

    score = []
    for e, n in zip(of, size, strict=True):
        same = [i for i in range(len(of)) if path(of[i]) == path(e) and size[i]]
        score.append(np.log1p(np.mean(size[same]) * (1 + np.mean(marks[same])) * (1 + np.std(size[same])) * (1 + np.std(marks[same]))) if n else 0.0)
    weight = [np.exp(-0.5 * d**2) for d in (-2, -1, 0, 1, 2)]
    smooth = [sum(w / sum(weight) * score[i + d] for w, d in zip(weight, (-2, -1, 0, 1, 2), strict=True) if 0 <= i + d < len(score)) for i in range(len(score))]
    assert np.allclose(tagpaths.path_scores(p, size, marks, of), np.sqrt(np.array(score) * smooth))


def test_long_and_deep_pages():
    html = "<article>" + "<p>Some words, again. " * 20000 + "</article>" + "<" * 1000
    assert len(tagpaths.extract_main_text(html).split("\n")) == 20000
    began = time.perf_counter()
    assert tagpaths.extract_main_text("<article>" + "<b>" * 100_000 + "<p>Some, words." * 20_000).count("\n") == 19_999
    assert tagpaths.extract_main_text("<div>Some, words." * 100_000).count("\n") == 99_999
    assert time.perf_counter() - began < 60


# ---- exactness ------------------------------------------------------------------------------------------


def test_hashes_do_not_clash_by_construction():
    word = b"a"
    while len(word) < 2048:
        word += bytes(195 - c for c in word)  # the Thue-Morse word over a and b
    other = bytes(195 - c for c in word)
    for n in (64, 2048):
        buf = np.frombuffer(word[:n] + other[:n], np.uint8)
        a, b = common.span_hashes(buf, np.array([0, n]), np.array([n, 2 * n]), fold=False)
        assert a != b


def test_equal_strings_are_told_by_bytes():
    buf = np.frombuffer(b"abcabdabcxyabd", np.uint8)
    at, size = np.array([0, 3, 6, 9, 11]), np.array([3, 3, 3, 2, 3])
    got = repeats.equal_strings(np.zeros(5, np.uint64), at, size, buf)  # all hashes alike
    assert got[0] == got[2] and got[1] == got[4] and len(set(got)) == 3


def test_letters_are_category_l():
    assert not any(ppm._LETTER.search(t) for t in ("½ ² Ⅷ 12 _ !", "", "①"))
    assert all(ppm._LETTER.search(t) for t in ("a", "京", "ª", "½é"))


def test_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    text = " ".join(words(rng, 400, 50)).encode()
    counts = [[dict(collections.Counter(int.from_bytes(bytes([n]) + text[i : i + n], "big") for i in range(len(text) - n + 1)))] for n in (1, 2, 3)]
    m = ppm.Model(["a"], counts)
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    seen = np.zeros(1 << 24, bool)
    for i in range(1, len(text)):
        seen[(text[i - 2] << 16 if i > 1 else 0) | text[i - 1] << 8 | text[i]] = True
    k, n = np.unique(ppm._grams(buf, offs, 5)[0], return_counts=True)
    kn = kneser_ney.Model(k, np.c_[n % 3, n], 5, seen)
    whole = m.code_lengths(buf, offs), kn.sums(buf, offs)
    for module in (ppm, kneser_ney):
        monkeypatch.setattr(module, "BLOCK", 97)
    assert np.allclose(m.code_lengths(buf, offs), whole[0], rtol=1e-5) and np.allclose(kn.sums(buf, offs), whole[1])


def test_topk_of_large_integers():
    big = 1 << 31
    X = np.array([[big, 1], [big, 2], [big, 3], [-big, 5]], np.int64)
    best, scores, _ = topk.SortedLists(np.arange(4), X).search(np.array([big, 1]), -1, 3)
    assert best.tolist() == [2, 1, 0] and scores.tolist() == [big * big + 3, big * big + 2, big * big + 1]


def test_kneser_ney_matches_brute_force(spark):
    docs = ["Ab abc\u00e9", "abcab", "", None, "x", "xyxyx abc"]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(docs)], DOCS).repartition(2)
    seen = kneser_ney.corpus_strings(df)
    texts = [lower(t).encode() for t in docs]
    want = {((t[i - 2] if i > 1 else 0), t[i - 1], t[i]) for t in texts for i in range(1, len(t))}
    assert {(int(x) >> 16, int(x) >> 8 & 255, int(x) & 255) for x in np.flatnonzero(seen)} == want
    classes = [[texts[0], texts[1]], [texts[5]]]
    counts = [collections.Counter(t[i : i + 3] for t in c for i in range(len(t) - 2)) for c in classes]
    keys = sorted(set().union(*counts))
    m = kneser_ney.Model(np.array([int.from_bytes(b"\3" + k, "big") for k in keys], np.uint64), np.array([[c[k] for c in counts] for k in keys]), 3, seen)
    D = kneser_ney.DISCOUNT
    pairs = {(b, c) for _, b, c in want}

    def p(cls, h, b):  # the probability of byte b after the bytes h
        if len(h) == 2:
            follow = {k[2]: n for k, n in counts[cls].items() if k[:2] == h}
        elif len(h) == 1:
            follow = {c: len({a for a, x, y in want if (x, y) == (h[0], c)}) for x, c in pairs if x == h[0]}
        else:
            follow = {c: len({x for x, y in pairs if y == c}) for _, c in pairs}
        lower_p = p(cls, h[1:], b) if h else 1 / 256
        total = sum(follow.values())
        return max(follow.get(b, 0) - D, 0) / total + D * len(follow) / total * lower_p if total else lower_p

    for probe in (b"abcab xy", b"xyabc", b"\xc3\xa9abq"):
        got = m.sums(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0]
        assert np.isclose(got, sum(np.log(p(1, probe[max(0, i - 2) : i], probe[i]) / p(0, probe[max(0, i - 2) : i], probe[i])) for i in range(len(probe))), atol=1e-5)


def test_fourier_features_and_normal_equations(spark):
    rng = np.random.default_rng(14)
    stats = rng.normal(size=(400, fourier_quality.N_STATS))
    wide = fourier_quality.Model(np.zeros(fourier_quality.N_STATS), np.ones(fourier_quality.N_STATS), 20000, 0.03, 1)
    z = wide.cosines(stats[:20])[:, :-1]
    gap = ((stats[:20, None] - stats[None, :20]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-0.03 * gap)).max() < 0.05  # the Gaussian kernel
    ids = np.arange(400)
    y = (stats[:, 0] + rng.normal(size=400) > 0).astype(np.int32)
    feats = spark.createDataFrame(pa.table({"doc_id": ids, "stats": list(stats)}))
    labels = spark.createDataFrame(pa.table({"doc_id": ids, "quality": pa.array(y)}))
    m = fourier_quality.train(feats, labels, F.lit(True), width=32)
    part = {r.doc_id: r.part for r in kneser_ney.bounded_labels(labels, F.lit(True), "quality", 20000, "doc_id").collect()}
    fit = np.array([part[i] == 0 for i in ids])
    z = m.cosines(stats[fit])
    assert np.allclose(m.mean, stats.mean(0)) and np.allclose(m.beta, np.linalg.solve(z.T @ z + np.eye(33), z.T @ y[fit]))
    raw = m.raw(stats[~fit])
    assert (np.diff(m.score(stats[~fit])[np.argsort(raw)]) >= 0).all() and np.isclose(m.score(stats[~fit]).mean(), y[~fit].mean())


def test_class_mix_is_the_same_at_any_size(spark):
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    for cap, toxic in ((100, 100), (500, 500), (6000, 1000)):
        n = {r.label: r["count"] for r in kneser_ney.bounded_labels(labels, F.lit(True), "toxic", cap, "doc_id", most=4).groupBy("label").count().collect()}
        assert abs(n[1] - toxic) < 0.25 * toxic and abs(n[0] - 4 * toxic) < 0.25 * 4 * toxic


# ---- helpers and the pipeline ----------------------------------------------------------------------------


def test_text_slices_hold_every_row():
    texts = ["a" * 10, None, "é" * 50, "", "z" * 1000, "b"]
    b = pa.RecordBatch.from_pydict({"x": pa.array([1, 2, 3, 4, 5, 6]), "t": pa.array(texts)})
    for limit in (1, 20, 10_000):
        got = [x for s in common.text_slices([b.slice(1), b.slice(0, 1)], "t", limit) for x in s.raw()]
        assert got == [(t or "").encode() for t in texts[1:] + texts[:1]]


def test_hash_index_finds_all():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64))
    h = common.HashIndex(keys)
    assert (h.find(keys) == np.arange(len(keys))).all() and (h.find(keys + np.uint64(1 << 63)) == -1).all()
    assert (common.HashIndex(keys[:0]).find(keys) == -1).all()


@with_tokenizers
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    passage = " ".join(words(rng, 40))
    secret = " ".join(words(rng, 12))
    rows = [(i, " ".join(words(rng, 80)), "en" if i % 2 else None, "s", 5) for i in range(40)]
    rows += [(50, "12 !!", "en", "s", 5), (51, None, "en", "s", None), (52, rows[7][1] + " tail", "en", "s", 5)]
    rows += [(60, f"{' '.join(words(rng, 15))} {passage} right words", "en", "s", 5), (61, f"{' '.join(words(rng, 15))} {passage} things entirely", "en", "s", 5), (62, f"x y {secret} z", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = set(docs.columns)
        docs = common.stash(stage(spark, docs, str(tmp_path)), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(docs.columns) == before
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    first, near, cut, clean, last = seen.values()
    assert first == {r[0] for r in rows} - {50, 51}
    assert near == first - {52}
    assert cut == near and clean == cut - {62} and last == clean
    # every stage by brute force on what the one before it kept
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=tokenizers_home.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizers_home.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    kept = [r for r in rows if r[0] in first]
    low = {i: c for i, _, c in brute_components(kept, percent=80)}
    kept = [r for r in kept if low[r[0]] == r[0]]
    texts = brute_kept(kept, 50)
    item = WORD.findall(secret)
    windows = [item[i : i + 10] for i in range(len(item) - 9)]
    whole = lambda t: any(WORD.findall(lower(t))[i : i + 10] in windows for i in range(len(t.split())))
    want = {i: tuple(e.encode_ordinary(t)) for i, t in texts.items() if not whole(t)}
    assert {r.doc_id: tuple(r.ids) for r in docs.collect()} == want and all(r.n_tokens == len(r.ids) for r in docs.collect())
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string"
    for stage in ("near_duplicates", "repeated_passages", "decontaminated"):
        spark.createDataFrame([(1, "some secret words of it")], "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        run = lambda rows: sorted(((r.doc_id, r.text) for r in getattr(corpus_pipeline, stage)(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()), key=str)  # noqa: B023, E731
        assert run([]) == []
        t, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
        # a copy under an id that another text bears too: only the copy goes
        rows = [(1, t, "en", "s", 1, "x"), (2, t, "en", "s", 1, "x"), (2, other, None, None, None, None), (None, other + " more", "en", "s", 1, "x"), (4, None, "en", "s", None, "x"), (5, "", "en", "s", 0, "x")]
        kept = sorted(((i, x) for i, x, *_ in rows if not (stage == "near_duplicates" and (i, x) == (2, t))), key=str)
        assert run(rows) == kept
    assert run([(7, "with some secret words of it inside", "en", "s", 1, "x"), (7, "clean", "en", "s", 1, "x"), (None, "some secret words of it", "en", "s", 1, "x")]) == [(7, "clean")]
