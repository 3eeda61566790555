"""Archives with a dictionary, aligned tokens and hard negatives: against brute force, the libraries and round trips, and on odd input."""

import base64
import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from framequarry.llm import alignment, hardneg, warc

try:
    import public_tokenizers as tokenizers_home
except ImportError:
    tokenizers_home = None
with_tokenizers = pytest.mark.skipif(tokenizers_home is None, reason="no vocabulary files here")


# ---- 11: archives ----------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, payload int, digest string"


def page_rows():
    shared, long = "<p>the same page</p>" * 20, "<b>long</b>" * 40_000
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<html><body><nav>menu menu</nav><p>page {i} text {i * 7919 % 1009}</p></body></html>", 1, "x") for i in range(60)]
    rows += [(i, "http://copy.example/", shared, 1, None) for i in range(100, 180)]
    rows += [(200, None, None, 1, "x"), (201, "http://e/", "", None, "x"), (-5, "http://neg/", "only one ü 漢", 1, "x"), (202, "a b\r\nWARC-Type: fake", long, 1, "x"), (203, "http://l/", long, 1, "x")]
    rows += [(None, "http://n/", shared, 1, "x"), (None, "http://n/", "without an id", 1, "x"), (None, "http://m/", "without an id", 1, "x")]
    return rows + [rows[3], (179, "http://copy.example/", shared, 1, "again")]  # repeated rows, one of them the largest id of its payload


def brute_archives(rows, least=0):
    payload = [(h or "").encode() for _, _, h, *_ in rows]
    top = {}
    for (page, *_), p in zip(rows, payload, strict=True):
        if page is not None:
            top[p] = max(top.get(p, page), page)
    out = []
    for (page, *_), p in zip(rows, payload, strict=True):
        leader = top.get(p) if len(p) >= least else page
        again = page != leader
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", leader if again else None))
    return sorted(out, key=str)


def read_back(manifest):
    return sorted((tuple(r) for r in warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize(("least", "parts"), [(0, 1), (0, 5), (300, 3)])
def test_archives_give_back_what_was_written(spark, tmp_path, least, parts):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(parts)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", revisit_from=least)
    assert read_back(manifest) == brute_archives(rows, least)
    got = warc.read_archives(manifest, payloads=True).where("record_type = 'response'").select("page_id", "payload").collect()
    want = collections.Counter((p, (h or "").encode()) for p, _, h, *_ in rows)
    assert all((p, bytes(x)) in want for p, x in got)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)


def test_archive_begins_with_its_dictionary_and_every_record_is_a_frame(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", "".join(f"<div class=c{rng.randrange(9)}><p>word{rng.randrange(500)} and more words</p></div>" for _ in range(60)), 1, "") for i in range(400)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/out", archive_bytes=60_000)
    files = [r.file.removeprefix("file://") for r in manifest.collect()]
    assert len(files) > 1  # another archive after archive_bytes
    data = open(files[0], "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert dictionary[:4] == b"\x37\xa4\x30\xec" and len(dictionary) <= warc.DICTIONARY_BYTES
    first = warc.parse_record(next(warc.archive_records(open(files[0], "rb")))[2])
    assert first[0]["warc-type"] == "warcinfo"
    some = warc.read_archives(manifest).where("page_id in (7, 399)").collect()
    for r in some:
        headers, block = warc.read_record(r.file, r.offset, r.size, dictionary)
        assert warc.page_of(headers["warc-record-id"]) == r.page_id and warc.http_parts(block)[1] == rows[r.page_id][2].encode()
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(warc.page_record(r[0], r[1], r[2].encode(), "2020-01-01T00:00:00Z"))) for r in rows)
    assert sum(r.n_bytes for r in manifest.collect()) - len(files) * size < plain  # the dictionary pays


def test_record_ids_hold_page_ids():
    for page in (None, 0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567):
        r = warc.record_id(page, hashlib.sha1(str(page).encode()).digest())
        assert warc.page_of(r) == page and r[24:25] == "8" and r.startswith("<urn:uuid:")


def test_damaged_archives_are_refused(tmp_path):
    record = warc.page_record(1, "http://x/", b"payload", "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="not what was written"):
        warc.parse_record(record.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="whole"):
        warc.parse_record(record[:-3])
    data = zstandard.ZstdCompressor().compress(record)
    assert [x[2] for x in warc.archive_records(__import__("io").BytesIO(data * 3), chunk=5)] == [record] * 3
    with pytest.raises(ValueError, match="within"):
        list(warc.archive_records(__import__("io").BytesIO(data[:-2])))


def test_large_tables_of_copies_are_joined_with_salt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    rows = page_rows()
    assert read_back(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), f"file://{tmp_path}/out")) == brute_archives(rows)


def test_no_pages_no_archives(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/out")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


# ---- 12: alignment ---------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Row by row with whole texts, the libraries' own ids and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizers_home.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizers_home.path("piece_bpe_32k.model"))
    letters = {c: i for c, i in alignment._byte_letters().items()}
    docs = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(([], [], []))
            continue
        ends_a, ends_b = ([*itertools.accumulate(map(len, x))] for x in (raw_a, raw_b))
        groups, at = [], (0, 0)
        for cut in sorted(set(ends_a) & set(ends_b)):
            to = (ends_a.index(cut) + 1, ends_b.index(cut) + 1)
            groups.append((ids_a[at[0] : to[0]], ids_b[at[1] : to[1]]))
            at = to
        docs.append((ids_a, ids_b, groups))
    count = collections.Counter(p for _, _, gs in docs for p in {(x, y) for ga, gb in gs for x in ga for y in gb})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for ids_a, ids_b, gs in docs:
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        out.append((len(ids_a), len(ids_b), len(gs), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


ODD = [None, "", " ", "  ", "\n", "a", "abc ", "\n\nfoo \n bar\t", "a▁b", "▁", "<|endoftext|> and </s> <s> <0x0A>", "naïve ﬁ ½ Ａ 漢字 😀😀", "x" * 700, "=" * 333 + " " * 50, "\x00\x1c\x85 　z", "tab\tand\r\nreturn\r\n  two", "The cat sat; the cat sat.", "The cat sat; the cat sat."]


@with_tokenizers
def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "The", "ofthe", "reading", "ßen", "été", "naïve", "123", "4567", "...", ");", "x=1", "\n", "\n\n", "\t", "  ", "漢字", "don't", "http://a.b/c", "aaaaaaa"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)]
    paths = tokenizers_home.path("byte_bpe_50k.json"), tokenizers_home.path("piece_bpe_32k.model")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pack int, docs string").repartition(3)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_alignment(texts), strict=True)), key=str)
    assert sorted((tuple(r) for r in alignment.align(df, *paths).collect()), key=str) == want
    # small packs, parts and groups change nothing; ids of another type
    import framequarry.llm.alignment as m

    small = {"PACK_BYTES": 300, "PART_IDS": 40, "EXPANDED": 3, "LONG": 64, "MOST_STRINGS": 20}
    coder = m.TwoTokenizers(*paths)
    for k, v in small.items():
        monkeypatch.setattr(m, k, v)
    pack, numbers, digests, linked = m._Pack(coder), [], [], collections.Counter()
    for i in range(0, len(texts), 7):
        for t, parts in zip(texts[i : i + 7], coder.texts(texts[i : i + 7]), strict=True):
            pack.add(t, parts)
        n, d, links, pairs = pack.finish()
        numbers += n.tolist()
        digests += d
        pair, docs = m._unpack(pairs)
        linked.update(dict(zip(pair.tolist(), docs.tolist(), strict=True)))
        per_doc, place, times = m._unpack(links)
        assert np.add.reduceat(np.append(times, 0), np.minimum(np.cumsum(per_doc) - per_doc, len(times)))[per_doc > 0].tolist() == n[:, 3][per_doc > 0].tolist() and place.max(initial=-1) < len(pair)
        pack.clear()
    brute = brute_alignment(texts)
    assert [tuple(x) for x in numbers] == [w[:4] for w in brute] and digests == [w[6] for w in brute]


@with_tokenizers
def test_alignment_of_odd_tables(spark):
    paths = tokenizers_home.path("byte_bpe_50k.json"), tokenizers_home.path("piece_bpe_32k.model")
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), *paths).count() == 0
    long = "many words of a long text \n and more; " * 40_000  # above the size of a part
    got = alignment.align(spark.createDataFrame([("a", long), ("b", None)], "doc_id string, text string"), *paths).orderBy("doc_id").collect()
    unit = alignment.align(spark.createDataFrame([("a", long[:38])], "doc_id string, text string"), *paths).first()
    assert got[0].n_links > 39_000 * unit.n_links * 0.9 and got[0].n_best <= got[0].n_links == got[0].count_sum
    assert tuple(got[1]) == ("b", 0, 0, 0, 0, 0, 0, "")


def test_wide_groups_count_by_ids(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 50)
    ga, gb = np.sort(rng.integers(0, 3, 60)), np.sort(rng.integers(0, 3, 50))
    want = collections.Counter((int(g), int(x), int(y)) for x, g in zip(a, ga, strict=True) for y, h in zip(b, gb, strict=True) if g == h)
    for limit in (0, 1 << 12):
        monkeypatch.setattr(alignment, "EXPANDED", limit)
        got = collections.Counter()
        for g, x, y, n in zip(*alignment.links(a, b, ga, gb, 3), strict=True):
            got[int(g), int(x), int(y)] += int(n)
        assert got == want


# ---- 13: hard negatives ----------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=5, percent=80, scale=256):
    ok = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.append((vec_id, label, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]))
    out = []
    for anchor, label, v in ok:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in ok if i != anchor and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            below = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(anchor, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(below)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, id int, score string"


@pytest.mark.parametrize("block", [8192, 37])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0.1, 0.2, 6).astype(np.float32)], int(rng.integers(3)), 1, "x") for i in range(420)]
    rows += [(i, [0.5, 0.25, 0.5, 0.0, 0.0, 0.0], i % 3, 1, "x") for i in range(500, 540)]  # ties
    rows += [(600, None, 1, 1, "x"), (700, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1, 1, "x"), (701, [float("nan")] * 6, 1, 1, "x"), (702, [float("inf")] * 6, 1, 1, "x"), (800, [0.1] * 6, None, 1, "x"), (None, [0.1] * 6, 1, 1, "x")]
    rows += [(900, [0.5, 0.5], 1, 1, "x"), (901, [0.5, 0.4], 1, 1, "x"), (902, [0.4, 0.45], 2, 1, "x"), (1000, [], 1, 1, "x"), (1100, [0.0] * 6, 1, 1, "x")]
    rows += [rows[100], rows[433], (200, rows[7][1], 2, 1, "x")]  # repeated rows, and another row under an anchor's id
    import framequarry.llm.hardneg as m

    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    if block == 8192:
        got = sorted(tuple(r) for r in m.mine(df, F.col("id") % 100 == 0).collect())
        assert got == brute_negatives(rows) and len(got) > 50
        assert sorted(tuple(r) for r in m.mine(df, F.col("id") % 100 == 0, positives=2, negatives=3, percent=50).collect()) == brute_negatives(rows, 2, 3, 50)
    else:  # small rounds: several, each over all rows
        monkeypatch.setattr(m, "ROUND_BYTES", 200)
        assert sorted(tuple(r) for r in m.mine(df, F.col("id") % 100 == 0).collect()) == brute_negatives(rows)


def test_one_anchor_over_blocks():
    rng = np.random.default_rng(9)
    X = rng.integers(-300, 300, (1000, 8))
    ids, labels = np.sort(rng.choice(5000, 1000, replace=False)), rng.integers(0, 4, 1000)
    q = X[17]
    batch = pa.RecordBatch.from_pydict({"id": ids, "label": labels, "v": pa.array(X.tolist(), pa.list_(pa.int64()))})
    best = hardneg._Best(3, 4)
    best.most = 10
    scores = X @ q
    limits = sorted(scores[labels == labels[17]].tolist(), reverse=True)[:3]
    for at in range(0, 1000, 90):
        for i, of, x in hardneg._row_blocks([batch.slice(at, 90)]):
            s = hardneg.scores_of(x, q[None])[0]
            assert s.tolist() == (x @ q).tolist()
            for place, found in enumerate(hardneg.negatives_of(s, of, int(labels[17]), limits, 80, 4)):
                best.add(np.full(len(found), place), s[found], i[found])
    best.settle()
    got = sorted(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True))
    want = []
    for place, p in enumerate(limits):
        below = sorted((-int(s), int(i)) for s, i, of in zip(scores, ids, labels, strict=True) if of != labels[17] and 80 * p <= 100 * s <= 100 * p)[:4]
        want += [(place, -s, i) for s, i in below]
    assert got == sorted(want)


def test_scores_are_exact_whatever_their_size():
    for most in (200, 1 << 24, 1 << 30):
        X = np.array([[most, -most, 1], [most - 1, 1, -most]])
        assert hardneg.scores_of(X, X).tolist() == [[int(sum(int(a) * int(b) for a, b in zip(x, y, strict=True))) for x in X] for y in X]
    low, high = -(1 << 63), (1 << 63) - 1
    s = np.array([0, high, low, high, -1])
    assert hardneg.sorted_by_score(s).tolist() == [1, 3, 0, 4, 2]


def test_no_vectors_no_negatives(spark):
    assert hardneg.mine(spark.createDataFrame([], VECTORS), F.col("id") % 100 == 0).count() == 0
