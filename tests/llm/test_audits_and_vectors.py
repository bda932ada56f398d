"""Periodic runs, source divergence and embedding near-duplicates against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import divergence, embedding_dedup, mixing, periodic_runs, queries, substring_dedup, tokens, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, runs string, collapsed string, term string, n string"


def plain_runs(ws):
    """Runs by trying every period."""
    n, seen = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and ws[i] == ws[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s:
                seen.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
        ws = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(ws))
        yield ws[:at] + [unit[i % len(unit)] for i in range(rng.randint(0, 7 * len(unit)))] + ws[at:]


def test_runs_of_random_texts():
    texts = list(periodic_texts(1500, 3)) + [["x"] * 300, list("ab") * 500, list("aab") * 100 + ["c"] + list("aab") * 90]
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        assert periodic_runs.runs_of(tokens.tokenize([" ".join(ws).encode() for ws in part])) == [plain_runs(ws) for ws in part]


def test_wavelet_neighbours():
    rng = random.Random(4)
    numbers = list(range(200))
    rng.shuffle(numbers)
    tree = periodic_runs._Wavelet(np.array(numbers))
    for _ in range(100):
        low, high = sorted(rng.sample(range(201), 2))
        part, x = sorted(numbers[low:high]), rng.randrange(200)
        args = [np.array([v]) for v in (low, high)]
        assert tree.below(*args, np.array([x]))[0] == sum(v < x for v in part)
        k = rng.randrange(len(part))
        assert tree.select(*args, np.array([k]))[0] == part[k]


def test_run_operator_on_odd_rows(spark):
    long_text = " ".join(f"w{i % 40_000}" for i in range(200_000))  # larger than a chunk, one run of period 40,000
    assert len(long_text) > 2 * tokens.CHUNK_BYTES
    texts = [" ".join(ws) for ws in periodic_texts(30, 9)] + [" \n".join("xyxyxyxyxyz"), "é é é é é é", long_text]
    rows = [(i, t, "en", "s", "r", "c", "t", "n") for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "", "", "", "", "", ""), (None, "a a a a a a b", "", "", "", "", "", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    found = periodic_runs.find(docs)
    want = Counter()
    for doc_id, text, *_ in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = plain_runs(ws) if len(ws) < 1000 else [(0, 200_000, 40_000)]
        want[(doc_id, tuple(runs), plain_collapse(ws, runs))] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()) == want
    cut = periodic_runs.collapse(docs)
    assert cut.columns == docs.columns
    got = {(r.doc_id, r.runs, r.text) for r in cut.filter("doc_id in (30, 31, 100, 101)").collect()}
    assert got == {(30, "r", "x y z"), (31, "r", "é"), (100, None, None), (101, "", "")}
    for operator in (periodic_runs.find, periodic_runs.collapse):
        assert operator(docs.limit(0)).count() == 0


def test_run_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for r in docs:
        ws = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        n, h = len(ws), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
            planted += 1
        runs = plain_runs(ws)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        lines = "".join("%d,%d,%d\n" % x for x in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, plain_collapse(ws, runs))]
        assert got[r.doc_id] == (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests)
    assert planted and len(got) == len(docs)


def plain_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        price = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {s: {t: price(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for s in sources}
        q = {t: price(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, value, k) for k, (i, value) in enumerate(items[:most], 1)}
    return out


@pytest.mark.parametrize("block,tile", [(8192, 16), (4, 2)])
def test_divergence(spark, block, tile):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("Wort", "mot", "é", "λ") for b in "abcdefg"]
    rows = []
    for k in range(160):
        own = rng.randrange(len(words))
        text = " 7,".join(rng.choice(words[own:] + words[:5]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", "é", None])))
    rows += [(None, "en", "silent"), ("", "en", ""), ("only here", "xx", "lone"), ("12 34", "yy", "p"), ("", "yy", "q"), rows[0], rows[0]]
    docs = spark.createDataFrame([(k, t, a, b, "r", "c", "t", "n") for k, (t, a, b) in enumerate(rows)], DOCS)
    found = divergence.audit(docs, least=12, top=4, block=block, tile=tile)
    assert {tuple(r) for r in found.collect()} == plain_audit(rows, 12, 4) and found.count() == len(plain_audit(rows, 12, 4))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_prices_and_gallop(spark):
    rng = random.Random(8)
    cases = [(rng.randrange(10**e), rng.randrange(10**e) + 10**e + 6) for e in range(1, 15)]
    want = [1 + 10**9 * (c + 5) // n for c, n in cases]
    assert [int(divergence.prices(np.array([c]), n)[0]) for c, n in cases] == want
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c long, n long")
    assert [r.p for r in frame.select("k", divergence.price_column("c", "n").alias("p")).orderBy("k").collect()] == want
    for few, many in ((0, 50), (3, 1000), (200, 300), (130, 131)):
        a, b = (np.sort(np.array(rng.sample(range(1200), n), np.int64)) for n in (few, many))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def plain_groups(rows):
    """Links and components of (id, vector) rows by comparing all pairs."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    for x, a in enumerate(good):
        for b in good[x + 1 :]:
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.9:
                links.update((a, b))
                r, s = root(rows[a][0]), root(rows[b][0])
                parent[max(r, s)] = min(r, s)
    return Counter((i, links[k], root(i) if i is not None else None, i is None or root(i) == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_groups(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)  # groups span several blocks
    bases = rng.standard_normal((60, 24))
    rows = [(1000 + k, b.tolist()) for k, b in enumerate(bases)]
    for k in range(220):  # a dense group and smaller ones
        base = bases[0] if k < 120 else bases[k % 20]
        rows.append((k, (base + rng.standard_normal(24) * 0.1).tolist()))
    rows += [(5000 + k, bases[3].tolist()) for k in range(50)]  # equal vectors
    rows += [(6000, (bases[3] * 2.5).tolist()), (6001, (-bases[3]).tolist()), (6002, bases[4][:7].tolist()), (6003, (bases[4][:7] * 3).tolist())]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 24), (7003, [math.nan] + [1.0] * 23), (7004, [math.inf] * 24),
             (7005, [None] + [1.0] * 23), (None, bases[5].tolist()), rows[0], (1001, bases[2].tolist())]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rep string, cell long")
    got = Counter(map(tuple, embedding_dedup.group(frame).collect()))
    assert got == plain_groups(rows)
    kept = embedding_dedup.without_copies(frame)
    assert kept.columns == frame.columns and kept.count() == sum(n for (_, _, _, k), n in got.items() if k)
    assert embedding_dedup.group(frame.limit(0)).count() == 0 == embedding_dedup.without_copies(frame.limit(0)).count()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    u, other = rng.standard_normal((2, 1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other -= (other * u).sum(1, keepdims=True) * u
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    v = 0.9005 * u + math.sqrt(1 - 0.9005**2) * other
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate([*u, *v])], "vec_id long, embedding array<double>")
    found = embedding_dedup.group(frame).filter(F.col("n_links") > 0)
    assert found.count() >= 2 * 0.98 * 1500
    assert found.filter((F.col("component_id") != F.col("vec_id") % 1500)).count() == 0


def test_block_order_of_any_size(spark):
    for n in (1, 2, 7, 1000):
        order = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long")).alias("t"))
        assert sorted(r.t for r in order.collect()) == list(range(n))
    n = 5_000_000_000 * 3 + 1
    rows = spark.createDataFrame([(b,) for b in (0, 1, n // 2, n - 2, n - 1)], "block long")
    got = [r.t for r in rows.select(mixing.permuted(F.col("block"), F.lit(n), F.lit(12345).cast("long")).alias("t")).collect()]
    assert got == [(b * (mixing.LARGE_PRIME % n) + 12345) % n for b in (0, 1, n // 2, n - 2, n - 1)]


def test_mix_counts_only_what_a_shard_has_drawn(spark, monkeypatch):
    """The counts come from the tree: without a shard's ranges, its pieces are missing."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * 40), f"s{i % 3}") for i in range(120)], "doc_id long, text string, source string")
    whole = mixing.taken(docs, block_words=16, shards=4).agg(F.sum("taken")).first()[0]
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a, **b: tree(*a, **b).filter("shard <> 2"))
    part = mixing.taken(docs, block_words=16, shards=4).agg(F.sum("taken")).first()[0]
    assert 0.6 * whole < part < 0.9 * whole


def test_long_query_strings_count(spark):
    tail = "x" * (1 << 20)
    urls = [(f"https://a.org/p?q={tail}{k}",) for k in "ab"]
    found = [r.u for r in spark.createDataFrame(urls, "url string").select(warc.canonical_url(F.col("url")).alias("u")).collect()]
    assert found == [f"a.org/p?q={tail}{k}" for k in "ab"]


@pytest.mark.parametrize("swap", [False, True])
def test_passages_of_repeated_ids_stay_with_their_text(spark, swap):
    """Rows (1, A), (2, A), (2, B), where B has no word of A: only the copy of A goes."""
    rng = random.Random(11)
    a = " ".join(f"a{rng.randrange(10**6)}" for _ in range(80))
    b = " ".join(f"b{rng.randrange(10**6)}" for _ in range(90))
    c = " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, a), (2, b if swap else a), (2, a if swap else b), (2, a), (3, f"{c} {b}"), (4, c), (4, c)]
    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, version string")
    found = substring_dedup.passages(docs.drop("version")).collect()
    assert {(r.doc_id, r.start, r.end, r.origin_id) for r in found} in (
        {(2, 0, 80, 1), (4, 0, 60, 3), (3, 60, 150, 2)}, {(2, 0, 80, 1), (4, 0, 60, 3), (2, 0, 90, 3)})
    kept = substring_dedup.without_repeats(docs, substring_dedup.passages(docs))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left[1, a] == 1 and left[2, ""] >= 2 and left[4, ""] == 2
    assert left[2, b] + left[3, f"{c} {b}"] == 1
