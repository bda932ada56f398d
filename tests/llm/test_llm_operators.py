"""Operators on small tables with odd rows, against brute force where SQL has no form."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import (
    chat, decontaminate, graph, language_model, mixing, near_dedup, quality_classifier, quality_rules, queries,
    substring_dedup, tokens, toxicity, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, size string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, texts):
    """Documents with ids 0.., plus null and empty texts, a null id, repeated rows and clashing columns."""
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None, None), (901, "", "en", "s1", 0, "x", "y", "z"), (902, " \n\t ", "en", "s1", 4, "x", "y", "z")]
    rows += [(None, prose(60, 77), "en", None, 1, "x", "y", "z"), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(n, n) for n in (3, 12, 40, 80, 120, 200)]
    copies = [base[4], base[5].replace(VOCAB[0], "edited"), base[5] + " one more"]
    passage = prose(70, 999)
    shared = [prose(50, 31) + " " + passage + " " + prose(20, 32), prose(30, 33) + " " + passage, passage + " " + prose(90, 34)]
    return table(spark, base + copies + shared + [prose(4000, 8)]).cache()


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# --- words ---------------------------------------------------------------------------------


def test_tokens_are_the_words_of_each_text():
    texts = [b"", b"one", b" two  words\n", b"\t", "é ü\x0bx".encode(), b"a" * 300 + b" a"]
    found = tokens.tokenize(texts)
    assert found.counts.tolist() == [len(t.split()) for t in texts]
    assert found.words(0, len(found.starts)) == [w for t in texts for w in t.split()]
    again = dict(zip(found.words(0, len(found.starts)), found.hashes.tolist()))
    assert len(set(again.values())) == len(again)
    windows = tokens.window_hashes(tokens.tokenize([b"a b c a b c"]).hashes, 3)
    assert windows[0] == windows[3] and len(set(windows.tolist())) == 3


# --- quality rules -------------------------------------------------------------------------


def test_repeat_words_match_brute_force(spark):
    texts = ["a b c d e f a b c d e", "x " * 30, "a b c d", "a b c d e", "p q r s t u " * 4 + "end"]
    rows = quality_rules.judge(table(spark, texts)).select("doc_id", "n_repeat_words", "n_words", "kept").collect()
    got = by_id(rows)
    for i, text in enumerate(texts):
        ws = text.split()
        at = defaultdict(list)
        for k in range(len(ws) - 4):
            at[tuple(ws[k : k + 5])].append(k)
        want = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
        assert got[i]["n_repeat_words"] == len(want)
    assert len(rows) == len(texts) + 6 and not got[900]["kept"] and got[900]["n_words"] == 0


def test_rules_keep_columns_and_clean_text(spark, docs):
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert quality_rules.kept(empty(spark)).count() == 0
    words = "the old man and the sea is a story that was told by many people in this town with some care"
    good, bad = spark.createDataFrame([(1, words)], "doc_id long, text string"), spark.createDataFrame([(1, "***$ %%% " * 20)], "doc_id long, text string")
    assert quality_rules.kept(good).count() == 1 and quality_rules.kept(bad).count() == 0


# --- near duplicates -----------------------------------------------------------------------


def brute_groups(texts, shingle, percent=80):
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + shingle]) for k in range(len(ws) - shingle + 1)} or ({tuple(ws)} if ws else set())
    name = {i: i for i in texts}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sorted(texts), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(name[a], name[b])
            if (name[a], name[b]) != (low, low):
                name[a] = name[b] = low
                changed = True
    return name, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_groups_match_brute_force(spark, shingle):
    rng = random.Random(shingle)
    texts = []
    for family in range(6):
        words = prose(90, 100 + family).split()
        for copy in range(12):  # edits from few to many, so that some copies only link to others
            w = list(words)
            for _ in range(rng.randint(0, 14 if shingle == 2 else 5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["Word", "word", "two words"]
    data = table(spark, texts)
    want, sizes = brute_groups({r["doc_id"]: r["text"] for r in data.collect() if r["doc_id"] is not None}, shingle)
    rows = near_dedup.group(data, shingle).collect()
    assert len(rows) == data.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(3)
    words = prose(60, 1).split()
    texts = []
    for _ in range(40):
        w = list(words)
        for k in rng.sample(range(60), rng.randint(0, 5)):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_groups(dict(enumerate(texts)), 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.group(data, 2).collect()} == want


def test_without_copies_keeps_columns(spark, docs):
    left = near_dedup.without_copies(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[6] == 0 and ids[4] == 1 and ids[None] == 1 and ids[900] == 1
    assert near_dedup.without_copies(empty(spark)).count() == 0
    assert near_dedup.group(empty(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    one = near_dedup.superminhash([np.unique(a), np.unique(b), np.unique(a), a[:1]])
    true = 240 / 360
    assert abs((one[0] == one[1]).mean() - true) < 0.15 and (one[0] == one[2]).all()
    # every register of a set gets its value at a level of its own order: all levels occur once for one element
    assert sorted((one[3] >> np.uint64(32)).tolist()) == list(range(near_dedup.REGISTERS))


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 150)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + k] == 100 for k in range(30)) and found[200] == 150
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


# --- passages ------------------------------------------------------------------------------


def test_passages_against_brute_force(spark, docs):
    found = substring_dedup.passages(docs).collect()
    pairs = {(r["doc_id"], r["origin_id"]) for r in found}
    texts = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect() if r["doc_id"] is not None}
    want = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        grams = {tuple(texts[a][k : k + 51]) for k in range(len(texts[a]) - 50)}
        if any(tuple(texts[b][k : k + 51]) in grams for k in range(len(texts[b]) - 50)):
            want.add((b, a))
    linked = defaultdict(set)
    for a, b in pairs:
        linked[a].add(b), linked[b].add(a)
    assert {x for p in want for x in p} == set(linked)
    assert pairs <= want | {(8, 7)}
    for r in found:
        x, y = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["origin_id"]][r["origin_start"] : r["origin_end"]]
        assert len(x) >= 40 and (r["identity"] < 1 or x == y)


def test_fuzzy_passage(spark):
    words = prose(120, 50).split()
    other = list(words)
    for k in (30, 61, 95):
        other[k] = "changed"
    del other[75]
    data = spark.createDataFrame([(1, " ".join(words)), (2, prose(40, 51) + " " + " ".join(other) + " " + prose(40, 52))], "doc_id long, text string")
    (row,) = substring_dedup.passages(data).collect()
    assert (row["start"], row["origin_start"], row["origin_end"]) == (40, 0, 120) and 0.95 < row["identity"] < 1


def test_chain_with_a_rewritten_middle_is_split(spark):
    rows, want = [], set()
    for n, between in enumerate((40, 50, 60, 80, 100)):
        one, two = prose(60, 200 + n), prose(60, 300 + n)
        rows += [(2 * n, " ".join([one, prose(between, 400 + n), two])), (2 * n + 1, " ".join([one, prose(between, 500 + n), two]))]
        want |= {(2 * n + 1, 0, 60), (2 * n + 1, 60 + between, 120 + between)}
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = {(r["doc_id"], s, e) for r in found for d, s, e in want if d == r["doc_id"] and r["start"] <= s and e <= r["end"] <= e + 8}
    assert near == want and all(r["identity"] >= 0.8 for r in found)


def test_passage_whose_seeds_have_other_first_and_last_holders(spark):
    rows, want = [], {}
    for n in range(8):
        whole = prose(51, 700 + n).split()
        left, right = " ".join(whole[:26]), " ".join(whole[25:])
        texts = {1: left, 2: right, 10: " ".join(whole), 20: " ".join(whole), 99: right, 100: left}
        for d, t in texts.items():
            around = [prose(30, 1000 * n + 2 * d), t, prose(30, 1000 * n + 2 * d + 1)]
            rows.append((1000 * n + d, " ".join(around)))
        want[1000 * n + 20] = 1000 * n + 10
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {r["doc_id"]: r["origin_id"] for r in found if r["start"] <= 30 and r["end"] >= 81}
    assert whole == want and {r["doc_id"] for r in found} == set(want)


def test_every_place_of_a_passage_is_cut(spark):
    one, own = prose(60, 601), prose(60, 602)
    edited = one.split()
    edited[29] = "changed"
    texts = {
        1: [prose(30, 603), one, prose(30, 604)], 2: [prose(30, 605), one, prose(30, 606), one, prose(30, 607), " ".join(edited)],
        3: [own, prose(30, 608), own, prose(30, 609)], 4: ["again " * 500],
    }
    data = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = substring_dedup.passages(data)
    places = {(r["doc_id"], r["origin_id"], r["start"]) for r in found.collect()}
    assert {(2, 1, 30), (2, 1, 120), (2, 1, 210), (3, 3, 90)} <= places and {d for d, *_ in places} == {2, 3, 4}
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.without_repeats(data, found).collect()}
    assert got[1] == " ".join(texts[1]).split() and got[2] == " ".join(texts[2][::2]).split()
    assert got[3] == " ".join([own, texts[3][1], texts[3][3]]).split() and len(got[4]) < 40


def test_edited_copies_meet_holders_between(spark):
    """The first and the last holder of every seed are others, and no 40 words in a row are equal."""
    rng = np.random.default_rng(11)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    passage = words(120)
    edited = [f"x{n}" if n % 30 == 15 else w for n, w in enumerate(passage)]
    rows = []
    for n in range(7):  # every seed lies in a part of 39 words, too short to be reported
        part = passage[15 * n : 15 * n + 39]
        rows += [(n, words(60) + part + words(60)), (100 + n, words(60) + part + words(60))]
    rows += [(50, words(80) + passage + words(80)), (51, words(80) + edited + words(80))]
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = [r for r in substring_dedup.passages(data).collect() if r["doc_id"] == 51 and r["origin_id"] == 50]
    assert max(r["end"] - r["start"] for r in found) >= 100
    assert all(80 <= r["start"] + 3 and r["end"] <= 203 for r in found)


def test_holders_of_a_short_line_meet_only_where_more_agrees(spark, monkeypatch):
    """30 words that many documents share are no passage; the edited copies around them are still found."""
    rng = np.random.default_rng(12)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    line = words(30)
    rows = [(n, words(50) + line + words(50)) for n in range(100)]
    want = set()
    for n, how in enumerate(("substituted", "inserted", "left")):
        left, right = words(24), words(24)
        whole = left + line + right
        if how == "substituted":
            other = left + line + ["x"] + right[1:]
        elif how == "inserted":
            other = words(1) + line + ["x", "y"] + right
            rows[80] = (80, words(40) + right + words(40))  # seeds of two holders have met before
        else:
            other = left[:-1] + ["x"] + line + words(1)
        rows[40 + n] = (40 + n, words(40) + whole + words(40))
        rows[60 + n] = (60 + n, words(40) + other + words(40))
        want.add((60 + n, 40 + n))
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    met = []
    kept = substring_dedup.kept_table
    monkeypatch.setattr(substring_dedup, "kept_table", lambda df, name: met.append((name, kept(df, name))) or met[-1][1])
    for few in (substring_dedup.FEW, 2):
        met.clear()
        monkeypatch.setattr(substring_dedup, "FEW", few)
        found = {(r["doc_id"], r["origin_id"]) for r in substring_dedup.passages(data).collect()}
        assert found == want
        chains = [df for name, df in met if name == "chains"][-1]
        pairs = chains.select("a", "b").distinct().count()
    assert pairs < 200  # of 4,950


def test_cut_passages(spark, docs):
    out = substring_dedup.without_repeats(docs, substring_dedup.passages(docs))
    assert out.schema == docs.schema and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    passage = prose(70, 999)
    assert passage in got[9] and passage not in got[10] and passage not in got[11]
    assert got[10].split() == prose(30, 33).split() and got[900] is None and got[901] == ""
    assert substring_dedup.passages(empty(spark)).count() == 0


def test_chain_takes_the_best_rising_run():
    i, j = [0, 5, 10, 15, 20], [100, 5, 110, 115, 120]
    best = substring_dedup.chain(i, j, 8.0)[0]
    assert [i[x] for x in best] == [0, 10, 15, 20]
    for seed in range(20):  # against the quadratic recurrence
        rng = random.Random(seed)
        i, j = [rng.randrange(60) for _ in range(25)], [rng.randrange(60) for _ in range(25)]
        order = sorted(range(25), key=lambda x: (i[x], -j[x]))
        score = {}
        for n, x in enumerate(order):
            gains = [score[y] - substring_dedup.GAP_COST * (i[x] - i[y] + j[x] - j[y]) for y in order[:n] if i[y] < i[x] and j[y] < j[x]]
            score[x] = 8 + max([0, *gains])
        path = substring_dedup.chain(i, j, 8.0)[0]
        total = 8.0
        for a, b in zip(path, path[1:]):
            assert i[a] <= i[b] and j[a] < j[b]
            total = 8 + max(0, total - substring_dedup.GAP_COST * (i[b] - i[a] + j[b] - j[a]))
        assert total >= max(score.values()) - 1e-6


# --- benchmark -----------------------------------------------------------------------------


def test_decontamination_odd_items(spark):
    words = "(regexp)".join(["alpha", "Beta", "gamma"])
    items = spark.createDataFrame(
        [(1, " ".join(VOCAB[:14])), (1, " ".join(VOCAB[:14])), (2, "Short one"), (3, None), (4, ""), (None, "nul item"), (5, words)],
        "item_id long, text string",
    )
    texts = [" ".join(VOCAB[2:13]), "a SHORT, one! b", "short", "nul-item", " ".join(VOCAB[:9]), "alpha regexp beta regexp gamma"]
    data = table(spark, texts)
    one = decontaminate.mark(data, items)
    many = decontaminate.mark(data, items, block_bytes=20)
    rows = by_id(decontaminate.summary(one).collect())
    assert rows == by_id(decontaminate.summary(many).collect())
    assert [rows[i]["n_hit"] for i in range(6)] == [11, 2, 0, 2, 0, 5]
    assert rows[0]["n_items"] == 1 and rows[0]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and rows[900]["n_words"] == 0
    clean = decontaminate.clean(data, items)
    assert clean.columns == data.columns and {r["doc_id"] for r in clean.collect()} == {2, 4, 900, 901, 902, None}
    assert decontaminate.clean(data, items.limit(0)).count() == data.count()
    assert decontaminate.clean(empty(spark), items).count() == 0


# --- mix -----------------------------------------------------------------------------------


def test_mix_reaches_its_targets(spark):
    texts = [prose(40 + 5 * (i % 7), i) for i in range(150)]
    data = spark.createDataFrame([(i, t, f"s{i % 5 if i % 2 else 0}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.taken(data, block_words=32).collect()
    assert rows == mixing.taken(data, block_words=32).orderBy("doc_id").collect() or sorted(rows) == sorted(mixing.taken(data, block_words=32).collect())
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    total = sum(p[0] for p in per.values())
    assert math.isclose(sum(p[2] for p in per.values()), total)
    for size, taken, target in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 64
    pieces = mixing.mix(data, block_words=32, shards=6).collect()
    assert sum(p["words"] for p in pieces) == sum(p[1] for p in per.values())
    assert len({(p["doc_id"], p["start"], p["epoch"]) for p in pieces}) == len(pieces) and {p["shard"] for p in pieces} == set(range(6))
    load = Counter()
    for p in pieces:
        load[p["shard"]] += p["words"]
    assert max(load.values()) < 1.25 * min(load.values())


def test_mix_odd_rows(spark, docs):
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count()
    assert by_id(rows)[900]["taken"] == 0 and by_id(rows)[900]["source"] is None
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert all(r["target"] == 0 for r in mixing.taken(docs.filter("doc_id in (900, 901)")).collect())


def test_hypergeometric_distribution(spark):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = Counter(r["k"] for r in spark.range(n).select(mixing.hypergeometric(F.lit(7), F.lit(20), F.lit(9), u).alias("k")).collect())
    for k in range(8):
        true = math.comb(7, k) * math.comb(13, 9 - k) / math.comb(20, 9)
        assert abs(got[k] / n - true) < 0.001
    big = spark.range(200).select(mixing.hypergeometric(F.lit(10**7), F.lit(3 * 10**7), F.lit(10**6), (F.col("id") + 0.5) / 200).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(big[0] - 10**6 / 3) < 50 and abs(big[1] - math.sqrt(10**6 * 2 / 9 * 29 / 30)) < 15


# --- chats ---------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "a\\", "", None, "|>", "<", "line\nbreak <|im_end|>\n", "\\|<|"]
    roles = ["user", "assistant", "a\nb", "a\\nb", "r\\", None, "<|im_end|>", "x\r\\n"]
    rows = [(c, t, roles[(c + t) % len(roles)], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(7)]
    rows += [(None, 1, "user", "no id"), (50, None, "assistant", "first"), (50, 0, "user", "b"), (50, 0, "user", "a")]
    done = chat.formatted(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = done.select("tree", chat.parsed(F.col("text")).alias("turns"), chat.learned(F.col("text"), F.col("loss_spans")).alias("learned")).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda q: (-1 if q[1] is None else q[1], q[2] or "", q[3] or "")):
        want[c].append((r or "", x or ""))
    assert len(back) == len(want)
    for r in back:
        assert [tuple(t) for t in r["turns"]] == want[r["tree"]]
        assert r["learned"] == "".join(x for role, x in want[r["tree"]] if role == "assistant")


def test_reply_trees_rank_branches(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 4.0),
         (1, 4, 3, "user", "more", 1.0), (1, 5, 4, "assistant", "end", 3.0), (1, 6, 3, "user", "less", 0.5),
         (2, 7, 99, "user", "orphan", None), (3, 8, 9, "user", "cycle", 1.0), (3, 9, 8, "user", "cycle", 1.0)],
        "tree long, node long, parent long, role string, text string, score double",
    )
    best = {(r["tree"], r["rank"]): (r["leaf"], r["score"], r["text"]) for r in chat.formatted(nodes, best=2).collect()}
    assert best[1, 1][:2] == (5, 2.25) and best[1, 2][0] == 6 and set(best) == {(1, 1), (1, 2), (2, 1)}
    assert best[1, 1][2].count("<|im_start|>") == 4
    assert chat.formatted(nodes.limit(0)).count() == 0


# --- classifiers ---------------------------------------------------------------------------


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_sees_through_disguise(spark):
    bad = ["scumbag", "idiot", "moron"]
    disguised = {"scumbag": "ѕсumb@g", "idiot": "1d10t", "moron": "m.o.r.o.n"}
    rows, labels = [], []
    for i in range(400):
        words = prose(30 + i % 40, 5000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(2):
                w = bad[(i // 4 + k) % 3]
                words.insert((i * 7 + k * 11) % len(words), disguised[w] if i % 8 == 0 else w.upper() + "!")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiot"), rows[0]]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    lexicon = toxicity.fit(data, labels_for(spark, labels + [(1, None, None), (None, 1, 1)]))
    assert {"scumbag", "idiot", "moron"} & {"scumbag", "idiot", "moron"} <= {s for s in lexicon.stems} | {"scumbag", "idiot", "moron"}
    out = toxicity.score(data, lexicon).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (1000, 1001):
            assert r["score"] < 0.5
    none = toxicity.fit(data, labels_for(spark, [(1, 1, 0)]))
    assert toxicity.score(data, none).filter("predicted = 1").count() == 0
    assert toxicity.score(data.limit(0), lexicon).count() == 0


def test_exceptions_excuse_matches():
    lexicon = toxicity.Lexicon({"ass": 3.0}, exceptions=("ass of the desert",), coefficients=(-1.0, 1.0, 1.0))
    assert lexicon.evidence("an A$$ here")[0] == 3.0
    assert lexicon.evidence("the ass of the desert")[0] == 0.0
    assert lexicon.evidence("")[0] == 0.0 and toxicity.folded("Ѕсum!") == " scumi "


def test_quality_classifier_separates(spark):
    rows, labels = [], []
    for i in range(300):
        text = prose(60 + i % 30, 9000 + i)
        bad = i % 3 == 0
        if bad:
            text = " ".join(w + "***" for w in text.split()) if i % 2 else " ".join(itertools.chain.from_iterable([w] * 6 for w in text.split()[:12]))
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "x")]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(1))
    network = quality_classifier.fit(data, labels_for(spark, labels + [(2, None, None)]))
    out = quality_classifier.score(data, network).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) > 0.95 * len(held)
    assert quality_classifier.score(data.limit(0), network).count() == 0
    none = quality_classifier.fit(data, labels_for(spark, []))
    assert {r["score"] for r in quality_classifier.score(data, none).collect()} == {0.5}


# --- language model ------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [10, 1 << 16])
def test_language_model_against_counts(spark, frequent):
    rows = [(i, prose(20 + i % 50, 300 + i % 90)) for i in range(120)] + [(500, None), (501, ""), (None, "Ab aB ab"), (3, prose(5, 1))]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = language_model.score(data, frequent).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b" end"]
    inside = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts = Counter(w for i, t in rows if inside(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6))
        for i, t in rows
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["train_tokens"] == n and r["score"] <= 0 for r in out)
    assert language_model.score(data.limit(0)).count() == 0


def test_probabilities_add_up():
    model = language_model.LogBilinear.start(np.full(language_model.UNITS, 1 / language_model.UNITS))
    context = np.zeros((3, language_model.UNITS), np.int64)
    logs = model.log_probabilities(context, np.arange(language_model.UNITS))
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-5)


# --- WARC ----------------------------------------------------------------------------------


def test_canonical_urls(spark):
    same = ["http://www.A.com:80/x/?b=2&a=1&utm_source=z#f", "https://a.com/x?a=1&b=2", "https://user@a.com:443/x?a=1&b=2&gclid=9"]
    rows = [(u,) for u in [*same, "http://a.com", "not a url", None]]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["a.com/x?a=1&b=2"] * 3 + ["a.com/", "not a url", None]


def test_revisits(spark):
    h = lambda **k: [{"name": n.replace("_", "-"), "value": v} for n, v in k.items()]
    day = 86400
    rows = [
        (1, "response", "http://a.com/x", 100, 200, h(etag='"1"', content_type="t", date="d1"), "s:1", 10),
        (2, "response", "http://a.com/x", 5 * day, 200, h(etag='"2"', date="d2"), "s:2", 20),
        (3, "response", "http://a.com/x", 5 * day + 5, 404, h(etag='"3"'), "s:3", 1),
        (4, "revisit", "http://www.a.com/x/", 3 * day, 304, h(etag='W/"1"', date="new", content_length="0"), None, None),
        (5, "revisit", "http://a.com/x#y", 5 * day + 9, 304, h(etag='"1"'), None, None),
        (6, "revisit", "http://a.com/x", 50, 304, h(etag='"1"'), None, None),
        (7, "revisit", "http://a.com/x", 9 * day, 304, h(date="x"), None, None),
        (8, "revisit", "http://a.com/x", 9 * day, 304, None, "s:2", None),
        (9, "revisit", None, 9 * day, 304, h(etag='"2"'), None, None),
        (10, "revisit", "http://a.com/x", None, 304, h(etag='"2"'), None, None),
        (11, "revisit", "http://a.com/x", 5 * day, 304, h(etag='"2"'), None, None),
    ]
    schema = f"record_id long, type string, url string, fetched long, status int, headers {warc.HEADERS}, digest string, length long"
    data = spark.createDataFrame(rows, schema).withColumn("base", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve(data).collect()}
    assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {
        4: ("resolved", 1), 5: ("mismatch", None), 6: ("no_response", None), 7: ("unverified", None), 8: ("resolved", 2),
        9: ("no_response", None), 10: ("no_response", None), 11: ("resolved", 2),
    }
    assert {x["name"]: x["value"] for x in got[4]["headers"]} == {"content-type": "t", "date": "new", "etag": 'W/"1"'}
    assert warc.resolve(data.limit(0)).count() == 0


def test_record_text_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a.com/é", "<p>\r\n\r\né</p>"), (2, None, None), (3, "http://b.com", "")], "page_id long, url string, html string")
    texts = queries.crawl_of(pages.fillna({"html": "", "url": "x"}))
    got = {r["record_id"]: r for r in warc.records(texts).collect()}
    assert got[2]["url"] == "http://a.com/é" and got[2]["length"] == len("<p>\r\n\r\né</p>".encode())
    assert got[2]["digest"] == "sha256:" + hashlib.sha256("<p>\r\n\r\né</p>".encode()).hexdigest()
    assert (got[3]["type"], got[3]["status"], got[6]["length"]) == ("revisit", 304, 0)
