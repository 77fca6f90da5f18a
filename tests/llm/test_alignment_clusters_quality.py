"""Token alignment, centroid clustering and quality rules against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabkit.llm import centroids, quality_rules, queries, token_alignment

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def paths():
    import public_tokenizers

    return public_tokenizers.path(token_alignment.BYTE_BPE), public_tokenizers.path(token_alignment.PIECE_BPE)


# 11 -----------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, seed, scale=256):
    """Plain rounds over (vec_id, components) that are all usable."""
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        held = {}
        for _, v in x:
            held.setdefault(near(v)[1], []).append(v)
        for i, vs in held.items():
            centres[i] = [sum(c) // len(vs) for c in zip(*vs)]
    placed = [(i, *near(v)) for i, v in x]
    total = Counter()
    for _, d, c in placed:
        total[c] += d
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, c, d, total[c], sum(total.values()), named[c]) for i, d, c in placed)


@pytest.mark.parametrize("spread", [1, 4, 60, 5000])
def test_threshold_walk_finds_the_nearest_with_ties(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (500, 6))
    c = np.concatenate([rng.integers(-spread, spread + 1, (17, 6)), x[:3], x[:3]])
    who, distance, taken = centroids.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()
    assert taken <= every.size


def test_threshold_walk_stops_early_where_few_dimensions_tell():
    x = np.random.default_rng(1).integers(0, 100_000, (2000, 2))
    _, _, taken = centroids.nearest(x, x[:200])
    assert taken < 0.3 * len(x) * 200


def test_clusters_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(4)]) for i in range(240)] + [(7, [0.5] * 4), (7, [0.5] * 4), (999, [-3.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, _ = centroids.cluster(df, k=9, rounds=4, width=4)
    assert sorted(tuple(r) for r in found.collect()) == brute_clusters(rows, 9, 4, centroids.SEED)


@needs_tables
def test_registered_clusters_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    found = queries.op11_centroids(spark, FOLDER)
    assert sorted(tuple(r) for r in found.collect()) == brute_clusters(rows, 40, 5, 2)


def test_unusable_vectors_have_no_row(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (None, [0.3, -0.2]), (3, None), (4, [0.1]), (5, [0.1, None]), (6, [nan, 0.0]), (7, [0.0, -inf]), (8, []), (9, [1e30, 0.0]), (1, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("mine"), "x": F.lit(1), "distance": F.lit(2.0)})
    found = centroids.cluster(df, width=2)[0].collect()
    assert sorted((r["vec_id"] or 0) for r in found) == [0, 1, 1]
    assert all(r["inertia"] == 0 for r in found)
    empty, none = centroids.cluster(df.limit(0), width=2)
    assert empty.count() == 0 and len(none) == 0 and empty.columns == centroids.cluster(df, width=2)[0].columns


def test_a_cluster_that_empties_stays(spark):
    # centroids 0, 1 start on the same point: all of its rows go to the first
    rows = [(i, [float(i // 6)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in centroids.cluster(df, k=5, rounds=3, width=1)[0].collect()) == brute_clusters(rows, 5, 3, 2)


# 12 -----------------------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Whole texts through both libraries; byte sets of both ends; links counted over all texts."""
    pair = token_alignment._pair_of(*paths())
    rows, links = [], []
    for text in texts:
        own = (" " + (text or "")).encode()
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if not text or b"".join(pair.bytes_a[i] for i in a) != own or b"".join(pair.bytes_b[i] for i in b) != own:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, found = 0, []
            for i in ids:
                at += len(table[i])
                found.append(at)
            ends.append(found)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for e in both:
            held = [[str(i) for i in ids[bisect_right(at, before) : bisect_right(at, e)]] for ids, at in ((a, ends[0]), (b, ends[1]))]
            groups.append("|".join(map(",".join, held)))
            before = e
        rows.append((len(a), len(b), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        by_end = {}
        for j, y in zip(b, ends[1]):
            by_end.setdefault(y, []).append(j)
        links.append([(i, j) for i, x in zip(a, ends[0]) for j in by_end.get(x, [])])
    count = Counter(p for one in links for p in one)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(*r, len(one), sum(count[p] == top[p[1]] for p in one), sum(count[p] for p in one)) for r, one in zip(rows, links)]


NAMES = ["n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
STRANGE = [
    "the  a b", " lead", "trail ", "tab\tand\nline \n end", "nbsp x    y", "mark ▁ in", "a▁b", "<s> <|endoftext|> </s>", "naïve café Zürich – “quotes”",
    "日本語 のテキスト 🙂 👩‍👩‍👧", "don't we'll I'M", "x　y 　z", "᠎ ᠎ a ᠎ b", "a \x1c b \x85 c", "...!!! ### 12 345,678", "\r\n\r\n  a\r", " ", "   ", "é ́ x", "\x00 a \x00", "﻿bom a",
]


def test_alignment_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", *STRANGE, *("".join(rng.choice(["the ", "un", "ing ", " ", "\n", "é", "Straße ", "x", ", ", "2 ", "  "]) for _ in range(rng.randrange(1, 120))) for _ in range(60)), "same text", "same text", "word " * 20_000, "y" * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = token_alignment.alignment_summary(df, *paths()).orderBy("doc_id").select(*NAMES).collect()
    for text, got, want in zip(texts, found, brute_alignment(texts)):
        assert tuple(got) == want, (text or "")[:80]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" ▁\n\t'a1.e ́"), max_size=40), min_size=1, max_size=5))
def test_parts_give_what_whole_texts_give(texts):
    pair = token_alignment._pair_of(*paths())
    want = brute_alignment(texts)
    for text, found, (n_a, n_b, n_groups, digest, n_links, _, _) in zip(texts, pair.of_texts(texts, "ends"), want):
        parts = token_alignment.whole(text, found)
        got = token_alignment._row(text, parts)
        assert got[:4] == (n_a, n_b, n_groups, n_links)
        assert (hashlib.sha256(got[4].encode()).hexdigest() if got[0] else "") == digest


def test_parts_side_by_side_and_met_parts_left_alone():
    """A part's alignment does not hang on those encoded with it, and parts already known are not written again."""
    import public_tokenizers

    pair = token_alignment.Pair(*(str(public_tokenizers.path(n)) for n in (token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)))
    parts = ["", " ", "one", "two\n", "thr\u0000ee", "ﬁve", "<unk>", "</s>six", "▁", "a▁", "\tb", "\u3000c", "\u180ed", "é" * 9, *(f"w{i}" for i in range(150))]
    for linked in ("ends", "overlaps"):
        together = pair.align(parts, linked)
        assert together == [pair.align([p], linked)[0] for p in parts]
        assert any(a.wrong for a in together) and not all(a.wrong for a in together)
    assert pair._left([" " + p for p in parts]) == [pair.a.encode(" " + p, add_special_tokens=False).ids for p in parts]

    class Counted(dict):
        added = 0

        def update(self, items):
            items = list(items)
            self.added += len(items)
            super().update(items)

    pair.known["ends"] = known = Counted()
    texts = ["one two three", "two three four"]
    first = list(pair.of_texts(texts, "ends"))
    once = known.added
    assert once == len(known) > 0
    assert list(pair.of_texts(texts, "ends")) == first and known.added == once


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = random.Random(2)
    for _ in range(60):
        size = [[], []]
        texts = rng.randrange(1, 4)
        per = [[], []]
        for _ in range(texts):
            total = rng.randrange(1, 20)
            for side in (0, 1):
                cuts = sorted(rng.sample(range(1, total), rng.randrange(0, total)) if total > 1 else []) + [total]
                size[side] += [b - a for a, b in zip([0, *cuts], cuts)]
                per[side].append(len(cuts))
        ids = [np.arange(len(s)) + 1000 * k for k, s in enumerate(size)]
        arrays = [np.array(v) for v in (size[0], per[0], size[1], per[1])]
        _, pairs = token_alignment.coalesce(ids[0], arrays[0], arrays[1], ids[1], arrays[2], arrays[3])
        ends = [np.cumsum(s) for s in size]
        want = {(int(i), int(j)) for i, (e, s) in enumerate(zip(ends[0], size[0])) for j, (f, t) in enumerate(zip(ends[1], size[1])) if e - s < f and f - t < e}
        got = {(p >> 32, (p & 0xFFFFFFFF) - 1000) for one in pairs for p in one}
        assert got == want


def test_rare_and_common_pairs_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat the cat sat", "the dog", "a cat in a hat", "Zug um Zug", ""])], "doc_id long, text string")
    rows = token_alignment.align(token_alignment.numbered(df), *paths(), "ends")
    want = sorted(tuple(r) for r in token_alignment.with_counts(rows).select("doc_id", "n_best", "count_sum").collect())
    for hot in (0, 3):
        assert sorted(tuple(r) for r in token_alignment.with_counts(rows, hot).select("doc_id", "n_best", "count_sum").collect()) == want


def test_alignment_of_awkward_rows(spark):
    rows = [(None, "x y"), (1, None), (1, "x y"), (1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_a", "pairs", "groups", "n_best", "row")})
    found = token_alignment.alignment_summary(df, *paths())
    assert sorted(r["n_a"] for r in found.collect()) == [0, 2, 2, 2]
    assert token_alignment.alignment_summary(df.limit(0), *paths()).count() == 0
    carried = token_alignment.align(df, *paths())
    assert carried.columns == ["doc_id", "n_best", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


# 13 -----------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é|\x0b\x85日"), max_size=120))
def test_counts_against_brute_force(text):
    assert quality_rules.measure(text)[0] == brute_counts(text)


def test_repeated_windows_of_large_vocabularies():
    rng = random.Random(1)
    words = [f"w{rng.randrange(20_000)}".encode() for _ in range(30_000)]
    words[20_000:20_040] = words[100:140]
    assert quality_rules.repeated_words(words) == brute_counts(" ".join(w.decode() for w in words))[4] >= 80


def test_forest_scores_against_a_walk_by_hand():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(250, 3)), [[9.0, 9.0, 9.0]], [[0.0, 0.0, 0.0]] * 5])
    trees = [quality_rules.grow(x, np.random.default_rng(i)) for i in range(30)]
    forest = quality_rules.Forest(trees, len(x))

    def path(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = int(tree[at][2]) + (row[int(tree[at][0])] > tree[at][1])
        return tree[at][3]

    by_hand = [2 ** (-np.mean([path(t, row) for t in trees]) / quality_rules.usual_path(len(x))) for row in x]
    found = forest.score(x)
    assert np.allclose(found, by_hand)
    assert found.argmax() == 250 and found[250] > 0.6 > 0.5 > np.median(found)


def test_cut_between_the_kinds():
    good, poor = np.zeros(10), np.zeros(10)
    good[[1, 2]], poor[[7, 8]] = 50, 5
    assert quality_rules.best_cut(good, poor) == pytest.approx(0.5)
    assert quality_rules.best_cut(good, poor * 0) == 2.0
    poor[1] = 40  # poor texts that look like good ones are left in
    assert quality_rules.best_cut(good, poor) == pytest.approx(0.5)


def labelled(spark, copies=0):
    rng = random.Random(8)
    words = ["".join(rng.choice(["an", "be", "co", "du", "el", "fi", "go"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) + (rng.choice("#$%&") * 3 if i % 9 == 0 else "") for _ in range(rng.randrange(30, 90))) + ".") for i in range(900)]
    rows += [(10_000 + i, "the same poor | text | with | bars | and | nothing | else | in | it") for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(0, 900, 2)], "doc_id long, quality int")
    return docs, labels


@pytest.mark.parametrize("copies", [0, 600])
def test_poor_texts_go_and_clean_ones_stay(spark, copies):
    docs, labels = labelled(spark, copies)
    found = {r["doc_id"]: r for r in quality_rules.judged(docs, labels, trees=60, sample=128).collect()}
    poor = [r["kept"] for i, r in found.items() if i < 900 and i % 9 == 0]
    clean = [r["kept"] for i, r in found.items() if i < 900 and i % 9]
    assert sum(poor) <= 0.1 * len(poor) and sum(clean) >= 0.98 * len(clean)
    again = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs.repartition(7), labels, trees=60, sample=128).collect()}
    assert again == {i: r["kept"] for i, r in found.items()}


def test_quality_of_awkward_rows(spark):
    rows = [(None, "x y"), (1, None), (2, ""), (3, " \n "), (4, "tie " * 50_000), (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_words", "kept", "shares", "anomaly", "copies", "tree")})
    labels = spark.createDataFrame([(None, 1), (5, None), (4, 0)], "doc_id long, quality int")
    found = quality_rules.judged(docs, labels).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in found) == [(0, 2, True, False), (1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 50_000, True, False), (5, 10, False, True), (5, 10, False, True)]
    assert quality_rules.judged(docs.limit(0), labels).count() == 0


@needs_tables
def test_registered_quality_counts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op13_quality_rules(spark, FOLDER).collect():
        n, chars, symbols, lines, repeated = brute_counts(texts[r["doc_id"]])
        failed = n < 10 or 100 * repeated > 20 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert not (failed and r["kept"])


@needs_tables
def test_registered_alignment_against_brute_force(spark):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = sorted(table)
    want = dict(zip(ids, brute_alignment([table[i] for i in ids])))
    for r in queries.op12_token_alignment(spark, FOLDER).collect():
        assert tuple(r[c] for c in NAMES) == want[r["doc_id"]]
