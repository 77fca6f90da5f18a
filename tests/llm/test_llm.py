"""The text operators against brute force, and on awkward rows: nulls, empty and long texts, ties, clashing names."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabkit.llm import common, decontaminate, language_id, line_dedup, mixing, pq_dedup, queries, sharding, simhash, suffix_dedup, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def awkward(spark):
    """Null id, text and source; empty, blank and long texts; repeated rows; clashing column names."""
    rows = [(1, None, "en", "a", 0), (None, "x y z", None, None, 5), (2, "", "en", "b", 0), (3, "  \n ", "de", "b", 4), (4, "tie " * 50_000, "en", "a", 0), (5, "same text", "en", "a", 9), (5, "same text", "en", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("mine") for n in ("fp", "component_id", "shard", "slot", "size", "copies", "n_words", "n_hit", "score", "n_tokens", "row", "key")})


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_difference_cover_meets_every_pair():
    for bits in (1, 2, 3, 4):
        v, members = suffix_dedup.difference_cover(bits)
        inside = set(members.tolist())
        assert len(members) == 2**bits + 1
        assert {(a - b) % v for a in inside for b in inside} == set(range(v))


def test_repeated_bytes_against_brute_force(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = noise(700), noise(450)
    texts = [
        noise(900), passage + noise(50), noise(300) + passage + noise(300), noise(10) + passage[:420], other + noise(5) + other,
        "ab" * 600, "ab" * 210, passage, passage, noise(399), noise(200) + passage[100:499] + noise(3), None, "", "é" * 401,
        noise(2000) + other[20:] + passage[5:650], "ab" * 199 + "a", passage[:350] + "X" + passage[351:],
    ]
    docs = common.numbered(documents(spark, texts, n_bytes="mine", whole=1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 400)


def test_buckets_of_names_meet_in_no_task(spark):
    met = suffix_dedup._dealt(spark.range(93).select((F.col("id") % 31).cast("int").alias("bucket")), 31)
    held = met.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("bucket").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert [(r["n"], r["rows"]) for r in held] == [(1, 3)] * 31


def test_strings_around_marks_are_counted(spark):
    v, _ = suffix_dedup.difference_cover()
    rng = random.Random(11)
    marks = [[5_000], [1_000, 900, 3_000], list(range(2_000, 2_600)), [], rng.sample(range(500, 9_000), 200), [400 * i + 300 for i in range(20)]]
    df = spark.createDataFrame(list(enumerate(marks)), "id int, open array<int>").select("id", suffix_dedup._strings(F.col("open"), v).alias("n"))
    named = [int(suffix_dedup._cover(10_000, np.array(m, np.int64) - v + 1, v).sum()) for m in marks]
    assert [r["n"] for r in df.orderBy("id").collect()] == named


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_links(prints, radius=4):
    return {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}


def test_fingerprint_by_hand():
    import xxhash

    words = "A b C d e".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in (0, 1)]
    assert simhash.fingerprint("A b\tC d\n e") == hashes[0] & hashes[1]  # over half of two is both
    assert simhash.fingerprint("Ab") == xxhash.xxh64_intdigest(b"ab", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_bk_trees_lose_no_link(spark, shard_rows):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), shard_rows=shard_rows)
    label = {p: p for p, in signed}
    for r in common.components(edges).collect():
        label[r["node"]] = r["component"]
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in brute_links(prints):
        parent[root(a)] = root(b)
    as_signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = {}
    for p in prints:
        want.setdefault(root(p), set()).add(as_signed(p))
    got = {}
    for p, c in label.items():
        got.setdefault(c, set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_repeated_and_null_ids_keep_one_row_a_component(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    unlike = [prose(60) for _ in range(6)]
    while True:  # a near copy within the radius
        base = prose(400).split()
        copy = [*base[:-1], "other"]
        apart = (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(copy))).bit_count()
        if 0 < apart <= 4:
            break
    rows = [(-1, t, "en", "a", 0) for t in unlike] + [(None, " ".join(base), "en", "a", 0), (None, " ".join(copy), "en", "a", 0)]
    kept = [r["text"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept) == sorted([*unlike, next(t for t in kept if t not in unlike)]) and len(kept) == 7


def brute_groups(texts):
    """Per text the smallest index reachable over fingerprints at most four bits apart, all pairs compared."""
    prints = [simhash.fingerprint(t) for t in texts]
    least = list(range(len(texts)))
    while True:
        now = [min(least[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
        if now == least:
            return least
        least = now


def near_texts(rng, groups, words=150):
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        texts += [" ".join(base)] * 2
        for changed in (1, 1, 2, 6):
            copy = list(base)
            for at in rng.sample(range(words), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


def test_pipeline_stage_keeps_one_text_of_each_group(spark):
    import corpus_pipeline

    texts = near_texts(random.Random(12), 40)
    texts[7] = None
    want = {i for i, least in enumerate(brute_groups(texts)) if i == least}
    docs = documents(spark, texts, fp="mine", component_id=7)
    got = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert {r["doc_id"] for r in got.collect()} == want and 40 < len(want) < 200 and got.columns == docs.columns


def test_pipeline_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = near_texts(rng, 30, 200) + [" ".join(word() for _ in range(rng.randrange(40, 300))) for _ in range(200)]
    toxic = set(range(len(texts), len(texts) + 60))
    texts += [" ".join([word() for _ in range(40)] + ["zorkwit"] + [word() for _ in range(40)]) for _ in toxic]
    items = [" ".join(word() for _ in range(20)) for _ in range(5)]
    planted = set(range(len(texts), len(texts) + 20))
    texts += [" ".join([word() for _ in range(60)] + [items[i % 5]] + [word() for _ in range(60)]) for i in range(20)]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stays = [i for i in range(len(texts)) if i not in toxic]
    least = brute_groups([texts[i] for i in stays])
    stays = [i for n, i in enumerate(stays) if least[n] == n and i not in planted]
    source = {i: rows[i][3] for i in stays}
    words = {s: sum(len(texts[i].split()) for i in stays if source[i] == s) for s in set(source.values())}
    targets = mixing.source_targets(words, mixing.WEIGHTS, mixing.MOST)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = {i: 0 for i in stays}
    for r in out:
        assert (r["text"], r["source"], r["n_chars"]) == (texts[r["doc_id"]], source[r["doc_id"]], len(texts[r["doc_id"]]))
        times[r["doc_id"]] += 1
    assert set(times) == set(stays)  # nothing from outside the brute-force survivors
    for s in words:
        rate = targets[s] / words[s]
        assert all(int(rate) <= times[i] <= -(-rate // 1) for i in stays if source[i] == s)
        taken = sum(times[i] * len(texts[i].split()) for i in stays if source[i] == s)
        assert abs(taken - targets[s]) < 2 * max(len(texts[i].split()) for i in stays)
    size = {}
    for r in out:
        size.setdefault(r["shard"], []).append((r["slot"], len(r["text"].encode()) + 1))
    assert all(sorted(slot for slot, _ in rows) == list(range(len(rows))) for rows in size.values())
    loads = [sum(n for _, n in rows) for rows in size.values()]
    assert set(size) <= set(range(16)) and max(loads) - min(loads) < 3 * max(len(t) + 1 for t in texts if t)


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in common.components(path).collect()} == {0}


# 4 ------------------------------------------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared():
    targets = mixing.source_targets({"a": 10, "b": 1000, None: 990})
    assert targets["a"] == 30 and sum(targets.values()) == pytest.approx(2000)
    assert targets["b"] == pytest.approx(1970 * 2 / 3)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    docs = documents(spark, [" ".join(["w"] * rng.randint(0, 60)) for _ in range(3000)])
    rows = docs.select("source", mixing.words().alias("size"), "doc_id")
    runs = [sorted(map(tuple, mixing.plan_mix(r).select("doc_id", "copies").collect())) for r in (rows, rows.repartition(7))]
    assert runs[0] == runs[1]
    out = mixing.plan_mix(rows).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"))
    assert all(abs(r["taken"] - r["target"]) <= 60 and r["most"] <= 3 for r in out.collect())
    assert mixing.mix_documents(docs).count() == sum(c for _, c in runs[0])


# 5 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_tolerates_gaps_and_insertions(spark):
    rng = random.Random(7)
    syllables = ["ka", "lo", "mi", "ren", "tus", "vel", "dor", "pa", "sin", "gre"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    insults = ["zqwack", "bhooby", "fzunge"]
    clean, toxic = [prose(80) for _ in range(400)], [f"{prose(40)} {rng.choice(insults)} {prose(40)}" for _ in range(200)]
    machine = toxicity.train(toxic, clean)
    tests = [prose(50) + " zq-wack", "z q w a c k", "bhoXoby " + prose(50), prose(2000), "", None]
    docs = documents(spark, tests, score="mine")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, machine).collect()}
    assert [got[i] >= 0.5 for i in range(6)] == [True, True, True, False, False, False]
    assert toxicity.train([], clean).score(np.array([[-1.0, -2.0]]))[0] < 0.5


def brute_features(word):
    """Weight of every subsequence of three signs, by its letters, spelled out."""
    signs = [toxicity.MARK] + [int(toxicity._CODE[ord(c)]) for c in word if toxicity._CODE[ord(c)]]
    found = {}
    for i in range(len(signs)):
        for j in range(i + 1, len(signs)):
            for k in range(j + 1, min(len(signs), i + toxicity.SPAN)):
                slot = (signs[i] * toxicity.LETTERS + signs[j]) * toxicity.LETTERS + signs[k]
                found[slot] = found.get(slot, 0.0) + toxicity.DECAY ** (k - i + 1)
    return found


def test_kernel_and_folded_machine_equal_brute_force():
    words = ["idiot", "idixot", "banana", "i.d.i.o.t", "Straße", "anananananananana" * 40]
    feats = [brute_features(w) for w in words]
    dot = lambda a, b: sum(v * b.get(slot, 0.0) for slot, v in a.items())
    want = np.array([[dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) for b in feats] for a in feats])
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-4)
    slots, weights = toxicity.long_word(words[-1])  # a long word adds up from stretches
    assert np.allclose([feats[-1][s] for s in slots], weights) and len(slots) == len(feats[-1])
    used, marks = toxicity.landmark_table(words[:3])
    table = np.zeros(toxicity.LETTERS**3, np.float32)
    table[used] = marks @ np.array([1.0, 2.0, -0.5], np.float32)
    raw = want[:, :3] @ np.array([1.0, 2.0, -0.5])
    assert np.allclose(toxicity.Machine(table, -1.0).margins([*words, "abc"]), np.append(np.maximum(raw, 0) - 1, -1), atol=1e-4)


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    table = rng.normal(size=toxicity.LETTERS**3).astype(np.float32)
    machine = toxicity.Machine(table, -1.0, np.array([0.7, 0.2]), 0.1, 1.5)
    texts = ["idiot and banana trees", "", None, "idiot idiot! IDIOT", "a b c d e", "xy z", "banana " * 3000]
    best = []
    for text in texts:
        found = set()
        for word in toxicity.words_of(text):
            f = brute_features(word)
            if len([c for c in word if toxicity._CODE[ord(c)]]) >= toxicity.LEAST_LETTERS:
                raw = sum(v * float(table[s]) for s, v in f.items())
                found.add(round(-1 + max(0.0, raw / sum(v * v for v in f.values()) ** 0.5), 3))
            else:
                found.add(-1.0)
        top = [min(m, toxicity.MOST_MARGIN) for m in sorted(found, reverse=True)[:2]]
        best.append(top + [toxicity.LEAST_MARGIN] * (2 - len(top)))
    want = machine.score(np.array(best))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(documents(spark, texts), machine).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=2e-3)


def test_held_out_rows(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), toxicity.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


# 6 ------------------------------------------------------------------------------------------------------------------


def test_contamination_of_short_items_and_ties(spark):
    item = " ".join(f"w{i}" for i in range(20))
    texts = [f"Intro {item.upper()} end", "one TWO three", "same same same same", item.replace("w7", "x"), None, "", "alone"]
    items = spark.createDataFrame([(1, item), (2, "two three"), (3, "same same"), (4, None), (5, "alone"), (6, "alone")], "item_id long, text string")
    docs = common.numbered(documents(spark, texts, n_hit="mine"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {0: (22, 20, 1, True), 1: (3, 2, 1, True), 2: (4, 4, 1, True), 3: (20, 0, 0, False), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (1, 1, 2, True)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark, texts), items).collect()) == [3, 4, 5]


def brute_near(words, item, slack=1):
    """Is one of the item's windows near some start, looked at term by term."""
    places = {}
    for p, pair in enumerate(zip(words[:-1], words[1:], strict=True)):
        places.setdefault(pair, set()).add(p)
    for i in range(max(1, len(item) - 12)):
        cut = item[i : i + 13]
        pairs = list(zip(cut[:-1], cut[1:], strict=True))
        bases = {p - off + d for off, pair in enumerate(pairs) for p in places.get(pair, ()) for d in range(-slack, slack + 1)}
        for base in bases:
            found = sum(any(base + off + d in places.get(pair, ()) for d in range(-slack, slack + 1)) for off, pair in enumerate(pairs))
            if found >= len(pairs) - len(pairs) // 4:
                return True
    return False


def test_proximity_against_brute_force(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 12, n)]
    items = {i: draw(int(rng.integers(2, 30))) for i in range(25)}
    texts = [draw(60) for _ in range(30)]
    for i in range(25):  # an item with words put in, dropped and changed
        edited = [w for w in items[i] for w in ([w] if rng.random() > 0.1 else [[], [w, "x"], ["y"]][rng.integers(0, 3)])]
        texts.append(draw(8) + edited + draw(8))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = common.numbered(documents(spark, [" ".join(t) for t in texts]))
    got = {r["doc_id"]: r["n_near_items"] for r in decontaminate.contamination(docs, table).collect()}
    assert got == {d: sum(brute_near(t, item) for item in items.values()) for d, t in enumerate(texts)}
    assert {0, 1} <= set(got.values())


def test_passage_with_a_word_put_in_and_one_dropped_every_dozen(spark):
    item = [f"w{i}" for i in range(60)]
    loose = [w for i, w in enumerate(item) for w in ([] if i % 12 == 9 else [w, "extra"] if i % 12 == 3 else [w])]
    texts = [" ".join(loose), " ".join(item), " ".join(item[::-1]), " ".join(w for i, w in enumerate(item) if i % 3)]
    docs = common.numbered(documents(spark, texts))
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near_items"]) for r in decontaminate.contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: (0, 0, 1), 1: (60, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


# 7 ------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    texts = [f"text {i} " * (i % 40) for i in range(4000)] + ["copy " * 30] * 100 + ["hot " * 30] * 3000
    placed = sharding.plan_shards(sharding.keyed(documents(spark, texts), "doc_id"), rows_per_piece=500).collect()
    assert len(placed) == len(texts)
    sizes, slots, of_text = {}, {}, {}
    for r in placed:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert max(sizes.values()) < 1.02 * min(sizes.values()) and len(sizes) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [t for t, s in of_text.items() if len(s) > 1] == ["hot " * 30]


# 8 ------------------------------------------------------------------------------------------------------------------


def test_lines_near_the_threshold_are_exact(spark):
    pages = [(i, f"http://h{i}.example.org/x", f"<p>line {i}</p><p>nine {int(i < 9)}</p><p>ten {int(i < 10)}</p><p>all</p>") for i in range(40)]
    pages += [(100, None, "<p>all</p>"), (101, "http://h1.example.org", None), (102, "http://h1.example.org", "")]
    df = common.numbered(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kept", F.lit(1)))
    got = {r["page_id"]: r["kept"] for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0] == ["line 0", "nine 1"] and got[20] == ["line 20"] and got[100] == [] and got[101] == [] and got[102] == []


# 9 ------------------------------------------------------------------------------------------------------------------


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    near = np.repeat(base[:60], 4, axis=0) + rng.normal(size=(240, 32)) * 0.25
    x = np.concatenate([base, near, base[:20]]).astype(np.float32)
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(len(x) + i, v) for i, v in enumerate(odd)]
    got = {r["vec_id"]: r for r in pq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T) >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[len(x) + i]["n_links"] == 0 and got[len(x) + i]["kept"] for i in range(len(odd)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())


@pytest.mark.parametrize(("dims", "spectrum"), [(64, "even"), (256, "eight"), (768, "eight"), (256, "falling"), (768, "root")])
def test_lists_asked_meet_the_links_of_uneven_vectors(dims, spectrum):
    rng = np.random.default_rng(8)
    i = np.arange(1, dims + 1)
    deviation = {"even": i**0.0, "eight": np.where(i <= 8, 1.0, 0.02), "falling": 1 / i, "root": i**-0.5}[spectrum]
    base = rng.normal(size=(3000, dims)) * deviation
    near = base[:1500] + rng.normal(size=(1500, dims)) * deviation * 0.4
    x = pq_dedup.unit(np.concatenate([base, near]))
    index = pq_dedup.Index(x, 134)
    own, _, _, asks = index.encode(x)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    met = (own[a] == own[b]) | asks[a, own[b]] | asks[b, own[a]]
    assert len(a) > 500 and met.mean() >= 0.97
    if spectrum == "even":
        assert index.slack < 0.6 * index.far


def test_a_vector_travels_once_however_many_lists_it_asks():
    x = np.random.default_rng(5).normal(size=(2000, 64)).astype(np.float32)
    index = pq_dedup.Index(pq_dedup.unit(x), 40)
    assert index.encode(pq_dedup.unit(x))[3].sum() > 2 * len(x)
    vectors = pa.array(list(x), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), vectors, pa.array(np.ones(len(x), np.int64))], names=["cid", "embedding", "times"])
    sent = [len(v) for part in pq_dedup._index_rows(index, 64, "<f4")[0](iter([batch])) for v in part.column("x").to_pylist()]
    assert sum(sent) == x.nbytes


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_blocks_of_any_size_meet_each_pair_once(spark, block_rows, monkeypatch):
    monkeypatch.setattr(pq_dedup, "PAIRS", 64)
    monkeypatch.setattr(pq_dedup, "QUERIES", 5)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    close = base[0] + rng.normal(size=(50, 8)) * 0.05  # a list of its own, many blocks long
    x = np.concatenate([base, close, base[10:30] + rng.normal(size=(20, 8)) * 0.2, close[:5]]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in pq_dedup.near_vectors(vectors, reach=100.0, block_rows=block_rows).collect()}
    u = pq_dedup.unit(x)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    assert [got[i]["n_links"] for i in range(len(x))] == links.sum(1).tolist()
    root = common.forest(*np.nonzero(links), len(x))
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()


def test_folded_links_of_a_task_equal_a_single_forest(monkeypatch):
    monkeypatch.setattr(pq_dedup, "EDGES", 10)
    rng = np.random.default_rng(3)
    tally, a, b = pq_dedup._Tally(), rng.integers(0, 80, 200), rng.integers(0, 80, 200)
    for i in range(0, 200, 4):
        tally.join(a[i : i + 4], b[i : i + 4])
    nodes, root = tally._folded()
    assert np.array_equal(nodes, np.unique([a, b])) and np.array_equal(root, common.forest(a, b, 80)[nodes])
    ends = np.unique(np.stack([np.sort(rng.integers(0, 30, 90)), rng.integers(0, 40, 90)], axis=1), axis=0)
    assert np.array_equal(pq_dedup.spanning(ends[:, 0], ends[:, 1], 30, 40), common.forest(ends[:, 1], ends[:, 0] + 40, 70))


# 10 -----------------------------------------------------------------------------------------------------------------


def model():
    return pytest.importorskip("public_tokenizers").path(token_counts.MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" a\n\té▁<s>/.x字", max_size=30), max_size=6), st.integers(1, 40))
def test_token_counts_equal_the_library(texts, batch_bytes):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=model())
    assert token_counts.count_batch(texts, model(), batch_bytes) == [len(whole.encode(t)) for t in texts]


# all ----------------------------------------------------------------------------------------------------------------


def test_awkward_rows_everywhere(spark):
    import corpus_pipeline

    docs, n = awkward(spark), 7
    whole = common.numbered(docs)
    items = spark.createDataFrame([(1, "q")], "item_id long, text string")
    machine = toxicity.train([], [])
    assert suffix_dedup.repeated_bytes(whole).count() == n
    assert simhash.near_duplicates(docs.select("doc_id", "text")).count() == n
    assert decontaminate.contamination(whole, items).count() == n
    assert token_counts.token_counts(docs, model()).count() == n
    assert toxicity.scores(docs, machine).count() == n
    kept = {"simhash": simhash.drop_near_duplicates(docs), "items": decontaminate.drop_contaminated(docs, items), "toxic": toxicity.drop_toxic(docs, machine), "mix": mixing.mix_documents(docs)}
    assert all(df.columns == docs.columns for df in kept.values())
    assert (kept["simhash"].count(), kept["items"].count(), kept["toxic"].count()) == (4, n, n)
    placed = sharding.shard_documents(docs).collect()
    assert len(placed) == n and all(r["shard"] in range(16) for r in placed)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    whole = common.numbered(docs)
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train_on(docs, labels)
    frames = [
        suffix_dedup.repeated_bytes(whole), simhash.drop_near_duplicates(docs), mixing.mix_documents(docs), toxicity.drop_toxic(docs, machine),
        decontaminate.contamination(whole, items), sharding.shard_documents(docs), line_dedup.drop_boilerplate(common.numbered(pages)),
        pq_dedup.near_vectors(vectors), token_counts.token_counts(docs, model()), language_id.languages(pages, docs),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_languages_from_other_evidence(spark):
    docs = spark.createDataFrame([("en", "the house and the garden with trees " * 5), ("de", "das haus und der garten mit baum " * 5)], "lang string, text string")
    page = lambda i, lang, text: (i, f"http://a.example.{lang}/", f'<html lang="{lang}"><p>{text}</p></html>')
    rows = [page(i, "de", "das haus und der garten mit baum") for i in range(20)] + [page(50 + i, "en", "the house and the garden with trees") for i in range(20)]
    rows += [page(100, "de", ""), (101, None, None), (101, None, None)]
    got = {r["page_id"]: r for r in language_id.languages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[0]["language"] == got[100]["language"] == "de" and got[50]["language"] == "en" and got[101]["declared"] is None


def test_rare_languages_are_learned(spark):
    rows = [("en", f"the house and garden {i}") for i in range(600)] + [("en", "one hot text")] * 600 + [("de", f"das haus und garten {i}") for i in range(600)] + [("fi", "talo ja puutarha")]
    names, _ = language_id.train_text(spark.createDataFrame(rows, "lang string, text string"), 40)
    assert names == ["de", "en", "fi"]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE[name]) is None


@needs_tables
def test_pipeline_stages_against_their_contracts(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = corpus_pipeline.toxic(spark, before, FOLDER)
    assert clean.columns == before.columns and clean.exceptAll(before).count() == 0
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*before.columns, "shard", "slot"] and out.select(*before.columns).distinct().exceptAll(clean).count() == 0


def test_null_vector_ids_are_kept_only_without_a_named_copy(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (8, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq_dedup.near_vectors(vectors).collect()]
    want = [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (8, 0, 8, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("part", [3, 1000, 1 << 20])
def test_kernel_sums_hold_a_part_at_a_time(monkeypatch, part):
    """The same sums to the last bit as over all entries at once, in memory that doesn't grow with them."""
    import tracemalloc

    import numpy as np

    from tabkit.llm import toxicity

    monkeypatch.setattr(toxicity, "PART", part, raising=False)
    rng, many = np.random.default_rng(1), 3_000_000 if part == 1 << 20 else 2_000
    seen = toxicity.Seen.__new__(toxicity.Seen)
    seen.rows, seen.weights = rng.integers(0, 50, many).astype(np.uint16), rng.random(many, np.float32)
    seen.stop = np.sort(np.append(rng.integers(0, many + 1, 500), [0, 3, 3, many]))  # some words hold nothing
    folded = rng.normal(size=50)
    tracemalloc.start()
    got = seen.times(folded)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = np.concatenate([[0.0], np.cumsum(folded[seen.rows] * seen.weights, dtype=float)])
    assert (got == np.diff(total[np.concatenate([[0], seen.stop])])).all()
    assert peak < 40 << 20
