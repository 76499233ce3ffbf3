from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from plazametrics.functions.similarity import indel_ratio_text, indel_ratios
from plazametrics.operators import entities
from plazametrics.operators.components import components
from plazametrics.operators.ranks import numbered

LETTERS = list("abcdefghij") + ["é", "山", "海", "😀"]


def edited(rng, name):
    """One random edit: a character more, less or another."""
    at, kind = int(rng.integers(0, len(name) + 1)), rng.integers(0, 3)
    return name[:at] + ("" if kind == 0 else str(rng.choice(LETTERS))) + name[at + (kind != 1):]


def names(rng, n):
    base = ["".join(rng.choice(LETTERS, int(rng.integers(1, 14)))) for _ in range(n)]
    return base + [edited(rng, b) for b in base] + [edited(rng, edited(rng, b)) for b in base] + [b + "xyz" for b in base[: n // 3]] + [""]


def rows(rng, n, count=25, videos=2):
    pool = names(rng, count)
    pick = lambda *x: str(rng.choice(x))
    out = []
    for i in range(n):
        name = pool[int(rng.integers(0, len(pool)))] if rng.random() > 0.3 else pool[0]
        out.append((f"v{int(rng.integers(0, videos))}", i, float(i // 3), name.upper(), pick("rated", "unrated", "new_store"), float(rng.integers(0, 60)) / 60,
                    name, pick("", "books", "book", "noodles"), pick("", "4.5", "4.6"), pick("", "L1", "L2"), pick("", "30")))
    return out


SCHEMA = ("video string, ord bigint, timestamp_sec double, merchant_name_raw string, card_type string, quality double, "
          "name_key string, category_key string, rating string, floor_location string, avg_price_yuan string")


def folded(table):
    """One pass over all observations of each video in time order."""
    fields = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    out = []
    for video in sorted({r[0] for r in table}):
        tracker = entities.Tracker()
        for r in sorted((dict(zip(fields, r)) for r in table if r[0] == video), key=lambda r: (r["timestamp_sec"], r["ord"])):
            tracker.add(r)
        out += [(video, k, best, first, last, n, variants, types) for k, (_, _, best, first, last, n, variants, types) in enumerate(tracker.rows(video))]
    return out


def test_components_of_names_fold_like_whole_videos(spark):
    rng = np.random.default_rng(7)
    table = rows(rng, 1500)
    seen = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in entities.merge_observations(seen).collect())
    want = sorted(folded(table))
    assert [g[:7] for g in got] == [w[:7] for w in want] and [g[7] for g in got] == [w[7] for w in want]
    found = entities.name_components(seen)
    sizes = found.groupBy("video", "component").count()
    assert sizes.count() > 20


def test_null_fields_and_no_rows(spark):
    assert entities.merge_observations(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = [("v", 1, 0.0, "A", "rated", 0.5, "abcd", None, None, None, None), ("v", 2, 1.0, "B", "rated", 0.6, "abcd", "x", None, "L1", ""),
           ("v", 3, 1.0, "C", "rated", 0.6, None, "x", None, "L1", ""), (None, 4, 1.0, "C", "rated", 0.6, "abcd", "x", None, "L1", "")]
    got = {(r["video"], r["entity"]): (r["observations"], r["best_ord"]) for r in entities.merge_observations(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert got == {("v", 0): (2, 2), ("v", 1): (1, 3), (None, 0): (1, 4)}


def test_likely_and_prefix_names_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    pool = sorted(set(names(rng, 60)) - {""})
    df = spark.createDataFrame([("v", i, n) for i, n in enumerate(pool)], "video string, v bigint, name_key string")
    close = lambda a, b: indel_ratio_text(a, b) >= 91 or (indel_ratio_text(a, b) >= 75 and abs(len(a) - len(b)) <= 2)
    want = {(i, j) for i, j in itertools.combinations(range(len(pool)), 2) if close(pool[i], pool[j])}
    assert {tuple(r) for r in entities.likely_names(df).collect()} == want and len(want) > 60
    hashed = df.withColumn("v", F.xxhash64("video", "name_key"))
    number = {r["v"]: r["name_key"] for r in hashed.collect()}
    got = {(number[r["u"]], number[r["v"]]) for r in entities.prefix_names(hashed).collect()}
    assert got == {(b, a) for a in pool for b in pool if a != b and len(a) >= 4 and b.startswith(a)} and got


def test_pair_column_equals_rule(spark):
    rng = np.random.default_rng(5)
    table = [dict(zip([c.strip().split(" ")[0] for c in SCHEMA.split(",")], r)) for r in rows(rng, 120, 8, 1)]
    pairs = [(a, b) for a, b in itertools.combinations(table, 2)]
    pick = lambda r: tuple(r[c] for c in entities.MATCH_FIELDS)
    struct = "struct<" + ",".join(f"{c}:string" for c in entities.MATCH_FIELDS) + ">"
    df = spark.createDataFrame([(i, pick(a), pick(b)) for i, (a, b) in enumerate(pairs)], f"i int, l {struct}, r {struct}")
    got = [r["s"] for r in df.select("i", entities.same_merchant_pair(F.col("l"), F.col("r")).alias("s")).orderBy("i").collect()]
    want = [entities.same_merchant(a, b) for a, b in pairs]
    assert got == want and 20 < sum(want) < len(want)


def test_ratios_of_many_pairs():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 7, 8, 9, 16, 17, 33, 63, 64, 65, 200]
    left = ["".join(rng.choice(LETTERS, int(rng.choice(sizes)))) for _ in range(700)]
    right = ["".join(rng.choice(LETTERS, int(rng.choice(sizes)))) for _ in range(700)]
    assert np.allclose(indel_ratios(left, right), [indel_ratio_text(a, b) for a, b in zip(left, right)])
    assert indel_ratios([], []).tolist() == []


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(a, b) for a in range(200, 206) for b in range(200, 206)] + [(7, 7)]
    rng = np.random.default_rng(0)
    edges = [edges[i] if i % 2 else edges[i][::-1] for i in rng.permutation(len(edges))]
    got = {r["u"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, **{i: 200 for i in range(200, 206)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_numbers_within_groups_of_any_size(spark):
    rng = np.random.default_rng(2)
    table = [("hot" if rng.random() < 0.8 else str(rng.choice(["a", "b"])) if i % 9 else None, int(x)) for i, x in enumerate(rng.permutation(900))]
    got = {(r["g"], r["x"]): r["n"] for r in numbered(spark.createDataFrame(table, "g string, x int").repartition(7), "g", ["x"], "n").collect()}
    assert len(got) == len(table)
    for g in {g for g, _ in table}:
        assert [got[g, x] for x in sorted(x for h, x in table if h == g)] == list(range(1, sum(h == g for h, _ in table) + 1))


def test_segments_of_frames_fold_like_one_pass(spark):
    rng = np.random.default_rng(6)
    frames, want = [], set()
    for video, n in (("walk", 120), ("still", 60), ("jumps", 90), ("one", 1)):
        step = {"walk": 0.3, "still": 0.0, "jumps": 3.0, "one": 0.0}[video]
        pictures = np.cumsum(rng.normal(0, step, (n, 3)), axis=0)
        last = None
        for k, p in enumerate(pictures):
            frames.append((video, 2 * k, 100 + k, [float(x) for x in p]))
            if last is None or np.abs(p - last).mean() >= 1.0:
                last = p
                want.add((video, 2 * k))
            if k == n - 1:
                want.add((video, 2 * k))
    df = spark.createDataFrame(frames, "video string, bucket bigint, frame_index bigint, image array<double>").repartition(3)
    for segment in (7, 1000):
        assert {(r["video"], r["bucket"]) for r in entities.changed_frames(df, "image", 1.0, segment).collect()} == want
    assert entities.changed_frames(df.limit(0), "image", 1.0).collect() == []
