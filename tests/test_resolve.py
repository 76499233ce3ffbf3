from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plazametrics.functions.text import UNMAPPED
from plazametrics.operators import metadata, quantiles, resolve, sensitivity, venue

PLAIN = dict(venue="v", brand="b", floor="f", ordinal="o")


def cost():
    return resolve.quality_cost(F.col("r") != "", F.lit(True), F.lit(True), F.lit(0), F.lit(0), F.lit(0))


def test_dedup_by_floor(spark):
    schema = "v string, b string, f string, r string, o int"
    two = spark.createDataFrame([("m", "x", "F1", "", 1), ("m", "x", "F2", "4", 2), ("m", "x", "", "", 3)], schema)
    found = {r["floor_location"]: r for r in resolve.deduplicate(two, cost=cost(), **PLAIN).collect()}
    assert {k: v["source_record_count"] for k, v in found.items()} == {"F1": 1, "F2": 2}
    audit = resolve.duplicate_audit(two, cost=cost(), **PLAIN).collect()
    assert [(r["rows_before"], r["instances_after"], r["duplicates_removed"]) for r in audit] == [(3, 2, 1)]
    lineage = resolve.lineage(two, cost=cost(), **PLAIN).collect()
    assert sorted(r["source_record_id"] for r in lineage) == [1, 2, 3]
    blank = spark.createDataFrame([("m", "x", "", "", 1), ("m", "x", "", "", 2)], schema)
    merged = resolve.deduplicate(blank, cost=cost(), **PLAIN).collect()
    assert [(r["source_record_count"], r["representative"], r["floor_location"]) for r in merged] == [(2, 1, "")]


def test_floor_tie_takes_first_floor_and_known_row(spark):
    rows = [("m", "x", "F2", "4", 5), ("m", "x", "F1", "4", 6), ("m", "x", "", "4", 1)]
    df = spark.createDataFrame(rows, "v string, b string, f string, r string, o int")
    found = {r["floor_location"]: r["representative"] for r in resolve.deduplicate(df, cost=cost(), **PLAIN).collect()}
    assert found == {"F1": 6, "F2": 5}


def test_hot_brand_is_counted_whole(spark):
    hot = spark.range(9000).select(
        F.lit("m").alias("v"), F.lit("x").alias("b"), F.concat(F.lit("F"), (F.col("id") % 3).cast("string")).alias("f"),
        F.lit("").alias("r"), F.col("id").alias("o"),
    )
    counts = sorted(r["source_record_count"] for r in resolve.deduplicate(hot, cost=cost(), **PLAIN).collect())
    assert counts == [3000, 3000, 3000]


def test_first_mode_prefers_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4)], "k string, x string, o int")
    assert resolve.first_mode(df, ["k"], "x", "o", "m").first()["m"] == "b"


def stats_frame(spark, rows):
    return spark.createDataFrame(
        rows, "brand_key string, display string, venues int, rows int, l1 array<string>, l2 array<string>"
    )


def test_name_candidates_equal_brute_force(spark):
    words = ["breadtalkshop", "breadtolkshop", "breadtalkshops", "breadtalkshoqs", "zzzzzzzzzz", "zzzzzzzzz", "short", "shirt"]
    rows = [(w, w, 1 + 2 * (i % 2 == 0), 5 - i % 2, ["a"], ["c"]) for i, w in enumerate(words)]
    got = {(r["variant_name"], r["reference_name"]) for r in resolve.name_candidates(stats_frame(spark, rows)).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for a, _, va, *_ in rows:
        best = max(
            ((1 - edits(a, b) / max(len(a), len(b)), vb, b) for b, _, vb, *_ in rows
             if a != b and vb >= 2 and edits(a, b) <= 1 and 1 - edits(a, b) / max(len(a), len(b)) >= 0.88), default=None)
        if va <= 1 and best:
            want.add((a, best[2]))
    assert got == want and want


def test_protected_terms_and_categories_block(spark):
    rows = [("某某品牌一二三四五童装", "某某品牌一二三四五儿童", 1, 1, ["a"], ["c"]),
            ("某某品牌一二三四五童", "某某品牌一二三四五童", 4, 9, ["a"], ["c"]),
            ("abcdefghijkl", "abcdefghijkl", 1, 1, ["a"], ["x"]), ("abcdefghijkm", "abcdefghijkm", 5, 9, ["a"], ["y"])]
    assert resolve.name_candidates(stats_frame(spark, rows)).count() == 0


def test_correction_settles_one_display(spark):
    df = spark.createDataFrame(
        [(1, "Ab C", "none"), (2, "ABC", "none"), (3, "ABC", "none"), (4, "Ab-c", "manual_alias")], "o int, n string, m string")
    none = spark.createDataFrame([], "variant_key string, reference_name string, auto_eligible boolean")
    out = resolve.apply_corrections(df, none, "n", "m", "o").collect()
    assert {r["n"] for r in out} == {"Ab-c"} and len({r["brand_id"] for r in out}) == 1


def test_diversity_over_mapped_only(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", UNMAPPED)], "v string, c string")
    row = venue.diversity(df, "v", "c", 8).first()
    assert row["category_entropy"] == round(math.log(2), 6) and row["category_hhi"] == 0.5
    assert row["normalized_category_entropy"] == round(math.log(2) / math.log(8), 6)


def test_leave_one_out_rates(spark):
    # Each store counts with the share of the two other venues that have its brand; P's own brand is nowhere else.
    held = {"P": ["k", "k", "m", "own", "own"], "Q": ["k", "n"], "R": ["m", "m", "n"]}
    df = spark.createDataFrame([(v, b) for v, bs in held.items() for b in bs], "v string, b string")
    rates = {r["v"]: r for r in venue.loo_rates(df, "v", "b").collect()}
    assert rates["P"]["standardization_loo"] == pytest.approx(3 * 0.5 / 5) and rates["P"]["local_only_rate"] == pytest.approx(2 / 5)
    assert rates["Q"]["standardization_loo"] == 0.5 and rates["R"]["local_only_rate"] == 0.0


def test_price_needs_samples_and_hides_zero(spark):
    df = spark.createDataFrame([("m", float(p)) for p in (30, 40, 50, 60)] + [("n", 50.0)] * 5, "v string, p double")
    out = {r["v"]: r for r in venue.price_profile(df, "v", "p", F.lit(True)).collect()}
    assert out["m"]["sitdown_price_median"] is None and out["m"]["sitdown_price_sample"] == 4
    assert out["n"]["sitdown_price_median"] == 50.0 and out["n"]["price_dispersion"] is None


def test_weak_singletons_follow_the_identity(spark):
    rows = [("A", "1", "NIKE", 1), ("B", "2", "NIKE旗舰店", 1), ("A", "3", "ADIDAS", 5), ("B", "3", "ADIDAS", 5)]
    df = spark.createDataFrame(rows, "v string, b string, n string, o int")
    cells = sensitivity.identity_cells(df, "v", "b", "n", F.col("o"))
    weak = {(r["brand_identity"], r["key"]) for r in sensitivity.weak_singletons(cells, "v").collect()}
    assert weak == {("strict_current", "1"), ("strict_current", "2")}


def test_seed_years(spark):
    # Every way out of the form: another length, another century, another sign at each place, something around it.
    year = "1998"
    odd = [year[:n] for n in range(4)] + [year + c for c in "0年 x"] + [c + year[1:] for c in "0389"] + [f"{c}8{year[2:]}" for c in "12"]
    odd += [year[:i] + "x" + year[i + 1:] for i in range(4)] + ["x" + year]
    odd = sorted(set(odd) - {"", year + " "})
    seeds = spark.createDataFrame(
        [("TRUE", "good", year, "52000"), ("FALSE", "off", "2001", "")] + [("TRUE", y, y, "") for y in odd],
        "active string, mall_name string, opening_year string, commercial_area_sqm string")
    records = spark.createDataFrame([(n, "", "") for n in ("good", "off", *odd)], "mall_name string, opening_year string, commercial_area_sqm string")
    out = {r["mall_name"]: r for r in metadata.merge_seed_years(records, seeds, "mall_name").collect()}
    assert [n for n, r in out.items() if r["year_merged"]] == ["good"]
    assert (out["good"]["opening_year"], out["good"]["commercial_area_sqm"], out["off"]["opening_year"]) == ("1998", "52000", "")


def test_aliases_in_wide_letters_and_switched_off(spark):
    book = spark.createDataFrame(
        [("ｆｏｏ", "First", "TRUE", 1), ("FOO", "Second", "TRUE", 2), ("bar", "Never", "FALSE", 3)],
        "alias string, canonical_brand_name string, active string, place int")
    names = spark.createDataFrame([("Ｆoo",), ("bar",)], "name string")
    got = {r["name"]: r["canonical_brand_name"] for r in resolve.apply_aliases(names, book, "name", "place").collect()}
    assert got == {"Ｆoo": "Second", "bar": "bar"}


def test_alias_holds_within_its_category(spark):
    book = spark.createDataFrame([("BOLT 1", "bolt 1 promo", "p")], "alias string, canonical_brand_name string, kind string")
    names = spark.createDataFrame([("bolt 1", "p"), ("bolt 1", "q"), ("bolt 2", "p")], "name string, kind string")
    found = resolve.apply_aliases(names, book, "name", within=["kind"])
    assert sorted(tuple(r) for r in found.collect()) == [
        ("bolt 1", "p", "bolt 1 promo", "manual_alias"), ("bolt 1", "q", "bolt 1", "none"), ("bolt 2", "p", "bolt 2", "none"),
    ]


@pytest.mark.parametrize("name", ["joi1_alias_lookup", "fil5_fil6_preprocess"])
def test_parts_of_one_name_keep_their_category(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    from .compare import differences

    con = duckdb.connect()
    parts = ("SELECT * FROM (VALUES (100000, 'red bolt', 'Brand#1', 'PROMO', 9, 1.0), (1000001, 'red bolt', 'Brand#2', 'LARGE', 9, 1.0))"
             " AS t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)")
    con.execute(f"COPY (SELECT * REPLACE (p_partkey::BIGINT AS p_partkey) FROM ({parts})) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_linenumber % 2 = 0 THEN 100000 ELSE 1000001 END::BIGINT AS l_partkey)"
                f" FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 200) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == ""


def test_long_lists_stay_whole(spark):
    rows = spark.range(12_000).selectExpr("'b' as brand", "cast(id as string) as venue")
    assert len(resolve.merged_text(rows, ["brand"], "venue", "venues").first()["venues"].split(" | ")) == 12_000


def test_order_statistics_with_one_far_value(spark):
    values = [i / 5000 for i in range(5000)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = quantiles._binned(df, [], "v", None, quantiles.BINS).groupBy("_bin").count().collect()
    assert max(r["count"] for r in bins) <= 3 * len(values) / quantiles.BINS
    assert quantiles.grouped_median(df, [], "v", "m").first()["m"] == sorted(values)[2500]


def test_strict_join_refuses_differences(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("x", 1), ("y", 3)], "k string, b int")
    assert metadata.strict_join([a, b], "k").count() == 2
    with pytest.raises(ValueError):
        metadata.strict_join([a, b.where("k = 'x'")], "k")


def test_poi_choice(spark):
    """Each venue's candidates differ in one thing from those of the others; the names are letters without a meaning."""
    plain = dict(wanted="wxyz", poi_name="wxyz", adname="P", expected_district="", typecode="060101")
    cases = {
        "first of equals": [plain, plain],
        "better name": [{**plain, "poi_name": "wxyzq"}, plain],
        "mall code": [{**plain, "typecode": "050000"}, plain],
        "known district": [{**plain, "adname": "[]"}, plain],
        "expected district": [{**plain, "expected_district": "Q"}, {**plain, "adname": "Q", "expected_district": "Q"}],
        "nothing near": [{**plain, "poi_name": "abcd"}],
        "elsewhere": [{**plain, "expected_district": "Q"}],
        "null fields": [{**plain, "adname": None, "expected_district": None, "typecode": None}],
    }
    columns = list(plain)
    rows = [(name, *[c[x] for x in columns], place) for name, given in cases.items() for place, c in enumerate(given)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} string" for c in columns) + ", o int")
    searched = spark.createDataFrame([(k,) for k in [*cases, "not answered"]], "k string")
    out = {r["k"]: r for r in metadata.best_candidate(df, "k", "wanted", "o", searched).collect()}
    assert {k: r["status"] for k, r in out.items() if r["status"] != "ok"} == {
        "nothing near": "no_match", "not answered": "no_match", "elsewhere": "district_mismatch:P"}
    assert out["better name"]["poi_name"] == "wxyz" and out["mall code"]["typecode"] == "060101"
    assert out["known district"]["adname"] == "P" and out["null fields"]["adname"] == ""
