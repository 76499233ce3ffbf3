from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plazametrics.operators import rules
from plazametrics.plans import build
from plazametrics.sources import rest, sinks, tables

HEADER = ",".join(tables.CARD_COLUMNS)


def card_line(**values):
    return ",".join('"' + values.get(c, "").replace('"', '""') + '"' for c in tables.CARD_COLUMNS)


@pytest.fixture(scope="module")
def card_root(tmp_path_factory):
    """Nine venues of noisy cards, one file each, one of them empty."""
    root, rng = tmp_path_factory.mktemp("cards"), random.Random(5)
    brands = [(f"品牌名字一二三四五六{chr(0x4E00 + i)}", ["火锅", "咖啡", "服饰", "电影院", "其它"][i % 5]) for i in range(40)]
    for v in range(9):
        folder = root / f"上海__商场{v}__20260826"
        folder.mkdir()
        lines = [HEADER]
        picked = rng.sample(brands, 25) + [brands[0], brands[1]]
        if v == 4:
            picked.append(("品牌名字一二三四五大" + brands[0][0][-1], brands[0][1]))
        for i, (name, kind) in enumerate(picked):
            lines.append(card_line(
                card_id=f"CARD-{i:04d}", mall_name=f"商场{v}", merchant_name_raw=name, merchant_name_normalized=name,
                category_raw="谜" if i == 3 else kind, rating=str(3 + i % 3) if i % 4 else "", avg_price_yuan=str(30 + 7 * i),
                floor_location=f"L{i % 3 + 1}" if i % 5 else "", card_type="rated" if i % 4 else "unrated",
                rating_status="rated" if i % 4 else "unrated", metadata_text="新店 | x" if i == 7 else "x",
                ocr_confidence="0.9", title_score="0.8", observations=str(1 + i % 3)))
        (folder / "merchant_cards.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    empty = root / "上海__空__20260826"
    empty.mkdir()
    (empty / "merchant_cards.csv").write_text(HEADER + "\n", encoding="utf-8")
    return str(root)


MAPPING = rules.rules_from_rows([
    {"priority": "10", "match_type": "regex", "pattern": "火锅|咖啡", "category_l1": "美食", "category_l2": "火锅"},
    {"priority": "20", "match_type": "exact", "pattern": "服饰", "category_l1": "购物", "category_l2": "服饰"},
    {"priority": "30", "match_type": "contains", "pattern": "电影", "category_l1": "休闲", "category_l2": "电影院"},
    {"priority": "40", "match_type": "exact", "pattern": "其它", "category_l1": "购物", "category_l2": "其它"},
])


@pytest.fixture(scope="module")
def built(spark, card_root):
    cards = tables.read_cards(spark, card_root)
    none = spark.createDataFrame([], "alias string, canonical_brand_name string")
    manual = spark.createDataFrame([("商场1", "不存在")], "mall_name string, merchant_name string")
    chains = spark.createDataFrame([("品牌名字一二三四五六一",)], "chain_key string")
    return cards.cache(), build.master_tables(build.MasterInputs(cards, MAPPING, [], none, manual, chains))


def test_cards_carry_lineage(built):
    cards, _ = built
    row = cards.where("card_id = 'CARD-0001' and mall_name = '商场3'").first()
    assert row["capture_date"] == "2026-08-26" and row["source_record_id"] == "上海__商场3__20260826/CARD-0001"
    assert cards.select("mall_name").distinct().count() == 9 and row["mall_id"].startswith("MALL-")


def test_every_card_is_kept_or_excluded_once(built):
    cards, out = built
    lineage = out["store_lineage"]
    assert lineage.count() + out["excluded_records"].count() == cards.count()
    assert lineage.select("source_record_id").distinct().count() == lineage.count()
    assert lineage.select("store_instance_id").distinct().count() == out["master_stores"].select("store_instance_id").distinct().count()
    reasons = {r["reason"]: r["row_count"] for r in out["exclusion_reasons"].collect()}
    assert reasons == {"unmapped_category": 9}


def test_metrics_add_up(built):
    _, out = built
    rows = out["mall_metrics"].collect()
    assert len(rows) == 9
    for r in rows:
        assert r["source_record_count"] == r["excluded_record_count"] + r["duplicates_removed"] + r["final_store_instance_count"]
        assert 0 <= r["normalized_category_entropy"] <= 1 and 0 < r["category_hhi"] <= 1
    removed = out["duplicate_audit"].agg(F.sum("duplicates_removed")).first()[0] or 0
    assert removed == sum(r["duplicates_removed"] for r in rows)
    assert sum(r["store_instance_count"] for r in out["category_summary"].collect()) == out["master_stores"].count()


def test_typo_is_corrected(built):
    _, out = built
    found = out["name_correction_candidates"].where("auto_eligible").collect()
    assert any(r["variant_name"].startswith("品牌名字一二三四五大") for r in found)
    assert out["name_corrections_applied"].count() == len({r["variant_name"] for r in found})


def test_features_and_profiles(spark, built):
    _, out = built
    features = build.feature_table(out["master_stores"]).cache()
    assert features.count() == 9
    scores = features.select("mall_name", F.lit(0.0).alias("factor1"))
    mixtures = features.select("mall_name", F.lit(1.0).alias("w_A0"))
    assert build.profiles(features, scores, mixtures).count() == 9
    with pytest.raises(ValueError):
        build.profiles(features, scores.limit(3), mixtures)


def test_analysis_tables(built):
    _, out = built
    master = out["master_stores"]
    features = build.feature_table(master).cache()
    tables_ = build.analyse(master, features)
    rows = {name: df.collect() for name, df in tables_.items()}
    assert len(rows["archetype_mixtures"]) == len(rows["compositional_factor_scores"]) == len(rows["mall_category_counts"]) == 9
    assert len(rows["brand_sensitivity"]) == 6 and len(rows["compositional_pca_sensitivity"]) == 5
    assert all(r["cooccurrence"] >= 5 for r in rows["brand_colocation"])
    constant = [r for r in rows["partial_correlations"] if "subculture_index" in (r["feature_a"], r["feature_b"])]
    assert constant and all(r["marginal_corr"] is None for r in constant)
    joined = build.profiles(features, tables_["compositional_factor_scores"], tables_["archetype_mixtures"])
    assert joined.count() == 9


def test_stages_publish_or_leave_results_alone(spark, tmp_path):
    staging, current = str(tmp_path / "staging"), str(tmp_path / "current")
    table = spark.range(3).toDF("x")
    build.run_stages(spark, [("one", lambda: {"mall_profiles": table})], staging, current)
    assert spark.read.parquet(f"{current}/core/mall_profiles").count() == 3

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        build.run_stages(spark, [("one", lambda: {"mall_profiles": table.limit(1)}), ("two", broken)], staging, current)
    assert spark.read.parquet(f"{current}/core/mall_profiles").count() == 3
    build.run_stages(spark, [("one", lambda: {"mall_profiles": table.limit(1)})], staging, current)
    assert spark.read.parquet(f"{current}/core/mall_profiles").count() == 1
    assert not os.path.exists(current + ".backup")
    with pytest.raises(ValueError):
        build.preflight({"x": table.where("x > 9")})


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿mall_name,n\n甲,\n\"乙,\"\"丙\",2\n", encoding="utf-8")
    rows = tables.read_text_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("甲", ""), ('乙,"丙', "2")]
    out = spark.createDataFrame([(["a", "b"], None, "=1")], "l array<string>, x string, t string")
    sinks.write_csv(out, str(tmp_path / "out"), ["l", "x", "t", "absent"], guard=True)
    back = tables.read_text_csv(spark, str(tmp_path / "out")).first()
    assert tuple(back) == ("a | b", "", "'=1", "")
    assert "| l | x | t |" in sinks.markdown_table(sinks.flat(out), 50)


def test_rule_files_are_read_in_file_order(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("﻿priority,active,match_type,pattern,category_l1,category_l2\n48,TRUE,regex,b,x,y\n48,TRUE,regex,a,x,z\n", encoding="utf-8")
    assert [r.pattern for r in tables.read_rules(spark, str(path))] == ["b", "a"]


def test_token_replay(spark, tmp_path):
    folder = tmp_path / "video1"
    folder.mkdir()
    tokens = [{"text": "b", "score": .5, "box": [5, 20, 9, 30]}, {"text": "a", "score": .9, "box": [1, 2, 3, 4]}]
    (folder / "frame_000007.json").write_text(json.dumps(tokens), encoding="utf-8")
    rows = tables.read_tokens(spark, str(tmp_path / "*" / "*.json")).orderBy("ord").collect()
    assert [(r["video"], r["frame_index"], r["ord"], r["token"]["text"]) for r in rows] == [("video1", 7, 1, "a"), ("video1", 7, 2, "b")]


def test_place_search_turns_errors_into_status(spark):
    def fetch(word):
        if word == "boom":
            raise TimeoutError
        return {"status": "1", "pois": [{"name": word}]} if word == "ok" else {"status": "0", "info": "LIMIT"}

    wanted = spark.createDataFrame([("a", "ok"), ("b", "no"), ("c", "boom")], "mall_name string, search_keyword string")
    got = {r["mall_name"]: r["fetch_status"] for r in rest.search_places(wanted, fetch, interval=0.0).collect()}
    assert got == {"a": "ok", "b": "api_error:LIMIT", "c": "request_error:TimeoutError"} and rest.MAX_PARALLEL <= 3


def test_search_records_from_request_to_venue(spark):
    asked = []

    def fetch(word):
        if word == "down":
            raise ConnectionError
        place = {"id": "9", "name": "Far Plaza", "adname": "East", "address": [], "location": "1.5,2.5", "typecode": "060101", "business_area": [], "biz_ext": {"rating": []}}
        return {"status": 1, "pois": [] if word == "none" else [place]}

    wanted = spark.createDataFrame([("Far Plaza",), ("other",), ("none",), ("down",), ("far plaza",)], "mall_name string")
    aliases = spark.createDataFrame([("other", "Far Plaza", "West"), ("far plaza", "  ", None)], "mall_name string, search_keyword string, expected_district string")
    out = {r["mall_name"]: r for r in rest.search_records(wanted, fetch, aliases, interval=0.0).collect()}
    assert {k: r["search_status"] for k, r in out.items()} == {
        "Far Plaza": "ok", "far plaza": "ok", "other": "district_mismatch:East", "none": "no_match", "down": "request_error:ConnectionError"}
    best = out["Far Plaza"]
    assert (best["poi_id"], best["district"], best["longitude"], best["latitude"], best["business_area"], best["poi_rating"]) == ("9", "East", "1.5", "2.5", "", "")
    assert out["none"]["poi_name"] == "" and best["fetched_at"][4] == "-" and not asked


def test_manifest_counts_and_digests_in_the_pass_that_writes(spark, tmp_path):
    rows = [(1, "a", ["x"]), (2, None, []), (2, None, [])]
    df = spark.createDataFrame(rows, "k int, t string, l array<string>")
    one = sinks.written(df.repartition(3), str(tmp_path / "one"))
    two = sinks.written(df.orderBy(F.desc("k")), str(tmp_path / "two"))
    assert one.rows == two.rows == 3 and one.digest == two.digest
    assert sinks.written(df.distinct(), str(tmp_path / "three")).digest != one.digest
    assert sinks.written(df.limit(0), str(tmp_path / "four")).rows == 0


def test_ordered_files(spark, tmp_path):
    df = spark.range(500).select(((F.col("id") * 37) % 101).alias("a"), "id")
    sinks.write_ordered(df, str(tmp_path / "o"), F.desc("a"), F.asc("id"))
    got = [(r["a"], r["id"]) for r in sinks.read_ordered(spark, str(tmp_path / "o")).orderBy("place").collect()]
    assert got == sorted(((i * 37 % 101, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    # Reading the files by name gives the same order.
    assert [tuple(r) for r in spark.read.parquet(*sorted(str(p) for p in (tmp_path / "o").glob("part-*"))).select("a", "id").collect()][0] == got[0]


def test_token_payload_forms(spark):
    texts = ['{"res": {"rec_texts": [" a ", "", "b", "c"], "rec_scores": [0.5, 1, 0.25], "rec_boxes": [[1, 9, 3, 4], [0, 0, 1, 1], [5.7, 2, 7, 8]]}}',
             '[{"text": " kept ", "score": 1, "box": [1, 2, 3, 4]}]', '{"rec_texts": []}', "not json", '{"other": 1}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    got = [(r["k"], r["token"]["text"], r["token"]["score"], r["token"]["box"]) for r in tables.frame_tokens(df).collect()]
    assert sorted(got) == [(0, "a", 0.5, [1, 9, 3, 4]), (0, "b", 0.25, [5, 2, 7, 8]), (1, " kept ", 1.0, [1, 2, 3, 4])]


def test_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    row = sinks.file_digests(spark, str(tmp_path)).first()
    assert row["sha256"].startswith("ba7816bf") and row["bytes"] == 3
