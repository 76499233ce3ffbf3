"""Candidate names: one computation a row, and the same keys by the short way as by all steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazametrics.functions import identity
from plazametrics.functions.text import brand_key
from plazametrics.operators import metadata

from .conftest import apply

NAMES = [
    "百联12购物中心", "百联12广场", "百联12(上海虹桥店)", "上海市百联12", "百联长宁区12商场", "（旧）百联12", "百联12北1门", "百联12A区", "广场\n",
    "", None, "区", "Plaza 7广场", "(上海", "百联停车场出入口",
]


def test_short_way_to_the_match_key(spark):
    def all_steps(name):
        text = F.regexp_replace(name, rf"^(.*?)[（(]{identity.CITY}({identity.HAN}{{2,3}})[店馆][）)]", "$2$1")
        text = F.regexp_replace(F.regexp_replace(text, r"[（(].*?[）)]", ""), f"^{identity.CITY}市?", "")
        return brand_key(F.regexp_replace(F.regexp_replace(text, rf"({identity.CITY}市)?{identity.HAN}{{2,3}}区", ""), identity.PLACE_TAIL, ""))

    cases = [(n,) for n in NAMES]
    assert apply(spark, identity.venue_match_key, cases) == apply(spark, all_steps, cases)


def test_quality_is_computed_once_a_candidate(spark, capsys):
    rows = [("a", "百联12购物中心", "百联12广场", "P", "", "060101", 2), ("a", "百联12购物中心", "百联13广场", "P", "", "060101", 1), ("b", None, "x", "", "", "", 3)]
    df = spark.createDataFrame(rows, "k string, wanted string, poi_name string, adname string, expected_district string, typecode string, o int")
    best = metadata.best_candidate(df, "k", "wanted", "o")
    best.explain()
    plan = capsys.readouterr().out
    assert plan.count("match_quality(") == 1 and "ordered" not in plan and "aggregate(" not in plan
    assert {r["k"]: (r["status"], r["poi_name"], r["quality"]) for r in best.collect()} == {"a": ("ok", "百联12广场", 3), "b": ("no_match", None, None)}
