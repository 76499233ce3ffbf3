from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plazametrics.functions import cards as cd
from plazametrics.functions import identity, numeric
from plazametrics.functions import text as tx
from plazametrics.functions.similarity import indel_ratio_text
from plazametrics.operators import rules

from .conftest import apply


def pairs_of(spark, fn, table):
    got = apply(spark, fn, [(k,) for k, _ in table])
    assert dict(zip([k for k, _ in table], got)) == dict(table)


def test_clean_compact_and_key(spark):
    assert apply(spark, tx.clean, [("　Ａｂ c ",), (None,)]) == ["Ab c", ""]
    assert apply(spark, tx.compact, [(" 新　店 ",)]) == ["新店"]
    assert apply(spark, lambda c: tx.brand_key(tx.clean(c)), [("H&M·Ｘ（上海）",)]) == ["hmx上海"]


def test_ids_dates_floors(spark):
    assert apply(spark, lambda c: tx.stable_id("MALL", c, 10), [("abc",)]) == ["MALL-A9993E3647"]
    pairs_of(spark, tx.capture_date, [("sh__x__20260826", "2026-08-26"), ("x", ""), ("x__2026082", "")])
    pairs_of(spark, tx.normalize_floor, [(" b 1", "B1"), ("Lg2", "LG2"), ("4f", "4F"), ("L", ""), ("商场内", "")])


def test_new_store_token_is_exact(spark):
    got = apply(spark, lambda c: tx.has_exact_token(c, ["新店"]), [("4.5 | 新 店",), ("New",), ("新店开业",), (None,)])
    assert got == [True, False, False, False]


def test_category_noise(spark):
    pairs_of(spark, tx.is_category_noise, [("", True), ("b1", True), ("3/L2", True), ("月", True), ("...", True), ("咖啡", False)])


def test_first_useful_guard_and_path(spark):
    assert apply(spark, tx.first_useful, [("[]", "x"), ("null", ""), ("a", "b")]) == ["x", "", "a"]
    pairs_of(spark, tx.csv_guard, [("=1+1", "'=1+1"), ("-a", "'-a"), ("@a", "'@a"), ("a=1", "a=1")])
    roots = {"/old/": "new/", "/older/": "newer/"}
    assert apply(spark, lambda c: tx.portable_path(c, roots), [("c:\\x\\old\\a.csv",), ("y/older/b",), ("z",)]) == ["new/a.csv", "newer/b", "z"]


def test_lenient_numbers(spark):
    assert apply(spark, numeric.number, [("",), ("1.5",), ("x",)]) == [0.0, 1.5, 0.0]
    assert apply(spark, numeric.whole_number, [("3",), ("3.5",), ("",)])[::2] == [3, 0]
    assert apply(spark, numeric.as_bool, [(" Yes",), ("TRUE",), ("0",), (None,)]) == [True, True, False, False]


def test_rule_types(spark):
    assert apply(spark, lambda c: rules.matches(c, "exact", "Abc"), [("aBC",), ("abcd",)]) == [True, False]
    assert apply(spark, lambda c: rules.matches(c, "contains", "BC"), [("xbcx",)]) == [True]
    assert apply(spark, lambda c: rules.matches(c, "regex", "^A+$"), [("aaa",), ("ab",)]) == [True, False]
    with pytest.raises(ValueError):
        rules.matches(F.lit("a"), "glob", "a")


def test_rule_order_keeps_file_order_and_defaults():
    rows = [{"pattern": "b", "priority": "48"}, {"pattern": "a", "priority": "48"}, {"pattern": "c", "priority": ""},
            {"pattern": "d", "priority": "1", "active": "FALSE"}, {"pattern": "e", "priority": "0"}]
    assert [r.pattern for r in rules.in_order(rules.rules_from_rows(rows))] == ["b", "a", "c", "e"]


def test_keep_rule_clears_reasons(spark):
    table = rules.rules_from_rows([
        {"action": "exclude", "field": "n", "match_type": "contains", "pattern": "x", "reason": "r2"},
        {"action": "exclude", "field": "n", "match_type": "contains", "pattern": "y", "reason": "r1"},
        {"action": "exclude", "field": "absent", "match_type": "contains", "pattern": "", "reason": "r0"},
        {"action": "keep", "field": "n", "match_type": "exact", "pattern": "xy!"},
    ])
    df = spark.createDataFrame([("xy",), ("xy!",), ("z",)], "n string")
    got = [r[0] for r in df.select(rules.exclusion_reasons(df, table)).collect()]
    assert got == [["r1", "r2"], [], []]


MARKS = [f"{letter}{n}" for letter in ("L", "B", "F", "LG") for n in range(1, 10)] + [f"{n}F" for n in (1, 2, 9, 10, 35, 99)]
FREE = ["{}", "{}层", "甲乙{}", "丙: {}层", "{} 丁", "戊/{}/己"]
TOUCHED = ["A{}", "{}Z", "7{}", "{}.5", "3.{}", "{}K庚"]


def plain_floor(text):
    """A run of letters, digits and dots that is a mark; else the whole text without blanks; else the phrase for inside."""
    for run in re.findall("[A-Z0-9.]+", text.upper()):
        if run in MARKS or re.fullmatch("[1-9][0-9]?F", run):
            return run
    return "LG" if text.replace(" ", "") in ("LG", "LG层") else "商场内" if "商场内" in text else ""


def test_floors_of_every_mark_in_every_context(spark):
    texts = [c.format(m) for m in MARKS for c in FREE + TOUCHED] + [m.lower() for m in MARKS] + ["LG", "LG层", "在商场内", "L0", "0F", "100F", "无"]
    pairs_of(spark, cd.floor, [(t, plain_floor(t)) for t in dict.fromkeys(texts)])
    assert sum(plain_floor(c.format(m)) == m for m in MARKS for c in FREE) == len(MARKS) * len(FREE)
    assert apply(spark, cd.floor, [(c.format("L4"),) for c in TOUCHED]) == [""] * len(TOUCHED)


def test_categories_between_what_stands_around_them(spark):
    before = ["", "4.3", "★★ 0.9 ", "·3·8", "暂无评分 ", "B2层 ", "12F、", "：L6 2.7"]
    after = ["", "￥64/人", "58/人", " ¥ 9.5/人 三折", "：3F"]
    kinds = ["丑寅菜", "Vegan", "卯辰午用品"]
    pairs_of(spark, cd.category, [(x + k + y, k) for x in before for k in kinds for y in after])
    pairs_of(spark, cd.category, [(x + y, "") for x in before for y in after if y != "：3F"] + [("店内", ""), ("附近", ""), ("申" * 25, "")])


def test_ratings_and_prices_of_all_forms(spark):
    ratings = {f"{a}{n}.{d}{b}": f"{n}.{d}" for n in range(6) for d in (0, 4, 9) for a, b in (("", ""), ("★ ", " 酉"), ("戌", "亥￥7/人"))}
    ratings |= {"6.1": "", "13.1": "", "￥3.4": "", "3.44": "", "已售2.2": "", "2.2折": "", "1·5": "1.5"}
    pairs_of(spark, cd.rating, list(ratings.items()))
    prices = {f"{a}{mark}{n}/人{b}": n for mark in "￥¥" for n in ("5", "120", "8.25") for a, b in (("", ""), ("4.1子", " L2"))}
    pairs_of(spark, cd.price, list(prices.items()) + [("33/人", ""), ("￥33", "")])


def test_floor_tokens_never_become_categories(spark):
    assert all(apply(spark, cd.is_floor_token, [(m,) for m in MARKS + [m + "层" for m in MARKS]]))
    edges = ["", "、", ",", " ", "-", "：", "。"]
    assert not any(apply(spark, lambda c: cd.is_plausible_category(cd.category(c)), [(e + m,) for m in MARKS for e in edges]))
    # A name goes on behind the mark.
    assert not any(apply(spark, cd.is_floor_token, [(m + rest,) for m in MARKS for rest in ("x", "9z", "未申", "'酉")]))


def test_name_normalisation(spark):
    assert apply(spark, cd.normalize_name, [(" 小楼 · 老北方菜 ",), ("C,D（商场内）",)]) == ["小楼·老北方菜", "C·D"]


def test_brand_identities(spark):
    both = [("1", "NIKE耐克旗舰店"), ("2", "海底捞（二楼）店"), ("3", "！")]
    assert apply(spark, identity.latin_core, both) == ["LAT:nike", "2", "3"]
    assert apply(spark, identity.strip_suffix, both) == ["LAT:nike", "K:海底捞", "3"]


def place_names(rng, n, size):
    """Names of ``size`` characters, none of which two names share."""
    every = rng.permutation(np.arange(0x5000, 0x7000))
    return ["".join(map(chr, every[i * size : (i + 1) * size])) for i in range(n)]


def plain_quality(a, b):
    short, long = sorted((a, b), key=len)
    if not short or a == b:
        return 3 if a == b and a else 0
    if short in long:
        return 2 if len(short) >= 3 else 0
    hits = at = 0
    for c in short:
        found = long.find(c, at)
        at, hits = (found + 1, hits + 1) if found >= 0 else (at, hits)
    return int(len(short) >= 4 and hits >= 0.9 * len(short))


def test_venue_names_keep_their_key_under_every_decoration(spark):
    rng = np.random.default_rng(21)
    names, branches, areas = place_names(rng, 6, 4), place_names(rng, 6, 2), place_names(rng, 6, 3)
    forms = ["{n}", "上海{n}", "上海市{n}", "{d}区{n}", "上海市{d}区{n}", "{n}(改造中)", "{n}购物中心", "{n}广场", "{n}停车场", "{n}出入口", "{n}12门", "{n}东门", "{n}B区", "上海{n}（三楼）广场"]
    rows = [(f.format(n=n, d=d), n) for n, d in zip(names, areas) for f in forms]
    # A branch in brackets moves to the front.
    rows += [(f"{n}{left}上海{b}{kind}{right}", b + n) for n, b in zip(names, branches) for left, right in ("()", "（）") for kind in "店馆"]
    rows += [("Mixed Case 9", "mixedcase9"), ("mIXED-case·9", "mixedcase9")]
    pairs_of(spark, identity.venue_match_key, rows)


def test_match_quality_of_edited_names(spark):
    rng = np.random.default_rng(22)
    pairs = []
    for size in (2, 3, 4, 6, 11, 24):
        for name, other in zip(place_names(rng, 4, size), place_names(rng, 8, size)[4:]):
            at = int(rng.integers(0, size))
            pairs += [(name, name), (name, other), (name, name + other), (other + name, name), (name, name[:at] + "一" + name[at:]),
                      (name, name[:at] + "一" + name[at + 1:]), (name, name[::-1]), (name, name[:at]), (name, "")]
    quality = apply(spark, identity.match_quality, pairs)
    assert quality == [plain_quality(a, b) for a, b in pairs] and set(quality) == {0, 1, 2, 3}


def test_indel_ratio_against_table():
    def slow(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return 200.0 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0

    rng = np.random.default_rng(23)
    words = ["", *("".join(rng.choice(list("abcé山"), n)) for n in (1, 2, 3, 5, 8, 13, 21))]
    for a in words:
        for b in words:
            assert indel_ratio_text(a, b) == pytest.approx(slow(a, b))


def test_percent_rounds_as_c_does(spark):
    import duckdb

    values = [(i / n,) for n in (16, 32, 80, 400, 1000, 2000) for i in range(n + 1)]
    df = spark.createDataFrame(values, "v double")
    got = {r[0]: r[1] for r in df.select("v", numeric.percent(F.col("v"))).collect()}
    assert got == {v: f"{v * 100:.1f}%" for (v,) in values}
    assert duckdb.connect().execute("SELECT printf('%.1f', 31.25::DOUBLE)").fetchone()[0] + "%" == got[0.3125] == "31.2%"
