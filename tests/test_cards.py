from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plazametrics.operators import entities, frames

GEOMETRY = frames.Geometry(width=864, height=1556, scale=2.0, crop_y=172, frame_height=960)


def line(*parts, y=110):
    """Tokens of one text line: (text, x) pairs on a common height, each as wide as its text."""
    return [(text, .97, (x, y, x + 22 * len(text), y + 30)) for text, x in parts]


TITLE, BELOW = 110, 160
KIND, FLOOR = "卯辰用品", "L3"


def screen(name, head, price, floor, badge=None, split=False):
    """One card: its name, then what stands before the category, the category with its price, the floor."""
    middle = f"{KIND}￥{price}/人" if price else KIND
    parts = [(head, 260), (middle, 480)] if split else [(f"{head}{' ' if head[-1:] > '9' else ''}{middle}", 260)]
    tokens = line((name, 260), y=TITLE) + line(*parts, *([(floor, 770)] if floor else []), y=BELOW)
    return tokens + (line((badge[0], 260), y=badge[1]) if badge else [])


# Every head of the line below the title, with and without price and floor, in one token or two.
HEADS = {"4.6": ("4.6", "rated"), "0.0": ("0.0", "rated"), "暂无评分": ("", "unrated"), "暂无星级": ("", "unrated")}
SCREENS, EXPECTED = {}, {}
for _head, (_rating, _type) in HEADS.items():
    for _price in ("", "88"):
        for _floor in ("", FLOOR):
            for _split in (False, True):
                _name = f"shop {len(SCREENS)}x"
                SCREENS[_name] = screen(_name, _head, _price, _floor, split=_split)
                EXPECTED[_name] = (_name, KIND, _rating, _price, _floor, _type)
for _badge, _y, _type in (("新店", BELOW + 20, "new_store"), ("8.15新店开业", BELOW + 20, "new_store"), ("新店特惠", BELOW + 20, "rated"), ("新店", 330, "rated")):
    _name = f"badge {len(SCREENS)}x"
    SCREENS[_name] = screen(_name, "3.2", "41", "B2", badge=(_badge, _y))
    EXPECTED[_name] = (_name, KIND, "3.2", "41", "B2", _type)
SCREENS["backwards"] = list(reversed(screen("turned", "2.9", "", "5F", split=True)))
EXPECTED["backwards"] = ("turned", KIND, "2.9", "", "5F", "rated")


def token_rows():
    return [(name, 1, 1.0, i, (text, score, list(box))) for name, tokens in SCREENS.items() for i, (text, score, box) in enumerate(tokens)]


def test_parse_known_screens(spark):
    df = spark.createDataFrame(
        token_rows(), "video string, frame_index bigint, timestamp_sec double, ord int, token struct<text:string,score:double,box:array<int>>")
    cards, audit = frames.parse_cards(df, GEOMETRY)
    got = {r["video"]: tuple(r[c] for c in ("merchant_name_raw", "category_raw", "rating", "avg_price_yuan", "floor_location", "card_type"))
           for r in cards.collect()}
    assert got == EXPECTED
    total = frames.recall_audit(audit).first()
    unrated = sum(e[2] == "" for e in EXPECTED.values())
    assert (total["accepted_cards"], total["unrated_cards"], total["frames_without_cards"]) == (len(EXPECTED), unrated, 0)


def observation(name, category="粤菜", floor="L2", rating="4.5", at=0.0, order=0, **more):
    row = dict(video="v", ord=order, timestamp_sec=at, merchant_name_raw=name, category_raw=category, rating=rating, avg_price_yuan="",
               floor_location=floor, ocr_confidence=.9, detection_method="rating_anchor", card_type="rated", rating_status="rated", title_score=.9)
    return {**row, **more}


SCHEMA = ("video string, ord bigint, timestamp_sec double, merchant_name_raw string, category_raw string, rating string, avg_price_yuan string, "
          "floor_location string, ocr_confidence double, detection_method string, card_type string, rating_status string, title_score double")


def frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return entities.with_match_keys(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA), SIMPLER)


def likeness(a, b):
    """200 times the longest common subsequence over both lengths, by the plain table."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 200 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0


SIMPLER = {"點": "点"}


def plain_same(a, b):
    """The rule on raw fields whose categories are plain words."""
    x, y = (r["merchant_name_raw"].lower().translate(str.maketrans(SIMPLER)) for r in (a, b))
    agree = lambda c: not a[c] or not b[c] or a[c] == b[c]
    if not x or not y or not agree("floor_location"):
        return False
    if x == y or (min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x))):
        return True
    k, m = a["category_raw"].lower(), b["category_raw"].lower()
    kinds = not k or not m or k in m or m in k or likeness(k, m) >= 60
    near = likeness(x, y)
    return kinds and (near >= 91 or (near >= 75 and abs(len(x) - len(y)) <= 2 and agree("rating") and agree("avg_price_yuan")))


def edited_pairs(rng):
    """A name against each edit of itself, in all agreeing and disagreeing surroundings."""
    letters = list("abcdefgh点")
    for n in (1, 2, 3, 4, 5, 9, 14, 24):
        name = "".join(rng.choice(letters, n))
        at = int(rng.integers(0, n))
        edits = [name, name.upper(), name.replace("点", "點"), name[:at] + name[at + 1:], name[:at] + "z" + name[at:], name[:at] + "z" + name[at + 1:],
                 name + "zz", name[::-1], name[: n // 2], name[:at] + "zy" + name[at + 1:]]
        for other in dict.fromkeys(edits):
            for more in ({}, {"floor": "L9"}, {"floor": ""}, {"category": "noodles"}, {"category": "food hall"}, {"category": ""}, {"rating": "1.1"}, {"rating": ""}, {"avg_price_yuan": "70"}):
                yield observation(name, "food", "L2", avg_price_yuan="60"), observation(other, **{"category": "food", "avg_price_yuan": "60", **more})


def test_same_merchant_rule_and_column_agree(spark):
    pairs = list(edited_pairs(np.random.default_rng(12)))
    flat = [dict(r, ord=2 * i + j) for i, pair in enumerate(pairs) for j, r in enumerate(pair)]
    df, fields = frame(spark, flat).cache(), F.struct(*entities.MATCH_FIELDS)
    rows = {r["ord"]: r.asDict() for r in df.collect()}
    want = [plain_same(a, b) for a, b in pairs]
    assert [entities.same_merchant(rows[2 * i], rows[2 * i + 1]) for i in range(len(pairs))] == want and 50 < sum(want) < len(want) - 50
    left = df.where("ord % 2 = 0").select((F.col("ord") / 2).cast("int").alias("i"), fields.alias("l"))
    right = df.where("ord % 2 = 1").select(((F.col("ord") - 1) / 2).cast("int").alias("i"), fields.alias("r"))
    got = left.join(right, "i").select("i", entities.same_merchant_pair(F.col("l"), F.col("r")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want


def test_merge_is_ordered_and_follows_the_best(spark):
    rows = [observation("abcdefgh", "湘菜馆", "L5", at=0.0, order=1), observation("abcdefgx", "湘菜馆", "L5", at=1.0, order=2, ocr_confidence=.95),
            observation("大铜锅", "火锅", "L1", at=2.0, order=3), observation("大铜锅", "火锅", "L2", at=3.0, order=4),
            observation("abcdefgh", "湘菜馆", "L5", at=4.0, order=5, card_type="new_store")]
    seen = frame(spark, rows)
    out = {r["entity"]: r for r in entities.merge_observations(seen.repartition(3)).collect()}
    assert [(out[i]["observations"], out[i]["best_ord"]) for i in range(3)] == [(3, 2), (1, 3), (1, 4)]
    assert out[0]["card_type_counts"] == {"rated": 2, "new_store": 1} and out[0]["variants"] == ["abcdefgh", "abcdefgx"]
    cards = {r["entity"]: r for r in entities.entity_cards(entities.merge_observations(seen), seen).collect()}
    assert cards[0]["card_type"] == "new_store" and not cards[0]["research_eligible"] and cards[0]["review_reasons"] == []
    assert cards[1]["review_reasons"] == ["single_observation"] and cards[1]["review_status"] == "建议复核"


def test_frames_compare_with_the_last_kept(spark):
    values = [0.0, 0.6, 1.2, 1.3, 1.4]
    df = spark.createDataFrame([("v", i, i, [x]) for i, x in enumerate(values)], "video string, bucket bigint, frame_index bigint, image array<double>")
    kept = sorted(r["bucket"] for r in entities.changed_frames(df, "image", 1.0).collect())
    assert kept == [0, 2, 4]


def test_bucket_boundary_frame_stays_early(spark):
    df = spark.createDataFrame([("v", i, float(i == 10)) for i in range(21)], "video string, frame_index bigint, sharpness double")
    got = {r["bucket"]: r["frame_index"] for r in frames.sharpest_per_bucket(df, 10).collect()}
    assert got == {0: 10, 1: 11}


def test_equal_scores_are_compared_as_the_sql_adds_them(spark, tmp_path):
    """An unrated anchor and a seven-letter title below whose sums are equal on paper, not in doubles."""
    import duckdb

    import __spark_entry__ as entry

    from .compare import differences

    con = duckdb.connect()
    rows = ", ".join(
        f"({200 * i + e}, 0, '{kind}', '{{\"k\": {k}}}')"
        for i, low in enumerate((9, 10, 21, 22)) for e, kind, k in ((0, "view", 1), (1, "view", low + 73), (39, "error", low))
    )
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, event_type, props"
                f" FROM (VALUES {rows}) AS t(event_id, user_id, event_type, props)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "win5_category_contest"
    assert differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == ""
