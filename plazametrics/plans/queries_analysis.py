"""Statistics, clustering and log-ratio analysis of venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, composition, factor_model, factor_selection, simplex, stats, venue
from ..session import iterated
from .bindings import PLACE_SQL, listings, places, table, with_listings
from .queries_venue import vectors
from .registry import query

FEATURES = ["store_count", "mean_rating", "mean_price", "mean_size"]
FEATURE_SQL = """f AS (SELECT l_suppkey AS mall_id, cast(count(*) AS double) AS store_count, avg(l_quantity) AS mean_rating,
  avg(l_extendedprice) AS mean_price, avg(p_size) AS mean_size, avg(l_discount) AS mean_discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)"""


def venue_numbers(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("mall_id")).agg(
        F.count("*").cast("double").alias("store_count"), F.avg("l_quantity").alias("mean_rating"),
        F.avg("l_extendedprice").alias("mean_price"), F.avg("p_size").alias("mean_size"), F.avg("l_discount").alias("mean_discount"),
    )


@query("sta1_zscores", f"WITH {FEATURE_SQL} SELECT mall_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in FEATURES) + " FROM f")
def _(spark, sf):
    z = stats.zscores(venue_numbers(spark, sf), FEATURES)
    return z.select("mall_id", *[F.round(c, 4).alias(c) for c in FEATURES])


@query("sta2_pearson", """SELECT event_type, round(CASE WHEN count(*) >= 3 THEN corr(cast(user_id AS double), value) END, 4) AS r FROM events GROUP BY event_type""")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(stats.pearson(F.col("user_id"), F.col("value")), 4).alias("r")
    )


PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS marginal_corr FROM f"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]
)


@query("sta3_correlation_matrix", f"WITH {FEATURE_SQL} {PAIR_SQL}")
def _(spark, sf):
    found = stats.correlation_pairs(venue_numbers(spark, sf), FEATURES)
    return found.withColumn("marginal_corr", F.round("marginal_corr", 4))


_THREE = ["store_count", "mean_rating", "mean_price"]


def _partial(x: str, y: str, z: str) -> str:
    p = f"(corr({x}, {y}) - corr({x}, {z}) * corr({y}, {z})) / sqrt((1 - power(corr({x}, {z}), 2)) * (1 - power(corr({y}, {z}), 2)))"
    return f"""SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(corr({x}, {y}), 4) AS marginal_corr, round({p}, 4) AS partial_corr,
      CASE WHEN abs({p}) > 0.3 THEN 'direct' WHEN abs(corr({x}, {y})) > 0.4 THEN 'spurious' ELSE 'weak' END AS verdict FROM f"""


@query("sta4_partial_correlations", f"WITH {FEATURE_SQL} " + " UNION ALL ".join(
    [_partial(_THREE[0], _THREE[1], _THREE[2]), _partial(_THREE[0], _THREE[2], _THREE[1]), _partial(_THREE[1], _THREE[2], _THREE[0])]))
def _(spark, sf):
    return stats.partial_correlations(venue_numbers(spark, sf), _THREE)


@query("fil12_usable_features", f"""WITH {FEATURE_SQL}, g AS (SELECT *, CASE WHEN store_count > 600 THEN NULL ELSE mean_size END AS patchy FROM f)
  SELECT 'store_count' AS feature, count(*) FILTER (store_count IS NULL) AS missing, count(*) FILTER (store_count IS NULL) = 0 AS usable FROM g
  UNION ALL SELECT 'patchy', count(*) FILTER (patchy IS NULL), count(*) FILTER (patchy IS NULL) = 0 FROM g""")
def _(spark, sf):
    patchy = F.when(F.col("store_count") <= 600, F.col("mean_size"))
    return stats.missing_counts(venue_numbers(spark, sf).withColumn("patchy", patchy), ["store_count", "patchy"])


@query("sta5_nestedness", """WITH h AS (SELECT c_custkey AS v, p_brand AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  u AS (SELECT k, count(*) AS u FROM h GROUP BY k), t AS (SELECT v, cast(sum(n) AS double) AS s, count(*) AS d, avg(u) AS m FROM h JOIN u USING (k) GROUP BY v)
  SELECT round(corr(d, m), 4) AS corr_diversity_ubiquity, round(corr(s, d), 4) AS corr_size_diversity, min(d) AS diversity_min, max(d) AS diversity_max,
  cast(min(s) AS bigint) AS smallest_store_count FROM t""")
def _(spark, sf):
    return stats.nestedness(customer_purchases(spark, sf), "o_custkey", "p_brand")


def customer_purchases(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "p_brand", "l_returnflag")
    )


def purchase_vectors(spark, sf) -> DataFrame:
    rows = customer_purchases(spark, sf)
    return venue.count_vectors(rows, "o_custkey", "p_brand", venue.vocabulary(rows, "p_brand"))


@query("sta6_rarefaction")
def _(spark, sf):
    return stats.rarefaction(purchase_vectors(spark, sf), "o_custkey")


@query("sta6_rarefaction_summary")
def _(spark, sf):
    return stats.rarefaction_summary(stats.rarefaction(purchase_vectors(spark, sf), "o_custkey"))


@query("sta10_posthoc", f"""WITH {FEATURE_SQL}, {PLACE_SQL}, j AS (SELECT f.*, sqrt(power((longitude - 121.4737) * 111.32 * cos(radians(latitude)), 2)
    + power((latitude - 31.2304) * 110.57, 2)) AS km FROM f JOIN places USING (mall_id)), l AS (
  SELECT 'mean_price' AS variable, mean_price AS value, store_count, mean_rating FROM j UNION ALL SELECT 'distance_from_centre_km', km, store_count, mean_rating FROM j
  UNION ALL SELECT 'mean_size', CASE WHEN mean_size > 25.5 THEN mean_size END, store_count, mean_rating FROM j)
  SELECT variable, count(*) AS n, round(corr(store_count, value), 4) AS corr_store_count, round(corr(mean_rating, value), 4) AS corr_mean_rating
  FROM l WHERE value IS NOT NULL GROUP BY variable""")
def _(spark, sf):
    from ..functions.geo import planar_km

    joined = venue_numbers(spark, sf).join(places(spark, sf), "mall_id")
    variables = {
        "mean_price": F.col("mean_price"), "distance_from_centre_km": planar_km(F.col("longitude"), F.col("latitude")),
        "mean_size": F.when(F.col("mean_size") > 25.5, F.col("mean_size")),
    }
    return stats.posthoc(joined, ["store_count", "mean_rating"], variables)


@query("sta11_spearman", """WITH r AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) AS a, count(*) OVER (PARTITION BY p_size) AS na,
    rank() OVER (ORDER BY p_retailprice) AS b, count(*) OVER (PARTITION BY p_retailprice) AS nb FROM part)
  SELECT count(*) AS n, round(corr(a + (na - 1) / 2.0, b + (nb - 1) / 2.0), 4) AS spearman FROM r""")
def _(spark, sf):
    return stats.spearman(table(spark, sf, "part"), "p_size", "p_retailprice")


@query("sta11_regression")
def _(spark, sf):
    return stats.regression(venue_numbers(spark, sf), "mean_price", ["store_count", "mean_rating", "mean_size"])


@query("sta11_first_order_partial", f"""WITH {FEATURE_SQL}, c AS (SELECT corr(store_count, mean_rating) AS xy, corr(store_count, mean_price) AS xz, corr(mean_rating, mean_price) AS yz FROM f)
  SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 4) AS partial FROM c""")
def _(spark, sf):
    c = venue_numbers(spark, sf).agg(
        F.corr("store_count", "mean_rating").alias("xy"), F.corr("store_count", "mean_price").alias("xz"),
        F.corr("mean_rating", "mean_price").alias("yz"),
    )
    return c.select(F.round(stats.first_order_partial(F.col("xy"), F.col("xz"), F.col("yz")), 4).alias("partial"))


@query("sta12_share_check", """WITH s AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS a,
    avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY l_suppkey)
  SELECT CASE WHEN a >= n AND a >= r THEN 'a' WHEN n >= r THEN 'n' ELSE 'r' END AS largest_share, count(*) AS venues,
  count(*) FILTER (abs(a + n + r - 1) > 1e-5) AS not_summing_to_one FROM s GROUP BY ALL""")
def _(spark, sf):
    flags = {"a": "A", "n": "N", "r": "R"}
    shares = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.avg((F.col("l_returnflag") == v).cast("double")).alias(k) for k, v in flags.items()]
    )
    return stats.share_check(shares, list(flags))


@query("win12_median_split", f"""WITH {FEATURE_SQL}, h AS (SELECT *, CASE WHEN store_count <= (SELECT median(store_count) FROM f) THEN 'smaller' ELSE 'larger' END AS half FROM f)
  SELECT half, count(*) AS venues, round(median(mean_rating), 6) AS median_mean_rating, round(median(mean_price), 4) AS median_mean_price FROM h GROUP BY half""")
def _(spark, sf):
    split = stats.half_summary(venue_numbers(spark, sf), "store_count", ["mean_rating", "mean_price"])
    return split.withColumns({"median_mean_rating": F.round("median_mean_rating", 6), "median_mean_price": F.round("median_mean_price", 4)})


# ---------------------------------------------------------------- clustering

def points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def feature_vectors(spark, sf) -> DataFrame:
    z = stats.zscores(venue_numbers(spark, sf), FEATURES)
    return iterated(z.select("mall_id", F.array(*FEATURES).alias("x")))


@query("clu2_silhouette", """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.x, b.x)) AS m, count(*) AS n FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
  s AS (SELECT vec_id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM d GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette, count(*) AS scored_rows FROM s WHERE a IS NOT NULL""")
def _(spark, sf):
    labelled = points(spark, sf).withColumn("labels", F.array("label"))
    groups = labelled.agg(F.max("label")).first()[0] + 1
    scored = cluster.silhouettes(labelled, "vec_id", "x", "labels", [groups])
    return scored.select(F.round("silhouette", 4).alias("silhouette"), "scored_rows")


@query("clu1_lloyd_step", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  c AS (SELECT label AS g, pos, avg(embedding[pos]::DOUBLE) AS v FROM embeddings, range(1, 65) t(pos) GROUP BY ALL), cc AS (SELECT g, list(v ORDER BY pos) AS x FROM c GROUP BY g),
  n AS (SELECT vec_id, p.x, arg_min(g, (list_distance(p.x, cc.x), g)) AS g FROM p, cc GROUP BY vec_id, p.x)
  SELECT g AS "group", pos AS dimension, round(avg(x[pos]), 5) AS centre FROM n, range(1, 65) t(pos) GROUP BY ALL""")
def _(spark, sf):
    data = points(spark, sf)
    by_label = data.select("label", F.posexplode("x")).groupBy("label", "pos").agg(F.avg("col").alias("v")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("c")
    ).orderBy("label").collect()
    import numpy as np

    start = cluster.Run(len(by_label), 0, np.asarray([r["c"] for r in by_label]))
    moved = cluster.lloyd_step(data, "x", [start])[0]
    rows = [(g, d + 1, float(v)) for g, row in enumerate(moved) for d, v in enumerate(row)]
    out = spark.createDataFrame(rows, "`group` int, dimension int, centre double")
    return out.withColumn("centre", F.round("centre", 5))


@query("clu1_clu7_kmeans_reference")
def _(spark, sf):
    return cluster.kmeans_reference(feature_vectors(spark, sf), "mall_id", "x")


@query("clu3_com5_kmedoids_groups")
def _(spark, sf):
    return composition.discrete_groups(vectors(spark, sf), "mall_id")


@query("clu4_clu6_archetype_mixtures")
def _(spark, sf):
    rows = feature_vectors(spark, sf)
    fit = cluster.archetypes(rows, "mall_id", "x", 3)
    return cluster.mixtures(rows, "mall_id", "x", fit).withColumn("explained", F.lit(round(fit.explained, 4)))


@query("win10_purest_venues")
def _(spark, sf):
    rows = feature_vectors(spark, sf)
    fit = cluster.archetypes(rows, "mall_id", "x", 3)
    return cluster.purest(cluster.mixtures(rows, "mall_id", "x", fit), "mall_id", 3)


_SIMPLEX_IN = "[p_size / 50.0, p_retailprice / 1000.0 - 1, (p_partkey % 7) / 7.0, 0.3]"


@query("clu5_simplex_projection", f"""WITH v AS (SELECT p_partkey, {_SIMPLEX_IN}::DOUBLE[] AS v FROM part), u AS (SELECT p_partkey, v, unnest(v) AS x FROM v),
  o AS (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY x DESC) AS r, sum(x) OVER (PARTITION BY p_partkey ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS s FROM u),
  t AS (SELECT p_partkey, arg_max((s - 1) / r, r) AS theta FROM o WHERE x - (s - 1) / r > 0 GROUP BY p_partkey)
  SELECT p_partkey, round(greatest(v[1] - theta, 0), 6) AS w1, round(greatest(v[2] - theta, 0), 6) AS w2, round(greatest(v[3] - theta, 0), 6) AS w3,
  round(greatest(v[4] - theta, 0), 6) AS w4 FROM v JOIN t USING (p_partkey)""")
def _(spark, sf):
    values = F.array(F.expr("p_size / 50.0D"), F.expr("p_retailprice / 1000.0D - 1"), F.expr("(p_partkey % 7) / 7.0D"), F.lit(0.3))
    rows = table(spark, sf, "part").select("p_partkey", simplex.project_simplex(values).alias("w"))
    return rows.select("p_partkey", *[F.round(F.col("w")[i], 6).alias(f"w{i + 1}") for i in range(4)])


@query("clu6_mixture_table", """WITH w AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS a,
    avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY l_suppkey)
  SELECT l_suppkey, round(a, 4) AS w_A0, round(n, 4) AS w_A1, round(r, 4) AS w_A2, CASE WHEN a >= n AND a >= r THEN 'A0' WHEN n >= r THEN 'A1' ELSE 'A2' END AS dominant,
  round(greatest(a, n, r), 4) AS max_weight, greatest(a, n, r) <= 0.35 AS is_mixed FROM w""")
def _(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.avg((F.col("l_returnflag") == v).cast("double")).alias(f"w_A{i}") for i, v in enumerate("ANR")]
    )
    return cluster.mixture_table(w, "l_suppkey", 3, pure=0.35)


@query("clu7_cluster_sizes", """SELECT string_agg(cast(n AS varchar), ' | ' ORDER BY n DESC) AS cluster_sizes FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def _(spark, sf):
    return cluster.cluster_sizes(table(spark, sf, "embeddings"), "label")


# ---------------------------------------------------------------- composition

CLR_SQL = """c AS (SELECT mall_id, category_l2, count(*) AS n FROM listings GROUP BY ALL), k AS (SELECT DISTINCT category_l2 FROM c), m AS (SELECT DISTINCT mall_id FROM c),
  full_grid AS (SELECT m.mall_id, k.category_l2, ln(coalesce(n, 0) + 0.5) AS l FROM m CROSS JOIN k LEFT JOIN c ON c.mall_id = m.mall_id AND c.category_l2 = k.category_l2),
  clr AS (SELECT mall_id, category_l2, l - avg(l) OVER (PARTITION BY mall_id) AS v FROM full_grid)"""


@query("com1_clr", with_listings(f", {CLR_SQL} SELECT mall_id, category_l2, round(v, 6) AS clr FROM clr"))
def _(spark, sf):
    rows = listings(spark, sf).select("mall_id", "category_l2")
    labels = venue.vocabulary(rows, "category_l2")
    found = venue.count_vectors(rows, "mall_id", "category_l2", labels)
    long = found.select("mall_id", F.posexplode(composition.clr(F.col("counts"))).alias("pos", "clr"))
    return long.select("mall_id", F.element_at(F.lit(labels), F.col("pos") + 1).alias("category_l2"), F.round("clr", 6).alias("clr"))


@query("com2_pca_sensitivity")
def _(spark, sf):
    rows = listings(spark, sf).select("mall_id", "category_l2")
    labels = venue.vocabulary(rows, "category_l2")
    return composition.pca_sensitivity(venue.count_vectors(rows, "mall_id", "category_l2", labels), "mall_id", labels)


@query("com3_aitchison_pairs", with_listings(f""", {CLR_SQL} SELECT x.mall_id AS a, y.mall_id AS b, round(sqrt(sum(power(x.v - y.v, 2))), 6) AS distance
  FROM clr x JOIN clr y ON x.category_l2 = y.category_l2 AND x.mall_id < y.mall_id GROUP BY ALL"""))
def _(spark, sf):
    rows = vectors(spark, sf).select("mall_id", composition.clr(F.col("counts")).alias("clr"))
    return composition.aitchison_pairs(rows, "mall_id", "clr").withColumn("distance", F.round("distance", 6))


@query("com3_distance_statistics", with_listings(f""", {CLR_SQL}, d AS (SELECT sqrt(sum(power(x.v - y.v, 2))) AS d
  FROM clr x JOIN clr y ON x.category_l2 = y.category_l2 AND x.mall_id < y.mall_id GROUP BY x.mall_id, y.mall_id)
  SELECT count(*) AS pair_count, round(avg(d), 6) AS distance_mean, round(stddev_pop(d), 6) AS distance_sd, round(stddev_pop(d) / avg(d), 6) AS distance_cv FROM d"""))
def _(spark, sf):
    rows = vectors(spark, sf).select("mall_id", composition.clr(F.col("counts")).alias("clr"))
    found = composition.distance_statistics(rows, "mall_id", "clr")
    return found.select("pair_count", *[F.round(c, 6).alias(c) for c in ("distance_mean", "distance_sd", "distance_cv")])


@query("com4_multinomial_null")
def _(spark, sf):
    return composition.aitchison_grouping(vectors(spark, sf), "mall_id")


@query("com6_parallel_analysis")
def _(spark, sf):
    return composition.parallel_analysis(iterated(vectors(spark, sf)), "mall_id")


@query("com7_holdout_reconstruction")
def _(spark, sf):
    return composition.holdout_reconstruction(iterated(vectors(spark, sf)), "mall_id")


@query("com8_count_split", with_listings("""SELECT mall_id, category_l2, count(*) FILTER (u >= 0.1) AS train, count(*) FILTER (u < 0.1) AS test FROM
  (SELECT *, cast(concat('0x', substr(md5(concat('5|', record_id)), 1, 6)) AS bigint) / 16777216.0 AS u FROM listings) GROUP BY ALL"""))
def _(spark, sf):
    return composition.split_counts(listings(spark, sf), "mall_id", "category_l2", F.col("record_id"))


@query("com9_loading_stability")
def _(spark, sf):
    return composition.loading_stability(iterated(vectors(spark, sf)), "mall_id")


@query("com10_factor_model")
def _(spark, sf):
    data = iterated(vectors(spark, sf))
    fits = factor_model.fit(data, "counts", (1, 2, 3, 4))
    rows = [(f.k, f.passes, round(f.bound, 2)) for f in fits]
    return spark.createDataFrame(rows, "k int, passes int, bound double")


CHECK_SQL = """s AS (SELECT mall_id, category_l1, count(*) FILTER (u >= 0.1) AS train, count(*) FILTER (u < 0.1) AS test FROM
    (SELECT *, cast(concat('0x', substr(md5(concat('5|', record_id)), 1, 6)) AS bigint) / 16777216.0 AS u FROM listings) GROUP BY ALL),
  p AS (SELECT category_l1, sum(train) / cast(sum(sum(train)) OVER () AS double) AS p FROM s GROUP BY category_l1),
  t AS (SELECT mall_id, sum(train) AS n, sum(test) AS m FROM s GROUP BY mall_id),
  x AS (SELECT train, test, p, n, m FROM s JOIN p USING (category_l1) JOIN t USING (mall_id))"""


@query("com11_predictive_checks", with_listings(f""", {CHECK_SQL} SELECT round(sum(power(train - p * n, 2) / (p * n)), 1) AS chi_square_discrepancy,
  round(avg(CASE WHEN m > 0 THEN abs(test - p * m) END), 4) AS holdout_mae, round(sum(test * ln(p)) / sum(test), 6) AS holdout_mean_log_score,
  cast(sum(test) AS bigint) AS holdout_store_count FROM x"""))
def _(spark, sf):
    rows = listings(spark, sf)
    labels = venue.vocabulary(rows, "category_l1")
    split = composition.split_counts(rows, "mall_id", "category_l1", F.col("record_id"))
    totals = {r["category_l1"]: r["n"] for r in split.groupBy("category_l1").agg(F.sum("train").alias("n")).collect()}
    share = [totals[c] / sum(totals.values()) for c in labels]
    held = split.groupBy("mall_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category_l1", F.struct("train", "test")))).alias("m")
    )

    def dense(field: str):
        return F.array(*[F.coalesce(F.try_element_at("m", F.lit(c))[field], F.lit(0)).cast("double") for c in labels])

    table_ = held.select(dense("train").alias("y"), dense("test").alias("h"), F.array(*[F.lit(v) for v in share]).alias("p"))
    return factor_model.predictive_checks(table_, "y", "h", "p")


@query("com10_com11_fitted_models")
def _(spark, sf):
    rows = listings(spark, sf)
    labels = venue.vocabulary(rows, "category_l1")
    split = iterated(factor_selection.split_vectors(rows, "mall_id", "category_l1", labels, F.col("record_id")))
    return factor_model.comparison(split, factor_model.fit(split, "train", (1, 2, 3, 4)))


def selection(spark, sf, count_model: bool):
    rows = listings(spark, sf)
    return factor_selection.select_factors(
        rows, "mall_id", "category_l1", venue.vocabulary(rows, "category_l1"), F.col("record_id"), count_model=count_model
    )


@query("com12_com14_factor_selection")
def _(spark, sf):
    found = selection(spark, sf, count_model=True)
    votes = {f"vote_{name}": F.lit(k) for name, k in found.votes.items()}
    return found.table.withColumns({**votes, "selected_k": F.lit(found.selected), "source": F.lit(found.source), "scope": F.lit(found.scope)})


@query("com13_com15_clr_factors")
def _(spark, sf):
    return selection(spark, sf, count_model=False).scores


@query("com13_loading_poles")
def _(spark, sf):
    rows = listings(spark, sf).select("mall_id", "category_l2")
    labels = venue.vocabulary(rows, "category_l2")
    data = iterated(venue.count_vectors(rows, "mall_id", "category_l2", labels))
    loadings, _ = composition.clr_factors(data, "mall_id", 2)
    return composition.loading_poles(spark, loadings, labels)
