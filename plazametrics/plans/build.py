"""End-to-end builds: cards to master tables, features, analysis tables, published results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import number, whole_number
from ..operators import cluster, composition, factor_selection, metadata, pairs, resolve, rules, sensitivity, stats, venue
from ..session import checkpointed, iterated
from ..sources import sinks

# Category sets behind the venue features.
SUBCULTURE = ("潮玩礼品", "桌游棋牌", "VR体验", "游戏电竞", "密室逃脱", "DIY手工", "演出活动")
LIGHT = ("茶饮果汁", "美甲美睫", "撸宠购宠")
SITDOWN = (
    "日料", "西餐", "火锅", "江浙菜", "粤菜", "烧烤烤肉", "川菜", "湘菜", "东南亚料理", "韩料", "北京菜", "其它地方菜", "自助餐",
    "东北菜", "云南菜", "西北菜", "鲁菜", "其它",
)
EXPERIENTIAL = (
    "密室逃脱", "游戏电竞", "VR体验", "桌游棋牌", "DIY手工", "演出活动", "电影院", "儿童乐园", "亲子活动", "健身中心", "球馆",
    "瑜伽普拉提", "舞蹈",
)
DINING, RETAIL = "美食", "购物"
FEATURE_COLUMNS = (
    "standardization_loo", "local_only_rate", "function_rarity_loo", "sitdown_price_log", "subculture_index", "experiential_share",
)


@dataclass
class MasterInputs:
    """Card rows with lineage and the rule tables they are judged by."""

    cards: DataFrame
    mapping: list[rules.Rule]
    exclusions: list[rules.Rule]
    aliases: DataFrame
    manual: DataFrame
    chains: DataFrame
    switches: resolve.CleaningSwitches = field(default_factory=resolve.CleaningSwitches)
    names: resolve.NameSettings = field(default_factory=resolve.NameSettings)
    dedup: resolve.DedupPolicy = field(default_factory=resolve.DedupPolicy)


def preflight(tables: dict[str, DataFrame]) -> None:
    """Refuse to start on an empty input."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"empty inputs: {', '.join(sorted(empty))}")


def master_tables(given: MasterInputs) -> dict[str, DataFrame]:
    """Classify, correct, deduplicate and measure the cards.

    Two tables feed several consumers and are written out once: the judged cards and the
    store instances. Everything else is one lazy plan per result.
    """
    judged = checkpointed(
        resolve.preprocess(
            given.cards, given.mapping, given.exclusions, given.aliases, given.manual, given.switches, factored=True
        ).withColumn("canonical_brand_name", tx.clean(F.col("canonical_brand_name")))
        .withColumn("source_name", F.col("canonical_brand_name"))
    )
    eligible, excluded = judged.where("analysis_eligible"), judged.where("not analysis_eligible")
    brand_stats = resolve.brand_statistics(
        eligible, "mall_id", "canonical_brand_name", "category_l1", "category_l2", "source_record_id"
    )
    candidates = resolve.name_candidates(brand_stats, given.names)
    if not given.names.enabled:
        candidates = candidates.where(F.lit(False))
    candidates = checkpointed(candidates)
    corrected = checkpointed(
        resolve.apply_corrections(eligible, candidates, "canonical_brand_name", "correction_method", "source_record_id")
    )
    cost = resolve.quality_cost(
        F.col("rating") != "", F.col("mapping_status") == "mapped", F.col("category_raw") != "",
        number(F.col("title_score")), number(F.col("ocr_confidence")), number(F.col("observations")),
    )
    keys = dict(venue="mall_id", brand="brand_id", floor="normalized_floor", ordinal="source_record_id")
    carried = corrected.withColumn("_floor", F.col("floor_location"))
    kept = [c for c in carried.columns if c not in ("mall_id", "brand_id", "floor_location", "dedup_policy")]
    found = resolve.deduplicate(carried, cost=cost, policy=given.dedup, carry=kept, **keys)
    known = F.col("floor_location") != ""
    master = found.withColumn("floor_location", F.when(known, F.col("floor_location")).otherwise(F.col("_floor")))
    master = checkpointed(venue.with_brand_metrics(
        master.drop("_floor"), "mall_id", "brand_id", given.chains, tx.brand_key(F.col("canonical_brand_name"))
    ))
    level1 = len({r.category_l1 for r in given.mapping if r.active and r.category_l1})
    unmapped = F.col("mapping_status") == "unmapped"
    return {
        "master_stores": master,
        "store_lineage": resolve.lineage(corrected, cost=cost, policy=given.dedup, **keys),
        "excluded_records": excluded,
        "category_unmapped": venue.unmapped_summary(
            judged.where(unmapped), "category_raw", "mall_id", "canonical_brand_name", tx.is_category_noise(F.col("category_raw"))
        ),
        "exclusion_reasons": resolve.reason_counts(excluded),
        "name_correction_candidates": candidates,
        "name_corrections_applied": resolve.applied_corrections(
            corrected, "source_name", "canonical_brand_name", "correction_method"
        ),
        "duplicate_audit": resolve.duplicate_audit(corrected, cost=cost, policy=given.dedup, **keys),
        "mall_metrics": venue.venue_metrics(
            judged, ~F.col("analysis_eligible"), unmapped, master.drop("shared_across_malls"), "mall_id", "brand_id",
            "category_l1", "floor_location", "rating", F.col("known_chain"), level1,
        ),
        "category_summary": venue.category_summary(master, "mall_name", "category_l1"),
        "mall_similarity": pairs.jaccard_pairs(master, "mall_name", "brand_id"),
        "brand_summary": venue.brand_summary(
            master, "mall_name", "brand_id", "canonical_brand_name", "category_l1", "category_l2", "source_record_id",
            F.col("known_chain"),
        ),
    }


def feature_table(master: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """The venue feature table, with location and opening year where metadata has them."""
    level1, level2 = F.col("category_l1"), F.col("category_l2")
    shares = {
        "subculture_index": level2.isin(*SUBCULTURE), "light_consumption_index": level2.isin(*LIGHT),
        "experiential_share": level2.isin(*EXPERIENTIAL), "dining_share": level1 == DINING, "retail_share": level1 == RETAIL,
    }
    priced = master.withColumn("_price", number(F.col("avg_price_yuan"), None)).withColumn("_rating", number(F.col("rating"), None))
    features = venue.venue_features(
        priced, "mall_name", "brand_id", "category_l1", "category_l2", "_price", "_rating", shares, level2.isin(*SITDOWN)
    )
    if details is None:
        return features
    return metadata.with_defaults(
        features, details, "mall_name", ["district", "business_area", "longitude", "latitude", "opening_year"]
    )


def analyse(master: DataFrame, features: DataFrame, archetype_count: int = 3, count_model: bool = True) -> dict[str, DataFrame]:
    """Statistics, archetypes, overlap sensitivity and factors of the venues; the table of models only with the count model."""
    spark = master.sparkSession
    master = checkpointed(master)
    usable = stats.usable_features(features, FEATURE_COLUMNS)
    z = iterated(stats.zscores(features, usable).select("mall_name", F.array(*[F.col(c) for c in usable]).alias("x")))
    fit = cluster.archetypes(z, "mall_name", "x", archetype_count)
    labels = venue.vocabulary(master, "category_l2")
    vectors = iterated(venue.count_vectors(master, "mall_name", "category_l2", labels))
    factors = factor_selection.select_factors(
        master, "mall_name", "category_l2", labels, F.col("source_record_id"), count_model=count_model
    )
    compared = {} if factors.comparison is None else {"compositional_lnm_comparison": factors.comparison}
    cells = sensitivity.identity_cells(
        master, "mall_name", "brand_id", "canonical_brand_name", whole_number(F.col("observations"))
    )
    return {
        "category_ubiquity": venue.ubiquity(master, "mall_name", "category_l2"),
        "nestedness": stats.nestedness(master, "mall_name", "category_l2"),
        "rarefaction": stats.rarefaction_summary(stats.rarefaction(vectors, "mall_name")),
        "partial_correlations": stats.partial_correlations(features, usable),
        "archetype_mixtures": cluster.mixtures(z, "mall_name", "x", fit),
        "kmeans_reference": cluster.kmeans_reference(z, "mall_name", "x"),
        "brand_colocation": pairs.colocation_lift(master, "mall_name", "brand_id"),
        "brand_sensitivity": sensitivity.sensitivity_grid(cells, "mall_name"),
        "compositional_grouping": composition.aitchison_grouping(vectors, "mall_name"),
        "compositional_pca_sensitivity": composition.pca_sensitivity(vectors, "mall_name", labels),
        "compositional_parallel_analysis": factors.parallel,
        "compositional_factor_selection": factors.table,
        "compositional_factor_loadings": factor_selection.with_source(
            composition.loading_poles(spark, factors.loadings, labels), factors.source
        ),
        "compositional_factor_scores": factors.scores,
        **compared,
        "mall_category_counts": venue.count_matrix(master, "mall_name", "category_l2", labels),
    }


def profiles(features: DataFrame, scores: DataFrame, mixtures: DataFrame) -> DataFrame:
    """One row per venue from three tables that must name the same venues."""
    return metadata.strict_join([features, scores, mixtures], "mall_name")


def run_stages(
    spark: SparkSession, stages: Sequence[tuple[str, Callable[[], dict[str, DataFrame]]]], staging: str, current: str
) -> DataFrame:
    """Run stages in order into a staging folder, publish it, and return the manifest.

    The manifest has each table's rows, digest and own seconds, taken while it was written. The first failing stage stops
    the run and leaves the published results as they were.
    """
    rows = []
    for name, stage in stages:
        for table, done in sinks.package(stage(), staging).items():
            rows.append((name, table, done.path.replace(staging, current), done.rows, done.digest, done.seconds))
    manifest = spark.createDataFrame(rows, "stage string, table string, path string, rows bigint, digest string, seconds double")
    sinks.write_json(manifest, f"{staging.rstrip('/')}/manifest")
    sinks.publish(spark, staging, current)
    return manifest
