"""One query per operator over the whole tables of a folder, and the SQL where it can state the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontamination, lexical, line_templates, minhash, packing, personal_data, quality_mil, repeats, syncmers, token_files, url_filter
from .url_filter import Rule

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP1_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select cast(item_id as varchar) as item_id, coalesce({_WORDS}, []) as w from benchmark),
win as (select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as win
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from (select *, least(10, len(w)) as n from b where len(w) > 0))),
lens as (select distinct n from win),
dw as (select r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)),
m as (select distinct r, s, dw.n, item_id from dw join win on dw.win = win.win and dw.n = win.n),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from m) group by r),
ids as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join ids using (r)
"""


@query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_prob_minhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("text_key")


@query("op3_line_templates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_templates.without_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query("op9_attention_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = quality_mil.learn(docs, labels.where(~quality_mil.held_out()))
    found = quality_mil.scored(docs, model)
    return found.select("doc_id", quality_mil.held_out().alias("held_out"), "score", (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"))


#: The rules that the query applies.
URL_RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


@query("op8_url_segmentation")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), URL_RULES)


@query("op10_personal_data")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = personal_data.found(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in personal_data.BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans"))


@query("op5_token_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.shared_path(spark)
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


@query("op2_syncmers")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compared(table(spark, folder, "documents"))


@query("op7_prefix_doubling")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _op12_sql(k: int = 40, size: int = 64, rounds: int = 5) -> str:
    """Each round as two tables: the nearest centroid of every vector, and the centroids moved by exact division."""
    parts = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        "e as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as d from kept)",
        f"c0 as materialized (select row_number() over (order by h nulls last, v) - 1 as c, v from (select sha256('2:' || vec_id) as h, v from kept) qualify row_number() over (order by h nulls last, v) <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select r, c, dist from (select k.r, m.c, cast(list_sum(list_transform(generate_series(1, {size}), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i]))) as bigint) as dist
  from kept k, c{i} m) qualify row_number() over (partition by r order by dist, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (select o.c, coalesce(n.v, o.v) as v from c{i} o left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by d) as v
  from (select c, d, sum(x) as s, count(*) as n from a{i} join e using (r) group by c, d) group by c) n using (c))""")
    return f"""with {", ".join(parts)}
select kept.vec_id, cast(c as int) as cluster, dist as distance, cast(sum(dist) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(dist) over () as bigint) as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} m using (c)"""


@query("op12_simplex_centroids", _op12_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(centroids.fitted(table(spark, folder, "embeddings")))


@query("op11_vector_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP13_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, unnest({_TERMS}) as term from documents),
c as materialized (select r, any_value(doc_id) as doc_id, term, count(*) as tf from d group by r, term),
lens as materialized (select r, cast(sum(tf) as bigint) as n from c group by r),
t as (select count(*) as docs, cast(sum(n) as bigint) as terms from lens),
b as materialized (select distinct q, item_id, term from (select row_number() over () as q, item_id, unnest({_TERMS}) as term from benchmark)),
w as materialized (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from c where term in (select term from b) group by term), t),
m as (select r, 50 + (50 * n * docs) // terms as m from lens, t),
s as (select q, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from b join w using (term) join c using (term) join m using (r) group by q, r)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 50
"""


@query("op13_presence_masks", _OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
