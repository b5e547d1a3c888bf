"""Registered queries for segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.operators import features as fe
from storecast.operators import segment as H
from storecast.operators.order import materialize
from storecast.plans import sql_blocks as S
from storecast.plans.explore_queries import panel, q
from storecast.plans.registry import register
from storecast.session import ensure_checkpoint_dir

COLS = H.SEG_COLS

_H1 = """sf AS (
  SELECT store, AVG(weekly_sales) AS mean_weekly, stddev_samp(weekly_sales) AS std_weekly,
         AVG(CASE WHEN is_holiday = 1 THEN weekly_sales END)
           / greatest(AVG(CASE WHEN is_holiday <> 1 THEN weekly_sales END), 1.0E0) AS hol_lift,
         AVG(total_markdown) AS mean_md, AVG(cpi) AS mean_cpi, AVG(unemployment) AS mean_unemp,
         CAST(MIN(size) AS DOUBLE) AS size, MIN(type) AS type
  FROM panel GROUP BY store)"""
_Z = """m AS (SELECT """ + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLS) + """ FROM sf),
z AS (SELECT store, type, """ + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0E0 ELSE s_{c} END AS {c}" for c in COLS) + """ FROM sf, m)"""


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in COLS) + ")"


def store_vectors(spark, sf_dir):
    return H.entity_vectors(panel(spark, sf_dir))


def std_vectors(spark, sf_dir):
    """Standardised store vectors; the vectors (one row per store) are written once, as every measure reads them often."""
    return fe.standardize(_materialized(store_vectors(spark, sf_dir)), COLS)


def _materialized(df):
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(df)


@register("h1_entity_vectors", q(",\n" + _H1 + "\nSELECT store, " + ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in COLS) + ", type FROM sf"))
def h1_entity_vectors(spark, sf_dir):
    v = store_vectors(spark, sf_dir)
    return v.select("store", *[rnd(c, 6).alias(c) for c in COLS], "type")


@register("h4_silhouette_by_type", q(",\n" + _H1 + ",\n" + _Z + """,
d AS (SELECT a.store AS i, a.type AS li, b.type AS lj, """ + _dist("a", "b") + """ AS dist
      FROM z a JOIN z b ON a.store <> b.store),
per AS (SELECT i, li, lj, AVG(dist) AS md FROM d GROUP BY i, li, lj),
s AS (SELECT i, MAX(CASE WHEN lj = li THEN md END) AS a, MIN(CASE WHEN lj <> li THEN md END) AS b FROM per GROUP BY i)
SELECT ROUND(AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM s"""))
def h4_silhouette_by_type(spark, sf_dir):
    """Exact Euclidean silhouette of the store-type labelling on standardised store vectors."""
    s = H.silhouette(_materialized(std_vectors(spark, sf_dir)), COLS, "type")
    return s.select(rnd("silhouette", 8).alias("silhouette"))


@register("h5_davies_bouldin_by_type", q(",\n" + _H1 + ",\n" + _Z + """,
c AS (SELECT type, """ + ", ".join(f"AVG({x}) AS {x}" for x in COLS) + """ FROM z GROUP BY type),
s AS (SELECT z.type, AVG(""" + _dist("z", "c") + """) AS s FROM z JOIN c ON z.type = c.type GROUP BY z.type),
r AS (SELECT a.type, MAX((sa.s + sb.s) / """ + _dist("a", "b") + """) AS r
      FROM c a JOIN c b ON a.type <> b.type JOIN s sa ON sa.type = a.type JOIN s sb ON sb.type = b.type GROUP BY a.type)
SELECT ROUND(AVG(r), 8) AS davies_bouldin FROM r"""))
def h5_davies_bouldin_by_type(spark, sf_dir):
    d = H.davies_bouldin(std_vectors(spark, sf_dir), COLS, "type")
    return d.select(rnd("davies_bouldin", 8).alias("davies_bouldin"))


@register("h11_cluster_profile_by_type", q(",\n" + _H1 + ",\n" + "per AS (SELECT type, " + ", ".join(
    f"AVG({c}) AS {c}" for c in COLS) + " FROM sf GROUP BY type),\nov AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in COLS) + " FROM sf)\n" + " UNION ALL ".join(
    f"SELECT type, '{c}' AS feature, ROUND(({c} - m_{c}) / s_{c}, 6) AS z FROM per, ov" for c in COLS)))
def h11_cluster_profile_by_type(spark, sf_dir):
    p = H.cluster_profile(store_vectors(spark, sf_dir), "type", COLS)
    return p.select("type", "feature", rnd("z", 6).alias("z"))


@register("h12_cluster_summary_by_size_band", q(",\n" + _H1 + """,
lab AS (SELECT *, CASE WHEN size < 5000 THEN 0 ELSE 1 END AS cluster FROM sf),
mix AS (SELECT cluster, type, COUNT(*) AS c FROM lab GROUP BY cluster, type)
SELECT l.cluster, COUNT(*) AS stores, ROUND(AVG(mean_weekly), 6) AS mean_weekly, ROUND(AVG(hol_lift), 6) AS hol_lift,
       (SELECT string_agg(type || ':' || c, ', ' ORDER BY type) FROM mix WHERE mix.cluster = l.cluster) AS type_mix
FROM lab l GROUP BY l.cluster"""))
def h12_cluster_summary_by_size_band(spark, sf_dir):
    """Cluster summary with a SQL-expressible labelling (size band) so it has an oracle."""
    v = store_vectors(spark, sf_dir).withColumn("cluster", F.when(F.col("size") < 5000, 0).otherwise(1))
    s = H.cluster_summary(v, "cluster")
    mix = F.array_join(F.transform(F.map_entries("type_mix"),
                                   lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    return s.select("cluster", "stores", rnd("mean_weekly", 6).alias("mean_weekly"),
                    rnd("hol_lift", 6).alias("hol_lift"), mix.alias("type_mix"))


@register("h2_k_search")
def h2_k_search(spark, sf_dir):
    """Inertia + silhouette for k = 2..8 over standardised store vectors (KMeans, 20 restarts)."""
    return H.k_search(std_vectors(spark, sf_dir), COLS, range(2, 9), seed=42, n_init=20)


@register("h3_kmeans_labels")
def h3_kmeans_labels(spark, sf_dir):
    """KMeans labels at the best k of the search, with that k and its two scores."""
    z = _materialized(std_vectors(spark, sf_dir))
    best = H.k_search(z, COLS, range(2, 9), seed=42, n_init=20).where("best").first()
    lab, _ = H.kmeans(z, COLS, best["k"], seed=42, n_init=30)
    lab = _materialized(lab)
    dbi = H.davies_bouldin(lab, COLS, "cluster").first()[0]
    return lab.select("store", "type", "cluster", F.lit(best["k"]).alias("k"), F.lit(best["silhouette"]).alias("silhouette"),
                      F.lit(dbi).alias("davies_bouldin"))


_DBSCAN_SQL = "WITH RECURSIVE " + ",\n".join(S.BASE) + ",\n" + _H1 + ",\n" + _Z + """,
nb AS (SELECT a.store AS src, b.store AS dst FROM z a JOIN z b ON """ + _dist("a", "b") + """ <= 1.5),
core AS (SELECT src AS store FROM nb GROUP BY src HAVING COUNT(*) >= 3),
ce AS (SELECT src, dst FROM nb WHERE src IN (SELECT store FROM core) AND dst IN (SELECT store FROM core)),
reach(root, node) AS (SELECT store, store FROM core UNION SELECT r.root, ce.dst FROM reach r JOIN ce ON r.node = ce.src),
comp AS (SELECT node AS store, MIN(root) AS lab FROM reach GROUP BY node),
border AS (SELECT nb.src AS store, MIN(comp.lab) AS lab FROM nb JOIN comp ON nb.dst = comp.store
           WHERE nb.src NOT IN (SELECT store FROM core) GROUP BY nb.src),
alll AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, CAST(row_number() OVER (ORDER BY lab) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT lab FROM comp))
SELECT z.store, COALESCE(num.cluster, -1) AS dbscan
FROM z LEFT JOIN alll ON z.store = alll.store LEFT JOIN num ON alll.lab = num.lab"""


@register("h10_dbscan", _DBSCAN_SQL)
def h10_dbscan(spark, sf_dir):
    """DBSCAN eps 1.5, min_samples 3 on standardised store vectors."""
    return H.dbscan(_materialized(std_vectors(spark, sf_dir)), COLS, 1.5, 3)


@register("h7_h8_agglomerative")
def h7_h8_agglomerative(spark, sf_dir):
    """The hierarchy behind a dendrogram as a split table: sizes and within-cluster sums for cuts at 1..8 clusters."""
    return H.split_table(_materialized(std_vectors(spark, sf_dir)), COLS, 8)


@register("h9_linkage_sweep")
def h9_linkage_sweep(spark, sf_dir):
    """Cuts of the hierarchy at 2..6 clusters with silhouette and Davies-Bouldin for each."""
    z = _materialized(std_vectors(spark, sf_dir))
    rows = []
    for k in range(2, 7):
        lab = _materialized(H.bisecting(z, COLS, k))
        rows.append((k, H.silhouette(lab, COLS, "bisect").first()[0], H.davies_bouldin(lab, COLS, "bisect").first()[0]))
    return spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double")


@register("h7_bisecting_kmeans")
def h7_bisecting_kmeans(spark, sf_dir):
    """Hierarchical clustering without a single merge task: bisecting KMeans at k = 4, with scores."""
    lab = _materialized(H.bisecting(std_vectors(spark, sf_dir), COLS, 4))
    sil = H.silhouette(lab, COLS, "bisect").first()[0]
    dbi = H.davies_bouldin(lab, COLS, "bisect").first()[0]
    return lab.select("store", "type", "bisect", F.lit(sil).alias("silhouette"), F.lit(dbi).alias("davies_bouldin"))
