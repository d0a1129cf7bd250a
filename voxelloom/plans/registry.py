"""Registration of queries with their SQL check, and the SQL views both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return register


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable result types: 64-bit integers and rounded doubles (no negative zero)."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            column = column.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        columns.append(column.alias(name))
    return df.select(*columns)


# The SQL twins of voxelloom.sources.testdata, written for DuckDB.
VOX = """vox AS (
  SELECT 'v' || (e.vec_id // 128) AS volume_id, (e.vec_id % 128) // 16 AS z, e.vec_id % 16 AS y, r.p AS x,
         CAST(e.embedding[r.p + 1] AS DOUBLE) AS f,
         CAST(trunc(least(255, greatest(0, (CAST(e.embedding[r.p + 1] AS DOUBLE) + 0.6) / 1.2 * 255))) AS BIGINT) AS v
  FROM embeddings e, range(64) r(p))"""

# Whole slices: lines the last slice lacks are 0.
DENSE = (
    VOX
    + """, cells AS (
  SELECT 'v' || (i // 128) AS volume_id, (i % 128) // 16 AS z, i % 16 AS y, r.p AS x
  FROM range((SELECT max(vec_id) // 16 + 1 FROM embeddings) * 16) g(i), range(64) r(p)),
dense AS (
  SELECT c.volume_id, c.z, c.y, c.x, coalesce(v.v, 0) AS v
  FROM cells c LEFT JOIN vox v ON v.volume_id = c.volume_id AND v.z = c.z AND v.y = c.y AND v.x = c.x),
shape AS (SELECT volume_id, max(z) + 1 AS n_slices, 16 AS h, 64 AS w FROM dense GROUP BY volume_id)"""
)

# Byte counts of the text rasters.
TEXT_HIST = """raw AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
bytes AS (SELECT 'd' || doc_id AS volume_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM raw),
counted AS (SELECT volume_id, i // 2048 AS z, ('0x' || p)::BIGINT AS v, count(*) AS n FROM bytes GROUP BY ALL),
fill AS (SELECT 'd' || doc_id AS volume_id, (greatest(len(l), 1) - 1) // 2048 AS z, 0 AS v,
                2048 * ((greatest(len(l), 1) - 1) // 2048 + 1) - len(l) AS n FROM raw),
thist AS (SELECT volume_id, z, v, sum(n)::BIGINT AS n
          FROM (SELECT * FROM counted UNION ALL SELECT * FROM fill WHERE n > 0) GROUP BY ALL)"""

PIXELS = """pix AS (
  SELECT 'v' || (e.vec_id // 128) || '_' || ((e.vec_id % 128) // 16 // 4) AS batch,
         'v' || (e.vec_id // 128) || '_' || ((e.vec_id % 128) // 16) AS slice,
         e.vec_id % 16 AS y, r.p AS x,
         1.0::DOUBLE / (1.0::DOUBLE + exp(CAST(e.embedding[r.p + 1] AS DOUBLE) * -8.0::DOUBLE)) AS p1,
         CASE WHEN CAST(e.embedding[r.p + 1] AS DOUBLE) + CAST(e.embedding[64 - r.p] AS DOUBLE) * 0.5::DOUBLE > 0 THEN 1 ELSE 0 END AS t
  FROM embeddings e, range(64) r(p)),
sums AS (
  SELECT batch, slice, count(*) AS n,
         sum(CASE WHEN (p1 > 0.5) = (t = 1) THEN 1 ELSE 0 END) AS correct,
         sum(CASE WHEN p1 > 0.5 AND t = 1 THEN 1 ELSE 0 END) AS i,
         sum(CASE WHEN p1 > 0.5 OR t = 1 THEN 1 ELSE 0 END) AS u,
         sum(p1) AS sp, sum(t) AS st, sum(p1 * t) AS tp, sum(p1 * (1 - t)) AS fp, sum((1 - p1) * t) AS fn,
         sum((1 - p1) * (1 - t)) AS tn
  FROM pix GROUP BY batch, slice)"""

HISTORY = """history AS (
  SELECT 'run_' || (event_id // 50) AS run, event_id % 50 + 1 AS epoch, 1.0::DOUBLE / (value + 1) AS train_loss,
         value / (value + 5) AS val_pixAcc, value / (value + 20) AS val_IoU_pos, 0.001::DOUBLE / (event_id % 50 + 1) AS lr
  FROM events)"""

BOXES = """boxes AS (
  SELECT 'm' || l_orderkey AS mesh_id, l_linenumber * 100.0::DOUBLE AS x0, l_quantity AS a,
         l_discount * 100 + 1 AS b, l_tax * 100 + 1 AS c FROM lineitem)"""
