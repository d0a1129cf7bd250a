"""Segmentation scores, run histories, splits and experiment grids on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom import layouts
from voxelloom.operators import scoring, training
from voxelloom.plans.registry import HISTORY, PIXELS, VOX, plain, query
from voxelloom.sources import testdata

E6 = "0.000001::DOUBLE"


def sums(spark, sf):
    return scoring.slice_sums(testdata.scored_pixels(spark, sf))


def batch_sql(expression: str) -> str:
    """SQL of a per-batch metric over the slice sums."""
    return f"WITH {PIXELS} SELECT batch, round({expression}, 6) AS value, count(*)::BIGINT AS n_slices FROM sums GROUP BY 1"


ACCURACY = "sum(correct) / sum(n)::DOUBLE"
IOU = "sum(i) / greatest(1, sum(u))::DOUBLE"
DICE = f"1 - avg(((2 * tp + {E6}) / (sp + st + {E6}) + (2 * tn + {E6}) / (n - sp + n - st + {E6})) / 2)"
TVERSKY_INDEX = f"(tp + {E6}) / (tp + 0.3 * fp + 0.7 * fn + {E6})"
CE_PIXEL = "-ln(CASE WHEN t = 1 THEN p1 ELSE 1 - p1 END)"
FOCAL_PIXEL = f"CASE WHEN t = 1 THEN -0.5 * pow(1 - p1, 2) * ln(p1 + {E6}) ELSE -0.5 * pow(p1, 2) * ln(1 - p1 + {E6}) END"


@query(batch_sql(ACCURACY))
def pixel_accuracy(spark, sf):
    return plain(scoring.pixel_accuracy(sums(spark, sf)))


@query(f"WITH {PIXELS}, b AS (SELECT {ACCURACY} AS v, count(*) AS n FROM sums GROUP BY batch) SELECT round(sum(v * n) / sum(n), 6) AS value, sum(n)::BIGINT AS n_slices FROM b")
def epoch_accuracy(spark, sf):
    return plain(scoring.over_batches(scoring.pixel_accuracy(sums(spark, sf))))


@query(batch_sql(IOU))
def iou_class1(spark, sf):
    return plain(scoring.iou_class1(sums(spark, sf)))


@query(f"WITH {PIXELS} SELECT round({IOU}, 6) AS value FROM sums")
def iou_class1_global(spark, sf):
    return plain(scoring.iou_class1(sums(spark, sf), per_batch=False))


@query(f"WITH {PIXELS} SELECT batch, slice, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn FROM sums")
def confusion_counts(spark, sf):
    return plain(scoring.confusion_counts(sums(spark, sf)))


@query(batch_sql(DICE))
def soft_dice_loss(spark, sf):
    return plain(scoring.soft_dice_loss(sums(spark, sf)))


@query(batch_sql(f"1 - avg({TVERSKY_INDEX})"))
def tversky_loss(spark, sf):
    return plain(scoring.tversky_loss(sums(spark, sf)))


@query(batch_sql(f"avg(pow(1 - {TVERSKY_INDEX}, 1.5))"))
def focal_tversky_loss(spark, sf):
    return plain(scoring.focal_tversky_loss(sums(spark, sf)))


@query(f"WITH {PIXELS} SELECT batch, round(avg({FOCAL_PIXEL}), 6) AS value, count(DISTINCT slice)::BIGINT AS n_slices FROM pix GROUP BY 1")
def focal_loss(spark, sf):
    return plain(scoring.focal_loss(sums(spark, sf)))


@query(f"""WITH {PIXELS} SELECT batch, round(sum({CE_PIXEL} * CASE WHEN t = 1 THEN 0.7 ELSE 0.3 END) / sum(CASE WHEN t = 1 THEN 0.7::DOUBLE ELSE 0.3 END), 6) AS value,
count(DISTINCT slice)::BIGINT AS n_slices FROM pix GROUP BY 1""")
def cross_entropy(spark, sf):
    return plain(scoring.cross_entropy(sums(spark, sf), 0.3, 0.7))


@query(f"""WITH {PIXELS}, px AS (SELECT batch, avg({CE_PIXEL}) AS ce, avg({FOCAL_PIXEL}) AS focal FROM pix GROUP BY 1),
sl AS (SELECT batch, {DICE} AS dice, 1 - avg({TVERSKY_INDEX}) AS tv, avg(pow(1 - {TVERSKY_INDEX}, 1.5)) AS ftv, count(*) AS n FROM sums GROUP BY 1),
b AS (SELECT * FROM px JOIN sl USING (batch))
SELECT batch, kind, round(CASE kind WHEN 'ce' THEN ce WHEN 'cedice' THEN (ce + dice) / 2 WHEN 'focal' THEN focal WHEN 'focaldice' THEN (focal + dice) / 2
  WHEN 'tversky' THEN tv ELSE ftv END, 6) AS value, n::BIGINT AS n_slices
FROM b, (SELECT unnest(['ce', 'cedice', 'focal', 'focaldice', 'tversky', 'focaltversky']) AS kind)""")
def combined_loss(spark, sf):
    return plain(scoring.all_losses(sums(spark, sf), ["ce", "cedice", "focal", "focaldice", "tversky", "focaltversky"]))


@query(f"""WITH {PIXELS}, px AS (SELECT batch, avg({CE_PIXEL}) AS ce FROM pix GROUP BY 1), sl AS (SELECT batch, {DICE} AS dice FROM sums GROUP BY 1)
SELECT round(avg((ce + dice) / 2), 6) AS train_loss FROM px JOIN sl USING (batch)""")
def epoch_train_loss(spark, sf):
    return plain(scoring.epoch_train_loss(scoring.combined_loss(sums(spark, sf), "cedice")))


@query(f"""WITH {VOX}, f AS (SELECT avg(CASE WHEN v > 150 THEN 1.0::DOUBLE ELSE 0 END) AS f1 FROM vox), w AS (SELECT 1 / greatest(1e-6, 1 - f1) AS a, 1 / greatest(1e-6, f1) AS b FROM f)
SELECT round(a / (a + b), 6) AS w0, round(b / (a + b), 6) AS w1 FROM w""")
def class_weights(spark, sf):
    mask = testdata.voxels(spark, sf).withColumn("v", (F.col("v") > 150).cast("int"))
    return plain(scoring.class_weights(layouts.voxels_to_hist(mask)))


@query(f"""WITH {VOX}, s AS (SELECT DISTINCT volume_id, z FROM vox ORDER BY volume_id, z LIMIT 20), f AS (SELECT avg(CASE WHEN v > 150 THEN 1.0::DOUBLE ELSE 0 END) AS f1 FROM vox JOIN s USING (volume_id, z)),
w AS (SELECT 1 / greatest(1e-6, 1 - f1) AS a, 1 / greatest(1e-6, f1) AS b FROM f) SELECT round(a / (a + b), 6) AS w0, round(b / (a + b), 6) AS w1 FROM w""")
def class_weights_of_first_batches(spark, sf):
    """The default estimate looks at the first ten batches of two slices; the bound is the feature."""
    mask = layouts.map_slices(scoring.first_slices(testdata.slices(spark, sf), 20), lambda image: image > 150)
    return plain(scoring.class_weights(layouts.slices_to_hist(mask)))


# Histories ----------------------------------------------------------------------------------------

SAVED = f"""{HISTORY}, marked AS (SELECT *, val_pixAcc > greatest(0, coalesce(max(val_pixAcc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS saved FROM history),
best AS (SELECT run, max(epoch) AS epoch, max(val_pixAcc) AS a, max(val_IoU_pos) AS i FROM marked WHERE saved GROUP BY 1)"""


@query(f"WITH {SAVED} SELECT run, epoch, saved FROM marked")
def mark_saved(spark, sf):
    return plain(training.mark_saved(testdata.histories(spark, sf)).select("run", "epoch", "saved"))


@query(f"WITH {SAVED} SELECT run, epoch, round(a, 6) AS \"best_val_pixAcc\", round(i, 6) AS \"best_val_IoU_pos\" FROM best")
def best_checkpoint(spark, sf):
    return plain(training.best_checkpoint(testdata.histories(spark, sf)))


@query(f"""WITH {HISTORY} SELECT run, epoch, round(val_IoU_pos, 6) AS "val_IoU_pos", round(max(val_IoU_pos) OVER (PARTITION BY run ORDER BY epoch), 6) AS best_so_far FROM history""")
def running_history(spark, sf):
    marked = training.running_history(testdata.histories(spark, sf), "val_IoU_pos")
    return plain(marked.select("run", "epoch", "val_IoU_pos", "best_so_far"))


@query(f"""WITH {HISTORY}, s AS (SELECT run, min(epoch) AS stop FROM history WHERE val_pixAcc >= 0.97 GROUP BY 1)
SELECT run, epoch, round(val_pixAcc, 6) AS "val_pixAcc" FROM history LEFT JOIN s USING (run) WHERE stop IS NULL OR epoch <= stop""")
def early_stop(spark, sf):
    return plain(training.early_stop(testdata.histories(spark, sf), 0.97).select("run", "epoch", "val_pixAcc"))


@query(f"""WITH {HISTORY} SELECT run, epoch, round(train_loss, 6) AS train_loss, round(val_pixAcc, 6) AS "val_pixAcc", round(val_IoU_pos, 6) AS "val_IoU_pos", round(lr, 6) AS lr FROM history""")
def read_history(spark, sf):
    return plain(training.history_columns(testdata.histories(spark, sf)))


@query(f"""WITH {SAVED}, cfg AS (SELECT DISTINCT run, CASE WHEN length(run) % 2 = 0 THEN 'ce' ELSE 'focal' END AS loss FROM history)
SELECT run, loss, epoch, round(a, 6) AS "best_val_pixAcc", round(i, 6) AS "best_val_IoU_pos", rank() OVER (ORDER BY a DESC)::BIGINT AS place FROM best JOIN cfg USING (run)""")
def training_summary(spark, sf):
    history = testdata.histories(spark, sf)
    settings = history.select("run", F.when(F.length("run") % 2 == 0, "ce").otherwise("focal").alias("loss")).distinct()
    return plain(training.training_summary(training.best_checkpoint(history), settings))


@query("""WITH n AS (SELECT 'img_' || doc_id || '.png' AS name, md5('img_' || doc_id || '.png|2025') AS h FROM documents),
r AS (SELECT name, row_number() OVER (ORDER BY h, name) AS k, greatest(1, floor(count(*) OVER () * 0.1::DOUBLE)) AS v FROM n)
SELECT name, CASE WHEN k <= v THEN 'val' ELSE 'train' END AS part FROM r""")
def train_val_split(spark, sf):
    files = testdata.table(spark, sf, "documents").select(F.format_string("img_%d.png", "doc_id").alias("name"))
    return plain(training.train_val_split(files))


@query("""WITH r AS (SELECT 'img_' || doc_id || '.png' AS name, row_number() OVER (ORDER BY 'img_' || doc_id || '.png') - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT name, (k // 7)::BIGINT AS batch FROM r WHERE k < n // 7 * 7""")
def batches(spark, sf):
    files = testdata.table(spark, sf, "documents").select(F.format_string("img_%d.png", "doc_id").alias("name"))
    return plain(training.batches(files, size=7, drop_last=True))


@query("""WITH s AS (SELECT p_partkey, i, j, k, l, 0.001::DOUBLE * CASE j WHEN 0 THEN 1 ELSE 0.3 END AS lr, CASE k WHEN 0 THEN p_size ELSE p_size + 2000 END AS seed
  FROM part, (SELECT unnest([0, 1, 2]) AS i, unnest(['ce', 'cedice', 'focal']) AS l), range(2) b(j), range(2) c(k))
SELECT 't' || p_partkey AS study, ((i * 2 + j) * 2 + k + 1)::BIGINT AS run_no, l AS loss, round(lr, 6) AS lr, seed::BIGINT AS seed,
 'loss-' || l || '_lr-' || CASE j WHEN 0 THEN '0.001' ELSE '0.0003' END || '_seed-' || seed AS run FROM s""")
def experiment_grid(spark, sf):
    studies = testdata.table(spark, sf, "part").select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("study"), F.lit("ce, cedice,,focal").alias("losses"), F.lit("1e-3, 3e-4").alias("lrs"),
        F.concat(F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 2000).cast("string")).alias("seeds"),
    )
    return plain(training.experiment_grid(studies))
