from voxelloom.operators import training


def test_a_run_without_a_saved_epoch_stays(spark):
    best = spark.createDataFrame([("a", 3, 0.9, 0.5)], "run string, epoch int, best_val_pixAcc double, best_val_IoU_pos double")
    settings = spark.createDataFrame([("a", "ce"), ("b", "focal")], "run string, loss string")
    rows = {r.run: r for r in training.training_summary(best, settings).collect()}
    assert (rows["a"].place, rows["b"].place) == (1, 2)
    assert (rows["b"].epoch, rows["b"].best_val_pixAcc, rows["b"].best_val_IoU_pos) == (None, 0.0, -1.0)
