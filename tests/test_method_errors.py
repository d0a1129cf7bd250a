from voxelloom.operators import meshes


def test_every_error_text_is_counted(spark):
    rows = [("a", True, None), ("a", False, "x"), ("a", False, "y"), ("a", False, "x"), ("b", None, None)]
    found = meshes.method_errors(spark.createDataFrame(rows, "method string, success boolean, error string")).collect()
    assert sorted(map(tuple, found), key=str) == [("a", "x", 2), ("a", "y", 1), ("b", None, 1)]
