"""What runs for every pair is generated code, in methods that the virtual machine compiles."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from chainweave.operators import joint


def test_features_of_pairs_have_no_interpreted_part(spark):
    columns = (F.lit(1 if c.endswith("_idx") else "x").alias(f"{p}_{c}") for p in "ma" for c in joint.COLUMNS)
    pairs = spark.createDataFrame([(2, 1), (1, 1)], "m int, a int").select("m", "a", *columns)
    rows = pairs.select(joint.joint_features("+FINAL", "TYPE").alias("feats"))
    assert "lambda" not in rows._jdf.queryExecution().analyzed().toString().lower()
    for (feats,) in rows.collect():
        assert feats and all("=" in x for x in feats)


def test_long_methods_are_cut_for_the_core_queries_only(spark):
    entry.compiled_in_pieces(spark, False)  # earlier tests run core queries
    before = spark.conf.get(entry.COMPILED)
    entry.queries()["mentions"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(entry.COMPILED) == "8000"
    entry.compiled_in_pieces(spark, False)
    assert spark.conf.get(entry.COMPILED) == before
