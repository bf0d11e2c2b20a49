"""What a task sorts of the training pairs does not follow the input."""

from pyspark.sql import Window, functions as F

from chainweave.plans import proxy, queries

DATA = "/root/testdata/sf0.001"


def test_pairs_are_not_sorted_to_tell_anaphoric_mentions(spark):
    pairs = queries._with_loss(spark, DATA)
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(doc_key" in plan and not any(" m#" in x.split(")")[0] for x in plan.split("windowspecdefinition(")[1:])
    told = proxy.scored_pairs(spark, DATA, diagonal=True).withColumn("any", F.bool_or("coreferent").over(Window.partitionBy("doc_key", "m"))).select("doc_key", "m", "a", "any")
    both = pairs.select("doc_key", "m", "a", "anaphoric").join(told, ["doc_key", "m", "a"])
    assert both.count() == told.count() > 0
    assert both.where("anaphoric <> any").isEmpty() and not both.where("anaphoric").isEmpty()
