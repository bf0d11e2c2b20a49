"""Networks score vectors as arrays, not row by row."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from chainweave.operators import learning


def test_vectors_are_scored_as_arrays(spark):
    net = learning.SparseMlp(50, 8)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 60, (500, 4))  # ids from 50 are the dummy's
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, feats array<int>").repartition(3)
    scored = learning.scored_vectors(rows, net)
    assert "InPandas" not in scored._jdf.queryExecution().analyzed().toString()
    found = {r.k: r.score for r in scored.collect()}
    assert np.allclose([found[k] for k in range(500)], net.scores(np.minimum(x, 49)), rtol=0, atol=1e-12)
    assert learning.scored_vectors(rows.where("k < 0"), net).isEmpty()
    with pytest.raises(PythonException, match="one length"):
        learning.scored_vectors(rows.withColumn("feats", F.expr("slice(feats, 1, 1 + k % 2 * 2)")), net).collect()
