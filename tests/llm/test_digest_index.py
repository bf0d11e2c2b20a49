"""The digest index against plain dictionaries, over several batches and sessions."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chainweave.llm import digest_index
from chainweave.llm.digest_index import DigestIndex

RNG = random.Random(3)
BASE = ["", None, " \t\r\n\x0b\x0c", "one text", "one  text", "onetext", "one text ", "one\xa0text", "é", "é", "日本 語", "日本語", "x " * 40_000, "x" * 40_000, "a\x1cb", "ab"]
ROWS = [(RNG.choice([None, *range(40)]), RNG.choice(BASE), k, f"r{k}", True) for k in range(300)]
SCHEMA = "doc_id long, text string, row long, digest string, kept boolean"


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def rank(row):
    return -len(row[1] or ""), row[0] is None, row[0] or 0


def test_copies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    groups = {}
    for r in ROWS:
        groups.setdefault(bare(r[1]), []).append(r)
    for deliveries in (1, 2, 5):
        found = digest_index.copies(docs, deliveries).collect()
        assert len(found) == len(ROWS)
        by_sha = {}
        for r in found:
            by_sha.setdefault(r["text_sha256"], []).append(r)
        assert by_sha.keys() == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
        for text, own in groups.items():
            rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
            best = min(own, key=rank)
            assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r[0]) for r in own)
            assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best[0], len(own))}
            assert [r["doc_id"] for r in rows if r["kept"]] == [best[0]]
    assert digest_index.copies(docs.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_batches_and_sessions(spark, tmp_path, seed):
    """Each batch gives the rows that the index has nothing as good for; a new session goes on with the folder."""
    rng, path = random.Random(seed), str(tmp_path / "index")
    index, best = DigestIndex.create(spark, path, buckets=3), {}
    for batch in range(4):
        rows = [(rng.choice([None, *range(60)]), rng.choice(BASE), k, f"b{batch}", False) for k in range(rng.choice([0, 40, 90]))]
        expected = {}
        for r in rows:
            if bare(r[1]) not in expected or rank(r) < rank(expected[bare(r[1])]):
                expected[bare(r[1])] = r
        expected = {t: r for t, r in expected.items() if t not in best or rank(r) < rank(best[t])}
        best |= expected
        found = index.new_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), f"batch {batch}")
        assert found.columns == ["doc_id", "text", "row", "digest", "kept"]
        found = found.collect()
        assert sorted(map(str, (rank(r) + (bare(r["text"]),) for r in found))) == sorted(map(str, (rank(r) + (t,) for t, r in expected.items())))
        if batch == 2:  # as another session would
            index.drop()
            index = DigestIndex.open(spark.newSession(), path)
            assert index.buckets == 3
            index = DigestIndex.open(spark, path)
    standing = {bytes(r["digest"]): (-r["n_chars"], r["doc_id"] is None, r["doc_id"] or 0) for r in index.standing().collect()}
    assert standing == {hashlib.sha256(t.encode()).digest(): rank(r) for t, r in best.items()}
    again = index.unbeaten(digest_index.signed(spark.createDataFrame(list(best.values()), SCHEMA)))
    assert again.collect() == []
    small = index.compacted(buckets=2)
    assert small.entries().count() == len(best) and small.standing().exceptAll(index.standing()).count() == 0


def test_plan(spark, tmp_path):
    """The index is not shuffled, and the join is by sorting and merging."""
    index = DigestIndex.create(spark, str(tmp_path / "i"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = digest_index.signed(spark.createDataFrame(ROWS, SCHEMA))
    index.add(rows, "first")
    plan = index.unbeaten(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("Exchange hashpartitioning(digest") == 1 and "Bucketed: true" in plan
    standing = index.standing()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in standing


def test_sql(spark):
    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{data}/documents.parquet'")
    found = digest_index.copies(spark.read.parquet(f"{data}/documents.parquet")).select(*sorted(["doc_id", "keep_id", "group_size", "kept", "text_sha256"]))
    expected = duck.sql(f"select doc_id, group_size, keep_id, kept, text_sha256 from ({digest_index.COPIES_SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert found.where(F.col("group_size") > 1).count()
