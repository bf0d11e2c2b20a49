"""Orders, word lists, stored models, training documents, options and head rules that no query reaches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweave.operators import joint, learning, lexical, ordering, templates, trees
from chainweave.plans.config import LANGUAGES, Options
from chainweave.sources import text_formats


def test_fixed_random_order(spark):
    docs = spark.createDataFrame([(f"d{k}",) for k in range(50)], "doc_key string")
    one, two, other = ([r[0] for r in ordering.shuffled(d, seed=s).collect()] for d, s in ((docs, 0), (docs.repartition(7), 0), (docs, 1)))
    assert one == two != other and sorted(one) == sorted(other) != one
    keys = spark.createDataFrame([([2],), ([1, 5],), ([1],), ([],), ([1, 4, 9],)], "key array<int>")
    assert [r[0] for r in ordering.in_key_order(keys, "key").collect()] == [[], [1], [1, 4, 9], [1, 5], [2]]


def test_word_lists_and_counts(spark):
    lines = spark.createDataFrame([("The",), (" the ",), ("Cat",), ("",)], "value string")
    assert sorted(r[0] for r in text_formats.word_list(lines).collect()) == ["cat", "the"]
    assert sorted(r[0] for r in text_formats.word_list(lines, lower=False).collect()) == ["Cat", "The", "the"]
    grams = spark.createDataFrame([("a b c 12",), ("one",), ("x y z",)], "value string")
    assert [tuple(r) for r in text_formats.ngrams(grams).collect()] == [(["a", "b", "c"], 12)]
    counts = spark.createDataFrame([("b", "c", 2.9), ("a", "z", 10.0)], "x string, y string, cnt double")
    text = [r[0] for r in text_formats.query_counts_text(counts, ["x", "y"]).collect()]
    assert text == ["a z 10", "b c 2"]
    _, pairs = text_formats.query_counts(spark.createDataFrame([(t,) for t in text], "value string"))
    assert {tuple(r) for r in pairs.collect()} == {("a", "z", 10.0), ("b", "c", 2.0)}


def test_stored_tables_are_not_overwritten(spark, tmp_path):
    weights = spark.createDataFrame([(1, 0.5), (2, -1.0)], "feat_idx int, weight double")
    text_formats.write_table(weights, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).exceptAll(weights).count() == 0
    with pytest.raises(Exception, match="EXISTS"):
        text_formats.write_table(weights, str(tmp_path / "w"))


def test_training_documents_train_a_ranker(spark):
    rng = random.Random(3)
    mentions, pairs, clusters = [], [], []
    for doc in range(12):
        truth = [rng.randrange(3) for _ in range(7)]
        mentions += [(doc, m, [int(truth[m] in truth[:m]), 2 + m % 3]) for m in range(7)]
        pairs += [(doc, m, a, [int(truth[a] == truth[m]), 2]) for m in range(7) for a in range(m)]
        clusters += [(doc, m, t) for m, t in enumerate(truth)]
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((mentions, "doc_key int, m long, feats array<int>"), (pairs, "doc_key int, m long, a long, feats array<int>"), (clusters, "doc_key int, ment_idx long, cluster_id long"))]
    documents = list(learning.training_documents(*frames))
    assert [len(d.mentions) for d in documents] == [7] * 12
    for doc, d in enumerate(documents):
        assert d.clusters.tolist() == [t for k, _, t in clusters if k == doc]
        for m in range(7):
            assert d.pairs_of(m).tolist() == [f for k, x, _, f in pairs if k == doc and x == m]
    ranker, opt = learning.Ranker(4, 6, 8, 8, 4), learning.AdaGrad(0.1)
    losses = [ranker.epoch(documents, opt) for _ in range(5)]
    assert losses[-1] < losses[0]


def test_dirichlet_draws():
    rng = np.random.default_rng(0)
    for size in (2, 5):
        draws = np.array([learning.dirichlet(rng, np.ones(size), 1) for _ in range(4000)])
        assert np.allclose(draws.sum(1), 1) and (draws > 0).all()
        expected = (np.ones(size) + 4 * (np.arange(size) == 1)) / (size + 4)
        assert np.allclose(draws.mean(0), expected, atol=0.02)


def test_split_model_learns(spark):
    rows = [(f"{w}{e} {n}", not dot) for w, dot in (("end", False), ("Mr", True)) for e in (".",) for n in ("Next", "He", "It", "The") for _ in range(6)]
    texts = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "doc_id long, text string, label boolean")
    examples = templates.split_examples(texts).withColumn("label", F.col("label").cast("double"))
    model = templates.train_splits(examples, "label")
    from pyspark.ml.feature import HashingTF

    hashed = HashingTF(numFeatures=1 << 12, binary=True, inputCol="feats", outputCol="features").transform(examples)
    assert model.transform(hashed).where("prediction = label").count() == examples.count() == len(rows)


def test_options(spark):
    own = Options.bound(["-feature_sets", "+FINAL+nomentlen", "epochs=3", "rate=0.5", "-epochs", "4", "language=arabic"])
    assert (own.feature_sets, own.epochs, own.rate, own.l1) == ("+FINAL+nomentlen", 4, 0.5, 0.001) and own.pack == LANGUAGES["arabic"]
    for bad in (["-nope", "1"], ["epochs=x"], ["-epochs"], ["nope=1"]):
        with pytest.raises(ValueError):
            Options.bound(bad)
    with pytest.raises(ValueError):
        joint.joint_features("SURFACE", "SOMETIMES")


def mention(k, head, kind="NOMINAL", **more):
    base = {"doc_key": "d", "ment_idx": k, "head": head, "first": head, "last": None, "prev1": "<s>", "next1": "ran", "penultimate": None, "second": None, "prev2": "<S>", "next2": "x", "governor": "R-ran", "ment_type": kind,
            "text": head, "start_idx": k, "end_idx": k + 1, "sent_idx": 0, "syn_uni": "VBD(R)", "syn_bi": "VBD(R)-[ROOT]", "sent_ment_idx": k + 1, "gender": "MALE", "number": "SINGULAR", "ner": "O", "speaker": "s"}
    return base | more


def test_gates_and_conjunctions(spark):
    """Every negative gate removes its templates; every kind of conjunction has its strings."""
    rows = [mention(0, "He", "PRONOMINAL"), mention(1, "Dog"), mention(2, "him", "PRONOMINAL")]
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in rows[1].items())
    m = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    counts = spark.createDataFrame([("head", "dog", 7), ("class", "-INITC", 9)], "template string, key string, cnt long")
    from chainweave.operators.pairs import mention_pairs

    tags = {p: F.lit("T") for p, _ in joint.POSITIONS}
    p = mention_pairs(joint.with_words(m, counts, tags, common_head=5), joint.COLUMNS, diagonal=True).cache()

    def feats(feature_set, kind="NONE", at=(1, 0)):
        return p.where(f"m = {at[0]} and a = {at[1]}").select(joint.joint_features(feature_set, kind).alias("f")).first()["f"]

    surface = feats("SURFACE")
    assert {f.split("=")[0] for f in surface} == {"SNMentLen", "SNMentHead", "SNMentFirst", "SNMentLast", "SNMentPreceding", "SNMentFollowing", "PrevMentLen", "PrevMentPreceding", "PrevMentFollowing", "Dist", "SentDist", "ExactStrMatch", "ExactHeadMatch"}
    assert "SNMentHead=dog-SN=false" in surface and "SNMentFirst=T-SN=false" in surface and "SNMentLast=-SN=false" in surface
    for gate, gone in (("+nomentlen", "MentLen"), ("+nolexanaph", "MentHead"), ("+nolexfirstword", "MentFirst"), ("+nolexlastword", "MentLast"), ("+nolexprecedingword", "Preceding"), ("+nolexfollowingword", "Following"), ("+nomentdist", "Dist="), ("+nosentdist", "SentDist"), ("+noexactmatch", "ExactStrMatch"), ("+noheadmatch", "ExactHeadMatch")):
        left = feats(gate)
        assert left == [f for f in surface if not (f.startswith(gone) if gone == "Dist=" else gone in f.split("=")[0])]
    dist = lambda kind, at: [f for f in feats("SURFACE", kind, at) if f.startswith("Dist=")]
    assert dist("TYPE", (1, 0)) == ["Dist=1", "Dist=1&Curr=NOMINAL", "Dist=1&Curr=NOMINAL&Prev=PRONOMINAL"]
    assert dist("TYPE_OR_RAW_PRON", (2, 0)) == ["Dist=2", "Dist=2&Curr=him", "Dist=2&Curr=him&Prev=he"]
    assert dist("CANONICAL", (2, 0)) == ["Dist=2", "Dist=2&Curr=he", "Dist=2&Curr=he&Prev=he"]
    assert dist("CANONICAL_NOPRONPRON", (2, 0)) == ["Dist=2", "Dist=2&Curr=PRONOMINAL", "Dist=2&Curr=PRONOMINAL&Prev=PRONOMINAL"]
    assert dist("CANONICAL_NOPRONPRON", (2, 1)) == ["Dist=1", "Dist=1&Curr=he", "Dist=1&Curr=he&Prev=NOMINAL"]
    assert dist("CANONICAL_OR_COMMON", (2, 1)) == ["Dist=1", "Dist=1&Curr=he", "Dist=1&Curr=he&Prev=dog"]
    only = feats("SURFACE", "CANONICAL_ONLY_PAIR_CONJ")
    assert [f for f in only if "&" in f and f.startswith(("SN", "PrevMent"))] == [] and len([f for f in only if f.startswith("Dist=")]) == 3
    assert [f for f in feats("+bias", at=(0, 0)) if f.startswith(("SN=", "Dist"))] == ["SN=true"]
    alone = [r["f"] for r in joint.with_words(m, counts, tags).orderBy("ment_idx").withColumn("animacy", F.lit("UNKNOWN")).select(joint.separate_mention_features(first_too=False).alias("f")).collect()]
    assert alone[0] == [] and len(alone[1]) == 19


def test_head_rules_of_both_languages():
    def tree(label, *children):
        node = trees.Node(label, 0)
        node.children = [trees.Node(c, k) for k, c in enumerate(children)]
        return node

    of = lambda language, label, *children: trees.head_child(tree(label, *children), language).label
    assert of("english", "NP", "NN", "JJ", "NNS") == "NNS" and of("arabic", "NP", "NN", "JJ", "NNS") == "NN"
    assert of("arabic", "ADJP", "RB", "JJ", "NN", "JJ") == "JJ" and of("arabic", "ADJP", "DT", "UH") == "DT"
    assert of("arabic", "VP", "NP", "VP", "VBD") == "VBD" and of("arabic", "S", "NP", "PP") == "PP" and of("arabic", "UCP", "CC", "NN") == "CC"
    assert of("arabic", "QP", "CD", "CD", "NN") == "NN" and of("arabic", "ROOT", "S", "PUNC") == "S"
    assert of("english", "NP", "NN", "CC", "NN") == "NN" and trees.head_child(tree("NP", "NN", "CC", "NN"), "english").start == 0


def test_counts_of_affixes_and_fallbacks(spark):
    known = spark.createDataFrame([("prefix", "un"), ("prefix", "unb"), ("suffix", "n")], "template string, key string")
    words = spark.createDataFrame([("Unbroken",), ("under",), ("x",)], "word string")
    assert [r["p"] for r in lexical.affix_fallback(words, known, "word", "p", "prefix").orderBy("word").collect()] == ["unb", "un", ""]
    assert [r["s"] for r in lexical.affix_fallback(words, known, "word", "s").orderBy("word").collect()] == ["n", "", ""]


def test_phrases_of_a_language(spark):
    from chainweave.operators import mentions as M

    schema = "doc_key string, sent_idx long, start_idx long, end_idx long, label string, head_idx long"
    found = spark.createDataFrame([("d", 0, 0, 3, "NP-SBJ", 1), ("d", 0, 0, 3, "NML", 1), ("d", 0, 3, 4, "VP", 3), ("d", 0, 4, 5, "NP", 4)], schema)
    tags = ["``", "NN", "''", "VBD", ".", "PRP"]
    tokens = spark.createDataFrame([("d", 0, k, t) for k, t in enumerate(tags)], "doc_key string, sent_idx long, tok_idx long, pos string")
    spans = lambda pack: {tuple(r)[2:] for r in M.phrase_spans(found, tokens, pack).collect()}
    assert spans(LANGUAGES["english"]) == {(1, 2, 1), (5, 6, 5)}
    assert spans(LANGUAGES["chinese"]) == {(0, 3, 1), (4, 5, 4)}  # other tags are punctuation and pronouns there


def test_losses_by_name(spark):
    from chainweave.functions import numeric

    df = spark.createDataFrame([(True, True, False, 4), (True, False, False, 4), (True, False, True, 4), (False, False, False, 1), (False, True, True, 1)], "ana boolean, new boolean, ok boolean, size int")
    of = lambda name: [r[0] for r in df.select(numeric.named_loss(name, F.col("ana"), F.col("new"), F.col("ok"), F.col("size"))).collect()]
    assert of("noLoss") == [0] * 5 and of("precisionLoss") == [0, 1, 0, 1, 0] and of("recallLoss") == [1, 1, 0, 0, 0]
    assert of("customLoss-0.1-3-1") == [3, 1, 0, 0.1, 0] and of("weightedCustomLoss-0.1-3-1-0.5") == [7.5, 2.5, 0, 0.1, 0]
    for bad in ("customLoss", "customLoss-1-2", "loss", "noLoss-1"):
        with pytest.raises(ValueError):
            numeric.named_loss(bad, F.col("ana"), F.col("new"), F.col("ok"))


def test_shown_numbers(spark):
    from chainweave.functions import numeric

    numbers = [0.0, 1e-30, 0.00012, 0.5, -2.25, 9999.0, 10000.0, -1.5e12, float("inf"), float("-inf"), float("nan")]
    found = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double").orderBy("k").select(numeric.shown(F.col("x"))).collect()
    assert [r[0] for r in found] == ["0", "tiny", "1.2e-4", "0.500", "-2.250", "9999.000", "1.0e4", "-1.5e12", "+Inf", "-Inf", "NaN"]
