"""CoNLL text, trees, and the text forms of features and clusterings."""

import pytest
from pyspark.sql import functions as F

from chainweave.operators import analysis, clusters, components, mentions as M, trees
from chainweave.sources import conll, text_formats


def line(doc, k, word, pos="NN", bit="*", ner="*", coref="-", speaker="sp"):
    return f"{doc} 0 {k} {word} {pos} {bit} - - - {speaker} {ner} {coref}"


TEXT = "\n".join([
    "#begin document (nw/a); part 000",
    line("nw/a", 0, "The", "DT", "(TOP(S(NP*", "*", "(1|(2"), line("nw/a", 1, "Smith", "NNP", "*)", "(PERSON)", "2)"), line("nw/a", 2, "ran", "VBD", "(VP*)", "(ORG*", "1)"),
    line("nw/a", 3, ".", ".", "*))", "*)", "(3)"),
    "", "", line("nw/a", 0, "He", "PRP", "(TOP(S(NP*)", "*", "(1)|(7)"), line("nw/a", 1, "sat", "VBD", "(VP*", "*", "(5|(5"), line("nw/a", 2, "x", "NN", "*)))", "*", "5)|5)"), "#end document",
    "#begin document (nw/a); part 001", line("nw/a", 0, "Hi", "UH", "(TOP*)"), "", "#end document", "",
])


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("conll")
    (folder / "a.v4_auto_conll").write_text(TEXT)
    (folder / "a.txt").write_text("not annotated")
    return conll.documents(conll.read_lines(spark, str(folder), "*auto_conll")).cache()


def test_documents_and_sentences(tokens):
    rows = tokens.orderBy("doc_key", "sent_idx", "tok_idx").collect()
    assert [(r["doc_key"], r["sent_idx"], r["tok_idx"], r["word"]) for r in rows][:5] == [("nw/a (part 0)", 0, 0, "The"), ("nw/a (part 0)", 0, 1, "Smith"), ("nw/a (part 0)", 0, 2, "ran"), ("nw/a (part 0)", 0, 3, "."), ("nw/a (part 0)", 1, 0, "He")]
    assert [r["word"] for r in rows if r["doc_key"] == "nw/a (part 1)"] == ["Hi"]


def test_short_line_raises(spark):
    lines = spark.createDataFrame([("f", 0, "#begin document (x); part 000"), ("f", 1, "x 0 0 word")], "file string, line_no int, line string")
    with pytest.raises(Exception, match="fewer than twelve"):
        conll.documents(lines).collect()


def test_chunks(tokens):
    ner = {(r["sent_idx"], r["start_idx"], r["end_idx"], r["label"]) for r in conll.entity_chunks(tokens).collect()}
    assert ner == {(0, 1, 2, "PERSON"), (0, 2, 4, "ORG")}
    coref = {(r["sent_idx"], r["start_idx"], r["end_idx"], r["label"]) for r in conll.coref_chunks(tokens).collect()}
    assert coref == {(0, 0, 2, 2), (0, 0, 3, 1), (0, 3, 4, 3), (1, 0, 1, 1), (1, 1, 3, 5)}


def test_bits_round_trip(tokens):
    chunks = conll.coref_chunks(tokens).cache()
    again = conll.coref_bits(tokens, chunks)
    assert again.join(tokens.select("doc_key", "sent_idx", "tok_idx", F.col("coref_bit").alias("was")), ["doc_key", "sent_idx", "tok_idx"]).where("sent_idx = 0 and coref_bit <> was").count() == 0
    assert conll.coref_chunks(again).exceptAll(chunks).count() == chunks.exceptAll(conll.coref_chunks(again)).count() == 0
    ner = conll.entity_bits(tokens, conll.entity_chunks(tokens))
    assert {(r["tok_idx"], r["ner_bit"]) for r in ner.where("sent_idx = 0 and doc_key like '%0)'").collect()} == {(0, "*"), (1, "(PERSON)"), (2, "(ORG*"), (3, "*)")}
    text = conll.rewritten(tokens).orderBy("value").first()["value"]
    assert text.startswith("#begin document (nw/a); part 000\nnw/a\t0\t0\tThe\tDT") and text.endswith("\n\n#end document")


def test_bio(tokens):
    bio = conll.bio_labels(tokens, conll.entity_chunks(tokens))
    chunks = analysis.bio_chunks(bio, "bio")
    assert {(r["start_idx"], r["end_idx"], r["label"]) for r in chunks.collect()} == {(1, 2, "PERSON"), (2, 4, "ORG")}
    assert analysis.chunk_scores(chunks, chunks).first()["f1"] == 1


def test_trees(tokens):
    deps = {(r["sent_idx"], r["tok_idx"]): r["parent_idx"] for r in trees.dependencies(tokens).where("doc_key like '%0)'").collect()}
    assert [deps[0, k] for k in range(4)] == [1, 2, -1, 2]
    spans = {(r["label"], r["start_idx"], r["end_idx"], r["head_idx"]) for r in trees.constituents(tokens).where("doc_key like '%0)' and sent_idx = 0").collect()}
    assert ("NP", 0, 2, 1) in spans and ("VP", 2, 3, 2) in spans
    bits = ["(TOP(S(NP*", "*)", "(VP*)", "*))"]
    assert trees.parse_bits(trees.tree_of(bits, ["DT", "NNP", "VBD", "."])) == bits
    with pytest.raises(ValueError):
        trees.tree_of(["(S*"], ["X"])


def test_mentions(spark):
    spans = "doc_key string, sent_idx int, start_idx int, end_idx int, head_idx int"
    entities = spark.createDataFrame([("d", 0, 0, 2, 1, "PERSON"), ("d", 0, 8, 9, 8, "CARDINAL")], spans + ", label string")
    phrases = spark.createDataFrame([("d", 0, 0, 1, 0, "."), ("d", 0, 3, 6, 4, "."), ("d", 0, 3, 5, 4, ","), ("d", 0, 4, 5, 4, ".")], spans + ", next_pos string")
    pronouns = spark.createDataFrame([("d", 0, 7, 8, 7)], spans)
    found = M.numbered(M.proto_mentions(entities, phrases, pronouns)).orderBy("ment_idx").collect()
    assert [(r["start_idx"], r["end_idx"]) for r in found] == [(0, 2), (3, 5), (3, 6), (7, 8)]


def test_features_text(spark):
    lines = spark.createDataFrame([("d", "3|0|7 8|0|9|10 11|0")], "doc_key string, line string")
    pairs = text_formats.pair_features(lines)
    assert {(r["m"], r["a"]): r["feats"] for r in pairs.collect()} == {(1, 0): [7, 8], (2, 0): [9], (2, 1): [10, 11]}
    own = spark.createDataFrame([("d", k) for k in range(3)], "doc_key string, ment_idx long")
    assert text_formats.pair_features_text(pairs, own).first()["value"] == "3|0|7 8|0|9|10 11|0"
    assert text_formats.pair_features_text(pairs, own, blank=spark.createDataFrame([("d", 2, 0)], "doc_key string, m long, a long")).first()["value"] == "3|0|7 8|0||10 11|0"
    single = text_formats.mention_features(spark.createDataFrame([("d", "2|3 1|2")], "doc_key string, line string"))
    assert text_formats.mention_features_text(single).first()["value"] == "2|1 3|2"


def test_pointers_and_dictionaries(spark):
    docs = spark.createDataFrame([("b",), ("a",)], "doc_key string")
    lines = spark.createDataFrame([(0, "0 0 2 1"), (1, "0")], "line_no int, line string")
    pointers = text_formats.pointers_from_text(lines, docs)
    found = {(r["doc_key"], r["ment_idx"]): r["cluster_id"] for r in clusters.from_back_pointers(pointers).collect()}
    assert found == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 0, ("b", 0): 0}
    assert {r["value"] for r in text_formats.pointers_text(pointers).collect()} == {"0 0 2 1", "0"}
    counts = text_formats.gender_dictionary(spark.createDataFrame([("jack 1 2 3 4",), ("jack 1 0 0 0",), ("a b 5 6 7 8",), ("bad line",)], "value string"))
    assert {r["key"]: r["counts"] for r in counts.collect()} == {"jack": [2, 2, 3, 4], "a b": [5, 6, 7, 8]}
    one, two = text_formats.query_counts(spark.createDataFrame([("w 3",), ("x y 4",)], "value string"))
    assert one.first()["cnt"] == 3 and two.first()["y"] == "y"


def test_sentence_ends(spark):
    from chainweave.functions import strings

    yes = ["stuff. A", "stuff! A", "stuff? A", 'stuff." A', 'stuff!" A', 'stuff?" A', "stuff.'' A", "stuff!'' A", "stuff?'' A"]
    no = ["stuff; a", 'stuff;" a']
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", F.size(strings.sentence_candidates(F.col("t"))).alias("n")).collect()
    assert {r["t"] for r in rows if r["n"]} == set(yes)


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(61)}) == 1 and len({found[k] for k in (100, 101, 102)}) == 1
    assert len(set(found.values())) == 3 and len(found) == 65
