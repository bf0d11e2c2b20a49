"""Links found by op9 on the sf0.1 documents, against exact similarities of every document whose id is divisible by 100 with all others."""

import collections

from test_operators import shingle_set

from chainweave.llm import near_duplicates


def test_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = {i: shingle_set(t) for i, t in texts.items() if i % 100 == 0}
    having = collections.defaultdict(list)
    for i, own in asked.items():
        for x in own:
            having[x].append(i)
    links = set()
    for j, t in texts.items():
        other = shingle_set(t)
        common = collections.Counter(i for x in other for i in having.get(x, ()))
        links |= {(i, j) for i, n in common.items() if i != j and 10 * n >= 8 * (len(asked[i]) + len(other) - n)}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.classes(docs).collect()}
    counted = collections.Counter(i for i, _ in links)
    assert len(asked) == 100 and len(links) >= 20
    assert {i: found[i][1] for i in asked} == {i: counted[i] for i in asked}  # recall and precision 1.0
    assert all(found[i][0] == found[j][0] for i, j in links)
    print(len(links), "links")
