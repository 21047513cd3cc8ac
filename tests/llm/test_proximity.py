"""Proximity matches of the decontamination against brute force."""

from strandlab.llm import decontaminate


def test_proximity_by_brute_force(spark):
    item = [f"w{k}" for k in range(30)]
    edited = [f"x{k}" if k % 9 == 4 else w for k, w in enumerate(item)]
    moved = item[:7] + ["in", "between"] + item[7:12] + ["w3"] + item[12:15]
    table = [(0, " ".join(edited)), (1, " ".join(moved)), (2, "w3 a b c d e f g h i j k l m n o w5"), (3, "nothing of it")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "absent " + " ".join(item[:4]))], "item_id long, text string")
    items = decontaminate.tokens(bench, "item_id").withColumnRenamed("pos", "place")
    postings = decontaminate.build_index(docs, items.select("term").distinct())
    keys = decontaminate.anchors(items, postings).join(items.select("item_id", "place"), ["item_id", "place"]).collect()
    texts = {7: item, 8: ["absent", *item[:4]]}
    places = {(r.item_id, r.place) for r in keys}
    want = set()
    for d, text in table:
        at = [(i, p, k) for i, p in places for k, w in enumerate(text.split()) if w == texts[i][p]]
        want |= {(d, i, p, q, k, m) for i, p, k in at for j, q, m in at if i == j and 0 < q - p < 10 and abs((m - k) - (q - p)) <= 5 and k != m}
    _, near = decontaminate.find(docs, bench)
    got = [tuple(r[c] for c in ("doc_id", "item_id", "place", "place_2", "pos", "pos_2")) for r in near.collect()]
    assert sorted(got) == sorted(want) and {d for d, *_ in want} == {0, 1} and 8 in {i for _, i, *_ in want}
    out = {r.doc_id: (r.n_near > 0, r.contaminated) for r in decontaminate.contamination(docs.where("doc_id in (0, 3)"), bench.where("item_id = 7")).collect()}
    assert out == {0: (True, False), 3: (False, False)}  # a changed word every nine leaves no phrase
