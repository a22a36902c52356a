"""The pipeline's stages on a folder of small tables."""

import random


import corpus_pipeline
from wardstats.llm.decontaminate import without_contaminated
from tests.llm.test_operators import cuts, prose, sets_of


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    clean = [(i, prose(rng, 70 + i)) for i in range(40)]
    item = prose(rng, 30)
    passage = prose(rng, 55)
    rows = list(clean)
    rows += [(100 + i, t) for i, t in clean[:5]] + [(110, clean[6][1] + " tail")]  # copies and a near copy
    rows += [(120 + k, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60)) for k in range(3)]
    rows += [(130, prose(rng, 60) + " " + item + " " + prose(rng, 60)), (140, "too short"), (141, None), (142, ""), (None, prose(rng, 90)), (3, clean[3][1])]
    rows += [(200 + k, "## $$ " * 40 + prose(rng, 60)) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "?") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept string")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 220)) for i, _ in rows if i is not None and (i % 2 or i < 20)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frames, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        if name != "packing":
            assert at.schema == docs.schema or at.columns == docs.columns
        path = f"{sf}/{name}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        frames[name] = sorted(((r.doc_id, r.text) for r in at.collect()), key=str) if name != "packing" else at.collect()
    good = [(i, t) for i, t in rows if t and len(t.split()) >= 50 and not (i or 0) >= 200]
    assert frames["quality"] == sorted(good, key=str)
    kept = []
    for (i, s), (_, t) in sorted(zip(sets_of(good), good), key=lambda x: (x[0][0] is None, x[0][0])):
        if not any(100 * len(s & o) >= 80 * len(s | o) for _, o, _ in kept):
            kept.append((i, s, t))
    assert frames["near_duplicates"] == sorted([(i, t) for i, _, t in kept], key=str)
    left = [(i, n - gone) for i, n, gone, _, _ in cuts([(i, t) for i, _, t in kept])]
    got = [(i, len(t.encode())) for i, t in frames["repeated_passages"]]
    assert {i for i, _ in got} == {i for i, _ in left} and all(dict(left)[i] - 3 * 4 <= n <= dict(left)[i] for i, n in got)
    assert sum(passage in t for _, t in frames["repeated_passages"]) == 1
    assert [x for x in frames["repeated_passages"] if x[0] != 130] == frames["decontamination"]
    assert {r.doc_id for r in frames["packing"]} == {i for i, _ in frames["decontamination"]}


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 80) for _ in range(3))
    near = b + " tail"
    columns = "doc_id long, text string, n_chars long"
    stay = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, spark.createDataFrame([(*x, 1) for x in rows], columns), "").collect()), key=str)
    assert stay([(5, a), (5, b), (3, b)]) == [(3, b), (5, a)]
    assert stay([(5, b), (5, near)]) in ([(5, b)], [(5, near)])
    assert stay([(None, a), (None, a), (4, a), (None, c)]) == [(4, a), (None, c)]
    assert stay([(-2, a), (1, a), (7, ""), (8, None), (7, "")]) == sorted([(-2, a), (7, ""), (8, None)], key=str)


def test_rows_are_contaminated_by_their_own_text(spark):
    rng = random.Random(8)
    item, clean = prose(rng, 40), prose(rng, 60)
    docs = spark.createDataFrame([(1, clean), (1, item), (None, item), (None, clean)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = without_contaminated(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"] and {r.text for r in got} == {clean}


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
