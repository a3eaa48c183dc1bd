from collections import Counter

import corpus_pipeline
from tesserae.llm import line_crf
from tests.llm.test_dedup_and_sharding import brute_groups, fold
from tests.llm.test_models import labelled


def test_stages(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in labelled(5, 120)]
    rows += [(500 + d, t.upper()) for d, t in rows[1:30:3]] + [(700 + d, t + " tail") for d, t in rows[1:40:3]] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, q, x) for d, _, q, x in labelled(5, 120)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{k}")
        seen.append((name, now.collect(), spark.read.parquet(f"{tmp_path}/{k}")))
        now = seen[-1][2]
    assert [n for n, *_ in seen] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(out.columns == docs.columns for _, _, out in seen[:-1])
    # every stage against its own input
    model = line_crf.fit(docs, labels, line_crf.crc_mod(line_crf.F.col("doc_id"), 3) != 1)
    before = seen[0][1]
    want = Counter(r.doc_id for r, s in zip(before, model.score([r.text or "" for r in before]), strict=True) if s >= 0.5)
    assert Counter(r.doc_id for r in seen[0][2].collect()) == want and len(want) < len(before)
    last = {}
    for r in seen[1][1]:
        last[fold(r.text)] = max(r.doc_id, last.get(fold(r.text), -1))
    assert sorted(r.doc_id for r in seen[1][2].collect()) == sorted(last.values()) and len(last) < len(seen[1][1])
    groups = brute_groups([(r.doc_id, r.text) for r in seen[2][1]])
    assert sorted(r.doc_id for r in seen[2][2].collect()) == sorted(d for d, g in groups.items() if g[2])
    mixed = seen[3][2].collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in seen[3][1]} and max(Counter(r.doc_id for r in mixed).values()) > 1
    tokens = Counter()
    for r in seen[4][2].collect():
        tokens[r.doc_id] += r.length
    total = {(r.doc_id, r.doc_tokens) for r in seen[4][2].collect()}
    assert tokens == Counter({d: n * sum(r.doc_id == d for r in mixed) for d, n in total})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


NAMES = "doc_id long, text string, lang string, source string, n_chars long, place string, n_copies string, copy_no string, _doc string, _row string"


def test_stages_with_clashing_columns_null_ids_and_repeats(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in labelled(5, 60)]
    rows += [(None, rows[1][1]), (None, rows[1][1]), rows[2], (3, "another text that shares an id with the third"), (901, None)]
    docs = spark.createDataFrame([(d, t, "en", None, 1, "mine", "a", "b", "c", "d") for d, t in rows], NAMES)
    spark.createDataFrame([(d, q, x) for d, _, q, x in labelled(5, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
        else:
            assert out.columns == docs.columns
            got = out.collect()
            assert got and all((r.place, r.n_copies, r.copy_no, r._doc, r._row) == ("mine", "a", "b", "c", "d") for r in got), name


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], NAMES)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
