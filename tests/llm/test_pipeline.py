import random

import corpus_pipeline
from meterstone.llm.common import stage
from tests_llm_brute import base_spans, hit_words, link_groups


def test_stages_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    rows = [(i, prose(80), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(60 + i, prose(80).upper().replace(" ", "!! ") + "!!", "en", "s0", 1) for i in range(30)]
    rows += [(90 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(5)]
    rows += [(95, prose(30) + " mail me@host.org or 10.1.2.3 " + prose(30), "en", "s2", 1)]
    rows += [(96, prose(10) + " " + rows[7][1][:150], "en", "s2", 1), (97, None, None, None, None), (98, "", "en", "s3", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    stages = [f for _, f in corpus_pipeline.STAGES]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = []
    for step in stages:
        at = stage(step(spark, at, str(tmp_path)))
        after.append(at.collect())
    good, single, clean, private, mixed = after
    assert {r.doc_id for r in good} == set(range(60)) | set(range(90, 99))
    groups = link_groups([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in single} == {g for g in groups.values()}
    dirty = {r.doc_id for r in single if 20 * hit_words(r.text, " ".join(rows[7][1].split()[:20])) >= len((r.text or "").split()) and hit_words(r.text, " ".join(rows[7][1].split()[:20]))}
    assert dirty and {r.doc_id for r in clean} == {r.doc_id for r in single} - dirty
    before = {r.doc_id: r.text for r in clean}
    for r in private:
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert (r.text != before[r.doc_id]) == bool(base_spans(before[r.doc_id]))
    assert "[EMAIL]" in next(r.text for r in private if r.doc_id == 95)
    assert all(len(r) == 5 for stage_rows in after[:-1] for r in stage_rows)
    assert all(r.taken == r["size"] * r.copies and r.copies in (1, 2) for r in mixed)
    assert {r.doc_id for r in mixed} <= set(before)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, mixed))


def test_odd_rows_pass_through_all_stages(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs.withColumnRenamed("Size", "score"), nothing):
        at = table
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = stage(step(spark, at, str(tmp_path)))
            assert out.columns == table.columns
            assert out.count() <= at.count()
            at = out
        corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
