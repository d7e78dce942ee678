"""The pipeline's stages: what goes, what stays, and in what columns."""

import random
from collections import Counter

import corpus_pipeline

WORDS = "river stone under bright morning field castle window paper garden silver engine market winter letter".split()


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def test_stages(spark, tmp_path):
    item = prose(9999, 40)
    texts = [prose(i) for i in range(200)]
    texts[10] = texts[11] = texts[12]  # copies
    texts[20] = texts[21] + " tail"  # a near copy
    texts[30] = prose(555, 10) + " " + item
    texts[40] += " password: hunter2hunter2 end"
    texts[50], texts[51], texts[52] = None, "", "123 456"
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, note string")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_masks", "source_mix"]
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, now, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        kept.append({x["doc_id"] for x in now.collect()})
    assert set(range(200)) - kept[0] == {50, 51, 52}
    assert kept[0] - kept[1] == {11, 12, 21}
    assert kept[1] - kept[2] == {30}
    assert kept[2] == kept[3]
    masked = next(x for x in spark.read.parquet(f"{sf}/3").collect() if x["doc_id"] == 40)
    assert "hunter2" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    n = Counter(x["doc_id"] for x in now.collect())
    assert max(n.values()) <= 2 and set(n) <= kept[3]
    whole = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.run(spark, sf).collect())
    assert whole == Counter((x["doc_id"], x["text"]) for x in now.collect())
    # A run that was stopped goes on from the tables that are complete.
    folder = f"file://{sf}/stages"
    assert whole == Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.run(spark, sf, folder).collect())
    (tmp_path / "stages" / "2-decontamination" / "_SUCCESS").unlink()
    docs.limit(0).write.mode("overwrite").parquet(f"{sf}/stages/3-secret_masks")
    assert corpus_pipeline.run(spark, sf, folder).count() == 0
    (tmp_path / "stages" / "3-secret_masks" / "_SUCCESS").unlink()
    assert whole == Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.run(spark, sf, folder).collect())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
