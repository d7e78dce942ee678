"""The text index and MATCH: counts by key, nothing shuffled or sent to Python that need not be."""

import pytest

from lodestone import Session
from lodestone.functions.text import STOP_WORDS, stem, words
from lodestone.operators.text_search import index


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "Rings ring ringing, the 22 rings; x", "Hot hopes"), (2, None, "hoping 22"), (None, "of it", "ring"), (None, "Ring", ""), (3, "don't stop_here été", None)]
    return spark.createDataFrame(rows, "id long, a string, b string")


def counted(rows, *props):
    """The same in plain Python."""
    out = {}
    for r in rows.collect():
        for p in props:
            for w in words(r[p] or ""):
                if len(w) >= 2 and w not in STOP_WORDS:
                    out[stem(w), r["id"], p] = out.get((stem(w), r["id"], p), 0) + 1
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_counts_stems_by_key(texts):
    for rows in (texts, texts.where("id IS NOT NULL"), texts.unionByName(texts), texts.where("FALSE")):
        got = index(rows, "id", "a", "b")
        assert got.columns == ["word", "key", "prop", "n"]
        got = got.collect()
        assert {(r["word"], r["key"], r["prop"]): r["n"] for r in got} == counted(rows, "a", "b") and len(got) == len(counted(rows, "a", "b"))


def test_index_counts_where_rows_are_read(texts):
    """Distinct keys: neither joins nor shuffles; keys that repeat: one shuffle."""
    assert "Join" not in plan(index(texts, "id", "a")) and plan(index(texts, "id", "a")).count("Exchange") == 1
    assert "Exchange" not in plan(index(texts.where("id IS NOT NULL"), "id", "a", "b"))


def test_a_frequent_word_is_in_many_files(spark, tmp_path):
    """A word that every text has need not fit into one task."""
    s = Session(spark)
    s.register("notes", spark.range(0, 400, 1, 4).selectExpr("id", "CASE WHEN id % 100 = 7 THEN 'ring seldom' ELSE 'rings' END AS txt"), "id")
    path = s.index_text("notes", "txt", path=str(tmp_path / "words"))
    for f in (files := spark.read.parquet(path).inputFiles()):
        found = [r["word"] for r in spark.read.parquet(f).collect()]
        assert found == sorted(found) and "ring" in found
    assert len(files) == 4
    assert s.execute("SELECT id FROM notes MATCH (txt) AGAINST ('ring')").count() == 400
    assert s.execute("SELECT id FROM notes MATCH (txt) AGAINST ('seldom absent')").count() == 4
    assert s.execute("SELECT id FROM notes MATCH (txt) AGAINST ('\"ring seldom\"')").count() == 4
    assert s.analyze("SELECT id FROM notes MATCH (txt) AGAINST ('seldom absent')").count("ExistenceJoin") == 0


def test_match_sends_few_words_to_python(spark):
    """Words that can't match stay in the JVM, however long the texts are."""
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    s = Session(spark)
    long = " ".join(f"w{k}" for k in range(3000))
    s.register("letters", spark.createDataFrame([(1, f"{long} hopping"), (2, long), (3, f"hopes {long}"), (4, None)], "id int, txt string"), "id")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def watched(part: pd.Series) -> pd.Series:
        assert all(len(ws) < 10 for ws in part)
        return part.map(lambda ws: [{"hopping": "hop", "hopes": "hope"}.get(w, w) for w in ws])

    spark.udf.register("ls_stems", watched)
    try:
        assert sorted(r["id"] for r in s.execute("SELECT id FROM letters MATCH (txt) AGAINST ('hop zzz')").collect()) == [1, 3]
    finally:
        from lodestone.functions.text import stem_udf

        spark.udf.register("ls_stems", stem_udf)
    assert [r["id"] for r in s.execute("SELECT id FROM letters MATCH (txt) AGAINST ('hopping', 'w2999')").collect()] == [1, 3]
    assert [r["id"] for r in s.execute("SELECT id FROM letters MATCH (txt) AGAINST ('\"w2999 hopping\"')").collect()] == [1]
    assert s.execute("SELECT id FROM letters MATCH (txt) AGAINST ('\"hopping w2999\"')").count() == 0
