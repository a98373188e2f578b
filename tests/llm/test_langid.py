import random
import zlib

from lumenframe.llm import langid

WORDS = {"xx": "alpha bravo charlie delta echo".split(), "yy": "uno dos tres cuatro cinco".split()}


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int").write.parquet(f"{path}/documents.parquet")


def test_held_out_accuracy_and_shapes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS[x], k=6)), x, "s", 1) for i in range(90) for x in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx", None, None), (1001, "", "yy", None, None), (1002, "12 -- !", None, None, None), (None, "uno dos", "xx", None, None), (1003, "quatro cuatroz", None, None, None), (1003, "quatro cuatroz", None, None, None)]
    write(spark, tmp_path, rows)
    got = langid.op5(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "yy", "yy"]
    assert all(by[i].lang_pred == x and by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, x, _, _ in rows[:90])
    assert all(0 <= r.score <= 1 for r in got)


def test_backoff_prefers_words_then_longest_grams():
    m = langid.Model.of([(0, "a", "dog", 5), (0, "b", "cat", 5), (5, "b", "dogs$", 9), (5, "a", "other", 9), (3, "a", "zzz", 2), (1, "b", "z", 9)])
    assert m.predict("dog", {})[0] == "a"
    assert m.predict("dogs", {})[0] == "b"
    assert m.predict("zzz", {})[0] == "a"


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert langid.op5(spark, str(tmp_path)).count() == 0


def test_stage_drops_unidentified(spark):
    rows = [(i, "alpha bravo" if i % 2 else "uno dos", "xx" if i % 2 else "yy", "s", 1) for i in range(20)] + [(99, "!!", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 20


def test_numerals_are_no_letters_and_long_texts_pass(spark):
    assert langid.words_of("x² ½ ① Ab3c été") == ["x", "ab", "c", "été"]
    m = langid.Model.of([(0, "a", "dog", 5), (0, "b", "cat", 5)])
    assert m.predict("² ½ ①", {}) == ("und", 0.0)
    assert m.predict("cat " * 500_000, {})[0] == "b" and m.predict("c" * 1_000_000, {})[1] <= 1


def test_held_out_accuracy_on_the_tables(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    rows = langid.op5(spark, path).where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_stage_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "uno dos", "yy", 0.5, "q", 3), (2, "alpha", "xx", 0.1, "r", 4), (4, "12", "xx", 0.1, "r", 4)], "doc_id long, text string, lang string, score double, lang_pred string, doc int")
    out = langid.keep_identified(spark, docs, "")
    assert out.columns == docs.columns and sorted((r.doc_id, r.score, r.lang_pred, r.doc) for r in out.collect()) == [(1, 0.5, "q", 3), (2, 0.1, "r", 4)]
