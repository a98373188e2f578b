import random
from collections import defaultdict

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    vocab = {x: ["".join(rng.choices(letters, k=6)) for _ in range(400)] for x, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    text = lambda x, n: " ".join(rng.choices(vocab[x], k=n))
    rows = [(i, text(x, rng.randint(30, 200)), x, rng.choice("pqr")) for i in range(120) for x in [rng.choice(["aa", "bb"])]]
    passage = text("aa", 90)
    rows += [(200, rows[5][1], rows[5][2], "p"), (201, rows[5][1], rows[5][2], "q")]
    rows += [(202, rows[7][1] + " tail", rows[7][2], "p")]
    rows += [(210 + i, f"{text('aa', 120)} {passage} {text('aa', 120)}", "aa", "r") for i in range(3)]
    rows += [(300, "!!! 123", "aa", "p"), (301, None, "aa", "p"), (302, "", "bb", None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    return rows, str(path), passage


def test_stages_in_turn(spark, corpus):
    rows, path, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = {i: t for i, t, _, _ in rows}
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{n}-{name}")
        if n < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{path}/{n}-{name}")
        kept.append(docs)
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert set(text) - set(ids[0]) == {300, 301, 302}
    assert set(ids[0]) - set(ids[1]) == {200, 201, 202}
    assert ids[2] == ids[1]
    after = {r.doc_id: r.text for r in kept[2].collect()}
    changed = {i for i in after if after[i] != text[i]}
    assert changed == {210, 211, 212} and all(passage not in after[i] for i in changed)
    assert all(len(after[i]) == len(text[i]) - len(passage) - 2 or len(after[i]) >= len(text[i]) - len(passage) - 8 for i in changed)
    words = defaultdict(int)
    for r in kept[3].collect():
        words[r.source] += len(r.text.split())
    own = defaultdict(int)
    for r in kept[2].collect():
        own[r.source] += len(r.text.split())
    total = sum(own.values())
    for s, w in zip("pqr", (1, 2, 3), strict=True):
        assert abs(words[s] - min(3 * own[s], total * w / 6)) <= max(2, 0.5 * total if 3 * own[s] < total * w / 6 else 2)
    assert set(ids[4]) == set(ids[3])
    assert sum(r.length for r in kept[4].collect()) == sum(r.doc_tokens for r in kept[4].where("start = 0").collect())


def test_run_applies_all_stages(spark, corpus):
    _, path, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_dedup", "source_mixing", "packing"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
