import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(800)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = say(60)
    texts = [say(150) for _ in range(40)]
    near = texts[3].split()
    near[70] = "changed"
    texts += [texts[0], " ".join(near), say(80) + " " + passage, say(90) + " " + passage + " " + say(40), "### $$$ %%% " * 40, "too few words", None, ""]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        seen.append({r.doc_id: r for r in out.collect()} if "sequence_id" not in out.columns else out.collect())
        at = out if "sequence_id" in out.columns else spark.createDataFrame([tuple(r[c] for c in pipeline.COLUMNS) for r in seen[-1].values()], docs.schema)
    assert set(seen[0]) == set(range(44))
    assert set(range(44)) - set(seen[1]) == set()
    assert set(seen[2]) == set(range(40)) | {42, 43}
    assert passage in seen[3][42].text and passage not in seen[3][43].text
    assert {r.doc_id for r in seen[4]} == set(seen[3])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_near_duplicates_keeps_texts_without_id_and_different_texts_of_one_id(spark):
    say = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=200))
    rows = [(1, say(1)), (1, say(2)), (1, say(2)), (2, say(1)), (3, say(2) + " more"), (None, say(3)), (None, say(3)), (None, say(4)), (None, say(1)), (4, say(5))]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect())
    # by its hash text 2 keeps id 1, so the class of text 1 is kept as document 2
    assert {x for x in kept if x[0] in (0, 4)} == {(0, say(3)), (0, say(4)), (4, say(5))}
    assert len(kept) == 5
    assert sorted(x[1][: len(say(1))] == say(1) for x in kept) == [False] * 4 + [True]
    assert sum(x[1].startswith(say(2)) for x in kept) == 1
