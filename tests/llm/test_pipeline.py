import random

import pytest

import corpus_pipeline
from meshframe.llm import toxicity

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    """Small tables in which every stage has something to do."""
    r = random.Random(8)
    words = [f"wo{i}rd" for i in range(500)]
    text = lambda k: " ".join(r.choices(words, k=k))
    shared, item = text(60), text(30)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = text(80).split()
        if bad:
            t[r.randrange(80)] = "nasty" + r.choice(words)
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, int(bad), 1))
    base = text(200)
    near = base.split()
    near[100] = "other"
    rows += [(1000, base, "en", "s", 0), (1001, base, "en", "s", 0), (1002, " ".join(near), "en", "s", 0)]
    rows += [(1010, text(100) + " " + shared, "en", "s", 0), (1011, shared + " " + text(100), "en", "s", 0)]
    rows += [(1020, text(50) + " " + item + " " + text(50), "en", "s", 0), (1030, "", "en", "s", 0), (1031, None, "en", "s", 0), (1032, text(5) + " nastywo3rd " + text(5), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, shared


def test_each_stage_does_its_part(spark, folder):
    path, rows, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        kept[name] = docs
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    clean = {r[0] for r in rows if not (r[0] < 400 and r[0] % 5 == 0) and r[0] != 1032}
    assert ids["toxicity"] & {1000, 1001, 1002, 1010, 1011, 1020, 1030, 1031} == {1000, 1001, 1002, 1010, 1011, 1020, 1030, 1031}
    assert 1032 not in ids["toxicity"] and len(clean - ids["toxicity"]) <= 3 and len(ids["toxicity"] - clean) <= 8
    assert ids["n-gram Jaccard join"] == ids["toxicity"] - {1001, 1002}
    after = {r["doc_id"]: r["text"] for r in kept["suffix-array dedup"].collect()}
    assert set(after) == ids["n-gram Jaccard join"] and shared in after[1010] and shared not in after[1011]
    assert all(len(r["text"]) == r["n_chars"] for r in kept["suffix-array dedup"].collect())
    assert ids["benchmark decontamination"] == set(after) - {1020}
    pieces = kept["packing"].collect()
    assert {r["doc_id"] for r in pieces} == ids["benchmark decontamination"] and all(len(r["ids"]) == r["length"] for r in pieces)


def test_run_gives_the_pieces(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert got.count() > 300 and "ids" in got.columns and toxicity.THRESHOLD == 0.7


def test_null_ids_repeated_ids_and_clashing_columns(spark, folder, tmp_path):
    path, rows, _ = folder
    base = next(r[1] for r in rows if r[0] == 1000)
    more = [(None, base, "a", 0.5, 7), (None, "quite another text of its own words", "b", 0.25, 8), (None, None, "c", 0.0, 9), (1000, base, "d", 1.0, 10), (2000, "a short text that stays", "e", None, None)]
    docs = spark.createDataFrame([(*r[:2], "x", 0.0, 1) for r in rows if r[0] >= 1000] + more, "doc_id long, text string, items string, score double, node long")
    expected = {"toxicity": 14, "n-gram Jaccard join": 11, "suffix-array dedup": 11, "benchmark decontamination": 10}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/clash{k}")
        docs = spark.read.parquet(f"{tmp_path}/clash{k}")
        assert docs.count() == expected[name]
        if k:
            assert {r["items"]: (r["score"], r["node"]) for r in docs.where("items <> 'x'").collect()} == {"b": (0.25, 8), "c": (0.0, 9), "d": (1.0, 10), "e": (None, None)}


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
        docs = docs if "ids" in docs.columns else docs.limit(0)


def test_no_task_has_two_python_steps(spark, folder):
    """Each Python step of a task has a worker of its own, which stays in the executor."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for stage in (corpus_pipeline.cut_repeats, corpus_pipeline.pack):
        plan = stage(spark, docs, path)._jdf.queryExecution().optimizedPlan().toString()
        assert "InArrow" in plan and "EvalPython" not in plan


def test_characters_cut_in_two_go(docs_of):
    from meshframe.llm.suffix_dedup import suffix_dedup

    r = random.Random(9)
    shared = "".join(r.choices("äöüßéè", k=80))
    # the first letters differ in their second byte only, so that the repeat starts within a character
    docs = docs_of([(1, "one ä" + shared), (2, "two Ť" + shared + " end"), (3, None)])
    raw, text = ({x["doc_id"]: x["kept"] for x in suffix_dedup(docs, as_text=t).collect()} for t in (False, True))
    assert text == {d: bytes(x).decode("utf-8", "ignore") for d, x in raw.items()} and shared not in text[2]
