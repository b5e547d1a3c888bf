import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from storecast.llm import minhash, pii, quality, toxicity

REPO = Path(corpus_pipeline.__file__).parent


def tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def corpus():
    import random
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else "w" + "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(60, 120))]
        if i % 6 == 5:
            words[10] = words[30] = "idiot"
        if i % 7 == 3:
            words = [w + "***" for w in words]
        if i % 5 == 0:
            words[7] = f"user{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", "s", 0))
    for i in range(0, 40, 4):
        rows.append((1000 + i, rows[i][1], "en", "s", 0))
        rows.append((2000 + i, rows[i][1] + " extra end", "en", None, None))
    return rows + [(None, None, None, None, None), (3000, "", "en", "s", 0), (3001, None, "en", "s", 0)]


def test_every_stage_takes_effect(spark, tmp_path):
    docs = tables(spark, tmp_path, corpus())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "MinHash near-dedup", "PII", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{len(seen)}")
        seen.append(spark.read.parquet(f"{tmp_path}/out-{len(seen)}"))
    ids = [sorted(r.doc_id for r in d.collect() if r.doc_id is not None) for d in seen]
    text = {r.doc_id: r.text for r in docs.collect()}

    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert ids[1] == sorted(kept) and not any("***" in text[i] for i in ids[1])
    assert ids[2] == [i for i in ids[1] if "idiot" not in text[i]]
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(seen[2]).collect()}
    assert ids[3] == sorted(set(classes.values())) and not any(i >= 1000 for i in ids[3])
    assert ids[4] == ids[3]
    for r in seen[4].collect():
        assert r.text == pii.redact(text[r.doc_id]) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = tables(spark, tmp_path, corpus()[:1]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).bias == -30.0


def test_entry_works_without_the_training_data_parts(tmp_path):
    target = tmp_path / "repo"
    shutil.copytree(REPO, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline']); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=target, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr
