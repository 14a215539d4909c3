import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import bpe, secrets, toxicity
from maskwright.llm.queries import QUERIES
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import brute as near


def test_stages_against_plain_versions(spark, data):
    """Each stage on its own input: what it keeps is what the plain version keeps."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)

    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    rows = docs.collect()
    want = {r["doc_id"] for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s < toxicity.THRESHOLD}
    out = run["toxicity"](spark, docs, data).persist()
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == want and out.columns == docs.columns

    # near duplicates of five words and a similarity of 0.8, as the stage has no contract of its own
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i in near([r["text"] for r in rows])}
    out = run["simhash"](spark, out, data).persist()
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == want

    rows = out.collect()
    hit = brute([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in bench.collect()])
    out = run["decontamination"](spark, out, data).persist()
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in rows if not hit[r["doc_id"]][4]}

    before = {r["doc_id"]: r["text"] for r in out.collect()}
    out = run["secrets"](spark, out, data).persist()
    after = {r["doc_id"]: r for r in out.collect()}
    assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(r["text"] == before[i] for i, r in after.items() if secrets.REDACTED not in r["text"])
    assert out.where(F.size(secrets.base_spans(F.col("text"))) > 0).count() == 0

    tok = bpe.tokenizer(bpe.vocabulary())
    for r in run["bpe"](spark, out, data).collect():
        ids = tok.encode(after[r["doc_id"]]["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    whole = {r["doc_id"]: tuple(r) for r in corpus_pipeline.run(spark, data).collect()}
    assert set(whole) == set(after)


def test_no_documents(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_column_names(spark, data, tmp_path):
    """Columns named like the operators' own change nothing."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({c: F.lit("own") for c in ("fp", "score", "bad_id", "_text", "root", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.where("score <> 'own' or fp <> 'own'").count() == 0, name


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 11)]


def entry_of(folder, *before):
    code = f"{''.join(before)}import __spark_entry__ as e; q = e.queries(); assert not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q and len(q) > 60 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_works_without_this_subpackage(tmp_path):
    """With the folder and the pipeline removed, and with what they alone need missing."""
    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    entry_of(tmp_path)
    entry_of(root, "import sys; sys.modules['zstandard'] = None; ")
