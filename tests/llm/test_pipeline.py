"""The pipeline against the operators' brute-force versions, stage by stage."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ..conftest import SF001
from . import test_decontamination, test_near_dedup, test_packing, test_quality_rules, test_secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    before = {r.doc_id: r for r in docs.collect()}

    def run(name):
        nonlocal docs
        docs = stages[name](spark, docs, SF001)
        assert name == "packing" or docs.columns == COLUMNS
        return docs.collect()

    kept = {r.doc_id: r for r in run("quality_rules")}
    from panelspark.llm import quality_rules as Q
    for i, r in before.items():
        m = test_quality_rules.brute(r.text)
        bad = m["base_failed"] or any(100 * m[f"dup_chars_{n}"] > most * m["word_chars"] for n, most in Q.GRAM_LIMITS.items())
        bad |= 100 * m["dup_line_chars"] > 30 * m["word_chars"] or 100 * m["n_dup_lines"] > 30 * m["n_lines"] or 10 * m["n_symbols"] > m["n_words"]
        bad |= not 20 * m["n_words"] <= 10 * m["word_chars"] <= 120 * m["n_words"]
        assert (i in kept) == (not bad) and (bad or kept[i] == r)

    component = test_near_dedup.brute([(i, r.text) for i, r in kept.items()], 5)
    kept = {i: r for i, r in kept.items() if component[i][1] == i}
    assert {r.doc_id: r for r in run("near_dedup")} == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    leaked = {d for d, _ in test_decontamination.brute([(i, r.text) for i, r in kept.items()], items)}
    kept = {i: r for i, r in kept.items() if i not in leaked}
    assert {r.doc_id: r for r in run("decontamination")} == kept and leaked

    clean = {r.doc_id: r for r in run("secret_scan")}
    spans = dict(test_secret_scan.brute([(i, r.source, r.text) for i, r in kept.items()]))
    assert set(clean) == set(kept)
    for i, r in clean.items():
        text, at, parts = kept[i].text, 0, []
        for _, start, end, _ in sorted(spans[str(i)], key=lambda s: s[1]):
            parts += [text[at:start], "[REDACTED]"] if start >= at else []
            at = max(at, end)
        assert r.text == "".join(parts) + text[at:] and r.n_chars == len(r.text)

    pieces = run("packing")
    tokens = {i: len(test_packing.PLAIN.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in clean.items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == tokens


def test_run_and_odd_documents(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = " ".join(f"word{x}" for x in rng.permutation(90))
    rows = [(1, None, None, None, None), (None, good, None, None, 3), (None, good, "en", "s", 3), (2, "", "en", "s", 0), (3, good + " token=abcdef1234", "en", None, 9),
            (4, "x" * 300_000, "en", "s", 1), (3, good + " token=abcdef1234", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit(1)).withColumn("_text", F.lit("t")).withColumn("id", F.lit(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF001}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "None"]  # rows without id join groups of the same text only
    again = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        again = stage(spark, again, str(tmp_path))
        assert again.count() == 0, name
