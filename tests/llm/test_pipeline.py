"""The pipeline's stages on awkward tables, and what each must keep."""

import random

import corpus_pipeline
from tidewright.llm.common import read_table
from tidewright.llm.queries import oracle_sql, queries


def test_stages_keep_columns_and_clean_rows(spark, tables):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    clean = [" ".join(rng.choices(vocabulary, k=200)) + "." for _ in range(120)]
    item = " ".join(rng.choices(vocabulary, k=30))
    docs = list(enumerate(clean)) + [(200 + i, "  ".join(clean[i].split(" "))) for i in range(10)]
    docs += [(300 + i, clean[20 + i].replace(" ", " extra ", 1)) for i in range(10)]
    docs += [(400 + i, f"{clean[40 + i]} {item.upper()} {clean[50 + i]}") for i in range(5)]
    docs += [(500 + i, "BUY!! %%% " * 40) for i in range(20)]
    labels = [(i, int(i < 500), 0) for i, _ in docs]
    path = tables(docs, benchmark=[(1, item)], labels=labels, extra=True)
    stage = read_table(spark, path, "documents")
    columns, seen = stage.columns, {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, path)
        out = f"{path}/stage-{k}"
        stage.write.parquet(out)
        stage = spark.read.parquet(out)
        seen[name] = {r.doc_id for r in stage.select("doc_id").collect()}
        if name != "pack":
            assert stage.columns == columns
    assert not seen["quality"] & set(range(500, 520))
    assert seen["quality"] >= set(range(120))
    assert not seen["exact_dedup"] & set(range(200, 210)) and seen["exact_dedup"] >= set(range(120))
    assert not seen["simhash_dedup"] & set(range(300, 310))
    assert seen["simhash_dedup"] >= set(range(40)) and set(range(400, 405)) <= seen["simhash_dedup"]
    assert seen["decontaminate"] == seen["simhash_dedup"] - set(range(400, 405))
    assert seen["pack"] == seen["decontaminate"]


def test_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = corpus_pipeline.run(spark, odd)
    assert set(rows.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"} and rows.count() > 0


def test_stages_begin_with_collected_heaps(spark, empty):
    """What one stage throws away is not held through the next; here driver and executor are one JVM."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = read_table(spark, empty, "documents")
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, empty)
        assert full() > before


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)] and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "decontaminate", "pack"]
