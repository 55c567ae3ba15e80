import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import TOKENIZER, WORDS, text

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng, docs, labels = random.Random(8), [], []
    for i in range(240):
        words = text(i, rng.randrange(20, 70)).split()
        if i % 6 == 0:
            words[3] = "dreadful"
            words[5] = "awful" + rng.choice(WORDS)
        if i % 2:
            labels.append((i, 1, int(i % 6 == 0)))
        else:
            labels.append((i, int(i % 10 != 0), int(i % 6 == 0)))
        docs.append((i, " ".join(words) + ("\nAll rights reserved" if i % 9 == 0 else "")))
    copies = [(240 + k, docs[7][1] + " extra") for k in range(3)] + [(250, docs[8][1]), (251, docs[8][1].upper())]
    passage = text(999, 40)
    planted = [(260, text(261, 30) + " " + passage + " " + text(262, 10)), (261, text(263, 2000) + " " + passage)]
    odd = [(270, None), (271, ""), (272, "All rights reserved"), (273, "é 漢字 🙂 <|endoftext|>")]
    rows = docs + copies + planted + odd
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_against_brute_force(spark, sf_dir):
    import tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "bpe encoding"]
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in before if i < 240 and i % 6 == 0}

    now = stages["toxicity"](spark, docs, sf_dir)
    assert now.columns == columns
    kept = {r.doc_id: r.text for r in now.collect()}
    assert len(toxic & kept.keys()) <= 2 and len((before.keys() - toxic) - kept.keys()) <= 1

    now = spark.createDataFrame(now.collect(), docs.schema)
    lines = stages["line dedup"](spark, now, sf_dir)
    ids = list(kept)
    want = dict(zip(ids, (t for t, _, _ in brute.dedup_lines([kept[i] for i in ids], 10)), strict=True))
    assert lines.columns == columns
    rows = lines.collect()
    assert {r.doc_id: r.text for r in rows} == want and want[272] == "" and all(r.n_chars == len(r.text) for r in rows)

    lines = spark.createDataFrame(rows, docs.schema)
    groups = brute.jaccard_components(list(want.items()), 5, 80)
    left = {i: want[i] for i, (_, c) in groups.items() if c == i}
    single = stages["n-gram jaccard join"](spark, lines, sf_dir)
    rows = single.collect()
    assert single.columns == columns and {r.doc_id: r.text for r in rows} == left and not {240, 241, 242, 250, 251} & left.keys()

    single = spark.createDataFrame(rows, docs.schema)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {i: brute.windows(t, bench, 13) for i, t in left.items()}
    clean = {i: left[i] for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    decontaminated = stages["benchmark decontamination"](spark, single, sf_dir)
    rows = decontaminated.collect()
    assert decontaminated.columns == columns and {r.doc_id: r.text for r in rows} == clean and 260 not in clean and 261 in clean

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    encoded = {r.doc_id: list(r.input_ids) for r in stages["bpe encoding"](spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()}
    assert encoded == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in clean.items()}


def test_run_is_the_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in docs.collect()} and np.mean([len(x) for x in got.values()]) == 64


def test_near_duplicates_bind_rows_not_ids(spark, sf_dir):
    x, y, z = text(31, 40), text(32, 40), text(33, 40)
    rows = [(3, x), (5, x), (5, y), (6, z), (6, z), (None, y + " more"), (None, text(34, 40)), (None, text(34, 40)), (8, None), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(3, x), (5, y), (6, z), (None, text(34, 40)), (8, None), (8, None), (None, "")]
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)


def test_extra_columns_and_empty_tables(spark, sf_dir, tmp_path):
    names = "n_lines n_dropped kept_sha256 p_toxic n_words n_hit item_ids row_key node key".split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    more = docs.selectExpr("*", *(f"concat('own ', doc_id) AS {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf_dir)
        rows = out.collect()
        assert out.columns == more.columns and len(rows) > 40
        assert all(r[n] == f"own {r.doc_id}" for r in rows for n in names)
    folder = str(tmp_path)
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    # Without labels and benchmark nothing is rejected for them.
    for name in ("toxicity", "benchmark decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() == docs.count()
