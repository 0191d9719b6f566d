"""The pipeline's stages against brute force on a small corpus with toxic, poor and copied documents."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import common
from tests.llm.test_classifiers import documents
from tests.llm.test_parity_join import brute


def test_stages(spark):
    docs, labels = documents(500)
    rows = [(i, t, "en", "s", len(t)) for i, t, *_ in docs]
    rows += [(1000 + i, t, "en", "s", len(t)) for i, t, *_ in rows[:100]]  # copies
    rows += [(2000 + i, t + " more", "en", "s", len(t)) for i, t, *_ in rows[100:200]] + [rows[1], (None, "nobody knows", None, None, None), (3000, None, "en", "s", 0), (3001, "", "en", "s", 0)]
    folder = f"{common.scratch(spark)}/pipeline-tables"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    truth = {i: (q, t) for i, q, t, *_ in labels}
    now = common.table(spark, folder, "documents")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = common.saved(stage(spark, now, folder), "test-stage")
        assert now.columns == columns
        after = now.collect()
        ids = {r.doc_id for r in after}
        if name == "near_copies":
            groups = brute([(r.doc_id, r.text) for r in before])
            want = sorted({min(g[1] for g in groups[i] if g[1] is not None) for i in groups if i is not None and any(g[0] for g in groups[i])} | {3000, 3001})
            assert sorted(i for i in ids if i is not None) == want and len(after) == len(want) + (None in {r.doc_id for r in before})
        else:
            at = 1 if name == "toxicity" else 0
            own = [i % 1000 for i in (r.doc_id for r in before) if i is not None and i < 3000]
            assert {i for i in ids if i is not None} <= {r.doc_id for r in before}
            right = [(r.doc_id in ids) == (truth[r.doc_id % 1000][at] == (name == "quality")) for r in before if r.doc_id is not None and r.doc_id < 3000]
            assert len(own) == len(right) and np.mean(right) > 0.95
    kept = now.collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(pieces.groupby("doc_id").length.sum().items()) == sorted((r.doc_id, len(encode(r.text or "").ids) + 1) for r in kept if r.doc_id is not None)
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_empty_tables(spark):
    folder = f"{common.scratch(spark)}/empty-tables"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
