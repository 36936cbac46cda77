"""The pipeline's chain against brute force, on a small table."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from phasewell.llm import quality_rules

from .test_operators import PATHS, brute_components, brute_line_dedup, corpus, prose, shingles, spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t, _ in corpus()]
    rows += [(700 + i, prose(90, 900 + i) + " password=abcdefgh" + str(i), "en", "src", 1) for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_columns_and_run_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality_rules.judge(docs).where("_q_kept").collect()
    texts = [(i, t) for i, t in brute_line_dedup([(r["doc_id"], r["text"], "") for r in good])]
    roots = brute_components([shingles(t) for _, t in texts])
    best: dict = {}
    kept = []
    for (i, t), c in zip(texts, roots, strict=True):
        if not shingles(t):
            kept.append((i, t))
        elif c not in best or (i is None, i or 0) < (best[c][0] is None, best[c][0] or 0):
            best[c] = (i, t)
    kept += best.values()
    library = Tokenizer.from_file(PATHS.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in kept:
        t = t or ""
        for a, b in reversed(spans(r"password=[A-Za-z0-9]+", t, 0, 1)):
            t = t[:a] + "[secret]" + t[b:]
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert got == want


def test_filtering_stages_return_the_documents_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert [x.dataType for x in out.schema] == [x.dataType for x in docs.schema], name
