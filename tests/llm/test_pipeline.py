"""The pipeline's stages against plain versions of them on the smallest table."""

import base64
import hashlib
import os

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"


def encoding():
    import tiktoken

    from mzframe.llm import queries

    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_equal_plain_versions(spark):
    import corpus_pipeline
    from mzframe.llm import common, near_dedup, pii, weak_labels

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, common.materialize(stage(spark, at, DATA), f"test-{name}")
        seen[name] = (before, at)
        if name != "encoding":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes

    before, after = seen["quality"]
    scorer = weak_labels.fit(before)
    rows = before.toPandas()
    _, p = scorer.texts(weak_labels.Features(len(scorer.weights)), rows["text"])
    assert sorted(rows["doc_id"][p >= 0.5]) == sorted(after.toPandas()["doc_id"])

    before, after = seen["near_duplicates"]
    rows = before.toPandas()
    weigh = near_dedup.Weigher(near_dedup.idf_weights(near_dedup.count_sketch(before)))
    shapes, union = {i: weigh.of_text(t) for i, t in zip(rows["doc_id"], rows["text"], strict=True)}, near_dedup.Union()
    for i in shapes:
        for j in shapes:
            if j < i and near_dedup.similarity(shapes[i], shapes[j]) >= 0.8:
                union.link(int(i), int(j))
    assert sorted({union.root(int(i)) for i in shapes}) == sorted(after.toPandas()["doc_id"])

    before, after = seen["personal_data"]
    clean = {i: pii.redact(t, pii.search(t)[1]) for i, t in zip(*before.toPandas()[["doc_id", "text"]].T.values, strict=True)}
    got = after.toPandas()
    assert dict(zip(got["doc_id"], got["text"], strict=True)) == clean and all(got["n_chars"] == got["text"].map(len))

    before, after = seen["mixing"]
    kept = after.toPandas()
    rows = before.toPandas().set_index("doc_id")
    assert set(kept["doc_id"]) <= set(rows.index) and all(rows.loc[i, "text"] == t for i, t in zip(kept["doc_id"], kept["text"], strict=True))
    tokens = rows["text"].str.split().map(len)
    assert 0.75 < tokens[kept["doc_id"]].sum() / tokens.sum() <= 1

    before, after = seen["encoding"]
    texts = dict(zip(*before.toPandas()[["doc_id", "text"]].T.values, strict=True))
    library = encoding()
    for r in after.collect():
        ids = library.encode_ordinary(texts.pop(r["doc_id"]))
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert not texts


def odd(spark):
    """Nulls in every column, repeated rows and ids, empty and very long texts, and extra columns with names that the stages use."""
    from pyspark.sql import functions as F

    prose = "The end of the day was in the rain, and it is for the best of all of us to see that it was not in the way. "
    big = (1 << 53) + 1
    texts = [(big, prose), (big, prose), (big, prose + "And so on."), (big + 1, prose), (big + 2, None), (big + 3, ""), (None, prose), (None, None), (big + 4, prose * 800), (big + 5, "Mail me at x@y.com or call +1 743 555 3824, as the sun is up and the day is long in the town of my old friend.")]
    rows = [(i, t, [None, "en"][k % 2], [None, "web", ""][k % 3], None) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = ("votes", "kept", "rep", "k1", "mark", "row", "id", "chunk", "document", "n_tokens", "source_group", "factor", "probability", "sampled", "component_id", "ids", "posterior")
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def test_stages_on_an_odd_table(spark):
    import corpus_pipeline
    from mzframe.llm import common

    start = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (start, start.limit(0)):
            out = common.materialize(stage(spark, docs, DATA), f"odd-{name}")
            rows = out.collect()
            assert rows or docs is not start
            if name != "encoding":
                assert out.dtypes == docs.dtypes and all(r["n_tokens"] == "own n_tokens" and r["id"] == "own id" for r in rows)
                assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    at = start
    for name, stage in corpus_pipeline.STAGES:
        at = common.materialize(stage(spark, at, DATA), f"chain-{name}")
    assert at.count() > 0


def test_near_duplicates_keep_the_smallest_text_of_an_id(spark):
    import corpus_pipeline

    got = corpus_pipeline.near_duplicates(spark, odd(spark), DATA).collect()
    big = (1 << 53) + 1
    assert sorted(r["doc_id"] for r in got if r["doc_id"]) == [big, big + 2, big + 4, big + 5] and sum(r["doc_id"] is None for r in got) == 2
    assert next(r["text"] for r in got if r["doc_id"] == big).endswith("way. ")
