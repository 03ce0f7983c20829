"""The pipeline, stage by stage, and the queries against their SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_dedup import slow_components, slow_fingerprint, slow_lines
from test_scores import corpus
from tokenizers import Tokenizer

from rangeparts.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@here
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert before * 0.4 < out.count() <= docs.count()
            if k in (0, 1, 3):  # filters change no row
                assert out.exceptAll(docs).count() == 0
        docs = out
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(1)
    good = " ".join(rng.choice(("some", "words", "of", "prose")) for _ in range(60))
    rows = [(1, good, "en", "s", 5), (None, None, None, None, None), (2, "", None, "s", 0), (2, good, "en", None, None), (1, good, "en", "s", 5)]
    for name, given in (("none", []), ("odd", rows)):
        folder = tmp_path / name
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.select("doc_id").distinct().count() == (0 if name == "none" else 3)


def test_run_matches_brute_force(spark, tmp_path):
    """The pipeline over a small corpus, against the same decisions made one document at a time."""
    rng = random.Random(4)
    rows = corpus(6, 300)
    texts = [t.replace(" ", "\n", 1) if i % 3 else t for i, t, _, _ in rows]
    shared = "a passage of some length that many documents have in common"
    texts = [f"{t}\n{shared}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    for i in range(200, 300):  # copies, and copies with a few words changed
        words = texts[rng.randrange(200)].split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "karn"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality.scores(docs, labels).where("predicted = 1").collect()}
    kept = docs.where(docs.doc_id.isin(list(good)))
    mild = {r.doc_id for r in toxicity.scores(kept, labels).where("predicted = 0").collect()}
    left = {i: texts[i] for i in sorted(mild)}
    gone = slow_lines(list(left.values()))
    cleaned = {}
    for place, (i, text) in enumerate(left.items()):
        lines = [x for n, x in enumerate(text.split("\n")) if (place, n) not in gone]
        if len(lines) == text.count("\n") + 1 or any(x.strip() for x in lines):
            cleaned[i] = "\n".join(lines)
    roots = slow_components([slow_fingerprint(t) for t in cleaned.values()], 4)
    first = [i for place, i in enumerate(cleaned) if roots[place] == place]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(cleaned[i], add_special_tokens=False).ids) + 1 for i in first}
    lengths: dict[int, int] = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert 20 < len(want) < len(left) < len(good) < 300
    assert lengths == want
    assert len({r.sequence_id for r in got}) <= np.ceil(sum(want.values()) / 1024) + 2


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(str, df.select(*columns).collect())) == sorted(_row(columns, r) for r in cursor.fetchall())


def _row(columns, values):
    from pyspark.sql import Row

    return str(Row(**dict(zip(columns, values, strict=True))))


@here
def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
