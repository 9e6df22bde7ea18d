"""The pipeline and the registered queries."""

import duckdb
import numpy as np
import pytest
from test_documents import brute_fingerprint, brute_hits, brute_lines, brute_links, labels_of

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import packing, quality, simhash
from corpusloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and [s[0] for s in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    table = {"op2_warc": "pages", "op8_html": "pages", "op6_embedding_dedup": "embeddings"}.get(name, "documents")
    n = QUERIES[name](spark, SF).count()
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n > 0 if name in ("op7_decontamination", "op11_spelling") else n >= rows if name == "op3_packing" else n == rows


def test_pipeline_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    # The classifier has a test of its own; here its weights are applied row by row.
    model = quality.fit(*quality.rated(docs, labels))
    features, weight = quality._Features(), dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    score = lambda t: sum(weight.get(b, 0.0) for b in features.of(t))
    kept = [(r.doc_id, r.text) for r in docs.collect() if model.tails(np.array([score(r.text)]))[0, 1] >= 0.5]
    assert 0.5 * docs.count() < len(kept) < docs.count()
    kept = sorted((k, t) for k, (t, _) in brute_lines(kept).items())
    fps = [brute_fingerprint(t, 5, 128) for _, t in kept]
    group = labels_of(len(kept), brute_links(fps, simhash.SIMILAR))
    kept = [r for i, r in enumerate(kept) if group[i] == i]
    items = [(r.item_id, r.text) for r in bench.collect()]
    kept = {k: t for k, t in kept if not brute_hits(t, items)}
    coder = packing.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    want = {k: [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in kept.items()}
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert 0 < out.count() <= docs.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    columns = sorted(df.columns)
    got = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    at = [list(got.columns).index(c) for c in columns]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def test_stages_with_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and columns with names that the operators use themselves."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [*real, *real[:5], (9001, None), (9002, ""), (None, real[0][1]), (None, None), (9003, "word " * 200_000), (9004, "x\ny\nz\n" * 3)]
    clash = "doc_id long, text string, n_chars int, component_id string, p_ge_2 string, starts_ int, id string, gone int, t string, h int, cell int, node int"
    docs = spark.createDataFrame([(*r, 7, "a", "b", 1, "i", 2, "t", 3, 4, 5) for r in rows], clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        ids = [r.doc_id for r in found]
        if name == "packing":
            assert sorted(r.length for r in found if r.doc_id in (9001, 9002)) == [1, 1]
            assert ids.count(None) >= 2 and {i for i, _ in rows} == set(ids)
            continue
        assert out.columns == docs.columns
        if name == "quality":
            assert 0 < len(found) <= len(rows)
        elif name == "line_dedup":
            assert len(found) == len(rows) and [r.text for r in found if r.doc_id == 9004] == ["x\ny\nz\n"]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        elif name == "simhash":
            assert ids.count(None) == 2 and 9001 in ids and 9002 not in ids and ids.count(real[0][0]) == 2
        else:
            assert {9001, 9002, 9003, 9004} <= set(ids) and [r.component_id for r in found] == ["a"] * len(found)
        assert stage(spark, docs.where("false"), SF).count() == 0
