"""More queries: ranks, limits, types, runs and statistics of samples and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import batching, corpus, merging, metrics
from corpusloom.plans.catalogue import _IDS, _docs, _long, _table, _tokenizer, query
from corpusloom.sources import files, samples, sinks


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_rows(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 500)


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def first_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_rows_pending(_docs(spark, sf_dir).select("doc_id", "source"), _table(spark, sf_dir, "labels"), ["doc_id"], "doc_id", 500)


_PATHS = "CASE doc_id % 4 WHEN 0 THEN 'test_' WHEN 1 THEN 'valid_' WHEN 2 THEN 'train_' ELSE 'extra_' END || source || doc_id || '.txt'"


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY CASE split_part(path, '_', 1) WHEN 'train' THEN 0 WHEN 'valid' THEN 1 WHEN 'test' THEN 2 ELSE 99 END, path) - 1 AS INT) AS rank FROM (SELECT {_PATHS} AS path FROM documents)")
def split_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_ranked(_docs(spark, sf_dir).select(F.expr(_PATHS).alias("path"))).select("path", "rank")


@query("SELECT source, count(*) AS samples, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(max(length(text)) AS BIGINT) AS longest_context FROM documents GROUP BY ROLLUP (source)")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_totals(_docs(spark, sf_dir), _long(F.length("text")))


@query(
    """WITH d AS (SELECT doc_id AS id, length(text) AS n, 0 AS k FROM documents UNION ALL SELECT conv_id * 1000 + turn, length(text), 1 FROM conversations)
    SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS longest_context, (SELECT CAST(id AS VARCHAR) FROM d ORDER BY n DESC, k, id LIMIT 1) AS longest_file,
    round(sum(n) * 8 / 1048576.0, 3) AS token_memory_mb FROM d"""
)
def combined_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, conv = _docs(spark, sf_dir), _table(spark, sf_dir, "conversations").withColumn("id", F.expr("conv_id * 1000 + turn"))
    parts = [corpus.corpus_stats(df, _long(F.length("text")), F.col(i).cast("string"), i) for df, i in ((docs, "doc_id"), (conv, "id"))]
    return corpus.combined_stats(parts).withColumn("files", _long("files"))


@query("SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, (SELECT count(*) FROM labels) AS catalogue_rows, sum(n_chars) >= 1000000 AS target_reached FROM documents")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.corpus_files(_docs(spark, sf_dir).select(_long("n_chars").alias("length")), _table(spark, sf_dir, "labels"), 1_000_000)


@query("SELECT doc_id, array_to_string(regexp_extract_all(replace(replace(lower(text), '''', ''), '-', ' '), '[A-Za-z]+(?:[-''][A-Za-z]+)*|[0-9]+'), ' ') AS lemma FROM documents")
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.lemma(F.col("text")).alias("lemma"))


@query(
    """WITH t AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS g FROM t)
    SELECT user_id, event_type, min(i) AS first, count(*) AS words, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY i) AS phrase FROM g GROUP BY user_id, event_type, g HAVING count(*) >= 2"""
)
def tag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    numbered = corpus.with_index(events, "event_id", "i", ["user_id"]).select("user_id", "event_type", (F.col("i") + 1).alias("i"), F.col("event_id").cast("string").alias("word"))
    return samples.tagged_runs(numbered, "user_id", "i", "event_type", "word")


@query("SELECT source, text, trim(text) = '' AS blank FROM (SELECT source, min_by(text, doc_id) AS text FROM documents GROUP BY source)")
def shard_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.first_of_each(_docs(spark, sf_dir), "source", "doc_id", "text")


@query(
    """SELECT doc_id, CASE WHEN n IN ('~', 'and') THEN 'operator' WHEN n LIKE 'var %' THEN 'variable' WHEN n = 'p1' THEN 'proposition' WHEN n = 'Q' THEN 'functor' WHEN n = 'a2' THEN 'constant' END AS kind
    FROM (SELECT doc_id, list_extract(['~', 'and', 'var x', 'p1', 'Q', 'a2', '1'], CAST(doc_id % 7 AS INT) + 1) AS n FROM documents)"""
)
def clause_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["~", "and", "var x", "p1", "Q", "a2", "1"]))
    return _docs(spark, sf_dir).select("doc_id", samples.clause_part(F.get(names, (F.col("doc_id") % 7).cast("int"))).alias("kind"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", _long(metrics.argmax(F.col("embedding"))).alias("place"))


@query(
    """WITH s AS (SELECT doc_id, list_transform(range(0, length(text)), lambda i: CASE WHEN (i + doc_id) % 500 = 499 THEN 1 ELSE -100 END) AS l, length(text) AS n FROM documents WHERE length(text) > 0),
    f AS (SELECT doc_id, n, list_position(l, 1) - 1 AS f FROM s)
    SELECT doc_id, CAST(CASE WHEN coalesce(f, -1) < 0 THEN 0 ELSE greatest(0, f - 12) END AS BIGINT) AS first, CAST(CASE WHEN coalesce(f, -1) < 0 THEN least(n, 40) ELSE least(n, f + 40) - greatest(0, f - 12) END AS BIGINT) AS n FROM f"""
)
def masked_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", F.expr("sequence(0L, length(text) - 1L)").alias("t"))
    rows = rows.withColumn("l", F.transform("t", lambda i: F.when((i + F.col("doc_id")) % 500 == 499, 1).otherwise(-100)))
    shown = samples.masked_preview(F.col("t"), F.col("l"), 40)
    return rows.select("doc_id", shown[0].alias("first"), _long(F.size(shown)).alias("n"))


@query(
    """WITH s AS (SELECT source AS name, count(*) AS samples, CAST(sum(n_chars) AS BIGINT) AS n_tokens FROM documents GROUP BY source)
    SELECT name, samples, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY name) AS BIGINT) AS cumulative FROM s"""
)
def cumulative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = _docs(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("samples"), _long(F.sum("n_chars")).alias("n_tokens"))
    return sinks.cumulative_tokens(shards)


@query(
    """WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS p, list_distinct(regexp_extract_all(text, '[A-Za-z]{6,}')) AS t FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_filter(t, lambda w: NOT list_contains(p, w))), ',') AS missing, array_to_string(list_sort(list_filter(p, lambda w: NOT list_contains(t, w))), ',') AS extra
    FROM x WHERE len(list_filter(t, lambda w: NOT list_contains(p, w))) > 0 OR len(list_filter(p, lambda w: NOT list_contains(t, w))) > 0 ORDER BY doc_id LIMIT 20"""
)
def first_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda r: F.array_distinct(F.regexp_extract_all("text", F.lit(r), F.lit(0)))
    sets = _docs(spark, sf_dir).select("doc_id", words("[A-Z][a-z]+").alias("p"), words("[A-Za-z]{6,}").alias("t"))
    found = metrics.misses(sets, "p", "t", "doc_id")
    return found.select("doc_id", F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join(F.array_sort("extra"), ",").alias("extra"))


@query(
    """WITH s AS (SELECT source AS name, doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT name, doc_id, t, coalesce(sum(len(t)) OVER (PARTITION BY name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM s)
    SELECT name, low // 16777216 AS part, count(*) AS samples, CAST(sum(len(t)) AS BIGINT) AS n_tokens,
    md5(unhex(string_agg(array_to_string(list_transform(t, lambda n: printf('%02x%02x%02x00', n % 256, n // 256 % 256, n // 65536)), ''), '' ORDER BY doc_id))) AS bin_md5,
    md5(unhex(string_agg(printf('%02x%02x%02x%02x00000000', low % 256, low // 256 % 256, low // 65536 % 256, low // 16777216), '' ORDER BY doc_id))) AS idx_md5 FROM p GROUP BY name, low // 16777216"""
)
def legacy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("text is not null").select(F.col("source").alias("name"), F.col("doc_id").alias("sample_index"), F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("tokens"))
    return files.legacy_shards(docs).select("name", "part", "samples", "n_tokens", F.md5("bin").alias("bin_md5"), F.md5("idx").alias("idx_md5"))


@query(
    """WITH r AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS index FROM documents)
    SELECT index, source || '#' || CAST(doc_id AS VARCHAR) AS path FROM r WHERE index IN (7, (SELECT max(index) FROM r))"""
)
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.shard_dataset(_docs(spark, sf_dir).select(F.col("source").alias("name"), F.col("doc_id").alias("sample_index")))
    return files.nth(rows, 7).unionByName(files.nth(rows, -1)).select("index", "path")


@query(f"WITH RECURSIVE {_IDS} SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(ids, ','), '')) AS digest FROM documents LEFT JOIN texts USING (doc_id)")
def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = merging.encode_pieces(_docs(spark, sf_dir), _tokenizer(), "doc_id")
    return ids.select("doc_id", _long(F.size("ids")).alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@query("SELECT CAST(floor(i / 7) AS BIGINT) AS batch_id, CAST(7 AS BIGINT) AS rows FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY 1")
def batches_refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = batching.positions(_docs(spark, sf_dir).select("doc_id"), "doc_id", 7)
    return samples.refilled(placed, 7, 1).groupBy(_long("batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("rows"))
