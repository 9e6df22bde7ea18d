"""Queries over the shared test tables by name, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import sampling
from corpusloom.functions.text import WHITE, preview, strip
from corpusloom.operators import batching, corpus, dialogue, jsontext, logic, metrics, synth, tokens
from corpusloom.sources import sinks
from corpusloom.sources.scratch import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CHUNK = 512
_STRIP = f"regexp_replace(text, '^{WHITE}+|{WHITE}+$', '', 'g')"
_COLLAPSE = f"regexp_replace({_STRIP}, '{WHITE}+', ' ', 'g')"
_RSTRIP = f"regexp_replace(text, '{WHITE}+$', '', 'g')"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.roles(_table(spark, sf_dir, "conversations"))


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Corpora


@query(f"SELECT doc_id, {_STRIP} AS text FROM documents WHERE {_STRIP} <> ''")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean(_docs(spark, sf_dir)).select("doc_id", "text")


@query(f"SELECT doc_id, substr({_COLLAPSE}, 1, 80) AS preview FROM documents")
def whitespace_collapse_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", preview(F.col("text"), 80).alias("preview"))


@query(
    """SELECT source, count(*) AS samples, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest_chars,
    source || '/' || CAST(arg_max(doc_id, struct_pack(a := length(text), b := -doc_id)) AS VARCHAR) AS longest_path
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE trim(text) <> '') WHERE r = 1) GROUP BY source"""
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.dedupe(corpus.clean(_docs(spark, sf_dir)), ["text"], "doc_id")
    return corpus.source_stats(docs, path=F.concat("source", F.lit("/"), "doc_id"), ordinal="doc_id")


@query(
    """SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(max(length(text)) AS BIGINT) AS longest_context,
    CAST(arg_max(doc_id, struct_pack(a := length(text), b := -doc_id)) AS VARCHAR) AS longest_file, round(sum(length(text)) * 8 / 1048576.0, 3)::DOUBLE AS token_memory_mb FROM documents"""
)
def corpus_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(_docs(spark, sf_dir), F.length("text"), F.col("doc_id").cast("string"), "doc_id")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedupe(_docs(spark, sf_dir), ["text"], "doc_id").select("doc_id", "source", "n_chars")


@query(
    """SELECT conv_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY k ORDER BY conv_id) AS r
    FROM (SELECT conv_id, string_agg(role || chr(1) || text, chr(2) ORDER BY turn) AS k FROM conversations GROUP BY conv_id)) WHERE r = 1"""
)
def dedupe_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    keyed = whole.select("conv_id", F.transform("t", lambda x: F.struct(x.role, x.text)).alias("key"))
    return corpus.dedupe(keyed, ["key"], "conv_id").select("conv_id")


@query(
    """SELECT doc_id, CASE WHEN i >= n - greatest(CAST(floor(n * 0.01) AS BIGINT), CASE WHEN n > 1 THEN 1 ELSE 0 END) THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"""
)
def split_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_tail(_docs(spark, sf_dir), "doc_id").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 100 = 99 THEN 'valid' ELSE 'train' END AS split FROM documents")
def split_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_interval(_docs(spark, sf_dir), "doc_id").select("doc_id", "split")


@query(
    """SELECT source, n, CASE WHEN n > 1 THEN n - least(greatest(CAST(floor(n * 0.01::DOUBLE) AS BIGINT), 1), n - 1) END AS first_valid
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
)
def split_index_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("first_valid", corpus.split_index(F.col("n"), 0.01))


@query(
    """SELECT source, n, n - least(greatest(CAST(floor(n * 0.01::DOUBLE) AS BIGINT), 258), n - 258) AS first_valid
    FROM (SELECT source, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY source)"""
)
def split_token_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).groupBy("source").agg(F.sum(_long(F.length("text"))).alias("n"))
    return n.withColumn("first_valid", corpus.split_tokens(F.col("n"), 0.01, 256))


@query(
    """SELECT source, doc_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(length(text) AS BIGINT) AS size FROM documents"""
)
def offsets_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.offsets(_docs(spark, sf_dir), F.length("text"), "doc_id").select("source", "doc_id", "start", "size")


@query(
    """SELECT source, sample_index, start, coalesce(lead(start) OVER (PARTITION BY source ORDER BY start, sample_index), total) AS "end" FROM (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_index, CAST(sum(length(text)) OVER (PARTITION BY source) AS BIGINT) AS total,
    CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents WHERE text <> '')"""
)
def sample_refs_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.with_index(_docs(spark, sf_dir).where("text <> ''"), "doc_id", "sample_index", ["source"])
    placed = corpus.offsets(docs, F.length("text"), "doc_id").select("source", "sample_index", "start", "size")
    total = placed.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("total"))
    refs = corpus.sample_refs(placed.join(total, F.col("source") == F.col("s")), F.col("total"))
    return refs.select("source", "sample_index", "start", "end")


@query(
    f"""WITH s AS (SELECT source, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY source),
    c AS (SELECT source, t, CAST(unnest(range(0, length(t) // {CHUNK})) AS BIGINT) AS chunk FROM s)
    SELECT source, chunk, md5(substr(t, chunk * {CHUNK} + 1, {CHUNK})) AS digest FROM c"""
)
def pack_fixed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pack_fixed(_docs(spark, sf_dir), "doc_id", CHUNK).select("source", "chunk", F.md5("content").alias("digest"))


@query(
    f"""SELECT source, count(*) AS input_samples, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(length(text)) // {CHUNK} AS BIGINT) AS sample_count,
    CAST(sum(length(text)) % {CHUNK} AS BIGINT) AS dropped_tail FROM documents GROUP BY source"""
)
def pack_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pack_audit(_docs(spark, sf_dir), _long(F.length("text")), CHUNK)


def _members(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), "text")
    conv = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("ordinal"), "text")
    bench = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), "text")
    return [("dataset", docs), ("emotion", conv), ("dataset2", bench)]


_UNION = """SELECT 0 AS source_rank, 'dataset' AS source, doc_id AS ordinal, text FROM documents
    UNION ALL SELECT 1, 'emotion', conv_id * 100000 + turn, text FROM conversations UNION ALL SELECT 2, 'dataset2', item_id, text FROM benchmark"""


@query(_UNION)
def union_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.union_sources(_members(spark, sf_dir))


@query(f"SELECT * FROM ({_UNION}) WHERE source IN ('dataset', 'dataset2')")
def union_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.union_sources(_members(spark, sf_dir), ["dataset", "dataset2"])


@query(f"SELECT source, count(*) AS expected, count(*) FILTER (length(text) >= 300) AS actual, count(*) FILTER (length(text) < 300 OR text IS NULL) AS missing FROM ({_UNION}) GROUP BY source")
def union_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the members hold against a union that short texts were taken from."""
    members = _members(spark, sf_dir)
    expected = corpus.union_sources(members).groupBy("source").agg(F.count(F.lit(1)).alias("expected"))
    return corpus.union_audit(expected, corpus.union_sources([(n, df.where(F.length("text") >= 300)) for n, df in members]))


# Dialogues

_ROLE = "CASE role WHEN 'user' THEN 'usr' WHEN 'assistant' THEN 'agent' ELSE role END"
_TURNS = f"""t AS (SELECT conv_id, turn, {_ROLE} AS role, {_COLLAPSE} AS text FROM conversations),
    sys AS (SELECT c.conv_id, coalesce(max(CASE WHEN role = 'system' AND turn = 0 THEN {_RSTRIP} END), '') AS system FROM conversations c GROUP BY c.conv_id),
    v AS (SELECT * FROM t WHERE role IN ('usr', 'agent') AND text <> ''),
    l AS (SELECT conv_id, turn, role, CASE WHEN role = 'agent' THEN '<agent>: <bos>' || text || '<eos>' ELSE '<usr>: ' || text END AS line FROM v)"""


@query(
    f"""WITH {_TURNS} SELECT s.conv_id, '<system>: ' || s.system || coalesce(chr(10) || x.lines, '') AS dialogue
    FROM sys s LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS lines FROM l GROUP BY conv_id) x ON s.conv_id = x.conv_id"""
)
def format_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = dialogue.turns(_conv(spark, sf_dir))
    return samples.select("conv_id", dialogue.formatted(F.col("system"), F.col("turns")).alias("dialogue"))


@query(
    f"""WITH {_TURNS}, m AS (SELECT conv_id, max(CASE WHEN role = 'agent' THEN turn END) AS last FROM v GROUP BY conv_id),
    b AS (SELECT l.conv_id, string_agg(CASE WHEN m.last IS NULL OR l.turn < m.last THEN l.line END, chr(10) ORDER BY l.turn) AS lines,
          max(CASE WHEN l.turn = m.last THEN l.line END) AS reply FROM l JOIN m ON l.conv_id = m.conv_id GROUP BY l.conv_id)
    SELECT s.conv_id, '<system>: ' || s.system || coalesce(chr(10) || b.lines, '') AS prompt, coalesce(b.reply, '<agent>: <bos><eos>') AS completion
    FROM sys s LEFT JOIN b ON s.conv_id = b.conv_id"""
)
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.prompt_completion(dialogue.turns(_conv(spark, sf_dir)))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n_turns FROM v GROUP BY conv_id HAVING count(*) >= 2 AND count(*) FILTER (WHERE role = 'agent') > 0")
def valid_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.valid(dialogue.turns(_conv(spark, sf_dir))).select("conv_id", _long(F.size("turns")).alias("n_turns"))


def _runs_sql(rows: str, keys: str) -> str:
    return f"""WITH t AS ({rows}),
    c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY {keys} ORDER BY turn) THEN 0 ELSE 1 END AS chg FROM t),
    i AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY {keys} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM c),
    g AS (SELECT {keys}, run, max(role) AS role, CASE WHEN max(role) = 'usr' THEN regexp_replace(string_agg(text, ' ' ORDER BY turn), '{WHITE}+', ' ', 'g') ELSE string_agg(text, chr(10) ORDER BY turn) END AS text FROM i GROUP BY {keys}, run),
    k AS (SELECT *, max(CASE WHEN role = 'agent' THEN run END) OVER (PARTITION BY {keys}) AS last FROM g),
    n AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, max(CASE WHEN role = 'agent' THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) AS a FROM k WHERE run <= last AND NOT (run = 1 AND role = 'agent'))
    SELECT {keys}, run, role, text FROM n WHERE n >= 2 AND a = 1"""


@query(_runs_sql(f"SELECT conv_id, turn, {_ROLE} AS role, {_COLLAPSE} AS text FROM conversations WHERE role <> 'system'", "conv_id"))
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conv(spark, sf_dir).where("role <> 'system'").withColumn("text", preview(F.col("text"), 1 << 30))
    return dialogue.role_runs(rows, ["conv_id"], ["turn"]).select("conv_id", "run", "role", "text")


@query(
    _runs_sql(
        f"""SELECT c.conv_id, t.target, turn, CASE WHEN role = t.target THEN 'agent' ELSE 'usr' END AS role, role || ': ' || {_COLLAPSE} AS text
        FROM conversations c JOIN (SELECT DISTINCT conv_id, role AS target FROM conversations) t ON c.conv_id = t.conv_id""",
        "conv_id, target",
    )
)
def cped_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker")
    rows = rows.withColumn("text", F.concat("speaker", F.lit(": "), preview(F.col("text"), 1 << 30)))
    both = dialogue.perspectives(rows, "conv_id", "speaker", ["turn"])
    return dialogue.role_runs(both, ["conv_id", "target"], ["turn"]).select("conv_id", "target", "run", "role", "text")


@query(
    """SELECT conv_id, turn, p AS position, CASE WHEN p % 2 = 0 THEN 'usr' ELSE 'agent' END AS role
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)"""
)
def parity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.parity(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "position", "role")


@query(
    """SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'view' OR g IS NULL OR g > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)"""
)
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = events.withColumn("gap", gap)
    starts = F.coalesce(F.col("event_type") == "view", F.lit(False)) | F.isnull("gap") | (F.col("gap") > F.expr("interval 1 day"))
    return dialogue.sessions(events, ["user_id"], ["ts", "event_id"], starts).select("event_id", "user_id", "session")


_LABELS = f"""t AS (SELECT conv_id, turn, {_ROLE} AS role, {_COLLAPSE} AS text FROM conversations),
    s AS (SELECT conv_id, max(CASE WHEN role = 'system' AND turn = 0 THEN {_RSTRIP} END) AS system FROM conversations GROUP BY conv_id),
    n AS (SELECT s.conv_id, 5 + 8 + 2 + coalesce(length(any_value(s.system)), 0) + coalesce(sum(CASE WHEN t.role = 'agent' THEN 1 + 7 + 2 + 10 + length(t.text) WHEN t.role = 'usr' THEN 1 + 5 + 2 + length(t.text) END), 0) AS n_tokens,
          coalesce(sum(CASE WHEN t.role = 'agent' THEN 10 + length(t.text) END), 0) AS n_labelled
          FROM s LEFT JOIN (SELECT * FROM t WHERE role IN ('usr', 'agent') AND text <> '') t ON s.conv_id = t.conv_id GROUP BY s.conv_id)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as tokens: their code points."""
    samples = dialogue.turns(_conv(spark, sf_dir))
    parts = samples.select("conv_id", dialogue.segments(F.col("turns"), F.col("system")).alias("s"))
    ids = F.transform("s", lambda x: F.transform(F.filter(F.split(x.text, ""), lambda c: c != ""), lambda c: F.ascii(c)))
    return parts.withColumn("ids", ids).select("conv_id", F.flatten("ids").alias("tokens"), batching.labels(F.col("s"), F.col("ids")).alias("labels"))


@query(
    f"""WITH {_LABELS},
    v AS (SELECT conv_id, list(CASE WHEN role = 'agent' THEN list_concat(list_transform(range(10), lambda x: -100), list_transform(string_split('<bos>' || text || '<eos>', ''), lambda c: unicode(c)))
        ELSE list_transform(range(8 + length(text)), lambda x: -100) END ORDER BY turn) AS l FROM t WHERE role IN ('usr', 'agent') AND text <> '' GROUP BY conv_id),
    h AS (SELECT s.conv_id, list_concat(list_transform(range(15 + coalesce(length(s.system), 0)), lambda x: -100), coalesce(flatten(v.l), [])) AS l FROM s LEFT JOIN v ON v.conv_id = s.conv_id)
    SELECT n.conv_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_tokens AS BIGINT) AS n_labels, CAST(n_labelled AS BIGINT) AS n_labelled, md5(array_to_string(h.l, ',')) AS digest FROM n JOIN h ON h.conv_id = n.conv_id"""
)
def label_mask_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = F.size(F.filter("labels", lambda x: x != batching.IGNORE))
    digest = F.md5(F.array_join(F.col("labels").cast("array<string>"), ","))
    return _labels(spark, sf_dir).select("conv_id", _long(F.size("tokens")).alias("n_tokens"), _long(F.size("labels")).alias("n_labels"), _long(labelled).alias("n_labelled"), digest.alias("digest"))


@query(f"WITH {_LABELS} SELECT CAST(sum(n_labelled) AS BIGINT) AS labelled_tokens, count(*) AS samples FROM n WHERE n_labelled > 0")
def labeled_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = F.size(F.filter("labels", lambda x: x != batching.IGNORE))
    return batching.labelled(_labels(spark, sf_dir)).agg(F.sum(_long(labelled)).alias("labelled_tokens"), F.count(F.lit(1)).alias("samples"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.history(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role", "text")


# Batches; words stand for tokens


@query("SELECT doc_id, (i // 8) AS batch_id, (i % 8) AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def batch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.positions(_docs(spark, sf_dir), "doc_id", 8).select("doc_id", "batch_id", "position")


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("tokens", F.transform(F.split("text", " "), lambda w: F.length(w)))
    return batching.positions(docs, "doc_id", 8)


_WORDS = """w AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INTEGER)) AS t FROM documents)"""


@query(
    f"""WITH {_WORDS}, m AS (SELECT *, min(len(t) - 1) OVER (PARTITION BY batch_id) AS m FROM w)
    SELECT doc_id, CAST(m AS BIGINT) AS steps, CAST(coalesce(list_sum(t[1:m]), 0) AS BIGINT) AS sum_x, CAST(coalesce(list_sum(t[2:m + 1]), 0) AS BIGINT) AS sum_y FROM m"""
)
def shift_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    out = batching.shift(_batched(spark, sf_dir), "tokens")
    return out.select("doc_id", _long(F.size("x")).alias("steps"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(
    f"""WITH {_WORDS}, k AS (SELECT doc_id, batch_id, t[greatest(1, len(t) - 256):] AS t FROM w), m AS (SELECT *, max(len(t) - 1) OVER (PARTITION BY batch_id) AS m FROM k)
    SELECT doc_id, CAST(m AS BIGINT) AS width, CAST(m - (len(t) - 1) AS BIGINT) AS padding, CAST(coalesce(list_sum(t[1:len(t) - 1]), 0) AS BIGINT) AS sum_x,
    CAST(coalesce(list_sum(t[2:]), 0) - 100 * (m - (len(t) - 1)) AS BIGINT) AS sum_y FROM m"""
)
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    docs = _batched(spark, sf_dir)
    out = batching.pad(docs.withColumn("labels", F.col("tokens")), "tokens", "labels", 256)
    padding = F.size("x") - F.least(F.size("tokens") - 1, F.lit(256))
    return out.select("doc_id", _long(F.size("x")).alias("width"), _long(padding).alias("padding"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("SELECT doc_id, CAST(unnest(range(0, length(text) - 257, 256)) AS BIGINT) AS start FROM documents WHERE length(text) >= 258")
def stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(batching.strides(F.length("text"), 256)).alias("start"))


# Metrics


@query('SELECT event_id // 100 AS "window", count(*) AS n, round(avg(value), 6) AS average FROM events GROUP BY 1 HAVING count(*) = 100')
def loss_window_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.window_average(_table(spark, sf_dir, "events"), F.col("event_id"), F.col("value")).withColumn("average", F.round("average", 6))


@query("SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS metric FROM events GROUP BY event_type")
def weighted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = (F.col("event_id") % 7 + 1).cast("double")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.weighted(F.col("value"), weight), 6).alias("metric"))


@query(
    """SELECT event_type, round(exp(least(sum(ln(1 + abs(value)) * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 20.0)), 6) AS ppl, round(exp(avg(ln(1 + abs(value)))), 6) AS batch_ppl
    FROM events GROUP BY event_type"""
)
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, weight = F.ln(F.abs("value") + 1), (F.col("event_id") % 5 + 1).cast("double")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.perplexity(loss, weight), 6).alias("ppl"), F.round(metrics.batch_perplexity(loss), 6).alias("batch_ppl"))


@query(
    """WITH c AS (SELECT n, count(*) AS k FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY n),
    g AS (SELECT CAST(unnest(range(0, (SELECT max(n) + 1 FROM c))) AS BIGINT) AS value) SELECT g.value, CAST(coalesce(c.k, 0) AS BIGINT) AS n FROM g LEFT JOIN c ON c.n = g.value"""
)
def histogram_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.histogram(sizes, F.col("n"))


@query("SELECT event_type, event_id, value FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM events) WHERE r <= 5")
def topk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc())
    return _table(spark, sf_dir, "events").withColumn("r", F.rank().over(w)).where("r <= 5").select("event_type", "event_id", "value")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    return _table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_type", "event_id", "value")


# JSON, lookups, logic


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"SELECT item_id, concat_ws(chr(10), nullif({_STRIP}, ''), 'item ' || CAST(item_id AS VARCHAR)) AS text FROM benchmark")
def json_collect_text_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": F.concat(F.lit("item "), "item_id"), "text": F.col("text")}
    return _table(spark, sf_dir, "benchmark").select("item_id", jsontext.collect_flat(fields).alias("text"))


@query()
def json_collect_text_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations")
    records = conv.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))).alias("record"))
    return records.select("conv_id", jsontext.collect_text(F.col("record")).alias("text"))


@query(
    """SELECT d.doc_id, coalesce(l.split, 'train') AS split FROM documents d
    LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'test' ELSE 'dev' END) AS split FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"""
)
def split_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "test").otherwise("dev")).alias("split"))
    return _docs(spark, sf_dir).join(splits, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query(
    """SELECT DISTINCT d.source, l.quality AS proposition FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic = 0
    AND EXISTS (SELECT 1 FROM labels m JOIN documents e ON m.doc_id = e.doc_id WHERE m.toxic = 1 AND m.quality = l.quality AND e.source = d.source)"""
)
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    stated = stated.select("source", F.col("quality").alias("proposition"), (F.col("toxic") == 1).alias("negated"))
    return logic.contradictions(stated, ["source"])


_SETS = """x AS (SELECT d.doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS p, list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}')) AS t FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Of each whole text, capitalised and long words play predicted and wanted symbols.
    labelled = _table(spark, sf_dir, "labels").select("doc_id").distinct()
    docs = _docs(spark, sf_dir).join(labelled, "doc_id")
    found = lambda r: F.array_distinct(F.regexp_extract_all("text", F.lit(r), F.lit(0)))
    return docs.select("doc_id", found("[A-Z][a-z]+").alias("p"), found("[A-Za-z]{5,}").alias("t"))


@query(f"WITH {_SETS} SELECT doc_id, CAST(len(list_intersect(p, t)) AS BIGINT) AS n_both, CAST(len(p) - len(list_intersect(p, t)) AS BIGINT) AS n_extra, CAST(len(t) - len(list_intersect(p, t)) AS BIGINT) AS n_missed FROM x")
def symbol_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: _long(F.size(c))
    return _sets(spark, sf_dir).select("doc_id", n(F.array_intersect("p", "t")).alias("n_both"), n(F.array_except("p", "t")).alias("n_extra"), n(F.array_except("t", "p")).alias("n_missed"))


@query(
    f"""WITH {_SETS} SELECT CAST(sum(len(list_intersect(p, t))) AS BIGINT) AS hits, CAST(sum(len(p)) AS BIGINT) AS predicted, CAST(sum(len(t)) AS BIGINT) AS wanted,
    round(sum(len(list_intersect(p, t)))::DOUBLE / sum(len(p)), 6) AS precision, round(sum(len(list_intersect(p, t)))::DOUBLE / sum(len(t)), 6) AS recall FROM x"""
)
def micro_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sets(spark, sf_dir).agg(*metrics.micro(F.col("p"), F.col("t")))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*|[0-9]+')) AS BIGINT) AS n_words FROM documents")
def regex_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _long(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:[-'][A-Za-z]+)*|[0-9]+"), F.lit(0)))).alias("n_words"))


@query(
    r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Za-z]+(?:-[A-Za-z]+)+\b'), ',') AS compounds,
    array_to_string(list_transform(regexp_extract_all(text, '\b(?:18|19|20)[0-9][0-9]\b'), lambda y: 'year' || y), ',') AS years FROM documents"""
)
def hyphen_year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(logic.hyphen_compounds(F.col("text")), ",").alias("compounds"), F.array_join(logic.years(F.col("text")), ",").alias("years"))


@query("SELECT doc_id, 'doc' || CAST(doc_id AS VARCHAR) AS entities, 'Doc' || lang || ',from_' || source AS predicates FROM documents")
def fol_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = F.concat(F.lit("forall x (Doc"), "lang", F.lit("(x) -> from_"), "source", F.lit("(x, doc"), "doc_id", F.lit("))"))
    entities, predicates = logic.symbols(clause)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(entities, ",").alias("entities"), F.array_join(predicates, ",").alias("predicates"))


@query("SELECT conv_id, turn, 'Context:' || chr(10) || role || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Options:' || chr(10) || 'yes' || chr(10) || 'no' || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations WHERE text <> ''")
def logic_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations").where("text <> ''")
    return conv.select("conv_id", "turn", logic.build_prompt(F.col("role"), F.col("text"), F.array(F.lit("yes"), F.lit("no"))).alias("prompt"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN t = '' THEN 'Answer:' || chr(10) || 'B' || chr(10) || 'Selected option: no' ELSE
    'Reasoning:' || chr(10) || t || chr(10) || chr(10) || 'Answer:' || chr(10) || 'B' || chr(10) || 'Selected option: no' END AS reply
    FROM (SELECT conv_id, turn, {_STRIP} AS t FROM conversations WHERE {_STRIP} <> '' AND {_COLLAPSE} <> 'B')"""
)
def logic_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations").where((strip(F.col("text")) != "") & (preview(F.col("text")) != "B"))
    meta = F.create_map(F.lit("Proof"), F.col("text"))
    return conv.select("conv_id", "turn", logic.build_reply(F.lit("B"), meta, F.array(F.lit("yes"), F.lit("no"))).alias("reply"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'red' WHEN 3 THEN 'blue' WHEN 4 THEN '' ELSE 'green' END AS chosen FROM documents"""
)
def selected_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.array(*map(F.lit, ["A", "b.", "0", "1", "Z", "gre"]))
    chosen = logic.selected_option(F.get(answers, (F.col("doc_id") % 6).cast("int")), F.array(F.lit("red"), F.lit("blue"), F.lit("green")))
    return _docs(spark, sf_dir).select("doc_id", chosen.alias("chosen"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def sha256_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("fingerprint"))


# Tokenizers: a public file, whose path is a parameter of the operators


#: SQL for the pieces of documents: white space before another white space that a piece begins with is marked off, as patterns can't look ahead there.
_PIECES = r"""cut AS (SELECT doc_id, regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(57344) || '\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS place FROM (SELECT doc_id, regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}' || chr(57344) || ']+|\s+') AS l FROM cut))"""
#: The pieces' ids by merging in rounds (ranks as in the tokenizer's file), and those of each document.
_IDS = f"""{_PIECES},
vocab AS (SELECT unnest(map_keys(v)) AS sym, unnest(map_values(v)) AS id FROM (SELECT CAST(content::JSON -> '$.model.vocab' AS MAP(VARCHAR, INT)) AS v FROM read_text('{_tokenizer()}'))),
ranks AS (SELECT m[1] AS a, m[2] AS b, k AS rank FROM (SELECT unnest(l) AS m, unnest(range(len(l))) AS k FROM (SELECT CAST(content::JSON -> '$.model.merges' AS VARCHAR[][]) AS l FROM read_text('{_tokenizer()}')))),
bytes AS (SELECT piece, k AS pos, CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) AS b FROM (SELECT piece, hex(encode(piece)) AS h, unnest(range(strlen(piece))) AS k FROM (SELECT DISTINCT piece FROM p))),
alphabet AS (SELECT b, CASE WHEN plain THEN chr(b::INT) ELSE chr((255 + sum(1 - plain::INT) OVER (ORDER BY b))::INT) END AS sym FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS plain FROM range(256) r(b))),
merging AS (SELECT piece, pos, sym, 0 AS round, true AS go FROM bytes JOIN alphabet USING (b)
  UNION ALL
  SELECT piece, pos, CASE WHEN mine THEN sym || next ELSE sym END, round + 1, least IS NOT NULL FROM
    (SELECT *, coalesce(lag(mine) OVER (PARTITION BY piece ORDER BY pos), false) AS gone FROM
      (SELECT *, coalesce(rank = least AND (i - run) % 2 = 0, false) AS mine FROM
        (SELECT *, max(CASE WHEN rank = least AND NOT coalesce(before = least, false) THEN i END) OVER (PARTITION BY piece ORDER BY pos) AS run FROM
          (SELECT *, min(rank) OVER (PARTITION BY piece) AS least, lag(rank) OVER (PARTITION BY piece ORDER BY pos) AS before FROM
            (SELECT m.*, r.rank FROM (SELECT *, lead(sym) OVER (PARTITION BY piece ORDER BY pos) AS next, row_number() OVER (PARTITION BY piece ORDER BY pos) AS i FROM merging WHERE go) m LEFT JOIN ranks r ON r.a = m.sym AND r.b = m.next))))) WHERE NOT gone),
done AS (SELECT piece, list(id ORDER BY pos) AS ids FROM merging JOIN vocab USING (sym) WHERE NOT go GROUP BY piece),
texts AS (SELECT doc_id, flatten(list(ids ORDER BY place)) AS ids FROM p JOIN done USING (piece) GROUP BY doc_id)"""


@query(f"WITH {_PIECES} SELECT piece, count(*) AS n FROM p GROUP BY piece")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pretoken_counts(_docs(spark, sf_dir))


@query(f"SELECT unnest(map_values(v)) AS id, unnest(map_keys(v)) AS piece FROM (SELECT CAST(content::JSON -> '$.model.vocab' AS MAP(VARCHAR, INT)) AS v FROM read_text('{_tokenizer()}'))")
def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(spark, f"file://{_tokenizer()}")


@query(f"WITH RECURSIVE {_IDS} SELECT doc_id, coalesce(len(ids), 0) AS n_tokens FROM documents LEFT JOIN texts USING (doc_id)")
def bpe_encode_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _long(F.size(tokens.encode(F.col("text"), _tokenizer()))).alias("n_tokens"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode(F.col("text"), _tokenizer())
    return _docs(spark, sf_dir).select("doc_id", F.md5(tokens.decode(ids, _tokenizer())).alias("digest"))


@query(
    f"""WITH RECURSIVE {_IDS},
    stream AS (SELECT source, flatten(list(list_append(coalesce(ids, []), 50256) ORDER BY doc_id)) AS ids FROM documents LEFT JOIN texts USING (doc_id) GROUP BY source)
    SELECT source, chunk, ids[chunk * 10000 + 1 : chunk * 10000 + 10000] AS ids FROM (SELECT source, ids, unnest(range(len(ids) // 10000)) AS chunk FROM stream)"""
)
def pack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", tokens.encode(F.col("text"), _tokenizer(), eos=50256).alias("ids"))
    return corpus.pack_ids(kept(docs, "ids"), "doc_id", 10_000)  # packing reads the ids more than once


@query()
def logic_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.split_iid(synth.examples(spark, 600))


@query()
def logic_rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.rule_counts(synth.examples(spark, 600))


# Sinks' summaries and sampling


@query(
    """WITH a AS (SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text),
    c AS (SELECT source, count(*) AS n FROM a GROUP BY source)
    SELECT CAST(sum(n) AS BIGINT) AS total, (SELECT count(*) FROM documents) AS deduped_from, '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' AS sources FROM c"""
)
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return sinks.manifest(docs, corpus.dedupe(docs, ["text"], "doc_id"))


@query(
    """SELECT source AS name, count(*) AS samples, CAST(count_if(len(t) = 0) AS BIGINT) AS empty, CAST(sum(len(t)) AS BIGINT) AS n_tokens, min(list_min(t)) AS min_id, max(list_max(t)) AS max_id
    FROM (SELECT source, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM documents) GROUP BY source"""
)
def shard_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("long"))
    return sinks.shard_integrity(_docs(spark, sf_dir).select(F.col("source").alias("name"), sizes.alias("tokens")))


@query(
    """SELECT event_id AS step, round((event_id - (SELECT min(event_id) FROM events)) / (SELECT max(event_id) - min(event_id) FROM events)::DOUBLE, 9) AS x,
    round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 9) AS y FROM events"""
)
def loss_chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sinks.chart_points(_table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss")))
    return points.select("step", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
    k AS (SELECT vec_id, list_filter(e, lambda v: v >= list_reverse_sort(e)[least(5, len(e))]) AS k FROM e)
    SELECT vec_id, CAST(len(k) AS INT) AS kept, round(1 / list_sum(list_transform(k, lambda v: exp((v - list_max(k)) / 0.5))), 6) AS p FROM k"""
)
def softmax_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    scores = sampling.top_k(F.transform("embedding", lambda v: v.cast("double")), 5)
    rows = rows.select("vec_id", scores.alias("s"))
    return rows.select("vec_id", F.size(F.array_compact("s")).alias("kept"), F.round(F.array_max(sampling.softmax(F.col("s"), 0.5)), 6).alias("p"))


@query("SELECT doc_id, CASE WHEN doc_id % 1000 < 500 THEN 0 WHEN doc_id % 1000 < 750 THEN 1 ELSE 2 END::INT AS steps FROM documents")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))
    return _docs(spark, sf_dir).select("doc_id", sampling.choose(weights, F.col("doc_id") % 1000 / 1000).cast("int").alias("steps"))
