"""Queries of phrases, clauses, random orders and draws over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, draws, logic, phrases
from corpusloom.plans.catalogue import _docs, _long, query

#: A word's tag follows its length here, as no tagger is installed.
_TAGS = ["VERB", "NOUN", "ADJ", "PROPN", "DET", "ADP", "NUM"]
_STOPS = ("the", "der", "la", "de", "to")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    v AS (SELECT doc_id, l, unnest(x) AS word, unnest(range(len(x))) AS i FROM (SELECT doc_id, l, list_filter(string_split(line, ' '), lambda w: w != '') AS x FROM l)),
    t AS (SELECT *, {_TAGS}[length(word) % 7 + 1] AS tag, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lemma FROM v),
    f AS (SELECT *, lemma IN {_STOPS} AS s, tag IN {phrases.NOMINAL} AS n, tag = 'PROPN' AS p, tag IN {phrases.NOMINAL} AND lemma NOT IN {_STOPS} AS c FROM t),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, l, c ORDER BY i) AS cg, i - row_number() OVER (PARTITION BY doc_id, l, p ORDER BY i) AS pg,
        lead(lemma, 1) OVER o AS m1, lead(lemma, 2) OVER o AS m2, lead(lemma, 3) OVER o AS m3, lead(lemma, 4) OVER o AS m4, lead(n, 1) OVER o AS n1, lead(n, 2) OVER o AS n2, lead(n, 3) OVER o AS n3, lead(n, 4) OVER o AS n4,
        lead(s, 1) OVER o AS s1, lead(s, 2) OVER o AS s2, lead(s, 3) OVER o AS s3, lead(s, 4) OVER o AS s4 FROM f WINDOW o AS (PARTITION BY doc_id, l ORDER BY i)),
    a AS (SELECT *, c AND count(*) OVER (PARTITION BY doc_id, l, c, cg) >= 2 AS in_c, tag = 'VERB' AND NOT s AS verb FROM g),
    b1 AS (SELECT *, verb AND coalesce(n1 AND NOT s1, false) AS t1, verb AND coalesce(n2 AND NOT s2, false) AS t2 FROM a),
    b2 AS (SELECT *, t1 AND coalesce(NOT n2 AND NOT s2, false) AS o2 FROM b1),
    b3 AS (SELECT *, verb AND NOT o2 AND coalesce(n3 AND NOT s3, false) AS t3, o2 OR ((t1 OR t2) AND coalesce(NOT n3 AND NOT s3, false)) AS o3 FROM b2),
    b AS (SELECT *, verb AND NOT o3 AND coalesce(n4 AND NOT s4, false) AS t4 FROM b3),
    e AS (SELECT *, NOT in_c AND NOT s AND NOT coalesce(lag(t1, 1) OVER o, false) AND NOT coalesce(lag(t2, 2) OVER o, false) AND NOT coalesce(lag(t3, 3) OVER o, false) AND NOT coalesce(lag(t4, 4) OVER o, false) AS free
      FROM b WINDOW o AS (PARTITION BY doc_id, l ORDER BY i)),
    r AS (SELECT doc_id, 'chunk' AS kind, min(i) AS first, max(i) AS last, sum(length(CASE WHEN p THEN word ELSE lemma END)) AS letters FROM e WHERE in_c GROUP BY doc_id, l, cg
      UNION ALL SELECT doc_id, 'name', min(i), max(i), sum(length(word)) FROM e WHERE p GROUP BY doc_id, l, pg HAVING bool_or(free)
      UNION ALL SELECT doc_id, 'object', i, i + CASE WHEN t4 THEN 4 WHEN t3 THEN 3 WHEN t2 THEN 2 ELSE 1 END,
        length(lemma) + list_sum(list_transform(list_filter([CASE WHEN t1 THEN m1 END, CASE WHEN t2 THEN m2 END, CASE WHEN t3 THEN m3 END, CASE WHEN t4 THEN m4 END], lambda x: x IS NOT NULL)[:3], lambda x: length(x))) FROM e WHERE t1 OR t2 OR t3 OR t4
      UNION ALL SELECT doc_id, 'word', i, i, length(lemma) FROM e WHERE (tag IN ('NOUN', 'ADJ') AND free) OR (verb AND NOT (t1 OR t2 OR t3 OR t4)))
    SELECT doc_id, kind, count(*) AS n, CAST(sum(first) AS BIGINT) AS firsts, CAST(sum(last) AS BIGINT) AS lasts, CAST(sum(letters) AS BIGINT) AS letters FROM r GROUP BY doc_id, kind"""
)
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of every line of the documents, summed by document and kind."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("l", "line"))
    words = lines.select("doc_id", "l", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("i", "word"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tagged = words.withColumns({"tag": F.get(F.array(*map(F.lit, _TAGS)), F.length("word") % 7), "lemma": F.translate("word", upper, lower)})
    found = phrases.phrase_spans(tagged, ["doc_id", "l"], stops=_STOPS)
    letters = _long(F.length(F.array_join("phrase", "")))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("first").alias("firsts"), F.sum("last").alias("lasts"), F.sum(letters).alias("letters"))


@query(
    """WITH s AS (SELECT lang, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS w FROM documents),
    t AS (SELECT DISTINCT lang, unnest(list_distinct(w)) AS a, unnest(list_transform(list_distinct(w), lambda x: length(w[-1]) + length(x))) AS k FROM s WHERE len(w) > 1),
    c AS (SELECT DISTINCT lang, a, CASE k % 3 WHEN 0 THEN 'forall' WHEN 1 THEN 'exists' ELSE 'of' END AS q, k % 2 = 0 AS neg FROM t)
    SELECT x.lang, '["forall",' || CASE WHEN x.neg THEN '["~",["' || x.a || '"]]' ELSE '["' || x.a || '"]' END || ']' AS clause, '["' || y.q || '",' || CASE WHEN y.neg THEN '["~",["' || y.a || '"]]' ELSE '["' || y.a || '"]' END || ']' AS against
    FROM c x JOIN c y ON x.lang IS NOT DISTINCT FROM y.lang AND x.a = y.a WHERE x.q = 'forall' AND y.q IN ('exists', 'of') AND x.neg != y.neg"""
)
def clause_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a document as a clause, of all or of some and with or without a sign by its length and the last word's; what clashes by language."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = _docs(spark, sf_dir).select("lang", F.regexp_extract_all(F.translate("text", upper, lower), F.lit("[a-z]+"), F.lit(0)).alias("w")).where("size(w) > 1")
    each = words.select("lang", F.length(F.element_at("w", -1)).alias("n"), F.explode(F.array_distinct("w")).alias("a"))
    k = F.col("n") + F.length("a")
    body = F.when(k % 2 == 0, F.format_string('["~", ["%s"]]', "a")).otherwise(F.format_string('["%s"]', "a"))
    kind = F.when(k % 3 == 0, "forall").when(k % 3 == 1, "exists").otherwise("of")
    return logic.clause_clashes(each.select("lang", F.format_string('["%s", %s]', kind, body).alias("clause")), ["lang"])


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS places, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, true AS moved FROM documents")
def random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = draws.random_order(corpus.with_index(_docs(spark, sf_dir).select("doc_id"), "doc_id"), 42)
    moved = F.avg((F.col("index") == F.col("place")).cast("int")) < 0.1
    return placed.agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"), moved.alias("moved"))


@query("SELECT source, least(25, count(*)) AS drawn, least(25, count(*)) AS ids FROM documents WHERE n_chars > 0 GROUP BY source")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents of each source, by length."""
    drawn = draws.weighted_draw(_docs(spark, sf_dir).select("source", "doc_id", "n_chars"), 25, "n_chars", "doc_id", 42, ["source"])
    return drawn.groupBy("source").agg(F.count("*").alias("drawn"), F.count_distinct("doc_id").alias("ids"))
