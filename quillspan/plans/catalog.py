"""The registered queries of the document engine, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import chunking, retrieval
from quillspan.operators.holders import holders
from quillspan.plans.shared import settle
from quillspan.sources import html
from quillspan.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
STOP = ", ".join(f"'{w}'" for w in T.STOP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query that is the same SQL in both engines, but for what spark_sql says."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_sql or sql
        used = [t for t in TABLES if re.search(rf"\{{{t}\}}", text)]
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    _QUERIES[name] = run
    _SQL[name] = re.sub(r"\{(\w+)\}", r"\1", sql)


# --- search ------------------------------------------------------------------------------------------------------------

_TERMS = f"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g'), '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({STOP}))".replace("{{", "{").replace("}}", "}")
_BM25 = f"""WITH t AS (SELECT doc_id, lang, {_TERMS} AS t FROM documents), dl AS (SELECT avg(len(t)) AS avgdl, count(*) AS n FROM t),
p AS (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT doc_id, lang, term, any_value(dl) AS dl, count(*) AS tf FROM p GROUP BY ALL),
d AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, dl GROUP BY term),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM d) ELSE raw END AS idf FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, any_value(lang) AS lang, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN i USING (term) JOIN q USING (term), dl GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0),
f AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 AND lang = 'en') """


@query(_BM25 + "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(_BM25 + "SELECT item_id, doc_id, score, rank FROM f WHERE rank <= 10")
def bm25_filtered(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), where=F.col("lang") == "en")


@query(_BM25 + "SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_stats(spark, sf_dir):
    return retrieval.bm25_stats(table(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


_HIT = """, gold AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
g AS (SELECT item_id, coalesce(min(rank), 999999) AS best FROM gold LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id) """


@query(_BM25 + _HIT + "SELECT count(*) AS questions, round(avg((best <= 1)::INT), 6) AS hit1, round(avg((best <= 5)::INT), 6) AS hit5, round(avg((best <= 10)::INT), 6) AS hit10 FROM g")
def retrieval_metrics(spark, sf_dir):
    """Questions whose evidence is known: documents that hold the item. All items are looked for in one pass over the texts."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    held = holders(docs.select("doc_id", "text"), items.select(F.col("text").alias("item")))
    gold = held.join(items.select("item_id", F.col("text").alias("item")), "item").select("item_id", "doc_id")
    found = gold.join(retrieval.bm25(docs, items), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.coalesce(F.min("rank"), F.lit(999999)).alias("best"))
    hit = lambda k: F.round(F.avg((F.col("best") <= k).cast("int")), 6).alias(f"hit{k}")
    return found.agg(F.count("*").alias("questions"), hit(1), hit(5), hit(10))


_DENSE = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS own, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0) """


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_DENSE + "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return retrieval.dense(table(spark, sf_dir, "embeddings"), _questions(spark, sf_dir))


@query(_DENSE + "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label = 3) WHERE rank <= 10")
def dense_filtered(spark, sf_dir):
    return retrieval.dense(table(spark, sf_dir, "embeddings").filter("label = 3"), _questions(spark, sf_dir))


def _lists(spark, sf_dir):
    return retrieval.bm25_lists(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), [F.lit(True), F.col("lang") == "en"])


_RRF = """, l AS (SELECT item_id, doc_id, rank, 1.0 AS w FROM r WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, rank, {w} AS w FROM f WHERE rank <= 10),
u AS (SELECT item_id, doc_id, round(sum(w / (60 + rank))::DOUBLE, 9) AS score, min(rank) AS best FROM (SELECT item_id, doc_id, rank, w::DOUBLE AS w FROM l) GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best, doc_id) AS rank FROM u) """


@query(_BM25 + _RRF.format(w="1.0") + "SELECT item_id, doc_id, score, best, rank FROM z WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    return retrieval.rrf(_lists(spark, sf_dir), "item_id", "doc_id")


@query(_BM25 + _RRF.format(w="0.5") + "SELECT item_id, doc_id, score, best, rank FROM z WHERE rank <= 10")
def rrf_weighted(spark, sf_dir):
    return retrieval.rrf(_lists(spark, sf_dir), "item_id", "doc_id", weights=[1.0, 0.5])


@query(_BM25 + _RRF.format(w="1.0") + """, b AS (SELECT z.*, round(score * (1 + 0.25 * ((lang = 'fr')::INT + (source = 'src0')::INT)), 9) AS boosted FROM z JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, boosted, row_number() OVER (PARTITION BY item_id ORDER BY boosted DESC, rank) AS new_rank FROM b""")
def boost_rank(spark, sf_dir):
    fused = rrf_fusion(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    matches = (F.col("lang") == "fr").cast("int") + (F.col("source") == "src0").cast("int")
    return retrieval.boosted(fused, "item_id", matches).select("item_id", "doc_id", "boosted", "new_rank")


@query(_BM25 + """, e AS (SELECT item_id, doc_id, 0 + (CASE WHEN rank <= 3 THEN 0 ELSE 2 END) AS tier, rank AS pos FROM r WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 1, rank FROM f WHERE rank <= 2),
o AS (SELECT item_id, doc_id, min({'t': tier, 'p': pos}) AS spot FROM e GROUP BY ALL), n AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY spot, doc_id) AS slot FROM o) SELECT * FROM n WHERE slot <= 5""")
def reserved_slots(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    lists = settle(retrieval.bm25_lists(docs, items, [F.lit(True), F.col("lang") == "en"]))  # read twice
    extras = lists.filter("list_id = 1 AND rank <= 2").withColumnRenamed("rank", "pos")
    return retrieval.reserve_slots(lists.filter("list_id = 0"), extras, "item_id", "doc_id", 3, 5)


@query(_BM25 + """, m AS (SELECT b.item_id, coalesce(max(score), 0) AS evidence FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id GROUP BY 1)
SELECT item_id, evidence, CASE WHEN evidence >= 150 THEN 'sufficient' WHEN evidence >= 60 THEN 'partial' ELSE 'insufficient' END AS verdict, evidence < 150 AS widen FROM m""")
def gate_verdict(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    best = retrieval.bm25(table(spark, sf_dir, "documents"), items, top=1).select("item_id", "score")
    out = items.select("item_id").join(best, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("evidence"))
    return out.withColumn("verdict", retrieval.verdict(F.col("evidence"), 150, 60)).withColumn("widen", F.col("evidence") < 150)


# --- ingest ------------------------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({t}, '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_CLEAN.format(t='text')}) AS digest, length({_CLEAN.format(t='text')}) AS n FROM documents".replace("replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(0), '')", "regexp_replace(text, '\\r\\n?', chr(10), 'g')"))
def clean_text(spark, sf_dir):
    t = T.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, len(u) AS n_units, md5(array_to_string(u, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+([A-Z0-9("''])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x) <> '') AS u FROM documents)""")
def unit_split(spark, sf_dir):
    u = T.units(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(u).cast("long").alias("n_units"), F.md5(F.array_join(u, "|")).alias("digest"))


@query(r"""WITH a AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
b AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '^[($-]*[0-9][0-9,.]*%?[)]?$'))) / len(w) END AS share, len(list_filter(l, lambda x: len(regexp_extract_all(x, '[0-9][0-9,.]*')) >= 2)) AS rows FROM a)
SELECT doc_id, round(share, 6) AS share, CASE WHEN contains(text, ' | ') OR (len(l) >= 4 AND rows * 10 >= len(l) * 4) THEN 'table' WHEN regexp_matches(lower(text), 'is defined as|refers to|means the') AND share < 0.05 THEN 'definition' WHEN share >= 0.06 THEN 'numeric' ELSE 'narrative' END AS chunk_type FROM b""")
def chunk_type_rules(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.numeric_share(t), 6).alias("share"), T.chunk_type(t).alias("chunk_type"))


@query()
def chunk_packing(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"))


@query()
def html_text(spark, sf_dir):
    return html.read_pages(table(spark, sf_dir, "pages"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))



# --- filings derived from orders: one page for each nation, years as columns ---------------------------------------------

_FILINGS = "WITH y AS (SELECT n_name AS company, year(o_orderdate) AS year, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) AS BIGINT) AS revenue, count(*) AS orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2) "


# --- evaluation --------------------------------------------------------------------------------------------------------

both("dedupe_texts", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY md5(text)")
both("docs_needed", "SELECT doc_id FROM {labels} UNION SELECT doc_id FROM {documents} WHERE lang = 'fr'")




@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return ingest.latency_windows(table(spark, sf_dir, "events"))


@query(_BM25 + """, e AS (SELECT b.item_id, coalesce(max(score), 0) < 150 AS widened FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id GROUP BY 1)
SELECT item_id, doc_id, score, rank, widened FROM r JOIN e USING (item_id) WHERE rank <= CASE WHEN widened THEN 20 ELSE 10 END""")
def widen_once(spark, sf_dir):
    """Questions whose evidence is not sufficient are searched once more, twice as deep; the others stay as they are. The
    deeper search holds the first one, so one is made and cut where the evidence suffices."""
    deep = retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)
    best = F.max("score").over(Window.partitionBy("item_id"))
    return deep.withColumn("widened", best < 150).filter((F.col("rank") <= 10) | F.col("widened"))


@query("SELECT n_nationkey, n_name || ' & Co' AS name, CAST(2000 + n_nationkey AS VARCHAR) AS year FROM nation")
def xbrl_facts(spark, sf_dir):
    page = F.concat(F.lit('<ix:nonNumeric id="a" name="dei:EntityRegistrantName"><b>'), "n_name", F.lit('</b>  &amp; Co</ix:nonNumeric><p><ix:nonNumeric name="dei:DocumentFiscalYearFocus" contextRef="c">'), (F.col("n_nationkey") + 2000).cast("string"), F.lit("</ix:nonNumeric>"))
    facts = html.xbrl_facts(page)
    return table(spark, sf_dir, "nation").select("n_nationkey", facts["EntityRegistrantName"].alias("name"), facts["DocumentFiscalYearFocus"].alias("year"))




def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillspan.plans import filings  # registers its queries here

    return dict(filings.QUERIES)


def oracle_sql() -> dict[str, str]:
    from quillspan.plans import filings

    return dict(filings.SQL)
