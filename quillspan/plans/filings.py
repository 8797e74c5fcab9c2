"""Queries of the operators that the given texts hold nothing for (years, tables, amounts, statements, runs of questions).

Their inputs are texts made from the tables, so that SQL can say what must be found in them: pages of filings with the yearly
revenues of each nation, questions about them, answers right and wrong, chunks with headings, and records of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import answers, chunking, evaluation, metadata, stages, tables
from quillspan.plans import config as C
from quillspan.plans.catalog import _FILINGS, _QUERIES, _SQL, query, table
from quillspan.plans.engine import VARIANTS, Engine
from quillspan.plans.shared import settle
from quillspan.sources import files, html

QUERIES, SQL = _QUERIES, _SQL
Y = _FILINGS.replace("{", "").replace("}", "")
#: half: pages hold the years up to 1998 and those after; n: how many years.
HALVES = Y + ", h AS (SELECT *, CASE WHEN year <= 1998 THEN 2 ELSE 3 END AS page, count(*) OVER (PARTITION BY company, CASE WHEN year <= 1998 THEN 2 ELSE 3 END) AS n FROM y) "
ROWS = HALVES + """, v AS (SELECT company, page, year, n, 'Revenue' AS label, revenue AS value, 1 AS k FROM h UNION ALL SELECT company, page, year, n, 'Costs', revenue // 3, 2 FROM h
UNION ALL SELECT company, page, year, n, 'Margin', revenue - revenue // 3, 3 FROM h UNION ALL SELECT company, page, year, n, 'Losses', revenue // 7, 4 FROM h) """


def years(spark, sf_dir) -> DataFrame:
    """company, year, revenue, orders."""
    return spark.sql(_FILINGS + "SELECT * FROM y", **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")})


def pages(spark, sf_dir) -> DataFrame:
    """company, page and text: a table of contents, two income statements, and prose that names one."""
    y = years(spark, sf_dir).withColumn("page", F.when(F.col("year") <= 1998, 2).otherwise(3))
    lists = y.groupBy("company", "page").agg(F.sort_array(F.collect_list(F.struct("year", "revenue"))).alias("y"))
    number = lambda f: F.array_join(F.transform("y", lambda x: f(x["revenue"])), " ")
    plain = lambda x: F.format_number(x, 0)
    third = lambda x: F.floor(x / 3)
    rows = [("Revenue $ ", plain), ("Costs ", lambda x: plain(third(x))), ("Margin ", lambda x: plain(x - third(x))), ("Losses ", lambda x: F.concat(F.lit("("), plain(F.floor(x / 7)), F.lit(")")))]
    text = F.concat_ws("\n", F.lit("Item 8.\n CONSOLIDATED STATEMENTS OF INCOME\nYears ended December 31,"), F.array_join(F.transform("y", lambda x: x["year"].cast("string")), "\n"), *(F.concat(F.lit(label), number(f)) for label, f in rows))
    made = lists.select("company", "page", text.alias("text"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"))
    index = nation.select("company", F.lit(1).alias("page"), F.lit("Table of contents\nConsolidated statements of income\n2").alias("text"))
    prose = nation.select("company", F.lit(4).alias("page"), F.concat(F.lit("The consolidated statements of income are on the pages before.\n"), F.array_join(F.transform(F.sequence(F.lit(100), F.lit(130)), lambda x: x.cast("string")), " ")).alias("text"))
    return made.unionByName(index).unionByName(prose)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat("company", F.lit(":"), F.col("page").cast("string")))


@query(ROWS + "SELECT company || ':' || page AS key, label, CAST(year AS VARCHAR) AS year, CAST(value AS DOUBLE) AS value FROM v WHERE n BETWEEN 2 AND 5")
def table_values(spark, sf_dir):
    return tables.table_values(_keyed(pages(spark, sf_dir)), "key").select("key", "label", "year", "value")


@query(ROWS + """, l AS (SELECT company, page, k, label || ' (' || string_agg(year || ': ' || CASE WHEN k = 4 THEN '-' ELSE '' END || format('{:,}', value), '; ' ORDER BY year) || ')' AS line FROM v WHERE n BETWEEN 2 AND 5 GROUP BY company, page, k, label)
SELECT company || ':' || page AS key, string_agg(line, chr(10) ORDER BY k) AS lines FROM l GROUP BY company, page""")
def table_annotate(spark, sf_dir):
    out = tables.annotate(_keyed(pages(spark, sf_dir)), "key")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"^[A-Z][a-z]+ \(")))
    return out.select("key", F.array_join(lines, "\n").alias("lines")).filter("lines <> ''")


TITLES = {"income": "consolidated statements? of income", "balance": "consolidated balance sheets?"}
KEYWORDS = {"income": ["revenue", "margin"], "balance": ["asset", "invent"]}


def chunks(spark, sf_dir) -> DataFrame:
    """The pages as chunks: one each, with the last year of a statement as its year."""
    rows = pages(spark, sf_dir)
    last = years(spark, sf_dir).groupBy("company", F.when(F.col("year") <= 1998, 2).otherwise(3).alias("page")).agg(F.max("year").cast("string").alias("year"))
    rows = rows.join(last, ["company", "page"], "left").select(F.col("company").alias("doc_id"), "company", F.coalesce("year", F.lit("1900")).alias("year"), "page", F.lit(0).alias("chunk_no"), "text", F.lit("10-K").alias("doc_type"), F.lit("").alias("section"))
    return rows.withColumns({"chunk_id": F.format_string("%s:p%d:c0", "doc_id", "page"), "chunk_type": T.chunk_type(F.col("text"))})


_PAGES_SQL = HALVES + ", s AS (SELECT company, page, CAST(max(year) AS VARCHAR) AS year FROM h WHERE n >= 3 GROUP BY ALL) "


@query(_PAGES_SQL + "SELECT company, year, 'income' AS kind, company || ':p' || page || ':c0' AS chunk_id, page FROM s")
def statement_pages(spark, sf_dir):
    return metadata.statement_pages(chunks(spark, sf_dir), TITLES)


def questions(spark, sf_dir) -> DataFrame:
    """id and question, one for each supplier: by name, by an alias in capitals, or by one that is not in capitals."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.element_at(F.array(F.lower("n_name"), F.concat(F.lit("TK"), F.col("n_nationkey").cast("string")), F.concat(F.lit("tk"), F.col("n_nationkey").cast("string"))), F.col("k") + 1)
    year = F.when(F.col("s_suppkey") % 2 == 0, "1998").otherwise("2001 and FY1996")
    text = F.concat(F.lit("How did the revenues of "), name, F.lit(" and their inventor develop in "), year, F.lit("?"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", (F.col("s_suppkey") % 3).cast("int")).select(F.col("s_suppkey").cast("long").alias("id"), text.alias("question"))


def names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("TK"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("company"))


def companies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("company"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, n_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 < 2")
def company_match(spark, sf_dir):
    return metadata.match_companies(questions(spark, sf_dir), companies(spark, sf_dir), names(spark, sf_dir))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, round(2.0 * (length(n_name) - 1) / (2 * length(n_name) - 1) * 0.9, 3) AS confidence, n_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def fuzzy_company(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    spans = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("long").alias("id"), F.replace("n_name", F.lit("_"), F.lit("")).alias("span"), F.lit(0.9).alias("score"))
    return metadata.fuzzy_companies(spans, companies(spark, sf_dir))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 2 = 0 THEN '1998' ELSE '2001' END AS year, 'income,balance' AS kinds, CASE WHEN s_suppkey % 2 = 0 THEN '1998' ELSE '1996,2001' END AS said FROM supplier")
def question_tags(spark, sf_dir):
    q = F.col("question")
    return questions(spark, sf_dir).select("id", metadata.match_year(q, ["1998", "2001", "2015"]).alias("year"), F.array_join(metadata.question_kinds(q, KEYWORDS), ",").alias("kinds"), F.array_join(metadata.years_in(q), ",").alias("said"))


@query(_PAGES_SQL + "SELECT CAST(s_suppkey AS BIGINT) AS id, company || ':p' || page || ':c0' AS chunk_id, 1 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN s ON s.company = n_name AND s.year = CASE WHEN s_suppkey % 2 = 0 THEN '1998' ELSE '2001' END WHERE s_suppkey % 3 < 2")
def statement_lookup(spark, sf_dir):
    q = questions(spark, sf_dir)
    tags = q.join(metadata.match_companies(q, companies(spark, sf_dir), names(spark, sf_dir)), "id").select("id", "company", metadata.match_year(F.col("question"), ["1998", "2001"]).alias("year"), metadata.question_kinds(F.col("question"), KEYWORDS).alias("kinds"))
    return metadata.statement_lookup(tags, metadata.statement_pages(chunks(spark, sf_dir), TITLES), 2)


@query("SELECT n_nationkey AS id, (CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END) AS matches FROM nation")
def tag_matches(spark, sf_dir):
    k = F.col("n_nationkey")
    tag = lambda v, c: F.struct(F.lit(v).alias("value"), c.alias("confidence"))
    rows = table(spark, sf_dir, "nation").select(
        k.alias("id"), tag("a", F.when(k % 2 == 0, 0.9).otherwise(0.4)).alias("tag_company"), tag("1998", F.lit(1.0)).alias("tag_year"), tag("risk", F.lit(0.8)).alias("tag_section"), F.lit(None).cast("struct<value:string,confidence:double>").alias("tag_intent"),
        F.lit("a").alias("company"), F.when(k % 3 == 0, "1998").otherwise("1999").alias("year"), F.when(k % 5 == 0, "item 1a. risk factors").otherwise("item 2").alias("section"), F.lit("table").alias("chunk_type"),
    )
    return rows.select("id", metadata.tag_matches(0.5, {"risk": ["risk factors"]}, {"compare": ["table"]}).alias("matches"))


# --- amounts and the check of answers ------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, value, scale, percent FROM nation, LATERAL (VALUES (n_nationkey + 20.5::DOUBLE, 1000000.0::DOUBLE, false), (-(1200.0::DOUBLE + n_nationkey), 1.0::DOUBLE, false), (61.0::DOUBLE, 1.0::DOUBLE, false), (7.25::DOUBLE, 1.0::DOUBLE, true), (19815.0::DOUBLE, 1000000.0::DOUBLE, false), (0.5::DOUBLE, 1.0::DOUBLE, false)) AS v(value, scale, percent)""")
def number_mentions(spark, sf_dir):
    text = F.format_string("In 2018, FY2019 and on March 4 (1975 too) the 10-K of COVID-19 said %s paid $%s million, or (1,2%s) in its 61st year: 7.25%% of ($19,815 million) [p. 44], see page 68, and .5 more of 10K 3M 10x.", "n_name", F.format_number(F.col("n_nationkey") + 20.5, 1), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), text.alias("text"))
    found = answers.number_mentions(rows, "id", skip_small=False)
    return found.select(F.col("id").cast("int").alias("id"), "value", "scale", "percent")


_PAIRS = HALVES + ", p AS (SELECT a.company, a.year, a.revenue AS r1, b.revenue AS r2 FROM h a JOIN h b ON a.company = b.company AND a.page = b.page AND b.year = a.year + 1 WHERE a.n BETWEEN 2 AND 5) "
_CASES = ("right", "wrong_year", "difference", "growth", "sum", "chain", "nowhere", "hedged", "plain", "cut")


def cases(spark, sf_dir) -> DataFrame:
    """Answers of each kind about two years of a filing: id, kind, answer, passages, question, truncated."""
    y = years(spark, sf_dir).withColumn("page", F.when(F.col("year") <= 1998, 2).otherwise(3))
    a, b = y.select("company", "page", "year", F.col("revenue").alias("r1")), y.select("company", "page", (F.col("year") - 1).alias("year"), F.col("revenue").alias("r2"))
    few = y.groupBy("company", "page").count().filter("count BETWEEN 2 AND 5").select("company", "page")
    pairs = a.join(b, ["company", "page", "year"]).join(few, ["company", "page"]).join(pages(spark, sf_dir), ["company", "page"])
    n = lambda x: F.format_number(x, 0)
    r1, r2, year = F.col("r1"), F.col("r2"), F.col("year").cast("string")
    # Wrong by 1 % at least: a calculation may be off by half a percent (answers.SLACK), and revenues grow with the tables.
    error = F.greatest(F.lit(5_000_000).cast("long"), F.floor((r1 + r2) / 100))
    said = {
        "right": F.concat(F.lit("Revenue in "), year, F.lit(" was $"), n(r1), F.lit(".")),
        "wrong_year": F.concat(F.lit("Revenue in "), year, F.lit(" was $"), n(r2), F.lit(".")),
        "difference": F.concat(F.lit("It went from "), n(r1), F.lit(" to "), n(r2), F.lit(", which is "), n(F.abs(r2 - r1)), F.lit(" apart.")),
        "growth": F.concat(F.lit("From "), n(r1), F.lit(" to "), n(r2), F.lit(" is a change of "), F.format_number(F.abs(r2 - r1) * 100.0 / r1, 3), F.lit("%.")),
        "sum": F.concat(n(r1), F.lit(" + "), n(r2), F.lit(" = "), n(r1 + r2 + error), F.lit(".")),
        "chain": F.concat(F.lit("("), n(r1), F.lit(" + "), n(r2), F.lit(") / 2 = "), n(r1 + r2), F.lit(" / 2 = "), F.format_number((r1 + r2) / 2, 1), F.lit(".")),
        "nowhere": F.lit("It was $98,765,432,101."),
        "hedged": F.concat(F.lit("Revenue was "), n(r1), F.lit(" but the rest is not provided.")),
        "plain": F.lit("Nothing was said about amounts."),
        "cut": F.concat(F.lit("Revenue was "), n(r1)),
    }
    rows = pairs.select("company", "year", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), said[k].alias("answer")) for k in _CASES))).alias("x"))
    return rows.select(F.xxhash64("company", "year", "x.kind").alias("id"), "company", "year", "x.kind", "x.answer", F.array("text").alias("passages"), F.lit("").alias("question"), (F.col("x.kind") == "cut").alias("truncated"))


_EXPECT = """CASE kind WHEN 'right' THEN 'quoted' WHEN 'wrong_year' THEN 'wrong_year' WHEN 'difference' THEN 'quoted,quoted,derived' WHEN 'growth' THEN 'quoted,quoted,derived' WHEN 'sum' THEN 'quoted,quoted,corrected'
WHEN 'chain' THEN 'quoted,quoted,calculated,calculated' WHEN 'nowhere' THEN 'unsupported' WHEN 'hedged' THEN 'quoted' WHEN 'plain' THEN '' ELSE 'quoted' END"""
_KINDS = "(VALUES " + ", ".join(f"('{k}')" for k in _CASES) + ") AS k(kind)"


@query(_PAIRS + f"SELECT company, year, kind, kind NOT IN ('wrong_year', 'nowhere', 'hedged', 'cut') AS ok, {_EXPECT} AS statuses, CASE WHEN kind = 'sum' THEN format('{{:,}}', r1) || ' + ' || format('{{:,}}', r2) || ' = ' || format('{{:,}}', r1 + r2) || '.' END AS corrected FROM p CROSS JOIN {_KINDS}")
def verify_answers(spark, sf_dir):
    asked = cases(spark, sf_dir)
    out = answers.verify_answers(asked).join(asked.select("id", "company", "year", "kind"), "id")
    # The "2" that a chain divides by is small and no amount.
    return out.select("company", "year", "kind", "ok", F.array_join("statuses", ",").alias("statuses"), F.when(F.size("corrections") > 0, F.col("text")).alias("corrected"))


@query(_PAIRS + "SELECT company, year, kind, CASE WHEN kind = 'right' THEN 'quoted' ELSE 'wrong_year' END AS status FROM p CROSS JOIN (VALUES ('right'), ('wrong_year')) AS k(kind)")
def year_column_check(spark, sf_dir):
    asked = cases(spark, sf_dir).filter("kind IN ('right', 'wrong_year')")
    return answers.verify_answers(asked).join(asked.select("id", "company", "year", "kind"), "id").select("company", "year", "kind", F.get("statuses", F.lit(0)).alias("status"))


@query(_PAIRS + "SELECT f, count(*) AS n, CASE WHEN f = 1.0 THEN count(*) ELSE 0 END AS passed FROM p CROSS JOIN (VALUES (1.0::DOUBLE), (1.02::DOUBLE), (1.05::DOUBLE), (1.1::DOUBLE), (1.25::DOUBLE)) AS v(f) GROUP BY f")
def leakage(spark, sf_dir):
    """How many right answers still pass with their amount made wrong by 2, 5, 10 and 25 %."""
    right = cases(spark, sf_dir).filter("kind = 'right'")
    rows = right.withColumn("f", F.explode(F.array(*(F.lit(x) for x in (1.0, 1.02, 1.05, 1.1, 1.25)))))
    said = F.regexp_replace(F.regexp_extract("answer", r"\$([0-9,]+)", 1), ",", "").cast("long")
    rows = rows.withColumn("id", F.xxhash64("id", "f")).withColumn("answer", F.concat(F.lit("Revenue was $"), F.format_number(F.round(said * F.col("f")), 0), F.lit(".")))
    return answers.verify_answers(rows).join(rows.select("id", "f"), "id").groupBy("f").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


@query("""WITH v AS (SELECT item_id AS id, unnest(CASE item_id % 3 WHEN 0 THEN [{'doc_id': 'a', 'page': 12}, {'doc_id': 'b', 'page': 12}, {'doc_id': 'b', 'page': 14}, {'doc_id': '', 'page': 15}] WHEN 1 THEN [{'doc_id': '', 'page': 20}, {'doc_id': 'a', 'page': 10}] ELSE [] END) AS x FROM benchmark) SELECT id, x.doc_id AS doc_id, CAST(x.page AS INTEGER) AS page FROM v""")
def citation_check(spark, sf_dir):
    """Pages cited in several forms, held against chunks of two documents; doc_id is empty for pages that none covers."""
    said = F.when(F.col("item_id") % 3 == 0, "a [p. 12] b [pp. 14–15] (page 12)").when(F.col("item_id") % 3 == 1, "x [page 20] and (p.10), [pp. 9-7] [pp. 1-90]").otherwise("none [q. 4] p. 7")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.regexp_replace("text", r"[\[(]", ""), said).alias("text"))
    covered = asked.select("id", F.explode(F.array(F.struct(F.lit("a").alias("doc_id"), F.lit(10).alias("page_start"), F.lit(12).alias("page_end")), F.struct(F.lit("b").alias("doc_id"), F.lit(12).alias("page_start"), F.lit(14).alias("page_end")))).alias("c")).select("id", "c.*")
    out = answers.check_citations(asked, covered)
    bad = out.select("id", F.explode("invalid_pages").alias("page")).select("id", F.lit("").alias("doc_id"), "page")
    return out.select("id", F.explode("citations").alias("c")).select("id", "c.doc_id", "c.page").unionByName(bad)


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'not found' WHEN 1 THEN 'do not provide' END AS phrase, n_nationkey % 3 = 0 AS refused, n_nationkey >= 20 AS cut FROM nation")
def answer_flags(spark, sf_dir):
    k = F.col("n_nationkey")
    said = F.when(k % 3 == 0, "The answer was Not Found here.").when(k % 3 == 1, "The filings do not provide it.").otherwise("It is 5.")
    return table(spark, sf_dir, "nation").select(k.alias("id"), answers.hedged(said).alias("phrase"), answers.refused(said).alias("refused"), answers.truncated(k, 20).alias("cut"))


# --- ingest --------------------------------------------------------------------------------------------------------------

HEADING = [r"^(item [0-9]+\.[^\n]*)$"]
_LATE = "word " * 50


def turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations as chunks: headings at the top, late headings, years, and tables of contents."""
    k = F.col("turn") % 5
    text = F.when(k == 0, F.concat(F.lit("Item "), F.col("turn").cast("string"), F.lit(".  Overview of "), "role", F.lit(" .:\nsome body"))).when(k == 1, F.lit(_LATE + "\nITEM 9. Late part\nmore")).when(k == 3, "Only 1999 and FY2018, then 1999").when(k == 4, "Item 1. A\nItem 2. B\nItem 3. C").otherwise("nothing here")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("chunk_no"), text.alias("text"))


def doc_meta(spark, sf_dir) -> DataFrame:
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(c.cast("string").alias("doc_id"), F.concat(F.lit("C"), (c % 3).cast("string")).alias("company"), (c % 4 + 2000).cast("string").alias("year"), F.array(F.concat(F.lit("T"), (c % 3).cast("string"))).alias("aliases"))


_SECTIONS = """WITH c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'item ' || turn || '. overview of ' || role WHEN 1 THEN 'item 9. late part' END AS here, CASE turn % 5 WHEN 3 THEN '1999,2018' ELSE '' END AS years FROM conversations),
s AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS page, years, CASE WHEN turn % 5 = 0 THEN here ELSE coalesce(last_value(here IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS section, 'C' || (conv_id % 3) AS company FROM c) """


@query(_SECTIONS + "SELECT * FROM s")
def section_carry_forward(spark, sf_dir):
    out = metadata.add_metadata(turns(spark, sf_dir), doc_meta(spark, sf_dir), HEADING)
    return out.select("doc_id", "page", F.array_join("years", ",").alias("years"), "section", "company")


@query(_SECTIONS + """, n AS (SELECT 'years' AS kind, unnest(string_split(years, ',')) AS value FROM s WHERE years <> '' UNION ALL SELECT 'sections', section FROM s WHERE section <> ''), g AS (SELECT kind, value, count(*) AS n FROM n GROUP BY ALL)
SELECT kind, value, n, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'sections' THEN -n END, value) AS place FROM g""")
def vocab_counts(spark, sf_dir):
    return metadata.vocab_counts(metadata.add_metadata(turns(spark, sf_dir), doc_meta(spark, sf_dir), HEADING))


@query("WITH f AS (SELECT 'company' AS field, 'C' || (conv_id % 3) AS v FROM conversations UNION ALL SELECT 'year', CAST(conv_id % 4 + 2000 AS VARCHAR) FROM conversations) SELECT field, string_agg(DISTINCT v, ',' ORDER BY v) AS names FROM f GROUP BY field UNION ALL SELECT 'alias:T' || (conv_id % 3), 'C' || (conv_id % 3) FROM conversations GROUP BY ALL")
def doc_fields(spark, sf_dir):
    meta = doc_meta(spark, sf_dir)
    fields = metadata.doc_fields(meta).select("field", F.array_join("values", ",").alias("names"))
    return fields.unionByName(metadata.aliases(meta).select(F.concat(F.lit("alias:"), "alias").alias("field"), F.col("company").alias("names")))


@query(r"WITH b AS (SELECT conv_id AS doc_id, turn AS chunk_no, sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT doc_id, chunk_no, CAST(used AS BIGINT) AS used FROM b WHERE used <= 150")
def context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), "text")
    return stages.context_budget(rows, 150).select("doc_id", "chunk_no", "used")


@query("WITH p AS (SELECT conv_id AS id, turn, '[' || (turn + 1) || '] C 2001, page ' || turn || chr(10) || text AS t FROM conversations) SELECT id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest FROM p GROUP BY id")
def format_passages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("rank"), F.lit("C").alias("company"), F.lit("2001").alias("year"), F.lit("").alias("doc_type"), F.col("turn").alias("page"), "text")
    return stages.format_passages(rows).select("id", F.md5("passages").alias("digest"))


@query("SELECT n_nationkey AS id, page, replace(t, 'NAME', n_name) AS text FROM nation, LATERAL (VALUES (1, 'One NAME' || chr(10) || 'two &'), (2, 'Total $5 (7)' || chr(10) || 'end'), (3, 'last')) AS v(page, t)")
def html_pages(spark, sf_dir):
    """Page breaks, hidden parts, rows of tables, unclosed tags and cells that belong together."""
    page = F.concat(F.lit('<html><head><title>x</title></head><body><ix:header>no</ix:header><p>One <b>'), "n_name", F.lit('<p>two &amp;</b><hr style="page-break-after: always"><table><tr><td>Total</td><td>$</td><td>5</td><td>(7)</td></tr></table>end<div style="display:none">hid</div><div style="page-break-before:always">last<script>"</p>"</script></div></body>'))
    return html.read_pages(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), page.alias("html"))).select(F.col("page_id").cast("int").alias("id"), "page", "text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'a | b' || chr(10) || n_name || ' x | 1' AS text, n_nationkey || ':p1:t0.0' AS chunk_id FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'a | b' || chr(10) || 'u | v', n_nationkey || ':p1:t0.1' FROM nation")
def table_chunks(spark, sf_dir):
    """Rows with gaps: an empty row and column go, white space is collapsed, the header stands over each piece."""
    rows = F.array(F.array(F.lit(" a "), F.lit(None), F.lit("b")), F.array(F.lit(""), F.lit(" ")), F.array(F.concat("n_name", F.lit("\n  x")), F.lit(""), F.lit("1")), F.array(F.lit("u"), F.lit(None), F.lit("v"), F.lit("")))
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), rows.alias("rows"))
    return tables.table_chunks(made, 8).select("doc_id", "text", "chunk_id")


@query(r"SELECT n_nationkey AS id, n_name AS short, regexp_replace(lower(n_name || ' & Söhne'), '[^a-z0-9]', '', 'g') AS norm, substr(sha1(n_name), 1, 12) AS hash, 'item 7. md&a of ' || lower(n_name) AS section FROM nation")
def name_functions(spark, sf_dir):
    c = F.col("n_name")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), metadata.short_name(F.concat(c, F.lit(" Holdings, Inc."))).alias("short"), metadata.norm(F.concat(c, F.lit(" & Söhne"))).alias("norm"), metadata.text_hash(c).alias("hash"), metadata.find_section(F.concat(F.lit("Item 1. Old\ntext\n ITEM 7.  MD&A of "), c, F.lit(" . \nmore")), [r"^\s*(item [0-9]+\.[^\n]*)$"]).alias("section"))


_NORM = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"


@query(f"""WITH e AS (SELECT item_id AS id, {_NORM} AS t FROM benchmark), p AS (SELECT id, unnest([substr(t, CAST(floor(0.1 * (length(t) - 40) + 1e-9) AS INTEGER) + 1, 40), substr(t, CAST(floor(0.5 * (length(t) - 40) + 1e-9) AS INTEGER) + 1, 40), substr(t, CAST(floor(0.9 * (length(t) - 40) + 1e-9) AS INTEGER) + 1, 40)]) AS probe FROM e WHERE length(t) >= 60),
d AS (SELECT doc_id, {_NORM} AS b FROM documents), m AS (SELECT id, doc_id, count(DISTINCT probe) AS n FROM p JOIN d ON contains(b, probe) GROUP BY ALL), o AS (SELECT id, count(*) AS owners, min(doc_id) AS doc_id FROM m WHERE n >= 2 GROUP BY id) SELECT id, doc_id FROM o WHERE owners = 1""")
def evidence_owners(spark, sf_dir):
    excerpts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    filings = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return metadata.evidence_owners(excerpts, filings).select("id", "doc_id")


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN '0-based' WHEN doc_id % 3 = 1 THEN '1-based' ELSE 'neither' END AS vote, count(*) AS n FROM (SELECT doc_id, {_NORM} AS t FROM documents) WHERE length(t) >= 30 GROUP BY ALL")
def page_base_votes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("id"), "doc_id", (F.col("doc_id") % 3).cast("int").alias("n"), "text")
    return metadata.page_base_votes(asked, docs.select("doc_id", F.lit(1).alias("page"), "text"))


@query()
def round_robin(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.col("lang").alias("category"))
    return metadata.round_robin(items, 3)


# --- evaluation ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, unnest([{'v': o_totalprice * 1000000, 'p': false}, {'v': 0 - CAST(o_orderkey AS DOUBLE), 'p': false}, {'v': 12.5::DOUBLE, 'p': true}]) AS x FROM orders".join(("WITH v AS (", ") SELECT id, round(x.v, 2) AS value, x.p AS percent FROM v WHERE NOT (x.v BETWEEN -2049 AND -1990)")))
def grader_numbers(spark, sf_dir):
    import pandas as pd

    text = F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"), F.lit(" million in 2018, ("), F.col("o_orderkey").cast("string"), F.lit("), 12.5%"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))

    def run(batches):
        for b in batches:
            out = [(i, v, p) for i, t in zip(b["id"], b["text"], strict=True) for v, p in evaluation.grader_numbers(t)]
            yield pd.DataFrame(out, columns=["id", "value", "percent"])

    return rows.mapInPandas(run, "id long, value double, percent boolean").withColumn("value", F.round("value", 2))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN o_orderkey % 4 = 0 END AS correct, CASE o_orderkey % 6 WHEN 3 THEN 'refused' WHEN 4 THEN 'unanswerable' WHEN 5 THEN 'ungraded' ELSE 'numeric' END AS method FROM orders")
def grade(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    gold = F.when(k % 6 == 4, evaluation.UNANSWERABLE).when(k % 6 == 5, "no amounts").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", price)))
    said = F.when(k % 6 == 0, F.concat(F.lit("it is "), F.format_string("%.6f", price / 1e6), F.lit(" million"))).when(k % 6 == 1, F.format_string("%.4f", price * 1.01)).otherwise(F.format_string("%.4f", price * 1.05))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), gold.alias("gold"), said.alias("prediction"), ((k % 6 == 3) | ((k % 6 == 4) & (k % 4 == 0))).alias("refused"))
    return evaluation.grade(rows).select("id", "correct", "method")


def records(spark, sf_dir) -> DataFrame:
    """Graded records of runs: one for each label of a document."""
    d = F.col("doc_id")
    spot = lambda page: F.struct(d.cast("string").alias("doc_id"), page.cast("int").alias("page"))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.select(
        d.alias("id"), F.col("lang").alias("grp"), F.col("source").alias("run"), F.lit("q").alias("question"), F.when(d % 4 == 0, evaluation.UNANSWERABLE).otherwise("gold").alias("gold"), F.concat(F.lit("said "), d.cast("string")).alias("prediction"),
        (F.col("toxic") == 1).alias("refused"), (F.col("quality") == 1).alias("correct"), F.when(d % 2 == 0, "numeric").otherwise("judge").alias("method"), (d % 97 / 97.0).alias("confidence"),
        F.array(spot(F.lit(3)), spot(F.lit(5))).alias("evidence"), F.array(spot(d % 3), spot(d % 5), spot(d % 7), spot(F.lit(9))).alias("chunks"), F.array(spot(d % 11)).alias("candidates"), F.array(spot(d % 4), spot(d % 4 + 10)).alias("citations"),
        F.create_map(F.lit("search"), d % 10 + 0.5, F.lit("answer"), d % 7 + 0.25).alias("timings"),
    )


_RECORDS = "WITH r AS (SELECT doc_id AS id, lang AS grp, source AS run, quality = 1 AS correct, toxic = 1 AS refused, CASE WHEN doc_id % 2 = 0 THEN 'numeric' ELSE 'judge' END AS method, doc_id % 97 / 97.0::DOUBLE AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'UNANSWERABLE' ELSE 'gold' END AS gold FROM labels JOIN documents USING (doc_id)) "


@query(_RECORDS + """, x AS (SELECT 'all' AS dim, 'all' AS value, * FROM r UNION ALL SELECT 'method', method, * FROM r UNION ALL SELECT 'group', grp, * FROM r)
SELECT dim, value, count(*) AS graded, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS accuracy, round(avg(refused::INT), 6) AS refusal_rate, round(avg((NOT refused AND NOT correct)::INT), 6) AS hallucination_rate,
round(count(*) FILTER (NOT refused AND NOT correct) / nullif(count(*) FILTER (NOT refused), 0), 6) AS wrong_when_answered, round(avg(CASE WHEN NOT refused THEN (id % 4 = 3)::INT END), 6) AS citation_any_match FROM x GROUP BY ALL""")
def answer_metrics(spark, sf_dir):
    out = evaluation.answer_metrics(records(spark, sf_dir))
    return out.select("dim", "value", "graded", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "refusal_rate", "hallucination_rate", "wrong_when_answered", "citation_any_match")))


@query(_RECORDS + "SELECT count(*) AS questions, round(avg((id % 3 IN (3, 5))::INT), 6) AS hit1, round(avg((id % 3 IN (3, 5) OR id % 5 IN (3, 5) OR id % 7 IN (3, 5))::INT), 6) AS hit3, round(avg((id % 5 IN (3, 5) OR id % 7 IN (3, 5))::INT), 6) AS hit5, round(avg((id % 11 IN (3, 5))::INT), 6) AS hit_candidates FROM r")
def run_retrieval_metrics(spark, sf_dir):
    out = evaluation.retrieval_metrics(records(spark, sf_dir))
    return out.select("questions", *(F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "hit_candidates")))


@query(_RECORDS + "SELECT id, round((id % 5 = 3 OR id % 7 = 3)::INT / 2.0 + (id % 7 = 5)::INT / 2.0, 6) AS recall, id % 5 = 3 OR id % 7 IN (3, 5) AS hit, CASE WHEN id % 4 = 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS prec, (id % 4 = 3)::INT::DOUBLE AS any_match FROM r")
def recall_at_k(spark, sf_dir):
    m = evaluation.citation_match(F.col("citations"), F.col("evidence"))
    return records(spark, sf_dir).select("id", F.round(evaluation.recall(F.col("chunks"), F.col("evidence"), 3), 6).alias("recall"), evaluation.hit(F.col("chunks"), F.col("evidence"), 3).alias("hit"), m["precision"].alias("prec"), m["any_match"].alias("any_match"))


@query(_RECORDS + ", t AS (SELECT id % 10 + 0.5 AS a, id % 7 + 0.25 AS b FROM r), s AS (SELECT 'search' AS stage, a AS ms FROM t UNION ALL SELECT 'answer', b FROM t UNION ALL SELECT 'total', a + b FROM t) SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5)::DOUBLE, 6) AS median, round(quantile_cont(ms, 0.95)::DOUBLE, 6) AS p95, min(ms)::DOUBLE AS low, max(ms)::DOUBLE AS high FROM s GROUP BY stage")
def latency_summary(spark, sf_dir):
    out = evaluation.latency(records(spark, sf_dir).withColumn("timings", F.col("timings").cast("map<string,double>")))
    return out.select("stage", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "low", "high")


@query("WITH l(label) AS (VALUES ('0'), ('1'), ('2')), n AS (SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS said, count(*) AS n FROM labels GROUP BY ALL) SELECT a.label AS truth, b.label AS said, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON n.truth = a.label AND n.said = b.label")
def confusion(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("said"))
    return evaluation.confusion(pairs, ["0", "1", "2"])


_QUOTA = "WITH g AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM g), q AS (SELECT grp, n, n * 50 // total AS base, (n * 50) % total AS rest FROM g CROSS JOIN t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, grp) AS place, 50 - sum(base) OVER () AS over_ FROM q), s AS (SELECT grp, n, CAST(base + CASE WHEN place <= over_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r) "


@query(_QUOTA + "SELECT grp, n, quota FROM s")
def largest_remainder(spark, sf_dir):
    return evaluation.largest_remainder(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n")), 50)


@query(_QUOTA + ", d AS (SELECT doc_id AS id, source AS grp, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents) SELECT id, d.grp, CASE WHEN place <= quota THEN 'dev' ELSE 'test' END AS split FROM d JOIN s ON d.grp = s.grp")
def stratified_split(spark, sf_dir):
    return evaluation.check_split(evaluation.stratified_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp")), 50, 7))


@query(_RECORDS + """, c AS (SELECT DISTINCT confidence AS t FROM r UNION SELECT 0.0::DOUBLE), u AS (SELECT t, sum(CASE WHEN gold = 'UNANSWERABLE' THEN CASE WHEN confidence < t OR refused THEN 1 ELSE -1 END WHEN confidence < t OR refused THEN 0 WHEN correct THEN 1 ELSE -1 END) AS utility FROM c, r GROUP BY t)
SELECT t AS threshold, CAST(utility AS BIGINT) AS utility, CAST((SELECT utility FROM u WHERE t = 0) AS BIGINT) AS ungated FROM u ORDER BY utility DESC, t LIMIT 1""")
def gate_calibration(spark, sf_dir):
    return evaluation.calibrate(records(spark, sf_dir)).select("threshold", F.col("utility").cast("long").alias("utility"), F.col("ungated").cast("long").alias("ungated"))


_LIMITS, _p, _total = [], 0.36787944117144233, 0.0
for _k in range(12):
    _total += _p
    _LIMITS.append(_total)
    _p /= _k + 1
_DRAW = " + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in _LIMITS)


@query(f"WITH u AS (SELECT s.range AS sample, quality AS v, CAST(('0x' || substr(md5('0:' || s.range || ':' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM labels, range(2000) s), t AS (SELECT sample, v, {_DRAW} AS n FROM u), m AS (SELECT sample, sum(n * v) / sum(n) AS mean FROM t GROUP BY sample) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m")
def bootstrap_ci(spark, sf_dir):
    out = evaluation.bootstrap_ci(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(_RECORDS + "SELECT id, CASE WHEN id % 6 = 0 AND NOT refused AND gold <> 'UNANSWERABLE' THEN 'review' ELSE method END AS method, CASE WHEN id % 6 = 0 AND NOT refused AND gold <> 'UNANSWERABLE' THEN id % 18 = 0 ELSE correct END AS correct FROM r")
def apply_reviews(spark, sf_dir):
    """Reviews of every third record, half of them of a text that has changed since."""
    r = records(spark, sf_dir)
    text = F.when(F.col("id") % 6 == 0, F.col("prediction")).otherwise("another text")
    reviews = r.filter("id % 3 = 0").select("id", metadata.text_hash(text).alias("hash"), (F.col("id") % 18 == 0).alias("correct"), F.lit("read").alias("why"))
    return evaluation.apply_reviews(r, reviews).select("id", "method", "correct")


@query(_RECORDS + "SELECT id FROM r WHERE NOT refused AND gold <> 'UNANSWERABLE' AND id % 6 <> 0")
def to_review(spark, sf_dir):
    r = records(spark, sf_dir)
    return evaluation.to_review(r, r.filter("id % 6 = 0").select("id", metadata.text_hash(F.col("prediction")).alias("hash"))).select("id")


@query(_RECORDS + ", g AS (SELECT run, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(1 - count(*) FILTER (NOT refused AND NOT correct) / nullif(count(*) FILTER (NOT refused), 0), 6) AS prec FROM r GROUP BY run) SELECT *, row_number() OVER (ORDER BY CASE run WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, run) AS place FROM g")
def run_list(spark, sf_dir):
    return evaluation.run_list(records(spark, sf_dir), ["src3", "src1"]).select("run", "n", F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("prec"), "place")


@query(_RECORDS + "SELECT id, CASE WHEN refused THEN 'refused' WHEN correct THEN 'correct' ELSE 'wrong' END AS outcome, id % 5 = 3 OR id % 7 IN (3, 5) AS evidence_in_top5 FROM r")
def run_detail(spark, sf_dir):
    return evaluation.run_detail(records(spark, sf_dir)).select("id", "outcome", "evidence_in_top5")


@query(_PAIRS + "SELECT company, year, kind, kind IN ('wrong_year', 'nowhere', 'hedged', 'cut') AS refused, CASE WHEN kind IN ('wrong_year', 'nowhere', 'hedged', 'cut') THEN 'refused' ELSE 'numeric' END AS method, kind = 'right' AS correct FROM p CROSS JOIN " + _KINDS + " WHERE kind IN ('right', 'wrong_year', 'nowhere', 'hedged', 'cut')")
def recheck(spark, sf_dir):
    """Stored answers checked again: the gold answer of each is its own first amount, which only the right one keeps."""
    asked = cases(spark, sf_dir).filter("kind IN ('right', 'wrong_year', 'nowhere', 'hedged', 'cut')")
    stored = asked.withColumn("gold", F.regexp_extract("answer", r"([0-9][0-9,]{4,})", 1)).withColumn("prediction", F.col("answer")).withColumns({"refused": F.lit(False), "unverified": F.lit(None).cast("string"), "correct": F.lit(True), "method": F.lit("numeric")})
    return evaluation.recheck(stored).select("company", "year", "kind", "refused", "method", "correct")


@query("WITH n AS (SELECT n_name, n_nationkey FROM nation), q AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || n_nationkey), n_nationkey) AS k FROM n) SELECT 'unans_' || n_nationkey AS id, 'What did ' || CASE k % 2 WHEN 1 THEN 'Acme' ELSE 'Umbra' END || ' report?' AS question, n_name AS company FROM q WHERE k <= 10")
def unanswerable(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("What did "), F.lower("n_name"), F.lit(" report?")).alias("question"), F.col("n_name").alias("company"))
    return evaluation.unanswerable(asked, ["Acme", "NATION_1", "Umbra"], 10).select("id", "question", "company")


# --- from questions to answers ------------------------------------------------------------------------------------------


def engine(spark, sf_dir) -> Engine:
    settings = C.merge(C.DEFAULTS, {"statements": {"titles": TITLES, "keywords": KEYWORDS}, "gate": {"sufficient": 0.3, "partial": 0.1}})
    return Engine(settle(chunks(spark, sf_dir)), settings, names(spark, sf_dir))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 3 < 2 THEN n_name END AS company, CASE WHEN s_suppkey % 2 = 0 THEN '1998' ELSE '2001' END AS year, 'income,balance' AS kinds FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def analyze(spark, sf_dir):
    out = engine(spark, sf_dir).analyze(questions(spark, sf_dir))
    return out.select("id", F.col("tag_company")["value"].alias("company"), F.col("tag_year")["value"].alias("year"), F.array_join("kinds", ",").alias("kinds"))


@query()
def ask(spark, sf_dir):
    """Questions about the filings all the way to checked answers."""
    out = engine(spark, sf_dir).ask(questions(spark, sf_dir), VARIANTS["verified"])
    return out.select("id", "text", "refused", "verdict", "widened", F.size("citations").alias("cited"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT count(DISTINCT n_name) AS documents, string_agg(n_name, ',' ORDER BY n_name) AS companies, (SELECT count(*) FROM (SELECT DISTINCT n_name, CASE WHEN year(o_orderdate) <= 1998 THEN 1 ELSE 2 END FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)) + 2 * count(*) AS chunks, least(50, (SELECT count(*) FROM supplier)) AS examples FROM nation")
def info(spark, sf_dir):
    out = engine(spark, sf_dir).info(questions(spark, sf_dir))
    return out.select("documents", F.array_join("companies", ",").alias("companies"), "chunks", F.size("examples").cast("long").alias("examples"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 'Consolidated statements of income [p. 1]' AS answer, false AS refused FROM nation")
def baseline_answers(spark, sf_dir):
    """Answers from the beginning of the right filing: its table of contents comes first and names the statements."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("consolidated statements of income").alias("question"), F.col("n_name").alias("doc_id"))
    return engine(spark, sf_dir).baseline(asked, 9)


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents), k AS (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 260)) AS chunk_no FROM w WHERE len(w) > 0), c AS (SELECT doc_id, chunk_no, w[chunk_no * 260 + 1 : chunk_no * 260 + 260] AS own FROM k) SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(own) AS INTEGER) AS n_tokens, md5(array_to_string(own, ' ')) AS digest FROM c WHERE len(own) >= 30")
def word_windows(spark, sf_dir):
    return chunking.word_windows(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", "n_tokens", F.md5("text").alias("digest"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unmatched_docs(spark, sf_dir):
    """Documents that no label is there for: those left to do."""
    return files.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def split_rows(spark, sf_dir):
    split = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "dev").otherwise("test").alias("split"))
    return files.rows_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), files.check_split(split), "dev")
