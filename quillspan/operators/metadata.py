"""Metadata of chunks and tags of questions: years, sections that run on, vocabularies, companies, statement pages, boosts.

Everything but the fuzzy match of names is columns, windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.holders import holders

YEARS = r"(?<![0-9])(19[89][0-9]|20[0-4][0-9])(?![0-9])"
NOISE = r"(?i)^(table of contents|index|item [0-9]+[a-c]?\.?|part [iv]+|[0-9]+)$"


def years_in(text: Column) -> Column:
    """The different years of a text, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1))))


def normalize_section(heading: Column) -> Column:
    return F.substring(F.lower(F.btrim(F.regexp_replace(heading, r"\s+", " "), F.lit(" .:"))), 1, 80)


def _headings(text: Column, patterns: Sequence[str]) -> Column:
    """The headings in a text in the order of where they begin, a later pattern after an earlier one at the same place.

    Each pattern is one group. Places are lengths of what stands before a heading."""

    def of(k: int, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?im){pattern}"), F.lit(1))
        parts = F.split(F.regexp_replace(text, f"(?im){pattern}", "\x01$0"), "\x01")
        # The part before the first mark, and so on: their lengths add up to the place of the n-th heading.
        place = lambda n: F.length(F.array_join(F.slice(parts, F.lit(1), n + 1), ""))
        return F.transform(found, lambda h, n: F.struct(place(n).cast("int").alias("at"), F.lit(k).alias("p"), normalize_section(h).alias("heading")))

    return F.array_sort(F.concat(*(of(k, p) for k, p in enumerate(patterns))))


def find_section(text: Column, patterns: Sequence[str]) -> Column:
    """The last heading of a text, normalised; null if there is none. patterns: regular expressions with one group, matched
    by line and in any case."""
    return F.element_at(F.when(F.size(_headings(text, patterns)) > 0, _headings(text, patterns)), -1)["heading"]


def add_metadata(chunks: DataFrame, doc_meta: DataFrame, patterns: Sequence[str], order: Sequence[str] = ("page", "chunk_no")) -> DataFrame:
    """chunks (doc_id, text, ... and the columns of order) with those of doc_meta (doc_id, ...), years and section.

    A chunk's last heading is the section of the chunks after it, until the next; one within its first 200 characters is
    its own section as well. A chunk of three or more headings is a table of contents and changes nothing.
    """
    marked = chunks.withColumn("__found", _headings(F.col("text"), patterns))
    here = F.when((F.size("__found") > 0) & (F.size("__found") < 3), F.element_at("__found", -1)["heading"])
    marked = marked.withColumn("__here", F.when(here != "", here))
    top = find_section(F.substring("text", 1, 200), patterns)
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.last("__here", ignorenulls=True).over(before)
    own = F.when(F.col("__here").isNotNull() & (top != ""), top)
    out = marked.withColumn("section", F.coalesce(own, running, F.lit(""))).withColumn("years", years_in(F.col("text"))).drop("__found", "__here")
    return out.join(doc_meta, "doc_id", "left")


def vocab_counts(chunks: DataFrame) -> DataFrame:
    """kind (years or sections), value, n and place: years ascending, sections by how often they come, then by name."""
    years = chunks.select(F.lit("years").alias("kind"), F.explode("years").alias("value"))
    sections = chunks.filter("section <> ''").select(F.lit("sections").alias("kind"), F.col("section").alias("value"))
    n = years.unionByName(sections).groupBy("kind", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "sections", -F.col("n")), "value")
    return n.withColumn("place", F.row_number().over(by))


def doc_fields(doc_meta: DataFrame) -> DataFrame:
    """field and values: the different values of each column but doc_id and lists, sorted."""
    names = [f.name for f in doc_meta.schema if f.name != "doc_id" and f.dataType.typeName() != "array"]
    rows = doc_meta.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))).alias("x")).select("x.*")
    return rows.filter("value IS NOT NULL").groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values"))


def aliases(doc_meta: DataFrame) -> DataFrame:
    """alias and company of doc_meta (company, aliases); of several companies the first by name."""
    return doc_meta.select(F.explode("aliases").alias("alias"), "company").groupBy("alias").agg(F.min("company").alias("company"))


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def match_companies(questions: DataFrame, companies: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id and company of questions (id, question) that name a company (company) or one of names (alias, company) in whole
    words: company names before aliases, longer before shorter, then by name. An alias in capitals must be in capitals.

    Names and questions meet by the first word of the name, so no pair is looked at that shares none.
    """
    rows = companies.select(F.lit(0).alias("tier"), F.lower("company").alias("name"), "company", F.lit(False).alias("cased"))
    if names is not None:
        capitals = (F.upper("alias") == F.col("alias")) & (F.lower("alias") != F.col("alias"))
        rows = rows.unionByName(names.select(F.lit(1).alias("tier"), F.when(capitals, F.col("alias")).otherwise(F.lower("alias")).alias("name"), "company", capitals.alias("cased")))
    rows = rows.filter("name <> ''").withColumn("word", F.coalesce(F.get(_words_of(F.lower("name")), F.lit(0)), F.lit("")))
    asked = questions.select("id", "question", F.explode(F.array_distinct(F.concat(_words_of(F.lower("question")), F.array(F.lit(""))))).alias("word"))
    met = asked.join(rows, "word")
    text = F.when(F.col("cased"), F.col("question")).otherwise(F.lower("question"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("name", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    found = met.filter(F.rlike(text, quoted))
    best = F.min(F.struct("tier", (-F.length("name")).alias("size"), "name", "company")).alias("best")
    return found.groupBy("id").agg(best).select("id", "best.company")


def fuzzy_companies(entities: DataFrame, companies: DataFrame, block: int = 5000) -> DataFrame:
    """id, company and confidence of entities (id, span, score): the company whose name is most alike (Ratcliff and
    Obershelp's ratio, times the score), the first by name of equal ones. Names come in blocks of bounded size; each task
    keeps its best, and blocks meet in one aggregate."""
    n = companies.count()
    out = None
    for k in range(max(1, -(-n // block))):
        names = sorted(r[0] for r in companies.filter(F.pmod(F.xxhash64("company"), F.lit(max(1, -(-n // block)))) == k).select("company").distinct().collect())

        def best(batches: Iterator[pd.DataFrame], names=names) -> Iterator[pd.DataFrame]:
            from difflib import SequenceMatcher

            for b in batches:
                rows = []
                for r in b.itertuples():
                    m = SequenceMatcher(None)
                    m.set_seq1(r.span.lower())
                    top, at = -1.0, None
                    for name in names:
                        m.set_seq2(name.lower())
                        if m.real_quick_ratio() * r.score > top and m.quick_ratio() * r.score > top and m.ratio() * r.score > top:
                            top, at = m.ratio() * r.score, name
                    if at is not None:
                        rows.append((r.id, at, top))
                yield pd.DataFrame(rows, columns=["id", "company", "confidence"])

        part = entities.select("id", "span", "score").mapInPandas(best, "id long, company string, confidence double")
        out = part if out is None else out.unionByName(part)
    top = F.min(F.struct((-F.col("confidence")).alias("c"), "company")).alias("best")
    return out.groupBy("id").agg(top).select("id", "best.company", F.round(-F.col("best.c"), 3).alias("confidence"))


def match_year(question: Column, years: Sequence[str]) -> Column:
    """The latest year that a question and the documents share; null if none."""
    return F.array_max(F.array_intersect(years_in(question), F.array(*map(F.lit, years)).cast("array<string>")))


def question_kinds(question: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Kinds of statements whose keywords begin a word of the question, in the order of keywords."""
    low = F.lower(question)
    hit = lambda words: F.exists(F.array(*(F.lit(rf"(?U)(?<!\w)\Q{w.lower()}\E") for w in words)), lambda p: F.rlike(low, p))
    return F.array_compact(F.array(*(F.when(hit(words), kind) for kind, words in keywords.items())))


def statement_kind(text: Column, titles: Mapping[str, str], least: int = 15, lines: int = 4) -> Column:
    """The kind of statement that a page begins with; null for other pages. A title is a whole line, but for punctuation,
    among the first lines that are no noise (page numbers, item marks), and the page has least numbers at least."""
    top = F.filter(F.transform(F.slice(F.split(text, "\r\n|\n|\r"), 1, 2 * lines), lambda x: F.trim(x)), lambda x: (x != "") & ~F.rlike(x, F.lit(NOISE)))
    top = F.slice(top, 1, lines)

    def is_title(pattern: str) -> Column:
        return F.exists(top, lambda x: F.rlike(x, F.lit(rf"(?i)^\W*(?:{pattern})\W*$")))

    kinds = [F.when(is_title(p), kind) for kind, p in titles.items()]
    return F.when(F.size(F.regexp_extract_all(text, F.lit("[0-9][0-9,]{2,}"), F.lit(0))) >= least, F.coalesce(*kinds))


def statement_pages(chunks: DataFrame, titles: Mapping[str, str], least: int = 15) -> DataFrame:
    """company, year, kind, chunk_id and page of statement pages among the first chunks of pages (chunk_no 0)."""
    first = chunks.filter("chunk_no = 0 AND company IS NOT NULL AND company <> '' AND year IS NOT NULL AND year <> ''")
    return first.withColumn("kind", statement_kind(F.col("text"), titles, least)).filter("kind IS NOT NULL").select("company", "year", "kind", "chunk_id", "page")


def statement_lookup(tags: DataFrame, pages: DataFrame, slots: int) -> DataFrame:
    """id, chunk_id and pos of the statement pages for tags (id, company, year, kinds): by the order of kinds, then pages."""
    asked = tags.select("id", "company", "year", F.posexplode("kinds").alias("nth", "kind"))
    w = Window.partitionBy("id").orderBy("nth", "page", "chunk_id")
    return asked.join(pages, ["company", "year", "kind"]).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= slots).select("id", "chunk_id", "pos")


def tag_matches(least: float, synonyms: Mapping[str, Sequence[str]], intents: Mapping[str, Sequence[str]]) -> Column:
    """How many confident tags a chunk matches, over columns tag_company, tag_year, tag_section, tag_intent (structs of
    value and confidence, or null) and company, year, section and chunk_type."""
    sure = lambda t: F.coalesce(F.col(t)["confidence"] >= least, F.lit(False))
    value = lambda t: F.col(t)["value"]
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    section = F.lit(False)
    for tag, words in synonyms.items():
        for w in words:
            section = section | ((value("tag_section") == tag) & F.contains(F.coalesce("section", F.lit("")), F.lit(w)))
    intent = F.lit(False)
    for tag, kinds in intents.items():
        if kinds:
            intent = intent | ((value("tag_intent") == tag) & F.col("chunk_type").isin(*kinds))
    return one(sure("tag_company") & (F.col("company") == value("tag_company"))) + one(sure("tag_year") & (F.col("year") == value("tag_year"))) + one(sure("tag_section") & section) + one(sure("tag_intent") & intent)


def boost_factor(matches: Column, boost: float) -> Column:
    return 1 + boost * matches


# --- names and evidence -------------------------------------------------------------------------------------------------


def norm(text: Column) -> Column:
    """Letters a to z and digits alone, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def probes(text: Column, size: int = 40, least: int = 60) -> Column:
    """Three pieces of an excerpt's letters and digits, near its begin, middle and end; none of short ones."""
    n = norm(text)
    at = [F.floor(F.lit(x) * (F.length(n) - size) + F.lit(1e-9)).cast("int") + 1 for x in (0.1, 0.5, 0.9)]
    return F.when(F.length(n) >= least, F.array(*(F.substring(n, p, size) for p in at))).otherwise(F.array().cast("array<string>"))


LEGAL = r"(?i)[,.]?\s+(company|co|corporation|corp|incorporated|inc|limited|ltd|holdings|plc|n\.v|s\.a)\.?$"


def short_name(name: Column) -> Column:
    """A company's name without its legal form, of which two are taken off at most."""
    for _ in range(2):
        name = F.btrim(F.regexp_replace(F.trim(name), LEGAL, ""), F.lit(" ,."))
    return name


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def evidence_owners(excerpts: DataFrame, filings: DataFrame, size: int = 40) -> DataFrame:
    """id, doc_id and pages of excerpts (id, text) that one filing alone holds: of the probes of an id, two and two thirds
    must be in its pages (doc_id, page, text). Pages are gone through once, for all probes together, where they are."""
    asked = excerpts.select("id", F.explode(probes(F.col("text"), size)).alias("probe"))
    need = asked.groupBy("id").agg(F.greatest(F.lit(2), F.floor(F.count("*") * 2 / 3)).alias("need"))
    met = holders(filings.select("doc_id", "page", "text"), asked.select("probe"), squeeze=True)
    hits = asked.join(met, "probe").groupBy("id", "doc_id", "page").agg(F.collect_set("probe").alias("found"))
    per = hits.groupBy("id", "doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.array_sort(F.collect_set("page")).alias("pages"))
    good = per.join(need, "id").filter("n >= need")
    return good.groupBy("id").agg(F.count("*").alias("owners"), F.min(F.struct("doc_id", "pages")).alias("o")).filter("owners = 1").select("id", "o.doc_id", "o.pages")


def page_base_votes(excerpts: DataFrame, filings: DataFrame) -> DataFrame:
    """vote and n for excerpts (id, doc_id, n, text): whether the excerpt's first 60 letters and digits are on page n + 1
    (0-based), on page n (1-based), on both or on neither; those of fewer than 30 do not vote."""
    asked = excerpts.select("id", "doc_id", "n", F.substring(norm(F.col("text")), 1, 60).alias("probe")).filter(F.length("probe") >= 30)
    both = asked.select("*", F.explode(F.array(F.struct(F.lit("zero").alias("base"), (F.col("n") + 1).alias("page")), F.struct(F.lit("one").alias("base"), F.col("n").alias("page")))).alias("x")).select("id", "doc_id", "probe", "x.base", "x.page")
    pages = filings.select("doc_id", "page", norm(F.col("text")).alias("body"))
    met = both.join(pages, ["doc_id", "page"], "left").groupBy("id").agg(*(F.max(F.when(F.col("base") == b, F.coalesce(F.contains("body", F.col("probe")), F.lit(False))).otherwise(False)).alias(b) for b in ("zero", "one")))
    vote = F.when(F.col("zero") & F.col("one"), "both").when(F.col("zero"), "0-based").when(F.col("one"), "1-based").otherwise("neither")
    return met.groupBy(vote.alias("vote")).agg(F.count("*").alias("n"))


def round_robin(items: DataFrame, per: int, seed: int = 0) -> DataFrame:
    """id, doc_id and category of per items of each document: categories take turns (first the first of each, in the order of
    their names, turned on by one for each document), within one the order is by a seeded hash of the id."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    nth = items.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(order, "id")))
    categories = items.select("category").distinct()
    rank = categories.withColumn("c", F.row_number().over(Window.orderBy("category")) - 1)  # as many rows as categories
    n = F.count("*").over(Window.partitionBy())
    rank = rank.withColumn("of", n)
    turn = F.pmod(F.col("c") + F.pmod(F.xxhash64("doc_id"), "of"), F.col("of"))
    w = Window.partitionBy("doc_id").orderBy("nth", turn, "category", "id")
    return nth.join(F.broadcast(rank), "category").withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= per).select("id", "doc_id", "category", "slot")
