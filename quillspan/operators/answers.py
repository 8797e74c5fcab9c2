"""Amounts in texts, page citations, and the check of an answer against the passages that it was written from."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.tables import value_years

_PAGE = r"(?:pages?|pp?\.?)"
_LIST = rf"[0-9][0-9,\s–-]*(?:,\s*{_PAGE}\s*[0-9]+)*\s*"
#: Citations of pages and markers of passages; in round brackets, and in running text, only with a word for page. The third
#: form is one that the end of the text cuts off.
CITED = re.compile("|".join((rf"\[\s*(?:{_PAGE}\s*)?{_LIST}\]", rf"\(\s*{_PAGE}\s*{_LIST}\)", rf"\[\s*{_PAGE}\s*[0-9][^\]]*\Z", r"\b(?:see|from|on|in)\s+(?:p\.|pages?)\s*[0-9]+(?:\s*(?:,|-|and)\s*[0-9]+)*")), re.I)
POWERS = {"thousand": 3, "k": 3, "million": 6, "mn": 6, "mm": 6, "m": 6, "billion": 9, "bn": 9, "b": 9}
AMOUNT = re.compile(
    r"""(?P<minus>[-−])? (?P<money>\$\s?)? (?P<left>\()? (?:\$\s?)?
    (?P<digits>\.[0-9]+ | [0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)? | [0-9]+(?:\.[0-9]+)?)
    (?P<right>\))? (?:\s?(?P<unit>% | (?:thousand|million|billion|percent|mn|mm|bn)\b | [kmb]\b))?""",
    re.I | re.X,
)
MONTH = re.compile(r"\b(?:" + "|".join("jan feb mar apr may jun jul aug sep oct nov dec".split()) + r")[a-z]*\.?\s+$", re.I)
ORDINAL = re.compile(r"(?<=[0-9])(?:st|nd|rd|th)\b")
SMALL = 12
HEDGES = ("cannot be calculated", "can not be calculated", "cannot be determined", "not possible to determine", "not possible to calculate", "not found", "not enough information", "insufficient information", "not fully supported", "is not provided", "are not provided", "does not provide", "do not provide", "does not specify", "do not specify")
SLACK = 0.005
REFUSAL = "The documents do not bear out the answer that was found, so none is given."


@dataclass(frozen=True)
class Number:
    """An amount as written: value is signed and without its scale."""

    start: int
    end: int
    raw: str
    digits: str
    value: float
    decimals: int
    scale: float = 1.0
    percent: bool = False
    money: bool = False

    @property
    def scaled(self) -> bool:
        return self.money or self.scale != 1.0


def mask(text: str) -> str:
    """Citations as blanks of the same length, so places stay what they are."""
    return CITED.sub(lambda m: " " * len(m[0]), text)


def _is_name(plain: str, m: re.Match) -> bool:
    """Parts of names and words (FY2018, 3M, 10x, 10-K, COVID-19)."""
    start, end = m.span()
    before, after = plain[max(0, start - 2) : start], plain[end : end + 2]
    if before[-1:].isalpha() or before[-1:] == "_" or (after[:1].isalpha() and not m["unit"]):
        return True
    return (after[:1] == "-" and after[1:].isalpha()) or (before[-1:] == "-" and before[:-1].isalpha())


def find_numbers(text: str, skip_small: bool = True) -> list[Number]:
    """Amounts of a text in order: no bare years, parts of names, days of a month or citations; skip_small leaves out bare
    whole numbers up to SMALL. Ordinals count. Brackets mean a negative, unless they hold a unit or a currency."""
    plain = ORDINAL.sub(lambda m: " " * len(m[0]), mask(text))
    out = []
    for m in AMOUNT.finditer(plain):
        digits, unit = m["digits"], (m["unit"] or "").lower()
        if (unit in ("k", "m", "b") and not m["money"]) or _is_name(plain, m):
            continue
        start, bare, whole = m.start(), not (unit or m["money"]), digits.isdigit()
        if bare and whole and len(digits) == 4 and 1900 <= int(digits) < 2100:
            continue
        if bare and whole and int(digits) <= 31 and MONTH.search(plain[max(0, start - 12) : start]):
            continue
        value = float(digits.replace(",", ""))
        decimals = len(digits.partition(".")[2])
        if skip_small and bare and not decimals and value <= SMALL:
            continue
        both, raw = bool(m["left"] and m["right"]), m[0].strip()
        aside = both and (not bare or "$" in m[0])
        if aside:
            raw = raw.strip("()").strip()
        elif m["left"] and not m["right"]:  # opens a longer expression
            raw = raw.lstrip("(").strip()
        elif m["right"] and not m["left"]:
            raw = raw.replace(")", "").strip()
        if aside or (m["left"] and not m["right"]):
            start += m[0].index(raw)
        sign = -1 if m["minus"] or (both and not aside) else 1
        out.append(Number(start, m.end(), raw, digits, sign * value, decimals, 10.0 ** POWERS.get(unit, 0), unit in ("%", "percent"), bool(m["money"])))
    return out


def tolerance(n: Number, slack: float = 0.0) -> float:
    """Half a unit of the last digit that is written, or a share of the value if that is more."""
    return (1 + 1e-9) * max(slack * abs(n.value), 0.5 / 10**n.decimals)


def same_amount(written: Number, value: float, percent: bool = False, slack: float = 0.0) -> bool:
    """Magnitudes within the rounding of the one written. Powers of a thousand are tried only if that one has a scale or a
    currency; percent: a hundred times more or less will do as well."""
    size = abs(value)
    ways = [size * 10.0**k for k in ((0, 3, -3, 6, -6, 9, -9) if written.scaled else (0,))]
    if percent:
        ways += [100 * size, size / 100]
    return any(abs(abs(written.value) - w) <= tolerance(written, slack) for w in ways)


_BINARY = dict(zip((ast.Div, ast.Mult, ast.Sub, ast.Add), (operator.truediv, operator.mul, operator.sub, operator.add), strict=True))


def evaluate(text: str) -> float | None:
    """The value of sums, differences, products and quotients of plain numbers; None for anything else."""

    def walk(x: ast.AST) -> float:
        match x:
            case ast.BinOp() if type(x.op) in _BINARY:
                return _BINARY[type(x.op)](walk(x.left), walk(x.right))
            case ast.UnaryOp(op=ast.USub()):
                return -walk(x.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return walk(x.operand)
            case ast.Constant() if type(x.value) in (int, float):
                return float(x.value)
        raise ValueError(type(x).__name__)

    try:
        tree = ast.parse(text.translate(str.maketrans("×÷−", "*/-", "$,%")).strip(), mode="eval").body
        return walk(tree) if any(isinstance(x, ast.BinOp) for x in ast.walk(tree)) else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def one_step(values: Sequence[float]) -> Iterator[float]:
    """What one step makes of values: one of them, its double, sums, differences, quotients, growths, means of two or three."""
    for a in values:
        yield from (a, 2 * a)
    for a, b in permutations(values, 2):
        yield from (a + b, a - b)
        if b:
            yield from (a / b, (a - b) / b)
    for k in (3, 2):
        for some in combinations(values, k):
            yield sum(some) / k


def derived(written: Number, known: Sequence[float]) -> bool:
    """Whether one step from the first 14 known magnitudes lands on the digits written, or a hundred times does (with a
    scale: a thousand times, or a thousandth)."""
    values = list(dict.fromkeys(abs(x) for x in known if x))[:14]
    factors = (1, 100, 1e3, 1e-3) if written.scaled else (1, 100)
    return any(abs(abs(written.value) - abs(w * f)) <= tolerance(written) for w in one_step(values) for f in factors)


EQUALS = re.compile("[=≈~]")
SCALE_WORD = re.compile(r"\b(?:" + "|".join(sorted((w for w in POWERS if len(w) > 1), key=len)) + r")\b", re.I)
LINK = re.compile(r"[\s$(]*(?:about|around|roughly|approx\.?|approximately)?[\s$(]*", re.I)
OPERATION = re.compile(r"[0-9)]\s*[-+*/×÷−]\s*[$(0-9]")
SIGNS = frozenset("0123456789.,$%()+-*/ ×÷−\t")


def _operates(text: str) -> bool:
    return bool(OPERATION.search(text.replace("%", "")))


def _left_of(text: str, at: int) -> int | None:
    """Where the arithmetic that ends at a place begins; None if there is none."""
    start = at
    while start and text[start - 1] in SIGNS:
        start -= 1
    while start < at and (text.count("(", start, at) < text.count(")", start, at) or not re.match(r"\s*[-−$(.0-9]", text[start:at])):
        start += 1
    while text.count("(", start, at) > text.count(")", start, at):
        start = text.index("(", start, at) + 1
    return start if _operates(text[start:at]) else None


def _right_of(text: str, at: int) -> int | None:
    """Where the arithmetic from a place on ends at another equals sign: a middle step of a chain."""
    end = at
    while end < len(text) and text[end] in SIGNS:
        end += 1
    part = text[at:end]
    return end if end < len(text) and EQUALS.match(text[end]) and _operates(part) and part.count("(") == part.count(")") else None


YEAR_SAID = re.compile(r"\b(?:FY\s?)?((?:20|19)[0-9]{2})\b|\bFY\s?'?([0-9]{2})\b", re.I)
QUARTER = re.compile(r"quarter|\bQ[1-4]\b|(?:three|six|nine) months|months ended", re.I)
BREAK = re.compile(r"\n+|(?<=[.!?])\s+(?=[(\[A-Z])")


def years_said(text: str) -> set[str]:
    """Years that a text names: 2018, FY2018, FY18."""
    return {a or "20" + b for a, b in YEAR_SAID.findall(text)}


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence or line."""
    cuts = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    return list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True))


@dataclass
class Sources:
    """What an answer may use: amounts of the passages with their page, those of the question, values with their year."""

    passages: list[tuple[Number, int]]
    question: list[Number]
    columns: list[tuple[float, str]]

    @classmethod
    def of(cls, passages: Sequence[str], question: str = "", pages: Sequence[int] | None = None) -> Sources:
        pages = pages or range(1, len(passages) + 1)
        found = [(n, page) for text, page in zip(passages, pages, strict=False) for n in find_numbers(text, skip_small=False)]
        return cls(found, find_numbers(question, skip_small=False), [x for text in passages for x in value_years(text)])

    def wrong_year(self, n: Number, sentence: str) -> str | None:
        """The years of the columns that hold the amount, if the sentence names one other year and no quarter, and the
        amount stands nowhere but in such tables."""
        said = years_said(sentence)
        if QUARTER.search(sentence) or len(said) != 1:
            return None
        at = [year for value, year in self.columns if same_amount(n, value)]
        if not at or said & set(at) or sum(same_amount(n, x.value) for x, _ in self.passages) > len(at):
            return None
        return ", ".join(sorted(set(at)))


@dataclass
class Check:
    raw: str
    status: str
    note: str = ""
    start: int = 0
    end: int = 0


@dataclass
class Checked:
    ok: bool
    text: str
    reasons: list[str] = field(default_factory=list)
    numbers: list[Check] = field(default_factory=list)
    corrections: list[str] = field(default_factory=list)


def _look(text: str, sources: Sources) -> tuple[list[Check], tuple[Number, float, str] | None]:
    """The state of each amount, and the first calculation whose result is wrong (with the right one, and the expression)."""
    numbers = find_numbers(text)
    plain = SCALE_WORD.sub(lambda m: " " * len(m[0]), mask(text))
    state: dict[int, tuple[str, str]] = {}
    known = [n.value for n in sources.question]

    def settle(k: int, status: str, note: str, counts: bool = True) -> bool:
        if k in state:
            return False
        state[k] = status, note
        if counts:
            known.append(numbers[k].value)
        return True

    for k, n in enumerate(numbers):
        page = next((p for x, p in sources.passages if same_amount(n, x.value)), None)
        if page is not None:
            settle(k, "quoted", f"page {page}")
        elif any(same_amount(n, x.value) for x in sources.question):
            settle(k, "question", "in the question")
    for k, n in enumerate(numbers):
        if n.value in (100, 1000) and not (n.scaled or n.percent):
            settle(k, "constant", "a plain factor", counts=False)
    wrong = None
    for _ in range(6):  # what a round supports may be an operand in the next
        news = False
        for sign in EQUALS.finditer(plain):
            begin = _left_of(plain, sign.start())
            if begin is None or any(k not in state for k, n in enumerate(numbers) if begin <= n.start < sign.start()):
                continue
            said = plain[begin : sign.start()]
            value = evaluate(said)
            if value is None:
                continue
            end = _right_of(plain, sign.end())
            if end is not None:
                step = evaluate(plain[sign.end() : end])
                if step is not None and abs(step - value) <= SLACK * max(1e-9, abs(value)):
                    for k, n in enumerate(numbers):
                        if sign.end() <= n.start < end:
                            news |= settle(k, "calculated", said.strip())
                continue
            k = next((k for k, n in enumerate(numbers) if n.start >= sign.end()), None)
            if k is None or not LINK.fullmatch(plain[sign.end() : numbers[k].start]):
                continue
            n = numbers[k]
            if same_amount(n, value, percent=True, slack=SLACK):
                news |= settle(k, "calculated", said.strip())
            elif wrong is None and state.get(k, ("calculated",))[0] == "calculated":
                share = n.percent and abs(value) <= 1.5 and "100" not in said
                wrong = n, 100 * value if share else value, said.strip()
        if wrong:
            break
        for k, n in enumerate(numbers):
            if k not in state and derived(n, known):
                news |= settle(k, "derived", "one step from known amounts")
        if not news:
            break
    spans = sentences(text)
    out = []
    for k, n in enumerate(numbers):
        status, note = state.get(k, ("unsupported", "neither in the passages nor calculated"))
        if status == "quoted":
            a, b = next(((a, b) for a, b in spans if a <= n.start < b), (0, len(text)))
            if other := sources.wrong_year(n, text[a:b]):
                status, note = "wrong_year", f"stands in the column of {other}"
        out.append(Check(n.raw, status, note, n.start, n.start + len(n.raw)))
    return out, wrong


def format_like(value: float, written: Number) -> str:
    """A value with the decimals and commas of the one it replaces; two decimals rather than none below ten."""
    places = written.decimals or (2 if abs(value) < 10 else 0)
    return format(abs(value), f"{',' if ',' in written.digits or abs(value) >= 10_000 else ''}.{places}f")


def hedge(text: str, phrases: Sequence[str] = HEDGES) -> str | None:
    low = text.lower()
    return next((p for p in phrases if p in low), None)


def verify(answer: str, passages: Sequence[str], question: str = "", truncated: bool = False, hedges: Sequence[str] | None = None, pages: Sequence[int] | None = None) -> Checked:
    """Every amount of an answer must be quoted from a passage (from the column of the year that its sentence names), be in
    the question, be the result of a written calculation over such amounts, or lie one step from them. A wrong result of a
    calculation is corrected, up to three times. Hedged and cut off answers fail."""
    sources, reasons, corrections = Sources.of(passages, question, pages), [], []
    if phrase := hedge(answer, hedges or HEDGES):
        reasons.append(f"hedged: {phrase}")
    if truncated:
        reasons.append("cut off")
    new_digits = set()
    while True:
        numbers, wrong = _look(answer, sources)
        if wrong is None or len(corrections) == 3:
            break
        n, value, said = wrong
        digits = format_like(value, n)
        corrections.append(f"{said} is {digits}, not {n.digits}")
        new_digits.add(digits)
        answer = re.sub(rf"(?<![0-9.,]){re.escape(n.digits)}(?![0-9]|[.,][0-9])", digits, answer)
    if wrong:
        reasons.append("a calculation is wrong")
    for status, words in (("unsupported", "not in the passages"), ("wrong_year", "from the column of another year")):
        if found := [c.raw for c in numbers if c.status == status]:
            reasons.append(f"{words}: {', '.join(found[:4])}")
    for c in numbers:
        if c.status in ("calculated", "derived") and any(d in c.raw for d in new_digits):
            c.status = "corrected"
    return Checked(not reasons, answer, reasons, numbers, corrections)


# --- columns and tables --------------------------------------------------------------------------------------------------


def cited_pages(text: Column) -> Column:
    """Pages of [p. 12], (pp. 3-5) and the like: distinct, in order; ranges that fall, or span over 20, are left out."""
    inside = F.regexp_extract_all(text, F.lit(r"(?i)[\[(]\s*(?:pages?|pp?\.?)\s*([0-9][0-9,\s\-–]*?)\s*[\])]"), F.lit(1))
    parts = F.transform(F.split(F.array_join(inside, ","), ","), lambda p: F.regexp_replace(F.trim(p), r"\s*[-–]\s*", "-"))
    parts = F.filter(parts, lambda p: p.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))
    lo, hi = (lambda p, k=k: F.try_element_at(F.split(p, "-"), F.lit(k)).cast("int") for k in (1, 2))
    pages = lambda p: F.when(hi(p).isNull(), F.array(lo(p))).when((hi(p) >= lo(p)) & (hi(p) - lo(p) <= 20), F.sequence(lo(p), F.greatest(hi(p), lo(p)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(parts, pages)))


def check_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, citations (doc_id, page) and invalid_pages of answers (id, text), given the chunks of each (id, doc_id,
    page_start, page_end). A page that chunks of several documents cover is cited from each; one that none covers is
    invalid."""
    said = answers.select("id", F.posexplode(cited_pages(F.col("text"))).alias("at", "page"))
    # A chunk's pages as rows make the range an equality.
    covered = chunks.select("id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).withColumn("page", F.col("page").cast("int")).distinct()
    met = said.join(covered, ["id", "page"], "left")
    spot = F.struct("at", "doc_id", "page")
    per = met.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("doc_id").isNotNull(), spot))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("doc_id").isNull(), F.struct("at", "page")))).alias("i"))
    out = answers.select("id").join(per, "id", "left")
    none = F.array().cast("array<struct<doc_id:string,page:int>>")
    cites = F.transform("c", lambda x: F.struct(x["doc_id"].cast("string").alias("doc_id"), x["page"].alias("page")))
    return out.select("id", F.coalesce(cites, none).alias("citations"), F.coalesce(F.transform("i", lambda x: x["page"]), F.array().cast("array<int>")).alias("invalid_pages"))


def refused(text: Column) -> Column:
    """Whether a written answer is a refusal: NOT FOUND within its first 200 characters."""
    return F.contains(F.upper(F.substring(F.coalesce(text, F.lit("")), 1, 200)), F.lit("NOT FOUND"))


def hedged(text: Column, phrases: Sequence[str] = HEDGES) -> Column:
    """The first of the phrases that the text holds; null if none."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), F.lit(0))


def truncated(tokens: Column, limit: int | None) -> Column:
    return F.lit(False) if not limit else F.coalesce(tokens >= limit, F.lit(False))


def number_mentions(texts: DataFrame, key: str, text: str = "text", skip_small: bool = False) -> DataFrame:
    """key and the amounts of each text: start, end, raw, value, decimals, scale, percent and currency."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n.start, n.end, n.raw, n.value, n.decimals, n.scale, n.percent, n.money) for k, t in zip(b[key], b[text], strict=True) for n in find_numbers(t or "", skip_small)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "raw", "value", "decimals", "scale", "percent", "currency"])

    return texts.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, start int, end int, raw string, value double, decimals int, scale double, percent boolean, currency boolean")


CHECKS = "id long, ok boolean, text string, statuses array<string>, raws array<string>, reasons array<string>, corrections array<string>"


def verify_answers(answers: DataFrame, hedges: Sequence[str] | None = None) -> DataFrame:
    """id, ok, text, statuses and raws of its amounts, reasons and corrections of (id, answer, passages, question,
    truncated): one Arrow pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                x = verify(r.answer or "", [p or "" for p in r.passages], r.question or "", bool(r.truncated), hedges)
                rows.append((r.id, x.ok, x.text, [c.status for c in x.numbers], [c.raw for c in x.numbers], x.reasons, x.corrections))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHECKS.split(", ")])

    return answers.select("id", "answer", "passages", "question", "truncated").mapInPandas(run, CHECKS)


def check_answers(answers: DataFrame, chunks: DataFrame, hedges: Sequence[str] | None = None) -> DataFrame:
    """answers (id, answer, passages, question, truncated, refused) with text, refused, checked, reasons, original (the
    answer as written, where it changed), citations and invalid_pages. A refusal is left as it is; an answer that fails
    becomes REFUSAL and cites nothing; a corrected one is cited anew."""
    asked = answers.filter(~F.coalesce("refused", F.lit(False)))
    done = verify_answers(asked, hedges).withColumnsRenamed({"text": "checked_text"})
    out = answers.select("id", "answer", "refused").join(done, "id", "left")
    failed = ~F.coalesce("ok", F.lit(True))
    text = F.when(failed, REFUSAL).otherwise(F.coalesce("checked_text", "answer"))
    out = out.select("id", text.alias("text"), (F.coalesce("refused", F.lit(False)) | failed).alias("refused"), F.col("ok").isNotNull().alias("checked"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), F.when(text != F.col("answer"), F.col("answer")).alias("original"), failed.alias("failed"))
    cites = check_citations(out.select("id", F.when(F.col("failed"), "").otherwise(F.col("text")).alias("text")), chunks)
    return out.drop("failed").join(cites, "id")
