"""Text columns: cleaning, tokens, sentence units, kinds of chunks. All of it stays inside the JVM, but for terms_said."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in questions.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"^[($-]*[0-9][0-9,.]*%?[)]?$"


def clean(text: Column) -> Column:
    """One kind of line end, single blanks, no blanks at line ends, at most one empty line, nothing around the whole."""
    text = F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\x00"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


_EDGE = r"[\p{L}\p{N}_]"
#: A word that is no stop word: the choice is made by the pattern, so no array has to be filtered afterwards.
TERM = rf"(?<!{_EDGE})(?!(?:{'|'.join(STOP)})(?!{_EDGE})){_EDGE}+"


def terms(text: Column) -> Column:
    """Search terms: lower case, digits without thousands commas, no stop words; repeats are kept."""
    low = F.lower(text)
    plain = F.when(F.rlike(low, F.lit("[0-9],[0-9]{3}")), F.regexp_replace(low, "([0-9]),(?=[0-9]{3})", "$1")).otherwise(low)
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


_COMMA, _WORD, _STOP = re.compile("([0-9]),(?=[0-9]{3})"), re.compile(r"\w+"), frozenset(STOP)
#: Lower case for letters and digits of ASCII, blanks for what parts words.
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() or c == 95 else " " for c in range(128))


def terms_said(text: str) -> dict[str, int]:
    """What terms() makes of a text, counted; for Arrow batches. Python's words are those of the pattern: \\w is a letter, a
    number or a low line."""
    if "," in text:
        text = _COMMA.sub(r"\1", text)
    found = Counter(text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower()))
    for w in _STOP & found.keys():
        del found[w]
    return found


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")


def units(text: Column) -> Column:
    """Lines, divided into sentences where an end mark and white space stand before a capital, a digit or a quote."""
    sentences = F.regexp_replace(text, r"([.!?])[ \t]+(?=[A-Z0-9(\"'])", "$1\n")
    return F.filter(F.split(sentences, "\n"), lambda u: F.trim(u) != "")


def numeric_share(text: Column) -> Column:
    w = words(text)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: x.rlike(NUMBER))) / F.size(w))


def chunk_type(text: Column) -> Column:
    """table: cells parted by bars, or many lines of numbers; definition and numeric by phrase and share; else narrative."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit("[0-9][0-9,.]*"), F.lit(0))) >= 2)
    table = F.contains(text, F.lit(" | ")) | ((F.size(lines) >= 4) & (F.size(rows) * 10 >= F.size(lines) * 4))
    share = numeric_share(text)
    definition = F.lower(text).rlike("is defined as|refers to|means the") & (share < 0.05)
    return F.when(table, "table").when(definition, "definition").when(share >= 0.06, "numeric").otherwise("narrative")
