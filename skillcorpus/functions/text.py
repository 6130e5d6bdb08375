"""Text measures and tokenizers as column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and CJK ranges as the measures count them.
WS = r"[\s\x{00a0}\x{feff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
CJK_LISTING = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"

# Stop words of the three tokenizers.
TRIGGER_STOP = (
    "the and for with when use this that its your you ask from into please before after then will can should must each some are was been being "
    "have has get gets make made onto about them they their what which whom user users help helps thing things task tasks want need "
    "any all every whenever anything everything"
).split()
TRIGGER_STEM_STOP = (
    "skill trigger request improv reduc involv provid includ ensur turn wher qualiti visibl surfac direct matter prefer handl relat variou gener creat context "
    "ask work want need like even also new one add over never similar exist mention use make way thing well good best current right read file fil content edit "
    "modifi open form set run build support allow follow cover input output time text command option value list item step result session page pag formatt "
    "structur complet load guid guide through integrat toolkit name type data bias toward retrieval pre-train pretrain pretrained knowledge doc docs"
).split()
GOAL_STOP = (
    "the and for with when use this that your you from into of to in on or be is are my our want need make build help using able can via so as skill "
    "user thing task variou relat provid includ gener context creat ask get work let given various related"
).split()
MATCH_STOP = "the and for with when use this that your you from into make build want need skill skills using app apps a an to of in on or my".split()


#: An edge of a word of ASCII letters, digits and underscores, whatever letter stands beside it.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


@functools.cache
def edges(pattern: str) -> str:
    """A pattern whose ``\\b`` is the edge of a word of ASCII: Java's own, up to version 18, counts accented letters as parts of words, which JavaScript's and SQL's do not."""
    return re.sub(r"\\(.)", lambda m: EDGE if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


#: The characters of ``WS``, for trimming without a pattern.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def js_trim(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.trim(c, F.lit(BLANKS))


def count_of(c: Column, pattern: str) -> Column:
    """How often a pattern of characters beyond ASCII occurs; a text of ASCII alone is not searched."""
    return F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.regexp_count(c, F.lit(pattern)))


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(c + 0.5)


def estimate_tokens(c: Column) -> Column:
    """Tokens of a text: 1.05 per CJK character, one per four others; null and blank texts have none."""
    t = js_trim(F.coalesce(c, F.lit("")))
    cjk = count_of(t, CJK)
    return half_up(cjk * F.lit(1.05) + (F.length(t) - cjk) / 4).cast("long")


def listing_tokens(c: Column) -> Column:
    """Tokens of a listing text, by the listing's own CJK ranges, rounded up."""
    t = F.coalesce(c, F.lit(""))
    cjk = count_of(t, CJK_LISTING)
    return F.ceil(cjk / F.lit(1.5) + (F.length(t) - cjk) / 4).cast("long")


def stem(w: Column) -> Column:
    """A crude stem, so that forms of one word meet."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return F.when(w.endswith("ing") & (n > 5), cut(3)).when(w.endswith("ed") & (n > 4), cut(2)).when(w.endswith("es") & (n > 4), cut(2)).when(w.endswith("s") & (n > 3), cut(1)).otherwise(w)


def _words(c: Column, pattern: str, stop: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(stop))


def trigger_tokens(desc: Column) -> Column:
    """Distinct stems of a description that tell when a skill fires."""
    return F.array_distinct(F.filter(F.transform(_words(desc, "[a-z][a-z-]{2,}", TRIGGER_STOP), stem), lambda s: ~s.isin(TRIGGER_STEM_STOP)))


def goal_tokens(c: Column) -> Column:
    """Distinct stems that relevance to a goal is measured on."""
    return F.array_distinct(F.filter(F.transform(_words(c, "[a-z]{3,}", GOAL_STOP), stem), lambda s: ~s.isin(GOAL_STOP)))


def match_tokens(c: Column) -> Column:
    """Distinct words that catalog matching is done on."""
    return F.array_distinct(_words(c, "[a-z]{3,}", MATCH_STOP))


def text_safe(c: Column) -> Column:
    """A label without terminal escapes, control, bidirectional and tag characters."""
    out = F.regexp_replace(c, r"\x{1b}\][^\x{07}\x{1b}]*(?:\x{07}|\x{1b}\\)", "")
    out = F.regexp_replace(out, r"\x{1b}\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(out, r"[\x{00}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]", "")
