"""Audit of replies: every number, number word with unit and citation must occur in an allowed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed values of the audit's patterns.
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
WORD_UNIT = rf"(?i)\b(?:{NUMBER_WORDS})(?:[- ](?:{NUMBER_WORDS}))?\s+(?:volts?|ohms?|amps?|milliamps?|millivolts?|kpa|psi|hz|ft-?lbs?|nm)\b"
CITATION = r"\[([^\[\]]+? p\.\d+)\]"
LEDGER_LINE = r"(?m)^\s*(?:COMMIT|SAFEGUARD):.*$"
LIST_MARK = r"(?m)^\s*(?:\d+[.)]\s+|[-*]\s+)"
NUMBER = r"(?U)(?<![\w.])\d+(?:\.\d+)?"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def without_marks(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), LEDGER_LINE, ""), LIST_MARK, "")


def offending(reply: Column | str, allowed: Column | str) -> Column:
    """What of a reply no allowed text has: numbers (equal to six places), number words with units, citations."""
    blob, body = F.concat_ws("\n", col(allowed)), without_marks(reply)
    exact = lambda x: F.round(x.cast("double"), 6)
    known = F.transform(numbers(blob), exact)
    wrong = F.filter(numbers(body), lambda x: ~F.array_contains(known, exact(x)))
    words = F.filter(F.regexp_extract_all(body, F.lit(WORD_UNIT), F.lit(0)), lambda x: ~F.contains(F.lower(blob), F.lower(x)))
    cited = F.transform(F.regexp_extract_all(blob, F.lit(CITATION), F.lit(1)), F.btrim)
    cites = F.filter(F.regexp_extract_all(body, F.lit(CITATION), F.lit(1)), lambda x: ~F.array_contains(cited, F.btrim(x)))
    return F.concat(wrong, words, F.transform(cites, lambda x: F.concat(F.lit("["), x, F.lit("]"))))


#: Fixed value: words that only the engine itself may use.
OUTCOME_WORDS = r"(?i)\b(pass(?:ed|es)?|fail(?:ed|s|ure)?|in[- ]spec|out of spec|too (?:low|high))\b"


def guarded(body: Column | str, allowed: Column | str, plain_words_only: Column | None = None) -> Column:
    """A worded reply without ledger lines, or null: where nothing is left, where it asks more than once, names
    an outcome or says what no allowed text has, and always at steps that must keep the engine's own words."""
    text = F.regexp_replace(F.regexp_replace(col(body), LEDGER_LINE, ""), r"(?U)^\s+|\s+$", "")
    sound = (text != "") & (F.regexp_count(text, F.lit(r"\?")) <= 1) & ~text.rlike(OUTCOME_WORDS) & (F.size(offending(text, allowed)) == 0)
    return F.when(sound if plain_words_only is None else sound & ~plain_words_only, text)
