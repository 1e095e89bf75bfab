"""Text expressions: markup removal, whitespace, scrubbing, quality, chunking.

All of them are JVM-side column expressions over whole texts.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from triagelake.functions.evaluate import let

# ---- Fixed values: close codes, scrub patterns, quality rules ---------------
EXCLUDED_CLOSE_CODES = ["Cannot Reproduce", "Duplicate", "User Error - No Action"]
SCRUB_RULES = [
    (r"\bMRN[-:\s]?\d{4,12}\b", "[MRN REDACTED]"),
    (r"\bDOB[-:\s]?\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DOB REDACTED]"),
    (r"\bNPI[-:\s]?\d{10}\b", "[NPI REDACTED]"),
    (r"\bICD-?1[01][-:\s]?[A-Z]\d+\.?\w*\b", "[DIAGNOSIS-CODE REDACTED]"),
    (r"\b(patient|pt|member)\s*id[-:\s]?\w+\b", "[PATIENT-ID REDACTED]"),
    (r"\b(member|patient)\s+id[-:\s]+\d{6,}\b", "[PATIENT-ID REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[ID REDACTED]"),
    (r"\b(member|patient)\s+\w+\s+\d{6,}\b", "[PATIENT-ID REDACTED]"),
]
SCRUB_NEEDLES = [["mrn"], ["dob"], ["np"], ["cd"], ["pat", "pt", "member"], ["pat", "member"], ["-"],
                 ["pat", "member"]]
SCRUB_MARKER = r"\[(?:MRN|DOB|NPI|DIAGNOSIS-CODE|PATIENT-ID|ID) REDACTED\]"
STEP_MARKER = r"(?im)(^\s*(?:step\s*\d+|first|then|finally|\d+[\.\)])\b)"
SOLVED_FULLY = "Solved (Permanently)"
# -----------------------------------------------------------------------------

BLANK = r"(?U)\s+"
WORD = r"(?U)\S+"
# The characters Python's str.strip removes.
EDGE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_edges(c: Column) -> Column:
    """Remove any Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(EDGE_CHARS))


class _Data(HTMLParser):
    """Gathers what lies between tags."""

    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def parsed_data(markup: str) -> str:
    """Text as an HTML parser reports it: every character reference decoded, script text kept as it is.

    The text is complete: what follows a last `&` or `<` is reported too."""
    parser = _Data()
    parser.feed(markup)
    parser.close()
    return "".join(parser.found)


@F.pandas_udf(StringType())
def _parsed(c: pd.Series) -> pd.Series:
    return c.map(parsed_data, na_action="ignore")


def strip_markup(c: Column) -> Column:
    """Parser flavour; only texts with a `<` or `&` go through the parser."""
    given = F.coalesce(c, F.lit(""))
    marked = F.contains(given, F.lit("<")) | F.contains(given, F.lit("&"))
    return F.when(marked, _parsed(F.when(marked, given))).otherwise(given)


def strip_tags_spaced(c: Column) -> Column:
    """Pattern flavour: every tag becomes one space, ends trimmed."""
    return strip_edges(F.regexp_replace(c, r"<[^>]+>", " "))


def collapse_whitespace(c: Column) -> Column:
    out = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    return strip_edges(F.regexp_replace(out, r"\n{2,}", "\n"))


def words(c: Column) -> Column:
    """Whitespace words; an empty text has none."""
    return F.filter(F.split(c, BLANK), lambda w: w != "")


def _may_match(low: Column, needles: list[str]) -> Column:
    hit = F.contains(low, F.lit(needles[0]))
    for n in needles[1:]:
        hit = hit | F.contains(low, F.lit(n))
    return hit


def scrub(c: Column) -> Column:
    """Rules in order, each only where its cheap needle occurs in the lower-case text.

    Needles avoid i, k and s, whose Unicode case forms differ, so they never
    miss a text the rule would change; no marker contains one a later rule needs.
    """
    def steps(low: Column) -> Column:
        out = c
        for (pattern, marker), needles in zip(SCRUB_RULES, SCRUB_NEEDLES):
            out = let(out, _guarded(_may_match(low, needles), pattern, marker))
        return out
    return let(F.lower(c), steps)


def _guarded(hit: Column, pattern: str, marker: str):
    return lambda t: F.when(hit, F.regexp_replace(t, "(?iU)" + pattern, marker)).otherwise(t)


def scrub_count(before: Column, after: Column | None = None) -> Column:
    """Redactions made: markers after scrubbing less markers before.

    No rule can match a bracket, so markers are never swallowed or split."""
    after = scrub(before) if after is None else after
    n = F.regexp_count(after, F.lit(SCRUB_MARKER)) - F.regexp_count(before, F.lit(SCRUB_MARKER))
    return F.coalesce(n, F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def quality_score(notes: Column, close_code: Column, attributed: Column | None = None,
                  reporter: Column | None = None) -> Column:
    """0..1: length, step markers, closing code, attribution, known reporter."""
    n_words, n_chars = word_count(notes), F.length(notes)
    s = (F.when((n_words >= 50) | (n_chars >= 200), 0.30)
          .when((n_words >= 20) | (n_chars >= 80), 0.15).otherwise(0.0))
    s = s + F.when(F.regexp_like(notes, F.lit(STEP_MARKER)), 0.20).otherwise(0.0)
    s = s + (F.when(close_code == SOLVED_FULLY, 0.20)
              .when(F.startswith(close_code, F.lit("Solved")), 0.10).otherwise(0.0))
    if attributed is not None:
        s = s + F.when(attributed, 0.20).otherwise(0.0)
    if reporter is not None:
        s = s + F.when(F.length(reporter) > 0, 0.10).otherwise(0.0)
    return F.least(F.round(s, 10), F.lit(1.0))


def embedding_text(short: Column, description: Column, notes: Column) -> Column:
    resolution = F.when(F.length(notes) > 0, F.concat(F.lit("Resolution: "), notes))
    return F.concat_ws("\n\n", nullif_empty(short), nullif_empty(description), resolution)


def chunk_count(n_words: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return (F.when(n_words <= size, F.lit(1))
             .otherwise(F.ceil((n_words - size) / F.lit(float(step))).cast("int") + 1))


def chunks(text: Column, w: Column, size: int = 400, overlap: int = 50) -> Column:
    """Overlapping windows over the words `w` of a text; a text that fits in one stays as it is.

    `w` should be a column, not an expression: every window refers to it."""
    step = size - overlap
    n = chunk_count(F.size(w), size, overlap)
    windows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    return F.when(F.size(w) <= size, F.array(text)).otherwise(windows)


def escape_markup(c: Column) -> Column:
    # The five reserved characters; the ampersand goes first.
    for char, ref in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                      ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4.0))
