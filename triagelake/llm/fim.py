"""Fill-in-middle transformation by counted quantifiers.

A unit is a line with its line feed, or a last line without one. regexp_count
gives the number n of units of a text. Two keyed hashes choose a <= b of 0..n; a
pattern made for the row, `(unit{a})(unit{b-a})(rest)` with possessive counts,
captures prefix, middle and suffix in one match, and the replacement puts them
behind their sentinels in the order of the row's form. Possessive groups are
loops in the regex engine, so depth does not grow with the number of lines.

Forms: psm is `<P>prefix<S>suffix<M>middle`, spm is `<S>suffix<P>prefix<M>middle`,
plain is the text. As a text with a sentinel in it stays plain, the sentinels of
an output tell its parts apart, and `restored` gives back the exact text.

Everything is Spark SQL in one pass without a shuffle, so neither skew nor the
length of a text matters. Rows: a null text is empty, an empty text is plain with
n = 0; a null id counts as the empty string in the hash. Repeated rows give equal
results. Other columns are kept, except those named like the new ones. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import text_or_empty

UNIT = r"[^\n]*\n|[^\n]+"
#: The same units for a counted group: once taken, a unit is not given back.
_POSSESSIVE_UNIT = r"(?:[^\n]*+\n|[^\n]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"        # sentinels
SEED, RATE, SPM = 7, 100, 50                        # seed of the hashes; percent transformed; percent of them in spm


def _hash(digest: str, group: int) -> Column:
    """The group-th eight hex digits of a digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _repeated(count: Column) -> Column:
    return F.concat(F.lit("(" + _POSSESSIVE_UNIT + "{"), count.cast("string"), F.lit("}+)"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm: int = SPM) -> DataFrame:
    """docs with n, form, output, prefix_chars and middle_chars (null if plain)."""
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c not in new]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    made = docs.select(F.struct(*kept).alias("row"), text_or_empty(text_col).alias("t"), F.sha2(key, 256).alias("digest"))
    made = made.withColumn("n", F.regexp_count("t", F.lit(UNIT)).cast("long"))
    cuts = [_hash("digest", i) % (F.col("n") + 1) for i in (0, 1)]
    plain = (F.col("n") == 0) | (_hash("digest", 2) % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("t", F.lit(mark))
    made = made.withColumns({
        "a": F.least(*cuts), "b": F.greatest(*cuts),
        "form": F.when(plain, "plain").when(_hash("digest", 3) % 100 < spm, "spm").otherwise("psm")})
    pattern = F.concat(F.lit(r"\A"), _repeated(F.col("a")), _repeated(F.col("b") - F.col("a")), F.lit(r"((?s:.*+))\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    made = made.withColumn("output", F.when(F.col("form") == "plain", F.col("t")).otherwise(
        F.regexp_replace("t", pattern, order)))
    prefix, _, middle = _parts(F.col("output"), F.col("form"))
    return made.select("row.*", "n", "form", "output",
                       F.when(F.col("form") != "plain", F.char_length(prefix)).cast("long").alias("prefix_chars"),
                       F.when(F.col("form") != "plain", F.char_length(middle)).cast("long").alias("middle_chars"))


def _parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """(prefix, suffix, middle) of an output that is not plain."""
    psm, size = form == "psm", len(PREFIX)
    second = F.when(psm, F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one = F.substring(output, F.lit(size + 1), second - 1 - size)
    two = F.substring(output, second + size, third - second - size)
    middle = F.substring(output, third + size, F.char_length(output))
    return F.when(psm, one).otherwise(two), F.when(psm, two).otherwise(one), middle


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form."""
    prefix, suffix, middle = _parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


#: The same in DuckDB, without regular expressions: lines from a split at line feeds.
ORACLE_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
l AS (
    SELECT *, string_split(text, chr(10)) AS line,
           (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (right(text, 1) = chr(10))::INT END)::BIGINT AS n,
           [('0x' || substr(digest, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h
    FROM t),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100
                THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM l),
e AS (
    SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(text)
                   ELSE length(array_to_string(line[1:a], chr(10))) + 1 END AS x,
              CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(text)
                   ELSE length(array_to_string(line[1:b], chr(10))) + 1 END AS y
    FROM c),
o AS (
    SELECT *, CASE form
        WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || substr(text, 1, x) || '<S>' || substr(text, y + 1) || '<M>' || substr(text, x + 1, y - x)
        ELSE '<S>' || substr(text, y + 1) || '<P>' || substr(text, 1, x) || '<M>' || substr(text, x + 1, y - x) END AS output
    FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (y - x)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
