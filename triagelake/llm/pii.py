"""Personal data: patterns first, then an information-theoretic sanitisation.

1. Base spans: e-mail addresses, IPv4 addresses, card numbers, phone numbers.
   Each distinct value found is a protected entity c.
2. Every word outside the base spans is a term t. Over all rows, n(c), n(t) and
   n(c, t) count sources with the entity, with the term, and with both, wherever they
   stand. A source is a row; rows with the same values in the same surroundings
   (copies, and near copies that differ elsewhere) are one, which has the words of all
   of them, and n(t) also counts words inside values. PMI(c; t) = log(N p(t|c) / n(t)) is what t tells
   about c, of the IC(c) = log(N / n(c)) there is to know. p(t|c) is the lower Wilson
   bound of n(c, t) / n(c) at `z` standard errors.
3. The share PMI / IC is the disclosure. It counts where there is evidence that c and t
   belong together: a likelihood-ratio test of their independence that holds over all
   pairs judged (at most `error` of all such tables have a false pair), or, as one
   source is none, a second sign: t is spelled out in the value, as in jo.doe@...
4. The largest disclosure over all entities is that of the term. From `generalise` on a
   term is replaced by a placeholder, from `remove` on it goes: everywhere, also in rows
   without the entity. Base spans stay.

Offsets are code points, ends exclusive. Rows: a null or empty text has no span.
Repeated rows are one source and get the same spans. Words of any length and texts
of any length are scanned in linear time. Other columns are kept by `sanitise`,
which replaces the text, and not read by `find`. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, fresh, map_arrow, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")        # order of equal starts
GENERALISED, REMOVED = "term", "removed"        # kinds of the method's own spans
Z, GENERALISE, REMOVE = 1.0, 0.8, 0.95
ERROR = 0.05                                    # chance of any pair by accident
AROUND = 40                                     # characters on both sides of a value that tell sources apart
SPELLED = 3                                     # letters of a word in a value that count as a sign
CACHE, CACHED = 100_000, 64                     # words a worker remembers, and their longest
BITS = 1 << 27                                  # of the filter of telling terms, at most

# The character classes of the four patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]                     # start, index of the kind, end


def _emails(text: str) -> list[Span]:
    """A match ends its local part at an @, so each @ has at most one, from the leftmost free character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[Span]:
    """Dotted runs are taken whole: a run with fewer than four parts has no match at any later start."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts):
            out.append((m.start(), 1, m.end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    return out


def _phones(text: str) -> list[Span]:
    return [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += _ips(text)
        out += _cards(text)
        if "+" in text:
            out += _phones(text)
    return sorted(out)


def _key(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def _free_words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of the words that lie outside all spans."""
    covered = sorted((s, e) for s, _, e in spans)
    free, i, reach = [], 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][0] < e:
            reach, i = max(reach, covered[i][1]), i + 1
        if s >= reach:
            free.append((s, e))
    return free


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_KEYS = pa.list_(pa.int64())
_PAIRS = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))


def _entity(text: str, span: Span) -> int:
    start, kind, end = span
    return _key(f"{kind}:{text[start:end].casefold()}")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _h, base, source, entities, terms, spelled) of every row, terms only where there are entities.

    _h tells texts of one id apart; spelled is (entity, term) of words in the local part of an address.
    """
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("_h", pa.int64()), ("base", _SPANS), ("source", pa.int64()),
                        ("entities", _KEYS), ("terms", _KEYS), ("spelled", _PAIRS)])
    names = _SPANS.value_type.names

    def run(batches: Batches) -> Batches:
        for b in batches:
            base, sources, entities, terms, spelled = [], [], [], [], []
            for text in b.column(2).to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(names, (KINDS[k], s, e), strict=True)) for s, k, e in spans])
                sources.append(_key("\0".join([text[max(0, s - AROUND):e + AROUND] for s, _, e in spans])))
                entities.append(list({_entity(text, span) for span in spans}))
                terms.append(list({_key(text[s:e].casefold()) for s, e in _free_words(text, spans)}) if spans else [])
                spelled.append([{"entity": c, "term": t} for c, t in {
                    (_entity(text, span), _key(w.casefold())) for span in spans if span[1] == 0
                    for w in _TERM.findall(text[span[0]:text.index("@", span[0])]) if len(w) >= SPELLED}])
            yield batch(schema, b.column(0), b.column(1), base, sources, entities, terms, spelled)

    text = text_or_empty(text_col)
    return map_arrow(docs.select(id_col, F.xxhash64(text).alias("_h"), text.alias("_t")), run, schema)


def term_frequencies(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(term, n_t): rows that hold each word, counted over all rows."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def rows(seen: Counter) -> pa.RecordBatch:
        return batch(schema, [_key(w) for w in seen], list(seen.values()))

    def run(batches: Batches) -> Batches:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update({w.casefold() for w in set(_TERM.findall(text))})
                if len(seen) > flush:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return map_arrow(docs.select(text_or_empty(text_col).alias("_t")), run, schema) \
        .groupBy("term").agg(F.sum("n").alias("n_t"))


def _likelihood_ratio(n: float, n_c: Column, n_t: Column, n_ct: Column) -> Column:
    """Twice the log of how much likelier the counts are if c and t are not independent."""
    def part(seen: Column, row: Column, col: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(0.0)

    return 2 * (part(n_ct, n_c, n_t) + part(n_c - n_ct, n_c, n - n_t) + part(n_t - n_ct, n - n_c, n_t)
                + part(n - n_c - n_t + n_ct, n - n_c, n - n_t))


def disclosures(docs: DataFrame, scanned: DataFrame, text_col: str = "text", z: float = Z,
                least: float = GENERALISE, error: float = ERROR) -> DataFrame:
    """(term, disclosure) of all terms that tell `least` or more about an entity, with evidence."""
    n = float(max(scanned.count(), 1))
    # Rows of a source have the same values; their words may differ. Copies of a text are counted once, with their number.
    texts = stored(scanned.where(F.size("entities") > 0).groupBy("source", "_h").agg(
        F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("entities", "terms", "spelled")]))
    sources = stored(texts.groupBy("source").agg(
        F.sum("m").alias("m"), F.min_by(F.struct("entities", "spelled"), "_h").alias("row")).select("source", "m", "row.*"))
    words = stored(texts.select("source", "m", F.explode("terms").alias("term")).groupBy("source", "term").agg(
        F.sum("m").alias("rows")).join(term_frequencies(docs, text_col), "term"))
    judged = words.groupBy("source").count().join(sources, "source").agg(
        F.sum(F.size("entities").cast("double") * F.col("count"))).first()[0] or 1.0
    # Entities of the same sources have the same counts, so one stands for all of them.
    held = sources.select("source", "m", F.explode("entities").alias("entity"))
    where = held.groupBy("entity").agg(
        F.count("*").alias("n_c"), F.sum("m").alias("m_c"), F.min("source").alias("low"), F.max("source").alias("high"),
        F.bit_xor("source").alias("xor"), F.sum(F.col("source").cast("decimal(20,0)")).alias("sum"))
    one = where.groupBy("n_c", "m_c", "low", "high", "xor", "sum").agg(F.min("entity").alias("entity"))
    n_c, n_ct = F.col("n_c").cast("double"), F.col("n_ct").cast("double")
    # A term in more sources than this tells less than `least` even if it is in every source of the entity.
    most = n * n_c / (n_c + z * z) * F.pow(n_c / n, F.lit(least)) * (1 + 1e-9)
    # Copies count in n_t as they do in n_ct: once.
    n_t = F.greatest(n_ct, F.col("n_t") - F.col("rows") + n_ct)
    both = words.join(held.join(one.select("entity", "n_c", "m_c"), "entity"), "source")
    pairs = both.where(F.col("n_t") - F.col("m_c") <= most).groupBy("entity", "term").agg(
        F.count("*").alias("n_ct"), F.sum("rows").alias("rows"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    evident = pairs.where((F.col("n_ct") > 1) & (_likelihood_ratio(n, n_c, n_t, n_ct) >= 2 * math.log(judged / error)))
    # The second sign needs the pairs of a value and its own words only, for every entity.
    own = sources.select("source", F.explode("spelled").alias("s")).select("source", "s.entity", "s.term").join(
        words, ["source", "term"]).groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.sum("rows").alias("rows"))
    signed = own.join(where.select("entity", "n_c"), "entity").join(words.select("term", "n_t").distinct(), "term")
    rate = n_ct / n_c
    bound = (rate + z * z / (2 * n_c) - z * F.sqrt(rate * (1 - rate) / n_c + z * z / (4 * n_c * n_c))) / (1 + z * z / n_c)
    known, told = F.log(n / n_c), F.log(n * bound / n_t)
    disclosure = F.when(known > 0, told / known).otherwise(F.lit(0.0)).alias("disclosure")
    return evident.select("term", disclosure).unionByName(signed.select("term", disclosure)) \
        .where(F.col("disclosure") >= least).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _filter(terms: DataFrame) -> bytes:
    """A bit map with two bits of each term set; of other words few have both, and a join finds those out."""
    size = min(BITS, 1 << max(16, (64 * terms.count()).bit_length()))
    low = F.col("term").bitwiseAND(F.lit(size - 1))
    high = F.shiftrightunsigned("term", 32).bitwiseAND(F.lit(size - 1))
    at = terms.select(F.explode(F.array(low, high)).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr(
        "shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, "<i8")
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _places(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _g, term, start, end): every place outside base spans of every word that passes the filter of the terms."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(terms))
    schema = pa.schema([("_id", arrow_type(docs, id_col)), ("_g", pa.int64()), ("term", pa.int64()),
                        ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Batches) -> Batches:
        bits, known = shared.value, {}
        mask = 8 * len(bits) - 1

        def passed(word: str) -> int | None:
            key = _key(word.casefold())
            i, j = key & mask, key >> 32 & mask
            return key if bits[i >> 3] >> (i & 7) & bits[j >> 3] >> (j & 7) & 1 else None

        for b in batches:
            rows, terms, starts, ends = [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                words = set(_TERM.findall(text))
                for w in [w for w in words if w not in known]:
                    if len(w) <= CACHED:
                        if len(known) >= CACHE:
                            known.clear()
                        known[w] = passed(w)
                hits = {w: k for w in words if (k := known[w] if w in known else passed(w)) is not None}
                for s, e in _free_words(text, base_spans(text)) if hits else ():
                    if (k := hits.get(text[s:e])) is not None:
                        rows.append(row)
                        terms.append(k)
                        starts.append(s)
                        ends.append(e)
            at = pa.array(rows, pa.int64())
            yield batch(schema, b.column(0).take(at), b.column(1).take(at), terms, starts, ends)

    text = text_or_empty(text_col)
    return map_arrow(docs.select(id_col, F.xxhash64(text).alias("_h"), text.alias("_t")), run, schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", z: float = Z,
         generalise: float = GENERALISE, remove: float = REMOVE, error: float = ERROR) -> DataFrame:
    """(id, _h, base, added) of every row: arrays of (kind, start, end), each sorted by start."""
    scanned = stored(_scan(docs, id_col, text_col))
    telling = stored(disclosures(docs, scanned, text_col, z, generalise, error))
    kind = F.when(F.col("disclosure") >= remove, REMOVED).otherwise(GENERALISED)
    # Repeated rows have equal spans, so one list for each (id, text) serves all of them.
    added = _places(docs, telling, id_col, text_col).join(telling.select("term", kind.alias("kind")), "term") \
        .groupBy("_id", "_g").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("_a"))
    joined = scanned.join(added, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    return joined.select(id_col, "_h", "base", F.coalesce(F.transform("_a", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.array()).alias("added"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_place(spans: Column) -> Column:
    """Spans by start, then base kinds as listed, then the method's own."""
    order = F.array(*[F.lit(k) for k in (*KINDS, GENERALISED, REMOVED)])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"),
        x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                 x["end"].alias("end")))


def replaced(text: str, spans: list[dict]) -> str:
    """The text with each span as its kind in brackets; removed terms vanish. Overlapping spans act as one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at:s["start"]], "" if s["kind"] == REMOVED else f"[{s['kind'].upper()}]"]
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with every span replaced in the text; null texts stay null."""
    found = find(docs, id_col, text_col, **thresholds)
    key, own, added = fresh(docs, "_id", "_g", "_spans")
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select(
        F.col(id_col).alias(key), F.col("_h").alias(own), F.concat("base", "added").alias(added)) \
        .dropDuplicates([key, own])
    keep, text = docs.columns, text_or_empty(text_col)
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(own)), "left")
    at = keep.index(text_col)
    schema = pa.schema([(c, arrow_type(docs, c)) for c in keep])

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = [replaced(t, s) if s else t for t, s in zip(
                b.column(at).to_pylist(), b.column(len(keep)).to_pylist(), strict=True)]
            cols = [*b.columns[:at], pa.array(texts, schema.field(at).type), *b.columns[at + 1:len(keep)]]
            yield batch(schema, *cols)

    return map_arrow(joined.select(*keep, added), run, schema)
