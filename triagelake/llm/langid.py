"""Language identification by words first, character n-grams for unseen words.

A known word adds its log frequency in each language. An unseen word adds the
mean over its positions of the longest known n-gram that starts there, from
`order` characters down to one, each step down costing a fixed factor.

Rows: a null text and a text without a letter are `und` with score 0. Ties go to
the alphabetically first language. Repeated rows are predicted each; other columns
are not read. With no training row every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow

UNDETERMINED = "und"
ORDER = 4
BACKOFF = float(np.log(0.4))
SAMPLE_ROWS = 20_000          # bound of the labelled rows that the model is fitted on
WORDS, GRAMS = 40_000, 10_000 # bounds of the model's tables, for each language
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def _grams(word: str, order: int) -> set[str]:
    """n-grams of a word, each once, so that one endless word has no more weight than its kinds of grams."""
    padded = f"<{word}>"
    return {padded[i:i + n] for n in range(1, order + 1) for i in range(len(padded) - n + 1)}


def _counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, kind, item, n): words (kind 0) and n-grams of the words (kind n) by language."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])

    def rows(words: Counter) -> pa.RecordBatch:
        grams: Counter = Counter()
        for (lang, w), n in words.items():
            for g in _grams(w, order):
                grams[lang, g] += n
        out = [(lang, 0, w, n) for (lang, w), n in words.items()]
        out += [(lang, len(g), g, n) for (lang, g), n in grams.items()]
        return batch(schema, *zip(*out, strict=True)) if out else batch(schema, [], [], [], [])

    def run(batches: Batches) -> Batches:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    seen[lang, w] += n
            if len(seen) > _FLUSH:
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    return map_arrow(train, run, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language of words and n-grams; its tables are bounded by WORDS and GRAMS."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int],
                 gram_rows: np.ndarray, order: int):
        self.langs, self.words, self.word_rows, self.order = langs, words, word_rows, order
        self.grams, self.gram_rows = grams, gram_rows

    def tables(self) -> tuple:
        return self.langs, self.words, self.word_rows, self.grams, self.gram_rows, self.order

    def back_off(self, words: list[str]) -> np.ndarray:
        """For each unseen word the mean over its positions of the longest known n-gram there, less what steps down cost."""
        known, none = self.grams.get, len(self.gram_rows)
        found, starts, steps, sizes = [], [], [], []
        lengths = list(enumerate(range(self.order, 0, -1)))
        for w in words:
            padded, cost = f"<{w}>", 0
            starts.append(len(found))
            for i in range(len(padded)):
                for step, n in lengths:
                    # Near the end a slice is a shorter n-gram already.
                    at = known(padded[i:i + n])
                    if at is not None:
                        found.append(at)
                        cost += max(step, self.order - len(padded) + i)
                        break
            found.append(none)                      # a row of zeros, so that no word is without any
            steps.append(cost)
            sizes.append(len(padded))
        rows = np.concatenate([self.gram_rows, np.zeros((1, len(self.langs)))])
        sums = np.add.reduceat(rows[found], starts) if words else np.zeros((0, len(self.langs)))
        return (sums + np.array(steps)[:, None] * BACKOFF) / np.array(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability under equal priors."""
        known, base, unseen, at = self.words.get, len(self.word_rows), {}, []
        for text in texts:
            words = words_of(text) if text else []
            if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
                at.append(None)
                continue
            rows = list(map(known, words))
            if None in rows:
                rows = [unseen.setdefault(w, base + len(unseen)) if i is None else i
                        for w, i in zip(words, rows, strict=True)]
            at.append(np.array(rows))
        table = np.concatenate([self.word_rows, self.back_off(list(unseen))]) if unseen else self.word_rows
        out = []
        for rows in at:
            if rows is None:
                out.append((UNDETERMINED, 0.0))
                continue
            total = table[rows].sum(0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def _table(langs: list[str], rows: list) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies by kind and language; what a language lacks has one floor in all languages.

    The floor is a tenth of one occurrence in the language with the most, so that
    a language is not preferred for having been seen less.
    """
    column = {lang: i for i, lang in enumerate(langs)}
    at: dict[str, int] = {}
    counts = np.zeros((len({r["item"] for r in rows}), len(langs)))
    kinds = np.zeros(len(counts), np.int64)
    for r in rows:
        i = at.setdefault(r["item"], len(at))
        counts[i, column[r["lang"]]] += r["n"]
        kinds[i] = r["kind"]
    for kind in np.unique(kinds):
        total = counts[kinds == kind].sum(0)
        counts[kinds == kind] /= np.maximum(total, 1)
        counts[kinds == kind] += 0.1 / total.max()
    return at, np.log(counts)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
        order: int = ORDER, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Fit on labelled rows; beyond `sample_rows` of them, on a sample of that expected size.

    The sample is drawn by row, so copies of a text are thinned like others. Each language has
    tables of its own size: a large one does not crowd out a rare one.
    """
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = train.count()
    if n > sample_rows:
        row = F.xxhash64(text_col, lang_col, F.monotonically_increasing_id())
        train = train.where(F.pmod(row, F.lit(1_000_000)) < 1_000_000 * sample_rows // n)
    counts = _counts(train.select(lang_col, text_col), order).persist()
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())

    def most(kind: str, limit: int) -> list:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "kind", "item")
        top = counts.where(kind).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit) \
            .select("kind", "item").distinct()
        return counts.join(F.broadcast(top), ["kind", "item"]).select("lang", "kind", "item", "n").collect()

    model = Model(langs, *_table(langs, most("kind = 0 and n > 1", words)),
                  *_table(langs, most("kind > 0", grams)), order)
    counts.unpersist()
    return model




def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of `keep`, lang_pred, score) of every row."""
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), *[(c, arrow_type(docs, c)) for c in keep],
                        ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model.tables())

    def run(batches: Batches) -> Batches:
        m = Model(*shared.value)
        for b in batches:
            out = m.predict(b.column(b.num_columns - 1).to_pylist())
            yield batch(schema, *b.columns[:-1], [o[0] for o in out], [o[1] for o in out])

    return map_arrow(docs.select(id_col, *keep, F.col(text_col).alias("_t")), run, schema)
