"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths of the most frequent pieces, the same
in every task: each task summarises its pieces in a bounded Misra-Gries summary,
summaries (never pieces) are merged, and the table has at most `entries` rows.
Tier two is a bounded cache of each worker, filled by the tokenizer. Pieces are
not shuffled, and the table decides about speed only: every count is the library's.

Rows: a null or empty text has no bytes and no tokens. Repeated rows are counted
each; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, stored, text_or_empty
from triagelake.llm.tokens import encoder, pieces

ENTRIES = 32_768
FAN_IN = 16


def _shrink(counts: Counter, entries: int) -> Counter:
    """Misra-Gries: take the count of the first piece left out from all; at most `entries` stay."""
    if len(counts) <= entries:
        return counts
    top = counts.most_common(entries + 1)
    least = top[-1][1]
    return Counter({p: n - least for p, n in top[:-1] if n > least})


def frequent_pieces(docs: DataFrame, text_col: str = "text", entries: int = ENTRIES) -> list[str]:
    """At most `entries` pieces; holds every piece with over 1/entries of all occurrences."""
    schema = pa.schema([("g", pa.int32()), ("s", pa.binary())])

    def summarise(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for line in pieces(text):
                    counts.update(line[1:])
            if len(counts) > 8 * entries:
                counts = _shrink(counts, entries)
        yield batch(schema, [TaskContext.get().partitionId()], [pickle.dumps(dict(_shrink(counts, entries)))])

    def merge(t: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for s in t.column("s"):
            counts.update(pickle.loads(s.as_py()))
            counts = _shrink(counts, 2 * entries)
        return pa.table({"g": [t.column("g")[0].as_py() // FAN_IN],
                         "s": [pickle.dumps(dict(_shrink(counts, entries)))]}, schema=schema)

    sums = stored(map_arrow(docs.select(text_or_empty(text_col).alias("_t")), summarise, schema))
    while sums.count() > 1:
        sums = stored(sums.groupBy(F.floor(F.col("g") / FAN_IN)).applyInArrow(merge, sums.schema))
    last = sums.first()
    return sorted(pickle.loads(last["s"])) if last else []


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 entries: int = ENTRIES) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    enc = encoder(tokenizer)
    frequent = {p: len(enc.lookup(p)) // enc.dtype.itemsize for p in frequent_pieces(docs, text_col, entries)}
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Batches) -> Batches:
        tier_one, cached = table.value.get, encoder(tokenizer)
        width = cached.dtype.itemsize
        feed = len(cached.encode_bytes("\n")) // width

        def tokens(text: str) -> int:
            lines = pieces(text)
            total = feed * (len(lines) - 1)
            for first, *rest in lines:
                found = list(map(tier_one, rest))
                if None in found:
                    found = [len(cached.lookup(p)) // width if n is None else n
                             for p, n in zip(rest, found, strict=True)]
                total += sum(found) + len(cached.lookup(first, led=False)) // width
            return total

        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(schema, b.column(0), b.column(2), [tokens(t) for t in texts])

    text = text_or_empty(text_col)
    return map_arrow(docs.select(id_col, text.alias("_t"), F.octet_length(text).cast("long").alias("_b")), run, schema)
