"""A small table with every awkward row, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars int, score string, k string, n int, "
           "fp string, item_id string, length string, at string, node string")


def prose(rnd, n, letters="etaoinshrdlu"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n))


def texts():
    """(doc_id, text, lang): copies, near copies, shared passages, nulls, empty, blank and very long texts."""
    rnd = random.Random(17)
    shared = prose(rnd, 60)
    out = [(0, prose(rnd, 80), "en"), (1, None, None), (2, "", "en"), (3, " \n\t ", "fr"), (4, "123 456 !!!", "de"),
           (5, prose(rnd, 30) + " " + shared + " " + prose(rnd, 30), "en"),
           (6, shared + " " + prose(rnd, 10), "en"), (7, prose(rnd, 12) + shared, "en"),
           (8, "a" * 3000, "en"), (9, "ab" * 700 + "x", "en"), (10, prose(rnd, 20_000), "en"),
           (11, "A" * 130_000, "fr"), (12, "mail me: jo.doe@example.org, +49 (30) 123-4567 or 4111 1111 1111 1111; 10.0.0.255 "
                                       "1.2.3.4.5 300.1.1.1 a@b a@b.c_d@e.f", "en"),
           (13, "École naïve café — “ﬁn” ½ 中文字 İstanbul ΣΑΣ <|endoftext|> é", "fr"),
           (14, "don't  stop\n\nnow 's   x\x1cy", "en")]
    base = prose(rnd, 200)
    out += [(20 + i, base, "en") for i in range(5)]
    for i in range(6):
        words = base.split()
        words[rnd.randrange(200)] = "changed"
        out.append((30 + i, " ".join(words), "en"))
    out += [(40 + i, prose(rnd, 60, "äöüßchgn"), "de") for i in range(12)] + [
        (60 + i, prose(rnd, 60, "éèàuqoirl"), "fr") for i in range(12)]
    return out


def rows():
    """The texts with clashing extra columns, one row repeated and one id null twice."""
    out = [(i, t, lang, f"s{(i or 0) % 3}", None if t is None else len(t), "x", "y", 7, "z", "q", "l", "a", "b")
           for i, t, lang in [*texts(), texts()[5], (None, "no id here", "en"), (None, "no id here", None)]]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS)


def folder(spark, tmp_path, some=None):
    """A folder of tables like the given ones."""
    d = str(tmp_path)
    docs = frame(spark, some)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) AS quality", "0 AS toxic")
    labels.distinct().write.parquet(f"{d}/labels.parquet")
    bench = [(0, " ".join(texts()[5][1].split()[30:60]), "x"), (1, prose(random.Random(5), 30), "x"), (2, None, "x"),
             (3, "", "x"), (4, "too short", "x")]
    spark.createDataFrame(bench, "item_id long, text string, coverage string").write.parquet(f"{d}/benchmark.parquet")
    return d


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15)]


def personal(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS)
                  for m in re.finditer(p, text or "") if ok(m[0]))


def covered(all_texts, length):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in all_texts]
    seen = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if mark[i] and not (i and mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(t, mark) if not m)).hexdigest()))
    return out


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def classes(prints, bits):
    """Index of the class of each fingerprint: all within `bits` are linked."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words_covered(all_texts, length):
    """(words, removed, sha256 of the rest) of each text."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in all_texts]
    seen = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        mark = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                mark[i:i + length] = b"\1" * length
        kept = " ".join(x for x, m in zip(w, mark) if not m)
        out.append((len(w), sum(mark), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def resampled(docs, target):
    """(id, features, weight, score, rank) of (id, text) rows, straight from the definition."""
    def buckets(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [zlib.crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    own = [buckets(t) for _, t in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * (big_s + 10000) / (float(s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for (i, _), f in zip(docs, own):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[:len(order) * 10 // 100], 1):
        r[4] = rank
    return [tuple(r) for r in rows]


def filled(i, text):
    """(n, form, prefix, middle, output) of one document."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"
