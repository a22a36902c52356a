"""Spelling variants: words that differ by exactly one inserted, deleted or
replaced code point, and each word's more frequent form.

1. Words are counted over all texts: per batch in NumPy, then summed in Spark.
2. Asymmetric q-chunks: a word gives its two halves, disjoint chunks of which
   one edit leaves one whole; a word as long or one code point longer gives the
   positional grams that such a chunk can be: its head of that length, or its
   tail, which stands where the chunk stood or one further. The two meet by a
   hash of the chunk and its place, and the pair is verified in full.
3. A chunk that many words share is not paired: what it leaves of each word is
   halved again, and the words meet by the longer chunk, until groups are
   small or all but one code point is fixed (then a group is bounded by the
   alphabet). Nothing is dropped, and no frequent head pairs all its words.
4. Roots follow forms by pointer doubling; a form is twice as frequent at
   least, so chains are shorter than the logarithm of the largest count.

Runs are ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z as a-z. With ``slip`` a run
whose crc32 of ``<id>:<run>`` divides by it loses the code point crc32 mod its
length: a planted misspelling.

Nulls, ties and edge cases: a null or empty text has no words; a null id is
an empty one; repeated rows count as often as given; of equally frequent near
words the first in code-point order is the form; words of any length are
handled; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.hashing import LOWER, Texts, mix, slices, words
from wardstats.llm.scratch import sized, stored

#: Pairs that one chunk may try before it is cut again; text bytes counted at a time.
MOST_PAIRS, COUNT_BYTES = 1 << 12, 4 << 20

_U = np.uint64
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123), 0xC3]] = True
_GAP = np.zeros(256, bool)
_GAP[32] = True
#: Runs up to this many bytes get their crc32 all at once.
_LONG = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc_of_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, continued from the crc32 ``seed``."""
    order = np.argsort(start - end, kind="stable")
    a, size = start[order], (end - start)[order]
    state = ~seed[order]
    longest = int(np.searchsorted(-size, -_LONG))  # runs above _LONG bytes come first
    for i in range(_LONG):
        n = int(np.searchsorted(-size, -i))
        if n <= longest:
            break
        part = state[longest:n]
        state[longest:n] = _CRC[(part ^ data[a[longest:n] + i]) & 255] ^ part >> 8
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for j in range(longest):
        at = order[j]
        out[at] = zlib.crc32(data[start[at]:end[at]].tobytes(), int(seed[at]))
    return out


def count_words(ids: list[str], texts: Texts, least: int, slip: int | None) -> tuple[pa.Array, np.ndarray]:
    """Words of ``least`` code points or more and their counts."""
    data = texts.data
    inside = _PLAIN[data]
    inside[1:] |= data[:-1] == 0xC3
    data = np.where(inside, LOWER[data], 32).astype(np.uint8)
    h, start, end, first = words(SimpleNamespace(data=data, offsets=texts.offsets), _GAP, lower=False)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    doubles = np.append(0, np.cumsum(data == 0xC3))
    size = end - start - (doubles[end] - doubles[start])
    slipped: Counter[str] = Counter()
    kept = np.ones(len(h), bool)
    if slip and len(h):
        _, one, same = np.unique(mix(h + of.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        seed = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
        crc = crc_of_runs(data, start[one], end[one], seed[of[one]])
        hit = crc % slip == 0
        kept = ~hit[same]
        times = np.bincount(same, minlength=len(one))
        for at in np.flatnonzero(hit & (size[one] > least)):
            i = one[at]
            run = data[start[i]:end[i]].tobytes().decode()
            cut = int(crc[at]) % len(run)
            slipped[run[:cut] + run[cut + 1:]] += int(times[at])
    kept &= size >= least
    _, at, n = np.unique(h[kept], return_index=True, return_counts=True)
    at = np.flatnonzero(kept)[at]
    length = end[at] - start[at]
    stop = np.cumsum(length)
    gather = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length, length) + np.repeat(start[at], length)
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(0, stop).astype(np.int64).tobytes()), pa.py_buffer(data[gather].tobytes())]).cast(pa.string())
    return pa.concat_arrays([found, pa.array(list(slipped), pa.string())]), np.append(n, np.array(list(slipped.values()), np.int64))


def vocabulary(docs: DataFrame, least: int, at_least: int, slip: int | None) -> DataFrame:
    """(word, n): words of ``least`` code points that occur ``at_least`` times."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", COUNT_BYTES):
            word, n = count_words(batch.column(0).to_pylist(), Texts(batch.column(1)), least, slip)
            yield pa.RecordBatch.from_arrays([word, pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _cut(rows: DataFrame) -> DataFrame:
    """What ``head`` and ``tail`` leave of a word of ``size`` is halved: each
    row becomes two, with the one half fixed as well or the other."""
    half = "((size - head - tail) div 2)"
    more = F.expr(f"inline(array(struct(head + {half} AS h, tail AS t), struct(head AS h, tail + size - head - tail - {half} AS t)))")
    rows = rows.select("chunk", "size", "word", "n", more).withColumnsRenamed({"h": "head", "t": "tail"})
    return rows.withColumn("key", F.expr("xxhash64(size, head, tail, left(word, int(head)), right(word, int(tail)))"))


def near_words(counted: DataFrame, least: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs one edit apart."""
    size = F.length("word").cast("bigint")
    start = counted.select("word", "n", F.lit(0).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("tail"))
    asks = start.withColumn("size", size).withColumn("chunk", F.lit(True))
    # a gram's word is as long as the chunk's word, or one longer
    tells = start.withColumn("size", F.explode(F.array(size, size - 1))).where(F.col("size") >= least).withColumn("chunk", F.lit(False))
    rows, found = _cut(asks.unionByName(tells)), []
    while True:
        crowd = rows.groupBy("key").agg(F.count_if("chunk").alias("a"), F.count_if(~F.col("chunk")).alias("b"), F.min(F.col("size") - F.col("head") - F.col("tail")).alias("open"))
        hot = stored(crowd.where(f"a * b > {most_pairs} AND open > 1").select("key"), "hot")
        some = not hot.isEmpty()
        cold = rows.join(sized(hot, 16), "key", "left_anti") if some else rows
        x = cold.where("chunk").select("key", "size", F.col("word").alias("a"), F.col("n").alias("a_n"))
        y = cold.where("NOT chunk").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        pairs = x.join(y, "key").where("(length(b) > size OR a < b) AND abs(length(b) - length(a)) <= 1 AND levenshtein(a, b, 1) = 1")
        found.append(stored(pairs.select("a", "a_n", "b", "b_n"), "pairs"))
        if not some:
            break
        rows = _cut(stored(rows.join(sized(hot, 16), "key", "left_semi"), "crowded"))
    pairs = reduce(DataFrame.unionByName, found).distinct()  # an insertion between the halves keeps both
    return pairs.select(F.expr("inline(array(struct(a AS word, a_n AS n, b AS near, b_n AS near_n), struct(b AS word, b_n AS n, a AS near, a_n AS near_n)))"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        then = stored(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(docs: DataFrame, least: int = 5, at_least: int = 3, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text",
             most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per word: word, form (null without one), root, n, n_near, form_n."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = stored(vocabulary(docs, least, at_least, slip), "words")
    near = near_words(counted, least, most_pairs).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = stored(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.expr("CASE WHEN -best.less >= 2 * n THEN struct(best.near AS form, -best.less AS form_n) END").alias("to")), "near")
    told = told.select("word", F.col("to.form").alias("form"), "n", "n_near", F.col("to.form_n").alias("form_n"))
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
