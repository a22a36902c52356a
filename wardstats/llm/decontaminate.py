"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words under the ones of a fixed mask; words under
its zeros are ignored, so a hit survives substitutions there. Seeds of the
benchmark and of the documents are joined, each hit names an alignment
(document, item, diagonal), and the words of document and item along that
diagonal are compared: the longest run in which at least ``density`` of the
words agree is an overlap if it has ``min_words`` words (or all words of a
shorter item).

Before the join, document seeds are tested against a bitmap of the benchmark
seeds (a semi-join filter of bounded size: it saturates for huge benchmarks,
then more rows reach the join, and results stay the same).

Words: maximal runs of ASCII letters and digits (A-Z as a-z) and non-ASCII
characters. Nulls, ties and edge cases: null or empty texts and items have no
words and no overlap; rows without an id can't be named in the result and are
left out of it; repeated rows give the rows of one; an item with fewer words
than a mask is searched as a whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.hashing import Texts, mix, signed, slices, words
from wardstats.llm.scratch import row_key, scope, sized, stored

#: Which words of a window a seed looks at.
MASKS = ("111111", "1101111", "11101011", "110110011")
#: Largest bitmap of benchmark seeds (slots of one byte).
BITMAP_SLOTS = 1 << 26

SEPARATOR = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    SEPARATOR[_a:_b] = False

_U = np.uint64


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of all windows that lie in one text, and their first words
    (as indices of ``h``)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.full(n, int(mask, 2), _U)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += h[i:i + n] * (mix(np.array([i + 1], _U))[0] | _U(1))
    last = np.repeat(first[1:], np.diff(first))[:n] if first[0] == 0 else None
    at = np.flatnonzero(np.arange(n) + len(mask) <= last)
    return mix(out[at]), at


def _seed_table(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(seed, item_id, at): the seeds of all items; an item shorter than the
    longest mask also has its whole word sequence as one seed."""
    longest = max(map(len, masks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(Texts(batch.column(1)), SEPARATOR)
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            parts = [(s, at) for s, at in (seeds(h, first, m) for m in masks)]
            for a, b in zip(first[:-1], first[1:]):
                if 0 < b - a < longest and "1" * int(b - a) not in masks:
                    s, _ = seeds(h[a:b], np.array([0, b - a]), "1" * int(b - a))
                    parts.append((s, np.array([a])))
            s, at = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(signed(s)), batch.column(0).take(pa.array(of[at])), pa.array((at - first[of[at]]).astype(np.int32))], names=["seed", "item_id", "at"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(cut, f"seed bigint, item_id {kind}, at int")


def _bitmap(seed_table: DataFrame, rows: int) -> np.ndarray:
    slots = 1 << min(BITMAP_SLOTS, max(1 << 16, 32 * rows)).bit_length() - 1
    hit = np.zeros(slots, bool)
    for r in seed_table.select(F.col("seed").bitwiseAND(F.lit(slots - 1)).alias("s")).distinct().toLocalIterator():
        hit[r["s"]] = True
    return hit


def _word_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, words): the word hashes of each text as bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(Texts(batch.column(1)), SEPARATOR)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=[key, "words"])

    return rows.mapInArrow(cut, f"{key} {rows.schema[key].dataType.simpleString()}, words binary")


def best_run(agree: np.ndarray, density: float) -> tuple[int, int]:
    """The longest run [a, b) with at least ``density`` of its words agreeing,
    without disagreeing words at its ends (the first of equally long ones)."""
    if not agree.any():
        return 0, 0
    gain = np.concatenate([[0.0], np.cumsum(np.where(agree, 1.0 - density, -density))]).round(9)
    low = np.minimum.accumulate(np.where(agree, gain[:-1], np.inf))
    ends = np.flatnonzero(agree) + 1
    begin = np.searchsorted(-low, -gain[ends], side="left")  # the first agreeing word not above the end's gain
    longest = int(np.argmax(ends - begin))
    return int(begin[longest]), int(ends[longest])


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = 13,
             density: float = 0.75, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All verified overlaps: doc_id, item_id, first_word and item_word (where
    the overlap starts in document and item, words from 0), n_words,
    n_matched, item_words (the item's length)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id IS NOT NULL")
    seed_table = stored(_seed_table(items, masks).distinct(), "seeds")
    hit = docs.sparkSession.sparkContext.broadcast(_bitmap(seed_table, seed_table.count()))
    longest = max(map(len, masks))
    short = sorted({r["n"] for r in items.select(F.size(F.expr("array_remove(split(text, '[^0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]+'), '')")).alias("n")).where(f"n < {longest} AND n > 0").distinct().collect()})
    kinds = (*masks, *(m for m in ("1" * n for n in short) if m not in masks))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hit.value
        for batch in slices(batches, "text"):
            h, _, _, first = words(Texts(batch.column(1)), SEPARATOR)
            if not len(h):
                continue
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for mask in kinds:
                s, at = seeds(h, first, mask)
                keep = known[s & _U(len(known) - 1)]
                s, at = s[keep], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s)), batch.column(0).take(pa.array(of[at])), pa.array((at - first[of[at]]).astype(np.int32))], names=["seed", "doc_id", "doc_at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(find, f"seed bigint, doc_id {kind}, doc_at int")
    aligned = stored(found.join(sized(seed_table, 40), "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct(), "aligned")
    item_words = stored(_word_rows(items, "item_id"), "items").withColumn("item_words", (F.length("words") / 8).cast("int"))
    spans = aligned.join(sized(item_words.select("item_id", "item_words"), 32), "item_id").select(
        "doc_id", "item_id", "diagonal", "item_words").distinct()
    per_doc = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "item_words")).alias("spans")), "spans")
    named = docs.join(sized(per_doc, 256), "doc_id").select("doc_id", "text", F.col("spans.diagonal").alias("d"), F.col("spans.item_words").alias("n"), F.col("spans.item_id").alias("item"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, _, _, first = words(Texts(batch.column(1)), SEPARATOR)
            rows, at, text = [], [], []
            for i, (ds, ns) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for d, n in zip(ds, ns):
                    a, b = max(0, d), min(int(first[i + 1] - first[i]), d + n)
                    rows.append(i)
                    at.append(a)
                    text.append(h[first[i] + a:first[i] + max(a, b)].tobytes())
            flat = batch.column(4).flatten()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), flat, batch.column(2).flatten(), pa.array(at, pa.int32()), pa.array(text, pa.binary())], names=["doc_id", "item_id", "diagonal", "doc_at", "doc_words"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    sides = named.mapInArrow(read, f"doc_id {kind}, item_id {item_kind}, diagonal int, doc_at int, doc_words binary").join(sized(item_words, 1024), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (d, at, mine, its) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))):
                mine, its = np.frombuffer(mine, _U), np.frombuffer(its, _U)
                its_part = its[at - d:at - d + len(mine)]
                agree = mine == its_part
                a, b = best_run(agree, density)
                if b - a >= min(min_words, len(its)) > 0:
                    out.append((i, at + a, at - d + a, b - a, int(agree[a:b].sum()), len(its)))
            cols = list(zip(*out)) or [()] * 6
            rows = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["doc_id", "item_id", "first_word", "item_word", "n_words", "n_matched", "item_words"])

    out = f"doc_id {kind}, item_id {item_kind}, first_word int, item_word int, n_words int, n_matched int, item_words int"
    return sides.select("doc_id", "item_id", "diagonal", "doc_at", "doc_words", "words").mapInArrow(verify, out).distinct()


def best_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per (document, item): its longest overlap (ties: the one with
    more agreeing words, then the earliest)."""
    rows = overlaps(docs, benchmark, **options)
    rest = [c for c in rows.columns if c not in ("doc_id", "item_id")]
    by = (F.col("n_words").alias("size"), F.col("n_matched").alias("same"), (-F.col("first_word")).alias("early"))
    best = F.max(F.struct(*by, *rest)).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col(f"b.{c}").alias(c) for c in rest])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that overlap an item. Each row is judged by
    its own text, also where several share an id or have none."""
    with scope() as inner:
        keyed = docs.select(row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("text"))
        bad = inner.keep(stored(overlaps(keyed, benchmark, id_col="_key", **options).select(F.col("doc_id").alias("_key")).distinct(), "contaminated"))
    return docs.join(sized(bad, 64), row_key(id_col, text_col) == bad["_key"], "left_anti")
