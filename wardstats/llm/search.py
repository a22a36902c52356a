"""Ranked lexical search by an Aho-Corasick scan of the documents.

1. The items' distinct terms become one automaton; each stands between two
   spaces there, and so does each term of a text, so that only whole terms
   match. Items come in blocks of about ``BLOCK_BYTES`` of text (an item's
   rows stay together), which bounds what is broadcast; each block is a pass
   of its own over all documents. Nothing of a document is indexed.
2. A first scan counts documents, their terms and, for each term, the
   documents that hold it; partial counts are summed in Spark.
3. A second scan counts each term in each text, maps the automaton's outputs
   to the items that ask for the term, and keeps per task and item the ``k``
   best documents (ties at the end by id). Those meet in two steps, first per
   item and salt, then per item, so that no item's candidates meet in one
   task all at once.

Score of a document: sum over the item's terms, repeats included, of
w * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, with
w = floor(1000 ln((2N + 2) / (2 df + 1))): 64-bit integers throughout.

Nulls, ties and edge cases: a null or empty text has no terms, is no document
for N and is found by nothing; an item without terms has no rows; rows of one
``item_id`` (null is one too) are one item with the terms of all of them; each
repeated document row counts and is ranked for itself; equal scores rank by
ascending id, null ids last; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstats.llm.hashing import LOWER, Texts, slices
from wardstats.llm.scratch import stored

#: Item text of a block; cells (documents x items) that a task scores at a
#: time; candidates it holds before it keeps the best; salts of an item.
BLOCK_BYTES, CELLS, HELD, SALTS = 1 << 20, 1 << 20, 1 << 17, 64

_GAP = 32
_TERM = np.full(256, _GAP, np.uint8)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = LOWER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]]
_automata: dict[str, ahocorasick.Automaton] = {}


def guarded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, a space around each and in place of each byte that
    is of no term; and where the space before each text is."""
    return np.insert(_TERM[texts.data], texts.offsets, _GAP), texts.offsets + np.arange(len(texts.offsets))


def _automaton(key: str, terms: list[str]) -> ahocorasick.Automaton:
    """Built once in each worker process; that of the last block stays."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            made.add_word(f" {t} ", i)
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def count_terms(texts: Texts, key: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, term, tf) of those of the automaton."""
    data, gap = guarded(texts)
    inside = data != _GAP
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    n = np.diff(np.searchsorted(starts, gap))
    hits = _automaton(key, terms).iter(data.tobytes().decode("latin-1"))
    end, term = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2).T
    pair, tf = np.unique((np.searchsorted(gap, end) - 1) * len(terms) + term, return_counts=True)
    return n, pair // len(terms), pair % len(terms), tf


def _tally(docs: DataFrame, key: str, shared) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df, over all documents."""
    size = len(shared.value)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in slices(batches, "text"):
            n, _, term, _ = count_terms(Texts(batch.column(0)), key, shared.value)
            total[:size] += np.bincount(term, minlength=size)
            total[size:] += ((n > 0).sum(), n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = docs.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 2, np.int64)
    total[got["cell"].to_numpy()] = got["n"].to_numpy()
    return int(total[size]), int(total[size + 1]), total[:size]


def _best(item: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's ``k`` first by score, then id (None last)."""
    null = np.array([x is None for x in ids], bool) if ids.dtype == object else np.zeros(len(ids), bool)
    by_id = np.zeros(len(ids), np.int64)
    by_id[~null] = np.unique(ids[~null], return_inverse=True)[1]
    order = np.lexsort((by_id, null, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array([*column.to_pylist(), None], object)[:-1]


def _answer(docs: DataFrame, items: list, asks: list[Counter], terms: list[str], item_field, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task for each item."""
    spark, key = docs.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(terms)
    documents, length, df = _tally(docs, key, shared)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    place = {t: i for i, t in enumerate(terms)}
    links = np.array(sorted((place[t], i, c) for i, ask in enumerate(asks) for t, c in ask.items()), np.int64).reshape(-1, 3)
    bounds = np.searchsorted(links[:, 0], np.arange(len(terms) + 1))
    model = spark.sparkContext.broadcast((weight, links[:, 1:], bounds, items))
    doc_kind, item_kind = docs.schema["doc_id"].dataType, item_field.dataType
    schema = f"item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, link, bound, names = model.value
        floor = np.ones(len(names), np.int64)
        item, score, ids, kind, waiting = [], [], [], None, 0

        def settle() -> None:
            nonlocal waiting
            all_ = np.concatenate(item), np.concatenate(score), np.concatenate([x.astype(object) for x in ids]) if any(x.dtype == object for x in ids) else np.concatenate(ids)
            kept = _best(*all_, k)
            for held, x in zip((item, score, ids), all_):
                held[:] = [x[kept]]
            waiting = len(kept)
            at, first, times = np.unique(item[0], return_index=True, return_counts=True)
            full = times == k
            floor[at[full]] = score[0][first[full] + k - 1]

        for batch in slices(batches, "text"):
            kind = batch.column(0).type
            names_of = _ids(batch.column(0))
            n, doc, term, tf = count_terms(Texts(batch.column(1)), key, shared.value)
            m = np.array([75 + 25 * x * documents // max(length, 1) for x in n.tolist()], np.int64)
            value = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            step = max(1, CELLS // max(len(names), 1))
            for a in range(0, len(n), step):
                x, y = np.searchsorted(doc, (a, a + step))
                many = bound[term[x:y] + 1] - bound[term[x:y]]
                each = np.repeat(np.arange(x, y), many)
                ask = link[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bound[term[x:y]], many)]
                cells = np.zeros((min(step, len(n) - a), len(names)), np.int64)
                np.add.at(cells, (doc[each] - a, ask[:, 0]), value[each] * ask[:, 1])
                d, i = np.nonzero(cells >= floor)
                item.append(i), score.append(cells[d, i]), ids.append(names_of[a + d])
                waiting += len(d)
                if waiting > HELD:
                    settle()
        if waiting:
            settle()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item[0]], pa_kind), pa.array(ids[0].tolist(), kind), pa.array(score[0])], names=["item_id", "doc_id", "score"])

    pa_kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(item_kind.simpleString(), pa.string())
    found = docs.select("doc_id", "text").mapInArrow(search, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item: item_id, rank (from 1), doc_id and score of its ``k`` best
    documents with a score above 0. Item ids are integers or strings."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        data, gap = guarded(Texts(rows["text"].combine_chunks()))
        asks: dict = {}
        for name, a, b in zip(rows["item_id"].to_pylist(), gap[:-1], gap[1:]):
            asks.setdefault(name, Counter()).update(data[a:b].tobytes().decode("latin-1").split(" "))
        asks = {name: Counter({t: c for t, c in ask.items() if t}) for name, ask in asks.items()}
        asks = {name: ask for name, ask in asks.items() if ask}
        if asks:
            out.append(stored(_answer(docs, list(asks), list(asks.values()), sorted(set().union(*asks.values())), items.schema["item_id"], k), "ranked"))
    none = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return reduce(DataFrame.unionByName, out or [none])
