"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text, hashed to ``SLOTS`` slots: its words, the shapes of its
words (case, digits and marks, runs as one), and four figures in steps (how
many words, how many of them distinct, how many lines repeat, how many words
follow themselves). The fit takes at most ``max_labelled`` labelled rows (those with the smallest hash of their
id; copies count once), weighs terms by (1 + ln tf) * idf, and keeps the
``RANK`` leading right singular vectors of that matrix: a text's latent
vector is its weighted terms times those. The labelled vectors are broadcast
(a fixed bound: ``max_labelled`` * ``RANK`` numbers), and every text's cosine
with each of them is computed exactly, in blocks of ``BLOCK`` texts. The
``k`` nearest labels vote with their cosine as weight.

Nulls, ties and edge cases: a null or empty text has the terms of its figures
alone; neighbours as near as the k-th (to five digits) all vote; a text
without any neighbour of positive cosine, or a fit without labelled rows, gets
the labelled share of ones (0.5 without labels); null labels, labels other
than 0 and 1 and labels of null ids are left out; a repeated row is scored as
often as it is given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.decontaminate import SEPARATOR
from wardstats.llm.hashing import SPACE, Texts, mix, slices, words
from wardstats.llm.scratch import stored

SLOTS, RANK, NEIGHBOURS = 1 << 16, 48, 15
#: What a figure counts for, a word that occurs once being 1.
EMPHASIS = 6.0
#: Labelled rows that a fit reads at most.
MAX_LABELLED = 8192
#: Texts whose cosines a task holds at a time; matrix entries multiplied at a time.
BLOCK, ENTRIES = 256, 1 << 16

_U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("x")
_NEWLINE = np.arange(256) == 10
_SHAPE[65:91], _SHAPE[48:58], _SHAPE[SPACE] = ord("X"), ord("9"), 32


def _counted(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, tf = np.unique(of * np.int64(SLOTS) + key, return_counts=True)
    return pair // SLOTS, pair % SLOTS, tf


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + _U(kind)) >> _U(20) & _U(SLOTS - 1)).astype(np.int64)


def weighted_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, 1 + ln tf), sorted by text."""
    rows = len(texts)
    h, _, _, first = words(texts, SEPARATOR)
    of = np.repeat(np.arange(rows), np.diff(first))
    total = np.diff(first)
    distinct = np.bincount(np.unique(np.stack([of.astype(_U), h]), axis=1)[0].astype(np.int64), minlength=rows) if len(h) else np.zeros(rows, np.int64)
    shape = _SHAPE[texts.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    left = np.append(0, np.cumsum(keep))[texts.offsets]
    s, _, _, begin = words(SimpleNamespace(data=shape[keep], offsets=left), SPACE, lower=False)
    again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=rows)
    lines, _, _, at = words(texts, _NEWLINE)
    line_of = np.repeat(np.arange(rows), np.diff(at))
    lone = np.bincount(np.unique(np.stack([line_of.astype(_U), lines]), axis=1)[0].astype(np.int64), minlength=rows) if len(lines) else np.zeros(rows, np.int64)
    size = np.maximum(total, 1)
    figures = np.stack([np.log2(total + 1).astype(np.int64), 10 * distinct // size, 10 * (np.diff(at) - lone) // np.maximum(np.diff(at), 1), (20 * again + size - 1) // size], 1)
    figures = mix((figures + np.array([0, 100, 200, 300])).astype(_U)).ravel()
    parts = [_counted(of, _slot(h, 1)), _counted(np.repeat(np.arange(rows), np.diff(begin)), _slot(s, 2)), _counted(np.repeat(np.arange(rows), 4), _slot(figures, 3))]
    text, slot, tf = (np.concatenate(x) for x in zip(*parts))
    value = 1 + np.log(tf)
    value[len(tf) - len(parts[2][2]):] *= EMPHASIS
    order = np.argsort(text, kind="stable")
    return text[order], slot[order], value[order].astype(np.float32)


def product(rows: int, of: np.ndarray, at: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The sparse matrix of (of, at, value), sorted by ``of``, times ``dense``."""
    out = np.zeros((rows, dense.shape[1]), dense.dtype)
    for a in range(0, len(of), ENTRIES):
        o = of[a:a + ENTRIES]
        head = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        out[o[head]] += np.add.reduceat(dense[at[a:a + ENTRIES]] * value[a:a + ENTRIES, None], head, axis=0)
    return out


def singular_vectors(rows: int, of: np.ndarray, at: np.ndarray, value: np.ndarray, columns: int, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns x rank) by subspace
    iteration from a fixed start."""
    order = np.argsort(at, kind="stable")
    across = of[order], at[order], value[order]
    basis = np.random.default_rng(11).normal(size=(columns, rank + 8))
    for _ in range(4):
        left = np.linalg.qr(product(rows, of, at, value, basis))[0]
        basis = np.linalg.qr(product(columns, across[1], across[0], across[2], left))[0]
    small = product(rows, of, at, value, basis)
    return basis @ np.linalg.svd(small, full_matrices=False)[2].T[:, :rank]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


@dataclass
class Voters:
    """``basis``: slots to latent vectors, with their idf; ``vectors`` and
    ``labels``: the labelled rows; ``share``: of ones among them."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float
    k: int

    def place(self, rows: int, of: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        return _unit(product(rows, of, slot, value, self.basis))

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.share)
        k = min(self.k, len(self.labels))
        for a in range(0, len(vectors) if k else 0, BLOCK):
            near = np.round(vectors[a:a + BLOCK] @ self.vectors.T, 5)
            least = np.partition(near, -k, axis=1)[:, -k:].min(1, keepdims=True)
            weight = np.where((near >= least) & (near > 0), near, 0)
            total = weight.sum(1, dtype=np.float64)
            out[a:a + BLOCK] = np.divide((weight * self.labels).sum(1, dtype=np.float64), total, out=out[a:a + BLOCK].copy(), where=total > 0)
        return out.clip(0, 1)


def voters(rows: int, of: np.ndarray, slot: np.ndarray, value: np.ndarray, label: np.ndarray, k: int = NEIGHBOURS, rank: int = RANK) -> Voters:
    """Fitted on the weighted terms of ``rows`` labelled texts."""
    share = float(label.mean()) if rows else 0.5
    idf = np.log((1 + rows) / (1 + np.bincount(slot, minlength=SLOTS)))
    value = value * idf[slot]
    size = np.sqrt(np.bincount(of, value ** 2, rows))
    used, column = np.unique(slot, return_inverse=True)
    basis = np.zeros((SLOTS, rank), np.float32)
    if len(used):
        right = singular_vectors(rows, of, column, value / np.maximum(size, 1e-9)[of], len(used), min(rank, rows, len(used)))
        basis[used, :right.shape[1]] = right * idf[used, None]
    plain = Voters(basis, np.zeros((0, rank), np.float32), np.zeros(0, np.float32), share, k)
    plain.vectors = plain.place(rows, of, slot, (value / np.maximum(idf[slot], 1e-9)).astype(np.float32))
    plain.labels = label.astype(np.float32)
    return plain


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, k: int = NEIGHBOURS) -> Voters:
    """Voters from labelled rows (ids and labels 0 or 1 in ``labels``)."""
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id", "label").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "_id").select("text", "label")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, slot, value = weighted_terms(Texts(batch.column(0)))
            cut = np.searchsorted(of, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x.tobytes() for x in np.split(y, cut)], pa.binary()) for y in (slot.astype(np.int32), value))], names=["label", "slots", "weights"])

    # copies count once: their terms agree
    found = rows.mapInArrow(terms, "label int, slots binary, weights binary").groupBy(F.xxhash64("slots", "weights").alias("same"), "label").agg(F.first("slots").alias("slots"), F.first("weights").alias("weights"))
    got = stored(found, "labelled").orderBy("same", "label").limit(max_labelled).toArrow()
    slots, weights = ([np.frombuffer(x, t) for x in got[c].to_pylist()] for c, t in (("slots", np.int32), ("weights", np.float32)))
    of = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return voters(len(slots), of, flat(slots, np.int64), flat(weights, np.float64), got["label"].to_numpy(), k)


def judge(docs: DataFrame, fitted: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, slot, value = weighted_terms(Texts(batch.column(1)))
            vectors = shared.value.place(batch.num_rows, of, slot, value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.vote(vectors))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
