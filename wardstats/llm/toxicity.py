"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and byte prefixes of words, hashed to
``SLOTS`` slots. A term has a weight and a vector of ``RANK`` factors, a text
the logit bias + sum of weights + sum over pairs of the vectors' products, so
that two terms together can count for more (or less) than each alone.

The fit reads at most ``max_labelled`` labelled rows (those with the smallest
hash of their id); copies count once. All terms enter the machine whose
likelihood ratio (G squared) against the label reaches ``min_ratio``, over all
rows or over the rows that have a term of the first kind: there a term tells
that alone says nothing, such as the mention of a group beside an insult. So
do both terms of each pair that tells ``min_pair_ratio`` more together than
its terms tell alone, even if neither tells anything alone; terms are paired
if each is in ``pair_share`` of the rows. There is no limit to their number.
(A machine of all terms, without this choice, learns the fitted rows by heart:
on the sf0.1 documents it finds 1 in 140 toxic held-out rows.)

Nulls, ties and edge cases: a null or empty text has no terms and gets the
score of the bias; null labels and labels of null ids are left out; a
repeated row is scored as often as it is given; without labels of both kinds
every score is the share of toxic ones (0 without any); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.decontaminate import SEPARATOR
from wardstats.llm.hashing import LOWER, _BYTE_CODE, Texts, mix, powers, slices, words
from wardstats.llm.scratch import stored

SLOTS = 1 << 20
#: Bytes of the word prefixes that are terms.
PREFIXES = (4, 5)
#: Labelled rows that a fit reads at most; the likelihood ratio a term must
#: have, and a pair beyond its terms; the share of rows that has a paired term.
MAX_LABELLED, MIN_RATIO, MIN_PAIR_RATIO, PAIR_SHARE = 20_000, 30.0, 40.0, 0.02
#: Terms that are paired with all others at one time, rows that are multiplied at one time.
PAIR_BLOCK, PAIR_ROWS = 256, 1024
RANK, EPOCHS, BATCH, STEP, SHRINK = 4, 150, 512, 0.05, 2e-5

_U = np.uint64


def term_slots(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of all terms, with repeats."""
    h, start, end, first = words(texts, SEPARATOR)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    up, down = powers(len(texts.data) + 1)
    sums = np.zeros(len(texts.data) + 1, _U)
    np.cumsum(_BYTE_CODE[LOWER[texts.data]] * up[:-1], out=sums[1:])
    hashes, owners = [h], [of]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        a = start[long]
        hashes.append(mix((sums[a + k] - sums[a]) * down[a] + _U(k << 32)))
        owners.append(of[long])
    return np.concatenate(owners), (np.concatenate(hashes) >> _U(20) & _U(SLOTS - 1)).astype(np.int64)


@dataclass
class Machine:
    """``slots``: the terms; ``bias``, ``weights``, ``factors``: parameters."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: int, of: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Probabilities of ``rows`` texts from their distinct (text, term)."""
        logit = self.bias + np.bincount(of, self.weights[term], rows)
        for v in self.factors.T:
            logit += 0.5 * (np.bincount(of, v[term], rows) ** 2 - np.bincount(of, v[term] ** 2, rows))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(rows: int, of: np.ndarray, term: np.ndarray, label: np.ndarray, slots: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the logistic loss in batches; ``of`` must be sorted."""
    toxic = label.mean() if rows else 0.0
    if not 0 < toxic < 1:
        return Machine(slots, float(np.clip(np.log(max(toxic, 1e-12) / max(1 - toxic, 1e-12)), -30, 30)), np.zeros(len(slots)), np.zeros((len(slots), RANK)))
    rng = np.random.default_rng(7)
    bias, w, v = float(np.log(toxic / (1 - toxic))), np.zeros(len(slots)), rng.normal(0, 0.01, (len(slots), RANK)).T.copy()
    seen_b, seen_w, seen_v = 1e-6, np.full(len(slots), 1e-6), np.full((RANK, len(slots)), 1e-6)
    begin = np.searchsorted(of, np.arange(rows + 1))
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, rows, BATCH):
            batch = order[at:at + BATCH]
            count = begin[batch + 1] - begin[batch]
            first = np.cumsum(count) - count
            t = term[np.arange(count.sum()) + np.repeat(begin[batch] - first, count)]
            full = np.flatnonzero(count)

            def by_row(value):
                out = np.zeros(len(batch))
                if len(full):
                    out[full] = np.add.reduceat(value[t], first[full])
                return out

            sums = [by_row(x) for x in v]
            logit = bias + by_row(w) + 0.5 * (sum(x * x for x in sums) - by_row((v ** 2).sum(0)))
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[batch]
            by_term = [np.bincount(t, np.repeat(x, count), len(w)) for x in (error, *(error * x for x in sums))]
            gb = error.sum()
            gw = by_term[0] + SHRINK * len(batch) * w
            gv = np.stack(by_term[1:]) - by_term[0] * v + SHRINK * len(batch) * v
            seen_b, seen_w, seen_v = seen_b + gb * gb, seen_w + gw * gw, seen_v + gv * gv
            bias -= STEP * 4 * gb / np.sqrt(seen_b)
            w -= STEP * 8 * gw / np.sqrt(seen_w)
            v -= STEP * gv / np.sqrt(seen_v)
    return Machine(slots, bias, w, v.T.copy())


def pair_gain(has: np.ndarray, label: np.ndarray, block: int = PAIR_BLOCK) -> Iterator[tuple[slice, np.ndarray]]:
    """For blocks of the terms (columns of ``has``, rows x terms) and all
    terms: how much more the four cells of a pair tell about the label than
    its two terms do, in G squared. With n log n of all counts in a table, a
    cell's part is three look-ups; what depends on the totals cancels out."""
    kinds = [has[label == 1], has[label != 1]]
    t1, t0 = (len(x) for x in kinds)
    n = np.arange(t1 + t0 + 1)
    table = n * np.log(np.maximum(n, 1))

    def cell(n1, n0):
        return table[n1] + table[n0] - table[n1 + n0]

    s1, s0 = (x.sum(0, dtype=np.int32) for x in kinds)
    alone = cell(s1, s0) + cell(t1 - s1, t0 - s0)
    for at in range(0, has.shape[1], block):
        mine = slice(at, at + block)
        both = []
        for x in kinds:
            count = np.zeros((len(s1[mine]), len(s1)), np.float32)  # counts of rows: exact
            for rows in (x[r:r + PAIR_ROWS].astype(np.float32) for r in range(0, len(x), PAIR_ROWS)):
                count += rows[:, mine].T @ rows
            both.append(count.astype(np.int32))
        b1, b0 = both
        a1, a0 = s1[mine, None], s0[mine, None]
        gain = cell(b1, b0)
        gain += cell(a1 - b1, a0 - b0)
        gain += cell(s1 - b1, s0 - b0)
        gain += cell(t1 - a1 - s1 + b1, t0 - a0 - s0 + b0)
        yield mine, 2 * (gain - alone[mine, None] - alone + cell(t1, t0))


def _telling(terms: DataFrame, among: np.ndarray | None, min_ratio: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The slots that tell over rows with a slot of ``among`` (or all), and
    those in ``share`` of these rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for label, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots = np.frombuffer(slots, np.int32)
                if among is None or np.isin(slots, among).any():
                    total[label, slots] += 1
                    rows[label] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[1, at], rows[1])), pa.array(np.append(total[0, at], rows[0]))], names=["slot", "n1", "n0"])

    counts = stored(terms.select("label", "slots").mapInArrow(count, "slot int, n1 bigint, n0 bigint").groupBy("slot").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "counts")
    totals = counts.where("slot = -1").first()
    if totals is None or not totals["n1"] or not totals["n0"]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t1, t0 = totals["n1"], totals["n0"]
    n1, n0 = F.col("n1"), F.col("n0")
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    ratio = 2 * sum(part(n, total * has / (t1 + t0)) for n, total, has in ((n1, t1, n1 + n0), (n0, t0, n1 + n0), (t1 - n1, t1, t1 + t0 - n1 - n0), (t0 - n0, t0, t1 + t0 - n1 - n0)))
    got = counts.where("slot >= 0").select("slot", (ratio >= min_ratio).alias("tells"), (n1 + n0 >= share * (t1 + t0)).alias("often")).where("tells OR often").orderBy("slot").toArrow()
    slot = got["slot"].to_numpy().astype(np.int64)
    return slot[np.asarray(got["tells"])], slot[np.asarray(got["often"])]


def _active(found: DataFrame, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``slots``) of the fitted rows' terms, and their labels."""
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(slots, np.frombuffer(s, np.int32))).astype(np.int32).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["same", "label", "terms"])

    got = found.select("same", "label", "slots").mapInArrow(active, "same bigint, label int, terms binary").orderBy("same", "label").toArrow()
    each = [np.frombuffer(x, np.int32) for x in got["terms"].to_pylist()]
    of = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return of, np.concatenate(each) if each else np.zeros(0, np.int32), got["label"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED, min_ratio: float = MIN_RATIO, min_pair_ratio: float = MIN_PAIR_RATIO, pair_share: float = PAIR_SHARE) -> Machine:
    """A machine from labelled rows (ids and labels 0 or 1 in ``labels``)."""
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id", "label").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").select("text", "label")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, slot = term_slots(Texts(batch.column(0)))
            pair = np.unique(of * SLOTS + slot)
            parts = np.split((pair % SLOTS).astype(np.int32), np.searchsorted(pair // SLOTS, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "slots"])

    found = stored(rows.mapInArrow(terms, "label int, slots binary").groupBy(F.xxhash64("slots").alias("same"), "label").agg(F.first("slots").alias("slots")).orderBy("same", "label").limit(max_labelled), "terms")
    plain, often = _telling(found, None, min_ratio, pair_share)
    slots = np.union1d(plain, _telling(found, plain, min_ratio, pair_share)[0]) if len(plain) else plain
    if len(often):
        of, term, label = _active(found, often)
        has = np.zeros((len(label), len(often)), bool)
        has[of, term] = True
        for block, gain in pair_gain(has, label):
            x, y = np.nonzero(gain >= min_pair_ratio)
            slots = np.union1d(slots, often[np.concatenate([x + block.start, y])])
    of, term, label = _active(found, slots)
    return train(len(label), of, term, label, slots)


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and n_terms (distinct terms of the machine) of
    every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = np.full(SLOTS, -1, np.int32)
        index[m.slots] = np.arange(len(m.slots))
        for batch in slices(batches, "text"):
            of, slot = term_slots(Texts(batch.column(1)))
            term = index[slot]
            pair = np.unique(of[term >= 0] * np.int64(len(m.slots)) + term[term >= 0])
            of, term = pair // max(len(m.slots), 1), pair % max(len(m.slots), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(batch.num_rows, of, term)), pa.array(np.bincount(of, minlength=batch.num_rows))], names=["doc_id", "score", "n_terms"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, score double, n_terms bigint")
