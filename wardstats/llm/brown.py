"""Brown class-based n-grams: P(w | before) = P(class(w) | class(before)) *
P(w | class(w)).

1. Chunks of texts are written to the shared folder as their distinct words
   and their tokens' numbers among those; each chunk asks for its words once,
   with their counts in training texts.
2. Words meet by their hash. That gives every word's count over the whole
   corpus: the vocabulary table, as large as the corpus makes it, never
   collected.
3. Exchange clustering assigns words to ``CLASSES`` classes, in ``SWEEPS``
   rounds over the class bigrams N(c, d) of the training texts. Each round
   the chunks learn their words' classes and count N (a fixed size) and, for
   each word, the classes before and after it; those counts meet the
   vocabulary, and half of the words (by a bit of their hash, in turn) move
   to the class under whose bigrams their neighbours' classes are likeliest.
   The words of a round move at once, by the counts before it, so that a round
   can lose; of all rounds the classes with the largest sum N(c, d) log N(c, d)
   - 2 sum N(c) log N(c) are kept. At first the most frequent words are a class
   each and all others are the last one.
4. Counts and classes go back to the chunks, which score every text.

Smoothing: transitions are backed by the class unigram (weight ``BACKING``);
words lose an absolute discount d = n1 / (n1 + 2 n2), which is what an unseen
word has, over all classes it could have. So the probabilities of all known
words, one unseen word and the end add up to 1 after any word. The end of a
text is a class of its own; an unseen word tells nothing about the next.

Words: ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, known by 64-bit hashes.
Nulls, ties and edge cases: a null, empty or wordless text is its end alone;
a null ``held`` counts as not held out; repeated rows count and are scored as
often as given; without training texts every score is that of unseen words;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.hashing import Texts, slices, words
from wardstats.llm.scratch import scope, stored

CLASSES, SWEEPS, BACKING = 64, 6, 64.0
#: Text bytes of a chunk; bytes of records that one task gathers at a time.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Words that are compared with the classes at one time.
BLOCK = 1024

_U = np.uint64
_END = _U(1)


def token_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by its end, and where each
    text's tokens begin."""
    h, _, _, first = words(texts)
    return np.insert(h, first[1:], _END), first + np.arange(len(first))


def _half(h: np.ndarray) -> np.ndarray:
    """Which of two halves of all words, that move in turn, each belongs to."""
    return (h >> _U(1) & _U(1)).astype(bool)


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _opened(x: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd") if n else b"", kind)


def _chunks(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=5)
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = Texts(batch.column(1))
            held = np.asarray(batch.column(2).fill_null(False)).astype(np.uint8)
            h, begin = token_hashes(texts)
            known, word = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(os.urandom(8), "little") >> 1]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                pa.array([held.tobytes()]), pa.array([begin.astype(np.int64).tobytes()]), pa.array([len(texts.data)], pa.int64()),
                pa.array([codec.compress(word.astype(np.uint32).tobytes(), asbytes=True)]), pa.array([known.tobytes()]),
                pa.array([np.packbits(_half(known)).tobytes()])], names=["chunk", "ids", "held", "begin", "bytes", "word", "hashes", "half"])

    return stored(docs.mapInArrow(pack, f"chunk bigint, ids array<{kind}>, held binary, begin binary, bytes bigint, word binary, hashes binary, half binary"), "texts")


class Chunk:
    """Tokens of one chunk: ``word`` (index among the distinct words, which
    are in the order of their hashes and so of their buckets), ``begin``
    (first token of each text), ``train`` (of each token)."""

    def __init__(self, held: bytes, begin: bytes, word: bytes):
        self.begin = np.frombuffer(begin, np.int64)
        self.word = _opened(word, int(self.begin[-1]), np.uint32).astype(np.int64)
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.train = np.repeat(~self.held, np.diff(self.begin))


def _vocabulary(chunks: DataFrame, classes: int, buckets: int) -> DataFrame:
    """A row per bucket: its words' counts, the most frequent of them, and
    which words which chunk asked for."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, begin, word, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                c, known = Chunk(held, begin, word), np.frombuffer(hashes, _U)
                if not len(known):
                    continue
                count = np.bincount(c.word[c.train], minlength=len(known)).astype(np.uint32)
                bucket = ((known >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                heads, tails = np.append(0, cut), np.append(cut, len(known))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[heads]), pa.array(np.full(len(heads), chunk)), pa.array([known[a:b].tobytes() for a, b in zip(heads, tails)], pa.binary()),
                    pa.array([_small(count[a:b]) for a, b in zip(heads, tails)], pa.binary())], names=["bucket", "chunk", "word", "n"])

    def meet(asked: pa.Table) -> pa.Table:
        size = [len(x) // 8 for x in asked["word"].to_pylist()]
        known, place = np.unique(np.frombuffer(b"".join(asked["word"].to_pylist()), _U), return_inverse=True)
        n = np.concatenate([_opened(x, k, np.uint32) for x, k in zip(asked["n"].to_pylist(), size)])
        count = np.bincount(place, n, len(known)).astype(np.int64)
        best = np.lexsort((known, -count))[:classes + 1]
        best = best[(count[best] > 0) & (known[best] != _END)]
        return pa.table({
            "bucket": [asked["bucket"][0].as_py()], "words": [len(known)], "end": [int(np.searchsorted(known, _END)) if _END in known else -1], "n": [count.tobytes()],
            "top": pa.array([[{"n": int(count[i]), "word": int(known[i].view(np.int64)), "at": int(i)} for i in best]], pa.list_(pa.struct([("n", pa.int64()), ("word", pa.int64()), ("at", pa.int64())]))),
            "chunks": [asked["chunk"].to_numpy().tobytes()], "sizes": [np.array(size, np.int64).tobytes()], "asked": [_small(place.astype(np.uint32))]})

    asked = chunks.select("chunk", "held", "begin", "word", "hashes").mapInArrow(ask, "bucket bigint, chunk bigint, word binary, n binary")
    return stored(asked.groupBy("bucket").applyInArrow(meet, "bucket bigint, words bigint, end bigint, n binary, top array<struct<n:bigint,word:bigint,at:bigint>>, chunks binary, sizes binary, asked binary"), "vocabulary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def objective(table: np.ndarray) -> float:
    """What the exchange raises, of class bigram counts (the end is the last
    class)."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def likeliest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The class of each context vector: the one under whose distribution it
    is likeliest (the first of equal ones)."""
    smooth, side = centers + 0.5, centers.shape[1] // 2
    halves = [np.log(h / h.sum(1, keepdims=True)) for h in (smooth[:, :side], smooth[:, side:])]
    return (vectors @ np.concatenate(halves, 1).T).argmax(1)


def _summed(frame: DataFrame, emit, cells: int) -> np.ndarray:
    """Sums of (cell, n) rows that tasks emit, as one array of fixed size."""
    got = frame.mapInArrow(emit, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _answers(vocabulary: DataFrame, assigned: DataFrame, counts: bool = False) -> DataFrame:
    """Classes, and counts if asked for, of the words that each chunk has
    asked for."""
    columns = ["bucket", "chunks", "sizes", "asked", "cls", *["n"] * counts]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, asking, sizes, asked, *facts in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.frombuffer(sizes, np.int64)
                parts = np.split(_opened(asked, int(sizes.sum()), np.uint32), np.cumsum(sizes)[:-1])
                facts = [np.frombuffer(x, kind) for x, kind in zip(facts, (np.uint8, np.int64))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(parts), bucket)), pa.array(np.frombuffer(asking, np.int64)), pa.array(sizes),
                    *(pa.array([_small(x[p]) for p in parts], pa.binary()) for x in facts)], names=["bucket", "chunk", "size", *columns[4:]])

    both = vocabulary.join(assigned, "bucket").select(*columns)
    return both.mapInArrow(tell, "bucket bigint, chunk bigint, size bigint, cls binary" + ", n binary" * counts)


def _told(got: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their numbers of words, and a column of all answers, in the
    order of a chunk's words."""
    order = np.argsort(got["bucket"].to_numpy())
    bucket, size, rows = got["bucket"].to_numpy()[order], got["size"].to_numpy()[order], got[column].to_pylist()
    return bucket, size, np.concatenate([_opened(rows[i], int(k), kind) for i, k in zip(order, size)])


def _contexts(chunks: DataFrame, answers: DataFrame, classes: int, turn: int | None) -> DataFrame:
    """A row per chunk and bucket: context counts of its words of half
    ``turn`` (unless None); and one per chunk with its class bigrams, in bucket -1."""
    k = classes + 1
    width = 2 * k

    def count(mine: pa.Table, got: pa.Table) -> pa.Table:
        rows = []
        if mine.num_rows and got.num_rows:
            c = Chunk(*(mine[x][0].as_py() for x in ("held", "begin", "word")))
            bucket, size, cls = _told(got, "cls", np.uint8)
            of = cls.astype(np.int64)[c.word]
            before = np.append(classes, of[:-1])  # what stands before a text is an end
            moves = np.bincount((before * k + of)[c.train], minlength=k * k)
            rows.append((-1, 0, b"", k * k, b"", _small(moves)))
            if turn is not None:
                moving = np.unpackbits(np.frombuffer(mine["half"][0].as_py(), np.uint8), count=len(cls)) == turn
                plain = np.flatnonzero(c.train & (of < classes) & moving[c.word])  # a word has a token after it
                key = np.concatenate([c.word[plain] * width + before[plain], c.word[plain] * width + k + of[plain + 1]])
                at, times = np.unique(key, return_counts=True)
                bounds = np.searchsorted(at, np.arange(len(cls) + 1) * width)
                stop = np.cumsum(size)
                for b, x, y in zip(bucket, stop - size, stop):
                    e = slice(bounds[x], bounds[y])
                    rows.append((int(b), int(y - x), _small(np.diff(bounds[x:y + 1]).astype(np.uint16)), int(e.stop - e.start), _small((at[e] % width).astype(np.uint16)), _small(times[e].astype(np.uint32))))
            rows = [(r[0], mine["chunk"][0].as_py(), *r[1:]) for r in rows]
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["bucket", "chunk", "size", "entries", "total", "kind", "times"])

    side = chunks.select("chunk", "held", "begin", "word", "half").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return stored(side.applyInArrow(count, "bucket bigint, chunk bigint, size bigint, entries binary, total bigint, kind binary, times binary"), "contexts")


def exchange(chunks: DataFrame, vocabulary: DataFrame, classes: int, sweeps: int) -> tuple[DataFrame, np.ndarray]:
    """The words' classes (bucket, cls) and the class bigrams; the end is
    class ``classes``."""
    k = classes + 1
    width = 2 * k
    top = vocabulary.select("bucket", F.inline("top")).orderBy(F.desc("n"), "word").limit(classes - 1).collect()
    seeds: dict[int, list[tuple[int, int]]] = {}
    for c, r in enumerate(top):
        seeds.setdefault(r["bucket"], []).append((r["at"], c))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words_, end in zip(*(c.to_pylist() for c in batch.columns)):
                cls = np.full(words_, classes - 1, np.uint8)
                for at, c in seeds.get(bucket, ()):
                    cls[at] = c
                if end >= 0:
                    cls[end] = classes
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([cls.tobytes()], pa.binary())], names=["bucket", "cls"])

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            for times in batch.column(0).to_pylist():
                total += _opened(times, k * k, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    def move(told: pa.Table, mine: pa.Table, centers: np.ndarray) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "cls": pa.array([], pa.binary())})
        cls, sizes = (np.frombuffer(mine[x][0].as_py(), t) for x, t in (("cls", np.uint8), ("sizes", np.int64)))
        cls = cls.copy()
        parts = np.split(_opened(mine["asked"][0].as_py(), int(sizes.sum()), np.uint32), np.cumsum(sizes)[:-1])
        place = dict(zip(np.frombuffer(mine["chunks"][0].as_py(), np.int64).tolist(), parts))
        keys, counts = [], []
        for chunk, size, entries, total, kind, times in zip(*(told[x].to_pylist() for x in ("chunk", "size", "entries", "total", "kind", "times"))):
            keys.append(np.repeat(place[chunk].astype(np.int64), _opened(entries, size, np.uint16)) * width + _opened(kind, total, np.uint16))
            counts.append(_opened(times, total, np.uint32))
        if keys:
            at, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(inverse, np.concatenate(counts), len(at))
            word = at // width
            known = np.unique(word)
            for a in range(0, len(known), BLOCK):
                w = known[a:a + BLOCK]
                e = slice(*np.searchsorted(word, (w[0], w[-1] + 1)))
                vectors = np.zeros((len(w), width))
                vectors[np.searchsorted(w, word[e]), at[e] % width] = times[e]
                cls[w] = likeliest(vectors, centers)
        return pa.table({"bucket": mine["bucket"], "cls": pa.array([cls.tobytes()], pa.binary())})

    assigned = stored(vocabulary.select("bucket", "words", "end").mapInArrow(start, "bucket bigint, cls binary"), "classes")
    best = None
    for sweep in range(sweeps + 1):
        with scope() as round_:
            contexts = _contexts(chunks, _answers(vocabulary, assigned), classes, sweep % 2 if sweep < sweeps else None)
            table = _summed(contexts.where("bucket = -1").select("times"), bigrams, k * k).reshape(k, k)
            value = objective(table)
            if best is None or value > best[0]:
                best = value, assigned, table
            if sweep < sweeps:
                centers = np.concatenate([table[:, :classes].T, table[:classes]], 1)  # of each class: those before it, those after it
                words_ = vocabulary.join(assigned, "bucket").select("bucket", "chunks", "sizes", "asked", "cls")
                both = contexts.where("bucket >= 0").groupBy("bucket").cogroup(words_.groupBy("bucket"))
                assigned = round_.keep(stored(both.applyInArrow(partial(move, centers=centers), "bucket bigint, cls binary"), "classes"))
    return best[1], best[2]


def log_probabilities(docs: DataFrame, held, classes: int = CLASSES, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (class model), log10 probabilities of the
    whole text. ``held`` is a boolean column; rows where it holds teach
    nothing."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    spark = docs.sparkSession
    chunks = _chunks(docs)
    volume = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES)
    vocabulary = _vocabulary(chunks, classes, buckets)
    assigned, moves = exchange(chunks, vocabulary, classes, sweeps)

    # tokens, words, words that occur once and twice, and words by class
    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + classes)
        for batch in batches:
            for end, n, cls in zip(*(c.to_pylist() for c in batch.columns)):
                n, cls = np.frombuffer(n, np.int64), np.frombuffer(cls, np.uint8)
                total[:4] += (n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum())
                plain = np.arange(len(n)) != end
                total[4:] += np.bincount(cls[plain], n[plain] > 0, classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    total = _summed(vocabulary.join(assigned, "bucket").select("end", "n", "cls"), census, 4 + classes)
    tokens, kinds, once, twice = total[:4]
    moves = np.concatenate([moves, np.zeros((1, classes + 1))])  # after an unseen word
    ends = moves[:, classes].sum()
    by_class = moves.sum(0)
    size = np.append(by_class[:classes], ends)
    unigram = size / max(size.sum(), 1)
    smooth = (moves + BACKING * unigram) / (moves.sum(1, keepdims=True) + BACKING)
    discount = once / (once + 2 * twice) if once else 0.5
    lost = discount * total[4:]  # of each class: what its words have given up
    unseen = np.divide(np.append(lost, 0.0), size, out=np.zeros(classes + 1), where=size > 0).clip(0, 1)
    emit_unseen = smooth @ unseen
    floor = 1.0 / (tokens + kinds + 1)
    with np.errstate(divide="ignore"):
        move_log = np.log10(np.maximum(smooth, 1e-300))
        unseen_log = np.log10(np.where(emit_unseen > 0, emit_unseen, floor))
        size_log = np.log10(np.maximum(size, 1))
    model = spark.sparkContext.broadcast((move_log, unseen_log, size_log, discount))

    kind = docs.schema["doc_id"].dataType.simpleString()
    result = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(mine: pa.Table, got: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return result.empty_table()
        move, unknown, class_size, d = model.value
        c = Chunk(*(mine[x][0].as_py() for x in ("held", "begin", "word")))
        n, cls = _told(got, "n", np.int64)[2], _told(got, "cls", np.uint8)[2].astype(np.int64)
        cls[(n == 0) & (cls < classes)] = classes + 1  # an unseen word
        base = np.log10((n + 1) / (tokens + kinds + 1))[c.word]
        of = cls[c.word]
        before = np.concatenate([[classes], of[:-1]])
        # given its class, a word has its discounted share; the end is its class
        own = np.where(cls < classes, np.log10(np.maximum(n - d, 1e-300)) - class_size[np.minimum(cls, classes)], 0.0)[c.word]
        best = np.where(of <= classes, move[before, np.minimum(of, classes)] + own, unknown[before])
        add = lambda x: np.add.reduceat(x, c.begin[:-1])
        columns = (c.held, np.diff(c.begin), add((n > 0)[c.word].astype(np.int64)), np.full(len(c.held), int(tokens)), add(base), add(best))
        return pa.Table.from_arrays([mine["ids"].combine_chunks().flatten(), *map(pa.array, columns)], schema=result)

    side = chunks.select("chunk", "ids", "held", "begin", "word").groupBy("chunk").cogroup(_answers(vocabulary, assigned, counts=True).groupBy("chunk"))
    return side.applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
