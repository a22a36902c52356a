"""Best-fit packing by minimum bin slack.

Documents become token sequences; only those longer than a bin are cut. Bins
are then filled one after the other: the longest piece that is left must go
in, and a bitset subset-sum programme over the lengths that are left finds
the fullest combination with it, which is then removed.

Pieces of one length are interchangeable, so the programme runs over the
*histogram of lengths* (one number per length, ``capacity`` numbers at most,
whatever the corpus holds). A combination is removed as often as the
histogram allows at once; every removal leaves at least one of its lengths
with fewer pieces than the combination takes, so there are at most
sum(capacity / l) combinations of at most sqrt(2 * capacity) lengths. Which
piece goes where is then a distributed ranking: pieces are numbered within
their length, and a number falls into exactly one combination's share.

Nulls, ties and edge cases: a null or empty text is the end token alone (one
piece of length 1); repeated rows are packed as often as they occur; a null
id is kept as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstats.llm.hashing import Texts, slices, words
from wardstats.llm.scratch import stored

#: Words whose ids a worker remembers (beyond it the memo starts anew), and
#: text bytes that it takes at a time.
MEMO_WORDS, SLICE = 400_000, 512 << 10


#: ASCII letters and ASCII punctuation (without the apostrophe of contractions).
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 2
KINDS[[0x27, *range(0x30, 0x3A)]] = 0
for _a in (0x41, 0x61):
    KINDS[_a:_a + 26] = 1


class WordIds:
    """Token ids of the words of texts, for a tokenizer that lower-cases,
    removes white space, and never joins characters across white space or
    between a letter and punctuation: then the ids of a text are those of its
    words one after the other, and each word is encoded once per worker.
    Where a special token may stand in a text, only white space parts words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, added)) or b"(?!)", re.IGNORECASE)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        size, flat = np.zeros(len(texts), np.int64), []
        for i in range(0, len(texts), 1024):
            got = [e.ids for e in encode(texts[i:i + 1024], add_special_tokens=False)]
            size[i:i + len(got)] = [len(x) for x in got]
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
        at = len(self.flat) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(old, where, new) for old, new in ((self.keys, keys), (self.at, at), (self.size, size)))
        self.flat = np.concatenate([self.flat, *flat])

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        raw = texts.data.tobytes()
        special = self.special.search(raw) is not None
        h, start, end, first = words(texts, lower=not special, kinds=None if special else KINDS)
        if len(self.keys) > MEMO_WORDS:
            self._clear()
        kinds, example, kind = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        new = np.ones(len(kinds), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != kinds
        if new.any():
            self._learn(kinds[new], [raw[start[i]:end[i]].decode("utf-8", "replace") for i in example[new]])
            at = np.searchsorted(self.keys, kinds)
        size, place = self.size[at][kind], self.at[at][kind]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(place - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate([[0], stop])[first]


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` as pieces of at most ``capacity`` tokens: doc_id, piece (from
    0), start (token offset in the document), length, ids_crc32 and, on
    request, the ids. Each document ends with ``end_id``. ``tokenizer`` is a
    tokenizer file every executor can read (default: the public word BPE)."""
    dtype = docs.schema[id_col].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dtype]
    schema = pa.schema([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        memo = _memos.get(path) or _memos.setdefault(path, WordIds(path))
        for batch in slices(batches, "text", SLICE):
            ids, bounds = memo.ids(Texts(batch.column(1)))
            rows: list[list] = [[] for _ in schema]
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                seq = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(seq), capacity):
                    part = seq[k:k + capacity]
                    for x, value in zip(rows, (row, k // capacity, k, len(part), zlib.crc32(part.tobytes()), part)):
                        x.append(value)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64()))]
            columns += [pa.array(x, f.type) for x, f in zip(rows[1:], list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = f"doc_id {dtype}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, out)


_memos: dict[str, WordIds] = {}


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (repeats allowed as often as counted) whose sum is the largest
    at most ``room``: bounded subset sums as bits of an integer."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(how many pieces of each length a bin takes, number of such bins)."""
    left, out = dict(sorted(histogram.items())), []
    while left:
        longest = max(left)
        left[longest] -= 1
        uses: dict[int, int] = {longest: 1}
        for length in fullest(left, capacity - longest):
            uses[length] = uses.get(length, 0) + 1
        left[longest] += 1
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((uses, times))
    return out


def minimum_bin_slack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset (the piece's place there; each sequence is
    filled without gaps from 0) to ``pieces`` (any table with doc_id, piece
    and a ``length`` of 1 to ``capacity``)."""
    pieces = stored(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    shares, given, bins = [], dict.fromkeys(histogram, 0), 0
    for uses, times in combinations(histogram, capacity):
        offset = 0
        for length in sorted(uses, reverse=True):
            shares.append((length << 44 | given[length], given[length], uses[length], bins, offset))
            given[length] += uses[length] * times
            offset += uses[length] * length
        bins += times
    key, begin, uses, first, offset = (np.array(x, np.int64) for x in zip(*sorted(shares))) if shares else (np.zeros(0, np.int64),) * 5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "_rank"))
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - begin[i]
            kept = [n for n in b.schema.names if n != "_rank"]
            columns = [b.column(b.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[i] + nth // uses[i]), pa.array(offset[i] + nth % uses[i] * length)], names=[*kept, "sequence_id", "offset"])

    # number the pieces of each length: within shards, after the shards before
    shards = max(16, math.isqrt(sum(histogram.values())))
    order = [c for c, t in pieces.dtypes if not t.startswith(("array", "map"))]
    rows = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    before = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n")).select(
        "length", "_shard", (F.sum("_n").over(Window.partitionBy("length").orderBy("_shard")) - F.col("_n")).alias("_before"))
    ranked = (rows.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*order)) - 1)
              .join(before, ["length", "_shard"])
              .select(*pieces.columns, (F.col("_before") + F.col("_nth")).cast("bigint").alias("_rank")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
