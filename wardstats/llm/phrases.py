"""Removal of repeated byte strings by prefix-free parsing.

A byte string is *repeated* in a document if it has ``length`` bytes (50) and
also starts in a document with a smaller id. Every byte under a repeated
string goes. Comparing all strings would move one record for each byte of the
corpus; parsing moves one for each phrase:

1. Parse. A rolling hash runs over each text; of the hashes inside a string
   of ``length`` bytes the smallest is its *trigger*. Neighbouring strings
   mostly share a trigger; the bytes under all strings with one trigger are a
   *phrase*. Trigger and phrase depend on the string's own bytes only, so
   equal strings have equal triggers wherever they stand, and phrases overlap
   so far that each string lies in one phrase whole.
2. Dictionary. Distinct phrases meet by their trigger; each keeps the
   smallest id in which it occurs (from the parse). A phrase that occurs in an
   earlier document is repeated whole: long copies cost a record per phrase.
3. Suffixes. Only phrases that share a trigger with a *different* phrase can
   have single repeated strings (at the ends of copied passages). Their
   suffixes of ``length`` bytes or more are put in order; equal neighbours in
   it are equal strings, and take the smallest id of their phrases.
4. Both answers go back to the documents; runs of covered bytes are cut out.

The order in step 3 is by 64-bit fingerprints of the first ``length`` bytes,
not alphabetical: equality of neighbours is all that is asked of it, and no
string longer than a phrase need be compared, so the parse's own suffix order
is not needed. Phrases and strings are equal if their fingerprints are.

Texts are packed into chunks that are written once to the shared folder; a
phrase costs a record per chunk, however often it occurs, so frequent
passages don't meet in one task.

Nulls, ties and edge cases: null and empty texts have no bytes; texts under
``length`` bytes lose nothing; rows with equal ids never count as earlier
than each other; a null id counts as larger than all others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.hashing import Texts, mix, powers, slices
from wardstats.llm.scratch import stored

#: Bytes of a string, and of the rolling hash.
LENGTH, ROLLING = 50, 20
#: Text bytes of a chunk; bytes of text whose records one task gathers at a time.
CHUNK_BYTES, BUCKET_BYTES = 512 << 10, 8 << 20

_U = np.uint64
_NO_ID = (1 << 63) - 1


class Parse:
    """Phrases of consecutive texts. ``first``, ``last``: the first and last
    string start of each phrase (byte positions in ``data``); ``of``: its
    text; ``trigger``, ``phrase``: hashes of the trigger and of all bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, rolling: int = ROLLING):
        self.length, n = length, len(data)
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.of = empty
        self.trigger = self.phrase = np.zeros(0, _U)
        if n < length:
            return
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = mix(np.ndarray(n, "<u8", padded, 0, (1,)).astype(_U) + _U(0x632BE59BD9B4E019))
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(eight * up[:n], out=self._sums[1:])
        rolled = (eight[:n - rolling + 1] * _U(0x9FB21C651E98DF25)) ^ (eight[rolling - 8:n - 7] >> _U(7))
        if rolling > 16:
            rolled = rolled + eight[8:n - rolling + 9]
        rolled = (rolled ^ (rolled >> _U(32))) * _U(0xD6E8FEB86659FD93)
        place_bits = _U(int(n).bit_length())
        low = ((rolled >> place_bits) << place_bits) | np.arange(len(rolled), dtype=_U)
        width = length - rolling + 1  # the smallest of so many, by doubling
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        at = (low & ((_U(1) << place_bits) - _U(1))).view(np.int64)  # trigger of the string that starts here
        size = np.diff(offsets)
        text = np.flatnonzero(size >= length)
        begin, end = offsets[text], offsets[text + 1] - length
        cut = np.zeros(len(at), bool)
        cut[1:] = at[1:] != at[:-1]
        cut[begin] = True
        inside = np.zeros(len(at) + 1, np.int8)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end + 1, -1)
        within = np.cumsum(inside[:-1], dtype=np.int8) > 0
        self.first = np.flatnonzero(cut & within)
        if not len(self.first):
            return
        owner = np.searchsorted(begin, self.first, side="right") - 1
        self.of = text[owner]
        self.last = np.minimum(np.append(self.first[1:] - 1, n), end[owner])
        t = at[self.first]
        self.trigger = mix(rolled[t])
        self.phrase = mix(self._hash(self.first, self.last + length) + (t - self.first).astype(_U) * _U(0x9E3779B97F4A7C15)) ^ self.trigger

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes [a, b), 8 or more."""
        return mix((self._sums[b - 7] - self._sums[a]) * self._down[a] + (b - a).astype(_U))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of some phrases: fingerprint, start and phrase."""
        count = self.last[which] - self.first[which] + 1
        of = np.repeat(which, count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[of]
        return self._hash(start, start + self.length), start, of


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, rows, ids, sizes, bytes, data): texts packed and compressed,
    and what is carried of their rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=5)
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = Texts(batch.column(1))
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(os.urandom(8), "little") >> 1]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(2)), pa.array([ids.tobytes()]), pa.array([np.diff(texts.offsets).tobytes()]),
                pa.array([len(texts.data)], pa.int64()), pa.array([codec.compress(texts.data.tobytes(), asbytes=True)])],
                names=["chunk", "rows", "ids", "sizes", "bytes", "data"])

    return stored(docs.mapInArrow(pack, f"chunk bigint, rows array<{docs.schema['row'].dataType.simpleString()}>, ids binary, sizes binary, bytes bigint, data binary"), "texts")


def _unpacked(ids: bytes, sizes: bytes, length: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data, length, "zstd") if length else b""
    return np.frombuffer(ids, np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]), np.frombuffer(raw, np.uint8)


def _by_bucket(bucket: np.ndarray, chunk: int, base: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Rows (bucket, chunk, base, packed columns) of one chunk's records."""
    if not len(bucket):
        return None
    rank = np.argsort(bucket, kind="stable")
    bucket = bucket[rank]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    heads = bucket[np.concatenate([[0], cut])].astype(np.int64)
    packed = [pa.array([x.tobytes() for x in np.split(c[rank], cut)], pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(np.full(len(heads), chunk)), pa.array(np.full(len(heads), base)), *packed], names=["bucket", "chunk", "base", *columns])


def _narrow(ids: np.ndarray, base: int) -> np.ndarray:
    """Ids as small differences from ``base``."""
    d = ids - base
    return d.astype(np.uint16) if len(d) and d.max() < 1 << 16 else d.astype(np.uint32) if not len(d) or d.max() < 1 << 32 else d


def _widened(column: pa.ChunkedArray, base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    kinds = {2: np.uint16, 4: np.uint32, 8: np.int64}
    return np.concatenate([np.frombuffer(x, kinds[len(x) // max(n, 1)]).astype(np.int64) + b if n else np.zeros(0, np.int64) for x, b, n in zip(column.to_pylist(), base, counts)])


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted), the row with each one's smallest id, and the
    place of every row's key among them."""
    rank = np.lexsort((ids, keys))
    head = np.ones(len(rank), bool)
    head[1:] = keys[rank[1:]] != keys[rank[:-1]]
    place = np.empty(len(rank), np.int64)
    place[rank] = np.cumsum(head) - 1
    return keys[rank[head]], rank[head], place


def _answer_rows(chunk: np.ndarray, key: np.ndarray, low: np.ndarray, kind: np.ndarray) -> pa.Table:
    rank = np.argsort(chunk, kind="stable")
    chunk, key, low, kind = chunk[rank], key[rank], low[rank], kind[rank]
    cut = np.flatnonzero(np.diff(chunk)) + 1
    heads = chunk[np.concatenate([[0], cut])] if len(chunk) else chunk
    split = lambda x: pa.array([y.tobytes() for y in np.split(x, cut)] if len(x) else [], pa.binary())
    return pa.table({"chunk": pa.array(heads, pa.int64()), "key": split(key), "low": split(low.astype(np.int64)), "kind": split(kind.astype(np.uint8))})


_ANSWER = "chunk bigint, key binary, low binary, kind binary"
#: Kinds of answers: a phrase of an earlier document, a phrase whose strings
#: must be looked at, a string of an earlier document.
_PHRASE, _LOOK, _STRING = 1, 2, 3


def _dictionary(chunks: DataFrame, buckets: int, length: int, rolling: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids, offsets, data = _unpacked(*packed)
                p = Parse(data, offsets, length, rolling)
                doc = ids[p.of]
                _, row, _ = _least(p.phrase, doc)
                base = int(ids.min()) if len(ids) else 0
                bucket = (p.trigger[row] >> _U(32)) % _U(buckets)
                out = _by_bucket(bucket, chunk, base, {"phrase": (p.phrase[row] >> _U(32)).astype(np.uint32), "rest": (p.phrase[row] >> _U(16)).astype(np.uint16), "trigger": p.trigger[row].astype(np.uint32), "doc": _narrow(doc[row], base)})
                if out is not None:
                    yield out

    def meet(asked: pa.Table) -> pa.Table:
        counts = np.array([len(x) // 4 for x in asked["phrase"].to_pylist()])
        joined = lambda c, t: np.frombuffer(b"".join(asked[c].to_pylist()), t)
        key = joined("phrase", np.uint32).astype(_U) << _U(16) | joined("rest", np.uint16)
        trigger = joined("trigger", np.uint32)
        doc = _widened(asked["doc"], asked["base"].to_numpy(), counts)
        chunk = np.repeat(asked["chunk"].to_numpy(), counts)
        rank = np.lexsort((doc, key, trigger))
        key, trigger, doc, chunk = key[rank], trigger[rank], doc[rank], chunk[rank]
        new_trigger = np.concatenate([[True], trigger[1:] != trigger[:-1]])
        new_phrase = new_trigger | np.concatenate([[True], key[1:] != key[:-1]])
        phrase = np.cumsum(new_phrase) - 1
        low = doc[new_phrase][phrase]
        group = np.cumsum(new_trigger) - 1
        starts = np.flatnonzero(new_trigger)
        several = (np.add.reduceat(new_phrase.astype(np.int64), starts) > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
        kind = np.where(doc > low, _PHRASE, np.where(several[group], _LOOK, 0))
        keep = kind > 0
        return _answer_rows(chunk[keep], key[keep], low[keep], kind[keep])

    asked = chunks.drop("rows").mapInArrow(ask, "bucket bigint, chunk bigint, base bigint, phrase binary, rest binary, trigger binary, doc binary")
    return stored(asked.groupBy("bucket").applyInArrow(meet, _ANSWER), "phrases")


def _answers(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("key", _U), ("low", np.int64), ("kind", np.uint8)))


def _told(keys: np.ndarray, known: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What was answered for each key, else the largest id."""
    out = np.full(len(keys), _NO_ID)
    if len(known):
        rank = np.argsort(known)
        place = np.minimum(np.searchsorted(known[rank], keys), len(known) - 1)
        hit = known[rank][place] == keys
        out[hit] = low[rank][place[hit]]
    return out


def _short(p: Parse) -> np.ndarray:
    return p.phrase >> _U(16)


def _strings(chunks: DataFrame, dictionary: DataFrame, buckets: int, length: int, rolling: int) -> DataFrame:
    def ask(mine: pa.Table, got: pa.Table) -> pa.Table:
        out = None
        if mine.num_rows and got.num_rows:
            ids, offsets, data = _unpacked(*(mine[c][0].as_py() for c in ("ids", "sizes", "bytes", "data")))
            key, _, kind = _answers(got)
            p = Parse(data, offsets, length, rolling)
            look = np.flatnonzero(np.isin(_short(p), key[kind == _LOOK]))
            _, row, _ = _least(_short(p)[look], ids[p.of[look]])
            h, _, of = p.strings(look[row])
            doc = ids[p.of[of]]
            h, row, _ = _least(h, doc)
            base = int(ids.min())
            out = _by_bucket((h >> _U(32)) % _U(buckets), mine["chunk"][0].as_py(), base, {"string": h, "doc": _narrow(doc[row], base)})
        schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("base", pa.int64()), ("string", pa.binary()), ("doc", pa.binary())])
        return schema.empty_table() if out is None else pa.Table.from_batches([out])

    def meet(asked: pa.Table) -> pa.Table:
        counts = np.array([len(x) // 8 for x in asked["string"].to_pylist()])
        key = np.frombuffer(b"".join(asked["string"].to_pylist()), _U)
        doc = _widened(asked["doc"], asked["base"].to_numpy(), counts)
        chunk = np.repeat(asked["chunk"].to_numpy(), counts)
        _, row, place = _least(key, doc)
        low = doc[row][place]
        keep = doc > low
        return _answer_rows(chunk[keep], key[keep], low[keep], np.full(int(keep.sum()), _STRING))

    looked = dictionary.where(F.expr(f"instr(hex(kind), '0{_LOOK}') > 0"))
    asked = chunks.drop("rows").groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(ask, "bucket bigint, chunk bigint, base bigint, string binary, doc binary")
    return stored(asked.groupBy("bucket").applyInArrow(meet, _ANSWER), "strings")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, rolling: int = ROLLING, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """Per row: row (a struct of the columns named in ``carry``), doc_id,
    n_bytes, spans (array of
    [start, end) byte runs to remove, maximal and in order), kept (the
    remaining bytes)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("row"))
    chunks = _chunks(docs)
    volume = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES)
    dictionary = _dictionary(chunks, buckets, length, rolling)
    answers = dictionary.unionByName(_strings(chunks, dictionary, buckets, length, rolling))

    def cut(mine: pa.Table, got: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if mine.num_rows:
            ids, offsets, data = _unpacked(*(mine[c][0].as_py() for c in ("ids", "sizes", "bytes", "data")))
            key, low, kind = _answers(got)
            p = Parse(data, offsets, length, rolling)
            doc = ids[p.of]
            _, row, place = _least(_short(p), doc)
            least = np.minimum(doc[row][place], _told(_short(p), key[kind == _PHRASE], low[kind == _PHRASE]))
            whole = np.flatnonzero(least < doc)
            look = np.flatnonzero((least >= doc) & np.isin(_short(p), key[kind == _LOOK]))
            h, start, of = p.strings(look)
            _, row, place = _least(h, doc[of]) if len(h) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
            earlier = np.minimum(doc[of][row][place], _told(h, key[kind == _STRING], low[kind == _STRING]))
            single = start[earlier < doc[of]]
            covered = np.zeros(len(data) + 1, np.int32)
            for a, b in ((p.first[whole], p.last[whole]), (single, single)):
                np.add.at(covered, a, 1)
                np.add.at(covered, b + length, -1)
            gone = np.cumsum(covered[:-1]) > 0
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                rows.append((None if ids[i] == _NO_ID else int(ids[i]), int(b - a), edges.reshape(-1, 2).tolist(), data[a:b][~mask].tobytes()))
        cols = list(zip(*rows)) or [()] * 4
        carried = mine["rows"].combine_chunks().flatten() if mine.num_rows else pa.array([], mine.schema.field("rows").type.value_type)
        return pa.table({"row": carried, "doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "spans": pa.array(cols[2], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(cols[3], pa.binary())})

    kind = docs.schema["row"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, f"row {kind}, doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")


def digest(cuts: DataFrame) -> DataFrame:
    """The numbers and the checksum of :func:`repeated_bytes`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, 1) - F.get(s, 0))
    return cuts.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
