"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and the
components of its links.

The sets are the distinct word shingles of each text. Texts with equal sets
form a class; links between classes are found like this:

1. Sketches of fixed size (``SLOTS`` counters each) of all shingles and all
   words of all texts put all shingles in one order: first those that are
   not frequent themselves, by the frequency of their words (shingles of rare
   words are hardly shared by chance), then frequent ones by frequency.
2. If two sets x, y reach the threshold, their first |x| - T(x) + l shingles
   (T(x): the least overlap any partner needs) share at least l. Each class
   takes the l of 1 to ``MAX_MATCHES`` with the least estimated cost (list
   entries read, and candidates that would be verified: entries / l), so
   classes with frequent shingles get longer prefixes and a stricter count.
3. Prefix shingles that two classes hold are found by shuffling the distinct
   ones of each chunk of texts once, as packed arrays; a shingle costs a
   record per chunk, however many texts hold it.
4. Hub round: for each shared shingle the class with the most frequent prefix
   is its hub, and the others are compared with it only. That joins groups of
   near copies by a number of comparisons that grows with the group, not with
   its square.
5. Completing round: classes of *different* components that share l or more
   prefix shingles (l: the smaller of both), and could overlap enough by
   their sizes and by the place of each shared shingle, are compared. Pairs
   inside a component can't change the result. (Before a shingle at place i
   of x, x and y can share no more than the r shingles that x shares with
   anyone, from it on no more than |x| - i.)
6. Every compared pair is verified on the whole shingle sets.

Shingles are compared by 64-bit hashes; a class is known by a 64-bit hash of
its set. Words: ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z.

Nulls, ties and edge cases: a text with fewer words than a shingle is one
shingle; null, empty and wordless texts have the empty set and link to
nothing, not to each other; repeated rows are one class and appear as often
as given; a null id takes part and gets its component's smallest id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.llm.graph import components
from wardstats.llm.hashing import Texts, grams, mix, shingle_sets, signed, slices, words
from wardstats.llm.scratch import sized, stored

#: Counters of the frequency sketch, whatever the corpus holds.
SLOTS = 1 << 18
#: The largest l.
MAX_MATCHES = 4
#: Cost of verifying a candidate and of one more prefix shingle, in list
#: entries, and the entries a shingle has by chance.
VERIFY_COST, TOKEN_COST, CHANCE = 20.0, 1.0, 0.05
#: Bytes of shingle records that one task gathers at a time.
BUCKET_BYTES = 8 << 20
#: Texts, and pairs of whole shingle sets, that a task hands to its worker at a time.
TEXTS_IN_BATCH, PAIRS_IN_BATCH = 1000, 250

_U = np.uint64


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles (row 0) and words (row 1) fall into each slot, over
    all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, np.int64)
        for batch in slices(batches, "text"):
            h, *_ = words(Texts(batch.column(batch.schema.get_field_index("text"))))
            for row, x in enumerate((grams(h, k), h)):
                total[row * SLOTS:][:SLOTS] += np.bincount((x & _U(SLOTS - 1)).view(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    sketch = np.zeros(2 * SLOTS, np.int64)
    got = rows.toArrow()
    sketch[got["slot"].to_numpy()] = got["n"].to_numpy()
    return sketch.reshape(2, SLOTS)


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def choose_matches(entries: np.ndarray, base: int) -> int:
    """l for a set whose shingles, in order, have these estimated entries and
    whose prefix for l = 1 has ``base`` shingles."""
    sums = np.cumsum(entries[:base + MAX_MATCHES - 1])
    if len(sums) == 0:
        return 1
    options = np.arange(1, min(MAX_MATCHES, len(entries) - base + 1) + 1)
    s = sums[base + options - 2]
    return int(options[np.argmin(s + VERIFY_COST * s / options + TOKEN_COST * options)])


def set_class(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=_U) + _U(len(s))], _U))[0])


def _chunks(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """A row per chunk of texts: ids, classes and set sizes of its texts, and
    for its distinct classes l, weight, prefix length and prefix shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of_words = shared.value
        usual = float(np.median(seen))
        frequent = usual + 5 * np.sqrt(usual + 1) + 1
        rarity = (1024 * np.log2(of_words + 1)).astype(np.int64)  # whole numbers: sums don't depend on their order
        for batch in slices(batches, "text"):
            cls, size, own = [], [], {}
            for s, rank in shingle_sets(Texts(batch.column(1)), k, lambda h: rarity[(h & _U(SLOTS - 1)).view(np.int64)]):
                c = set_class(s)
                cls.append(c)
                size.append(len(s))
                if len(s) and c not in own:
                    est = seen[(s & _U(SLOTS - 1)).view(np.int64)]
                    order = np.argsort(np.where(est > frequent, est << 20, rank), kind="stable")
                    base = len(s) - least_overlap(len(s), percent) + 1
                    near = order[:base + MAX_MATCHES]
                    entries = np.maximum(est[near] - usual, 0) * (est[near] > frequent) + CHANCE
                    few = choose_matches(np.concatenate([entries, np.ones(max(0, len(s) - len(near)))])[:len(s)], base)
                    prefix = s[order[:base + few - 1]]
                    own[c] = (len(s), few, int((est[order[:base]] > frequent).sum()), prefix)
            n, few, weight, prefix = zip(*own.values()) if own else ((), (), (), ())
            as_bytes = lambda x, t: np.array(x, t).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(os.urandom(8), "little") >> 1]),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                pa.array([np.array(cls, _U).view(np.int64)], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int32())),
                pa.array([as_bytes(list(own), _U)]), pa.array([as_bytes(n, np.int32)]), pa.array([as_bytes(few, np.int8)]),
                pa.array([as_bytes(weight, np.int32)]), pa.array([as_bytes([len(p) for p in prefix], np.int32)]),
                pa.array([np.concatenate(prefix).tobytes() if prefix else b""]),
            ], names=["chunk", "ids", "classes", "sizes", "own", "n", "few", "weight", "length", "prefix"])

    return stored(docs.mapInArrow(build, f"chunk bigint, ids array<{kind}>, classes array<bigint>, sizes array<int>, own binary, n binary, few binary, weight binary, length binary, prefix binary"), "chunks")


def _shared_prefixes(chunks: DataFrame) -> DataFrame:
    """(token, cls, n, few, before, rest, hub): the prefix shingles that at
    least two classes hold, with how many such shingles the class has before
    it, how many shingles it has from there on, and its hub."""
    spark = chunks.sparkSession
    volume = chunks.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * volume // BUCKET_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, weight, length, prefix in zip(*(c.to_pylist() for c in batch.columns)):
                own, weight, length, token = (np.frombuffer(x, t) for x, t in ((own, _U), (weight, np.int32), (length, np.int32), (prefix, _U)))
                of = np.repeat(np.arange(len(own)), length)
                rank = np.lexsort((own[of], weight[of], token))
                # of one token's classes the two of most weight: enough to name the hub and to show that there are two
                last = np.ones(len(rank), bool)
                last[:-1] = token[rank[1:]] != token[rank[:-1]]
                keep = last.copy()
                keep[:-1] |= last[1:]
                rank = rank[keep]
                bucket = (token[rank] >> _U(20)) % _U(buckets)
                rank = rank[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                parts = np.split(rank, cut)
                if not len(rank):
                    continue
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[np.concatenate([[0], cut])].astype(np.int64)), pa.array(np.full(len(parts), chunk)),
                    pa.array([token[p].tobytes() for p in parts]), pa.array([own[of[p]].tobytes() for p in parts]),
                    pa.array([weight[of[p]].astype(np.int32).tobytes() for p in parts])], names=["bucket", "chunk", "token", "cls", "weight"])

    def answer(asked: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(asked[c].to_pylist()), t) for c, t in (("token", _U), ("cls", _U), ("weight", np.int32))]
        token, cls, weight = parts
        chunk = np.repeat(asked["chunk"].to_numpy(), [len(x) // 8 for x in asked["token"].to_pylist()])
        rank = np.lexsort((cls, weight, token))
        token, cls, chunk = token[rank], cls[rank], chunk[rank]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        stop = np.append(start[1:], len(token))
        two = np.add.reduceat(np.concatenate([[False], (cls[1:] != cls[:-1]) & (token[1:] == token[:-1])]), start) > 0
        hub = np.repeat(cls[stop - 1], stop - start)
        keep = np.repeat(two, stop - start)
        chunk, token, hub = chunk[keep], token[keep], hub[keep]
        rank = np.lexsort((token, chunk))
        chunk, token, hub = chunk[rank], token[rank], hub[rank]
        once = np.ones(len(rank), bool)
        once[1:] = (chunk[1:] != chunk[:-1]) | (token[1:] != token[:-1])
        chunk, token, hub = chunk[once], token[once], hub[once]
        cut = np.flatnonzero(np.diff(chunk)) + 1
        heads = chunk[np.concatenate([[0], cut])] if len(chunk) else chunk
        split = lambda x: [y.tobytes() for y in np.split(x, cut)] if len(x) else []
        return pa.table({"chunk": pa.array(heads, pa.int64()), "token": pa.array(split(token), pa.binary()), "hub": pa.array(split(hub), pa.binary())})

    asked = chunks.select("chunk", "own", "weight", "length", "prefix").mapInArrow(ask, "bucket bigint, chunk bigint, token binary, cls binary, weight binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk bigint, token binary, hub binary")

    def tell(mine: pa.Table, got: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        if mine.num_rows and got.num_rows:
            known, hubs = (np.frombuffer(b"".join(got[c].to_pylist()), _U) for c in ("token", "hub"))
            rank = np.argsort(known)
            known, hubs = known[rank], hubs[rank]
            own, n, few, length, token = (np.frombuffer(mine[c][0].as_py(), t) for c, t in (("own", _U), ("n", np.int32), ("few", np.int8), ("length", np.int32), ("prefix", _U)))
            of = np.repeat(np.arange(len(own)), length)
            at = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            place = np.minimum(np.searchsorted(known, token), len(known) - 1)
            hit = known[place] == token
            of, at, place, token = of[hit], at[hit], place[hit], token[hit]
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[:len(of)])
            before = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
            for x, y in zip(out, (signed(token), signed(own[of]), n[of], few[of].astype(np.int32), before.astype(np.int32), (n[of] - at).astype(np.int32), signed(hubs[place]))):
                x.append(y)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64)
        return pa.table({name: np.concatenate(x) if x else np.zeros(0, t) for name, x, t in zip(("token", "cls", "n", "few", "before", "rest", "hub"), out, kinds)})

    shared = chunks.select("chunk", "own", "n", "few", "length", "prefix").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        tell, "token bigint, cls bigint, n int, few int, before int, rest int, hub bigint")
    return stored(shared.dropDuplicates(["token", "cls"]), "shared")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles): the shingle sets of the classes in ``wanted`` (cls,
    doc_id of one text of it), computed anew from the texts."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, "text"):
            cls, found = [], []
            for (s, _), c in zip(shingle_sets(Texts(batch.column(0)), k), batch.column(1).to_numpy().view(_U)):
                if int(c) not in done and set_class(s) == int(c):
                    done.add(int(c))
                    cls.append(int(c.view(np.int64)))
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(found, pa.binary())], names=["cls", "shingles"])

    texts = docs.join(sized(wanted, 32), docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "cls")
    return stored(texts.mapInArrow(build, "cls bigint, shingles binary").dropDuplicates(["cls"]), "sets", TEXTS_IN_BATCH)


def _verified(docs: DataFrame, pairs: DataFrame, texts_of: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, with their
    overlap and union sizes."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _sets(docs, stored(texts_of.join(wanted, "cls").select("cls", "doc_id"), "wanted"), k)
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, common, union = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(z.as_buffer(), _U) for z in (x, y))
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[place] == y).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    rows.append(i)
                    common.append(same)
                    union.append(len(x) + len(y) - same)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(common, pa.int32()), pa.array(union, pa.int32())], names=["a", "b", "common", "total"])

    return stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, common int, total int"), "links", PAIRS_IN_BATCH)


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, roots): members has doc_id, cls, n (set size) of every
    row; links has verified pairs (a, b, common, total) of classes that join
    all linked classes; roots has (cls, root) of every linked class."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = _chunks(docs, k, percent, frequency_sketch(docs, k))
    members = chunks.select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("classes").alias("cls"), F.col("sizes").alias("n"))))
    texts_of = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    shared = _shared_prefixes(chunks)
    hubs = shared.where("cls != hub").groupBy(F.col("cls").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("m"), F.max("few").alias("few")).where("m >= few")
    first = _verified(docs, hubs, texts_of, k, percent)
    linked = components(first, "a", "b")

    roots = linked.select(F.col("node").alias("cls"), "root")
    placed = shared.drop("hub").join(sized(roots, 24), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).where("lo != hi").select("token", "least")
    enough = lambda common, a, b: (100 + percent) * common >= percent * (a + b)
    open_rows = placed.join(mixed, "token").where(enough(F.col("before") + F.col("rest"), F.col("n"), F.col("least")))
    open_rows = stored(open_rows.select("token", "cls", "n", "few", "before", "rest", "root"), "open")
    x, y = (open_rows.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "n", "few", "before", "rest", "root")]) for side in "xy")
    rest = F.least("rest_x", "rest_y")
    together = x.join(y, "token").where(
        (F.col("cls_x") < F.col("cls_y")) & (F.col("root_x") != F.col("root_y"))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & enough(F.least("before_x", "before_y") + rest, F.col("n_x"), F.col("n_y")))
    # a pair that reaches the threshold has all its common prefix shingles here: m, and no more than rest - 1 after the last of them
    counted = together.groupBy(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).agg(
        F.count("*").alias("m"), F.min(F.least("few_x", "few_y")).alias("few"), F.min(rest).alias("rest"), F.min("n_x").alias("x"), F.min("n_y").alias("y"))
    rest = counted.where((F.col("m") >= F.col("few")) & enough(F.col("m") + F.col("rest") - 1, F.col("x"), F.col("y")))
    second = _verified(docs, rest, texts_of, k, percent)
    links = first.unionByName(second)
    roots = components(links, "a", "b").select(F.col("node").alias("cls"), "root")
    return members, links, roots.unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **columns) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id (the smallest id among
    the texts that links reach, its own included)."""
    members, _, roots = similar_classes(docs, k, percent, **columns)
    classes = (members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
               .join(roots, "cls", "left"))
    groups = classes.withColumn("group", F.coalesce("root", "cls")).where("copies > 1 OR root IS NOT NULL")
    lowest = groups.groupBy("group").agg(F.min("low").alias("component_id"))
    named = stored(groups.join(lowest, "group").select("cls", "component_id"), "named")
    return members.join(sized(named, 32), "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
