"""Near-duplicate documents by MinHash, with exact confirmation and connected components.

A document's set holds its distinct shingles of k lower-cased words. Documents with equal sets are one
class from the start, so a group of copies counts once in all that follows. Each class has the minima of
128 universal hash functions over its whole set; 32 bands of four minima are its buckets.

1. Each member of a bucket is paired with the bucket's smallest document (no pairs among the others),
   pairs with too few equal minima are left out, the rest is confirmed on the full sets, and
   alternating large-star and small-star steps join the links into components.
2. Buckets whose members still lie in several components are compared whole, in blocks of members, by
   1024 further minima; only pairs across components that are close to the similarity leave a block, so heavily edited
   copies of one text don't leave all their pairs. These are confirmed on the full sets, too.

A link with a similarity of 0.85 shares no bucket with a chance of (1 - 0.85**4)**32 < 6e-11 (0.8: 5e-8) and falls below
the bounds on equal minima, about six standard deviations under the similarity asked for, with a chance below 1e-8.
Every link found is exact.

Defined results: null and empty texts, and texts without words, have an empty set, are linked with nothing and kept; fewer
than k words are one shingle; very long texts are hashed whole; equal similarity links; the smallest
doc_id stands for a component; rows with a null doc_id have a null component and are kept; repeated rows with one
doc_id have the same component and are all given; an empty table gives no row; columns other than
doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, kept, own_columns, shipped, texts

c = F.col
BANDS, ROWS = 32, 4
#: Equal minima may fall this far below the similarity.
SLACK = 0.2
#: Further minima for documents that are still apart in a bucket, how far these may fall below, and documents in a block.
FINE, FINE_SLACK = 1024, 0.075
BLOCK = 2048
#: Rows of a pair of blocks that are compared with all others at once.
STRIP = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS, _TERMS = (np.random.default_rng(seed).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12))
_FINE_FACTORS, _FINE_TERMS = (np.random.default_rng(seed).integers(0, 1 << 32, FINE, dtype=np.uint32) | np.uint32(1) for seed in (21, 22))
_TOGETHER = 2048


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    rolled = np.full(len(single) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        rolled = rolled * _STEP + single[j:j + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over a set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for first in range(0, len(found), _TOGETHER):
        some = found[first:first + _TOGETHER, None]
        least = np.minimum(least, ((some * _FACTORS + _TERMS) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


def fine_minima(found: np.ndarray) -> np.ndarray:
    """One byte of the least value of each of many more hash functions."""
    least = np.full(FINE, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(short), _TOGETHER):
        values = short[first:first + _TOGETHER, None] * _FINE_FACTORS
        values += _FINE_TERMS
        least = np.minimum(least, values.min(axis=0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def buckets(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal minima in different bands."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for j in range(ROWS):
        keys = (keys ^ least.reshape(BANDS, ROWS)[:, j].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("mark", pa.binary())])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest, its bucket keys and the lowest byte of each minimum."""

    def rows(batch: pa.RecordBatch):
        out = {name: [] for name in ("n_shingles", "digest", "keys", "mark")}
        for text in texts(batch.column("text")):
            found = shingles(text, k)
            least = minima(found)
            out["n_shingles"].append(len(found))
            out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            out["keys"].append(buckets(least) if len(found) else [])
            out["mark"].append(least.astype(np.uint8).tobytes())
        yield {"doc_id": batch.column("doc_id")} | out

    return batches(own_columns(docs, "doc_id", "text"), rows, "doc_id long, n_shingles long, digest binary, keys array<long>, mark binary", _SIGNED)


def alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both) > 0


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def confirmed(pairs: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; each row holds two texts."""
    one = whole.select(c("doc_id").alias("a"), c("text").alias("text_a"))
    two = whole.select(c("doc_id").alias("b"), c("text").alias("text_b"))

    def checked(batch: pa.RecordBatch):
        a, b, last, own = [], [], (None, None), None
        for x, y, left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts(batch.column("text_a")), texts(batch.column("text_b"))):
            if last != (x, left):
                last, own = (x, left), shingles(left, k)
            if alike(own, shingles(right, k), percent):
                a.append(x)
                b.append(y)
        yield {"a": a, "b": b}

    return batches(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b"), checked, "a long, b long", _PAIRS)


def with_marks(pairs: DataFrame, marks: DataFrame, least_equal: int) -> DataFrame:
    """The pairs with at least so many equal minima."""
    one, two = marks.select(c("doc_id").alias("a"), c("mark").alias("mark_a")), marks.select(c("doc_id").alias("b"), c("mark").alias("mark_b"))

    def checked(batch: pa.RecordBatch):
        left, right = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for x in ("mark_a", "mark_b"))
        close = pa.array((left == right).sum(axis=1) >= least_equal)
        yield {"a": batch.column("a").filter(close), "b": batch.column("b").filter(close)}

    return batches(pairs.join(two, "b").join(one, "a").select("a", "b", "mark_a", "mark_b"), checked, "a long, b long", _PAIRS)


def fine(whole: DataFrame, k: int) -> DataFrame:
    """doc_id, and in ``mark`` the further minima of documents and the keys of all their buckets."""

    def rows(batch: pa.RecordBatch):
        sets = [shingles(t, k) for t in texts(batch.column("text"))]
        yield {"doc_id": batch.column("doc_id"), "mark": [fine_minima(x).tobytes() + buckets(minima(x)).tobytes() for x in sets]}

    return batches(whole, rows, "doc_id long, mark binary", pa.schema([("doc_id", pa.int64()), ("mark", pa.binary())]))


def close_pairs(marks: np.ndarray, keys: np.ndarray, band: int, allowed: np.ndarray, similarity: float, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the allowed pairs that are close by their first 128 minima, then by all; the first row of ``allowed`` is place ``start``.

    Pairs that share a bucket of an earlier band are left to that one.
    """
    first = np.ascontiguousarray(marks[:, :BANDS * ROWS])
    x, y = np.nonzero(allowed)
    x, out = x + start, []
    for at in range(0, len(x), 1 << 14):
        i, j = x[at:at + (1 << 14)], y[at:at + (1 << 14)]
        close = (first[i] == first[j]).sum(axis=1) >= BANDS * ROWS * (similarity - SLACK)
        close &= ~(keys[i, :band] == keys[j, :band]).any(axis=1)
        i, j = i[close], j[close]
        close = (marks[i] == marks[j]).sum(axis=1) >= FINE * (similarity - FINE_SLACK)
        out.append((i[close], j[close]))
    return tuple(np.concatenate([o[side] for o in out]) if out else np.empty(0, dtype=np.int64) for side in (0, 1))


_MEMBER = ["key", "i", "j", "doc_id", "component", "part", "mark"]


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets with the pairs (i, j) of blocks they belong to; a bucket of up to BLOCK members is one block, and no row is copied."""
    parts = F.ceil(c("n") / BLOCK).cast("int")
    placed = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), c("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    return spread.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select(*_MEMBER)


def across(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components from members (key, n, doc_id, component, mark) of buckets, compared block by block."""
    blocks = in_blocks(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(rows: pa.Table, lo: int, hi: int, name: np.ndarray) -> np.ndarray:
        own = rows.slice(lo, hi - lo)
        ids, component, part = (own.column(x).to_numpy() for x in ("doc_id", "component", "part"))
        if (component == component[0]).all():
            return np.empty((0, 2), dtype=np.int64)
        both = np.frombuffer(b"".join(own.column("mark").to_pylist()), dtype=np.uint8).reshape(-1, FINE + 8 * BANDS)
        keys = np.ascontiguousarray(both[:, FINE:]).view(np.int64)
        band, found = int(np.argmax(keys[0] == name[0])), []
        for at in range(0, len(ids), STRIP):
            some = slice(at, at + STRIP)
            allowed = (component[some, None] != component[None, :]) & (ids[some, None] < ids[None, :])
            if name[1] != name[2]:
                allowed &= part[some, None] != part[None, :]
            x, y = close_pairs(both[:, :FINE], keys, band, allowed, similarity, at)
            found.append(np.column_stack([ids[x], ids[y]]))
        return np.concatenate(found)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(rows: pa.Table, last: bool):
            """The result of all groups but the unfinished one, and the rows of that."""
            names = np.column_stack([rows.column(x).to_numpy() for x in ("key", "i", "j")])
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(names)] if last else []]).astype(np.int64)
            found = [compared(rows, int(lo), int(hi), names[lo]) for lo, hi in zip(bounds[:-1], bounds[1:]) if hi - lo > 1]
            pairs = np.unique(np.concatenate([np.empty((0, 2), dtype=np.int64), *found]), axis=0)
            out = pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], schema=_PAIRS)
            return out, rows.slice(int(bounds[-1]))

        for batch in source:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(rows):
                out, held = groups(rows, False)
                yield out
        if held is not None and len(held):
            yield groups(held, True)[0]

    shipped(members.sparkSession)
    return blocks.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of all nodes but the roots, by alternating large-star and small-star steps.

    A step moves minima with ``groupBy`` and joins them back, so a node with very many links is never one task's group.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(c("v").alias("u"), c("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(c("v").alias("u"), c("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(c("v").alias("x"), c("m").alias("y"))
        small = small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        edges = kept(small.unionByName(least.select("u", c("m").alias("v"))).distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(c("u").alias("node"), c("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each document.

    Linked are documents with 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.
    """
    found = kept(signed(docs, k), "signed")
    least_equal = int(BANDS * ROWS * (percent / 100 - SLACK))
    full = found.where("n_shingles > 0 and doc_id is not null")
    classes = kept(full.groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
    firsts = full.join(classes.select(c("first").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    firsts = kept(firsts.select("doc_id", "keys", "mark"), "firsts")
    marks = firsts.select("doc_id", "mark")
    in_bucket = firsts.select("doc_id", F.explode("keys").alias("key"))
    shared = in_bucket.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("a <> z").drop("z")
    members = kept(in_bucket.join(shared, "key").select("key", "n", "a", "doc_id"), "members")
    tested = kept(with_marks(members.where("doc_id <> a").select("a", c("doc_id").alias("b")).distinct(), marks, least_equal), "tested")
    some = members.select("doc_id").distinct()
    whole = kept(own_columns(docs, "doc_id", "text").join(some, "doc_id", "left_semi"), "whole")
    links = kept(confirmed(tested, whole, k, percent), "confirmed")
    stars = components(links)
    placed = members.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("root", "doc_id"))
    placed = kept(placed.select("key", "n", "doc_id", "component"), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_members = kept(placed.join(split, "key", "left_semi"), "open")
    marks = fine(whole.join(open_members.select("doc_id").distinct(), "doc_id", "left_semi"), k)
    more = kept(across(open_members.join(marks, "doc_id"), percent / 100).join(tested, ["a", "b"], "left_anti"), "more")
    more_links = confirmed(more, whole, k, percent)
    stars = components(stars.select(c("node").alias("a"), c("root").alias("b")).unionByName(more_links))
    by_digest = classes.join(stars, c("first") == c("node"), "left").select("digest", F.coalesce("root", "first").alias("component"))
    result = found.select("doc_id", "n_shingles", F.when(c("n_shingles") > 0, c("digest")).alias("digest")).join(by_digest, "digest", "left")
    component = F.when(c("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(c("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_originals(docs: DataFrame, originals: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose text in ``originals`` is a near duplicate of that of another one in ``docs``.

    For texts that are cut already, which may not be alike any more. Only doc_ids that one row of
    ``originals`` holds take part; others stay.
    """
    once = originals.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    once = kept(once.join(docs.select("doc_id"), "doc_id", "left_semi"), "once")
    return _without(docs, near_duplicates(own_columns(originals, "doc_id", "text").join(once, "doc_id", "left_semi"), k, percent))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    gone = found.where("not kept").select(c("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those of which a component keeps another one, with all their columns."""
    return _without(docs, near_duplicates(docs, k, percent))
