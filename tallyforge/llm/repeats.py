"""Removal of repeated passages by seed and extend.

Seeds are the winnowed word n-grams of a text: of every 20-word window the n-gram with the least hash, so
two equal windows have the same seed at the same place. Seeds found once in the whole corpus are let go.
Around each repeated seed the match is extended both ways to the windows that hold it; of each such window
the first document is found, and what later ones share with it is removed. Overlapping windows of a text
join into the maximal repeats.

Documents with the same words as an earlier one are removed whole by the digest of their words and take no
part in the rest, so a group of copies is one text to it. Seeds and windows are summed before they are
shuffled, and joined back in joins whose one side has unique keys, which Spark can split where a key is hot.
Texts without a repeated seed are never shuffled with their windows. Windows are compared by 96 bits of hash.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; very long texts are
read whole; of equal windows the one with the smallest doc_id, then start, stays; rows with a null doc_id lose
nothing and take nothing; repeated rows with one doc_id and text are treated alike; rows of one doc_id with other texts are
documents of their own, none of which comes earlier than the other; an
empty table gives no row; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, kept, own_columns, sha256, texts

c = F.col
WINDOW, SEED = 20, 6
_STEP, _SMALL_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)
_EMPTY = sha256(b"")
BLANKS = r"[\x20\x09-\x0D]+"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, n: int, step=_STEP) -> np.ndarray:
    """A hash of each window of n."""
    out = np.zeros(len(hashes) - n + 1, dtype=hashes.dtype)
    for j in range(n):
        out = out * step + hashes[j:j + len(out)]
    return out


class Winnowed:
    """Hashes of a text's windows, and the place of the seed of each."""

    def __init__(self, words: list[bytes], window: int, seed: int):
        self.hashes = word_hashes(words)
        grams = rolled(self.hashes, seed)
        grams ^= grams >> np.uint64(31)
        self.grams = grams * np.uint64(0xD6E8FEB86659FD93)
        inside = np.lib.stride_tricks.sliding_window_view(self.grams, window - seed + 1)
        self.seed_of = inside.argmin(axis=1) + np.arange(len(inside))


_READ = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def seeded(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, n_words, the digest of all words, and the seeds with their places."""

    def read(batch: pa.RecordBatch):
        out = {name: [] for name in ("n_words", "whole", "seeds", "places")}
        for text in texts(batch.column("text")):
            words = (text or b"").split()
            out["n_words"].append(len(words))
            out["whole"].append(sha256(b" ".join(words)))
            if len(words) < window:
                out["seeds"].append([])
                out["places"].append([])
                continue
            own = Winnowed(words, window, seed)
            places = np.unique(own.seed_of)
            out["seeds"].append(own.grams[places].view(np.int64))
            out["places"].append(places.astype(np.int32))
        yield {"doc_id": batch.column("doc_id")} | out

    return batches(own_columns(docs, "doc_id", "text"), read, "doc_id long, n_words long, whole string, seeds array<long>, places array<int>", _READ)


_EXTENDED = pa.schema([("doc_id", pa.int64()), ("whole", pa.string()), ("text", pa.string()), ("windows", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32())),
                       ("starts", pa.list_(pa.int32())), ("own", pa.list_(pa.int32()))])


def extended(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """From doc_id, text and the places of repeated seeds: the windows that hold them, first and (``own``) later ones of the text."""

    def read(batch: pa.RecordBatch):
        out = {name: [] for name in ("whole", "text", "windows", "checks", "starts", "own")}
        for text, places in zip(texts(batch.column("text")), batch.column("places")):
            words = text.split()
            own = Winnowed(words, window, seed)
            repeated = np.zeros(len(words), dtype=bool)
            repeated[places.values.to_numpy()] = True
            starts = np.flatnonzero(repeated[own.seed_of])
            wide = rolled(own.hashes, window)[starts]
            check = rolled((own.hashes >> np.uint64(17)).astype(np.uint32), window, _SMALL_STEP)[starts]
            both = np.rec.fromarrays([wide, check], names="a,b")
            _, first = np.unique(both, return_index=True)
            first.sort()
            joined = b" ".join(words)
            out["whole"].append(sha256(joined))
            out["text"].append(joined.decode())
            out["windows"].append(wide[first].view(np.int64))
            out["checks"].append(check[first].view(np.int32))
            out["starts"].append(starts[first].astype(np.int32))
            out["own"].append(np.delete(starts, first).astype(np.int32))
        yield {"doc_id": batch.column("doc_id")} | out

    return batches(rows.select("doc_id", "text", "places"), read,
                   "doc_id long, whole string, text string, windows array<long>, checks array<int>, starts array<int>, own array<int>", _EXTENDED)


def spans_of(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Mask of the words that the windows cover."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


_CUT = pa.schema([("doc_id", pa.int64()), ("whole", pa.string()), ("kept_text", pa.string()), ("removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())])))])


def cut(rows: DataFrame, window: int) -> DataFrame:
    """The text without the words its ``own`` and ``later`` windows cover, and the maximal repeats that went."""

    def read(batch: pa.RecordBatch):
        out = {name: [] for name in ("kept_text", "removed", "spans")}
        for text, own, later in zip(texts(batch.column("text")), batch.column("own").to_pylist(), batch.column("later").to_pylist()):
            words = text.split(b" ")
            gone = spans_of(np.array(own + (later or []), dtype=np.int64), len(words), window)
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            out["kept_text"].append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            out["removed"].append(int(gone.sum()))
            out["spans"].append([{"start": int(a), "n_words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
        yield {"doc_id": batch.column("doc_id"), "whole": batch.column("whole")} | out

    return batches(rows.select("doc_id", "whole", "text", "own", "later"), read,
                   "doc_id long, whole string, kept_text string, removed long, spans array<struct<start:long,n_words:long>>", _CUT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, and for those that lose a part only ``kept_text`` and ``spans`` (start, n_words)."""
    read = kept(seeded(docs, window, seed), "seeded")
    classes = read.where(f"n_words >= {window} and doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("first"))
    classes = kept(classes, "classes")
    # a text's first document stands for all its copies
    firsts = read.join(classes.select("whole", c("first").alias("doc_id")), ["doc_id", "whole"], "left_semi")
    own = ["doc_id", "mark"]  # a short hash of the text's digest tells the texts of one doc_id apart
    mark = F.xxhash64("whole").alias("mark")
    found = firsts.select("doc_id", mark, F.explode(F.arrays_zip("seeds", "places")).alias("x")).select(*own, c("x.seeds").alias("seed"), c("x.places").alias("place"))
    found = kept(found, "seeds")
    again = found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    places = found.join(again, "seed").groupBy(*own).agg(F.collect_set("place").alias("places"))  # at most the places of a text
    places = kept(places, "places")
    whole = F.sha2(F.trim(F.regexp_replace("text", BLANKS, " ")), 256)  # of the words joined by one space
    first_texts = own_columns(docs, "doc_id", "text").withColumn("mark", F.xxhash64(whole)).join(places, own)
    wide = kept(extended(first_texts, window, seed), "extended")
    windows = wide.select("doc_id", mark, F.explode(F.arrays_zip("windows", "checks", "starts")).alias("x")).select(
        *own, c("x.windows").alias("window"), c("x.checks").alias("check"), c("x.starts").alias("start"))
    origin = windows.groupBy("window", "check").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin < last").drop("last")
    later = windows.join(origin, ["window", "check"]).where("doc_id > origin").groupBy(*own).agg(F.collect_set("start").alias("later"))  # at most the words of a text
    later = kept(later, "later")
    done = kept(cut(wide.withColumn("mark", mark).join(later, own, "left").where("size(own) > 0 or later is not null"), window), "cut").dropDuplicates(["doc_id", "whole"])
    rows = read.select("doc_id", "n_words", "whole").join(classes, "whole", "left").join(done, ["doc_id", "whole"], "left")
    copy = F.coalesce(c("doc_id") > c("first"), F.lit(False))
    return rows.select("doc_id", "n_words", F.when(copy, c("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                       F.when(copy, F.lit(_EMPTY)).when(c("removed").isNotNull(), F.sha2("kept_text", 256)).otherwise(c("whole")).alias("kept_sha256"),
                       F.when(copy, F.lit("")).otherwise(c("kept_text")).alias("kept_text"), "spans")
