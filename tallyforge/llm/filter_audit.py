"""Filter interaction audit: what each of five filters removes, alone and in every order.

A byte transducer makes one pass over the UTF-8 bytes of the texts. ``CLASS`` maps a byte to its class,
``NEXT`` a state and a class to the next state, ``ACT`` a state and the next one to what is put out (a word starts or ends).
All classes lead to one state from every state, so the tables are applied to whole blocks of bytes by numpy;
at the end of a document the state goes back to "between words". The spans put out are inserted into an
open-addressing hash table, in which a span counts as known only after its bytes are compared. Blocks
are whole documents, up to 4 MB; a longer document is cut between words and keeps its table over the blocks.

Copies are found by the SHA-256 of the text: rows are first summed for each (text, part, labels), so a text that
most rows share is a few rows when the smallest doc_id of a text is sought. The audit itself needs only the
counts of each set of failed filters; the 120 orders are worked out on those few rows.

Defined results: a null text is the empty one; a null lang and an empty one are the part ''. Repeated rows of a doc_id
are rows of their own, and none of them is a copy of the other (no doc_id is smaller); a row without doc_id is no
copy and makes none. Labels of a doc_id with several rows are 1 if any row says so; documents without a label
lose neither good nor toxic ones. An empty table gives no row. Columns that the operator does not name are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

c = F.col

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
MIN_WORDS = 200
BLOCK = 4 << 20

BLANK, INNER, CAPITAL, SYMBOL, LEAD = range(5)
CLASS = np.full(256, LEAD, dtype=np.uint8)
CLASS[0x80:0xC0] = INNER  # goes on with a code point
CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASS[list(range(ord("A"), ord("Z") + 1))] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL
BETWEEN, WORD = 0, 1
#: The next state for (state, class); every class leads to one state.
NEXT = np.array([[BETWEEN, WORD, WORD, WORD, WORD]] * 2, dtype=np.uint8)
STARTS, ENDS = 1, 2
#: What is put out between a state and the next one.
ACT = np.array([[0, STARTS], [ENDS, 0]], dtype=np.uint8)

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)  # the first k bytes of eight
_LONG = 64  # bytes; longer words are rare and are hashed and compared one by one


class Spans:
    """Open-addressing hash table of word spans of one buffer; equal means same document and same bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes = data
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[:len(data)] = data
        self.eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.keys = tuple(np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int64, np.uint64))  # start, size, document, hash

    def hashed(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = (doc.astype(np.uint64) * _K2) ^ size.astype(np.uint64)
        live = np.flatnonzero(size <= _LONG)
        for at in range(0, _LONG, 8):
            if not len(live):
                break
            part = self.eight[start[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
            mixed = (out[live] ^ part) * _K1
            out[live] = mixed ^ (mixed >> np.uint64(29))
            live = live[size[live] > at + 8]
        for k in np.flatnonzero(size > _LONG):
            word = self.bytes[start[k]:start[k] + size[k]]
            out[k] ^= np.uint64(zlib.crc32(word) | zlib.adler32(word) << 32)
        out *= _K2
        return out ^ (out >> np.uint64(32))

    def same(self, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of ``size`` bytes at these places hold the same bytes."""
        equal = np.ones(len(one), dtype=bool)
        live = np.flatnonzero(size <= _LONG)
        for at in range(0, _LONG, 8):
            if not len(live):
                break
            unlike = (self.eight[one[live] + at] ^ self.eight[other[live] + at]) & _LOW[np.minimum(size[live] - at, 8)]
            equal[live[unlike != 0]] = False
            live = live[(unlike == 0) & (size[live] > at + 8)]
        for k in np.flatnonzero(size > _LONG):
            equal[k] = np.array_equal(self.bytes[one[k]:one[k] + size[k]], self.bytes[other[k]:other[k] + size[k]])
        return equal

    def insert(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Insert spans; True for each that is new, one of equal spans."""
        base, fresh = len(self.keys[0]), np.zeros(len(start), dtype=bool)
        keys = (start, size, doc, self.hashed(start, size, doc))
        self.keys = tuple(np.concatenate(k) for k in zip(self.keys, keys, strict=True))
        if 2 * len(self.keys[0]) > len(self.slots):
            self.slots = np.full(1 << int(4 * len(self.keys[0]) - 1).bit_length(), -1, dtype=np.int64)
            self.place(np.arange(base))  # those are all unlike
        fresh[self.place(np.arange(base, base + len(start))) - base] = True
        self.keys = tuple(np.concatenate([k[:base], k[base:][fresh]]) for k in self.keys)
        number = np.cumsum(fresh) - 1 + base  # the table names spans by their place among those that stay
        moved = np.flatnonzero(self.slots >= base)
        self.slots[moved] = number[self.slots[moved] - base]
        return fresh

    def place(self, spans: np.ndarray) -> np.ndarray:
        """Probe for all spans at once, round by round; gives those that found a free slot."""
        starts, sizes, docs, hashes = self.keys
        mask, new = len(self.slots) - 1, []
        slot = (hashes[spans] & np.uint64(mask)).astype(np.int64)
        while len(spans):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = spans[free]  # of several for one slot the last one gets it
            owner = self.slots[slot]
            mine = owner == spans
            new.append(spans[mine])
            known = ~mine & (hashes[owner] == hashes[spans]) & (sizes[owner] == sizes[spans]) & (docs[owner] == docs[spans])
            at = np.flatnonzero(known)
            known[at] = self.same(starts[owner[at]], starts[spans[at]], sizes[spans[at]])
            left = ~(mine | known)
            spans, slot = spans[left], (slot[left] + 1) & mask
        return np.concatenate(new) if new else spans


def transduce(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the bytes, and starts and ends of the words; ``first`` are the places where documents begin."""
    classes = CLASS[data]
    state = NEXT[BETWEEN][classes]
    before, after = np.empty_like(state), np.empty_like(state)
    before[1:], after[:-1] = state[:-1], state[1:]
    before[first[first < len(data)]] = BETWEEN  # place 0 is among them
    last = first[(first > 0) & (first <= len(data))] - 1
    after[last] = BETWEEN
    after[-1:] = BETWEEN
    return classes, np.flatnonzero(ACT[before, state] & STARTS), np.flatnonzero(ACT[state, after] & ENDS) + 1


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most BLOCK bytes together; a longer one stands alone."""
    begin = 0
    for k in range(1, len(offsets)):
        if offsets[k] - offsets[begin] > BLOCK and k - 1 > begin:
            yield begin, k - 1
            begin = k - 1
    if begin < len(offsets) - 1:
        yield begin, len(offsets) - 1


def cuts(data: np.ndarray, step: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Pieces of a long document that end behind a blank, or at its end."""
    begin = 0
    while begin < len(data):
        end = min(begin + step, len(data))
        while end < len(data) and CLASS[data[end - 1]] != BLANK:
            ahead = np.flatnonzero(CLASS[data[end:end + step]] == BLANK)
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + step, len(data))
        yield begin, end
        begin = end


def measure_bytes(data: np.ndarray, offsets: np.ndarray, step: int = BLOCK) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of the documents between the offsets of one buffer."""
    n = len(offsets) - 1
    out = {name: np.zeros(n, dtype=np.int64) for name in ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")}
    for begin, end in blocks(offsets):
        part = data[offsets[begin]:offsets[end]]
        edges = offsets[begin:end + 1] - offsets[begin]
        table = Spans(part)
        for a, b in cuts(part, step) if end == begin + 1 else [(0, len(part))]:
            inside = np.clip(edges, a, b) - a
            classes, starts, ends = transduce(part[a:b], inside[:-1])
            if not len(classes):
                continue
            of = lambda places: np.diff(np.searchsorted(places, inside))
            out["n_words"][begin:end] += of(starts)
            out["n_capitals"][begin:end] += of(np.flatnonzero(classes == CAPITAL))
            out["n_symbols"][begin:end] += of(np.flatnonzero(classes == SYMBOL))
            out["n_chars"][begin:end] += np.diff(inside) - of(np.flatnonzero(classes == INNER))
            doc = np.searchsorted(inside, starts, side="right") - 1
            fresh = table.insert(starts + a, ends - starts, doc)
            out["n_distinct"][begin:end] += np.bincount(doc[fresh], minlength=end - begin)
    return out


_FIELDS = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("n_capitals", pa.int64()),
           ("n_chars", pa.int64()), ("n_symbols", pa.int64()), ("text_sha", pa.binary())]
_SCHEMA = "doc_id long, lang string, n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long, text_sha binary"


def measures(docs: DataFrame) -> DataFrame:
    """One row for each document: the transducer's counts and the SHA-256 of the text."""

    def measured(batch: pa.RecordBatch):
        column = batch.column("text").cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "text_sha": digests} | measure_bytes(data, offsets)

    return batches(docs.select("doc_id", c("lang").cast("string").alias("lang"), "text"), measured, _SCHEMA, pa.schema(_FIELDS))


def text_failures() -> Column:
    """Bits of the filters A to D that a row of ``measures`` fails."""
    failed = (c("n_words") < MIN_WORDS, 100 * c("n_distinct") < 50 * c("n_words"), 100 * c("n_capitals") > 3 * c("n_chars"), c("n_symbols") > 0)
    return sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones of each part and set of failed filters: (part, failed, n, good, toxic)."""
    copy = 1 << FILTERS.index("E")
    # a row without doc_id gets a key of its own text, so that such rows don't meet in one task
    rows = measures(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures().alias("failed"), "text_sha",
                                 F.coalesce(c("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("text_sha"))).alias("key"))
    known = labels.where("doc_id IS NOT NULL").groupBy(c("doc_id").cast("string").alias("key")).agg(
        F.max(c("quality") == 1).alias("good"), F.max(c("toxic") == 1).alias("toxic"))
    yes = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    marked = rows.join(known, "key", "left").select("key", "doc_id", "part", "failed", "text_sha", yes("good"), yes("toxic"))
    text = ["text_sha", "part", "failed", "good", "toxic"]
    each = marked.groupBy("key", "doc_id", *text).agg(F.count("*").alias("n"))  # stays where the join left it
    summed = each.groupBy(*text).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
                                     F.sum(F.when(c("doc_id").isNull(), c("n")).otherwise(0)).alias("n_none"))
    # as many rows of a text as it has (part, labels), not as it has copies
    least = summed.groupBy("text_sha").agg(F.min("first").alias("least"))
    both = summed.join(least, "text_sha")
    firsts = c("n_none") + F.when(c("first") == c("least"), c("n_first")).otherwise(0)
    split = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct(c("failed").alias("failed"), firsts.alias("n")), F.struct((c("failed") + copy).alias("failed"), (c("n") - firsts).alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", c("x.failed").alias("failed")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(c("good"), c("x.n")).otherwise(0)).alias("good"), F.sum(F.when(c("toxic"), c("x.n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what stays, what goes here, and what the step's filter does beside the others."""
    orders = F.explode(F.split(F.lit(",".join(ORDERS)), ","))
    rows = failure_counts(docs, labels).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    this = sum((F.when(p == c("step"), F.lit(1 << k)).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    earlier = sum((F.when(p < c("step"), F.lit(1 << k)).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    fails, gone = c("failed").bitwiseAND(this) != 0, c("failed").bitwiseAND(earlier) != 0
    here = fails & ~gone
    total = lambda when, what: F.sum(F.when(when, what).otherwise(F.lit(0))).cast("long")
    # a document that fails k filters goes by each of them in 120 / k of the orders
    share = c("n") * (len(ORDERS) / F.bit_count("failed")).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, c("n")).alias("kept"), total(here, c("n")).alias("removed"), total(fails & gone, c("n")).alias("redundant"),
        total(c("failed") == this, c("n")).alias("unique_fails"), total(here, c("good")).alias("good_lost"),
        total(here, c("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))
