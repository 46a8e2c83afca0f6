"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

The letters fall into groups; a word's frequency vector holds how many letters of each group it has. One inserted, deleted
or replaced letter changes the vector by a surplus of one at most and a deficit of one at most. The trie
arranges words by the successive counts. Its upper levels are a table of nodes: a node with over ``SHARD`` words is inner, any
other ends a shard of the trie. Words go down these levels as joins, with the budget they have left, and reach each
shard that can hold a near word. Below, each task holds one shard and a bounded block of the words that reach it, and goes depth
first through the trie, all words of the block at once; a subtree is left out when no word has budget for it. In a leaf
the rest of the vectors is compared and each pair left is verified letter by letter.

A shard can be larger only if its words have all counts in common; such words are all anagrams, but for the last group.
Forms lead to words at least twice as frequent, so chains are short; roots are found by pointer doubling.

Defined results: a null text has no word; a run of a row without doc_id is never damaged (its key is null); repeated rows count
each; equal counts are settled by code-point order; an empty table gives no row; texts and runs of any length are read
whole. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, own_columns, shipped

c = F.col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED_ONE_IN = 97
MIN_CHARS, MIN_COUNT = 5, 3
#: Maximal runs that can give a word: a shorter one gets no longer by the loss of a letter.
RUN = f"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}"
FORM_TIMES = 2
#: Letter groups from the most to the least frequent letters; all other letters are the last group.
GROUPS = ("e", "n", "a", "i", "t", "r", "o", "s", "u", "l", "h", "d", "cm", "bgp", "fvwy", "jkqxz")
LEVELS = len(GROUPS) + 1
SHARD = 16_384
BLOCK = 65_536
LEAF = 24
#: Nodes of a level are broadcast up to this number, joined by a shuffle beyond it.
FEW_NODES = 10_000
_PAIRS = 400_000


def occurrences(docs: DataFrame) -> DataFrame:
    """One row for each run of at least five letters, lower-cased; one in 97 (run, document) pairs has lost a letter."""
    run = own_columns(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = run.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat(c("doc_id").cast("string"), F.lit(":"), c("run")), "UTF-8"))
    run = run.select("run", h.alias("h"))
    gone = F.expr("CAST(h % length(run) AS INT)")
    cut = F.concat(F.substring(c("run"), F.lit(1), gone), F.substring(c("run"), gone + 2, F.length("run")))
    return run.select(F.when(c("h") % DAMAGED_ONE_IN == 0, cut).otherwise(c("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words of at least five letters that occur three times or more, with their number."""
    words = occurrences(docs).where(F.length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(c("n") >= MIN_COUNT)


def vector() -> Column:
    """Counts of the letter groups of ``word``."""
    size = F.length("word")
    counts = [size - F.length(F.translate("word", letters, "")) for letters in GROUPS]
    return F.array(*counts, size - reduce(lambda a, b: a + b, counts))


def reach(words: DataFrame, shard: int) -> DataFrame:
    """(word, n, shard, up, down): every shard that a word can reach, with the surplus and deficit spent on the way.

    Level by level: the words that reach a node without spending anything are its own, so their number is its size.
    """
    front = words.select("word", "n", "v", F.array().cast("array<int>").alias("shard"), F.lit(0).alias("up"), F.lit(0).alias("down"))
    if words.limit(shard + 1).count() <= shard:
        return front.drop("v")
    found = []
    for level in range(1, LEVELS + 1):
        own = front.where("up = 0 AND down = 0").select(F.concat("shard", F.array(F.element_at("v", level))).alias("shard"))
        nodes = kept(own.groupBy("shard").agg(F.count("*").alias("size")), "spelling-nodes")
        few = nodes.limit(FEW_NODES + 1).count() <= FEW_NODES
        step = front.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        count = F.element_at("v", level) + c("step")
        step = step.withColumn("up", c("up") + F.greatest("step", F.lit(0))).withColumn("down", c("down") - F.least("step", F.lit(0)))
        step = step.where((c("up") <= 1) & (c("down") <= 1) & (count >= 0)).withColumn("shard", F.concat("shard", F.array(count))).drop("step")
        step = kept(step.join(F.broadcast(nodes) if few else nodes, "shard"), "spelling-reach")
        inner = (c("size") > shard) & F.lit(level < LEVELS)
        found.append(step.where(~inner).select("word", "n", "shard", "up", "down"))
        front = step.where(inner).drop("size")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _grouped() -> np.ndarray:
    of = np.full(256, len(GROUPS), dtype=np.int64)
    for k, letters in enumerate(GROUPS):
        of[list(letters.encode("latin-1"))] = k
    return of


_GROUP = _grouped()


def vectors(words: list[bytes]) -> np.ndarray:
    """Frequency vectors of words in Latin-1."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    at = np.repeat(np.arange(len(words)), sizes) * LEVELS + _GROUP[np.frombuffer(b"".join(words), dtype=np.uint8)]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


class Padded:
    """Words of up to ``WIDTH`` letters as rows of a matrix, also aligned at the right end."""

    WIDTH = 24

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        short = [w if len(w) <= self.WIDTH else b"" for w in words]
        shape = lambda rows: np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(words), self.WIDTH)
        self.left, self.right = shape([w.ljust(self.WIDTH, b"\0") for w in short]), shape([w.rjust(self.WIDTH, b"\0") for w in short])


def verified(one: Padded, i: np.ndarray, other: Padded, j: np.ndarray) -> np.ndarray:
    """Mask of the pairs of words that are exactly one edit apart."""
    out = np.zeros(len(i), dtype=bool)
    a, b = one.size[i], other.size[j]
    long = (a > Padded.WIDTH) | (b > Padded.WIDTH)
    for k in np.flatnonzero(long):
        out[k] = one_edit(one.words[i[k]], other.words[j[k]])
    short = np.flatnonzero(~long & (np.abs(a - b) <= 1))
    if len(short):
        i, j, a, b = i[short], j[short], a[short], b[short]
        unlike = one.left[i] != other.left[j]
        head = np.argmax(unlike, axis=1)  # letters in common from the left
        tail = np.argmax((one.right[i] != other.right[j])[:, ::-1], axis=1)
        out[short] = unlike.any(axis=1) & (head + tail >= np.maximum(a, b) - 1)
    return out


def search(members: list[bytes], asked: list[bytes], up: np.ndarray, down: np.ndarray, level: int, leaf: int = LEAF):
    """Yield (asked, member) index arrays of the words one edit apart; ``level`` counts are settled and ``up``, ``down`` spent on them."""
    tree, wanted = vectors(members), vectors(asked)
    order = np.lexsort(tree.T[::-1])  # by the successive counts: a node of the trie is a run of rows
    tree, members = tree[order], [members[k] for k in order]
    mine, theirs = Padded(members), Padded(asked)
    waiting, n_waiting = [], 0

    def check():
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        good = verified(theirs, i, mine, j)
        return i[good], order[j[good]]

    stack = [(0, len(members), level, np.arange(len(asked)), up.astype(np.int32), down.astype(np.int32))]
    while stack:
        lo, hi, at, alive, up, down = stack.pop()
        if hi - lo <= leaf or at == LEVELS:
            size = max(1, _PAIRS // ((hi - lo) * max(1, LEVELS - at)))
            for k in range(0, len(alive), size):
                some = alive[k:k + size]
                over, under = np.repeat(up[k:k + size, None], hi - lo, axis=1), np.repeat(down[k:k + size, None], hi - lo, axis=1)
                for g in range(at, LEVELS):
                    diff = tree[None, lo:hi, g] - wanted[some, g, None]
                    over += np.maximum(diff, 0)
                    under -= np.minimum(diff, 0)
                i, j = np.nonzero((over <= 1) & (under <= 1))
                if len(i):
                    waiting.append((some[i], lo + j))
                    n_waiting += len(i)
                if n_waiting > _PAIRS:
                    yield check()
                    waiting, n_waiting = [], 0
            continue
        column = tree[lo:hi, at]
        edges = np.flatnonzero(column[1:] != column[:-1]) + 1 + lo
        counts = wanted[alive, at]
        for a, b in zip([lo, *edges], [*edges, hi], strict=True):
            diff = tree[a, at] - counts
            over, under = up + np.maximum(diff, 0), down - np.minimum(diff, 0)
            live = (over <= 1) & (under <= 1)
            if live.any():
                stack.append((int(a), int(b), at + 1, alive[live], over[live], under[live]))
    if waiting:
        yield check()


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n): how many words are one edit away, and the most frequent of them, for words that have any."""
    reached = kept(reach(words.withColumn("v", vector()), shard), "spelling-reached")
    sizes = reached.groupBy("shard").agg((F.floor((F.count("*") - 1) / block) + 1).cast("int").alias("blocks"))
    sizes = kept(sizes, "spelling-sizes")
    sizes = F.broadcast(sizes) if sizes.limit(FEW_NODES + 1).count() <= FEW_NODES else sizes
    both = reached.join(sizes, "shard")
    asked = both.withColumn("block", F.expr("pmod(xxhash64(word), blocks)").cast("int"))
    members = both.where("up = 0 AND down = 0").withColumn("block", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))

    result = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.int64()), ("form", pa.string())])

    def found(members: pa.Table, asked: pa.Table) -> pa.Table:
        nothing = result.empty_table()
        if not len(members) or not len(asked):
            return nothing
        mine, theirs = members["word"].to_pylist(), asked["word"].to_pylist()
        n = members["n"].to_numpy()
        alphabetical = np.empty(len(mine), dtype=np.int64)
        alphabetical[sorted(range(len(mine)), key=mine.__getitem__)] = np.arange(len(mine))
        coded = lambda words: [w.encode("latin-1") for w in words]
        parts = list(search(coded(mine), coded(theirs), asked["up"].to_numpy(), asked["down"].to_numpy(), len(members["shard"][0])))
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [])
        if not len(i):
            return nothing
        order = np.lexsort((alphabetical[j], -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        return pa.table([[theirs[k] for k in i[first]], np.diff(np.r_[first, len(i)]), n[j[first]], [mine[k] for k in j[first]]], schema=result)

    shipped(words.sparkSession)
    members = members.select(*(c(x).alias(x) for x in ("shard", "block", "word", "n")))  # new columns, so that the two sides can't be mixed up
    pairs = (members.groupBy("shard", "block").cogroup(asked.select("shard", "block", "word", "up", "down").groupBy("shard", "block"))
             .applyInArrow(found, "word string, n_near long, best long, form string"))
    best = F.min(F.struct((-c("best")).alias("less"), c("form").alias("form")))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", c("b.form").alias("form"), (-c("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by pointer doubling, until nothing moves."""
    links = kept(forms.select("word", c("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(c("word").alias("root"), c("root").alias("ahead"))
        links = kept(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), c("ahead").isNotNull().alias("moved")), "spelling-roots")
        moved = not links.where("moved").isEmpty()
        links = links.drop("moved")
        if not moved:
            return links


def variants(docs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Every word with its number, near words, form (the usual spelling one edit away) and root."""
    words = kept(vocabulary(docs), "spelling-words")
    near = kept(near_words(words, shard, block), "spelling-near")
    usual = c("form_n") >= FORM_TIMES * c("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, c("form")).alias("form"), F.when(usual, c("form_n")).alias("form_n"))
    table = kept(table, "spelling-forms")
    return table.join(roots(table.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
