"""Removal of repeated chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of each line and the one before it decides where chunks end: at lines whose hash is less than
those of the lines beside them, one line in three. So chunks of equal
lines have equal bounds wherever they stand, and a chunk has two lines at least: a line left over at either end joins its
neighbours. A line of 50 words or more is a chunk of its own. Chunks with several lines that are not blank, or with 50 words, are
counted by their hash over all documents; the first (smallest doc_id, then place) stays. Of each repeated chunk
the first one's bytes travel to the documents that repeat it, where a chunk goes only if its bytes are
the same.

Only hashes are counted; a chunk that a third of the documents share is summed before the shuffle, and
the join that carries its bytes can be split by Spark, as its other side has one row per chunk.

Defined results: null texts stay null and empty ones empty; rows with a null doc_id are left as they are; chunks
of one line with fewer words always stay; a text may become empty; very long texts are cut into chunks whole; repeated rows with one
doc_id and text are treated alike, and chunks that repeat within one text go, too; an empty table gives no row; other columns are kept and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

c = F.col
#: Chunks with fewer lines than this stay, unless they have so many words; a line of so many words is a chunk.
LEAST_LINES, LONG_WORDS = 2, 50
_WORD = r"[^\x20\x09-\x0D]+"


def long(text: Column) -> Column:
    """Whether a text has LONG_WORDS words or more; few lines are long enough to be cut into words for it."""
    return (F.length(text) >= 2 * LONG_WORDS - 1) & (F.regexp_count(text, F.lit(_WORD)) >= LONG_WORDS)


def chunked(rows: DataFrame) -> DataFrame:
    """Add ``_chunks``, the texts of the chunks of ``_text`` in order. Steps are columns of their own, so each is worked out once."""
    hashed = rows.withColumn("_lines", F.split("_text", "\n", -1)).withColumn("_hashes", F.transform("_lines", lambda line: F.md5(line)))
    rolled = F.zip_with("_hashes", F.concat(F.array(F.lit("")), F.slice("_hashes", 1, F.size("_hashes") - 1)),
                        lambda own, before: F.conv(F.substring(F.md5(F.concat(own, before)), 1, 8), 16, 10).cast("long"))
    ended = hashed.withColumn("_rolled", rolled).withColumn("_long", F.transform("_lines", long))
    last = F.size("_lines") - 1
    at = lambda i: F.coalesce(F.get("_long", i), F.lit(False))
    least = lambda h, i: (i > 0) & (i < last - 1) & ~at(i - 1) & ~at(i + 2) & (h < F.get("_rolled", i - 1)) & (h <= F.get("_rolled", i + 1))
    ends = F.transform("_rolled", lambda h, i: F.when((i == last) | at(i) | at(i + 1) | least(h, i), i).otherwise(-1))
    ended = ended.withColumn("_ends", F.filter(ends, lambda i: i >= 0))
    starts = F.concat(F.array(F.lit(-1)), F.slice("_ends", 1, F.size("_ends") - 1))
    text = F.zip_with("_ends", starts, lambda end, before: F.array_join(F.slice("_lines", before + 2, end - before), "\n"))
    return ended.withColumn("_chunks", text).drop("_lines", "_hashes", "_rolled", "_long", "_ends")


def counts(chunk: Column, least_lines: int) -> Column:
    """Whether a chunk has so many lines with a character that is not blank, or the words of a long line."""
    return (F.size(F.filter(F.split(chunk, "\n", -1), lambda line: line.rlike(r"[^ \t\r]"))) >= least_lines) | long(chunk)


def deduplicate_lines(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and the numbers of all and of removed chunks."""
    own = docs.select(c("doc_id").alias("_doc"), c("text").alias("_text")).where("_doc is not null and _text is not null")
    # the outer forms of explode: the plain ones add a filter that would work out all steps once more for each text
    placed = chunked(own).select("_doc", F.posexplode_outer("_chunks").alias("_at", "_chunk"))
    seen = kept(placed.where(counts(c("_chunk"), least_lines)).select("_doc", "_at", F.xxhash64("_chunk").alias("_hash")), "chunks")
    first = seen.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(F.struct("_doc", "_at")).alias("_first")).where("_n > 1")
    first = kept(first.select("_hash", c("_first._doc").alias("_doc"), c("_first._at").alias("_at")), "first-chunks")
    wanted = first.groupBy("_doc").agg(F.collect_list(F.struct("_at", "_hash")).alias("_wanted"))  # at most the chunks of a text
    at_home = chunked(own.join(wanted.hint("merge"), "_doc"))
    bytes_of = at_home.select(F.explode_outer(F.transform("_wanted", lambda w: F.struct(w["_hash"].alias("_hash"), F.get("_chunks", w["_at"]).alias("_bytes")))).alias("_x"))
    bytes_of = kept(bytes_of.select("_x.*").where(F.xxhash64("_bytes") == c("_hash")).dropDuplicates(["_hash"]), "chunk-bytes")
    again = (seen.join(first.select("_hash", c("_doc").alias("_doc0"), c("_at").alias("_at0")), "_hash").where("_doc <> _doc0 or _at <> _at0")
             .select("_hash", "_doc", "_at").join(bytes_of, "_hash"))
    again = again.groupBy("_doc").agg(F.collect_list(F.struct("_at", "_bytes")).alias("_again"))  # at most a text
    rows = docs.select(F.struct(*(c(f"`{n}`") for n in docs.columns)).alias("_row"), c("doc_id").alias("_doc"))
    rows = rows.join(again.hint("merge"), "_doc", "left").withColumn("_text", c("_row.text"))
    cut = chunked(rows)
    placed_text = lambda at, chunk: F.concat(at.cast("string"), F.lit(":"), chunk)  # as texts, so that Spark compares them in a hash set
    left = F.array_except(F.transform("_chunks", lambda chunk, i: placed_text(i, chunk)), F.transform("_again", lambda a: placed_text(a["_at"], a["_bytes"])))
    stays = F.transform(left, lambda x: F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x)))
    cut = cut.withColumn("_stays", F.when(c("_again").isNotNull(), stays))
    text = F.when(c("_stays").isNotNull(), F.array_join("_stays", "\n")).otherwise(c("_row.text"))
    n, n_stay = F.coalesce(F.size("_chunks"), F.lit(0)), F.size("_stays")
    return cut.select("_row", text.alias("_kept"), F.greatest(n, F.lit(0)).cast("long").alias("_n"),
                      F.when(c("_stays").isNotNull(), n - n_stay).otherwise(0).cast("long").alias("_gone"))


def line_dedup(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """doc_id, text that stays, n_chunks and n_removed of each document."""
    return deduplicate_lines(docs, least_lines).select("_row.doc_id", c("_kept").alias("text"), c("_n").alias("n_chunks"), c("_gone").alias("n_removed"))


def without_repeats(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """The documents with the text that stays, and n_chars to match where there is such a column."""
    done = deduplicate_lines(docs, least_lines)
    new = {"text": c("_kept"), "n_chars": F.when(c("_gone") > 0, F.length("_kept")).otherwise(c("_row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(new[n].alias(n) if new.get(n) is not None else c("_row")[n].alias(n) for n in docs.columns))


def without_copies(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """The documents but for those whose whole text in ``originals`` is that of another one in ``docs`` with a smaller doc_id.

    For texts that are cut already: what is left of a copy isn't alike to its original any more. A doc_id with different texts stays.
    """
    whole = originals.select(c("doc_id").alias("_doc"), F.sha2("text", 256).alias("_hash")).where("_doc is not null and _hash is not null")
    whole = whole.groupBy("_doc").agg(F.min("_hash").alias("_hash"), F.max("_hash").alias("_other")).where("_hash = _other").drop("_other")
    own = kept(whole.join(docs.select(c("doc_id").alias("_doc")), "_doc", "left_semi"), "whole-texts")
    first = own.groupBy("_hash").agg(F.min("_doc").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = own.join(first, "_hash").where("_doc <> _first").select(c("_doc").alias("_out"))
    return docs.join(out, docs["doc_id"] == out["_out"], "left_anti")
