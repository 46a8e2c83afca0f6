"""Quality rules on repetition coverage: how much of a text lies inside n-grams and lines that it repeats.

Word ids of a text are hashed by a rolling polynomial for several n-gram lengths in numpy; two
windows count as equal only after their ids are compared. A text is judged on its own, so the
operator is one map over the documents without a shuffle.

Defined results: a null or empty text has no words and fails the base rule; very long texts are
judged whole; repeated rows are judged each on its own; an empty table gives no row; columns other
than doc_id and text are never read by the rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, own_columns, shipped, texts

#: Largest share of word characters inside repeated n-grams, by n: long repeats are rarer by chance, so less is allowed.
MAX_COVERED = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
MAX_DUP_LINE_SHARE = 0.30
MAX_DUP_LINE_CHARS = 0.30
MAX_SYMBOLS_PER_WORD = 0.10
MAX_UPPER_SHARE = 0.60
MIN_WORDS = 10
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def covered(ids: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that lie in an n-word window found twice or more; ``hashes`` are those of the windows."""
    mask = np.zeros(len(ids), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return mask
    left, right = order[same], order[same + 1]
    equal = np.ones(len(same), dtype=bool)
    for j in range(n):
        equal &= ids[left + j] == ids[right + j]
    starts = np.zeros(len(ids) + 1, dtype=np.int64)
    found = np.unique(np.concatenate([left[equal], right[equal]]))
    np.add.at(starts, found, 1)
    np.add.at(starts, np.minimum(found + n, len(ids)), -1)
    return np.cumsum(starts[:-1]) > 0


def measure(text: str | None) -> dict:
    """All measures of one text and the verdict."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at space and \t..\r only
    out = {"n_words": len(words), "word_chars": len(text) - sum(text.count(b) for b in BLANKS),
           "n_symbols": sum(text.count(s) for s in SYMBOLS)}
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line)
        else:
            seen.add(line)
    out["n_dup_lines"] = dup_lines
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=len(words))
    sizes = None
    repeat_words, shares = 0, {}
    hashes = ids
    for n in range(2, max(MAX_COVERED) + 1):
        if len(ids) < n or len(known) == len(words):
            break
        with np.errstate(over="ignore"):
            hashes = hashes[:-1] * _STEP + ids[n - 1:] + np.uint64(1)
        if n not in MAX_COVERED:
            continue
        mask = covered(ids, hashes, n)
        if not mask.any():
            break  # a longer window found twice would hold a shorter one found twice
        if n == 5:
            repeat_words = int(mask.sum())
        if sizes is None:
            sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
        shares[n] = float(sizes[mask].sum()) / max(1, out["word_chars"])
    out["n_repeat_words"] = repeat_words
    out["base_failed"] = len(words) < MIN_WORDS or 100 * repeat_words > 20 * len(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER))
    out["repeat_share"] = max(shares.values(), default=0.0)
    out["dup_line_share"] = dup_lines / len(lines) if lines else 0.0
    out["kept"] = not (
        out["base_failed"]
        or any(share > MAX_COVERED[n] for n, share in shares.items())
        or dup_lines > MAX_DUP_LINE_SHARE * len(lines)
        or dup_line_chars > MAX_DUP_LINE_CHARS * max(1, len(text))
        or out["n_symbols"] > MAX_SYMBOLS_PER_WORD * len(words)
        or upper > MAX_UPPER_SHARE * max(1, letters))
    return out


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
           ("repeat_share", pa.float64()), ("dup_line_share", pa.float64())]
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, repeat_share double, dup_line_share double")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict for each document."""

    def judged(batch: pa.RecordBatch):
        rows = [measure(t.decode("utf-8", "surrogatepass") if t is not None else None) for t in texts(batch.column("text"))]
        yield {"doc_id": batch.column("doc_id")} | {name: [r[name] for r in rows] for name, _ in _FIELDS[1:]}

    return batches(own_columns(docs, "doc_id", "text"), judged, _SCHEMA, pa.schema(_FIELDS))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them, with all their columns, judged in one map without a join."""

    def good(source):
        for batch in source:
            verdicts = [measure(t.decode("utf-8", "surrogatepass") if t is not None else None)["kept"] for t in texts(batch.column(at))]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    shipped(docs.sparkSession)
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # a name with a dot can't go to Arrow
    return plain.mapInArrow(good, plain.schema).toDF(*docs.columns)
