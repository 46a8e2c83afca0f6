"""License scans: short notices in whole texts, with a bounded number of errors.

A notice of m characters may differ by m // 10 edits (Levenshtein, code points). Cut into one piece more than that, at least
one piece stands unchanged in the text (pigeonhole), at most that many places from where the notice begins. One Aho-Corasick
automaton over the pieces of all notices gives these seeds; around a seed every run of whole words that can be the
notice is verified by the regex library's bounded-error matching, which gives the number of edits. A text is the words
``[a-z0-9]`` and all beyond ASCII, A-Z lower-cased, joined by one space; so a notice counts wherever its words stand, over line ends and marks.

The operator is one map without a shuffle; the automaton is built once for each Python worker.

Defined results: a null text is the empty one, which has no word and no label; texts are scanned whole; repeated rows are
scanned each on its own; an empty table gives no row; only doc_id and text are read. Of overlapping spans of one
notice the one with the fewest edits stays, then the earlier, then the shorter one.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, own_columns, texts

#: Phrases whose exact places are counted, and their labels. Fixed values.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices that are searched with errors, and their labels.
NOTICES = BASE + (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(data: bytes) -> tuple[str, int]:
    """The words joined by one space, and their number."""
    words = data.translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of nearly the same size, with their places."""
    edges = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], chars_per_edit: int):
        self.notices, self.allowed, self.verify = notices, [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            edits = len(notice) // chars_per_edit
            self.allowed.append(edits)
            self.verify.append(regex.compile(f"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}"))
            for at, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def candidates(self, text: str):
        """Each (notice, start, end) of whole words that a seed allows, once."""
        seen: set[tuple[int, int]] = set()
        for last, (size, places) in self.seeds.iter(text):
            for k, at in places:
                begin, slack = last + 1 - size - at, self.allowed[k]
                if (k, begin) in seen:
                    continue
                seen.add((k, begin))
                length = len(self.notices[k][0])
                starts = [s for s in range(max(0, begin - slack), min(len(text) - 1, begin + slack) + 1) if text[s] != " " and (s == 0 or text[s - 1] == " ")]
                if not starts:
                    continue
                near = begin + length
                for e in range(max(1, near - slack), min(len(text), near + slack) + 1):
                    if text[e - 1] != " " and (e == len(text) or text[e] == " "):
                        yield from ((k, s, e) for s in starts if s < e and abs(e - s - length) <= slack)

    def matches(self, text: str) -> dict[tuple[int, int, int], int]:
        """Edits of every (notice, start, end) of whole words that is a notice within its edits."""
        found: dict[tuple[int, int, int], int] = {}
        tried: set[tuple[int, int, int]] = set()
        for k, s, e in self.candidates(text):
            if (k, s, e) in tried:
                continue
            tried.add((k, s, e))
            if text[s:e] == self.notices[k][0]:
                found[k, s, e] = 0
            elif self.allowed[k] and (match := self.verify[k].fullmatch(text, s, e)):
                found[k, s, e] = sum(match.fuzzy_counts)
        return found

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits), without overlaps for one notice, by place."""
        found, kept, taken = self.matches(text), [], {}
        for (k, s, e), edits in sorted(found.items(), key=lambda x: (x[1], x[0][1], x[0][2])):
            if all(e <= a or b <= s for a, b in taken.get(k, [])):
                taken.setdefault(k, []).append((s, e))
                kept.append((k, s, e, edits))
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


scanner = lru_cache(maxsize=4)(Scanner)


def word_numbers(text: str, places: list[int]) -> dict[int, int]:
    """The number of the word (from 0) that begins at each place."""
    out, at, number = {}, 0, 0
    for place in sorted(set(places)):
        number += text.count(" ", at, place)
        out[place] = number
        at = place
    return out


def exact_places(text: str, phrase: str) -> list[int]:
    """Where the words of the phrase stand consecutively."""
    out, at = [], text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


def scan_text(data: bytes | None, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> dict:
    """All results of one text."""
    text, n_words = normalised(data or b"")
    places = [(at, label) for phrase, label in BASE for at in exact_places(text, phrase)]
    spans = scanner(notices, chars_per_edit).scan(text)
    number = word_numbers(text, [at for at, _ in places] + [s for _, s, _, _ in spans])
    base = {label for _, label in places}
    starts = [number[at] for at, _ in places]
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {notices[k][1] for k, _, _, _ in spans})),
        "score": max((1 - edits / len(notices[k][0]) for k, _, _, edits in spans), default=1.0 if base else 0.0),
        "spans": [{"label": notices[k][1], "notice": notices[k][0], "found": text[s:e], "first_word": number[s],
                   "n_words": text.count(" ", s, e) + 1, "edits": edits} for k, s, e, edits in spans]}


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("found", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "spans array<struct<label: string, notice: string, found: string, first_word: long, n_words: long, edits: int>>")


def license_scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Exact places of the base phrases and the notices found within their edits, with spans, for each document."""

    def scanned(batch: pa.RecordBatch):
        rows = [scan_text(t, notices, chars_per_edit) for t in texts(batch.column("text"))]
        yield {"doc_id": batch.column("doc_id")} | {name: [r[name] for r in rows] for name, _ in _FIELDS[1:]}

    return batches(own_columns(docs, "doc_id", "text"), scanned, _SCHEMA, pa.schema(_FIELDS))


def found_spans(docs: DataFrame, **options) -> DataFrame:
    """One row for each notice found: doc_id, label, notice, the words as found, their place and the edits."""
    return license_scan(docs, **options).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
