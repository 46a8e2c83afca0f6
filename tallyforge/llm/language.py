"""Language of texts: script ranges narrow the candidates, Viterbi over the words labels spans.

Training counts hashed character n-grams per language on a bounded sample of labelled documents.
A word's score for a language is the log probability of its n-grams; languages whose training
text doesn't use the word's script are no candidates. The best labelling of the word sequence,
where each change of language costs a penalty, cuts a text into spans; the language with the most
letters is the text's. Paths of many texts are followed side by side in numpy.

Defined results: a null text and one without a letter give ``und`` and score 0, as does a table
without a labelled text; ties go to the language first in the alphabet; very long texts are read whole;
repeated rows are labelled each on its own; any number of languages up to MAX_LANGUAGES is learned, more are an error that says so; columns other than doc_id, text and lang are never
read, and lang never when predicting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, own_columns, texts

#: Labelled documents of each language that the model is fitted on: those with the smallest hash of doc_id.
TRAINING_DOCUMENTS = 400
#: The model holds BUCKETS numbers for each language on the driver and in each worker, and the ids of its sample are broadcast.
MAX_LANGUAGES = 2_000
BUCKETS = 1 << 16  # what a hash of 64 bits keeps of its highest
GRAMS = (1, 2, 3, 4)
SWITCH_PENALTY = 8.0
SCRIPT_SHARE = 0.001
_NO_CANDIDATE = -60.0
#: Words a worker remembers the scores of; words that are scored side by side.
REMEMBERED, SIDE_BY_SIDE = 400_000, 1_000_000
#: Characters of the texts that are cut into words at a time.
PORTION = 6_000_000
#: Words whose n-grams are hashed together.
_TOGETHER = 20_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: First code points of ranges and the script of their letters. Fixed values.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1C80, "Cyrillic"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"),
    (0x20000, "Han"),
]
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def script_ids(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, codes, side="right") - 1]


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the word each belongs to."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the n-grams of all words, with their ends marked, and the word each belongs to."""
    codes, owner = _codes([f"^{w}$" for w in words])
    codes = codes.astype(np.uint64)
    found, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:len(codes) - n + 1] * _STEP + codes[n - 1:] + np.uint64(n)
        if n in GRAMS:
            whole = owner[:len(rolled)] == owner[n - 1:]
            found.append(((rolled[whole] * _MIX) >> np.uint64(48)).astype(np.int64))
            owners.append(owner[:len(rolled)][whole])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    """Log probabilities by language and bucket, and the scripts that each language uses."""

    languages: list[str]
    grams: np.ndarray  # languages x BUCKETS
    scripts: np.ndarray  # languages x SCRIPTS, bool

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word of letters: log probabilities less the best; other scripts' languages get a very low one."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for first in range(0, len(words), _TOGETHER):
            some = words[first:first + _TOGETHER]
            buckets, owner = gram_buckets(some)
            codes, of = _codes(some)
            scripts = script_ids(codes)
            scores = np.empty((len(some), len(self.languages)))
            allowed = np.empty(scores.shape, dtype=bool)
            for k in range(len(self.languages)):
                scores[:, k] = np.bincount(owner, weights=self.grams[k][buckets], minlength=len(some))
                allowed[:, k] = np.bincount(of, weights=self.scripts[k][scripts], minlength=len(some)) > 0
            best = np.where(allowed, scores, -np.inf).max(axis=1, keepdims=True)
            narrowed = np.where(allowed, scores - np.where(np.isfinite(best), best, 0.0), _NO_CANDIDATE)
            out[first:first + len(some)] = np.where(np.isfinite(best), narrowed, 0.0)
        return out


def training_sample(docs: DataFrame, per_language: int = TRAINING_DOCUMENTS) -> DataFrame:
    """lang and text of the documents to fit on.

    The rank is cut twice: among the documents of a language with the same bits of the hash, then among those
    that are left, so one task gets a bounded number of rows of a language however many tasks read it.
    """
    labelled = docs.where("lang is not null and text is not null")
    if labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} values of lang")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    within = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order)) <= per_language
    hashed = labelled.where(~held_out()).select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(61)).alias("part"))
    some = hashed.withColumn("first", within("part")).where("first").drop("first")
    picked = some.withColumn("first", within()).where("first").select("doc_id")
    # at most per_language ids for each language
    return labelled.join(F.broadcast(picked.distinct()), "doc_id", "left_semi").select("lang", "text")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = TRAINING_DOCUMENTS) -> Model:
    """Count n-grams and scripts of the sample on the executors; the model has a fixed size per language."""

    def counted(batch: pa.RecordBatch):
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            words.setdefault(lang, Counter()).update(text.decode().lower().split())
        sums: dict[str, np.ndarray] = {}
        for lang, seen in words.items():
            own = sums[lang] = np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64)
            pairs = [(letters, n) for word, n in seen.items() if (letters := letters_of(word))]
            for first in range(0, len(pairs), _TOGETHER):
                some = [w for w, _ in pairs[first:first + _TOGETHER]]
                n = np.array([n for _, n in pairs[first:first + _TOGETHER]])
                buckets, owner = gram_buckets(some)
                codes, of = _codes(some)
                np.add.at(own, buckets, n[owner])
                np.add.at(own, BUCKETS + script_ids(codes), n[of])
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield {"lang": [lang] * len(at), "bucket": at, "n": own[at]}

    fields = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    counts = batches(training_sample(own_columns(docs, "doc_id", "text", "lang"), per_language), counted, "lang string, bucket int, n long", fields)
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    grams = np.full((len(languages), BUCKETS), 0.5)
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        bucket, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        is_gram = bucket < BUCKETS
        grams[i, bucket[is_gram]] += n[is_gram]
        scripts[i, bucket[~is_gram] - BUCKETS] = n[~is_gram]
    if languages:
        grams = np.log(grams / grams.sum(axis=1, keepdims=True))
        grams -= grams.max(axis=0)  # only differences count
        scripts = scripts > SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)
    return Model(languages, grams.astype(np.float32), scripts.astype(bool))


def label_type(languages: int) -> np.dtype:
    return np.dtype(np.uint8 if languages <= 1 << 8 else np.uint16)


def best_paths(ids: list[np.ndarray], scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """For each sequence of rows of ``scores`` the labels of its best path; ties stay, then go to the smaller label."""
    kind = label_type(scores.shape[1])
    out: list[np.ndarray] = [np.empty(0, dtype=kind)] * len(ids)
    order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
    while order:
        side = max(1, 4 * SIDE_BY_SIDE // (len(ids[order[0]]) * max(4, scores.shape[1] * kind.itemsize)))  # by the bytes of the choices kept
        some, order = order[:side], order[side:]
        for i, labels in zip(some, _paths([ids[i] for i in some], scores, penalty)):
            out[i] = labels
    return out


def _paths(ids: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in ids])
    steps, kinds = int(sizes[0]), scores.shape[1]
    grid = np.zeros((steps, len(ids)), dtype=np.int32)
    for k, x in enumerate(ids):
        grid[:len(x), k] = x
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than the step
    kind = label_type(kinds)
    came = np.empty((steps, len(ids), kinds), dtype=kind)
    own = np.arange(kinds, dtype=kind)
    value = scores[grid[0]].astype(np.float64)
    for t in range(1, steps):
        n = alive[t]
        now = value[:n]
        best = now.argmax(axis=1)
        moved = now.max(axis=1, keepdims=True) - penalty
        came[t, :n] = np.where(now >= moved, own, best[:, None].astype(kind))
        value[:n] = np.maximum(now, moved) + scores[grid[t, :n]]
    state = value.argmax(axis=1).astype(kind)
    labels = np.empty((steps, len(ids)), dtype=kind)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        labels[t, :n] = state[:n]
        if t:
            state[:n] = came[t, np.arange(n), state[:n]]
    return [labels[:len(x), k].copy() for k, x in enumerate(ids)]


class Labeller:
    """Word scores remembered between the batches and tasks of a worker."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1, len(self.model.languages)), dtype=np.float32)
        self.sizes = np.zeros(1, dtype=np.int64)

    def _learn(self, words: set[str]) -> None:
        new = []
        for word in words:
            letters = letters_of(word.lower())
            if letters:
                self.known[word] = len(self.sizes) + len(new)
                new.append(letters)
            else:
                self.known[word] = 0
        if new:
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), dtype=np.int64, count=len(new))])

    def spans(self, found: list[str]) -> list[tuple[list[tuple[int, int, int, int]], int]]:
        """For each text its spans (label, first word, words, letters) and its number of letters."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [text.split() for text in found]
        self._learn(set().union(*split).difference(self.known))
        known = self.known
        ids = [np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)) for words in split]
        sizes = self.sizes
        out = []
        for own, labels in zip(ids, best_paths(ids, self.scores)):
            letters = sizes[own] if len(own) else np.empty(0, dtype=np.int64)
            cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(own) else np.empty(0, dtype=np.int64)
            ends = np.append(cuts[1:], len(own))
            sums = np.add.reduceat(letters, cuts) if len(own) else []
            out.append(([(int(labels[a]), int(a), int(b - a), int(s)) for a, b, s in zip(cuts, ends, sums)], int(letters.sum())))
        return out


_LABELLERS: dict[str, Labeller] = {}


def remembered(mark: str, model: Model) -> Labeller:
    """The worker's labeller for the model; one model at a time."""
    if mark not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[mark] = Labeller(model)
    return _LABELLERS[mark]


_SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long,n_letters:long>>"
_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64())])
_FIELDS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def in_portions(values: Iterable[str], characters: int = PORTION) -> Iterator[list[str]]:
    """Lists of texts of about so many characters; only one list's words are held at a time."""
    some, size = [], 0
    for value in values:
        some.append(value)
        size += len(value)
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters that lie in spans of lang_pred) and the spans."""
    names, mark = model.languages, uuid4().hex

    def labelled(batch: pa.RecordBatch):
        if not names:
            yield {"doc_id": batch.column("doc_id"), "lang_pred": ["und"] * len(batch), "score": [0.0] * len(batch), "spans": [[]] * len(batch)}
            return
        labeller = remembered(mark, model)
        ids, pred, score, spans = batch.column("doc_id"), [], [], []
        values = ((t or b"").decode() for t in texts(batch.column("text")))
        for own, letters in (found for some in in_portions(values) for found in labeller.spans(some)):
            sums = np.zeros(len(names), dtype=np.int64)
            for label, _, _, n in own:
                sums[label] += n
            best = int(sums.argmax())
            pred.append(names[best] if letters else "und")
            score.append(float(sums[best] / letters) if letters else 0.0)
            spans.append([{"lang": names[k], "first_word": a, "n_words": n, "n_letters": s} for k, a, n, s in own] if letters else [])
        yield {"doc_id": ids, "lang_pred": pred, "score": score, "spans": spans}

    return batches(own_columns(docs, "doc_id", "text"), labelled, _SCHEMA, _FIELDS)
