"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, so it has one last token. A token fits as the last
one of a prefix when it also fits after the last token of the prefix before it, and two tokens fit
side by side when merging their bytes gives just these two. The table of last tokens is all that is
stored: an append goes on from it, an edit keeps it up to the place of the edit and takes the old
table up again where both agree. Reading it from the end gives the encoding.

Defined results: a null text is the empty one and has no token; very long texts and matches are
encoded whole; columns other than doc_id and text are never read; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, own_columns, texts

#: Matches whose tokens a worker remembers, and pairs of tokens; older ones are forgotten, which costs time only.
REMEMBERED = 600_000
_NEVER = 1 << 62
_NO_TOKEN = 1 << 32


class Vocabulary:
    """Ranks of byte strings, and for each the last merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.usable: dict[bytes, int] = {}  # tokens that merging their bytes gives back
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            split = self._last_merge(token)
            self.parts[rank] = split
            if len(token) == 1 or split is not None:
                self.usable[token] = rank
        self._fitting: dict[int, bool] = {}
        self._guesses: dict[int, int] = {}  # at most 256 for each token

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that are left before the last merge; None for one byte or a token merging never makes."""
        pieces = [token[i:i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best, at = _NEVER, -1
            for i in range(len(pieces) - 1):
                rank = self.ranks.get(pieces[i] + pieces[i + 1], _NEVER)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None
            pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        return (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 and all(p in self.ranks for p in pieces) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay as they are when their bytes are merged side by side.

        Undo the merges next to the border, latest first. At each point the two pieces that meet
        there must not have made an earlier merge than the one just undone; merges on the left go
        first when ranks are equal.
        """
        key = left << 32 | right
        known = self._fitting.get(key)
        if known is None:
            if len(self._fitting) > REMEMBERED:
                self._fitting.clear()
            known = self._fitting[key] = self._stay_apart(left, right)
        return known

    def last_tokens(self, data: bytes, last: list[int], stop: int) -> None:
        """Go on with ``last`` up to the prefix of ``stop`` bytes.

        Only one token fits, so the places may be tried in any order: first the length that came
        out last time for the same last token before and the same byte, then all from long to short.
        """
        rank_of, known, fits, longest, guesses = self.usable.get, self._fitting, self.fits, self.longest, self._guesses
        before = last[-1] if len(last) > 1 else _NO_TOKEN
        for end in range(len(last), stop + 1):
            context = before << 8 | data[end - 1]
            start = end - guesses.get(context, end)
            rank = rank_of(data[start:end]) if start >= 0 else None
            if rank is None or (start and not (known.get(last[start] << 32 | rank) or fits(last[start], rank))):
                for start in range(max(0, end - longest), end):
                    rank = rank_of(data[start:end])
                    if rank is not None and (not start or fits(last[start], rank)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                guesses[context] = end - start
            last.append(rank)
            before = rank

    def _stay_apart(self, left: int, right: int) -> bool:
        a, b = left, right
        until = (_NEVER, 0)  # (rank, side) of the merge undone last; side 0 is the left one
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)
            # of two merges of one rank the one further left goes first: the border is right of the left side's, left of the right side's
            if (joint, 0.5) < until:
                return False
            parts_a, parts_b = self.parts[a], self.parts[b]
            undo_a = (a, 0) if parts_a else (-1, 0)
            undo_b = (b, 1) if parts_b else (-1, 0)
            if undo_a[0] < 0 and undo_b[0] < 0:
                return True
            if undo_a > undo_b:
                until, a = undo_a, parts_a[1]
            else:
                until, b = undo_b, parts_b[0]


class PrefixEncoding:
    """The last token of each prefix of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Encode what is appended; nothing before it is looked at twice."""
        data = self.data + more
        self.vocabulary.last_tokens(data, self.last, len(data))
        self.data = data

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; gives the number of prefixes encoded again.

        Behind the edit the old table holds again from where as many last tokens in a row agree
        with it as the longest token has bytes: each later one looks back no further.
        """
        old_last, shift = self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start + 1]
        agreed = done = 0
        for end in range(start + 1, len(data) + 1):
            self.vocabulary.last_tokens(data, self.last, end)
            done += 1
            if end > start + len(new):
                agreed = agreed + 1 if self.last[end] == old_last[end - shift] else 0
                if agreed > self.vocabulary.longest:
                    self.last.extend(old_last[end - shift + 1:])
                    break
        self.data = data
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Codec:
    """Encodes texts match by match of a pattern, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._bytes_of = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]

    def _match_ids(self, match: str) -> bytes:
        found = self._before.get(match)
        if found is not None:
            self._known[match] = found
            return found
        data = match.encode()
        rank = self.vocabulary.ranks.get(data)  # a match that is one token is that token
        ids = [rank] if rank is not None else PrefixEncoding(self.vocabulary, data).tokens()
        found = pack(f"<{len(ids)}I", *ids)
        if len(match) <= 64:
            self._known[match] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self._known) > REMEMBERED // 2:
            self._known, self._before = {}, self._known
        known, slow = self._known, self._match_ids
        return b"".join([known.get(m) or slow(m) for m in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(package: str, name: str) -> Codec:
    """The codec of a rank file that a package of vocabularies on every worker holds; loaded once per worker."""
    vocabularies = importlib.import_module(package)
    with open(vocabularies.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return Codec(ranks, vocabularies.PATTERN)


_FIELDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
_DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_documents(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", package: str = "public_tokenizers") -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian) and the bytes decoded from the ids."""

    def coded(batch: pa.RecordBatch):
        c = codec(package, name)
        ids = [c.encode((t or b"").decode()) for t in texts(batch.column("text"))]
        yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [c.decode(i) for i in ids]}

    return batches(own_columns(docs, "doc_id", "text"), coded, "doc_id long, n_tokens long, ids binary, decoded binary", pa.schema(_FIELDS))


def digest_documents(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", package: str = "public_tokenizers") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes; ids don't leave the task."""

    def coded(batch: pa.RecordBatch):
        c = codec(package, name)
        counts, first, second = [], [], []
        for text in texts(batch.column("text")):
            ids = c.encode((text or b"").decode())
            counts.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(c.decode(ids)).hexdigest())
        yield {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": first, "decoded_sha256": second}

    return batches(own_columns(docs, "doc_id", "text"), coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema(_DIGESTS))


_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def token_documents(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", package: str = "public_tokenizers") -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding them gives the text back."""

    def coded(batch: pa.RecordBatch):
        c = codec(package, name)
        counts, ids, same = [], [], []
        for text in texts(batch.column("text")):
            found = c.encode((text or b"").decode())
            counts.append(len(found) // 4)
            ids.append(np.frombuffer(found, dtype="<i4"))
            same.append(c.decode(found) == (text or b""))
        yield {"doc_id": batch.column("doc_id"), "n_tokens": counts, "token_ids": ids, "round_trip": same}

    return batches(own_columns(docs, "doc_id", "text"), coded, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean", _TOKENS)
