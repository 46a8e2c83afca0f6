"""Spelling variants, filter audit and license scans against brute force, with planted odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from test_operators import ODD_ROWS, SF, docs_of, words

from tallyforge.llm import filter_audit, licenses, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 spelling variants ------------------------------------------------------------------------------------

def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(row) for w, row in out.items()}


def spelled(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def variant_rows():
    pick = random.Random(11)
    stems = ["".join(pick.choice("aeinrstéÀ×") for _ in range(pick.randint(5, 8))) for _ in range(25)]
    rows = []
    for doc in range(300):
        out = []
        for _ in range(30):
            w = pick.choice(stems)
            if pick.random() < 0.4:
                k = pick.randrange(len(w))
                w = pick.choice([w[:k] + w[k + 1:], w[:k] + pick.choice("aeioé") + w[k:], w[:k] + pick.choice("xyz") + w[k + 1:]])
            out.append(pick.choice([w, w.upper(), w.title()]))
        rows.append((doc, pick.choice([" ", "-", "\n", "1"]).join(out)))
    long = "abcde" * 9
    rows += [(1000 + k, f"{long} {long} {long[1:]} " * 2 + "x" * 4000) for k in range(3)]
    return rows + [(2000 + k, f"{long[:-1]} chainaa chainab{' chainab' * (k % 2)} {'chainbb ' * 5} {'chaincb ' * 20}") for k in range(4)] + ODD_ROWS


@pytest.mark.parametrize(("shard", "block"), [(8, 16), (4096, 32_768)])
def test_variants_equal_brute_force(spark, shard, block):
    rows = variant_rows()
    expected = brute_variants(rows)
    assert len(expected) > 200 and any(r[0] and r[1] != r[0] for r in expected.values())  # chains of forms are among them
    found = spelling.variants(docs_of(spark, rows), shard, block).collect()
    assert len(found) == len(expected)
    assert spelled(found) == expected


def test_variants_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert spelled(queries.op11(spark, SF).collect()) == brute_variants(rows)


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        assert spelling.variants(docs_of(spark, rows)).collect() == []


def test_hot_word_with_all_its_variants(spark):
    """One word is a third of all occurrences, and every deletion and replacement of it occurs too."""
    hub = "wonderland"
    others = sorted({hub[:k] + x + hub[k + 1:] for k in range(len(hub)) for x in ("", *"abcxyz")} - {hub})
    rows = [(k, " ".join([hub] * len(others) + others + others[:7])) for k in range(3)]
    assert spelled(spelling.variants(docs_of(spark, rows), 16, 32).collect()) == brute_variants(rows)


def test_trie_search_finds_the_pairs_of_brute_force():
    pick = random.Random(4)
    members = sorted({"".join(pick.choice("abcnrs") for _ in range(pick.randint(4, 7))) for _ in range(400)} | {"a" * 40, "a" * 41})
    asked = members[::2] + ["a" * 39]
    code = lambda ws: [w.encode("latin-1") for w in ws]
    zero = np.zeros(len(asked), dtype=np.int64)
    for leaf in (1, 24):
        pairs = [(int(i), int(j)) for part in spelling.search(code(members), code(asked), zero, zero, 0, leaf) for i, j in zip(*part, strict=True)]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(members) if near(a, b)}


# --- 12 filter audit -----------------------------------------------------------------------------------------

def blank_split(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    judged = []
    for doc, text, lang in rows:
        text, found = text or "", blank_split(text or "")
        fails = [len(found) < 200, 100 * len(set(found)) < 50 * len(found), 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text),
                 any(x in "#$%&*|" for x in text), any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows)]
        marks = [(q, x) for d, q, x in labels if d is not None and d == doc]
        judged.append((lang or "", {f for f, bad in zip("ABCDE", fails, strict=True) if bad}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in judged}:
        mine = [j for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in j[1] for j in mine) - len(gone), sum(j[1] == {f} for j in mine),
                                                   sum(j[2] for j in gone), sum(j[3] for j in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS key", "1 AS n", "2 AS good_")


def test_audit_equals_brute_force(spark):
    pick = random.Random(12)
    texts = [words(n, seed=n) for n in (150, 199, 200, 260)] + [("ab " * 230), words(240, seed=1).upper(), words(240, seed=2) + " #", "", "A", None, "naïve " * 201]
    rows = [(k if k % 9 else None, pick.choice(texts), pick.choice(["en", "de", None, ""])) for k in range(150)]
    rows += [(7, texts[3], "en")] * 2 + [(5000 + k, texts[2], "en") for k in range(80)]
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for k in range(0, 150, 2)] + [(7, 1, 1), (7, 0, 1), (None, 1, 1), (None, 1, 1), (99_999, 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS key", "2 AS good", "3 AS failed", "4 AS `a.b`")
    found = filter_audit.audit(frame, label_frame(spark, labels)).collect()
    assert len(found) == 600 * 3
    assert audited(found) == brute_audit(rows, labels)
    assert filter_audit.audit(frame.limit(0), label_frame(spark, labels)).collect() == []
    assert audited(filter_audit.audit(frame, label_frame(spark, labels).limit(0)).collect()) == brute_audit(rows, [])


def counted(texts, step):
    data = [t.encode() for t in texts]
    out = filter_audit.measure_bytes(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]), step)
    return [tuple(int(out[n][k]) for n in ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")) for k in range(len(texts))]


def plain_counts(text):
    found = blank_split(text)
    return len(found), len(set(found)), sum("A" <= x <= "Z" for x in text), len(text), sum(x in "#$%&*|" for x in text)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("block", [1, 64, 4 << 20])
def test_transducer_equals_plain_counts(monkeypatch, block, weak):
    """Blocks of any size, words over 64 bytes that differ in one byte, and a hash that is the same for all words."""
    pick = random.Random(6)
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    if weak:
        monkeypatch.setattr(filter_audit.Spans, "hashed", lambda self, start, size, doc: np.zeros(len(start), dtype=np.uint64))
    texts = ["".join(pick.choice(["a", "B", "é", "中", " ", "\n", "\x0b", "#", "|", "😀", " ", "\x1c"]) for _ in range(pick.randint(0, 300))) for _ in range(40)]
    tail = "x" * 70
    texts += ["", f"{tail}a {tail}b {tail}a {tail}", " ", "abc", "abc", "abcdefgh abcdefghi abcdefgh", "y" * 500, "a b " * 100]
    assert counted(texts, block) == [plain_counts(t) for t in texts]


def test_long_document_keeps_its_table(spark):
    text = words(120_000, seed=9)
    assert counted([text, "a a"], 1 << 16) == [plain_counts(text), plain_counts("a a")]
    row = filter_audit.measures(docs_of(spark, [(1, text), (None, None)])).where("doc_id = 1").first()
    assert (row.n_words, row.n_distinct) == (120_000, len(set(text.split())))


# --- 13 license scans ----------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(above, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row


def scan_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW)) if w]


def brute_scan(text):
    found = scan_words(text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for notice, label in licenses.NOTICES:
        most = len(notice) // 10
        for i in range(len(found)):
            size = -1
            for j in range(i, len(found)):
                size += len(found[j]) + 1
                if size > len(notice) + most:
                    break
                if size >= len(notice) - most and (n := edits(" ".join(found[i:j + 1]), notice)) <= most:
                    labels.add(label)
                    score = max(score, 1 - n / len(notice))
    at = [i for i, _ in places]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def license_rows():
    pick = random.Random(13)
    rows = []
    for k in range(150):
        notice = list(pick.choice(licenses.NOTICES)[0])
        for _ in range(pick.randint(0, 1 + len(notice) // 10)):
            at = pick.randrange(len(notice))
            pick.choice([lambda: notice.pop(at), lambda: notice.insert(at, pick.choice("abe é")), lambda: notice.__setitem__(at, pick.choice("xyz ü"))])()
        text = "".join(notice)
        text = pick.choice([text, text.upper(), text.replace(" ", "\n"), text.replace(" ", ", ")])
        rows.append((100 + k, f"{words(pick.randint(0, 6), seed=k)} {text} {words(pick.randint(0, 6), seed=k + 1)}"))
    rows += [(500, "CC BY cc-by-nc 4.0, cc by cc by"), (501, "the mit license mit license the gnu general public license"), (502, "MIT License"), (503, "submit license"),
             (504, "license " * 300), (505, "Apache_License, apache license1 apache\tlicense")]
    return rows + [r for r in ODD_ROWS if r[1] is None or len(r[1]) < 1000 or " " not in r[1]]


def test_license_scan_equals_brute_force(spark):
    rows = license_rows()
    found = licenses.license_scan(docs_of(spark, rows)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in found), key=key)
    assert mine == sorted(((i, *brute_scan(t)) for i, t in rows), key=key)
    fuzzy = [r for r in found if r.labels != r.base_labels]
    assert len(fuzzy) > 40
    for r in found:
        text = dict(rows)[r.doc_id]
        for s in r.spans:
            words_found = scan_words(text)[s.first_word:s.first_word + s.n_words]
            assert " ".join(words_found) == s.found and edits(s.found, s.notice) == s.edits <= len(s.notice) // 10
    assert licenses.license_scan(docs_of(spark, [])).collect() == []


def test_license_scan_of_a_long_text_and_own_notices(spark):
    text = words(30_000, seed=3) + " Licensed under the Apache Licence, Version 2.0 " + words(30_000, seed=4)
    row = licenses.license_scan(docs_of(spark, [(1, text)])).first()
    assert (row.labels, row.base_labels, row.n_base, row.n_words) == ("apache", "", 0, 60_008)
    assert [(s.found, s.edits, s.first_word) for s in row.spans] == [("apache licence", 1, 30_003)]
    own = (("do what you want license", "wtf"),)
    spans = licenses.found_spans(docs_of(spark, [(1, "do wat you want license"), (2, "nothing"), (3, None)]), notices=own, chars_per_edit=10).collect()
    assert [(s.doc_id, s.label, s.edits) for s in spans] == [(1, "wtf", 1)]


def test_clean_documents_get_no_label(spark):
    assert not licenses.license_scan(docs_of(spark, [(k, words(400, seed=k)) for k in range(20)])).where("labels <> '' OR score > 0").count()
