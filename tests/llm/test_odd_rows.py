"""Rows that earlier ended a query or changed its answer: repeated ids with other contents, very large numbers, many languages."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from test_operators import docs_of, words

from tallyforge.llm import repeats, topk

_MOST = (1 << 63) - 1


def scaled(v):
    return [math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in v]


def brute_top(rows, asked, k):
    out = {}
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(scaled(v), scaled(x), strict=False)), j) for j, x in rows if j != q)[:k]
        out |= {(q, rank + 1): (j, max(-_MOST, min(_MOST, -s))) for rank, (s, j) in enumerate(best)}
    return out


def test_top_k_with_components_of_any_size(spark):
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[3.0e38, 0.0, -1.0, 2.0], [-3.0e38, 1.0, 1.0, 1.0], [2.9e38, 1.0, 0.0, 0.0], [1e9, -1e9, 0.5, 0.0], [1e16, 1.0, 1.0, 1.0], [0.0, 0.0, 3.4e38, 3.4e38]])]
    rows += [(2000, [1.0e308, -1.0e308, 0.0, 5.0]), (2100, [1.7e308, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, beyond int")
    asked = {i: v for i, v in rows if i % 100 == 0}
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.nearest(frame, frame.where("vec_id % 100 = 0"), 7, rows_per_block=64, queries_per_block=2).collect()}
    assert found == brute_top(rows, asked, 7)
    assert 1000 in asked and 2000 in asked


def test_one_answer_for_a_repeated_query_id(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(1, 50)]
    odd = [(0, None), (0, [2.0, 1.0]), (0, [1.0, 9.0]), (0, [float("nan"), 0.0]), (0, []), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    for parts in (1, 5):
        shuffled = frame.repartition(parts)
        found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.nearest(shuffled, shuffled.where("vec_id % 100 = 0"), 5).collect()}
        assert found == brute_top(rows, {0: [1.0, 9.0]}, 5)


def test_a_doc_id_with_two_texts(spark):
    """Each text is a document of its own; a passage that both hold stays in both, and goes from later ids."""
    passage, other = words(40, seed=1), words(30, seed=2)
    rows = [(1, f"{words(60, seed=3)} {passage}"), (1, f"{passage} few"), (1, "few"), (1, f"{passage} few"), (2, f"in {passage} out"), (3, f"{other} {other}"), (3, other), (4, f"a {other}")]
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, rows)).collect())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    whole = lambda i, text: (i, len(text.split()), 0, sha(text))
    expected = [whole(*rows[0]), whole(*rows[1]), whole(*rows[2]), whole(*rows[3]), (2, 42, 40, sha("in out")), (3, 60, 30, sha(other)), whole(3, other), (4, 31, 30, sha("a"))]
    assert found == sorted(expected)


def test_a_doc_id_with_very_many_texts(spark):
    pick = random.Random(5)
    passage = words(25, seed=9)
    rows = [(7, f"{words(pick.randint(0, 60), seed=1000 + k)} {passage}") for k in range(300)] + [(8, passage)]
    found = repeats.remove_repeats(docs_of(spark, rows)).collect()
    assert len(found) == 301 and [r.n_removed for r in found if r.doc_id == 8] == [25] and not any(r.n_removed for r in found if r.doc_id == 7)


def test_the_curve_decides_what_is_content(spark, monkeypatch):
    """A constant curve takes in marked parts; names of elements select no region."""
    from test_operators import PAGE, SF

    from tallyforge.llm import html_text

    pages = [PAGE] + [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r.html]
    texts = [html_text.main_text(h) for h in pages]
    plain = lambda h: h.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
    assert [html_text.main_text(plain(h)) for h in pages] == texts
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1.0: np.ones(len(ratios)))
    changed = [html_text.main_text(h) for h in pages]
    assert all(a != b for a, b in zip(texts, changed, strict=True)) and "Reader comment" in changed[0] and "Reader comment" not in texts[0]


def test_malformed_pages_take_time_in_proportion():
    import time

    from tallyforge.llm import html_text

    for body in ("<b><br>x ", "<div></section>x "):
        begin = time.process_time()
        assert html_text.main_text(f"<html><body>{body * 16_000}</body></html>").count("x") == 16_000
        assert time.process_time() - begin < 8  # a walk over the open elements for each line took minutes
    deep = "<p><table>" + "<b>" * 8000 + "<div>y</div>" * 8000
    assert html_text.main_text(deep).count("y") == 8000


def test_three_hundred_languages(spark):
    from tallyforge.llm import language

    letters = "bcdfghjklmnpqrstvwxz"
    syllable = lambda k: letters[k % 20] + "aeiou"[k // 20 % 5] + letters[k // 100 % 20] + "aeiou"[k * 7 % 5]
    rows, ids = [], [k for k in range(2000) if not_held_out(k)]
    for k in range(300):
        rows.append((ids[k], f"{syllable(k)} {syllable(k) * 2} {syllable(k)} {syllable(k) * 3}", f"l{k:03d}", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit(docs)
    assert len(model.languages) == 300
    found = {r.doc_id: r.lang_pred for r in language.label_documents(docs, model).collect()}
    assert found == {r[0]: r[2] for r in rows}


def not_held_out(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 4 != 2


def test_word_scores_equal_plain_counts(spark):
    """Log probabilities of hashed n-grams, counted without numpy, and the rule of scripts."""
    import zlib

    from tallyforge.llm import language

    step, mix, size = int(language._STEP), int(language._MIX), 1 << 64

    def grams(word):
        codes = [ord(x) for x in f"^{word}$"]
        for n in language.GRAMS:
            for i in range(len(codes) - n + 1):
                h = 0
                for j, code in enumerate(codes[i:i + n], 1):
                    h = (h * step + code + j) % size
                yield (h * mix % size) >> 48

    train = {"de": "der Hund und die Katze der", "en": "the dog and the cat", "ru": "кот и собака"}
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(ids[k], text, lang) for k, (lang, text) in enumerate(train.items())], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en", "ru"]
    counts = {lang: np.full(language.BUCKETS, 0.5) for lang in train}
    for lang, text in train.items():
        for word in text.lower().split():
            for g in grams(word):
                counts[lang][g] += 1
    logs = {lang: np.log(x / x.sum()) for lang, x in counts.items()}
    tested = ["hund", "the", "dogs", "кот", "xyz"]
    scores = model.word_scores(tested)
    for word, row in zip(tested, scores, strict=True):
        plain = np.array([sum(logs[lang][g] for g in grams(word)) for lang in model.languages])
        allowed = np.array([False, False, True] if word == "кот" else [True, True, False])
        want = np.where(allowed, plain - plain[allowed].max(), language._NO_CANDIDATE)
        assert np.allclose(row, want, atol=2e-3)
