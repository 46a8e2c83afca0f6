"""DuckDB statements that give the rows of queries that SQL can express, each by a plain way of its own."""

OP2 = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM split WHERE len(words) >= 20),
keyed AS (SELECT doc_id, start, array_to_string(words[start : start + 19], ' ') AS window_text FROM windows),
later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, start) AS place FROM keyed) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, start + more AS place FROM later, (SELECT unnest(range(0, 20)) AS more)),
numbered AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
kept AS (SELECT n.doc_id, count(*) AS n_words, count(g.place) AS n_removed, string_agg(n.word, ' ' ORDER BY n.place) FILTER (WHERE g.place IS NULL) AS text
         FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.place = g.place GROUP BY n.doc_id)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP3 = """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
           FROM vectors q JOIN vectors r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP4 = r"""
WITH inside AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
blocks AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>|<br>'), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM inside),
joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""

OP5 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')))
                             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM split),
sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
items AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS least FROM sized UNION SELECT s.b, r.least FROM reached r JOIN sides s ON s.a = r.doc_id AND r.least < s.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.least) AS component_id, min(r.least) = s.doc_id AS kept
FROM sized s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

OP7 = r"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, list_transform(lines, lambda x: md5(x)) AS hashes FROM lines),
rolled AS (SELECT *, list_transform(range(1, len(lines) + 1), lambda i: ('0x' || substr(md5(hashes[i] || CASE WHEN i > 1 THEN hashes[i - 1] ELSE '' END), 1, 8))::BIGINT) AS h,
          list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50) AS long FROM hashed),
ended AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR long[i] OR coalesce(long[i + 1], false)
          OR (i > 1 AND i < len(lines) - 1 AND NOT long[i - 1] AND NOT coalesce(long[i + 2], false) AND h[i] < h[i - 1] AND h[i] <= h[i + 1])) AS ends FROM rolled),
cut AS (SELECT doc_id, list_transform(range(1, len(ends) + 1),
        lambda j: array_to_string(lines[(CASE WHEN j > 1 THEN ends[j - 1] ELSE 0 END) + 1 : ends[j]], chr(10))) AS chunks FROM ended),
placed AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS place FROM cut),
judged AS (SELECT *, (len(list_filter(string_split(chunk, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))) >= 2 OR len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) >= 50)
           AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM placed),
rebuilt AS (SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
            count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed FROM judged GROUP BY doc_id)
SELECT d.doc_id, r.text, coalesce(r.n_chunks, 0) AS n_chunks, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""


OP11 = r"""
WITH RECURSIVE steps AS (SELECT unnest(range(0, 256)) AS i, unnest(range(0, 256)) AS v, 0 AS k
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
coded AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
          lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes FROM counted),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h FROM coded, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (SELECT x.word, y.word AS other, y.n FROM less x JOIN vocab y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN vocab y ON x.rest = y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
formed AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN other END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word),
followed AS (SELECT word, word AS root FROM formed UNION ALL SELECT f.word, x.form FROM followed f JOIN formed x ON x.word = f.root WHERE x.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT g.word, g.root FROM followed g JOIN formed x ON x.word = g.root WHERE x.form IS NULL) r ON r.word = f.word
"""

OP12 = r"""
WITH split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM split GROUP BY text),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 3 * length(s.text),
     'D': regexp_matches(s.text, '[#$%&*|]'), 'E': coalesce(s.doc_id > f.first, false)} AS f
  FROM split s JOIN firsts f ON f.text = s.text LEFT JOIN marks m ON m.doc_id = s.doc_id),
failed AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS f FROM judged),
sums AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
told AS (SELECT part, o, step, f, n, good, toxic, list_contains(f, substr(o, step, 1)) AS fails,
    len(list_filter(f, lambda x: instr(o, x) < step)) > 0 AS gone, f = [substr(o, step, 1)] AS alone FROM sums, steps),
counted AS (SELECT part, o, step, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost FROM told GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(o, step, 1)) AS BIGINT) AS shapley
FROM counted
"""


def op13(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], chars_per_edit: int) -> str:
    """The statement for phrases and notices: every run of whole words is measured against every notice of about its length."""
    listed = lambda pairs: ", ".join(f"('{text}', '{label}')" for text, label in pairs)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH base(phrase, label) AS (VALUES {listed(base)}),
notices AS (SELECT notice, label, length(notice) AS m, length(notice) // {chars_per_edit} AS k, len(string_split(notice, ' ')) AS w FROM (VALUES {listed(notices)}) x(notice, label)),
split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
          lambda x: x <> '') AS words FROM documents),
marked AS (SELECT r, list_transform(words, lambda x: regexp_replace(x, '[^\x00-\x7F]', '~', 'g')) AS words FROM split),
pieces AS (SELECT DISTINCT substr(notice, m * j // (k + 1) + 1, m * (j + 1) // (k + 1) - m * j // (k + 1)) AS piece FROM (SELECT notice, m, k, unnest(range(0, k + 1)) AS j FROM notices)),
plain AS (SELECT r, words FROM marked WHERE EXISTS (SELECT 1 FROM pieces WHERE contains(array_to_string(words, ' '), piece))),
sizes AS (SELECT DISTINCT unnest(range(greatest(1, w - k), w + k + 1)) AS w FROM notices),
runs AS (SELECT r, i, s.w, unnest([array_to_string(words[i : i + s.w - 1], ' ')]) AS run FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM plain), sizes s WHERE i + s.w - 1 <= len(words)),
found AS (SELECT r, i, run, notice, label, m, levenshtein(run, notice) AS edits FROM runs JOIN notices n ON runs.w BETWEEN n.w - k AND n.w + k AND abs(length(run) - m) <= k
          WHERE levenshtein(run, notice) <= k),
exact AS (SELECT r, i - 1 AS place, b.label FROM runs JOIN base b ON run = phrase),
based AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM exact GROUP BY r),
fuzzy AS (SELECT r, max(1 - edits::DOUBLE / m) AS score, list(DISTINCT label) AS labels FROM found GROUP BY r)
SELECT s.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  greatest(coalesce(score, 0::DOUBLE), CASE WHEN n_base > 0 THEN 1::DOUBLE ELSE 0 END) AS score
FROM split s LEFT JOIN based b ON b.r = s.r LEFT JOIN fuzzy f ON f.r = s.r
"""


def op6(max_covered: dict[int, float], dup_line_share: float, dup_line_chars: float, symbols: float, upper: float, min_words: int) -> str:
    """The statement for the limits of the quality rules."""
    shares = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN chars END), 0) AS c{n}" for n in max_covered)
    over = " OR ".join(f"share{n} > {limit}::DOUBLE" for n, limit in max_covered.items())
    share = lambda n: f"c{n}::DOUBLE / greatest(1, word_chars) AS share{n}"
    return rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS start, words FROM split, (SELECT unnest(range({min(max_covered)}, {max(max_covered) + 1})) AS n) WHERE len(words) >= n),
twice AS (SELECT doc_id, n, start FROM (SELECT doc_id, n, start, array_to_string(words[start : start + n - 1], ' ') AS w FROM windows) QUALIFY count(*) OVER (PARTITION BY doc_id, n, w) > 1),
places AS (SELECT DISTINCT doc_id, n, start + more AS place FROM twice, (SELECT unnest(range(0, {max(max_covered)})) AS more) WHERE more < n),
covered AS (SELECT p.doc_id, p.n, count(*) AS n_covered, sum(length(s.words[p.place])) AS chars FROM places p JOIN split s ON s.doc_id = p.doc_id GROUP BY p.doc_id, p.n),
wide AS (SELECT doc_id, coalesce(max(CASE WHEN n = 5 THEN n_covered END), 0) AS n_repeat_words, {shares} FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
lined AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(line)) AS dup_chars FROM lines GROUP BY doc_id),
measured AS (SELECT s.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, {", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in max_covered)}
  FROM split s LEFT JOIN wide w ON w.doc_id = s.doc_id LEFT JOIN lined l ON l.doc_id = s.doc_id),
shared AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(map(share, max_covered))} FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {over} OR n_dup_lines > {dup_line_share}::DOUBLE * n_lines OR dup_chars > {dup_line_chars}::DOUBLE * greatest(1, length(text))
       OR n_symbols > {symbols}::DOUBLE * n_words OR upper > {upper}::DOUBLE * greatest(1, letters)) AS kept,
  greatest({", ".join(f"share{n}" for n in max_covered)}) AS repeat_share, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0.0::DOUBLE END AS dup_line_share
FROM shared
"""
