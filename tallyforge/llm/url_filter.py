"""URL filter: rules first, then naive Bayes on the words that host and path are made of.

A host or path piece such as ``freebets`` is cut into words by a unigram Viterbi: the substrings of
all distinct pieces are joined with the word counts of the pages' titles, and the most probable cut of
each piece is found from its few matching substrings. Each word has a log ratio of its
probabilities in the blocked and the allowed class; a url's score is their sum and the prior.
Urls with the same pieces are scored once. Words count without a plural s; language codes that are a
whole label of the host or a whole part of the path are no words.

The blocked class is learned from the pages: from a few listed words, from the names and link hosts of
the elements that pages mark as adverts, and from the other words of the hosts and paths that these two block;
of those, the ones that stand in more blocked than other hosts and paths, by the difference. The allowed class
are the titles' words. A blocked url is made of ordinary words, too, so the allowed class is the background of
the blocked one and an ordinary word costs little.

Defined results: host and path of a null url, or one without ``://``, are empty; such a url has no word and
is allowed unless a rule fits; unknown words weigh nothing; very long urls are read whole;
repeated rows are judged each on its own; an empty table gives no row; columns other
than page_id, url and html are never read. A score of exactly 0 allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, kept, own_columns

c = F.col

#: Words that the learning of the blocked class starts from, each counted once. Fixed values.
BLOCKED_WORDS = ("adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "clicks", "crack", "cracked", "credit", "dating", "discount", "escort",
                 "farm", "forex", "free", "gambling", "hack", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "lotto", "malware", "nude", "offer", "offers",
                 "payday", "pharma", "phishing", "pills", "poker", "porn", "prize", "prizes", "replica", "scam", "sex", "slots", "spam", "torrent", "viagra", "warez",
                 "win", "winner", "xxx")
#: Words of host names that stand for no content, beside the top-level domain. Fixed values.
PLAIN_WORDS = ("www", "m", "blog", "example", "html", "htm", "php", "index", "page")
#: ISO 639-1.
LANGUAGE_CODES = ("aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu "
                  "gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms "
                  "mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl "
                  "tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu").split()
CODE = rf"(?<![^/.])(?:{'|'.join(LANGUAGE_CODES)})(?:[-_][a-z]{{2}})?(?![^/.])"
#: An element whose class or id names it as an advert: the name (2) and what stands in it (3).
ADVERT = (r"""(?is)<(\w+)\b[^>]*?\s(?:class|id)\s*=\s*["']?([^"'>]*(?<![a-z0-9])(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*)(?![a-z0-9])[^"'>]*)["']?[^>]*>(.*?)(?:</\1\b|$)""")
PRIOR_BLOCKED = 0.01
#: Shares of the blocked class: ordinary words, listed ones, those of adverts, learned ones; what is missing of one goes to none.
ORDINARY, LISTED, ADVERTS, LEARNED = 0.8, 0.1, 0.05, 0.05
#: Added to each probability, and to the number of learned words: a word needs about four blocked hosts or paths to decide alone.
LEAST, FEW_LEARNED = 1e-6, 2000.0
LONGEST_WORD = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the few (verdict, host, path) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def pieces(host: Column, path: Column) -> Column:
    """Letter runs of the host without its top-level domain, and of the path."""
    own = F.regexp_replace(F.concat_ws("/", F.regexp_replace(host, r"(^|\.)[^.]*$", ""), F.lower(path)), CODE, "")
    return F.filter(F.split(own, r"[^\p{L}]+"), lambda x: (x != "") & ~x.isin(*PLAIN_WORDS))


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the titles of all pages; the training text of the allowed class."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    return pages.select(F.explode(F.split(F.lower(title), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_cut(piece: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable words of a piece; ``known`` has the log probability of its (start, length) that are words.

    Unknown stretches cost as much as a word seen less than once, and ten times more per letter.
    """
    best, came = [0.0], [0]
    unknown = [log(1.0 / (total + 1.0)) - n * log(10.0) for n in range(LONGEST_WORD + 1)]
    for end in range(1, len(piece) + 1):
        top, at = None, 0
        for start in range(max(0, end - LONGEST_WORD), end):
            value = best[start] + known.get((start, end - start), unknown[end - start])
            if top is None or value > top:
                top, at = value, start
        best.append(top)
        came.append(at)
    out, end = [], len(piece)
    while end:
        out.append(piece[came[end]:end])
        end = came[end]
    return out[::-1]


def segmented(distinct_pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """piece, words: each distinct piece cut by the unigram counts."""
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    starts = distinct_pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    longest = F.least(F.length("piece") - c("start") + 1, F.lit(LONGEST_WORD))
    parts = starts.select("piece", "start", F.explode(F.sequence(F.lit(1), longest)).alias("size")).withColumn("word", F.expr("substring(piece, start, size)"))
    found = (parts.join(counts, "word").groupBy("piece")
             .agg(F.collect_list(F.struct((c("start") - 1).cast("int").alias("start"), c("size").cast("int").alias("size"), c("n").alias("n"))).alias("found")))
    every = distinct_pieces.join(found, "piece", "left")

    def cut(batch: pa.RecordBatch):
        names = batch.column("piece").to_pylist()
        words = []
        for piece, own in zip(names, batch.column("found").to_pylist()):
            known = {(x["start"], x["size"]): log(x["n"] / total) for x in own or ()}
            words.append(best_cut(piece, known, total))
        yield {"piece": names, "words": words}

    return batches(every, cut, "piece string, words array<string>", pa.schema([("piece", pa.string()), ("words", pa.list_(pa.string()))]))


def without_plural(word: Column) -> Column:
    return F.regexp_replace(word, r"(?<=..)s$", "")


def advert_words(pages: DataFrame) -> DataFrame:
    """word, n: in how many pages the words of adverts' names and of the hosts that adverts link to stand."""
    html = F.coalesce("html", F.lit(""))
    names = F.concat_ws(" ", F.regexp_extract_all(html, F.lit(ADVERT), 2))
    linked = F.regexp_extract_all(F.concat_ws(" ", F.regexp_extract_all(html, F.lit(ADVERT), 3)), F.lit(r"""(?i)://([^/?#"'\s<>]+)"""), 1)
    hosts = F.flatten(F.transform(linked, lambda host: pieces(F.lower(host), F.lit(""))))
    found = F.array_distinct(F.concat(F.split(F.lower(names), r"[^\p{L}]+"), hosts))
    return pages.select(F.explode(found).alias("word")).where(f"word <> '' and length(word) <= {LONGEST_WORD}").groupBy("word").agg(F.count("*").alias("n"))


def log_ratios(allowed: DataFrame, seeds: DataFrame, adverts: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """word, ratio: log P(word | blocked) - log P(word | allowed) of words without their plural s, from (word, n) of each class."""
    parts = [(allowed, "allowed", 0.0), (seeds, "listed", 0.0), (adverts, "adverts", 0.0), (learned, "learned", FEW_LEARNED)]
    both, totals = None, {}
    for frame, name, more in parts:
        if frame is None:
            continue
        own = frame.select(without_plural(c("word")).alias("word"), F.lit(name).alias("part"), c("n").cast("double").alias("n"))
        both = own if both is None else both.unionByName(own)
        totals[name] = more
    for r in both.groupBy("part").agg(F.sum("n").alias("n")).collect():  # four rows at most
        totals[r["part"]] += r["n"]
    counts = both.groupBy("word").agg(*(F.coalesce(F.sum(F.when(c("part") == name, c("n"))), F.lit(0.0)).alias(name) for name in totals))
    share = {name: c(name) / F.lit(max(1.0, total)) for name, total in totals.items()}
    blocked = F.lit(ORDINARY) * share["allowed"] + F.lit(LISTED) * share["listed"] + F.lit(ADVERTS) * share["adverts"]
    if learned is not None:
        blocked = blocked + F.lit(LEARNED) * share["learned"]
    return counts.select("word", F.log((blocked + LEAST) / (share["allowed"] + LEAST)).alias("ratio"))


def key_scores(by_key: DataFrame, words: DataFrame, ratios: DataFrame) -> DataFrame:
    """key, ratio: the sum over the words of its pieces."""
    weights = words.join(ratios, "word").groupBy("piece").agg(F.sum("ratio").alias("ratio"))
    return by_key.join(weights, "piece").groupBy("key").agg(F.sum("ratio").alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], seeds: Sequence[str] = BLOCKED_WORDS, prior: float = PRIOR_BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict and the score behind it (over 0: blocked) of each page."""
    host, path = host_and_path(c("url"))
    urls = own_columns(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat_ws(" ", F.array_sort(pieces(c("host"), c("path")))))
    listed = pages.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n long")
    titles, adverts = kept(word_counts(own_columns(pages, "html")), "title-words"), kept(advert_words(own_columns(pages, "html")), "advert-words")
    vocabulary = titles.unionByName(listed).unionByName(adverts.select("word", F.lit(1).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    keys = urls.where("key <> ''").select("key").distinct()
    by_key = kept(keys.select("key", F.explode(F.split("key", " ")).alias("piece")), "url-pieces")
    words = kept(segmented(by_key.select("piece").distinct(), vocabulary).select("piece", F.explode("words").alias("word")).withColumn("word", without_plural(c("word"))), "url-words")
    base = log(prior / (1.0 - prior))
    first = key_scores(by_key, words, log_ratios(titles, listed, adverts)).select("key", (c("ratio") + base > 0).alias("blocked"))
    judged = by_key.join(first, "key", "left").groupBy("piece").agg(F.sum(F.when(c("blocked"), 1).otherwise(-1)).alias("n"))
    learned = kept(words.join(judged, "piece").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "learned-words")
    scores = key_scores(by_key, words, log_ratios(titles, listed, adverts, learned))
    rule, decided = rule_for(c("host"), c("path"), rules)
    score = F.coalesce("ratio", F.lit(0.0)) + base
    return (urls.join(scores, "key", "left").withColumn("score", score)
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(decided, F.when(c("score") > 0, "block").otherwise("allow")).alias("verdict"), "score"))
