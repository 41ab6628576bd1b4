"""URL filter: rules first, then segmented host and path words under naive Bayes.

Host and path names are cut at separators, and each name is split by unigram
Viterbi over a lexicon (``casinowin`` -> ``casino win``).  A multinomial naive
Bayes model over the segmented words gives the verdict where no rule fits.

The two classes' example names are fixed parameters, for the table marks no url as
bad but by the rules, whose hosts hold pages of both kinds.  The lexicon holds their
words and the words that urls separate themselves (``casino-win``), the ``MOST_WORDS``
most frequent of these, with counts over all urls of the table.

Edge cases: a null url, or one without ``://``, has an empty host and path and
is allowed with score 0.5, as is a url of words that no class knows; names of any
length are split whole, an unknown word holds ``UNKNOWN`` letters at most; of equally
likely splits the one whose last word is longest is taken; urls and ids may repeat;
the empty table gives no rows; columns of the input other than page_id and url play
no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rules: (host suffix with path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Example names of the two classes, as words of a url.
BLOCK_EXAMPLES = """
casino win|casino bonus|online casino|best casino slots|free bets|sports betting|bet now|poker room|jackpot spins|lotto win
cheap pills|buy pills online|pharmacy discount|viagra cheap|weight loss pills|payday loan|fast cash|easy money|cheap loans
adult x|adult video|xxx porn|hot sex cams|nude girls|escort dating|spam farm|link farm|seo spam|ads track|ad server|click track
popup ads|tracking pixel|malware download|free crack keygen|warez torrent|phishing login|fake replica|cheap watches|get rich quick
""".replace("\n", "|")
ALLOW_EXAMPLES = """
news daily|science journal|university library|public school|city council
open source project|developer docs|weather report|health advice|history museum|music review|travel guide|food recipes
local paper|book club|garden blog|photo archive|the wiki|help forum|government service|research data|english page|art gallery
sports news|video lecture|free software|online course|cash book|best practice
""".replace("\n", "|")
#: Words that stay apart in names though no class knows them.
COMMON_WORDS = "my your the and for all top new web net site home page go up get how to of in on with shop store info tech web world"

ALPHA = 0.5
#: Words that the lexicon learns from the table, and letters of a word that it doesn't know.
MOST_WORDS, UNKNOWN = 20_000, 24


def _examples(text: str) -> list[list[str]]:
    return [x.split() for x in text.split("|") if x.strip()]


LEXICON = tuple(sorted({w for text in (BLOCK_EXAMPLES, ALLOW_EXAMPLES) for x in _examples(text) for w in x} | set(COMMON_WORDS.split())))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as native expressions; empty where there is none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain) and path, with its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi: the likeliest split of a name; unknown runs cost by length."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + len(counts) + 1
        self.cost = {w: -math.log((c + 1) / total) for w, c in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown, self.letter = math.log(total) + 2.0, 2.2

    def split(self, name: str) -> tuple[str, ...]:
        n = len(name)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        reach = max(self.longest, UNKNOWN)
        for end in range(1, n + 1):
            for start in range(max(0, end - reach), end):
                word = name[start:end]
                known = self.cost.get(word) if end - start <= self.longest else None
                if known is None and end - start > UNKNOWN:
                    continue
                cost = best[start][0] + (known if known is not None else self.unknown + self.letter * (end - start))
                if cost < best[end][0]:
                    best[end] = (cost, start)
        words, end = [], n
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return tuple(reversed(words))


def names_of(host: str, path: str) -> list[str]:
    """Names between separators; runs of digits are dropped."""
    return re.findall(r"[^\W\d_]+", f"{host} {path}".lower())


class NaiveBayes:
    """Multinomial naive Bayes with additive smoothing and even priors."""

    def __init__(self, block: list[list[str]], allow: list[list[str]], alpha: float = ALPHA):
        vocabulary = {w for x in block + allow for w in x}
        self.weight: dict[str, float] = {}
        sizes = [sum(map(len, side)) + alpha * len(vocabulary) for side in (block, allow)]
        for w in vocabulary:
            b, a = ((sum(x.count(w) for x in side) + alpha) / size for side, size in zip((block, allow), sizes))
            self.weight[w] = math.log(b / a)

    def score(self, words: list[str]) -> float:
        """Probability of the block class; unknown words have no say."""
        odds = sum(self.weight.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def lexicon_counts(pages: DataFrame) -> dict[str, int]:
    """The lexicon's words, with counts of how often urls of the table separate them."""
    labels = F.explode(F.split(F.lower(F.coalesce("url", F.lit(""))), r"[^a-z+_-]+")).alias("label")
    words = pages.select(labels).where(F.col("label").rlike("[a-z][+_-]+[a-z]")).select(F.explode(F.split("label", "[+_-]+")).alias("word"))
    counted = words.where(F.length("word").between(2, UNKNOWN)).groupBy("word").count()
    counts = dict.fromkeys(LEXICON, 0)
    for text in (BLOCK_EXAMPLES, ALLOW_EXAMPLES):
        for x in _examples(text):
            for w in x:
                counts[w] += 1
    for r in counted.orderBy(F.col("count").desc(), "word").limit(MOST_WORDS).collect():
        counts[r["word"]] = counts.get(r["word"], 0) + int(math.log2(1 + r["count"]))
    return counts


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict; then the method's score and host words."""
    segmenter = Segmenter(lexicon_counts(pages))
    model = NaiveBayes(_examples(BLOCK_EXAMPLES), _examples(ALLOW_EXAMPLES))

    @F.pandas_udf("score double, words string")
    def method(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        split = lru_cache(maxsize=50_000)(segmenter.split)  # names recur from url to url
        for hosts, paths in parts:
            words = [[w for name in names_of(h, p) for w in split(name)] for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"score": [model.score(w) for w in words], "words": [" ".join(w) for w in words]})

    host, path = split_url(F.col("url"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    found = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), method("host", "path").alias("m"))
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("m.score") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("m.score").alias("score"), F.col("m.words").alias("words"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
