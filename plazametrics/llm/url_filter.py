"""URL filter: rules by host and path, and for the rest words of the host and naive Bayes.

Host names are concatenated words. Each label of a host is segmented by a unigram model: Viterbi over the cuts into known
words of three letters or more. Words are counted in the pages' visible text, without markup, entities, urls and words
that only names of hosts have, and in host names, where dots and hyphens already part them: once a domain (the last two
labels), a label's own domain aside. A label that no cut explains stays whole, whatever its length. Only substrings of
labels are joined with the counts, so no word list travels.
Multinomial naive Bayes then scores the segmented host words and the path's words. The rules are a policy about sites
and languages and say nothing about words, so they are not learned from: a url counts as unwanted where a word of its
host or path is a seed word, and as wanted otherwise, and the words that stand with the seeds are learned from that.
Counts are kept by word in a table, from which each word's odds are joined to the distinct lists of words that urls have.

Null urls and urls without "://" have an empty host and path; no rule fits them and the method judges them by its
prior alone. Repeated rows are judged alike. Other columns are not read, but for the text that gives word counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Words with this share of all words or more, a thousand at most, are broadcast; no other word fills a task.
COMMON = 0.001
LONGEST_WORD = 24
#: Parts of a label have so many letters at least; shorter words stand only as a label of their own.
SHORTEST_PART = 3
#: A label longer than this is not a legal host label; it is one word.
LONGEST_LABEL = 63
#: Words that mark unwanted urls, each counted ``SEED_WEIGHT`` times besides the urls that have it.
SEEDS = ("casino", "bet", "bets", "pills", "cheap", "viagra", "porn", "ads", "poker", "loan", "lottery", "spam", "xxx")
SEED_WEIGHT = 5


@dataclass(frozen=True)
class Rule:
    """``name`` is host and path together; the rule fits the host, its subdomains, and paths that begin alike."""

    name: str
    verdict: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of name and verdict of the longest rule that fits; null where none does."""
    choice = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice


def visible(html: Column) -> Column:
    """Text between the tags: without entities, comments, scripts, styles, tags with their attributes, and urls."""
    for pattern in (r"&(?:amp;)*(?:#?[A-Za-z0-9]{1,31};)?", r"(?s)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1\s*>", r"""<[A-Za-z/!?](?:[^'">]++|"[^"]*+"|'[^']*+')*+>""", r"<[A-Za-z/!?][^>]*>", r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s<>"']*"""):
        html = F.regexp_replace(html, pattern, " ")
    return html


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """(word, n): runs of a-z in the pages' visible text; words that occur in dotted names alone are left out."""
    chunks = pages.select(F.explode(F.split(lower_ascii(visible(F.col(text))), "[^a-z0-9.-]+")).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    dotted = F.col("chunk").rlike(r"[a-z0-9-]\.[a-z0-9-]")
    words = chunks.select(F.explode(F.split("chunk", "[^a-z]+")).alias("word"), "n", F.when(dotted, 0).otherwise(F.col("n")).alias("apart"))
    counted = words.where((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    return counted.where("apart > 0").select("word", "n")


def host_parts(hosts: DataFrame) -> DataFrame:
    """(word, hosts): runs of a-z between the dots, hyphens and figures of host names, and how many domains have them."""
    domain = F.substring_index("host", ".", -2)
    parts = hosts.select(domain.alias("domain"), F.explode(F.split("host", "[^a-z]+")).alias("word")).where("word != ''").distinct()
    return parts.groupBy("word").agg(F.count(F.lit(1)).alias("hosts"))


def segmented(label: str, known: dict[str, float], unknown: float) -> list[str]:
    """The most likely cut of a label into known words and runs of figures, or the label as it is.

    ``unknown`` is the cost of a letter of an unknown label, which counts two letters more; a run of figures costs two.
    """
    best: list[float] = [0.0] + [-np.inf] * len(label)
    back = [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = label[start:end]
            cost = 2 * unknown if word.isdigit() else known.get(word) if len(word) >= SHORTEST_PART else None
            if cost is not None and best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    if best[-1] <= known.get(label, unknown * (2 + len(label))):
        return [label]
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def label_words(labels: DataFrame, counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(label, words) for every distinct label: each group holds only the label's own substrings that are words.

    ``counts``: (word, n) of texts; ``hosts``: (word, hosts) of host names, where a label itself counts once less.
    """
    known = stored(counts.join(hosts, "word", "full_outer").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hosts", F.lit(0)).alias("hosts")), "known")
    size = float(known.agg(F.sum(F.col("n") + F.col("hosts"))).first()[0] or 1)
    distinct = labels.select("label").distinct().where("length(label) > 0")
    parts = F.expr(
        f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({LONGEST_WORD}, length(label) - i + 1)), k -> substr(label, i, k))))"
    )
    short = F.when(F.length("label") <= LONGEST_LABEL, F.array_distinct(F.concat(parts, F.array("label")))).otherwise(F.array().cast("array<string>"))
    n = F.col("n") + F.col("hosts") - F.when(F.col("word") == F.col("label"), F.least("hosts", F.lit(1))).otherwise(0)
    found = (
        distinct.select("label", F.explode_outer(short).alias("word")).join(known, "word", "left").withColumn("n", n)
        .groupBy("label").agg(F.collect_list(F.when(F.col("n") > 0, F.struct("word", "n"))).alias("words"))
    )

    @F.pandas_udf("array<string>")
    def cut(label: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for name, own in zip(label, words):
            logs = {w["word"]: float(np.log(w["n"] / size)) for w in own}
            out.append([name] if len(name) > LONGEST_LABEL else segmented(name, logs, -float(np.log(size + 1)) / 2))
        return pd.Series(out)

    return found.select("label", cut("label", "words").alias("words"))


def judged(pages: DataFrame, rules: list[Rule], page: str = "page_id", url: str = "url", text: str = "html", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_words, score (log odds of block)."""
    spark = pages.sparkSession
    split = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    # Each distinct host is cut once; its words are then looked up by host.
    hosts = split.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", "[.:@_-]")).alias("at", "label")).where("label != ''")
    cut = label_words(labels, word_counts(pages, text), host_parts(hosts))
    host_words = labels.join(cut, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("x"))
    host_words = host_words.select(F.col("host").alias("_host"), F.flatten(F.col("x.words")).alias("host_words"))
    path_words = F.filter(F.split(F.regexp_replace(lower_ascii(F.col("path")), "[0-9]+", "0"), "[^a-z0-9]+"), lambda w: w != "")
    rows = ruled.join(host_words, F.col("host") == F.col("_host"), "left").drop("_host").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    rows = rows.withColumn("words", F.concat("host_words", F.transform(path_words, lambda w: F.concat(F.lit("/"), w))))

    rows = stored(rows, "urls")

    unwanted = F.exists("words", lambda w: F.regexp_replace(w, "^/", "").isin(list(seeds)))
    lists = stored(rows.groupBy("words").agg(F.count(F.lit(1)).alias("n")).withColumn("unwanted", unwanted), "words")
    block, allow = F.when(F.col("unwanted"), F.col("n")).otherwise(0), F.when(F.col("unwanted"), 0).otherwise(F.col("n"))
    seeded = spark.createDataFrame([(w, SEED_WEIGHT, 0) for w in dict.fromkeys(seeds)], "word string, block bigint, allow bigint")
    counted = lists.select(F.explode("words").alias("word"), block.alias("block"), allow.alias("allow")).union(seeded)
    counted = stored(counted.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "counts")
    total = counted.agg(F.count(F.lit(1)).alias("words"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    used, n_block, n_allow = total.words + 1, total.block or 0, total.allow or 0
    odds = F.log((F.col("block") + 1) / (n_block + used)) - F.log((F.col("allow") + 1) / (n_allow + used))
    common = F.col("block") + F.col("allow") >= COMMON * (n_block + n_allow)
    frequent, others = counted.where(common).select("word", odds.alias("odds")), counted.where(~common).select("word", odds.alias("odds"))
    classes = lists.agg(F.sum(block).alias("block"), F.sum(allow).alias("allow")).first()
    start = float(np.log(((classes.block or 0) + 1) / ((classes.allow or 0) + 1)))

    each = lists.select("words", F.explode("words").alias("word"))
    found = each.join(F.broadcast(frequent), "word").unionByName(each.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(others, "word"))
    # Added in order of size, so that a score does not depend on the order of rows.
    scores = found.groupBy("words").agg(F.aggregate(F.sort_array(F.collect_list("odds")), F.lit(start), lambda x, y: x + y).alias("_score")).withColumnRenamed("words", "_words")
    scored = rows.join(scores, F.col("words") == F.col("_words"), "left").withColumn("score", F.coalesce("_score", F.lit(start)))
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), "host_words", "score")
