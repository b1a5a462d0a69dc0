"""URL filter: host and path rules first, then naive Bayes over segmented names.

Names in hosts and paths are split into words by unigram Viterbi, under the shares that separately written
words have in all urls. The words, all of them, stay a table: a name's parts are joined to it, so no vocabulary is sent to
the executors and none is cut. A multinomial naive Bayes model over host and path words, learned from the urls
that hold seed words (blocked) against all others, decides where no rule does. Pages are first grouped
by host and by path with its numbers masked, so each distinct name is split once and hot hosts are counted
before anything is shuffled.
"""

from __future__ import annotations

import math
import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: (host and path, verdict): fits the host and its subdomains where the path starts alike.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Words whose presence makes a url an example of what to block.
SEEDS = ("adult", "porn", "sex", "xxx", "casino", "poker", "bets", "bet", "gambling", "pills", "viagra", "pharma", "spam", "scam", "malware", "phishing", "warez", "torrent", "ads", "track", "tracker", "clickbait")
#: Letters of the longest word that the segmentation knows.
LONGEST = 40


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decided in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def pieces(host: str, path: str) -> list[tuple[str, str, bool]]:
    """(kind, name, apart) for the names of a host, but for its last label, and of a path whose numbers are masked.

    Names are apart from others in a path and in a label with several; a label of one name may itself be several words.
    """
    labels = [[x for x in re.split(r"[^\w]+|[\d_]+", label) if x] for label in host.split(".")[:-1]]
    return [("h", x, len(names) > 1) for names in labels for x in names] + [("p", x, True) for x in re.split(r"[^\w#]+|_+", path.lower()) if x]


class Segmenter:
    """Most probable split of a name into words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """counts of words, at least of all those that a name to be split holds; total: of all words there are."""
        total = (sum(counts.values()) if total is None else total) + 10
        self.cost = {w: math.log(total / n) for w, n in counts.items() if n > 0}
        self.longest = max(map(len, self.cost), default=0)
        self.start, self.step = math.log(total / 10), math.log(10)

    def split(self, name: str) -> list[str]:
        """Unknown stretches cost more with each character, so known words win where they fit."""
        best, back = [0.0] * (len(name) + 1), [0] * (len(name) + 1)
        open_, since = math.inf, 0  # cheapest unknown stretch that ends here
        for i in range(1, len(name) + 1):
            if best[i - 1] + self.start < open_:
                open_, since = best[i - 1] + self.start, i - 1
            open_ += self.step
            cost, at = open_, since
            for j in range(max(0, i - self.longest), i):
                c = self.cost.get(name[j:i])
                if c is not None and best[j] + c < cost:
                    cost, at = best[j] + c, j
            best[i], back[i] = cost, at
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


def segmented(parts: DataFrame, seeds, longest: int = LONGEST) -> DataFrame:
    """(name, words) for the distinct names of parts (name, apart, n), split under the counts of names that stand apart; seeds count once at least."""
    spark = parts.sparkSession
    apart = parts.where(F.col("apart") & (F.char_length("name") <= longest)).select(F.col("name").alias("word"), "n")
    some = spark.createDataFrame([(s, 0) for s in seeds], "word string, n long")
    known = shared.written(apart.unionByName(some).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")), "words")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = parts.select("name").distinct()
    size = F.char_length("name")
    inside = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.substring(F.col("name"), i, k)))
    held = names.select("name", F.explode(F.array_distinct(F.flatten(inside))).alias("word")).join(known, "word")
    held = held.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("held"))

    def split(batches):
        for b in batches:
            got = [Segmenter(dict(h or ()), total).split(name) for name, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], ["name", "words"])

    return names.join(held, "name", "left").mapInArrow(split, "name string, words array<string>")


def judged(pages: DataFrame, rules=RULES, seeds=SEEDS, page_id: str = "page_id", url: str = "url", longest: int = LONGEST) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds): odds are the model's log odds for blocking.

    Null urls and those without :// have an empty host and path, no rule, and the verdict of the model's prior.
    Repeated rows stay; a null page_id is kept; other columns are ignored; an empty table gives an empty one. Ties in the odds allow.
    Urls of any length are read whole; words of more than longest letters are unknown to the segmentation, at any size of the table.
    """
    shared.tune(pages.sparkSession)
    host, path = address(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    p = p.withColumn("form", F.regexp_replace("path", "[0-9]+", "#"))
    forms = p.groupBy("host", "form").agg(F.count("*").alias("n"))

    def named(batches):
        for b in batches:
            rows = [(h, f, n, *x) for h, f, n in zip(*(c.to_pylist() for c in b.columns)) for x in pieces(h, f)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "form", "n", "kind", "name", "apart"])

    forms = shared.written(forms, "forms")
    parts = shared.written(forms.mapInArrow(named, "host string, form string, n long, kind string, name string, apart boolean"), "parts")
    split = shared.written(segmented(parts, seeds, longest), "split")
    bad = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds]).cast("array<string>"))
    seeded = parts.join(split.where(bad).select("name"), "name", "left_semi").select("host", "form").distinct().withColumn("bad", F.lit(True))
    marked = shared.written(forms.join(seeded, ["host", "form"], "left").select("host", "form", "n", F.coalesce("bad", F.lit(False)).alias("bad")), "marked")
    # counts go by name before words, and by word before anything is joined
    of = parts.join(marked.select("host", "form", "bad"), ["host", "form"]).groupBy("kind", "name").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a"))
    by = of.join(split, "name").select("kind", F.explode("words").alias("word"), "b", "a").groupBy("kind", "word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    by = shared.written(by, "token-counts")
    s = by.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    d = marked.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum("n")).first()
    n_bad, n_all = d[0] or 0, d[1] or 0
    prior = math.log((n_bad + 1) / (n_all - n_bad + 1))
    size_b, size_a = (s[0] or 0) + s[2], (s[1] or 0) + s[2]
    weight = by.select("kind", "word", (F.log((F.col("b") + 1.0) / float(max(size_b, 1))) - F.log((F.col("a") + 1.0) / float(max(size_a, 1)))).alias("w"))
    each = parts.select("kind", "name").distinct().join(split, "name").select("kind", "name", F.explode("words").alias("word"))
    each = each.join(weight, ["kind", "word"]).groupBy("kind", "name").agg(F.sum("w").alias("w"))
    odds = parts.join(each, ["kind", "name"]).groupBy("host", "form").agg(F.sum("w").alias("w"))
    rule, decided = ruled(F.col("host"), F.col("path"), rules)
    out = p.join(odds, ["host", "form"], "left").withColumn("odds", F.coalesce("w", F.lit(0.0)) + prior)
    verdict = F.coalesce(decided, F.when(F.col("odds") > 1e-9, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "odds")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page; a null url has an empty host and path and the verdict of the prior."""
    return judged(shared.read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
