"""URL filter: rules on host and path, and logistic regression on hashed character n-grams for the rest.

Everything is a Spark expression: the n-grams of host and path are hashed into a fixed number of buckets, the
weights are fitted by stochastic gradient steps inside one aggregate expression over the small labelled table,
and reach the pages as a one-row scalar subquery.  No shuffle of the pages, no Python on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host and path, verdict); the rules of the contract.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))

#: Labelled URLs: 1 is unwanted.
LABELLED = tuple((u, 1) for u in (
    "http://casino-win.example.org/play", "https://m.casino-win.example.net/en/22.html",
    "http://www.casino-win.example.org/de/7", "https://big-casino.test/slots/spin", "http://casino.test/poker",
    "https://poker-room.test/bonus", "http://free-bets.example.net/en/1", "https://www.free-bets.example.org/fr/6",
    "http://m.free-bets.example.org/de/9.html", "https://bets-now.test/odds", "http://sports-bets.test/win-cash",
    "https://cheap-pills.example.org/en/3", "http://www.cheap-pills.example.net/de/18.html",
    "https://blog.cheap-pills.example.org/es/4", "http://pills-online.test/buy", "https://cheap-meds.test/no-script",
    "http://spam-farm.example.net/en/5", "https://www.spam-farm.example.org/de/12", "http://m.spam-farm.example.org/1",
    "https://link-farm.test/seo-spam", "http://spam.test/offer", "https://ads-track.example.org/click",
    "http://www.ads-track.example.net/en/9?ref=x", "https://m.ads-track.example.org/de/4.html",
    "http://track-ads.test/pixel", "https://adserver.test/banner", "http://adult-x.example.net/en/8",
    "https://www.adult-x.example.org/fr/2", "http://blog.adult-x.example.org/de/6", "https://adult-cams.test/live",
    "http://xxx.test/adult", "https://free-xxx.test/video")) + tuple((u, 0) for u in (
    "http://en.example.org/wiki/page", "https://www.tionsh.example.net/en/7817", "http://thering.example.org/en/12",
    "https://ththan.example.net/de/7944?page=2&ref=x", "http://therhe.example.org/fr/8423.html",
    "https://m.ththha.example.net/en/1570", "http://blog.tionsh.example.org/de/7424.html", "https://docs.test/guide",
    "http://news.test/politics/2021/report", "https://www.museum.test/exhibitions/painting",
    "http://library.test/catalogue/books", "https://university.test/departments/physics",
    "http://weather.test/forecast/week", "https://recipes.test/soup/vegetables", "http://history.test/archive/letters",
    "https://blog.travel.test/mountains/walk", "http://science.test/articles/biology", "https://www.ththst.example.org/en/3",
    "http://therst.example.net/de/4163", "https://theron.example.org/en/991/", "http://ththble.example.org/fr/44",
    "https://www.tionble.example.net/en/8", "http://city.test/council/minutes", "https://school.test/lessons/maths",
    "http://garden.test/plants/roses", "https://music.test/scores/piano", "http://m.tiontion.example.org/es/5.html",
    "https://ththon.example.net/de/61#top", "http://therer.example.org/en/2?page=3", "https://forum.test/thread/77",
    "http://health.test/advice/sleep", "https://www.therin.example.org/es/10",
    "http://m.thonth.example.net/en/14", "https://blog.therly.example.net/fr/71.html", "http://m.theren.example.org/de/3#top",
    "https://blog.ththnd.example.org/en/20", "http://blog.thered.example.net/es/6?page=2", "https://m.thertion.example.net/fr/9"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.

    A rule fits its host and all subdomains when the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):   # later, longer rules come first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, buckets: int, sizes=(3, 4, 5)) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked with where it stands."""
    def grams(text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(text.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    marked = [F.concat(F.lit("h^"), host, F.lit("$")), F.concat(F.lit("p^"), path, F.lit("$"))]
    return F.array_distinct(F.concat(*[grams(t, n) for t in marked for n in sizes]))


def _margin(weights: Column, marks: Column) -> Column:
    """Bias (first weight) plus the mean weight of the marked buckets, scaled by the root of their number."""
    total = F.aggregate(marks, F.lit(0.0), lambda acc, m: acc + F.element_at(weights, m + 2))
    return F.element_at(weights, 1) + total / F.sqrt(F.greatest(F.size(marks), F.lit(1)).cast("double"))


def fit_weights(spark: SparkSession, labelled=LABELLED, buckets: int = 1024, epochs: int = 60, rate: float = 1.0,
                shrink: float = 1e-4) -> DataFrame:
    """One row ``weights`` (bias first): logistic regression by gradient steps over the labelled URLs.

    ``labelled`` is a small table given by the caller; an empty one gives zero weights.
    """
    size = buckets + 1
    zero = F.array_repeat(F.lit(0.0), size)
    if not labelled:
        return spark.range(1).select(zero.alias("weights"))
    table = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("y")) for u, y in labelled]))
    url = F.col("r.url")
    rows = (spark.range(1).select(table.alias("r"))
            .select(F.col("r.y").alias("y"), features(host_of(url), path_of(url), buckets).alias("marks"), url.alias("u"))
            .withColumn("x", F.transform(
                F.sequence(F.lit(-1), F.lit(buckets - 1)),
                lambda d: F.when(d == -1, 1.0).when(F.array_contains("marks", d), 1.0 / F.sqrt(F.size("marks").cast("double")))
                .otherwise(0.0)))
            # order by a digest, so that the two classes alternate at random
            .agg(F.sort_array(F.collect_list(F.struct(F.md5("u").alias("o"), "y", "marks", "x"))).alias("rows")))

    def step(w: Column, r: Column) -> Column:
        error = r["y"] - 1 / (1 + F.exp(-_margin(w, r["marks"])))
        # a one-element array binds the error, so that it is computed once and not per weight
        return F.aggregate(F.array(error), w, lambda acc, e: F.zip_with(
            acc, r["x"], lambda a, b: a * (1 - rate * shrink) + rate * e * b))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), zero,
                         lambda w, _: F.aggregate(F.col("rows"), w, step))
    return rows.select(fitted.alias("weights"))


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, buckets: int = 1024, threshold: float = 0.5,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: one row per page.

    The longest fitting rule decides; else the classifier blocks from ``threshold`` on.  A null URL or one
    without ``://`` has an empty host and path and is judged by the classifier like any other.  Repeated rows
    are judged one by one; an empty table gives an empty result; other columns are ignored.
    """
    weights = fit_weights(pages.sparkSession, labelled, buckets)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    marked = rows.withColumn("marks", features(F.col("host"), F.col("path"), buckets))
    margin = _margin(F.col("weights"), F.col("marks"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    return (marked.withColumn("weights", weights.scalar())
            .withColumn("p_block", 1 / (1 + F.exp(-margin)))
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(says, F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"),
                    F.round("p_block", 6).alias("p_block")))
