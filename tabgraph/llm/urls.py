"""Operator 10: URL filters by host rules and, where none fits, a character language-model ratio. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, written

#: (host, path, allowed): the longest that fits wins.
RULES = (("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4  # characters of context
BROADCAST_ROWS = 50_000
SPAN = 20.0  # scores are held within this of 0, in nats a character


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as 'host/path'; null if none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)) for h, p, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(text: Column, order: int = ORDER) -> Column:
    """Array of (context of `order` characters, character) at each place of a text; \\x02 stands before it, \\x03 ends it."""
    padded = F.concat(F.lit("\x02" * order), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def log_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): ln of the accepted model's probability of each gram's last character over the rejected model's.

    `counted` has gram, acc and rej (times seen in accepted and rejected URLs, 0 for grams to be scored only). Both are
    variable-order Markov models by Witten-Bell: an order's relative frequencies are mixed with those of the next
    shorter context by the number of distinct characters seen after the context, and a context that was never seen
    leaves it to the shorter one; below order 0 every character of the table, and one more, is as likely.
    """
    seen, sides = counted, ("acc", "rej")
    alphabet = F.broadcast(counted.select(F.countDistinct(F.substr("gram", F.lit(order + 1), F.lit(1))).alias("letters")))  # one row
    probs = None
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        own = seen.groupBy(tail.alias("g")).agg(*(F.sum(s).alias(s) for s in sides))
        head = F.substring("g", 1, k)
        if k == 0:
            totals = F.broadcast(own.agg(*(F.sum(s).alias(f"n_{s}") for s in sides), *(F.count_if(F.col(s) > 0).alias(f"t_{s}") for s in sides)))
            own = own.crossJoin(totals).crossJoin(alphabet)  # with one row each
            below = {s: 1.0 / (F.col("letters") + 1) for s in sides}
        else:
            totals = own.groupBy(head.alias("h")).agg(*(F.sum(s).alias(f"n_{s}") for s in sides), *(F.count_if(F.col(s) > 0).alias(f"t_{s}") for s in sides))
            own = own.withColumn("h", head).join(totals, "h").withColumn("lower", F.substring("g", 2, k)).join(probs, "lower")
            below = {s: F.col(f"p_{s}") for s in sides}
        mix = {s: F.when(F.col(f"n_{s}") + F.col(f"t_{s}") > 0, (F.col(s) + F.col(f"t_{s}") * below[s]) / (F.col(f"n_{s}") + F.col(f"t_{s}"))).otherwise(below[s]) for s in sides}
        probs = own.select(F.col("g").alias("lower"), *(mix[s].alias(f"p_{s}") for s in sides))
    return probs.select(F.col("lower").alias("gram"), F.ln(F.col("p_acc") / F.col("p_rej")).alias("ratio"))


def judged(spark: SparkSession, pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url).

    verdict is the fitting rule's, else allow where score, the log-likelihood ratio of host + path a character, is at
    least the threshold. The models learn from all URLs that a rule judges, but for a fifth of them (by hash), on which
    the threshold that errs least on both sides alike is found (the smallest of equals; 0 if either side is missing). Null URLs and
    those without :// have empty host and path and score 0. Each distinct host + path is scored once, with its number
    of pages as its weight, so repeated URLs cost nothing; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    allowed = [h + p for h, p, ok in rules if ok]
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", fit)
    p = written(spark, p.withColumn("key", F.concat("host", "path")), "urls")
    texts = p.groupBy("key").agg(F.first("rule").alias("rule"), F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("ok", F.col("rule").isin(allowed)).withColumn("held", F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    side = lambda ok: F.sum(F.when((F.col("ok") == ok) & ~F.col("held"), F.col("n")).otherwise(0))
    exploded = texts.where(F.col("key") != "").select("key", "ok", "held", "n", F.explode(grams(F.col("key"), order)).alias("gram"))
    counted = written(spark, exploded.groupBy("gram").agg(F.coalesce(side(True), F.lit(0)).alias("acc"), F.coalesce(side(False), F.lit(0)).alias("rej")), "grams")
    model = written(spark, log_ratios(counted, order), "model")
    if model.count() <= BROADCAST_ROWS:
        hit = exploded.join(F.broadcast(model), "gram")
    else:  # any size: partial sums of each gram's texts would not help, so AQE splits what is frequent
        hit = exploded.join(model.hint("merge"), "gram")
    scores = hit.groupBy("key").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("chars"))
    scores = written(spark, texts.join(scores, "key", "left").select("key", "ok", "held", "n", F.when(F.col("chars").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("sum") / F.col("chars"))), 6)).alias("score")), "scores")
    threshold = calibrated(scores.where(F.col("held") & F.col("ok").isNotNull()))
    out = p.join(scores.select("key", "score"), "key").crossJoin(F.broadcast(threshold))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(allowed), "allow").otherwise("block")).when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrated(scores: DataFrame) -> DataFrame:
    """One row (threshold): over a histogram of bounded length, the bin's lower edge with the least sum of error rates."""
    from pyspark.sql import Window

    bins = scores.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("r"))
    up, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rates = bins.select("bin", (F.coalesce(F.sum("a").over(up), F.lit(0)) / F.sum("a").over(all_)).alias("lost"), (1 - F.coalesce(F.sum("r").over(up), F.lit(0)) / F.sum("r").over(all_)).alias("let"), F.sum("a").over(all_).alias("na"), F.sum("r").over(all_).alias("nr"))
    best = rates.where((F.col("na") > 0) & (F.col("nr") > 0)).agg(F.min_by("bin", F.struct(F.col("lost") + F.col("let"), "bin")).alias("bin"))
    return best.select(F.coalesce(F.col("bin") / 100, F.lit(0.0)).alias("threshold"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
