"""URL filter: rules first, then a ratio of character language models, in DataFrame operations.

URLs that a rule decides are the accepted and rejected examples. Two Markov models of variable
order (contexts of 0 to ``ORDER`` characters, Witten-Bell interpolation) are counted from four
fifths of them; a URL's score is the difference of its log-likelihoods divided by its length. The
threshold is the score that separates the other fifth with the least sum of both error rates.
Counts are kept per distinct gram and URLs are scored once per distinct URL, so copies cost nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .saved import attach, saved

ORDER = 3
#: Beyond this many distinct grams their weights are joined by a shuffle, hot grams dealt apart, instead of a broadcast.
BROADCAST_GRAMS = 200_000
#: One in so many examples, by CRC-32 of its URL, is held out of the counts for the threshold.
HELD_OUT = 5
#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule (host/path) that fits the host or a domain above it and starts the path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """Each character with the ORDER characters before it, one row per place."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.col("url"), F.lit("\u0003"))
    return urls.withColumn("padded", padded).select("*", F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER)).alias("i")).withColumn("gram", F.substring(F.col("padded"), F.col("i"), F.lit(ORDER + 1)))


def gram_weights(grams: DataFrame) -> DataFrame:
    """(gram, weight): log of the accepted model's probability over the rejected one's.

    grams: gram, allow, block (counts of a character after its context in either class).
    """
    level = grams.select("gram", "allow", "block")
    levels = [level]
    for k in range(ORDER, 0, -1):
        level = saved(level.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
        levels.append(level)
    out: DataFrame | None = None
    for level in reversed(levels):
        context = F.expr("substring(gram, 1, length(gram) - 1)")
        seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
        stats = level.groupBy(context.alias("context")).agg(*(x for c in ("allow", "block") for x in (F.sum(c).alias(f"{c}_n"), seen(c).alias(f"{c}_t"))), F.count("*").alias("size"))
        level = level.withColumn("context", context).join(stats, "context")
        if out is None:
            level = level.withColumn("allow_p", 1 / (F.col("size") + 1)).withColumn("block_p", 1 / (F.col("size") + 1))
        else:
            level = level.withColumn("lower", F.expr("substring(gram, 2, length(gram))")).join(out, "lower")
        better = lambda c: F.when(F.col(f"{c}_n") > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_p")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(F.col(f"{c}_p"))
        out = saved(level.select(F.col("gram").alias("lower"), better("allow").alias("allow_p"), better("block").alias("block_p")), "model")
    return out.select(F.col("lower").alias("gram"), (F.log("allow_p") - F.log("block_p")).alias("weight"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Judge the URL of every row of ``pages``; one row per row.

    Returns page_id, host, path, rule (the longest fitting one, else null), score (accepted minus
    rejected log-likelihood per character, rounded to nine digits) and verdict: the rule's, else
    'allow' if the score reaches the calibrated threshold, else 'block'.

    Null URLs and those without '://' have an empty host and path and fit no rule; a null URL
    scores 0. Without held-out examples of both classes the counted ones calibrate the threshold,
    and without those it is 0. URLs of any length are read whole. Repeated rows are judged
    alike. No rows give no rows. Other columns are not looked at.
    """
    verdicts = dict(rules)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = reduce(lambda out, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))
    held = F.col("said").isNotNull() & (F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0)
    urls = saved(rows.where("url is not null").withColumn("said", said).groupBy("url", "said").agg(F.count("*").alias("n")).withColumn("held", held), "urls")
    places = _grams(urls.select("url", "said", "n", "held"))
    count = lambda c, which=F.lit(True): F.sum(F.when((F.col("said") == c) & which, F.col("n")).otherwise(0)).alias(c)
    grams = saved(places.groupBy("gram").agg(count("allow", ~F.col("held")), count("block", ~F.col("held")), F.count("*").alias("places")), "grams")
    weights = gram_weights(grams)
    if grams.count() <= BROADCAST_GRAMS:
        both = places.join(F.broadcast(weights), "gram")
    else:
        both = attach(places.select("gram", "url"), weights, "gram", grams.select("gram", F.col("places").alias("n")))
    scored = both.groupBy("url").agg(F.round(F.sum("weight") / F.count("*"), 9).alias("score"))
    scored = saved(urls.join(scored, "url"), "scored")
    bins = scored.where("said is not null").groupBy("held", F.floor(F.col("score") * 100).alias("bin")).agg(count("allow"), count("block"))
    below, all_ = W.partitionBy("held").orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("held")
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(all_))
    wrong = share("allow") + 1 - share("block")
    best = bins.withColumn("wrong", wrong).groupBy("held").agg(F.min_by("bin", F.struct("wrong", "bin")).alias("bin"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).where("allow > 0 and block > 0").orderBy(F.desc("held")).first()
    threshold = best["bin"] / 100 if best else 0.0
    out = attach(rows, scored.select("url", "score"), "url", urls.select("url", "n"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_rule = F.create_map(*(F.lit(x) for r in verdicts.items() for x in r))[F.col("rule")] if verdicts else F.lit(None)
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce(by_rule, F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))
