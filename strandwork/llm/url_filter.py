"""Judging urls by rules and, where no rule fits, by two character language models. DataFrame operations only.

Both models are variable-order Markov models with Witten-Bell smoothing: the chance of a character after its context is
that of the longest context seen in training, mixed with the next shorter one by how often the context was followed by
something new. One learns the urls that an allow rule accepts, the other those that a block rule rejects. A url's score
is the mean over its characters of log(accepted) - log(rejected); what lies below a threshold is blocked. The threshold
is calibrated on the labelled urls outside the training folds: it keeps the largest mean of the two classes' hit rates.

All counts are sums over distinct character grams, all look-ups joins on grams, so nothing is held whole anywhere; a
url that many rows share is scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.common import apart, drop, written

#: Longest context in characters; one url in FOLDS calibrates; histogram steps per unit of score, and its ends.
ORDER, FOLDS, STEPS, END = 4, 5, 50, 10
#: Stand for what comes before a url and after it.
BEGIN, STOP = "\x02", "\x03"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as struct<rule, verdict>, or null. A fixed, short list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        under = (host == rule_host) | host.endswith("." + rule_host)
        out = F.when(under & path.startswith(rule_path), F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """urls with gram: each character and the end, behind the `order` characters before it."""
    padded = F.concat(F.lit(BEGIN * order), F.col("url"), F.lit(STOP))
    places = F.sequence(F.lit(1), F.length("url") + 1)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda p: F.substring(padded, p, F.lit(order + 1)))))


def _ratios(counts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """(gram, llr): for each wanted gram the log chance of its last character after the rest among accepted urls, less
    that among rejected ones, from counts (gram, good, bad) of grams of ORDER + 1 characters. Each order is written
    before the next is built on it, so plans stay short."""
    spark = counts.sparkSession
    sides = ("good", "bad")
    chance = path = None
    for k in range(ORDER + 1):
        grams = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("g")).agg(*(F.sum(s).alias(s) for s in sides))
        totals = [F.sum(s).alias(f"{s}_total") for s in sides] + [F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in sides]
        now = wanted.select(F.right("gram", F.lit(k + 1)).alias("g")).distinct().join(grams, "g", "left")
        if k == 0:
            row = grams.agg(*totals).first()  # one row: sizes of the alphabets
            sums = {c: F.lit(float(row[c] or 0)) for s in sides for c in (f"{s}_total", f"{s}_kinds")}
        else:
            contexts = grams.groupBy(F.left("g", F.lit(k)).alias("h")).agg(*totals)
            now = now.withColumns({"h": F.left("g", F.lit(k)), "s": F.right("g", F.lit(k))}).join(contexts, "h", "left")
            now = now.join(chance.select(F.col("g").alias("s"), *(F.col(f"{s}_p").alias(f"{s}_q") for s in sides)), "s")
            sums = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for s in sides for c in (f"{s}_total", f"{s}_kinds")}
        out = ["g"]
        for s in sides:
            n, total, kinds = F.coalesce(F.col(s), F.lit(0)).cast("double"), sums[f"{s}_total"], sums[f"{s}_kinds"]
            shorter = 1 / (kinds + 1.0) if k == 0 else F.col(f"{s}_q")  # at first all known characters and an unknown one alike
            out.append(F.when(total > 0, (n + kinds * shorter) / F.when(total > 0, total + kinds)).otherwise(shorter).alias(f"{s}_p"))
        new, new_path = written(now.select(*out))
        if path:
            drop(spark, path)
        chance, path = new, new_path
    return chance.select(F.col("g").alias("gram"), (F.log("good_p") - F.log("bad_p")).alias("llr")), path


def threshold(scored: DataFrame) -> Column:
    """From (score, good) the score from which on accepting gives the best mean hit rate, as an aggregate of few rows."""
    bins = F.floor(F.greatest(F.lit(-END), F.least(F.lit(END), F.col("score"))) * STEPS)
    histogram = scored.groupBy(bins.alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("pos"), F.sum((~F.col("good")).cast("long")).alias("neg"))
    whole = Window.partitionBy(F.lit(1))
    below = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum("pos").over(below), F.lit(0)) / F.greatest(F.sum("pos").over(whole), F.lit(1))
    caught = F.coalesce(F.sum("neg").over(below), F.lit(0)) / F.greatest(F.sum("neg").over(whole), F.lit(1))
    rated = histogram.select("bin", (caught - lost).alias("worth"), (-F.abs(F.col("bin"))).alias("near"))
    return rated.agg(F.max_by(F.col("bin"), F.struct("worth", "near", "bin")).alias("bin")).select((F.coalesce("bin", F.lit(0)) / F.lit(float(STEPS))).alias("threshold"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and score (null where a rule decides).

    rules: (allow or block, host, path). A host is what follows the first :// up to /, ? or #, lower-cased in A-Z; a path
    what follows up to ? or #; both are empty without :// or a url. A rule fits its host and all hosts below it whose
    path starts with the rule's; the longest wins. Null urls are judged like empty ones. Without urls of both classes to
    learn from, what no rule fits is allowed. Repeated rows keep their rows; the names host, path, rule, verdict and
    score are replaced if pages has them.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    names, pages = pages.columns, apart(pages)
    url = pages.columns[names.index(url)]
    known = pages.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    parts = known.select(F.col("_url").alias("url")).distinct().withColumns({"h": host_of(F.col("url")), "p": path_of(F.col("url"))})
    urls, _ = written(parts.select("url", fitting_rule(F.col("h"), F.col("p"), rules)["verdict"].alias("verdict")))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)) == 0
    counts = (
        _grams(urls.where(F.col("verdict").isNotNull() & ~held), ORDER)
        .groupBy("gram")
        .agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad"))
    )
    counts, _ = written(counts)
    asked = _grams(urls.where(F.col("verdict").isNull() | held), ORDER)
    wanted, _ = written(asked.select("gram").distinct())
    ratio, _ = _ratios(counts, wanted)
    # In fixed point, so that a sum is the same in any order.
    scores = asked.join(ratio, "gram").groupBy("url", "verdict").agg((F.sum(F.round(F.col("llr") * 2**32).cast("long")) / F.count("*") / 2.0**32).alias("score"))
    scores, _ = written(scores)
    cut = threshold(scores.where("verdict is not null").select("score", (F.col("verdict") == "allow").alias("good"))).first()["threshold"]
    seen = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    trained = bool(seen["good"] and seen["bad"])
    judged = F.when(F.lit(trained) & (F.col("score") < F.lit(float(cut))), "block").otherwise("allow")
    free = scores.where("verdict is null").select(F.col("url").alias("_url"), "score", judged.alias("_judged"))
    out = known.join(free, "_url", "left").withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", fit["rule"]).withColumn("verdict", F.coalesce(fit["verdict"], F.col("_judged"))).select(*pages.columns, "host", "path", "rule", "verdict", "score").toDF(*names, "host", "path", "rule", "verdict", "score")
