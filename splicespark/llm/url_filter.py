"""URL filters: host and path rules, and a character language-model ratio for the rest. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
PARTS = r"^(?s)(.*?)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null or without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(part(2), UPPER, LOWER), part(3)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it and the start of the path: struct verdict, rule."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))).otherwise(found)
    return found


def grams(urls: DataFrame, order: int) -> DataFrame:
    """key, context (up to `order` characters before), sign and times: each character of each url, and its end."""
    n = F.length("url")
    at = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.struct(F.substring("url", F.greatest(F.lit(1), i - order), F.least(F.lit(order), i - 1)).alias("context"), F.substring("url", i, F.lit(1)).alias("sign")))
    return urls.select(*(c for c in urls.columns if c != "url"), F.explode(at).alias("g")).select("*", "g.*").drop("g")


def log_ratios(labelled: DataFrame, order: int, strength: float) -> DataFrame:
    """For each context and sign of the labelled urls: `ratio`, log P(sign | context) of accepted less of rejected.

    Each order's estimate is smoothed with the next shorter one's, (n(context, sign) + strength * shorter) / (n(context)
    + strength), down to one over the number of signs; a context that one class lacks so takes the shorter one's value.
    Rows are there for each context length; the longest one known is to be used.
    """
    seen = grams(labelled, order).groupBy("accepted", "context", "sign").agg(F.count(F.lit(1)).alias("n"))
    counts = written(seen.groupBy("context", "sign").agg(*(F.coalesce(F.sum(F.when(F.col("accepted") == v, F.col("n"))), F.lit(0)).alias(k) for k, v in (("a", True), ("r", False)))))
    signs = counts.agg(F.greatest(F.count_distinct("sign"), F.lit(1)).alias("signs"))
    shorter, levels = None, []
    for k in range(order + 1):
        cut = lambda c, k=k: F.substring(c, F.greatest(F.lit(1), F.length(c) - k + 1), F.lit(k)) if k else F.lit("")
        own = counts.filter(F.length("context") >= k).groupBy(cut("context").alias("context"), "sign").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        whole = own.groupBy("context").agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
        own = own.join(whole, "context")
        if shorter is None:
            own = own.crossJoin(F.broadcast(signs)).withColumns({"low_a": 1.0 / F.col("signs"), "low_r": 1.0 / F.col("signs")})
        else:
            low = shorter.select(F.col("context").alias("_context"), F.col("sign").alias("_sign"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
            own = own.join(low, (F.substring("context", 2, k) == F.col("_context")) & (F.col("sign") == F.col("_sign")))
        smooth = lambda x: (F.col(x) + strength * F.col(f"low_{x}")) / (F.col(f"all_{x}") + strength)
        shorter = written(own.select("context", "sign", smooth("a").alias("p_a"), smooth("r").alias("p_r")))
        levels.append(shorter.select("context", "sign", F.log(F.col("p_a") / F.col("p_r")).alias("ratio")))
    for level in levels[1:]:
        levels[0] = levels[0].unionByName(level)
    return levels[0]


def mean_ratios(urls: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """key, score: the mean over the url's characters of the ratio of the longest known context (0 where none knows the sign).

    Ratios are looked up for each kind of context and sign once, not for each place where it stands, and written: the
    places of a very common kind are shuffled for the join alone, so that Spark can split them.
    """
    places = grams(urls, order)
    kinds = places.groupBy("context", "sign").agg(F.count(F.lit(1)).alias("n"))
    suffixes = F.transform(F.sequence(F.lit(0), F.length("context")), lambda k: F.substring("context", F.length("context") - k + 1, k))
    tried = kinds.select("context", "sign", F.explode(suffixes).alias("suffix"))
    known = model.select(F.col("context").alias("suffix"), "sign", "ratio")
    best = written(tried.join(known, ["suffix", "sign"]).groupBy("context", "sign").agg(F.max_by("ratio", F.length("suffix")).alias("ratio")))
    return places.join(best, ["context", "sign"], "left").groupBy("key").agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count(F.lit(1))).alias("score"))


def threshold_of(scored: DataFrame, steps: int = 200, width: float = 0.02) -> DataFrame:
    """One row, threshold: where the share of accepted urls above it plus the share of rejected ones below is greatest.

    Scores are counted in a fixed number of steps, so that whatever the input this looks at 2 * steps rows at most. Of
    equal places the middle one; 0 when a class is missing.
    """
    from pyspark.sql import Window as W

    step = F.greatest(F.lit(-steps), F.least(F.lit(steps), F.floor(F.col("score") / width)))
    counted = scored.groupBy(step.alias("step")).agg(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("r"))
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    shares = counted.select("step", *((F.sum(k).over(upto) / F.sum(k).over(everything)).alias(k) for k in "ar"))
    gain = shares.select("step", (F.col("r") - F.col("a")).alias("gain"), F.lead("step").over(W.orderBy("step")).alias("next"))
    best = gain.filter("gain is not null").orderBy(F.desc("gain"), "step").limit(1)
    return best.agg(F.coalesce(F.max((F.col("step") + 1 + F.coalesce("next", F.col("step") + 1)) / 2 * width), F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules=RULES, order: int = 4, strength: float = 1.0, held_out: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every url.

    Urls that a rule decides teach two character models of up to `order` characters of context, one for allowed and one
    for blocked urls. A url that no rule fits is allowed when its mean log ratio is over a threshold, which is set on one
    in `held_out` of the labelled urls that the models didn't see. Equal urls are learned from and scored once. Without
    urls of both labels all are allowed. Null urls have empty host and path and are scored as empty; repeated page_ids are
    rows of their own; other columns are ignored; long urls are scored whole; an empty table
    gives no rows.
    """
    host, path = parts_of(F.col("url"))
    split = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumns({"host": host, "path": path}).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    urls = written(split.groupBy("url").agg(F.first("found.verdict").alias("label")).withColumn("key", F.monotonically_increasing_id()))
    labelled = urls.filter("label is not null").select("key", "url", (F.col("label") == "allow").alias("accepted"))
    kept_out = F.pmod(F.xxhash64("url"), F.lit(held_out)) == 0
    model = log_ratios(labelled.filter(~kept_out), order, strength)
    # The url's beginning decides nothing that the rules left open, so all characters count alike.
    scored = written(mean_ratios(urls.select("key", "url"), model, order).join(urls, "key"))
    threshold = threshold_of(scored.filter(F.col("label").isNotNull() & kept_out).select("score", (F.col("label") == "allow").alias("accepted")))
    judged = scored.crossJoin(F.broadcast(threshold)).select("url", "score", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block").alias("guess"))
    return split.join(judged, "url").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "guess").alias("verdict"), "score")
