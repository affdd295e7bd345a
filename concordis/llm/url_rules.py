"""URL filters: given rules first, then association rules mined from labelled urls, DataFrame functions only.

A given rule is a host and a path start.  It fits its host and all subdomains of it; the longest
rule that fits decides.  Every other url is judged by rules that Spark's FP-growth mines: a
labelled url is a transaction of its tokens (scheme, words of host and path, parts of the query; digit
runs read as 0) and of its label.  Rules whose right side is a label are kept from a stated
confidence and support on, unless a rule with fewer tokens says the same at least as surely.

Tokens that occur in exactly the same labelled urls (equal count and equal 128-bit sum of urls) enter
mining once, under the least of their names: a template of twenty fixed path words is one item then, not
2^20 combinations.

Mined rules are found through an inverted index: each is listed under its rarest token, a url looks up only
the tokens it shares with some rule, and what it finds is kept if the whole left side is there.  Of the
rules that fit, the surest decides, then the better supported, then the longer one, then the first by
name.  A url that no rule fits is allowed.  Equal urls are judged once.

A url is labelled if a row of ``labels`` has its ``page_id`` as ``doc_id``: blocked if any
such row has quality 0 or toxic 1, allowed if none has and one says quality 1 or toxic 0.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by its tokens, if any; a
null page_id has no label; repeated rows are judged alike, and count once for mining; without labels
nothing is mined; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import saved, table, whole

#: (verdict, host, path start), fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A rule holds for this share of all labelled urls at least, and for this many of them.
SUPPORT, LEAST = 0.002, 20
CONFIDENCE = 0.75
LABELS = ("=allow", "=block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    shape = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole(url), shape, 1), UPPER, LOWER), F.regexp_extract(whole(url), shape, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest given rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, its_host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(start)
        text = F.when(fits, F.lit(its_host + start)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """The url's different tokens: kind, colon, word."""
    plain = F.regexp_replace(F.translate(whole(url), UPPER, LOWER), "[0-9]+", "0")
    scheme = F.regexp_extract(plain, "(?s)^(.*?)://", 1)
    host, path = host_and_path(plain)
    query = F.regexp_extract(plain, "(?s)^[^?#]*\\?([^#]*)", 1)

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind + ":"), w))

    return F.array_distinct(
        F.concat(
            named("s", F.array(scheme)), named("h", F.split(host, "[.:@]")),
            named("p", F.split(path, "[/._~-]")), named("q", F.split(query, "&")),
        )
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Different (page_id, url) with a label item."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = (F.col("quality") == 1) | (F.col("toxic") == 0)
    said = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"), F.max(good).alias("good"))
        .select("page_id", F.when(F.col("bad"), F.lit(LABELS[1])).when(F.col("good"), F.lit(LABELS[0])).alias("label"))
        .where(F.col("label").isNotNull())
    )
    return pages.select("page_id", "url").where(F.col("url").isNotNull()).distinct().join(said, "page_id")


def mine(
    labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(rules, index) of ``labelled`` (page_id, url, label).

    rules: rule_id, antecedent, verdict, confidence, support.  index: the same with ``rare``, the
    token that each is listed under.
    """
    labelled = saved(labelled, "labelled")
    count = labelled.count()
    share = max(support, least / count) if count else 1.0
    each = labelled.select("page_id", "url", "label", F.explode(tokens(F.col("url"))).alias("token"))
    frequent = (
        each.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("urls"),
            F.bit_xor(F.xxhash64("page_id", "url")).alias("sum_1"),
            F.bit_xor(F.xxhash64(F.lit(1), "url", "page_id")).alias("sum_2"),
        )
        .where(F.col("urls") >= share * count)
        .groupBy("urls", "sum_1", "sum_2")
        .agg(F.min("token").alias("token"))
        .select("token", "urls")
    )
    frequent = saved(frequent, "frequent")
    items = each.join(frequent, "token").select("page_id", "url", "token")
    baskets = (
        items.unionByName(labelled.select("page_id", "url", F.col("label").alias("token")))
        .groupBy("page_id", "url").agg(F.collect_set("token").alias("items"))
    )
    if not count:
        found = baskets.select(
            F.col("items").alias("antecedent"), F.col("items").alias("consequent"),
            F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"),
        )
    else:
        parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = FPGrowth(
            itemsCol="items", minSupport=min(share, 1.0), minConfidence=confidence, numPartitions=parts
        ).fit(baskets).associationRules
    sure = (
        found.where(F.col("consequent")[0].isin(*LABELS))
        .withColumn("antecedent", F.array_sort("antecedent"))
        .select(
            F.concat_ws(" ", "antecedent", F.lit("=>"), F.col("consequent")[0]).alias("rule_id"), "antecedent",
            F.substring(F.col("consequent")[0], 2, 5).alias("verdict"), "confidence", "support",
        )
    )
    sure = saved(sure, "mined")
    rarest = (
        sure.select("rule_id", F.explode("antecedent").alias("token")).join(frequent, "token")
        .groupBy("rule_id").agg(F.min(F.struct("urls", "token"))["token"].alias("rare"))
    )
    listed = saved(sure.join(rarest, "rule_id"), "listed")
    shorter = listed.select(
        "rare", "verdict", F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence")
    )
    needless = (
        listed.select("rule_id", "verdict", "antecedent", "confidence", F.explode("antecedent").alias("rare"))
        .join(shorter, ["rare", "verdict"])
        .where(
            (F.size("part") < F.size("antecedent")) & (F.col("part_confidence") >= F.col("confidence"))
            & (F.size(F.array_except("part", "antecedent")) == 0)
        )
        .select("rule_id")
    )
    index = saved(listed.join(needless, "rule_id", "left_anti"), "rule_index")
    return index.drop("rare"), index


def judge(pages: DataFrame, index: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule with its confidence where one decided."""
    host, path = host_and_path(F.col("url"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    read = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
        .withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("says", says)
    )
    free = read.where(F.col("rule").isNull() & F.col("url").isNotNull()).select("url").distinct()
    used = index.select(F.explode("antecedent").alias("token")).distinct()
    held = (
        free.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(used, "token")
        .groupBy("url").agg(F.collect_set("token").alias("held"))
    )
    fitting = (
        held.select("url", "held", F.explode("held").alias("rare")).join(index, "rare")
        .where(F.size(F.array_except("antecedent", "held")) == 0)
    )
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("antecedent"), "rule_id")
    best = fitting.groupBy("url").agg(F.min_by(F.struct("verdict", "rule_id", "confidence"), order).alias("best"))
    return read.join(best, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.col("best.verdict"), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("best.rule_id")).alias("mined_rule"),
        F.when(F.col("rule").isNull(), F.col("best.confidence")).alias("confidence"),
    )


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, index = mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge(pages, index)
