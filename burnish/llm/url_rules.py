"""URL filters: given host and path rules, and association rules mined from the urls that they decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import saved
from burnish.operators.skew import join_without_hot_tasks

BROADCAST_RULES = 20_000  # mined rules (some MB) that a task may hold whole; more are joined by a shuffle
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` for `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of `rule` and `verdict`; null if none does. Rules are found by host."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    entry = lambda r: F.struct(
        F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path")
    )
    index = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))])
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(index, e)), lambda x: x.isNotNull()))
    found = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(found, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """What a url is made of: host, each domain label, path segments by depth, names in the query. Digits are one."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(F.lower(F.regexp_replace(path, "[0-9]+", "0")), "/"), lambda x: x != "")
    query = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")))
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("host:"), host)),
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
    )
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(tokens))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Association rules `tokens` -> `verdict` from `tokens`, `verdict`: frequent, confident, and none that a rule of
    fewer of its tokens makes as well. `key` is the token of a rule that the fewest urls have.
    """
    spark = labelled.sparkSession
    items = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    schema = "rule_id long, tokens array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema + ", key string")
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("verdict=")))
    rules = rules.select(
        F.array_sort("antecedent").alias("tokens"),
        F.regexp_replace(F.col("consequent")[0], "^verdict=", "").alias("verdict"),
        "confidence",
        "support",
    )
    rules = saved(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")))
    # A rule's shorter ones: leave out one token after the other. What a part does as well, the whole needn't.
    parts = rules.where(F.size("tokens") > 1).select(
        "rule_id", "verdict", "confidence", F.explode("tokens").alias("out"), "tokens"
    )
    parts = parts.select("rule_id", "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    needless = parts.join(shorter, ["part", "verdict"]).where("of_part >= confidence").select("rule_id").distinct()
    kept = rules.join(needless, "rule_id", "left_anti")
    frequency = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keys = kept.select("rule_id", F.explode("tokens").alias("token")).join(frequency, "token")
    keys = keys.groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return saved(kept.join(keys, "rule_id"))


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, min_support: float = 0.01, min_confidence: float = 0.8
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `confidence` of every row of `pages` (`page_id`, `url`).

    The longest of `rules` that fits decides (`confidence` 1). Other urls go by the mined rules that they meet, the
    most confident first, then the best supported, then the one of the smallest tokens; without any, and for urls
    without host, the verdict is `allow` with confidence 0. Equal urls get equal verdicts; repeated ids keep their
    rows; an empty table gives no row; other columns are left aside.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = saved(rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    labelled = saved(rows.where("fit is not null").select(tokens, F.col("fit.verdict").alias("verdict")))
    mined = mine_rules(labelled, min_support, min_confidence)
    if mined.count() <= BROADCAST_RULES:
        mined = F.broadcast(mined)

    others = rows.where("fit is null and host <> ''").select("url", "host", "path").distinct().select("url", tokens)
    met = others.select("url", F.col("tokens").alias("has"), F.explode("tokens").alias("key")).join(mined, "key")
    met = met.where(F.size(F.array_except("tokens", "has")) == 0)
    order = F.struct("confidence", "support", (-F.size("tokens")).alias("short"), "rule_id")
    best = met.groupBy("url").agg(F.max_by(F.struct("verdict", "confidence"), order).alias("best"))
    # Only urls that no rule decides look for a mined one; a url of very many rows is dealt out.
    open_rows = rows.where("fit is null and host <> ''")
    decided = rows.where("not (fit is null and host <> '')").withColumn("best", F.lit(None).cast("struct<verdict:string,confidence:double>"))
    best = best.withColumnRenamed("url", "met_url")
    judged = join_without_hot_tasks(open_rows, best, "url", "met_url", "left", spread_by=["page_id"]).unionByName(decided)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("fit").isNotNull(), 1.0).otherwise(F.coalesce("best.confidence", F.lit(0.0))).alias("confidence"),
    )
