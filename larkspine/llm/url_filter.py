"""URL filtering by association rules, and by lists of host and path rules.

Spark's FP-growth mines combinations of URL tokens that occur with the label "block" in labelled pages.
A rule token set -> block is kept if its tokens occur with the label in ``MIN_COUNT`` pages, its confidence reaches
``MIN_CONFIDENCE``, and the confidence is significantly above the share of all labelled pages that are blocked: with n pages of
the token set, confidence c and overall share b, Chernoff's bound exp(-n KL(c || b)) on the chance of such a count must be
at most ``ALPHA`` over the number of token sets tested: all tokens, blocked or not, and the combinations mined.  Support is a count, so a host's rule does not vanish as the
table grows.  A rule goes if a rule over all but one of its tokens is as sure.  Labels that say nothing about URLs give no rules.

Of tokens that occur in the very same labelled pages one is mined for all, so long URLs do not multiply the itemsets; in
a rule each stands for the others.  Rules match by an inverted index: every rule is posted under its rarest tokens, a
page's tokens look their rules up, and the rule's other tokens are then looked for in the page's array.  All host labels,
path parts and query keys are tokens.  Itemsets and rules stay distributed; rules are broadcast if they are counted
to be at most ``MOST_BROADCAST``, else shuffled.

FP-growth itself holds the mined tokens on the driver and in every task, so a token is mined only if a rule could come of it.
Of k blocked pages the chance is base^k at least, however few others there are, so a token set with fewer blocked pages than
log(tokens / ``ALPHA``) / log(1 / base) passes under no confidence, nor does any set that it is part of.  This cut (``least_hits``)
is exact: no rule is lost by it.  It grows with the logarithm of the tokens, and most tokens of a large table are rare.

List rules (host, path) fit the host and its subdomains if the path starts with theirs; the longest rule wins
and goes before the mined verdict.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens, fits no rule and is allowed; null
labels are left out; without labels nothing is mined.  Rows repeated with the same page_id are judged row by row; of several
labels of a page "block" counts.  Of list rules of equal length the first in code-point order wins; of mined rules
the surest gives the confidence.  URLs of any length are tokenised whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspine.llm.shared import written

#: A rule blocks where block is the likelier label.
MIN_CONFIDENCE = 0.5
#: A rule's tokens occur with the label in so many pages at least.
MIN_COUNT = 5
#: Chance of any rule at all where the labels say nothing about URLs.
ALPHA = 0.01
LABEL = "=block"
#: Mined rules up to this number are broadcast to the pages; more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Pages of one token set are spread over so many groups.
SALTS = 16
_RULES = "tokens array<array<string>>, keys array<string>, confidence double, pages long"


@dataclass(frozen=True)
class ListRule:
    verdict: str
    host: str
    path: str

    @property
    def rule(self) -> str:
        return self.host + self.path


#: The list rules of the registered query.
LIST_RULES = (
    ListRule("block", "com", "/en/"),
    ListRule("allow", "example.com", "/en/7"),
    ListRule("allow", "net", "/de/"),
    ListRule("block", "example.net", "/de/8"),
    ListRule("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, all host suffixes, labels before the last two, path parts with digits as 0 (the
    first two with their place), depth, extension and query keys."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffix = lambda x, i: F.concat(F.lit("h"), (n - i).cast("string"), F.lit(":"), F.array_join(F.slice(labels, i + 1, n - i), "."))
    digits = F.regexp_replace(path, "[0-9]+", "0")
    parts = F.filter(F.split(digits, "/"), lambda p: p != "")
    place = lambda p, i: F.concat(F.when(i < 2, F.concat(F.lit("p"), (i + 1).cast("string"), F.lit(":"))).otherwise(F.lit("p:")), p)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("q:"), F.regexp_extract(p, r"(?s)^([^=]*)", 1)))
    tag = lambda name, value: F.when(value != "", F.concat(F.lit(name + ":"), value))
    some = F.array(
        tag("scheme", F.regexp_extract(url, "^([A-Za-z]+)://", 1)),
        tag("ext", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        tag("depth", F.when(host != "", F.size(parts).cast("string"))),
    )
    subs = F.transform(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("sub:"), x))
    return F.array_distinct(F.filter(F.concat(some, F.transform(labels, suffix), subs, F.transform(parts, place), keys), lambda x: x.isNotNull()))


def _surprise(n: Column, confidence: Column, base: Column) -> Column:
    """n KL(confidence || base) in nats: minus the logarithm of Chernoff's bound."""
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    return n * (part(confidence, base) + part(1 - confidence, 1 - base))


def least_hits(tokens: int, base: float, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> int:
    """Blocked pages that a token set needs to be significant at all, if ``tokens`` sets or more are tested."""
    return max(min_count, math.ceil(math.log(max(1, tokens) / alpha) / -math.log(base) - 1e-9))


def mine_rules(pages: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, alpha: float = ALPHA) -> DataFrame:
    """tokens, keys, confidence, pages from pages (page_id, url) and labels (page_id, block: boolean).

    ``tokens`` has an array of alternatives for each token of the rule, ``keys`` are the rarest of them, and ``pages`` is the
    number of labelled pages that hold the tokens.
    """
    spark = pages.sparkSession
    known = labels.where("page_id is not null and block is not null").groupBy("page_id").agg(F.max("block").alias("block"))
    seen = pages.select("page_id", F.xxhash64("page_id", "url").alias("h"), F.hash("page_id", "url").alias("g"), tokens_of(F.col("url").cast("string")).alias("tokens")).join(known, "page_id")
    seen = written(spark, seen.where(F.size("tokens") > 0).select("h", "g", "block", "tokens").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    n, blocked = seen.agg(F.count(F.lit(1)), F.count_if("block")).first()
    if not blocked or blocked == n:
        return spark.createDataFrame([], _RULES)
    # Tokens of the same pages by the pages' hashes, added up.
    single = seen.select("h", "g", "block", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("hits"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "hg"))
    alike = written(spark, single.where(F.col("n") >= min_count).groupBy("n", "h", "g").agg(F.min("token").alias("token"), F.min("hits").alias("hits"), F.array_sort(F.collect_list("token")).alias("members")).select("token", "members", "n", "hits"), "url-tokens")
    singles = alike.count()
    least = least_hits(singles, blocked / n, min_count, alpha)
    items = seen.select("row", "block", F.explode("tokens").alias("token")).join(alike.where(F.col("hits") >= least).select("token"), "token")
    baskets = items.groupBy("row").agg(F.first("block").alias("block"), F.collect_list("token").alias("items"))
    baskets = baskets.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items"))
    baskets = written(spark, baskets, "url-baskets")
    held = baskets.count()
    if not held:
        return spark.createDataFrame([], _RULES)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / held)).fit(baskets).freqItemsets
    sets = written(spark, sets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "url-itemsets")
    with_label = sets.where(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(F.array_remove("items", LABEL).alias("set"), F.col("freq").alias("hits"))
    tested = with_label.join(sets.select(F.col("items").alias("set"), F.col("freq").alias("pages")), "set")
    tested = tested.withColumn("confidence", F.col("hits") / F.col("pages"))
    together = sets.where(~F.array_contains("items", LABEL) & (F.size("items") > 1)).count()
    bar = math.log(max(1, singles + together) / alpha)
    base = F.lit(blocked / n)
    sure = tested.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > base) & (_surprise(F.col("pages"), F.col("confidence"), base) >= bar))
    sure = written(spark, sure, "url-sure")
    smaller = F.transform("set", lambda t: F.array_remove("set", t))
    lesser = sure.select("set", F.col("confidence").alias("own"), F.explode(smaller).alias("part"))
    as_sure = lesser.join(sure.select(F.col("set").alias("part"), F.col("confidence").alias("other")), "part").where("other >= own").select("set").distinct()
    kept = sure.join(as_sure, "set", "left_anti").withColumn("token", F.explode("set"))
    named = kept.join(alike.drop("hits"), "token").groupBy("set", "confidence", "pages").agg(F.array_sort(F.collect_list(F.struct("n", "members"))).alias("all"))
    rules = named.select(F.transform("all", lambda x: x["members"]).alias("tokens"), F.col("all")[0]["members"].alias("keys"), "confidence", "pages")
    return written(spark, rules, "url-rules")


def list_rule(host: Column, path: Column, rules: tuple[ListRule, ...] = LIST_RULES) -> Column:
    """struct<rule, verdict> of the longest list rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[ListRule, ...] = LIST_RULES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the surest mined rule that fits, else null) for every page."""
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    index = mined.select(F.explode("keys").alias("key"), F.col("tokens").alias("needs"), "confidence")
    if index.count() <= most_broadcast:
        index = F.broadcast(index)
    sets = base.select("tokens", "salt").distinct()
    hits = sets.withColumn("key", F.explode("tokens")).join(index, "key")
    fits = F.forall("needs", lambda some: F.arrays_overlap(some, F.col("tokens")))
    best = hits.where(fits).groupBy("tokens", "salt").agg(F.max("confidence").alias("confidence"))
    judged = base.join(best, ["tokens", "salt"], "left").withColumn("fit", list_rule(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
