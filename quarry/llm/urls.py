"""URL filters: rules are indexed by their rarest literal token, and only rules that a URL's tokens fetch are run.

Two kinds of rule share one index. A site rule (host, path) fits its host and all subdomains where the URL's
path starts with its own; the longest that fits decides. A pattern rule is a line of literal text with `^` (a separator
or an end) and `*` (anything), matched in the lower-cased URL; `||` before it binds it to the start of a host label, `@@`
before all that makes it an exception. Where no site rule fits, a URL is blocked if a blocking pattern fits and no
exception does, and allowed otherwise. The lines can come from any table or text file (`read_rules`); those here are made
from word lists and shapes.

A token is a run of [a-z0-9] in the lower-cased URL. A rule's tokens are those that any URL it fits must hold
whole; how common they are is counted over all URLs given. A rule without such a token is tried on all URLs.

Edge cases: a null URL, or one without `://`, has an empty host and path and is allowed; repeated URLs are
judged once and repeated rows kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
WORDS = {
    "play": ("casino", "bets", "poker", "lottery", "slots", "roulette", "blackjack", "jackpot", "sportsbook", "bingo"),
    "drugs": ("pills", "viagra", "cialis", "xanax", "tramadol", "steroids"),
    "adult": ("adult", "porn", "xxx", "escort", "camgirls", "hentai"),
    "fraud": ("payday", "replica", "warez", "keygen", "serialz", "nulled"),
}
SHAPES = {
    "play": ("^{}^", "^free-{}^", "^online-{}^", "^{}-bonus^", "||{}-*.", "^play*{}^"),
    "drugs": ("^{}^", "^cheap-{}^", "^buy-{}^", "^{}-online^", "^{}*without-prescription^", "@@^health^*^{}^", "@@^{}-side-effects^"),
    "adult": ("^{}^", "^free-{}^", "^{}-videos^", "^{}-*-gallery^", "||{}.", "@@^{}-education^"),
    "fraud": ("^{}^", "^best-{}^", "^{}-download^", "^get*{}^", "/{}/*.exe", "@@^{}-warning^"),
}
PATTERN_RULES = ["@@^responsible-gambling^", "@@^gambling-help^"] + [shape.format(word) for group, words in WORDS.items() for word in words for shape in SHAPES[group]]
RULES = "rule_id long, kind string, host string, path string, regex string, verdict string, size int, tokens array<string>"
BROADCAST_RULES, SALTS = 20_000, 64


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def site_tokens(host: str, path: str) -> list[str]:
    """Labels of the host, and of the path those that a separator ends."""
    return re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())


def pattern_rules(lines: DataFrame) -> DataFrame:
    """RULES without ids from lines (value): regex and tokens, those with a separator on both sides inside the pattern. Null and empty lines and comments (`!`) are none."""
    exception = F.startswith(F.col("value"), F.lit("@@"))
    body = F.lower(F.trim(F.when(exception, F.substr("value", F.lit(3))).otherwise(F.col("value"))))
    rows = lines.select(body.alias("p"), F.when(exception, "allow").otherwise("block").alias("verdict")).where("p <> '' and p not like '!%'")
    bound = F.startswith(F.col("p"), F.lit("||"))
    escaped = F.regexp_replace(F.when(bound, F.substr("p", F.lit(3))).otherwise(F.col("p")), r"([\\.+?()\[\]{}|$])", r"\\$1")
    parts = F.filter(F.split(F.replace(escaped, F.lit("^"), F.lit("(?:[^a-z0-9]|^|$)")), r"\*"), lambda x: x != "")
    # Each part is taken where it first occurs after the one before, for good: that leaves most room for the rest, and takes linear time in long urls.
    start = F.when(bound & ~F.startswith("p", F.lit("||*")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*?\.)??").when(bound, r"^[a-z][a-z0-9+.-]*://.*?").otherwise("^.*?")
    regex = F.concat(F.lit("(?s)"), F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("(?>"), F.when(i == 0, start).otherwise(".*?"), x, F.lit(")"))), ""))
    tokens = F.regexp_extract_all("p", F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))
    return rows.select(F.lit("pattern").alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), regex.alias("regex"), "verdict", F.char_length("p").alias("size"), tokens.alias("tokens"))


def read_rules(spark, path: str, sites=SITE_RULES) -> DataFrame:
    """Site rules and the pattern rules of a text file, one a line."""
    return rule_table(spark, sites, spark.read.text(path))


def rule_table(spark, sites=SITE_RULES, patterns: DataFrame | None = None) -> DataFrame:
    lines = patterns if patterns is not None else spark.createDataFrame([(p,) for p in PATTERN_RULES], "value string")
    of_sites = spark.createDataFrame([("site", h, p, None, v, len(h) + len(p), site_tokens(h, p)) for h, p, v in sites], RULES.removeprefix("rule_id long, "))
    all_rules = of_sites.unionByName(pattern_rules(lines))
    return all_rules.select(F.xxhash64("kind", "host", "path", "regex", "verdict").alias("rule_id"), "*").dropDuplicates(["rule_id"])


def index_rules(rules: DataFrame, urls: DataFrame, few: bool) -> DataFrame:
    """Add `token`, the rule's rarest over all urls (ties: the first by name); null if it has none. Tokens of few rules are broadcast, others dealt, after the urls' tokens are counted."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    found = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    if few:
        found = found.join(F.broadcast(wanted), "token", "left_semi")
    counts = found.groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(rarest, "rule_id", "left")


def judge_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict of each distinct url that some rule fits."""
    few = rules.count() <= BROADCAST_RULES
    indexed = index_rules(rules, urls, few)
    # Rules without a token are tried on all URLs: their key is dealt in salts, so no task gets all URLs.
    salted = indexed.withColumn("token", F.coalesce("token", F.lit(""))).withColumn("salt", F.explode(F.when(F.col("token") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    ready = F.broadcast(salted) if few else salted
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    tokens = urls.select("url", host.alias("u_host"), path.alias("u_path"), F.explode(F.array_union(url_tokens(F.col("url")), F.array(F.lit("")))).alias("url_token"))
    dealt = tokens.withColumn("url_salt", F.when(F.col("url_token") == "", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).otherwise(0))
    fetched = dealt.join(ready, (F.col("url_token") == F.col("token")) & (F.col("url_salt") == F.col("salt")))
    site = (F.col("kind") == "site") & ((F.col("u_host") == F.col("host")) | F.endswith("u_host", F.concat(F.lit("."), "host"))) & F.startswith("u_path", "path")
    pattern = (F.col("kind") == "pattern") & F.regexp_like(F.lower("url"), F.col("regex"))
    fits = fetched.where(F.when(F.col("kind") == "site", site).otherwise(pattern))
    best = F.max(F.when(F.col("kind") == "site", F.struct("size", F.concat("host", "path").alias("rule"), "verdict")))
    return fits.groupBy("url").agg(
        best.alias("site"),
        F.coalesce(F.bool_or((F.col("kind") == "pattern") & (F.col("verdict") == "block")), F.lit(False)).alias("p_block"),
        F.coalesce(F.bool_or((F.col("kind") == "pattern") & (F.col("verdict") == "allow")), F.lit(False)).alias("p_allow"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    rules = rules if rules is not None else rule_table(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    judged = judge_urls(rows.where("url is not null").select("url").distinct(), rules)
    verdict = F.coalesce(F.col("site.verdict"), F.when(F.col("p_block") & ~F.col("p_allow"), "block").otherwise("allow"))
    return rows.join(judged, "url", "left").select("page_id", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"), F.col("site.rule").alias("rule"), verdict.alias("verdict"))
