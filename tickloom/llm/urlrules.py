"""URL filtering: a host-and-path list first, then pattern rules fetched through their rarest literal token.

A pattern rule names the literal tokens (runs of a-z and 0-9 in the lower-cased URL) that every match holds. Tokens are
counted over all URLs; each rule is filed under the one of its tokens that fewest URLs hold (ties: the smaller token). A
URL's tokens fetch its candidate rules by a join, and only those run their regular expressions. Pattern rules are rows of a table,
so their number changes the data of the plan and not its size; the table is broadcast up to ``FEW_RULES`` rows and shuffled beyond.
Only the few URLs that a pattern matches are grouped and joined back, by the URL.

Verdict: the longest fitting list rule decides; else a matching ``allow`` pattern allows, else a matching ``block``
pattern blocks, else the URL is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no list rule, and is judged by the
patterns like any other (a null URL matches none, so it is allowed); repeated rows each give a row; very long URLs are judged whole; an
empty table gives no rows; only page_id and url are read, so other columns can't clash. The list rules are literals of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, only

FEW_RULES = 200_000


@dataclass(frozen=True)
class ListRule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    action: str
    tokens: tuple[str, ...]
    pattern: str


#: The contract's list.
LIST = (
    ListRule("allow", "org", "/"),
    ListRule("block", "example.org", "/es/"),
    ListRule("block", "example.org", "/en/1"),
    ListRule("allow", "com", "/fr/"),
    ListRule("block", "com", "/de/"),
)

#: Pages that are poor training text by their address; patterns run on the lower-cased URL.
PATTERNS = (
    PatternRule("paged-referral", "block", ("page", "ref"), r"[?&]page=[0-9]+&(?:[^#]*&)?ref="),
    PatternRule("campaign", "block", ("utm", "source"), r"[?&]utm_source="),
    PatternRule("click-id", "block", ("fbclid",), r"[?&]fbclid="),
    PatternRule("session", "block", ("sessionid",), r"[?&;]sessionid=[0-9a-z]+"),
    PatternRule("print-view", "block", ("print",), r"[/?&]print(?:=1|/|$)"),
    PatternRule("login", "block", ("login",), r"/login(?:[/?#.]|$)"),
    PatternRule("cart", "block", ("cart", "add"), r"/cart/add(?:[/?#]|$)"),
    PatternRule("tag-page", "block", ("tag", "page"), r"/tag/[^/]+/page/[0-9]+"),
    PatternRule("feed", "block", ("feed",), r"/feed/?(?:[?#]|$)"),
    PatternRule("deep-number-html", "block", ("blog",), r"^https?://blog\.[^/?#]+/[a-z]{2}/[0-9]{3,}\.html"),
    PatternRule("mobile-top", "allow", ("m", "top"), r"^https?://m\.[^?#]*#top$"),
    PatternRule("first-page", "allow", ("page", "1"), r"[?&]page=1(?:&|#|$)"),
)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: what follows the first ``://``; both empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules: tuple[ListRule, ...]) -> tuple[Column, Column]:
    """Text and action of the longest rule whose host is this one or a parent of it and whose path begins this one."""
    fits, acts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a later, longer one overrides
        fit = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fits, acts = F.when(fit, F.lit(rule.text)).otherwise(fits), F.when(fit, F.lit(rule.action)).otherwise(acts)
    return fits, acts


def url_tokens(url: Column) -> Column:
    """Distinct literal tokens of a URL; none for a null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit(r"([a-z0-9]+)"), F.lit(1))), F.array().cast("array<string>"))


def rule_table(spark: SparkSession, patterns: Sequence[PatternRule]) -> DataFrame:
    """number, name, action, pattern, tokens of the pattern rules."""
    rows = [(i, rule.name, rule.action, rule.pattern, list(rule.tokens)) for i, rule in enumerate(patterns)]
    return spark.createDataFrame(rows, "number int, name string, action string, pattern string, tokens array<string>")


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with the token that each is filed under, from (token) rows of all URLs: the one that fewest URLs hold."""
    named = rules.select("number", F.explode("tokens").alias("token"))
    counts = urls.join(named.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = named.join(counts, "token", "left").groupBy("number").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return rules.drop("tokens").join(rarest, "number")


def matches(pages: DataFrame, patterns: Sequence[PatternRule]) -> DataFrame:
    """url, the names of the pattern rules that it matches in their order, and whether any allows."""
    rules = rule_table(pages.sparkSession, patterns)
    urls = pages.where(F.col("url").isNotNull()).select("url").distinct()
    tokens = pages.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    index = filed(tokens, rules)
    index = F.broadcast(index) if len(patterns) <= FEW_RULES else index
    candidates = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    met = candidates.where(F.rlike(ascii_lower("url"), F.col("pattern")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "name"))), lambda rule: rule["name"])
    return met.groupBy("url").agg(listed.alias("patterns"), F.bool_or(F.col("action") == "allow").alias("allows"))


def judged(pages: DataFrame, rules: tuple[ListRule, ...] = LIST, patterns: Sequence[PatternRule] = PATTERNS) -> DataFrame:
    """page_id, url, host, path, rule, the names of the matching patterns, verdict."""
    pages = only(pages, "page_id", "url")
    host, path = parsed(F.col("url"))
    fits, acts = list_rule(host, path, rules)
    found = pages.join(matches(pages, patterns), "url", "left") if patterns else pages.withColumns({"patterns": F.array().cast("array<string>"), "allows": F.lit(None).cast("boolean")})
    return found.select(
        "page_id", "url",
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), fits.alias("rule"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"),
        F.coalesce(acts, F.when(F.col("allows"), "allow").when(~F.col("allows"), "block"), F.lit("allow")).alias("verdict"),
    )


def op10_query(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_sql() -> str:
    """The same by trying every rule on every URL."""
    rest = "case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ranked = sorted(LIST, key=lambda r: (-len(r.text), r.text))
    fit = {r: f"((host = '{r.host}' or suffix(host, '.{r.host}')) and starts_with(path, '{r.path}'))" for r in ranked}
    pick = lambda of: "case " + " ".join(f"when {fit[r]} then '{getattr(r, of)}'" for r in ranked) + " end"
    any_of = lambda action: " or ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERNS if r.action == action)
    return f"""
with p as (select page_id, url, {lower.format("url")} as low, {rest} as rest from pages),
h as (select page_id, low, coalesce({lower.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
r as (select *, {pick("text")} as rule, {pick("action")} as act from h)
select page_id, host, path, rule,
  coalesce(act, case when {any_of("allow")} then 'allow' when {any_of("block")} then 'block' else 'allow' end) as verdict from r
"""
