"""Operator 7, URL filters: rules indexed by their rarest literal token. DataFrame functions only.

A URL's tokens look up candidate rules in a literal map, and only the candidates' regular
expressions run, inside one projection: judging the URLs moves no rows between executors. The one
aggregate before it counts, over all URLs, those tokens that occur in rules (at most one row a
rule literal comes back), which tells each rule's rarest token.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and the
verdict "allow"; repeated pages are judged each for itself; an empty table gives an empty result;
columns of the input other than the key and the URL are not read and cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: A rule list up to this is a literal of the plan; a longer one is a table, joined to the URLs on the token.
MOST_RULES = 10_000


class HostRule(NamedTuple):
    """Fits host and its subdomains, if the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """A regular expression over the lower-cased URL, with the words it cannot match without."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    one_of: tuple[str, ...] = ()  # every match holds one of these, where it holds no fixed literal


#: The contract's rules.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

#: Used where no host rule fits. Literals are whole tokens (runs of a-z and 0-9) of any match.
PATTERN_RULES = (
    PatternRule("pill shop", "block", r"(^|[^a-z0-9])cheap[-_.]pills([^a-z0-9]|$)", ("cheap", "pills")),
    PatternRule("spam farm", "block", r"(^|[^a-z0-9])spam[-_.]farm([^a-z0-9]|$)", ("spam", "farm")),
    PatternRule("link farm", "block", r"(^|[^a-z0-9])link[-_.]farm([^a-z0-9]|$)", ("link", "farm")),
    PatternRule("online casino", "block", r"(^|[^a-z0-9])online[-_.]casino([^a-z0-9]|$)", ("online", "casino")),
    PatternRule("casino bonus", "block", r"(^|[^a-z0-9])casino[-_./]+(bonus|slots?|poker)([^a-z0-9]|$)", ("casino",)),
    PatternRule("free download", "block", r"(^|[^a-z0-9])free[-_./]+(crack|keygen|warez)([^a-z0-9]|$)", ("free",)),
    PatternRule("adult", "block", r"(^|[^a-z0-9])(www[.])?xxx[./]", ("xxx",)),
    PatternRule("payday loan", "block", r"(^|[^a-z0-9])payday[-_.]loans?([^a-z0-9]|$)", ("payday",)),
    PatternRule("session id", "block", r"[?&;](phpsessid|jsessionid)=", (), ("phpsessid", "jsessionid")),
    PatternRule("login page", "block", r"/(login|signin|logout)([./?#]|$)", (), ("login", "signin", "logout")),
    PatternRule("raw address", "block", r"^[a-z]+://[0-9]{1,3}([.][0-9]{1,3}){3}([:/?#]|$)", ()),
)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def token_counts(urls: DataFrame, url: str, wanted: Sequence[str]) -> dict[str, int]:
    """How many URLs hold each wanted token: one row a literal at most reaches the driver."""
    if not wanted:
        return {}
    hits = urls.select(F.explode(F.array_intersect(tokens_of(F.col(url)), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r.token: r["count"] for r in hits.groupBy("token").count().collect()}


def rarest_token_index(literals: dict[int, tuple[str, ...]], counts: dict[str, int], one_of: dict[int, tuple[str, ...]] | None = None) -> dict[str, list[int]]:
    """Rule numbers under the rarest literal of each (ties: the smaller token), or under each of its
    alternatives; "" keeps rules without either."""
    index: dict[str, list[int]] = {}
    for k, words in literals.items():
        for w in [min(words, key=lambda w: (counts.get(w, 0), w))] if words else (one_of or {}).get(k) or [""]:
            index.setdefault(w, []).append(k)
    return index


def filter_urls(
    urls: DataFrame,
    key: str = "page_id",
    url: str = "url",
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
) -> DataFrame:
    """key, host, path, rule, verdict, pattern (the pattern rule that decided, else null) of every row.

    The longest fitting host rule wins; without one, the first pattern rule in list order; without
    one, the URL is allowed.
    """
    ordered_hosts = sorted(host_rules, key=lambda r: (-len(r.label), r.label))
    rules: list[tuple[str, str, str, str, tuple[str, ...], tuple[str, ...]]] = []  # kind, name, verdict, pattern over "host path" or the url, tokens
    for r in ordered_hosts:
        words = tuple(w for w in re.split("[^a-z0-9]+", r.host) if w)  # path words may be cut short by the prefix rule
        rules.append(("host", r.label, r.verdict, rf"(?s)^([^\n]*\.)?{re.escape(r.host)}\n{re.escape(r.path)}.*$", words, ()))
    rules += [("pattern", p.name, p.verdict, p.pattern, p.literals, p.one_of) for p in pattern_rules]
    base = urls.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")})
    best = _by_table(base, rules) if len(rules) > MOST_RULES else _by_map(base, urls, url, rules)
    return best.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.when(F.col("_best.kind") == "host", F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("_best.kind") == "pattern", F.col("_best.name")).alias("pattern"),
    )


def _fits(rule: Column) -> Column:
    """Whether a candidate's regular expression fits the row."""
    place = F.concat("host", F.lit("\n"), "path")
    return F.when(rule["kind"] == "host", (F.col("host") != "") & F.rlike(place, rule["pattern"])).otherwise((F.col("host") != "") & F.rlike(lower_ascii(F.col("_url")), rule["pattern"]))


def _by_map(base: DataFrame, urls: DataFrame, url: str, rules: Sequence[tuple]) -> DataFrame:
    """base with _best, the first rule that fits: candidates come from a literal map of tokens."""
    counts = token_counts(urls, url, sorted({w for r in rules for w in r[4]}))
    index = rarest_token_index({k: r[4] for k, r in enumerate(rules)}, counts, {k: r[5] for k, r in enumerate(rules)})

    def entry(k: int) -> Column:
        kind, name, verdict, pattern, *_ = rules[k]
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern"))

    always = index.pop("", [])
    listed = F.create_map(*[x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, ks)))]) if index else None
    kind = "array<struct<k:int,kind:string,name:string,verdict:string,pattern:string>>"
    empty = F.array().cast(kind)
    fixed = F.array(*map(entry, always)).cast(kind) if always else empty
    known = F.array(*map(F.lit, sorted(index))) if index else F.array().cast("array<string>")
    hit = F.array_intersect(tokens_of(F.col("_url")), known)
    fetched = F.flatten(F.transform(hit, lambda t: F.coalesce(F.element_at(listed, t).cast(kind), empty))) if listed is not None else empty
    candidates = base.withColumn("_candidates", F.concat(fixed, fetched))
    # structs sort by k: host rules by length, then patterns
    return candidates.withColumn("_best", F.try_element_at(F.array_sort(F.filter("_candidates", _fits)), F.lit(1)))


def _by_table(base: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """The same for any number of rules: a table of rules joined on their rarest token, of which a URL's tokens
    fetch the rows; a URL and its tokens are exchanged, adaptive execution splits a hot token."""
    spark = base.sparkSession
    rows = [(k, kind, name, verdict, pattern, list(words), list(one_of)) for k, (kind, name, verdict, pattern, words, one_of) in enumerate(rules)]
    table = materialise(spark.createDataFrame(rows, "k int, kind string, name string, verdict string, pattern string, words array<string>, one_of array<string>"), "rules")
    numbered = materialise(base.withColumn("_rid", F.monotonically_increasing_id()), "urls")
    tokens = numbered.select("_rid", F.explode(F.array_distinct(tokens_of(F.col("_url")))).alias("token"))
    wanted = table.select("k", F.explode("words").alias("token"))
    held = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(held, "token", "left").groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    other = table.where(F.size("words") == 0).select("k", F.explode("one_of").alias("token"))
    under = rarest.select("k", "token").unionAll(other).join(table.select("k", "kind", "name", "verdict", "pattern"), "k")
    rule = F.struct("k", "kind", "name", "verdict", "pattern")
    fetched = tokens.join(under.select("token", rule.alias("rule")), "token").join(numbered.select("_rid", "_url", "host", "path"), "_rid")
    always = [k for k, r in enumerate(rules) if not r[4] and not r[5]]
    fits = fetched.where(_fits(F.col("rule"))).select("_rid", "rule")
    if always:  # rules without any token run on every URL
        run = table.where(F.col("k").isin(always)).agg(F.collect_list(rule).alias("r")).first().r
        kind = "struct<k:int,kind:string,name:string,verdict:string,pattern:string>"
        every = F.array(*(F.struct(*(F.lit(x[c]).alias(c) for c in ("k", "kind", "name", "verdict", "pattern"))).cast(kind) for x in run))
        fits = fits.unionAll(numbered.select("_rid", "_url", "host", "path", F.explode(every).alias("rule")).where(_fits(F.col("rule"))).select("_rid", "rule"))
    return numbered.join(fits.groupBy("_rid").agg(F.min("rule").alias("_best")), "_rid", "left")
