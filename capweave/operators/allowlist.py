"""URL allow-lists: rules as data, applied by an equi-join on host suffixes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.functions import urls, values
from capweave.schema import field, once

BROADCAST_RULES, SINGLE_RULES = 100_000, 32


@dataclass(frozen=True, order=True)
class Rule:
    host: str
    path: str = "/"
    match: str = "host"

    @classmethod
    def parse(cls, entry: str) -> Rule:
        """A URL, a bare host with an optional path, or *.domain."""
        full = entry if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", entry) else f"http://{entry}"
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?(?=[/?#]|$)([^?#]*)", full)
        if not m or re.search(r"[^!-~]|[\"<>\\^`{|}]", full):
            raise ValueError(f"invalid entry {entry!r}")
        host = m[1]
        mode = "domain" if host.startswith("*.") else "host"
        host = urls.literal_host(host.removeprefix("*."))
        if not host or "*" in host:
            raise ValueError(f"invalid entry {entry!r}")
        return cls(host, m[2] or "/", mode)

    def as_dict(self) -> dict:
        return {"host": self.host, "path": self.path} | ({} if self.match == "host" else {"match": self.match})


def parse_lines(lines, path: str = "-") -> list[Rule]:
    """Rules of a list's lines; blank lines and comments are skipped, a bad line is named."""
    out = []
    for n, line in enumerate(lines, 1):
        entry = line.strip()
        if entry and not entry.startswith("#"):
            try:
                out.append(Rule.parse(entry))
            except ValueError as error:
                raise ValueError(f"{path}:{n}: invalid only-url entry {entry!r}") from error
    return out


def read_rules(spark: SparkSession, *paths: str) -> list[Rule]:
    out = []
    for p in paths:
        rows = spark.read.text(p, wholetext=True).collect()  # a list of rules is read whole, on the driver
        for r in rows:
            out += parse_lines(r[0].splitlines(), p)
    return out


def canonical(rules) -> list[Rule]:
    return sorted(set(rules))


def signature(rules) -> dict:
    listed = [r.as_dict() for r in canonical(rules)]
    return {"count": len(listed), "sha256": values.digest_of(listed), "rules": listed}


def capture_host(df: DataFrame) -> Column:
    return F.coalesce(F.nullif(urls.url_host(field(df, "url")), F.lit("")), urls.key_host(field(df, "urlkey")))


def capture_path(df: DataFrame) -> Column:
    """Without query: the rules look at paths only."""
    from_url = F.when(F.nullif(urls.url_host(field(df, "url")), F.lit("")).isNotNull(), F.regexp_extract(urls.url_path_query(field(df, "url")), r"^([^?]*)", 1))
    return F.coalesce(from_url, urls.key_path(field(df, "urlkey")))


def allowed(df: DataFrame, rules) -> DataFrame:
    """The rows that a rule allows; no rules allow nothing.

    Host and path are computed once a row. A host's rules are those of itself and its suffixes, found by an equi-join of the distinct
    hosts' suffixes with the rules; the hosts that have any (no more than rules and hosts allow) then meet the rows in one join.
    """
    spark, rules = df.sparkSession, canonical(rules)
    if not rules:
        return df.limit(0)
    listed = spark.createDataFrame([(r.host, r.path, r.match == "domain") for r in rules], "_rule_host string, _rule_path string, _rule_domain boolean")
    by = listed.groupBy("_rule_host").agg(F.collect_list(F.struct("_rule_path", "_rule_domain")).alias("_rules"))
    keyed = once(df, _host=capture_host(df), _path=capture_path(df))
    if len(rules) <= SINGLE_RULES:  # so few that each row's host can be tried against them all
        own, path = F.col("_host"), F.col("_path")
        hits = [((own == r.host) | (F.lit(r.match == "domain") & own.endswith(f".{r.host}"))) & (F.lit(r.path == "/") | path.startswith(r.path)) for r in rules]
        return keyed.where(reduce(Column.__or__, hits)).drop("_host", "_path")
    hosts = once(keyed.select("_host").where("_host is not null").distinct(), _labels=F.split("_host", r"[.]", -1))
    n = F.size("_labels")
    suffixes = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("_labels", i, n), "."))).alias("_suffix"))
    met = suffixes.join(F.broadcast(by) if len(rules) <= BROADCAST_RULES else by, F.col("_suffix") == F.col("_rule_host"))
    paths = F.transform(F.filter("_rules", lambda r: r["_rule_domain"] | (F.col("_suffix") == F.col("_host"))), lambda r: r["_rule_path"])
    ruled = met.groupBy(F.col("_host").alias("_ruled")).agg(F.array_distinct(F.flatten(F.collect_list(paths))).alias("_paths")).where(F.size("_paths") > 0)
    fits = F.exists("_paths", lambda p: (p == "/") | F.col("_path").startswith(p))
    return keyed.join(ruled, F.col("_host") == F.col("_ruled")).where(fits).drop("_host", "_path", "_ruled", "_paths")
