"""URL filters by explicit rules and empirical-Bayes host reputation, in DataFrame functions.

Labelled page outcomes are counted by host. Each level of the host name (suffix, registered
domain, host) has a beta-binomial prior centred on the posterior mean of the level above (on
the whole table's share of bad pages at the top), whose strength is estimated from the data by
moments: the less the rates of a level's members differ beyond chance, the harder they are
drawn to their parent. A page without a rule is blocked when the lower posterior bound of its
host's share of bad pages exceeds the whole table's share, times a factor. Hosts without
outcomes stand at their parent's posterior mean.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Public suffixes of two labels; any other suffix is a host's last label.
SUFFIXES = "ac.jp ac.uk co.at co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx com.my com.sg com.tr com.tw com.ua com.vn edu.au gov.au gov.br gov.uk ne.jp net.au net.br or.jp or.kr org.au org.br org.nz org.uk org.za".split()
#: Two to one: the bound that a share exceeds with a probability of 2/3.
Z = 0.43


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; else empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    ``rules`` are (verdict, ``host/path``). A rule fits its host and all subdomains if the
    path starts with its own; of rules of one length the longer host wins, then the first
    by text.
    """
    split = [{"verdict": v, "rule": r, "host": r.partition("/")[0], "path": "/" + r.partition("/")[2]} for v, r in rules]
    split.sort(key=lambda r: (-len(r["rule"]), -len(r["host"]), r["rule"]))
    every = F.from_json(F.lit(json.dumps(split)), "array<struct<verdict: string, rule: string, host: string, path: string>>")  # a constant, whatever the number
    fits = F.filter(every, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.get(fits, F.lit(0))
    return best["rule"], best["verdict"]


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (one label before the suffix) and suffix of a host, without user and port.

    A suffix is one of ``suffixes`` or the last label. A numeric address is a domain of its
    own, and all of them share the empty suffix.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last = [F.substring_index(name, ".", -k) for k in (1, 2, 3)]
    address = name.rlike(r"^\d+([.]\d+){3}$|^\[")
    two = last[1].isin(*suffixes)
    return F.when(address, name).when(two, last[2]).otherwise(last[1]), F.when(address, "").when(two, last[1]).otherwise(last[0])


def _strength(n: str, bad: str, centre: str) -> Column:
    """Moment estimate of a beta prior's strength from members' counts and their prior means."""
    var = F.sum(F.expr(f"{n} * ({bad} / {n} - {centre}) * ({bad} / {n} - {centre})"))
    chance = F.sum(F.expr(f"{centre} * (1 - {centre})"))
    spread = F.sum(F.expr(f"({n} - 1) * {centre} * (1 - {centre})"))
    rho = F.when(spread > 0, F.least(F.lit(0.99), F.greatest(F.lit(0.01), (var - chance) / spread))).otherwise(0.5)
    return (1 - rho) / rho


def base_rate(counts: DataFrame) -> float:
    """The whole table's share of bad pages, half a page of each kind added; a half if there is no outcome."""
    n, bad = counts.agg(F.sum("n"), F.sum("bad")).first()
    return ((bad or 0) + 0.5) / ((n or 0) + 1.0)


def host_reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of the share of bad pages: ``host, n, bad, mean, lower`` from ``host, n, bad``.

    Hosts with n = 0 stand at their domain's mean, with the prior's spread. The table's share
    and the three estimated strengths, one number each, are all that comes to the driver.
    """
    domain, suffix = levels(F.col("host"))
    hosts = counts.select("host", F.col("n").cast("double").alias("n"), F.coalesce("bad", F.lit(0)).cast("double").alias("bad"), domain.alias("domain"), suffix.alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)

    def posterior(rows: DataFrame, k: float) -> DataFrame:
        return rows.withColumn("mean", (F.col("bad") + k * F.col("up")) / (F.col("n") + k))

    def strength(rows: DataFrame) -> float:
        return rows.where("n > 0").agg(_strength("n", "bad", "up")).first()[0]

    top = suffixes.withColumn("up", F.lit(base_rate(counts)))
    top = posterior(top, strength(top))
    mid = domains.join(top.select("suffix", F.col("mean").alias("up")), "suffix")
    mid = posterior(mid, strength(mid))
    low = hosts.join(mid.select("domain", "suffix", F.col("mean").alias("up")), ["domain", "suffix"])
    k = strength(low)
    low = posterior(low, k)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return low.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "mean", (F.col("mean") - z * deviation).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], lift: float = 1.0, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every page: ``id_col, host, path, rule, verdict, bad_mean, bad_lower``.

    ``outcomes`` (``id_col``, bad 0/1) label some pages; of several for a page the worst
    counts, null ids and outcomes count for nothing. The verdict is the rule's, else block
    if the lower bound of the host's share of bad pages exceeds ``lift`` times the table's,
    else allow. A null url or one without ``://`` has an empty host and path and is judged
    with the others of its kind; repeated rows are judged each for itself; other columns don't
    pass through; an empty table has no rows. The counts, a row a host, are written once; the
    join on hosts is an ordinary one, so that Spark can split a hot host.
    """
    rows = pages.select(id_col, F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(url_path(F.col(url_col)), F.lit("")).alias("path"))
    worst = outcomes.where("bad IS NOT NULL").groupBy(id_col).agg(F.max("bad").alias("bad"))
    counts = settle(rows.select(id_col, "host").join(worst, id_col, "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad")))
    known = host_reputation(counts, z).select("host", F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"))
    which, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, "host").withColumn("rule", which)
    method = F.when(F.col("bad_lower") > lift * base_rate(counts), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "bad_mean", "bad_lower")
