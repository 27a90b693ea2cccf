"""URL filter by empirical-Bayes host reputation.

Registered domains and suffixes come from a public suffix list with its wildcards and exceptions, a parameter; the default
is the one in Spark's distribution. A page's outcome is bad or not, where it has a label. Outcomes are counted by host, registered domain and public
suffix. Each level is beta-binomial: its units' rates scatter around the posterior mean of the unit above (the corpus
above the suffixes) with a strength that is fitted to the level by moments, so a host with few labelled pages leans on
its domain, that on its suffix, that on all pages. A host is refused when the lower bound of its posterior bad rate is
over the limit, that is when the labels leave little doubt.

All of it is counts, joins and arithmetic in the JVM; what is joined to the pages is one row a host.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm.common import checkpoint, pick

#: Suffixes of two labels where no list is found; every other suffix is then the last label.
FEW_SUFFIXES = tuple(f"{a}.{b}" for b, firsts in {"uk": "co org ac gov ltd plc me net sch", "au": "com net org edu gov id", "nz": "co net org ac govt", "jp": "co ne or ac go ad", "br": "com net org gov edu", "za": "co org net gov ac", "in": "co net org ac gov firm gen", "kr": "co or ne ac go", "tr": "com org net edu gov", "cn": "com net org gov edu", "tw": "com org net edu gov", "mx": "com org net gob edu"}.items() for a in firsts.split())


def read_suffixes(lines: Iterable[str]) -> tuple[str, ...]:
    """Rules of a public suffix list in its usual form: a rule a line ("co.uk", "*.ck", "!www.ck"), // for comments. Rules
    of other scripts come in both forms that hosts have."""
    rules = dict.fromkeys(w[0].lower() for x in lines if (w := x.split()) and not w[0].startswith("//"))
    for r in list(rules):
        if not r.isascii():
            try:
                mark = r[: len(r) - len(r.lstrip("!*."))]
                rules.setdefault(mark + r[len(mark) :].encode("idna").decode())
            except UnicodeError:
                continue
    return tuple(rules)


def _own_suffixes() -> tuple[str, ...]:
    """The public suffix list that Spark's distribution brings along in its HTTP client."""
    for jar in sorted(Path(pyspark.__file__).parent.glob("jars/httpclient-4*.jar")):
        with zipfile.ZipFile(jar) as z:
            return read_suffixes(z.read("mozilla/public-suffix-list.txt").decode().splitlines())
    return FEW_SUFFIXES


SUFFIXES = _own_suffixes()
LIMIT = 0.3
Z = 1.645
#: Intra-unit correlation where a level's labels can't tell it, and its range.
RHO, RHO_LOW, RHO_HIGH = 0.1, 0.0001, 0.99
#: Hosts whose table is broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_HOSTS = 500_000


#: Host of a URL: http(s) or no scheme, user and password, then an address in brackets or a name.
_HOST = r"^\s*(?:https?:)?//(?:[^/?#@]*@)?(\[[^\]/?#\s]+\]|[^/?#@:\s\[]+)"
#: Addresses, which have no domain above them.
_NUMERIC = r"^[0-9.]+$|^\["


def host_of(url: Column | str) -> Column:
    """The host of an http(s) or scheme-relative URL in lower case, without user, port and a dot at its end; null where
    there is none."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), r"\.+$", "")
    return F.when(found != "", found)


def _rules(suffixes: tuple[str, ...]) -> tuple[list[str], list[str], list[str]]:
    """(plain rules, those behind "*.", exceptions)."""
    return [r for r in suffixes if r[0] not in "*!"], [r[2:] for r in suffixes if r.startswith("*.")], [r[1:] for r in suffixes if r[0] == "!"]


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix by the rules: the longest that holds, less its first label for an exception, else the last label;
    an address is its own."""
    plain, wild, exceptions = _rules(suffixes)
    last = lambda k: F.substring_index(host, ".", -k)
    out = F.when(host.rlike(_NUMERIC), host)
    for k in sorted({r.count(".") + 1 for r in exceptions}, reverse=True):
        out = out.when(last(k).isin(*[r for r in exceptions if r.count(".") + 1 == k]), last(k - 1))
    for k in range(max((r.count(".") + 1 + (r in wild) for r in (*plain, *wild)), default=1), 1, -1):
        exact, above = [r for r in plain if r.count(".") + 1 == k], [r for r in wild if r.count(".") + 2 == k]
        if exact:
            out = out.when(last(k).isin(*exact), last(k))
        if above:
            out = out.when(last(k - 1).isin(*above), last(k))
    return out.otherwise(last(1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the public suffix and the label before it, as far as the host has one."""
    return F.when(host == suffix, host).otherwise(F.concat_ws(".", F.substring_index(F.left(host, F.length(host) - F.length(suffix) - 1), ".", -1), suffix))


def _posterior(units: DataFrame, parent: str) -> DataFrame:
    """units (.., n, bad) with the mean of the unit above in `parent` -> mean and strength of each unit's posterior as p and
    weight. Two sums over the units come to the driver."""
    m, n, rate = F.col(parent), F.col("n"), F.col("bad") / F.col("n")
    # E[n (rate - m)^2] = m (1 - m) (1 + (n - 1) rho)
    excess = F.sum(F.when(n > 0, n * (rate - m) * (rate - m) - m * (1 - m)))
    room = F.sum(F.when(n > 0, m * (1 - m) * (n - 1)))
    excess, room = units.agg(excess, room).first()
    rho = max(RHO_LOW, min(RHO_HIGH, excess / room)) if room and room > 0 else RHO
    strength = (1 - rho) / rho
    return units.withColumn("weight", n + strength).withColumn("p", (F.col("bad") + m * strength) / F.col("weight"))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_HOSTS else df


def reputations(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, bad, p, weight), a row a host of pages; host null stands for pages without a host.

    A page is bad if its label says low quality (0) or toxic (1); labels that are null in both say nothing, of repeated
    labels the worst counts, and a repeated page counts once."""
    lab = pick(labels, i=label_id, q=quality_col, t=toxic_col).where("i is not null and (q is not null or t is not null)")
    bad = (F.coalesce(F.col("q") == 0, F.lit(False)) | F.coalesce(F.col("t") == 1, F.lit(False))).cast("int")
    lab = lab.groupBy("i").agg(F.max(bad).alias("y"))
    p = pick(pages, i=id_col, u=url_col).select("i", host_of("u").alias("host")).distinct()
    hosts = p.join(lab, "i", "left").groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad"))
    h = F.col("host")
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = checkpoint(hosts.select("host", domain_of(F.col("host"), F.col("suffix")).alias("domain"), "suffix", "n", "bad"))
    named = hosts.where("host is not null")
    n, bad = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("bad")).first())
    top, weight = (bad + 1) / (n + 2), float(n + 2)
    count = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = checkpoint(named.groupBy("suffix").agg(*count).withColumn("above", F.lit(top)))
    by_suffix = _small(_posterior(by_suffix, "above").select("suffix", F.col("p").alias("above")))
    by_domain = checkpoint(named.groupBy("suffix", "domain").agg(*count).join(by_suffix, "suffix"))
    by_domain = _small(_posterior(by_domain, "above").select("suffix", "domain", F.col("p").alias("above")))
    known = _posterior(checkpoint(named.join(by_domain, ["suffix", "domain"])), "above").select("host", "domain", "suffix", "n", "bad", "p", "weight")
    none = hosts.where("host is null").select("host", "domain", "suffix", "n", "bad", F.lit(top).alias("p"), F.lit(weight).alias("weight"))
    return known.unionByName(none)


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, z: float = Z, **columns) -> DataFrame:
    """(id, host, domain, suffix, n_labelled, n_bad, p_bad, bound, keep) of every row of pages.

    p_bad is the host's posterior bad rate, bound its lower bound: the mean less z standard deviations, 0 at least, both
    rounded to 6 decimals. keep: bound is at most limit. A null URL or one without a host: host, domain and suffix null,
    the rate of all pages. Repeated rows repeat their result, a null id stays null, an empty table gives an empty
    result. Without any labels each host has the uniform prior's mean of one half; its bound is still wide enough to
    keep it."""
    reps = checkpoint(reputations(pages, labels, id_col, url_col, **columns))
    p, w = F.col("p"), F.col("weight")
    bound = F.round(F.greatest(F.lit(0.0), p - z * F.sqrt(p * (1 - p) / (w + 1))), 6)
    reps = reps.select(F.col("host").alias("h"), "domain", "suffix", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.round(p, 6).alias("p_bad"), bound.alias("bound"))
    d = pick(pages, i=id_col, u=url_col).select("i", host_of("u").alias("host"))
    out = d.join(_small(reps), F.col("host").eqNullSafe(F.col("h")))
    return out.select(F.col("i").alias(id_col), "host", "domain", "suffix", "n_labelled", "n_bad", "p_bad", "bound", (F.col("bound") <= limit).alias("keep"))


def _sql_level(name: str, source: str, keys: str, parent: str) -> str:
    return f"""
{name}_fit AS (SELECT CASE WHEN sum(CASE WHEN n > 0 THEN {parent} * (1 - {parent}) * (n - 1) END) > 0
    THEN greatest({RHO_LOW}, least({RHO_HIGH}, sum(CASE WHEN n > 0 THEN n * (bad * 1.0::DOUBLE / n - {parent}) * (bad * 1.0::DOUBLE / n - {parent}) - {parent} * (1 - {parent}) END)
      / sum(CASE WHEN n > 0 THEN {parent} * (1 - {parent}) * (n - 1) END)))
    ELSE {RHO} END::DOUBLE AS rho FROM {source}),
{name} AS (SELECT {keys}, n, bad, n + (1 - rho) / rho AS weight, (bad + {parent} * ((1 - rho) / rho)) / (n + (1 - rho) / rho) AS p FROM {source}, {name}_fit)"""


SQL = rf"""
WITH lab AS (SELECT doc_id AS i, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS y FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
pg AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '{_HOST}', 1), '\.+$', ''), '') AS host FROM pages),
cut AS (SELECT host, string_split(host, '.') AS parts, count(y) AS n, coalesce(sum(y), 0)::BIGINT AS bad
  FROM (SELECT DISTINCT page_id, host FROM pg) d LEFT JOIN lab ON lab.i = d.page_id GROUP BY host),
{", ".join(f"{name}_rule AS (SELECT unnest(string_split('{' '.join(rules)}', ' ')) AS r)" for name, rules in zip(("plain", "wild", "except"), _rules(SUFFIXES), strict=True))},
ends AS (SELECT host, k, array_to_string(parts[-k:], '.') AS this, CASE WHEN k > 1 THEN array_to_string(parts[-(k - 1):], '.') END AS above
  FROM cut, (SELECT unnest(range(1, 8)) AS k) ks WHERE k <= len(parts) AND NOT regexp_matches(host, '{_NUMERIC}')),
labels_of AS (SELECT host, coalesce(max(CASE WHEN this IN (SELECT r FROM except_rule) THEN k - 1 END),
  max(CASE WHEN this IN (SELECT r FROM plain_rule) OR above IN (SELECT r FROM wild_rule) THEN k END), 1) AS k FROM ends GROUP BY host),
hosts AS (SELECT cut.host, n, bad, CASE WHEN k IS NULL THEN cut.host ELSE array_to_string(parts[-(k + 1):], '.') END AS domain,
  CASE WHEN k IS NULL THEN cut.host ELSE array_to_string(parts[-k:], '.') END AS suffix FROM cut LEFT JOIN labels_of l ON l.host = cut.host),
top AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) AS m0, coalesce(sum(n), 0) + 2 AS w0 FROM hosts),
s_in AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m0 FROM hosts, top WHERE host IS NOT NULL GROUP BY suffix),
{_sql_level("s", "s_in", "suffix", "m0")},
d_in AS (SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.p) AS ps FROM hosts h JOIN s ON s.suffix = h.suffix WHERE h.host IS NOT NULL GROUP BY h.suffix, h.domain),
{_sql_level("d", "d_in", "suffix, domain", "ps")},
h_in AS (SELECT h.host, h.domain, h.suffix, h.n, h.bad, d.p AS pd FROM hosts h JOIN d ON d.suffix = h.suffix AND d.domain = h.domain WHERE h.host IS NOT NULL),
{_sql_level("h", "h_in", "host, domain, suffix", "pd")},
reps AS (SELECT host, domain, suffix, n, bad, p, weight FROM h
  UNION ALL SELECT host, NULL, NULL, n, bad, m0, w0 FROM hosts, top WHERE host IS NULL),
rated AS (SELECT *, round(greatest(0.0, p - {Z} * sqrt(p * (1 - p) / (weight + 1))), 6) AS low FROM reps)
SELECT pg.page_id, pg.host, domain, suffix, n::BIGINT AS n_labelled, bad::BIGINT AS n_bad, round(p, 6) AS p_bad, low AS bound, low <= {LIMIT} AS keep
FROM pg JOIN rated ON pg.host IS NOT DISTINCT FROM rated.host
"""
