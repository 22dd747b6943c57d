"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Reputation. Labelled pages are trials: a page is good or bad. Outcomes are counted for each
host, registered domain and suffix, and shrunk from the top down through beta-binomial priors:
a suffix towards all pages, a domain towards its suffix, a host towards its domain. At each
level the prior's mean is the posterior mean of the level above, and its strength is estimated
from the spread of the children's rates around those means by the method of moments (within
``LEAST_STRENGTH`` and ``MOST_STRENGTH``). A host is allowed if the lower bound of its posterior,
mean minus ``DEVIATIONS`` standard deviations, reaches ``LEAST_GOOD``. A host without labelled
pages takes the posterior of its domain, a domain without any that of its suffix, and so on up
to all pages, with the prior's strength as its only evidence; with no labels at all the rate is
one half.

Rules. A rule (``net/``, ``example.net/en/``) names a host with all its subdomains and the start
of a path. The longest that fits decides: the one with the most host labels, then the longest
path.

Url. The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path what follows up to ``?``, ``#`` or the end. A null url or one without
``://`` has both empty; such pages share the empty host. The suffix is the host's last label,
or two where the second last is one of the ``SECOND_LEVEL`` labels and the last has two letters;
the registered domain has one label more.

Repeated rows are judged alike and count as trials of their own; other columns are ignored.
Host counts aggregate before they are shuffled, and pages meet their host's verdict by a join
whose hot keys adaptive execution splits.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import cut_lineage

LEAST_STRENGTH = 2.0
MOST_STRENGTH = 200.0
DEVIATIONS = 1.0
LEAST_GOOD = 0.6
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, the start of a path, and allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Host, empty for a null url or one without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path, empty for a null url or one without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Public suffix of a host."""
    labels = F.split(host, r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    long = second.isin(*SECOND_LEVEL) & (F.char_length(F.element_at(labels, -1)) == 2) & (F.size(labels) > 2)
    return F.when(F.coalesce(long, F.lit(False)), F.substring_index(host, ".", -2)).otherwise(
        F.substring_index(host, ".", -1)
    )


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: one label more than the suffix."""
    two = F.instr(suffix, ".") > 0
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name and verdict of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-r.host.count("."), -len(r.host), -len(r.path), r.name))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(children: DataFrame, mean: str) -> Column:
    """Prior strength by moments: children (n, k) around their parents' means.

    With prior mean m and strength s a rate of n trials varies by m(1-m)(1 + (n-1)/(s+1))/n. The
    sums of n(rate-m)^2 and of m(1-m) and m(1-m)(n-1) over the children solve for 1/(s+1).
    """
    m = F.col(mean)
    square = F.sum((F.col("k") - F.col("n") * m) * (F.col("k") - F.col("n") * m) / F.col("n"))
    base, more = F.sum(m * (1 - m)), F.sum(m * (1 - m) * (F.col("n") - 1))
    share = (square - base) / more
    held = F.least(F.greatest(share, F.lit(1 / (MOST_STRENGTH + 1))), F.lit(1 / (LEAST_STRENGTH + 1)))
    return F.coalesce(F.when(more > 0, 1 / held - 1), F.lit(MOST_STRENGTH))


def _under(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children with ``prior``, the posterior mean of their parent (key, mean)."""
    return children.join(parents.select(key, F.col("mean").alias("prior")), key)


def _shrunk(children: DataFrame) -> DataFrame:
    """children (n, k, prior) with ``mean`` (posterior mean), ``weight`` and the level's prior ``strength``."""
    known = cut_lineage(children)
    strength = known.agg(_strength(known, "prior")).first()[0]
    return (
        known.withColumn("strength", F.lit(strength))
        .withColumn("mean", (F.col("k") + strength * F.col("prior")) / (F.col("n") + strength))
        .withColumn("weight", F.col("n") + strength)
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and good (0 or 1) of every labelled page.

    The last number in a page's path names the document it shows; its label says whether that is
    good: of quality and not toxic. Null marks do not speak against a page; a document with
    several label rows takes the worst of each mark.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        ((F.coalesce(F.min("quality"), F.lit(1)) > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) <= 0)).cast("int").alias("good")
    )
    shown = pages.select(
        host_of(F.col("url")).alias("host"),
        F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"),
    ).filter(F.col("doc_id").isNotNull())
    return shown.join(marks, "doc_id").select("host", "good")


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, good_rate and good_bound of every distinct host of ``hosts`` (host), from ``outcomes`` (host, good)."""
    suffix = suffix_of(F.col("host"))
    named = hosts.select("host").distinct().withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    counted = cut_lineage(
        outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k")).join(
            named, "host", "right"
        ).na.fill(0, ["n", "k"])
    )
    seen = counted.filter(F.col("n") > 0)
    total = seen.agg(F.sum("k"), F.sum("n")).first()
    rate = (total[0] + 0.5) / (total[1] + 1) if total[1] else 0.5
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    by_suffix = _shrunk(seen.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(rate)))
    by_domain = _shrunk(_under(seen.groupBy("domain", "suffix").agg(*sums), by_suffix, "suffix"))
    by_host = _shrunk(_under(seen, by_domain, "domain"))
    best = (
        counted.select("host", "domain", "suffix")
        .join(by_host.select("host", F.struct("mean", "weight").alias("_host")), "host", "left")
        .join(by_domain.select("domain", F.struct("mean", F.col("strength").alias("weight")).alias("_domain")), "domain", "left")
        .join(by_suffix.select("suffix", F.struct("mean", F.col("strength").alias("weight")).alias("_suffix")), "suffix", "left")
        .withColumn(
            "best",
            F.coalesce("_host", "_domain", "_suffix", F.struct(F.lit(rate).alias("mean"), F.lit(LEAST_STRENGTH).alias("weight"))),
        )
    )
    mean, weight = F.col("best.mean"), F.col("best.weight")
    return best.select(
        "host",
        mean.alias("good_rate"),
        (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("good_bound"),
    )


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate and good_bound of every row of ``pages`` (page_id, url)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(parts, labelled_outcomes(pages, labels))
    judged = parts.join(known, "host", "left").withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("good_bound") >= LEAST_GOOD, "allow").otherwise("block")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.name").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        "good_rate",
        "good_bound",
    )
