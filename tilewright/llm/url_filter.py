"""URL filter: rules by host and path, then a weighted vocabulary found by an Aho-Corasick automaton.

A few rules are compiled into one expression; a table of rules, of any length, is joined by the suffixes of the hosts. The
vocabulary may come from a table too, in any language; terms are lower case. It goes to the tasks whole, so it has a bound.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged by the
vocabulary over what text there is (null: no hit, so ``allow``). Of equal rules with different verdicts ``block`` counts; null
rules and terms are left out. Repeated urls are judged alike; further columns of the input, whatever their names, are carried
along unless they are named like an output column, which then replaces them. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: One of these rejects a url.
STRICT = ("adult", "bestiality", "camgirls", "hardcore", "hentai", "milf", "nsfw", "porn", "pornhub", "porno", "xvideos", "xxx")
#: These reject it from SOFT_MIN distinct ones on.
SOFT = (
    "ads", "babe", "babes", "bet", "bets", "betting", "casino", "cheap", "cialis", "dating", "erotic", "escort", "escorts", "free",
    "gambling", "girls", "hot", "jackpot", "loan", "loans", "lottery", "nude", "nudes", "payday", "pharmacy", "pills", "poker",
    "replica", "sex", "sexy", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "webcam", "win",
)
SOFT_MIN = 2
#: (verdict, host and path): a rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 1000  # that are compiled into one expression; more are joined
MAX_TERMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = frozenset(LOWER + "0123456789")


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):  # a term of both counts as strict
        for t in terms:
            a.add_word(t, (t, kind))
    a.make_automaton()
    return a


def hits(url: str, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a lower-cased url that stand between ends or characters other than a-z and 0-9."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (term, kind) in a.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in ALNUM) and (end + 1 == len(url) or url[end + 1] not in ALNUM):
            found[kind].add(term)
    return found["strict"], found["soft"]


def vocabulary_counts(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct<n_strict, n_soft>: distinct terms with boundaries, A-Z lower-cased; null: none."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict int, n_soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        a = automaton(strict, soft)
        fold = str.maketrans(UPPER, LOWER)
        out = []
        for u in urls:
            s, t = hits(u.translate(fold), a) if isinstance(u, str) and u else ((), ())
            out.append((len(s), len(t)))
        return pd.DataFrame(out, columns=["n_strict", "n_soft"])

    return count(url)


def host_of(url: Column) -> Column:
    return F.translate(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)).otherwise(""), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0] == "block")):  # the last when() is the outermost
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths that a rule of the table (verdict, rule) fits.

    Each host meets the rules of the domains above it only, held in one row for each domain of a rule.
    """
    at = F.substring_index("rule", "/", 1)
    table = rules.filter("rule is not null and verdict is not null").select(at.alias("domain"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"), "rule", "verdict")
    near = urls.select("host", "path").distinct().withColumn("domain", F.explode(suffixes(F.col("host")))).join(table, "domain")
    fits = near.filter(F.startswith("path", F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"))  # block comes after allow
    return best.select("host", "path", "b.rule", "b.verdict")


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) of a table (term, kind); more than MAX_TERMS raise ValueError."""
    rows = terms.filter("term is not null and term <> ''").select(F.lower("term").alias("term"), "kind").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    of = lambda k: tuple(sorted(r.term for r in rows if r.kind == k))
    return of("strict"), of("soft")


OUTPUTS = ("host", "path", "rule", "n_strict", "n_soft", "verdict")


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] | DataFrame = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_min: int = SOFT_MIN) -> DataFrame:
    """df with host, path, rule, n_strict, n_soft and verdict. One pass over the url column, without a shuffle if rules are compiled."""
    keep = [c for c in df.columns if c not in OUTPUTS]
    u = F.col(f"`{url}`")
    work = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), vocabulary_counts(u, strict, soft).alias("hits"))
    work = work.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = df.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    if isinstance(rules, DataFrame):
        found = joined_rules(df.select(F.coalesce(host_of(u), F.lit("")).alias("host"), F.coalesce(path_of(u), F.lit("")).alias("path")), rules)
        work = work.join(found.select("host", "path", F.struct("rule", "verdict").alias("fit")), ["host", "path"], "left")
    else:
        work = work.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= soft_min), "block").otherwise("allow")
    return work.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), F.col("hits.n_strict").alias("n_strict"), F.col("hits.n_soft").alias("n_soft"), F.coalesce("fit.verdict", own).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _sql() -> str:
    fold = f"translate(url, '{UPPER}', '{LOWER}')"
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r[1].partition("/") for r in sorted(RULES, key=lambda r: -len(r[1])))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)
    return f"""
    WITH a AS (SELECT page_id, coalesce({fold}, '') AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    b AS (SELECT page_id, u, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
    c AS (SELECT *, CASE {rules} END AS rule, ({" + ".join(map(hit, STRICT))})::INT AS n_strict, ({" + ".join(map(hit, SOFT))})::INT AS n_soft FROM b)
    SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN n_strict > 0 OR n_soft >= {SOFT_MIN} THEN 'block' ELSE 'allow' END END AS verdict,
      n_strict, n_soft FROM c"""


QUERIES = {"op9_url_filter": op9_url_filter}
SQL = {"op9_url_filter": _sql()}
