"""URL filter: listed hosts and paths first, then weighted vocabulary hits."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import table
from plotgrid.llm.registry import query

# an url is refused when the weights of its distinct terms reach LIMIT: by one strict term, two strong soft ones or three mild ones
LIMIT = 6
STRONG, MILD = 3, 2
STRICT = (
    "adult", "bestiality", "blackjack", "bookmaker", "botnet", "camgirl", "camgirls", "casino", "cialis", "escort", "escorts",
    "hentai", "keygen", "keylogger", "malware", "milf", "nsfw", "payday-loan", "payday-loans", "phishing", "porn", "porno",
    "pornhub", "ransomware", "roulette", "spam", "sportsbook", "trojan", "viagra", "warez", "xxx",
)
SOFT = {
    **dict.fromkeys((
        "ads", "bet", "bets", "betting", "bonus", "cheap", "cheats", "click", "crack", "cracked", "diet-pills", "erotic", "farm",
        "free", "gamble", "jackpot", "loan", "loans", "lottery", "nude", "nudes", "pills", "poker", "popup", "promo", "serial-key",
        "slots", "torrent", "track", "win", "winner",
    ), STRONG),
    **dict.fromkeys((
        "affiliate", "banner", "buy", "cash", "coupon", "coupons", "credit", "dating", "deal", "deals", "discount", "download",
        "earn", "giveaway", "hot", "lucky", "mod", "money", "offer", "offers", "prize", "redirect", "sale", "singles", "tracker",
        "unlimited", "vip",
    ), MILD),
}
TABLE_TERMS = 100_000

# fixed values: rules as (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an url; both empty without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


class Judge:
    """Rules by host, and the automaton of the vocabulary."""

    def __init__(self, rules, weights: dict[str, int]):
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        if weights:
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule whose host is this one or above it and whose path begins this one."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for start, verdict in self.rules.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                    best = (suffix + start, verdict)
        return best

    def terms(self, url: str | None) -> tuple[list[str], int]:
        """Distinct terms that stand in the url between other characters than letters and
        digits, and their weight."""
        text, found = (url or "").translate(LOWER), {}
        if len(self.automaton):
            for end, (term, weight) in self.automaton.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in TERM_CHARS) and (end + 1 == len(text) or text[end + 1] not in TERM_CHARS):
                    found[term] = weight
        return sorted(found), sum(found.values())


def vocabulary(terms: DataFrame, most: int = TABLE_TERMS) -> tuple[list[str], dict[str, int]]:
    """(strict, soft) of a table ``term string, weight int``, as :func:`judge_urls` takes them; null ``weight``: strict.

    Terms are lower-cased; blank ones and weights below 1 are left out, and of a term's several weights strict goes first, then
    the highest. The automaton lies in every task's memory, so more than ``most`` distinct terms are an error and none is cut off.
    """
    whole = terms.filter("trim(term) <> '' AND coalesce(weight, 1) > 0").groupBy(F.lower(F.trim("term")).alias("term")).agg(
        F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight")
    )
    rows = whole.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    return sorted(r.term for r in rows if r.strict), {r.term: r.weight for r in sorted(rows) if not r.strict}


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, verdict and terms.

    The longest rule that fits decides; else the url is blocked when it holds one of the ``strict`` terms or the weights of
    its distinct ``soft`` terms (term: weight) come to ``limit``; a repeated term counts once, all other urls are allowed.
    A null url or one without ``://`` has
    an empty host and path, so no rule fits. Only the url is read; other columns pass
    through (columns of the new names are replaced), repeated rows get equal results, an
    empty table gives no rows. Rules and terms go to every task, so they are lists; :func:`vocabulary` takes them from a table.
    """
    weights = {**dict(soft), **dict.fromkeys(strict, limit)}

    @F.pandas_udf("host string, path string, rule string, verdict string, terms array<string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judges = Judge(rules, weights)
        for urls in batches:
            out = []
            for url in urls:
                host, path = host_and_path(url)
                rule, (terms, weight) = judges.rule(host, path), judges.terms(url)
                verdict = rule[1] if rule else ("block" if weight >= limit else "allow")
                out.append((host, path, rule[0] if rule else None, verdict, terms))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "terms"])

    added = ("host", "path", "rule", "verdict", "terms")
    judged = pages.select(F.struct("*").alias("row"), judge.asNondeterministic()("url").alias("j"))
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in added],
        *[F.col(f"j.{c}").alias(c) for c in added],
    )


def _check() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        (f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules
    ]
    rule = " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    weight = " + ".join(
        f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} ELSE 0 END"
        for t, w in {**SOFT, **dict.fromkeys(STRICT, LIMIT)}.items()
    )
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), {lower}) AS low,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), {lower}) AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {verdict} WHEN {weight} >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""


@query("op8_url_filter", _check())
def op8_url_filter(spark, sf_dir):
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, STRICT, SOFT, LIMIT)
    return judged.select("page_id", "host", "path", "rule", "verdict")
