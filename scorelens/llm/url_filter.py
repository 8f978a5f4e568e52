"""URL filters: site rules by longest match, then pattern rules found by their rarest token.

* Site rules are ``host/path`` prefixes with a verdict.  A rule fits its host and all
  subdomains if the url's path starts with the rule's; the longest rule wins.  Only the
  suffixes of a url's host are looked up, never the whole list.
* Pattern rules are regular expressions with the literal tokens that any match must hold
  whole.  Each is indexed under the token that is rarest in the urls at hand (counted over
  all of them).  A url's tokens fetch the candidate rules, and only those run their
  expression; of the rules that match, the first in the list decides, and without one the
  url is allowed.

Rule lists are configuration, not data: at most ``MAX_RULES`` (checked), and the token
counts that reach the driver are those of the rules' own tokens.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there
up to ``? #`` or the end.  A null url or one without ``://`` has both empty, fits no rule and
is allowed.  Repeated rows each give a row; an empty table gives none; other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

MAX_RULES = 200_000
ALLOW, BLOCK = "allow", "block"
ADDED = ("host", "path", "rule", "verdict", "pattern")
TOKEN = re.compile(r"[a-z]+|[0-9]+")


@dataclass(frozen=True)
class PatternRule:
    """``tokens``: whole runs of a-z or of 0-9 of the lower-cased url in any match.  A rule
    with a choice of words is one rule for each, all of one name."""
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = BLOCK


# Site rules of the contract (fixed values).
SITE_RULES = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)

# Production pattern rules: junk hosts by name, advertising and tracking paths, traps.
PATTERN_RULES = (
    PatternRule("wellknown", r"^[a-z]+://[^/?#]+/\.well-known/", ("well", "known"), ALLOW),
    PatternRule("spam-farm", r"^[a-z]+://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("cheap-pills", r"^[a-z]+://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule("free-bets", r"^[a-z]+://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    PatternRule("ads-track", r"^[a-z]+://([^/?#]*\.)?ads-track\.", ("ads", "track")),
    PatternRule("casino", r"^[a-z]+://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule("porn", r"^[a-z]+://[^/?#]*\bporn\b", ("porn",)),
    *[PatternRule("ad-server", rf"^[a-z]+://{w}[0-9]*\.[^/?#]+/", (w,)) for w in ("ad", "ads", "adserver")],
    *[PatternRule("banner", rf"/{w}/[^?#]*\.(gif|jpe?g|png|swf)([?#]|$)", (w,)) for w in ("banner", "banners")],
    PatternRule("doubleclick", r"^[a-z]+://([^/?#]*\.)?doubleclick\.net/", ("doubleclick", "net")),
    *[PatternRule("login", rf"/{w}\.(php|aspx?|jsp)([?#]|$)", (w,)) for w in ("login", "signin")],
    PatternRule("cgi", r"/cgi-bin/", ("cgi", "bin")),
    PatternRule("wp-admin", r"/wp-admin/", ("wp", "admin")),
    *[PatternRule("calendar-trap", rf"[?&]{w}=[0-9]+&(month|day)=[0-9]+", (w,)) for w in ("year", "month")],
)


def read_rules(table: DataFrame) -> tuple[PatternRule, ...]:
    """Pattern rules from a table ``(position, name, pattern, tokens array<string>, verdict)``, in
    the order of ``position``.  More than ``MAX_RULES`` rows, an expression that does not compile,
    a verdict other than allow or block, or tokens that are none or not whole runs are errors."""
    rows = table.select("position", "name", "pattern", "tokens", "verdict").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in sorted(rows, key=lambda r: (r["position"], r["name"])):
        tokens = tuple(r["tokens"] or ())
        if not tokens or not all(TOKEN.fullmatch(t or "") for t in tokens) or r["verdict"] not in (ALLOW, BLOCK):
            raise ValueError(f"rule {r['name']!r}: no tokens, a token that is no run of a-z or 0-9, or an unknown verdict")
        try:
            re.compile(r["pattern"])
        except (re.error, TypeError) as e:
            raise ValueError(f"rule {r['name']!r}: {e}") from e
        out.append(PatternRule(r["name"], r["pattern"], tokens, r["verdict"]))
    return tuple(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as in the module's text."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    m = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if m is None else (rest[:m.start()], rest[m.start():])
    host = host.translate(_LOWER)
    return host, re.split(r"[?#]", tail, maxsplit=1)[0]


_LOWER = {c: c + 32 for c in range(65, 91)}


def site_index(rules) -> dict[str, list[tuple[str, str, str]]]:
    """Rule host -> its ``(path, rule, verdict)``, longest rule first."""
    out: dict[str, list] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    for found in out.values():
        found.sort(key=lambda x: -len(x[1]))
    return out


def site_rule(host: str, path: str, index) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict."""
    best = None
    at = 0
    while host:
        for rule_path, rule, verdict in index.get(host[at:], ()):
            if path.startswith(rule_path):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break  # the next ones of this host are shorter
        nxt = host.find(".", at)
        if nxt < 0:
            break
        at = nxt + 1
    return best


def token_counts(urls: DataFrame, col: str, wanted: list[str]) -> dict[str, int]:
    """In how many rows each wanted token occurs; summed per task before the shuffle."""
    if not wanted:
        return {}
    known = frozenset(wanted)

    def run(batches):
        import pyarrow as pa
        n = Counter()
        for b in batches:
            for u in b["u"].to_pylist():
                if u is not None:
                    n.update(known.intersection(TOKEN.findall(u.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())],
                                         names=["token", "n"])

    rows = (urls.select(F.col(col).cast("string").alias("u")).mapInArrow(run, "token string, n bigint")
            .groupBy("token").agg(F.sum("n").alias("n")).collect())  # at most one row per wanted token
    return {r["token"]: r["n"] for r in rows}


def pattern_index(rules, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> numbers of the rules kept under it; the rules without a literal token run
    for every url."""
    by, always = {}, []
    for i, r in enumerate(rules):
        if r.tokens:
            by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return by, always


def filter_urls(pages: DataFrame, url_col: str = "url", site_rules=SITE_RULES,
                pattern_rules=PATTERN_RULES, default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, pattern`` (the pattern rule that decided,
    null if none did; not looked for when a site rule fits)."""
    if len(site_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = prepare(pages.sparkSession)
    wanted = sorted({t for r in pattern_rules for t in r.tokens})
    by, always = pattern_index(pattern_rules, token_counts(pages, url_col, wanted))
    shared = spark.sparkContext.broadcast((site_index(site_rules), tuple(pattern_rules), by, always))

    def run(batches):
        import pyarrow as pa
        sites, rules, by, always = shared.value
        compiled: dict[int, re.Pattern] = {}

        def judge(url):
            host, path = split_url(url)
            site = site_rule(host, path, sites)
            if site:
                return host, path, *site, None
            if url is not None:
                low = url.lower()
                candidates = set(always)
                for t in set(TOKEN.findall(low)):
                    candidates.update(by.get(t, ()))
                for i in sorted(candidates):
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i].pattern)
                    if compiled[i].search(low):
                        return host, path, None, rules[i].verdict, rules[i].name
            return host, path, None, default, None

        for b in batches:
            made = list(zip(*map(judge, b["_url"].to_pylist()))) or [()] * len(ADDED)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array(x, pa.string()) for x in made]],
                names=[*b.schema.names[:-1], *ADDED])

    own = [c for c in pages.columns if c not in ADDED]
    given = pages.select(*own, F.col(url_col).cast("string").alias("_url"))
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in own)
    return given.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string, pattern string")
