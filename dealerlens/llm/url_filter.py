"""URL filters: path rules per host, and pattern rules found through their rarest token.

A pattern rule is literal text with ``*`` (any run), ``^`` (a separator or the end) and
``|`` (the start, or the end).  Its *whole tokens* are the runs of [a-z0-9] that the
pattern itself bounds on both sides, so a URL that matches must have them as tokens.
One pass counts how often the rules' tokens occur in all URLs; every rule is then filed
under its rarest one.  A URL's tokens fetch the rules filed under them, and only those run
their regular expression.  Rules without a whole token are tried on every URL.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no path
rule, and is judged by the patterns as it stands (null: as empty text); very long URLs are judged
whole; the longest fitting path rule decides; repeated rows are judged each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"

#: The path rules of the contract, as (verdict, host and path).
PATH_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

#: The method's own rules, as (verdict, pattern).
PATTERN_RULES = [
    ("block", "^spam-farm^"),
    ("block", "^spam^"),
    ("block", "^link-farm^"),
    ("block", "^casino^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "^viagra^"),
    ("block", "^phishing^"),
    ("block", "^doubleclick^"),
    ("block", "^adserver^"),
    ("block", "/ads/*"),
    ("block", "/banners/*^click^"),
    ("block", "/wp-login.php^"),
    ("block", "/cgi-bin/*redirect^"),
    ("block", "?sessionid="),
    ("block", "popunder"),
    ("allow", "^docs^*/ads/api^"),
    ("allow", "/spam^report^"),
]


def to_regex(pattern: str) -> str:
    parts = {"*": ".*", "^": r"(?:[^a-z0-9%_]|^|$)"}
    body = pattern.strip("|")
    return ("^" if pattern.startswith("|") else "") + "".join(parts.get(c, re.escape(c)) for c in body) + ("$" if pattern.endswith("|") and len(pattern) > 1 else "")


def whole_tokens(pattern: str) -> list[str]:
    found = []
    for m in re.finditer(TOKEN, pattern.lower()):
        before, after = pattern[m.start() - 1 : m.start()], pattern[m.end() : m.end() + 1]
        if before not in ("", "*") and after not in ("", "*"):
            found.append(m.group())
    return found


class RuleIndex:
    """Pattern rules by their rarest whole token, path rules by host."""

    def __init__(self, patterns, paths, counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for number, (verdict, pattern) in enumerate(patterns):
            rule = (number, verdict, pattern, re.compile(to_regex(pattern.lower())))
            tokens = whole_tokens(pattern)
            place = self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always
            place.append(rule)
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in paths:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, rule))
        self.ran = 0

    def path_rule(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, host
        while at:
            for prefix, verdict, rule in self.by_host.get(at, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            _, _, at = at.partition(".")
        return best

    def pattern_rule(self, url: str) -> tuple[str, str] | None:
        """The first matching allow rule, else the first matching block rule."""
        found = None
        for number, verdict, pattern, regex in sorted([*self.always, *(r for t in set(re.findall(TOKEN, url)) for r in self.by_token.get(t, ()))]):
            if verdict == "allow" or found is None:
                self.ran += 1
                if regex.search(url):
                    if verdict == "allow":
                        return pattern, verdict
                    found = pattern, verdict
        return found


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(_LOWER), m[2]


_LOWER = {c: c + 32 for c in range(65, 91)}


def token_counts(pages: DataFrame, tokens: list[str], url_col: str = "url") -> dict[str, int]:
    """How often each of ``tokens`` occurs in all URLs; as many rows as rules have tokens."""
    if not tokens:
        return {}
    each = pages.select(F.explode(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(f"({TOKEN})"), 1)).alias("token"))
    return {r["token"]: r["n"] for r in each.filter(F.col("token").isin(tokens)).groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, *, paths=PATH_RULES, patterns=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): the longest fitting path rule decides,
    else the pattern rules, else ``default``."""
    counts = token_counts(pages, sorted({t for _, p in patterns for t in whole_tokens(p)}), url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(patterns, paths, counts)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                fit = index.path_rule(host, path) if host else None
                own = index.pattern_rule((url or "").lower()) if fit is None else None
                for column, value in zip(out, (host, path, fit and fit[0], (fit or own or (None, default))[1], own and own[0]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out)], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, pattern string")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    from ._util import table

    return judge(table(spark, sf_dir, "pages")).drop("pattern")


def oracle() -> str:
    """The same rules as SQL."""
    quoted = lambda s: s.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '/{p}', '{h}/{p}')" for v, r in PATH_RULES for h, _, p in [r.partition("/")])
    hit = lambda kind: " OR ".join(f"regexp_matches(l, '{quoted(to_regex(p.lower()))}')" for v, p in PATTERN_RULES if v == kind)
    return f"""
WITH u AS (
  SELECT page_id, url, lower(coalesce(url, '')) AS l, strpos(coalesce(url, ''), '://') > 0 AS ok,
         substr(url, strpos(url, '://') + 3) AS rest
  FROM pages
), p AS (
  SELECT page_id, l,
         CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), r(v, h, p, rule) AS (VALUES {rules}
), m AS (
  SELECT x.page_id, x.host, x.path, x.l,
         (SELECT max_by(struct_pack(rule := r.rule, v := r.v), length(r.rule)) FROM r
          WHERE (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p)) AS best
  FROM p x
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN {hit("allow")} THEN 'allow' WHEN {hit("block")} THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
