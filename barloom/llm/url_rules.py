"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a domain and path prefix, or any regular expression with literal tokens in it.
Rules stand in an index under their rarest token (the one in the fewest rules, then the
longest).  A URL is cut into tokens once; only rules whose index token it has are fetched
by an equi-join, and only those run their expression.  Rules without a usable token stand
under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
#: Up to so many rules the index goes to every task; a larger one is shuffled by token.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; the longest name among fitting domain rules wins.

    A domain rule has ``host`` and ``path`` and is tested on them exactly.  A pattern rule
    has a Java regular expression for the host and one for the path (null: any), or one for
    both written one after the other.  ``tokens`` are lower-case literals that every
    fitting host or path has as whole tokens; an index may only skip what cannot fit.
    """

    name: str
    verdict: str
    tokens: tuple[str, ...]
    host: str | None = None
    path: str | None = None
    host_pattern: str | None = None
    path_pattern: str | None = None
    whole_pattern: str | None = None

    @property
    def is_pattern(self) -> bool:
        return self.host is None


def domain_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits the host, all its subdomains, and paths that start with ``path``.

    A path's last token may go on in the URL (``/en`` fits ``/english``), so it is only
    used for the index where something ends it in the rule.
    """
    host = host.lower()
    closed = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    tokens = [t.lower() for t in re.findall(r"[A-Za-z0-9]+", host) + closed]
    return Rule(host + path, verdict, tuple(dict.fromkeys(tokens)), host, path)


def pattern_rule(verdict: str, name: str, *tokens: str, host: str | None = None, path: str | None = None) -> Rule:
    return Rule(name, verdict, tuple(t.lower() for t in tokens), host_pattern=host, path_pattern=path)


#: What ends a name in a filter line: the end, or any other character than these.
_ENDS = r"(?:[^A-Za-z0-9_.%-]|$)"


def parse_filter(line: str) -> Rule | None:
    """A rule of a filter list's line; None for blank lines, comments, headers and rules on
    elements of a page.

    ``||`` starts at a label of the host and ``|`` at the host's start or the path's end;
    ``^`` is a separator or the end, ``*`` anything, ``@@`` allows, ``/.../`` is a regular
    expression.  Letters fit in either case.  Rules are tested on host and path written
    one after the other: schemes and queries are no part of them, and options (after ``$``)
    are an error, since a URL alone does not tell whether they hold.
    """
    line = line.strip()
    if not line or line[0] in "![" or re.search(r"#[@?$]?#", line):
        return None
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    if len(body) > 2 and body[0] == body[-1] == "/":
        return Rule(line, verdict, (), whole_pattern=f"(?is){body[1:-1]}")
    if "$" in body:
        raise ValueError(f"options are not known here: {line}")
    label, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    core = body[2 if label else int(start) :]
    core = core[:-1] if end and core else core
    pattern = "".join(".*" if c == "*" else _ENDS if c == "^" else re.escape(c) for c in core)
    lead = r"^(?:[^/]*\.)?" if label else "^" if start else ""
    # A run of letters and digits is a whole token where the rule shows both of its ends.
    tokens = []
    for m in re.finditer(r"[A-Za-z0-9]+", core):
        left = core[m.start() - 1] not in "*" if m.start() else start
        right = core[m.end()] not in "*" if m.end() < len(core) else end
        if left and right and m[0].isascii():
            tokens.append(m[0].lower())
    return Rule(line, verdict, tuple(dict.fromkeys(tokens)), whole_pattern=f"(?is){lead}{pattern}{'$' if end else ''}")


#: The rules of the query.
RULES = (
    domain_rule("allow", "com"),
    domain_rule("block", "example.com", "/en/"),
    domain_rule("allow", "www.example.com", "/en/"),
    domain_rule("block", "net", "/es/"),
    domain_rule("block", "net", "/fr/"),
)
#: What the method itself blocks where no domain rule fits.
PATTERNS = (
    # No literal is in all its matches (ad, ads7, adserver), so it has no token.
    pattern_rule("block", "pattern:adserver", host=r"(?s)^(.*\.)?ad(s|server)?[0-9]*\."),
    pattern_rule("block", "pattern:casino", "casino", host=r"(?s)^(.*[.-])?(online-)?casino[.-]"),
    pattern_rule("block", "pattern:wp-login", "wp", "login", "php", path=r"^(/[^/]*)*/wp-login\.php$"),
    pattern_rule("block", "pattern:tracking-pixel", "pixel", "gif", path=r"(?s)^(.*/)?pixel\.gif$"),
)
_INDEX = "token string, name string, verdict string, is_pattern boolean, rule_host string, rule_path string, host_pattern string, path_pattern string, whole_pattern string"


def index_rules(rules: tuple[Rule, ...]) -> list[tuple]:
    """Each rule under its rarest token, the empty one where it has none."""
    seen = Counter(t for r in rules for t in set(r.tokens))
    return [(min(r.tokens, key=lambda t: (seen[t], -len(t), t), default=""), r.name, r.verdict, r.is_pattern, r.host, r.path, r.host_pattern, r.path_pattern, r.whole_pattern) for r in rules]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES + PATTERNS, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path and no rule.  A domain
    rule beats a pattern rule, and an allowing pattern a blocking one; of several, the
    longest name wins, and of equally long ones the last in order of characters.  Pages may
    repeat or lack a page_id; urls may be of any length and hold line feeds; other columns
    are ignored; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    index = spark.createDataFrame(index_rules(rules), _INDEX)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # The distinct pairs of host and path are judged, so repeated URLs run once.
    subjects = rows.select("host", "path").distinct()
    lowered = F.translate(F.concat("host", F.lit("\n"), "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))))
    asked = subjects.withColumn("token", F.explode(tokens))
    if len(rules) <= BROADCAST_RULES:
        candidates = asked.join(F.broadcast(index), "token")
    else:
        # Every URL has the empty token: in a shuffle it would be one task for all.
        candidates = asked.where("token != ''").join(index.where("token != ''"), "token")
        candidates = candidates.unionByName(subjects.crossJoin(F.broadcast(index.where("token = ''"))))
    domain = "(host = rule_host or endswith(host, concat('.', rule_host))) and startswith(path, rule_path)"
    pattern = "coalesce(host rlike host_pattern, true) and coalesce(path rlike path_pattern, true) and coalesce(concat(host, path) rlike whole_pattern, true)"
    fits = candidates.where(F.expr(f"case when is_pattern then {pattern} else {domain} end"))
    order = F.struct((~F.col("is_pattern")).alias("domain"), (F.col("is_pattern") & (F.col("verdict") == "allow")).alias("allows"), F.length("name").alias("n"), "name", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = rows.join(best, ["host", "path"], "left")
    rule = F.when(F.col("best.domain"), F.col("best.name"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
