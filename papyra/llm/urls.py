"""URL filters: host and path rules first, then a weighted vocabulary that one Aho-Corasick pass counts.

A term counts where no letter or digit stands before or after it. One strict term rejects a URL; soft terms reject it
when at least `soft_least` different ones appear and their weights reach `soft_weight`. Terms are sought in the URL as it is
read: percent escapes decoded as UTF-8, labels of the host out of Punycode, and lower-cased. The automaton is built once in
each Python worker; the pass is map-only, without any shuffle. The built-in vocabulary is a small start;
UrlFilter.from_table() takes one of any size from a table (term, weight, strict).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import LOWER, UPPER, free_name

#: One of these terms rejects a URL.
STRICT = ["porn", "porno", "xxx", "hentai", "milf", "camgirl", "sexcam", "escorts", "casino", "jackpot", "viagra", "cialis", "warez", "keygen", "torrentz", "malware"]
#: Terms that count together, with their weights.
SOFT = {
    "adult": 1.0, "sex": 1.5, "sexy": 1.5, "nude": 1.5, "naked": 1.5, "dating": 1.0, "hot": 0.5, "bet": 1.0, "betting": 1.5,
    "poker": 1.5, "slots": 1.5, "gamble": 1.5, "pills": 1.0, "pharmacy": 1.0, "loan": 1.0, "payday": 1.5, "free": 0.5,
    "crack": 1.0, "torrent": 1.5, "download": 0.5, "hack": 1.0, "replica": 1.0, "cheap": 0.5, "promo": 0.5, "click": 0.5,
}
#: The rules of the query: host and path to verdict. A rule fits its host and all subdomains.
RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}

TO_LOWER = str.maketrans(UPPER, LOWER)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, path = rest[:end].translate(TO_LOWER), rest[end:]
    end = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return host, path[:end]


def label(text: str) -> str:
    """A label of a host; out of Punycode if it is that and can be read."""
    if text.startswith("xn--"):
        try:
            return text[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return text
    return text


def shown(url: str | None) -> str:
    """The URL as words are sought in it. Escapes that are no UTF-8 give replacement characters, which bound words."""
    text = url or ""
    if "%" in text:
        text = unquote(text, errors="replace")
    text = text.lower()
    if "xn--" in text:
        scheme, mark, rest = text.partition("://")
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        text = scheme + mark + ".".join(map(label, rest[:end].split("."))) + rest[end:]
    return text


@dataclass
class UrlFilter:
    rules: dict = field(default_factory=lambda: dict(RULES))
    strict: list = field(default_factory=lambda: list(STRICT))
    soft: dict = field(default_factory=lambda: dict(SOFT))
    soft_least: int = 2
    soft_weight: float = 2.0
    _automaton = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_automaton", "_by_host")}

    @classmethod
    def from_table(cls, terms: DataFrame, most: int = 5_000_000, **options) -> UrlFilter:
        """A filter by rows (term, weight, strict); more than `most` terms raise, as each Python worker holds all.

        Terms are lower-cased and stripped; null and empty ones go. A term that repeats is strict if any row says so, and
        has the largest of its weights; a null weight is 1.
        """
        term = F.lower(F.trim("term"))
        rows = terms.select(term.alias("term"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"), F.coalesce("strict", F.lit(False)).alias("strict"))
        rows = rows.where(F.coalesce("term", F.lit("")) != "").groupBy("term").agg(F.max("weight").alias("weight"), F.max("strict").alias("strict"))
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} terms")
        return cls(strict=sorted(r.term for r in found if r.strict), soft={r.term: r.weight for r in found if not r.strict}, **options)

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as text, and its verdict. Looks up the host's suffixes, however many rules there are."""
        if not hasattr(self, "_by_host") or self._by_host[0] is not self.rules:
            by: dict = {}
            for (h, p), verdict in self.rules.items():
                by.setdefault(h, []).append((p, verdict))
            self._by_host = (self.rules, by)
        by, best = self._by_host[1], (None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for p, verdict in by.get(suffix, ()):
                if path.startswith(p) and len(suffix + p) > len(best[0] or ""):
                    best = (suffix + p, verdict)
        return best

    def hits(self, url: str | None) -> tuple[int, int, float]:
        """Strict hits, different soft terms and their weight."""
        text = shown(url)
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term in {*self.strict, *self.soft} - {""}:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        strict, soft, ban = 0, set(), set(self.strict)
        if not len(self._automaton):
            return 0, 0, 0.0
        for last, term in self._automaton.iter(text):
            first = last - len(term) + 1
            if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                continue
            if term in ban:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft), sum(self.soft[t] for t in sorted(soft))

    def judge(self, url: str | None) -> tuple:
        host, path = parts(url)
        rule, verdict = self.rule(host, path)
        strict, soft, weight = self.hits(url)
        reject = strict > 0 or (soft >= self.soft_least and weight >= self.soft_weight)
        return host, path, rule, verdict or ("block" if reject else "allow"), strict, soft, weight


def judge_urls(df: DataFrame, url: Column, by: UrlFilter | None = None, into: str = "judged") -> DataFrame:
    """Adds struct column `into`: host, path, rule, verdict (allow or block), strict_hits, soft_terms, soft_weight.

    A null URL or one without `://` has empty host and path, fits no rule and is judged by its words (null: allow).
    All rows and columns stay, repeats included; a taken name `into` raises. Long URLs take time in proportion. Equal URLs,
    equal values. An empty table gives an empty one.
    """
    free_name(df, into)
    by = by or UrlFilter()
    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"]

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_hits int, soft_terms int, soft_weight double")
    def judge(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([by.judge(u) for u in urls], columns=names)

    return df.withColumn(into, judge(url))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, F.col("url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.strict_hits", "judged.soft_terms")
