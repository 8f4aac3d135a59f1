"""URL filters: pattern rules indexed by their rarest literal token.

Each rule becomes one regular expression and is filed under the one of its literal tokens that occurs
in the fewest URLs (document frequencies over all URLs, counted for the rules' tokens only). A URL is cut
into tokens once; its tokens fetch the rules filed under them, and only those run their expression. Rules
without a literal token are fetched by every URL. The longest fitting rule wins (by length of its text, then
the longer host, then the smaller text, then block before allow).

Up to MAX_BROADCAST_RULES rules the index is a broadcast dictionary and the URLs are never shuffled. Beyond,
tokens are joined with the index; hot tokens are salted, and so are hot URLs when results return to their pages. Both ways give the same rows.

Defined cases: a null url, or one without ``://``, has empty host and path and gets the default verdict;
repeated pages are each judged; empty tables give no rows; an empty rule list gives the default to every
page; a rule with null host or path is an error; URLs of any length are judged whole; only the id and url columns are read, so other columns' names do no harm. Ports and user
names are part of the host, as the contract cuts it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.common import ascii_lower

MAX_BROADCAST_RULES = 200_000
SALTS = 64
#: Copies of each judged place that pages of one URL are dealt over.
PAGE_SALTS = 8
TOKEN = re.compile(r"[a-z0-9]+")
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains, and every path that begins with ``path`` (``*`` there stands for anything)."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def host_pattern(self) -> str:
        return r"(?s)^(?:.*\.)?" + re.escape(self.host) + r"\z"

    @property
    def path_pattern(self) -> str:
        return "(?s)^" + ".*".join(re.escape(x) for x in self.path.split("*"))

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL must hold as whole tokens.

        The last token of a path is left out unless a separator ends it: a longer word could go on there.
        """
        host = TOKEN.findall(self.host)
        path = []
        for piece in re.split(r"(\*)", self.path.lower()):
            found = list(TOKEN.finditer(piece))
            path += [m[0] for m in found if m.end() < len(piece) and (m.start() > 0)]
        return list(dict.fromkeys([*host, *path]))

    @property
    def order(self) -> tuple:
        return (-len(self.text), -len(self.host), self.text, self.verdict != "block")


#: The rules that the query judges by.
PAGE_RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    rest = F.try_element_at(F.split(url, "://", 2), F.lit(2))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.try_element_at(F.split(url, "://", 2), F.lit(2))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; bounded by the rules, not by the URLs."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = urls.sparkSession
    words = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+"))).alias("token"))
    counted = seen.join(F.broadcast(words) if len(wanted) <= MAX_BROADCAST_RULES else words, "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.toLocalIterator()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in sorted(set(rules), key=lambda r: r.order):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(rule)
    return index


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT, max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    if any(r.host is None or r.path is None for r in rules):
        raise ValueError("a rule needs a host and a path")
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    index = build_index(rules, token_counts(urls, rules))
    return _judge_mapped(urls, index, default) if len(rules) <= max_broadcast else _judge_joined(urls, index, default)


def _judge_mapped(urls: DataFrame, index: dict[str, list[Rule]], default: str) -> DataFrame:
    sent = urls.sparkSession.sparkContext.broadcast({t: [(r.order, r.host_pattern, r.path_pattern, r.text, r.verdict) for r in rs] for t, rs in index.items()})
    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = {t: [(order, re.compile(h.replace(r"\z", r"\Z")), re.compile(p), text, verdict) for order, h, p, text, verdict in rs] for t, rs in sent.value.items()}
        for batch in batches:
            rules, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = None
                for token in {"", *TOKEN.findall(f"{host}/{path}".lower())}:
                    for order, on_host, on_path, text, verdict in filed.get(token, ()):
                        if best is not None and best[0] <= order:
                            break  # filed in order: the rest can't win
                        if on_host.match(host) and on_path.match(path):
                            best = (order, text, verdict)
                rules.append(best and best[1])
                verdicts.append(best[2] if best else default)
            yield pa.record_batch([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, schema)


def _judge_joined(urls: DataFrame, index: dict[str, list[Rule]], default: str) -> DataFrame:
    """Without a broadcast: distinct (host, path) tokens meet the rules filed under them, salted against hot tokens."""
    spark = urls.sparkSession
    rows = [(t, r.host_pattern, r.path_pattern, -len(r.text), -len(r.host), r.text, r.verdict) for t, rs in index.items() for r in rs]
    rules = spark.createDataFrame(rows, "token string, on_host string, on_path string, o1 int, o2 int, rule string, verdict string").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = urls.select("host", "path").distinct()
    tokens = F.array_union(F.array(F.lit("")), F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+"))
    met = (
        places.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        .withColumn("token", F.explode(F.array_distinct(tokens)))
        .join(rules, ["token", "salt"])
        .where(F.expr("host rlike on_host and path rlike on_path"))
    )
    best = met.groupBy("host", "path").agg(F.min(F.struct("o1", "o2", "rule", (F.col("verdict") != "block").alias("o3"), "verdict")).alias("b")).select("host", "path", "b.rule", "b.verdict")
    spread = urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(PAGE_SALTS)).cast("int"))
    copies = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAGE_SALTS - 1))))
    return spread.join(copies, ["host", "path", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), PAGE_RULES)


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE_SQL = {
    "op3_url_filters": """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
}
