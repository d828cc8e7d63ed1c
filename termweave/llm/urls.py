"""URL filters: host and path rules, and logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from termweave.llm.util import carry, restore

#: (rule, verdict); what stands before the first / is the host.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BITS = 14
SIZES = (3, 4, 5)

# The words that the small labelled table is made from.
_GOOD_HOSTS = "library.example.org docs.example.org wiki.example.net news.example.com science.example.org school.example.edu museum.example.org blog.example.com health.example.gov journal.example.net recipes.example.com archive.example.org".split()
_BAD_HOSTS = "casino-bonus.example.biz free-pills.example.info xxx-video.example.net win-prizes.example.com adserver.example.net cheap-loans.example.biz hot-girls.example.info warez-crack.example.net click-track.example.com poker-jackpot.example.biz replica-watch.example.info torrent-keygen.example.net".split()
_GOOD_PATHS = "/en/articles/history /guide/index.html /research/paper-12 /2021/05/garden-notes /de/wissen/artikel /reference/manual /learn/lesson/4 /en/98.html /stories/river".split()
_BAD_PATHS = "/casino/slots/bonus /buy/viagra-cheap /xxx/adult/video /ads/banner/click /win/free/iphone /poker/jackpot/spin /download/crack/keygen /loans/payday/now /redirect/track/aff".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 is allow, 0 is block. Fewer than 250 rows, whatever the corpus."""
    good = [(f"https://{h}{p}", 1) for i, h in enumerate(_GOOD_HOSTS) for p in _GOOD_PATHS[i % 2 :: 2]]
    bad = [(f"http://{h}{p}", 0) for i, h in enumerate(_BAD_HOSTS) for p in _BAD_PATHS[i % 2 :: 2]]
    mixed = [(f"http://{h}{p}", 0) for h, p in zip(_GOOD_HOSTS, _BAD_PATHS, strict=False)] + [(f"http://{h}{p}", 0) for h, p in zip(_BAD_HOSTS, _GOOD_PATHS, strict=False)]
    return good + bad + mixed


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent domain of it and whose path begins the url's; else null."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _features(host: str, path: str) -> np.ndarray:
    """Hashed slots of the character n-grams of host and path, each once."""
    out = set()
    for mark, part in ((b"h", b"^" + host.encode() + b"$"), (b"p", b"^" + path.encode() + b"$")):
        for n in SIZES:
            out.update(zlib.crc32(mark + part[i : i + n]) & ((1 << BITS) - 1) for i in range(len(part) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def _cut(url: str) -> tuple[str, str]:
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def fit(labelled: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression by full gradient steps; slots are averaged over a url's n-grams."""
    rows = [_features(*_cut(u)) for u, _ in labelled]
    x = np.zeros((len(rows), (1 << BITS) + 1))
    for i, f in enumerate(rows):
        x[i, f] = 1 / np.sqrt(max(len(f), 1))
    x[:, -1] = 1
    y = np.array([v for _, v in labelled], float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * 8 * (x.T @ ((p - y) * share) + decay * np.r_[w[:-1], 0])
    return w


@functools.lru_cache(maxsize=1)
def default_weights() -> np.ndarray:
    return fit(labelled_urls())


def score(host: str, path: str, weights: np.ndarray) -> float:
    """The probability of allow."""
    f = _features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(len(f), 1)) + weights[-1]))))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds (or replaces) host, path, rule, p_allow and verdict; all other columns return.

    A fitting rule decides, the longest first; elsewhere the model does: allow if p_allow is at least
    ``threshold``. A null url, an empty one or one without :// has empty host and path, fits no rule and is
    judged by the model on nothing (its intercept). The model is trained on the driver from ``labelled``
    (default: ``labelled_urls()``, fewer than 250 rows) and reaches the workers as 16,385 weights. Rows are
    judged one by one: no shuffle, and only the url column leaves the JVM.
    """
    weights = default_weights() if labelled is None else fit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, str], float] = {}
            p = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key not in known:
                    known[key] = score(*key, weights)
                p.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_allow"])

    url = F.col(f"`{url_col}`")
    base = carry(pages, host=url_host(url), path=url_path(url))
    base = base.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    schema = StructType([*base.schema.fields, StructField("p_allow", DoubleType())])
    scored = base.mapInArrow(run, schema)
    by_rule = F.create_map(*[F.lit(x) for pair in rules for x in pair])[F.col("rule")]
    verdict = F.coalesce(by_rule, F.when(F.col("p_allow") >= threshold, "allow").otherwise("block"))
    return restore(scored, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), p_allow=F.col("p_allow"), verdict=verdict)
