"""Language identification by rank-order n-gram profiles and out-of-place distance.

Text is lower-cased; letters form words, everything else is a border between words. n-grams are single letters, and
pairs and triples inside a word with its borders. A language's profile lists its PROFILE most frequent n-grams over all
training texts, a document's profile its own most frequent ones (ties: the smaller code points first). The distance
to a language sums, over the document's n-grams, how far their ranks are apart, PROFILE for an n-gram that the
language's profile lacks. The least distance wins (ties: the first name); the score is 1 less the share of the
greatest possible distance.

Null text, text without letters, or an empty training set: `und` with score 0. Rows with null lang teach nothing.
A null doc_id counts as empty text in the training split. Repeated rows count each. Counts cover all training rows;
only PROFILE entries a language reach the driver, from SALTS groups each, for at most MOST_LANGS languages. A very long
text is counted whole. An empty table gives no rows. `predict` replaces columns named lang_pred and score, other columns
stay as they are; `keep_told` keeps all.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import common as c

PROFILE = 400
SALTS = 16
MOST_LANGS = 1000
BORDER = 0x5F
HOLD = 1_000_000
#: Limits of the score: lengths in characters, the quantile of training scores, the share of it that is asked for, and from how many texts.
CUTS = (8, 16, 32, 64, 128, 256, 512, 1024)
LOWEST = 0.01
SHARE = 0.75
ENOUGH = 100


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(sys.maxunicode + 1, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for m in regex.finditer(r"\p{L}+", every):
        a, b = m.span()
        out[ord(every[a]) : ord(every[b - 1]) + 1] = True
    return out


def ngrams(text: str) -> np.ndarray:
    """Codes of the text's n-grams: up to three code points of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    known = letters()[points]
    s = np.full(len(points) + 2, BORDER, np.int64)
    s[1:-1][known] = points[known]
    border = s == BORDER
    keep = ~border
    keep[1:] |= ~border[:-1]
    keep[0] = True
    s = s[keep]
    inner = s[1:-1] != BORDER
    pairs = s[:-1] << 21 | s[1:]
    triples = (pairs[:-1] << 21 | s[2:])[inner]
    return np.concatenate([s[s != BORDER], pairs, triples]) if len(triples) else np.zeros(0, np.int64)


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:most]]


def held_out(doc_id="doc_id", of: int = 4, at: int = 2):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of) == at


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(ranks)
        self.codes = np.unique(np.array([x for k in self.names for x in ranks[k]], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, k in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, ranks[k]), j] = np.arange(len(ranks[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, int]:
        """The language, the score, and the number of the document's n-grams that it comes from."""
        codes = ngrams(text) if text else ()
        if not len(codes) or not self.names:
            return "und", 0.0, 0
        own = ranked(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        rank = self.rank[at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (len(own) * self.size), len(own)


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in docs (text, lang)."""

    def count(batches):
        held: dict[str, list] = {}
        n = 0

        def merged(lang):
            codes, back = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([y for _, y in held[lang]])).astype(np.int64)

        def rows():
            for lang in held:
                codes, counts = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes, counts = np.unique(ngrams(text), return_counts=True)
                held.setdefault(lang, []).append((codes, counts))
                n += len(codes)
                if n > HOLD:
                    held = {k: [merged(k)] for k in held}
                    n = sum(len(v[0][0]) for v in held.values())
                    if n > HOLD // 2:
                        yield from rows()
                        held, n = {}, 0
        yield from rows()

    counts = (
        docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    first = Window.partitionBy("lang", F.pmod("code", F.lit(SALTS))).orderBy(F.desc("n"), "code")
    top = counts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= size).drop("k")
    rows = top.take(MOST_LANGS * SALTS * size + 1)
    by: dict[str, list] = {}
    for lang, code, n in rows:
        by.setdefault(lang, []).append((-n, code))
    if len(by) > MOST_LANGS or len(rows) > MOST_LANGS * SALTS * size:
        raise ValueError(f"more than {MOST_LANGS} languages")
    return Profiles({k: [code for _, code in sorted(v)[:size]] for k, v in by.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, columns: list[str] | None = None) -> DataFrame:
    """The named columns (all, if none are named) with lang_pred and score."""
    columns = [x for x in (columns if columns is not None else docs.columns) if x not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    text = "text"
    rows = docs.select(*columns, *([] if text in columns else [text]))

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*columns, "lang_pred", "score"])

    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


class Limits:
    """The least score by language and length, that of the next shorter length where one has too few texts; by length alone
    where the language has too few texts up to this length; `least` where all have."""

    def __init__(self, least: float, by_lang: dict[tuple[str, int], float], by_length: dict[int, float]):
        self.least, self.by_lang, self.by_length = least, by_lang, by_length

    def at(self, lang: str, n: int) -> float:
        for k in range(_length(n), 0, -1):
            if (lang, k) in self.by_lang:
                return max(self.least, self.by_lang[lang, k])
        return max(self.least, next((self.by_length[k] for k in range(_length(n), 0, -1) if k in self.by_length), 0.0))


def _length(n: int) -> int:
    """Half powers of two of the number of n-grams."""
    return (n * n).bit_length()


def limits(docs: DataFrame, profiles: Profiles, least: float) -> Limits:
    """SHARE of the score that the LOWEST of the training texts get, by language told and length.

    docs are the training documents: each is scored whole and by its first CUTS characters, so that short texts are known too.
    Only the quantiles reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def score(batches):
        n: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for x in (text, *(text[:k] for k in CUTS if k < len(text))):
                    lang, value, size = shared.value.measured(x)
                    if size:
                        key = lang, _length(size), int(value * 1000)
                        n[key] = n.get(key, 0) + 1
        lang, length, value = zip(*n) if n else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(length, pa.int32()), pa.array(value, pa.int32()), pa.array(n.values(), pa.int64())], ["lang", "length", "value", "n"])

    scored = docs.where("text IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(score, "lang string, length int, value int, n bigint")
    scored = c.written(scored.groupBy("lang", "length", "value").agg(F.sum("n").alias("n")), "scores")
    low = F.percentile("value", F.lit(LOWEST), F.col("n")).alias("low")
    by_lang, by_length = ({tuple(r)[:-1]: SHARE * r.low / 1000 for r in scored.groupBy(*k).agg(low, F.sum("n").alias("n")).where(F.col("n") >= ENOUGH).drop("n").collect()} for k in (("lang", "length"), ("length",)))
    return Limits(least, by_lang, {k: v for (k,), v in by_length.items()})


def keep_told(docs: DataFrame, profiles: Profiles, least: Limits | float) -> DataFrame:
    """The documents whose language is told with the score that `least` asks for, or more; all columns stay as they are."""
    least = least if isinstance(least, Limits) else Limits(least, {}, {})
    shared = docs.sparkSession.sparkContext.broadcast((profiles, least))

    def run(batches):
        profiles, least = shared.value
        for batch in batches:
            got = [profiles.measured(x) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least.at(lang, n) for lang, score, n in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
