"""Personal data by weak supervision, in DataFrame functions only.

Candidates: the base spans (e-mail, IP address, card and phone number by fixed patterns and checks), which always stay,
and looser forms of e-mails, phones and cards that don't overlap them. Four labelers vote on each candidate or abstain:
the strict pattern, a gazetteer (top-level domains, calling codes, card prefixes, reserved networks), the words before
it, and the characters at its borders. Expectation-maximisation over the table of vote patterns (of bounded size)
estimates how reliable each labeler is for each kind, and gives every pattern a probability. A logistic classifier of
span features is trained on those, and decides on the looser candidates.

Positions are code points, ends exclusive. Null text is empty text: no spans. Repeated rows are judged each for itself.
A run of any length is matched in linear time: quantifiers are possessive wherever the pattern can't need to step back,
and e-mails start only where a run of their characters starts or the last match ended. Without candidates nothing is
trained and only base spans, of which there are none either, would be returned; an empty table gives no rows. The spans of
one text are built up in an array, so a text of very many spans takes time that grows faster than their number. All
columns stay in `redact`, whatever their names, but for those that begin with factloom_, which are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm import common as c

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?(?:\((?i:at)\)|\[(?i:at)\])\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\((?i:dot)\)|\[(?i:dot)\]|\.)\x20?[A-Za-z0-9-]{{1,63}}+){{1,5}}+",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: Top-level domains, calling codes, and words that speak for or against personal data before a span.
DOMAINS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|mx|br|in|jp|cn|au"
CODES = r"\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = "mail|e-mail|email|contact|write|phone|tel|telephone|call|fax|mobile|card|visa|account|payment|ip|host|address|server|from|client"
DOUBTS = "version|release|isbn|serial|section|figure|build|page|part|no"
THRESHOLD = 0.5
ROUNDS = 60
CONTEXT = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """The check sum over the digits of x, which are 19 at most."""
    def value(d, i):
        n = d.cast("int") * (F.lit(1) + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(_digits(x)), "(?!^)(?!$)"), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(hit).between(14, 37) & F.length(_digits(hit)).between(14, 19) & F.when(F.length(hit) <= 37, _luhn(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _found(text: str, kind: str, pattern: str, strict: bool) -> tuple[Column, Column]:
    """Columns with the matches of a pattern, and the texts between them."""
    may = F.col(text).contains("@") if kind == "email" and strict else F.col(text).rlike(r"\((?i:at)\)|\[(?i:at)\]" if kind == "email" else "[0-9]")
    none = F.array().cast("array<string>")
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(may, F.split(text, pattern, -1)).otherwise(none)


def _placed(hits: Column, gaps: Column, kind: str, strict: bool) -> Column:
    """Spans with their positions and the text before, those that fail the kind's check left out."""
    rank = KINDS.index(kind)
    behind = F.zip_with(F.slice(gaps, 2, F.size(gaps)), F.slice(hits, 2, F.size(gaps)), lambda gap, hit: F.substring(F.concat(F.substring(gap, 1, 1), F.coalesce(F.substring(hit, 1, 1), F.lit(""))), 1, 1))
    pairs = F.zip_with(hits, gaps, lambda hit, gap: F.struct(gap.alias("gap"), hit.alias("hit")))
    both = F.filter(F.zip_with(pairs, behind, lambda x, after: F.struct(x.gap.alias("gap"), x.hit.alias("hit"), after.alias("after"))), lambda x: x.hit.isNotNull())

    def step(acc, x):
        start = acc.at + F.length(x.gap)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x.hit)).alias("stop"), x.hit.alias("hit"), F.substring(x.gap, -CONTEXT, CONTEXT).alias("before"), F.lit(strict).alias("base"),
            x.after.alias("after"),
        )
        good = F.coalesce(_valid(kind, x.hit), F.lit(False))
        return F.struct((start + F.length(x.hit)).alias("at"), F.when(good, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,hit:string,before:string,base:boolean,after:string>>")
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc.spans)


SPANS = "factloom_spans"


def candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with SPANS: base spans and looser candidates with votes and features, by start and kind."""
    t = "factloom_text"
    rows = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t))
    plan = [(k, p, True) for k, p in BASE.items()] + [(k, p, False) for k, p in LOOSE.items()]
    found = [_found(t, *x) for x in plan]
    rows = rows.select(*columns, t, *(h.alias(f"factloom_h{i}") for i, (h, _) in enumerate(found)), *(g.alias(f"factloom_g{i}") for i, (_, g) in enumerate(found)))
    placed = [_placed(F.col(f"factloom_h{i}"), F.col(f"factloom_g{i}"), k, s) for i, (k, _, s) in enumerate(plan)]
    n = len(BASE)
    rows = rows.select(*columns, t, F.concat(*placed[:n]).alias("factloom_base"), F.concat(*placed[n:]).alias("factloom_loose"))
    apart = F.filter("factloom_loose", lambda x: ~F.exists("factloom_base", lambda b: (b.start < x.stop) & (x.start < b.stop)))
    rows = rows.select(*columns, t, F.array_sort(F.concat("factloom_base", apart)).alias("factloom_all"))
    return rows.select(*columns, F.transform("factloom_all", _described).alias(SPANS))


def _described(x: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    before, last = F.lower(x["before"]), F.substring(x["before"], -1, 1)
    after = x["after"]
    digits = _digits(x["hit"])
    listed = (
        F.when(x["rank"] == 0, x["hit"].rlike(rf"(?i)[.)\] ](?:{DOMAINS})$"))
        .when(x["rank"] == 1, ~x["hit"].rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."))
        .when(x["rank"] == 2, digits.rlike("^[3-6]"))
        .otherwise(x["hit"].rlike(f"^{CODES}") | digits.rlike("^[2-9][0-9]{2}[2-9]"))
    )
    cue = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES})[^\p{{L}}]{{0,4}}$"), 1).when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{DOUBTS})[^\p{{L}}]{{0,3}}$"), 0).otherwise(-1)
    edge = F.when(last.rlike(r"[\p{L}\p{N}_]") | after.rlike(r"[\p{L}\p{N}_]"), 0).otherwise(1)
    strict = F.when(x["base"], 1).otherwise(0)
    votes = F.array(strict, F.when(F.coalesce(listed, F.lit(False)), 1).otherwise(0), cue, edge)
    share = F.floor(4 * F.length(digits) / F.greatest(F.length(x["hit"]), F.lit(1)))
    size = F.least(F.floor(F.length(x["hit"]) / 6), F.lit(5))
    features = F.array(*(F.concat_ws(":", kind, F.lit(name), value.cast("string")) for name, value in (("share", share), ("size", size), ("listed", votes[1]), ("cue", cue), ("edge", edge), ("strict", strict))))
    return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), kind.alias("kind"), x["stop"].alias("stop"), x["base"].alias("base"), votes.alias("votes"), features.alias("features"))


def reliabilities(votes: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The probability of each vote pattern (1 yes, 0 no, -1 none), by expectation-maximisation for each kind."""
    out = np.full(len(n), 0.5)
    for kind in np.unique(kinds):
        v, w = votes[kinds == kind], n[kinds == kind].astype(float)
        prior, yes, no = 0.5, np.full(v.shape[1], 0.8), np.full(v.shape[1], 0.3)
        for _ in range(ROUNDS):
            like = [np.log(q) + np.where(v == 1, np.log(p), np.where(v == 0, np.log(1 - p), 0.0)).sum(axis=1) for p, q in ((yes, prior), (no, 1 - prior))]
            own = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
            prior = (own @ w + 1) / (w.sum() + 2)
            said = (v >= 0) * w[:, None]
            yes = ((own[:, None] * said * (v == 1)).sum(axis=0) + 4) / ((own[:, None] * said).sum(axis=0) + 5)
            no = (((1 - own)[:, None] * said * (v == 1)).sum(axis=0) + 1) / (((1 - own)[:, None] * said).sum(axis=0) + 5)
        out[kinds == kind] = own
    return out


def classifier(features: list[list[str]], target: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Weights of a ridge logistic regression on features (present or not), by Newton steps."""
    names = sorted({f for x in features for f in x})
    x = np.array([[name in own for name in names] + [True] for own in map(set, features)], float)
    w = np.zeros(x.shape[1])
    n = n / n.sum() * min(n.sum(), 10_000)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - target)) + w
        w -= np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)), grad)
    return {**dict(zip(names, w[:-1].tolist())), "": float(w[-1])}


def train(spans: DataFrame) -> dict[str, float]:
    """spans: rows of candidates' arrays. Only the table of distinct votes and features reaches the driver."""
    table = spans.select(F.explode(SPANS).alias("x")).groupBy("x.rank", "x.votes", "x.features").count().collect()
    if not table:
        return {"": 0.0}
    kinds, n = np.array([r[0] for r in table]), np.array([r["count"] for r in table], float)
    target = reliabilities(np.array([list(r[1]) for r in table]), kinds, n)
    return classifier([list(r[2]) for r in table], target, n)


def decided(rows: DataFrame, weights: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """SPANS without the looser candidates that the classifier turns down."""
    table = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in (k, v)))
    level = float(np.log(threshold / (1 - threshold)))

    def keep(x):
        return x.base | (F.aggregate(x.features, F.lit(weights[""]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0))) > level)

    return rows.withColumn(SPANS, F.filter(SPANS, keep))


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with SPANS (start, rank, kind, stop, base, ...), by start and kind."""
    rows = c.written(candidates(docs, columns), "spans")
    return decided(rows, train(rows))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    base = F.filter(SPANS, lambda x: x.base)
    counts = [F.size(F.filter(SPANS, _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col(SPANS)).alias("spans"))


def _of(rank: int):
    return lambda x: x.base & (x["rank"] == rank)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each found span replaced by its kind in angle brackets (of overlapping ones, the first). All columns stay."""
    found = find(docs, docs.columns)

    def step(acc, x):
        fresh = x.start >= acc.at
        more = F.concat(acc.out, F.array(F.concat(F.substr(F.col("text"), acc.at + 1, x.start - acc.at), F.lit("<"), F.upper(x.kind), F.lit(">"))))
        return F.struct(F.greatest(acc.at, x.stop).alias("at"), F.when(fresh, more).otherwise(acc.out).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(SPANS, none, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(F.col("text"), acc.at + 1)))
    return found.withColumn("text", F.when(F.size(SPANS) > 0, text).otherwise(F.col("text"))).select(docs.columns)
