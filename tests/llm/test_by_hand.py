"""Language distances, quality weights and scores, and the spans that weak supervision adds, against plain definitions."""

import random
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from factloom.llm import langid, pii, quality

WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne".split(),
}


def grams(text):
    """Letters, pairs and triples of the text, words bordered by one sign: names as numbers, so that ties are told."""
    signs = [langid.BORDER]
    for ch in text.lower():
        x = ord(ch) if regex.match(r"\p{L}", ch) else langid.BORDER
        if x != langid.BORDER or signs[-1] != langid.BORDER:
            signs.append(x)
    if signs[-1] != langid.BORDER:
        signs.append(langid.BORDER)
    if len(signs) < 3:
        return Counter()
    name = lambda xs: sum(x << 21 * (len(xs) - 1 - i) for i, x in enumerate(xs))
    out = Counter(x for x in signs if x != langid.BORDER)
    out.update(name(p) for p in zip(signs, signs[1:]))
    out.update(name(t) for t in zip(signs, signs[1:], signs[2:]) if t[1] != langid.BORDER)
    return out


def order(counts):
    return [x for x, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]


def test_language_distances(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(WORDS[lang], k=r.randint(1, 60))).replace(" das", ", DAS 7!"), lang) for i in range(160) for lang in [r.choice(list(WORDS))]]
    docs += [(900, "", "en"), (901, None, "en"), (902, "12 34", "de"), (903, "Ж", "fr"), (904, "x" * 5000, None)]
    df = spark.createDataFrame([(*d, "keep", 1.0) for d in docs], "doc_id int, text string, lang string, Lang_Pred string, SCORES double").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    profiles = {k: Counter() for k in WORDS}
    for i, text, lang in docs:
        if not held(i) and text and lang:
            profiles[lang].update(grams(text))
    profiles = {k: order(v) for k, v in profiles.items()}
    found = langid.predict(df.select("doc_id", "text", "SCORES"), langid.learn(df.where(~langid.held_out())), ["doc_id", "SCORES"])
    got = {x.doc_id: (x.lang_pred, x.score) for x in found.collect()}
    assert found.columns == ["doc_id", "SCORES", "lang_pred", "score"] and len(got) == len(docs)
    for i, text, _ in docs:
        own = order(grams(text or ""))
        far = {k: sum(abs(p.index(x) - n) if x in p else langid.PROFILE for n, x in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert got[i][0] == best and abs(got[i][1] - (1 - far[best] / (len(own) * langid.PROFILE) if own else 0.0)) < 1e-12


def test_quality_weights_and_scores(spark):
    r = random.Random(8)
    good = lambda: ". ".join(" ".join(r.choices(WORDS["en"], k=r.randint(4, 12))).capitalize() for _ in range(r.randint(1, 9))) + "."
    bad = lambda: " ".join(r.choice(["CLICK!!!", "$$$", "a|b|c", "9999", "free"]) for _ in range(r.randint(1, 60)))
    docs = [(i, good() if i % 2 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "word " * 4000), (7, "again")]
    labels = [(i, float(i % 2 if r.random() < 0.9 else 1 - i % 2)) for i in range(0, 300, 1) if i % 10] + [(11, 0.0), (12, None), (None, 1.0), (5555, 1.0)]
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, Score double, STATS string").repartition(3)
    got = {(x.doc_id, round(x.score, 7)): x.predicted for x in quality.classify(df, spark.createDataFrame(labels, "doc_id long, label double"), ~langid.held_out()).collect()}

    told = {}
    for i, y in labels:
        if i is not None and y is not None:
            told.setdefault(i, []).append(y)
    import pyarrow as pa

    stats = quality.statistics(pa.array([t for _, t in docs], pa.string()))
    some = [k for k, (i, _) in enumerate(docs) if i in told and zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([np.mean(told[docs[k][0]]) for k in some])
    dev = stats[some].std(axis=0)
    model = quality.Model(stats[some].mean(axis=0), dev)
    f = model.features(stats[some])
    weight = np.append(np.full(quality.FEATURES, quality.RIDGE * len(some) / quality.FEATURES), 0.0) + 1e-9
    w = np.linalg.lstsq(np.vstack([f, np.diag(np.sqrt(weight))]), np.append(y, np.zeros(len(weight))), rcond=None)[0]
    raw = f @ w
    at = np.clip(np.floor(raw * quality.BINS / 2 + quality.BINS / 4), 0, quality.BINS)
    bins = sorted(set(at))
    xs, ys, ns = (np.array([g(at == b) for b in bins]) for g in (lambda m: raw[m].mean(), lambda m: y[m].mean(), lambda m: m.sum()))
    mean = lambda i, j: (ys[i : j + 1] @ ns[i : j + 1]) / ns[i : j + 1].sum()
    level = np.array([max(min(mean(i, j) for j in range(k, len(ys))) for i in range(k + 1)) for k in range(len(ys))])
    groups = np.cumsum(np.append(0, np.diff(level) > 1e-9))
    middle = np.array([(xs[groups == g] @ ns[groups == g]) / ns[groups == g].sum() for g in range(groups[-1] + 1)])
    want = np.clip(np.interp(model.features(stats) @ w, middle, [level[groups == g].mean() for g in range(groups[-1] + 1)]), 0, 1)
    left = sorted(got)
    for (i, s), (k, v) in zip(left, sorted((d[0], x) for d, x in zip(docs, want))):
        assert i == k and abs(s - v) < 1e-5 and got[i, s] == int(s >= 0.7)


def test_spans_that_weak_supervision_adds(spark):
    r = random.Random(9)
    parts = [
        "mail joe (AT) mail (DOT) com now", "joe.b[at]x-y.org", "call 555-123-4567", "phone (555) 123 4567", "part 555 123 4567a", "4111.1111.1111.1111", "card 4111/1111/1111/1111", "x@y.de", "+49 30 1234567 89",
        "10.0.0.1", "4111 1111 1111 1111", "no 4111_1111_1111_1112", "version 10.20.30.40", "a" * 70 + "(at)b.c", "Ünï 𝒳", "lorem ipsum", "-", "\n", "555.123.4567@x.com", "tel: 212 555 1234",
    ]
    docs = [(i, " ".join(r.choices(parts, k=r.randint(0, 14)))) for i in range(250)] + [(900, None), (901, ""), (902, " ".join(parts * 20))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, Spans int").repartition(3)

    def luhn(x):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(x))) % 10 == 0

    def valid(kind, hit):
        digits = regex.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        return luhn(digits) and 14 <= len(digits) <= 19 if kind == "card" else 10 <= len(digits) <= 15 if kind == "phone" else True

    def spans(text, patterns):
        return {(m.start(), pii.KINDS.index(k), m.end()) for k, p in patterns.items() for m in regex.finditer(p, text) if valid(k, m[0])}

    rows = pii.candidates(df, ["doc_id"])
    weights = pii.train(rows)
    kept = {x.doc_id: {(s.start, s["rank"], s.stop, s.base) for s in x[pii.SPANS]} for x in pii.find(df, ["doc_id"]).collect()}
    seen = {x.doc_id: x[pii.SPANS] for x in rows.collect()}
    added = turned_down = 0
    for i, text in docs:
        base = spans(text or "", pii.BASE)
        loose = {x for x in spans(text or "", pii.LOOSE) if not any(b[0] < x[2] and x[0] < b[2] for b in base)}
        assert {(s.start, s["rank"], s.stop, s.base) for s in seen[i]} == {(*x, True) for x in base} | {(*x, False) for x in loose}
        good = {(s.start, s["rank"], s.stop, s.base) for s in seen[i] if s.base or sum(weights.get(f, 0.0) for f in s.features) + weights[""] > 0}
        assert kept[i] == good
        added += len(good) - len(base)
        turned_down += len(base) + len(loose) - len(good)
    assert added and turned_down
    assert pii.redact(df).columns == df.columns and pii.find(df, ["doc_id"]).where(F.col("doc_id") == 901).first()[pii.SPANS] == []
