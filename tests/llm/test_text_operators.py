"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, decontaminate, iblt, langid, pii, ppm, quality, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, block string, spans string, score string, fp string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdefgéß", k=random.randint(1, 6))) for _ in range(300)]
    passage = " ".join(random.choices(vocabulary, k=60))
    out = {i: " ".join(random.choices(vocabulary, k=random.randint(0, 80))) for i in range(1, 60)}
    out |= {60: None, 61: "", 62: " \t\n", 63: "one", 64: "$$$ 123", 65: out[7], 66: out[7], 67: out[8] + " tail", 68: "Intro " + passage + "\nEnd.", 69: passage, 70: "x " + passage[10:-10] + " y", 71: passage + " " + passage}
    out |= {72: "z" * 50_000, 73: (passage + "\n") * 60, 74: "ÄÖ Ünïcode 😀 text. " * 5, 75: out[7].upper()}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", "s", 0, "r", "b", "sp", "sc", "fp") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ppm(docs, texts, empty, spark):
    got = rows_of(ppm.report(docs))
    tokens = {i: [low(w) for w in words(t)] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
        assert r.score < 0
    assert got[60].score == pytest.approx(got[61].score) == pytest.approx(got[62].score)
    assert got[65].score == pytest.approx(got[66].score)
    assert ppm.report(empty).count() == 0
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)  # held out: nothing is learned
    alone = spark.createDataFrame([(one, "ab")], "doc_id bigint, text string")
    assert ppm.report(alone).first().score == pytest.approx(-3 * log10(256))


def test_ppm_against_plain_definition(docs):
    """The trie's scores against the definition, by dictionaries; and they sum to one."""
    import numpy as np

    from factloom.llm import common as c

    trie = ppm.learn(docs.where("doc_id < 30"), nodes=500)
    texts = [r.text for r in docs.where("doc_id < 30").collect()]
    full = Counter()
    for t in texts:
        line = " ".join(low(w) for w in words(t)).encode() + bytes([ppm.END])
        seq = bytes([ppm.END]) * ppm.ORDER + line
        for p in range(ppm.ORDER, len(seq)):
            for size in range(1, ppm.ORDER + 2):
                full[seq[p - size + 1 : p + 1]] += 1
    bins = Counter(int(np.floor(np.log2(n) * 8)) for n in full.values())
    total, least = 0, 1
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > 500:
            least = max(1, int(np.ceil(2 ** ((b + 1) / 8))))
            break
    kept = {g: n for g, n in full.items() if n >= least}
    assert 0 < len(kept) == len(trie.count) <= 500

    def score(context, byte):
        out, ruled = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            h = context[len(context) - k :]
            own = {g[-1]: n for g, n in kept.items() if len(g) == k + 1 and g[:-1] == h}
            if not own:
                continue
            every = {g[-1]: n for g, n in full.items() if len(g) == k + 1 and g[:-1] == h}
            cut = sum(every.values()) - sum(own.values())
            mass = sum(n - ppm.DISCOUNT for s, n in own.items() if s not in ruled)
            escape = ppm.DISCOUNT * len(every) + cut if not ruled else max(ppm.DISCOUNT, ppm.DISCOUNT * (len(every) - len(ruled)) + cut)
            if byte in own:
                return out + log10((own[byte] - ppm.DISCOUNT) / (mass + escape))
            if mass > 0:
                out += log10(escape / (mass + escape))
            ruled = set(own)
        return out - log10(256 - len(ruled))

    line = bytes([ppm.END]) * ppm.ORDER + b"abg zz q\xc3\xa9"
    for p in range(ppm.ORDER, len(line), 2):
        codes = np.array([int.from_bytes(line[p - ppm.ORDER : p] + bytes([s]), "big") for s in range(256)], c.U64)
        found = trie.scores(codes)
        assert (10**found).sum() == pytest.approx(1.0)
        for s in (line[p], 0, 97, 255):
            assert found[s] == pytest.approx(score(line[p - ppm.ORDER : p], s))


def test_bpe(docs, texts, empty):
    import public_tokenizers
    import tiktoken

    t = bpe.public()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    got = rows_of(bpe.digests(docs, t))
    for i, x in texts.items():
        ids = reference.encode_ordinary(x or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha(x or ""))
    assert bpe.digests(empty, t).count() == 0
    back = bpe.decode(bpe.encode(docs, t), t)
    assert all(r.decoded == (r.text or "") for r in back.select("text", "decoded").collect())
    assert all(t.entries[t.hash.slot(k)] == k for k in t.entries[::50]) and t.whole(b"no such token") == -1


def brute_hits(texts, items, size=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    wins = {}
    for item, text in items.items():
        w = find(low(text or ""))
        for p in range(max(min(len(w), 1), len(w) - size + 1)):
            wins.setdefault(tuple(w[p : p + size]), set()).add(item)
    out = {}
    for i, text in texts.items():
        w = find(low(text or ""))
        hit, own = set(), set()
        for p in range(len(w)):
            for n in {len(x) for x in wins}:
                if p + n <= len(w) and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    own |= wins[tuple(w[p : p + n])]
        out[i] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit))
    return out


@pytest.mark.parametrize("most", [1_000_000, 300])
def test_decontamination(spark, docs, texts, empty, most):
    items = {"1": texts[69], "2": texts[5], "10": "one", "11": None, "12": "...", "13": texts[69], "3": " ".join(texts[9].split()[:12])}
    benchmark = spark.createDataFrame(list(items.items()), "item_id string, text string")
    want = brute_hits(texts, items)
    got = rows_of(decontaminate.scan(docs, benchmark, most=most))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert decontaminate.scan(empty, benchmark, most=most).count() == 0
    assert {r.n_hit for r in decontaminate.scan(docs, spark.createDataFrame([], "item_id string, text string"), most=most).collect()} == {0}
    kept = rows_of(decontaminate.remove(docs, benchmark, most=most))
    assert kept == rows_of(decontaminate.remove(docs, benchmark))
    assert 69 not in kept and 5 not in kept and kept[1].text == texts[1] and kept[60].text is None and kept[1].block == "b"
    assert kept[68 if 68 in kept else 1].text is not None


def test_language(spark, empty):
    random.seed(1)
    alphabet = {"en": "thinkoverland", "fr": "éàquelmaison", "ru": "приветмир"}
    rows = [(i, " ".join("".join(random.choices(alphabet[k], k=5)) for _ in range(40)), k) for i, k in enumerate(["en", "fr", "ru"] * 40)]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None), (1003, "привет", None), (1004, "x" * 100_000, None), (None, "than", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = langid.held_out()
    profiles = langid.learn(docs.where(~held))
    got = langid.predict(docs, profiles, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "ru"] and by[1000].score == 0 and all(0 <= r.score <= 1 for r in got)
    # counts and ranks by brute force
    grams = Counter()
    for i, text, k in rows:
        if k == "fr" and text and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                s = "_" + w + "_"
                grams.update([*w, *(s[j : j + 2] for j in range(len(s) - 1)), *(s[j : j + 3] for j in range(len(s) - 2))])

    def code(g):
        return sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))

    want = [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[: profiles.size]]
    column = profiles.rank[:-1, profiles.names.index("fr")]
    have = [int(profiles.codes[k]) for k in column.argsort() if column[k] >= 0]
    assert have == want
    none = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"} and langid.predict(empty, profiles).count() == 0
    kept = {r.doc_id for r in langid.keep_told(docs, profiles, 0.05).collect()}
    assert not {1000, 1001, 1002} & kept and set(range(120)) <= kept


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, empty):
    random.seed(9)
    pieces = ["a@b.com", "x.y+z@q-r.co.uk", "1.2.3.4", "256.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+33 1 23 45 67 89", "é@é.com", "@", ".", "_", "+", "555-123-4567", "é😀", "12", " - ", "9.9.9.9.9"]
    rows = [(i, "".join(random.choice(pieces) + random.choice(["", " ", "x ", "\n"]) for _ in range(random.randint(1, 25)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 30_000), (1003, "x" * 30_000), (1004, "a@b.co " * 500), (1005, "joe (at) mail (dot) com or (555) 123-4567"), (1006, "4111-1111-1111-1111" + " 5" * 5000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(pii.report(table))
    assert len(got) == len(rows)
    for i, text in rows:
        want = [] if i == 1003 else base_spans(text or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == sha(said), (text, said, got[i].spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    assert got[1005].spans.startswith("email:0:23")
    assert pii.report(empty).count() == 0 and pii.redact(empty).columns == empty.columns
    red = rows_of(pii.redact(table))
    assert red[1005].text.startswith("<EMAIL> or ") and red[1000].text is None and red[1004].text == "<EMAIL> " * 500
    clean = rows_of(pii.redact(docs.where("doc_id < 60")))
    assert all(r.spans == "sp" for r in clean.values())


def test_pii_plan_is_native(docs):
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(pii.candidates(docs, ["doc_id"])._jdf.queryExecution(), "simple")
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reliabilities_follow_the_majority():
    import numpy as np

    votes = np.array([[1, 1, 1, 1], [1, 1, -1, 1], [0, 0, 0, 0], [0, 0, -1, 1]])
    p = pii.reliabilities(votes, np.zeros(4), np.array([50, 30, 40, 20]))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1 and p[3] < 0.5


def test_fingerprints(docs, texts, empty, spark):
    got = rows_of(iblt.report(docs))
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        own, after = texts[i] or "", texts[j] or ""
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), sha(edited))
        sets = [set(iblt.digests([x])[0].tolist()) for x in (own, edited, after)]
        for near, other in ((got[i].near_edited, sets[1]), (got[i].near_next, sets[2])):
            assert near == pytest.approx(len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (sets[0] == sets[1])
        # what is returned is enough to tell how alike two texts are, and what they consist of
        assert got[i].near_edited == iblt.likeness_of(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == iblt.likeness_of(got[i].fingerprint, got[j].fingerprint)
        table = iblt.opened(got[i].fingerprint)
        assert set(iblt.peeled(*table, 1, len(table[0]))[0].tolist()) == sets[0]
    assert got[65].fingerprint == got[7].fingerprint and got[60].fingerprint == got[61].fingerprint
    assert iblt.report(empty).count() == 0
    lone = iblt.report(spark.createDataFrame([(1, "a b c. d")], "doc_id bigint, text string")).first()
    assert lone.near_next == 1.0
    twins = iblt.report(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id bigint, text string")).collect()
    assert len(twins) == 3


def test_fingerprints_over_blocks(docs, monkeypatch):
    want = rows_of(iblt.report(docs))
    from factloom.llm import blocks as s

    monkeypatch.setattr(iblt, "blocks", lambda d: s.blocks(d, chars=9000))
    monkeypatch.setattr(iblt, "ORDERED", 2)
    assert s.blocks(docs, chars=9000)[0].select(s.BLOCK).distinct().count() > 3
    assert rows_of(iblt.report(docs)) == want


def test_chat(spark, empty):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a\\<b #"), (1, 2, "assistant", "### user:\nx</turn>\n"), (2, 0, "assistant", None), (2, 1, None, "\\"), (3, 5, "ro:le\n", "t"), (3, 5, "ro:le\n", "t"), (3, 4, "assistant", "😀\n"), (None, 0, "user", "n")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(70)]
    got = rows_of(chat.report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")), "conv_id")
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert len(got) == 6
    for conv in got:
        own = sorted((t, r or "", x or "") for i, t, r, x in rows if i == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_reply_trees(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 2, 1.0), ("u", 1, 77, 0.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double")
    got = sorted(map(tuple, chat.paths(messages, keep=2).select("tree", "rank", "place", "node").collect()))
    assert got == [("t", 1, 1, 1), ("t", 1, 2, 3), ("t", 1, 3, 4), ("t", 2, 1, 1), ("t", 2, 2, 2), ("t", 2, 3, 5), ("u", 1, 1, 1)]


def brute_fingerprint(text):
    w = words(low(text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps):
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and group[i] < group[j]:
                    group[j], changed = group[i], True
    return group


def test_simhash(docs, texts, empty):
    got = rows_of(simhash.report(docs))
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    group = least_reachable(fps)
    assert {i: r.component_id for i, r in got.items()} == group
    kept = rows_of(simhash.keep_one(docs))
    assert set(kept) == {i for i in group if group[i] == i} and kept[1].fp == "fp"
    assert simhash.report(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "other words are here now"), (None, "a b c d"), (None, "alone with no id at all"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.text or "") for r in simhash.keep_one(docs).collect()) == [(-1, "alone with no id at all"), (5, "a b c d"), (5, "other words are here now"), (7, "")]
    assert simhash.report(docs).count() == 6


def test_simhash_chains():
    import numpy as np

    random.seed(3)
    fps = set()
    for _ in range(25):
        x = random.getrandbits(64)
        for _ in range(12):
            for b in random.sample(range(64), random.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    a, b = simhash.chained(np.repeat(np.array(fps, np.uint64), len(simhash.FLIP)), np.tile(np.arange(len(simhash.FLIP)), len(fps)))
    group = {x: x for x in fps}
    for _ in range(30):
        for x, y in zip(a.tolist(), b.tolist()):
            group[x] = group[y] = min(group[x], group[y])
    by = dict(enumerate(fps))
    want = least_reachable(by)
    assert [group[x] for x in fps] == [by[want[i]] for i in range(len(fps))]


def brute_removed(rows, size):
    first = {}
    last = 1 << 62
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (last if i is None else i):
                gone |= set(range(p, p + size))
        out.append((i if i is not None else -1, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize("chars, patterns, size, width", [(3_000_000, 20_000, 13, None), (9000, 40, 13, None), (9000, 20_000, 4, None), (9000, 20_000, 4, 9)])
def test_substring(spark, docs, texts, empty, chars, patterns, size, width):
    """A width of 9 bits makes nearly all windows collide."""
    rows = [*texts.items(), (None, texts[69]), (69, texts[69])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(table, size, width, chars, patterns).collect())
    assert got == brute_removed(rows, size)
    assert substring.report(empty, size, width, chars, patterns).count() == 0
    cut = rows_of(substring.remove(docs, size, width, chars, patterns))
    assert cut[60].text is None and cut[1].text == texts[1] and cut[1].fp == "fp"
    want = {i: n - g for i, n, g, _ in brute_removed(list(texts.items()), size)}
    assert {i: len(words(r.text)) for i, r in cut.items()} == want


def test_quality(spark, empty):
    random.seed(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        w = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(60)]
        rows.append((i, ". ".join(w) if good else "!! ".join(w).upper()))
        labels.append((i, float(good)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, "abc")]
    labels += [(1001, None), (5000, 1.0), (0, labels[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, label double")
    got = quality.classify(docs, marks, ~langid.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == dict(labels)[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.97
    assert quality.classify(empty, marks, F.lit(True)).count() == 0
    assert {r.score for r in quality.classify(docs, marks.where("doc_id < 0"), F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, marks.where("label = 1"), F.lit(True)).collect()} == {1.0}


def test_isotonic():
    import numpy as np

    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.ones(5))
    assert (np.diff(y) > 0).all() and y == pytest.approx([0.1, 1.1 / 3, 0.9]) and x == pytest.approx([0, 2, 4])


def test_fingerprints_of_any_size():
    """Fingerprints of long texts recover any difference, also where the other text is short, and no script is left uncut."""
    random.seed(6)
    texts = ["".join(random.choices(alphabet, k=n)) for alphabet in ("abcdefgh ij", "\u0430\u0431\u0432\u0433", "\u4e00\u4e01\u4e02\u4e03") for n in (0, 5, 300, 3000, 40_000)]
    texts += [texts[4][:20_000] + texts[9][:9000] + texts[4][20_000:], texts[4][100:]]
    found = iblt.digests(texts)
    cells, prints = iblt.sizes_and_prints(*found)
    sets = [set(found[0][a:b].tolist()) for a, b in zip(found[1], found[1][1:])]
    assert all(len(sets[k]) > 100 for k in (4, 9, 14)) and (cells[[4, 9, 14]] > 100).all() and cells[0] == iblt.CELLS
    for i in range(len(texts)):
        for j in range(0, len(texts), 3):
            assert iblt.likeness_of(prints[i], prints[j]) == (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0)
    assert iblt.likeness_of(prints[4], prints[15]) > 0.7 and iblt.likeness_of(prints[4], prints[16]) > 0.9
