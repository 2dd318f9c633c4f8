"""The near-dedup stage against brute force over all pairs."""

import random

import pytest

from factloom.llm import nearcopies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_kept(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and label[a] != label[b] and (sets[a] == sets[b] or both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4):
                x, y = sorted((label[a], label[b]))
                label = {i: x if k == y else k for i, k in label.items()}
    return {i for i, k in label.items() if i == k}


@pytest.mark.parametrize("part", [256, 7])
def test_near_copies(spark, part, monkeypatch):
    monkeypatch.setattr(nearcopies, "PART", part)
    monkeypatch.setattr(nearcopies, "HUB", part // 2)
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(2000)]
    rows = [(1, "one two"), (2, "ONE  two"), (3, "one three"), (4, ""), (5, None), (6, " \n")]
    for _ in range(25):  # copies with changed words, in all degrees
        base = random.choices(vocabulary, k=random.randint(8, 200))
        for _ in range(6):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(w)))
    line = random.choices(vocabulary, k=300)
    for k in range(40):  # a chain: neighbours are alike, its ends are not
        rows.append((len(rows) + 1, " ".join(line[3 * k : 3 * k + 60])))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in nearcopies.keep_one(docs).collect()}
    assert set(got) == brute_kept(rows) and all(got[i] == dict(rows)[i] for i in got)
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_stage_drops_a_near_copy(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"word{i}" for i in range(120)]
    other = words[:20] + ["changed"] + words[21:70] + ["another"] + words[71:]  # 8 bits of a SimHash of three words
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in ((1, words), (2, other), (3, words[:60]))], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_stage_links_fingerprints_too(spark, tmp_path):
    """Texts that five-word sets tell apart but fingerprints of three words don't, and a third that only such a set links to one of them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from factloom.llm import simhash

    line = " ".join(f"w{i}" for i in range(40))
    twice = " ".join([line] * 60)
    mixed = twice + " " + " ".join(f"x{i}" for i in range(12))  # few of its shingles, but a quarter of its distinct ones
    near = mixed + " more"
    a, b = simhash.fingerprints([twice, mixed]).tolist()
    assert (a ^ b).bit_count() <= 2
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ((1, twice), (2, mixed), (3, near), (4, "another text"))], SCHEMA)
    assert {r.doc_id for r in nearcopies.keep_one(docs).collect()} == {1, 2, 4}
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()} == {1, 4}
