"""Stages of the corpus pipeline against brute force, with planted near copies, bad documents, null and repeated ids."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from foliolens.llm import near_copies

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute_groups(texts):
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if similar(texts[a], texts[b]):
            root[top(a)] = top(b)
    return [top(k) for k in range(len(texts))]


@pytest.mark.parametrize("crowded", [near_copies.CROWDED, 3])
def test_near_dedup_stage_matches_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    rng = random.Random(11)
    bases = [text_of(rng, rng.randrange(60, 300)) for _ in range(25)]
    texts = [edited(rng, b, rng.randrange(0, 1 + len(b.split()) // 25)) for b in bases for _ in range(6)]
    texts += [edited(rng, bases[0], 2) for _ in range(20)] + [None, "", " ", "one two", "One  two", "one three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    groups = brute_groups(texts)
    linked = [1 for a, b in combinations(range(len(texts)), 2) if texts[a] != texts[b] and similar(texts[a], texts[b])]
    assert len(linked) > 50 and 25 < len(set(groups)) < len(texts) - 50
    want = sorted({g: k for k, g in reversed(list(enumerate(groups)))}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").collect() == []


def test_near_dedup_leaves_out_pairs_that_folded_sketches_rule_out(spark, monkeypatch):
    word = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    texts = []
    for k in range(30):  # pairs that share a passage, too short for a similarity of 0.8
        both = word(f"s{k}", 20)
        texts += [" ".join(both + word(f"a{k}", 40)), " ".join(both + word(f"b{k}", 40))]
    near = word("n", 100)
    texts += [" ".join(near), " ".join([*near[:-1], "other"])]
    made, pairs = [], near_copies._pairs

    def counted(*args, **more):
        made.append(out := pairs(*args, **more))
        made[-1] = out.count()
        return out

    monkeypatch.setattr(near_copies, "_pairs", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.survivors(docs).orderBy("doc_id").collect()] == list(range(61))
    assert made and sum(made) <= 12  # at most each key of the one similar pair


def test_near_dedup_stage_keeps_rows_whose_ids_clash(spark):
    rng = random.Random(12)
    x, y, z, w = (text_of(rng, 120) for _ in range(4))
    rows = [(3, y, "a"), (5, x, "b"), (5, edited(rng, y, 2), "c"), (None, z, "d"), (None, w, "e"), (None, edited(rng, z, 2), "f"), (None, text_of(rng, 80), "g"), (7, text_of(rng, 80), "h"), (7, text_of(rng, 80), "i"), (8, x, "j"), (8, x, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = sorted(r.lang for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert out in (list("abdeghi"), list("abefghi"))  # c copies a, j copies b; of d and f one stays
    same = spark.createDataFrame([(1, x, "j")] * 3, "doc_id long, text string, lang string")
    assert corpus_pipeline.near_dedup_stage(spark, same, "").count() == 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose, bad documents that the base rule rejects, and unlabelled ones like them that it lets through."""
    rng = random.Random(13)
    junk = lambda n: " ".join("".join(rng.choice("#$%XQZ0189") for _ in range(7)) for _ in range(n))
    docs = [(k, text_of(rng, rng.randrange(60, 200)), "good") for k in range(150)]
    docs += [(k, junk(rng.randrange(20, 49)), "short") for k in range(150, 250)]
    docs += [(k, junk(rng.randrange(60, 120)), "missed") for k in range(250, 290)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(kind == "good"), 0) for k, _, kind in docs if kind != "missed"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join(docs[0][1].split(" ")[5:45])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_classifier_stage_rejects_what_rules_let_through(spark, corpus):
    kept = corpus_pipeline.quality_rules_stage(spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus)
    before = [r.source for r in kept.collect()]
    assert before.count("missed") == 40 and before.count("short") == 0 and before.count("good") == 150
    after = [r.source for r in corpus_pipeline.quality_classifier_stage(spark, kept, corpus).collect()]
    assert after.count("missed") <= 2 and after.count("good") >= 140


def test_run_matches_its_stages_by_brute_force(spark, corpus):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    good = set(range(1, 150))  # 0 holds the benchmark item
    assert 0 not in out and len(out.keys() & good) >= 140 and not out.keys() & set(range(150, 250)) and len(out.keys() - good) <= 2
    assert all(r.n_ids == len(r.ids) > 0 for r in out.values())
