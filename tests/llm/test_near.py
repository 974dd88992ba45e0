"""The pipeline's near-duplicates against brute force over whole shingle sets."""

import random

import corpus_pipeline
from tests.llm.test_pairs import find_components


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([60, 150, 400]))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 9, 14):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[3], "one two", "One\n two", "one two three", "", None, " \n"]
    rng.shuffle(texts)
    sets = [five_words(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    assert sum(texts[i] != texts[j] for i, j in pairs) > 100
    roots = find_components(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [i for i, r in enumerate(roots) if r == i]


def test_a_chain_of_edits_is_one_group(spark):
    """Neighbours are similar and the ends aren't; more members than a row proposes at first."""
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(30):
        texts.append(" ".join(words))
        words[k * 6] = f"changed{k}"
    ends = five_words(texts[0]), five_words(texts[-1])
    assert not similar(*ends) and all(similar(five_words(a), five_words(b)) for a, b in zip(texts, texts[1:], strict=False))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
