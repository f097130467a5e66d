import random

import numpy as np

from retromill.llm.subjects import BUCKETS, subject_areas, term_counts

WORDS = {"cooking": "oven flour knead simmer garnish whisk broth pastry saucepan recipe", "sailing": "jib halyard mast tiller keel harbour rudder anchor spinnaker buoy", "law": "court clause tribunal statute appeal notary verdict counsel hearing plea"}
PLAIN = "def return for in if else row value count list total item get set data name".split()


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        k = rng.choice([0, 1, 1, 1, 2])
        about = rng.sample(sorted(WORDS), k)
        words = rng.choices(PLAIN, k=40)
        for s in about:
            words += rng.choices(WORDS[s].split(), k=12)
        if about and rng.random() < 0.2:
            words.append(rng.choice(WORDS[rng.choice(sorted(WORDS))].split()))
        rng.shuffle(words)
        docs.append((i, "".join(w.title() if rng.random() < 0.3 else "_" + w + " " for w in words)))
        truth += [(i, s) for s in about]
    return docs, truth


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, subject string, terms int").repartition(3)
    s = spark.createDataFrame([(k, None, 1) for k in WORDS] + [(None, "x", 1), ("Unused", None, 1)], "subject string, descr string, i int")
    l = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, subject string, text string")
    return [tuple(r) for r in subject_areas(d, s, l).collect()]


def test_held_out_documents(spark):
    docs, truth = corpus(600, 1)
    labels = [(i, s.upper() + " ") for i, s in truth if i < 120] + [(1, None), (None, "law"), (7777, "law"), (3, "nonsense")]
    labels += [(i, "law") for i in range(0, 120, 25)] + labels[:9]  # some wrong, some repeated
    got = run(spark, docs + [(None, "court"), (900, None), (901, ""), (902, "é" * 3000)], labels)
    held = {x for x in truth if x[0] >= 120}
    mine = {x for x in got if x[0] >= 120}
    assert len(got) == len(set(got)) and not {900, 901, 902} & {i for i, _ in got}
    assert len(mine & held) > 0.97 * len(held) and len(mine & held) > 0.97 * len(mine)


def test_nothing_to_learn_from(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "court clause"), (2, None)], []) == []


def test_words_are_cut_at_case_and_string_ends():
    texts = ["fooBar HTTPServer x foo_bar", "Bar", "", "straße2go"]
    raw = "".join(texts).encode()
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    doc, bucket, times = term_counts(np.frombuffer(raw, np.uint8), off)
    by = lambda i: sorted(times[doc == i])
    assert by(0) == [1, 1, 2, 2] and by(1) == [1] and by(2) == [] and by(3) == [1, 1]
    assert set(bucket[doc == 1]) <= set(bucket[doc == 0]) and bucket.max() < BUCKETS
