import random
from collections import Counter

import pytest

pytest.importorskip("tiktoken")
from retromill.llm.packing import pack, plan  # noqa: E402
from retromill.llm.queries import QUERIES  # noqa: E402
from retromill.llm.queries import VOCABULARY  # noqa: E402
from retromill.llm.tokens import count_tokens  # noqa: E402


def check(rows, sizes, capacity):
    fill, pieces = Counter(), {}
    for item, piece, n, box in rows:
        fill[box] += n
        pieces.setdefault(item, {})[piece] = n
    assert max(fill.values(), default=0) <= capacity
    want = Counter(k for k, n in sizes if n and n > 0)
    assert set(pieces) == set(want)
    for item, n in sizes:
        if n and n > 0:
            cut = [pieces[item][i] for i in sorted(pieces[item])]
            assert sum(cut) == n and (len(cut) == 1 if n <= capacity else cut[:-1] == [capacity] * (len(cut) - 1))
    return len(fill)


def test_plan_uses_every_item():
    rng = random.Random(1)
    for capacity, n in ((10, 30), (100, 400), (2048, 3000)):
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(n))
        steps = plan(counts, capacity)
        used = Counter()
        for times, combo in steps:
            assert sum(combo) <= capacity and times > 0
            for x in combo:
                used[x] += times
        assert used == counts and len(steps) <= len(counts)
        boxes = sum(t for t, _ in steps)
        least = max(-(-sum(k * c for k, c in counts.items()) // capacity), sum(c for k, c in counts.items() if 2 * k > capacity))
        assert boxes <= 1.02 * least + 2


def test_exact_complements_are_found():
    assert sorted(plan({6: 1, 4: 1, 5: 2, 7: 1, 2: 1, 1: 1, 10: 1}, 10)) == sorted([(1, (10,)), (1, (6, 4)), (1, (5, 5)), (1, (7, 2, 1))])


def test_containers(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([7, 7, 7, rng.randrange(1, 60), rng.randrange(100, 450)])) for i in range(500)] + [(900, 0), (901, None), (902, 300), (903, 100), (None, 50)]
    df = spark.createDataFrame([(*r, "a", 1) for r in sizes], "doc long, size long, part string, n int")
    rows = [tuple(r) for r in pack(df, "doc", "size", 100).select("doc", "piece", "n_tokens", "container_id").collect()]
    boxes = check(rows, sizes, 100)
    assert boxes <= -(-sum(n or 0 for _, n in sizes) // 100) + 2
    assert pack(df.where("false"), "doc", "size", 100).collect() == []


def test_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [tuple(r) for r in count_tokens(docs, "doc_id", vocabulary=VOCABULARY[1]).collect()]
    rows = [tuple(r) for r in QUERIES["p7_containers"](spark, sf).select("doc_id", "piece", "n_tokens", "container_id").collect()]
    boxes = check(rows, sizes, 2048)
    assert boxes <= 1.02 * -(-sum(n for _, n in sizes) // 2048) + 1


def test_tokens_are_those_of_the_whole_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY[1].replace(".tiktoken", ".json"))
    texts = ["", None, "def f(x):\n    return x + 1  # äöü €\n", "a" * 5000, "<|endoftext|> x", "\r\n\t 12345 'll 中文" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t.encode_special_tokens = True
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", vocabulary=VOCABULARY[1]).collect()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
