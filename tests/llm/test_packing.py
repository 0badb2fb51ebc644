import random
from collections import Counter, defaultdict

import pytest

from strandloom.llm import packing


def filled(rows, capacity):
    used = defaultdict(int)
    for r in rows:
        used[r["container_id"]] += r["n_tokens"]
    assert all(0 < u <= capacity for u in used.values())
    assert set(used) == set(range(len(used)))
    return used


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_item_once_and_fit(seed):
    rng = random.Random(seed)
    histogram = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1)))) for _ in range(5000))
    patterns = packing.pack_lengths(histogram)
    assert Counter({k: v for lengths, n in patterns for k, v in Counter({x: c * n for x, c in Counter(lengths).items()}).items()}) != {}
    seen = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 4096
        for x in lengths:
            seen[x] += n
    assert seen == histogram
    used = sum(k * v for k, v in histogram.items()) / (4096 * sum(n for _, n in patterns))
    assert used > 0.9 and len(patterns) <= 2 * 4096


def test_documents_get_one_place_each(spark):
    rng = random.Random(7)
    sizes = [rng.choice([10, 10, 10, rng.randrange(1, 100), rng.randrange(1, 400)]) for _ in range(3000)] + [None, 0, 100, 101, 250]
    df = spark.createDataFrame([(i, n, "z") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, size string")
    rows = packing.pack(df, 100).collect()
    filled(rows, 100)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
    for i, n in enumerate(sizes):
        got = sorted(pieces.get(i, []))
        assert sum(p[2] for p in got) == (n or 0)
        assert (len(got) == 1) == (0 < (n or 0) <= 100)
        assert [p[1] for p in got] == [100 * k for k in range(len(got))]
    again = {(r["doc_id"], r["piece"]): r["container_id"] for r in packing.pack(df.repartition(5), 100).collect()}
    assert again == {(r["doc_id"], r["piece"]): r["container_id"] for r in rows}


def test_a_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    df = spark.createDataFrame([(i, 60 if i % 3 else 500) for i in range(900)], "doc_id long, n_tokens long")
    rows = packing.pack(df, 100).collect()
    used = filled(rows, 100)
    assert len(rows) == 600 + 300 * 5 and sum(used.values()) == 600 * 60 + 300 * 500
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and len(used) == 600 + 300 * 5


def test_little_unused_space_on_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(packing.token_counts(documents)).collect()
    used = filled(rows, 4096)
    assert sum(used.values()) / (4096 * len(used)) > 0.9


def test_token_counts_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "ab " * 200000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] is None and got[2] == 0 and got[3] == 1 and got[4] >= 200000 and got[5] > 1
    assert packing.pack(packing.token_counts(df.limit(0))).count() == 0


def test_two_vocabularies_name_the_same_split_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    lists = [{r["doc_id"] for r in packing.token_counts(documents, f"/opt/tokenizers/{v}").filter("n_tokens > 4096").collect()} for v in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
    assert lists[0] == lists[1]
