import base64
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import packing, tokens

VOCABULARY = tokens.DEFAULT_VOCABULARY
#: Pattern of the public vocabulary, for the reference encoder of the test.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_vocabulary(VOCABULARY))


def ids(encoder, texts):
    flat, ends = encoder.encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevlmdDS  \n\t\r  　é中ไม่.,!?12½ ́’🙂\x85\x1c​<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_agrees_with_reference(reference, encoder, texts):
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_special_and_long(reference, encoder):
    texts = ["<|endoftext|>", "a" * 5000, " " * 999, "é" * 2000, "x's 're y'll", "'s", "", None, "word " * 9000]
    assert ids(encoder, texts) == [reference.encode_ordinary(t or "") for t in texts]
    noise = "".join(random.Random(1).choice("abcdeé") for _ in range(3000))
    assert encoder._merge_long(noise.encode()) == encoder._merge_short(noise.encode())


def test_encode_rows(spark, reference):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "naïve 中文", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a clashing name
    out = tokens.encode(df, offsets=True)
    got = sorted((r["id"], r["ids"], r["byte_starts"]) for r in out.collect())
    assert [(i, x) for i, x, _ in got] == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    for i, x, starts in got:
        data = (dict((r[0], r[1]) for r in rows)[i] or "").encode()
        cuts = [*starts, len(data)]
        assert [data[a:b] for a, b in zip(cuts, cuts[1:])] == [reference.decode_single_token_bytes(t) for t in x]
    assert {r["id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}[2] == 0
    assert tokens.encode(df.limit(0)).count() == 0


def best_fit(histogram, capacity):
    """Item by item: into the fullest container with room."""
    room = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60), st.data())
def test_plan_equals_item_by_item(capacity, data):
    histogram = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 40), max_size=25))
    plan = packing.best_fit_plan(histogram, capacity)
    load, placed = Counter(), Counter()
    for s in plan:
        for r in range(s.first_rank, s.last_rank + 1):
            load[s.first_container + (r - s.first_rank) // s.per] += s.length
            placed[s.length, r] += 1
    assert placed == Counter({(n, r): 1 for n, k in histogram.items() for r in range(k)})
    assert all(v <= capacity for v in load.values()) and len(load) == best_fit(histogram, capacity)


def test_pack_documents(spark):
    sizes = [(i, n) for i, n in enumerate([5, 5, 5, 12, 7, 3, 0, 10, 31, 2, 2, 2] + [4] * 40)]
    df = spark.createDataFrame(sizes, "id bigint, n_tokens int")
    rows = packing.pack(df, 10).collect()
    load, own = Counter(), Counter()
    for r in rows:
        load[r["container_id"]] += r["n_tokens"]
        own[r["id"]] += r["n_tokens"]
    assert dict(own) == {i: n for i, n in sizes if n} and max(load.values()) <= 10
    assert sorted(load) == list(range(len(load)))
    divided = {r["id"] for r in rows if r["piece_no"] > 0 or sum(x["id"] == r["id"] for x in rows) > 1}
    assert divided == {i for i, n in sizes if n > 10}
    assert packing.pack(df.limit(0), 10).count() == 0


def test_packed_query(spark, data):
    from quillmill.tables import table

    documents = table(spark, data, "documents")
    out = packing.packed_documents(spark, documents).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 2048
    assert set(out.doc_id) == {r["doc_id"] for r in documents.filter("length(text) > 0").collect()}
    starts = out.sort_values(["doc_id", "piece_no"]).groupby("doc_id")
    assert (starts.token_start.first() == 0).all()
    assert np.isclose(out.n_tokens.sum(), sum(r["n_tokens"] for r in tokens.token_counts(documents).collect()))
