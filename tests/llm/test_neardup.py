import itertools
import random

import pytest

from quillmill.llm import neardup
from quillmill.tables import table


def texts(seed=1, bases=12):
    """Texts with copies, small edits, reorderings, quotations and unrelated ones."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ve", "so") for b in ("ra", "nel", "dos", "pim", "tek", "bul", "fa", "gor")]
    out = {}
    for b in range(bases):
        own = r.choices(words, k=r.randint(45, 220)) if b % 4 else [f"{w}{b}" for w in r.choices(words, k=120)]
        out[f"{b:02}-0"] = " ".join(own).capitalize() + "."
        out[f"{b:02}-1"] = " ".join(own).upper()
        edited = list(own)
        for _ in range(len(own) // 25):
            edited[r.randrange(len(own))] = r.choice(words)
        out[f"{b:02}-2"] = ", ".join(edited)
        cut = len(own) // 2
        out[f"{b:02}-3"] = " ".join(own[cut:] + own[:cut])
        out[f"{b:02}-4"] = " ".join(own[: len(own) // 4] + r.choices(words, k=len(own)))
    out |= {"short-1": "too short", "short-2": "too short", "empty": "", "blank": "  "}
    return out


def model(docs, threshold=0.5):
    sets = {}
    for i, t in docs.items():
        w = neardup._WORD.findall((t or "").lower())
        if len(w) >= 40:
            sets[i] = set(zip(w, w[1:], w[2:]))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if root(a) == root(b)}


def pairs(df):
    return {(r["id_a"], r["id_b"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_all_pairs(spark, seed):
    docs = texts(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [("null", None, "x"), ("00-0", docs["00-0"], "x")], "id string, content string, label string")
    assert pairs(neardup.group_pairs(neardup.text_groups(df))) == model(docs)


def test_wide_columns_and_hot_copies(spark):
    r = random.Random(3)
    notice = " ".join(r.choices([f"n{i}" for i in range(300)], k=60))
    docs = {f"c{i:03}": notice for i in range(120)}  # exact copies
    docs |= {f"e{i:03}": notice + f" ending{i}" for i in range(120)}  # one word added
    docs |= {f"o{i:03}": " ".join([f"own{i}x{j}" for j in range(150)]) + " " + notice for i in range(80)}  # the notice within other texts
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    groups = {}
    for row in neardup.text_groups(df).collect():
        groups.setdefault(row["label"], set()).add(row["id"])
    assert list(groups.values()) == [{i for i in docs if i[0] in "ce"}]


@pytest.mark.parametrize("members", [65, 700])
def test_large_families_edited_at_random(spark, members):
    r = random.Random(members)
    base = [f"w{i}" for i in range(240)]
    docs = {}
    for m in range(members):
        own = list(base)
        for i in r.sample(range(len(own)), r.randint(4, 13)):
            own[i] = f"x{m}y{i}"
        docs[f"m{m:04}"] = " ".join(own)
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    got = {row["id"]: row["label"] for row in neardup.text_groups(df).collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]} == model(docs)


def test_large_title_families(spark):
    r = random.Random(5)
    base = "The Remarkable Journey of Penelope Through Abandoned Lighthouses"
    letters = [i for i, c in enumerate(base) if c.islower() and i > 4]
    titles = {("m%03d" % m): "".join(r.choice("bcdfgz") if i in chosen else c for i, c in enumerate(base)) for m in range(300) for chosen in [r.sample(letters, 1 + m % 2)]}
    df = spark.createDataFrame(list(titles.items()), "id string, title string")
    assert {row["label"] for row in neardup.title_groups(df).collect()} == {"m000"} and neardup.title_groups(df).count() == 300


def test_empty(spark):
    none = spark.createDataFrame([], "id string, content string, title string")
    assert neardup.text_groups(none).count() == 0 and neardup.title_groups(none).count() == 0


TITLES = {
    "a1": "The Dog of Dragregro, or Flebra the Velvety", "a2": "Dog of Dragregro, or Flebra the Velvety, The", "a3": "the dog from dragregro; or, flébra the velvetty (Illustratd)", "a4": "THE DOG OF DRAGREGRO, OR FLEBRA THE VELVETY: A New Edition.",
    "a5": "The Dgo of Dragergro, or Fllebra the Velvty", "b1": "The Dog of Dragregro, or Flebra the Velvety, Book 2", "b2": "The Dog of Dragregro, or Flebra the Velvety: Volume 2", "c1": "Kada's Bad Hen: A Tale of Drabuvi", "c2": "Rama's Bad Bed: A Tale of Graguchi",
    "d1": "Thin Nut from Jumima & Groplu, The", "d2": "The Thin Nut of Jumima and Groplu", "e1": "", "e2": "   ", "f1": "The Dog of Dragregro, or Flebra the Velvety 3", "g1": "Haba's Hollow Cat: A Tale of Memoza", "g2": "Pala's Hollow Hat: A Tale of Perofla",
}


def test_titles(spark):
    df = spark.createDataFrame([*TITLES.items(), ("n", None), ("a1", TITLES["a1"])], "id string, title string")
    groups = {}
    for row in neardup.title_groups(df).collect():
        groups.setdefault(row["label"], set()).add(row["id"])
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3", "a4", "a5"], ["b1", "b2"], ["d1", "d2"]]


def test_letter_edits():
    assert [neardup.letter_edits(*p) for p in (("quilt", "quuilt"), ("scrupulous", "scrupuluos"), ("parcel", "parcl"), ("hen", "bed"), ("", "ab"))] == [1, 1, 1, 2, 2]


def test_components(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y")]
    rows = neardup.components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r["label"] for r in rows} == {"000", "x"} and len(rows) == 63


def test_query(spark, data):
    out = neardup.found(table(spark, data, "chapters"), table(spark, data, "books"))
    rows = out.collect()
    assert out.columns == ["field", "id_a", "id_b"] and len(rows) == len(set(rows)) and all(r["id_a"] < r["id_b"] for r in rows)
    docs = {r["id"]: r["content"] for r in table(spark, data, "chapters").collect()}
    assert {(r["id_a"], r["id_b"]) for r in rows if r["field"] == "content"} == model(docs)


def test_nothing_in_wide_columns_is_left_out(spark):
    """Members just under and over the threshold, most of them alike to a few others and to no hub."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs = {f"m{m:04}": " ".join(f"x{m}y{i}" if i in own else w for i, w in enumerate(base)) for m in range(500) for own in [set(r.sample(range(120), 12))]}
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    full = {row["id"]: row["label"] for row in neardup.text_groups(df, wide=None).collect()}
    for wide, hubs in ((64, 12), (8, 1)):
        assert {row["id"]: row["label"] for row in neardup.text_groups(df, wide=wide, hubs=hubs).collect()} == full


def test_titles_without_a_hub(spark):
    """Pairs of titles that share all their columns with each other and single ones with many."""
    r = random.Random(12)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(6)) for _ in range(150)]
    titles = {f"{n:03}{s}": f"The Wonderful Adventures of Captain {name[:i] + 'q' + name[i + 1 :] if s else name}" for n, name in enumerate(names) for s in (0, 1) for i in [r.randrange(1, 11)]}
    df = spark.createDataFrame(list(titles.items()), "id string, title string")
    got = {row["id"]: row["label"] for row in neardup.title_groups(df).collect()}
    assert got == {row["id"]: row["label"] for row in neardup.title_groups(df, wide=None).collect()} and all(got[f"{n:03}0"] == got[f"{n:03}1"] for n in range(150))


def test_spread_columns(spark, monkeypatch):
    """Columns so popular that they are divided over tasks give the same groups."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(90)]
    docs = {f"m{m:04}": " ".join(f"x{m}y{i}" if i in own else w for i, w in enumerate(base)) for m in range(300) for own in [set(r.sample(range(90), 9))]}
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    full = {row["id"]: row["label"] for row in neardup.text_groups(df, wide=None).collect()}
    monkeypatch.setattr(neardup, "SKEWED", 40)
    assert {row["id"]: row["label"] for row in neardup.text_groups(df, wide=16, hubs=1).collect()} == full


def test_words_of_many_texts_at_once():
    docs = ["", " ", "İstanbul ΑΣ ΟΔΟΣ_x 12", "日本語 a\x00b \U0001f600c", *texts(4).values(), "x" * 300_000 + " ka", "Ka"]
    words = [neardup._WORD.findall(t.lower()) for t in docs]
    hashes = [h.tolist() for h in neardup._Hashes().of(docs)]
    assert [len(h) for h in hashes] == [len(w) for w in words]
    known = dict(zip((w for ws in words for w in ws), (h for hs in hashes for h in hs)))
    assert [[known[w] for w in ws] for ws in words] == hashes and len(set(known.values())) == len(known)


def block_rows(sizes, marks, edits=None):
    """Rows of one column with no columns behind it."""
    import numpy as np
    import pyarrow as pa

    heads = [np.int64(i).tobytes() + np.int32(n).tobytes() + np.array([1, 1], np.uint16).tobytes() for i, n in enumerate(sizes)]
    return neardup._Rows(pa.array(heads, pa.binary()), np.zeros(len(sizes), np.int64), None, pa.array(marks, pa.binary()), edits)


def test_marks_rule_out_no_pair():
    """Every pair of half the sequences in common stays, most others go; sizes on either side of a power of two."""
    import numpy as np

    r = np.random.default_rng(6)
    shared = r.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared[:k], r.integers(0, 2**63, n - k).astype(np.uint64)])) for n in (70, 127, 129, 250, 600, 1030, 5000) for k in (0, n // 3, n // 2, 2 * n // 3, n * 9 // 10) if k <= 4000]
    rows = block_rows([len(s) for s in sets], [neardup._mark(s, len(s)) if i % 9 else None for i, s in enumerate(sets)])
    p, q = (np.array(x) for x in zip(*itertools.combinations(range(len(sets)), 2)))
    sure = np.array([neardup.jaccard(sets[a], sets[b]) >= 0.5 for a, b in zip(p, q)])
    possible = rows.possible(p, q, 0.5)
    marked = (p % 9 > 0) & (q % 9 > 0)
    comparable = marked & (np.minimum(rows.size[p], rows.size[q]) * 2 >= np.maximum(rows.size[p], rows.size[q]))
    assert sure.any() and possible[sure].all() and possible[~marked].all()
    assert possible[comparable & ~sure].mean() < 0.5


def test_letters_rule_out_no_title():
    import numpy as np

    keys = ["thinnutofjumimaandgroplu", "thinnutofjumimandgrolpu", "thnnutofjumiimaandgropla", "häßλ日本語", "haßλ日本", "halespellnoughtzaphod", ""]
    rows = block_rows([len(k) for k in keys], [k.encode() for k in keys], 4)
    p, q = (np.array(x) for x in zip(*itertools.combinations(range(len(keys)), 2)))
    possible = dict(zip(zip(p.tolist(), q.tolist()), rows.possible(p, q, 0.6).tolist()))
    assert {x for x, good in possible.items() if good} == {(0, 1), (0, 2), (1, 2), (3, 4), (3, 6), (4, 6)}


def products(monkeypatch):
    """Of every product: its rows and what came out."""
    seen, real = [], neardup._product
    monkeypatch.setattr(neardup, "_product", lambda rows, *a: seen.append((rows, real(rows, *a))) or seen[-1][1])
    return seen


def test_alike_titles_of_other_works_are_ruled_out_early(spark, monkeypatch):
    """Titles that share half of their letters in place, but for their names."""
    r = random.Random(14)
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(5))
    titles = {f"t{i:03}": f"{name().title()}'s Hollow Cat: A Tale of {name().title()}" for i in range(200)}
    seen = products(monkeypatch)
    assert neardup.title_groups(spark.createDataFrame(list(titles.items()), "id string, title string")).count() == 0
    assert len(seen) == 2 and seen[1][1].filter("kind = 0").select("x", "y").distinct().count() < 200 * 199 // 2 // 4


def test_texts_are_not_read_again_for_the_full_product(spark, data, monkeypatch):
    seen = products(monkeypatch)
    neardup.text_groups(table(spark, data, "chapters"), wide=1, hubs=1).count()
    assert len(seen) == 2 and not any(rows.inputFiles() for rows, _ in seen)
