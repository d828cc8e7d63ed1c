"""The whole join against brute force: near copies at, above and below the bound, ties, repeated rows, large groups."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import jaccard


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    union = jaccard._Union(len(rows))
    by_token = {}
    for i, s in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in by_token[t] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                union.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = union.find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(union.find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def made_rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    rows, i = [], 0
    for n in (9, 13, 14, 40, 104, 204):  # sets of n - 4 shingles
        base = [word() for _ in range(n)]
        for cut in range(0, min(n, 60), 1 + n // 14):  # the first words go: an intersection of n - 4 - cut of n - 4
            rows.append((i := i + 1, " ".join(base[cut:])))
        rows.append((i := i + 1, " ".join(base).upper()))
        rows.append((i := i + 1, "\t".join(base) + " "))
    chain = [word() for _ in range(400)]  # each link is near, the ends are far
    rows += [(1000 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(30)]
    rows += [(2000 + k, " ".join(chain[:60] + [word()])) for k in range(40)]
    common = "this line stands in every text of them all"
    rows += [(3000 + k, common + " " + " ".join(word() for _ in range(5))) for k in range(60)]
    rows += [(4000, "a b"), (4001, "A  B"), (4002, "a"), (4003, ""), (4004, None), (4005, " \n"), (None, "a b"), (None, None), (None, " ".join(chain[:100])), (7, "a b c d e f"), (7, "a b c d e f"), (7, "x")]
    return rows


@pytest.mark.parametrize("group_bytes", [jaccard.GROUP_BYTES, 3000])
def test_join_equals_brute_force(spark, group_bytes):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, group_bytes=group_bytes).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_join_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = jaccard.jaccard_components(docs).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute_components([tuple(r) for r in docs.collect()])


def test_one_of_each_stays_whatever_the_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (None, "a b c d e f", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tw_gone string").withColumn("h", F.lit(1)).withColumn("d", F.lit(2))
    left = jaccard.first_of_each(docs)
    assert left.columns == docs.columns and sorted(r["_tw_gone"] for r in left.collect()) == ["n", "x", "z"]


def family_rows(families=30):
    """Families of four near copies; one of each has five words in common with one of the next, by chance."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    chance = [[word() for _ in range(5)] for _ in range(families + 1)]
    rows = []
    for f in range(families):
        base = [word() for _ in range(80)]
        made = [base[:30] + chance[f] + [word()] + base[30:], base[:60] + chance[f + 1] + [word()] + base[60:], base, base[1:]]
        rows += [(10 * f + k, " ".join(x)) for k, x in enumerate(made)]
    return rows


def test_words_in_common_by_chance_join_no_groups(spark, monkeypatch):
    seen, old = [], jaccard._components

    def spied(sets, groups, most):
        seen.append(groups.groupBy("root").count().agg(F.max("count")).first()[0])
        return old(sets, groups, most)

    monkeypatch.setattr(jaccard, "_components", spied)
    rows = family_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert seen[0] <= 8


def test_linked_sets_have_a_signature_in_common():
    r = np.random.default_rng(3)
    pairs = 0
    for n in [*range(4, 60), 100, 500, 2000] * 8:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[r.permutation(a)[r.integers(0, n // 5 + 1) :], r.integers(0, 1 << 63, r.integers(0, n // 4 + 1), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if both == len(a) == len(b) or not jaccard.linked(both, len(a), len(b)):
            continue
        sketch = np.bincount(jaccard._slot(np.r_[a, b]), minlength=jaccard.SKETCH)
        sketch[jaccard._slot(a[: n // 3])] += 5000  # some are frequent elsewhere
        total = int(sketch.sum())
        pairs += 1
        assert np.intersect1d(jaccard.signatures(a, sketch, total), jaccard.signatures(b, sketch, total)).size
    assert pairs > 100


def test_blocks_of_a_large_group_travel_in_rounds(spark, monkeypatch):
    sent, old = [], jaccard.by_key

    def spied(df, key, work, *rest):
        if work is jaccard._resolve:
            sent.append(df.agg(F.sum(F.length("tokens"))).first()[0] or 0)
        return old(df, key, work, *rest)

    monkeypatch.setattr(jaccard, "by_key", spied)
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(120)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=16_000).drop("text_hash").collect()
    held = 120 * 196 * 8
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert sum(sent) > 5 * held and max(sent) < 4 * held
