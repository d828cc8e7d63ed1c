import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import bpe, components, fingerprints, jaccard, lines, mixing, pii, quality, suffixes, topk, urls


def test_edge_rows(spark, edge_docs, empty_docs):
    """Every operator gives each row a result, keeps other columns, and takes an empty table."""
    n = edge_docs.count()
    runs = {
        "quality": lambda d: quality.classify(d),
        "bpe": lambda d: bpe.encode_documents(d, with_ids=False),
        "fingerprints": lambda d: fingerprints.fingerprint_documents(d),
        "lines": lambda d: lines.dedup_lines(d),
        "mixing": lambda d: mixing.mix_counts(d),
        "pii": lambda d: pii.find_pii(d),
        "suffixes": lambda d: suffixes.remove_repeats(d),
        "jaccard": lambda d: jaccard.jaccard_components(d),
    }
    got = {}
    for name, run in runs.items():
        out = run(edge_docs)
        got[name] = out.collect()
        assert len(got[name]) == n, name
        assert len(set(out.columns)) == len(out.columns), name
        if name not in ("fingerprints", "suffixes", "jaccard"):
            assert set(edge_docs.columns) <= set(out.columns), name
        assert run(empty_docs).count() == 0, name
    blank = {r["doc_id"]: r["keep"] for r in got["quality"]}
    assert not blank[3] and not blank[4] and not blank[6]
    assert {r["component_id"] for r in got["jaccard"] if r["doc_id"] in (1, 2)} == {1}
    assert [r["n_shingles"] for r in got["jaccard"] if r["doc_id"] in (3, 4, 6)] == [0, 0, 0]
    removed = {r["doc_id"]: r["n_removed"] for r in got["lines"]}
    assert removed[1] in (0, 4) and removed[2] == 4 and removed[8] == 4 and removed[9] == 0
    by_id = collections.defaultdict(set)
    for r in got["suffixes"]:
        by_id[r["doc_id"]].add(r["n_removed"])
    assert by_id[1] == {0} and len(by_id[2]) == 1 and by_id[2] != {0}
    assert len({r["fingerprint"] for r in got["fingerprints"] if r["doc_id"] in (1, 2)}) == 1
    assert all(r["copies"] <= 3 for r in got["mixing"])
    stay = jaccard.first_of_each(edge_docs).collect()
    assert sorted(r["doc_id"] for r in stay if r["doc_id"]) == [1, 3, 4, 5, 6, 8, 9] and mixing.mix(edge_docs).columns == edge_docs.columns


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    own, library, r = bpe.encoder(path), Tokenizer.from_file(path), random.Random(3)
    for _ in range(3000):
        letters = r.choice(["ab", "aeinrst ", "\n \t", "a'sd re", "01 2", "éüßaçñ", "日本 語a", "x   \x1c\x85　y", "ſK²½Ⅷ٣a"])
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 70))) + r.choice(["", "<|endoftext|>b"])
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == t == library.decode(ids, skip_special_tokens=False)


def test_url_rules_and_model(spark):
    cases = {
        "http://WWW.Example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://q.net/es/1?x#y": ("q.net", "/es/1", "net/es/", "block"),
        "http://x.com#a": ("x.com", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "http://notcom/": ("notcom", "/", None, None),
    }
    rows = urls.judge_urls(spark.createDataFrame([(u, 1) for u in cases], "url string, host int")).collect()
    for r in rows:
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ({verdict} if verdict else {"allow", "block"})
    weights = urls.fit(urls.labelled_urls()[::2])
    held = urls.labelled_urls()[1::2]
    right = [(urls.score(*urls._cut(u), weights) >= 0.5) == bool(y) for u, y in held]
    assert np.mean(right) > 0.75


def test_top_k_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-3, 3)) / 4 for _ in range(3)]) for i in range(130)] + [(131, None), (140, [float("nan"), 1.0, 1.0]), (141, [None, 1.0, 1.0]), (142, [1.0]), (None, [1.0, 1.0, 1.0])]
    got = collections.defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    good = {i: np.floor(64 * np.array(v)) for i, v in rows[:130]}
    for q in range(0, 130, 20):
        want = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    huge = np.array([[2.0**60, 1.0]])
    assert topk.products(huge, huge)[0, 0] == (1 << 63) - 1


def test_top_k_of_odd_rows(spark):
    docs = spark.createDataFrame([(20, [1.0], "q"), (20, [1.0], "q"), (5, [1.0], "r"), (5, [1.0], "r"), (6, [0.5], "s"), (7, None, "t"), (None, [1.0], "u"), (40, [], "v"), (8, [], "w")], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(docs).collect())
    assert got == [(20, 1, 5, 4096), (20, 2, 5, 4096), (20, 3, 6, 2048), (40, 1, 8, 0)]
    assert topk.top_k(docs.where("false")).count() == 0 and topk.top_k(docs.where("vec_id = 5")).count() == 0


def test_urls_of_odd_rows(spark):
    long = "http://a.com/" + "x" * 200_000
    rows = [(1, "http://a.net/fr/", "v"), (1, "http://a.net/fr/", "v"), (2, None, None), (3, "", "v"), (4, long, "v"), (None, "x://", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("verdict", F.lit(0)).withColumn("host", F.lit(1))
    got = urls.judge_urls(pages)
    assert len(set(got.columns)) == len(got.columns) and urls.judge_urls(pages.where("false")).count() == 0
    found = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in got.collect()]
    assert found.count((1, "a.net", "net/fr/", "block")) == 2 and (2, "", None) in [f[:3] for f in found] and {f[3] for f in found} <= {"allow", "block"} and len(found) == 6


def test_fingerprint_rows_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é")], "doc_id long, text string"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        own, other, next_ = fingerprints.fingerprints([t, changed, following])
        assert tuple(got[i])[:5] == (i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (fingerprints.likeness(own, other), fingerprints.likeness(own, next_))


def test_personal_data_rows_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "a" * 70 + "@b.de x at y dot com")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join("{}:{}:{}".format(*b) for b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) and len(r["spans"].split(",")) == len(base) + r["n_added"] or not r["spans"]


def test_lines_of_odd_rows(spark):
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x\n" + text), (None, "b\nc\nd"), (3, None)], "doc_id long, text string").withColumn("begins", F.lit(1)).withColumn("d", F.lit("k"))
    got = sorted(((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in lines.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(0, 0, "b\nc\nd"), (1, 3, "a"), (1, 3, "a"), (2, 4, "x"), (3, 0, None)], key=str)


def test_mixing_reaches_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 4 else None) for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix_counts(docs).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    taken, target, size = collections.Counter(), {}, {}
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    total = sum(size.values())
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    for s in target:
        assert abs(target[s] - total * weight[s] / 13) < 1e-6 and abs(taken[s] - target[s]) < 0.01 * target[s]
    one = spark.createDataFrame([("a", 1), ("b", 100)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.source_targets(one).collect()} == {"a": 3.0, "b": 98.0}


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"\D", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_personal_data():
    r = random.Random(5)
    for _ in range(5000):
        letters = r.choice(["a@.b", "1.2", "12 -", "+1 (2)-.3", "a@b.c@1.2.3.4.", "0123456789"])
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    trees, at = pii.model()
    t = "call 555-123-4567, card 12 4111111111111111, mail bob (at) example (dot) org, version 1.2.3"
    base = pii.base_spans(t)
    assert pii.redact(t, base + pii.added_spans(t, base, trees, at)) == "call [phone], card 12 [card], mail [email], version 1.2.3"
    rows = pii.training_spans(9, 600)
    p = trees.predict(np.array([pii.features(x, s) for x, s, _ in rows]))
    assert np.mean((p >= 0.5) == np.array([y for *_, y in rows])) > 0.9


def test_personal_data_in_many_groups_or_labels():
    trees, at = pii.model()
    for t, want in (
        ("call 5 5 5 1 2 3 4 5 6 7 today", "call [phone] today"),
        ("card 12 41 11 11 11 11 11 11 11", "card 12 [card]"),
        ("mail bob at mail dot a dot b dot c dot d dot example dot org now", "mail [email] now"),
        ("bob at home.com, page 1 2 3 4 5 6 7 8 9 10 11 12", "bob at home.com, page 1 2 3 4 5 6 7 8 9 10 11 12"),
    ):
        base = pii.base_spans(t)
        assert pii.redact(t, base + pii.added_spans(t, base, trees, at)) == want
    assert ("card", 0, 37) in set(pii.candidates(" ".join("4" * 19)))


def test_suffix_sort_and_removal(spark):
    r = random.Random(2)
    strings = np.array([[ord(r.choice("ab")) if k < 40 else ord(r.choice("abc")) for k in range(50)] for _ in range(60)], np.uint8)
    strings = np.concatenate([strings, strings[:20], np.repeat(strings[:1], 9, 0)])
    strings[60:75, 45:] = 99
    order = suffixes.deep_shallow(strings)
    assert [strings[i].tobytes() for i in order] == sorted(s.tobytes() for s in strings)
    words = ["alpha ", "beta ", "gamma ", "é", "delta-epsilon ", "zeta\n"]
    docs = [(i, "".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs += [(i, docs[i % 9][1][5:] + "tail" * (i % 5)) for i in range(40, 60)] + [(60, "a" * 400), (61, "b" + "a" * 300), (62, None)]
    first: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for row in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        b = (dict(docs)[row["doc_id"]] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < row["doc_id"]:
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (row["n_removed"], bytes(row["kept"]), row["kept_sha256"]) == (int(gone.sum()), kept, hashlib.sha256(kept).hexdigest())


def test_group_links_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = [rng.integers(0, 2**60, rng.integers(3, 60)).astype(np.uint64) for _ in range(2)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            b = base[rng.integers(2)].copy()
            m = rng.random(len(b)) < 0.2 * rng.random()
            b[m] = rng.integers(0, 50, m.sum())
            sets.append(np.unique(b))
        union = jaccard._Union(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    union.join(i, j)
        assert jaccard.link_group(sets) == [union.find(x) for x in range(len(sets))]
    lists = [np.array(sorted(random.Random(k).sample(range(40), 15))) for k in range(12)]
    count = collections.Counter(x for own in lists for x in own.tolist())
    for least in (1, 3, 6, 12):
        assert dict(zip(*map(list, jaccard.divide_skip(lists, least)), strict=True)) == {x: c for x, c in count.items() if c >= least}


def test_components(spark):
    r = random.Random(7)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    union = jaccard._Union(500)
    for a, b in links:
        union.join(a, b)
    got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: union.find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_shape_of_a_whole_token():
    known = quality.Describer(frozenset())
    start = "。".join(["日本"] * 20)
    shape = lambda token: int(known([token]).shapes[0])
    assert shape(start + "語") == shape(start + "語語") != shape(start + "#$%^&*" * 9) != shape(start)


@pytest.mark.parametrize("n", [10, 1000, 400_000])
def test_votes_depend_on_shares_not_on_length(n):
    known = quality.Describer(frozenset())
    words = ["alpha", "beta", "gamma", "delta", "same"]
    vote = lambda text: "".join(map(str, known([text]).votes[0]))
    own, short = vote(" ".join(words * (n // 5))), vote(" ".join(words * 20))
    assert own[5] == ("1" if n < 30 else short[5]) == "1" and own[6] == short[6]
    assert vote("x " * n)[2:4] == ("11" if n < 30 else "22")
    cut = "y " * ((1 << 19) - 2) + "run run run run run run run " + "a b c " * 9  # a run across a megabyte's end
    assert n > 10 or vote(cut)[3] == "2"


def test_features_survive_writing():
    known = quality.Describer(frozenset(["abcde*"]))
    made = known(["You idiot! abcdefgh ### x", None, "", "plain words here"])
    back = quality.Described.of(*made.arrays()[1:])
    for name in ("words", "n_words", "shapes", "n_shapes", "shares", "numbers"):
        assert (getattr(back, name) == getattr(made, name)).all(), name
    assert made.votes[0, quality.FORM :].tolist().count(quality.BAD) == 2 and made.votes[3, quality.FORM :].tolist() == [0, 0, 0, 0]


def test_quality_finds_junk_and_abuse(spark):
    r = random.Random(3)
    words = "the river runs along a green valley and people walk near old houses in spring while birds sing".split()
    good = [" ".join(r.choice(words) for _ in range(80)).capitalize() + ". " + " ".join(r.choice(words) for _ in range(20)) + "." for _ in range(120)]
    junk = [" ".join(r.choice(words) + "###" for _ in range(60)) for _ in range(20)] + [" ".join(["same"] * 80) for _ in range(10)] + [" ".join(r.choice(words).upper() + "!!" for _ in range(60)) for _ in range(10)]
    rude = [g.replace("river", "idiot").replace("people", "scum").replace("birds", "stupid moron") for g in good[:20]]
    rows = [(i, t) for i, t in enumerate(good + junk + rude)]
    keep = [x["keep"] for x in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert np.mean(keep[:120]) > 0.95 and np.mean(keep[120:160]) < 0.1 and np.mean(keep[160:]) < 0.1


@pytest.mark.parametrize("text", ["", "a", "abc" * 50, "é" * 10])
def test_fingerprints_are_functions_of_the_text(text):
    alone, among = fingerprints.fingerprints([text]), fingerprints.fingerprints(["other words here", text, "x" * 99])
    assert alone[0] == among[1] and fingerprints.likeness(alone[0], among[1]) == 1.0


def test_equal_substrings_share_phrases():
    r = random.Random(1)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(3))
    same, other = fingerprints.fingerprints([a + b, c[:77] + a + b[:600]]), fingerprints.fingerprints([a, c])
    assert fingerprints.likeness(*same) > 0.5 > 0.1 > fingerprints.likeness(*other)
