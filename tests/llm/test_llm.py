import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import jaccard, licenses, mixing, neighbours, packing, pii, quality, substrings, tokencounts, toxicity
from sedgeline.llm.wordbpe import WordBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"


def corpus():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = make(60)
    texts = [None, "", " \n\t", "one two", "One TWO", "x " * 400, make(3000)]
    texts += [make(r.randint(5, 200)) for _ in range(60)]
    texts += [make(20) + "\n" + passage + " " + make(30) for _ in range(12)]
    base = make(120)
    texts += [base] * 5
    for _ in range(70):  # a family that a single pivot doesn't hold
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), len(t or ""), 1) for i, t in enumerate(texts)]
    return rows + [rows[10]]  # a row that repeats


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_jaccard_is_exact(docs):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == len(corpus())
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == find(r["doc_id"]) for r in got)


def test_jaccard_large_regions(docs, monkeypatch):
    """Rounds over the whole table, broadcasts of hot keys and common shingles change the way, not the result."""
    want = {tuple(r) for r in jaccard.jaccard_join(docs).collect()}
    for limits in ({"LARGE": 2500, "SKETCHED": 5, "MOST_COPIES": 0, "TOKEN_BYTES": 2}, {"COMMON_TOTAL": 1, "COMMON_BATCH": 1, "LARGE": 3000, "MOST_COPIES": 50, "SHRINK": 0.97}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(jaccard, k, v)
            assert {tuple(r) for r in jaccard.jaccard_join(docs).collect()} == want, limits


def test_region_finds_all_links():
    """Cells, cells of cells and the exhaustive way against all pairs, on families of several widths."""
    rng = np.random.default_rng(5)
    for width, extra in ((0.02, 0), (0.15, 10), (0.3, 60), (0.9, 30)):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
            for _ in range(30):
                own = base.copy()
                hit = rng.random(160) < width * rng.random()
                own[hit] = rng.integers(0, 1 << 63, hit.sum(), dtype=np.uint64)
                sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 63, rng.integers(0, extra + 1), dtype=np.uint64)])))
        n = np.array([len(s) for s in sets])
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j]):
                    want[want == want[i]] = want[j]
        region = jaccard.Region(sets, n, np.arange(len(sets)))
        region.search(np.arange(len(sets)))
        pairs = {(min(a, b), max(a, b)) for a in range(len(sets)) for b in range(len(sets)) if region.root[a] == region.root[b]}
        assert pairs == {(min(a, b), max(a, b)) for a in range(len(sets)) for b in range(len(sets)) if want[a] == want[b]}
        assert len(region.joined) == len(sets) - len(set(want.tolist()))


def test_jaccard_of_odd_rows(spark):
    """Copies of a hot set, one doc_id with two texts, null ids, columns named like those of the result."""
    a, b = "a b c d e f g h i j k l", "p q r s t u v w x y z"
    rows = [(i, a) for i in range(20, 60)] + [(7, b), (7, "completely other text of seven words"), (9, b), (None, a), (None, None), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, component_id int, part int, region string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == collections.Counter([(i, 20) for i in range(20, 60)] + [(7, 7), (7, 7), (9, 7), (None, None), (None, None), (3, 3), (3, 3), (4, 4)])
    kept = jaccard.near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert left == sorted([(20, a), (7, b), (7, rows[41][1]), (3, None), (4, ""), (None, a), (None, None)], key=str)


def test_sketch_keeps_linked_pairs():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.uniform(0.6, 1)], r.integers(0, 1 << 63, r.integers(0, 200), dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if jaccard.linked(inter, len(a), len(b)):
            assert jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b))


@pytest.mark.parametrize("common", [False, True])
def test_substrings(docs, monkeypatch, common):
    if common:
        monkeypatch.setattr(substrings, "COMMON_LEAST", 1)
        monkeypatch.setattr(substrings, "COMMON_TOTAL", 1)
    rows = corpus()
    seen = collections.Counter(tuple(w[k : k + 35]) for _, t, *_ in rows for w in [words(t)] for k in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want


def test_quality_base(docs):
    import re

    for r in quality.judge_quality(docs).collect():
        t = next(x[1] for x in corpus() if x[0] == r["doc_id"]) or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert r["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_quality_cutoff_follows_distances(spark):
    """The cutoff lies between two classes wherever they are, and beyond nearly all rows of one class."""
    r = np.random.default_rng(8)
    core = r.chisquare(5, 4000) * np.exp(r.exponential(0.5, 4000))
    for junk in (150, 400, 3000):
        d = np.concatenate([core, junk * np.exp(r.normal(0, 0.1, 300))])
        at = quality.cutoff(spark.createDataFrame([(float(x),) for x in d] + [(None,)], "distance double"))
        assert quality.CHI2_FAR < at < junk * 0.8 and (core > at).mean() < 0.02
    one = quality.cutoff(spark.createDataFrame([(float(x),) for x in core], "distance double"))
    assert (core > one).mean() < 0.02
    assert quality.cutoff(spark.createDataFrame([], "distance double")) == float("inf")


def test_quality_starts_from_median_deviations(spark, monkeypatch):
    """Without steps, the start alone decides: a statistic that spreads widely doesn't push the others aside."""
    r = np.random.default_rng(9)
    x = r.normal(0, [3.0, 0.04, 0.25, 0.25, 0.25], (2000, 5))
    monkeypatch.setattr(quality, "STEPS", 0)
    rows = spark.createDataFrame([("en", "a", *map(float, v)) for v in x], ["lang", "source", *quality._X])
    got = quality.mcd(rows).first()
    assert got["f00"] > 2.0  # 1.86 where distances are scaled by the floors alone


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = {tuple(r) for r in mixing.mix(docs.repartition(7)).collect()}
    assert {tuple(r) for r in rows} == again and len(rows) == len(corpus())
    size, target, taken = {}, {}, collections.Counter()
    for r in rows:
        text = next(x[1] for x in corpus() if x[0] == r["doc_id"])
        assert r["size"] == len(words(text)) and 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] += r["taken"]
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1], strict=False))
    open_, left, want = set(size), sum(size.values()), {}
    while True:  # share, stop at three times, share the excess again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-9 and abs(taken[s] - target[s]) <= 2
    staged = mixing.mix_stage(docs.sparkSession, docs, "")
    assert staged.columns == docs.columns
    out = collections.Counter()
    for r in staged.collect():
        out[r["source"]] += len(words(r["text"]))
    assert {s: out[s] for s in size} == {s: taken[s] for s in size}


def test_mixing_keeps_text_before_the_cut(spark):
    r = random.Random(6)
    texts = {i: "".join(r.choice([" ", "\n", "\n\n  ", "\t"]) + f"w{i}x{k}" for k in range(90)) + "\n" for i in range(30)}
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t), 1) for i, t in texts.items()], SCHEMA)
    taken = {x["doc_id"]: x for x in mixing.mix(docs).collect()}
    cut = 0
    for x in mixing.mix_stage(spark, docs, "").collect():
        whole = texts[x["doc_id"]]
        assert whole.startswith(x["text"]) and x["n_chars"] == len(x["text"])
        if x["text"] != whole:
            cut += 1
            assert len(words(x["text"])) == taken[x["doc_id"]]["taken"] % 90
    assert cut


def test_pii():
    import re

    base = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab1.@-+ %é") for _ in range(r.randint(0, 40)))
        assert pii.emails(t) == [m.span() for m in base.finditer(t)]
    t = "Call +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.1 and 10.0.0.300, iban GB82 WEST 1234 5698 7654 32; SSN 123-45-6789"
    kinds = [k for _, _, k, _ in pii.spans(t)]
    assert kinds == ["phone", "card", "ip", "iban", "ssn"]
    assert "4111" not in pii.redact(t, pii.spans(t)) and pii.spans("") == []
    assert not any(k == "card" for *_, k, _ in pii.spans("4111 1111 1111 1112"))


def test_ibans_before_other_tokens():
    for number in ("ES9121000418450200051332", "BE71 0961 2345 6769", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for behind in ("", " CAIXESBB", " GEBABEBB36A", " EUR", " 2024", " EUR 2024 PAID", " PLEASE PAY", " AB12 0000 1111 2222", ", EUR"):
            t = f"to {number}{behind}"
            assert [(a, b) for a, b, k, _ in pii.spans(t) if k == "iban"] == [(3, 3 + len(number))], t
            assert pii.redact(t, pii.spans(t)).startswith("to [IBAN]")
    two = "AB12 0000 1111 BE71 0961 2345 6769 ES91 2100 0418 4502 0005 1332 EUR"  # behind a part of none, and one behind the other
    assert [two[a:b] for a, b in pii.ibans(two)] == ["BE71 0961 2345 6769", "ES91 2100 0418 4502 0005 1332"]
    assert pii.ibans("BE72 0961 2345 6769 GEBABEBB") == []


def test_licenses():
    s = licenses.Scanner()
    got = s.scan("Under the GNU general,public license.\nMIT License; cc  by")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (10, 3, 2, 8, "cc-by,gpl,mit")
    fuzzy = s.scan("Redistributon and use in sorce and binary forms, with or without modification")
    assert fuzzy["labels"] == "bsd" and fuzzy["n_base"] == 0 and 0 < fuzzy["score"] < 1
    import regex

    r = random.Random(5)
    for notice, label in licenses.NOTICES.items():  # seeds lose no match
        k = licenses.errors_allowed(notice)
        t = list(notice)
        for _ in range(k):
            t[r.randrange(len(t))] = r.choice("abcxyz ")
        text = " ".join(("lead " + "".join(t) + " tail").split())
        if regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", text):
            assert label in {x[2] for x in s.notices_in(text)}
    assert s.scan("")["first_word"] is None


def test_neighbouring_notices():
    s = licenses.Scanner()
    best, worse, worst = "licensed under the mit license", "licensd under the mit license", "licensd undr the mit license"
    for parts in ((worse, best), (best, worse), (worst, worse, best), (worse, best, worst), (best, best), (worst, best, worse)):
        t = " and ".join(parts)
        places, at = [], 0
        for x in parts:
            places.append((at, at + len(x), len(best) - len(x)))
            at += len(x) + len(" and ")
        assert [(a, b, e) for a, b, x, e in s.notices_in(t) if x == "mit"] == places, t


def test_word_bpe():
    w = WordBpe()
    odd = ["it's DON'T 3.14² ½kg", "İstanbul ΟΔΟΣ", "a\x1cb <|endoftext|> x", "日本 ﬁ ñ “q”", "x_y __a__", "", " \n"] + [f"x{chr(i)}y {chr(i)}" for i in range(1, 0x250)]
    for t in [*odd, *[t or "" for _, t, *_ in corpus()]]:
        assert w.ids(t) == w.slow.encode(t, add_special_tokens=False).ids, t


def test_packing(docs):
    w = WordBpe()
    by = collections.defaultdict(list)
    rows = packing.pack(docs, max_len=64).collect()
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t, *_ in corpus()[:-1]:
        ids = np.array(w.ids(t or "") + [1], "<u4")
        own = sorted(by[i], key=lambda r: (r["sequence_id"]))
        covered = sorted({(r["start"], r["length"]) for r in own})
        assert sum(n for _, n in covered) == len(ids) and [s for s, _ in covered] == list(np.cumsum([0, *[n for _, n in covered]])[:-1])
        for r in own:
            assert r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)


def test_edit_aware_counts():
    w, r = WordBpe(), random.Random(7)
    for _ in range(150):
        text = "".join(r.choice("ab, \n.1é") for _ in range(r.randint(0, 900)))
        tree = tokencounts.CountTree(text, w.count, leaf=16)
        assert tree.tokens == w.count(text)
        for _ in range(12):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 1, 5, 60]))
            new = "".join(r.choice("ab \n.") for _ in range(r.choice([0, 1, 7])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            tree.rebalance()
            assert tree.text == text and tree.tokens == w.count(text) and tree.chars[1] == len(text)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype("float32")
    x[100:400] = x[100]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0]), (2080, [])]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in neighbours.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v, hits = x.astype(float), 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        s = v @ v[q]
        want = sorted((-round(s[i], 9), i) for i in range(900) if i != q)[:20]
        found.sort()
        assert [a for a, *_ in found] == list(range(1, 21)) and all(abs(c - s[i]) < 1e-9 for _, i, c in found)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_repeated_queries(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    schema = "vec_id long, embedding array<double>"
    want = sorted(tuple(r) for r in neighbours.search(spark.createDataFrame(rows, schema), modulus=100).collect())
    twice = neighbours.search(spark.createDataFrame([*rows, rows[0], rows[100], rows[100]], schema), modulus=100).collect()
    for q in (0, 100, 200):
        found = sorted((r["rank"], r["vec_id"]) for r in twice if r["query_id"] == q)
        assert [a for a, _ in found] == list(range(1, 21))
        near = [i for _, i in found]
        # candidates count each time they occur; no other neighbour comes twice
        assert len(near) - len(set(near)) <= 2 * (100 in near) + (0 in near)
    assert {r["query_id"] for r in twice} == {q for q, *_ in want}


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice("the a of on in and edge river stone".split()) for _ in range(30)]
        if i % 5 == 0:
            for _ in range(2):
                w[r.randrange(30)] = r.choice(["grunk", "moron", "zorbler", "zorbling"])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95 and got[1000]["predicted"] == got[1001]["predicted"] == 0
    machine = toxicity.Composition(*(f() for f in toxicity.GRAMMAR))
    out = []
    for symbols in ("ul", "nl", "rl", "el", "v", "mv", "uov", "vu", "nmv", "rvu", "umv"):
        state = machine.start
        for s in symbols:
            state, o, f = machine.step(state, s)
        out.append((o, f))
    # insults beside a target, negated, reported, raised; verbs alone, behind "will", behind and before a target
    assert out == [("i", 1.25), ("x", 0.5), ("q", 0.7), ("i", 1.2), ("o", 1.0), ("t", 1.5), ("o", 1.0), ("t", 1.0), ("x", 0.75), ("q", 0.7), ("t", 3.0)]


def test_threat_phrases():
    s = toxicity.Scorer(toxicity.Model({}, *toxicity.DEFAULT_LAYER))
    zero = [0.0] * toxicity.FEATURES
    assert s.features("They beat the eggs and burn wood. A kill switch.") == zero
    assert s.features("I am going to hurt you.")[0] == s.features("We will burn it.")[0] > s.features("Hurt you.")[0] > 0
    assert s.features("He said he will kill you.")[3] > 0 and s.features("I will not kill you.")[2] > 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400) for _ in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = [r["text"] for r in toxicity.training_rows(docs, labels).collect()]
    assert sorted(got) == sorted(f"text {i}" for i in range(400) if zlib.crc32(str(i).encode()) % 5)
    monkeypatch.setattr(toxicity, "LABELLED_ROWS", 100)
    some = [r["text"] for r in toxicity.training_rows(docs, labels).collect()]
    assert 60 < len(some) == len(set(some)) <= 100
    assert sorted(some) == sorted(r["text"] for r in toxicity.training_rows(docs.repartition(5), labels).collect())


def test_empty_tables(spark, empty):
    assert jaccard.jaccard_join(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and quality.judge_quality(empty).count() == 0
    assert packing.pack(empty).count() == 0 and tokencounts.count_tokens(empty).count() == 0
    assert pii.find_pii(empty).count() == 0 and licenses.scan_licenses(empty).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert toxicity.score_documents(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        d = f(spark, d, str(tmp_path))
        assert d.columns == docs.columns
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()]
    groups = {r["component_id"] for r in jaccard.jaccard_join(docs).collect()}
    assert sorted(kept) == sorted(groups)
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).agg(F.sum("length")).first()[0] > 0


def test_pii_base_against_plain():
    """Every base kind, the digest and the order against the contract's own patterns."""
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0

    r = random.Random(12)
    for _ in range(4000):
        t = "".join(r.choice(["1", "4", "0", "25", "255", ".", ".", "-", " ", "+", "(", "a", "@", "é", "4111 1111 1111 1111", "10.0.0.1", "+1 555 010 9999", "x@y.z"]) for _ in range(r.randint(0, 30)))
        want = [(*m.span(), "email") for m in email.finditer(t)]
        want += [(*m.span(), "ip") for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(*m.span(), "card") for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        want += [(*m.span(), "phone") for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        want.sort(key=lambda s: (s[0], pii.BASE.index(s[2])))
        got = [(a, b, k) for a, b, k, _ in pii.spans(t) if k in pii.BASE]
        assert got == want, t


def test_long_texts_take_little_time():
    import time

    began = time.time()
    for t in ("0" * 5000 + ".1.1.1", "7" * 1_000_000, "1." * 300_000, "a@" * 300_000, "+1(" * 200_000, "AB12 " * 100_000, "1 " * 300_000):
        pii.spans(t)
    assert time.time() - began < 30
    began = time.time()
    tree = tokencounts.CountTree("", len)
    text = ",".join(f"name{i}x@host.example" for i in range(8000))
    tree = tokencounts.CountTree(text, lambda x: len(x.split(",")))
    tree.edit_all(tokencounts.mask_edits(text))
    tree.rebalance()
    assert tree.text.count("[email]") == 8000 and max(map(len, tree.leaves)) < 100 * tokencounts.LEAF and time.time() - began < 20


def test_licenses_base_against_plain():
    import re

    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    s, r = licenses.Scanner(), random.Random(11)
    for _ in range(2000):
        t = "".join(r.choice(["GNU", "general ", "public", " license", "apache", "cc", "by", "MIT", " ", "-", "\n", "é", "x", "mit license ", "cc by"]) for _ in range(r.randint(0, 25)))
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())]
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        got = s.scan(t)
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at}))), t
        assert (got["first_word"], got["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None)) and {x for _, x in at} <= set(got["labels"].split(","))


def test_kept_trees(spark):
    """A later call starts from the trees of the one before: it encodes what its own edits touch."""
    w, r = WordBpe(), random.Random(3)
    texts = {i: " ".join(r.choice(["alpha", "don't", "x9y", "a@b.example", "(5)", "né"]) for _ in range(400)) for i in range(20)}
    docs = spark.createDataFrame([*texts.items(), (50, None), (51, "")], "doc_id long, text string")
    first = tokencounts.count_tokens(docs).cache()
    rows = {x["doc_id"]: x for x in first.collect()}
    assert len(rows) == 22 and rows[50]["n_tokens"] == rows[51]["n_tokens"] == 0
    for i, t in texts.items():
        x = rows[i]
        assert x["n_tokens"] == w.count(t) and x["n_tokens_edited"] == w.count(x["edited"]) == sum(x["leaf_tokens"]) and sum(x["leaf_chars"]) == len(x["edited"])
    after = spark.createDataFrame([(i, rows[i]["edited"]) for i in texts], "doc_id long, text string")
    second = tokencounts.count_tokens(after, edits=lambda t: [(0, 5, "omega")], trees=first)
    for x in second.collect():
        assert x["n_chars_encoded"] == 0 and 0 < x["n_chars_reencoded"] < 2500 and x["n_tokens_edited"] == w.count(x["edited"])


def test_queries_over_a_table(spark, docs, tmp_path):
    """The thin queries over a table with clashing and extra columns, repeated rows and nulls."""
    rows = docs.withColumn("score", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("labels", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("spans", F.lit(0))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for f in (toxicity.op1_toxicity, pii.op2_pii, mixing.op3_mixing, licenses.op5_licenses, substrings.op6_substrings, tokencounts.op7_token_counts, quality.op8_quality):
        got = f(spark, str(tmp_path))
        assert len(set(got.columns)) == len(got.columns) and got.count() == len(corpus()), f.__name__
