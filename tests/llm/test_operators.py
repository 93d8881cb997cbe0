"""Operators against brute force, exact tokenizers, planted cases and held-out data."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from junctura.llm import classlm, common, decontam, licenses, mixing, neardup, pages, tokencount, toxicity, urls

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def test_word_hashes_know_words_only():
    raw = "One two  ONE\ttwo\nthree".encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, first = common.spans(data, np.array([0, 4, len(raw)]), common.SPACE_SEP)
    h = common.word_hashes(data, s, e)
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3 and first.tolist() == [0, 1, 5]
    assert h[0] == common.hash_word("one")


# near duplicates


def brute_components(texts, threshold):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k in sorted(sets):
        both = Counter(y for g in sets[k] for y in where[g])
        for y, n in both.items():
            if 100 * n >= threshold * (len(sets[k]) + len(sets[y]) - n):
                a, b = root(k), root(y)
                parent[max(a, b)] = min(a, b)
        for g in sets[k]:
            where[g].append(k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("threshold", "rows", "shingles"), [(85, 2048, 4_000_000), (80, 4, 1000)])
def test_near_duplicates(spark, texts, monkeypatch, threshold, rows, shingles):
    rng = random.Random(5)
    more = dict(texts)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    for k in range(40):  # a group of near copies of each other
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        more[10_000 + k] = " ".join(copy)
    monkeypatch.setattr(neardup, "NODE_ROWS", rows)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles)
    docs = spark.createDataFrame(list(more.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, threshold).collect()}
    assert got == brute_components(more, threshold)


def test_copies_that_only_resemble_one_original(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 4000)
    monkeypatch.setattr(neardup, "GROUP_DOCS", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = {1: " ".join(base)}
    for k in range(2, 90):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    want = brute_components(texts, 85)
    assert len({c for _, c in want.values()}) < 5 and got == want


@pytest.mark.parametrize("shared", [160, 180])
def test_templated_pages_beyond_a_task(spark, monkeypatch, shared):
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 3000)
    monkeypatch.setattr(neardup, "GROUP_DOCS", 16)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(shared)]
    own = lambda m: [f"x{rng.randrange(10**9)}" for _ in range(m)]
    texts = {}
    for k in range(0, 300, 2):  # each pair is alike, and no two pairs are
        mine = own(200 - shared)
        last = 200 - shared if k % 3 == 0 else (13 if shared == 160 else 15)
        texts[k], texts[k + 1] = " ".join(base + mine), " ".join(base + mine[: len(mine) - last] + own(last))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    want = brute_components(texts, 85)
    assert 150 < len({c for _, c in want.values()}) < 250 and got == want


def test_short_documents_of_one_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_ROWS", 8)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(30)]
    own = lambda m: [f"x{rng.randrange(10**9)}" for _ in range(m)]
    texts = {}
    for k in range(0, 800, 2):  # each pair is alike, others share about half
        mine = own(22)
        texts[k], texts[k + 1] = " ".join(base + mine), " ".join(base + mine[:-3] + own(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 85).collect()}
    assert got == brute_components(texts, 85)


@pytest.mark.parametrize("shared", [20, 79])
def test_a_large_family_with_the_constants_as_they_are(spark, shared):
    """20,000 documents that all share a boilerplate (resemblance 0.1 and 0.64), in pairs that differ by one word at an end or have nothing else in common."""
    rng = random.Random(shared)
    base = [f"w{k}" for k in range(shared)]
    texts, want = {}, {}
    for k in range(0, 20_000, 2):
        mine = [f"x{rng.randrange(10**12)}" for _ in range(100 - shared)]
        alike = k % 4 == 0
        other = [*mine[:-7], *(f"y{rng.randrange(10**12)}" for _ in range(7))] if alike else [f"x{rng.randrange(10**12)}" for _ in range(100 - shared)]
        texts[k], texts[k + 1] = " ".join(base + mine), " ".join(base + other)
        want[k], want[k + 1] = k, k if alike else k + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 85).collect()}
    found = sum(got[k + 1] == k for k in range(0, 20_000, 4))
    assert found >= 0.999 * 5000 and all(got[k] == want[k] for k in got if want[k] == k)


def test_recall_of_the_trees():
    """Pairs whose tokens agree independently with the threshold's probability, in trees that branch to the last level."""
    rng = np.random.RandomState(4)
    for threshold in (80, 85):
        b, trees, n = neardup.branches_for(threshold), neardup.trees_for(threshold), 20_000
        missed = np.ones(n, bool)
        for _ in range(trees):
            paths = np.ones(n, np.int64)
            for _ in range(neardup.LEVELS + 1):
                paths = rng.binomial(b * paths, threshold / 100)
            missed &= paths == 0
        assert missed.mean() <= 3e-4


def test_large_nodes_meet_whole(spark):
    rng = random.Random(13)
    linked = {d: (0 if d < 60 else rng.randrange(60, 90)) for d in range(200)}
    rows = spark.createDataFrame([(g, d, r, 1) for g in (1, 2) for d, r in linked.items()], "grp bigint, doc bigint, linked bigint, n int")
    met = defaultdict(set)
    for r in neardup.crossed(rows, 16, []).collect():
        met[r.grp].add(r.doc)
    assert max(map(len, met.values())) < 60 and len(met) > 100
    pairs = {(a, b) for m in met.values() for a in m for b in m}
    assert all((a, b) in pairs for a in linked for b in linked if linked[a] != linked[b])


def test_forest_spans_components():
    rng = np.random.RandomState(3)
    m = 60
    adjacent = rng.rand(m, m) < 0.03
    adjacent |= adjacent.T
    edges = list(neardup.forest(m, lambda x, rest: adjacent[x, rest]))

    reach = np.linalg.matrix_power((adjacent | np.eye(m, dtype=bool)).astype(float), m) > 0
    components = {tuple(r) for r in reach}
    assert len(edges) == m - len(components) and all(adjacent[a, b] for a, b in edges)
    assert len(set(itertools.chain(*edges))) <= m
    ids = 1000 - np.arange(m)
    joined = {(min(ids[list(np.flatnonzero(r))]), ids[i]) for i, r in enumerate(reach)}
    assert set(neardup.stars(ids, iter(edges))) == {(a, b) for a, b in joined if a != b}


# language model


def test_base_scores_and_counts(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(classlm, "KNOWN_WORDS", 300)
    rows = classlm.op5_class_lm(spark, SF).collect()
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    seqs = {k: [*words(t), None] for k, t in texts.items()}
    c = Counter(w for k, s in seqs.items() if not held[k] for w in s)
    n, v = sum(c.values()), len(c)
    for r in rows:
        s = seqs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(s), sum(c[w] > 0 for w in s), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def _classes(model, rare):
    """{hash: (class, count)} of all training words."""
    known = {int(h): (int(c), int(n)) for h, c, n in zip(model.words, model.classes, model.counts)}
    return known | {r.hash % 2**64: (r.cls, r.n) for r in rare.collect()}


def test_model_is_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(classlm, "OWN_SYMBOLS", 4)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "cc", "dd", "eee", "fff"]) for _ in range(30))) for k in range(50)]
    bodies = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("cast(text as binary) body")
    model, rare = classlm.train(bodies, 50)
    assert np.allclose((10**model.transitions).sum(1), 1)
    words = _classes(model, rare)
    assert len(words) == 6 and sum(n for _, n in words.values()) == 1500
    for c in range(1, len(model.rest)):  # the words of a class and one place for those never seen
        assert sum(n + classlm.ADD for k, n in words.values() if k == c) + classlm.ADD == pytest.approx(10 ** model.rest[c])


def test_class_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(classlm, "KNOWN_WORDS", 60)
    monkeypatch.setattr(classlm, "OWN_SYMBOLS", 40)
    monkeypatch.setattr(classlm, "HELD_PAIRS", 500)
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    rows = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    rows += [rows[7], rows[10], (None, rows[10][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = classlm.fold("doc_id", 10) == 0
    bodies = docs.filter(~held).selectExpr("cast(text as binary) body")
    model, rare = classlm.train(bodies, bodies.count())
    lexicon = _classes(model, rare)
    c = Counter(w for k, t in rows if zlib.crc32(str("" if k is None else k).encode()) % 10 for w in words(t))
    assert {common.hash_word(w): n for w, n in c.items()} == {h: n for h, (_, n) in lexicon.items()}

    def score(t):
        before, total = classlm.END, 0.0
        for w in words(t):
            raw = np.frombuffer(w.encode(), np.uint8)
            ending = int(classlm.endings(raw, np.array([0]), np.array([len(raw)]))[0])
            cls, n = lexicon.get(common.hash_word(w), (int(model.endings[ending]), 0))
            total += model.transitions[before, cls] + np.log10(n + classlm.ADD) - model.rest[cls]
            before = cls
        return total + model.transitions[before, classlm.END]

    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6), round(r.perplexity, 4)) for r in classlm.score_texts(docs, held).collect())
    want = sorted((-1 if k is None else k, round(float(score(t)), 6), round(10 ** (-score(t) / (len(words(t)) + 1)), 4)) for k, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-5)


def test_words_go_to_the_class_their_neighbours_tell(spark):
    """The distributed step against the gain of every class, word by word."""
    rng = np.random.RandomState(5)
    moves = np.log10(rng.dirichlet(np.ones(5), 5))
    sizes = np.array([10.0, 50, 20, 80, 30])
    rows = [(w, int(w % 4) + 1, int(code), int(n)) for w in range(200) for code, n in zip(rng.choice(50, 6, False), rng.randint(1, 9, 6))]
    table = spark.createDataFrame(rows, "hash bigint, old int, code int, n bigint")
    got = classlm.best_classes(table, moves, sizes).collect()
    logs = np.log(10) * moves
    for w in range(200):
        mine = [(code // 10, code % 5, n) for word, _, code, n in rows if word == w]
        count = sum(n for *_, n in mine)
        gain = [sum(n * (logs[a, k] + logs[k, c]) for a, c, n in mine) - count * np.log(sizes[k]) + classlm.STAY * (k == w % 4 + 1) for k in range(5)]
        assert [(r.cls, r.n) for r in got if r.hash == w] == [(1 + int(np.argmax(gain[1:])), count)]
    assert sum(r.n for r in got if r.hash is None) == sum(n * (1 + (code % 10 < 5)) for *_, code, n in rows)


def test_exchange_ends_where_no_move_helps():
    rng = np.random.RandomState(2)
    side = np.array([0, 1, 1, 1, 1, 2, 2, 2, 2])
    pairs = rng.poisson(np.where(side[:, None] == side[None, :], 3, 40))

    def information(of):
        hot = np.eye(4)[of]
        m = hot.T @ pairs @ hot
        x = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()
        return x(m) - x(m.sum(0)) - x(m.sum(1))

    of = classlm.exchange(pairs, 4, 50)
    assert of[0] == 0 and (of[1:] > 0).all()
    best = information(of)
    assert best > information(np.array([0, *(1 + np.arange(8) % 3)]))
    for s in range(1, 9):
        for c in range(1, 4):
            other = of.copy()
            other[s] = c
            assert information(other) <= best + 1e-6


# licenses


def test_license_base_against_brute_force(spark, documents, texts):
    phrases = [(tuple(p.split()), label) for p, label in licenses.PHRASES]
    for r in licenses.scan_licenses(documents).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(UP))
        at = [(i, label) for i in range(len(w)) for p, label in phrases if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("licensed under the Apache license 2.0 (the License)", {"apache-2.0"}),
        ("licensed under the Apache Licence 2.0", set()),
        ("This fine work is licensed under the MIT License.", {"mit-notice"}),
        ("Permission is hereby given, free of charge", set()),
        ("This file is not licensed under the MIT License.", set()),
        ("It isn't licensed under the MIT License", set()),
        ("It isn\u2019t licensed under the MIT License", set()),
        ("It is not currently licensed under the MIT License", set()),
        ("not to be licensed under the MIT License", set()),
        ("It is not only licensed under the MIT License", {"mit-notice"}),
        ("This is not a toy. Licensed under the MIT License", {"mit-notice"}),
        ("Do not ask\n\nLicensed under the MIT License", {"mit-notice"}),
        ("not licensed under the MIT license here; there it is licensed under the MIT license", {"mit-notice"}),
        ("licensed under MIT License", {"mit-notice"}),
        ("licensed under CC BY 4.0", {"cc-by"}),
        ("licensed under CC BY-NC-ND 4.0", {"cc-by-nc-nd"}),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
        ("licensed under the GNU General Public License version 3", {"gpl-notice"}),
        ("licensed under the GNU Lesser General Public License version 3", {"lgpl-notice"}),
        ("licensed under the GNU Affero General Public License, version 3", {"agpl-notice"}),
        (re.sub(r"<<.*?>>", "", dict(licenses.TEMPLATES)["unlicense"].split("<<begin")[0]), {"unlicense"}),
        (re.sub(r"<<.*?>>", "", dict(licenses.TEMPLATES)["unlicense"].split("<<begin")[0]).replace("perpetuity", "part"), set()),
        (re.sub(r"<<var;.*?>>", "the author", dict(licenses.TEMPLATES)["isc-text"]), {"isc-text"}),
        (re.sub(r"<<var;.*?>>", "the author", dict(licenses.TEMPLATES)["isc-text"]).replace("in no event", "only on tuesdays"), set()),
        ("Copyright (c) 2020 Someone " + re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", dict(licenses.TEMPLATES)["mit-text"]), {"mit-text"}),
        ("Copyright (c) 2020 Someone " + re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", dict(licenses.TEMPLATES)["mit-text"]).replace("sublicense", "rent"), set()),
    ],
)
def test_templates(text, labels):
    assert licenses.scan(text.lower().encode(), licenses.compiled(), [])[2] == labels


def test_automata_against_regular_expressions():
    """Random templates as regular expressions over the words, at every start."""
    rng = random.Random(7)
    for _ in range(300):
        template, pattern = [], []
        for k in range(rng.randrange(1, 5)):
            w, kind = rng.choice("abc"), rng.randrange(3)
            if kind == 0 or k == 0:
                template.append(w)
                pattern.append(f"{w} ")
            elif kind == 1:
                least, most = rng.randrange(3), rng.randrange(1, 4)
                most = max(least, most)
                template.append(f"<<var;{least};{most}>>")
                pattern.append(rf"(?:\w+ ){{{least},{most}}}")
            else:
                v = rng.choice("abc")
                template.append(f"<<beginOptional>>{w} <<beginOptional>>{v}<<endOptional>><<endOptional>>")
                pattern.append(f"(?:{w} (?:{v} )?)?")
        automaton = licenses.Automaton(" ".join(template))
        text = [rng.choice("abcd") for _ in range(12)]
        for i in range(len(text)):
            ends = [j for j in range(i, len(text) + 1) if re.fullmatch("".join(pattern), "".join(f"{w} " for w in text[i:j]))]
            assert automaton.match([w.encode() for w in text], i) == max(ends, default=None)


def test_template_variables_are_bounded():
    a = licenses.Automaton("start <<var;1;2>> end <<beginOptional>>now<<endOptional>>")
    find = lambda t: list(a.find([w.encode() for w in t.split()]))
    assert find("x start a end now y") == [(1, 5)] and find("start a b end") == [(0, 4)] and not find("start end") and not find("start a b c end")


# tokens


def test_token_counts_equal_a_tokenizer(spark, documents):
    from tokenizers import Tokenizer, models

    vocabulary = tokencount.load_vocabulary()
    whole = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *vocabulary]
    exact = Tokenizer(models.Unigram(whole, 0, True))
    counting = tokencount.Counting(vocabulary)
    more = ["  two  spaces ", "日本語😀\x00", "a" * 3000, "tab\tline\r\n", "¤ ¤¤"]
    for t in [*[r.text for r in documents.limit(60).collect()], *more]:
        assert counting.count(t)[0] == len(exact.encode("▁" + t.replace(" ", "▁")).ids)


def test_token_ties_keep_the_earlier_start():
    c = tokencount.Counting([("ab", -2.0), ("c", -1.0), ("a", -1.0), ("bc", -2.0), ("b", -1.0)])
    assert c.part("abc") == (2, -3.0)  # ab+c, a+bc and a+b+c score the same; for the last c the piece bc starts first
    assert c.part("a")[0] == 1 and c.part("é")[0] == 2


def test_token_windows_change_nothing(monkeypatch):
    """Every segmentation of short strings, and the same counts with windows of three characters."""
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.5, "ba": -2.0, "aba": -3.5, "bb": -3.0, "abab": -4.5}
    counting = tokencount.Counting(list(pieces.items()))

    def best(s):
        if not s:
            return 0.0
        return max([pieces[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces] + [counting.unknown + best(s[1:])] * (s[0] not in pieces))

    texts = ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)]
    whole = [counting.part(t) for t in texts]
    assert [score for _, score in whole] == [best(t) for t in texts]
    monkeypatch.setattr(tokencount, "WINDOW", 3)
    assert [counting.part(t) for t in texts] == whole


# decontamination


def test_repeated_copy_with_most_grams_broken(spark):
    item = [f"q{k}" for k in range(20)]
    copy = [f"z{k}" if k in (3, 6, 9, 12, 15) else w for k, w in enumerate(item)]
    texts = {d: " ".join([f"a{d}", "b", *copy, "c"]) if d < 20 else f"other text {d} of no item" for d in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = decontam.find_leaks(docs, benchmark).collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and {r.score for r in got} == {25 / 40}
    assert decontam.drop_leaks(docs, benchmark).count() == 380


def test_leaks_edited_and_everywhere(spark):
    rng = random.Random(2)
    vocabulary = [f"vé{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(40) for i in range(12)}
    rows, want = [], set()
    for d in range(300):
        t = text(200)
        if d % 3 == 0:  # one item is everywhere
            t[50:50] = items[0]
            want.add((d, 0))
        if d % 10 == 1:
            i = d % 11 + 1
            copy = list(items[i])
            for _ in range(9):  # edited, with words changed, left out and put in
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([["zz"], [], ["zz", copy[k]]])
            t[20:20] = copy
            want.add((d, i))
        if d % 10 == 2:  # a part too short to count
            t[20:20] = items[d % 11 + 1][:10]
        rows.append((d, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    rows = [(d, t.upper() if d % 7 == 0 else t) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontam.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score > 0.999 for r in got if r.item_id == 0)
    assert {r.doc_id for r in decontam.drop_leaks(docs, benchmark).collect()} == set(range(300)) - {d for d, _ in want}


def test_decontamination_against_brute_force(spark):
    """Every item is aligned with every whole text, without seeds or windows."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(60)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice([4, 7, 12, 25]))] for i in range(15)}
    texts = {}
    for d in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 120))]
        if d % 2:
            copy = list(items[d % 15])
            for _ in range(rng.randrange(0, 1 + len(copy) // 3)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([["zz"], [], ["zz", copy[k]]])
                copy = copy or ["zz"]
            at = rng.randrange(len(t))
            t[at:at] = copy
        texts[d] = t

    def local(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (decontam.MATCH if x == y else decontam.MISMATCH), row[j + 1] - decontam.GAP, new[j] - decontam.GAP))
            row, best = new, max(best, *new)
        return best

    want = {}
    for d, t in texts.items():
        grams = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
        for i, w in items.items():
            score = local(w, t)
            if score >= (len(w) if len(w) >= decontam.SHORT_ITEM else 2 * len(w)) and any(tuple(w[k : k + 3]) in grams for k in range(len(w) - 2)):
                want[d, i] = score / (2 * len(w))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    rows = decontam.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == pytest.approx(want) and len(want) > 25
    for r in rows:  # the passage alone has the whole score
        assert local(items[r.item_id], texts[r.doc_id][r.first_word : r.end_word]) / (2 * len(items[r.item_id])) == pytest.approx(r.score)


def test_alignment_against_plain_recurrence():
    rng = np.random.RandomState(0)
    for _ in range(30):
        a, b = rng.randint(0, 4, rng.randint(1, 12)), rng.randint(0, 4, rng.randint(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (decontam.MATCH if a[i] == b[j] else decontam.MISMATCH), h[i, j + 1] - decontam.GAP, h[i + 1, j] - decontam.GAP)
        assert decontam.smith_waterman(a, b)[0] == h.max()


# mixing


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    sources = {"a": 3000, "b": 1500, "c": 600, None: 300}
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), s) for k, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    planned = [r["__jx_mix"] for r in mixing.plan_mix(docs).collect()]
    total = sum(m.size for m in planned)
    by = {m.source_size: m.target for m in planned}
    assert sum(by.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-6 for s, t in by.items())
    taken = Counter()
    for m in planned:
        taken[m.source_size] += m.size * m.copies
    assert all(abs(taken[s] - t) < 0.06 * t for s, t in by.items())
    assert mixing.mix(docs).count() == sum(m.copies for m in planned)


# toxicity


def naive_kernel(s, t, n, decay):

    spans = lambda x: [(tuple(x[i] for i in c), c[-1] - c[0] + 1) for c in itertools.combinations(range(len(x)), n)]
    a = defaultdict(float)
    for u, k in spans(s):
        a[u] += decay**k
    return sum(a[u] * decay**k for u, k in spans(t))


def test_kernel_and_common_length_against_definition():
    for w, mark in (("idiom", "^idiot"), ("xidixotx", "^idiot"), ("banana", "^anan"), ("q", "^idiot")):
        letters = toxicity.letters_of([mark])
        codes, _ = toxicity.coded([w], letters)
        code = toxicity.code_of(mark, letters)
        assert toxicity.kernel(codes, code)[0] == pytest.approx(naive_kernel("^" + w, mark, toxicity.ORDER, toxicity.LAMBDA))
        s = "^" + w
        best = [[0] * (len(mark) + 1) for _ in range(len(s) + 1)]
        for i, x in enumerate(s):
            for j, y in enumerate(mark):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert toxicity.common_length(codes, code)[0] == best[-1][-1]


def test_toxicity_learns_and_tolerates_spelling(spark):
    rng = random.Random(3)
    clean = [f"{a}{b}" for a in ("ro", "mi", "ta", "ve", "lu") for b in ("ne", "sto", "ka", "ri", "den")]
    bad = ["grumblork", "snaffwit", "plonkhead"]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(clean) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    extra = dict(enumerate(["g r u m b l o r k", "plonk-head", "snaffxwit", "grumxblork", "gxrumxblxork", "gxruxmbxlxork", "grmblork", "grum blork", "pl onk head"], 1001))
    rows += [(k, " ".join(rng.choice(clean) for _ in range(20)) + f" {t} " + rng.choice(clean)) for k, t in extra.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, table).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if got[k].held_out]
    assert all(got[k].predicted == truth[k] for k in held) and len(held) > 150
    assert all(got[k].predicted for k in extra)
    assert toxicity.drop_toxic(docs.filter("doc_id < 600"), table).count() == 480


@pytest.mark.parametrize(
    ("bad", "clean"),
    [
        (["дурацкий", "болванище"], "дом река город ветер книга дорога солнце письмо вечер окно".split()),
        (["笨蛋", "傻瓜"], ["今天天气", "我们学习", "城市公园", "朋友来了", "看书写字", "中午吃饭"]),
    ],
)
def test_toxicity_in_other_scripts(bad, clean):
    rng = random.Random(3)
    texts, toxic = [], np.arange(400) % 5 == 0
    for k in range(400):
        w = [rng.choice(clean) for _ in range(40)]
        if toxic[k]:
            w[rng.randrange(40)] += rng.choice(["", " "]) + rng.choice(bad) if len(bad[0]) == 2 else " " + rng.choice(bad)
        texts.append(" ".join(w))
    model = toxicity.train(texts[:], toxic.copy())
    raw = [t.encode() for t in texts]
    got = model.scores(*toxicity.Scorer(model).pool(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))))
    assert ((got >= toxicity.REJECT) == toxic).all()


# pages


def test_pages_on_held_out_layouts():
    field = pages.train()
    page_list = list(pages.training_pages(200, 77))
    right = total = 0
    for page in page_list:
        got = field.decode([f for f, _ in page])
        right += sum(a == b for a, (_, b) in zip(got, page))
        total += len(page)
    assert right / total > 0.97


def test_page_text_exact():
    field = pages.train()
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class=site>Name</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First   line&nbsp;here<br>and <b>mo</b>re.<!-- no <p>x</p> --><p>Second &lt;p&gt; one<script>var t="</p>";</script>.</p>
    <div class="ad">Buy now</div><p>Third and last paragraph of it.</p></article><section id=comments><p>Nice text, I like it a lot.</p></section><footer>&copy; me</footer></body>"""
    assert pages.main_text(page, field) == "A & B First line here and more. Second <p> one. Third and last paragraph of it."
    assert pages.main_text("<b>" * 3000 + "<div>" * 3000, field) == ""


def test_pages_of_the_tables(spark):
    import html

    for r in pages.op1_page_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


# URLs


@pytest.mark.parametrize("most", [20_000, 2])
def test_urls_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rng = random.Random(6)
    hosts = ["net", "example.net", "x.example.net", "notexample.net", "example.com", "A.Example.COM", "org", "a.b.c.org", "net.com", ""]
    rows = [(k, f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/de/x/y', '/fr/?q#f', '?a/en/', '//en/'])}") for k in range(400)] + [(500, None), (501, "example.net/en/")]
    rules = [*urls.RULES, ("block", "example.net", "/en/deep"), ("allow", "b.c.org", ""), ("block", "org", "/f")]

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(UP), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    table = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(table, rules).collect()}
    assert got == {k: judge(u) for k, u in rows}
