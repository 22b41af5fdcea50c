"""The training-data operators against brute force, the tokenizer library, exact round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.llm import common, components, exact_dedup, html_extract, langid, mixing, packing, quality, simhash, token_counts, toxicity, warc
from brindle.llm.bpe_fst import Transducer
from brindle.llm.dom import blocks, parse
from brindle.llm.textfeat import Piece

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def fst():
    return Transducer(VOCABULARY)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def sample_rows():
    """Nulls, empty and blank texts, copies with other white space, near copies, a long text, a hot source, repeated rows."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeiou", k=r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(40)]
    rows = [(k, base[k % 40] if k % 3 else base[0], "hot" if k % 2 else f"s{k % 5}") for k in range(100)]
    rows += [(100, None, "hot"), (101, "", None), (102, " \n\t", "s1"), (103, base[1].replace(" ", "\n "), "s2"), (104, base[2] + " extra", "s3")]
    rows += [(105, " ".join(base) * 3, "s4"), (106, "x", None), (106, "x", None), (107, "éß " * 30, "é")]
    return rows


# -- tokenizer -----------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("aabcdeest'lvrmd 019!?.*<|>$\n\t\x00\x1c\x85 ") + ["é", "́", "İ", "Σ", "漢", "\U0001f600", "ﬁ", "ᄀ", "ᅡ", "'s", "'re", "<|endoftext|>"]), max_size=40).map("".join), min_size=1, max_size=6))
def test_transducer_agrees_with_the_library(library, fst, texts):
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert fst.counts(texts).tolist() == [len(w) for w in want]
    ids, n = fst.ids(texts)
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_transducer_on_long_words(library, fst):
    texts = ["a" * 2000, "thing" * 300, "x'" * 900, "é" * 700, "1" * 500]
    assert fst.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_forgets_and_goes_on(library, monkeypatch):
    import brindle.llm.bpe_fst as m

    monkeypatch.setattr(m, "MOST_STATES", 50)
    t = Transducer(VOCABULARY)
    for text in ("some words here", "other strange things", "some words here again"):
        assert t.counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_token_counts(spark, library):
    rows = sample_rows()
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(spark, rows), VOCABULARY, 100).collect()}
    want = {(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, _ in rows}
    assert got == want
    assert token_counts.token_counts(docs_of(spark, []), VOCABULARY).count() == 0


# -- packing -------------------------------------------------------------


def test_packing(spark, library):
    rows = sample_rows() + [(None, "no id here", "s1"), (None, "no id here", "s1")]
    out = packing.pack(docs_of(spark, rows), VOCABULARY, length=64, window_sequences=4).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    times = Counter(i for i, _, _ in rows)
    covered = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in covered.items():  # each token as often as the row is there
        assert all(n > 0 for _, n in parts)
        assert Counter(k for start, n in parts for k in range(start, start + n)) == Counter(dict.fromkeys(range(len(ids[i])), times[i]))
    assert set(covered) == set(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(docs_of(spark, []), VOCABULARY).count() == 0


def test_windows_keep_the_proportions(spark):
    rows = [(i, "word " * 40, "big" if i % 4 else "small") for i in range(400)]
    out = packing.pack(docs_of(spark, rows), VOCABULARY, length=64, window_sequences=16)
    shares = out.groupBy("window").pivot("source", ["big", "small"]).agg(F.sum("length")).collect()
    for r in shares[:-1]:
        assert 0.15 < r.small / (r.big + r.small) < 0.35


def test_packing_to_targets(spark, library):
    """In every window while its queue lasts a source has its target to within a document; all tokens are packed."""
    r = random.Random(5)
    rows = [(i, "word " * r.randint(5, 60), s) for i, s in enumerate(["a"] * 300 + ["b"] * 300 + [None] * 150 + ["c"] * 40)]
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    held, most = Counter(), max(size(t) for _, t, _ in rows)
    for _, t, s in rows:
        held[s] += size(t)
    for targets in ({"a": 0.6, "b": 0.3}, {"b": 0.5, None: 0.5}, None):
        out = packing.pack(docs_of(spark, rows), VOCABULARY, length=64, window_sequences=32, targets=targets).collect()
        assert sum(x.length for x in out) == sum(held.values())
        by = defaultdict(Counter)
        for x in out:
            by[x.window][x.source] += x.length
        quantum = {s: w * 64 * 32 for s, w in targets.items()} if targets else {s: n / len(by) for s, n in held.items()}
        dry, done = False, Counter()
        for k, w in enumerate(sorted(by)):
            done.update(by[w])
            dry = dry or any(done[s] >= held[s] - most for s in held)
            if dry:
                break
            for s in quantum:
                assert -most < done[s] - quantum[s] * (k + 1) <= 1, (targets, s, k)
        assert k > 3
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, rows), VOCABULARY, targets={"a": 0.8, "b": 0.4})


# -- mixing --------------------------------------------------------------


def test_mixing(spark):
    rows = sample_rows()
    out = mixing.mix_sources(docs_of(spark, rows)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = Counter()
    for i, t, s in rows:
        by[s] += len(WORD.findall(t or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_, budget = {}, set(order), 1.5 * sum(by.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * by[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * by[s] for s in full}
        budget -= sum(2 * by[s] for s in full)
        open_ -= full
    taken = Counter()
    largest = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(out) == len(rows)
    for s in order:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix_sources(docs_of(spark, rows[::-1])).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0


def test_mixing_agrees_in_any_layout(spark):
    """Null and repeated ids, equal rows, other partitions: the same rows are taken; whole rows are repeated alike."""
    r = random.Random(3)
    rows = [(None, " ".join(r.choices("abcdef", k=r.randint(1, 60))), "s") for _ in range(80)]
    rows += [(1, " ".join(r.choices("abcdef", k=r.randint(1, 60))), "s") for _ in range(40)] + [(2, "x y z", "t")] * 90 + [(3, "w " * 9, "t")] * 10
    runs = []
    for k in (1, 7):
        r.shuffle(rows)
        docs = docs_of(spark, rows).repartition(k)
        out = mixing.mix_sources(docs).collect()
        taken = sum(x.taken for x in out if x.source == "t")
        assert abs(taken - next(x.target for x in out if x.source == "t")) <= 9
        runs.append(Counter((x.doc_id, x.size, x.taken) for x in out))
        whole = Counter((x.doc_id, len(WORD.findall(x.text))) for x in mixing.mixed(docs).collect())
        want = Counter()
        for x in out:
            want[x.doc_id, x.size] += x.copies
        assert whole == +want
    assert runs[0] == runs[1]


def test_mixing_draws_unequal_probabilities(spark):
    """Over seeds a document's copies are about those expected of its size and source, and ranks follow the odds."""
    rows = [(k, "w " * (3 if k % 2 else 300), "a") for k in range(120)] + [(200 + k, "w " * 50, "b") for k in range(100)]
    docs = docs_of(spark, rows)
    copies, n = Counter(), 10
    for seed in range(n):
        out = mixing.mix_sources(docs, weights=(1, 1), share=0.7, seed=seed).collect()
        for x in out:
            copies[x.source, x.size] += x.copies
        for s in "ab":  # those in are before those out
            ranked = sorted((x.rank_odds, x.copies - min(y.copies for y in out if (y.source, y.size) == (s, x.size))) for x in out if x.source == s)
            taken = [c > 0 for _, c in ranked]
            assert taken == sorted(taken, reverse=True)
    size, target = {"a": 60 * 303.0, "b": 5000.0}, out[0].target
    goal = {x.source: x.target for x in out}
    level = goal["a"] / (60 * (3 * 10 + 300 * 17))
    for s, k, expected in (("a", 3, level * 10), ("a", 300, level * 17), ("b", 50, goal["b"] / size["b"])):
        mean = copies[s, k] / (n * sum(1 for _, t, x in rows if x == s and len(t) // 2 == k))
        assert abs(mean - expected) < 0.09, (s, k, mean, expected, target)


# -- exact duplicates ----------------------------------------------------


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\r\x0b\x0c")


def brute_groups(rows):
    """(id, keep, size, kept, sha) with exactly one kept row a group."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            want[m[3], members[0][3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return want


ODD_ROWS = [(5, "a b c", "s"), (5, "abc", "s"), (6, "a bc", "s"), (None, "a  b  c", "s"), (None, "q", "s"), (None, "q", "s"), (7, "q", None), (None, None, None), (None, "", None)]


@pytest.mark.parametrize(("capacity", "key"), [(1024, None), (3, "length"), (1, "one")])
def test_exact_dedup(spark, capacity, key):
    """Also with keys that collide (chains), share long prefixes (pages) or are hot, and with null and repeated ids."""
    keys = {None: F.xxhash64, "length": lambda c: F.length(c).cast("long"), "one": lambda c: F.lit(-7).cast("long")}
    rows = sample_rows() + ODD_ROWS
    docs = docs_of(spark, rows)
    out = exact_dedup.exact_dedup(docs, capacity=capacity, key=keys[key]).collect()
    want = brute_groups(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want
    chains = defaultdict(set)
    for r in out:
        chains[r.text_sha256].add((r.bucket, r.chain))
    assert all(len(c) == 1 for c in chains.values())
    if key == "one":  # one chain holds all texts
        assert {c for x in chains.values() for _, c in x} == set(range(1, len(chains) + 1))
    kept = exact_dedup.distinct_rows(docs, capacity=capacity, key=keys[key])
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, squeezed(r.text)) for r in kept.collect()) == Counter((x[1], n) for n in {squeezed(t) for _, t, *_ in rows} for x in want if x[3] and x[4] == hashlib.sha256(n.encode()).hexdigest())


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0 and exact_dedup.distinct_rows(docs_of(spark, [])).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select((F.col("id") % 16).cast("int").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    leaves = exact_dedup.directory(keys, 4, 130).collect()
    assert len(leaves) == 16 and {r.depth for r in leaves} == {3} and all(r.held <= 130 for r in leaves)
    assert all(r.bucket == r.prefix >> 1 << 1 for r in leaves)


def test_owners_hold_ranges_of_buckets(spark):
    index = exact_dedup.build(spark.range(5000).select(F.xxhash64("id").alias("key")), 100)
    rows = index.entries.orderBy("bucket").collect()
    assert [r.owner for r in rows] == sorted(r.owner for r in rows) and len({r.owner for r in rows}) == index.owners
    assert not index.any_hot and all(r.pages == 1 for r in rows)


# -- near duplicates -----------------------------------------------------


def test_cover_misses_no_link():
    code, r = simhash.Cover(), random.Random(9)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 2)):
            y ^= 1 << b
        (hx, vx), (hy, vy) = code.reach(x), code.reach(y)
        assert hx == hy or (hy in vx.tolist() and hx in vy.tolist())


def test_simhash_groups(spark):
    rows = sample_rows()
    out = simhash.simhash_groups(docs_of(spark, rows)).collect()
    fp = {i: simhash.fingerprint_of((t or "").encode()) for i, t, _ in rows}
    assert all(r.fingerprint == format(fp[r.doc_id], "016x") for r in out) and len(out) == len(rows)
    label = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if label[b] < label[a] and (fp[a] ^ fp[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    assert all(r.component_id == label[r.doc_id] for r in out)
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0


def test_simhash_links_over_null_and_repeated_ids(spark, monkeypatch):
    fps = {"a": 0b0, "b": 0b11, "c": 0b1111, "far": 0xFFFF0000, "near far": 0xFFFF0001, "alone": 0xFFFF << 40}
    of = F.create_map(*[F.lit(x) for kv in fps.items() for x in kv])
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle, i, t: docs.select(i, of[F.col(t)].cast("long").alias("fp")))
    rows = [(1, "a", "s"), (None, "b", "s"), (2, "c", "s"), (1, "far", "s"), (0, "near far", "s"), (None, "alone", "s")]
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs_of(spark, rows)).collect()}
    assert out == {(i, format(fps[t], "016x")): c for (i, t, _), c in zip(rows, (1, 1, 1, 0, 0, None), strict=True)}


def broadcasts(df):
    """Joins of a plan by Spark's own choice of a broadcast."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_growing_tables_are_not_broadcast_by_their_estimate(spark, monkeypatch):
    # files of a few kB, and 80 rows made of each fingerprint: all far below Spark's bound of 10 MB by its estimate
    plans, plain, held = {}, simhash.stored, components.components
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.update({name: broadcasts(df)}) or plain(df, name))
    monkeypatch.setattr(simhash, "components", lambda edges: plans.update(edges=broadcasts(edges)) or held(edges))
    plans["out"] = broadcasts(simhash.simhash_groups(docs_of(spark, sample_rows())))
    assert plans == dict.fromkeys(["simhash", "simhash-nodes", "simhash-links", "edges", "simhash-named", "out"], 0)


def joins(df):
    """How and by which key a plan joins, from the top."""
    return re.findall(r"(\w+Join) \[([^\]]*)", df._jdf.queryExecution().executedPlan().toString())


def test_stages_do_not_broadcast_what_grows(spark, monkeypatch):
    keys = spark.range(64).select(F.col("id").cast("int").alias("prefix"), F.lit(9).alias("n"))
    assert [j for j, _ in joins(exact_dedup.directory(keys, 6, 20))] == ["SortMergeJoin"]
    docs = docs_of(spark, sample_rows())
    assert next(j for j, on in joins(packing.pack(docs, VOCABULARY)) if on.startswith("row#")) == "SortMergeJoin"
    # of the order of all rows and the cuts of the sources, the cuts
    plans, plain = {}, mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    few = mixing.mix_sources(docs).collect()
    assert re.search(r"BroadcastHashJoin \[coalesce\(source.*block.*Inner, Build(\w+)", plans["mix-plan"])[1] == "Right"
    monkeypatch.setattr(common, "FEW_ROWS", 2)
    assert Counter(few) == Counter(mixing.mix_sources(docs).collect())
    assert re.search(r"(\w+Join) \[coalesce\(source.*block.*Inner", plans["mix-plan"])[1] == "SortMergeJoin"


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


# -- quality, toxicity, language -----------------------------------------


def labelled(spark, n=240):
    r = random.Random(2)
    good, bad = ["calm", "river", "stone", "paper", "light", "garden"], ["buy###", "win$$$", "now***", "deal&&&"]
    rows, labels = [], []
    for i in range(n):
        q = i % 3 > 0
        toxic = i % 5 < 2
        words = r.choices(good if q else bad, k=40)
        if toxic:
            words[r.randrange(40)] = r.choice(["Idiot!", "moron", "(trash)"])
        rows.append((i, " ".join(f"{w}{r.randrange(30)}" if r.random() < 0.5 else w for w in words), "s"))
        labels.append((i, int(q), int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "w\n" * 100, "s"), (1003, "a b c d e f g h " * 10, "s")]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def brute_rules(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark):
    docs, labels, rows = labelled(spark)
    out = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t, _ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t or "")
        assert not (r.kept and r.base_failed)
    scored = [(out[i].quality, i % 3 > 0) for i in range(240)]
    assert np.mean([(q >= 0.5) == y for q, y in scored]) > 0.95
    assert quality.quality_rules(docs_of(spark, []), labels).count() == 0
    assert quality.quality_rules(docs, labels.where("false")).where("kept").count() >= 200


def test_toxicity(spark):
    docs, labels, _ = labelled(spark)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in out.items())
    held = [i for i in range(240) if out[i].held_out]
    assert np.mean([out[i].predicted == (i % 5 < 2) for i in held]) > 0.85
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, changed).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-12 for i in out)  # held-out labels teach nothing
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0


def test_toxicity_by_plain_ftrl():
    """The batch form against the published update, feature by feature."""
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 300, 12)).astype(np.int32) for _ in range(400)]
    y = np.array([int(np.isin([3, 50, 70], x).any()) for x in rows])
    got = toxicity.ftrl(rows, y, alpha=0.5, l1=2.0, l2=1.0, passes=2)
    l1, weight = 2.0 * (400 / 8000) ** 0.5, min(4.0, (400 - y.sum()) / y.sum())
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((1.0 + n[i] ** 0.5) / 0.5 + 1.0)

    for _ in range(2):
        for x, goal in zip(rows, y.tolist(), strict=True):
            bias = -bz / ((1.0 + bn**0.5) / 0.5)
            g = (1 / (1 + np.exp(-(sum(w(i) for i in x.tolist()) + bias))) - goal) * (weight if goal else 1.0)
            if abs(g) < 1e-4:
                continue
            for i in x.tolist():
                old, s = w(i), ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i], n[i] = z[i] + g - s * old, n[i] + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / 0.5 * bias
            bn += g * g
    want = {i: w(i) for i in z if abs(w(i)) > 0}
    assert set(got.at.tolist()) == set(want)
    assert all(abs(want[i] - v) < 1e-6 for i, v in zip(got.at.tolist(), got.value.tolist(), strict=True))
    text = ["bad word here bad word", "", "nothing"]
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    p = Piece(*_buffers(text))
    at, doc = toxicity.grams(p)
    dense[at[doc == 0][:2]] = 0.7
    each = [sum(dense[b] for b in set(at[doc == k].tolist())) for k in range(3)]
    assert np.allclose(toxicity.Weights.score(p, dense, -0.2), 1 / (1 + np.exp(-(np.array(each) - 0.2))))


def _buffers(texts):
    raw = "".join(texts).encode()
    return np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_language_by_plain_em(spark):
    """Sets and proportions against expectation-maximisation word by word, with the same likelihoods and penalty."""
    r = random.Random(16)
    parts = {"aa": ["thing", "with", "shore"], "bb": ["schnee", "nicht", "wald"], "cc": ["quelle", "avec", "beau"]}
    say = lambda k, n: " ".join(r.choice(parts[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(k, 30), k, "s", 1) for i in range(90) for k in [list(parts)[i % 3]]], DOCS)
    model = langid.fit(docs)
    texts = [say("aa", 40), say("aa", 20) + " " + say("bb", 30), " ".join(say(k, 25) for k in parts), "", "12 !", say("cc", 1), say("bb", 50) + " " + say("aa", 2)]
    p = langid._piece(*_buffers(texts))
    share, used = model.infer(p)
    ll = model.words(p)

    def em(like, start, rounds):
        s = start
        for _ in range(rounds):
            s = np.mean([like_w * s / ((like_w * s).sum() + 1e-300) for like_w in like], axis=0)
        return s, sum(np.log((like_w * s).sum() + 1e-300) for like_w in like)

    for d in range(len(texts)):
        mine = ll[p.doc == d]
        if not len(mine):
            assert not used[d].any()
            continue
        like, top = np.exp(mine - mine.max(axis=1, keepdims=True)), mine.max(axis=1).sum()
        best = mine.sum(axis=0)
        want, value = np.eye(3)[best.argmax()], best.max()
        first, _ = em(like, np.full(3, 1 / 3), langid.ROUNDS)
        for k in (2, 3):
            start = np.zeros(3)
            for x in np.argsort(-first, kind="stable")[:k]:
                start[x] = first[x] + 1e-3
            got, gain = em(like, start / start.sum(), 3)
            if gain + top <= value + langid.PRICE * np.log(max(len(mine), 2)):
                break
            want, value = got, gain + top
        assert np.allclose(share[d], want, atol=1e-9), texts[d]


def test_calibration_is_the_best_line():
    r = np.random.default_rng(8)
    z = r.normal(size=400) * 2
    y = (r.random(400) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    a, b = quality.calibrate(z, y)
    pos, neg = y.sum(), 400 - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * z + b)))
        return -(goal * np.log(p) + (1 - goal) * np.log(1 - p)).sum()

    assert all(loss(a, b) <= loss(a + i, b + j) + 1e-3 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))


def test_minimise_finds_the_least_of_a_logistic_loss():
    r = np.random.default_rng(9)
    x, w = r.normal(size=(200, 6)), r.normal(size=6)
    y = (r.random(200) < 1 / (1 + np.exp(-(x @ w)))).astype(float)

    def f(v):
        p = 1 / (1 + np.exp(-(x @ v)))
        return float(np.logaddexp(0, -(x @ v) * (2 * y - 1)).mean() + 0.005 * v @ v), x.T @ (p - y) / 200 + 0.01 * v

    got, plain = quality.minimise(f, np.zeros(6), 60), np.zeros(6)
    for _ in range(4000):
        plain -= 0.5 * f(plain)[1]
    assert np.allclose(got, plain, atol=2e-3) and f(got)[0] <= f(plain)[0] + 1e-6


def test_repeated_rows_and_ties(spark):
    """Rows alike get alike results, whatever stands around them; equal languages give the first by name."""
    docs, labels, rows = labelled(spark)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 5000)).repartition(5, "doc_id")
    model = toxicity.fit(docs, labels)
    for out, columns in ((toxicity.toxicity(twice, labels), ("score", "predicted")), (quality.judge(twice, quality.fit(docs, labels)), ("n_words", "kept", "quality")), (langid.identify(twice), ("lang_pred", "score"))):
        by = {r.doc_id: tuple(r[c] for c in columns) for r in out.collect()}
        assert all(by[i] == by[i + 5000] for i in range(0, 240, 3)) and len(by) > 240
    assert len(model.at) > 0
    tie = spark.createDataFrame([(i, "same words here and there", "ab"[i % 2], "s", 1) for i in range(80)], DOCS)
    tie = tie.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    even = tie.groupBy("lang").count().agg(F.min("count")).first()[0]
    picked = tie.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where(F.col("n") <= even).drop("n")
    assert {r.lang_pred for r in langid.identify(picked).collect()} == {"a"}
    r = random.Random(31)
    page = html_extract.made_page(r)
    pages = spark.createDataFrame([(i, "u", page if i % 2 else html_extract.made_page(r)) for i in range(20)], "page_id long, url string, html string")
    assert len({x.text for x in html_extract.main_text(pages).where("page_id % 2 = 1").collect()}) == 1


def test_language_model_is_bounded():
    assert langid.buckets_for(4) == langid.BUCKETS and langid.buckets_for(5000) * 5000 * 12 <= langid.MODEL_BYTES


def test_language(spark):
    r = random.Random(6)
    parts = {"aa": ["thing", "with", "shore", "other", "and"], "bb": ["schnee", "und", "nicht", "wald", "grau"], "cc": ["était", "quelle", "une", "avec", "beau"]}
    say = lambda k, n: " ".join(r.choice(parts[k]) + r.choice(["", "e", "n"]) for _ in range(n))
    rows = [(i, say(k, 30), k, "s", 1) for i in range(150) for k in [list(parts)[i % 3]]]
    rows += [(900, say("aa", 60) + " " + say("bb", 60), None, "s", 1), (901, None, "aa", "s", 0), (902, "123 !!", "aa", "s", 0), (903, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [i for i in range(150) if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert np.mean([out[i].lang_pred == list(parts)[i % 3] for i in held]) > 0.95
    assert set(out[900].langs) == {"aa", "bb"} and abs(out[900].shares[0] - 0.5) < 0.15
    assert [out[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3
    assert langid.identify(docs.where("false")).count() == 0


def test_language_sets_have_no_bound(spark):
    r = random.Random(8)
    letters = "bcdfghjklmnpqrstvwxz"
    names = [f"l{k}" for k in range(6)]
    stems = {k: ["".join(r.choices(letters[3 * x : 3 * x + 3], k=6)) for _ in range(6)] for x, k in enumerate(names)}
    say = lambda k, n: " ".join(r.choice(stems[k]) for _ in range(n))
    rows = [(i, say(names[i % 6], 30), names[i % 6], "s", 1) for i in range(240)] + [(900, " ".join(say(k, 60) for k in names), None, "s", 1)]
    found = langid.identify(spark.createDataFrame(rows, DOCS)).where("doc_id = 900").first()
    assert set(found.langs) == set(names) and all(abs(x - 1 / 6) < 0.05 for x in found.shares)


def test_quality_fits_on_3000_rows(spark):
    docs = spark.range(3200).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"))
    seen = []
    keep = quality.calibrate
    quality.calibrate = lambda z, y: seen.append(len(y)) or keep(z, y)
    try:
        quality.quality_rules(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    finally:
        quality.calibrate = keep
    assert seen == [600]  # a fifth of the rows


# -- pages ---------------------------------------------------------------


def test_dom_blocks():
    nodes, stream = parse("<title>t</title><p>a <b>b<br>c<p>d&amp;&eacute;<script>x</p></script><ul><li>e<li>f</ul><!-- g -->h")
    assert blocks(stream) == ["a b c", "d&é", "e", "f", "h"]
    assert blocks(parse("")[1]) == [] and blocks(parse("<p")[1]) == []
    assert len(nodes) == 10


def test_dom_head_without_end():
    for page in (
        "<html><head><title>t</title><meta charset=x><body><article><p>a<p>b</article></html>",
        "<head><style>s</style>\n<div>a</div><p>b",
        "<head> <script>s</script> a<p>b",
        "<html><head><title>t</title><head><link rel=x></head><p>a<p>b",
    ):
        nodes, stream = parse(page)
        assert blocks(stream) == ["a", "b"], page
        assert all(nodes[n.parent].tag != "head" for n in nodes if n.tag in ("body", "article", "div", "p"))
    assert blocks(parse("<head><title>t</title> <!-- x --> <meta name=y></head>z")[1]) == ["z"]


def test_dom_odd_markup():
    assert blocks(parse("<p it's>Hello one</p><p>don't go</p><p>third</p>")[1]) == ["Hello one", "don't go", "third"]
    assert blocks(parse("<p title='a > b' x=\"c > d\" y = e'f>one</p><p a=\">two</p>")[1]) == ["one", "two"]
    assert blocks(parse("<p>a</p><iframe src=x><p>b</p>")[1]) == ["a", "b"]
    assert blocks(parse("<p>a</p><noscript><p>b</p></noscript><p>c</p><script>d")[1]) == ["a", "c"]
    assert html_extract.attribute_words(" class='main Box' it's id=left-col data-x=\"ad\"") == ["main", "box", "left", "col"]


def test_dom_is_linear():
    import time

    start = time.time()
    for page in ("<span>" * 40000 + "x", "<p>" + "<i>" * 20000 + "</b>" * 20000, "<a b=\"" * 20000, "<p " + "='x" * 20000, "<iframe>" * 300 + "x" * 10**5):
        parse(page)
    assert time.time() - start < 20


def test_trees_and_decoding_by_brute_force():
    """Scores node by node and tree by tree, and a decoding that multiplies probabilities along each path."""
    r, trees = random.Random(70), html_extract.model()
    for _ in range(5):
        nodes, stream = parse(html_extract.made_page(r))
        x = html_extract.node_features(nodes, stream)
        kept = []
        for i, row in enumerate(x):
            z = trees.bias
            for splits, value in trees.trees:
                leaf = 0
                for choice in splits:
                    f, cut = int(choice[leaf, 0]), int(choice[leaf, 1])
                    leaf = 2 * leaf + (cut < len(trees.edges[f]) and row[f] > trees.edges[f][cut])
                z += value[leaf]
            assert abs(z - trees.score(x)[i]) < 1e-9
            p, at = 1.0, i
            while at > 0:
                p *= 1 / (1 + np.exp(-trees.score(x)[at]))
                at = nodes[at].parent
            kept.append(p >= 0.5)
        assert html_extract.decode(nodes, trees.score(x).tolist()) == kept


def test_main_text_without_head_end(spark):
    r = random.Random(78)
    pages = [p for p in (html_extract.made_page(r) for _ in range(30)) if "</head>" in p]
    rows = [(i, "u", p) for i, p in enumerate(pages)] + [(100 + i, "u", p.replace("</head>", "")) for i, p in enumerate(pages)]
    out = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert any(out.values()) and all(out[i] == out[100 + i] for i in range(len(pages)))


def test_decoding_never_keeps_a_child_of_a_dropped_node():
    nodes, _ = parse("<div><p><b>x</b></p></div><p>y")
    assert html_extract.decode(nodes, [9.0, -9.0, 9.0, 9.0, 9.0]) == [True, False, False, False, True]


def test_main_text(spark):
    r = random.Random(77)
    pages = [html_extract.made_page(r) for _ in range(60)]
    rows = [(i, "u", p) for i, p in enumerate(pages)] + [(98, "u", None), (99, None, "")]
    out = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    same = 0
    for i, p in enumerate(pages):
        nodes, stream = parse(p)
        gold = "\n\n".join(blocks(stream, [k == 0 or "data-gold" in n.attrs for k, n in enumerate(nodes)]))
        same += gold == out[i].text
        assert out[i].n_chars == len(out[i].text)
    assert same >= 45
    assert out[98].text == out[99].text == ""
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WARC_ROWS = [(3, "http://a", "<p>x</p>"), (1, "http://a\r\nb", "<p>x</p>"), (2, None, None), (5, "u", ""), (4, "u", "é" * 5000), (4, "u", "é" * 5000), (1, "again", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "q"), (None, "n", "q")]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_warc(spark, tmp_path, monkeypatch, hot):
    """One response a payload, also where the smallest id repeats or is null, or the payload is hot."""
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    monkeypatch.setattr(warc, "MOST_HOT", 10**6)
    pages = spark.createDataFrame(WARC_ROWS, "page_id long, url string, html string")
    got = warc.digests(warc.archive(pages, f"file://{tmp_path}/a"))
    groups = defaultdict(list)
    for i, _, h in WARC_ROWS:
        groups[h or ""].append(i)
    want = Counter()
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        raw = h.encode()
        for k, i in enumerate(ids):
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if k else "response", ids[0] if k else None] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    read = lambda: spark.read.format("warc").load(f"file://{tmp_path}/a")
    assert read().where("record_type = 'revisit'").count() == len(WARC_ROWS) - len(groups)
    assert bytes(read().where("record_id = '<urn:page:4>' AND record_type = 'response'").first().payload) == ("é" * 5000).encode()
    assert read().where("payload_ok").count() == len(groups) and read().where("NOT payload_ok").count() == 0
    small = warc.digests(warc.archive(pages, f"file://{tmp_path}/b", least_bytes=9)).collect()
    assert [r.record_type for r in small].count("revisit") == 1 and len(small) == len(WARC_ROWS)
    assert warc.archive(pages.where("false"), f"file://{tmp_path}/c").count() == 0
    again = warc.to_records(pages.where("page_id = 2"))
    for n in (len(WARC_ROWS) + 1, len(WARC_ROWS) + 2):
        again.write.format("warc").mode("append").save(f"file://{tmp_path}/a")
        assert spark.read.format("warc").load(f"file://{tmp_path}/a").count() == n
    for _ in range(2):
        again.write.format("warc").mode("overwrite").save(f"file://{tmp_path}/a")
        assert spark.read.format("warc").load(f"file://{tmp_path}/a").count() == 1
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) == 1


def ordinary_records():
    """Records as crawlers write them: other types, HTTP without a length, a folded header, a chunked body."""

    def record(kind, block, **headers):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
        return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"

    html = b"<p>" + bytes(random.Random(1).choices(range(256), k=300_000)) + b"</p>"
    return [
        record("warcinfo", b"software: x\r\nformat: WARC\r\n", WARC_Record_ID="<urn:1>", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", WARC_Record_ID="<urn:2>", WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + html, WARC_Record_ID="<urn:3>", WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:" + warc.digest_of(html)),
        record("metadata", b"fetchTimeMs: 3\r\n", WARC_Record_ID="<urn:4>\r\n  folded", Content_Type="application/warc-fields"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n", WARC_Record_ID="<urn:5>", Content_Type="application/http", WARC_Payload_Digest="sha1:" + warc.digest_of(b"x")),
        record("response", b"HTTP/1.1 200 OK\r\n\r\nbad", WARC_Record_ID="<urn:6>", Content_Type="application/http", WARC_Payload_Digest="sha1:" + warc.digest_of(b"good")),
        record("resource", b"", WARC_Record_ID="<urn:7>", WARC_Target_URI="file:///e"),
    ], html


def test_ordinary_warc_files(spark, tmp_path):
    import gzip

    records, html = ordinary_records()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "deep" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))  # one member holds all
    (tmp_path / "in" / "notes.txt").write_text("no archive")
    warc.register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}/in")
    out = got.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.first("record_type").alias("type"), F.first("payload_bytes").alias("size"), F.first("payload").alias("payload"), F.first("payload_ok").alias("ok"), F.countDistinct("payload").alias("same"))
    by = {r.record_id: r for r in out.collect()}
    assert all(r.n == 3 and r.same == 1 for r in by.values()) and len(by) == 7
    assert [by[f"<urn:{k}>"].type for k in (1, 2, 3, 5, 7)] == ["warcinfo", "request", "response", "response", "resource"] and by["<urn:4> folded"].type == "metadata"
    assert bytes(by["<urn:3>"].payload) == html and by["<urn:3>"].ok and by["<urn:3>"].size == len(html)
    assert by["<urn:5>"].ok is None and by["<urn:6>"].ok is False and by["<urn:7>"].size == 0 and bytes(by["<urn:1>"].payload).startswith(b"software")
    assert spark.read.format("warc").load(f"file://{tmp_path}/in/a.warc").where("record_type = 'response' AND target_uri LIKE 'http%'").count() == 1
    assert spark.read.format("warc").load(f"file://{tmp_path}/in").where("record_type = 'nothing'").count() == 0
    (tmp_path / "in" / "bad.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx")
    with pytest.raises(Exception, match="Content-Length"):
        spark.read.format("warc").load(f"file://{tmp_path}/in/bad.warc").count()


def test_warc_bytes_made_for_skipped_payloads(tmp_path):
    """Of unwanted payloads nothing is read in plain files and in members that tell their length."""
    import gzip
    import io

    records, html = ordinary_records()
    reader = warc.WarcReader({"path": "x"})
    reader.want = [("in", "record_type", ("metadata",))]
    own = b"".join(warc.encode_record({"WARC-Type": "response"}, html, len(html)) for _ in range(5))
    for data, found, most in ((b"".join(records), 1, 150_000), (own, 0, 5 * 40_000), (b"".join(map(gzip.compress, records)), 1, 10**6)):
        assert len(list(reader.records(io.BytesIO(data), 0, -1))) == found
        assert reader.stream.made < most
    assert len(own) > 5 * 250_000


def test_warc_reader_skips_by_header():
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "https:"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.want) == 2
    values = dict.fromkeys(warc.HEADERS) | {"record_type": "response", "target_uri": "https://a"}
    assert reader.wanted(values) and not reader.wanted(values | {"target_uri": None})


# -- tables of odd shape ---------------------------------------------------


def test_clashing_columns_and_null_ids(spark):
    """Columns with the names that operators use inside, and rows without an id, change no result and crash nothing."""
    rows = [(i, t, "en", s, 1) for i, t, s in sample_rows()[:60]] + [(None, "some words without an id " * 5, "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    odd = docs
    for c in ("id", "key", "norm", "bucket", "sha", "fp", "node", "anchor", "size", "copies", "taken", "row", "block", "upto", "window", "first", "n_tokens", "start", "kept", "score", "order", "y", "quality", "held_out", "component_id", "x", "a", "b"):
        odd = odd.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    runs = [
        lambda d: quality.quality_rules(d, labels).select("doc_id", "n_words", "kept"),
        lambda d: token_counts.token_counts(d, VOCABULARY),
        lambda d: mixing.mix_sources(d).select("doc_id", "size", "taken"),
        lambda d: toxicity.toxicity(d, labels).select("doc_id", "predicted"),
        lambda d: langid.identify(d).select("doc_id", "lang_pred"),
        lambda d: exact_dedup.exact_dedup(d).select("doc_id", "keep_id", "group_size", "kept"),
        lambda d: packing.pack(d, VOCABULARY, length=64).groupBy("doc_id").agg(F.sum("length")),
        lambda d: simhash.simhash_groups(d),
    ]
    for run in runs:
        assert Counter(map(tuple, run(docs).collect())) == Counter(map(tuple, run(odd).collect()))
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, "<p>a</p>"), (2, "v", None)], "page_id long, url string, html string")
    wide = pages.withColumn("text", F.lit("t")).withColumn("payload", F.lit("p")).withColumn("digest", F.lit("d")).withColumn("id", F.lit("i"))
    for run in (lambda p: warc.digests(warc.archive(p)), html_extract.main_text):
        assert Counter(map(tuple, run(pages).collect())) == Counter(map(tuple, run(wide).collect()))


# -- very long texts -------------------------------------------------------


def test_slices_and_parts_of_long_texts(monkeypatch):
    import brindle.llm.textfeat as m

    r = np.random.default_rng(4)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    data[r.integers(0, 5000, 700)] = 32
    start = np.sort(r.integers(0, 4000, 300))
    end = np.minimum(start + r.integers(0, 2000, 300), 5000)
    want = m.hash_slices(data, start, end)
    for size in (64, 1000, 4999, 5000):
        monkeypatch.setattr(m, "HASH_BYTES", size)
        assert (m.hash_slices(data, start, end) == want).all()
    words = bytes(data).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    for back in (0, 1, 3):
        got = []
        for a, b in m.long_parts(data, 0, len(data), 200, back):
            part = [w for w in bytes(data[a:b]).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
            got += [tuple(part[k : k + back + 1]) for k in range(len(part) - back)]
        assert got == [tuple(words[k : k + back + 1]) for k in range(len(words) - back)]


def test_long_texts_in_parts_give_the_same(spark, monkeypatch):
    """Every kernel over texts that it handles in parts agrees with itself over the whole."""
    import brindle.llm.bpe_fst as fst_module
    import brindle.llm.textfeat as m

    docs, labels, rows = labelled(spark)
    model, weights, lang = quality.fit(docs, labels), toxicity.fit(docs, labels), langid.fit(docs)
    dense = weights.dense()
    r = random.Random(20)
    texts = [" ".join(t for _, t, _ in r.sample(rows[:240], 40)), "x" * 3000, "w " * 2000 + "\n" + "w " * 2000, ("line of words here\n" * 300)]
    for t in texts:
        raw, off = _buffers([t])
        whole = Piece(raw, off)
        counts, p = quality.base_counts(whole), model.probability(whole)
        tox = toxicity.Weights.score(Piece(toxicity.letters_only(raw), off, lower=True), dense, weights.bias)
        ll = lang.words(langid._piece(raw, off))
        with monkeypatch.context() as k:
            for module in (m, quality):
                k.setattr(module, "HASH_BYTES", 500)
            k.setattr(toxicity, "PIECE_BYTES", 500)
            again = Piece(raw, off)
            assert all((counts[c] == v).all() for c, v in quality.base_counts(again).items())
            assert np.allclose(model.probability(again), p, atol=1e-9)
            cells = np.unique(np.concatenate([toxicity.Weights.hits(x, dense) for x in toxicity.parts_of(raw)]))
            assert np.allclose(1 / (1 + np.exp(-(weights.bias + dense[cells].sum(dtype=float)))), tox, atol=1e-6)
            parts = [lang.words(langid._piece(raw, np.array([a, b]))) for a, b in m.long_parts(raw, 0, len(raw), 500)]
            assert np.allclose(np.concatenate(parts), ll) and len(ll) == sum(map(len, parts))
    assert fst_module.PART >= 1 << 16


def test_very_long_text_and_many_repeated_rows(spark, library):
    """A text of 3 MB and one row a hundred thousand times, through the operators that look into texts."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdeiou", k=r.randint(1, 9))) for _ in range(5000)]
    long = " ".join(r.choices(words, k=550_000))
    same = " ".join(r.choices(words, k=30))
    docs = docs_of(spark, [(1, long, "a"), (2, "short text", "a")]).unionByName(spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(same).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    n = token_counts.token_counts(docs, VOCABULARY).groupBy("doc_id").agg(F.max("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(x.doc_id, x.n, x.rows) for x in n} == {(1, len(library.encode(long, add_special_tokens=False).ids), 1), (2, 2, 1), (3, len(library.encode(same, add_special_tokens=False).ids), 100_000)}
    marks = simhash.simhash_groups(docs).groupBy("doc_id").agg(F.max("fingerprint").alias("f"), F.count(F.lit(1)).alias("n")).collect()
    assert {(x.doc_id, x.f, x.n) for x in marks} == {(i, format(simhash.fingerprint_of(t.encode()), "016x"), k) for i, t, k in ((1, long, 1), (2, "short text", 1), (3, same, 100_000))}
    groups = exact_dedup.exact_dedup(docs).groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("n")).collect()
    assert {(x.doc_id, x.kept, x.n) for x in groups} == {(1, 1, 1), (2, 1, 1), (3, 1, 100_000)}
    mixed = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(x.taken - x.target) <= (550_000 if x.source == "a" else 30) for x in mixed)
    judged = quality.quality_rules(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).where("doc_id = 1").first()
    assert judged.n_words == 550_000 and judged.word_chars == len(long) - 549_999


# -- pipeline ------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark)
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 500)
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == names, name
        if name == "exact_dedup":
            assert now.where("doc_id >= 500").count() == 0
    assert seen[0] > seen[1] >= seen[2] and seen[3] > 0 and seen[4] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4]


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    """Verdicts belong to rows: null ids stay, rejected rows and copies go although another row of their id is kept."""
    import corpus_pipeline

    docs, labels, rows = labelled(spark)
    r = random.Random(12)
    fresh = lambda: " ".join(f"{r.choice(['calm', 'river', 'stone', 'paper', 'light', 'garden'])}{r.randrange(10**6)}" for _ in range(60))
    none, hot = [fresh() for _ in range(4)], [fresh() for _ in range(30)]
    odd = [(None, t, "s") for t in none] + [(None, none[0], "s")]  # without an id, one of them twice
    odd += [(7000, t, "hot") for t in hot] + [(7000, hot[0], "hot")] * 3 + [(7000, "too short", "hot")]
    odd += [(7001, hot[1], "hot"), (7001, fresh() + " end", "s")]
    docs.unionByName(docs_of(spark, odd)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            texts[name] = Counter((x.doc_id, x.text) for x in now.collect())
    first = texts["quality_rules"]
    assert (7000, "too short") not in first and first[7000, hot[0]] == 4 and first[None, none[0]] == 2
    for name in ("exact_dedup", "simhash_near_dedup"):
        assert all(n == 1 for n in texts[name].values())
        assert {x for x in texts[name] if x[0] is None} == {(None, t) for t in none}
        assert {x for x in texts[name] if x[0] == 7000} == {(7000, t) for t in hot} and (7001, hot[1]) not in texts[name]
        assert sum(x[0] == 7001 for x in texts[name]) == 1
    mixed = texts["mix_sources"]
    assert set(mixed) <= set(texts["simhash_near_dedup"]) and max(mixed.values()) <= 2
    assert any(x[0] is None for x in mixed) and any(x[0] == 7000 for x in mixed)
    assert now.where("doc_id is null").count() > 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """No rows, columns with the names that stages use inside, and other columns of any type go through every stage."""
    import corpus_pipeline

    docs, labels, _ = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.where("doc_id < 90")
    for c in ("row", "key", "whole", "norm", "owner", "bucket", "n", "size", "mark", "cut", "class", "fp", "_copies", "_in", "_size", "_source", "_copy", "kept"):
        odd = odd.withColumn(c, F.struct(F.col("doc_id").alias("a"), F.array(F.lit(c)).alias("b")))
    odd.write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.where("doc_id < 0"), str(tmp_path))
        assert none.count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        plain = stage(spark, odd.select(*docs.columns), str(tmp_path))
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain.collect()), name
        if name != "packing":
            assert got.columns == none.columns == odd.columns and all(r.row.a == r.doc_id for r in got.select("doc_id", "row").collect()), name


def test_fitted_features_come_a_partition_at_a_time_in_order(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from brindle.llm.common import fit_features

    made = [(i % 2, (i * 37) % 101 // 2, np.arange(i % 7, dtype=np.int32).tobytes(), np.full(i % 7, i, np.float32).tobytes()) for i in range(101)]
    made = list({(o, y): (y, o, a, b) for y, o, a, b in made}.values())
    want = sorted(made, key=lambda r: (r[1], r[0]))
    frame = spark.createDataFrame(made, "y int, order long, idx binary, val binary").repartition(5)
    whole, most = DataFrame.toArrow, []
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: most.append(self.columns) or whole(self))
    for limit in (None, 400, 0):
        y, sizes, got = fit_features(frame, limit, idx=np.int32, val=np.float32)
        rows, total = [], 0
        for r in want:
            total += len(r[2])
            if total > (1 << 40 if limit is None else limit):
                rows = [x for x in rows if x[1] < r[1]]
                break
            rows.append(r)
        assert y.tolist() == [r[0] for r in rows] and sizes.tolist() == [len(r[2]) // 4 for r in rows]
        assert got["idx"].tobytes() == b"".join(r[2] for r in rows) and got["val"].tobytes() == b"".join(r[3] for r in rows)
    assert all("idx" not in c and "val" not in c for c in most)
