"""Operators of the training-data package against plain versions, on small tables with every odd row."""

import hashlib
import itertools
import math
import os
import random
import re
import struct
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terracadence.llm import components, features, fingerprint, linededup, mixing, neardup, packing, quality, queries, secrets, shingles, substring, topk, toxicity
from terracadence.llm.common import sliced

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"
VOCAB = [f"w{k}" for k in range(60)] + ["Über", "naïve", "ﬁne"]


def sentence(rnd, n, vocab=VOCAB):
    return " ".join(rnd.choice(vocab) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, and columns that clash with inner names."""
    rnd = random.Random(11)
    passage = sentence(rnd, 30)
    base = [sentence(rnd, rnd.randrange(1, 120)) for _ in range(25)]
    texts = [*base, base[0], base[0], base[3], None, "", " \n\t ", "one", "one two three four", "one two three four", sentence(rnd, 3000)]
    long_ = sentence(rnd, 150)
    for k in range(8):
        words = long_.split()
        words[k * 17] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [f"{sentence(rnd, 8)} {passage} {sentence(rnd, 5)}" for _ in range(5)]
    texts += ["\n".join([sentence(rnd, 12), base[2][:80], "a b c d e f g h i j", sentence(rnd, 3)]) for _ in range(4)] + ["x a b c d e f g h i j\n\ny", "a a a a " * 30]
    return [(k * 3, t, "en", [None, "s1", "s2", "s0"][k % 4], len(t) if t is not None else None) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "x", "y") for r in corpus()]
    return spark.createDataFrame(rows, DOCS + ", id int, key string, cell string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- quality and toxicity


def labelled(spark, n=300):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        good, toxic = k % 3 > 0, k % 5 == 0
        text = sentence(rnd, 60) if good else " ".join(w.upper() + "!!" for w in sentence(rnd, 60).split())
        rows.append((k, text + (f" {rnd.choice(['idiot', 'scum', 'pathetic'])} " if toxic else ""), "en", "s", 100))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_learns(spark):
    docs, labels = labelled(spark)
    out = quality.score(docs, quality.fit(docs, labels), keep=("text",)).withColumn("held", quality.held_out()).join(labels, "doc_id").where("held and quality is not null").collect()
    assert out and sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out) and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)


def test_pair_sum_identity():
    m = quality.FactorisationMachine(0.3, np.arange(5.0), np.random.default_rng(0).normal(size=(5, 3)))
    idx, val = np.array([0, 2, 4]), np.array([1.0, 2.0, -1.0])
    pairs = sum(m.factors[idx[a]] @ m.factors[idx[b]] * val[a] * val[b] for a, b in itertools.combinations(range(3), 2))
    assert m.raw(idx, val, np.array([0]))[0] == pytest.approx(0.3 + m.weights[idx] @ val + pairs)


def test_quality_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.count() == docs.count() and all(0.4 < r.score < 0.6 for r in out.collect())
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_categories_follow_telling_words():
    """Toxic rows of three vocabularies, and some without a telling word."""
    rnd = random.Random(2)
    rows, toxic, kind = [], [], []
    for k in range(400):
        bad, which = k % 4 == 0, rnd.randrange(3)
        own = {100 + which * 5 + rnd.randrange(5) for _ in range(4)} if bad and k % 40 else set()
        rows.append(np.array(sorted({rnd.randrange(60) for _ in range(20)} | own), np.int32))
        toxic.append(int(bad))
        kind.append(which if own else None)
    got = toxicity.find_categories(rows, np.array(toxic), 256, kept=64, count=3)
    assert got.shape == (400, 3) and got.sum() >= sum(k is not None for k in kind)
    for which in range(3):
        mine = [got[i].argmax() for i, k in enumerate(kind) if k == which]
        assert max(map(mine.count, set(mine))) >= 0.9 * len(mine)
    assert not got[np.array(toxic) == 0].any() and not toxicity.find_categories(rows, np.zeros(400), 256).any()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_toxicity_on_held_out_labels(spark):
    """The fold that neither links nor categories have seen."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet".replace("0.001", "0.01")) for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).withColumnRenamed("toxic", "found").join(labels, "doc_id").where(quality.held_out()).collect()
    bad = [r for r in out if r.toxic == 1]
    assert sum(r.found for r in bad) >= 0.6 * len(bad) > 0 and sum(r.found for r in out if r.toxic == 0) <= 0.02 * len(out)


def plain_fm(m, idx, val):
    """The machine by its definition, pair by pair."""
    y = m.bias + float((m.weights[idx] * val).sum())
    for a, b in itertools.combinations(range(len(idx)), 2):
        y += float(m.factors[idx[a]] @ m.factors[idx[b]]) * float(val[a]) * float(val[b])
    return 1 / (1 + math.exp(-max(-30, min(30, y))))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_queries_of_models_score_whole_tables(spark):
    """op1 and op4 against plain sums over the features of each text, and op1 on held-out labels."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model, chain = quality.fit(docs, labels), toxicity.fit(docs, labels)
    texts = by_id(docs)
    got = by_id(queries.op1_quality_fm(spark, TABLES))
    assert set(got) == set(texts) and len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
    for i in sorted(i for i in got if len(texts[i].text or "") < 800)[:150]:
        assert got[i].score == pytest.approx(plain_fm(model, *features.quality_features(texts[i].text or "", texts[i].n_chars, quality.WORD_BITS)), abs=1e-4)
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.9 * len(held) > 0
    for i, r in by_id(queries.op4_toxicity_chain(spark, TABLES)).items():
        words, before = features.word_features(texts[i].text or "", toxicity.WORD_BITS).tolist(), []
        for link in chain:
            weight = dict(zip(link.words.tolist(), link.weights.tolist(), strict=True))
            z = link.bias + sum(weight.get(w, 0.0) for w in words) + sum(e * b for e, b in zip(link.earlier, before, strict=True))
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert [r[f"p_{c}"] for c in toxicity.NAMES] + [r.score] == pytest.approx(before) and r.toxic == int(before[-1] >= 0.5)


def test_toxicity_chain(spark, docs, empty):
    train, labels = labelled(spark)
    chain = toxicity.fit(train, labels)
    held = toxicity.score(train, chain).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(quality.held_out()).where("y is not null").collect()
    assert sum(r.toxic == r.y for r in held) / len(held) > 0.95
    assert len(chain) == len(toxicity.CHAIN) and [len(link.earlier) for link in chain] == list(range(len(chain)))
    assert toxicity.score(docs, chain).count() == docs.count() and toxicity.score(empty, chain).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert all(r.toxic == 0 for r in toxicity.score(docs, none).collect())


def test_structure_of_odd_texts():
    for t in ("", " ", "\n", "x" * 100_000, "a " * 50_000):
        idx, val = features.quality_features(t, None, 10)
        assert len(idx) == len(val) >= len(features.STATS)


# --- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
AKIA = "AKIA" + "ABCDEFGH12345678"


def plain_spans(t):
    a = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    k = [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    h = [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(a + k + h)


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


SECRETS = [
    None, "", "secret=token:abcdef1", "password = hunter22 and token:abc and TOKEN='abcdefg'", f"é😀 {AKIA} x AKIA123 AKIAAKIA{'A' * 12}", "0123456789abcdef01234567 deadbeef", f"api_key={'f' * 30}",
    f"user: alice\npwd: s3cret!!\nlogin=bob99 {AKIA} https://db.example.com/x password=longsecret", "see https://example.com and user: carol", "user: dave" + " " * 300 + "password=faraway1",
    "client_id=abcd1234 " + "Ab1" * 12 + " postgres://u:p@h/db", "x" * 50_000 + " password=abcdef", "token=abcdef " * 500,
]


def test_secret_spans(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(SECRETS)] + [(None, SECRETS[3], 1), (3, SECRETS[3], 1)], "doc_id long, text string, k int")
    raw = secrets.scan(df)
    out = secrets.digest_columns(raw).collect()
    assert len(out) == len(SECRETS) + 2
    for r in out:
        spans = plain_spans(SECRETS[3 if r.doc_id is None else r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(shown(spans).encode()).hexdigest(), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    got = {r.doc_id: r.spans for r in out}
    kinds = lambda k: [s.split(":")[0] for s in got[k].split(",")]
    assert {"weak_id", "weak_secret", "endpoint", "access", "assign"} <= set(kinds(7))
    assert got[8] == "" and got[9] == shown(plain_spans(SECRETS[9])), "nothing complements them, or it is too far"
    assert kinds(10) == ["weak_id", "bare_secret", "endpoint"]
    t, s = SECRETS[7], [x.split(":") for x in got[7].split(",")]
    assert all(0 <= int(a) < int(b) <= len(t) for _, a, b in s) and any(t[int(a) : int(b)] == "user: alice" for _, a, b in s)


def test_secrets_in_a_text_of_many_matches(spark):
    """Places are added up in blocks: 40,000 matches in one text, and counts around the size of a block."""
    texts = [f"token=abcdef{k % 10} " * n for k, n in enumerate((1, 127, 128, 129, 257, 40_000))]
    out = secrets.digest_columns(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for r in out.collect():
        assert r.base_sha256 == hashlib.sha256(shown(plain_spans(texts[r.doc_id])).encode()).hexdigest() and r.n_assign == texts[r.doc_id].count("=")


def test_secrets_of_nothing(spark, empty):
    assert secrets.scan(empty).count() == 0


# --- top-k


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    vecs = {int(i): rnd.normal(0, 0.3, 8).astype(np.float32).tolist() for i in range(0, 900, 3)}
    for i in range(900, 1000):
        vecs[i] = [0.5] * 8
    odd = [(5000, None), (5050, [float("nan")] * 8), (5100, [0.1] * 7 + [None]), (None, [0.1] * 8), (900, [9.0] * 8), (5150, [0.25])]
    df = spark.createDataFrame([*vecs.items(), *odd], "vec_id long, embedding array<float>")
    vecs[5150] = [0.25]
    whole = {i: np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 8 - len(v))) for i, v in vecs.items()}
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted((-(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        want += [(q, k + 1, i, int(-s)) for k, (s, i) in enumerate(best)]
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()))
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_of_huge_values(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e300, 1.0]), (2, [-1e30, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 3, 2] and out[0].score == topk.LARGEST and out[2].score == -topk.LARGEST


def test_blocks_are_pruned_and_whole():
    rnd = np.random.default_rng(2)
    v = np.floor(np.concatenate([rnd.normal(5 * np.eye(16)[k % 16], 0.3, (400, 16)) for k in range(16)]) * 256)
    ids, q = np.arange(len(v)), v[::100]
    got, scored = topk.search_blocks(ids, v, ids[::100], q, 5)
    want = []
    for i, x in zip(ids[::100], q, strict=True):
        s = v @ x
        want += [(int(i), int(j), int(s[j])) for j in sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:5]]
    assert got == want and scored < 0.5 * len(q) * (len(v) / topk.BLOCK_ROWS)


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix(spark, docs, empty):
    out = mixing.mix_sources(docs).collect()
    sizes = {}
    for r in corpus():
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want, source, taken = plain_targets(sizes), {r[0]: r[3] for r in corpus()}, {}
    biggest = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        biggest[s] = max(biggest.get(s, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in want)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) == sorted(map(tuple, out))
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in out)
    assert mixing.mix_sources(empty).count() == 0


def test_water_filling_caps(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(t).collect()}
    assert got == pytest.approx(plain_targets({"a": 1, "b": 1000, "c": 10, None: 0}))


# --- fingerprints


def plain_digest(t):
    c = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    c = re.sub(r"\s+", " ", c).strip(" ").encode()
    first = xxhash.xxh64_intdigest(c, seed=42)
    second = xxhash.xxh64_intdigest(c, seed=xxhash.xxh64_intdigest(struct.pack("<i", 2), seed=42))
    return f"{first:016x}{second:016x}"


def test_edited_fingerprints(spark, docs, empty):
    rows = sorted((r[0], r[1] or "") for r in corpus())
    out = by_id(fingerprint.edited_fingerprints(docs))
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - half] + nxt[:half]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_digest(t) and r.edited_fingerprint == plain_digest(edited)
        assert r.near_edited == float(plain_digest(edited) == plain_digest(t)) and r.near_next == float(plain_digest(nxt) == plain_digest(t))
        same = [j for j, u in rows if plain_digest(u) == plain_digest(t)]
        assert (r.group_id, r.group_size) == (min(same), len(same))
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_many_order_buckets(spark):
    ids = random.Random(3).sample(range(10**9), 700)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "n"), (None, "m")], "id long, t string").repartition(4)
    out = {r.t: r.next_t for r in fingerprint.next_in_order(df, "id", ["t"], ["t"], bucket_rows=50).collect()}
    order = [f"t{i}" for i in sorted(ids)] + ["m", "n"]
    assert out == {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}


def test_canonical_folding(spark):
    pairs = [("Ｆｕｌｌ  Width", "full width"), ("é", "É"), ("STRASSE", "straße"), (" a b\n", "a b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(x == y for x, y in df.select(fingerprint.digest(F.col("a")), fingerprint.digest(F.col("b"))).collect())


def test_bytes_part_equal_hashes(spark, docs):
    """With two hash bits nearly all groups hold different texts; the bytes must tell them apart."""
    got = {(r.group_id, r.group_size) for r in fingerprint.exact_groups(docs, bits=2).collect()}
    assert got == {(r.group_id, r.group_size) for r in fingerprint.exact_groups(docs).collect()} and got


def test_clashing_digests_keep_classes_apart(spark, docs):
    """Digests of one bit: most texts share one, and classes must still be those of the texts, through the whole operator."""
    by_text = {}
    for i, t in ((r[0], r[1]) for r in corpus()):
        by_text.setdefault(plain_digest(t), []).append(i)
    want = {i: (min(ids), len(ids)) for ids in by_text.values() for i in ids}
    for out in (fingerprint.edited_fingerprints(docs, bits=1), fingerprint.fingerprints(docs, bits=1)):
        rows = by_id(out)
        assert {i: (r.group_id, r.group_size) for i, r in rows.items()} == want and len({r.fingerprint for r in rows.values()}) == 2


# --- lines


def plain_removed(rows, percent=80):
    seen, gone = [], {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            s = set(line.encode().split())
            if s and any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.setdefault(doc, set()).add(k)
            if s:
                seen.append(s)
    return gone


def test_lines_equal_brute_force(spark, docs, empty):
    rows = sorted((r[0], r[1]) for r in corpus())
    gone = plain_removed(rows)
    out = by_id(linededup.dedup_lines(docs))
    assert len(out) == len(rows) and gone
    for doc, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(doc, ()))
        assert out[doc].text == kept and out[doc].n_removed == len(gone.get(doc, ()))
    assert linededup.dedup_lines(empty).count() == 0


def test_variants_of_a_line(spark):
    rnd = random.Random(9)
    base = [f"t{k}" for k in range(20)]
    rows = []
    for d in range(120):
        words = list(base)
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(20)] = f"v{rnd.randrange(40)}"
        rows.append((d, " ".join(words) + "\n" + sentence(rnd, 5)))
    rows += [(None, rows[0][1]), (3, rows[3][1])]
    gone = plain_removed(sorted(r for r in rows[:-2]))
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.n_removed for r in out if r.doc_id is not None} == {d: len(gone.get(d, ())) for d in range(120)}


@pytest.mark.parametrize(("percent", "want"), [(80, [0, 0, 0, 0]), (75, [0, 1, 0, 0]), (66, [0, 1, 0, 1])])
def test_small_sets_match_at_lower_percent(spark, percent, want):
    """Three of four words are alike by 0.75, two of three by 0.66."""
    df = spark.createDataFrame(list(enumerate(["a b c d", "a b c", "p q r", "p q"])), "doc_id long, text string")
    out = linededup.dedup_lines(df, percent=percent)
    assert [r.n_removed for r in out.orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("percent", [50, 67, 75, 80, 90])
def test_lines_at_any_percent(spark, percent):
    rnd = random.Random(percent)
    rows = [(d, "\n".join(sentence(rnd, rnd.randrange(1, 12), VOCAB[:14]) for _ in range(3))) for d in range(60)]
    gone = plain_removed(rows, percent)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.n_removed for r in out} == {d: len(gone.get(d, ())) for d, _ in rows} and gone


def variants(rnd, n, least, most):
    """n lines of least to most words, each near some of the others."""
    base = [f"t{k}" for k in range(most)]
    rows = []
    for d in range(n):
        words = base[: rnd.randrange(least, most + 1)]
        for _ in range(rnd.randrange(0, least // 6)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(2 * most)}"
        rows.append((d, " ".join(words)))
    return rows


def test_lines_read_their_candidates_once(spark, monkeypatch):
    """However many rounds of partners are verified, the texts of candidate lines are read again once."""
    calls, read = [], linededup._texts
    monkeypatch.setattr(linededup, "_texts", lambda *a: calls.append(1) or read(*a))
    rows = variants(random.Random(9), 120, 20, 24)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = plain_removed(rows)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {d: len(gone.get(d, ())) for d, _ in rows} and gone
    assert len(calls) == 1


def test_lines_of_many_words_and_odd_spaces(spark):
    rows = variants(random.Random(3), 60, 72, 88) + [(60, "  a\tb  c d e "), (61, "e d c b a"), (62, " \t ")]
    gone = plain_removed(rows)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {d: len(gone.get(d, ())) for d, _ in rows} and 20 < len(gone) < 60


def test_lines_of_clashing_columns_and_repeated_ids(spark):
    """Columns named as the operator's own keep their values; rows that repeat an id with other texts stand for themselves."""
    names = ["doc", "ln", "loc", "tag", "line", "cell", "gone", "kept", "removed", "n_lines", "n_removed", "row", "k1", "a.b"]
    rows = [(1, "a b c d e\nx y z", *range(14)), (2, "p q\na b c d e", *range(14)), (3, "m n o\nu v w", *range(14)), (3, "m n o\na b c d e", *range(14)), (None, "a b c d e", *range(14))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and all(tuple(r)[2:] == tuple(range(14)) for r in out.collect())
    texts = [r.text for r in out.collect() if r.doc_id == 3]
    want = [{"m n o\nu v w", ""}, {"u v w", "m n o"}]  # whichever text of id 3 comes first keeps "m n o"
    assert set(texts) in want and {r.text for r in out.collect() if r.doc_id in (2, None)} == {"p q", "a b c d e"}


def test_lines_of_a_long_text(spark):
    t = "\n".join(f"w{k} v{k % 7} u{k}" for k in range(20_000)) + "\n" + "\n".join(f"w{k} v{k % 7} u{k}" for k in range(0, 20_000, 2))
    r = linededup.dedup_lines(spark.createDataFrame([(5, t)], "doc_id long, text string")).first()
    assert (r.n_lines, r.n_removed) == (30_000, 10_000) and r.text == "\n".join(t.split("\n")[:20_000])


# --- packing


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    pieces = packing.pack(docs, path, capacity=128, pool_tokens=2048).collect()
    whole, sequences = {}, {}
    for p in pieces:
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        whole.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for r in corpus():
        want, got = t.encode(r[1] or "", add_special_tokens=False).ids + [0], []
        for start, ids, n in sorted(whole[r[0]]):
            assert start == len(got) and n == len(want)
            got += ids
        assert got == want
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 128 or at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_encoder_of_odd_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.encoder(path)
    t.encode_special_tokens = True
    for x in ("a  b", " a", "a ", "a\n b", "a \nb", "a\n\n b  c", "x   ", "don't 12 <|endoftext|> é😀", "\t a", "a　 b"):
        assert list(np.frombuffer(encode(x), "<u4")) == t.encode(x, add_special_tokens=False).ids, x


def test_ids_are_the_default_tokenizers(spark):
    """Texts that spell tokens with an inner space, or an added token, against the file as it stands."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, rnd = Tokenizer.from_file(path), random.Random(5)
    texts = ["a \u00a0 \u00a0 b", "\u00a0 \u00a0 \u00a0", "oui\u00a0! non \u00a0", "a <|endoftext|>b <|endoftext|>", "<|endoftext|>", "<|endoftext| >", "x  <|endoftext|> \u00a0 \u00a0"]
    texts += ["".join(rnd.choice(["a", " ", "\u00a0", " \u00a0", "!", "\n"]) for _ in range(12)) for _ in range(300)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += struct.unpack(f"<{r.length}I", r.ids)
        assert r.doc_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    for k, x in enumerate(texts):
        assert got[k] == [*t.encode(x, add_special_tokens=False).ids, 0], x


def test_best_fill_is_best():
    rnd = random.Random(6)
    for _ in range(200):
        lengths = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 8))]
        counts = {n: lengths.count(n) for n in lengths}
        room = rnd.randrange(max(lengths), 60)
        got = packing.best_fill(counts, room)
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        best = max(first + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if first + sum(c) <= room)
        assert sum(got) == best and all(got.count(n) <= counts[n] for n in got)


# --- near duplicates


def plain_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_large_buckets_move_little(spark, monkeypatch):
    """A family of 600 near copies and a second one that shares buckets with it, in blocks of 16: components as by brute force, rows far below the square."""
    rnd = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for d in range(600):
        words = list(base)
        words[rnd.randrange(120)] = f"v{d}"
        if d >= 480:  # a second family: some of it within reach of the first, most not
            words[40:52] = [f"z{k}" for k in range(12)]
        rows.append((d, " ".join(words)))
    placed = []
    whole = neardup._rest

    def counted(large, found, block):
        out = whole(large, found, block)
        placed.append((large.select("id").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "_rest", counted)
    want = plain_components({d: plain_set(t) for d, t in rows}, 85)
    out = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16))
    assert {d: r.component_id for d, r in out.items()} == want and placed and placed[0][0] > 16
    assert placed[0][1] < placed[0][0] ** 2 / 8


def test_blocks_of_few_bytes(spark, monkeypatch):
    """Long sets part a bucket long before its members are many; nothing is lost."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 8 * 400)
    rnd = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = [(d, " ".join(f"v{d}" if k == 11 * d % 200 else w for k, w in enumerate(base))) for d in range(20)] + [(50 + d, sentence(rnd, 150)) for d in range(5)]
    want = plain_components({d: plain_set(t) for d, t in rows}, 85)
    out = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: r.component_id for d, r in out.items()} == want


def test_slices_hold_few_bytes():
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": ["x" * (3_000_000 if k % 10 == 3 else 10) for k in range(40)]})
    parts = list(sliced([batch, batch.slice(0, 0)], rows=25, most_bytes=4_000_000))
    assert [i for p in parts for i in p["id"].to_pylist()] == list(range(40))
    assert all(p.num_rows <= 25 and (p.num_rows == 1 or p.nbytes <= 4_000_000) for p in parts)


def test_operators_on_a_table_of_the_users_own_from_another_folder(tmp_path):
    """Nothing but the driver's path knows the package; executors get its code from the operators themselves."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "cp").getOrCreate()
import public_tokenizers
from terracadence.llm import hardneg, heaplloyd, neardup, packing, quality, substring, topk, toxicity, wrappers
docs = spark.createDataFrame([(k, f"some words of text {{k}} " * 9, 9) for k in range(12)], "doc_id long, text string, n_chars long")
labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(k, [k / 16.0] * 16, 0) for k in range(12)], "vec_id long, embedding array<float>, label int")
found = [quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), neardup.near_duplicates(docs), substring.remove_repeats(docs), packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")),
         topk.top_k(vectors, vectors), heaplloyd.compress(vectors), wrappers.extract(spark.createDataFrame([(k, "http://x/", "<p>t") for k in range(12)], "page_id long, url string, html string"))]
print("ROWS", [f.count() >= 12 for f in found], hardneg.mine(vectors, vectors).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [True, True, True, True, True, True, True, True] 0" in done.stdout, done.stderr[-3000:]


def test_keep_one_tells_texts_of_an_id_apart(spark):
    t, u = "a b c d e f g h", "z y x w v u t s"
    df = spark.createDataFrame([(4, t, 0), (9, t, 1), (9, u, 2), (None, t, 3)], "doc_id long, text string, row int")
    assert sorted(r.row for r in neardup.keep_one(df).collect()) == [0, 2, 3]


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, docs, empty, block):
    want = {r[0]: plain_set(r[1]) for r in corpus()}
    comp = plain_components(want, 85)
    out = by_id(neardup.near_duplicates(docs, block=block))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in out.items()} == {i: (len(want[i]), comp[i], comp[i] == i) for i in want}
    assert len(set(comp.values())) < len(comp) - 5
    assert neardup.near_duplicates(empty).count() == 0


def test_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (9, t), (9, "z y x w v u")], "doc_id long, text string")
    out = neardup.near_duplicates(df).collect()
    assert len(out) == 6 and all(r.kept for r in out if r.doc_id in (None, 4)) and sorted(r.component_id for r in out if r.doc_id == 9) == [4, 9]


def test_keep_one(spark, docs):
    comp = plain_components({r[0]: plain_set(r[1]) for r in corpus()}, 80)
    out = neardup.keep_one(docs, percent=80)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, c in comp.items() if i == c}


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(0)
    for similarity in (0.75, 0.85, 0.95):
        n = 2000
        shared = int(round(2 * n * similarity / (1 + similarity)))
        pool = rnd.integers(0, 1 << 63, 2 * n - shared + n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        got = neardup.estimates(*[np.frombuffer(neardup.odd_sketch(neardup.minhash(x, 150)), np.uint64).reshape(1, -1) for x in (a, b)], 150)[0, 0]
        assert abs(got - similarity) < 0.13


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 100), (205, 203), (203, 204)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[k] == k // 20 * 20 for k in range(60)) and out[205] == 203 and 100 not in out


# --- repeated spans


def plain_repeats(rows, width):
    first = {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d, w in sorted(words.items()):
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), (d, p))
    out = {}
    for d, w in words.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] != (d, p):
                gone |= set(range(p, p + width))
        out[d] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 50])
def test_repeats_equal_brute_force(spark, docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    want = plain_repeats([(r[0], r[1]) for r in corpus()], 20)
    out = by_id(substring.remove_repeats(docs))
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in out.items()} == want and sum(r.n_removed > 0 for r in out.values()) > 5
    assert substring.remove_repeats(empty).count() == 0


def test_colliding_windows_lose_no_repeat(spark, docs, monkeypatch):
    """Window hashes of six bits: nearly all paths fail the comparison of words, and their edges must still find their repeats."""
    whole = shingles.windows
    monkeypatch.setattr(substring, "windows", lambda h, width: whole(h, width) if width < 20 else whole(h, width) & np.uint64(63))
    rows = [(r[0], r[1]) for r in corpus() if len(r[1] or "") < 2_000]
    want = plain_repeats(rows, 20)
    out = by_id(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r.n_words, r.n_removed) for i, r in out.items()} == {i: w[:2] for i, w in want.items()}


def test_repeats_with_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, t), (7, t), (8, t), (8, t)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()), key=str)
    assert out == [(7, 0), (8, 40), (8, 40), (None, 0)]


@pytest.mark.parametrize("chunk", [2_000_000, 30])
def test_equal_rows_are_one_document(spark, monkeypatch, chunk):
    """Two equal rows with no earlier copy, one of them with a repeat inside; chunk 30 sends the rows of a pair in different chunks."""
    monkeypatch.setattr(substring, "CHUNK", chunk)
    t, inner = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k % 30}" for k in range(60))
    df = spark.createDataFrame([(8, t), (8, t), (9, inner), (9, inner), (10, t), (10, t)], "doc_id long, text string").coalesce(1)
    out = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect())
    want = plain_repeats([(8, t), (9, inner), (10, t)], 20)
    assert want[8][1] == 0 and want[9][1] > 0 and want[10][1] == 40
    assert out == [(i, *want[i][:2]) for i in (8, 8, 9, 9, 10, 10)]


def test_window_hashes_follow_the_words():
    rnd = random.Random(1)
    w = [rnd.choice([b"a", b"b", b"c"]) for _ in range(400)]
    h = shingles.windows(shingles.word_hashes(w), 3)
    seen = {}
    for p, x in enumerate(h.tolist()):
        assert seen.setdefault(tuple(w[p : p + 3]), x) == x
    assert len(set(seen.values())) == len(seen)
