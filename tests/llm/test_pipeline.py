"""The stages of the pipeline, each on its own input, and run() as their chain."""

import hashlib
import random

import pytest
from test_llm import plain_components, plain_fm, plain_removed, plain_set, plain_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(160):
        bad = k % 4 == 0
        t = "\n".join(" ".join(rnd.choice(words) for _ in range(15)) for _ in range(4))
        texts.append(" ".join(w.upper() + "!!" for w in t.split()) if bad else t)
        labels.append((k, int(not bad), 0))
    texts[7], texts[9] = texts[5], texts[5].replace("w1 ", "w2 ")
    texts[11] = None
    sf = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t) if t else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf)


def test_stages(spark, tables, tmp_path):
    docs = first = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == first.columns or k == len(corpus_pipeline.STAGES) - 1
        seen[name] = docs.collect()
    quality = {r.doc_id for r in seen["quality_classifier"]}
    assert sum(i % 4 == 0 for i in quality) <= 2 and sum(i % 4 != 0 for i in quality) >= 117
    lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert set(lines) == quality and lines[7].text == "" and lines[7].n_chars == 0
    assert {r.doc_id for r in seen["minhash_near_dedup"]} <= quality
    tokens = {r.doc_id: r.doc_tokens for r in seen["sequence_packing"]}
    assert set(tokens) == {r.doc_id for r in seen["mixing_sources"]}


def test_run_is_the_chain(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    a, b = pieces(corpus_pipeline.run(spark, tables)), pieces(docs)
    assert sum(p[2] for p in a) == sum(p[2] for p in b) and {p[0] for p in a} == {p[0] for p in b}


def plain_chain(rows, model, encode):
    """(doc, tokens of one copy, copies) of what the stages leave, in plain Python. rows: (id, text, source, n_chars)."""
    from terracadence.llm import features, quality

    rows = [r for r in rows if plain_fm(model, *features.quality_features(r[1] or "", r[3], quality.WORD_BITS)) >= 0.5]
    gone = plain_removed(sorted((r[0], r[1]) for r in rows))
    rows = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())), s) for i, t, s, _ in rows]
    comp = plain_components({i: plain_set(t) for i, t, _ in rows}, 80)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    targets, copies = plain_targets(sizes), {}
    for s, target in targets.items():
        whole = min(int(target // sizes[s]), 3) if sizes[s] else 0
        rest, upto = max(target - whole * sizes[s], 0), 0
        for key, i in sorted((hashlib.md5(f"{i}:{t or ''}".encode()).hexdigest()[:9], i) for i, t, x in rows if x == s):
            n = size[i]
            extra = upto + n <= rest or (upto < rest and upto + n - rest < rest - upto)
            upto += n
            copies[i] = min(whole + extra, 3) if n else 0
    return {i: (len(encode(t or "")) + 1, copies[i]) for i, t, _ in rows if copies[i]}


def test_run_equals_a_plain_chain(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    from terracadence.llm import quality

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = plain_chain([(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()], quality.fit(docs, labels), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    got = {}
    for r in corpus_pipeline.run(spark, tables).collect():
        tokens, length = got.get(r.doc_id, (r.doc_tokens, 0))
        assert tokens == r.doc_tokens
        got[r.doc_id] = (tokens, length + r.length)
    assert got == {i: (n, n * k) for i, (n, k) in want.items()}


def test_stages_of_odd_tables(spark, tables):
    """Columns with the names that operators use, nulls, repeated rows, and no rows at all."""
    names = ["score", "predicted", "n_lines", "n_removed", "row", "cell", "tag", "id", "repeats", "key", "size", "a.b"]
    text = "one two three four five six seven eight nine ten\neleven twelve thirteen"
    rows = [(1, text, "en", "s", 70), (1, text, "en", "s", 70), (2, None, None, None, None), (None, text, "en", "s", 70), (3, "", "en", "s", 0)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], shape)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tables)
            if name != "sequence_packing":
                assert out.columns == df.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect())
            assert docs is df or out.count() == 0
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, tables).collect()
    assert len(lines) == 5 and {r.text for r in lines} == {text, None, ""}
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, df, tables).collect()
    assert len(kept) == 5
