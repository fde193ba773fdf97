"""The pipeline's stages on a small folder: what goes, what stays, and the columns between them."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logweave.llm import secrets, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(2)
    at = str(tmp_path_factory.mktemp("sf"))
    words = [f"w{k}" for k in range(3000)]
    clean = [" ".join(random.choices(words, k=80)) for _ in range(60)]
    toxic = [" ".join([*random.choices(words, k=70), *["idiot scum moron"] * 3]) for _ in range(30)]
    item = " ".join(random.choices(words, k=30))
    near = " ".join([*clean[0].split()[:-1], "other"])
    texts = clean + toxic + [clean[1], near, "see " + item + " end", "password=abc123def456 " + clean[2][:200], None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id for r in docs.collect()}
    assert set(range(60)) <= left["toxicity"] and not left["toxicity"] & set(range(60, 90))
    assert left["toxicity"] - left["minhash_near_dedup"] == {90, 91}
    assert left["minhash_near_dedup"] - left["benchmark_decontamination"] == {92}
    assert left["secret_scan"] == left["benchmark_decontamination"]
    masked = docs.where("doc_id = 93").first()
    assert masked.text.startswith("<SECRET> ") and masked.n_chars == len(masked.text)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.select("doc_id", "n_tokens", F.size("ids").alias("n"), "round_trip").collect()
    assert all(r.round_trip and r.n == r.n_tokens for r in rows) and {r.doc_id for r in rows} == {*range(60), 93, 94, 95}


def test_stages_on_odd_tables(spark, folder, tmp_path):
    """Each stage with no rows, with null ids and texts, repeated rows and columns whose names the stages use themselves."""
    names = ["toxicity_score", "findings", "matches", "n_words", "gone_id", "id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.union(docs.where("doc_id in (3, 93)")).union(spark.createDataFrame([(None, None, None, None, None), (None, "word " * 20, "en", "s", 100)], docs.schema))
    odd = odd.withColumns({c: F.lit("x") for c in names})
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd.where("false"), odd):
            out = stage(spark, df, folder)
            assert (out.count() == 0) == (df.count() == 0), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == odd.columns and out.where("toxicity_score <> 'x' or findings <> 'x' or id <> 'x'").count() == 0


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_against_brute_force(spark):
    """The rows of run() on the small tables against the five stages in loops; classifier and network come from their own training."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    # 1: the score is the logistic sum of the weights of a text's distinct n-grams
    model = toxicity.train(docs, spark.read.parquet(f"{base}/labels.parquet"))
    for i in list(left):
        code = np.array([ord(c) for c in (left[i].text or "").lower()], np.uint32)
        grams = {b for _, bs in toxicity._grams(code, np.array([0, len(code)])) for b in bs.tolist()}
        if model.bias + sum(float(model.weights[b]) for b in grams) >= 0:
            del left[i]
    # 2: of each component of pairs at similarity 0.8 or more the least id stays
    ids, sets = sorted(left), {i: shingles(left[i].text) for i in left}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: left[i] for i in ids if find(i) == i}
    # 3: no window of ten words, or of a whole shorter item
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in spark.read.parquet(f"{base}/benchmark.parquet").collect():
        w = word.findall(low(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    words = {i: word.findall(low(r.text)) for i, r in left.items()}
    left = {i: r for i, r in left.items() if not any(tuple(words[i][k : k + n]) in windows for n in sizes for k in range(len(words[i]) - n + 1))}
    # 4: findings masked, overlapping ones as one
    kept = spark.createDataFrame(list(left.values()), docs.schema)
    network = secrets.train(kept)
    texts = {}
    for i, r in left.items():
        out, end = "", 0
        for s, _, e, _ in secrets.findings(network, r.text) if r.text else []:
            out += "" if s < end else r.text[end:s] + "<SECRET>"
            end = max(end, e)
        texts[i] = None if r.text is None else out + r.text[end:]
    # 5: ids as the tokenizers library gives them
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    wanted = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == wanted and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    assert 0 < len(got) < docs.count()
