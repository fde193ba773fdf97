"""The operators on small tables against brute force, and the cases that each docstring defines."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import bpe, chat, components, decontaminate, embeddings, html, langid, minhash, registry, secrets, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def docs_of(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} string" for k in extra)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1


def brute_repeats(texts, width):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen:
                mark[p : p + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for k in range(len(raw)) if mark[k] and not (k and mark[k - 1]))
        out[i] = (len(raw), sum(mark), spans, bytes(b for b, m in zip(raw, mark) if not m))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    random.seed(5)
    line = " ".join(random.choices(WORDS, k=25))
    texts = [" ".join(random.choices(WORDS, k=random.randrange(5, 60))) for _ in range(12)]
    texts += [texts[0], f"é {line} x", f"y {line} z", line[:99], line[:100], None, "", "ab" * 200, "q" * 350, f"{line}{line}", texts[0] + "!"]
    df = docs_of(spark, texts, kept="x", n_bytes="y", anchor="z")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(df).collect()}
    assert got == brute_repeats(texts, 100)


def test_repeats_empty(spark):
    assert suffix_dedup.dedup(docs_of(spark, ["a"]).where("false")).count() == 0


def test_repeats_on_a_table(spark):
    """Every document of the small table against brute force: all places of 100 bytes at once, by their hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    seen, wanted = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - 99):
            h = hash(raw[p : p + 100])
            if h in seen:
                mark[p] += 1
                mark[min(p + 100, len(raw))] -= 1
            seen.add(h)
        inside = np.cumsum(mark)[:-1] > 0 if raw else np.zeros(0, bool)
        spans = int((inside & ~np.concatenate([[False], inside[:-1]])).sum()) if raw else 0
        wanted[i] = (len(raw), int(inside.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~inside]))
    assert got == wanted


def test_repeats_of_one_character(spark):
    texts = ["a" * 2_000_000, "x" + "a" * 150 + "y", "ab" * 40_000 + "c", "b" * 99, "-" * 300 + "z" + "-" * 300]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs_of(spark, texts)).collect()}
    assert got == {0: (2_000_000, 1_999_999, 1), 1: (152, 150, 1), 2: (80_001, 79_998, 1), 3: (99, 0, 0), 4: (601, 599, 2)}


def test_repeats_edges(spark):
    line = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(line)), ("None", 0)]
    for width in (20, 60, 255, 300):
        with pytest.raises(ValueError):
            suffix_dedup.dedup(df, width)


def test_bwt_order():
    strings = [b"banana", b"ananas", b"", b"ban"]
    ids, lcp = suffix_dedup.build(strings, 100)
    joined = b"".join(b"\xff" + s for s in strings)
    ends = np.cumsum([len(s) + 1 for s in strings])
    suffix = lambda i: joined[i : ends[np.searchsorted(ends, i, "left")]]
    found = [suffix(int(i)) for i in ids]
    assert found == sorted(found) and len(found) == sum(len(s) + 1 for s in strings)
    for k in range(1, len(found)):
        a, b = found[k - 1], found[k]
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert lcp[k] == n


# 2


def test_languages(spark):
    out = registry.op2_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    model = langid.train(docs_of(spark, ["the cat sat", "el gato negro"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("es")))
    df = docs_of(spark, ["The cat!", "gato", "cats", None, "", "123 !?", "the cat " * 50_000], lang_pred="x", lang="y")
    got = [(r.lang_pred, 0 <= r.score <= 1, r.lang) for r in langid.identify(df, model).orderBy("doc_id").collect()]
    assert got == [(x, True, "y") for x in ("en", "es", "en", "und", "und", "und", "en")]
    more = docs_of(spark, ["the cat", "the cat", "zzz"], lang="y").union(docs_of(spark, ["the cat"], lang="y"))
    assert len({(r.lang_pred, r.score) for r in langid.identify(more.where("doc_id < 2"), model).collect()}) == 1  # repeated rows
    assert langid.identify(more.where("false"), model).count() == 0
    same = langid.train(docs_of(spark, ["word", "word"]).withColumn("lang", F.when(F.col("doc_id") == 0, "b").otherwise("a")))
    assert [r.lang_pred for r in langid.identify(docs_of(spark, ["word"]), same).collect()] == ["a"]  # a tie
    nothing = langid.train(docs_of(spark, ["a"], lang="en").where("false"))
    assert langid.identify(df, nothing).where("lang_pred <> 'und'").count() == 0


def brute_language(sample, text):
    """HeLI from Python dictionaries of strings."""
    langs = sorted({g for _, g in sample})
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {}
    for t, g in sample:
        for w in words(t):
            for n in (0, 5, 4, 3, 2, 1):
                for x in [w] if not n else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                    counts.setdefault((n, g), Counter())[x] += 1
    mark = lambda n, g, x: max(np.log10(counts[n, g][x] / sum(counts[n, g].values())), -7.0) if counts[n, g][x] else -7.0
    totals = {g: [] for g in langs}
    for w in words(text):
        for n in (0, 5, 4, 3, 2, 1):
            known = [x for x in ([w] if not n else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]) if any(counts[n, g][x] for g in langs)]
            if known:
                for g in langs:
                    totals[g].append(np.mean([mark(n, g, x) for x in known]))
                break
    return max(langs, key=lambda g: np.mean(totals[g]))


def test_languages_as_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null").orderBy("doc_id").select("doc_id", "text", "lang").collect()
    known, asked = rows[:60], [(r.doc_id, " ".join(r.text.split()[:8])) for r in rows[60:160] if re.search(r"[^\W\d_]", r.text or "")]
    model = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    sample = [(r.text, r.lang) for r in known if r.text]
    asked = [(i, t) for i, t in asked if re.search(r"[^\W\d_]", t)]
    assert sum(got[i] == brute_language(sample, t) for i, t in asked) >= 0.98 * len(asked)


# 3


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    random.seed(3)
    base = [str(random.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(base)]
    for k in range(40):  # copies of a copy, further and further away
        w = list(base)
        for _ in range(random.randrange(1, 9)):
            w[random.randrange(60)] = f"x{random.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[3].upper(), None, "", " \t\n", "One", "one", "two words", "two words again", "ONE"]
    df = docs_of(spark, texts, id="a", n="b", c="d", key="e")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=2).collect()}
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(pairs, range(len(texts)))
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, ["a"]).where("false")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, minhash.near_duplicates(df).select("doc_id", "component_id", "kept").collect())) == sorted(
        ["Row(doc_id=1, component_id=1, kept=True)"] * 2 + ["Row(doc_id=None, component_id=None, kept=True)", "Row(doc_id=2, component_id=1, kept=False)"]
    )
    assert minhash.one_of_each(df).count() == 3
    texts = ["a b c d e f", "u v w x y z", ""]  # doc 1 holds all of them; the one of least hash is compared for it
    h = [r[0] for r in docs_of(spark, texts).orderBy("doc_id").select(F.xxhash64("text")).collect()]
    for held in ([0, 1], [1, 0], [0, 2], [0, 1, 2]):
        df = spark.createDataFrame([(1, texts[k]) for k in held] + [(2 + k, texts[k]) for k in range(2)], "doc_id long, text string")
        same = 2 + min(held, key=lambda k: h[k])
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
        assert got == {(1, 0 if k == 2 else 2, 1, True) for k in held} | {(d, 2, 1 if d == same else d, d != same) for d in (2, 3)}
    long = " ".join(f"w{k}" for k in range(150_000))
    got = minhash.near_duplicates(docs_of(spark, [long, long + " end", "w1 w2"])).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(149_996, 0), (149_997, 0), (1, 2)]


def test_kept_tables_go(spark, tmp_path, monkeypatch):
    """Of the tables that an operator writes, those stay that its result reads."""
    from logweave.llm import _store

    monkeypatch.setattr(_store, "shared_folder", lambda spark: f"file://{tmp_path}")
    random.seed(6)
    base = [str(random.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(base), *(" ".join(random.sample(base, 3) + base[3:]) for _ in range(20))]
    vectors = spark.createDataFrame([(i, [1.0, i % 3 / 100], 1) for i in range(20)], "vec_id long, embedding array<float>, label int")
    named = lambda: sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir())
    out = minhash.near_duplicates(docs_of(spark, texts), words=2)
    assert set(named()) <= {"labels", "stands", "summaries", "edges", "star"} and out.count() == 21, named()
    before = named()
    out = embeddings.near_duplicates(vectors)
    assert set(named()) - set(before) == {"linked"} and out.where("component_id = 0").count() == 20, named()


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    root = roots(edges, {x for e in edges for x in e})
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


# 4


def chat_digest(rows):
    said = "".join(t or "" for _, r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_query(spark):
    by = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    by[-7] = [(0, "user", registry.TRICKY), (1, "assistant", registry.TRICKY)]
    got = {r.conv_id: tuple(r)[1:5] for r in registry.op4_chat(spark, DATA).collect()}
    assert got == {k: chat_digest(sorted(v)) for k, v in by.items()}


def test_chat_windows(spark):
    random.seed(8)
    nasty = ["</turn>", "### User: ", "\\", "\\h", "#", "<", "\\\\l", "é😀", "\n", ": ", "word " * 30]
    rows = []
    for conv in range(6):
        for turn in range(random.randrange(1, 40)):
            role = "system" if turn == 0 and conv % 2 else random.choice(["user", "assistant", "Tool: x#", ""])
            rows.append((conv, turn, role, random.choice([None, "", "".join(random.choices(nasty, k=6))]), "z"))
    rows.append((9, 0, "system", "only", "z"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=300, history_tokens=60, history_turns=2).cache()
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = [(role, text or "") for c, _, role, text, _ in rows if c == conv]
        assert [(x.role, x.text) for x in back[conv].said] == own
        assert back[conv].targets == "".join(t for r, t in own if r == "assistant")
    for w in windows.collect():
        assert w.n_tokens <= 300 or max(t.length for t in w.turns) > 100
        if w.conv_id in (1, 3, 5):
            assert w.turns[0].role == "system"
        old = [t for t in w.turns if not t.is_new and t.role != "system"]
        assert len(old) <= 2 and not any(t.is_target for t in old)
    assert chat.format_windows(df.where("false")).count() == 0
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5


@pytest.mark.parametrize(("cell", "block"), [(64, 512), (1, 7)])
def test_embeddings(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "SMALL_CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    random_ = np.random.default_rng(1)
    base = random_.normal(size=(40, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    for k in range(60):
        v = base[k % 7] + random_.normal(size=16) * 0.1
        rows.append((100 + k, (v * (1 + k)).tolist(), k % 7 % 2))
    rows += [(300, base[0].tolist(), 0), (301, base[0].tolist(), 0), (302, base[0].tolist(), 1), (303, base[0].tolist(), None), (304, None, 0), (305, [0.0] * 16, 0), (306, [], 0), (307, [1.0, None], 0), (308, [float("nan")] * 16, 0), (309, [1.0] * 3, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    good = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: c for i, _, c in rows}
    cos = lambda a, b: a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) if len(a) == len(b) else 0
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and cos(good[a], good[b]) >= 0.98]
    root = roots(pairs, [r[0] for r in rows])
    links = Counter(x for p in pairs for x in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    found = sum(v[0] for v in got.values())
    assert found >= 0.9 * sum(links.values()) and all(got[i][0] <= links[i] for i in got)
    assert {i: got[i][1:] for i in got} == {i: (root[i], root[i] == i) for i in root}
    assert got[300][0] == links[300] and got[303] == (0, 303, True)
    lone = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"))
    assert sorted(map(str, lone.collect())) == sorted(["Row(vec_id=None, n_links=0, component_id=None, kept=True)"] + ["Row(vec_id=5, n_links=1, component_id=5, kept=True)"] * 2)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


# 6


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_as_the_library(spark, tokenizer):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer)
    random.seed(1)
    letters = " \t\n\r\x0b\x0c\x1c\x85\xa0aaabcdeéñüß́½²ª0123'''stremvld.,!?-=_#$漢字😀​ ЖٱͅǅⅧ\x00\x7f"
    texts = ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(4000)]
    texts += ["a" * 9000, " " * 300, "the" * 200, "<|endoftext|>x <|endoftext|>", "<|endoftext|>", None, "", "b c", "b c"]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = docs_of(spark, texts, ids="x", decoded="y")
    for r in bpe.decode(bpe.encode(df, tokenizer), tokenizer).collect():
        wanted = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == wanted and r.decoded == theirs.decode(wanted, skip_special_tokens=False)
    apart, once = bpe.decode(bpe.encode(df, tokenizer), tokenizer), bpe.round_trip(df, tokenizer)
    assert apart.columns == once.columns and apart.exceptAll(once).isEmpty() and once.exceptAll(apart).isEmpty()
    assert bpe.round_trip(df.where("false"), tokenizer).isEmpty()
    none = bpe.decode(bpe.encode(df.where("false"), tokenizer), tokenizer)
    assert none.count() == 0 and none.columns == ["doc_id", "text", "ids", "decoded"]


def test_bpe_table_is_the_language(tokenizer):
    """Two labels follow each other in the compiled table exactly where merging their bytes gives these two back."""
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer)
    machine, labels = bpe.compiled(tokenizer)
    random.seed(8)
    spelt = lambda t: labels.data[labels.start[t] : labels.start[t] + labels.size[t]].tobytes()
    words = [t for t in range(50256) if spelt(t).isalpha() and spelt(t).isascii()]
    for a, b in [random.choices(words, k=2) for _ in range(5000)] + [(t, t) for t in words[:300]]:
        c = machine.column[b]
        arc = machine.row[a] >= 0 and c >= 0 and bool(machine.arcs[machine.row[a], c >> 3] >> (c & 7) & 1)
        assert arc == (theirs.encode((spelt(a) + spelt(b)).decode(), add_special_tokens=False).ids == [a, b])


def test_bpe_decodes_anything(spark, tokenizer):
    broken = int(np.flatnonzero(bpe.automaton(tokenizer)[1].size == 1)[-1])
    rows = [(0, []), (1, [10**6, -1]), (2, None), (3, [64, None, 65]), (4, [broken])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, tokenizer).collect()}
    assert got[0] == got[1] == got[2] == "" and len(got[3]) == 2 and len(got[4]) == 1
    with pytest.raises(ValueError):
        bpe.encode(docs_of(spark, ["a"]), tokenizer, ids="text")


def test_bpe_words_of_one_hash(tokenizer, monkeypatch):
    """Words are told apart by their bytes where their hashes agree."""
    from tokenizers import Tokenizer

    machine, _ = bpe.automaton(tokenizer)
    whole = lambda texts: (np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    texts = ["the cat and the dog the end", "", "été ñu the été", "dog cat god tac"]
    ids, at = machine.encode(*whole(texts))
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    same, places = machine.encode(*whole(texts))
    theirs = Tokenizer.from_file(tokenizer)
    assert same.tolist() == ids.tolist() == [i for t in texts for i in theirs.encode(t, add_special_tokens=False).ids] and places.tolist() == at.tolist()


def test_bpe_refuses_other_settings(tokenizer, tmp_path):
    spec = json.load(open(tokenizer, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        at = tmp_path / "t.json"
        at.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.compiled(str(at))


# 7


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in registry.op7_html(spark, "/root/testdata/sf0.01").join(pages.select("page_id", "html"), "page_id").collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        import html as std

        parts = re.split(r"</?(?:p|h1)>", inside)
        wanted = "\n".join(x for x in (" ".join(std.unescape(re.sub("<[^>]*>?", "", p.replace("<br>", " "))).split()) for p in parts) if x)
        assert r.text == wanted and r.n_chars == len(wanted)
    model = html.fit([r.html for r in pages.collect()])
    page = """<title>t</title><header class=top>Site name and slogan</header><nav>menu one two</nav><div class="cookie-notice">We use cookies, many of them</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>First <b>para</b>graph\n of&nbsp;text.<div class="ad">Buy now cheap things</div><p>Second one here.
    <ul><li>item a<li>item b</ul><form>Sign up please</form><script>var x = "<p>no</p>"</script></article>
    <section id="comments"><h2>Comments</h2><p>A nice long comment by a reader of the page</section></main><aside>Related</aside><footer>Copyright"""
    assert html.extract(model, page) == "Title & more\nFirst paragraph of text.\nSecond one here.\nitem a\nitem b"
    assert [html.extract(model, x) for x in (None, "", "<p>", "<p", "a &am", "<article><p>a<p>b</article>")] == ["", "", "", "", "a &am", "a\nb"]
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>hi", "y")], "page_id long, html string, text string")
    assert [r.text for r in html.main_text(df, html.HtmlModel()).collect()] == ["", "hi"]


def test_html_raw_elements():
    script = "<script>for(i=0;i<n;i++){f('</scripts>');}</SCRIPT ><style>a<b{}</style>"
    page = f"{script}<article><p>one two<math><mi>x</mi></math><object>shown instead</object><noscript><p>still here</noscript><select><option>this</select>{script}<p>end</article>"
    texts = [b.text for b in html.blocks_of(page)]
    assert texts == ["one two", "x", "shown instead", "still here", "this", "end"]
    assert html.extract(html.fit([]), page) == "\n".join(texts)
    assert [b.text for b in html.blocks_of("<p>a<svg><p>b<svg>c<script>if(i<n)</scriptx>d")] == ["a", "b", "c"]


def test_html_broken_tags():
    model = html.fit([])
    assert html.extract(model, '<article><p title="x>four five six</p></article>') == "four five six"
    assert html.extract(model, "<article><p class='a b>one two</p><p>three") == "one two\nthree"
    assert html.extract(model, "<article><script>for(i=0;i<n;i++){s=1}</script><p>Hello there my friend</p></article>") == "Hello there my friend"
    learnt = html.fit(['<nav>menu of links</nav><article><p class="share-price">words of the text here</p></article>'] * 20)
    assert html.extract(learnt, '<article><p class="share-price">Shares rose today in trading</p></article>') == "Shares rose today in trading"


def test_html_best_region():
    """The scan's region scores as the best of all regions."""
    random.seed(5)
    for _ in range(200):
        names = [random.choice(["good", "bad", "odd"]) for _ in range(random.randrange(1, 9))]
        page = "".join(f'<div class="{c}">{" ".join(["w"] * random.randrange(1, 5))}</div>{"<hr>" * random.randrange(3)}' for c in names)
        model = html.HtmlModel({".good": 1.0, ".bad": -1.0, ".odd": 0.1}, {"hr": 0.9, "div": 0.3})
        found = html.blocks_of(page)
        weight = [html._weight(model, b) for b in found]
        cost = [(html.INSIDE if w > 0 else 1) * sum(model.cost[t] for t in b.tags) for b, w in zip(found, weight)]
        score = lambda i, j: sum(max(weight[k], 0) * found[k].words - (cost[k] if k > i else 0) for k in range(i, j))
        regions = {(i, j): score(i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
        best = max(regions.values())
        texts = {"\n".join(found[k].text for k in range(i, j) if weight[k] > 0) for (i, j), v in regions.items() if v > best - 1e-9} if best > 0 else {""}
        assert html.extract(model, page) in texts


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "<article><p>" + "word " * 200_000), (2, "<p>same"), (2, "<p>same"), (3, "")], "page_id long, html string")
    got = sorted((r.page_id, len(r.text)) for r in html.main_text(df, html.fit([])).collect())
    assert got == [(1, 999_999), (2, 4), (2, 4), (3, 0)]
    assert html.main_text(df.where("false"), html.HtmlModel()).count() == 0 and html.train(df.where("false")) is not None


def test_html_names_are_a_prior(spark):
    filler = "<nav>menu of links</nav>{}<p>words of the text here</p>{}<footer>small print</footer>"
    model = html.fit([filler.format("<article>", "</article>")] * 30)
    for wrapper in ("layout has-sidebar", "single comments-open", "with-banner", "search-result", "side-by-side"):
        page = f'<body class="{wrapper}"><div class="{wrapper}">{filler.format("<article>", "<div class=ad>buy this now</div></article>")}</div>'
        assert html.extract(model, page) == "words of the text here"
        assert html.extract(model, f'<body class="{wrapper}"><p>words of the text here') == "words of the text here"
    page = filler.format('<div class="side-by-side">', "</div>")
    assert html.extract(model, page) == ""
    learnt = html.fit([filler.format('<article><div class="side-by-side">', "</div></article>")] * 30)
    assert learnt.context[".side"] > 0 > learnt.context["<nav>"] and html.extract(learnt, page) == "words of the text here"
    rows = [(k, "<p>no label") for k in range(50)] + [(50, '<article><p class="special">a b')]
    assert html.train(spark.createDataFrame(rows, "page_id long, html string"), max_pages=1).context[".special"] > 0


def test_html_keeps_what_stands_behind_an_aside(spark):
    """With the model of the test pages: parts of an article on both sides of a notice, a menu or a long list, and names that training has not met."""
    model = html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    long = "<aside>" + "".join(f"<ul><li>promo {k}</li></ul>" for k in range(40)) + "</aside>"
    cases = {
        "<article><p>first part one two three</p><aside>" + "promo words " * 40 + "</aside><p>six seven eight nine ten</p></article>": "first part one two three\nsix seven eight nine ten",
        "<article><h1>T</h1><p>one two three</p><nav>x y</nav><p>four five six</p></article>": "T\none two three\nfour five six",
        f"<article><p>one two three</p>{long}<p>four five six</p></article>": "one two three\nfour five six",
        '<article><p class="share-price">Shares rose today in trading</p></article>': "Shares rose today in trading",
        '<nav>menu</nav><article><h1>A day</h1><p>one two three four</p><figure><figcaption class="widget-gallery">five six</figcaption></figure><div class="search-result">seven</div><p class="notification-law">eight nine</p></article><footer>end</footer>': "A day\none two three four\nfive six\nseven\neight nine",
    }
    for page, text in cases.items():
        assert html.extract(model, f"<html><body><header><nav>Home News</nav></header>{page}<footer>Imprint</footer></body></html>") == text


# 8


def brute_secrets(t):
    out = []
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [("assign", m.start(), m.end()) for m in rule.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets(spark):
    texts = [None, "", 'é Token = "abcdef1"', "PASSWORD:short", "api_key='x' apikey=123456", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24, "f" * 23, "token=api_key=abcdefg", "ſecret=abcdefg", "x" * 200_000 + " secret: abcdefgh"]
    df = docs_of(spark, texts, findings="x").withColumn("n_chars", F.lit(1))
    for r in secrets.scan(df, secrets.SecretModel()).collect():
        assert [(f.kind, f.start, f.end) for f in r.findings] == brute_secrets(texts[r.doc_id] or "")
    done = {r.doc_id: r for r in secrets.redact(df, secrets.SecretModel()).collect()}
    assert done[2].text == 'é <SECRET>"' and done[2].n_chars == len(done[2].text) and done[0].text is None and done[8].text == "f" * 23
    assert done[2].findings == "x"
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in registry.op8_secrets(spark, DATA).join(docs.select("doc_id", "text"), "doc_id").collect():
        wanted = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(r.text or ""))
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == [s for s in wanted.split(",") if s]


def test_secret_network_learns():
    random.seed(6)

    def examples(n):
        for k in range(n):
            token = "".join(random.choices("0123456789abcdef", k=32)) if k % 2 else "".join(random.choices("0123456789", k=16))
            yield f"some words before {'key ' if k % 2 else 'card '}{token} and after", token, k % 2

    rows = [(secrets.windows(t, t.index(x), t.index(x) + len(x))[0], y) for t, x, y in examples(400)]
    model = secrets.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32))
    assert model.recall >= 0.95
    new = [(secrets.probability(model, t, secrets.candidates(t))[0] >= model.threshold, y) for t, _, y in examples(200)]
    assert sum(hit for hit, y in new if y) >= 90 and sum(hit for hit, y in new if not y) <= 5


def test_secret_threshold_keeps_recall():
    random.seed(4)
    x = np.array([secrets.windows(t := f"card {random.randrange(10**15, 10**16)} of", 5, 21)[0] for _ in range(600)])
    model = secrets.fit(x, np.array([random.random() < 0.3 for _ in x], np.float32))
    assert model.recall >= 0.98 and model.threshold < 0.5


def test_secret_candidates(spark):
    text = "x" * 20 + " pin1 ab-c12 (aB3456) d3" + "y" * 50 + " shortword é9éabc12é"
    assert [text[s:e] for s, e in secrets.candidates(text)] == ["x" * 20, "ab-c12", "aB3456", "d3" + "y" * 50]
    token = "sk_live_" + "0123456789abcdef01234567" + "QZ7TAIL"
    texts = [f"a {token} b", "in code1x here", "token=abcdef123456"]
    some = secrets.fit(np.array([secrets.windows("a b", 0, 3)[0]] * 40), np.array([0, 1] * 20, np.float32))
    some.threshold = 0.0
    assert [r.text for r in secrets.redact(docs_of(spark, texts), some).orderBy("doc_id").collect()] == ["a <SECRET> b", "in <SECRET> here", "<SECRET>"]
    assert secrets.findings(some, texts[2]) == [(0, 0, 18, 1.0)]


def test_secret_scan_adds_what_the_network_finds(spark):
    """The added spans are the candidates outside the rules' findings whose probability, asked one by one, reaches the threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(docs)
    assert model.filters is not None and model.recall >= 0.9
    for r in secrets.scan(docs, model).collect():
        base = brute_secrets(r.text or "")
        wanted = []
        for s, e in secrets.candidates(r.text or ""):
            if not any(a <= s and e <= b for _, a, b in base) and float(secrets.probability(model, r.text, [(s, e)])[0]) >= model.threshold:
                wanted.append((s, e))
        assert [(f.start, f.end) for f in r.findings if f.kind == "model"] == wanted


def test_secret_shapes_not_trained_on(spark):
    """A network that has seen some shapes of tokens finds others, in texts that it has not seen, and few ordinary candidates beside them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = ("build", "package", "mail")
    model = secrets.train(docs.where("doc_id % 5 > 0"), shapes={k: v for k, v in secrets.SHAPES.items() if k not in held})
    random, hits, tries, extra, seen = np.random.default_rng(5), 0, 0, 0, 0
    for r in docs.where("doc_id % 5 = 0").orderBy("doc_id").limit(300).collect():
        for m in list(secrets.WORD.finditer(r.text or ""))[:1]:
            token = secrets.token_of(secrets.SHAPES[held[tries % 3]], random)
            text = r.text[: m.start()] + token + r.text[m.end() :]
            hits += any(s <= m.start() + 3 and e >= m.start() + len(token) - 3 for s, k, e, _ in secrets.findings(model, text) if k == 3)
            tries += 1
        spans = secrets.candidates(r.text or "")
        seen += len(spans)
        extra += sum(k == 3 for _, k, _, _ in secrets.findings(model, r.text or ""))
    print("held-out shapes", hits, tries, "added", extra, seen, "recall", model.recall, "threshold", model.threshold)
    assert hits >= 0.9 * tries and tries > 200


def test_secret_training_takes_every_window(spark):
    """The threshold is the exact order statistic of all held-back findings of a table with more than 4000 windows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    every = {(y, w) for r in docs.collect() if r.text for _, y, w in secrets._examples(r.text, 3)}
    table = spark.createDataFrame([(y, bytearray(w)) for y, w in every], "label int, window binary").withColumn("held", F.pmod(F.xxhash64("window"), F.lit(5)) == 0)
    rows = [(r.label, bytes(r.window)) for r in table.where("held").collect()]
    assert len(every) > 4000
    model = secrets.train(docs, epochs=1, least=1000)
    x = np.frombuffer(b"".join(w for y, w in rows if y == 1), np.uint8).reshape(-1, secrets.WIDTH).astype(np.int64)
    p = 1 / (1 + np.exp(-(secrets.logits(model, x) * model.calibration[0] + model.calibration[1])))
    assert abs(np.sort(p)[int((1 - 0.98) * len(p))] - model.threshold) < 1e-5 and 0.98 <= model.recall


def test_masked_findings():
    for text, wanted in (('a password="abcdef1" b', "abcdef1"), ("k AKIA" + "B1" * 8 + " x", "B1" * 10), ("f" * 24, None)):
        (s, k, e), *_ = secrets.base_findings(text)
        made = secrets._masked(text, s, k, e)
        assert (made and made[0][made[1] : made[2]]) == wanted and (not made or (len(made[0]) == len(text) and not secrets.base_findings(made[0])))


def test_secret_edges(spark):
    df = docs_of(spark, ["token=abcdef123456"] * 2, kept="x")
    assert secrets.scan(df.where("false"), secrets.SecretModel()).count() == 0
    assert secrets.train(df.where("false")).filters is None
    assert len({str(r.findings) for r in secrets.scan(df, secrets.SecretModel()).collect()}) == 1
    long = "key " + "Ab1" * 200
    places = [(at, label) for at, label, _ in secrets._examples(long + " token=abcdef1", 3)]
    assert len([1 for at, _ in places if at < 4 + 600]) > 10 and any(label for _, label in places)


# 9


def test_toxicity(spark):
    base = "/root/testdata/sf0.1"
    out = registry.op9_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    share = {(r.held_out, r.toxic): r.p for r in out.groupBy("held_out", "toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert share[(True, 1)] >= 0.9 and share[(True, 0)] < 0.01
    rows = [r for r in out.select("doc_id", "held_out", "score").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_training_as_brute_force(spark, monkeypatch):
    """Selection, ratios and the folds' scores against loops over sets of n-grams."""
    random.seed(12)
    bad, good = ["dreck", "mist"], WORDS
    texts = [" ".join(random.choices(good, k=8) + ([random.choice(bad)] if k % 3 == 0 else [])) for k in range(90)]
    y = [int(k % 3 == 0) for k in range(90)]
    taken = {}
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda row, col, labels, buckets, **more: taken.update(row=row, col=col, y=labels, buckets=buckets) or real(row, col, labels, buckets, **more))
    model = toxicity.train(docs_of(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    sets = []
    for t in texts:
        code = np.array([ord(c) for c in t], np.uint32)
        sets.append({b for _, bs in toxicity._grams(code, np.array([0, len(code)])) for b in bs.tolist()})
    ratio, kept = {}, []
    for b in sorted(set().union(*sets)):
        c1, c0 = (sum(b in s for s, l in zip(sets, y) if l == k) for k in (1, 0))
        share = (c1 + c0) / 90
        if c1 + c0 < 90 and abs(c1 / 30 - c0 / 60) / np.sqrt(share * (1 - share) * (1 / 30 + 1 / 60)) >= min(toxicity.LEAST_Z, 90**0.5 / 2):
            kept.append(b)
            ratio[b] = np.log((c1 + 10 * 30 / 90) / 40 / ((c0 + 10 * 60 / 90) / 70))
    assert taken["buckets"].tolist() == kept and taken["y"].tolist() == y
    assert {(r, kept[c]) for r, c in zip(taken["row"], taken["col"])} == {(i, b) for i, s in enumerate(sets) for b in s & set(kept)}
    mine = toxicity.ratios(taken["row"], taken["col"], taken["y"], len(kept))
    assert np.allclose(mine, [ratio[b] for b in kept])
    assert (model.weights[kept] * mine >= 0).mean() > 0.9
    got = toxicity.score_texts(model, pa.array(texts, pa.string())) >= 0.5
    assert got.tolist() == [bool(l) for l in y]


def test_fewest_errors():
    random.seed(3)
    for _ in range(50):
        z = np.array([random.randrange(8) + random.random() / 9 for _ in range(12)])
        y = np.array([random.randrange(2) for _ in z])
        y[:2] = 0, 1
        wrong = lambda cut: float((((z >= cut) != (y > 0)) * np.where(y > 0, 6 / sum(y > 0), 6 / sum(y == 0)) ** 0.5).sum())  # noqa: B023, E731
        assert abs(wrong(toxicity.fewest_errors(z, y)) - min(wrong(c) for c in [*z, z.max() + 1])) < 1e-9


def test_toxicity_edges(spark):
    texts = ["you idiot scum"] * 5 + ["a kind word here"] * 5 + [None, "", "x"]
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)] + [(11, None)], "doc_id long, toxic int")
    docs = docs_of(spark, texts, score="s")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[i] for i in range(5)) > 0.5 > max(got[i] for i in range(5, 10)) and len(got) == 13
    assert toxicity.flag(docs, model, "t").columns == ["doc_id", "text", "score", "t"]
    flagged = toxicity.flag(docs, model, "score")
    assert flagged.columns == ["doc_id", "text", "score"] and [r.score for r in flagged.orderBy("doc_id").collect()] == [got[i] for i in range(13)]
    assert toxicity.score(docs.where("false"), model).count() == toxicity.flag(docs.where("false"), model, "t").count() == 0
    long = docs_of(spark, ["a kind word here " * 60_000 + "you idiot scum", "ÄÖ é 漢字", "é"])
    assert [0 <= r.score <= 1 for r in toxicity.score(long, model).collect()] == [True] * 3
    nothing = toxicity.train(docs, labels.where("false"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, nothing).collect())


# 10


def test_decontamination(spark):
    random.seed(9)
    items = [" ".join(random.choices(WORDS, k=random.randrange(1, 30))) for _ in range(12)] + [None, "", "!?", "Éa bç", WORDS[0]]
    items.append(items[0])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [" ".join(random.choices(WORDS, k=random.randrange(60))) for _ in range(40)]
    texts += [f"x, {items[k].upper().replace(' ', '--')}. y" for k in range(12)] + [None, "", "éa-bç", "Éa bç"]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for k, t in enumerate(items):
        w = word.findall(low(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    wanted = {}
    for d, t in enumerate(texts):
        w = word.findall(low(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit |= set(range(i, i + n))
        wanted[d] = (len(w), len(hit), sorted(found))
    df = docs_of(spark, texts, n_words="a", matches="b", item_id="c")
    for limit in (1 << 20, 200):  # the second in many blocks
        out = decontaminate.find_matches(df, bench, max_block_bytes=limit).withColumn("n_hit", decontaminate.covered_words(F.col("matches")))
        assert {r.doc_id: (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) for r in out.collect()} == wanted
    kept = decontaminate.remove_contaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in wanted.items() if not v[1]} and kept.columns == df.columns
    assert decontaminate.find_matches(df, bench.where("false")).where("size(matches) > 0 or n_words < 0").count() == 0
    assert decontaminate.find_matches(df.where("false"), bench).count() == 0


def test_toxicity_scores_as_brute_force():
    """The score of a text is the logistic sum of the weights of its distinct n-grams of characters."""
    random.seed(1)
    texts = ["".join(random.choices("abÄ é漢", k=random.randrange(12))) for _ in range(60)]
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), 0.25)
    every = toxicity.score_texts(model, pa.array(texts, pa.string()))
    for t, p in zip(texts, every):
        code = np.array([ord(c) for c in t.lower()], np.uint32)
        buckets = set()
        for n in toxicity.ORDERS:
            for i in range(len(code) - n + 1):
                one = list(toxicity._grams(code[i : i + n], np.array([0, n])))[toxicity.ORDERS.index(n)]
                buckets |= set(one[1].tolist())
        assert abs(p - 1 / (1 + np.exp(-(0.25 + sum(float(model.weights[b]) for b in buckets))))) < 1e-5


def test_decontamination_of_repetitive_texts(spark):
    long, item = "alpha " * 16_000, "alpha " * 60
    bench = spark.createDataFrame([(k, item) for k in range(20)], "item_id long, text string")
    rows = decontaminate.find_matches(docs_of(spark, [long, long, "beta " * 9]), bench).orderBy("doc_id").collect()
    assert [(r.n_words, len(r.matches)) for r in rows] == [(16_000, 20), (16_000, 20), (9, 0)]
    assert {(m.first_word, m.end_word, m.longest) for m in rows[0].matches} == {(0, 16_000, 60)}


def test_merged_matches():
    random.seed(2)
    rows = [(random.randrange(3), random.randrange(3), a := random.randrange(60), a + random.randrange(1, 9), random.randrange(9)) for _ in range(80)]
    got = {tuple(x) for x in decontaminate._merged(np.array(rows)).tolist()}
    wanted = set()
    for key in {r[:2] for r in rows}:
        open_ = None
        for f, e, m in sorted(r[2:] for r in rows if r[:2] == key):
            if open_ and f <= open_[1]:
                open_ = (open_[0], max(e, open_[1]), max(m, open_[2]))
            else:
                wanted |= {(*key, *open_)} if open_ else set()
                open_ = (f, e, m)
        wanted.add((*key, *open_))
    assert got == wanted


def test_longest_match():
    test = decontaminate.test_set([7], ["a b c d e f g h i j k l m"], 10)
    text = np.frombuffer(b"zz b c d e f g h i j k l m n", np.uint8)
    counts, found = decontaminate.shard_matches(test, text, np.array([0, len(text)]))
    assert counts.tolist() == [14] and found == [[("7", 1, 13, 12)]]
    assert json.dumps(found[0]) and pa.array(counts)


# Queries with SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    rows = registry.QUERIES[name](spark, DATA).select(names).collect()
    assert sorted(map(tuple, rows)) == sorted(got.fetchall())
