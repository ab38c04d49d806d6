"""Problems 7, 8 and 9."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import leaks, mojibake, tokens

FOLDER = os.environ.get("SIEVELIGHT_TOKENIZERS", "/opt/tokenizers")
DOCS = "doc_id bigint, text string, word string, ids string, at int, n bigint, w string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", 1, 2, "x") for i, t in enumerate(texts)], DOCS)


TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world, it's the 1st test.", "the the the the", "naïve façade — “quotes” …", "日本語のテキスト 🎨👩‍🎨 ok", "<|endoftext|> is text", "tab\tand\r\nlines  with   runs ",
    "x" * 5000, "word " * 20_000, "Привет, мир! 12345 ½", " nbsp ​ zero", "don't we'll I'm YOU'RE", "Hello world, it's the 1st test.", "́combining é", "a b\u0085c",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tokenizers here")
def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs(spark, TEXTS)).collect()}
    assert got == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tokenizers here")
def test_decoding_inverts_and_rare_words_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 2)
    encoded = tokens.encode(docs(spark, TEXTS))
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    monkeypatch.setattr(tokens, "FREQUENT_BYTES", 0)  # no word is broadcast
    assert ids == {r["doc_id"]: r["ids"] for r in tokens.encode(docs(spark, TEXTS)).collect()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(docs(spark, TEXTS).limit(0)).count() == 0
    unknown = spark.createDataFrame([(1, [15, 999_999])], "doc_id bigint, ids array<int>")
    assert tokens.decode(unknown).first()["text"] is None


def plain_leaks(documents, items):
    import regex

    words = lambda t: [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
    grams = lambda ws: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
    of = {j: grams(words(t)) for j, t in items}
    return {(i, j) for i, t in documents for j, g in of.items() if grams(words(t)) & g}


def test_hot_words_beyond_the_broadcast(spark, monkeypatch):
    """A long word in every document is no hot key of one task, and ids stay in order."""
    from sievelight.operators import skew

    monkeypatch.setattr(skew, "HOT_SHARE", 1_000_000_000)
    rule = "-" * 300
    texts = [f"{rule} a{i} {rule}\n\n b {rule}" for i in range(700)]
    want = {r["doc_id"]: r["ids"] for r in tokens.encode(docs(spark, texts)).collect()}
    monkeypatch.setattr(tokens, "FREQUENT_BYTES", 200)
    seen = []
    monkeypatch.setattr(tokens, "hot_buckets", lambda *a: seen.append(skew.hot_buckets(*a)) or seen[-1])
    assert want == {r["doc_id"]: r["ids"] for r in tokens.encode(docs(spark, texts)).collect()} and seen[0]


def test_edited_passages_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, some(rng.choice([12, 20, 34, 50, 88]))) for j in range(40)]
    documents = []
    for i in range(300):
        ws = list(items[rng.randrange(40)][1])
        for _ in range(rng.choice([0, 1, 1, 2])):  # a word replaced, dropped or put in
            at = rng.randrange(len(ws))
            ws[at : at + rng.choice([0, 1, 1])] = some(rng.choice([0, 1, 1]))
        documents.append((i, some(rng.randint(0, 40)) + ws + some(rng.randint(0, 40)) if rng.random() < 0.7 else some(80)))
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in documents], "doc_id bigint, text string")
    it = spark.createDataFrame([(j, " ".join(ws)) for j, ws in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.near_leaks(d, it).collect()}
    # brute force: every window against every window of the item's class, by the same similarity
    number = {w: k for k, w in enumerate(sorted({w for _, ws in items + documents for w in ws}))}
    code = np.random.default_rng(1).integers(-(2**62), 2**62, len(number))
    hashed = lambda ws: code[[number[w] for w in ws]]
    want = set()
    for index in leaks.by_size([(j, hashed(ws)) for j, ws in items]):
        for i, ws in documents:
            if len(ws) >= index.window:
                views = np.lib.stride_tricks.sliding_window_view(hashed(ws), index.window)
                for k, row in enumerate(index.rows):
                    if (index.similarity(np.broadcast_to(row, views.shape).copy(), views) >= leaks.SIMILAR).any():
                        want.add((i, int(index.ids[k])))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100


def test_leaks_are_those_of_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_WINDOWS", 40)  # several blocks
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ärger", "naïve", "слово", "x2"]
    text = lambda n: rng.choice([" ", ", ", "\n- "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(j, text(rng.choice([8, 12, 20, 40]))) for j in range(15)] + [(90, None), (91, ""), (92, items_short := "one two three")]
    documents = [(0, None), (1, ""), (2, items_short)]
    for i in range(3, 60):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            ws = items[rng.randrange(15)][1].split()
            at, n = rng.randint(0, max(0, len(ws) - 12)), rng.choice([11, 12, 13, 30])
            t += " zz " + " ".join(ws[at : at + n]).upper() + " zz " + text(5)
        documents.append((i, t))
    documents += [(100, items[3][1] + " and " + items[3][1]), (101, text(30_000) + " zz " + items[2][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in documents], "doc_id bigint, text string, item_id string, w int")
    got = [(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_leaks(documents, items) and len(got) > 10
    assert leaks.leaks(d.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leaks.leaks(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_fingerprints_of_pieces_and_likeness(monkeypatch):
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    whole = leaks.fingerprints(h)
    monkeypatch.setattr(leaks, "PIECE", 37)
    assert (leaks.fingerprints(h) == whole).all() and len(whole) == 489
    near = np.bitwise_count(whole[:-1] ^ whole[1:]).mean()
    assert near < np.bitwise_count(whole[:-50] ^ whole[50:]).mean()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    parts = ["La légende décrit une forêt brûlée.", "Später wurde größtenteils geprüft.", "A revisão não encontrou padrão.", "Снимок признан настоящим после просмотра.", "Según señaló, también añadió números.", "The café “opened” — 18×24 px.", "plain words only"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]


def test_chains_invert(corpus):
    for chain in mojibake.CHAINS:
        for t in corpus[:40]:
            bad = mojibake.garble(t, chain)
            if bad is not None and "�" not in bad:
                assert mojibake.invert(bad, chain) == t


def test_garbled_are_found_and_restored(spark, corpus):
    rng = random.Random(7)
    chains = [c for c in mojibake.CHAINS if c in ((("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1251", "cp1252"),), (("cp1252", "cp850"),))]
    rows, want, original = [], set(), {}
    for i, t in enumerate(corpus):
        bad = mojibake.garble(t, rng.choice(chains)) if i % 25 == 0 else None
        if bad is not None and bad != t:
            want.add(i)
        original[i] = t
        rows.append((i, bad if bad is not None else t))
    rows += [(1000, None), (1001, ""), (1002, "ascii only"), (1003, "lost caf� here"), (1004, "🎨 ▓▒░ ok")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, words string, chains string")
    model = mojibake.train(df)
    assert {r["doc_id"] for r in mojibake.judged(df, model=model).collect()} == want | {1003}
    back = {r["doc_id"]: (r["text"], r["whole"]) for r in mojibake.restored(df, model=model).collect()}
    assert back[1003][1] is False
    assert sum(back[i] == (original[i], True) for i in want) >= 0.9 * len(want)
    assert mojibake.judged(df.limit(0)).count() == 0


def test_originals_are_looked_up_in_all_documents(spark, corpus, monkeypatch):
    """Single-byte words whose originals are in no sampled document; a bounded sample may only limit the bigrams."""
    rare = "Übergrößenträger"
    bad = mojibake.garble(rare, (("cp1252", "cp850"),))
    texts = dict(enumerate([*corpus[:100], *[f"the {rare} here"] * 3, f"the {bad} here"]))
    sample = [r["id"] for r in spark.range(len(texts)).orderBy(F.xxhash64("id")).limit(60).collect()]
    swapped = dict(zip(range(100, 104), [i for i in range(103, -1, -1) if i not in sample][:4]))  # ids beyond the sample
    for i, j in swapped.items():
        texts[i], texts[j] = texts[j], texts[i]
    at = next(i for i, t in texts.items() if bad in t)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(mojibake, "SAMPLE", 60)
    model = mojibake.train(df)
    assert rare.lower() not in model.known and [x[1] for x in model.candidates(bad)][:1] == [rare]
    assert [r["words"] for r in mojibake.judged(df).collect()] == [[(bad, rare)]]
    back = mojibake.restored(df).collect()
    assert [(r["doc_id"], r["text"], r["whole"]) for r in back] == [(at, f"the {rare} here", True)]


def test_held_out_accuracy(corpus):
    """Chains told apart on words the classifier was not trained with."""
    from collections import Counter

    words = Counter(w for t in corpus[:300] for w in t.split() if not w.isascii())
    model = mojibake.Classifier.train(words)
    held = {w for t in corpus[300:] for w in t.split() if not w.isascii()}
    chain = (("utf-8", "cp1252"),)
    assert all(model.judge([w]) == [] for w in held)
    bad = [(w, mojibake.garble(w, chain)) for w in held]
    assert np.mean([[x[2] for x in model.judge([b])] == [w] for w, b in bad if b]) > 0.95


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string")
    assert mojibake.judged(df).count() == 0 and mojibake.restored(df).count() == 0
    assert df.select(F.col("doc_id")).count() == 2
