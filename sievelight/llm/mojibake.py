"""Garbled text from wrong character encoding.

A chain says how a text went wrong: written in one encoding, read in another, once or twice. A multinomial classifier over
hashed byte bigrams is trained on words of the corpus that are garbled here, synthetically, by each chain, and on the
words as they are; it predicts a word's chain. The prediction is inverted and verified: the word must encode in the encoding
it was read in and decode, strictly, in the one it was written in, and what comes out must itself be classified as clean.
Strict UTF-8 proves itself; between single-byte encodings almost anything decodes, so there what comes out must also be a
word that the documents' clean words hold more than once, or the document must hold such a word of the same chain besides.
Only words with characters beyond ASCII are looked at, as no chain here changes ASCII. Words with the replacement character
are garbled beyond repair: found, not restored.

Training of the bigrams takes the words of at most SAMPLE documents (a bounded sample by hash, collected with their counts);
words found garbled are taken out of the clean class and training repeats. Which words are known is counted over all
documents: their distinct words are scored once, originals of single-byte candidates are joined to the counts, words so
found garbled are taken out of the counts and the lookup repeats. Prediction covers all documents and whole texts, in Arrow
batches; only words that may be garbled are shuffled, and of these only the unproven are joined.

Defined results: null, empty and ASCII texts are clean; copies are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.session import materialise

#: Documents and distinct words that training of the bigrams may see, and the most bytes of one.
SAMPLE, MOST_WORDS, MOST_BYTES = 20_000, 100_000, 200
BUCKETS = 1 << 14
#: A word as found in a text: no ASCII white space, at least one character beyond ASCII.
WORD = r"[^ \t\r\n\f\x0B]*[^\x00-\x7F][^ \t\r\n\f\x0B]*"
LOSSY = "�"

#: (written in, read in), applied in order.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = tuple(
    [(("utf-8", r),) for r in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15")]
    + [(("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1251", "cp1251"))]
    + [(("cp1252", r),) for r in ("cp850", "cp437", "mac_roman", "cp1251", "cp1250")]
    + [(("cp1251", r),) for r in ("cp1252", "koi8_r", "cp866", "mac_roman")]
    + [(("koi8_r", r),) for r in ("cp1251", "cp1252")]
    + [(("cp866", r),) for r in ("cp1251", "cp1252")]
    + [((w, "cp1252"),) for w in ("cp850", "cp437", "mac_roman")]
)


def _encode(text: str, name: str) -> bytes:
    """Strict, but for the five bytes that cp1252 leaves open: readers give them as control characters."""
    if name != "cp1252":
        return text.encode(name)
    return b"".join(bytes([ord(c)]) if c in "\x81\x8d\x8f\x90\x9d" else c.encode(name) for c in text)


def _decode(data: bytes, name: str) -> str:
    if name != "cp1252":
        return data.decode(name)
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(name) for b in data)


def garble(text: str, chain) -> str | None:
    """What a reader in the wrong encoding sees; None where the text cannot go that way."""
    try:
        for written, read in chain:
            text = _decode(_encode(text, written), read)
    except UnicodeError:
        return None
    return text


def invert(text: str, chain) -> str | None:
    """The text before the chain, if every step back is strictly decodable."""
    try:
        for written, read in reversed(chain):
            text = _decode(_encode(text, read), written)
    except UnicodeError:
        return None
    return text


def features(word: str) -> np.ndarray:
    """Buckets of the byte bigrams that hold a byte beyond ASCII, with the word's ends as bytes."""
    data = np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", dtype=np.uint8).astype(np.int64)
    a, b = data[:-1], data[1:]
    keep = (a > 127) | (b > 127)
    return ((a[keep] * 257 + b[keep]) * 2654435761 >> 7) % BUCKETS


def bare(word: str) -> str:
    """A word in lower case without what isn't a letter at its ends; a word of digits and signs as it is."""
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1].lower() if at else word if any(c.isdigit() for c in word) else ""


DIGITS = str.maketrans("123456789", "000000000")


def level(word: str) -> str:
    """A word with all digits alike: no chain here changes digits, and numbers would be no two the same."""
    return word.translate(DIGITS)


class Classifier:
    """Multinomial over bigrams: class 0 is clean, class k is CHAINS[k - 1]."""

    def __init__(self, logp: np.ndarray, prior: np.ndarray, known: frozenset[str]) -> None:
        self.logp, self.prior, self.known = logp, prior, known
        self.seen: dict[str, list[tuple[int, bool]]] = {}

    @classmethod
    def train(cls, words: Counter, rounds: int = 3) -> Classifier:
        """Rounds differ in which words count as clean only, so what each word gives each class is made once."""
        plain = Counter()
        for word, n in words.items():
            plain[level(word)] += n
        names = list(plain)
        weight = np.array([plain[w] for w in names], dtype=np.float64) ** 0.75
        made: list[tuple[np.ndarray, np.ndarray]] = []  # by class: bucket and word of every feature
        for chain in (None, *CHAINS):
            buckets, owners = [], []
            for i, word in enumerate(names):
                seen = word if chain is None else garble(word, chain)
                if seen is not None and (chain is None or seen != word and LOSSY not in seen):
                    f = features(seen)
                    buckets.append(f)
                    owners.append(np.full(len(f), i))
            made.append((np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
        prior = np.full(len(CHAINS) + 1, 0.03 / len(CHAINS))
        prior[0] = 0.97
        clean = np.ones(len(names), dtype=bool)
        model = None
        for _ in range(rounds):
            counts = np.full((len(CHAINS) + 1, BUCKETS), 0.02)
            for k, (buckets, owners) in enumerate(made):
                keep = clean[owners]
                counts[k] += np.bincount(buckets[keep], weights=weight[owners[keep]], minlength=BUCKETS)
            known = Counter()
            for i in np.flatnonzero(clean):
                known[bare(names[i])] += plain[names[i]]
            model = cls(np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior), frozenset(w for w, n in known.items() if n > 1 and len(w) > 1))
            found = Counter()
            for i, word in enumerate(names):
                k = next((k for k, _, sure in model.candidates(word) if sure), 0)
                found[k] += plain[word]
                clean[i] = k == 0
            total = sum(found.values()) or 1
            prior = np.array([max(found[k] / total, 1e-5) for k in range(len(CHAINS) + 1)])
            prior /= prior.sum()
        model.seen.clear()
        return model

    def _scores(self, word: str) -> np.ndarray:
        return self.prior + self.logp[:, features(word)].sum(axis=1)

    def candidates(self, word: str) -> list[tuple[int, str | None, bool]]:
        """(class, original, sure), likeliest first, of the chains likelier than clean; class -1 is beyond repair. None: clean."""
        plain = level(word)
        known = self.seen.get(plain)
        if known is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            known = self.seen[plain] = self._candidates(plain)
        return [(k, invert(word, CHAINS[k - 1]) if k > 0 else None, sure) for k, sure in known]

    def _candidates(self, word: str) -> list[tuple[int, bool]]:
        if LOSSY in word:
            return [(-1, True)]
        scores, found = self._scores(word), []
        for k in map(int, np.argsort(-scores)):
            if k == 0:
                break
            chain = CHAINS[k - 1]
            back = invert(word, chain)
            if back is None or back == word or garble(back, chain) != word:
                continue  # not what this chain makes of anything
            if back.isascii() or self._scores(back)[0] + 1.0 >= scores[0]:  # the original must be the better clean word
                found.append((k, chain[0][0] == "utf-8" or bare(back) in self.known))
        return found

    def judge(self, words: list[str]) -> list[tuple[str, int, str | None]]:
        """(word, class, original) of the garbled words of one document."""
        options = {w: c for w in words if (c := self.candidates(w))}
        out = {w: next((x for x in c if x[2]), None) for w, c in options.items()}
        chains = {x[0] for x in out.values() if x and x[0] > 0}
        for w, c in options.items():
            if out[w] is None:
                out[w] = next((x for x in c if x[0] in chains), None)
        return [(w, x[0], x[1]) for w, x in out.items() if x]


def words_of(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, w): the words beyond ASCII of every document that has any, as often as they occur."""
    held = documents.select(F.col(ident).alias("_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    return materialise(held.where(F.size("w") > 0), "words")


def leveled(held: DataFrame) -> DataFrame:
    return held.select(F.explode("w").alias("w")).select(F.translate("w", "123456789", "000000000").alias("w"))


def train(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> Classifier:
    """A classifier from a bounded sample: words of the SAMPLE documents of least hash."""
    return fit(words_of(documents, ident, text))


def fit(held: DataFrame) -> Classifier:
    picked = held.orderBy(F.xxhash64("_id")).limit(SAMPLE)
    counts = leveled(picked).where(F.octet_length("w") <= MOST_BYTES).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(MOST_WORDS)
    return Classifier.train(Counter({r["w"]: r["n"] for r in counts.collect()}))


def vocabulary(held: DataFrame, model: Classifier) -> DataFrame:
    """(w, n, own, options): each distinct word of all documents, its count, its bare form, and of its candidates whether the chain proves itself, else the original's bare form."""
    shared = held.sparkSession.sparkContext.broadcast((model.logp, model.prior))
    option = pa.struct([("proven", pa.bool_()), ("key", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value, frozenset())
        for batch in batches:
            words = batch.column(0).to_pylist()
            options = [[{"proven": sure, "key": None if sure or len(key := bare(back)) < 2 else key} for _, back, sure in own.candidates(w)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(map(bare, words), pa.string()), pa.array(options, pa.list_(option))], names=["w", "n", "own", "options"])

    counts = leveled(held).groupBy("w").agg(F.count("*").alias("n"))
    return materialise(counts.mapInArrow(run, "w string, n bigint, own string, options array<struct<proven: boolean, key: string>>"), "vocabulary")


def looked_up(words: DataFrame, rounds: int = 3) -> DataFrame:
    """(w, hits): the words of a vocabulary with candidates whose originals are known, and those candidates' places."""
    words = words.withColumn("proven", F.exists("options", lambda o: o["proven"]))
    asked = words.where(F.size("options") > 0).select("w", "n", "own", "proven", F.posexplode("options").alias("at", "o"))
    asked = materialise(asked.select("w", "n", "own", "proven", "at", "o.key").where("key IS NOT NULL"), "asked")
    totals = words.where("NOT proven").groupBy(F.col("own").alias("key")).agg(F.sum("n").alias("n"))
    totals = materialise(totals.join(asked.select("key").distinct(), "key", "leftsemi"), "totals")
    known = totals
    for _ in range(rounds - 1):
        garbled = asked.where("NOT proven").join(known.where("n > 1"), "key", "leftsemi").select("w", "n", "own").distinct()
        less = garbled.groupBy(F.col("own").alias("key")).agg(F.sum("n").alias("less"))
        known = materialise(totals.join(less, "key", "left").select("key", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "known")
    return asked.join(known.where("n > 1"), "key", "leftsemi").groupBy("w").agg(F.collect_set("at").alias("hits"))


def judged(documents: DataFrame, ident: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """(ident, words, chains): per garbled document its garbled words, as struct(word, original), and the chains' names.

    A model gives the bigrams; known words are those of all the documents."""
    held = words_of(documents, ident, text)
    model = model or fit(held)
    hits = looked_up(vocabulary(held, model))
    shared = documents.sparkSession.sparkContext.broadcast((model.logp, model.prior))
    option = pa.struct([("k", pa.int32()), ("original", pa.string()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value, frozenset())
        for batch in batches:
            ids, places, found, plain, options = [], [], [], [], []
            for ident_, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, w in enumerate(words):
                    if c := own.candidates(w):
                        ids.append(ident_)
                        places.append(i)
                        found.append(w)
                        plain.append(level(w))
                        options.append([{"k": k, "original": o, "sure": sure} for k, o, sure in c])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.string()), pa.array(plain, pa.string()), pa.array(options, pa.list_(option))], names=["_id", "i", "word", "w", "options"])

    maybe = held.select("_id", F.array_distinct("w").alias("w")).mapInArrow(run, "_id bigint, i int, word string, w string, options array<struct<k: int, original: string, sure: boolean>>")
    maybe = materialise(maybe, "maybe")
    first = F.col("options")[0]["sure"]  # needs no lookup, and such a word may be in many documents
    asked = maybe.where(~first).join(hits, "w", "left")
    asked = asked.withColumn("options", F.transform("options", lambda o, at: o.withField("sure", o["sure"] | F.coalesce(F.array_contains("hits", at), F.lit(False)))))
    columns = ["_id", F.struct("i", "word", "options").alias("x")]
    x = maybe.where(first).select(*columns).unionByName(asked.select(*columns)).groupBy("_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    sure = lambda e: F.get(F.filter(e["options"], lambda o: o["sure"]), F.lit(0))
    x = x.withColumn("found", F.filter(F.transform("x", lambda e: sure(e)["k"]), lambda k: k > 0))
    besides = lambda e: F.get(F.filter(e["options"], lambda o: F.array_contains("found", o["k"])), F.lit(0))
    x = x.withColumn("bad", F.filter(F.transform("x", lambda e: F.struct(e["word"].alias("word"), F.coalesce(sure(e), besides(e)).alias("o"))), lambda e: e["o"].isNotNull()))
    names = F.array(*map(F.lit, ["lossy", *(">".join(f"{a}>{b}" for a, b in chain) for chain in CHAINS)]))
    return x.where(F.size("bad") > 0).select(
        F.col("_id").alias(ident),
        F.transform("bad", lambda e: F.struct(e["word"].alias("word"), e["o"]["original"].alias("original"))).alias("words"),
        F.array_sort(F.array_distinct(F.transform("bad", lambda e: F.get(names, F.greatest(e["o"]["k"], F.lit(0)))))).alias("chains"),
    )


SPACES = re.compile(r"([ \t\r\n\f\x0B]+)")


def restored(documents: DataFrame, ident: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """(ident, text, whole, chains) of garbled documents: the text with every garbled word restored that can be; whole if all were."""
    bad = judged(documents, ident, text, model)
    joined = documents.select(F.col(ident).cast("bigint").alias("_id"), F.col(text).alias("_t")).join(bad.withColumnRenamed(ident, "_id"), "_id").select("_id", "_t", "words", "chains")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole = [], []
            for t, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = {w["word"]: w["original"] for w in words if w["original"] is not None}
                texts.append("".join(good.get(x, x) for x in SPACES.split(t)))
                whole.append(len(good) == len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(whole), batch.column(3)], names=["_id", "text", "whole", "chains"])

    return joined.mapInArrow(run, "_id bigint, text string, whole boolean, chains array<string>").toDF(ident, "text", "whole", "chains")


def rates(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(chain, documents, whole, rate): per chain the garbled documents it was found in, and in how many every garbled word could be restored."""
    found = restored(documents, ident, text).select("whole", F.explode("chains").alias("chain"))
    counts = found.groupBy("chain").agg(F.count("*").alias("documents"), F.count_if("whole").alias("whole"))
    return counts.select("chain", "documents", "whole", (F.col("whole") / F.col("documents")).alias("rate"))
