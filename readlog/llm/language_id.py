"""Language identification by unigrams over a fixed vocabulary, with segmentations marginalised.

A language is a probability for each piece of a public byte-level vocabulary, all of it. A word is a run of letters in
lower case, whole, behind the space with which the vocabulary starts words. A word's likelihood is the sum over all ways
to cut it into pieces, by a forward pass over its bytes; a text's is the product over its words. Probabilities are
fitted by expectation-maximisation on all words of a bounded sample of labelled documents, one language a task;
expected piece counts come from a forward and a backward pass. Every language that a row to learn from names is fitted.

Scoring works on the different words of a lot of texts at once: pieces are found by hashing the byte ranges of all
lengths that the vocabulary has, and the forward pass runs over all words of a length together, for all languages.
Words of more than ``LONG`` bytes, as scripts without spaces have them, go together whatever their lengths, in logarithms.
Words are kept, and languages taken at a time, within ``CACHE_BYTES`` and ``MODEL_BYTES`` of a task; a model takes 200 KB
a language on the driver, however many documents there are.

The score is the posterior of the predicted language under equal priors.

Cases: null text, and text without a letter, is ``und`` with score 0; letters of no fitted word still score through
single bytes; a very long text is scored whole; languages that tie go to the first by code point; repeated rows score
alike; an empty table gives no rows; without a labelled row all is ``und``; a null doc_id is predicted, but not learnt
from; ``lang`` and ``source`` are never read when scoring, nor are extra columns, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.storage import checkpoint, documents

#: The sample of a fit: about so many documents of a language.
SAMPLE_DOCS, ROUNDS = 1500, 3
WORDS = regex.compile(r"\p{L}+")
#: Bytes of a word from which it counts as long, of the word likelihoods that a task keeps, and of the languages it has at a time.
LONG, CACHE_BYTES, MODEL_BYTES = 96, 64 << 20, 128 << 20


@lru_cache(2)
def vocabulary(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces in order, and their lengths: the whole vocabulary and all single bytes."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(x.split()[0]) for x in lines}
    kept = sorted(pieces | {bytes([b]) for b in range(256)})
    data = np.frombuffer(b"".join(kept), np.uint8)
    sizes = np.array([len(p) for p in kept])
    ends = np.cumsum(sizes)
    prefix, powers = textnum.byte_prefix(data, 21)
    hashes = textnum.range_hash(prefix, powers, ends - sizes, ends)
    order = np.argsort(hashes)
    return hashes[order], sizes[order]


class Lookup:
    """Piece numbers of hashes, by an open table on their high bits; and the lengths that pieces have."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.bits = max(16, int(len(hashes) * 8).bit_length())
        self.hashes, self.shift = hashes, np.uint64(64 - self.bits)
        self.start = np.searchsorted(hashes >> self.shift, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.start).max())
        self.lengths = np.unique(sizes).tolist()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """-1 where there is no such piece."""
        slot = (values >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(values), -1, np.int32)
        for _ in range(self.depth):
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                break
            hit = self.hashes[at[open_]] == values[open_]
            out[open_[hit]] = at[open_[hit]]
            at[open_] += 1
        return out


#: Places in words of one length, and for each the piece lengths that some word has there with its piece numbers.
Table = list[list[tuple[int, np.ndarray]]]


def piece_table(words: np.ndarray, lookup: Lookup) -> Table:
    """For words of one length, as rows of bytes: by the place at which a piece ends, its length and its number by word."""
    n, size = words.shape
    prefix, powers = textnum.byte_prefix(words.ravel(), 21)
    out: Table = [[] for _ in range(size + 1)]
    row = np.arange(n) * size
    for k in lookup.lengths:
        for at in range(size - k + 1):
            piece = lookup(textnum.range_hash(prefix, powers, row + at, row + at + k))
            if (piece >= 0).any():
                out[at + k].append((k, piece))
    return out


def forward(table: Table, n: int, probability: np.ndarray) -> np.ndarray:
    """(words, languages) log-likelihoods, from piece probabilities (pieces + 1, languages) whose last row is 0."""
    size, languages = len(table) - 1, probability.shape[1]
    alpha = np.zeros((size + 1, n, languages))
    alpha[0] = 1
    log = np.zeros((n, languages))
    for at in range(1, size + 1):
        for k, piece in table[at]:
            alpha[at] += alpha[at - k] * probability[piece]
        if at % 16 == 0 or at == size:  # rescale what later places read
            scale = np.maximum(alpha[at], 1e-280)
            with np.errstate(over="ignore"):  # an infinite value would make places without a piece undefined
                alpha[: at + 1] = np.minimum(alpha[: at + 1] / scale, 1e290)
            log += np.log(scale)
    return log


def expected(table: Table, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one language's probabilities (pieces + 1,), whose last is 0.

    Pieces of k bytes are scaled by the k-th power of a word's own factor, which leaves the shares of its
    segmentations as they are and its likelihood 1.
    """
    n, size = len(weight), len(table) - 1
    factor = np.exp(-forward(table, n, probability[:, None])[:, 0] / size)
    scaled = [[(k, piece, probability[piece] * factor**k) for k, piece in places] for places in table]
    a, b = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    a[0] = b[size] = 1
    for at in range(1, size + 1):
        for k, _, p in scaled[at]:
            a[at] += a[at - k] * p
    out = np.zeros(len(probability))
    for at in range(size, 0, -1):
        for k, piece, p in scaled[at]:
            b[at - k] += b[at] * p
            out += np.bincount(piece % len(probability), weight * a[at - k] * p * b[at] / a[size], len(probability))
    return out[:-1]


def by_length(words: list[bytes], languages: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and byte matrix of the words of each length, about four megabytes of pieces at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        step = max(1, (4 << 20) // (size * size * max(1, languages // 4)))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), size)


def split_long(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the short words, and of the long ones in lots of similar lengths and about a megabyte with padding."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.flatnonzero(sizes > LONG)
    order = order[np.argsort(sizes[order], kind="stable")]
    lots, at = [], 0
    while at < len(order):
        to = at + 1
        while to < len(order) and sizes[order[to]] <= 2 * sizes[order[at]] and sizes[order[to]] * (to - at + 1) <= 1 << 20:
            to += 1
        lots.append(order[at:to])
        at = to
    return np.flatnonzero(sizes <= LONG), lots


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix with zeros behind shorter words, and their sizes."""
    sizes = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(w.ljust(sizes.max(), b"\0") for w in words), np.uint8).reshape(len(words), -1), sizes


def pieces_ending(matrix: np.ndarray, lookup: Lookup, step: int = 64) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """By the place at which a piece ends: lengths and piece numbers by word, -1 where there is none."""
    n, size = matrix.shape
    prefix, powers = textnum.byte_prefix(matrix.ravel(), 21)
    row = np.arange(n)[:, None] * size
    for begin in range(1, size + 1, step):
        ends = np.arange(begin, min(begin + step, size + 1))
        found = []
        for k in lookup.lengths:
            if k > ends[-1]:
                break
            start = np.maximum(ends - k, 0)
            piece = lookup(textnum.range_hash(prefix, powers, (row + start).ravel(), (row + ends).ravel())).reshape(n, -1)
            piece[:, ends < k] = -1
            if (piece >= 0).any():
                found.append((k, piece, (piece >= 0).any(axis=0)))
        for i, at in enumerate(ends.tolist()):
            yield at, [(k, piece[:, i]) for k, piece, some in found if some[i]]


def long_forward(words: list[bytes], lookup: Lookup, log_probability: np.ndarray) -> np.ndarray:
    """(words, languages) log-likelihoods of words of any lengths; the last row of ``log_probability`` is -inf."""
    matrix, sizes = padded(words)
    shape = (len(words), log_probability.shape[1])
    out, width = np.zeros(shape), max(lookup.lengths) + 1
    ring = np.full((width, *shape), -np.inf)
    ring[0] = 0
    for at, pieces in pieces_ending(matrix, lookup):
        now = np.full(shape, -np.inf)
        for k, piece in pieces:
            now = np.logaddexp(now, ring[(at - k) % width] + log_probability[piece])
        ring[at % width] = now
        done = sizes == at
        out[done] = now[done]
    return out


def long_expected(words: list[bytes], lookup: Lookup, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``expected`` for words of any lengths."""
    matrix, sizes = padded(words)
    with np.errstate(divide="ignore"):
        log_p = np.log(probability)
    n, size = matrix.shape
    a, b = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
    a[0] = 0
    b[sizes, np.arange(n)] = 0
    table = list(pieces_ending(matrix, lookup))
    for at, pieces in table:
        for k, piece in pieces:
            a[at] = np.logaddexp(a[at], a[at - k] + log_p[piece])
    whole, out = a[sizes, np.arange(n)], np.zeros(len(probability))
    for at, pieces in reversed(table):
        for k, piece in pieces:
            way = log_p[piece] + b[at]
            b[at - k] = np.logaddexp(b[at - k], way)
            out += np.bincount(piece % len(probability), weight * np.exp(a[at - k] + way - whole), len(probability))
    return out[:-1]


def fit_language(words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS, path: str | None = None) -> np.ndarray:
    """Piece probabilities of one language from counted words."""
    hashes, sizes = vocabulary(path)
    lookup, n = Lookup(hashes, sizes), len(hashes)
    probability = np.where(sizes == 1, 1e-3, 1e-4)
    short, lots = split_long(words)
    some = [words[i] for i in short]
    for _ in range(rounds):
        found, p = np.full(n, 0.01), np.append(probability, 0.0)
        for which, matrix in by_length(some):
            found += expected(piece_table(matrix, lookup), p, counts[short[which]].astype(float))
        for lot in lots:
            found += long_expected([words[i] for i in lot], lookup, p, counts[lot].astype(float))
        probability = found / found.sum()
    return probability


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces + 1, languages), from rows with a lang and a doc_id.

    The sample holds the documents whose id hash is below a cut by language, which follows from the language's count
    and lets about ``sample_docs`` pass; the model's size is that of the vocabulary, whatever the corpus.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    whole = 1 << 30
    cuts = known.groupBy("lang").agg(F.least(F.lit(whole), F.ceil(F.lit(sample_docs * whole) / F.count("*"))).alias("cut"))  # one row a language
    sample = known.join(F.broadcast(cuts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(whole)) < F.col("cut"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        probability = fit_language([b" " + w.encode() for w in table.column("word").to_pylist()], table.column("n").to_numpy(), path=path)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "p": pa.array([probability.astype("<f4").tobytes()], pa.binary())})

    rows = sorted(counted.groupBy("lang").applyInArrow(run, "lang string, p binary").collect())
    n = len(vocabulary(path)[0])
    model = np.zeros((n + 1, len(rows)), np.float32)
    for i, r in enumerate(rows):
        model[:n, i] = np.frombuffer(r["p"], "<f4")
    return [r["lang"] for r in rows], model


class Scorer:
    """Log-likelihoods of texts by language; those of words are kept within ``cache`` bytes."""

    def __init__(self, probability: np.ndarray, path: str | None = None, cache: int = CACHE_BYTES):
        self.probability, self.languages = probability.astype(float), probability.shape[1]
        with np.errstate(divide="ignore"):
            self.log_probability = np.log(self.probability)
        self.lookup, self.most = Lookup(*vocabulary(path)), max(1000, min(400_000, cache // (8 * max(1, self.languages))))
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, self.languages))

    def words(self, words: list[str]) -> np.ndarray:
        out, raw = np.zeros((len(words), self.languages)), [b" " + w.encode() for w in words]
        short, lots = split_long(raw)
        for which, matrix in by_length([raw[i] for i in short], self.languages):
            out[short[which]] = forward(piece_table(matrix, self.lookup), len(which), self.probability)
        for lot in lots:
            out[lot] = long_forward([raw[i] for i in lot], self.lookup, self.log_probability)
        return out

    def _learn(self, words: list[str]) -> None:
        added = self.words(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, added])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and its log-likelihoods."""
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        total = np.zeros((len(texts), self.languages))
        different = list(set().union(*words))
        for at in range(0, len(different), self.most):  # more than one part only for texts with very many words
            part = different[at : at + self.most]
            new = [w for w in part if w not in self.known]
            if len(self.known) + len(new) > self.most:
                self.known, self.logs, new = {}, self.logs[:0], part
            if new:
                self._learn(new)
            if len(part) == len(different):
                first, some = np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero(sizes)
                number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
                total[some] = self._summed(number, first[some])
            else:
                own = set(part)
                for i, ws in enumerate(words):
                    number = np.array([self.known[w] for w in ws if w in own], np.int64)
                    if len(number):
                        total[i] += self._summed(number, np.zeros(1, np.int64))[0]
        return sizes, total

    def _summed(self, number: np.ndarray, first: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """Sums of words' logs from each of ``first`` on, a language range at a time."""
        width = max(1, step // max(1, len(number)))
        parts = [np.add.reduceat(self.logs[number, at : at + width], first) for at in range(0, self.languages, width)]
        return np.concatenate([*parts, np.zeros((len(first), 0))], axis=1)


STATE = "lang_pred string, best double, total double"


def predict(docs: DataFrame, languages: list[str], probability: np.ndarray, path: str | None = None, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, lang_pred, score. Languages beyond ``model_bytes`` are scored in further passes over a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = max(1, model_bytes // (8 * len(probability)))
    none = [F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("total")]
    rows = docs.select("doc_id", "text", *none)
    for at in range(0, len(languages), size):
        if at:
            rows = checkpoint(rows)
        rows = _scored(rows, languages[at : at + size], probability[:, at : at + size], path, kind, at + size < len(languages))
    # total is the logarithm of the sum over all languages
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total"))))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def _scored(rows: DataFrame, languages: list[str], probability: np.ndarray, path: str | None, kind: str, more: bool) -> DataFrame:
    """doc_id, text if there are more, and the best of these languages and earlier ones."""
    model = rows.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(probability, np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, p = model.value
        scorer = Scorer(p, path)
        for batch in batches:
            for piece in textnum.pieces(batch, limit=max(1 << 15, (1 << 20) // max(1, len(named) // 4))):
                sizes, log = scorer(piece.column("text").to_pylist())
                number = log.argmax(axis=1)
                best = log[np.arange(len(log)), number]
                total = best + np.log(np.exp(log - best[:, None]).sum(axis=1))
                before = piece.column("best").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                lang = [named[k] if b > o else old for k, b, o, old in zip(number.tolist(), best.tolist(), before.tolist(), piece.column("lang_pred").to_pylist(), strict=True)]
                total = np.logaddexp(total, piece.column("total").fill_null(-np.inf).to_numpy(zero_copy_only=False))
                blank = sizes == 0
                arrays = [piece.column("doc_id"), *[piece.column("text")] * more, pa.array(lang, pa.string(), mask=blank), pa.array(np.maximum(best, before), mask=blank), pa.array(total, mask=blank)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *["text"] * more, "lang_pred", "best", "total"])

    return rows.mapInArrow(run, f"doc_id {kind}, {'text string, ' * more}{STATE}")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, *fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
