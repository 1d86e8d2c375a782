"""Language-model scores by subword lattices.

A text is its words (runs without ASCII white space, A-Z lower-cased) and an end. A word's probability adds two ways to
write it: as a word the training texts hold, by its absolutely discounted count; and, with the mass the discounts set free, as
any segmentation into the pieces of an existing vocabulary, whose marginal probability a forward recursion in log space
sums over the lattice. The pieces' scores start from the vocabulary's own and are refitted by expectation
maximisation on all training words, each with the weight of the one discount it frees for the lattice, whatever its
count; a round is one distributed sum of the pieces' expected uses.

A text's probability is the marginal over classes of text, one for each of the commonest labels of the training documents:
each class has its own counts, which back off to those of all, and its own scores of pieces. No label of a scored text is read.

Word counts cover all training documents; the table grows with the corpus and is only joined, never gathered. The few
words frequent enough to fill a task (at most HOT of them can have a share of 1 / HOT of all) are broadcast, so
joins by word meet no hot key.

Defined cases: a null text is empty and consists of the end; rows equal in id and text are scored once and repeated; without training texts all
mass is on the lattice; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

HOT = 50_000
#: Rounds of fitting the pieces' scores.
ROUNDS = 4
#: Pieces of more characters are rare at any one place of a word, and are added place by place.
DENSE = 4
#: Characters of a word, with its mark, up to which no probability underflows: 20 times the 4 bytes of the longest character at most.
SHORT = 18
#: Words that go through a lattice at a time: those of one length then fill its arrays.
TOGETHER = 100_000
#: Classes with models of their own.
CLASSES = 8
START = "▁"
LN10 = math.log(10)
SLOT_BITS = 18
#: log score of a byte that spells part of a character.
BYTE = math.log(0.02 / 256)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.array(words, f"<U{len(words[0])}").view("<u4").reshape(len(words), -1)


def _spans(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For each number of characters up to most: a number for each run of so many, by where it begins."""
    h = np.zeros(codes.shape, np.uint64)
    out = []
    for d in range(most):
        h = h[:, : codes.shape[1] - d] * np.uint64(0x9E3779B97F4A7C15) + codes[:, d:].astype(np.uint64) + np.uint64(1)
        out.append(h)
    return out


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Lattice:
    """Pieces with natural log scores, a column for each of several models; characters that no piece covers are spelled by
    bytes. Words of one length go through the recursion together."""

    def __init__(self, scores: dict[str, float] | list[dict[str, float]], byte: float):
        tables = scores if isinstance(scores, list) else [scores]
        self.ids, self.byte = {p: i for i, p in enumerate(tables[0])}, byte
        # After the pieces: characters of 1 to 4 bytes, and no piece at all.
        rest = [[byte * k] * len(tables) for k in range(1, 5)] + [[-math.inf] * len(tables)]
        self.table = np.array([[t[p] for t in tables] for p in self.ids] + rest)
        # A lattice is as wide as the longest of its pieces: none is left out.
        self.longest = max(map(len, self.ids), default=1)
        # The pieces' hashes in order, and where those begin that share their first SLOT_BITS bits.
        h, lengths = np.zeros(len(self.ids), np.uint64), np.array([len(p) for p in self.ids])
        for n in np.unique(lengths):
            h[lengths == n] = _finish(_spans(_codes([p for p in self.ids if len(p) == n]), int(n))[-1])[:, 0]
        order = np.argsort(h)
        self.hashes, self.rows = np.append(h[order], np.zeros(64, np.uint64)), np.append(order, np.full(64, len(self.table) - 1)).astype(np.int32)
        assert len(np.unique(h)) == len(h), "two pieces share a hash"
        slots = (h[order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << SLOT_BITS)).astype(np.int32)
        self.filled = np.zeros(1 << SLOT_BITS, bool)
        self.filled[slots] = True
        self.most = int(np.bincount(slots).max()) if len(h) else 0

    def edges(self, words: list[str]) -> np.ndarray:
        """For marked words of one length: the row of the table for the piece of d + 1 characters that ends after character j."""
        codes, none = _codes([START + w for w in words]), len(self.table) - 1
        n, length = codes.shape
        found = np.full((n, length, self.longest), none, np.int32)
        for d, h in enumerate(_spans(codes, min(self.longest, length))):
            h = _finish(h)
            slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            i, j = np.nonzero(self.filled[slot])
            h, at, row = h[i, j], self.first[slot[i, j]], np.full(len(i), none, np.int32)
            for _ in range(self.most):
                np.copyto(row, self.rows[at], where=self.hashes[at] == h)
                at += 1
            found[i, j + d, d] = row
        spelled = found[:, :, 0] == none
        long = len(self.ids) + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        found[:, :, 0] = np.where(spelled, long, found[:, :, 0])
        return found

    def forward(self, edges: np.ndarray, only: int | None = None) -> np.ndarray:
        """[word, longest - 1 + prefix, model]: log of the summed probability of all segmentations of each prefix; of one
        model, if only that is asked for."""
        n, length, width = edges.shape
        few, none = min(DENSE, width), len(self.table) - 1
        table = self.table if only is None else np.ascontiguousarray(self.table[:, only : only + 1])
        alpha = np.full((n, width + length, table.shape[1]), -math.inf)
        alpha[:, width - 1] = 0.0
        for j in range(length):
            each = alpha[:, j + width - few : j + width][:, ::-1] + table[edges[:, j, :few]]
            top = each.max(axis=1, keepdims=True)
            alpha[:, j + width] = top[:, 0] + np.log(np.exp(each - top).sum(axis=1))
            for d in range(few, min(width, j + 1)):
                w = np.flatnonzero(edges[:, j, d] != none)
                if len(w):
                    alpha[w, j + width] = np.logaddexp(alpha[w, j + width], alpha[w, j + width - 1 - d] + table[edges[w, j, d]])
        return alpha

    def batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Positions of words of one length, and their edges."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, at in by.items():
            step = max(1, 60_000 // (length + 1))
            for k in range(0, len(at), step):
                yield at[k : k + step], self.edges([words[i] for i in at[k : k + step]])

    def log10(self, words: list[str]) -> np.ndarray:
        """[word, model]: marginal log10 probabilities."""
        out = np.zeros((len(words), self.table.shape[1]))
        for at, edges in self.batches(words):
            out[at] = self.forward(edges)[:, -1] / LN10
        return out

    def uses(self, edges: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each row of the table in weighted words of one length under model k, by the forward and the
        backward recursion."""
        n, length, width = edges.shape
        few, none, table = min(DENSE, width), len(self.table) - 1, np.ascontiguousarray(self.table[:, k])
        alpha = self.forward(edges, k)[:, width - 1 :, 0]
        beta = np.full((n, length + width), -math.inf)
        beta[:, length] = 0.0
        for i in range(length - 1, -1, -1):
            steps = np.arange(min(few, length - i))
            each = table[edges[:, i + steps, steps]] + beta[:, i + 1 : i + 1 + len(steps)]
            top = each.max(axis=1, keepdims=True)
            with np.errstate(invalid="ignore"):
                beta[:, i] = np.where(np.isfinite(top[:, 0]), top[:, 0] + np.log(np.exp(each - top).sum(axis=1)), -math.inf)
            for d in range(few, min(width, length - i)):
                w = np.flatnonzero(edges[:, i + d, d] != none)
                if len(w):
                    beta[w, i] = np.logaddexp(beta[w, i], table[edges[w, i + d, d]] + beta[w, i + d + 1])
        out = np.zeros(len(self.table))
        for d in range(min(width, length)):
            w, i = np.nonzero(edges[:, d:, d] != none)
            row = edges[w, i + d, d]
            p = alpha[w, i] + table[row] + beta[w, i + d + 1] - alpha[w, length]
            out += np.bincount(row, weights[w] * np.exp(np.minimum(0.0, p)), len(out))
        return out

    def short_uses(self, edges: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
        """uses() of words of at most SHORT characters, whose probabilities fit into doubles without logarithms."""
        n, length, width = edges.shape
        few, none, table = min(DENSE, width), len(self.table) - 1, np.exp(self.table[:, k])
        alpha, beta = np.zeros((n, width + length)), np.zeros((n, length + width))
        alpha[:, width - 1] = beta[:, length] = 1.0
        far = []
        for d in range(few, min(width, length)):
            w, i = np.nonzero(edges[:, d:, d] != none)
            order = np.argsort(i, kind="stable")
            w, i = w[order], i[order]
            far.append((d, w, table[edges[w, i + d, d]], np.searchsorted(i, np.arange(length + 1))))
        near = table[edges[:, :, :few]]
        for j in range(length):
            alpha[:, j + width] = np.einsum("nd,nd->n", alpha[:, j + width - few : j + width][:, ::-1], near[:, j])
            for d, w, p, cut in far:
                if j >= d:
                    at = slice(cut[j - d], cut[j - d + 1])
                    alpha[w[at], j + width] += alpha[w[at], j - d + width - 1] * p[at]
        for i in range(length - 1, -1, -1):
            for d in range(min(few, length - i)):
                beta[:, i] += near[:, i + d, d] * beta[:, i + d + 1]
            for d, w, p, cut in far:
                if i + d < length:
                    at = slice(cut[i], cut[i + 1])
                    beta[w[at], i] += p[at] * beta[w[at], i + d + 1]
        alpha = alpha[:, width - 1 :]
        share, out = weights / alpha[:, length], np.zeros(len(self.table))
        for d in range(min(few, length)):
            p = (alpha[:, : length - d] * near[:, d:, d] * beta[:, d + 1 : length + 1]) * share[:, None]
            out += np.bincount(edges[:, d:, d].ravel(), p.ravel(), len(out))
        for d, w, p, cut in far:
            i = np.repeat(np.arange(length), np.diff(cut))
            out += np.bincount(edges[w, i + d, d], alpha[w, i] * p * beta[w, i + d + 1] * share[w], len(out))
        return out

    def expected(self, words: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        """Expected uses of each piece in the words under the first model; or, with weights [word, model], [piece, model]."""
        by = np.ones((len(words), 1)) if weights is None else weights
        out = np.zeros((len(self.table), by.shape[1]))
        for at, edges in self.batches(words):
            some = by[at]
            for k in range(by.shape[1]):
                mine = np.flatnonzero(some[:, k])
                if len(mine):
                    uses = self.short_uses if edges.shape[1] <= SHORT else self.uses
                    out[:, k] += uses(edges if len(mine) == len(some) else edges[mine], k, some[mine, k])
        return out[: len(self.ids), 0] if weights is None else out[: len(self.ids)]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in groups of TOGETHER rows or more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def vocabulary(path: str) -> dict[str, float]:
    """All pieces of a sentencepiece model without an inner mark, with the scores the model gives them; a score is
    minus a piece's rank, so its weight falls as the inverse of it."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(m.vocab_size()):
        p = m.id_to_piece(i)
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and p and START not in p[1:]:
            found[p] = 1.0 / (100.0 - min(0.0, m.get_score(i)))
    total = sum(found.values())
    return {p: math.log(0.98 * w / total) for p, w in found.items()}


def fit(weights: DataFrame, classes: list[str], pieces: dict[str, float], rounds: int = ROUNDS) -> list[dict[str, float]]:
    """For each class, a column of weights(word, ...): the pieces' scores after rounds of expectation maximisation on all
    words with such a weight. A round's result has a row for each piece that is used at all."""
    names, sc = list(pieces), weights.sparkSession.sparkContext
    tables = [pieces] * len(classes)
    uses = [f"u{j}" for j in range(len(classes))]
    for _ in range(rounds if classes else 0):
        shared = sc.broadcast(Lattice(tables, BYTE))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(names), len(classes)))
            for b in together(batches):
                by = np.stack([b.column(1 + j).to_numpy() for j in range(len(classes))], axis=1).astype(float)
                total += shared.value.expected(b.column(0).to_pylist(), by)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(np.ascontiguousarray(total[some, j])) for j in range(len(classes)))], names=["piece", *uses])

        got = weights.filter(sum((F.col(c) for c in classes[1:]), F.col(classes[0])) > 0).select("word", *classes).mapInArrow(common.tidied(run), "piece long, " + ", ".join(f"{x} double" for x in uses))
        got = got.groupBy("piece").agg(*[F.sum(x).alias(x) for x in uses]).toArrow()
        total = np.full((len(names), len(classes)), 1e-3)
        total[got.column("piece").to_numpy()] += np.stack([got.column(x).to_numpy() for x in uses], axis=1)
        tables = [dict(zip(names, t.tolist(), strict=True)) for t in np.log(0.98 * total / total.sum(axis=0)).T]
        shared.unpersist()
    return tables


def _words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII alone: A-Z, and white space 9 to 13 and 32."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def classes_of(docs: DataFrame, trained) -> list[str]:
    """The labels of the training documents, commonest first, at most CLASSES; others and null form one more class."""
    got = docs.filter(trained & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES)
    return [r["lang"] for r in got.collect()]


def count_words(docs: DataFrame, modulus: int, labels: list[str]) -> DataFrame:
    """word, all, c0 ... cK: occurrences in all of docs(doc_id, text, lang), and in the training documents of each class."""
    K = len(labels) + 1
    index = {x: i for i, x in enumerate(labels)}
    names = ["word", "all", *(f"c{k}" for k in range(K))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            words = list(every)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([every[w] for w in words], pa.int64()), *(pa.array([t.get(w, 0) for w in words], pa.int64()) for t in train)], names=names)

        train, every = [Counter() for _ in range(K)], Counter()
        for b in batches:
            for doc_id, text, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = _words(text)
                every.update(w)
                if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus:
                    train[index.get(lang, K - 1)].update(w)
                if len(every) > 250_000:
                    yield out()
                    train, every = [Counter() for _ in range(K)], Counter()
        yield out()

    got = docs.select("doc_id", "text", "lang").mapInArrow(common.tidied(run), "word string, " + ", ".join(f"`{x}` long" for x in names[1:]))
    return got.groupBy("word").agg(*[F.sum(x).alias(x) for x in names[1:]])


class Model:
    """Per class: discounted counts, backed off to those of all classes, backed off to the class's lattice."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray, n_all: int, v_all: int, discount: float, lattice: Lattice, docs: np.ndarray):
        self.n, self.all, self.d, self.lattice, self.docs = tokens, n_all, discount, lattice, docs
        self.free = np.where(tokens > 0, discount * kinds / np.maximum(tokens, 1), 1.0)
        self.free_all = discount * v_all / n_all if n_all else 1.0
        self.base_total = n_all + 0.1 * (v_all + 1)

    def best(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of words under each class; c: counts by class, spelled: log10 of the lattices."""
        total = np.maximum(c.sum(axis=1, keepdims=True) - self.d, 0) / max(1, self.all)
        own = np.maximum(c - self.d, 0) / np.maximum(self.n, 1)
        with np.errstate(divide="ignore"):
            counted = np.log10(own + self.free * total)
        loose = spelled + np.log10(self.free * self.free_all)
        top = np.maximum(counted, loose)
        return top + np.log1p(np.power(10.0, np.minimum(counted, loose) - top)) / LN10

    def words(self, words: list[str], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base and per-class log10 probabilities."""
        return np.log10((c.sum(axis=1) + 0.1) / self.base_total), self.best(c, self.lattice.log10(words))

    def end(self) -> tuple[float, np.ndarray]:
        """Base and per-class log10 probabilities of the end, which the lattice doesn't spell."""
        base, best = math.log10((self.docs.sum() + 0.1) / self.base_total), self.best(self.docs[None, :].astype(float), np.full((1, len(self.n)), -30.0))
        return base, best[0]


def score(docs: DataFrame, vocabulary_path: str, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, lang)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = common.crc_mod("doc_id", modulus) == 0
    labels = classes_of(docs, ~held)
    K = len(labels) + 1
    cs = [f"c{k}" for k in range(K)]
    trained = sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    counts = common.settle(count_words(docs, modulus, labels), "lm-words").withColumn("trained", trained)
    s = counts.agg(F.count_if(F.col("trained") > 0).alias("v"), F.count_if(F.col("trained") == 1).alias("once"), F.count_if(F.col("trained") == 2).alias("twice"), F.sum("all").alias("every"), *[F.sum(c).alias(c) for c in cs], *[F.count_if(F.col(c) > 0).alias(f"v{c}") for c in cs]).first()
    by_lang = docs.filter(~held).groupBy(F.when(F.col("lang").isin(*labels), F.col("lang")).alias("lang") if labels else F.lit(None).cast("string").alias("lang")).count().collect()
    ends = {r["lang"]: r["count"] for r in by_lang}
    ends = np.array([ends.get(x, 0) for x in [*labels, None]])
    tokens = np.array([s[c] or 0 for c in cs]) + ends
    kinds = np.array([s[f"v{c}"] or 0 for c in cs]) + (ends > 0)
    n, v = int(tokens.sum()), (s["v"] or 0) + int(ends.sum() > 0)
    discount = min(0.95, max(0.1, s["once"] / (s["once"] + 2 * s["twice"]))) if s["once"] else 0.5
    pieces = vocabulary(vocabulary_path)
    used = [k for k in range(K) if tokens[k]] or list(range(K))
    types = counts.select("word", *[(F.col(cs[k]) > 0).cast("long").alias(cs[k]) for k in used])
    lattices = fit(types, [cs[k] for k in used], pieces)
    made = Model(tokens[used], kinds[used], n, v, discount, Lattice(lattices, BYTE), ends[used])
    prior = np.log10((ends[used] + 0.5) / (ends[used] + 0.5).sum())
    model = spark.sparkContext.broadcast(made)
    J = len(used)
    bests = [f"b{j}" for j in range(J)]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches):
            c = np.stack([b.column(1 + k).to_numpy() for k in used], axis=1).astype(float)
            base, best = model.value.words(b.column(0).to_pylist(), c)
            yield pa.RecordBatch.from_arrays([b.column(0).chunk(0), pa.array(c.sum(axis=1) > 0), pa.array(base), *(pa.array(np.ascontiguousarray(best[:, j])) for j in range(J))], names=["word", "known", "base", *bests])

    least = max(2, math.ceil((s["every"] or 0) / HOT))
    names = "word string, known boolean, base double, " + ", ".join(f"{x} double" for x in bests)
    hot = {r["word"].encode(): (float(r["known"]), r["base"], *(r[x] for x in bests)) for r in counts.filter(F.col("all") >= least).select("word", *cs).mapInArrow(common.tidied(rate), names).toLocalIterator()}
    table = np.array(list(hot.values()), float).reshape(-1, 2 + J)
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(hot)}, table))
    cold = counts.filter(F.col("all") < least).select("word", *cs).mapInArrow(common.tidied(rate), names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = shared.value
        get, none = index.get, np.zeros(2 + J)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), *[pa.float64()] * (1 + J)]
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, rows = b.slice(k, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw, words = (text or "").encode("utf-8", "surrogatepass"), _words(text)
                    h = int.from_bytes(zlib.crc32(raw).to_bytes(4, "little") + zlib.adler32(raw).to_bytes(4, "little"), "little", signed=True)
                    at, loose = list(map(get, words)), {}
                    if None in at:
                        loose = Counter(w for w, i in zip(words, at, strict=True) if i is None)
                        at = [i for i in at if i is not None]
                    sums = values[at].sum(axis=0) if at else none
                    rows.append((doc_id, h, list(loose), list(loose.values()), len(words) + 1, int(sums[0]), *sums[1:]))
                cols = list(zip(*rows, strict=True)) or [()] * (7 + J)
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                arrays[2] = arrays[2].cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "words", "times", "n_tokens", "n_known", "base", *bests])

    # A document's other words lie beside its sums, so they are written once, without an id for each.
    parts = common.settle(docs.select("doc_id", "text").mapInArrow(common.tidied(split), "doc_id long, h long, words array<string>, times array<int>, n_tokens long, n_known long, base double, " + ", ".join(f"{x} double" for x in bests)), "lm-parts")
    sums = parts.select("doc_id", "h", F.lit(1).alias("copies"), "n_tokens", "n_known", "base", *bests)
    joined = parts.select("doc_id", "h", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", "h", F.col("x.words").alias("word"), F.col("x.times").alias("n")).join(cold, "word")
    rest = joined.select("doc_id", "h", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("known"), F.col("n").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_known"), *[(F.col("n") * F.col(x)).alias(x) for x in ("base", *bests)])
    got = sums.unionByName(rest).groupBy("doc_id", "h").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "base", *bests)])
    end_base, end_best = made.end()
    one = lambda c: F.col(c) / F.col("copies")
    # The marginal over the classes, in log space.
    each = [one(x) + float(end_best[j] + prior[j]) for j, x in enumerate(bests)]
    got = got.withColumn("top", F.greatest(*each) if J > 1 else each[0])
    total = sum((F.pow(F.lit(10.0), e - F.col("top")) for e in each[1:]), F.pow(F.lit(10.0), each[0] - F.col("top")))
    got = got.select("doc_id", held.alias("held_out"), one("n_tokens").cast("long").alias("n_tokens"), (one("n_known") + int(ends.sum() > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (one("base") + end_base).alias("base_score"), (F.col("top") + F.log10(total)).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return got.drop("_copy")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
