"""Language identification by interpolated Kneser-Ney character models.

One model of ORDER characters a language, over words (runs of letters) between marks of beginning and end. Counts lie in sorted arrays of
64-bit hashes, one array an order with a column for each language, so one binary search serves all languages. A text has the language of
lowest cross-entropy per character. Cross-entropies and scores are calibrated on documents kept from the counts: a text
whose cross-entropy is beyond what its language's own documents ever come near is rejected.

The models are fitted on at most about SAMPLE labelled documents a language, drawn by a hash of the id; whole texts are used. Workers
remember the sums of words they have met.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; without any labelled document all texts are
`und`; equal texts get equal results; ties go to the first language by code point; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

ORDER, SAMPLE = 4, 500
REMEMBERED = 200_000
FIRST, LAST = 2, 3
#: Words are runs of letters: digits and signs tell nothing of a language.
_LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def _windows(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """hashes[k]: of the k characters that end at each position, from words in turn, for k up to order; the word of each position."""
    lengths = np.array([len(w) for w in words], np.int64) + 1
    pad = order - 1
    text = "".join(chr(FIRST) * pad + w + chr(LAST) for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths + pad) - lengths
    at = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    hashes, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = h + (code[at - k] + np.uint64(1)) * power
            power = power * _P
            hashes.append(h)
    return hashes, owner


class Models:
    """grams[k], contexts[k]: sorted hashes; the columns of their values are languages."""

    def __init__(self, langs: list[str], counts: list[tuple[list[str], np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.grams, self.contexts, self.seen, self.totals, self.types, self.discount = [], [], [], [], [], []
        per = []
        for words, n in counts:
            hashes, owner = _windows(words, order)
            per.append((hashes, n[owner].astype(float)))
        L = len(langs)
        chars = np.unique(np.concatenate([h[1] for h, _ in per])) if per else np.zeros(0, np.uint64)
        self.uniform = 1.0 / (len(chars) + 1)
        for k in range(1, order + 1):
            keys, cols = [], []
            for i, (hashes, n) in enumerate(per):
                if k == order:
                    gram, inverse = np.unique(hashes[k], return_inverse=True)
                    c = np.bincount(inverse, n)
                else:  # continuation counts: how many characters stand before
                    longer = np.unique(np.stack([hashes[k], hashes[k + 1]]), axis=1)
                    gram, c = np.unique(longer[0], return_counts=True)
                pairs, first = np.unique(hashes[k], return_index=True)
                # The context of a gram: the same window without its last character.
                with np.errstate(over="ignore"):
                    context = self._context(hashes, k)[first]
                keys.append((gram, context, c.astype(float)))
                cols.append(np.full(len(gram), i))
            gram = np.unique(np.concatenate([g for g, _, _ in keys]))
            context = np.unique(np.concatenate([x for _, x, _ in keys]))
            seen, totals, types = np.zeros((len(gram), L), np.float32), np.zeros((len(context), L), np.float64), np.zeros((len(context), L), np.float32)
            d = np.zeros(L)
            for i, (g, x, c) in enumerate(keys):
                seen[np.searchsorted(gram, g), i] = c
                at = np.searchsorted(context, x)
                totals[:, i] += np.bincount(at, c, len(context))
                types[:, i] += np.bincount(at, minlength=len(context))
                once, twice = (c == 1).sum(), (c == 2).sum()
                d[i] = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            self.grams.append(gram)
            self.contexts.append(context)
            self.seen.append(seen)
            self.totals.append(totals.astype(np.float32))
            self.types.append(types)
            self.discount.append(d.astype(np.float32))

    @staticmethod
    def _context(hashes: list[np.ndarray], k: int) -> np.ndarray:
        """Hashes of the k - 1 characters before the last: the window's sum less its last character's term."""
        return (hashes[k] - hashes[1]) if k > 1 else np.zeros_like(hashes[1])

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word and its end, for each language."""
        out = np.zeros((len(words), len(self.langs)), np.float64)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            hashes, owner = _windows(part, self.order)
            p = np.full((len(owner), len(self.langs)), self.uniform, np.float32)
            for k in range(1, self.order + 1):
                with np.errstate(over="ignore"):
                    x = self._context(hashes, k)
                at, known = self._find(self.contexts[k - 1], x)
                total, types = self.totals[k - 1][at], self.types[k - 1][at]
                total[~known] = 0
                g, here = self._find(self.grams[k - 1], hashes[k])
                c = self.seen[k - 1][g]
                c[~here] = 0
                d = self.discount[k - 1]
                some = np.maximum(total, 1e-9)
                p = np.where(total > 0, np.maximum(c - d, 0) / some + d * types / some * p, p)
            logs = np.log(p, dtype=np.float64)
            for j in range(len(self.langs)):
                out[i : i + len(part), j] = np.bincount(owner, logs[:, j], len(part))
        return out

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys


class Identifier:
    """Scores texts with models; remembers words."""

    def __init__(self, models: Models):
        self.models, self.known, self.sums = models, {}, np.zeros((1024, len(models.langs)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the characters counted."""
        cut = [_LETTERS.findall(t.lower()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        if new:
            need = len(known) + len(new)
            if need > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((need, self.sums.shape[1]))])
            self.sums[len(known) : need] = self.models.word_sums(new)
            for w in new:
                known[w] = len(known)
        out = np.zeros((len(texts), self.sums.shape[1]))
        n = np.zeros(len(texts))
        for i, words in enumerate(cut):
            if words:
                n[i] = sum(map(len, words)) + len(words)
                out[i] = -self.sums[list(map(known.__getitem__, words))].sum(axis=0) / n[i]
        return out, n


class Calibration:
    """Of one set of models: per language the entropy beyond which a text is rejected, and the scores' temperature."""

    def __init__(self, langs: list[str], held: list[tuple[str, str]], models: Models):
        e, n = Identifier(models).entropies([t for _, t in held]) if held else (np.zeros((0, len(langs))), np.zeros(0))
        truth = np.array([langs.index(x) for x, _ in held], int)
        # A language with few calibration documents takes those of all languages, each under its own model.
        pooled = e[np.arange(len(e)), truth][n >= 40]
        self.mean, self.spread = np.full(len(langs), np.inf), np.zeros(len(langs))
        for j in range(len(langs)):
            own = e[(truth == j) & (n >= 40), j]
            own = own if len(own) >= 5 else pooled
            if len(own):
                self.mean[j], self.spread[j] = own.mean(), max(own.std(), 0.02)
        best = (math.inf, 8.0)
        for t in (2.0, 4.0, 8.0, 16.0, 32.0):
            if len(e):
                z = -t * e
                z -= z.max(axis=1, keepdims=True)
                loss = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
                best = min(best, (loss, t))
        self.temperature = best[1]

    def beyond(self, j: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Eight deviations and half a nat above the mean, more for short texts, whose entropies vary more."""
        return entropy > self.mean[j] + 8 * self.spread[j] * np.sqrt(1 + 400 / np.maximum(n, 1)) + 0.5


def fit(docs: DataFrame, training: Column, sample: int = SAMPLE, order: int = ORDER) -> tuple[Models, Calibration] | None:
    """Models and calibration from docs(doc_id, text, lang) where training holds; a fifth of the sample calibrates."""
    labelled = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(rate, F.col("lang")))
    drawn = common.settle(drawn.select("lang", "text", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0).alias("held")), "language-sample")
    words = drawn.filter("NOT held").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    table = words.toArrow()
    langs = sorted(sizes)
    lang, w, n = (table.column(i).to_pylist() for i in range(3))
    by: dict[str, tuple[list, list]] = {x: ([], []) for x in langs}
    for a, b, c in zip(lang, w, n, strict=True):
        by[a][0].append(b)
        by[a][1].append(c)
    langs = [x for x in langs if by[x][0]]
    if not langs:
        return None
    models = Models(langs, [(by[x][0], np.array(by[x][1])) for x in langs], order)
    held = [(r["lang"], r["text"]) for r in drawn.filter("held").select("lang", "text").toLocalIterator() if r["lang"] in langs]
    return models, Calibration(langs, held, models)


_LIVE: dict[int, Identifier] = {}


def identify(docs: DataFrame, training: Column, keep: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """The columns keep of docs(doc_id, text, lang), with lang_pred, score, rejected."""
    fitted = fit(docs, training, sample)
    common.give_back()
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        if got:
            if id(got) not in _LIVE:
                _LIVE.clear()
                _LIVE[id(got)] = Identifier(got[0])
            models, calibration, live = *got, _LIVE[id(got)]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                texts = [t or "" for t in s.column(0).to_pylist()]
                lettered = np.array([any(map(str.isalpha, t)) for t in texts])
                pred, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if got:
                    e, n = live.entropies(texts)
                    j = e.argmin(axis=1)
                    z = np.exp(-calibration.temperature * (e - e.min(axis=1, keepdims=True)))
                    score = np.where(lettered, 1 / z.sum(axis=1), 0.0)
                    rejected = ~lettered | calibration.beyond(j, e[np.arange(len(e)), j], n)
                    pred = [models.langs[k] if ok else "und" for k, ok in zip(j, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([*s.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*s.schema.names[1:], "lang_pred", "score", "rejected"])

    # The text goes first; if it is to be kept, a second time under its own name.
    rows = docs.select(F.col("text").alias("_text"), *keep)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(common.tidied(run), f"{names}{', ' if names else ''}lang_pred string, score double, rejected boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = common.crc_mod("doc_id", 4) == 2
    out = identify(docs, ~held, keep=("doc_id",))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
