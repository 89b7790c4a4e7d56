"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first bytes, so inflected forms share
weight. Filters of several widths run over the whole text and are max-pooled. The embeddings start from the
log-odds of each hashed feature in the training sample and are then trained with the filters and the output layer
by Adagrad. A threshold per language, the language being told from the text's function words, is calibrated on
labelled rows that training has not seen; scores are rescaled so that each language's threshold lies at 0.5.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import U64, bucket_of_doc, hash_slices, mix, spans_of, text_bytes, words_of

#: Function words that tell the language: fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with as at be this from or by",
    "fr": "le la les de des et en un une que qui est dans pour pas sur par plus au aux",
    "de": "der die das und in zu den mit von ist nicht ein eine auf für sich im dem auch es",
    "es": "el la los las de que y en un una por con no se para su del al es lo",
}
PREFIXES = (3, 4, 5)
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS)


def language_codes() -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, bit mask of the languages each is a function word of)."""
    words: dict[bytes, int] = {}
    for k, x in enumerate(FUNCTION_WORDS.values()):
        for w in x.split():
            words[w.encode()] = words.get(w.encode(), 0) | 1 << k
    raw, lengths = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    h = hash_slices(raw, np.cumsum(lengths) - lengths, np.cumsum(lengths))
    order = np.argsort(h)
    return h[order], np.array(list(words.values()))[order]


@dataclass
class Words:
    """Texts as indices into the distinct words of a chunk: features of each, words per text, language of each text."""

    features: np.ndarray  # distinct words x (1 + prefixes), hashed
    index: np.ndarray
    counts: np.ndarray
    language: np.ndarray


def read_words(a: np.ndarray, offsets: np.ndarray, buckets: int) -> Words:
    a, starts, ends, counts = words_of(a, offsets)
    # marks around a word are no part of it
    plain = ~(((a >= 33) & (a <= 47)) | ((a >= 58) & (a <= 64)) | ((a >= 91) & (a <= 96)) | ((a >= 123) & (a <= 126)))
    before = np.concatenate([[0], np.cumsum(plain)])
    keep = np.flatnonzero(plain)
    n_plain = before[ends] - before[starts]
    some = n_plain > 0
    if some.any():
        starts, ends = starts.copy(), ends.copy()
        starts[some] = keep[before[starts[some]]]
        ends[some] = keep[before[ends[some]] - 1] + 1
    h = hash_slices(a, starts, ends)
    unique, at, index = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(at)  # ascending slices, as the hashing wants them
    s, e = starts[at[order]], ends[at[order]]
    features = np.empty((len(unique), 1 + len(PREFIXES)), np.int32)
    features[:, 0] = unique & U64(buckets - 1)
    for k, n in enumerate(PREFIXES):
        features[order, k + 1] = mix(hash_slices(a, s, np.minimum(e, s + n)) + U64(n)) & U64(buckets - 1)
    known, masks = language_codes()
    place = np.minimum(np.searchsorted(known, unique), len(known) - 1)
    mask = np.where(known[place] == unique, masks[place], 0)[index]
    votes = np.zeros((len(counts), len(FUNCTION_WORDS)))
    has = counts > 0
    if has.any():
        first = (np.cumsum(counts) - counts)[has]
        for k in range(len(FUNCTION_WORDS)):
            votes[has, k] = np.add.reduceat(((mask >> k) & 1).astype(np.int64), first)
    return Words(features, index.astype(np.int32), counts, votes.argmax(1))


@dataclass
class Net:
    embed: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # per width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    @classmethod
    def fresh(cls, buckets: int, dim: int, filters: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        f = [(rng.standard_normal((w, dim, filters)) * 0.3 / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        for x in f:
            x[0, 0] = np.abs(x[0, 0]) + 0.5  # the first dimension starts as log-odds
        return cls(np.zeros((buckets, dim), np.float32), f, [np.zeros(filters, np.float32) for _ in WIDTHS], np.full(filters * len(WIDTHS), 0.3, np.float32), -1.0, np.full(len(FUNCTION_WORDS), 0.5))

    def pooled(self, words: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """(max-pooled filter outputs, outputs per position and width, padded word index, first position of each text).

        Each text is followed by PAD empty words, so that even an empty text has a position; windows that start
        further than one empty word behind a text would reach into the next one and don't count.
        """
        n = len(words.counts)
        vectors = np.vstack([self.embed[words.features].sum(1), np.zeros((1, self.embed.shape[1]), np.float32)])
        none = len(vectors) - 1
        sizes = words.counts + PAD
        first = np.cumsum(sizes) - sizes
        index = np.full(int(sizes.sum()) + PAD, none, np.int64)
        own = np.arange(len(words.index)) + np.repeat(np.arange(n) * PAD, words.counts)
        index[own] = words.index
        total = int(sizes.sum())
        outs, pools = [], []
        for f, b in zip(self.filters, self.bias, strict=True):
            y = np.take(vectors @ f[0], index[:total], axis=0)
            for k in range(1, len(f)):
                y += np.take(vectors @ f[k], index[k : total + k], axis=0)
            y += b
            for k in range(1, PAD):
                y[first + sizes - k] = -1e30
            outs.append(y)
            pools.append(np.maximum.reduceat(y, first, axis=0) if n else np.zeros((0, f.shape[2]), np.float32))
        return np.maximum(np.hstack(pools), 0), outs, index, first

    def logit(self, words: Words) -> np.ndarray:
        return self.pooled(words)[0].astype(np.float64) @ self.out + self.out_bias

    def score(self, words: Words) -> np.ndarray:
        """0 to 1, each language's threshold at 0.5."""
        p = 1 / (1 + np.exp(-np.clip(self.logit(words), -40, 40)))
        t = self.thresholds[words.language]
        return np.where(p >= t, 0.5 + 0.5 * (p - t) / np.maximum(1 - t, 1e-9), 0.5 * p / np.maximum(t, 1e-9)).clip(0, 1)


def chunks(texts: list[bytes], rows: int):
    for i in range(0, len(texts), rows):
        part = texts[i : i + rows]
        yield slice(i, i + len(part)), np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, part)))]).astype(np.int64)


def gradients(net: Net, words: Words, pooled: tuple, g: np.ndarray) -> tuple:
    """Gradients of a loss whose derivative by each text's logit is ``g``: output weights, output bias, filters, filter
    biases, the embedding rows that take part, and their gradients. ``pooled`` is the forward pass of the same texts."""
    top, outs, index, first = pooled
    dim = net.embed.shape[1]
    g_pool = g[:, None] * net.out[None, :] * (top > 0)
    vectors = np.vstack([net.embed[words.features].sum(1), np.zeros((1, dim), np.float32)])
    ends = np.append(first[1:], len(outs[0]))
    g_filters, g_bias, word_rows, word_grads = [], [], [], []
    for c, f in enumerate(net.filters):
        m = f.shape[2]
        own = g_pool[:, c * m : (c + 1) * m]
        best = np.stack([outs[c][s:e].argmax(0) + s for s, e in zip(first.tolist(), ends.tolist(), strict=True)])
        grad = np.zeros_like(f)
        for j in range(len(f)):
            at = index[best + j]
            grad[j] = np.einsum("nmd,nm->dm", vectors[at], own)
            word_rows.append(at.ravel())
            word_grads.append((own[:, :, None] * f[j].T[None]).reshape(-1, dim))
        g_filters.append(grad)
        g_bias.append(own.sum(0))
    rows, grads = np.concatenate(word_rows), np.concatenate(word_grads)
    real = rows < len(words.features)
    touched, inverse = np.unique(words.features[rows[real]], return_inverse=True)
    inverse = inverse.reshape(-1, words.features.shape[1])
    total = np.zeros((len(touched), dim), np.float32)
    for j in range(inverse.shape[1]):
        np.add.at(total, inverse[:, j], grads[real])
    return top.T @ g, float(g.sum()), g_filters, g_bias, touched, total


def train(texts: list[bytes], y: np.ndarray, hold: np.ndarray, buckets: int = 1 << 18, dim: int = 8, filters: int = 8, epochs: int = 5, batch: int = 192, rate: float = 0.15, seed: int = 9) -> Net:
    """Fit on the rows that ``hold`` leaves, then calibrate the thresholds on those it marks."""
    net = Net.fresh(buckets, dim, filters, seed)
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.flatnonzero(~hold))
    if not len(order) or len(np.unique(y[order])) < 2:
        net.embed[:] = 0
        net.out[:] = 0
        net.out_bias = -3.0 if not len(order) or not y[order].any() else 3.0
        return net
    seen = np.zeros((2, buckets))
    batches = []
    for rows, a, offsets in chunks([texts[k] for k in order], batch):
        w = read_words(a, offsets, buckets)
        target = y[order[rows]]
        owner = np.repeat(np.arange(len(target)), w.counts)
        pair = np.unique(owner * np.int64(len(w.features)) + w.index) if len(owner) else np.zeros(0, np.int64)
        doc, word = pair // max(1, len(w.features)), pair % max(1, len(w.features))
        for k in range(w.features.shape[1]):
            both = np.unique(doc * np.int64(buckets) + w.features[word, k])
            seen += np.stack([np.bincount((both % buckets)[target[both // buckets] == c], minlength=buckets) for c in (0, 1)])
        batches.append((w, target))
    n0, n1 = (y[order] == 0).sum(), (y[order] == 1).sum()
    odds = np.log((seen[1] + 0.3) / (n1 + 0.6)) - np.log((seen[0] + 0.3) / (n0 + 0.6))
    net.embed[:, 0] = np.clip(odds, -4, 6) * np.where(seen.sum(0) >= 3, 1, 0) / 4
    net.embed[:, 1:] = np.random.default_rng(seed + 1).standard_normal((buckets, dim - 1)) * 0.02 * (seen.sum(0) >= 3)[:, None]
    weight = np.array([0.5 / n0, 0.5 / n1]) * len(order)
    squares = {"out": np.full_like(net.out, 1e-3), "bias": 1e-3, "f": [np.full_like(f, 1e-3) for f in net.filters], "b": [np.full_like(b, 1e-3) for b in net.bias], "e": np.full(buckets, 1e-2)}
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            w, target = batches[k]
            pooled = net.pooled(w)
            p = 1 / (1 + np.exp(-np.clip(pooled[0] @ net.out + net.out_bias, -30, 30)))
            g = ((p - target) * weight[target] / len(target)).astype(np.float32)
            g_out, g_bias, g_filters, g_filter_bias, touched, g_embed = gradients(net, w, pooled, g)
            g_out = g_out + 1e-4 * net.out
            for c, f in enumerate(net.filters):
                squares["f"][c] += g_filters[c] ** 2
                f -= rate * g_filters[c] / np.sqrt(squares["f"][c])
                squares["b"][c] += g_filter_bias[c] ** 2
                net.bias[c] -= rate * g_filter_bias[c] / np.sqrt(squares["b"][c])
            squares["e"][touched] += (g_embed**2).mean(1)
            net.embed[touched] -= 0.3 * rate * g_embed / np.sqrt(squares["e"][touched])[:, None].astype(np.float32)
            squares["out"] += g_out**2
            net.out -= (rate * g_out / np.sqrt(squares["out"])).astype(np.float32)
            squares["bias"] += g_bias**2
            net.out_bias -= rate * g_bias / np.sqrt(squares["bias"])
    calibrate(net, [texts[k] for k in np.flatnonzero(hold)], y[hold], buckets)
    return net


def calibrate(net: Net, texts: list[bytes], y: np.ndarray, buckets: int, least: int = 20) -> None:
    """The threshold per language with the fewest errors, halfway between the scores it parts; a language with
    fewer than ``least`` rows takes the threshold over all languages."""
    logits, languages = [], []
    for _, a, offsets in chunks(texts, 256):
        w = read_words(a, offsets, buckets)
        logits.append(net.logit(w))
        languages.append(w.language)
    if not logits:
        return
    z, language = np.concatenate(logits), np.concatenate(languages)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
        cut = np.flatnonzero(errors == errors.min())
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        gaps = edges[cut + 1] - edges[cut]
        k = cut[gaps.argmax()]
        return float((edges[k] + edges[k + 1]) / 2)

    both = best(z, y)
    for k in range(len(net.thresholds)):
        own = language == k
        t = best(z[own], y[own]) if own.sum() >= least and len(np.unique(y[own])) == 2 else both
        net.thresholds[k] = 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, target: str, per_class: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class, chosen by a hash of the id: text, y, hold.

    Only ids (at most twice ``per_class``) are broadcast to the scan of the texts. An id counts once, with its least
    text; texts of more than ``longest`` characters aren't trained on, so the sample has a bound in bytes too.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(id_col).agg(F.max(target).alias("y")).where(bucket_of_doc(id_col) != 0)
    picks = [known.where(F.col("y") == c).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for c in (0, 1)]
    ids = F.broadcast(picks[0].unionByName(picks[1]).select(F.col(id_col).alias("_id"), "y"))
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_doc"), text.alias("text")).where(F.length("text") <= longest).join(ids, F.col("_doc") == F.col("_id"))
    once = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y"))
    return once.select("text", "y", (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(4)) == 0).alias("hold"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 4000, longest: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """Train in one task on the bounded sample: ``per_class`` rows of each class, of ``longest`` characters, at most."""

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip((x.encode() for x in batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        rows.sort()  # the same network whatever order the rows come in
        net = train([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    got = sample_of(docs, labels, target, per_class, longest, id_col, text_col).repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(got[0]) if got else train([], np.zeros(0, np.int64), np.zeros(0, bool))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000) -> DataFrame:
    """id, held_out, score, language (told from the text) of every document.

    A null or empty text is scored as one without words; a null id counts as held out; repeated rows get equal
    scores; a label that repeats counts once, as toxic if it is so anywhere; without labelled rows of both classes
    every score is the same. Neither labels, lang, source nor the id enters a score; other columns are not read.
    """
    net = fit(docs, labels, target, per_class, id_col=id_col, text_col=text_col)
    shared = spark.sparkContext.broadcast(net)
    names = np.array(list(FUNCTION_WORDS))

    def run(batches):
        model = shared.value
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, 1 << 19):
                w = read_words(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(model.embed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(w)), pa.array(names[w.language].tolist())], names=["id", "score", "language"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, language string").withColumnRenamed("id", id_col)
    return scored.select(id_col, (bucket_of_doc(id_col) == 0).alias("held_out"), "score", "language")


def clean_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; scored where they lie, without a join.

    Only the texts go to the workers. A null or empty text is scored as one without words, a row without an id like
    any other; no rows give no rows.
    """
    shared = spark.sparkContext.broadcast(fit(docs, labels, target, per_class, id_col=id_col, text_col=text_col))

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        model, kept = shared.value, []
        a, offsets = text_bytes(texts)
        for i, j in spans_of(offsets, 1 << 19):
            kept.append(model.score(read_words(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(model.embed))) < threshold)
        return pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    return docs.where(clean(F.col(f"`{text_col}`")))
