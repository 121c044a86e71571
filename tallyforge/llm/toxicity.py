"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded as the sum of two hashed embeddings: of the word and of its first four letters (inflected and joined words share the latter). Filters of widths 1, 2 and 3 run over the words, each is pooled by its maximum over the whole text, and a logistic layer scores what is left. Training takes Adam steps over minibatches of whole texts; the gradient of a maximum reaches one place for each filter and text. As hashing, embedding and convolution are linear up to the pooling, each bucket is projected onto all filters once, and scoring a text is gathering and adding rows for its words; a worker keeps nothing but these projections.

The classifier is fitted on at most SAMPLE labelled rows of each class, in hash order, and of these on at most SAMPLE_BYTES of whole texts (documented bounds, applied before anything reaches the driver; a text that would pass the second is left out, whichever its class); rows beyond the bounds count by weight. Decision thresholds are calibrated by language on all labelled rows outside the held-out fifth, each scored by a model that was fitted without its text (the rows are dealt into FOLDS folds by their texts): a language is never an input of the score, only of the threshold that an accept-or-reject decision uses.

Defined cases: a null text counts as empty, and an empty text has the score of no word at all; texts are scored whole; labels that are null are left out; a doc_id that is labelled twice alike, or that several rows have, is fitted once (by the least of its texts), while thresholds count each such row; with no labelled rows of both classes every score is the share of positive labels (0 for none); repeated rows are scored alike; other columns pass through, except those named as a result column, which the result replaces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_texts, stage
from .decontaminate import LOWERED, words_of

#: Labelled rows of each class that training takes at most, and bytes of their texts in all.
SAMPLE, SAMPLE_BYTES = 1500, 24 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 14, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.012, 2e-5
#: Text that is scored at once (or a longer text); and its words, laid out for the filters.
CHUNK_BYTES, WORDS_AT_ONCE = 4 << 20, 60_000
#: Folds of the calibration; thresholds to choose from; and toxic rows that a language needs for one of its own.
FOLDS, GRID, LEAST_TOXIC = 3, np.round(np.arange(0.2, 0.81, 0.05), 2), 10
#: Most labelled rows whose doc_ids are broadcast to score only their documents; beyond that all are scored, and only their doc_ids and scores are shuffled.
BROADCAST_IDS = 1_000_000


def features(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its first four characters."""
    return zlib.crc32(word) % BUCKETS, BUCKETS + zlib.crc32(b"^" + word.decode("utf-8", "replace")[:4].encode()) % BUCKETS


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def projected(self, words: pa.Array) -> list[np.ndarray]:
        """What each of some distinct words adds to the filters, for each width and offset; the first row is no word."""
        if self._table is None:
            self._table = np.concatenate([self.embed @ w[o * DIM : (o + 1) * DIM] for w in self.filters for o in range(len(w) // DIM)], axis=1).astype(np.float32)
        heads = pc.utf8_slice_codeunits(words, 0, 4).dictionary_encode()
        head = np.array([BUCKETS + zlib.crc32(b"^" + w) % BUCKETS for w in heads.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
        rows = np.zeros((len(words) + 1, self._table.shape[1]), np.float32)
        if len(words):
            rows[1:] = self._table[bucket] + self._table[head[heads.indices.to_numpy()]]
        return [np.ascontiguousarray(rows[:, k : k + FILTERS]) for k in range(0, rows.shape[1], FILTERS)]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        raw = [t.encode() for t in texts]
        at = 0
        while at < len(raw):
            to, n = at + 1, len(raw[at])
            while to < len(raw) and n + len(raw[to]) <= CHUNK_BYTES:
                n += len(raw[to])
                to += 1
            out[at:to] = self._chunk(raw[at:to])
            at = to
        return out

    def _chunk(self, raw: list[bytes]) -> np.ndarray:
        lists = pc.ascii_split_whitespace(pa.array([t.translate(LOWERED) for t in raw], pa.large_string()))
        found = lists.flatten()
        real = pc.binary_length(found).to_numpy() > 0  # white space at an end makes empty words
        cuts = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy()].tolist()
        coded = found.filter(pa.array(real)).dictionary_encode()
        ids, table = coded.indices.to_numpy() + 1, self.projected(coded.dictionary)
        out = np.empty(len(raw))
        at = 0
        while at < len(raw):  # so many texts at once that the gathered rows stay small
            to = at + 1
            while to < len(raw) and cuts[to + 1] - cuts[at] < WORDS_AT_ONCE:
                to += 1
            out[at:to] = self._score([ids[a:b] for a, b in zip(cuts[at:to], cuts[at + 1 : to + 1])], table)
            at = to
        return out

    def _score(self, ids: list[np.ndarray], table: list[np.ndarray], part: int = WORDS_AT_ONCE) -> np.ndarray:
        if len(ids) == 1 and len(ids[0]) > part:  # a very long text: its parts overlap by what a filter spans
            x = ids[0]
            pooled = np.max([pool([x[k : k + part + WIDTHS[-1] - 1]], table) for k in range(0, len(x), part)], axis=0)
        else:
            pooled = pool(ids, table)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pool(ids: list[np.ndarray], table: list[np.ndarray]) -> np.ndarray:
    """The maximum of each filter over each text (words as rows of the table)."""
    flat, first, last = laid_out(ids)
    ends = np.stack([first, last], 1).ravel()
    pieces, column = [], 0
    for w in WIDTHS:
        sums = table[column].take(flat, axis=0)
        for o in range(1, w):
            sums[: len(flat) - o] += table[column + o].take(flat[o:], axis=0)
        column += w
        pieces.append(np.maximum.reduceat(sums, ends)[::2])
    return np.concatenate(pieces, axis=1)


def laid_out(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other with stops (0) between them, so that no filter goes over an end; first and last + 1 place where a filter may start."""
    stops = WIDTHS[-1]
    size = np.array([max(1, len(x)) for x in ids], np.int64)
    first = np.cumsum(size + stops) - size - stops
    flat = np.zeros(int((size + stops).sum()), np.int64)
    for at, x in zip(first.tolist(), ids):
        flat[at : at + len(x)] = x
    return flat, first, first + size


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """A model trained on whole texts. weight: what each row counts."""
    rng = np.random.default_rng(seed)
    total = sum(WIDTHS)
    if not len(texts) or toxic.min() == toxic.max():
        share = float((toxic * weight).sum() / weight.sum()) if len(texts) else 0.0
        return Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0), 0.0, constant=share)
    p = {
        "embed": rng.normal(0, 0.1, (2 * BUCKETS + 1, DIM)),
        "filters": rng.normal(0, 0.3, (total * DIM, FILTERS)),
        "bias": np.zeros(len(WIDTHS) * FILTERS),
        "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
        "out_bias": np.array([np.log((toxic * weight).sum() / ((1 - toxic) * weight).sum())]),
    }
    none = 2 * BUCKETS
    known: dict[bytes, tuple[int, int]] = {}
    ids = []
    for t in texts:
        ws = words_of(t)
        known.update((w, features(w)) for w in set(ws).difference(known))
        ids.append(np.array([known[w] for w in ws], np.int64).reshape(-1, 2))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    weight = weight / weight.mean()
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            flat, first, last = laid_out([np.arange(len(ids[r])) + 1 for r in rows])
            feats = np.full((len(flat), 2), none)
            for at, r in zip(first.tolist(), rows):
                feats[at : at + len(ids[r])] = ids[r]
            e = p["embed"][feats[:, 0]] + p["embed"][feats[:, 1]]
            pooled, where, row = [], [], 0
            for w in WIDTHS:
                sums = e @ p["filters"][row * DIM : (row + 1) * DIM]
                for o in range(1, w):
                    sums[: len(flat) - o] += e[o:] @ p["filters"][(row + o) * DIM : (row + o + 1) * DIM]
                row += w
                at = np.stack([a + sums[a:b].argmax(0) for a, b in zip(first, last)])
                where.append(at)
                pooled.append(np.take_along_axis(sums, at, 0))
            raw = np.concatenate(pooled, 1) + p["bias"]
            keep = rng.random(raw.shape) > 0.2  # dropout
            h = np.maximum(raw, 0) * keep / 0.8
            prob = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_bias"], -30, 30)))
            d = (prob - toxic[rows]) * weight[rows] / len(rows)
            g = {"out": h.T @ d, "out_bias": np.array([d.sum()]), "filters": np.zeros_like(p["filters"])}
            dh = d[:, None] * p["out"] * (raw > 0) * keep / 0.8
            g["bias"] = dh.sum(0)
            de: dict[int, np.ndarray] = {}
            touched, grads, row = [], [], 0
            for j, w in enumerate(WIDTHS):
                dj, at = dh[:, j * FILTERS : (j + 1) * FILTERS], where[j]
                for o in range(w):
                    rows_at = at + o
                    g["filters"][(row + o) * DIM : (row + o + 1) * DIM] = np.einsum("bfd,bf->df", e[rows_at], dj)
                    touched.append(rows_at.ravel())
                    grads.append((dj[:, :, None] * p["filters"][(row + o) * DIM : (row + o + 1) * DIM].T[None]).reshape(-1, DIM))
                row += w
            places, grad = np.concatenate(touched), np.concatenate(grads)
            f = feats[places]
            used, back = np.unique(f.ravel(), return_inverse=True)
            ge = np.zeros((len(used), DIM))
            np.add.at(ge, back, np.repeat(grad, 2, axis=0))
            ge[used == none] = 0
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for name in ("filters", "bias", "out", "out_bias"):
                gr = g[name] + DECAY * p[name]
                m[name] = 0.9 * m[name] + 0.1 * gr
                v[name] = 0.999 * v[name] + 0.001 * gr * gr
                p[name] -= rate * (m[name] / c1) / (np.sqrt(v[name] / c2) + 1e-8)
            m["embed"][used] = 0.9 * m["embed"][used] + 0.1 * ge
            v["embed"][used] = 0.99 * v["embed"][used] + 0.01 * ge * ge
            p["embed"][used] -= rate * m["embed"][used] / (np.sqrt(v["embed"][used]) + 1e-7)
    row, filters = 0, []
    for w in WIDTHS:
        filters.append(p["filters"][row * DIM : (row + w) * DIM])
        row += w
    return Model(p["embed"], filters, p["bias"], p["out"], float(p["out_bias"][0]))


def best_threshold(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of GRID with the best F1; the nearest to 0.5 of equally good ones. clean, toxic: the rows of each class by how many thresholds their scores reach."""
    above = lambda n: n[::-1].cumsum()[::-1][1:]
    both = above(toxic)
    f1 = 2 * both / np.maximum(1, both + above(clean) + toxic.sum())
    return float(max(zip(GRID, f1), key=lambda x: (round(x[1], 6), -abs(x[0] - 0.5)))[0])


def fold_of(text: str) -> int:
    """The fold of a text; its copies share it."""
    return zlib.crc32(text.encode()) % FOLDS


def score_counts(docs: DataFrame, ours: DataFrame, n: int, parts: list[Model], text: str = "text") -> dict[str, np.ndarray]:
    """For each language with LEAST_TOXIC toxic rows: all labelled rows (n of ours: doc_id, _tf_toxic) by class and by how many thresholds of GRID their scores reach. A text is scored by the model of its fold."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def batch(texts: list[str]) -> dict[str, pa.Array]:
        fold = np.array([fold_of(t) for t in texts])
        score = np.zeros(len(texts))
        for k in range(FOLDS):
            at = np.flatnonzero(fold == k)
            if len(at):
                score[at] = shared.value[k].score([texts[i] for i in at])
        return {"_tf_bin": pa.array(np.searchsorted(GRID, score, "right"), pa.int32())}

    source = docs.withColumn("_tf_lang", F.col("lang").cast("string")).where("_tf_lang IS NOT NULL")
    if n <= BROADCAST_IDS:
        source = source.join(F.broadcast(ours.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = map_texts(source, batch, "_tf_bin int", text, ["doc_id", "_tf_lang"]).join(ours, "doc_id")
    counts = [F.count_if((F.col("_tf_toxic") == k) & (F.col("_tf_bin") == b)).alias(f"n{k}_{b}") for k in (0, 1) for b in range(len(GRID) + 1)]
    found = rows.groupBy("_tf_lang").agg(F.sum("_tf_toxic").alias("toxic"), *counts).where(F.col("toxic") >= LEAST_TOXIC).drop("toxic").collect()
    shared.destroy()
    return {r[0]: np.array(r[1:], np.int64).reshape(2, -1) for r in found}


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows outside the held-out fifth, with thresholds for the languages among them."""
    ours = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", (F.col(label) > 0).cast("int").alias("_tf_toxic"))
    counts = {r[0]: r[1] for r in ours.groupBy("_tf_toxic").count().collect()}
    sample = None
    for kind in (0, 1):
        part = ours.where(F.col("_tf_toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    joined = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_tf_text")).join(F.broadcast(sample.distinct()), "doc_id")  # 2 * SAMPLE rows at most
    joined = stage(joined.groupBy("doc_id", "_tf_toxic").agg(F.min("_tf_text").alias("_tf_text")), "labelled")
    sizes = sorted(joined.select("doc_id", "_tf_toxic", F.octet_length("_tf_text")).collect(), key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0], r[1]))  # a row for each of the sample
    left, wanted = SAMPLE_BYTES, []
    for doc, kind, size in sizes:
        if size <= left:
            left -= size
            wanted.append((doc, kind))
    taken = joined
    if len(wanted) < len(sizes):
        ids = docs.sparkSession.createDataFrame(wanted, joined.select("doc_id", "_tf_toxic").schema)
        taken = joined.join(F.broadcast(ids), ["doc_id", "_tf_toxic"], "left_semi")
    rows = sorted(taken.select("doc_id", "_tf_text", "_tf_toxic").collect(), key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0], r[2]))
    toxic = np.array([r[2] for r in rows], float)
    seen = {k: max(1, int((toxic == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 1) / seen[int(k)] for k in toxic])
    texts = [r[1] for r in rows]
    model = fit(texts, toxic, weight)
    if model.constant is None and "lang" in docs.columns:
        fold = np.array([fold_of(t) for t in texts])
        parts = [fit([t for t, f in zip(texts, fold) if f != k], toxic[fold != k], weight[fold != k]) for k in range(FOLDS)]
        for one, (clean, bad) in sorted(score_counts(docs, ours, sum(counts.values()), parts, text).items()):
            model.thresholds[one] = best_threshold(clean, bad)
    del rows, texts, joined, taken
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with toxicity (0 to 1), threshold (of the row's language, 0.5 for others) and toxic_rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("toxicity", "threshold", "toxic_rejected")]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = docs.withColumn("_tf_lang", lang.cast("string"))
    scored = map_texts(source, lambda texts: {"toxicity": pa.array(shared.value.score(texts), pa.float64())}, "toxicity double", text, [*columns, "_tf_lang"])
    threshold = F.lit(0.5)
    for name, t in model.thresholds.items():
        threshold = F.when(F.col("_tf_lang") == name, F.lit(t)).otherwise(threshold)
    return scored.select(*columns, "toxicity", threshold.alias("threshold"), (F.col("toxicity") >= threshold).alias("toxic_rejected"))
