"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 4, 6 and 8 bytes, so that inflected forms share
most of it. Filters of widths 1, 2 and 3 run over whole texts; each filter's maximum goes to a logistic layer. The first
dimension of the embeddings starts as the bucket's log odds in the training sample. Training moves the
filters, and of the embeddings what the maxima touch.

Filters learn from a bounded sample: `per_class` documents of each label, by hash order, none held out. Thresholds are
calibrated by language on all labelled rows that aren't held out; lang picks the threshold and is no input of the score.

Defined cases: null and empty texts get the score of a text of padding. Ids without a label are scored like others.
Rows with a null doc_id are scored, not held out. Repeated rows give repeated rows. Without labels of both
classes every score is 0. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import FOLD, MARKS, Words, drop, held_out, plain, stash, texts_in_chunks
from ctxloom.llm.learning import Adagrad, best_thresholds, collected, labelled, sample_ids, sigmoid

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 16, 8, (1, 2, 3), (4, 6, 8)
PAD = max(WIDTHS) - 1


def word_ids(column):
    """Arrow texts -> (row, words x 4 bucket numbers) of each row."""
    for at, buf, offsets in texts_in_chunks(column):
        w = Words(buf, offsets, MARKS)
        sums = w.sums(FOLD)
        ids = np.empty((len(w.start), 1 + len(PREFIXES)), dtype=np.uint16)
        ids[:, 0] = w.hashes(sums, w.start, w.end) >> np.uint64(48)
        for k, n in enumerate(PREFIXES):
            ids[:, k + 1] = (w.hashes(sums, w.start, np.minimum(w.end, w.start + n)) * np.uint64(2 * n + 1)) >> np.uint64(48)
        yield at, ids, w.first


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        out = [ids[first[i] : first[i + 1]].tobytes() for _, ids, first in word_ids(batch.column("text")) for i in range(len(first) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "lang", "y", "ids"])


def layout(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with PAD rows of zeros behind each: where each text begins, and the row of each word."""
    n = np.diff(first)
    begin = first[:-1] - first[0] + PAD * np.arange(len(n))
    return begin, np.arange(first[-1] - first[0]) + PAD * np.repeat(np.arange(len(n)), n)


def convolve(p: dict, ids: np.ndarray, first: np.ndarray):
    """-> word vectors with padding, where texts begin, and each filter at each place."""
    begin, rows = layout(first)
    x = np.zeros((len(rows) + PAD * (len(first) - 1) + PAD, DIM), dtype=np.float32)
    words = p["e"][ids[:, 0]]
    for k in range(1, ids.shape[1]):
        words += p["e"][ids[:, k]]
    x[rows] = words
    n = len(x) - PAD
    out = []
    for k in WIDTHS:
        z = np.broadcast_to(p[f"b{k}"], (n, FILTERS)).copy()
        for j in range(k):
            z += x[j : j + n] @ p[f"w{k}"][j * DIM : (j + 1) * DIM]
        out.append(z)
    return x, begin, out


def logits(p: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    _, begin, z = convolve(p, ids, first)
    top = np.concatenate([np.maximum.reduceat(a, begin, axis=0) for a in z], axis=1)
    return np.maximum(top, 0) @ p["u"] + p["c"][0]


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), "u": np.full(FILTERS * len(WIDTHS), 0.3, np.float32), "c": np.zeros(1, np.float32)}
    counts = np.zeros((2, BUCKETS), dtype=np.float64)
    for ids, label in zip(texts, y):
        counts[label, np.unique(ids)] += 1
    odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / (len(y) - y.sum() + 1))
    sure = 1 - 1 / np.sqrt(1 + counts.sum(axis=0))  # rare buckets say little
    p["e"][:, 0] = np.clip(odds * sure, -1, 4) / 4
    for k in WIDTHS:
        p[f"w{k}"] = rng.normal(0, 0.2, (k * DIM, FILTERS)).astype(np.float32)
        p[f"w{k}"][0 :: DIM, : FILTERS // 2] = 1.0 / k
        p[f"b{k}"] = np.full(FILTERS, -0.2, np.float32)
    opt = Adagrad(p, rate)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([texts[i] for i in pick])
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            x, begin, z = convolve(p, ids, first)
            stop = np.append(begin[1:], len(x) - PAD)
            where = [np.stack([a + part[a:b].argmax(axis=0) for a, b in zip(begin, stop)]) for part in z]
            top = np.concatenate([np.take_along_axis(part, w, axis=0) for part, w in zip(z, where)], axis=1)
            h = np.maximum(top, 0)
            g = ((sigmoid(h @ p["u"] + p["c"][0]) - y[pick]) / len(pick)).astype(np.float32)
            gh = g[:, None] * p["u"][None, :] * (top > 0)
            opt.step("u", h.T @ g + 1e-4 * p["u"])
            opt.step("c", g.sum(keepdims=True))
            back = np.zeros_like(x)
            for n, (k, w) in enumerate(zip(WIDTHS, where)):
                own = gh[:, n * FILTERS : (n + 1) * FILTERS]
                grad = np.zeros_like(p[f"w{k}"])
                for j in range(k):
                    seen = x[w + j]  # texts x filters x dim
                    part = slice(j * DIM, (j + 1) * DIM)
                    grad[part] = np.einsum("tf,tfd->df", own, seen)
                    np.add.at(back, (w + j).ravel(), (own[:, :, None] * p[f"w{k}"][part].T[None]).reshape(-1, DIM))
                opt.step(f"w{k}", grad)
                opt.step(f"b{k}", own.sum(axis=0))
            _, rows = layout(first)
            hit = np.flatnonzero(back[rows].any(axis=1))
            if len(hit):
                touched, slot = np.unique(ids[hit], return_inverse=True)
                total = np.zeros((len(touched), DIM), dtype=np.float32)
                np.add.at(total, slot.reshape(-1), np.repeat(back[rows[hit]], ids.shape[1], axis=0))
                opt.step("e", total, touched)
    return p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, prior: float | None = None) -> dict | None:
    """The trained filters, the shift of the logit to the labels' own mix, and thresholds by language."""
    ids = F.broadcast(sample_ids(labels, "toxic", per_class))  # 2 * per_class rows at most
    rows = plain(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "text", "lang").join(ids, "doc_id")
    t = collected(rows.mapInArrow(_features, "doc_id long, lang string, y int, ids binary"), 2 * per_class)
    y = t.column("y").to_numpy().astype(np.int64)
    if not len(y) or not y.any() or y.all():
        return None
    texts = [np.frombuffer(b.as_buffer(), dtype=np.uint16).reshape(-1, 1 + len(PREFIXES)) for b in t.column("ids")]
    model = train(texts, y)
    mix = labels.where(~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0] if prior is None else prior
    own = y.mean()
    model["shift"] = float(np.log(mix / (1 - mix)) - np.log(own / (1 - own)))
    # Thresholds come from all labelled rows that aren't held out, scored like any others.
    rows = stash(scored_labels(docs, labels, model), "scores")
    model["thresholds"] = {r["lang"]: r["threshold"] for r in best_thresholds(rows, 0.7).orderBy("lang").collect()}  # one a language
    drop(rows)
    return model


def scored_labels(docs: DataFrame, labels: DataFrame, model: dict) -> DataFrame:
    """(lang, score, y) of all labelled rows that aren't held out. Texts are scored where they lie; only scores meet the labels."""
    return _scores(docs, model).join(labelled(labels, "toxic"), "doc_id").select(F.coalesce("lang", F.lit("")).alias("lang"), "score", "y")


def _scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang, score) of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB
    return plain(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(_score(shared), "doc_id long, lang string, score double")


def _score(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model is not None:
                for at, ids, first in word_ids(batch.column("text")):
                    out[at : at + len(first) - 1] = sigmoid(logits(model, ids, first).astype(np.float64) + model["shift"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out)], names=["doc_id", "lang", "score"])

    return run


def score(docs: DataFrame, model: dict | None, cut: float = 0.7) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, held_out, score, predicted, threshold (of the language), flagged."""
    rows = _scores(docs, model)
    threshold = F.lit(cut)
    for lang, at in (model or {}).get("thresholds", {}).items():
        threshold = F.when(F.col("lang") == lang, F.lit(at)).otherwise(threshold)
    out = rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), threshold.alias("threshold"))
    return out.withColumn("flagged", F.col("score") >= F.col("threshold"))
