"""Document quality by attention-based multiple-instance learning, in numpy.

A document is a bag of passages of `PASSAGE` words, all of them. Each passage is measured (shares of letters, capitals,
digits, marks and bars, lengths of words, words that repeat the one before, distinct words) and encoded by a tanh layer.
Gated attention, learned from document labels alone, weighs the passages; the weighted sum gives the score.

The sample is bounded: `per_class` documents of each label, by hash order, none held out.

Defined cases: null and empty texts are one empty passage. Ids without a label are scored like others. Rows with a null
doc_id are scored, not held out. Repeated rows give repeated rows. Without labels of both classes every score is
1, so nothing is rejected. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import FOLD, Words, held_out, plain, texts_in_chunks
from ctxloom.llm.learning import Adagrad, collected, sample_ids, sigmoid

PASSAGE, HIDDEN, GATE = 64, 16, 8
_B = np.arange(256)
#: Classes of bytes whose shares are measured.
CLASSES = [
    (_B >= 97) & (_B < 123), (_B >= 65) & (_B < 91), (_B >= 48) & (_B < 58), _B >= 128,
    np.isin(_B, list(b".,;:'\"-()")), np.isin(_B, list(b"!?")), np.isin(_B, list(b"#$%&*@^~=+<>_\\/{}[]`")), _B == 124,
]
WIDTH = len(CLASSES) + 8


def passages(column):
    """Arrow texts -> (row, passages x WIDTH) of each row."""
    for at, buf, offsets in texts_in_chunks(column):
        w = Words(buf, offsets)
        n = np.diff(w.first)
        per = np.maximum(-(-n // PASSAGE), 1)
        bag = np.concatenate([[0], np.cumsum(per)])
        out = np.zeros((bag[-1], WIDTH), dtype=np.float32)
        if len(w.start):
            inside = np.arange(len(w.start)) - w.first[w.doc]
            own = bag[w.doc] + inside // PASSAGE
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            which, size = own[begin], np.diff(np.append(begin, len(own)))
            sums = w.sums(FOLD)
            h = w.hashes(sums, w.start, w.end)
            long = (w.end - w.start).astype(np.float32)
            letters = np.maximum(np.add.reduceat(long, begin), 1)
            for k, mask in enumerate(CLASSES):
                c = np.concatenate([[0], np.cumsum(mask[buf], dtype=np.int32)])
                out[which, k] = np.add.reduceat((c[w.end] - c[w.start]).astype(np.float32), begin) / letters
            again = np.zeros(len(h), dtype=np.float32)
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            order = np.lexsort((h, own))
            new = np.ones(len(h), dtype=np.float32)
            new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
            marked = ~((buf[w.end - 1] >= 48) & (buf[w.end - 1] < 58) | (buf[w.end - 1] >= 65) & (buf[w.end - 1] < 91) | (buf[w.end - 1] >= 97) & (buf[w.end - 1] < 123) | (buf[w.end - 1] >= 128))
            base = len(CLASSES)
            out[which, base] = np.log1p(letters / size)
            out[which, base + 1] = np.add.reduceat(again, begin) / size
            out[which, base + 2] = np.add.reduceat(new, begin) / size
            out[which, base + 3] = np.add.reduceat(marked.astype(np.float32), begin) / size
            out[which, base + 4] = np.add.reduceat((long == 1).astype(np.float32), begin) / size
            out[which, base + 5] = np.log1p(np.maximum.reduceat(long, begin))
            out[which, base + 6] = size / PASSAGE
            out[which, base + 7] = np.log1p(n[w.doc[begin]])
        yield at, out, bag


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        out = [x[bag[i] : bag[i + 1]].tobytes() for _, x, bag in passages(batch.column("text")) for i in range(len(bag) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])


def forward(p: dict, x: np.ndarray, begin: np.ndarray):
    """x: passages of some bags one after another; begin: where each bag begins."""
    x = np.clip((x - p["mean"]) / p["dev"], -8, 8)
    h = np.tanh(x @ p["v"] + p["vb"])
    t, s = np.tanh(h @ p["t"]), sigmoid(h @ p["s"])
    a = (t * s) @ p["w"]
    bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
    e = np.exp(a - np.maximum.reduceat(a, begin)[bag])
    weight = e / np.add.reduceat(e, begin)[bag]
    z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
    return x, h, t, s, bag, weight, z, z @ p["u"] + p["c"][0]


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.05, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    p = {"mean": every.mean(axis=0), "dev": every.std(axis=0) + 1e-3, "v": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "vb": np.zeros(HIDDEN),
         "t": rng.normal(0, 0.3, (HIDDEN, GATE)), "s": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "u": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
    opt = Adagrad({k: v for k, v in p.items() if k not in ("mean", "dev")}, rate)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            begin = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]])
            x, h, t, s, bag, weight, z, logit = forward(p, np.concatenate([bags[i] for i in pick]), begin)
            g = (sigmoid(logit) - y[pick]) / len(pick)
            gz = g[:, None] * p["u"]
            gw = (h * gz[bag]).sum(axis=1)  # of the attention weights
            ga = weight * (gw - np.add.reduceat(weight * gw, begin)[bag])
            gt, gs = ga[:, None] * p["w"] * s * (1 - t * t), ga[:, None] * p["w"] * t * s * (1 - s)
            gh = weight[:, None] * gz[bag] + gt @ p["t"].T + gs @ p["s"].T
            gx = gh * (1 - h * h)
            for name, grad in (("u", z.T @ g), ("c", g.sum(keepdims=True)), ("w", (t * s).T @ ga), ("t", h.T @ gt), ("s", h.T @ gs), ("v", x.T @ gx), ("vb", gx.sum(axis=0))):
                opt.step(name, grad + (1e-4 * p[name] if name not in ("c", "vb") else 0))
    return p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> dict | None:
    ids = F.broadcast(sample_ids(labels, "quality", per_class))  # 2 * per_class rows at most
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")
    t = collected(rows.mapInArrow(_features, "doc_id long, y int, x binary"), 2 * per_class)
    y = t.column("y").to_numpy().astype(np.int64)
    if not len(y) or not y.any() or y.all():
        return None
    return train([np.frombuffer(b.as_buffer(), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64) for b in t.column("x")], y)


def _score(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            out = np.ones(batch.num_rows)
            if model is not None:
                for at, x, bag in passages(batch.column("text")):
                    out[at : at + len(bag) - 1] = sigmoid(forward(model, x.astype(np.float64), bag[:-1])[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict | None, cut: float = 0.5) -> DataFrame:
    """documents (doc_id, text) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _keep(shared, cut: float):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            if model is not None:
                for at, x, bag in passages(batch.column("text")):
                    good[at : at + len(bag) - 1] = sigmoid(forward(model, x.astype(np.float64), bag[:-1])[-1]) >= cut
            yield batch.filter(pa.array(good))

    return run


def keep(docs: DataFrame, model: dict | None, cut: float = 0.5) -> DataFrame:
    """documents -> the rows, with all their columns, that score cut or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, cut), docs.schema)
