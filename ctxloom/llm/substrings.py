"""Removes passages that occur more than once, by relative Lempel-Ziv parsing.

A window is 35 consecutive words of one document. Of the 12-word grams in a window the one with the least hash is its
anchor, so windows of equal words have their anchors at the same place. All windows of one anchor are its phrase, and
the first occurrence of every anchor that occurs again is a phrase of the reference. The reference lies in blocks, dealt
by the anchor's hash, and every block is indexed by it. Documents are factored against the blocks: windows that equal the
reference's phrase continue the factor that leads to the same place of the same document, and the longest such
run is one factor. Where a phrase leaves the reference a factor ends; the windows at such a boundary are held
against all other boundary windows of their anchor, so a window that only two later documents share is found as well.

That is exact: a window that equals its anchor's reference phrase does so in every document, and one that doesn't is
a boundary window in every document. Windows are compared by 128 bits (the anchor's hash and their own).

Documents of equal words are one class, factored once; a class of several documents is a repeat as a whole. Anchors
that occur once (most) end after one count. Texts are read again for the classes that still have anchors alone, and
what is shuffled of them is eight bytes a window. Hot anchors meet one reference phrase each, in as many parts as
there are rows; nothing is gathered by anchor.

Defined cases: a null text has no words; documents under 35 words lose nothing; repeated rows are documents of their own,
so from 35 words on all of them are repeats as a whole, whatever their ids. Extra columns stay as they are. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import Words, checked, constants, drop, masked, mix, plain, powers, stash, texts_in_chunks

WINDOW, GRAM = 35, 12
#: Bytes of text that are worked on at once (more only where one text is longer).
CHUNK = 1 << 18
#: Every byte as it is: words are compared unchanged.
SAME = np.arange(256, dtype=np.uint8)
NOTHING = hashlib.sha256(b"").hexdigest()


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Where the first least value of each `width` neighbours is."""
    at, reach = np.arange(len(h)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        reach += step
    return at


def anchored(w: Words, window: int, gram: int):
    """-> the start of every whole window, its anchor's place, the hash of each gram, and of each such window. Places count words of the buffer."""
    h = w.hashes(w.sums(SAME), w.start, w.end)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none, none, h[:0], h[:0]
    coef, n = constants(gram, 707), len(h) - gram + 1
    g = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        g += h[k : k + n] * coef[k]
    g = mix(g)
    starts = np.flatnonzero(w.doc[: len(h) - window + 1] == w.doc[window - 1 :])
    anchor = least_of(g, window - gram + 1)[starts]
    up, down = powers(len(h) + 1)
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)) * up[: len(h)], out=s[1:])
    return starts, anchor, g, mix((s[starts + window] - s[starts]) * down[starts])


def whole_hash(text: bytes) -> bytes:
    """Of a text's words, joined by one space; bytes.split() parts at just the characters that part words here."""
    return hashlib.sha256(b" ".join(text.split())).digest()


def _keys(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


SIGNED = "doc_id long, tk long, n_words long, k1 long, k2 long, whole string, anchors array<long>"


def _sign(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, digests, sizes, values = [], [], [], []
            for _, buf, offsets in texts_in_chunks(batch.column("text"), CHUNK):
                w = Words(buf, offsets)
                starts, anchor, g, _ = anchored(w, window, gram)
                fresh = np.ones(len(anchor), dtype=bool)
                fresh[1:] = anchor[1:] != anchor[:-1]
                own = anchor[fresh]
                n.append(np.diff(w.first))
                sizes.append(np.bincount(w.doc[own], minlength=len(offsets) - 1))
                values.append(g[own].view(np.int64))
                data = buf.tobytes()
                digests += [whole_hash(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            if not digests:
                continue
            keys = np.array([_keys(d) for d in digests], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(np.concatenate(n).astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array([d.hex() for d in digests]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))],
                names=["doc_id", "tk", "n_words", "k1", "k2", "whole", "anchors"])

    return run


PHRASES = "g long, k1 long, k2 long, doc long, pos long, off int, hashes array<long>"


def _phrases(window: int, gram: int):
    """Texts with their repeated anchors -> a row for each occurrence of one: the hashes of its windows, the first of which starts `off` words before."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own, at = batch.column("own"), 0
            for _, buf, offsets in texts_in_chunks(batch.column("text"), CHUNK):
                w = Words(buf, offsets)
                starts, anchor, g, hashes = anchored(w, window, gram)
                data, rows = buf.tobytes(), []
                for i in range(len(offsets) - 1):
                    k1, k2 = batch.column("k1")[at + i].as_py(), batch.column("k2")[at + i].as_py()
                    if _keys(whole_hash(data[offsets[i] : offsets[i + 1]])) != (k1, k2):
                        continue  # another text of the same id and 64-bit hash
                    a, b = np.searchsorted(starts, [w.first[i], w.first[i + 1]])
                    if a < b:
                        wanted = np.isin(g[anchor[a:b]].view(np.int64), own[at + i].values.to_numpy(zero_copy_only=False))
                        rows.append((i, a + np.flatnonzero(wanted)))
                at += len(offsets) - 1
                if not rows:
                    continue
                take = np.concatenate([r for _, r in rows])
                if not len(take):
                    continue
                doc = np.concatenate([np.full(len(r), i) for i, r in rows])
                cut = np.flatnonzero(np.concatenate([[True], (anchor[take[1:]] != anchor[take[:-1]]) | (doc[1:] != doc[:-1])]))
                first, i = take[cut], doc[cut]
                back = at - (len(offsets) - 1)
                ends = np.concatenate([cut, [len(take)]]).astype(np.int32)
                pick = pa.array(back + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[anchor[first]].view(np.int64)), batch.column("k1").take(pick), batch.column("k2").take(pick), batch.column("doc_id").take(pick),
                     pa.array(anchor[first] - w.first[i]), pa.array((anchor[first] - starts[first]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[take].view(np.int64)))],
                    names=["g", "k1", "k2", "doc", "pos", "off", "hashes"])

    return run


#: One mark: the bits of `mask` are windows that start so many words before `pos`; ref_doc and ref_pos are where the reference has them, null where the document is the reference or a boundary was checked.
MARK = "struct<pos:bigint,mask:bigint,ref_doc:bigint,ref_pos:bigint,led:boolean>"


def marked(docs: DataFrame, signed: DataFrame, window: int, gram: int) -> DataFrame:
    """-> a stashed table (k1, k2, doc, tk, marks) of the classes that hold a window which occurs again."""
    long = signed.where("size(anchors) > 0")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk")
    classes = stash(long.groupBy("k1", "k2").agg(F.min(row).alias("rep"), F.first("anchors").alias("anchors")), "classes")
    grams = classes.select("k1", "k2", F.explode("anchors").alias("g"))
    many = stash(grams.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "anchors")
    own = grams.join(many, "g").groupBy("k1", "k2").agg(F.collect_set("g").alias("own"))
    own = stash(own.join(classes.select("k1", "k2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tk").alias("tk")), ["k1", "k2"]), "wanted")
    texts = at_rows(docs, own)
    rows = stash(texts.mapInArrow(_phrases(window, gram), PHRASES), "phrases")
    # The reference: the first occurrence of every anchor.
    first = rows.groupBy("g").agg(F.min(F.struct("k1", "k2", "pos", "doc", "off", "hashes")).alias("r"))
    blocks = stash(first.select("g", *[F.col(f"r.{c}").alias(f"r_{c}") for c in ("k1", "k2", "pos", "doc", "off", "hashes")]), "reference")
    met = rows.join(blocks, "g").where("not (k1 = r_k1 and k2 = r_k2 and pos = r_pos)")
    back = "(off - i)"  # how many words before the anchor the i-th window starts
    same = f"x = get(r_hashes, i - off + r_off)"
    bits = F.expr(f"aggregate(transform(hashes, (x, i) -> if({same}, shiftleft(1L, {back}), 0L)), 0L, (a, b) -> a | b)")
    out = F.expr(f"filter(transform(hashes, (x, i) -> if({same}, null, struct({back} as back, x as h))), y -> y is not null)")
    met = stash(met.select("g", "k1", "k2", "pos", bits.alias("mask"), out.alias("out"), "r_k1", "r_k2", "r_pos", "r_doc"), "parsed")
    led = met.where("mask <> 0")
    marks = led.select("k1", "k2", "pos", "mask", F.col("r_doc").alias("ref_doc"), F.col("r_pos").alias("ref_pos"), F.lit(True).alias("led"))
    none = [F.lit(None).cast("long").alias("ref_doc"), F.lit(None).cast("long").alias("ref_pos"), F.lit(False).alias("led")]
    held = led.groupBy(F.col("r_k1").alias("k1"), F.col("r_k2").alias("k2"), F.col("r_pos").alias("pos")).agg(F.bit_or("mask").alias("mask"))
    # At the boundaries: windows that aren't the reference's, by anchor and own hash.
    edge = met.where("size(out) > 0").select("g", "k1", "k2", "pos", F.inline("out"))
    again = stash(edge.groupBy("g", "h").agg(F.count("*").alias("c")).where("c > 1").select("g", "h"), "boundaries")
    edge = edge.join(again, ["g", "h"]).groupBy("k1", "k2", "pos").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask"))
    marks = marks.unionByName(held.select("k1", "k2", "pos", "mask", *none)).unionByName(edge.select("k1", "k2", "pos", "mask", *none))
    marks = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "mask", "ref_doc", "ref_pos", "led")).alias("marks"))
    marks = stash(marks.join(own.select("k1", "k2", "doc_id", "tk"), ["k1", "k2"]), "marks")
    drop(classes, many, own, rows, blocks, met, again)
    return marks


def at_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, a stashed table (doc_id, tk, ...), with the text of its rows; of rows that repeat one stays."""
    keys = wanted.select(F.col("tk").alias("tk_")).distinct()
    some = docs.join(checked(keys), F.col("tk") == F.col("tk_"), "left_semi").dropDuplicates(["doc_id", "tk"])
    some = some.select(F.col("doc_id").alias("id_"), F.col("tk").alias("tk_"), "text")
    return wanted.join(some, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tk") == F.col("tk_"))).drop("id_", "tk_")


def factored(marks: list[dict], window: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int | None, int]]]:
    """The marks of one document -> starts and ends of the spans that go, and the factors (start, words, ref_doc, ref_start), in words."""
    factors, open_ = [], None
    starts = []
    for m in sorted(marks, key=lambda m: (m["pos"], not m["led"])):
        bits = [m["pos"] - b for b in range(64) if m["mask"] >> b & 1]
        starts += bits
        if not m["led"]:
            continue
        for s in sorted(bits):
            shift = m["ref_pos"] - m["pos"]
            if open_ and open_[2] == m["ref_doc"] and open_[3] - open_[0] == shift and s <= open_[0] + open_[1]:
                open_[1] = s + window - open_[0]  # the factor goes on
            else:
                open_ = [s, window, m["ref_doc"], s + shift]
                factors.append(open_)
    s = np.unique(np.array(starts, dtype=np.int64))
    cut = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + window])) if len(s) else np.zeros(0, dtype=np.int64)
    ends = s[np.concatenate([cut[1:] - 1, [len(s) - 1]])] + window if len(s) else s
    return s[cut], ends, [tuple(f) for f in factors]


PARSED = "k1 long, k2 long, n_removed long, kept string, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, factors array<struct<start:bigint,words:bigint,ref_doc:bigint,ref_start:bigint>>"


def _cut(window: int, with_text: bool):
    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()),
                          ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                          ("factors", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "ref_doc", "ref_start")])))])
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                if _keys(whole_hash(text)) != (batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()):
                    continue
                a, b, factors = factored(batch.column("marks")[i].as_py(), window)
                words, kept, at = text.split(), [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept += words[at:x]
                    at = y
                kept = b" ".join(kept + words[at:])
                out.append({
                    "k1": batch.column("k1")[i].as_py(), "k2": batch.column("k2")[i].as_py(), "n_removed": int((b - a).sum()), "kept": kept.decode() if with_text else None,
                    "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())],
                    "factors": [dict(zip(("start", "words", "ref_doc", "ref_start"), f)) for f in factors]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def parsed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """documents -> of each row doc_id, tk (xxhash64 of the text), n_words, n_removed, kept (null where nothing went), kept_sha256, spans (start, stop, in words) and factors (start, words, ref_doc, ref_start).

    A class of several rows is one span and has no factors."""
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tk"))
    signed = stash(docs.mapInArrow(_sign(window, gram), SIGNED), "signed")
    marks = marked(docs, signed, window, gram)
    copies = signed.where(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("n_words").alias("n_removed")).where("n > 1")
    copies = stash(copies.select("k1", "k2", "n_removed"), "copies")
    alone = stash(marks.join(copies, ["k1", "k2"], "left_anti"), "alone")
    cut = at_rows(docs, alone).mapInArrow(_cut(window, with_text), PARSED)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_removed").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,words:bigint,ref_doc:bigint,ref_start:bigint>>")
    cut = stash(cut.unionByName(copies.select("k1", "k2", "n_removed", F.lit("").alias("kept"), F.lit(NOTHING).alias("kept_sha256"), whole.alias("spans"), none.alias("factors"))), "cut")
    drop(marks, alone, copies)
    out = signed.select("doc_id", "tk", "n_words", "k1", "k2", "whole").join(cut, ["k1", "k2"], "left")
    return out.select("doc_id", "tk", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept", F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
                      F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), F.coalesce("factors", none).alias("factors"))


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return parsed(docs, with_text=False, **parameters).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """documents -> the same rows and columns; where words went, the text is the kept words joined by one space."""
    own = masked(docs, "doc_id", "text")
    cut = stash(parsed(own, **parameters).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "kept").dropDuplicates(["_id", "_tk"]), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tk"))
    out = own.join(cut, same, "left").withColumn("text", F.coalesce("kept", "text"))
    return out.select(*own.columns).toDF(*docs.columns)
