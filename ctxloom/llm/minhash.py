"""Near-duplicate documents by b-bit MinHash.

Every text becomes its set of distinct 5-word shingles. Of 512 minima the first 128 give 32 bands of four (a pair
at similarity 0.75 shares none with a probability of 5e-6), and the two low bits of each are packed into a
signature of 128 bytes. Bands propose, the collision-corrected bit estimate prunes what is 3.9 deviations or more
under the threshold, and full sets confirm.

Texts with equal sets are one class. In a band bucket only links to one leader are tried first, the member that
shares most buckets: in a family of edited copies that is the text they came from. What stays apart in a bucket
after that is tried pair by pair across the parts. So a group of n copies costs about n checks, not n * n.

Defined cases: a null or empty text, or one without words, has n_shingles 0 and is its own component, as is a row
whose doc_id is null (kept, component_id null). Repeated rows are copies. Rows that share a doc_id but not a text
are documents of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import FOLD, Words, checked, connected_components, constants, distinct, drop, masked, matrix, mix, plain, runs, stash, texts_in_chunks

SHINGLE, HASHES, BANDED, ROWS, BITS = 5, 512, 128, 4, 2
ODD_BITS = 0x5555555555555555


def shingle_sets(column, width: int = SHINGLE):
    """An Arrow column of texts -> (row, sorted distinct 64-bit shingle hashes) for each row."""
    coef = constants(width, 11)
    for at, buf, offsets in texts_in_chunks(column):
        w = Words(buf, offsets)
        h = w.hashes(w.sums(FOLD), w.start, w.end)
        n = max(0, len(h) - width + 1)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            s += h[k : k + n] * coef[k]
        s = mix(s)
        for i in range(len(offsets) - 1):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= width:
                yield at + i, distinct(s[a : b - width + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield at + i, mix(np.array([(h[a:b] * coef[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
            else:
                yield at + i, np.zeros(0, dtype=np.uint64)


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def minima(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least of each of `hashes` permutations of the upper 32 bits."""
    mult, flip = ((constants(hashes, salt) >> np.uint64(32)).astype(np.uint32)[:, None] for salt in (101, 202))
    s, mult = (s >> np.uint64(32)).astype(np.uint32), mult | np.uint32(1)
    out = np.full(hashes, np.uint32(0xFFFFFFFF))
    for k in range(0, len(s), 256):
        np.minimum(out, ((s[None, k : k + 256] ^ flip) * mult).min(axis=1), out=out)
    return out.astype(np.uint64)


def packed(low: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum (taken after mixing), 32 to a long."""
    b = (mix(low) & np.uint64(3)).reshape(-1, 32)
    return (b << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    m = low[:BANDED].reshape(-1, rows)
    return mix((m * constants(rows, 303)).sum(axis=1, dtype=np.uint64) + constants(len(m), 404)).view(np.int64)


SIGNED = "doc_id long, th long, n_shingles long, class long, sig array<long>, bands array<long>"


def _sign(batches):
    import pyarrow as pa

    for batch in batches:
        ids, n, cls, sig, bands = batch.column("doc_id"), [], [], [], []
        for _, s in shingle_sets(batch.column("text")):
            n.append(len(s))
            if len(s):
                low = minima(s)
                cls.append(set_hash(s))
                sig.append(packed(low))
                bands.append(band_keys(low))
            else:
                cls.append(None)
                sig.append(None)
                bands.append(None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, longs), pa.array(bands, longs)],
            names=["doc_id", "th", "n_shingles", "class", "sig", "bands"])


def estimate(a: str, b: str):
    """Similarity from packed bits: the share of equal positions, less what falls together by chance."""
    wrong = sum((F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i])).bitwiseOR(
        F.shiftrightunsigned(F.col(a)[i].bitwiseXOR(F.col(b)[i]), 1)).bitwiseAND(F.lit(ODD_BITS)))
        for i in range(HASHES // 32)), F.lit(0))
    chance = 1 / (1 << BITS)
    return (1 - wrong / HASHES - chance) / (1 - chance)


def _across(keep_above: float):
    """Runs of one bucket, or of two blocks of a large one -> the likely pairs of different parts, each from the first band it shares."""

    def run(batches):
        import pyarrow as pa

        chance = 1 / (1 << BITS)
        most = int(HASHES * (1 - chance) * (1 - keep_above))
        for t in runs(batches, "key", "i", "j"):
            if t.num_rows < 2:
                continue
            key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
            cls, part, own = (t.column(c).to_numpy() for c in ("class", "part", "own"))
            sig = matrix(t.column("sig"), HASHES // 32, np.int64).view(np.uint64)
            bands = matrix(t.column("bands"), BANDED // ROWS, np.int64)
            a_rows, b_rows = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for k in range(0, len(a_rows), 128):
                a = a_rows[k : k + 128]
                x = sig[a][:, None, :] ^ sig[b_rows][None, :, :]
                wrong = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(ODD_BITS)).sum(axis=2, dtype=np.int64)
                good = (wrong <= most) & (part[a][:, None] != part[b_rows][None, :])
                if i == j:
                    good &= cls[a][:, None] < cls[b_rows][None, :]
                p, q = np.nonzero(good)
                p, q = a[p], b_rows[q]
                if len(p):
                    same = bands[p] == bands[q]
                    here = bands[p][np.arange(len(p)), same.argmax(axis=1)] == key
                    p, q = cls[p[here]], cls[q[here]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["lead", "member"])

    return run


def _confirm(percent: int):
    def run(batches):
        import pyarrow as pa

        lead, lead_set = None, None
        for batch in batches:
            leads, members = batch.column("lead").to_pylist(), batch.column("member").to_pylist()
            src, dst = [], []
            for row, s in shingle_sets(batch.column("text")):
                own = members[row] if members[row] is not None else leads[row]
                if not len(s) or set_hash(s) != own:
                    continue
                if members[row] is None:
                    lead, lead_set = own, s
                elif leads[row] == lead:
                    both = len(np.intersect1d(lead_set, s, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(lead_set) - both):
                        src.append(lead)
                        dst.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, salt_at: int = 256) -> DataFrame:
    """pairs (lead, member) of classes -> edges (src, dst) whose full sets are similar enough.

    The rows of a lead follow its own text in one sorted run, so a task holds one set at a time; leads with many
    members are dealt over several runs, each with a copy of the lead's text."""
    many = pairs.groupBy("lead").agg(F.ceil(F.count("*") / salt_at).cast("int").alias("runs"))
    wanted = stash(pairs.select(F.col("lead").alias("class")).union(pairs.select("member")).distinct().join(reps.select("class", F.col("from.doc_id").alias("_id"), F.col("from.th").alias("_th")), "class"), "wanted")
    text = stash(docs.join(checked(wanted), (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "text"), "texts")
    members = pairs.join(many, "lead").select("lead", F.pmod(F.xxhash64("member"), F.col("runs")).cast("int").alias("run"), "member")
    members = members.join(text.withColumnRenamed("class", "member"), "member").select("lead", "run", "member", "text")
    leads = many.select("lead", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("member"))
    leads = leads.join(text.withColumnRenamed("class", "lead"), "lead").select("lead", "run", "member", "text")
    runs = members.unionByName(leads).repartition("lead", "run")
    runs = runs.sortWithinPartitions("lead", "run", F.col("member").asc_nulls_first())
    return runs.select("lead", "member", "text").mapInArrow(_confirm(percent), "src long, dst long")


def components(docs: DataFrame, percent: int = 75, keep_above: float = 0.66) -> tuple[DataFrame, DataFrame]:
    """documents -> signed rows (doc_id, th, n_shingles, class), and of each class (class, root, rep, from)."""
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    signed = stash(docs.mapInArrow(_sign, SIGNED), "signed")
    reps = stash(signed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("from"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "reps")
    found = links(reps, docs, percent, keep_above)
    parts = connected_components(found)
    named = reps.select("class", "rep", "from").join(parts.withColumnRenamed("node", "class"), "class", "left")
    return signed.select("doc_id", "th", "n_shingles", "class"), named.select("class", "rep", "from", F.coalesce("root", "class").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 75, keep_above: float = 0.66) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    percent: the similarity from which documents are linked. keep_above: pairs that the bits estimate below it
    aren't confirmed (3.9 deviations under 0.75)."""
    signed, named = components(docs, percent, keep_above)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("class", "component_id")
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """documents -> the rows, with all their columns, of one row of each group: the least id, then text hash, null ids last.

    A row is told by its id and text; of rows that repeat both, one stays. Rows without words stay."""
    signed, named = components(docs, **parameters)
    heads = named.groupBy("root").agg(F.min("from").alias("head"))
    rows = signed.where("class is not null").groupBy("doc_id", "th", "class").agg(F.count("*").alias("n"))
    rows = rows.join(named.join(heads, "root").select("class", "head"), "class")
    head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    told = stash(rows.where(~head | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), head.alias("_head")), "gone")
    # Only rows in `told` go, or stay once; the others aren't shuffled where it is small.
    own = masked(docs, "doc_id", "text").withColumn("own_th", F.xxhash64("text"))
    names = [c for c in own.columns if c != "own_th"]
    same = (F.col("own_th") == F.col("_th")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    rest = own.join(checked(told), same, "left_anti").select(*names)
    again = stash(told.where("_head"), "again")
    once = own.join(checked(again), same).dropDuplicates(["_id", "_th"]).select(*names)
    return rest.unionByName(once).toDF(*docs.columns)


def links(reps: DataFrame, docs: DataFrame, percent: int, keep_above: float, block: int = 1024) -> DataFrame:
    """Confirmed links that connect what all confirmed links connect."""
    bands = reps.select(F.explode("bands").alias("key"), "class")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(bands.join(sizes, "key"), "buckets")
    weight = shared.groupBy("class").agg(F.sum("n").alias("w"))
    lead = shared.join(weight, "class").groupBy("key").agg(F.max(F.struct("w", "class")).alias("top"))
    first = shared.join(lead.select("key", F.col("top.class").alias("lead")), "key").where("class <> lead")
    first = first.select("lead", F.col("class").alias("member")).distinct()
    sig = reps.select("class", "sig")

    def likely(pairs):
        out = pairs.join(sig.toDF("lead", "a"), "lead").join(sig.toDF("member", "b"), "member")
        return out.where(estimate("a", "b") >= keep_above).select("lead", "member")

    tried = stash(likely(first), "tried")
    edges = stash(confirm(tried, reps, docs, percent), "links")
    parts = connected_components(edges).select(F.col("node").alias("class"), "root")
    left = shared.select("key", "n", "class").join(parts, "class", "left").select("key", "n", "class", F.coalesce("root", "class").alias("part"))
    open_ = left.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    left = stash(left.join(open_, "key"), "open")
    dealt = left.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "part")
    dealt = dealt.join(reps.select("class", "sig", "bands"), "class").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = dealt.mapInArrow(_across(keep_above), "lead long, member long").distinct()
    seen = tried.select(F.greatest("lead", "member").alias("lead"), F.least("lead", "member").alias("member"))
    more = stash(more.join(seen, ["lead", "member"], "left_anti"), "more")
    rest = stash(confirm(more, reps, docs, percent), "links")
    drop(shared, tried, left, more)
    return edges.unionByName(rest)
