"""Personal data in whole texts, with DataFrame functions only: one projection, no shuffle.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, 0 to 255 for the parts
of an address), and words near a span move its score. Email, ip, card and phone spans that their rules confirm
always stay; spans of the added kinds (iban, ssn) stay from `threshold` on. Offsets count code points, the end is
exclusive.

A pattern's matches and the gaps between them give the offsets: a match starts where the gaps and matches before it
end. The patterns are written so that no text makes them try one run of characters again and again: a match starts at
the start of its run or where the match before ended, and repeated parts are possessive.

Defined cases: a null text is empty: all counts 0, no spans. Repeated rows give repeated rows. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import plain

#: kind: (pattern, what each text with a match contains, score, words that raise it, words that lower it)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.9, r"mail|contact|write to", r"example|noreply"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|server|host|address", r"version|release|section"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"[0-9][0-9 -]{14}", 0.8, r"card|visa|master|credit|payment", r"order|invoice|tracking"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|call|tel|mobile|fax", r"score|total"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.7, r"iban|account|bank|konto|compte|cuenta", r"order|part"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.3, r"ssn|social security|tax id", r"order|part|phone"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT = 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97, its first four characters moved to the end and letters as numbers from 10."""
    moved = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.regexp_replace(p, "^0+(?=.)", "").cast("long") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind: an array of (kind, start, end, score), in order."""
    pattern, needs, score, up, down = KINDS[kind]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:long,match:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    placed = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")), start,
        lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                              F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("start"), x["m"].alias("match")))).alias("out")),
        lambda a: a["out"])
    good = F.filter(placed, lambda s: confirmed(kind, s["match"]))

    def told(s):
        before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")))
        after = F.lower(F.substring(text, (s["start"] + F.length(s["match"]) + 1).cast("int"), F.lit(CONTEXT)))
        near = F.concat(before, F.lit(" "), after)
        sure = F.lit(score) + F.when(near.rlike(up), 0.3).otherwise(0.0) - F.when(near.rlike(down), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), sure.alias("score"))

    empty = F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>")
    return F.when(text.rlike(needs), F.transform(good, told)).otherwise(empty)


def find(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text, found: array of (kind, start, end, score), by kind, then start."""
    docs = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = [spans(k, F.col("text")) if k in BASE else F.filter(spans(k, F.col("text")), lambda s: s["score"] >= threshold) for k in KINDS]
    return docs.select("doc_id", "text", F.concat(*kept).alias("found"))


def digest(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id, the count of each base kind, the hash of the base spans, and all spans as text."""
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find(docs, threshold).select("doc_id", "found")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say(F.col("found")).alias("spans"))


def masked(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """documents -> doc_id, text with every found span replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    out = F.aggregate(
        ordered, none,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(
            a["out"], F.substring("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), F.length("text"))))
    return find(docs, threshold).select("doc_id", out.alias("text"))
