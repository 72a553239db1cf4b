"""Repairs the structure of conversations by A* on the edit lattice.

A node is a place between two rows and the last role that is kept: nothing yet, system, user or assistant. Keeping a row
costs 0, giving it the role user or assistant 1, deleting it 2, inserting an empty turn 5, and a truncated row that isn't
deleted 5 more. The search is keyed by (cost + heuristic, audit), the audit being the initials of the edits so far; the
heuristic sums, from the place on, the deletions that must come and the least that a truncated row costs. It never
overestimates, so the first goal taken is the cheapest, and of the cheapest the one with the least audit.

Rows are sorted over ranges of (conversation, turn), so a conversation of any length lies in as many tasks as its rows fill.
A conversation inside one task and one chunk is searched there. Of the others each chunk is searched from every last role
to every other, the chunks' tables are joined in order (the cheapest way, then the least audit, which never depends on what
follows), and the chosen edits go back to the chunks. Only the digest of a long conversation's text, which can't be
worked out in parts, reads its repaired chunks one after another.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own, a null turn comes first.
Rows of one turn follow by role, then text. Repeated rows are rows of their own, all but the first duplicates. Conversations
without rows have zeros, an empty audit and the digest of nothing. Gaps over 63 bits are cut to 63. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import plain, stash

#: Rows of a conversation that one search covers.
CHUNK = 256
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Last roles: none, system, user, assistant; the first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
LONGEST = (1 << 63) - 1


def damaged(rows: DataFrame) -> DataFrame:
    """conversations -> (conv_id, turn, role, text, copies): what crc32 of `conv_id:turn` does to each row; 0 copies are a row that is gone."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = plain(rows, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), (F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"))


def steps(state: int, initial: str, fault: int):
    """What may be done with a row after `state`: (cost, letter, next state)."""
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more, turn = CUT if fault == TRUNCATED else 0, ASSISTANT if state == USER else USER
    if initial == "s" and state == START:
        yield more, "K", SYSTEM
    elif initial == ("a" if state == USER else "u"):
        yield more, "K", turn
    yield REROLE + more, "R", turn


def search(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """A*: rows (initial of the role, fault) -> the least (cost, audit) from entry to one of the exits, and that exit; None where there is no way."""
    n = len(rows)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if rows[i][1] != OK else 0)  # a truncated row costs its deletion at least
    heap, done = [(left[0], "", 0, entry)], set()
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in exits:
            return f, audit, state
        cost = f - left[i]
        turn = ASSISTANT if state == USER else USER
        if (i, turn) not in done:
            heapq.heappush(heap, (f + INSERT, audit + "I", i, turn))
        if i < n:
            for price, letter, then in steps(state, *rows[i]):
                if (i + 1, then) not in done:
                    heapq.heappush(heap, (cost + price + left[i + 1], audit + letter, i + 1, then))
    return None


def edited(rows: list[tuple[str, str]], audit: str, state: int):
    """rows (role, text) under the edits -> the (role, text) that are left."""
    at = 0
    for letter in audit:
        turn = ASSISTANT if state == USER else USER
        if letter == "I":
            yield NAMES[turn], ""
        elif letter == "R":
            yield NAMES[turn], rows[at][1]
        elif letter == "K":
            yield rows[at]
            if state == START and rows[at][0][:1] == "s":
                turn = SYSTEM
        at += letter != "I"
        state = turn if letter != "D" else state


def told(rows: list[tuple]) -> dict:
    """Rows (turn, role, text, fault) of one chunk -> what its summary needs of them."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {"blank": sum(r[3] == BLANK for r in rows), "duplicate": sum(r[3] == DUPLICATE for r in rows), "truncated": sum(r[3] == TRUNCATED for r in rows),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "least": min(turns, default=None), "most": max(turns, default=None),
            "distinct_turns": len(set(turns)), "head": initials[0] if rows else None, "tail": initials[-1] if rows else None}


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, LONGEST)


def joined(pieces) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in pieces).encode()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Whole conversations have their summary; of the others there are rows, and for each chunk a table of ways (entry, exit, cost, audit).
DEALT = SUMMARY + ", seg long, place int, role string, text string, least long, most long, distinct_turns long, head string, tail string, ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>"


def _arrow(spec: str):
    """The Arrow schema of flat columns, and of ways."""
    import pyarrow as pa

    flat = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    ways = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.schema([(f.split()[0], flat.get(f.split()[1], ways)) for f in spec.split(", ")])


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows, kind, size: int = 2000):
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kind)


def _deal(chunk: int):
    """Sorted rows of a range -> summaries of the conversations that lie in it whole, rows and ways of the first and the last, and of long ones."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def whole(conv, rows):
            if not rows:
                return {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
            t = told(rows)
            cost, audit, _ = search([(r[1][:1], r[3]) for r in rows], START, (START, ASSISTANT))
            out = joined(edited([(r[1], r[2]) for r in rows], audit, START))
            return {"conv_id": conv, "gaps": gaps(t["least"], t["most"], t["distinct_turns"]), **{k: t[k] for k in ("blank", "duplicate", "truncated", "illegal")},
                    "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(out).hexdigest()}

        def part(conv, rows):
            nonlocal number
            number += 1
            kinds, ways = [(r[1][:1], r[3]) for r in rows], []
            for entry in range(4):
                for exit_ in range(4):
                    if found := search(kinds, entry, (exit_,)) if exit_ in (USER, ASSISTANT) or entry <= exit_ else None:
                        ways.append({"entry": entry, "exit": exit_, "cost": found[0], "audit": found[1]})
            yield {"conv_id": conv, "seg": number, "ways": ways, **told(rows)}
            for i, r in enumerate(rows):
                yield {"conv_id": conv, "seg": number, "place": i, "role": r[1], "text": r[2]}

        def parts():
            conv, held, begun, first, long = None, [], False, True, False
            for r in _rows(batches):
                if not begun or r["conv_id"] != conv:
                    if begun and (first or long):
                        yield from part(conv, held)
                    elif begun:
                        yield whole(conv, held)
                    first, long, held = not begun, False, []
                    begun, conv = True, r["conv_id"]
                for i in range(r["copies"]):
                    if len(held) == chunk:
                        yield from part(conv, held)
                        held, long = [], True
                    fault = r["fault"] if r["fault"] == BLANK or i == 0 else DUPLICATE
                    held.append((r["turn"], r["role"], r["text"], fault))
            if begun:
                yield from part(conv, held)

        yield from _batched(parts(), _arrow(DEALT))

    return run


CHOSEN = SUMMARY + ", seg long, entry int, piece string"


def _choose(batches):
    """Chunks of a conversation in order -> the edits of each, and the conversation's summary."""

    def finish(conv, t, best, back):
        cost, exit_ = min((best[x][0], best[x][1], x) for x in (START, ASSISTANT) if x in best)[0::2]
        pieces = []
        for seg, came in reversed(back):
            entry, audit = came[exit_]
            pieces.append((seg, entry, audit))
            exit_ = entry
        pieces.reverse()
        for seg, entry, audit in pieces:
            yield {"conv_id": conv, "seg": seg, "entry": entry, "piece": audit}
        yield {"conv_id": conv, "gaps": gaps(t["least"], t["most"], t["distinct"]), **{k: t[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(p[2] for p in pieces)}

    def run():
        conv, begun, t, best, back = None, False, None, None, None
        for r in _rows(batches):
            if not begun or r["conv_id"] != conv:
                if begun:
                    yield from finish(conv, t, best, back)
                conv, begun, best, back = r["conv_id"], True, {START: (0, "")}, []
                t = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "least": None, "most": None, "distinct": 0, "tail": None}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                t[k] += r[k]
            if r["head"] is not None:
                t["illegal"] += t["tail"] is not None and t["tail"] + r["head"] not in LEGAL
                t["tail"] = r["tail"]
            if r["least"] is not None:  # turns ascend, so chunks share one turn at most
                t["distinct"] += r["distinct_turns"] - (t["most"] == r["least"])
                t["least"], t["most"] = r["least"] if t["least"] is None else t["least"], r["most"]
            then, came = {}, {}
            for w in r["ways"]:
                if w["entry"] in best:
                    cost, audit = best[w["entry"]]
                    new = (cost + w["cost"], audit + w["audit"])
                    if w["exit"] not in then or new < then[w["exit"]]:
                        then[w["exit"]], came[w["exit"]] = new, (w["entry"], w["audit"])
            best = then
            back.append((r["seg"], came))
        if begun:
            yield from finish(conv, t, best, back)

    yield from _batched(run(), _arrow(CHOSEN))


def _apply(batches):
    """Rows of chunks with their edits -> the repaired text of each chunk."""

    def run():
        seg, rows, last = None, [], None
        for r in _rows(batches):
            if seg is not None and r["seg"] != seg:
                yield out(last, rows)
                rows = []
            seg, last = r["seg"], r
            if r["place"] is not None:
                rows.append((r["role"], r["text"]))
        if seg is not None:
            yield out(last, rows)

    def out(r, rows):
        pieces = list(edited(rows, r["piece"], r["entry"]))
        return {"conv_id": r["conv_id"], "seg": r["seg"], "n": len(pieces), "body": joined(pieces)}

    yield from _batched(run(), _arrow("conv_id long, seg long, n int, body binary"), 64)


def _digest(batches):
    """Repaired chunks in order -> the digest of each conversation; one chunk is held at a time."""

    def run():
        conv, sha, some = None, None, False
        for r in _rows(batches):
            if sha is None or r["conv_id"] != conv:
                if sha is not None:
                    yield {"conv_id": conv, "sha": sha.hexdigest()}
                conv, sha, some = r["conv_id"], hashlib.sha256(), False
            if r["n"]:
                sha.update(b"\n" * some + r["body"])
                some = True
        if sha is not None:
            yield {"conv_id": conv, "sha": sha.hexdigest()}

    yield from _batched(run(), _arrow("conv_id long, sha string"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, role, text) and, if there is one, copies -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows, chosen, raw = searched(rows, chunk)
    names = SUMMARY.replace(" long", "").replace(" string", "").split(", ")
    bodies = raw.mapInArrow(_apply, "conv_id long, seg long, n int, body binary")
    digests = bodies.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_digest, "conv_id long, sha string")
    long = chosen.where("seg is null").join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    long = long.withColumn("repaired_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())))
    return rows.where("seg is null").select(*names).unionByName(long.select(*names))


def searched(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> what _deal gives, what _choose gives, and the rows of chunks with their edits, sorted by chunk."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    say = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), say("role").alias("role"), say("text").alias("text"), copies.alias("copies"))
    # Repeated rows come together before anything is sorted.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = stash(rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text")), "turns")
    at = lambda c: F.struct(F.col(c).isNotNull(), F.col(c))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "h1", "h2").agg(F.min(at("turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), "h1", "h2", F.col("t.turn").alias("t_"))
    same = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (rows.h1 == first.h1) & (rows.h2 == first.h2) & F.col("turn").eqNullSafe(F.col("t_"))
    rows = rows.join(first, same, "left").drop(first.h1, first.h2)
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("r_").isNull(), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(OK))
    rows = stash(rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")), "faults")
    # Ranges are cut by the beginning of a text, so that no long one is sampled; equal beginnings stay together.
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = stash(dealt.mapInArrow(_deal(chunk), DEALT), "dealt")
    chunks = dealt.where("ways is not null").select("conv_id", "seg", "blank", "duplicate", "truncated", "illegal", "least", "most", "distinct_turns", "head", "tail", "ways")
    chosen = stash(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_choose, CHOSEN), "chosen")
    raw = dealt.where("seg is not null").select("conv_id", "seg", "place", "role", "text").join(chosen.where("seg is not null").select("seg", "entry", "piece"), "seg")
    raw = raw.select("conv_id", "seg", "place", "role", "text", "entry", "piece").repartition("seg").sortWithinPartitions("seg", F.col("place").asc_nulls_first())
    return dealt, chosen, raw


# --- the same in SQL ----------------------------------------------------------------------------------


def _then(x: str, cost: str, letter: str, piece: str) -> str:
    """A state is its cost (12 digits), its audit, character 1 and its text, so that states compare by cost, then audit."""
    return (f"case when {x} is not null then lpad((left({x}, 12)::bigint + {cost})::varchar, 12, '0') || substr({x}, 13, strpos({x}, chr(1)) - 13) || '{letter}' || substr({x}, strpos({x}, chr(1))) || {piece} end")


def _inserted() -> str:
    say = lambda role: f"chr(10) || '{role}:'"
    u = "least(" + ", ".join(["u", *[_then(x, "5", "I", say("user")) for x in "qsa"]]) + ")"
    return f"select c, i, q, s, u, least(a, {_then('u', '5', 'I', say('assistant'))}) as a from (select c, i, q, s, {u} as u, a from {{0}})"


def _row() -> str:
    own, user, assistant = "chr(10) || r.role || ':' || r.text", "chr(10) || 'user:' || r.text", "chr(10) || 'assistant:' || r.text"
    more = "(case when fault = 3 then 5 else 0 end)"
    gone = lambda x: _then(x, "2", "D", "''")
    kept = lambda x, letter: f"case when fault in (0, 3) and r.initial = '{letter}' then {_then(x, more, 'K', own)} end"
    given = lambda x, text: f"case when fault in (0, 3) then {_then(x, f'(1 + {more})', 'R', text)} end"
    u = ", ".join([gone("u"), *[kept(x, "u") for x in "qsa"], *[given(x, user) for x in "qsa"]])
    return (f"select p.c, p.i + 1 as i, {gone('q')} as q, least({gone('s')}, {kept('q', 's')}) as s, least({u}) as u, least({gone('a')}, {kept('u', 'a')}, {given('u', assistant)}) as a "
            "from ({0}) p join faults r on r.c = p.c and r.i = p.i")


REPAIR_SQL = rf"""
with recursive
crcs as (select list(x order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x from range(256) s(i))),
given as (select coalesce(conv_id::varchar, ' ') as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as way from conversations, crcs),
hurt as (select c, turn, case when way = 4 then 'user' else role end as role, case when way = 1 then '' when way = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when way = 3 then [1, 2] else [1] end) as copy from given where way <> 0),
placed as (select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as i from hurt),
faults as materialized (select *, left(role, 1) as initial, lead(left(role, 1)) over (partition by c order by i) as next,
  case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by c, role, text order by i) > 1 then 2
       when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault from placed),
walk as (select distinct c, 1::bigint as i, '000000000000' || chr(1) as q, null::varchar as s, null::varchar as u, null::varchar as a from given
  union all {_row().replace("{0}", _inserted().replace("{0}", "walk"))}),
ends as ({_inserted().replace("{0}", "(select * from walk w where i = 1 + (select count(*) from faults f where f.c = w.c)) z")}),
best as (select c, least(q, a) as b from ends),
counts as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (next is not null and initial || next not in ('su', 'ua', 'au')) as illegal from faults group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, left(b, 12)::bigint as cost, substr(b, 13, strpos(b, chr(1)) - 13) as audit, sha256(substr(b, strpos(b, chr(1)) + 2)) as repaired_sha256
from (select distinct c, conv_id from given) join best using (c) left join counts using (c)
"""
