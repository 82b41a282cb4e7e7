"""Repair of a conversation's structure by aligning its turns to an alternating grammar.

A repaired conversation's role initials read ``(s?(ua)+)?``. For every feasible length the
grammar gives at most two target strings; turns are aligned to each by Wagner-Fischer with
Ukkonen's band, whose width follows from the best cost so far, and of equally cheap alignments
the one whose audit (the initials of its edits in order) is least wins, within a target and
between targets. Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank
and duplicate rows), Insert an empty user or assistant turn 3; a truncated row that stays adds 3.

Rows are range-partitioned by conversation and order, so a conversation that holds a third of
all rows lies in many partitions. What of it lies in one is cut into blocks of ``BLOCK`` turns.
A conversation of one block is aligned as a whole. Of a longer one every block is aligned from
each state of the grammar to each (nothing yet, after s, after u, after a); the blocks' tables
are composed up a tree, the cheapest way through is read off down it, and no task holds more
than a bounded number of blocks. Inserts belong to the row after them, so no audit of a block is the
start of another and ties are settled block by block. Only the digest of a repaired
conversation, which is a sequential function, is worked out by one task for each, in a stream.

A null role or text counts as one space, rows are taken by turn, null turns first, then by role
and a hash of the text; equal rows are duplicates of the first. A null id is a conversation of
its own. Roles count by their first character as it is; an empty role has none and never fits.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import kept

BLOCK, FAN = 64, 1024
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_OFF = 3
#: Nothing yet, after s, after u, after a; the next symbols of each state.
STATES = "BSAE"
FULL = {"u": "user", "a": "assistant"}
SPACE = r"[\x20\x09-\x0D]"
NEVER = 1 << 40


# --- one block ---------------------------------------------------------------------------------


def targets(start: str, length: int) -> Iterator[tuple[str, str]]:
    """(end state, target) for every string of a length that the grammar has from a state on."""
    if start == "A":
        yield ("E" if length % 2 else "A"), ("au" * length)[:length]
        return
    after = start if length == 0 else "A" if length % 2 else "E"
    yield after, ("ua" * length)[:length]
    if start == "B" and length:
        yield ("S" if length == 1 else "E" if length % 2 else "A"), "s" + ("ua" * length)[: length - 1]


def align(codes: str, target: str, most: int, closed: bool) -> tuple[int, str] | None:
    """The cheapest edits of a block to one target, at most ``most``; of several the least audit.

    ``codes``: a row's initial, ``o`` for any other, upper case if truncated, ``x`` if it must
    go. Only where ``closed`` may inserts follow the last row. Costs of what remains fill the
    band from the end, so that the audit is read forwards.
    """
    n, m = len(codes), len(target)
    over = m - n
    low, high = -((most - 3 * over) // 7), (most + 4 * over) // 7
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for j in range(max(0, n + low), m + 1):
        costs[n][j] = INSERT * (m - j) if closed else 0 if j == m else NEVER
    for i in range(n - 1, -1, -1):
        here, below, code = costs[i], costs[i + 1], codes[i]
        own, extra = code.lower(), CUT_OFF if code.isupper() else 0
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = below.get(j, NEVER) + DELETE
            if j < m:
                want = target[j]
                if want != "s":
                    best = min(best, here.get(j + 1, NEVER) + INSERT)
                if code != "x" and (own == want or want != "s"):
                    best = min(best, below.get(j + 1, NEVER) + extra + (KEEP if own == want else REROLE))
            here[j] = best
    total = costs[0].get(0, NEVER)
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = costs[i][j]
        code, want = codes[i] if i < n else "", target[j] if j < m else ""
        extra = CUT_OFF if code.isupper() else 0
        if code and costs[i + 1].get(j, NEVER) + DELETE == left:
            audit.append("D")
            i += 1
        elif want and want != "s" and costs[i].get(j + 1, NEVER) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if code.lower() == want else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def cheapest(codes: str, start: str, closed: bool) -> dict[str, tuple[int, str]]:
    """(cost, audit) by end state; by ``*`` over the ends that the grammar accepts if ``closed``.

    Lengths are tried from the number of rows outwards. A length that inserts or deletes alone
    would make dearer than the incumbents is not feasible any more, nor is any further out.
    """
    n, found = len(codes), {}
    worst = DELETE * n + 2 * INSERT  # deleting all rows and inserting a pair reaches any state but s

    def limit(slot: str) -> int:
        return found[slot][0] if slot in found else worst

    for away in range(n + worst // INSERT + 2):
        lengths = {n + away, n - away}
        least = min(INSERT * away, DELETE * away)
        slots = {"*"} if closed else set(STATES)
        if all(least > limit(s) for s in slots):
            break
        for length in sorted(x for x in lengths if x >= 0):
            floor = INSERT * (length - n) if length >= n else DELETE * (n - length)
            for end, target in targets(start, length):
                slot = "*" if closed else end
                if (closed and end not in "BE") or floor > limit(slot):
                    continue
                way = align(codes, target, limit(slot), closed)
                if way is not None and (slot not in found or way < found[slot]):
                    found[slot] = way
    return found


def step(state: str, code: str, edit: str) -> tuple[str, str]:
    """The symbol an edit gives from a state, and the state after it."""
    if edit == "D":
        return "", state
    if state == "B" and edit == "K" and code.lower() == "s":
        return "s", "S"
    return ("a", "E") if state == "A" else ("u", "A")


def edited(codes: str, places: list[int], audit: str, state: str) -> list[dict]:
    """The rows an audit leaves: the place of a kept or reroled one, and the role where it is new."""
    rows, i = [], 0
    for edit in audit:
        code = codes[i] if edit != "I" else ""
        symbol, state = step(state, code, edit)
        if edit == "I":
            rows.append({"at": -1 - places[min(i, len(places) - 1)] if places else -1, "role": FULL[symbol]})
        elif edit != "D":
            rows.append({"at": places[i], "role": FULL[symbol] if edit == "R" else None})
        i += edit != "I"
    return rows


def illegal(classes: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(classes, classes[1:])))


# --- tables of blocks ----------------------------------------------------------------------------


def table(codes: str) -> tuple[list[int], list[int]]:
    """Costs from every state to every state, and the ranks of the audits from each."""
    costs, ranks = [], []
    for start in STATES:
        found = cheapest(codes, start, closed=False)
        by_audit = sorted(found, key=lambda end: found[end][1])
        costs += [found[end][0] if end in found else -1 for end in STATES]
        ranks += [by_audit.index(end) if end in found else -1 for end in STATES]
    return costs, ranks


def way_through(children: list[tuple[list[int], list[int]]], start: int, end: int) -> tuple[int, list[int]] | None:
    """The cheapest states between consecutive tables; of several those with the least audits."""
    togo = [[NEVER] * 4 for _ in children] + [[0 if s == end else NEVER for s in range(4)]]
    for k in range(len(children) - 1, -1, -1):
        costs = children[k][0]
        togo[k] = [min((costs[4 * s + t] + togo[k + 1][t] for t in range(4) if costs[4 * s + t] >= 0), default=NEVER) for s in range(4)]
    if togo[0][start] >= NEVER:
        return None
    path = [start]
    for k, (costs, ranks) in enumerate(children):
        s = path[-1]
        ways = [t for t in range(4) if costs[4 * s + t] >= 0 and costs[4 * s + t] + togo[k + 1][t] == togo[k][s]]
        path.append(min(ways, key=lambda t: ranks[4 * s + t]))
    return togo[0][start], path


def audit_order(children: list[tuple[list[int], list[int]]], path: list[int]) -> list[int]:
    """Sorts ways from one state as their audits: by the ranks along them, which say less after they part."""
    return [children[k][1][4 * path[k] + path[k + 1]] for k in range(len(children))]


def composed(children: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The table of consecutive tables."""
    costs, ranks = [-1] * 16, [-1] * 16
    for s in range(4):
        ways = {t: w for t in range(4) if (w := way_through(children, s, t)) is not None}
        for t, (cost, _) in ways.items():
            costs[4 * s + t] = cost
        for rank, t in enumerate(sorted(ways, key=lambda t: audit_order(children, ways[t][1]))):
            ranks[4 * s + t] = rank
    return costs, ranks


#: What closes a conversation: nothing, or what the grammar still asks for.
CLOSING = {"B": "", "S": "II", "A": "I", "E": ""}


def closed_way(children: list[tuple[list[int], list[int]]]) -> list[int]:
    """The states of the cheapest whole conversation, its closing inserts included."""
    ways = []
    for t, state in enumerate(STATES):
        way = way_through(children, 0, t)
        if way is not None:
            ways.append((way[0] + INSERT * len(CLOSING[state]), audit_order(children, way[1]), way[1]))
    return min(ways)[2]


# --- Spark ---------------------------------------------------------------------------------------


def damage(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by crc32 of ``id:turn`` modulo 20: dropped, emptied, without sentence ends, repeated, of role user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn, role, text)]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    times = F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    return rows.where(fault != 0).select(
        F.col(id_col).alias("conv_id"), F.col(turn).alias("turn"), F.when(fault == 4, "user").otherwise(shown[2]).alias("role"),
        said.alias("text"), F.explode(times).alias("copy"),
    ).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` in order, with the place ``at`` and what a row alone shows."""
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    filled = rows.select(
        c.alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    stripped = F.regexp_replace("text", SPACE, "")
    first = F.substring("role", 1, 1)
    shown = filled.select(
        "*", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("cls"), (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut_off"), F.xxhash64("text").alias("h"),
        F.xxhash64(F.lit(1), "text").alias("g"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["c", "turn", "role", "h", "g", "tie"]  # the tie lets many equal rows be split
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # partition and place in it
    return kept(shown.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", at).drop("tie"))


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """``(c, part, blk, codes, classes, places, single, …)``: runs of at most ``block`` rows of a conversation."""
    first = placed.where("not blank").groupBy("c", "role", "h", "g").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = placed.select("c", "turn", "cls", "blank", "cut_off", "at").join(first, "at", "left").withColumn(
        "mark", F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut_off"), "t").otherwise("-")
    )
    code = F.when(F.col("mark").isin("b", "d"), "x").when(F.col("mark") == "t", F.upper("cls")).otherwise(F.col("cls"))
    part = F.shiftright("at", 33)
    in_part = W.partitionBy("c", "part").orderBy("at")
    numbered = marked.select("c", "turn", "cls", "mark", "at", code.alias("code"), part.alias("part")).withColumn(
        "blk", F.floor((F.row_number().over(in_part) - 1) / block).cast("bigint")
    )
    gathered = F.array_sort(F.collect_list(F.struct("at", "code", "cls")))
    return numbered.groupBy("c", "part", "blk").agg(
        gathered.alias("rows"), *[F.count_if(F.col("mark") == m).alias(name) for m, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    ).select(
        "c", "part", "blk", "blank", "duplicate", "truncated", F.array_join("rows.code", "").alias("codes"),
        F.array_join("rows.cls", "").alias("classes"), F.col("rows.at").alias("places"),
    )


EDITS = "array<struct<at:bigint,role:string>>"
SOLVED = f"c string, part bigint, blk bigint, audit string, cost bigint, illegal bigint, rows {EDITS}"
TABLE = "c string, part bigint, blk bigint, costs array<bigint>, ranks array<bigint>, ends string, illegal bigint"
ROWS = pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string())]))


class Known(dict):
    """Answers by codes: most conversations look like others. Forgets all when it grows too large."""

    def get_or(self, key, make):
        if key not in self:
            if len(self) > 100_000:
                self.clear()
            self[key] = make()
        return self[key]


def _solved_batch(rows: list[dict], audits: list[tuple[int, str, str]], inner: bool) -> pa.RecordBatch:
    """Blocks with their (cost, audit, start state) as rows of ``SOLVED``."""
    return pa.RecordBatch.from_pydict(
        {
            "c": [r["c"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int64()), "blk": pa.array([r["blk"] for r in rows], pa.int64()),
            "audit": pa.array([a for _, a, _ in audits], pa.string()), "cost": pa.array([c for c, _, _ in audits], pa.int64()),
            "illegal": pa.array([0 if inner else illegal(r["classes"]) for r in rows], pa.int64()),
            "rows": pa.array([edited(r["codes"], r["places"], a, s) for r, (_, a, s) in zip(rows, audits)], ROWS),
        }
    )


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            yield batch.slice(k, 1000).to_pylist()


def solve_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for rows in _sliced(batches):
        audits = [(*known.get_or(r["codes"], lambda: cheapest(r["codes"], "B", closed=True)["*"]), "B") for r in rows]  # noqa: B023
        yield _solved_batch(rows, audits, inner=False)


def solve_chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose start and end state are known."""
    known = Known()
    for rows in _sliced(batches):
        audits = []
        for r in rows:
            start, end = STATES[r["s"]], STATES[r["t"]]
            found = known.get_or((r["codes"], start), lambda: cheapest(r["codes"], start, closed=False))  # noqa: B023
            audits.append((*found[end], start))
        yield _solved_batch(rows, audits, inner=True)


def tabulate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for rows in _sliced(batches):
        tables = [known.get_or(r["codes"], lambda: table(r["codes"])) for r in rows]  # noqa: B023
        yield pa.RecordBatch.from_pydict(
            {
                "c": [r["c"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int64()), "blk": pa.array([r["blk"] for r in rows], pa.int64()),
                "costs": pa.array([t[0] for t in tables], pa.list_(pa.int64())), "ranks": pa.array([t[1] for t in tables], pa.list_(pa.int64())),
                "ends": [r["classes"][0] + r["classes"][-1] for r in rows], "illegal": pa.array([illegal(r["classes"]) for r in rows], pa.int64()),
            }
        )


def _children(pdf: pd.DataFrame) -> list[tuple[list[int], list[int]]]:
    return [(list(a), list(b)) for a, b in zip(pdf["costs"], pdf["ranks"])]


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "blk"])
    costs, ranks = composed(_children(pdf))
    joints = sum(illegal(a[1] + b[0]) for a, b in zip(pdf["ends"], pdf["ends"][1:]))
    return pd.DataFrame(
        {
            "c": pdf["c"].iloc[:1], "part": pdf["up_part"].iloc[:1], "blk": pdf["up_blk"].iloc[:1], "costs": [costs], "ranks": [ranks],
            "ends": [pdf["ends"].iloc[0][0] + pdf["ends"].iloc[-1][1]], "illegal": [int(pdf["illegal"].sum()) + joints],
        }
    )


def _descended(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "blk"])
    path = way_through(_children(pdf), int(pdf["s"].iloc[0]), int(pdf["t"].iloc[0]))[1]
    return pd.DataFrame({"c": pdf["c"], "part": pdf["part"], "blk": pdf["blk"], "s": path[:-1], "t": path[1:]})


def _states(tables: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """For blocks of long conversations ``(c, part, blk, s, t)``, and for the conversations ``(c, t, illegal)``.

    Up the tree go ``fan`` blocks of a part into one table, those of a part, and those of a
    conversation, of which there are as many as partitions; down it the states are read off.
    """
    up = tables.withColumns({"up_part": F.col("part"), "up_blk": F.floor(F.col("blk") / fan).cast("bigint")})
    runs = up.groupBy("c", "up_part", "up_blk").applyInPandas(_composed, TABLE)
    runs = kept(runs).withColumns({"up_part": F.col("part"), "up_blk": F.lit(0).cast("bigint")})
    parts = kept(runs.groupBy("c", "up_part", "up_blk").applyInPandas(_composed, TABLE))

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        path = closed_way(_children(pdf))
        joints = sum(illegal(a[1] + b[0]) for a, b in zip(pdf["ends"], pdf["ends"][1:]))
        total = int(pdf["illegal"].sum()) + joints
        return pd.DataFrame({"c": pdf["c"], "part": pdf["part"], "s": path[:-1], "t": path[1:], "last": path[-1], "illegal": total})

    top = kept(parts.groupBy("c").applyInPandas(closed, "c string, part bigint, s bigint, t bigint, last bigint, illegal bigint"))
    chosen = "c string, part bigint, blk bigint, s bigint, t bigint"
    of_runs = runs.join(top.select("c", F.col("part").alias("up_part"), "s", "t"), ["c", "up_part"])
    runs_way = of_runs.groupBy("c", "up_part").applyInPandas(_descended, chosen)
    named = runs_way.select("c", F.col("part").alias("up_part"), F.col("blk").alias("up_blk"), "s", "t")
    blocks_way = up.join(named, ["c", "up_part", "up_blk"]).groupBy("c", "up_part", "up_blk").applyInPandas(_descended, chosen)
    return blocks_way, top.groupBy("c").agg(F.max("last").alias("t"), F.max("illegal").alias("illegal"))


def _solved(blocks: DataFrame, fan: int) -> DataFrame:
    counts = blocks.groupBy("c").agg((F.count("*") == 1).alias("single"))
    tagged = kept(blocks.join(counts, "c"))
    asked = ["c", "part", "blk", "codes", "classes", "places"]
    whole = tagged.where("single").select(*asked).mapInArrow(solve_whole, SOLVED)
    long = tagged.where("not single").select(*asked)
    if long.isEmpty():
        return kept(whole)
    ways, ends = _states(kept(long.mapInArrow(tabulate, TABLE)), fan)
    parts = long.join(ways, ["c", "part", "blk"]).select(*asked, "s", "t").mapInArrow(solve_chosen, SOLVED)
    closing = F.element_at(F.array(*[F.lit(CLOSING[s]) for s in STATES]), (F.col("t") + 1).cast("int"))
    added = F.when(F.col("t") == 1, F.lit("user,assistant")).when(F.col("t") == 2, F.lit("assistant"))
    inserted = F.transform(F.split(F.coalesce(added, F.lit("")), ","), lambda r: F.struct(F.lit(-1).cast("bigint").alias("at"), r.alias("role")))
    last = ends.select(
        "c", F.lit(1 << 40).alias("part"), F.lit(0).cast("bigint").alias("blk"), closing.alias("audit"),
        (F.length(closing) * INSERT).cast("bigint").alias("cost"), "illegal", F.filter(inserted, lambda r: r["role"] != "").alias("rows"),
    )
    return kept(whole.unionByName(parts).unionByName(last))


def _digests(lines: DataFrame) -> DataFrame:
    """``(c, repaired_sha256)``: the lines of every conversation hashed one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = {"c": [], "repaired_sha256": []}
            for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist()):
                if c != now:
                    if state is not None:
                        done["c"].append(now)
                        done["repaired_sha256"].append(state.hexdigest())
                    now, state = c, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done["c"]:
                yield pa.RecordBatch.from_pydict(done)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"c": [now], "repaired_sha256": [state.hexdigest()]})

    order = ["c", "part", "blk", "k"]
    return lines.repartition("c").sortWithinPartitions(*order).select("c", "line").mapInArrow(run, "c string, repaired_sha256 string")


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(c, gaps, blank, duplicate, truncated, illegal, cost, audit)`` and their repaired rows
    ``(c, part, blk, k, role, text)``, in order of the three numbers.

    ``rows(conv_id, turn, role, text)``; ``c`` is ``=`` and the id as text, or empty for a null id.
    """
    placed = _placed(rows)
    blocks = kept(_blocks(placed, block))
    solved = _solved(blocks, fan)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy("c").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    faults = blocks.groupBy("c").agg(*[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    audits = F.transform(F.array_sort(F.collect_list(F.struct("part", "blk", "audit"))), lambda x: x["audit"])
    costs = solved.groupBy("c").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(audits, "").alias("audit"))
    left = solved.select("c", "part", "blk", F.posexplode("rows").alias("k", "row")).select("c", "part", "blk", "k", "row.at", F.col("row.role").alias("new"))
    texts = placed.select("at", "role", "text")
    repaired = left.join(texts, "at", "left").select(
        "c", "part", "blk", "k", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return gaps.join(faults, "c").join(costs, "c"), repaired


def repaired_digests(damaged: DataFrame, original: DataFrame, id_col: str = "conv_id", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for every id of the original table; conversations without rows have zeros and empty texts."""
    ids = original.select(F.col(id_col).alias("conv_id")).distinct()
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    facts, rows = repair(damaged, block, fan)
    digests = _digests(rows.withColumn("line", F.concat("role", F.lit(":"), "text")))
    zero: list[Column] = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.withColumn("c", c).join(facts, "c", "left").join(digests, "c", "left").select(
        F.col("conv_id").alias(id_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
