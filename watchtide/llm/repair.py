"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily, an arc at a time: an acceptor of a conversation's rows, a transducer of edits and
an acceptor of the role grammar (system? (user assistant)+)?. Weights are pairs (cost, edits), least first. Costs to go
are relaxed from the last row to the first, the topological order of the composition; from one state no two arcs bear
the same edit, so the least arc by (cost, edit) begins the least path by (cost, string of edits).

A conversation is cut into chunks where the range partitions of the sorted rows cut it, so that one of any length is
repaired by many tasks: the chunks at those cuts (two for each partition at most) exchange matrices of costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import materialize

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: The role grammar: state -> role initial -> state. 0 is the start; 1 after system, 2 after a user, 3 after an assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
START, STATES, NEVER = 0, range(4), 1 << 60
#: What edits may write, by the state they leave.
WRITES = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Letters of a row: its role's initial (x: any other) as it is, truncated, or to be deleted.
PLAIN, TRUNCATED, DOOMED = "suax", "SUAX", "0123"


def initial(code: str) -> str:
    return PLAIN[(PLAIN + TRUNCATED + DOOMED).index(code) % 4]


@lru_cache(None)
def arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """Arcs (edit, cost, next state) of row, edits and grammar composed, that leave a state by reading the row."""
    out = [(DELETE, DELETE_COST, state)]
    if code not in DOOMED:
        more = TRUNCATED_COST if code in TRUNCATED else 0
        if (to := GRAMMAR[state].get(initial(code))) is not None:
            out.append((KEEP, more, to))
        out.append((REROLE, REROLE_COST + more, GRAMMAR[state][WRITES[state]]))
    return out


def _inserted(best: list[tuple[int, str, int]]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs to go and the moves (edits, next state), after inserts before the row are allowed. best: (cost, edit, next state) without."""
    cost = [b[0] for b in best]
    for _ in STATES:  # chains of inserts; a cycle costs more than it saves
        cost = [min(cost[q], cost[GRAMMAR[q][WRITES[q]]] + INSERT_COST) for q in STATES]
    moves = []
    for q in STATES:
        edits, at = "", q
        while (cost[at], INSERT) < (best[at][0], best[at][1]) and cost[at] == cost[to := GRAMMAR[at][WRITES[at]]] + INSERT_COST:
            edits, at = edits + INSERT, to
        moves.append((edits + best[at][1], best[at][2]))
    return tuple(cost), tuple(moves)


@lru_cache(100_000)
def step(code: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(base, costs to go above base, moves) before a row, from the costs to go after it; NEVER and more: no way."""
    best = [min((cost + after[to], edit, to) for edit, cost, to in arcs(code, q)) for q in STATES]
    cost, moves = _inserted(best)
    base = low if (low := min(cost)) < NEVER else 0
    return base, tuple(c - base if c < NEVER else NEVER for c in cost), moves


#: After a conversation's last row: costs of closing it, and the inserts for that.
CLOSING, CLOSERS = _inserted([(0 if q in FINAL else NEVER, "", q) for q in STATES])


def backward(codes: str, after: tuple[int, ...], kept: list | None = None) -> tuple[int, ...]:
    """Costs to go before a chunk's rows from those after them; kept: gets the moves, last row first."""
    total = 0
    for code in reversed(codes):
        base, after, moves = step(code, after)
        total += base
        if kept is not None:
            kept.append(moves)
    return tuple(total + c if c < NEVER else NEVER for c in after)


def chunk_matrix(codes: str) -> list[int]:
    """Least costs from each state before a chunk to each state after it, row by row."""
    columns = [backward(codes, tuple(0 if q == to else NEVER for q in STATES)) for to in STATES]
    return [columns[to][q] for q in STATES for to in STATES]


def forward(codes: str, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The edits of each row, inserts before it included, and the state behind them."""
    kept: list = []
    backward(codes, after, kept)
    tokens = []
    for moves in reversed(kept):
        edits, state = moves[state]
        tokens.append(edits)
    return tokens, state


def _illegal(codes: str, before: str) -> int:
    roles = [initial(c) for c in before + codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


# ---- on Spark ----


def _matrices(codes: pd.Series) -> pd.Series:
    return codes.map(chunk_matrix)


def _follows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs to go after each chunk of a cut conversation. One row per conversation."""
    for batch in batches:
        for conv, chunks in zip(batch["conv"], batch["chunks"]):
            after, rows = CLOSING, []
            for c in reversed(chunks):
                rows.append((conv, c["chunk"], list(after)))
                m = np.asarray(c["matrix"]).reshape(4, 4)
                after = [min(NEVER, *(int(m[q, to]) + after[to] for to in STATES)) for q in STATES]
            yield pd.DataFrame(rows, columns=["conv", "chunk", "follows"])


def _exits(codes: pd.Series, follows: pd.Series) -> pd.Series:
    return pd.Series([[forward(own, tuple(map(int, after)), q)[1] for q in STATES] for own, after in zip(codes, follows)])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each chunk of a cut conversation, the last row of the chunk before, whether it is the last. One row per conversation."""
    for batch in batches:
        for conv, chunks in zip(batch["conv"], batch["chunks"]):
            state, before, rows = START, "", []
            for c in chunks:
                rows.append((conv, c["chunk"], list(c["follows"]), state, before, len(rows) + 1 == len(chunks)))
                state, before = int(c["exits"][state]), c["tip"]
            yield pd.DataFrame(rows, columns=["conv", "chunk", "follows", "entry", "before", "last"])


def _edits(codes: pd.Series, follows: pd.Series, entry: pd.Series, before: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = []
    for own, after, state, left, ends in zip(codes, follows, entry, before, last):
        after = CLOSING if after is None else tuple(map(int, after))
        tokens, end = forward(own, after, state)
        rows.append((tokens, CLOSERS[end][0] if ends else "", backward(own, after)[state], _illegal(own, left)))
    return pd.DataFrame(rows, columns=["tokens", "tail", "cost", "illegal"])


def _identity(role: Column, text: Column) -> Column:
    """A digest that is equal where role and text both are."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _given(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return named.withColumn("same", _identity(F.col("role"), F.col("text")))


ORDER = ("turn", "role", "same")


def plan(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Chunks of conversations with the edits of their rows, written to the shared folder.

    Rows stand in order of turn (nulls first), role, then a digest of role and text. A row without a visible character
    is blank; else one whose role and text stood before in its conversation is a duplicate; else one that doesn't end
    in . ! or ? is truncated. Null roles and texts are empty; a role's initial alone counts for the grammar. Rows of a
    null conversation are one conversation; repeated rows are duplicates; other columns are ignored. Texts stay behind:
    rows travel as digests.
    """
    own = _given(rows, conv, turn, role, text)
    visible = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = own.select("conv", *ORDER, (visible == "").alias("blank"), (~visible.rlike(r"[.!?]\z")).alias("cut"), F.monotonically_increasing_id().alias("id"))
    by = [F.asc_nulls_first(c) for c in ("conv", *ORDER, "id")]
    placed = slim.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    placed = materialize(placed.drop("id"), "turns")
    # the first of equal rows is told by its place, a key of its own: copies of one text don't gather
    first = placed.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select(F.col("conv").alias("_c"), F.col("same").alias("_s"), F.col("pos").alias("_p"))
    told = placed.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")) & (F.col("pos") == F.col("_p")), "left")
    told = told.withColumn("again", ~F.col("blank") & F.col("_p").isNull()).withColumn("cut", ~F.col("blank") & ~F.col("again") & F.col("cut"))
    letter = F.substring("role", 1, 1)
    letter = F.when(letter.isin(*PLAIN[:3]), letter).otherwise(PLAIN[3])
    code = F.when(F.col("blank") | F.col("again"), F.translate(letter, PLAIN, DOOMED)).when(F.col("cut"), F.upper(letter)).otherwise(letter)
    chunks = told.groupBy("conv", F.shiftright("pos", 33).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *ORDER, code.alias("code")))).alias("rows"),
        *(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "again", "cut")),
    )
    chunks = materialize(chunks.withColumn("codes", F.array_join(F.transform("rows", lambda r: r["code"]), "")), "chunks")
    # chunks of conversations that are cut: two for each border of partitions at most, so these tables are small
    spread = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("_c"))
    several = chunks.join(F.broadcast(spread), F.col("conv").eqNullSafe(F.col("_c"))).select("conv", "chunk", "codes", F.pandas_udf(_matrices, "array<long>")("codes").alias("matrix"))
    several = materialize(several, "cut")
    kind = dict(placed.dtypes)["conv"]
    met = several.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("chunks"))
    follows = met.mapInPandas(_follows, f"conv {kind}, chunk long, follows array<long>").select(F.col("conv").alias("_c"), F.col("chunk").alias("_k"), "follows")
    left = several.join(F.broadcast(follows), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")))
    left = left.select("conv", "chunk", "follows", F.pandas_udf(_exits, "array<int>")("codes", "follows").alias("exits"), F.substring("codes", -1, 1).alias("tip"))
    met = left.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "follows", "exits", "tip"))).alias("chunks"))
    known = met.mapInPandas(_entries, f"conv {kind}, chunk long, follows array<long>, entry int, before string, last boolean")
    known = known.select(F.col("conv").alias("_c"), F.col("chunk").alias("_k"), "follows", "entry", "before", "last")
    both = chunks.join(F.broadcast(known), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")), "left")
    last = F.coalesce("last", F.lit(True))
    edits = F.pandas_udf(_edits, "struct<tokens:array<string>, tail:string, cost:long, illegal:long>")("codes", "follows", F.coalesce("entry", F.lit(START)), F.coalesce("before", F.lit("")), last)
    return materialize(both.withColumn("e", edits).select("conv", "chunk", "rows", "blank", "again", "cut", "e.*"), "edits")


def report(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row per conversation of a plan: gaps, blank, duplicate, truncated, illegal, cost (longs) and audit, the edits' initials in order.

    gaps: turns missing between the least and the greatest, nulls aside; null where it doesn't fit into a long.
    """
    turns = F.transform("rows", lambda r: r["turn"].cast("decimal(38,0)"))
    known = F.filter(turns, lambda t: t.isNotNull())
    # rows are in order, so a turn is new in its chunk or the last one of the chunk before: distinct ones are merged by their ends
    each = found.select("conv", "chunk", "blank", "again", "cut", "cost", "illegal", F.concat(F.array_join("tokens", ""), "tail").alias("audit"), F.array_min(known).alias("low"), F.array_max(known).alias("high"), F.size(F.array_distinct(known)).cast("long").alias("n"))
    by_conv = each.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "again", "cut", "illegal")),
        F.min_by("cost", "chunk").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("chunk", "low", "high")))).alias("ends"),
    )
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size("ends")), lambda i: (i > 1) & (F.get("ends", i - 1)["low"] == F.get("ends", i - 2)["high"])))
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("n") + shared), F.lit(0).cast("decimal(38,0)")).try_cast("long")
    return by_conv.select(F.col("conv").alias(conv), gaps.alias("gaps"), "blank", F.col("again").alias("duplicate"), F.col("cut").alias("truncated"), "illegal", "cost", "audit")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, place, role, text, edits) of repaired rows; batches hold each conversation's rows in order, a row's edits before its text."""
    begun, conv, state, place, waiting = False, None, START, 0, []
    for batch in batches:
        for own, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "edits"))):
            if not begun or own != conv:
                begun, conv, state, place, waiting = True, own, START, 0, []
            if text is None and role is not None:  # the edits of a row, or of several equal ones
                if waiting and waiting[-1][0] == edits:
                    waiting[-1][1] += 1
                else:
                    waiting.append([edits, 1])
                continue
            if role is not None:
                edits = waiting[0][0]
                waiting[0][1] -= 1
                if not waiting[0][1]:
                    waiting.pop(0)
            for edit in edits:
                if edit == DELETE:
                    continue
                letter = role[:1] if edit == KEEP else WRITES[state]
                state = GRAMMAR[state][letter]
                yield conv, place, role if edit == KEEP else NAMES[letter], "" if edit == INSERT else text, edit
                place += 1


def _in_order(found: DataFrame, rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Texts and edits of each conversation together and in order, sorted by Spark and streamed: no conversation is held whole."""
    own = _given(rows, conv, turn, role, text).select("conv", F.lit(0).alias("tail"), *ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), "text", F.lit(None).cast("string").alias("edits"))
    each = found.select("conv", F.explode(F.arrays_zip("rows", "tokens")).alias("r"))
    edits = each.select("conv", F.lit(0).alias("tail"), *(F.col(f"r.rows.{c}").alias(c) for c in ORDER), F.lit(0).alias("kind"), F.col("r.rows.pos").alias("pos"), F.lit(None).cast("string").alias("text"), F.col("r.tokens").alias("edits"))
    kinds = dict(own.dtypes)
    ends = found.where("tail <> ''").select("conv", F.lit(1).alias("tail"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ORDER), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), F.col("tail").alias("edits"))
    together = own.unionByName(edits).unionByName(ends).repartition("conv")
    return together.sortWithinPartitions("conv", "tail", *(F.asc_nulls_first(c) for c in ORDER), "kind", "pos").select("conv", "role", "text", "edits")


def repaired(found: DataFrame, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows of a plan over the same rows: conv, place (from 0), role, text, edit. A conversation of which nothing stays has none."""
    ordered = _in_order(found, rows, conv, turn, role, text)
    kind = dict(ordered.dtypes)["conv"]
    schema = pa.schema([("conv", _arrow(ordered, "conv")), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for row in _turns(batches):
            waiting.append(row)
            size += len(row[3])
            if len(waiting) >= 10_000 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), schema.types)], schema=schema)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), schema.types)], schema=schema)

    return ordered.mapInArrow(run, f"conv {kind}, place long, role string, text string, edit string").withColumnRenamed("conv", conv)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def digest(found: DataFrame, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and repaired_sha256: of a conversation's repaired rows, role:text, joined by newlines. Hashed as they stream by."""
    ordered = _in_order(found, rows, conv, turn, role, text)
    kind, arrow = dict(ordered.dtypes)["conv"], _arrow(ordered, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", arrow), ("repaired_sha256", pa.string())])
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        done, begun, now, sha = [], False, None, hashlib.sha256()
        for own, place, who, said, _ in _turns(batches):
            if begun and place == 0:
                done.append((now, sha.hexdigest()))
                sha = hashlib.sha256()
            sha.update(("\n" * (place > 0) + f"{who}:{said}").encode())
            begun, now = True, own
            if len(done) >= 10_000:
                yield make(done)
                done = []
        if begun:
            yield make([*done, (now, sha.hexdigest())])

    return ordered.mapInArrow(run, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv)
