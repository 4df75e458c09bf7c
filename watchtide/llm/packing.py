"""Best-fit packing by a linear grouping scheme.

Documents become pieces of at most `capacity` tokens. The driver plans over the histogram of piece lengths, which
has at most `capacity` entries whatever the corpus: large lengths are rounded up within groups of equal cardinality,
the few rounded sizes are packed by the configuration linear programme (column generation), actual lengths take
the places of rounded ones, and what is left, the small lengths last, goes in by best fit. The plan is a list of
runs of sequences with equal content; each piece finds its place from its rank among all pieces.

Bound of the plan: runs split at most once for each distinct length and slot, and a run that takes a smaller length
as often as it fits has less than half its room left, so it is used at most log2(capacity) times.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import materialize, ranked, slices, small_batches
from watchtide.llm.tokens import default_path, word_ids

CAPACITY, END_ID = 4096, 1
#: Groups of large lengths, and the shares of a sequence tried as the least large length; the best plan is taken.
GROUPS, LARGE = 32, (1 / 4, 1 / 3, 1 / 2)
#: Column generation ends when a new configuration's worth exceeds its cost by less than this.
WORTH = 5e-4
#: Rows numbered in one task at most, about.
RANK_ROWS = 50_000


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. A document's tokens are its ids and END_ID."""
    import pyarrow as pa

    path, end = path or default_path(), END_ID.to_bytes(4, "little")
    kind = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in slices(batches, 1):
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encoder.text(t) + end
                for p, b in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[b : b + 4 * capacity]
                    at.append(i), piece.append(p), start.append(b // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            encoder.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(pieces, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole parts of the configuration programme's optimum: ([how many of each size], times)."""
    k = len(sizes)
    if not k:
        return []
    a = np.diag([float(capacity // s) for s in sizes])
    inverse, b = np.linalg.inv(a), np.asarray(demand, float)
    size = np.asarray(sizes)
    most = capacity // min(sizes)
    for _ in range(60 * k):
        price = np.ones(k) @ inverse
        best, choice = np.zeros(capacity + 1), []
        for _step in range(most):  # best value of one more item, for every room
            gain = np.full(capacity + 1, -np.inf)
            pick = np.full(capacity + 1, -1)
            for g in np.flatnonzero(price > 1e-12):
                s = size[g]
                v = best[: capacity + 1 - s] + price[g]
                better = v > gain[s:]
                gain[s:][better] = v[better]
                pick[s:][better] = g
            keep = gain <= best + 1e-12
            gain[keep], pick[keep] = best[keep], -1
            if keep.all():
                break
            best = gain
            choice.append(pick)
        if best[capacity] <= 1 + WORTH:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(choice):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= size[pick[room]]
        x, d = inverse @ b, inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        a[:, out] = column
        inverse = np.linalg.inv(a)
    left, found = np.asarray(demand).copy(), []
    x = inverse @ b
    for j in np.argsort(-x, kind="stable"):
        column = a[:, j].astype(int)
        used = column > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            left -= times * column
            found.append((column.tolist(), times))
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The plan with fewest sequences over the choices of LARGE."""
    return min((_plan(histogram, capacity, groups, x) for x in LARGE), key=lambda found: found[1])


def _plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[np.ndarray, int]:
    """Placements (from, to, first sequence, pieces per sequence, offset, length) over ranks by descending length.

    Rank r in [from, to) goes to sequence first + (r - from) // per, at offset + ((r - from) % per) * length.
    Also the number of sequences.
    """
    lengths = sorted(histogram, reverse=True)
    starts = np.cumsum([0, *(histogram[x] for x in lengths)]).tolist()

    def length_at(rank: int) -> int:
        return int(np.searchsorted(starts, rank, side="right")) - 1

    big = sum(histogram[x] for x in lengths if x > large * capacity)
    edges = sorted({round(i * big / groups) for i in range(groups + 1)}) if big else [0]
    members: dict[int, list[list[int]]] = {}
    for lo, hi in zip(edges, edges[1:]):
        members.setdefault(lengths[length_at(lo)], []).append([lo, hi])
    sizes = list(members)
    span = [[m[0][0], m[-1][1]] for m in members.values()]  # neighbouring groups of one rounded size are one
    placed: list[tuple] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)
    bins = 0

    def give(residual: int, start: int, n: int) -> None:
        if n and residual:
            room[residual].append((start, n))
            has[residual] = True

    for column, times in configurations(sizes, [hi - lo for lo, hi in span], capacity):
        slots = []
        for g, n in enumerate(column):
            for _ in range(n):
                slots.append(span[g][0])
                span[g][0] += times
        breaks = {0, times}
        for s in slots:
            i = length_at(s)
            while starts[i + 1] < s + times:
                breaks.add(starts[i + 1] - s)
                i += 1
        points = sorted(breaks)
        for x, y in zip(points, points[1:]):
            fill = 0
            for s in slots:
                n = lengths[length_at(s + x)]
                placed.append((s + x, s + y, bins + x, 1, fill, n))
                fill += n
            give(capacity - fill, bins + x, y - x)
        bins += times
    rest = [tuple(s) for s in span if s[0] < s[1]] + [(big, starts[-1])]
    for lo, hi in rest:
        while lo < hi:
            i = length_at(lo)
            n, upto = lengths[i], min(hi, starts[i + 1])
            while lo < upto:
                need = upto - lo
                r = n + int(np.argmax(has[n:])) if has[n:].any() else 0
                if r:
                    start, count = room[r].pop()
                    has[r] = bool(room[r])
                else:
                    r, start, count = capacity, bins, -(-need // (capacity // n))
                    bins += count
                per = r // n
                whole = min(count, need // per)
                if whole:
                    placed.append((lo, lo + whole * per, start, per, capacity - r, n))
                    give(r - per * n, start, whole)
                    lo += whole * per
                if whole < count:
                    odd = min(upto - lo, per)  # the last sequence takes what is left of this length
                    if odd:
                        placed.append((lo, lo + odd, start + whole, odd, capacity - r, n))
                        give(r - odd * n, start + whole, 1)
                        lo += odd
                        whole += 1
                    give(r, start + whole, count - whole)
    return np.array(sorted(placed), np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (length from 1 to capacity), using as few sequences as the plan can.

    Offsets are gapless from 0 in each sequence. An empty table gives no rows.
    """
    import pyarrow as pa

    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table, _ = plan(histogram, capacity)
    before, total = np.zeros(capacity + 2, np.int64), 0
    for n in range(capacity, 0, -1):
        before[n] = total
        total += histogram.get(n, 0)
    rank = ranked(pieces, "length", [key, "piece", "start"], max(1, min(RANK_ROWS, total // 512)))
    plain = pieces.schema.fieldNames()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            at = before[n] + batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(table[:, 0], at, side="right") - 1] if len(at) else np.zeros((0, 6), np.int64)
            i = at - row[:, 0]
            sequence, offset = row[:, 2] + i // row[:, 3], row[:, 4] + i % row[:, 3] * row[:, 5]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(sequence), pa.array(offset)], names=[*plain, "sequence_id", "offset"])

    return rank.select(*plain, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one token. Only documents of more than `capacity` tokens are cut. Repeated
    rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):  # whole texts pass through Arrow
        pieces = materialize(cut(docs, capacity, path, key, text), "pieces")
    return pack(pieces, key, capacity)
