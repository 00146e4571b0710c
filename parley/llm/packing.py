"""Filling containers of fixed capacity (problem 8): bin completion branch-and-bound over the histogram of sizes.

Items of one size are alike, so everything runs over how many items there are of each size: an array as long as the
capacity, however many documents. Three steps, each only while the best packing is above the lower bound (the sum of
sizes, and the bound for items of more than half a container and those that can't join them):

1. Best fit, largest items first, is the first incumbent. Equal containers are kept as one filling with a count.
2. Fillings around the largest item left, the fullest first, each used as often as the counts allow: a second incumbent
   from few fillings.
3. Branch and bound over containers. Around the largest item left every undominated filling is a branch, the fullest
   first: a filling is dominated if items of it could be replaced by one larger item that is left. A branch ends where
   its waste and the bound for what is left reach the incumbent. Where no waste is left to give away, all containers
   must be full, and the item with the fewest full fillings is branched on instead of the largest.

The search is exact if it ends by itself; ``steps`` limits it, None lets it run to the proven optimum. A document finds
its container from its rank among documents of its size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from . import tokens
from .corpora import load

#: Groups into which the documents of one size are divided for ranking, so that a size that a third of all documents
#: share is ranked by that many tasks.
SALTS = 256
#: Elementary steps of the branch and bound for each capacity, None for no limit: with one, the packing may stay above the optimum.
STEPS: int | None = 1_000_000
#: Steps in which one filling of the second incumbent is sought; it only has to be good, since the search is what decides.
FILLING = 2000
#: Most rows of the table of capacities.
CAPACITIES = 1000

Fills = list[tuple[int, list[int]]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The fewest containers that any packing needs: the greatest of the bounds of Martello and Toth over all thresholds."""
    sizes = sorted(counts)
    number, total = [0], [0]
    for s in sizes:
        number.append(number[-1] + counts[s])
        total.append(total[-1] + s * counts[s])
    half = bisect_right(sizes, capacity // 2)
    best = -(-total[-1] // capacity)
    for k in [0, *(s for s in sizes[:half])]:
        large = bisect_right(sizes, capacity - k)
        middle_n, middle = number[large] - number[half], total[large] - total[half]
        low = bisect_left(sizes, k)
        free = middle_n * capacity - middle
        best = max(best, number[-1] - number[half] + max(0, -(-(total[half] - total[low] - free) // capacity)) if large >= half else 0)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Fills:
    """The packing of best fit, largest sizes first; a container takes items of a size until none fits, as item by item."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # room -> (how many containers, what is in each)
    rooms: list[int] = []

    def put(room: int, times: int, fill: list[int]) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((times, fill))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                room, times, fill = capacity, left, []
            else:
                room = rooms[at]
                times, fill = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // s
            full = min(times, left // each)
            if full:
                put(room - full_size if (full_size := each * s) else room, full, fill + [s] * each)
            left -= full * each
            rest = left if full < times and left < each else 0
            if rest:
                put(room - rest * s, 1, fill + [s] * rest)
                left = 0
            if fill and times > full + (rest > 0):
                put(room, times - full - (rest > 0), fill)
    return [f for fills in open_.values() for f in fills]


def completions(sizes: list[int], counts: dict[int, int], room: int, waste: int, left: list[int] | None = None) -> list[list[int]]:
    """The undominated fillings of ``room`` with at most ``waste`` left over, the fullest first, with fewer items first.

    ``sizes`` ascends. ``left`` holds the steps that may still be taken, and loses those that are; with none left the
    enumeration ends, and what was found by then is returned.
    """
    out: list[tuple[int, list[int]]] = []
    below = [0]
    for s in sizes:
        below.append(below[-1] + s * counts[s])
    stack: list[tuple[int, int, list[int]]] = [(room, len(sizes), [])]
    while stack and (left is None or left[0] > 0):
        free, at, chosen = stack.pop()
        if left is not None:
            left[0] -= 1
        at = min(at, bisect_right(sizes, free))
        if free - below[at] > waste:
            continue  # all smaller items together can't fill it
        if at == 0:
            out.append((free, chosen))
            continue
        s = sizes[at - 1]
        for k in range(min(counts[s], free // s) + 1):
            stack.append((free - k * s, at - 1, chosen + [s] * k))
    kept = [(f, c) for f, c in out if not dominated(c, f, sizes, counts)]
    return [c for _, c in sorted(kept, key=lambda x: (x[0], len(x[1])))]


def dominated(chosen: list[int], free: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether some items of a filling could be replaced by one item that is left, larger than they are together and within the room."""
    if not free and len(chosen) < 2:
        return False
    sums = {0}
    for c in chosen:
        sums |= {x + c for x in sums}
        if len(sums) > 4096:  # so many small items: not worth the test, the filling is kept
            return False
    for t in sums:
        at = bisect_right(sizes, t + free)
        while at and sizes[at - 1] > t:
            y = sizes[at - 1]
            if counts[y] > chosen.count(y) and (free or t):
                return True
            at -= 1
        if t and at and sizes[at - 1] == t and counts[t] > chosen.count(t) and chosen.count(t) == 0:
            return True  # one item in place of several of the same sum
    return False


def branch(counts: dict[int, int], capacity: int, bound: int, best: Fills, steps: int | None) -> Fills:
    """A packing of fewer containers than ``best`` by branch and bound, or the best there is when the steps are used up.

    A branch is a filling and how often it is used, the most first, so the way down to a packing is as long as there are
    different fillings, however many items there are. A filling does not follow itself: that is the branch of once more.
    """
    counts = {s: n for s, n in counts.items() if n}
    used, items = sum(t for t, _ in best), sum(counts.values())
    left = None if steps is None else [steps]
    path: Fills = []
    depth = 0  # containers of the path

    def options() -> Iterator[tuple[int, list[int]]]:
        now = {s: n for s, n in counts.items() if n}
        sizes = sorted(now)
        if left:
            left[0] -= len(sizes)
        spare = (used - 1 - depth) * capacity - sum(s * n for s, n in now.items())  # waste that a better packing can have
        if spare < 0 or depth + lower_bound(now, capacity) >= used:
            return iter(())
        fewest: list[list[int]] | None = None
        for x in reversed(sizes) if not spare else sizes[-1:]:
            now[x] -= 1
            mine = [[x, *c] for c in completions([s for s in sizes if now[s]], now, capacity - x, spare, left)]
            now[x] += 1
            if fewest is None or len(mine) < len(fewest):
                fewest = mine
                if len(mine) < 2:
                    break
        last = sorted(path[-1][1]) if path else None
        usable = [(f, min(now[s] // f.count(s) for s in f)) for f in fewest or () if sorted(f) != last]
        return ((t, f) for f, most in usable for t in range(most, 0, -1))

    stack = [options()]
    while stack and used > bound and (left is None or left[0] > 0):
        branch_ = next(stack[-1], None)
        if branch_ is None:
            stack.pop()
            if path:
                times, gone = path.pop()
                depth -= times
                items += times * len(gone)
                for s in gone:
                    counts[s] += times
            continue
        times, fill = branch_
        path.append(branch_)
        depth += times
        items -= times * len(fill)
        for s in fill:
            counts[s] -= times
        if not items and depth < used:
            best, used = list(path), depth
        stack.append(options())
    return best


def repeated(counts: dict[int, int], capacity: int) -> Fills:
    """A packing by the fullest filling around the largest item left, used as often as the counts allow."""
    counts, fills = dict(counts), []
    while counts:
        top = max(counts)
        counts[top] -= 1
        stock = sorted(s for s, n in counts.items() if n)
        room, fill = capacity - top, [top]
        found = None
        for waste in (0, max(1, stock[0] - 1 if stock else 1), capacity):
            found = next(iter(completions(stock, counts, room, waste, [FILLING])), None)
            if found is not None:
                break
        counts[top] += 1
        fill += found or []
        need = {s: fill.count(s) for s in set(fill)}
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= times * n
            if not counts[s]:
                del counts[s]
        fills.append((times, fill))
    return fills


def plan(histogram: dict[int, int], capacity: int, steps: int | None = STEPS) -> Fills:
    """Fillings (how often, sizes) of a packing of ``histogram`` (size -> count), sizes being 1 to ``capacity``.

    Runs on the driver over at most ``capacity`` numbers.
    """
    counts = {int(s): int(n) for s, n in histogram.items() if n > 0}
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    if sum(t for t, _ in best) > bound:
        best = min(best, repeated(counts, capacity), key=lambda f: sum(t for t, _ in f))
    if sum(t for t, _ in best) > bound:
        best = branch(counts, capacity, bound, best, steps)
    return best


def segments(fills: list[tuple[int, list[int]]], first: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each size: (first rank, items per container, first container) in order of ranks; containers count from ``first``."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for times, fill in fills:
        for s in set(fill):
            need = fill.count(s)
            out.setdefault(s, []).append((ranks.get(s, 0), need, first))
            ranks[s] = ranks.get(s, 0) + need * times
        first += times
    return out


def pack(documents: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(container, container_no, doc_id, piece, tokens) for each capacity (container, capacity) over ``documents`` (doc_id, tokens).

    A document larger than the capacity is cut into full pieces, each a container of its own, and a rest that is packed
    like any other item. Documents without tokens (null or empty texts) need no container: container_no is null. Equal
    sizes are placed in order of doc_id within their group. A repeated doc_id is an item each time.
    """
    spark = documents.sparkSession
    limits = [(c, int(n)) for c, n in limits if c is not None and n is not None and n > 0]
    if not limits:
        return spark.createDataFrame([], "container string, container_no long, doc_id long, piece int, tokens long")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity")) for c, n in limits)))
    rows = documents.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("size"), each.alias("c")).select("doc_id", "size", "c.*")
    whole = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0)
    rows = rows.withColumn("full", whole.cast("int")).withColumn("rest", F.col("size") - F.col("full") * F.col("capacity"))
    items = rows.where("rest > 0").select("container", "capacity", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))

    key = ["container", "tokens"]
    counts = cut(items.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("rank", within).join(offsets, [*key, "salt"]).select("container", "doc_id", "piece", "tokens", (F.col("rank") + F.col("before")).alias("rank"))

    histogram: dict[str, dict[int, int]] = {c: {} for c, _ in limits}
    for r in counts.groupBy(*key).agg(F.sum("n").alias("n")).toLocalIterator():  # at most the sum of the capacities
        histogram[r["container"]][int(r["tokens"])] = int(r["n"])
    tables, sums = {}, {}
    for c, n in limits:
        fills = plan(histogram[c], n)
        tables[c], sums[c] = segments(fills, 0), sum(t for t, _ in fills)
    shared = spark.sparkContext.broadcast({c: {s: tuple(np.array(x) for x in zip(*seg)) for s, seg in t.items()} for c, t in tables.items()})

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names, s, r = batch.column("container").to_pylist(), batch.column("tokens").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            code = {n: k for k, n in enumerate(dict.fromkeys(names))}
            c = np.fromiter((code[n] for n in names), np.int64, len(names))
            out = np.empty(len(c), np.int64)
            order = np.lexsort((s, c))
            starts = np.flatnonzero(np.diff(c[order], prepend=-1) | np.diff(s[order], prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(order)]):  # one size of one capacity at a time
                rows = order[at:end]
                start, need, first = shared.value[names[rows[0]]][int(s[rows[0]])]
                j = np.searchsorted(start, r[rows], side="right") - 1
                out[rows] = first[j] + (r[rows] - start[j]) // need[j]
            yield pa.RecordBatch.from_arrays([batch.column("container"), pa.array(out), *(batch.column(x) for x in ("doc_id", "piece", "tokens"))], ["container", "container_no", "doc_id", "piece", "tokens"])

    schema = "container string, container_no long, doc_id long, piece int, tokens long"
    placed = ranked.mapInArrow(place, schema)

    # full pieces come after the packed containers, numbered by group and document in the same way
    pieces = rows.where("full > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    per = pieces.groupBy("container", "salt").agg(F.sum("full").alias("n"))
    ahead = Window.partitionBy("container").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("container", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("container", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.element_at(F.create_map(*(F.lit(x) for kv in sums.items() for x in kv)), F.col("container"))
    numbered = pieces.withColumn("own", F.coalesce(F.sum("full").over(own), F.lit(0))).join(base, ["container", "salt"])
    cut_up = numbered.select("container", "capacity", "doc_id", (first + F.col("ahead") + F.col("own")).alias("start"), F.posexplode(F.array_repeat(F.lit(0), F.col("full"))).alias("piece", "_"))
    whole_pieces = cut_up.select("container", (F.col("start") + F.col("piece")).cast("long").alias("container_no"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    nothing = rows.where("size = 0").select("container", F.lit(None).cast("long").alias("container_no"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("tokens"))
    return placed.unionByName(whole_pieces).unionByName(nothing)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sizes(load(spark, sf_dir, "documents").select("doc_id", "text"))


def limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The table of capacities, which is small by its nature; more than CAPACITIES rows are refused."""
    rows = load(spark, sf_dir, "pack_limits").select("container", "capacity_tokens").limit(CAPACITIES + 1).collect()
    if len(rows) > CAPACITIES:
        raise ValueError(f"more than {CAPACITIES} capacities")
    return sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_packing: (container, container_no, doc_id, piece, tokens) of every document or piece for each capacity."""
    return pack(cut(documents(spark, sf_dir)), limits(spark, sf_dir))


def unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_unused: per capacity its containers, the fewest possible, and the unused share."""
    caps = limits(spark, sf_dir)
    capacity = F.element_at(F.create_map(*(F.lit(x) for kv in caps for x in kv)), F.col("container"))
    rows = packing(spark, sf_dir).where("container_no is not null")
    out = rows.groupBy("container").agg((F.max("container_no") + 1).alias("containers"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return out.select("container", capacity.alias("capacity"), "items", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("fewest_possible"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
