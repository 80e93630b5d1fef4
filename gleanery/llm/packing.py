"""Packing the rows of each table into chunks of fixed capacity by a grouping genetic algorithm.

An individual is a set of bins.  Crossover injects well-filled bins of one parent into
the other, drops the bins that share rows with them, and puts the displaced rows back by
best fit.  Populations live on islands (rows of a DataFrame, several per block of rows)
and send their elites to the next island between epochs.  Blocks whose first packing
already meets a lower bound need no evolution.  A table of more rows than a block holds
is spread over many blocks; the badly filled bins of its blocks are packed again together.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.storage import shared_table

CAPACITY = 1200
#: Most rows of a block on average, islands per block, members of a population, generations between migrations, migrations.
BLOCK, ISLANDS, MEMBERS, GENERATIONS, EPOCHS = 512, 3, 8, 10, 2
#: Bins of a table of several blocks that are filled less than this are packed again, so many times.
FULL, LEVELS = 0.97, 2
KEYS = ["file_name", "table_id"]


# --- one block, plain Python; a row of n characters takes n + 1 of capacity + 1, for the line break between rows


def lower_bound(sizes: list[int], cap: int) -> int:
    """A number of bins that no packing can go below: the best of the sum bound and of bounds by large items."""
    total = sum(sizes)
    best = -(-total // cap)
    ordered = sorted(sizes)
    n = len(ordered)
    for k in sorted({s for s in ordered if s <= cap // 2})[:200] or [0]:
        big = n - bisect_left(ordered, cap - k + 1)
        half = n - bisect_left(ordered, cap // 2 + 1) - big
        mid = sum(ordered[bisect_left(ordered, k) : n - big])
        best = max(best, big + half + max(0, -(-(mid - half * cap) // cap)))
    return best


def best_fit(items: list[int], sizes: list[int], cap: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put the items, largest first, each into the bin where it leaves least room."""
    bins = bins if bins is not None else []
    room = sorted((cap - sum(sizes[i] for i in b), j) for j, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, j = room.pop(at)
            bins[j].append(i)
            insort(room, (free - sizes[i], j))
        else:
            bins.append([i])
            insort(room, (cap - sizes[i], len(bins) - 1))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins (mean of squared fill)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / cap) ** 2 for b in bins) / max(1, len(bins))


def inject(a: list[list[int]], b: list[list[int]], sizes: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """Crossover: well-filled bins of ``b`` enter ``a``; rows they displace are put back by exchange and best fit."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    chosen = [x for x in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    taken = {i for x in chosen for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    bins = [list(x) for x in chosen] + kept
    return best_fit(_exchange(bins, loose, sizes, cap), sizes, cap, bins)


def _exchange(bins: list[list[int]], loose: list[int], sizes: list[int], cap: int) -> list[int]:
    """Swap a loose row for one or two smaller rows of a bin where that fills the bin better; returns what is loose then."""
    free = [cap - sum(sizes[j] for j in b) for b in bins]
    open_ = [k for k, f in enumerate(free) if f]
    out = []
    for i in sorted(loose, key=lambda i: -sizes[i]):
        n = sizes[i]
        for k in open_:
            low = n - free[k]
            swap = max((j for j in bins[k] if low <= sizes[j] < n), key=lambda j: sizes[j], default=None)
            if swap is not None:
                b = bins[k]
                b[b.index(swap)] = i
                free[k] -= n - sizes[swap]
                if not free[k]:
                    open_.remove(k)
                out.append(swap)
                break
        else:
            out.append(i)
    return out


def mutate(bins: list[list[int]], sizes: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the emptiest bin and a few others, and put their rows back."""
    if len(bins) < 2:
        return bins
    order = sorted(range(len(bins)), key=lambda j: sum(sizes[i] for i in bins[j]))
    gone = {order[0], *rng.sample(order, min(len(order), max(1, len(order) // 8)))}
    loose = [i for j in gone for i in bins[j]]
    rest = [list(b) for j, b in enumerate(bins) if j not in gone]
    return best_fit(_exchange(rest, loose, sizes, cap), sizes, cap, rest)


def evolve(population: list[list[list[int]]], sizes: list[int], cap: int, bound: int, seed: int, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """Some generations of one island; stops early at the lower bound.  The fittest come first."""
    rng = random.Random(seed)
    items = list(range(len(sizes)))
    score = lambda p: fitness(p, sizes, cap)
    while len(population) < MEMBERS:  # first-fit of shuffled rows
        order = items[:]
        rng.shuffle(order)
        cut = rng.randrange(len(order) + 1)
        population.append(best_fit(order[cut:], sizes, cap, best_fit(order[:cut], sizes, cap)))
    population.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        half = max(2, len(population) // 2)
        children = []
        for _ in range(len(population) - half + 1):
            a, b = rng.sample(population[:half], 2)
            child = inject(a, b, sizes, cap, rng)
            children.append(mutate(child, sizes, cap, rng) if rng.random() < 0.4 else child)
        population = sorted(population[:half] + children, key=score, reverse=True)[:MEMBERS]
    return population


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for j, b in enumerate(bins):
        for i in b:
            out[i] = j
    return out


def _bins(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, j in enumerate(flat):
        out[j].append(i)
    return [b for b in out if b]


# --- over DataFrames


def cut_rows(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(file_name, table_id, row_id, row_index, n_chars, piece_no, start, size): rows, those over ``capacity`` in pieces.

    Pieces end at the last natural boundary in the last quarter of the capacity (line,
    sentence, word), else at the capacity.  Null and empty texts are one piece of size 0.
    """
    schema = "file_name string, table_id string, row_id bigint, row_index int, n_chars int, piece_no int, start int, size int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f, t, r, x, text in frame.itertuples(index=False):
                for no, (a, z) in enumerate(cuts(text, capacity), 1):
                    out.append((f, t, r, x, len(text), no, a, z - a))
            yield pd.DataFrame(out, columns=["file_name", "table_id", "row_id", "row_index", "n_chars", "piece_no", "start", "size"]).astype({"row_index": "Int32"})

    length = F.coalesce(F.length("_rag_row_text"), F.lit(0))
    base = rows.select(*KEYS, "row_id", "row_index", "_rag_row_text")
    short = base.where(length <= capacity).select(*KEYS, "row_id", "row_index", length.alias("n_chars"), F.lit(1).alias("piece_no"), F.lit(0).alias("start"), length.alias("size"))
    return short.unionByName(base.where(length > capacity).mapInPandas(run, schema))


def cuts(text: str, capacity: int) -> list[tuple[int, int]]:
    """The pieces of one over-long text."""
    out, a, n = [], 0, len(text)
    while n - a > capacity:
        low, high = a + capacity * 3 // 4, a + capacity
        z = high
        for mark in ("\n", ". ", "다. ", " "):
            at = text.rfind(mark, low, high)
            if at >= 0:
                z = at + len(mark)
                break
        z = min(z, high)
        out.append((a, z))
        a = z
    out.append((a, n))
    return out


_STATE = "file_name string, table_id string, block int, ids array<bigint>, sizes array<int>, bound int, bins array<int>"


def _seed(items: DataFrame, capacity: int) -> DataFrame:
    """One row per block with its best-fit packing and lower bound."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(key, ids, sizes):
            bins = best_fit(list(range(len(sizes))), sizes, capacity + 1)
            return (*key, ids, sizes, lower_bound(sizes, capacity + 1), _flat(bins, len(sizes)))

        key, ids, sizes, out = None, [], [], []
        names = [c.split()[0] for c in _STATE.split(", ")]
        for frame in frames:  # sorted by block; a block may run over two frames
            frame = frame.astype(object).where(frame.notna(), None)
            for f, t, b, r, s in frame.itertuples(index=False):
                if (f, t, b) != key:
                    if ids:
                        out.append(done(key, ids, sizes))
                    key, ids, sizes = (f, t, b), [], []
                ids.append(int(r))
                sizes.append(int(s) + 1)
            if len(out) > 500:
                yield pd.DataFrame(out, columns=names)
                out = []
        if ids:
            out.append(done(key, ids, sizes))
        if out:
            yield pd.DataFrame(out, columns=names)

    cols = [*KEYS, "block"]
    ordered = items.repartition(*cols).sortWithinPartitions(*cols, "row_id", "piece_no", "item")
    return ordered.select(*cols, "item", "size").mapInPandas(pack, _STATE)


def _islands(hard: DataFrame, capacity: int, epochs: int) -> DataFrame:
    """The hard blocks after evolution on ISLANDS islands with migration of elites."""
    names = [c.split()[0] for c in _STATE.split(", ")]

    def step(epoch: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    sizes = [int(s) for s in row.sizes]
                    first = [_bins([int(x) for x in e]) for e in row.elites]
                    best = evolve(first, sizes, capacity + 1, int(row.bound), hash((epoch, int(row.island), len(sizes), sum(sizes))) & 0x7FFFFFFF)
                    out.append((row.file_name, row.table_id, row.block, row.ids, row.sizes, row.bound, row.island, [_flat(p, len(sizes)) for p in best[:2]]))
                yield pd.DataFrame(out, columns=[*names[:-1], "island", "elites"])

        return run

    schema = _STATE.replace("bins array<int>", "island int, elites array<array<int>>")
    state = hard.withColumn("elites", F.array("bins")).drop("bins").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    spark = hard.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # few bytes, much work: not to be coalesced
    for epoch in range(epochs):
        state = state.repartition(tasks, *KEYS, "block", "island").mapInPandas(step(epoch), schema)
        if epoch < epochs - 1:  # each island sends its best to the next one
            state = shared_table(state)
            sent = state.select(*KEYS, "block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elites", 1, 1).alias("came"))
            a, b = state.alias("a"), sent.alias("b")
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEYS, "block", "island")]
            state = a.join(b, same[0] & same[1] & same[2] & same[3]).select(*[f"a.{c}" for c in (*names[:-1], "island")], F.concat("a.elites", "b.came").alias("elites"))
    best = state.withColumn("bins", F.col("elites")[0]).withColumn("n", F.array_max("bins"))
    ranked = best.groupBy(*KEYS, "block").agg(F.min_by(F.struct("ids", "sizes", "bound", "bins"), F.struct("n", "island")).alias("x"))
    return ranked.select(*KEYS, "block", "x.*")


def _level(items: DataFrame, level: int, capacity: int, block: int, epochs: int) -> DataFrame:
    """Pack all items once: (item, chunk_id)."""
    counts = items.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)  # large tables only: few, and a join either way
    large = counts.select(*[F.col(k).alias(f"l_{k}") for k in KEYS], F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    match = F.col("file_name").eqNullSafe(F.col("l_file_name")) & F.col("table_id").eqNullSafe(F.col("l_table_id"))
    spread = items.join(large, match, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("row_id", "piece_no"), F.col("blocks")).cast("int"))
    seeded = shared_table(_seed(spread, capacity))
    n = F.array_max("bins") + 1
    hard = seeded.where(n > F.col("bound"))
    done = seeded.where(n <= F.col("bound")).unionByName(_islands(hard, capacity, epochs))
    flat = done.select(*KEYS, "block", F.explode(F.arrays_zip("ids", "bins")).alias("x"))
    chunk = F.concat_ws(".", F.lit(str(level)), F.col("block").cast("string"), F.col("x.bins").cast("string"))
    return flat.select(chunk.alias("chunk_id"), F.col("x.ids").alias("item"))


def packed(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """Every piece of every row with its chunk: file_name, table_id, row_id, row_index, n_chars, piece_no, start, size, chunk_id.

    A chunk holds rows of one table, at most ``capacity`` characters with the line breaks
    between them; its rows are read in the order of row_index (nulls first), row_id,
    piece_no.  ``chunk_id`` is unique in its table.  Rows that were parsed twice are two
    rows.  Null and empty texts have no chunk; rows with null file_name or table_id form
    tables of their own; extra columns are ignored.
    """
    items = shared_table(cut_rows(rows, capacity).withColumn("item", F.monotonically_increasing_id()))
    full = items.where("size > 0").select(*KEYS, "item", "row_id", "piece_no", "size")
    placed = full.join(_level(full, 0, capacity, block, epochs), "item")
    placed = shared_table(placed)
    out = placed
    for level in range(1, LEVELS):  # the badly filled bins of tables of several blocks, together
        fills = placed.groupBy(*KEYS, "chunk_id").agg((F.sum("size") + F.count(F.lit(1)) - 1).alias("fill"))
        tables = fills.groupBy(*KEYS).agg(F.countDistinct(F.substring_index("chunk_id", ".", 2)).alias("b"), F.count(F.lit(1)).alias("c")).where("b > 1 AND c > 1").select(*[F.col(k).alias(f"l_{k}") for k in KEYS])
        match = F.col("file_name").eqNullSafe(F.col("l_file_name")) & F.col("table_id").eqNullSafe(F.col("l_table_id"))
        bad = fills.where(F.col("fill") < FULL * capacity).join(tables, match, "left_semi").select(*[F.col(k).alias(f"b_{k}") for k in KEYS], F.col("chunk_id").alias("b_chunk"))
        hit = F.col("file_name").eqNullSafe(F.col("b_file_name")) & F.col("table_id").eqNullSafe(F.col("b_table_id")) & (F.col("chunk_id") == F.col("b_chunk"))
        bad = shared_table(bad)
        again = placed.join(bad, hit, "left_semi").drop("chunk_id")
        placed = shared_table(again.join(_level(again, level, capacity, block, epochs), "item"))
        out = out.join(bad, hit, "left_anti").unionByName(placed)
    return items.join(out.select("item", "chunk_id"), "item", "left").select(*KEYS, "row_id", "row_index", "n_chars", "piece_no", "start", "size", "chunk_id")


def chunk_texts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(file_name, table_id, chunk_id, n_rows, n_chars, text): the chunks written out.  A chunk's rows are bounded by its capacity."""
    texts = rows.select("row_id", "_rag_row_text").dropDuplicates(["row_id"])
    parts = placed.where("chunk_id IS NOT NULL").join(texts, "row_id")
    piece = F.expr("substring(_rag_row_text, start + 1, size)")
    ordered = F.array_sort(F.collect_list(F.struct("row_index", "row_id", "piece_no", piece.alias("piece"))))
    made = parts.groupBy(*KEYS, "chunk_id").agg(ordered.alias("x"))
    text = F.array_join(F.col("x.piece"), "\n")
    return made.select(*KEYS, "chunk_id", F.size("x").cast("bigint").alias("n_rows"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"))
