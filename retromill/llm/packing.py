"""Filling fixed-capacity containers with items (problem 7)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retromill.shared import materialize

#: items of one length are numbered in parts of about so many
PART = 50_000


def _bits(left: dict[int, int], spare: Counter) -> int:
    """The lengths that are still available once ``spare`` is set aside, as the bits of a number."""
    return sum(1 << n for n, c in left.items() if c > spare[n])


class Sums:
    """The pairs and triples of available lengths by their sum, each with its largest length first and those with the
    largest first before others. A sum is indexed when it is first asked for; lengths only ever run out, so what
    is no longer available is passed over once and for all."""

    def __init__(self, left: dict[int, int]):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.open: dict[tuple[int, int], list] = {}

    def pair(self, total: int) -> list[tuple[int, int]]:
        if total not in self.pairs:
            self.pairs[total] = [(a, total - a) for a in range(total - 1, (total - 1) // 2, -1) if a in self.left and total - a in self.left]
        return self.pairs[total]

    def combos(self, total: int, size: int) -> Iterator[tuple[int, ...]]:
        if size == 1:
            yield (total,)
        elif size == 2:
            yield from self.pair(total)
        else:
            for a in range(total - 2, (total - 1) // 3, -1):
                if a in self.left:
                    yield from ((a, b, c) for b, c in self.pair(total - a) if b <= a)

    def fill(self, n: int, gap: int, size: int) -> tuple[int, ...] | None:
        """The first combination of ``size`` lengths that fills ``gap`` exactly beside one of length ``n``. The
        containers are equal, so a gap belongs to one ``n``."""
        if (gap, size) not in self.open:
            combos = self.combos(gap, size)
            self.open[gap, size] = [combos, next(combos, None)]
        state = self.open[gap, size]
        while state[1] is not None:
            need = Counter((n, *state[1]))
            if all(self.left.get(x, 0) >= k for x, k in need.items()):
                return state[1]
            state[1] = next(state[0], None)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """How to fill containers: (how many, lengths in each), from the number of items of each length.

    Single lengths, pairs and triples are indexed by their sums (:class:`Sums`); the
    lengths, largest first, take combinations that fill their gap exactly, as often as all their
    lengths are available. What is left is put together by best fit. Lengths above half the capacity,
    of which each needs its own container, go through both before the others, or the small ones that
    they need would be gone. A step uses up at least one
    length, so there are at most as many steps as lengths, however many items there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    steps: list[tuple[int, tuple[int, ...]]] = []
    index = Sums(left)

    def use(combo: list[int]) -> None:
        need = Counter(combo)
        times = min(left[n] // k for n, k in need.items())
        steps.append((times, tuple(combo)))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]

    def best_fit(n: int) -> list[int]:
        combo, gap = [n], capacity - n
        while True:
            fit = _bits(left, Counter(combo)) & ((1 << (gap + 1)) - 1)
            if not fit:
                return combo
            combo.append(fit.bit_length() - 1)
            gap -= combo[-1]

    for floor in (capacity // 2, 0):
        for depth in (0, 1, 2, 3):
            for n in sorted((n for n in left if n > floor), reverse=True):
                while n in left:
                    rest = [] if depth == 0 else index.fill(n, capacity - n, depth) if capacity - n >= depth else None
                    if rest is None or depth == 0 and n != capacity:
                        break
                    use([n, *rest])
        while left and (n := max(left)) > floor:
            use(best_fit(n))
    return steps


def pack(sizes: DataFrame, item: str, size: str, capacity: int = 2048) -> DataFrame:
    """``item``, ``piece``, ``n_tokens``, ``container_id``: each item in one container, none filled
    beyond ``capacity``, and no item cut unless it alone exceeds it; such an item is cut into pieces
    of the whole capacity and the rest.

    Exact-complement hashing: only the number of items of each length, at most ``capacity`` numbers,
    goes to the driver, which plans on them (:func:`plan`). The items of each length are numbered
    over all tasks: each (length, part by hash) is numbered by itself, and a prefix sum over the
    sizes of the parts gives where its numbers begin, so a length that very many items have is
    spread. The number then says the step of the plan and the container.

    Items of null or no size take no room and have no row. ``item`` must be unique; a null is an item
    like others. No items give no rows.
    """
    spark = sizes.sparkSession
    whole = sizes.select(F.col(item).alias("item"), F.col(size).cast("long").alias("n")).where("n > 0")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")), lambda i: F.struct(i.alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n") - i.cast("long") * capacity).alias("n_tokens")))
    items, facts = materialize(whole.select("item", F.explode(cut).alias("x")).select("item", "x.piece", F.col("x.n_tokens").cast("int").alias("n_tokens")), F.count(F.lit(1)).alias("n"))
    parts = 1 + facts["n"] // PART
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)).cast("int"))
    counts, _ = materialize(items.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("c")))
    by_length = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    begin = counts.select("n_tokens", "part", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("c")).alias("before"))
    rows, used, first = [], Counter(), 0
    for times, combo in plan(by_length, capacity):
        for n, k in Counter(combo).items():
            rows.append((n, used[n], used[n] + times * k, k, first))
            used[n] += times * k
        first += times
    steps = spark.createDataFrame(rows, "n_tokens int, lo long, hi long, k long, first long")
    order = Window.partitionBy("n_tokens", "part").orderBy("item", "piece")
    numbered = items.withColumn("i", F.row_number().over(order)).join(begin, ["n_tokens", "part"]).withColumn("i", F.col("i") - 1 + F.col("before"))
    placed = numbered.join(F.broadcast(steps), "n_tokens").where("i >= lo and i < hi")
    return placed.select(F.col("item").alias(item), "piece", F.col("n_tokens").cast("long").alias("n_tokens"), F.expr("first + (i - lo) div k").alias("container_id"))
