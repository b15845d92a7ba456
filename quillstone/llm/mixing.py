"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). A flow routes words of
each pattern to the sources' quotas; a second use of the same words costs more than the first, so
repetition is the last resort. Documents of a pattern are then laid out in seeded order and those
within the pattern's flow are taken; of those that come next, some fill what is left as nearly as can be.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, documents, n_words, unit, whole_row

#: Weights of the sources in code point order, repeating; what the mix takes of all words; most uses of a word.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Cells of the seeded order that each pattern is split into, so that no group is summed in one task; documents that may fill the rest of a pattern's flow;
#: words up to which that rest is filled to the word, beyond it in steps.
CELLS, FILLERS, STEPS = 4096, 64, 1 << 16


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above `most` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit_share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit_share * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit_share * weight[s] for s in open_})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _cheapest(supply: dict, members: dict, wanted: dict, repeats: int) -> dict:
    """(pattern, source) -> words: cheapest augmenting paths while any is left. The r-th use costs r."""
    arcs, at = [], defaultdict(list)  # arc: [to, room, cost]; its reverse is its neighbour

    def arc(a, b, room, cost):
        at[a].append(len(arcs))
        arcs.append([b, room, cost])
        at[b].append(len(arcs))
        arcs.append([a, 0.0, -cost])

    for p, size in supply.items():
        for r in range(repeats):
            arc("in", ("p", p), float(size), r)
        for s in members[p]:
            arc(("p", p), ("s", s), float("inf"), 0)
    for s, w in wanted.items():
        arc(("s", s), "out", float(w), 0)
    while True:
        cost, via, queue = {"in": 0}, {}, deque(["in"])
        while queue:
            a = queue.popleft()
            for i in at[a]:
                b, room, c = arcs[i]
                if room > 1e-6 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, i
                    queue.append(b)
        if "out" not in cost:
            break
        path, b = [], "out"
        while b != "in":
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        flow = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= flow
            arcs[i ^ 1][1] += flow
    return {(p, arcs[i][0][1]): arcs[i ^ 1][1] for p in supply for i in at[("p", p)] if i % 2 == 0}


def route(supply: dict[tuple, int], wanted: dict[str | None, float], repeats: int = REPEATS) -> dict[tuple, dict[str | None, float]]:
    """Pattern -> source -> words, by the cheapest flow. Patterns that share no source are routed apart."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in supply:
        for s in p:
            parent[find(("s", s))] = find(("p", p))
    groups = defaultdict(list)
    for p in supply:
        groups[find(("p", p))].append(p)
    out: dict = {}
    for patterns in groups.values():
        sources = {s for p in patterns for s in p}
        flow = _cheapest({p: supply[p] for p in patterns}, {p: list(p) for p in patterns}, {s: wanted.get(s, 0.0) for s in sources}, repeats)
        for p in patterns:
            out[p] = {s: flow.get((p, s), 0.0) for s in p}
    return out


def fill(left: float, sizes: list[int]) -> list[int]:
    """Which of the sizes (by place) add up nearest to what is left; of equals, the smaller sum, made of the earliest."""
    step = max(1, int(left) // STEPS)
    scaled = [round(x / step) for x in sizes]
    sums, seen = [1], 1  # bit s of the i-th number: s is a sum of some of the first i sizes
    for x in scaled:
        seen |= seen << x
        seen &= (1 << 2 * int(left / step) + 3) - 1
        sums.append(seen)
    goal, best = left / step, 0
    for away in range(int(goal) + 2):
        near = [s for s in (int(goal) - away, int(goal) + 1 + away) if s >= 0 and seen >> s & 1]
        if near:
            best = min(near, key=lambda s: (abs(s - goal), s))
            break
    chosen = []
    for i in range(len(scaled), 0, -1):
        if not sums[i - 1] >> best & 1:
            chosen.append(i - 1)
            best -= scaled[i - 1]
    return chosen[::-1]


def mix(docs: DataFrame, sources: str = "sources", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, size, pattern, text_key, taken and uses (the source of each use) for every row of docs (doc_id, text, sources array).

    A null text has size 0; a null or empty array means the null source; repeated rows count each and ties in
    the seeded order fall by id, size and text hash; an empty table gives none. Other columns are not read. The driver holds a row for
    each mixture of sources that occurs, and FILLERS documents of each.
    """
    spark = docs.sparkSession
    member = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    u = unit("doc_id", seed=seed)
    rows = cut(
        docs.select(
            "doc_id", n_words(F.col("text")).alias("size"), member.alias("pattern"), F.xxhash64("text").alias("text_key"),
            u.alias("u"), F.floor(u * CELLS).cast("int").alias("cell"),
        )
    )
    cells = cut(rows.groupBy("pattern", "cell").agg(F.sum("size").alias("words")))
    supply = {tuple(r.pattern): r.s for r in cells.groupBy("pattern").agg(F.sum("words").alias("s")).collect()}  # as many as there are mixtures of sources
    sizes: dict = defaultdict(int)
    for p, s in supply.items():
        for source in p:
            sizes[source] += s
    wanted = targets(sizes, weights, share, repeats)
    flows = route(supply, wanted, repeats)
    plan = []
    for p, s in supply.items():
        ends, run = [], 0.0
        for source in p:
            run += flows[p][source]
            ends.append(run)
        plan.append((list(p), int(s), ends, [int(sizes[x]) for x in p], [float(wanted[x]) for x in p]))
    plan_df = spark.createDataFrame(plan, "pattern array<string>, supply long, ends array<double>, source_sizes array<long>, targets array<double>")
    before = F.sum("words").over(W.partitionBy("pattern").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("pattern", "cell", F.coalesce(before, F.lit(0)).alias("offset")).join(plan_df, "pattern")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("pattern", "cell").orderBy("u", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total, supply, size = F.element_at("ends", -1), F.col("supply"), F.col("size")
    whole = F.when(supply > 0, F.floor(total / F.greatest(supply, F.lit(1)) + 1e-9)).otherwise(0)  # uses of every document
    placed = rows.withColumn("inside", inside).join(cells, ["pattern", "cell"]).withColumn("pos", F.col("offset") + F.col("inside"))
    placed = cut(placed.withColumn("whole", whole).withColumn("fits", F.col("pos") + size <= total - F.col("whole") * supply))

    def by_cell(values: dict, kind: str) -> DataFrame:  # joined on pattern and cell, as no pattern's rows may meet in one task
        table = spark.createDataFrame([(list(p), v) for p, v in values.items()], f"pattern array<string>, value {kind}")
        return cells.select("pattern", "cell").join(table, "pattern")

    # in the last round of uses the documents in order are taken while they fit, then those of the next that together come nearest to what is left
    ends = {tuple(r.pattern): r for r in placed.groupBy("pattern").agg(F.max(F.when(F.col("fits"), F.col("pos") + size)).alias("end"), F.first(total - F.col("whole") * supply).alias("goal")).collect()}
    left = {p: float(r.goal - (r.end or 0)) for p, r in ends.items()}
    after = placed.where(~F.col("fits") & (size > 0)).join(by_cell(left, "double"), ["pattern", "cell"]).where(size <= 2 * F.col("value"))
    nth = F.row_number().over(W.partitionBy("pattern").orderBy("pos"))
    coming = defaultdict(list)
    for r in after.select("pattern", "pos", "size", nth.alias("nth")).where(F.col("nth") <= FILLERS).sort("pos").collect():  # FILLERS a pattern
        coming[tuple(r.pattern)].append(r)
    filled = {p: [coming[p][i].pos for i in fill(left[p], [r["size"] for r in coming[p]])] for p in left}
    last = F.col("fits") | (F.array_contains("value", F.col("pos")) & (size > 0))
    position = lambda r: F.size(F.filter("ends", lambda e: e <= r * supply + F.col("pos") + size / 2))
    uses = F.filter(
        F.transform(F.array(*[F.lit(r) for r in range(repeats)]), lambda r: F.when((r < F.col("whole")) | ((r == F.col("whole")) & last), F.least(position(r), F.size("ends") - 1))),
        lambda i: i.isNotNull(),
    )
    return placed.join(by_cell(filled, "array<long>"), ["pattern", "cell"]).withColumn("use_at", uses).select(
        "doc_id", "size", "pattern", "text_key", "source_sizes", "targets",
        (size * F.size("use_at")).cast("long").alias("taken"),
        F.transform("use_at", lambda i: F.get("pattern", i)).alias("uses"),
    )


def take(docs: DataFrame, source: str = "source", **how) -> DataFrame:
    """The rows of docs as often as the mix uses them, with all their columns, whatever their names.

    A null text has no words and is never used; a null source is a source; of rows of equal id and text those that the mix uses
    more come first, which cannot be told from their contents; ties in the seeded order fall by id, size and text hash; an empty table gives none.
    """
    uses = mix(docs.select("doc_id", "text", F.array(source).alias("sources")), **how).select(F.xxhash64("doc_id", "text_key").alias("key"), F.size("uses").alias("uses"))
    uses = uses.where("uses > 0").withColumn("number", F.row_number().over(W.partitionBy("key").orderBy(F.desc("uses"))))
    rows = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), whole_row(docs)).withColumn("number", F.row_number().over(W.partitionBy("key").orderBy("key")))
    taken = rows.join(uses, ["key", "number"]).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    return taken.select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its source's size and target."""
    out = mix(documents(spark, sf_dir).withColumn("sources", F.array("source")))
    return out.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).cast(T.DoubleType()).alias("target"), "taken")
