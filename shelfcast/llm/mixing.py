"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are first summed by membership pattern, the set of sources they belong to. A flow routes
the words of the patterns to the quotas of the sources; using a pattern's words once costs nothing
and every further pass over them costs more than the one before, so the cheapest flow repeats as
little as it can. Only the table of patterns, whose size is checked, leaves Spark. The documents of
each pattern are then taken whole, in a seeded order, up to the words that the flow gives it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import fresh, quoted
from shelfcast.plans.durable import durable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SEED = 7
MAX_PATTERNS = 100_000
BUCKET_ROWS = 2_000

Source = str | None


def by_code_point(sources) -> list[Source]:
    """Sorted, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[Source, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MAX_PASSES) -> dict[Source, float]:
    """Words wanted from each source. Sources weigh ``weights`` in turn; none gets over ``most`` times its size."""
    names = by_code_point(sizes)
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left = max(0.0, left - out[s])
        open_ = [s for s in open_ if s not in out]
    return out


def whole_quotas(wanted: dict[Source, float]) -> dict[Source, int]:
    """Targets as whole words with the same sum, by largest remainders."""
    out = {s: int(t) for s, t in wanted.items()}
    spare = round(sum(wanted.values())) - sum(out.values())
    for s in sorted(by_code_point(wanted), key=lambda s: out[s] - wanted[s])[: max(0, spare)]:
        out[s] += 1
    return out


def route(capacity: list[int], members: list[tuple[Source, ...]], quota: dict[Source, int],
          passes: int = MAX_PASSES) -> list[dict[Source, int]]:
    """Cheapest flow of pattern words to source quotas: words by source for each pattern.

    The cost of a path is that of the pass it opens, and passes cost more one after the other. So
    the shortest augmenting paths come in order of passes: each pass adds every pattern's words
    once, and paths are searched until none is left. A path may move words of a pattern from one of
    its sources to another.
    """
    flow = [dict.fromkeys(m, 0) for m in members]
    room = [0] * len(members)
    need = dict(quota)
    patterns_of: dict[Source, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            patterns_of.setdefault(s, []).append(p)
    for _ in range(passes):
        room = [r + c for r, c in zip(room, capacity)]
        for p, m in enumerate(members):  # paths of one edge
            for s in m:
                step = min(room[p], need.get(s, 0))
                flow[p][s] += step
                room[p] -= step
                need[s] = need.get(s, 0) - step
        for s in by_code_point(need):
            while need[s] > 0:
                path = _path(s, room, members, flow, patterns_of)
                if path is None:
                    break
                step = min([need[s], room[path[-1][1]], *(flow[p][t] for t, p in zip([x for x, _ in path[1:]], [y for _, y in path]))])
                for k, (t, p) in enumerate(path):
                    flow[p][t] += step
                    if k + 1 < len(path):
                        flow[p][path[k + 1][0]] -= step
                need[s] -= step
                room[path[-1][1]] -= step
    return flow


def _path(source, room, members, flow, patterns_of):
    """Steps (source, pattern) from a source in need to a pattern with room.

    Each pattern gives words to its source and, unless it has room, takes them from the next one.
    """
    came: dict = {("s", source): None}
    todo = deque([source])
    while todo:
        s = todo.popleft()
        for p in patterns_of.get(s, ()):
            if ("p", p) in came:
                continue
            came["p", p] = s
            if room[p] > 0:
                steps = []
                while True:
                    s = came["p", p]
                    steps.append((s, p))
                    if came["s", s] is None:
                        return steps[::-1]
                    p = came["s", s]
            for t in members[p]:
                if flow[p][t] > 0 and ("s", t) not in came:
                    came["s", t] = p
                    todo.append(t)
    return None


def mix(docs: DataFrame, members: Column, size: Column, wanted=targets, id_col: str = "doc_id", seed: int = SEED,
        passes: int = MAX_PASSES, names: Sequence[str] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """``docs`` with the words of each row, those and the target of its sources, and the words taken.

    ``members`` is an array of sources (null is a source), ``size`` a number of words, ``wanted``
    a function from source sizes to targets. Columns called like one of ``names``, in any case, are replaced. A row is taken whole, a whole number of times up to
    ``passes``. Rows that repeat id, sources and size stay or go together. For rows of several
    sources the second and third figures are sums. An empty table gives no rows. More than
    MAX_PATTERNS patterns raise an error, since the flow is worked out on the driver.
    """
    spark = docs.sparkSession
    key, place, words = (fresh(n, [*docs.columns, *names]) for n in ("mix_key", "mix_place", "mix_words"))
    sources = F.array_sort(F.array_distinct(members))
    keyed = (
        docs.withColumn(words, F.coalesce(size.cast("long"), F.lit(0)))
        .withColumn(key, F.to_json(F.struct(sources.alias("m")), {"ignoreNullFields": "false"}))
        .withColumn(place, F.xxhash64(F.lit(seed), F.col(id_col), F.col(key), F.col(words)))
    )
    light = durable(
        keyed.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(place).alias("place"), F.col(words).alias("words"), sources.alias("m"))
    )
    found = light.groupBy("key").agg(F.first("m").alias("m"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    patterns = found.limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns.sort(key=lambda r: r["key"])
    lists = [tuple(r["m"] or ()) for r in patterns]
    sizes: dict[Source, int] = {}
    for r, m in zip(patterns, lists):
        for s in m:
            sizes[s] = sizes.get(s, 0) + r["words"]
    goal = wanted(sizes) if sizes else {}
    flow = route([r["words"] for r in patterns], lists, whole_quotas(goal), passes)
    plan = []
    for r, m, f in zip(patterns, lists, flow):
        whole, rest = divmod(sum(f.values()), r["words"]) if r["words"] else (0, 0)
        plan.append((r["key"], sum(sizes[s] for s in m), float(sum(goal[s] for s in m)), whole, rest, -(-r["rows"] // BUCKET_ROWS)))
    # Written once, so that the planner knows how small it is and joins it without a shuffle.
    plan = durable(
        spark.createDataFrame(
            plan, "key string, source_size long, target double, whole long, rest long, buckets long"
        ).coalesce(1)
    )
    bucket = F.pmod("place", "buckets")
    dealt = light.join(plan.select("key", "rest", "buckets"), "key").withColumn("bucket", bucket)
    sums = dealt.groupBy("key", "bucket", "rest").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("key").orderBy("bucket")
    edge = durable(
        sums.withColumn("end", F.sum("words").over(upto))
        .where("end > rest and end - words <= rest")
        .select("key", "bucket", (F.col("end") - F.col("words")).alias("before"))
    )
    # The bucket in which the words run out: whole documents in seeded order, then the one that fits the gap best.
    items = (
        dealt.join(edge, ["key", "bucket"])
        .groupBy("key", "place", "id", "rest", "before")
        .agg(F.sum("words").alias("words"))
    )
    ordered = Window.partitionBy("key").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    cut = items.withColumn("end", F.col("before") + F.sum("words").over(ordered))
    cut = cut.withColumn("in", F.col("end") <= F.col("rest"))
    inside = F.max(F.when(F.col("in"), F.col("end"))).over(Window.partitionBy("key"))
    gap = F.col("rest") - F.coalesce(inside, F.col("before"))
    cut = cut.withColumn("gap", gap).withColumn("off", F.abs(F.col("words") - F.col("gap")))
    nearest = F.row_number().over(Window.partitionBy("key", "in").orderBy("off", "place", "id"))
    filler = ~F.col("in") & (nearest == 1) & (F.col("off") < F.col("gap"))
    chosen = durable(cut.withColumn("extra", F.col("in") | filler).where("extra").select("key", "place", F.col("id").alias("chosen_id"), F.lit(True).alias("extra")))

    plan = durable(plan.join(edge.select("key", F.col("bucket").alias("edge")), "key", "left").coalesce(1))
    plan = plan.select(*[F.col(c).alias(f"plan_{c}_{key}") for c in plan.columns])
    chosen = chosen.select(*[F.col(c).alias(f"chosen_{c}_{key}") for c in chosen.columns])
    p = lambda c: F.col(f"plan_{c}_{key}")
    c = lambda n: F.col(f"chosen_{n}_{key}")
    joined = keyed.join(plan, F.col(key) == p("key"), "left")
    at_edge = F.col(id_col).eqNullSafe(c("chosen_id")) & (F.col(key) == c("key")) & (F.col(place) == c("place"))
    joined = joined.join(chosen, at_edge, "left")
    mine = F.pmod(F.col(place), p("buckets"))
    extra = F.when(p("rest") == 0, False).when(mine < p("edge"), True).otherwise(F.coalesce(c("extra"), F.lit(False)))
    taken = F.col(words) * (p("whole") + extra.cast("long"))
    added = (F.col(words), p("source_size"), p("target"), taken)
    replaced = {n.lower() for n in names}
    others = [quoted(n) for n in docs.columns if n.lower() not in replaced]
    return joined.select(*others, *[e.alias(n) for e, n in zip(added, names)])


def word_count(text: str = "text") -> Column:
    """Words of a text: runs without ASCII white space. Null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken."""
    names = [fresh(n, docs.columns) for n in ("size", "source_size", "target", "taken")]
    found = mix(docs, F.array(source_col), word_count(text_col), id_col=id_col, names=names)
    times = (F.col(names[3]) / F.greatest(F.col(names[0]), F.lit(1))).cast("int")
    copy = fresh("copy", found.columns)
    return (
        found.where(F.col(names[3]) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
        .select(*map(quoted, docs.columns))
    )
