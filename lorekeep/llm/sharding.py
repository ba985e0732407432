"""Sharding by balanced label propagation: equal texts move together, shards stay even.

Linked documents are those with equal texts. Documents of a group are
interchangeable, so the state is not one label a document but, for each group,
how many of its documents each shard holds: at most SHARDS rows for a group of
any size. All start dealt out evenly in the order of a hash. In each round every
group names as many of its shards as its size over the quota needs, those that
hold most of it; the group's documents in its other shards ask to move there.
Shards let documents go and come in equal numbers (swaps, and longer cycles of
shards) or into free room, largest groups first; a request that only partly fits
moves in part. Rounds alternate: in the first kind, ties between a group's
shards fall by a hash of the round; in the second, shards with room come first;
in the third only large groups ask (each size in turn), and where a shard is
full, parts of smaller groups leave it for the askers' shards in equal numbers,
each part whole, which cuts nothing. Rounds end when nobody asks, or when
nothing has moved for QUIET rounds and two more for each size that asks.
Documents without a link have no edge to cut:
they fill every shard up to its quota at the end.

Law `rows`: quotas differ by at most one, so counts do. Ranks are counted in
two steps (in hash buckets, then over the buckets' sums), so no task needs all
rows of a shard or a group.

Defined cases: a null text counts as an empty one (size 16, crc 0) and equal
to it; rows that repeat are rows of their own; with fewer rows than shards some
shards are empty; an empty table gives no rows. Ties go to the lower shard.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .columns import whole_rows

SHARDS = 40
#: Rounds in a row without a move that end the propagation, beside two for each size that asks.
QUIET = 4
#: Only a guard: every move makes the sum of squares of n grow, so rounds end by themselves; more than these raise.
MOST_ROUNDS = 1000
#: Hash buckets for two-step ranks, for each partition of the rank.
RANK_BUCKETS = 64


def _ranked(df: DataFrame, parts: list[str], order: list[Column], name: str, buckets: int = RANK_BUCKETS, spread: str = "rid") -> DataFrame:
    """df with a gapless rank from 0 within parts. Rows are numbered within (parts, hash bucket of `spread`); the
    buckets' sizes, far fewer rows, give each bucket's offset."""
    held = df.withColumn("__k", F.pmod(F.xxhash64(F.lit(17), spread), F.lit(buckets)).cast("int"))
    sums = held.groupBy(*parts, "__k").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*parts).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*parts, "__k", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    within = held.withColumn("__r", F.row_number().over(Window.partitionBy(*parts, "__k").orderBy(*order)))
    return within.join(sums, [*parts, "__k"]).withColumn(name, (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__k", "__r", "__before")


def _of_shard(values: list[int], at: Column) -> Column:
    """One number for each shard (or pair of shards), as a folded expression: no table has to be broadcast."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), at.cast("int") + 1)


def _flows(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from one shard to another, at most as asked: all go round cycles of shards, shortest
    first, where free room is a node that takes what it holds from each shard and gives to any shard."""
    n = len(free)
    left: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for (a, b), k in asked.items():
        left[a][b] = k
    for k, room in enumerate(free):
        if room > 0:
            left[k][n] = room
    left[n] = {k: sum(asked.values()) for k in range(n)}
    for a, b in sorted(asked):  # two shards that swap
        k = min(left[a].get(b, 0), left[b].get(a, 0))
        left[a][b] -= k
        if k:
            left[b][a] -= k
    for a, b in sorted(asked):
        while left[a][b] > 0:
            came, line = {b: a}, [b]
            for x in line:
                if x == a:
                    break
                for y, k in left[x].items():
                    if k > 0 and y not in came:
                        came[y] = x
                        line.append(y)
            if a not in came:
                break
            path, x = [(a, b)], a
            while x != b:
                path.append((came[x], x))
                x = came[x]
            k = min(left[x][y] for x, y in path)
            for x, y in path:
                left[x][y] -= k
    return {(a, b): k - left[a][b] for (a, b), k in asked.items() if k > left[a][b]}


def _accept(asks: DataFrame, parts: list[str], free: Column) -> DataFrame:
    """asks(g, label, target, n, size) with `moved`: how many of n fit into the free places of parts, largest groups first.

    Requests are summed by (parts, size) first; only the size that straddles the edge of the room is ranked singly.
    """
    by_size = asks.groupBy(*parts, "size").agg(F.sum("n").alias("all"))
    larger = Window.partitionBy(*parts).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("before", F.coalesce(F.sum("all").over(larger), F.lit(0)))
    asks = asks.join(by_size, [*parts, "size"]).withColumn("free", free)
    upto = Window.partitionBy(*parts, "size").orderBy("g", "label").rowsBetween(Window.unboundedPreceding, -1)
    whole = asks.where("before + `all` <= free").withColumn("moved", F.col("n"))
    edge = asks.where("before < free and before + `all` > free")
    fits = F.col("free") - F.col("before") - F.coalesce(F.sum("n").over(upto), F.lit(0))
    edge = edge.withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), fits)))
    return whole.unionByName(edge).where("moved > 0").select("g", "label", "target", "moved")


def _places(wanted: dict[tuple[int, int], int], offers: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(label, n, first, end, target): which of the parts of n documents that shard `label` offers, by their rank, go to
    `target`, each whole, so that together they are at most as many as the documents wanted from target to label."""
    left, out = dict(wanted), []
    for label, n in sorted(offers, reverse=True):
        first, count = 0, offers[label, n]
        for a, b in sorted(left):
            units = min(count - first, left[a, b] // n) if b == label else 0
            if units:
                out.append((label, n, first, first + units, a))
                left[a, b] -= units * n
                first += units
    return out


def propagate(groups: DataFrame, quotas: list[int], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """groups(g, label, n): how many documents of group g the shard `label` holds. The state when nothing moves any more.

    A move takes documents to where at least as many of their group are, so the sum of squares of n grows until nothing moves.
    """
    n_shards, state, quiet, powers = len(quotas), saved(groups, "shard-state"), 0, []
    held = {r["label"]: r["held"] for r in state.groupBy("label").agg(F.sum("n").alias("held")).collect()}
    free = [q - held.get(k, 0) for k, q in enumerate(quotas)]
    for turn in range(most_rounds):
        kind = turn % 3
        if (kind == 1 and max(free) <= 0) or (kind == 2 and not powers):
            continue
        tie = F.xxhash64(F.lit(turn), "g", "label")
        roomless = (_of_shard(free, F.col("label")) <= 0).cast("int") if kind == 1 else F.lit(0)
        shards_of = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), roomless.alias("roomless"), tie.alias("tie"), "label")))
        lists_of = state.groupBy("g").agg(shards_of.alias("s"), F.sum("n").alias("size"))
        lists = lists_of.where(F.size("s") > 1)
        lists = lists.withColumn("k", F.least(F.ceil(F.col("size") / F.lit(max(max(quotas), 1))).cast("int"), F.size("s")))
        goals = F.slice("s", 1, F.col("k"))
        if kind == 1:  # those with room, if there are any
            goals = F.filter(goals, lambda t: t["roomless"] == 0)
        lists = lists.withColumn("goals", goals).where(F.size("goals") > 0)
        asks = lists.select("g", "size", "k", "goals", F.posexplode("s").alias("at", "p")).where("at >= k")
        target = F.get("goals", F.pmod(F.col("at") + turn, F.size("goals")))["label"]
        asks = saved(asks.select("g", F.col("p.label").alias("label"), target.alias("target"), (-F.col("p.m")).alias("n"), "size"), "shard-asks")
        # each third round only groups of `least` documents or more ask, and parts of smaller ones leave for them, each whole
        least = (1 << powers[turn // 3 % len(powers)] - 1) + 1 if kind == 2 else 0
        asks = asks.where(F.col("size") >= least)
        asked: dict[tuple[int, int], int] = {}
        by_power = asks.groupBy("label", "target", F.ceil(F.log2("size")).cast("int").alias("power")).agg(F.sum("n").alias("n")).collect()
        for r in by_power:
            asked[r["label"], r["target"]] = asked.get((r["label"], r["target"]), 0) + r["n"]
        if kind == 0:
            if not asked:
                return state
            powers = sorted({r["power"] for r in by_power} - {1}, reverse=True)
        flows, moves = _flows(asked, free), []
        stuck = {k: n - flows.get(k, 0) for k, n in asked.items() if n > flows.get(k, 0)}
        if least and stuck:
            small = state.join(lists_of.where(F.col("size") < least).select("g"), "g").where(F.col("n") <= max(stuck.values()))
            offers = {(r["label"], r["n"]): r["k"] for r in small.groupBy("label", "n").agg(F.count("*").alias("k")).collect()}
            places = _places(stuck, offers)
            if places:
                chosen = small.sparkSession.createDataFrame(places, "label int, n long, first long, end long, target int")
                by_part = Window.partitionBy("label", "n").orderBy(F.xxhash64(F.lit(turn), "g"), "g")
                ranked = small.withColumn("rank", F.row_number().over(by_part) - 1).join(chosen, ["label", "n"]).where("rank >= first and rank < end")
                moves.append(ranked.select("g", "label", "target", F.col("n").alias("moved")))
                for label, n, first, end, a in places:
                    flows[a, label] = flows.get((a, label), 0) + (end - first) * n
        quiet = 0 if flows else quiet + 1
        if quiet >= QUIET + 2 * len(powers):
            return state
        if not flows:
            continue
        may = _of_shard([flows.get((a, b), 0) for a in range(n_shards) for b in range(n_shards)], F.col("label") * n_shards + F.col("target"))
        steps = F.array(F.struct("label", (-F.col("moved")).alias("n")), F.struct(F.col("target").alias("label"), F.col("moved").alias("n")))
        moves.append(_accept(asks, ["label", "target"], may))
        moves = reduce(DataFrame.unionByName, moves).select("g", F.explode(steps).alias("s")).select("g", "s.label", "s.n")
        state = saved(state.unionByName(moves).groupBy("g", "label").agg(F.sum("n").alias("n")).where("n > 0"), "shard-state")
        held = {r["label"]: r["held"] for r in state.groupBy("label").agg(F.sum("n").alias("held")).collect()}
        free = [q - held.get(k, 0) for k, q in enumerate(quotas)]
    raise RuntimeError(f"label propagation still moves documents after {most_rounds} rounds")


def shards(docs: DataFrame, n_shards: int = SHARDS, text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, size, text_crc32, shard, slot, and row_key and copy, which tell rows apart: a hash of
    doc_id and text, and a number from 1 among rows that repeat."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("g"))
    # one row for each different (doc_id, text); rows that repeat are counted and told apart by `copy`
    rows = rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("__times")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__times")
    rows = saved(rows.withColumn("row_key", _row_key("doc_id", "g")).withColumn("rid", F.xxhash64("doc_id", "g", "copy")), "shard-rows")
    counts = rows.groupBy("g").agg(F.count("*").alias("of_group"))
    total = rows.count()
    quotas = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    linked = saved(rows.join(counts.where("of_group > 1"), "g"), "shard-linked")
    dealt = _ranked(linked.withColumn("one", F.lit(0)), ["one"], [F.xxhash64(F.lit(29), "rid"), F.col("doc_id"), F.col("copy")], "at", 4096)
    state = propagate(dealt.groupBy("g", F.pmod("at", F.lit(n_shards)).cast("int").alias("label")).agg(F.count("*").alias("n")), quotas)

    # what a shard holds beyond its quota goes to the filling; the largest groups stay
    held = state.join(state.groupBy("g").agg(F.sum("n").alias("size")), "g").withColumn("target", F.col("label"))
    kept = saved(_accept(held, ["target"], _of_shard(quotas, F.col("target"))).select("g", F.col("target").alias("label"), F.col("moved").alias("n")), "shard-kept")
    spans = Window.partitionBy("g").orderBy("label")
    spans = kept.withColumn("upto", F.sum("n").over(spans)).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("spans"))
    placed = _ranked(linked, ["g"], [F.col("doc_id"), F.col("copy")], "rank").join(spans, "g", "left")
    home = F.try_element_at(F.filter(F.coalesce("spans", F.array().cast("array<struct<upto:bigint,label:int>>")), lambda s: F.col("rank") < s["upto"]), F.lit(1))
    columns = ["doc_id", "size", "text_crc32", "row_key", "rid", "copy"]
    placed = saved(placed.withColumn("label", home["label"]).select(*columns, "label"), "shard-placed")
    load = {r["label"]: r["n"] for r in placed.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    fill = rows.join(counts.where("of_group = 1"), "g", "left_semi").select(*columns).unionByName(placed.where("label is null").select(*columns))
    fill = _ranked(fill.withColumn("one", F.lit(0)), ["one"], [F.col("doc_id"), F.col("rid"), F.col("copy")], "rank", 4096)
    edges, upto = [], 0
    for k in range(n_shards):
        upto += quotas[k] - load.get(k, 0)
        edges.append(upto)
    filled = fill.withColumn("label", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= F.col("rank"))))
    every = placed.where("label is not null").unionByName(filled.select(*columns, "label"))
    every = _ranked(saved(every, "shard-all"), ["label"], [F.col("doc_id"), F.col("rid"), F.col("copy")], "slot", 1024)
    return every.select("doc_id", "size", "text_crc32", F.col("label").cast("int").alias("shard"), "slot", "row_key", "copy")


def _row_key(doc_id: str, g: str) -> Column:
    return F.xxhash64(doc_id, g)


def with_shards(docs: DataFrame, n_shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with size, text_crc32, shard and slot; a column of docs with such a name (in any
    case) stays as `<name>_before`, with as many `_before` as make it free. The texts are shuffled once: rows that repeat
    are numbered where they meet their places."""
    own = ["size", "text_crc32", "shard", "slot"]
    taken, names = {c.lower() for c in [*docs.columns, *own]}, {}
    for c in docs.columns:
        names[c] = c
        while c.lower() in own and names[c].lower() in taken:
            names[c] += "_before"
        taken.add(names[c].lower())
    places = shards(docs, n_shards, text).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("copy", *own))).alias("places"))
    rows = whole_rows(docs).withColumn("g", F.md5(F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary"))).withColumn("row_key", _row_key("row.doc_id", "g")).drop("g")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("row_key").orderBy("row_key")))
    rows = rows.join(places.hint("shuffle_hash"), "row_key").withColumn("place", F.get("places", F.col("copy") - 1))
    return rows.select(*[F.col(f"row.`{c}`").alias(names[c]) for c in docs.columns], *[F.col(f"place.{c}") for c in own])


def op9_sharding(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """One row per document under the law `rows`."""
    return shards(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
