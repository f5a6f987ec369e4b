"""Entity resolution in order, in parallel rounds: what a loop over the rows would find, without a task that holds a block.

The loop: each row looks for the first entity, in the order of founding, that shares its number, else its domain, else its phone,
name and address, name and city, or has a similar name in its city; entities that are known to have another number never count. It joins that entity or founds one.
Of an entity's members so far, the most trusted one with a value gives each attribute, the earliest of equally trusted ones.

Numbers come first and different ones never meet, so an entity keeps the number that it has: from its first row on, all rows with a
number are where that one is. They follow it and ask nothing. The first one can join entities without a number only; rows without one join any.

The rounds: let A be a guess of the founder that each asking row joins. A tells what every entity shows at any time, as intervals of the
order; so each row can be given the founder that it would find, all rows at once. The loop's answer is the only guess that gives itself back: the first
row is right in any round, and a row is right as soon as all before it were. A round ends with founders of founders, a better guess where
entities merge; right rows stay right. It ends when nothing changes, after as many rounds as answers depend on each other: few where rows
share keys as companies do, but a chain of rows, each of which is decided by the one before it, takes a round for each of them.

A round deals offers (what entities show, and when) and asks by key and goes through each key in the order of places, with a heap of the
founders that are to be found. Keys of more than HOT rows are not dealt to one task: their intervals are a few blocks of 16^l places each, a
place is in one block of each l, and of each block only the first founder is kept, so that asks and offers meet by equi-joins.
Values are whole numbers in the rounds, the place of the first row that has them. Names are compared for rows that found nothing else only.
"""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.operators.resolve import Saved, dealt_evenly, similar_names

LEVELS = ("corporate_number", "domain", "phone", "name_address", "name_city", "fuzzy_name")
#: The levels that are asked by keys; rows with a number follow the first one that has it.
PARTS = {"domain": ("domain",), "phone": ("phone",), "name_address": ("name", "address"), "name_city": ("name", "city")}
ATTRIBUTES = ("number", "domain", "phone", "name", "address", "city")
#: How alike names of one city must be, and from how many letters on.
ALIKE, LETTERS = 0.88, 4
BASE = 16
#: Keys that more rows have or ask for are spread over tasks.
HOT = 100_000
#: So many values and asks, as they are before the rounds, make a task of a round.
TASK = 100_000
KEY = ("level", "v1", "v2")
EVENTS = "level int, v1 long, v2 long, at long, offered int, x long, y long, z long"
FAR = -1  # the second part of keys that have one


def _powers(top: int) -> list[int]:
    """16^0, 16^1 .. up to the first that is above top."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * BASE)
    return out


def _blocks_of_interval(low: Column, high: Column, top: int) -> Column:
    """array<struct<size, block>>: the largest blocks that low .. high - 1 consists of."""
    sizes = _powers(top)
    up = lambda x, size: F.ceil(x.cast("decimal(20,0)") / size).cast("long") if size > 1 else x
    down = lambda x, size: F.floor(x.cast("decimal(20,0)") / size).cast("long") if size > 1 else x
    none = F.array().cast("array<bigint>")
    row = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    found = []
    for size in sizes:
        a, b, c, d = up(low, size), down(high, size), up(low, size * BASE), down(high, size * BASE)
        inner = F.when(c < d, F.concat(row(a, c * BASE), row(d * BASE, b))).otherwise(row(a, b))
        found.append(F.arrays_zip(F.array_repeat(F.lit(size).cast("long"), F.size(inner)).alias("size"), inner.alias("block")))
    return F.concat(*found)


def _blocks_of_place(at: Column, top: int) -> Column:
    return F.array(*[F.struct(F.lit(size).cast("long").alias("size"), F.floor(at / size).cast("long").alias("block")) for size in _powers(top)])


def _intervals(held: list, top: int) -> list:
    """low, high, value of held(place, trust, value): a value counts from its first place on, if no more trusted one stands before it."""
    best, out = None, []
    for place, trust, value in sorted(held):
        if best is None or trust > best:
            if out:
                out[-1][1] = place
            best = trust
            out.append([place, top + 1, value])
    return out


def _offers_of(levels: list[str], top: int):
    """Offers of members(founder, trust, places and values of ATTRIBUTES), which come sorted by founder: one for each key and time in which an entity can be found by it.

    level, v1, v2, at, 1, founder, high, free: found by rows with at < place <= high, and by rows with a number to place <= free, as the entity has none.
    """
    wanted = [(i, tuple(ATTRIBUTES.index(a) for a in PARTS[k])) for i, k in enumerate(PARTS) if k in levels]

    def of(founder, members):
        held = [[] for _ in ATTRIBUTES]
        for _, trust, *cells in members:
            for i in range(len(ATTRIBUTES)):
                if cells[2 * i] is not None:
                    held[i].append((cells[2 * i], trust, cells[2 * i + 1]))
        numbered = min((h[0] for h in held[0]), default=top + 1)
        shown = [_intervals(h, top) if h else h for h in held]
        for level, parts in wanted:
            first = shown[parts[0]]
            if len(parts) == 1:
                found = [(low, high, value, FAR) for low, high, value in first]
            else:
                found = [(max(l1, l2), min(h1, h2), a, b) for l1, h1, a in first for l2, h2, b in shown[parts[1]] if max(l1, l2) < min(h1, h2)]
            for low, high, a, b in found:
                yield level, a, b, low, 1, founder, high, min(high, numbered)

    def run(batches):
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        yield from _batches((o for founder, members in groupby(rows, lambda r: r[0]) for o in of(founder, members)), EVENT_ARROW)

    return run


EVENT_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in EVENTS.split(", ")])
BEST_ARROW = pa.schema([("place", pa.int64()), ("best", pa.int64())])


def _batches(rows, schema: pa.Schema, size: int = 50_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _answers(top: int):
    """place, best of asks(.., place, 0, rank, numbered, -) and offers that come by key, in the order of places: the rank and the first founder, as one number."""

    def each(batches):
        key, any_row, free_row = None, [], []
        for batch in batches:
            for level, v1, v2, at, offered, x, y, z in zip(*[c.to_pylist() for c in batch.columns]):
                if (level, v1, v2) != key:
                    key, any_row, free_row = (level, v1, v2), [], []
                if offered:
                    # what a founder before it offers for as long hides it
                    for heap, until in ((any_row, y), (free_row, z)):
                        if at < until and not (heap and heap[0][0] <= x and heap[0][1] >= until):
                            heappush(heap, (x, until))
                    continue
                heap = free_row if y else any_row
                while heap and heap[0][1] < at:
                    heappop(heap)
                if heap:
                    yield at, x * (top + 1) + heap[0][0]

    return lambda batches: _batches(each(batches), BEST_ARROW)


def _met_by_blocks(asks: DataFrame, offers: DataFrame, top: int, saved: Saved, name: str) -> DataFrame:
    """What _answers gives, by equi-joins."""
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("y"), F.col("y").alias("high")), F.struct(F.lit(1).cast("long").alias("y"), F.col("z").alias("high")))
    each = offers.select(*KEY, F.col("at").alias("low"), F.col("x").alias("founder"), F.explode(kinds).alias("k")).select(*KEY, "low", "founder", "k.*").filter("low < high")
    key = [*KEY, "y"]
    first = each.groupBy(*key).agg(F.min_by(F.struct("founder", "high"), F.struct("low", "founder")).alias("first"))
    # what the earliest one covers for as long counts no more if it was founded later
    counts = each.join(first, key).filter((F.col("founder") <= F.col("first.founder")) | (F.col("high") > F.col("first.high"))).drop("first")
    counts = saved.save(dealt_evenly(counts, *key, "low"), name)
    blocks = counts.select(*key, "founder", F.explode(_blocks_of_interval(F.col("low") + 1, F.col("high") + 1, top)).alias("b")).groupBy(*key, "b").agg(F.min("founder").alias("founder"))
    spread = asks.select(*key, "at", "x", F.explode(_blocks_of_place(F.col("at"), top)).alias("b"))
    return spread.join(blocks, [*key, "b"]).select(F.col("at").alias("place"), (F.col("x") * (top + 1) + F.col("founder")).alias("best"))


def _found(asks: DataFrame, offers: DataFrame, hot: DataFrame | None, top: int, tasks: int, saved: Saved, name: str) -> DataFrame:
    """place, best: the best rank and the first founder for each place that asks and is answered."""
    apart = lambda df, how: df if hot is None else df.join(F.broadcast(hot), [*KEY], how).select(*df.columns)
    dealt = apart(asks.unionAll(offers), "left_anti").repartition(tasks, *KEY).sortWithinPartitions(*KEY, "at", "offered")
    met = dealt.mapInArrow(_answers(top), "place long, best long")
    if hot is not None:
        met = met.unionAll(_met_by_blocks(apart(asks, "left_semi"), apart(offers, "left_semi"), top, saved, name))
    return met.groupBy("place").agg(F.min("best").alias("best"))


def _asks(rows: DataFrame, level: str, rank: int) -> DataFrame:
    """Asks of rows(place, numbered, values), as events. A value that no row before has finds nothing."""
    a, *b = PARTS[level]
    there = reduce(lambda x, y: x & y, [F.col(p) < F.col("place") for p in PARTS[level]])
    second = F.col(b[0]) if b else F.lit(FAR).cast("long")
    number = lambda x: F.lit(x).cast("long")
    return rows.filter(there).select(F.lit(list(PARTS).index(level)).alias("level"), F.col(a).alias("v1"), second.alias("v2"), F.col("place").alias("at"), F.lit(0).alias("offered"), number(rank).alias("x"), F.col("numbered").cast("long").alias("y"), number(0).alias("z"))


def _hot_keys(coded: DataFrame, often: dict[str, int], levels: list[str], alike: DataFrame | None) -> DataFrame | None:
    """The keys that more than HOT rows have, or ask for by names like theirs; few, as each takes so many rows. often: of how many rows an attribute's most frequent value is."""
    counts = []
    for i, (level, parts) in enumerate(PARTS.items()):
        a, *b = parts
        near = level == "name_city" and alike is not None
        if level not in levels or often.get(b[0] if near else min(parts, key=lambda p: often.get(p, 0)), 0) <= HOT:
            continue
        key = [F.lit(i).alias("level"), F.col(a).alias("v1"), F.col(b[0]).alias("v2") if b else F.lit(FAR).cast("long").alias("v2"), "n"]
        held = coded.filter(reduce(lambda x, y: x & y, [F.col(p).isNotNull() for p in parts])).groupBy(*parts).agg(F.count("*").alias("n"))
        counts.append(held.select(*key))
        if near:
            counts.append(held.join(alike, "name").drop("name").withColumnRenamed("other", "name").select(*key))
    if not counts:
        return None
    return reduce(DataFrame.unionAll, counts).groupBy(*KEY).agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select(*KEY)


def resolve_in_order(rows: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """id, entity, reason of rows(id, place, seed, trust, number, domain, phone, name, address, city), as the loop would have it.

    place: a distinct whole number from 0 on, under 1e15; entity: the id of the founder; reason: the level at which a row joined, null for founders.
    Seeds are entities of their own whatever they share; others can join them. Null and empty attributes match nothing. The first level is the number.
    """
    if levels[0] != "corporate_number":
        raise ValueError("numbers come first")
    saved = Saved(rows.sparkSession, "fold")
    rows = saved.save(rows.select("id", "place", "seed", F.coalesce("trust", F.lit(-(1 << 31))).alias("trust"), *[F.nullif(F.col(a), F.lit("")).alias(a) for a in ATTRIBUTES]), "rows")
    top = rows.agg(F.max("place")).first()[0]
    if top is None:
        return rows.select("id", F.col("id").alias("entity"), F.lit(None).cast("string").alias("reason"))
    asked = [k for k in PARTS if k in levels or k == "name_city" and "fuzzy_name" in levels]
    # of each value, the place of the first row that has it
    each = [rows.filter(F.col(a).isNotNull()).groupBy(F.lit(a).alias("attribute"), F.col(a).alias("value")).agg(F.min("place").alias("word"), F.count("*").alias("n")) for a in ATTRIBUTES]
    words = saved.save(reduce(DataFrame.unionAll, each), "words")
    often = {r["attribute"]: r["n"] for r in words.groupBy("attribute").agg(F.max("n").alias("n")).collect()}
    of = lambda a, value, word: words.filter(F.col("attribute") == a).select(F.col("value").alias(value), F.col("word").alias(word))
    coded = rows.drop("id")
    for a in ATTRIBUTES:
        coded = coded.join(of(a, a, "word"), a, "left").drop(a).withColumnRenamed("word", a)
    # rows with a number go where the first of them goes
    unit = F.when(F.col("seed") | F.col("number").isNull(), F.col("place")).otherwise(F.col("number"))
    coded = saved.save(coded.select("place", "seed", "trust", unit.alias("unit"), *ATTRIBUTES), "coded")
    cells = [c for a in ATTRIBUTES for c in (F.min(F.when(F.col(a).isNotNull(), F.col("place"))).alias(f"{a}_at"), F.min_by(a, F.when(F.col(a).isNotNull(), F.col("place"))).alias(a))]
    values = saved.save(coded.groupBy("unit", "trust").agg(*cells), "values")
    asking = saved.save(coded.filter("NOT seed AND unit = place").select("place", F.col("number").isNotNull().alias("numbered"), *ATTRIBUTES[1:]), "asking")
    asks = [_asks(asking, k, levels.index(k)) for k in asked if k in levels]
    asks = saved.save(reduce(DataFrame.unionAll, asks), "asks")
    alike = None
    if "fuzzy_name" in levels:
        # of names, not of names in a city: an entity can have its name from one member and its city from another
        pairs = saved.save(similar_names(of("name", "name", "word").filter(F.length("name") >= LETTERS), [], "name", ALIKE), "pairs")
        pairs = pairs.join(of("name", "a", "x"), "a").join(of("name", "b", "y"), "b")
        alike = saved.save(pairs.select(F.col("x").alias("name"), F.col("y").alias("other")).unionAll(pairs.select("y", "x")), "alike")
    hot = _hot_keys(coded, often, asked, alike)
    if hot is not None:
        hot = saved.save(hot, "hot")
        hot = hot if hot.limit(1).count() else None
    tasks = 1 + (values.count() + asks.count()) // TASK
    again = [c for a in ATTRIBUTES for c in (F.min(f"{a}_at").alias(f"{a}_at"), F.min_by(a, f"{a}_at").alias(a))]
    guess, turn = saved.save(asking.select("place", F.col("place").alias("founder")), "guess-0"), 0
    while True:
        joined = values.join(guess.select(F.col("place").alias("unit"), "founder"), "unit", "left").withColumn("founder", F.coalesce("founder", "unit"))
        members = joined.groupBy("founder", "trust").agg(*again)
        offers = members.repartition(tasks, "founder").sortWithinPartitions("founder").mapInArrow(_offers_of(asked, top), EVENTS)
        offers = saved.save(offers, f"offers-{turn}")
        best = saved.save(_found(asks, offers, hot, top, tasks, saved, f"hot-{turn}"), f"best-{turn}")
        told = guess.select("place", F.col("founder").alias("was"))
        if alike is not None:
            left = asking.join(best, "place", "left_anti").join(alike, "name").drop("name").withColumnRenamed("other", "name")
            near = offers.filter(F.col("level") == list(PARTS).index("name_city"))
            best = best.unionAll(_found(_asks(left, "name_city", levels.index("fuzzy_name")), near, hot, top, tasks, saved, f"hot-alike-{turn}"))
        told = told.join(best, "place", "left").select("place", "was", F.coalesce(F.col("best") % (top + 1), "place").alias("founder"), F.expr(f"best DIV {top + 1}").cast("int").alias("rank"))
        told = saved.save(told, f"told-{turn}")
        moved = told.filter("founder <> was").limit(1).count()
        if not moved:
            break
        # founders of founders
        onward = told.select(F.col("place").alias("founder"), F.col("founder").alias("onward"))
        guess = saved.save(told.join(onward, "founder", "left").select("place", F.coalesce("onward", "founder").alias("founder")), f"guess-{turn + 1}")
        for name in ("guess", "told", "offers", "best", "hot", "hot-alike"):
            saved.drop(f"{name}-{turn}")
        turn += 1
    joined = coded.select("place", F.col("unit")).join(told.select(F.col("place").alias("unit"), "founder", "rank"), "unit", "left")
    joined = joined.select("place", F.coalesce("founder", "unit").alias("founder"), F.when(F.col("place") != F.col("unit"), F.lit(0)).otherwise(F.col("rank")).alias("rank"))
    names = rows.select(F.col("place").alias("founder"), F.col("id").alias("entity"))
    reason = F.element_at(F.array(*map(F.lit, levels)), F.col("rank") + 1)
    return joined.join(rows.select("place", "id"), "place").join(names, "founder").select("id", "entity", F.when(F.col("rank").isNotNull(), reason).alias("reason"))
