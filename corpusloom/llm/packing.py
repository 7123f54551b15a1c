"""Problem 7: items into containers of fixed capacity, with little space left.

Bulk-synchronous best fit.  Items go by classes of size, the large ones first.
In a round the items of a class and the gaps of the open containers are
range-sorted together, and every task sweeps over its range: an item's
successor is the smallest gap at or above it that no other item needs.  How
much is still unmatched where a range begins or ends is handed over between
the tasks in a table of one row each.  Where several items want one gap, their
rank decides: the largest go in, the others wait.  Gaps are updated and swept
again until no item of the class moves; only then are containers opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Boxes at most that are filled in one run.
BOXES = 1000
#: Classes of items by how many of them a container holds: from each of these numbers on.
CLASSES = (2, 3, 4, 8, 24, 128)
#: From this class on the first sweep measures a gap in units of size; else in items that it holds for sure.
BY_SIZE = 5


def _parts(items: DataFrame, boxes: list) -> DataFrame:
    """(box, capacity, item, piece, start, size, class) of all items for every box; oversized items in pieces."""
    each_box = F.array(*(F.struct(F.lit(b["box"]).cast("string").alias("box"), F.lit(b["capacity"]).alias("capacity")) for b in boxes))
    sized = cut(items.select("item", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("all")))
    pairs = sized.select("item", "all", F.explode(each_box).alias("b")).select("item", "all", "b.box", F.col("b.capacity").cast("long").alias("capacity"))  # every box takes all items
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / F.col("capacity")) - 1, F.lit(0)).cast("int"))
    parted = pairs.select("box", "capacity", "item", "all", F.explode(places).alias("piece")).withColumn("start", F.col("piece") * F.col("capacity"))
    parted = parted.withColumn("size", F.least("capacity", F.col("all") - F.col("start")))
    fits = F.floor(F.col("capacity") / F.col("size"))
    of_class = reduce(lambda a, b: a + b, (F.when(fits >= c, 1).otherwise(0) for c in CLASSES))
    return parted.select("box", "capacity", "item", "piece", "start", "size", F.when(F.col("size") > 0, of_class).otherwise(-1).alias("class"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a number from 0 within each box, counted over range-sorted tasks that are told how many come before them."""
    ranged = cut(rows.repartitionByRange("box", *order).withColumn("task", F.spark_partition_id()))
    inside = Window.partitionBy("task", "box").orderBy(*order)
    before = Window.partitionBy("box").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = ranged.groupBy("box", "task").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row a task
    found = ranged.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(tasks), ["box", "task"])
    return found.withColumn("number", F.col("before") + F.col("inside")).drop("task", "inside", "before")


def _swept(items: DataFrame, gaps: DataFrame, bounds: DataFrame) -> DataFrame:
    """One sweep: ``items`` of one class in each box, whether each goes, and to which container.

    ``gaps`` has box, container, gap; ``bounds`` has low and high, the least and
    largest size of the items in each box, and by_size.  An item weighs 1 and a
    gap as many items as it holds whatever their size, or both weigh their size.

    Sorted by size, items open and gaps close.  From below, what a gap closes is
    known by running minima of the open weight; from above, likewise, which
    items find a gap, the largest first.  Both number the same weight, so that
    the items found and the gaps closed pair off in order.  An item whose weight
    would lie in two gaps waits.
    """
    spark = items.sparkSession
    least = items.schema["item"].dataType
    none = [F.lit(None).cast(least).alias("item"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("start")]
    bounds = F.broadcast(bounds)  # a row a box
    at_hand = gaps.join(bounds, "box").where("gap >= low")
    items = items.join(bounds.select("box", "by_size"), "box")
    holds = F.when(F.col("by_size"), F.col("gap")).otherwise(F.greatest(F.floor(F.col("gap") / F.col("high")), F.lit(1)))
    closing = at_hand.select("box", F.col("gap").alias("value"), F.lit(1).alias("closes"), *none, "container", (-holds).cast("long").alias("weight"))
    opening = items.select("box", F.col("size").alias("value"), F.lit(0).alias("closes"), "item", "piece", "start", F.lit(None).cast("long").alias("container"), F.when(F.col("by_size"), F.col("size")).otherwise(1).cast("long").alias("weight"))
    order = ["value", "closes", "item", "piece", "container"]
    ranged = cut(opening.unionByName(closing).repartitionByRange("box", *order).withColumn("task", F.spark_partition_id()))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(spark.sql(_SWEEP.format(tasks=tasks, ranged="{ranged}"), ranged=ranged))


# From range-sorted rows (value, closes, ..., weight, task) to items with goes and container.  ``total`` is the
# open weight behind a row, ``before`` the one ahead of it; ``lost`` is gap weight that finds nothing below,
# ``unmet`` item weight that finds nothing above.  Matched weight is cut into stretches; a gap lies in those
# that it touches, an item where it begins.
_SWEEP = """
WITH summed AS (
    SELECT *, greatest(weight, 0) AS own, sum(weight) OVER up AS total, sum(greatest(weight, 0)) OVER up AS held FROM {ranged}
    WINDOW up AS (PARTITION BY box, task ORDER BY value, closes, item, piece, container ROWS UNBOUNDED PRECEDING)
),
local AS (
    SELECT *, total - weight AS before,
           min(total) OVER (PARTITION BY box, task ORDER BY value, closes, item, piece, container ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_below,
           min(total - weight) OVER (PARTITION BY box, task ORDER BY value DESC, closes DESC, item DESC, piece DESC, container DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_above
    FROM summed
),
added AS (SELECT box, task, sum(weight) AS t_sum, sum(own) AS t_held, min(total) AS t_low, min(before) AS t_low_before FROM local GROUP BY box, task),
opened AS (
    SELECT *, coalesce(sum(t_sum) OVER earlier, 0) AS open, coalesce(sum(t_held) OVER earlier, 0) AS held_before, sum(t_sum) OVER whole AS every, sum(t_held) OVER whole AS every_held
    FROM added WINDOW earlier AS (PARTITION BY box ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS (PARTITION BY box)
),
shares AS (
    SELECT box, task, open, held_before, every, every_held, min(open + t_low) OVER (PARTITION BY box ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_earlier,
           min(open + t_low_before) OVER (PARTITION BY box ORDER BY task DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_later, min(open + t_low_before) OVER (PARTITION BY box) AS lowest
    FROM opened
),
placed AS (
    SELECT /*+ BROADCAST(shares) */ l.*, open + total AS here, held_before + held AS held_here, every_held,
           greatest(0, -coalesce(least(open + low_below, low_earlier), 0)) AS lost_before,
           greatest(0, -least(coalesce(least(open + low_below, low_earlier), 0), open + total)) AS lost_here,
           greatest(0, coalesce(every - least(open + low_above, low_later), 0)) AS unmet_above,
           greatest(0, every - least(open + low_above, low_later, open + before)) AS unmet_here,
           every_held - greatest(0, every - lowest) AS matched
    FROM local l JOIN shares USING (box, task)
),
numbered AS (
    SELECT box, value, closes, item, piece, start, container, matched,
           CASE WHEN closes = 1 THEN held_here - here + weight - lost_before WHEN unmet_here = unmet_above THEN matched - (every_held - held_here - unmet_above) - weight END AS first,
           CASE WHEN closes = 1 THEN held_here - here - lost_here ELSE matched - (every_held - held_here - unmet_above) END AS past,
           greatest(ceil(matched / {tasks}), 256) AS stretch
    FROM placed
),
spread AS (
    SELECT *, explode(CASE WHEN closes = 1 THEN sequence(floor(first / stretch), floor((past - 1) / stretch))
                           ELSE array(coalesce(floor(first / stretch), -1 - pmod(xxhash64(item, piece), {tasks}))) END) AS part
    FROM numbered WHERE closes = 0 OR past > first
),
met AS (
    SELECT *, last(CASE WHEN closes = 1 THEN struct(container, past) END, true) OVER (PARTITION BY box, part ORDER BY first, closes DESC ROWS UNBOUNDED PRECEDING) AS gap FROM spread
)
SELECT box, item, piece, start, value AS size, first IS NOT NULL AND coalesce(past <= gap.past, false) AS goes, gap.container AS container FROM met WHERE closes = 0
"""


def _updated(gaps: DataFrame, placed: DataFrame) -> DataFrame:
    """``gaps`` less what was placed in them; full containers leave."""
    changes = gaps.select("box", "container", "gap").unionByName(placed.select("box", "container", (-F.col("size")).alias("gap")))
    return cut(changes.groupBy("box", "container").agg(F.sum("gap").alias("gap")).where("gap > 0"))


def _stated(items: DataFrame, *by: str) -> list:
    """Number, least, largest and summed size of items by box: a row each."""
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("all")).collect()


def pack(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box, container, item, piece, start, size): where each part of each item goes.

    ``items`` has item (a unique id) and size; ``boxes`` has box (a name, unique)
    and capacity; both may have further columns.  For every box all items are
    packed.  An item over the capacity is divided into full containers and a
    rest, which is packed like an item; ``piece`` counts its parts from 0 and
    ``start`` is where a part begins.  No other item is divided.

    Null and negative sizes count as 0.  Items of size 0 need no space; they
    are spread over the containers there are, or go to container 0.  Boxes with
    a capacity that is null or below 1 are left out.
    """
    spark = items.sparkSession
    given = boxes.where("capacity >= 1").select("box", F.col("capacity").cast("int").alias("capacity")).limit(BOXES + 1).collect()
    if len(given) > BOXES:
        raise ValueError(f"more than {BOXES} boxes")
    if not given:
        return spark.createDataFrame([], f"box string, container long, item {items.schema['item'].dataType.simpleString()}, piece int, start long, size long")
    capacity = {str(b["box"]): b["capacity"] for b in given}
    parts = cut(_parts(items, given))

    # no two items over half of a container share one: each opens its own
    alone = cut(_numbered(parts.where("class = 0").select("box", "capacity", "item", "piece", "start", "size"), "size", "item", "piece"))
    placed = [alone.select("box", F.col("number").alias("container"), "item", "piece", "start", "size")]
    gaps = cut(alone.where("size < capacity").select("box", F.col("number").alias("container"), (F.col("capacity") - F.col("size")).alias("gap")))
    opened = {r["box"]: r["count"] for r in alone.groupBy("box").count().collect()}  # a row a box

    ahead: dict[str, list[tuple]] = {box: [] for box in capacity}
    for r in sorted(_stated(parts.where("class > 0"), "box", "class"), key=lambda r: -r["class"]):
        ahead[r["box"]].append((r["class"], (r["n"], r["low"], r["high"], r["all"])))
    waiting, left, at, stuck = None, {}, {}, set()
    while left or any(ahead.values()):
        begun = [box for box in capacity if box not in left and ahead[box]]
        for box in begun:
            at[box], left[box] = ahead[box].pop()
        started = [parts.where((F.col("box") == box) & (F.col("class") == at[box])).select("box", "item", "piece", "start", "size") for box in begun]
        waiting = reduce(DataFrame.unionByName, started if waiting is None else [waiting, *started])
        bounds = spark.createDataFrame([(box, s[1], s[2], at[box] >= BY_SIZE and (box in begun or box in stuck)) for box, s in left.items()], "box string, low long, high long, by_size boolean")
        room = dict.fromkeys(stuck, 0)
        if begun:
            own = gaps.join(F.broadcast(bounds), "box").where("gap >= low").groupBy("box").agg(F.sum("gap").alias("gap"))
            room |= dict.fromkeys(begun, 0) | {r["box"]: r["gap"] for r in own.collect() if r["box"] in begun}  # a row a box
        fresh = []
        for box, free in room.items():  # as many new containers as are needed at the least
            n, low, _, all_ = left[box]
            more = -(-(all_ - free) // capacity[box])
            if box in stuck:
                more = max(more, -(-n // (capacity[box] // low)))
            if more > 0:
                fresh.append((box, opened.get(box, 0), opened.get(box, 0) + more - 1, capacity[box]))
                opened[box] = opened.get(box, 0) + more
        if fresh:
            new = spark.createDataFrame(fresh, "box string, first long, last long, gap long")
            gaps = gaps.unionByName(new.select("box", F.explode(F.sequence("first", "last")).alias("container"), "gap"))
        swept = _swept(waiting, gaps, bounds)
        went = swept.where("goes").drop("goes")
        waiting = swept.where("NOT goes").drop("goes", "container")
        before, left = left, {r["box"]: (r["n"], r["low"], r["high"], r["all"]) for r in _stated(waiting, "box")}
        stuck = {box for box in left if left[box][0] == before[box][0]}
        placed.append(went.select("box", "container", "item", "piece", "start", "size"))
        gaps = _updated(gaps, went)

    empty = parts.where("class = -1")
    if not empty.isEmpty():
        many = spark.createDataFrame([(box, max(1, opened.get(box, 0))) for box in capacity], "box string, many long")
        empty = empty.join(F.broadcast(many), "box")  # a row a box
        placed.append(empty.select("box", F.pmod(F.xxhash64("item"), F.col("many")).alias("container"), "item", "piece", "start", "size"))
    columns: list[Column] = [F.col("box"), F.col("container").cast("long").alias("container"), F.col("item"), F.col("piece"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size")]
    return reduce(DataFrame.unionByName, placed).select(*columns)
