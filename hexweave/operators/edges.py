"""Polygons as an index of their edges by grid square.

A square holds the edges that meet it and the parity of one reference point inside it. Whether a point of the square
is inside then depends on the edges between the point and that reference alone, first along the point's latitude,
then along the reference's meridian. A square with more than `MOST` edges is cut into four, whose references get
their parity from the square's edges in the same way; squares without an edge are wholly inside or left out. So a point or a segment
costs what its squares hold, however long the polygon's rings are.

Building is row by row: a square's row becomes the rows of its quarters. The result is the even-odd rule of
`geometry.point_in_rings`, half-open edges included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import as_column
from hexweave.functions.geometry import bounds, over_segments, point_in_rings, rings_of
from hexweave.operators.sizing import shuffle_width
from hexweave.session import fresh_dir, materialize

MOST = 24
FEW = 32  # points of a square that are tested one by one
MAX_LEVEL = 24
ROUNDS = 3  # between two writes
# Where a square's reference stands in it: no vertex shares its meridian or parallel, but for chance.
AT_X, AT_Y = 0.6180339887498949, 0.7320508075688772


@dataclass(frozen=True)
class EdgeIndex:
    """One row per (id, square): level, bx, by, cx, cy, inside, edges; and the levels that occur."""

    squares: DataFrame
    key: str
    levels: list[int]


def span(level) -> Column:
    """Side of a square, in degrees."""
    return F.lit(360.0) / F.pow(F.lit(2.0), as_column(level))


def column_of(x, level) -> Column:
    return F.floor((as_column(x) + 180.0) / span(level))


def row_of(y, level) -> Column:
    return F.floor((as_column(y) + 90.0) / span(level))


def _edges(rings: Column) -> Column:
    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    every = F.flatten(F.transform(rings, lambda ring: over_segments(ring, edge)))
    return F.filter(every, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _along_row(e: Column, y: Column, x0: Column, x1: Column) -> Column:
    """Does the edge part two points of one latitude; the edge's latitudes are half-open."""
    at = e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
    return ((e["ay"] > y) != (e["by"] > y)) & ((x0 < at) != (x1 < at))


def _along_column(e: Column, x: Column, y0: Column, y1: Column) -> Column:
    at = e["ay"] + F.try_divide((x - e["ax"]) * (e["by"] - e["ay"]), e["bx"] - e["ax"])
    return ((e["ax"] > x) != (e["bx"] > x)) & ((y0 < at) != (y1 < at))


def parted(edges: Column, x0, y0, x1, y1) -> Column:
    """Do the edges leave the two points on different sides."""
    x0, y0, x1, y1 = (as_column(v) for v in (x0, y0, x1, y1))

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != parts(e, x0, y0, x1, y1))


def parts(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does one edge leave the two points on different sides."""
    row = F.coalesce(_along_row(e, y0, x0, x1), F.lit(False))
    column = F.coalesce(_along_column(e, x1, y0, y1), F.lit(False))
    return row != column


def inside_square(square: Column, x, y) -> Column:
    """Is a point of a square inside its polygon; ``square`` has cx, cy, inside and edges."""
    return square["inside"] != parted(square["edges"], x, y, square["cx"], square["cy"])


def inside_cut_square(square: Column, x: Column, y: Column) -> Column:
    """`inside_square` of a square with one edge."""
    return square["inside"] != parts(F.get(square["edges"], F.lit(0)), x, y, square["cx"], square["cy"])


def _meets(e: Column, west: Column, south: Column, side: Column) -> Column:
    """Edges that touch a square; the bounds are a little wide, since an edge too many does no harm."""
    half, wide = side / 2, side * (0.5 + 1e-9) + 1e-12
    x, y = west + half, south + half
    box = (
        (F.least(e["ax"], e["bx"]) <= x + wide) & (F.greatest(e["ax"], e["bx"]) >= x - wide)
        & (F.least(e["ay"], e["by"]) <= y + wide) & (F.greatest(e["ay"], e["by"]) >= y - wide)
    )
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    return box & (F.abs(dx * (y - e["ay"]) - dy * (x - e["ax"])) <= wide * (F.abs(dx) + F.abs(dy)) * (1 + 1e-9))


def _square(level: Column, bx: Column, by: Column, parity, edges: Column) -> Column:
    side = span(level)
    west, south = bx * side - 180.0, by * side - 90.0
    cx, cy = west + side * AT_X, south + side * AT_Y
    return F.struct(
        level.cast("int").alias("level"), bx.cast("long").alias("bx"), by.cast("long").alias("by"), cx.alias("cx"), cy.alias("cy"),
        parity(cx, cy).alias("inside"), F.filter(edges, lambda e: _meets(e, west, south, side)).alias("edges"),
    )


def _children(s: Column) -> Column:
    """The four squares of a square."""
    def child(i: int, j: int) -> Column:
        return _square(
            s["level"] + 1, s["bx"] * 2 + i, s["by"] * 2 + j,
            lambda cx, cy: s["inside"] != parted(s["edges"], s["cx"], s["cy"], cx, cy), s["edges"],
        )

    return F.array(*[child(i, j) for i in (0, 1) for j in (0, 1)])


def _cut_children(rows: DataFrame, key: str, level: int) -> DataFrame:
    """(key, s), the four squares of each square of ``rows``, all of one level and with one edge.

    What `_children` works out by walking lists, in steps that are compiled: each step's columns are used more than once, so
    that Spark does not write them out at each place, and the last explode keeps later filters from repeating it.
    """
    s, k, side = F.col("s"), F.col("_k"), F.lit(360.0 / 2.0 ** (level + 1))
    own = F.get(s["edges"], F.lit(0))
    flat = rows.select(
        F.col(key), s["bx"].alias("_px"), s["by"].alias("_py"), s["cx"].alias("_cx"), s["cy"].alias("_cy"), s["inside"].alias("_in"), s["edges"].alias("_edges"),
        *[own[c].alias(f"_e{c}") for c in ("ax", "ay", "bx", "by")], F.explode(F.array(*[F.lit(n) for n in range(4)])).alias("_k"),
    )
    at = flat.withColumns({"_bx": F.col("_px") * 2 + F.shiftright(k, 1), "_by": F.col("_py") * 2 + k.bitwiseAND(F.lit(1))})
    at = at.withColumns({"_west": F.col("_bx") * side - 180.0, "_south": F.col("_by") * side - 90.0})
    at = at.withColumns({"_x": F.col("_west") + side * AT_X, "_y": F.col("_south") + side * AT_Y})
    e = {c: F.col(f"_e{c}") for c in ("ax", "ay", "bx", "by")}
    at = at.withColumns({
        "_inside": F.col("_in") != parts(e, F.col("_cx"), F.col("_cy"), F.col("_x"), F.col("_y")),
        "_meets": F.coalesce(_meets(e, F.col("_west"), F.col("_south"), side), F.lit(False)),
    })
    child = F.struct(
        F.lit(level + 1).alias("level"), F.col("_bx").alias("bx"), F.col("_by").alias("by"), F.col("_x").alias("cx"), F.col("_y").alias("cy"),
        F.col("_inside").alias("inside"), F.when(F.col("_meets"), F.col("_edges")).otherwise(F.slice("_edges", 1, 0)).alias("edges"),
    )
    return at.select(F.col(key), F.explode(F.array(child)).alias("s"))


def _quarters(s: Column) -> Column:
    """The four squares of a square that holds too much, or the square itself."""
    return F.when(_open(s), _children(s)).otherwise(F.array(s))


def _open(s: Column) -> Column:
    return (F.size(s["edges"]) > MOST) & (s["level"] < MAX_LEVEL)


def edge_index(polygons: DataFrame, key: str, ring: str = "ring") -> EdgeIndex:
    """The index of ``ring`` (a ring, polygon or multipolygon) of every row of ``polygons``, named by ``key``.

    A shape starts at the finest level whose squares are as wide as its box, so on four squares at most. NULL and empty
    shapes have none. Rows are dealt to the tasks again while squares are cut, so one huge shape does not stay in one.
    """
    spark = polygons.sparkSession
    folder = fresh_dir(spark, "edges")
    shapes = polygons.select(F.col(key), rings_of(polygons, ring).alias("_rings"))
    shapes = shapes.withColumn("_box", bounds(F.flatten("_rings"))).where("_box.west is not null").withColumn("_edges", _edges(F.col("_rings")))
    wide = F.greatest(F.col("_box.east") - F.col("_box.west"), F.col("_box.north") - F.col("_box.south"))
    level = F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / F.greatest(wide, F.lit(1e-9)))))).cast("int")

    def between(low: Column, high: Column, place) -> Column:
        return F.explode(F.sequence(place(low, F.col("_level")), place(high, F.col("_level"))))

    started = (
        shapes.withColumn("_level", level).withColumn("_bx", between(F.col("_box.west"), F.col("_box.east"), column_of))
        .withColumn("_by", between(F.col("_box.south"), F.col("_box.north"), row_of))
    )
    first = _square(
        F.col("_level"), F.col("_bx"), F.col("_by"), lambda cx, cy: point_in_rings("_rings", cx, cy), F.col("_edges")
    )
    rows, turn = started.select(key, first.alias("s")), 0
    schema = rows.schema
    while True:
        rows.where(F.col("s.inside") | (F.size("s.edges") > 0)).write.parquet(f"{folder}/cut{turn}")
        rows = spark.read.schema(schema).parquet(f"{folder}/cut{turn}")
        found = rows.groupBy("s.level").agg(F.max(_open(F.col("s"))).alias("open")).collect()
        if not any(r["open"] for r in found):
            break
        turn += 1
        for _ in range(ROUNDS):
            rows = rows.select(key, F.explode(_quarters(F.col("s"))).alias("s"))
        rows = rows.repartition(shuffle_width(spark), key, "s.bx", "s.by")
    return EdgeIndex(rows.select(key, "s.*"), key, sorted(r["level"] for r in found))


def with_holders(points: DataFrame, index: EdgeIndex, x: str, y: str, out: str) -> DataFrame:
    """``points`` with ``out``, the array of the shapes that contain each.

    One left join per level that occurs, with the list of shapes of each square: broadcast below
    ``spark.sql.autoBroadcastJoinThreshold``, shuffled above. A list holds the shapes that overlap at one place, at most
    `MOST` edges each.
    """
    found = F.array().cast(f"array<{index.squares.schema[index.key].dataType.simpleString()}>")
    names = points.columns
    points = points.withColumn(out, found)
    for level in index.levels:
        items = F.struct(F.col(index.key).alias("key"), "cx", "cy", "inside", "edges")
        here = index.squares.where(F.col("level") == level).groupBy(F.col("bx").alias("_bx"), F.col("by").alias("_by")).agg(
            F.collect_list(items).alias("_items")
        )
        located = points.withColumn("_bx", column_of(F.col(x), F.lit(level))).withColumn("_by", row_of(F.col(y), F.lit(level)))
        holders = F.transform(F.filter("_items", lambda s: inside_square(s, F.col(x), F.col(y))), lambda s: s["key"])
        points = located.join(here, ["_bx", "_by"], "left").select(
            *[F.col(f"`{c}`") for c in names], F.when(F.col("_items").isNull(), F.col(out)).otherwise(F.concat(out, holders)).alias(out)
        )
    return points


# --- totals --------------------------------------------------------------------------


@dataclass(frozen=True)
class Met:
    """Shapes' squares met with the points of each level: by level, rows of (key, s, n, sums, closed)."""

    levels: dict[int, DataFrame]
    points: DataFrame
    key: str
    x: str
    y: str
    sums: list[str]

    def located(self, points: DataFrame, level: int) -> DataFrame:
        """Points with the square of a level they are in."""
        return points.withColumn("_bx", column_of(F.col(self.x), F.lit(level))).withColumn("_by", row_of(F.col(self.y), F.lit(level)))

    def within(self, level: int) -> DataFrame:
        """Squares wholly inside their shape: its share of the points is their sums."""
        return self.levels[level].where(F.size("s.edges") == 0)

    def tested(self, level: int) -> DataFrame:
        """Squares with edges and few points, which are tested one by one."""
        rows = self.levels[level].where((F.size("s.edges") > 0) & F.col("closed")).select(self.key, "s")
        # The rows are few bytes and much arithmetic, as in `lengths_inside`.
        return rows.repartition(shuffle_width(rows.sparkSession), "s.bx", "s.by")


def meet(points: DataFrame, index: EdgeIndex, x: str, y: str, sums: dict[str, Column | str]) -> Met:
    """Go down from the squares of ``index`` until each is without edges, without points, or holds `FEW` of them at most.

    So a shape costs the squares along its outline, however many points it holds, and points and shapes that overlap never
    meet in pairs. One join per level with the points' count and sums by square; each level is written.
    """
    spark, folder, key = points.sparkSession, fresh_dir(points.sparkSession, "met"), index.key
    names = list(sums)
    points = materialize(points.select(x, y, *[as_column(c).alias(name) for name, c in sums.items()]), "points")
    met, rest = Met({}, points, key, x, y, names), None
    last = max(index.levels, default=-1)
    for level in range(min(index.levels, default=0), MAX_LEVEL + 1):
        rows = rest
        if level in index.levels:
            own = index.squares.where(F.col("level") == level).select(key, F.struct(*[c for c in index.squares.columns if c != key]).alias("s"))
            rows = own if rest is None else rest.unionByName(own)
        if rows is None:
            continue
        here = met.located(points, level).groupBy("_bx", "_by").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
        here = materialize(here.dropna(subset=["_bx", "_by"]), "counts")
        closed = (F.col("n") <= FEW) | F.lit(level == MAX_LEVEL)
        found = rows.join(here, (F.col("s.bx") == F.col("_bx")) & (F.col("s.by") == F.col("_by"))).select(
            key, "s", "n", *names, closed.alias("closed")
        )
        found.write.parquet(f"{folder}/level{level}")
        met.levels[level] = spark.read.schema(found.schema).parquet(f"{folder}/level{level}")
        far = met.levels[level].where((F.size("s.edges") > 0) & ~F.col("closed"))
        rest = None
        if not far.isEmpty():
            far = far.select(key, "s").repartition(shuffle_width(spark), key, "s.bx", "s.by")
            # Below the first levels nearly all squares have one edge.
            listed = far.where(F.size("s.edges") > 1).select(key, F.explode(_children(F.col("s"))).alias("s"))
            rest = _cut_children(far.where(F.size("s.edges") == 1), key, level).unionByName(listed)
            rest = rest.where(F.col("s.inside") | (F.size("s.edges") > 0))
        elif level >= last:
            break
    return met


def totals(met: Met) -> DataFrame:
    """Per shape that holds a point: n, the number of its points, and their sums."""
    out = None
    for level in met.levels:
        own, here = met.located(met.points, level), (F.col("s.bx") == F.col("_bx")) & (F.col("s.by") == F.col("_by"))
        both, one = met.within(level).select(met.key, "n", *met.sums), F.size("s.edges") == 1
        for which, test in ((one, inside_cut_square), (~one, inside_square)):
            held = met.tested(level).where(which).join(own, here & test(F.col("s"), F.col(met.x), F.col(met.y)))
            both = both.unionByName(held.select(met.key, F.lit(1).cast("bigint").alias("n"), *met.sums))
        out = both if out is None else out.unionByName(both)
    return out.groupBy(met.key).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in met.sums])


def outside_all(met: Met) -> DataFrame:
    """Points that lie in no shape, those without coordinates among them."""
    rest, columns = met.points, met.points.columns
    at = ["_bx", "_by"]
    for level in met.levels:
        covered = met.within(level).select(F.col("s.bx").alias("_bx"), F.col("s.by").alias("_by")).distinct()
        rest = met.located(rest, level).join(covered, at, "left_anti").select(*columns)
    rest = materialize(rest, "rest")
    for level in met.levels:
        inside = (F.col("s.bx") == F.col("_bx")) & (F.col("s.by") == F.col("_by")) & inside_square(F.col("s"), F.col(met.x), F.col(met.y))
        rest = met.located(rest, level).join(met.tested(level).select("s"), inside, "left_anti").select(*columns)
    return rest


# --- segments ------------------------------------------------------------------------


def _touched(rows: DataFrame) -> DataFrame:
    """``rows`` with bx, by: the squares of a level and its range (low, high) that a segment s runs through, column after column."""
    ax, ay, bx, by, level = (F.col(c) for c in ("s.ax", "s.ay", "s.bx", "s.by", "level"))
    side = span(level)

    def steps(first: Column, last: Column) -> Column:
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    west, east = F.least(ax, bx), F.greatest(ax, bx)
    first, last = F.greatest(column_of(west, level), F.col("low.bx")), F.least(column_of(east, level), F.col("high.bx"))
    at = F.col("bx")

    def height(x: Column, end: Column) -> Column:
        return F.coalesce(ay + F.try_divide((x - ax) * (by - ay), bx - ax), end)

    y0 = height(F.greatest(west, at * side - 180.0), ay)
    y1 = height(F.least(east, (at + 1) * side - 180.0), by)
    low = F.greatest(row_of(F.least(F.col("_y0"), F.col("_y1")), level), F.col("low.by"))
    high = F.least(row_of(F.greatest(F.col("_y0"), F.col("_y1")), level), F.col("high.by"))
    # Two rows made of one each: a list of lists would be worked out by the element, in the slow way.
    return rows.withColumn("bx", steps(first, last)).withColumn("_y0", y0).withColumn("_y1", y1).withColumn("by", steps(low, high))


def _share_inside() -> Column:
    """Share of a segment (s) that lies in a square (q) and inside the square's shape."""
    s, q = F.col("s"), F.col("q")
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    side = span(q["level"])

    def enter_leave(low: Column, start: Column, d: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low - start, d), F.try_divide(low + side - start, d)
        return F.coalesce(F.least(a, b), F.lit(0.0)), F.coalesce(F.greatest(a, b), F.lit(1.0))

    (x0, x1), (y0, y1) = enter_leave(q["bx"] * side - 180.0, s["ax"], dx), enter_leave(q["by"] * side - 90.0, s["ay"], dy)
    t0, t1 = F.greatest(F.lit(0.0), x0, y0), F.least(F.lit(1.0), x1, y1)

    def cuts(t: Column) -> Column:
        def cut(e: Column) -> Column:
            ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
            return F.try_divide((e["ax"] - t["ax"]) * ey - (e["ay"] - t["ay"]) * ex, t["dx"] * ey - t["dy"] * ex)

        def side_of(x: Column, y: Column) -> Column:
            return t["dx"] * (y - t["ay"]) - t["dy"] * (x - t["ax"])

        def ends_apart(e: Column) -> Column:
            """Does the edge reach the segment's line; one that ends a hair off does."""
            a, b = side_of(e["ax"], e["ay"]), side_of(e["bx"], e["by"])
            return ((a <= t["hair"]) | (b <= t["hair"])) & ((a >= -t["hair"]) | (b >= -t["hair"]))

        met = F.filter(F.transform(F.filter(q["edges"], ends_apart), cut), lambda c: (c > t["t0"]) & (c < t["t1"]))
        stops = F.array_sort(F.concat(F.array(t["t0"]), met, F.array(t["t1"])))

        def piece(a: Column, b: Column) -> Column:
            mid = (a + b) / 2
            return F.struct((t["ax"] + mid * t["dx"]).alias("x"), (t["ay"] + mid * t["dy"]).alias("y"), (b - a).alias("long"))

        def pieces(stops: Column) -> Column:
            n = F.size(stops) - 1
            return F.zip_with(F.slice(stops, F.lit(1), n), F.slice(stops, F.lit(2), n), piece)

        def add(total: Column, p: Column) -> Column:
            return total + F.when(inside_square(q, p["x"], p["y"]), p["long"]).otherwise(F.lit(0.0))

        return F.aggregate(F.transform(F.array(stops), pieces)[0], F.lit(0.0), add)

    # Lambda variables are computed once per row, columns at each place they are used at.
    ends = F.struct(
        t0.alias("t0"), t1.alias("t1"), s["ax"].alias("ax"), s["ay"].alias("ay"), dx.alias("dx"), dy.alias("dy"),
        ((F.abs(dx) + F.abs(dy)) * 1e-9).alias("hair"),
    )
    partly = F.transform(F.array(ends), cuts)[0]
    whole = F.when(q["inside"], t1 - t0).otherwise(F.lit(0.0))
    return F.when(t1 > t0, F.when(F.size(q["edges"]) == 0, whole).otherwise(partly)).otherwise(F.lit(0.0))


def lengths_inside(segments: DataFrame, index: EdgeIndex, measure: str, out: str) -> DataFrame:
    """Per shape, the sum over its segments of ``measure`` times the share of the segment inside it.

    ``segments`` has the index's key and s (ax, ay, bx, by). A segment meets only its own squares of its shape.
    """
    key = index.key
    low, high = (F.struct(f("bx").alias("bx"), f("by").alias("by")) for f in (F.min, F.max))
    used = index.squares.groupBy(key, "level").agg(low.alias("low"), high.alias("high"))
    rows = _touched(segments.join(used, key)).select(key, measure, "s", "level", "bx", "by")
    squares = index.squares.select(key, "level", "bx", "by", F.struct("level", "bx", "by", "cx", "cy", "inside", "edges").alias("q"))
    # The rows are few bytes and much arithmetic: AQE would put them into few tasks.
    rows = rows.repartition(shuffle_width(segments.sparkSession), key, "level", "bx", "by")
    met = rows.join(squares, [key, "level", "bx", "by"])
    return met.groupBy(key).agg(F.sum(F.col(measure) * _share_inside()).alias(out))
