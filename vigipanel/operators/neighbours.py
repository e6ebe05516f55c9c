"""Neighbour graphs: contiguity of polygons, nearest centroids, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigipanel import fixed_values as fv
from vigipanel.session import cut_lineage

LEVELS = (6, 12, 20, 28, 36, 44, 52)     # tried as the finest until no cell is crowded
_CROWDED = 64
_GRID_START = 0.3819660112501051     # where in a cell the origin lies
_TASK_POINTS = 2_000      # points that a task finds candidates for, about
_BROADCAST_LEVELS = 5     # at most 4**6 / 3 cells on levels 0..5


def centroids(rings: DataFrame) -> DataFrame:
    """Area centroid of each polygon from its ring (shoelace sums).

    ``rings``: ``code, ring, seq, x, y`` in ring order, the first vertex not
    repeated.  The sums are taken about the first vertex of the ring, which
    keeps them exact for small polygons far from the origin; holes (clockwise
    rings) subtract.
    """
    order = Window.partitionBy("code", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(order), F.first("x").over(whole))
    ny = F.coalesce(F.lead("y").over(order), F.first("y").over(whole))
    moved = rings.select(
        "code", "ring", F.first("x").over(whole).alias("ox"), F.first("y").over(whole).alias("oy"),
        "x", "y", nx.alias("nx"), ny.alias("ny"),
    )
    ax, ay = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    bx, by = F.col("nx") - F.col("ox"), F.col("ny") - F.col("oy")
    cross = ax * by - bx * ay
    per_ring = moved.groupBy("code", "ring", "ox", "oy").agg(
        (F.sum(cross) / 2).alias("a"),
        (F.sum((ax + bx) * cross) / 6).alias("mx"),
        (F.sum((ay + by) * cross) / 6).alias("my"),
    )
    return per_ring.groupBy("code").agg(
        F.try_divide(F.sum(F.col("mx") + F.col("a") * F.col("ox")), F.sum("a")).alias("cx"),
        F.try_divide(F.sum(F.col("my") + F.col("a") * F.col("oy")), F.sum("a")).alias("cy"),
    )


def boundary_segments(rings: DataFrame) -> DataFrame:
    """``code, ax, ay, bx, by``: the sides of all rings, without those of no length."""
    order = Window.partitionBy("code", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = rings.select(
        "code", "ring", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"),
        F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).cast("double").alias("bx"),
        F.coalesce(F.lead("y").over(order), F.first("y").over(whole)).cast("double").alias("by"),
    )
    # repeated sides of a ring meet nothing more; the rows of a ring already lie together
    return sides.where("ax <> bx OR ay <> by").select("code", "ring", "ax", "ay", "bx", "by").distinct().drop("ring")


def _spans(tolerance: float, level):
    """The cells of a level (side 2 ** level) that the box of a segment meets, one to three each way: first and last column and row.

    The grid starts off the round numbers on which drawn corners like to lie.
    """
    side = F.pow(F.lit(2.0), level)

    def cell(at):
        return F.floor(at / side + F.lit(_GRID_START))

    return [
        edge.alias(name) for one, two, names in (("ax", "bx", ("x0", "x1")), ("ay", "by", ("y0", "y1")))
        for edge, name in ((cell(F.least(one, two) - tolerance), names[0]), (cell(F.greatest(one, two) + tolerance), names[1]))
    ]


def _in_cells(segments: DataFrame, tolerance: float, code: str, name: str) -> DataFrame:
    """``code``, the segment as ``name`` with its first cell, and ``level, gx, gy``: one row per cell of the level."""
    spans = segments.select("*", *_spans(tolerance, F.col("level")))
    held = spans.select(
        F.col("code").alias(code), F.struct("ax", "ay", "bx", "by", "ux", "uy", "length", "own", "x0", "y0").alias(name),
        "level", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("gx"),
    )
    return held.select(code, name, "level", "gx", F.explode(F.sequence("y0", "y1")).alias("gy"))


def _near(tolerance: float):
    """Whether the boxes of segments p and q come close enough to touch, with room for rounding."""
    room = F.lit(4 * tolerance) + F.lit(1e-9) * (F.col("p.length") + F.col("q.length"))

    def apart(one: str, two: str):
        low, high = [lambda s, f=f: f(F.col(f"{s}.{one}"), F.col(f"{s}.{two}")) for f in (F.least, F.greatest)]
        return F.greatest(low("p"), low("q")) - F.least(high("p"), high("q"))

    return (apart("ax", "bx") <= room) & (apart("ay", "by") <= room)


def _with_touch(pairs: DataFrame, tolerance: float) -> DataFrame:
    """``one, two, touch`` of segments p and q: 2 along a part of positive length, 1 in a point, 0 not at all."""
    def placed(s: str, x: str, y: str, names: tuple[str, str]):
        """Where a point lies along a segment and how far beside it (signed)."""
        dx, dy = F.col(x) - F.col(f"{s}.ax"), F.col(y) - F.col(f"{s}.ay")
        ux, uy = F.col(f"{s}.ux"), F.col(f"{s}.uy")
        return (dx * ux + dy * uy).alias(names[0]), (dx * uy - dy * ux).alias(names[1])

    # columns of their own, so that each is computed once
    at = pairs.select(
        "one", "two", F.col("p.length").alias("lp"), F.col("q.length").alias("lq"),
        *placed("p", "q.ax", "q.ay", ("t1", "d1")), *placed("p", "q.bx", "q.by", ("t2", "d2")),
        *placed("q", "p.ax", "p.ay", ("u1", "e1")), *placed("q", "p.bx", "p.by", ("u2", "e2")),
    )

    def along(t1, t2, d1, d2, length):
        common = F.least(F.greatest(t1, t2), length) - F.greatest(F.least(t1, t2), F.lit(0.0))
        return (F.abs(d1) <= tolerance) & (F.abs(d2) <= tolerance) & (common > tolerance)

    def on(t, d, length):
        return (F.abs(d) <= tolerance) & (F.col(t) >= -tolerance) & (F.col(t) <= F.col(length) + tolerance)

    point = on("t1", "d1", "lp") | on("t2", "d2", "lp") | on("u1", "e1", "lq") | on("u2", "e2", "lq") | (
        (F.col("d1") * F.col("d2") < 0) & (F.col("e1") * F.col("e2") < 0))
    run = along("t1", "t2", "d1", "d2", F.col("lp")) | along("u1", "u2", "e1", "e2", F.col("lq"))
    return at.select("one", "two", F.when(run, 2).when(point, 1).otherwise(0).alias("touch"))


def met_sides(rings: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``one, two, p, q``: the sides p and q of two polygons that may touch, each pair of sides once.

    Segments meet in square cells: each stands in the cells of the level as
    coarse as itself, and looks into those of every coarser level that occurs,
    so a cell holds few segments of its own however uneven the detail is.  Of all
    cells that two segments share only the first brings them together, and two
    of one level meet in one order only.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sides = boundary_segments(rings).withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumns({
        "ux": dx / F.col("length"), "uy": dy / F.col("length"),
        "own": F.ceil(F.log2(F.greatest(F.abs(dx), F.abs(dy)))).cast("int"),
    })
    sides = cut_lineage(sides)
    levels = sorted(r[0] for r in sides.select("own").distinct().collect())        # as many as there are binary orders of lengths
    coarser = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("own"))
    stand = _in_cells(sides.withColumn("level", F.col("own")), tolerance, "code", "p")
    look = _in_cells(sides.withColumn("level", F.explode(coarser)), tolerance, "other", "q")
    first_cell = (F.col("gx") == F.greatest("p.x0", "q.x0")) & (F.col("gy") == F.greatest("p.y0", "q.y0"))
    once = F.when(F.col("p.own") == F.col("q.own"), F.col("code") < F.col("other")).otherwise(F.col("code") != F.col("other"))
    met = stand.join(look, ["level", "gx", "gy"]).where(first_cell & once & _near(tolerance))
    return met.select(F.least("code", "other").alias("one"), F.greatest("code", "other").alias("two"), "p", "q")


def contiguity(rings: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Directed contacts with their type and row-normalised weights.

    Two polygons touch where their boundaries meet; they share an edge where the
    boundaries run together for more than ``tolerance``, be it along whole sides
    or a part of one.
    """
    pairs = met_sides(rings, tolerance)
    found = _with_touch(pairs, tolerance).groupBy("one", "two").agg(F.max("touch").alias("touch")).where("touch > 0")
    both = found.select(F.inline(F.array(
        F.struct(F.col("one").alias("src"), F.col("two").alias("dst"), "touch"), F.struct(F.col("two").alias("src"), F.col("one").alias("dst"), "touch"),
    )))
    typed = both.select("src", "dst", F.when(F.col("touch") == 2, fv.CONTACT_EDGE).otherwise(fv.CONTACT_POINT).alias("contact"))
    return row_normalised(cut_lineage(typed), fv.QUEEN)


def row_normalised(edges: DataFrame, rule: str) -> DataFrame:
    """Equal weights that sum to one per source, and the neighbour count."""
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("neighbours"))
    return (
        edges.join(counts, "src")
        .withColumn("binary_weight", F.lit(1))
        .withColumn("weight", F.lit(1.0) / F.col("neighbours"))
        .withColumn("rule", F.lit(rule))
    )


def edge_contacts_only(edges: DataFrame, rule: str = fv.ROOK) -> DataFrame:
    """The rook subset, weights normalised anew."""
    return row_normalised(
        edges.where(F.col("contact") == fv.CONTACT_EDGE).select("src", "dst", "contact"), rule
    )


def _cell(level, low, extent, value):
    """Cell number on a level; the far border belongs to the last cell."""
    cells = F.pow(F.lit(2.0), level)
    raw = F.floor(F.try_divide(F.col(value) - low, extent) * cells)
    return F.coalesce(F.least(raw, cells.cast("long") - 1), F.lit(0).cast("long"))


def nearest(points: DataFrame, k: int = 4) -> DataFrame:
    """The k nearest other points of each point, ties by code; exact.

    Points with equal coordinates are one location; of its codes only the first
    k + 1 can be anybody's neighbour.  Each location picks the finest square
    cell (of levels halving the side) that holds enough points; all its
    neighbours then lie within two cells, so it meets 25 cells by an equality
    join.  A location in thin country reaches a crowded cell only from near
    by, which bounds the candidates without dropping any.  The finest level
    follows from the data, up to the precision of the coordinates, so one far
    point does not press all others into one cell.
    """
    named = points.select("code", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    named = cut_lineage(named)
    by_code = Window.partitionBy("x", "y").orderBy("code")
    sizes = named.groupBy("x", "y").agg(F.count(F.lit(1)).alias("size"))
    first = (
        named.withColumn("_r", F.row_number().over(by_code)).where(F.col("_r") <= k + 1)
        .groupBy("x", "y").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    )
    places = first.join(sizes, ["x", "y"])
    low_x = named.agg(F.min("x")).scalar()
    low_y = named.agg(F.min("y")).scalar()
    extent = named.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).scalar()
    boxed = cut_lineage(places.withColumn("_lx", low_x).withColumn("_ly", low_y).withColumn("_e", extent))

    def on_level(df, level):
        return (
            df.withColumn("gx", _cell(level, F.col("_lx"), F.col("_e"), "x"))
            .withColumn("gy", _cell(level, F.col("_ly"), F.col("_e"), "y"))
        )

    finest = LEVELS[-1]
    for level in LEVELS:
        cells = on_level(boxed, F.lit(level)).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("held"))
        if (cells.agg(F.max("held")).first()[0] or 0) <= max(_CROWDED, 4 * (k + 1)):
            finest = level
            break
    leveled = on_level(
        boxed.select("*", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")), F.col("level")
    )
    filled = leveled.groupBy("level", "gx", "gy").agg(F.sum("size").alias("held")).where(F.col("held") > k)
    coarse = F.broadcast(filled.where(F.col("level") <= _BROADCAST_LEVELS))
    fine = filled.where(F.col("level") > _BROADCAST_LEVELS)
    place = ["x", "y"]
    cell = ["level", "gx", "gy"]
    chosen = (
        leveled.where(F.col("level") <= _BROADCAST_LEVELS).join(coarse, cell, "left_semi").select(*place, "level")
        .unionByName(
            leveled.where(F.col("level") > _BROADCAST_LEVELS).join(fine, cell, "left_semi").select(*place, "level")
        )
        .groupBy(*place).agg(F.max("level").alias("level"))
    )
    # fewer than k + 1 points in all: no cell is full, everything is in cell 0
    asking = on_level(
        boxed.select(*place, "_lx", "_ly", "_e").join(chosen, place, "left")
        .withColumn("level", F.coalesce("level", F.lit(0))), F.col("level"),
    )
    reach = F.sequence(F.lit(-2), F.lit(2))
    asking = (
        asking.select(F.col("x").alias("qx"), F.col("y").alias("qy"), "level", "gx", "gy", F.explode(reach).alias("_dx"))
        .select("*", F.explode(reach).alias("_dy"))
        .select("qx", "qy", "level", (F.col("gx") + F.col("_dx")).alias("gx"), (F.col("gy") + F.col("_dy")).alias("gy"))
    )
    levels_used = leveled.join(asking.select(*cell).distinct(), cell, "left_semi")
    # a small table makes many candidates, so the parts follow from the points and not from their bytes
    parts = max(-(-boxed.count() // _TASK_POINTS), 1)
    if parts > 1:
        asking, levels_used = asking.repartition(parts, *cell), levels_used.repartition(parts, *cell)
    square = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    near = Window.partitionBy("qx", "qy").orderBy("d2", "dst")
    met = (
        asking.join(levels_used.select(*cell, "x", "y", "codes"), cell)
        .select("qx", "qy", square.alias("d2"), F.explode("codes").alias("dst"))
        .withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1)
        .groupBy("qx", "qy")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "dst"))).alias("found"))
    )
    own = named.join(met, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")))
    others = F.slice(F.filter("found", lambda e: e["dst"] != F.col("code")), 1, k)
    return (
        own.select(F.col("code").alias("src"), F.explode(others).alias("e"))
        .select(
            "src", F.col("e.dst").alias("dst"), F.lit(fv.CONTACT_CENTROID).alias("contact"),
            F.sqrt("e.d2").alias("distance"), F.lit(1).alias("binary_weight"),
            F.lit(1.0 / k).alias("weight"), F.lit(k).alias("neighbours"),
            F.lit(f"{fv.KNN_PREFIX}{k}").alias("rule"),
        )
    )
