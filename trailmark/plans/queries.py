"""Every operator of the tracking engine as a query over the cells view, and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import math as fm
from trailmark.functions import tables as table_functions
from trailmark.operators import edits, frames, motion, passes, poses, scoring, segments, tracking
from trailmark.plans.cells import HEIGHT, STRIDE, WIDTH
from trailmark.plans.cells import SQL as CELLS
from trailmark.plans.cells import cells as _cells
from trailmark.session import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIGMA, N = 4.0, 3


def query(sql: str | None = None):
    """Register a function of cells under its name, with its SQL (common table expressions come after the cells view)."""

    def take(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_cells(spark, sf_dir), spark, sf_dir) if f.__code__.co_argcount == 3 else f(_cells(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {CELLS}, {sql.strip()}" if not sql.strip().startswith("SELECT") else f"WITH {CELLS} {sql.strip()}"
        return f

    return take


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


RN = "row_number() OVER (PARTITION BY frame, part ORDER BY p DESC, y, x, event_id)"
TOP = f"ranked AS (SELECT *, {RN} - 1 AS ind FROM cells), points AS (SELECT frame, part, ind, x, y, p FROM ranked WHERE ind < {N})"
SPLIT = "split AS (SELECT *, CASE WHEN x >= 16 THEN 1 ELSE 0 END AS ind FROM cells)"
PLACES = "d AS (SELECT frame, part, x, y, max(p) AS p FROM cells GROUP BY ALL)"
RECELL = """thr AS (SELECT * FROM cells WHERE p > 0.001), f AS (SELECT frame, part, p, event_id, x + 0.5 + ox / 8 AS fx, y + 0.5 + oy / 8 AS fy FROM thr),
 m AS (SELECT frame, part, p, event_id, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, fx - floor(fx) - 0.5 AS ox, fy - floor(fy) - 0.5 AS oy FROM f)"""
PLACED = """SELECT frame, part, x AS cell_x, y AS cell_y, round(greatest(least(x + 0.5 + ox, x + 1 - 1e-6), x + 1e-6), 6) AS x, round(greatest(least(y + 0.5 + oy, y + 1 - 1e-6), y + 1e-6), 6) AS y, round(p, 6) AS p
 FROM g WHERE x >= 0 AND x < 32 AND y >= 0 AND y < 24"""


def points(c: DataFrame, n: int = N) -> DataFrame:
    return frames.top_k(c, n).select("frame", "part", "ind", "x", "y", "p")


def split(c: DataFrame) -> DataFrame:
    return c.withColumn("ind", F.when(F.col("x") >= 16, 1).otherwise(0))


# -- top-k and poses ----------------------------------------------------------------------------------------------------


@query(f"{TOP} SELECT frame, part, ind::INT AS ind, x * 8.0 + 4 + ox AS x, y * 8.0 + 4 + oy AS y, round(p, 6) AS likelihood FROM ranked WHERE ind = 0")
def argmax_pose(c):
    return r6(frames.argmax_pose(c), "likelihood")


@query(f"{TOP} SELECT frame, part, ind::INT AS ind, x * 8.0 + 4 + ox AS x, y * 8.0 + 4 + oy AS y, round(p, 6) AS likelihood FROM ranked WHERE ind < {N}")
def topk_individuals(c):
    return r6(frames.argmax_pose(c, N), "likelihood")


@query("r AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY p DESC, y, x, event_id) AS n FROM cells WHERE p > 0.1) SELECT frame, part, x, y, round(p, 6) AS p FROM r WHERE n <= 10")
def sparsify_threshold_topk(c):
    return r6(frames.top_k(frames.above(c, 0.1), 10).select("frame", "part", "x", "y", "p"), "p")


@query(f"{RECELL}, g AS (SELECT frame, part, x, y, arg_max(ox, (p, -event_id)) AS ox, arg_max(oy, (p, -event_id)) AS oy, max(p) AS p FROM m GROUP BY ALL) {PLACED}")
def sparsify_domination(c):
    return r6(frames.sparsify(c, "OFFSET_DOMINATION", width=WIDTH, height=HEIGHT), "x", "y", "p")


@query(f"{RECELL}, g AS (SELECT frame, part, x, y, avg(ox) AS ox, avg(oy) AS oy, avg(p) AS p FROM m GROUP BY ALL) {PLACED}")
def sparsify_combination(c):
    return r6(frames.sparsify(c, "OFFSET_COMBINATION", width=WIDTH, height=HEIGHT), "x", "y", "p")


@query(f"""{RECELL}, s AS (SELECT frame, part, x, y, arg_max(ox, (p, -event_id)) AS ox, arg_max(oy, (p, -event_id)) AS oy, sum(p) AS s, max(p) AS m FROM m GROUP BY ALL),
 g AS (SELECT frame, part, x, y, ox, oy, s * max(m) OVER w / max(s) OVER w AS p FROM s WINDOW w AS (PARTITION BY frame, part)) {PLACED}""")
def sparsify_summation(c):
    return r6(frames.sparsify(c, "OFFSET_SUMMATION", width=WIDTH, height=HEIGHT), "x", "y", "p")


@query(f"g AS (SELECT * FROM cells WHERE p > 0.001) {PLACED}")
def sparsify_ignore_offsets(c):
    return r6(frames.sparsify(c, "IGNORE_OFFSETS", width=WIDTH, height=HEIGHT), "x", "y", "p")


@query("""s AS (SELECT frame, part, p, floor((x + 0.5) * 8 + ox)::BIGINT + dx AS x, floor((y + 0.5) * 8 + oy)::BIGINT + dy AS y, dx, dy FROM cells, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE p > 0.001),
 g AS (SELECT frame, part, x, y, max(p * exp(-(dx * dx + dy * dy) / 2.0)) AS p FROM s GROUP BY ALL) SELECT frame, part, x, y, round(p, 6) AS p FROM g WHERE p > 0.001""")
def upscale_splat(c):
    return r6(frames.sparsify(c, "UPSCALE"), "p")


@query(ORACLE_SQL["upscale_splat"].removeprefix(f"WITH {CELLS}, "))
def splat_in_sql(c, spark, sf_dir):
    table_functions.register(spark)
    kept = frames.above(c, 0.001)
    return r6(spark.sql("SELECT frame, part, x, y, max(p) AS p FROM splat(TABLE(SELECT * FROM {kept}), 8.0D, 2, 1.0D) GROUP BY ALL HAVING max(p) > 0.001", kept=kept), "p")


@query(f"""{TOP}, best AS (SELECT frame, part, x, y, p FROM points WHERE ind = 0),
 held AS (SELECT frame, part, max(CASE WHEN p >= 0.9 THEN frame END) OVER (PARTITION BY part ORDER BY frame) AS at FROM best)
 SELECT h.part, h.frame, b.x, b.y, round(b.p, 6) AS p, h.frame - h.at AS age FROM held h LEFT JOIN best b ON b.part = h.part AND b.frame = h.at""")
def carried_pass(c, spark, sf_dir):
    best = points(c, 1).select("frame", "part", "x", "y", "p")
    return r6(passes.carried(spark, best, passes.Held(0.9), frames=50), "p")


@query(f"""{SPLIT} SELECT frame, part, ind, round(CASE WHEN sum(p) > 0 THEN sum(x * p) / sum(p) ELSE avg(x) END, 6) AS x, round(CASE WHEN sum(p) > 0 THEN sum(y * p) / sum(p) ELSE avg(y) END, 6) AS y, round(max(p), 6) AS p FROM split GROUP BY ALL""")
def weighted_centroid(c):
    return r6(frames.weighted_centroid(split(c), ("frame", "part", "ind")), "x", "y", "p")


@query(f"""top AS (SELECT * FROM (SELECT *, {RN} AS n FROM cells) WHERE n = 1),
 near AS (SELECT c.*, row_number() OVER (PARTITION BY c.frame, c.part ORDER BY c.p DESC, c.y, c.x, c.event_id) AS n FROM cells c JOIN top t ON c.frame = t.frame AND c.part = t.part WHERE (c.x - t.x) ** 2 + (c.y - t.y) ** 2 <= 9)
 SELECT frame, part, x, y, round(p, 6) AS p FROM near WHERE n = 1""")
def relaxed_maximum(c):
    return r6(frames.relaxed_maximum(c, c, 3.0), "p")


@query(f"""{PLACES} SELECT frame, part, x, y, round(p, 6) AS p FROM d WHERE NOT EXISTS (SELECT 1 FROM d n WHERE n.frame = d.frame AND n.part = d.part AND abs(n.x - d.x) <= 1 AND abs(n.y - d.y) <= 1
 AND (n.x <> d.x OR n.y <> d.y) AND (n.p > d.p OR (n.p = d.p AND NOT (n.x >= d.x AND n.y >= d.y))))""")
def find_peaks(c):
    return r6(frames.find_peaks(c), "p")


@query(f"""{PLACES}, pk AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d n WHERE n.frame = d.frame AND n.part = d.part AND abs(n.x - d.x) <= 1 AND abs(n.y - d.y) <= 1
 AND (n.x <> d.x OR n.y <> d.y) AND (n.p > d.p OR (n.p = d.p AND NOT (n.x >= d.x AND n.y >= d.y)))))
 SELECT pk.frame, pk.part, pk.x AS px, pk.y AS py, round(pk.p, 6) AS peak, round(CASE WHEN sum(d.p) > 0 THEN sum(d.p * (d.x - pk.x)) / sum(d.p) ELSE 0 END, 6) AS dx, round(CASE WHEN sum(d.p) > 0 THEN sum(d.p * (d.y - pk.y)) / sum(d.p) ELSE 0 END, 6) AS dy
 FROM pk JOIN d ON d.frame = pk.frame AND d.part = pk.part AND abs(d.x - pk.x) <= 1 AND abs(d.y - pk.y) <= 1 GROUP BY pk.frame, pk.part, pk.x, pk.y, pk.p""")
def refined_peaks(c):
    return r6(frames.local_refine(c), "peak", "dx", "dy")


# -- two sides ----------------------------------------------------------------------------------------------------------

SIDES = "a AS (SELECT frame, part, x, y, max(p) AS p FROM cells WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT frame, part, x, y, max(p) AS p FROM cells WHERE event_id % 2 = 1 GROUP BY ALL)"


def sides(c):
    return c.filter("event_id % 2 = 0"), c.filter("event_id % 2 = 1")


@query(f"{SIDES} SELECT frame, part, x, y, round(a.p, 6) AS left_p, round(b.p, 6) AS right_p FROM a FULL JOIN b USING (frame, part, x, y)")
def pad_full_outer(c):
    return r6(frames.align(*sides(c)), "left_p", "right_p")


_NTH = ", ".join(f"round(max(p) FILTER (WHERE side = {i}), 6) AS p{i}, round(first(fx ORDER BY p DESC, fy, fx) FILTER (WHERE side = {i}), 6) AS x{i}, round(first(fy ORDER BY p DESC, fy, fx) FILTER (WHERE side = {i}), 6) AS y{i}" for i in range(4))


@query(f"s AS (SELECT frame, part, event_id % 4 AS side, x + 0.5 + ox / 16 AS fx, y + 0.5 + oy / 16 AS fy, p FROM cells) SELECT frame, part, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, {_NTH} FROM s GROUP BY frame, part, floor(fx), floor(fy)")
def align_four(c):
    placed = c.select("frame", "part", (F.col("x") + 0.5 + F.col("ox") / 16).alias("x"), (F.col("y") + 0.5 + F.col("oy") / 16).alias("y"), "p", "event_id")
    out = frames.align_all([placed.filter(F.col("event_id") % 4 == i) for i in range(4)])
    return r6(out, *(f"{k}{i}" for i in range(4) for k in "pxy"))


@query(f"{SIDES} SELECT frame, part, x, y FROM a INTERSECT SELECT frame, part, x, y FROM b")
def coord_intersection(c):
    return frames.common_places(*sides(c))


@query(f"{SIDES} SELECT frame, part, x, y FROM a UNION SELECT frame, part, x, y FROM b")
def coord_union(c):
    return frames.all_places(*sides(c))


@query(f"{SIDES} SELECT frame, part, x, y FROM a EXCEPT SELECT frame, part, x, y FROM b")
def coord_difference(c):
    return frames.only_left(*sides(c))


@query(f"{SIDES} SELECT a.frame, a.part, a.x, a.y, round(coalesce(b.p, 0), 6) AS p FROM a LEFT JOIN b USING (frame, part, x, y)")
def sparse_lookup(c):
    a, b = sides(c)
    return r6(frames.lookup(b, frames.places(a).distinct()), "p")


@query(f"{TOP} SELECT c.frame, c.part, c.x, c.y, c.event_id, round(CASE WHEN t.frame IS NULL THEN c.p ELSE 0 END, 6) AS p FROM cells c LEFT JOIN (SELECT * FROM points WHERE ind = 0) t USING (frame, part, x, y)")
def anti_collision(c):
    return r6(frames.anti_collision(c.select("frame", "part", "x", "y", "event_id", "p"), frames.top_k(c, 1)), "p")


# -- transitions and normalisation ---------------------------------------------------------------------------------------

PAIRS = f"{TOP}, pairs AS (SELECT c.frame, c.part, c.ind, q.ind AS other, c.x - q.x AS dx, c.y - q.y AS dy, c.p, q.p AS pp FROM points c JOIN points q ON c.frame = q.frame + 1 AND c.part = q.part)"


def pairs(c):
    t = points(c)
    return t.join(motion.previous(t.withColumn("other", F.col("ind")), "part", "other"), ["frame", "part"]).select("frame", "part", "ind", "other", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), "p", "pp")


@query(f"{PAIRS} SELECT frame, part, ind, other, round(greatest(exp(-(dx * dx + dy * dy) / 32.0), 0.01), 6) AS g FROM pairs")
def gaussian_transition(c):
    return pairs(c).select("frame", "part", "ind", "other", F.round(fm.gaussian(F.col("dx"), F.col("dy"), SIGMA, 1.0, 0.01), 6).alias("g"))


@query(f"{PAIRS}, q AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM pairs) SELECT frame, part, ind, other, round(CASE WHEN d < 6 THEN greatest(exp(-((d - 6) ** 2) / 8.0), 0.2) ELSE exp(-((d - 6) ** 2) / 8.0) END, 6) AS g FROM q")
def skeleton_transition(c):
    d = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    return pairs(c).select("frame", "part", "ind", "other", F.round(fm.ring(d, F.lit(6.0), F.lit(2.0), 0.2), 6).alias("g"))


@query(f"""{PAIRS}, q AS (SELECT *, floor(abs(dx) * 0.75) AS x0, floor(abs(dy) * 0.75) AS y0, abs(dx) * 0.75 - floor(abs(dx) * 0.75) AS fx, abs(dy) * 0.75 - floor(abs(dy) * 0.75) AS fy FROM pairs)
 SELECT frame, part, ind, other, round((1 - fx) * (1 - fy) * exp(-(x0 * x0 + y0 * y0) / 32.0) + fx * (1 - fy) * exp(-((x0 + 1) ** 2 + y0 * y0) / 32.0) + (1 - fx) * fy * exp(-(x0 * x0 + (y0 + 1) ** 2) / 32.0) + fx * fy * exp(-((x0 + 1) ** 2 + (y0 + 1) ** 2) / 32.0), 6) AS g FROM q""")
def interp_transition(c):
    return pairs(c).select("frame", "part", "ind", "other", F.round(fm.interpolated(F.col("dx"), F.col("dy"), SIGMA, 0.75), 6).alias("g"))


@query("SELECT c.frame, c.part, c.event_id, round(max(ln(CASE WHEN q.p > 0 THEN q.p END) - ((c.x - q.x) ** 2 + (c.y - q.y) ** 2) / 32.0), 6) AS best FROM cells c JOIN cells q ON c.frame = q.frame + 1 AND c.part = q.part GROUP BY ALL")
def max_product_step(c):
    """All cells of a frame against all of the one before."""
    return r6(motion.max_product(c.withColumnRenamed("event_id", "ind"), SIGMA), "best").withColumnRenamed("ind", "event_id")


@query("SELECT frame, part, event_id, round(CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 0 END, 6) AS p FROM cells WINDOW w AS (PARTITION BY frame)")
def joint_normalize(c):
    return r6(frames.normalise(c), "p").select("frame", "part", "event_id", "p")


@query("s AS (SELECT *, CASE WHEN p > 0 THEN ln(p) END AS s FROM cells) SELECT frame, part, event_id, round(s - max(s) OVER (PARTITION BY frame, part), 6) AS score FROM s")
def log_maxnorm(c):
    return r6(frames.log_max_norm(c), "score").select("frame", "part", "event_id", "score")


@query("SELECT frame, part, event_id, round(CASE WHEN p > 0 THEN ln(p) END - ln(CASE WHEN sum(p) OVER w > 0 THEN sum(p) OVER w END), 6) AS score FROM cells WINDOW w AS (PARTITION BY frame, part)")
def log_sumnorm(c):
    return r6(frames.log_sum_norm(c), "score").select("frame", "part", "event_id", "score")


@query("SELECT frame, part, event_id, round(CASE WHEN max(p) OVER w > 0 THEN p / max(p) OVER w ELSE 0 END, 6) AS scaled, floor(CASE WHEN max(p) OVER w > 0 THEN p / max(p) OVER w ELSE 0 END * 255)::INT AS byte FROM cells WINDOW w AS (PARTITION BY frame, part)")
def range_normalize(c):
    return r6(frames.range_norm(c), "scaled").select("frame", "part", "event_id", "scaled", "byte")


@query("""s AS (SELECT *, CASE WHEN p > 0 THEN ln(p) END AS s FROM cells), l AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM s WINDOW w AS (PARTITION BY frame, part))
 SELECT frame, part, event_id, round(CASE WHEN s IS NULL THEN 0 WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END, 6) AS shown FROM l""")
def display_rescale(c):
    return r6(frames.display_log(c), "shown").select("frame", "part", "event_id", "shown")


@query("SELECT frame, part, event_id, round(sqrt(ox * ox + oy * oy) / 8, 6) AS length FROM cells WHERE sqrt(ox * ox + oy * oy) / 8 > 0.3")
def offset_field(c):
    return r6(frames.offset_field(c, 0.3), "length").select("frame", "part", "event_id", "length")


@query("SELECT frame, part, event_id, round(0.5 * exp(0.01 * x * x - 0.001 * x * x * x * x), 6) AS v FROM cells")
def quartic_skeleton(c):
    return c.select("frame", "part", "event_id", F.round(fm.quartic(F.col("x"), 0.01, 0.001, 0.5), 6).alias("v"))


@query(f"{PLACES} SELECT frame, part, y, string_agg(x || ':' || round(p * 10000)::BIGINT, ' ' ORDER BY x) FILTER (p > 0) AS filled FROM d GROUP BY ALL")
def dense_rows(c):
    rows = frames.dense_rows(c, WIDTH)
    named = F.transform("probs", lambda p, i: F.when(p > 0, F.concat(i.cast("string"), F.lit(":"), F.round(p * 10000).cast("long").cast("string"))))
    text = F.array_join(F.filter(named, lambda s: s.isNotNull()), " ")
    return rows.select("frame", "part", "y", F.when(text != "", text).alias("filled"))


@query("SELECT frame, part, event_id, round(1 / (1 + exp(-(p * 8 - 4))), 6) AS p, round(greatest(least(p * 1.5, 1), 0), 6) AS clipped, greatest(least(ox * 2.5, 8), -8) AS ox, greatest(least(oy * 2.5, 8), -8) AS oy FROM cells")
def inference_post(c):
    maps = c.select("frame", "part", "event_id", F.col("p").alias("logit"), F.col("ox").alias("lx"), F.col("oy").alias("ly"), poses.clipped(F.col("p"), 1.5).alias("clipped"))
    return r6(poses.decoded(maps, STRIDE, 2.5, 8.0, -4.0), "p", "clipped")


# -- motion and skeleton -------------------------------------------------------------------------------------------------

MOVES = f"{TOP}, moves AS (SELECT c.frame, c.part, c.ind, min(sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2)) AS moved FROM points c JOIN points q ON c.frame = q.frame + 1 AND c.part = q.part GROUP BY ALL)"
HIST = f"{MOVES}, h AS (SELECT trunc((moved - 1) / 2)::BIGINT * 2 + 1.0 AS bin, count(*) AS freq, avg(moved) AS mean FROM moves WHERE moved >= 1 GROUP BY ALL)"
QUANT = "f AS (SELECT sum(freq) OVER (ORDER BY bin) / sum(freq) OVER () AS f, mean AS v FROM h), g AS (SELECT *, lag(f) OVER (ORDER BY f, v) AS f0, lag(v) OVER (ORDER BY f, v) AS v0 FROM f), m AS (SELECT min(CASE WHEN f0 IS NULL THEN v ELSE v0 + (0.5 - f0) / (f - f0) * (v - v0) END) AS value FROM g WHERE f >= 0.5 AND (f0 IS NULL OR f0 < 0.5))"


@query(f"{MOVES} SELECT frame, part, ind, round(moved, 6) AS moved FROM moves")
def nearest_move(c):
    return r6(motion.nearest_move(points(c)), "moved")


@query(f"{HIST} SELECT bin::DOUBLE AS bin, freq, round(mean, 6) AS mean FROM h")
def motion_histogram(c):
    return r6(motion.histogram(motion.nearest_move(points(c)).filter("moved >= 1"), "moved", 2.0, 1.0), "mean")


@query(f"{HIST}, {QUANT} SELECT round(value / 0.6744897502 * 3, 6) AS sigma FROM m")
def motion_sigma(c):
    return r6(motion.motion_sigma(points(c)), "sigma")


@query(f"{HIST} SELECT arg_max(bin, (freq, -bin))::DOUBLE AS bin, round(sum(freq * mean) / sum(freq), 6) AS avg, round(sqrt(greatest(sum(freq * mean * mean) / sum(freq) - (sum(freq * mean) / sum(freq)) ** 2, 0)), 6) AS std FROM h")
def histogram_summary(c):
    h = motion.histogram(motion.nearest_move(points(c)).filter("moved >= 1"), "moved", 2.0, 1.0)
    return r6(motion.mode(h).crossJoin(F.broadcast(motion.moments(h))), "avg", "std")


LIMBS = f"""{TOP}, parts AS (SELECT DISTINCT part FROM points), e AS (SELECT a.part AS part_a, b.part AS part_b FROM parts a, parts b WHERE a.part < b.part),
 both_ AS (SELECT part_a, part_b, part_a AS part, part_b AS other FROM e UNION ALL SELECT part_a, part_b, part_b, part_a FROM e),
 limbs AS (SELECT part_a, part_b, q.frame, q.part, q.ind, min(sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2)) AS length FROM points q JOIN both_ USING (part) JOIN points c ON c.frame = q.frame + 1 AND c.part = other GROUP BY ALL),
 h AS (SELECT part_a, part_b, trunc(length / 2)::BIGINT * 2.0 AS bin, count(*) AS freq, avg(length) AS mean FROM limbs GROUP BY ALL),
 f AS (SELECT part_a, part_b, sum(freq) OVER (PARTITION BY part_a, part_b ORDER BY bin) / sum(freq) OVER (PARTITION BY part_a, part_b) AS f, mean AS v FROM h),
 g AS (SELECT *, lag(f) OVER w AS f0, lag(v) OVER w AS v0 FROM f WINDOW w AS (PARTITION BY part_a, part_b ORDER BY f, v)),
 med AS (SELECT part_a, part_b, min(CASE WHEN f0 IS NULL THEN v ELSE v0 + (0.5 - f0) / (f - f0) * (v - v0) END) AS value FROM g WHERE f >= 0.5 AND (f0 IS NULL OR f0 < 0.5) GROUP BY ALL),
 dv AS (SELECT part_a, part_b, freq, bin, abs(value - mean) AS v FROM h JOIN med USING (part_a, part_b)),
 df AS (SELECT part_a, part_b, sum(freq) OVER (PARTITION BY part_a, part_b ORDER BY v, bin) / sum(freq) OVER (PARTITION BY part_a, part_b) AS f, v FROM dv UNION ALL SELECT DISTINCT part_a, part_b, 0, 0 FROM h),
 dg AS (SELECT *, lag(f) OVER w AS f0, lag(v) OVER w AS v0 FROM df WINDOW w AS (PARTITION BY part_a, part_b ORDER BY f, v)),
 mad AS (SELECT part_a, part_b, min(CASE WHEN f0 IS NULL THEN v ELSE v0 + (0.5 - f0) / (f - f0) * (v - v0) END) / 0.6744897502 AS s FROM dg WHERE f >= 0.5 AND (f0 IS NULL OR f0 < 0.5) GROUP BY ALL),
 skeleton AS (SELECT part_a, part_b, value AS avg, CASE WHEN s < 0.1 THEN 1 ELSE s END AS std FROM med JOIN mad USING (part_a, part_b))"""


@query(f"{LIMBS} SELECT part_a, part_b, round(avg, 6) AS avg, round(std, 6) AS std FROM skeleton")
def skeleton_edges(c):
    p = points(c)
    return r6(motion.fit_skeleton(p, motion.all_edges(p)), "avg", "std")


@query("x AS (SELECT DISTINCT part FROM cells), e AS (SELECT DISTINCT least(a.part, b.part) AS part_a, greatest(a.part, b.part) AS part_b FROM x a, x b WHERE a.part <> b.part) SELECT * FROM e")
def skeleton_normalised(c):
    p = c.select("part").distinct()
    return motion.undirected(p.select(F.col("part").alias("part_a")).crossJoin(F.broadcast(p.select(F.col("part").alias("part_b")))))


# -- scores --------------------------------------------------------------------------------------------------------------

SCORES = f"""{LIMBS}, sep AS (SELECT a.frame, a.part, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS min_dist, avg(a.p * b.p) AS conf FROM points a JOIN points b ON a.frame = b.frame AND a.part = b.part AND a.ind < b.ind GROUP BY ALL),
 geo AS (SELECT frame, sum(min_dist * conf) AS geometric, count(*) AS paired, min(min_dist) AS closest, max(min_dist) AS widest FROM sep GROUP BY frame),
 ed AS (SELECT part_a AS part, part_b AS other, avg, std FROM skeleton UNION ALL SELECT part_b, part_a, avg, std FROM skeleton), dgr AS (SELECT part, count(*) AS degree FROM ed GROUP BY part),
 lim AS (SELECT a.frame, a.part, a.ind, ed.other, std, degree, min(abs(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - avg)) AS m FROM points a JOIN ed USING (part) JOIN dgr USING (part) LEFT JOIN points b ON b.frame = a.frame AND b.part = ed.other GROUP BY ALL),
 per AS (SELECT frame, sum(coalesce(m, 40) / ({N} * degree)) AS limbs, max(CASE WHEN m IS NULL OR m / std > 3 THEN 1 ELSE 0 END) AS outlying FROM lim GROUP BY frame),
 cnt AS (SELECT frame, count(*) AS n FROM points GROUP BY frame),
 here AS (SELECT frame, count(*) AS here FROM (SELECT DISTINCT frame, part, ind FROM points) JOIN dgr USING (part) GROUP BY frame),
 sc AS (SELECT frame, coalesce(geometric, 0) - coalesce(limbs, 0) - 40.0::DOUBLE / {N} * ((SELECT count(*) FROM dgr) * {N} - coalesce(here, 0)) AS fallback, NOT (n < 5 * {N} OR coalesce(paired, 0) < 5 OR coalesce(closest, 0) <= 1e-9 OR coalesce(outlying, 0) > 0 OR coalesce(widest, 0) < {SIGMA}) AS is_valid
  FROM cnt LEFT JOIN geo USING (frame) LEFT JOIN per USING (frame) LEFT JOIN here USING (frame))"""


def scores(c):
    p = materialize(c.sparkSession, points(c), "points")
    skeleton = materialize(c.sparkSession, motion.fit_skeleton(p, motion.all_edges(p)), "skeleton")
    return scoring.frame_scores(p, 5, N, SIGMA, skeleton, 40.0)


@query(f"{SCORES} SELECT frame, round(fallback, 6) AS fallback, CASE WHEN is_valid THEN round(fallback, 6) END AS score, is_valid FROM sc")
def frame_scores(c):
    return r6(scores(c), "fallback", "score")


@query(f"{SCORES} SELECT frame FROM sc ORDER BY is_valid DESC, fallback DESC, frame LIMIT 1")
def best_frame(c):
    return scoring.best_frame(scores(c))


JUMP = f"""{TOP}, l AS (SELECT *, lag(frame) OVER w AS f, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(p) OVER w AS pp FROM points WINDOW w AS (PARTITION BY part, ind ORDER BY frame)),
 j AS (SELECT frame, max(sqrt((x - px) ** 2 + (y - py) ** 2) / {SIGMA}) AS jump FROM l WHERE f = frame - 1 AND p > 0.1 AND pp > 0.1 GROUP BY frame)"""


@query(f"{JUMP} SELECT frame, round(jump, 6) AS jump FROM j")
def jump_sigma(c):
    return r6(scoring.jumps(points(c), SIGMA), "jump")


@query(f"{JUMP} SELECT frame, round(jump, 6) AS jump FROM j WHERE jump > 4")
def bad_frames(c):
    return r6(scoring.flagged(scoring.jumps(points(c), SIGMA), "jump", 4.0), "jump")


@query(f"""{PAIRS}, w AS (SELECT *, exp(-(dx * dx + dy * dy) / 32.0) * p AS w FROM pairs), q AS (SELECT *, w / sum(w) OVER v AS q, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY frame, part, other)),
 h AS (SELECT frame, part, other, sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END) / log2(max(n)) AS h FROM q WHERE n > 1 GROUP BY ALL), f AS (SELECT frame, max(h) AS h FROM h GROUP BY frame)
 SELECT a.frame, round((a.h + coalesce(b.h, a.h)) / 2, 6) AS entropy FROM f a LEFT JOIN f b ON b.frame = a.frame - 1""")
def entropy_transitions(c):
    return r6(scoring.entropy_of_transitions(points(c), SIGMA), "entropy")


@query(f"{JUMP} SELECT frame, last_value(CASE WHEN jump > 4 THEN frame END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN jump > 4 THEN frame END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM j")
def neighbour_navigation(c):
    s = scoring.jumps(points(c), SIGMA)
    return scoring.neighbours(s, F.col("jump") > 4)


# -- segments ------------------------------------------------------------------------------------------------------------

# Pieces of seven frames; one is solved from its first frame if its number of cells leaves 1 on division by 3.
SEGS = 'seg AS (SELECT frame // 7 AS seg_id, frame // 7 * 7 AS start, frame // 7 * 7 + 7 AS "end", CASE WHEN count(*) % 3 = 1 THEN frame // 7 * 7 ELSE -1 END AS fix FROM cells GROUP BY frame // 7)'


def fixed_segments(c: DataFrame) -> DataFrame:
    start = F.col("seg_id") * 7
    counted = c.groupBy(F.expr("frame div 7").alias("seg_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("seg_id", start.alias("start"), (start + 7).alias("end"), F.when(F.col("n") % 3 == 1, start).otherwise(F.lit(-1)).alias("fix"))


@query(f"{SEGS} SELECT DISTINCT frame, seg_id, fix FROM cells JOIN seg ON frame >= start AND frame < \"end\"")
def frame_to_segment(c):
    return segments.frame_to_segment(c.select("frame").distinct(), fixed_segments(c), 16).select("frame", "seg_id", "fix")


@query(f"""{SEGS}, a AS (SELECT *, last_value(CASE WHEN fix >= 0 THEN seg_id END IGNORE NULLS) OVER (ORDER BY seg_id) AS l, first_value(CASE WHEN fix >= 0 THEN seg_id END IGNORE NULLS) OVER (ORDER BY seg_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM seg)
 SELECT seg_id, coalesce(least(seg_id - l, r - seg_id), 0) AS level, coalesce(seg_id - l < coalesce(r - seg_id, 1000000) AND seg_id > l, false) AS before, CASE WHEN seg_id - l < coalesce(r - seg_id, 1000000) THEN l ELSE coalesce(r, l) END AS anchor FROM a""")
def run_levels(c):
    return segments.run_levels(fixed_segments(c))


@query("SELECT frame, part, event_id, frame // 15 AS piece, frame % 15 AS place FROM cells")
def time_split(c):
    return segments.time_split(c.select("frame", "part", "event_id"), 0.5, 30.0)


@query("SELECT DISTINCT frame, CASE WHEN frame >= 70 THEN 2 WHEN frame >= 30 THEN 1 ELSE 0 END AS piece FROM cells")
def cut_list_split(c):
    return segments.cut_split(c.select("frame").distinct(), [70, 30, 30])


@query(f"{TOP}, t AS (SELECT frame, part, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS high FROM points WHERE ind = 0), c AS (SELECT *, CASE WHEN lag(high) OVER w IS NOT DISTINCT FROM high THEN 0 ELSE 1 END AS ch FROM t WINDOW w AS (PARTITION BY part ORDER BY frame)) SELECT frame, part, high, sum(ch) OVER (PARTITION BY part ORDER BY frame)::BIGINT AS run FROM c")
def run_ids(c):
    t = points(c, 1).select("frame", "part", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("high"))
    return segments.run_ids(t, ("part",), "frame", "high")


ASOF = "l AS (SELECT DISTINCT part, frame FROM cells), r AS (SELECT part, frame, max(event_id) AS v FROM cells WHERE p > 0.5 GROUP BY ALL)"


def _likely(c):
    return c.filter("p > 0.5").groupBy("part", "frame").agg(F.max("event_id").alias("v"))


@query(f"{ASOF} SELECT l.part, l.frame, r.v AS found, r.frame AS found_at FROM l ASOF LEFT JOIN r ON l.part = r.part AND l.frame >= r.frame")
def as_of_lookup(c):
    """For each part and frame the last frame up to it that has a cell of more than a half."""
    return segments.as_of(c.select("part", "frame").distinct(), _likely(c), "frame", ("part",), "v")


@query(f"{ASOF} SELECT l.part, l.frame, r.v AS found, r.frame AS found_at FROM l ASOF LEFT JOIN r ON l.part = r.part AND l.frame <= r.frame")
def as_of_ahead(c):
    return segments.as_of(c.select("part", "frame").distinct(), _likely(c), "frame", ("part",), "v", ahead=True)


@query("SELECT max(frame) + 1 AS frames, count(DISTINCT frame) AS with_cells, count(DISTINCT part) AS parts FROM cells")
def frame_count(c):
    return poses.frame_count(c)


@query("w AS (SELECT * FROM (VALUES (0, 9), (1, 3), (2, 9), (3, 77)) v(ord, frame)) SELECT ord, frame, part, x, y, round(p, 6) AS p FROM w JOIN cells USING (frame)")
def frame_extract(c, spark, sf_dir):
    wanted = spark.sql("SELECT * FROM VALUES (0, 9L), (1, 3L), (2, 9L), (3, 77L) AS v(ord, frame)")
    return r6(poses.frame_extract(c.select("frame", "part", "x", "y", "p"), wanted), "p")


# -- edits ---------------------------------------------------------------------------------------------------------------


@query(f"{TOP} SELECT frame, part, CASE WHEN frame >= 60 THEN (ind + 1) % 3 ELSE ind END AS ind, x, y, round(p, 6) AS p FROM points")
def identity_swap(c):
    return r6(edits.swap_identities(points(c), 60, [1, 2, 0]), "p").withColumn("ind", F.col("ind").cast("long"))


EDITS = "e AS (SELECT frame, part, ind, 1 AS x, 2 AS y, 1.0 AS p FROM points WHERE frame % 10 = 3 AND ind = 1)"


@query(f"{TOP}, {EDITS} SELECT frame, part, ind, coalesce(e.x, b.x) AS x, coalesce(e.y, b.y) AS y, round(coalesce(e.p, b.p), 6) AS p FROM points b LEFT JOIN e USING (frame, part, ind)")
def edit_overlay(c):
    base = points(c)
    changed = base.filter("frame % 10 = 3 AND ind = 1").withColumns({"x": F.lit(1).cast("long"), "y": F.lit(2).cast("long"), "p": F.lit(1.0)})
    return r6(edits.overlay(base, changed), "p")


@query("l AS (SELECT frame, part, x % 2 AS ind, event_id AS version, p, event_id % 5 = 0 AS undone FROM cells) SELECT frame, part, ind, version, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY frame, part, ind ORDER BY version DESC) AS n FROM l WHERE NOT undone) WHERE n = 1")
def edit_log_state(c):
    log = c.select("frame", "part", (F.col("x") % 2).alias("ind"), F.col("event_id").alias("version"), "p", (F.col("event_id") % 5 == 0).alias("undone"))
    return r6(edits.current(log).select("frame", "part", "ind", "version", "p"), "p")


GMIX = f"""{PLACES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY p DESC, y, x, event_id) AS n FROM cells), ctr AS (SELECT frame, part, x AS cx, y AS cy FROM ranked WHERE n = 1),
 sc AS (SELECT frame, part, x, y, CASE WHEN max(p) OVER w > 0 THEN p * (1 - 0.667) / max(p) OVER w ELSE 0 END AS p FROM d WINDOW w AS (PARTITION BY frame, part)),
 gs AS (SELECT frame, part, cx + dx AS x, cy + dy AS y, 0.667 * exp(-(dx * dx + dy * dy) / 8.0) AS g FROM ctr, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy))"""
GTOP = "t AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY p DESC, y, x) AS n FROM b) SELECT frame, part, x, y, round(p / max(p) OVER (PARTITION BY frame, part), 6) AS p FROM t WHERE n <= 75"


@query(f"{GMIX}, b AS (SELECT frame, part, x, y, coalesce(sc.p, 0) + g AS p FROM gs LEFT JOIN sc USING (frame, part, x, y)), {GTOP}")
def gaussian_mix(c):
    return r6(edits.mix(c, frames.top_k(c, 1)), "p")


@query(f"{GMIX}, b AS (SELECT frame, part, x, y, sc.p + coalesce(g, 0) AS p FROM sc LEFT JOIN gs USING (frame, part, x, y)), {GTOP}")
def source_mix(c):
    return r6(edits.mix(c, frames.top_k(c, 1), keep="source"), "p")


@query(f"""{PLACES}, pk AS (SELECT * FROM d WHERE p >= 0.05 AND NOT EXISTS (SELECT 1 FROM d n WHERE n.frame = d.frame AND n.part = d.part AND abs(n.x - d.x) <= 1 AND abs(n.y - d.y) <= 1
 AND (n.x <> d.x OR n.y <> d.y) AND (n.p > d.p OR (n.p = d.p AND NOT (n.x >= d.x AND n.y >= d.y))))),
 o AS (SELECT d.frame, d.part, d.x, d.y, d.p, arg_min((pk.x, pk.y), ((d.x - pk.x) ** 2 + (d.y - pk.y) ** 2, pk.y, pk.x)) AS o FROM d JOIN pk ON d.frame = pk.frame AND d.part = pk.part GROUP BY ALL),
 ch AS (SELECT frame, part, arg_min((x, y), ((16 - x) ** 2 + (12 - y) ** 2, y, x)) AS c FROM pk GROUP BY ALL)
 SELECT frame, part, x, y, round(p * CASE WHEN o = c THEN 0.95 ELSE 0.05 END, 6) AS p FROM o JOIN ch USING (frame, part)""")
def nearest_peak(c):
    clicks = c.select("frame", "part").distinct().withColumns({"x": F.lit(16), "y": F.lit(12)})
    return r6(edits.nearest_peak(c, clicks), "p")


@query(f"{TOP} SELECT frame, part, ind, x, y, CASE WHEN p > 0.1 THEN 'filled' ELSE 'hollow' END AS status FROM points")
def render_plan(c):
    return edits.render_plan(points(c), 0.1, hidden=True).select("frame", "part", "ind", "x", "y", "status")


@query("SELECT frame, part, 'SOURCE' AS plane, x, y, round(p, 6) AS p FROM cells UNION ALL SELECT frame, part, 'FRAME', x, y, round(p, 6) FROM cells WHERE p > 0.1 UNION ALL SELECT frame, part, 'OCCLUDED', x, y, round(p * 1e-8, 6) FROM cells WHERE p <= 0.1")
def state_planes(c):
    return r6(poses.state_planes(c, 0.1), "p")


# -- kernels -------------------------------------------------------------------------------------------------------------

ASSIGN = f"""{TOP}, cur AS (SELECT * FROM points), m AS (SELECT c.frame, c.part, q.ind AS i, c.ind AS j, sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2) + 0.001 * q.ind + 0.00001 * c.ind * (q.ind + 1) AS cost FROM cur c JOIN cur q ON c.frame = q.frame + 1 AND c.part = q.part),
 full_ AS (SELECT frame, part FROM m GROUP BY ALL HAVING count(*) = 9)"""
COST = "sqrt((x - px) * (x - px) + (y - py) * (y - py)) + 0.001 * i + 0.00001 * j * (i + 1)"


def _assigned(c: DataFrame, algorithm: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    from trailmark.operators.kernels import ASSIGN as methods

    t = points(c)
    m = t.withColumnRenamed("ind", "j").join(motion.previous(t.withColumn("i", F.col("ind")), "part", "i"), ["frame", "part"]).select("frame", "part", "i", "j", F.expr(COST).alias("cost"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) != N * N:
            return pd.DataFrame({"frame": pd.Series([], dtype="int64"), "part": pd.Series([], dtype="str"), "assignment": pd.Series([], dtype="str"), "total": pd.Series([], dtype="float64")})
        cost = np.zeros((N, N))
        cost[pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)] = pdf["cost"].to_numpy()
        pairs_ = methods[algorithm](cost)
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "part": [pdf["part"].iloc[0]], "assignment": ["".join(str(j) for _, j in pairs_)], "total": [round(sum(cost[i, j] for i, j in pairs_), 6)]})

    return m.groupBy("frame", "part").applyInPandas(run, "frame long, part string, assignment string, total double")


@query(f"""{ASSIGN}, t AS (SELECT a.frame, a.part, a.j::VARCHAR || b.j::VARCHAR || c.j::VARCHAR AS assignment, a.cost + b.cost + c.cost AS total FROM m a JOIN m b USING (frame, part) JOIN m c USING (frame, part) JOIN full_ USING (frame, part)
 WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND a.j <> b.j AND a.j <> c.j AND b.j <> c.j) SELECT frame, part, arg_min(assignment, total) AS assignment, round(min(total), 6) AS total FROM t GROUP BY ALL""")
def assign_hungarian(c):
    return _assigned(c, "hungarian")


@query(f"""{ASSIGN}, f AS (SELECT frame, part, arg_min((i, j), cost) AS c1 FROM m JOIN full_ USING (frame, part) GROUP BY ALL), s AS (SELECT frame, part, any_value(c1) AS c1, arg_min((i, j), cost) AS c2 FROM m JOIN f USING (frame, part) WHERE i <> c1[1] AND j <> c1[2] GROUP BY ALL),
 a AS (SELECT frame, part, c1, c2, (3 - c1[1] - c2[1], 3 - c1[2] - c2[2]) AS c3 FROM s), u AS (SELECT frame, part, unnest([c1, c2, c3]) AS q FROM a)
 SELECT frame, part, string_agg(q[2]::VARCHAR, '' ORDER BY q[1]) AS assignment, round(sum(cost), 6) AS total FROM u JOIN m USING (frame, part) WHERE m.i = q[1] AND m.j = q[2] GROUP BY ALL""")
def assign_greedy(c):
    return _assigned(c, "greedy")


@query(f"""{PLACES}, n AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY y, x) AS i FROM d), l AS (SELECT a.frame, a.part, a.i, b.i AS j FROM n a JOIN n b ON a.frame = b.frame AND a.part = b.part AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4),
 r AS (WITH RECURSIVE reach AS (SELECT frame, part, i, i AS root FROM n UNION SELECT l.frame, l.part, l.j, reach.root FROM reach JOIN l USING (frame, part, i)) SELECT frame, part, i, min(root) AS root FROM reach GROUP BY ALL)
 SELECT frame, part, x, y, dense_rank() OVER (PARTITION BY frame, part ORDER BY root) - 1 AS component FROM n JOIN r USING (frame, part, i)""")
def components(c):
    """Places of each frame and part linked within two cells: connected components, numbered by first appearance in (y, x) order."""
    import pandas as pd

    from trailmark.operators.kernels import components_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        i, j = np.nonzero(np.triu((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 4, 1))
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "part": pdf["part"].iloc[0], "x": x, "y": y, "component": components_of(len(x), zip(i, j, strict=True))})

    return frames.distinct_cells(c).groupBy("frame", "part").applyInPandas(run, "frame long, part string, x long, y long, component long")


@query()
def cluster_complete(c):
    return tracking.cluster(frames.top_k(frames.above(c, 0.001), 100), 2)


@query()
def cluster_peaks(c):
    return tracking.cluster(frames.top_k(frames.above(c, 0.001), 100), 2, nodes="PEAKS")


@query()
def endpoint_segments(c):
    return segments.segments_of(scores(c), 20)


@query()
def track_individuals(c, spark, sf_dir):
    return tracking.track(spark, c, 2)


@query()
def final_states(c, spark, sf_dir):
    """What the solver holds of each track in the end: source cells, scores of cells and scores of hidden places."""
    return tracking.prepared(spark, c, 2).planes()


@query()
def track_videos(c, spark, sf_dir):
    """Three videos in one table, each tracked as if it were alone."""
    return tracking.track(spark, c.withColumn("video", F.col("event_id") % 3), 2, by=("video",))


@query()
def track_again(c, spark, sf_dir):
    """A partial run after an edit: in the frames of its likeliest cell, a part has only that cell left."""
    run = tracking.prepared(spark, c, 2)
    top = c.groupBy("part").agg(F.max_by(F.struct("frame", "x", "y", "p"), F.struct("p", "event_id")).alias("c")).select("c.frame", "part", "c.x", "c.y", "c.p", F.lit(0).cast("long").alias("event_id"))
    return run.rerun(top).result()


# -- built-ins over poses --------------------------------------------------------------------------------------------------


@query(f"{TOP} SELECT part, ind, count(*) AS n, round(avg(p), 6) AS p FROM points GROUP BY ROLLUP (part, ind)")
def rollup_parts(c):
    return r6(poses.rollup_parts(points(c)), "p")


@query(f"{TOP} SELECT frame, max(CASE WHEN part = 'click' THEN x END) AS click_x, max(CASE WHEN part = 'view' THEN x END) AS view_x FROM points WHERE ind = 0 GROUP BY frame")
def pose_pivot(c):
    return poses.pose_pivot(points(c, 1), ["click", "view"])


@query(f"{TOP} SELECT frame, part, ind, round(p * 2, 6) AS p FROM points WHERE frame BETWEEN 10 AND 90 AND frame % 4 = 2")
def pose_slice(c):
    return poses.pose_slice(points(c), 10, 91, 4).select("frame", "part", "ind", F.round(F.col("p") * 2, 6).alias("p"))


@query("SELECT frame, part, x, y, event_id, round(p, 6) AS p, CASE part WHEN 'view' THEN 0 ELSE 1 END AS place FROM cells WHERE part IN ('view', 'click')")
def part_selection(c):
    return r6(poses.part_selection(c.select("frame", "part", "x", "y", "event_id", "p"), ["view", "click"]), "p")


@query("SELECT part, frame, x, y, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY p DESC, frame, y, x) AS n FROM cells) WHERE n = 1")
def top_frame(c):
    return r6(poses.top_frame(c), "p")


@query(f"{TOP} SELECT a.frame, a.part, a.ind, a.x, a.y, b.x AS px, b.y AS py, round(a.p, 6) AS p, round(b.p, 6) AS pp FROM points a LEFT JOIN points b ON b.frame = a.frame - 1 AND b.part = a.part AND b.ind = a.ind")
def ordered_pass(c):
    return r6(poses.with_prior(points(c)), "p", "pp")


@query(f"{TOP} SELECT a.frame, a.part, a.ind, a.x, a.y, b.x AS px, b.y AS py, round(a.p, 6) AS p, round(b.p, 6) AS pp FROM points a LEFT JOIN points b ON b.frame = a.frame + 1 AND b.part = a.part AND b.ind = a.ind")
def ordered_pass_back(c):
    return r6(poses.with_prior(points(c), 1), "p", "pp")


@query(f"{PLACES} SELECT frame, part, count(*) AS n, string_agg(y || ':' || x, ' ' ORDER BY y, x) AS places FROM d GROUP BY ALL")
def coordinate_sort(c):
    named = F.array_join(F.transform("places", lambda q: F.concat(q["y"].cast("string"), F.lit(":"), q["x"].cast("string"))), " ")
    return poses.ordered_places(c).withColumn("places", named)


@query(f"""{SIDES}, l AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY y, x) - 1 AS left_index FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY frame, part ORDER BY y, x) - 1 AS right_index FROM b)
 SELECT frame, part, x, y, left_index, right_index FROM l JOIN r USING (frame, part, x, y)""")
def intersection_indices(c):
    return poses.common_indices(*sides(c)).withColumns({k: F.col(k).cast("long") for k in ("left_index", "right_index")})


@query(f"{TOP} SELECT frame, part, ind, (CASE part WHEN 'click' THEN 0 WHEN 'view' THEN 4 END)::INT AS colour, (ind % 4)::INT AS shape FROM points WHERE part IN ('click', 'view')")
def colour_index(c):
    return poses.colour_index(points(c).filter(F.col("part").isin("click", "view")), ["click", "view"], 8).select("frame", "part", "ind", "colour", "shape")


@query(f"{HIST}, {QUANT} SELECT round(sqrt(sum(freq * (mean - value) ** 2) / sum(freq)), 6) AS std FROM h, m")
def histogram_std(c):
    h = motion.histogram(motion.nearest_move(points(c)).filter("moved >= 1"), "moved", 2.0, 1.0)
    return r6(motion.std_about(h, motion.quantile(h, 0.5)), "std")


@query(f"{HIST}, v AS (SELECT (i * 0.7)::DOUBLE + 1 AS moved FROM range(0, 60) t(i)) SELECT round(v.moved, 6) AS moved, trunc((v.moved - 1) / 2) * 2 + 1.0 AS bin, coalesce(freq, 0) AS freq, round(coalesce(mean, v.moved), 6) AS mean FROM v LEFT JOIN h ON h.bin = trunc((v.moved - 1) / 2)::BIGINT * 2 + 1.0")
def histogram_lookup(c, spark, sf_dir):
    h = motion.histogram(motion.nearest_move(points(c)).filter("moved >= 1"), "moved", 2.0, 1.0)
    return r6(motion.bin_of(h, spark.range(60).select((F.col("id") * 0.7 + 1).alias("moved")), "moved", 2.0, 1.0), "moved", "mean")


# Mean distances of the parts' likeliest cells.
APART = f"""{TOP}, apart AS (SELECT a.part AS part_a, b.part AS part_b, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS length FROM points a JOIN points b USING (frame) WHERE a.ind = 0 AND b.ind = 0 GROUP BY ALL)"""


def apart(c: DataFrame) -> DataFrame:
    a = points(c, 1).select("frame", F.col("part").alias("part_a"), "x", "y")
    b = a.select("frame", F.col("part_a").alias("part_b"), F.col("x").alias("px"), F.col("y").alias("py"))
    return a.join(b, "frame").groupBy("part_a", "part_b").agg(F.avg(motion.distance("x", "y", "px", "py")).alias("length"))


@query(f"{APART} SELECT least(part_a, part_b) AS part_a, greatest(part_a, part_b) AS part_b, round(max(length), 6) AS avg, 1.0::DOUBLE AS std FROM apart WHERE part_a <> part_b GROUP BY ALL")
def manual_skeleton(c):
    return r6(motion.manual_skeleton(apart(c)), "avg")


@query(f"""{APART}, pairs AS (SELECT * FROM apart WHERE part_a < part_b), e AS (SELECT part_a, part_b FROM pairs WHERE length < (SELECT avg(length) FROM pairs)),
 l AS (SELECT part_a AS a, part_b AS b FROM e UNION ALL SELECT part_b, part_a FROM e),
 r AS (WITH RECURSIVE reach AS (SELECT a AS part, a AS root FROM l UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.part) SELECT part, min(root) AS component FROM reach GROUP BY part) SELECT part, component FROM r""")
def skeleton_components(c):
    pairs = apart(c).filter("part_a < part_b")
    close = pairs.join(F.broadcast(pairs.agg(F.avg("length").alias("mean")))).filter("length < mean")  # one row
    return motion.skeleton_components(close.select("part_a", "part_b"))


@query(f"{TOP} SELECT frame, part, ind, floor((x * 8.0 + 3) / 8)::BIGINT AS x, floor((y * 8.0 + 6) / 8)::BIGINT AS y, round(p, 6) AS p, -1.0::DOUBLE AS ox, 2.0::DOUBLE AS oy FROM points WHERE p > 0")
def point_edit(c):
    at = points(c).withColumns({"x": F.col("x") * 8.0 + 3, "y": F.col("y") * 8.0 + 6})
    return r6(edits.point_edit(at, 8.0)[0], "p", "ox", "oy")


@query(f"{SEGS}, t AS (SELECT DISTINCT seg_id FROM seg JOIN (SELECT DISTINCT frame FROM cells WHERE part = 'click' AND p > 0.6) ON frame >= start AND frame < \"end\") SELECT seg.* FROM seg JOIN t USING (seg_id)")
def touched_segments(c):
    return edits.touched_segments(fixed_segments(c), c.filter("part = 'click' AND p > 0.6").select("frame"))


@query("SELECT frame, part, x, y, event_id, round(p, 6) AS p FROM cells WHERE p > 0.2 AND part IN ('click', 'view')")
def exported_maps(c):
    from trailmark import api

    return r6(api.exported(c.select("frame", "part", "x", "y", "event_id", "p"), ["click", "view"], 0.2), "p")
