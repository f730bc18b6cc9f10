"""Query name to callable, and to DuckDB SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import Box, any_box, contained, contains_point, encloses, intersects, on_edge, overlap_volume, overlaps, volume
from ..operators import clip, deadspace, generate, knn, select, stats, updates
from ..operators.index import Index
from ..operators.joins import grid_join, join_count, theta_join
from .views import CUST, EV, LI, ND, ORD, PQ, SUP, customers, events, li, nodes, orders, pq, suppliers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOW = Box.of([(10, 12), (100, 200)])
P1 = "a.x0_l <= b.x0_h AND a.x0_h >= b.x0_l AND a.x1_l <= b.x1_h AND a.x1_h >= b.x1_l"
IN_WINDOW = "x0_l <= 12 AND x0_h >= 10 AND x1_l <= 200 AND x1_h >= 100"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Selections


@query(f"WITH {LI} SELECT * FROM li WHERE {IN_WINDOW}")
def region_query(s, d):
    return select.region_query(li(s, d), WINDOW)


@query(f"WITH {LI} SELECT count(*) AS n FROM li WHERE {IN_WINDOW}")
def region_count(s, d):
    return select.region_count(li(s, d), WINDOW)


@query(f"WITH {LI} SELECT count(*) > 0 AS found FROM li WHERE {IN_WINDOW}")
def exists_region(s, d):
    return select.exists_region(li(s, d), WINDOW)


@query(f"WITH {LI} SELECT rid FROM li WHERE x0_l <= 10 AND x0_h >= 12 AND x1_l <= 150 AND x1_h >= 152")
def enclosure_query(s, d):
    return select.region_query(li(s, d), Box.of([(10, 12), (150, 152)]), encloses).select("rid")


@query(f"WITH {LI} SELECT rid FROM li WHERE x0_l >= 10 AND x0_h <= 20 AND x1_l >= 100 AND x1_h <= 400")
def containment_query(s, d):
    return select.region_query(li(s, d), Box.of([(10, 20), (100, 400)]), contained).select("rid")


@query(f"WITH {LI} SELECT rid FROM li WHERE x0_l < 12 AND x0_h > 10 AND x1_l < 200 AND x1_h > 100")
def strict_overlap_query(s, d):
    return select.region_query(li(s, d), WINDOW, overlaps).select("rid")


@query(f"WITH {LI} SELECT rid, (x0_l = 12 OR x0_h = 12 OR x1_l = 150 OR x1_h = 150) AS edge FROM li WHERE x0_l <= 12 AND x0_h >= 12 AND x1_l <= 150 AND x1_h >= 150")
def point_query(s, d):
    b = Box()
    return li(s, d).where(contains_point(b, [12, 150])).select("rid", on_edge(b, [12, 150]).alias("edge"))


@query(f"WITH {LI} SELECT rid FROM li WHERE ({IN_WINDOW}) OR (x0_l <= 41 AND x0_h >= 40 AND x1_l <= 1010 AND x1_h >= 1000)")
def multi_box_query(s, d):
    return li(s, d).where(any_box(intersects, Box(), [WINDOW, Box.of([(40, 41), (1000, 1010)])])).select("rid")


@query(f"WITH {LI} SELECT rid, CASE WHEN {IN_WINDOW} THEN -rid ELSE rid END AS info FROM li")
def modify_info(s, d):
    return select.modify(li(s, d).withColumn("info", F.col("rid")), WINDOW, {"info": -F.col("rid")}).select("rid", "info")


# Query batches

COUNTS = f"{LI}, {PQ}, counts AS (SELECT b.qid, count(a.rid) AS n FROM pq b LEFT JOIN li a ON {P1} GROUP BY b.qid)"


@query(f"WITH {COUNTS} SELECT qid, n FROM counts")
def region_count_batch(s, d):
    return select.batch_counts(li(s, d), pq(s, d))


@query(f"WITH {COUNTS} SELECT qid, n FROM counts")
def clipped_region_count(s, d):
    return Index.build(li(s, d)).region_counts(pq(s, d))


@query(f"WITH {COUNTS} SELECT qid, n FROM counts")
def unclipped_region_count(s, d):
    return Index.build(li(s, d), method=None).region_counts(pq(s, d), clipped=False)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("avg_n", "var_n", "sd_n", "nsd_n")})


@query(f"""WITH {COUNTS} SELECT CAST(sum(n) AS BIGINT) AS allfound, count_if(n = 0)::BIGINT AS emptyquery, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS avg_n,
  round(var_pop(n), 6) AS var_n, round(stddev_pop(n), 6) AS sd_n, round(stddev_pop(n) / avg(n), 6) AS nsd_n FROM counts""")
def batch_stats(s, d):
    return _rounded(select.batch_stats(select.batch_counts(li(s, d), pq(s, d))))


@query(f"WITH {COUNTS} SELECT qid FROM counts WHERE n > 0")
def exists_batch(s, d):
    return select.hit_queries(li(s, d), pq(s, d)).select("qid")


@query(f"WITH {COUNTS} SELECT qid FROM counts WHERE n = 0")
def empty_queries(s, d):
    return select.hit_queries(li(s, d), pq(s, d), missing=True).select("qid")


_EXACT = "b AS (SELECT rid AS qid, x0_l, x0_h, x1_l, x1_h FROM cust)"


@query(f"WITH {CUST}, {_EXACT} SELECT b.qid, count(a.rid) AS n FROM b LEFT JOIN cust a ON a.x0_l = b.x0_l AND a.x0_h = b.x0_h AND a.x1_l = b.x1_l AND a.x1_h = b.x1_h GROUP BY b.qid")
def exact_match_count(s, d):
    c = customers(s, d)
    return select.exact_counts(c, c.withColumnRenamed("rid", "qid"))


@query(f"WITH {EV}, {SUP} SELECT rid FROM ev SEMI JOIN (SELECT p0, p1 FROM sup) s ON ev.x0_l = s.p0 AND ev.x0_h = s.p0 AND ev.x1_l = s.p1 AND ev.x1_h = s.p1")
def record_exists(s, d):
    boxes = suppliers(s, d).select(*[F.col(f"p{i}").alias(f"x{i}_{e}") for i in (0, 1) for e in "lh"])
    return select.exact_match(events(s, d), boxes).select("rid")


# Joins


@query(f"WITH {CUST}, {EV} SELECT a.rid AS a_rid, b.rid AS b_rid FROM cust a JOIN ev b ON {P1}")
def spatial_join(s, d):
    return grid_join(customers(s, d), events(s, d)).select("a_rid", "b_rid")


@query(f"WITH {LI}, {PQ} SELECT count(*) AS n FROM li a JOIN pq b ON {P1}")
def spatial_join_count(s, d):
    return select.intersection_count(li(s, d), pq(s, d))


@query(f"WITH {LI}, {PQ} SELECT count(*) AS n FROM li a JOIN pq b ON {P1}")
def clipped_join_count(s, d):
    left, right = Index.build(li(s, d)), Index.build(pq(s, d).withColumnRenamed("qid", "rid"))
    return left.join_count(right)


@query(f"WITH {LI}, {PQ} SELECT a.rid AS a_rid, b.qid AS b_qid FROM li a JOIN pq b ON {P1} AND a.x0_l >= b.x0_l AND a.x0_h <= b.x0_h WHERE a.x2_l > 100 AND b.x0_l > 20")
def filtered_join(s, d):
    return grid_join(li(s, d).where("x2_l > 100"), pq(s, d).where("x0_l > 20"), within=[0]).select("a_rid", "b_qid")


@query(f"WITH {LI}, {PQ} SELECT count(*) AS n FROM li a JOIN pq b ON {P1} AND a.x0_l >= b.x0_l AND a.x0_h <= b.x0_h WHERE a.x2_l > 100 AND b.x0_l > 20")
def filtered_join_count(s, d):
    return select.intersection_count(li(s, d).where("x2_l > 100"), pq(s, d).where("x0_l > 20"), within=[0])


@query(f"WITH {CUST}, {SUP} SELECT count(*) AS n FROM cust a JOIN sup b ON a.x1_l = b.p1 AND a.x0_h < b.p0")
def theta_join_count(s, d):
    return join_count(theta_join(customers(s, d), suppliers(s, d), lambda: (F.col("a_x1_l") == F.col("b_p1")) & (F.col("a_x0_h") < F.col("b_p0"))))


@query(f"WITH {CUST} SELECT a.rid AS a_rid, b.rid AS b_rid FROM cust a JOIN cust b ON {P1}")
def self_join(s, d):
    return grid_join(customers(s, d), customers(s, d)).select("a_rid", "b_rid")


@query(f"WITH {ORD} SELECT a.rid AS a_rid, count(*) AS n FROM ord a JOIN ord b ON a.x0_l <= b.x0_h AND a.x0_h >= b.x0_l GROUP BY a.rid")
def interval_self_join(s, d):
    o = orders(s, d)
    return select.batch_counts(o, o, "rid", [0]).where("n > 0").withColumnRenamed("rid", "a_rid")


# Statistics


@query(f"WITH {LI} SELECT min(x0_l) AS x0_l, max(x0_h) AS x0_h, min(x1_l) AS x1_l, max(x1_h) AS x1_h, min(x2_l) AS x2_l, max(x2_h) AS x2_h FROM li")
def global_mbb(s, d):
    return stats.mbb(li(s, d), (0, 1, 2))


_REPORT = " UNION ALL ".join(
    f"SELECT {i} AS dim, m.l AS low, (SELECT count(*) FROM li WHERE x{i}_l = m.l) AS n_low, m.h AS high, (SELECT count(*) FROM li WHERE x{i}_h = m.h) AS n_high, m.h - m.l AS edge, cl AS center_low, ch AS center_high FROM (SELECT min(x{i}_l) AS l, max(x{i}_h) AS h, min((x{i}_l + x{i}_h) / 2) AS cl, max((x{i}_l + x{i}_h) / 2) AS ch FROM li) m"
    for i in range(3)
)


@query(f"WITH {LI} {_REPORT}")
def mbb_report(s, d):
    return stats.mbb_report(li(s, d), (0, 1, 2))


@query(f"WITH {LI}, m AS (SELECT min(x0_l) AS a0, max(x0_h) AS b0, min(x1_l) AS a1, max(x1_h) AS b1 FROM li) SELECT greatest(b0 - a0, b1 - a1) AS edge, (b0 - a0) * (b1 - a1) AS volume, (a0 + b0) / 2 - greatest(b0 - a0, b1 - a1) / 2 AS centered0_l, (a1 + b1) / 2 - greatest(b0 - a0, b1 - a1) / 2 AS centered1_l FROM m")
def least_squares(s, d):
    return stats.least_squares(li(s, d))


_VOL = "(x0_h - x0_l) * (x1_h - x1_l)"
_OVER = "greatest(least(a.x0_h, b.x0_h) - greatest(a.x0_l, b.x0_l), 0) * greatest(least(a.x1_h, b.x1_h) - greatest(a.x1_l, b.x1_l), 0)"


@query(f"""WITH {CUST}, one AS (SELECT count(*) AS n_boxes, count_if(x0_h = x0_l AND x1_h = x1_l)::BIGINT AS n_points, count_if(x0_h = x0_l OR x1_h = x1_l)::BIGINT AS n_flat,
  count_if(x0_h - x0_l = x1_h - x1_l AND x0_h > x0_l)::BIGINT AS n_squares, count_if((x0_h = x0_l) <> (x1_h = x1_l))::BIGINT AS n_zero1, count_if(x0_h = x0_l AND x1_h = x1_l)::BIGINT AS n_zero2,
  avg(e) AS avg_extent, avg(CASE WHEN e > 0 THEN 100 * abs(e0 - e1) / 2 / e END) AS avg_nsd, avg(CASE WHEN e > 0 THEN 100 * least(e0, e1) / greatest(e0, e1) END) AS avg_min_max, min(CASE WHEN {_VOL} > 0 THEN {_VOL} END) AS min_volume, avg({_VOL}) AS avg_volume FROM (SELECT *, x0_h - x0_l AS e0, x1_h - x1_l AS e1, (x0_h - x0_l + x1_h - x1_l) / 2 AS e FROM cust)),
  met AS (SELECT count(*) AS n_pairs, sum(CASE WHEN (a.x0_h - a.x0_l) * (a.x1_h - a.x1_l) > 0 THEN {_OVER} / ((a.x0_h - a.x0_l) * (a.x1_h - a.x1_l)) END) AS o FROM cust a JOIN cust b ON {P1} AND a.rid <> b.rid)
  SELECT n_boxes, n_points, n_flat, n_squares, n_zero1, n_zero2, round(avg_extent, 6) AS avg_extent, round(avg_nsd, 6) AS avg_nsd, round(avg_min_max, 6) AS avg_min_max, min_volume, round(avg_volume, 6) AS avg_volume, n_pairs, round(o / n_boxes, 6) AS avg_overlap FROM one, met""")
def box_report(s, d):
    return stats.box_report(customers(s, d)).withColumns({c: F.round(c, 6) for c in ("avg_volume", "avg_overlap", "avg_extent", "avg_nsd", "avg_min_max")})


@query(f"""WITH {EV}, v AS (SELECT 0 AS dim, x0_l AS v FROM ev UNION ALL SELECT 1, x1_l FROM ev), c AS (SELECT dim, v, count(*) AS n FROM v GROUP BY dim, v HAVING count(*) > 1)
  SELECT * FROM (SELECT dim, v, n, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, v DESC) AS INTEGER) AS rank FROM c) WHERE rank <= 10""")
def dim_duplicates(s, d):
    return stats.duplicate_values(events(s, d))


@query("SELECT count(*) AS n, count_if(a.l_quantity <> b.l_quantity)::BIGINT AS differing, 100.0 * count_if(a.l_quantity <> b.l_quantity) / count(*) AS percent FROM (SELECT l_orderkey AS k, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS k, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) b USING (k)")
def compare_segments(s, d):
    t = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k"))
    return stats.compare_segments(t.agg(F.max("l_quantity").alias("v")), t.agg(F.min("l_quantity").alias("v")), "k", "v")


@query(f"WITH {LI} SELECT count(*) AS n FROM li")
def record_count(s, d):
    return li(s, d).agg(F.count("*").alias("n"))


@query(f"WITH {LI}, bad AS (SELECT rid, x0_h AS x0_l, x0_l AS x0_h FROM li) SELECT rid FROM bad WHERE x0_l > x0_h")
def bad_boxes(s, d):
    return stats.bad_boxes(li(s, d).select("rid", F.col("x0_h").alias("x0_l"), F.col("x0_l").alias("x0_h")), [0]).select("rid")


@query(f"WITH {CUST} SELECT a.rid AS a_rid, sum({_OVER}) AS shared FROM cust a JOIN cust b ON {P1} AND a.rid <> b.rid GROUP BY a.rid")
def overlap_volumes(s, d):
    c = customers(s, d)
    pairs = grid_join(c, c).where("a_rid <> b_rid")
    return pairs.groupBy("a_rid").agg(F.sum(overlap_volume(Box((0, 1), "a_"), Box((0, 1), "b_"))).alias("shared"))


# Distance queries

_MIN = "pow(greatest(x0_l - 100, 100 - x0_h, 0), 2) + pow(greatest(x1_l - 50, 50 - x1_h, 0), 2)"
_CENTER = "pow(100 - (x0_l + x0_h) / 2, 2) + pow(50 - (x1_l + x1_h) / 2, 2)"
_MAX = "pow(greatest(x0_h - 100, 100 - x0_l), 2) + pow(greatest(x1_h - 50, 50 - x1_l), 2)"


def _browse(name: str, view: str, cte: str, make, dist: str, order: str, where: str = "true", limit: int | None = 100, **options):
    def run(s, d):
        return knn.browse(make(s, d), [100, 50], k=limit, **options).select("rid", "dist")

    run.__name__ = name
    query(f"WITH {cte} SELECT rid, {dist} AS dist FROM {view} WHERE {where} ORDER BY dist {order}, rid" + (f" LIMIT {limit}" if limit else ""))(run)


_browse("knn_min_inc", "cust", CUST, customers, _MIN, "ASC")
_browse("knn_min_dec", "cust", CUST, customers, _MIN, "DESC", farthest=True)
_browse("knn_center_inc", "cust", CUST, customers, _CENTER, "ASC", kind="center")
_browse("knn_center_dec", "cust", CUST, customers, _CENTER, "DESC", kind="center", farthest=True)
_browse("knn_max_inc", "cust", CUST, customers, _MAX, "ASC", kind="max")
_browse("knn_max_dec", "cust", CUST, customers, _MAX, "DESC", kind="max", farthest=True)
_browse("knn_manhattan", "cust", CUST, customers, "greatest(x0_l - 100, 100 - x0_h, 0) + greatest(x1_l - 50, 50 - x1_h, 0)", "ASC", metric="manhattan")
_browse("distance_range", "ev", EV, events, _MIN, "ASC", f"{_MIN} >= 400 AND {_MIN} <= 2500", None, start=20.0, end=50.0)
_browse("distance_range_dec", "ev", EV, events, _MIN, "DESC", f"{_MIN} <= 2500 AND {_MIN} >= 400", None, start=50.0, end=20.0, farthest=True)


@query(f"WITH {EV} SELECT rid, {_MIN} AS dist FROM ev WHERE x0_l <= 200 AND x0_h >= 90 AND x1_l <= 80 AND x1_h >= 60 ORDER BY dist, rid LIMIT 50")
def knn_clip_box(s, d):
    return knn.browse(events(s, d), [100, 50], where=intersects(Box(), Box.of([(90, 200), (60, 80)])), k=50).select("rid", "dist")


@query(f"""WITH {EV}, {SUP} SELECT * FROM (SELECT qid, rid, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS INTEGER) AS rank FROM
  (SELECT qid, rid, pow(greatest(x0_l - p0, p0 - x0_h, 0), 2) + pow(greatest(x1_l - p1, p1 - x1_h, 0), 2) AS dist FROM ev, sup)) WHERE rank <= 5""")
def knn_join(s, d):
    return knn.knn_join(events(s, d), suppliers(s, d), 5)


@query(f"""WITH {EV}, {SUP} SELECT * FROM (SELECT qid, rid, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist DESC, rid) AS INTEGER) AS rank FROM
  (SELECT qid, rid, greatest(abs(x0_l - p0), abs(x1_l - p1)) AS dist FROM ev, sup)) WHERE rank <= 3""")
def farthest_join(s, d):
    return knn.knn_scan(events(s, d), suppliers(s, d), 3, metric="maximum", kind="max", farthest=True)


@query(f"WITH {EV} SELECT rid, x0_l * x0_l + x1_l * x1_l AS dist, row_number() OVER (ORDER BY x0_l * x0_l + x1_l * x1_l, rid) AS rank FROM ev")
def proximity_sort(s, d):
    return knn.proximity_sort(events(s, d)).select("rid", "dist", "rank")


@query(f"""WITH {EV}, {SUP}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM (SELECT qid, p0, p1, rid, x0_l, x0_h, x1_l, x1_h, greatest(greatest(x0_l - p0, p0 - x0_h, 0), greatest(x1_l - p1, p1 - x1_h, 0)) AS dist FROM ev, sup))
  SELECT qid, min(least(p0, x0_h)) AS x0_l, max(greatest(p0, x0_l)) AS x0_h, min(least(p1, x1_h)) AS x1_l, max(greatest(p1, x1_l)) AS x1_h FROM near WHERE rank <= 5 + qid % 11 GROUP BY qid""")
def query_boxes(s, d):
    return knn.query_boxes(events(s, d), suppliers(s, d), 5 + F.col("qid") % 11, 15)


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (ORDER BY rid) AS r FROM ev) SELECT rid AS qid, x0_l, x0_h, x1_l, x1_h FROM n WHERE r % 10 = 0")
def workload_points(s, d):
    return generate.workload(events(s, d), 1)


@query()
def workload_hits(s, d):
    rows = events(s, d)
    return select.batch_counts(rows, generate.workload(rows, 10))


@query()
def nearest_chain(s, d):
    return knn.nearest_chain(events(s, d), group="user_id")


@query()
def multi_start_order(s, d):
    return knn.nearest_chain(events(s, d), group="user_id", starts=3)


@query()
def densify(s, d):
    return knn.densify(customers(s, d), 2)


# Clip points

_CORNERS = " UNION ALL ".join(f"SELECT node_id, {c} AS corner, {'x0_h' if c & 1 else '-x0_l'} AS s0, {'x1_h' if c & 2 else '-x1_l'} AS s1 FROM nd" for c in range(4))
SKY = f"""{ND}, pts AS (SELECT DISTINCT * FROM ({_CORNERS})),
sky AS (SELECT * FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE a.node_id = b.node_id AND a.corner = b.corner AND b.s0 >= a.s0 AND b.s1 >= a.s1 AND (b.s0 > a.s0 OR b.s1 > a.s1)))"""
_TOPS = """vol AS (SELECT node_id, (max(x0_h) - min(x0_l)) * (max(x1_h) - min(x1_l)) AS v FROM nd GROUP BY node_id),
tops AS (SELECT node_id, corner, max(s0) AS t0, max(s1) AS t1 FROM pts GROUP BY ALL)"""
_STAIR = """pair AS (SELECT DISTINCT a.node_id, a.corner, a.s0 AS s0, b.s1 AS s1, a.s1 AS a1, b.s0 AS b0 FROM sky a JOIN sky b ON a.node_id = b.node_id AND a.corner = b.corner AND a.s0 < b.s0),
stair AS (SELECT DISTINCT node_id, corner, s0, s1, size FROM (SELECT p.*, (t0 - s0) * (t1 - s1) AS size, v FROM pair p JOIN tops USING (node_id, corner) JOIN vol USING (node_id)) p
  WHERE v > 0 AND size > 0.025 * v AND NOT EXISTS (SELECT 1 FROM sky k WHERE k.node_id = p.node_id AND k.corner = p.corner AND k.s0 >= p.s0 AND k.s1 >= p.s1 AND NOT (k.s0 = p.s0 AND k.s1 = p.a1) AND NOT (k.s0 = p.b0 AND k.s1 = p.s1)))"""
_SKYLINE = """stair AS (SELECT node_id, corner, s0, s1, size FROM (SELECT s.*, (t0 - s0) * (t1 - s1) AS size, v, count(*) OVER (PARTITION BY s.node_id, s.corner) AS n FROM sky s JOIN tops USING (node_id, corner) JOIN vol USING (node_id)) WHERE v > 0 AND n >= 3)"""
_KEPT = """best AS (SELECT node_id, corner, s0 AS z0, s1 AS z1 FROM (SELECT *, row_number() OVER (PARTITION BY node_id, corner ORDER BY size DESC, s0, s1) AS r FROM stair) WHERE r = 1),
scored AS (SELECT s.node_id, s.corner, s.s0, s.s1, CASE WHEN s0 = z0 AND s1 = z1 THEN size ELSE size - (t0 - greatest(s0, z0)) * (t1 - greatest(s1, z1)) END AS score, v FROM stair s JOIN best USING (node_id, corner) JOIN tops USING (node_id, corner) JOIN vol USING (node_id)),
clips AS (SELECT node_id, corner, CASE WHEN corner & 1 > 0 THEN s0 ELSE 0 - s0 END AS p0, CASE WHEN corner & 2 > 0 THEN s1 ELSE 0 - s1 END AS p1, score FROM scored WHERE score > 0.025 * v),
kept AS (SELECT node_id, corner, p0, p1, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, corner, p0, p1) AS r FROM clips) WHERE r <= 4)"""
CLIPS = f"{SKY}, {_TOPS}, {_STAIR}, {_KEPT}"
SKYLINE_CLIPS = f"{SKY}, {_TOPS}, {_SKYLINE}, {_KEPT}"


@query(f"WITH {SKY} SELECT * FROM sky")
def skyline_corners(s, d):
    return clip.corner_skylines(nodes(s, d))


@query(f"WITH {CLIPS} SELECT node_id, corner, p0, p1, score FROM kept")
def clip_points_topk(s, d):
    return clip.explode_clips(clip.build_clips(nodes(s, d)))


@query(f"WITH {SKYLINE_CLIPS} SELECT node_id, corner, p0, p1, score FROM kept")
def skyline_clip_points(s, d):
    return clip.explode_clips(clip.build_clips(nodes(s, d), method="skyline"))


@query(f"WITH {CLIPS} SELECT node_id, corner, p0, p1, score FROM clips")
def stairline_points(s, d):
    return clip.explode_clips(clip.build_clips(nodes(s, d), k=1 << 30))


@query(f"WITH {CLIPS}, per AS (SELECT node_id, count(p0) AS n FROM (SELECT DISTINCT node_id FROM nd) LEFT JOIN kept USING (node_id) GROUP BY node_id) SELECT count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n_clips, round(avg(n), 6) AS avg_clips, CAST(max(n) AS INTEGER) AS max_clips, CAST(sum(n) * 20 AS BIGINT) AS n_bytes FROM per")
def clip_storage(s, d):
    return clip.clip_stats(clip.build_clips(nodes(s, d))).withColumn("avg_clips", F.round("avg_clips", 6))


@query(f"WITH {ND} SELECT node_id, count(*) AS n, min(x0_l) AS x0_l, max(x0_h) AS x0_h, min(x1_l) AS x1_l, max(x1_h) AS x1_h FROM nd GROUP BY node_id")
def node_catalogue(s, d):
    return clip.entry_mbbs(nodes(s, d))


@query(f"WITH {LI} SELECT count(*) AS n_bad FROM li WHERE false")
def check_consistency(s, d):
    index = Index.build(li(s, d))
    return updates.inconsistent(index.nodes, index.leaves).agg(F.count("*").alias("n_bad"))


@query(f"""WITH {ND} SELECT node_id, count(*) AS n, min(x0_l) AS x0_l, max(x0_h) + CASE WHEN node_id % 7 = 0 THEN 1 ELSE 0 END AS x0_h, min(x1_l) AS x1_l, max(x1_h) AS x1_h FROM nd GROUP BY node_id HAVING node_id % 7 = 0""")
def inconsistent_nodes(s, d):
    """Every seventh box of a catalogue is made too wide, and these must be found."""
    entries = nodes(s, d)
    stored = clip.entry_mbbs(entries).withColumn("x0_h", F.col("x0_h") + F.when(F.col("node_id") % 7 == 0, 1.0).otherwise(0.0))
    return updates.inconsistent(stored, entries).select("node_id", "n", *Box().columns())


@query(f"WITH {LI} SELECT count(*) AS n_records FROM li")
def tree_description(s, d):
    return Index.build(li(s, d)).describe().select("n_records")


@query()
def tree_utilisation(s, d):
    return Index.build(li(s, d)).describe()


@query()
def level_stats(s, d):
    return Index.build(li(s, d), height=3).describe_levels()


@query()
def level_lookup(s, d):
    """The directory nodes of the second level that the window meets."""
    return Index.build(li(s, d), height=2).level(2).where(intersects(Box(), WINDOW)).drop("clips")


@query()
def leaf_access_stats(s, d):
    index, q = Index.build(li(s, d)), pq(s, d)
    return index.access_stats(q).withColumn("clipped", F.lit(True)).unionByName(index.access_stats(q, clipped=False).withColumn("clipped", F.lit(False)))


# Dead space


@query(f"""WITH {ND}, m AS (SELECT node_id, min(x0_l) AS l0, max(x0_h) - min(x0_l) AS w0, min(x1_l) AS l1, max(x1_h) - min(x1_l) AS w1 FROM nd GROUP BY node_id),
b AS (SELECT *, CAST(ceil(w0 * 100 / greatest(w0, w1)) AS BIGINT) AS b0, CAST(ceil(w1 * 100 / greatest(w0, w1)) AS BIGINT) AS b1 FROM m WHERE w0 * w1 > 0),
e AS (SELECT node_id, b0, b1, w0 * w1 AS v, CAST(floor((x0_l - l0) / w0 * b0) AS BIGINT) AS f0, CAST(floor((x0_h - l0) / w0 * b0) AS BIGINT) AS t0, CAST(floor((x1_l - l1) / w1 * b1) AS BIGINT) AS f1, CAST(floor((x1_h - l1) / w1 * b1) AS BIGINT) AS t1 FROM nd JOIN b USING (node_id)),
g AS (SELECT DISTINCT node_id, b0, b1, v, f0, CASE WHEN f0 = t0 AND f0 <> b0 THEN t0 + 1 ELSE t0 END AS t0, f1, CASE WHEN f1 = t1 AND f1 <> b1 THEN t1 + 1 ELSE t1 END AS t1 FROM e),
c AS (SELECT DISTINCT node_id, b0, b1, v, c0, unnest(range(f1, t1)) AS c1 FROM (SELECT *, unnest(range(f0, t0)) AS c0 FROM g))
SELECT node_id, v AS volume, round(v * count(*) / (b0 * b1), 6) AS covered FROM c GROUP BY node_id, b0, b1, v""")
def pixel_coverage(s, d):
    return deadspace.dead_space(nodes(s, d)).where("volume > 0").select("node_id", "volume", F.round("covered", 6).alias("covered"))


@query()
def dead_space_shares(s, d):
    shares = deadspace.dead_shares(deadspace.dead_space(nodes(s, d)), 4)
    names = ("mbb_dead", "circle_dead", "hull_dead", "rotated_box_dead", "corners4_dead", "corners5_dead", "clipped1", "clipped2", "clipped3", "clipped4")
    return shares.agg(F.count("*").alias("n_nodes"), *[F.round(F.avg(c), 6).alias(c) for c in names])


# Updates


@query(f"""WITH {CUST}, old AS (SELECT * FROM cust WHERE x1_h > x1_l), new AS (SELECT * FROM cust WHERE x1_h = x1_l),
first AS (SELECT *, row_number() OVER (PARTITION BY x0_l, x0_h, x1_l, x1_h ORDER BY rid) AS r FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.x0_l = n.x0_l AND o.x0_h = n.x0_h AND o.x1_l = n.x1_l AND o.x1_h = n.x1_h))
SELECT * FROM old UNION ALL SELECT rid, x0_l, x0_h, x1_l, x1_h FROM first WHERE r = 1""")
def insert_unique(s, d):
    c = customers(s, d)
    return updates.insert_unique(c.where("x1_h > x1_l"), c.where("x1_h = x1_l"), "rid")


@query(f"WITH {CUST} SELECT * FROM cust UNION ALL SELECT rid + 1000000000, x0_l, x0_h, x1_l, x1_h FROM cust")
def insert_bag(s, d):
    c = customers(s, d)
    return updates.insert(c, c.withColumn("rid", F.col("rid") + 1000000000))


@query(f"""WITH {EV}, {SUP}, w AS (SELECT p0, p1, count(*) AS w FROM sup GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY x0_l, x0_h, x1_l, x1_h ORDER BY rid) AS r FROM ev)
SELECT rid FROM n LEFT JOIN w ON x0_l = p0 AND x1_l = p1 WHERE r > coalesce(w, 0)""")
def delete_records(s, d):
    boxes = suppliers(s, d).select(*[F.col(f"p{i}").alias(f"x{i}_{e}") for i in (0, 1) for e in "lh"])
    return updates.delete(events(s, d), boxes, "rid").select("rid")


# Generators and transforms


@query(f"WITH {LI} SELECT rid, (x0_l + x0_h) / 2 + (x0_l - (x0_l + x0_h) / 2) * 2 AS x0_l, (x0_l + x0_h) / 2 + (x0_h - (x0_l + x0_h) / 2) * 2 AS x0_h, (x1_l + x1_h) / 2 + (x1_l - (x1_l + x1_h) / 2) * 2 AS x1_l, (x1_l + x1_h) / 2 + (x1_h - (x1_l + x1_h) / 2) * 2 AS x1_h FROM li")
def area_scale(s, d):
    return generate.scale_area(li(s, d), 4.0).drop("x2_l", "x2_h")


@query(f"WITH {LI} SELECT rid FROM (SELECT rid, row_number() OVER (ORDER BY rid) AS r FROM li) WHERE r % 10 = 0")
def every_kth(s, d):
    return generate.every_kth(li(s, d), 10).select("rid")


@query(f"WITH {LI} SELECT rid, x2_l AS x0_l, x2_h AS x0_h, x0_l AS x1_l, x0_h AS x1_h FROM li")
def project_dims(s, d):
    return generate.project(li(s, d), (2, 0), (0, 1, 2))


@query("SELECT i + 1 AS rid, ((i % 64) + 0.5) / 64 - 0.005859375 AS x0_l, ((i % 64) + 0.5) / 64 + 0.005859375 AS x0_h, ((i // 64) + 0.5) / 64 - 0.005859375 AS x1_l, ((i // 64) + 0.5) / 64 + 0.005859375 AS x1_h FROM range(4096) t(i)")
def grid_boxes(s, d):
    return generate.grid(s, 64, area=0.5625, dither=0.0)


@query("SELECT i AS rid, (i - 0.5) / 1024 - 0.0009765625 AS x0_l, (i - 0.5) / 1024 + 0.0009765625 AS x0_h, (i - 0.5) / 1024 - 0.0009765625 AS x1_l, (i - 0.5) / 1024 + 0.0009765625 AS x1_h FROM range(1, 1025) t(i)")
def diagonal_boxes(s, d):
    return generate.dia(s, 1024, area=4.0, dither=0.0)


@query()
def uniform_boxes(s, d):
    return generate.uni(s, 10000, area=10.0)


@query()
def bit_points(s, d):
    return generate.bit(s, 10000)


@query("SELECT 1024 AS n, 1.0 AS volume")
def parcels(s, d):
    return generate.parcels(s, 10).agg(F.count("*").cast("int").alias("n"), F.round(F.sum(volume(Box())), 6).alias("volume"))


@query()
def parcel_clusters(s, d):
    return generate.clusters(s, 8, 25)


@query()
def edge_clusters(s, d):
    return generate.clusters(s, 8, 25, along=True)


@query()
def dithered(s, d):
    return generate.dither(li(s, d), 0.2, [1.0, 1.0])


@query(f"WITH {LI} SELECT rid FROM li")
def shuffled_records(s, d):
    return generate.shuffled(li(s, d)).select("rid")


@query(f"WITH {LI} SELECT a.rid, count(*) AS n FROM li a JOIN li b ON a.x0_l = b.x0_l AND a.x0_h = b.x0_h AND a.x1_l = b.x1_l AND a.x1_h = b.x1_h GROUP BY a.rid")
def equal_boxes(s, d):
    rows = li(s, d)
    return select.exact_counts(rows, rows, "rid").groupBy("rid").agg(F.sum("n").alias("n"))
