"""The registered queries over the lattices, each with the DuckDB SQL that it equals where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import grid as G
from strataq.operators import cells as C
from strataq.functions.lineage import shared_path
from strataq.operators import codec, decimate, isosurface, mesh, slices
from strataq.plans import lattice as L
from strataq.plans.volume import Volume
from strataq.sources import archive, plot, plotfile, source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
XYZ = ["x", "y", "z"]
E_ISO, L_ISO = 0.0, 50000.0


def cubes_sql(source: str, name: str) -> str:
    values = ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS v{k}" for k in range(8))
    return f"{name} AS (SELECT level, x - dx AS ax, y - dy AS ay, z - dz AS az, {values} FROM {source}, o GROUP BY level, x - dx, y - dy, z - dz HAVING count(*) = 8)"


def ranges_sql(source: str, cubes: str, name: str) -> str:
    halo = " AND ".join(f"(d{a} = 0 OR ({a} % 32 = 0 AND {a} > 0))" for a in "xyz")
    keys = ", ".join(f"({a} >> 5) - d{a} AS c{a}" for a in "xyz")
    return f"""{name} AS (SELECT level, cx, cy, cz, min(v) AS vmin, max(v) AS vmax FROM (SELECT level, {keys}, v FROM {source}, o WHERE {halo})
  WHERE (level, cx, cy, cz) IN (SELECT (level, ax >> 5, ay >> 5, az >> 5) FROM {cubes}) GROUP BY level, cx, cy, cz)"""


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name, with SQL after the lattices' common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH " + ",\n".join([L.SQL.strip(), *ctes]) + "\n" + sql.strip()
        return f

    return add


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


E_CUBES, L_CUBES, LC_CUBES = cubes_sql("ef", "cubes"), cubes_sql("lf", "lcubes"), cubes_sql("lc", "ccubes")
CASE = " + ".join(f"CASE WHEN v{k} > 0 THEN {1 << k} ELSE 0 END" for k in range(8))

# -- statistics, scans, grids ----------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(count(*) FILTER (isnan(v)) AS BIGINT) AS nan_count, CAST(min(v) AS DOUBLE) AS vmin, CAST(max(v) AS DOUBLE) AS vmax FROM e_cells")
def component_stats(spark, sf_dir):
    return doubles(C.stats(L.e_cells(spark, sf_dir)), "vmin", "vmax")


@query("SELECT level, count(*) AS n, CAST(min(v) AS DOUBLE) AS vmin, CAST(max(v) AS DOUBLE) AS vmax FROM e_cells GROUP BY ROLLUP (level)")
def level_stats_rollup(spark, sf_dir):
    return L.e_cells(spark, sf_dir).rollup("level").agg(F.count("*").alias("n"), F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))


@query("SELECT level, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, count(*) AS n FROM e_cells GROUP BY level, x >> 5, y >> 5, z >> 5")
def voxel_count_by_chunk(spark, sf_dir):
    return C.chunk_counts(L.e_cells(spark, sf_dir))


@query("SELECT level, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, count(*) AS n, min(q) = max(q) AS uniform, count(*) = 32768 AS \"full\" FROM lf GROUP BY level, x >> 5, y >> 5, z >> 5")
def chunk_uniformity(spark, sf_dir):
    return C.chunk_uniformity(L.l_fine(spark, sf_dir), "q")


@query("SELECT * FROM ranges", L_CUBES, ranges_sql("lf", "lcubes", "ranges"))
def chunk_ranges_halo(spark, sf_dir):
    fine = L.l_fine(spark, sf_dir)
    return C.chunk_ranges(fine, C.cubes(fine, corners=False))


@query(f"SELECT level, cx, cy, cz FROM ranges WHERE vmin <= {L_ISO} AND vmax > {L_ISO}", L_CUBES, ranges_sql("lf", "lcubes", "ranges"))
def chunks_crossing_iso(spark, sf_dir):
    fine = L.l_fine(spark, sf_dir)
    return C.crossing(C.chunk_ranges(fine, C.cubes(fine, corners=False)), L_ISO).select("level", "cx", "cy", "cz")


@query("SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM ef WHERE x >= 3 AND x < 20 AND y >= 5 AND y < 17 AND z >= 2 AND z < 9")
def box_scan(spark, sf_dir):
    return doubles(C.box_scan(L.e_fine(spark, sf_dir), (3, 5, 2), (20, 17, 9)).select(*XYZ, "v"), "v")


@query("""SELECT box_id FROM (SELECT n_nationkey AS box_id, n_nationkey AS lx, n_nationkey % 7 * 5 AS ly, n_nationkey % 5 AS lz FROM nation) b
WHERE EXISTS (SELECT 1 FROM lf WHERE x >= lx AND x < lx + 2 AND y >= ly AND y < ly + 2 AND z >= lz AND z < lz + 1)""")
def box_exists(spark, sf_dir):
    n = F.col("n_nationkey")
    boxes = L.read(spark, sf_dir, "nation").select(n.alias("box_id"), n.alias("lx"), (n % 7 * 5).alias("ly"), (n % 5).alias("lz"))
    boxes = boxes.withColumns({"hx": F.col("lx") + 2, "hy": F.col("ly") + 2, "hz": F.col("lz") + 1})
    return C.any_in_boxes(boxes, L.l_fine(spark, sf_dir)).select("box_id")


@query("SELECT x, y, z, CAST(v AS DOUBLE) AS v, x + 32 * (y + 32 * z) AS linear FROM ef WHERE x = 5 AND y = 6 AND z = 7")
def point_lookup(spark, sf_dir):
    at = L.e_fine(spark, sf_dir).where("x = 5 AND y = 6 AND z = 7")
    return doubles(at.select(*XYZ, "v", G.linear_index(32, 32).alias("linear")), "v")


PATCHES = "p AS (SELECT vec_id, vec_id % 8 AS px, (vec_id // 8) % 8 AS py, vec_id // 64 AS pz FROM embeddings)"


def patches(spark, sf_dir):
    return L.read(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id % 8 px", "(vec_id div 8) % 8 py", "vec_id div 64 pz")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, CAST((least(a.px, b.px) * 4 + 5 - greatest(a.px, b.px) * 4 + 1) * (least(a.py, b.py) * 4 + 5 - greatest(a.py, b.py) * 4 + 1)
  * (least(a.pz, b.pz) * 4 + 5 - greatest(a.pz, b.pz) * 4 + 1) AS BIGINT) AS volume
FROM p a, p b WHERE a.vec_id < b.vec_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AND abs(a.pz - b.pz) <= 1""", PATCHES)
def box_intersection(spark, sf_dir):
    """Common volume of patches grown by one cell; neighbours meet under shared keys, so no pair of far patches is made."""
    p = patches(spark, sf_dir)
    box = lambda n: p.select(F.col("vec_id").alias(n), *((F.col(f"p{a}") * 4 - 1).alias(f"{n}l{a}") for a in "xyz"), *((F.col(f"p{a}") * 4 + 5).alias(f"{n}h{a}") for a in "xyz"), "px", "py", "pz")
    near = box("a")
    for a in "xyz":
        near = near.withColumn(f"p{a}", F.explode(F.array(*(F.col(f"p{a}") + d for d in (-1, 0, 1)))))
    met = near.join(box("b"), ["px", "py", "pz"]).where("a < b")
    lo, hi = G.intersection(["alx", "aly", "alz"], ["ahx", "ahy", "ahz"], ["blx", "bly", "blz"], ["bhx", "bhy", "bhz"])
    return met.select("a", "b", G.volume(lo, hi).alias("volume"))


@query("SELECT vec_id AS patch_id, CAST(list_min(embedding) AS DOUBLE) AS vmin, CAST(list_max(embedding) AS DOUBLE) AS vmax FROM embeddings")
def patch_bounds(spark, sf_dir):
    return L.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), F.array_min("embedding").cast("double").alias("vmin"), F.array_max("embedding").cast("double").alias("vmax"))


@query("SELECT patch_id, count(*) AS n FROM ef WHERE v > 0.3 GROUP BY patch_id")
def patch_prune_by_value(spark, sf_dir):
    """Cells above a value, reading only the patches whose bounds allow it."""
    e = L.read(spark, sf_dir, "embeddings").where((F.col("label") != 0) & (F.array_max("embedding") > F.lit(0.3)))
    return e.select(F.col("vec_id").alias("patch_id"), F.explode("embedding").alias("v")).where("v > 0.3").groupBy("patch_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id, x, y, z, CAST(v AS DOUBLE) AS v FROM ea")
def array_to_cells(spark, sf_dir):
    return doubles(L.e_all(spark, sf_dir).select("vec_id", *XYZ, "v"), "v")


@query("""SELECT vec_id, count(*) AS n, list(v ORDER BY z, y, x) = any_value(embedding) AS same FROM ea JOIN embeddings USING (vec_id) GROUP BY vec_id""")
def cells_to_array(spark, sf_dir):
    back = L.e_all(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))), lambda s: s["v"]).alias("back"))
    return back.join(L.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", "n", (F.col("back") == F.col("embedding")).alias("same"))


@query("SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM e_cells WHERE level BETWEEN 0 AND 0")
def level_filter(spark, sf_dir):
    return doubles(L.e_cells(spark, sf_dir).where(F.col("level").between(0, 0)).select(*XYZ, "v"), "v")


def l_long(spark, sf_dir):
    """The L-lattice in long form: component 0 is v, 1 is q."""
    return L.l_fine(spark, sf_dir).select("level", *XYZ, F.posexplode(F.array("v", "q")).alias("component", "v"))


@query("SELECT 1 AS component, x, y, z, q AS v FROM lf")
def component_project(spark, sf_dir):
    return l_long(spark, sf_dir).where("component = 1").select("component", *XYZ, "v")


SPOILT = """spoilt AS (SELECT x, y, z, CASE WHEN (x + y + z) % 7 = 0 THEN 'NaN'::DOUBLE WHEN (x + y + z) % 11 = 0 THEN 'Infinity'::DOUBLE
  WHEN (x + y + z) % 13 = 0 THEN 1e39 ELSE v END AS v FROM lf)"""


def spoilt(spark, sf_dir):
    s = F.col("x") + F.col("y") + F.col("z")
    bad = F.when(s % 7 == 0, float("nan")).when(s % 11 == 0, float("inf")).when(s % 13 == 0, 1e39).otherwise(F.col("v"))
    return L.l_fine(spark, sf_dir).select(*XYZ, bad.alias("v"))


@query("SELECT x, y, z, CAST(CAST(CASE WHEN isnan(v) OR abs(v) >= 3.4028235677973366e38 THEN 0 ELSE v END AS FLOAT) AS DOUBLE) AS v FROM spoilt", SPOILT)
def sanitise_replace(spark, sf_dir):
    return doubles(spoilt(spark, sf_dir).select(*XYZ, G.sanitised(F.col("v")).alias("v")), "v")


@query("SELECT 0 AS component, count(*) AS replaced FROM spoilt WHERE isnan(v) OR abs(v) >= 3.4028235677973366e38 HAVING count(*) > 0", SPOILT)
def replace_counts(spark, sf_dir):
    bad = spoilt(spark, sf_dir).select(F.lit(0).alias("component"), (~G.representable(F.col("v"), True)).cast("long").alias("bad"))
    return bad.groupBy("component").agg(F.sum("bad").alias("replaced")).where("replaced > 0")


@query("""SELECT level, count(*) AS samples, count(DISTINCT (x >> 5, y >> 5, z >> 5)) AS chunks, count(DISTINCT patch_id) AS patches FROM
(SELECT level, x, y, z, patch_id FROM ef UNION ALL SELECT level, x, y, z, NULL FROM ec) GROUP BY level""")
def work_counts(spark, sf_dir):
    both = L.e_fine(spark, sf_dir).select("level", *XYZ, "patch_id").unionByName(L.e_coarse(spark, sf_dir).select("level", *XYZ, F.lit(None).cast("long").alias("patch_id")))
    return both.groupBy("level").agg(F.count("*").alias("samples"), F.countDistinct(F.struct(*G.chunk_key())).alias("chunks"), F.countDistinct("patch_id").alias("patches"))


CODE = "CAST(floor(greatest(0.0, least(1.0, (v - 1000.0) / 89000.0)) * 4294967295.0 + 0.5) AS BIGINT)"


@query(f"SELECT x, y, z, {CODE} AS code FROM lf")
def unorm_encode(spark, sf_dir):
    return L.l_fine(spark, sf_dir).select(*XYZ, G.unorm_code(F.col("v"), 1000.0, 90000.0).alias("code"))


@query(f"SELECT x, y, z, {CODE} / 4294967295.0 AS v FROM lf".replace("/ 4294967295.0 AS", "/ CAST(4294967295.0 AS DOUBLE) AS"))
def unorm_decode(spark, sf_dir):
    return L.l_fine(spark, sf_dir).select(*XYZ, G.unorm_value(G.unorm_code(F.col("v"), 1000.0, 90000.0)).alias("v"))


LEVELS = """lv AS (SELECT n_nationkey AS k, n_nationkey - 4 AS co, 2 * n_nationkey - 7 AS fo, 1 + n_nationkey % 4 AS r FROM nation)"""


def levels(spark, sf_dir):
    return L.read(spark, sf_dir, "nation").selectExpr("n_nationkey k", "n_nationkey - 4 co", "2 * n_nationkey - 7 fo", "1 + n_nationkey % 4 r")


@query("SELECT k, CAST(co * r - fo AS BIGINT) AS translation FROM lv", LEVELS)
def level_translation(spark, sf_dir):
    return levels(spark, sf_dir).select("k", (F.col("co").cast("long") * F.col("r") - F.col("fo")).alias("translation"))


@query("SELECT k, CAST(floor(c / f + 0.5) AS BIGINT) AS ratio, abs(c / f - floor(c / f + 0.5)) <= 1e-10 * floor(c / f + 0.5) AND floor(c / f + 0.5) >= 1 AS whole FROM (SELECT k, CAST(0.25 * r + CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS c, CAST(0.25 AS DOUBLE) AS f FROM lv)", LEVELS)
def refinement_ratio(spark, sf_dir):
    c = (F.lit(0.25) * F.col("r") + F.when(F.col("k") % 3 == 0, 0.1).otherwise(0.0)) / F.lit(0.25)
    r = F.floor(c + 0.5)
    return levels(spark, sf_dir).select("k", r.alias("ratio"), ((F.abs(c - r) <= 1e-10 * r) & (r >= 1)).alias("whole"))


# -- masks and stencils ------------------------------------------------------------------------------------------------


@query("SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM ec WHERE (x, y, z) NOT IN (SELECT (x // 2, y // 2, z // 2) FROM ef)")
def mask_any_cover(spark, sf_dir):
    return doubles(C.mask_any_cover(L.e_coarse(spark, sf_dir), L.e_fine(spark, sf_dir)).select(*XYZ, "v"), "v")


@query("SELECT x, y, z, v FROM lc WHERE (x, y, z) NOT IN (SELECT (CAST(floor((x + 3) / 2.0) AS INT), CAST(floor((y + 3) / 2.0) AS INT), CAST(floor((z + 3) / 2.0) AS INT)) FROM lf)")
def mask_any_cover_shifted(spark, sf_dir):
    return C.mask_any_cover(L.l_coarse(spark, sf_dir), L.l_fine(spark, sf_dir), shift=(-3, -3, -3)).select(*XYZ, "v")


@query("""SELECT x, y, z, v FROM lc WHERE z = 1 AND (x, y) NOT IN (SELECT (x, y) FROM (SELECT DISTINCT x // 2 AS x, y // 2 AS y, x % 2 AS a, y % 2 AS b FROM lf WHERE z IN (2, 3)) GROUP BY x, y HAVING count(*) = 4)""")
def mask_full_cover_slice(spark, sf_dir):
    return C.mask_full_cover(L.l_coarse(spark, sf_dir).where("z = 1"), L.l_fine(spark, sf_dir).where("z IN (2, 3)"), "z", fine_hi=(40, 40, 7)).select(*XYZ, "v")


@query("SELECT ax, ay, az FROM lcubes", L_CUBES)
def eligible_cubes(spark, sf_dir):
    return C.cubes(L.l_fine(spark, sf_dir), corners=False).select("ax", "ay", "az")


@query(f"SELECT CAST({CASE} AS INT) AS case_index, count(*) AS n FROM cubes GROUP BY {CASE}", E_CUBES)
def cube_case_histogram(spark, sf_dir):
    return C.cubes(L.e_fine(spark, sf_dir)).groupBy(C.case_index(E_ISO).alias("case_index")).agg(F.count("*").alias("n"))


D = [f"CAST(v{k} AS DOUBLE)" for k in range(8)]


@query(f"""SELECT ax, ay, az, (({D[1]} + {D[2]} + {D[5]} + {D[6]}) - ({D[0]} + {D[3]} + {D[4]} + {D[7]})) / 4.0 AS gx,
(({D[2]} + {D[3]} + {D[6]} + {D[7]}) - ({D[0]} + {D[1]} + {D[4]} + {D[5]})) / 4.0 AS gy,
(({D[4]} + {D[5]} + {D[6]} + {D[7]}) - ({D[0]} + {D[1]} + {D[2]} + {D[3]})) / 4.0 AS gz FROM cubes""", E_CUBES)
def cube_gradient(spark, sf_dir):
    return C.cubes(L.e_fine(spark, sf_dir)).select("ax", "ay", "az", *C.gradient())


@query(f"""SELECT level, ax, ay, az FROM lcubes SEMI JOIN (SELECT * FROM lr WHERE vmin <= {L_ISO} AND vmax > {L_ISO}) r ON ax >> 5 = cx AND ay >> 5 = cy AND az >> 5 = cz
UNION ALL SELECT level, ax, ay, az FROM ccubes SEMI JOIN (SELECT * FROM cr WHERE vmin <= {L_ISO} AND vmax > {L_ISO}) r ON ax >> 5 = cx AND ay >> 5 = cy AND az >> 5 = cz
WHERE (ax, ay, az) NOT IN (SELECT (x // 2, y // 2, z // 2) FROM lf)""", L_CUBES, LC_CUBES, ranges_sql("lf", "lcubes", "lr"), ranges_sql("lc", "ccubes", "cr"))
def active_cubes(spark, sf_dir):
    fine, coarse = L.l_fine(spark, sf_dir), L.l_coarse(spark, sf_dir)
    by_level = {0: C.cubes(coarse, corners=False), 1: C.cubes(fine, corners=False)}
    return C.active_cubes(by_level, {0: coarse, 1: fine}, L_ISO).select("level", "ax", "ay", "az")


def edge_rows(source: str, iso: float) -> str:
    parts = []
    for a, b, axis in isosurface.EDGES:
        dx, dy, dz = G.CORNERS[a]
        parts.append(f"SELECT level, ax + {dx} AS x, ay + {dy} AS y, az + {dz} AS z, {axis} AS axis, CAST(v{a} AS DOUBLE) AS s, CAST(v{b} AS DOUBLE) AS e FROM {source}")
    return f"edges AS (SELECT *, greatest(0.0, least(1.0, ({iso} - s) / (e - s))) AS t FROM (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})) WHERE (s > {iso}) <> (e > {iso}))"


PLACE = ", ".join(f"CAST(CAST({a} + CASE WHEN axis = {i} THEN t ELSE 0 END + 0.5 AS FLOAT) AS DOUBLE) AS p{a}" for i, a in enumerate("xyz"))


def l_vertices(spark, sf_dir):
    return isosurface.edge_vertices(None, L_ISO, C.cubes(L.l_fine(spark, sf_dir)))


@query(f"SELECT x, y, z, axis, t, {PLACE} FROM edges", L_CUBES, edge_rows("lcubes", L_ISO))
def iso_edge_vertices(spark, sf_dir):
    return doubles(l_vertices(spark, sf_dir).drop("level"), "px", "py", "pz")


@query("""SELECT e.x, e.y, e.z, axis, CAST(floor(greatest(0.0, least(1.0, ((a.q + (b.q - a.q) * t) - 1.0) / 49.0)) * 65535.0 + 0.5) AS INT) AS u_code
FROM edges e JOIN lf a ON a.x = e.x AND a.y = e.y AND a.z = e.z
JOIN lf b ON b.x = e.x + CAST(axis = 0 AS INT) AND b.y = e.y + CAST(axis = 1 AS INT) AND b.z = e.z + CAST(axis = 2 AS INT)""", L_CUBES, edge_rows("lcubes", L_ISO))
def iso_vertex_uv(spark, sf_dir):
    fine = L.l_fine(spark, sf_dir)
    return isosurface.edge_samples(isosurface.edge_vertices(None, L_ISO, C.cubes(fine)), fine, 1.0, 50.0, "q").select(*XYZ, "axis", "u_code")


W = [f"1.0 / (CAST(1e-12 AS DOUBLE) + abs(CAST(v{k} AS DOUBLE) - {L_ISO}))" for k in range(8)]
MEAN = [" + ".join(f"w{k}" for k in range(8) if G.CORNERS[k][a]) for a in range(3)]


@query(f"SELECT ax, ay, az, round(({MEAN[0]}) / w, 6) AS mx, round(({MEAN[1]}) / w, 6) AS my, round(({MEAN[2]}) / w, 6) AS mz FROM (SELECT *, {' + '.join(f'w{k}' for k in range(8))} AS w FROM (SELECT ax, ay, az, {', '.join(f'{w} AS w{k}' for k, w in enumerate(W))} FROM lcubes))", L_CUBES)
def iso_interior_weights(spark, sf_dir):
    _, place = isosurface.interior_weights(L_ISO)
    return C.cubes(L.l_fine(spark, sf_dir)).select("ax", "ay", "az", *(F.round(p, 6).alias(n) for p, n in zip(place, ("mx", "my", "mz"), strict=True)))


@query()
def iso_faces(spark, sf_dir):
    _, faces = isosurface.isosurface(L.e_fine(spark, sf_dir), E_ISO)
    return faces


@query()
def iso_vertices(spark, sf_dir):
    vertices, _ = isosurface.isosurface(L.e_fine(spark, sf_dir), E_ISO)
    return vertices


BOTH = """both_levels AS (SELECT lcubes.* FROM lcubes SEMI JOIN (SELECT * FROM lr WHERE vmin <= 50000.0 AND vmax > 50000.0) r ON ax >> 5 = cx AND ay >> 5 = cy AND az >> 5 = cz
UNION ALL SELECT ccubes.* FROM ccubes SEMI JOIN (SELECT * FROM cr WHERE vmin <= 50000.0 AND vmax > 50000.0) r ON ax >> 5 = cx AND ay >> 5 = cy AND az >> 5 = cz
WHERE (ax, ay, az) NOT IN (SELECT (x // 2, y // 2, z // 2) FROM lf))"""
TWO_LEVELS = (L_CUBES, LC_CUBES, ranges_sql("lf", "lcubes", "lr"), ranges_sql("lc", "ccubes", "cr"), BOTH, edge_rows("both_levels", L_ISO))
L_GEOMETRY = {0: ((0.0, 0.0, 0.0), (2.0, 2.0, 2.0)), 1: ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))}


def l_surface(spark, sf_dir, **options) -> tuple[DataFrame, DataFrame]:
    levels = {0: L.l_coarse(spark, sf_dir).withColumn("q", F.col("v") / 1000.0), 1: L.l_fine(spark, sf_dir)}
    return isosurface.isosurface_of_levels(levels, L_ISO, geometry=L_GEOMETRY, **options)


SIZED = ", ".join(f"CAST(CAST((e.{a} + CASE WHEN axis = {i} THEN t ELSE 0 END + 0.5) * (2 - e.level) AS FLOAT) AS DOUBLE) AS p{a}" for i, a in enumerate("xyz"))
VID = "(CAST(e.level AS BIGINT) << 56) | (CAST(e.z AS BIGINT) << 38) | (CAST(e.y AS BIGINT) << 20) | (CAST(e.x AS BIGINT) << 2) | axis"


@query(f"SELECT {VID} AS vid, level, {SIZED} FROM edges e", *TWO_LEVELS)
def iso_multilevel_vertices(spark, sf_dir):
    """The edge vertices of the surface over both levels; interior ones aren't in the SQL."""
    vertices, _ = l_surface(spark, sf_dir)
    return doubles(vertices.where(F.col("vid").bitwiseAND(F.lit(3)) != isosurface.INTERIOR).select("vid", "level", "px", "py", "pz"), "px", "py", "pz")


@query(f"""SELECT {VID} AS vid, CAST(floor(greatest(0.0, least(1.0, ((a.q + (b.q - a.q) * t) - 1.0) / 49.0)) * 65535.0 + 0.5) AS INT) AS u_q_code
FROM edges e JOIN bq a ON a.level = e.level AND a.x = e.x AND a.y = e.y AND a.z = e.z
JOIN bq b ON b.level = e.level AND b.x = e.x + CAST(axis = 0 AS INT) AND b.y = e.y + CAST(axis = 1 AS INT) AND b.z = e.z + CAST(axis = 2 AS INT)""", *TWO_LEVELS, "bq AS (SELECT level, x, y, z, q FROM lf UNION ALL SELECT level, x, y, z, v / 1000.0 FROM lc)")
def iso_multilevel_samples(spark, sf_dir):
    vertices, _ = l_surface(spark, sf_dir, samples=[("q", 1.0, 50.0)])
    return vertices.where(F.col("vid").bitwiseAND(F.lit(3)) != isosurface.INTERIOR).select("vid", "u_q_code")


@query()
def iso_multilevel_faces(spark, sf_dir):
    return l_surface(spark, sf_dir)[1]


# -- slices ------------------------------------------------------------------------------------------------------------


@query("SELECT x, y, z FROM ef WHERE z = 2")
def slice_cells(spark, sf_dir):
    return slices.slice_cells(L.e_fine(spark, sf_dir), "z", slices.plane_cell(3.0, 0.0, 1.0, 128)).select(*XYZ)


UV = """uv AS (SELECT a.x, a.y, a.z, greatest(0.0, least(1.0, (coalesce(CAST(a.v AS DOUBLE) + (CAST(b.v AS DOUBLE) - CAST(a.v AS DOUBLE)) * 0.25, CAST(a.v AS DOUBLE)) - -0.5) / 1.0)) AS u0
FROM ef a LEFT JOIN ef b ON b.x = a.x - 1 AND b.y = a.y AND b.z = a.z WHERE a.x = 5)"""


def uv(spark, sf_dir):
    return slices.slice_values(L.e_fine(spark, sf_dir), "x", 5.25, 5, 0.0, 1.0, [("v", -0.5, 0.5)])


@query("SELECT x, y, z, CAST(CAST(u0 AS FLOAT) AS DOUBLE) AS u0 FROM uv", UV)
def slice_uv(spark, sf_dir):
    return doubles(uv(spark, sf_dir), "u0")


CELL = "((CAST(1 AS BIGINT) << 58) + (CAST(z AS BIGINT) << 28) + y)"


@query(f"""SELECT {CELL} * 4 + i AS vid, CAST(5.25 AS DOUBLE) AS px, CAST(y + dy AS DOUBLE) AS py, CAST(z + dz AS DOUBLE) AS pz, CAST(CAST(u0 AS FLOAT) AS DOUBLE) AS u
FROM uv, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS q(i, dy, dz)""", UV)
def slice_vertices(spark, sf_dir):
    vertices, _ = slices.slice_mesh(uv(spark, sf_dir).withColumn("level", F.lit(1)), "x", 5.25)
    return doubles(vertices.select("vid", "px", "py", "pz", "u"), "px", "py", "pz", "u")


@query(f"SELECT {CELL} * 2 + i AS fid, {CELL} * 4 AS a, {CELL} * 4 + i + 1 AS b, {CELL} * 4 + i + 2 AS c FROM uv, (VALUES (0), (1)) AS q(i)", UV)
def slice_faces(spark, sf_dir):
    _, faces = slices.slice_mesh(uv(spark, sf_dir).withColumn("level", F.lit(1)), "x", 5.25)
    return faces.select("fid", "a", "b", "c")


SLICED = """fine_slice AS (SELECT 1 AS level, x, y, z, greatest(0.0, least(1.0, (v - 1000.0) / 89000.0)) AS u0 FROM lf WHERE z = 2),
coarse_slice AS (SELECT 0 AS level, a.x, a.y, a.z, greatest(0.0, least(1.0, (coalesce(a.v + (b.v - a.v) * 0.25, a.v) - 1000.0) / 89000.0)) AS u0
  FROM lc a LEFT JOIN lc b ON b.x = a.x AND b.y = a.y AND b.z = a.z - 1 WHERE a.z = 1 AND (a.x, a.y) NOT IN (
    SELECT (x, y) FROM (SELECT DISTINCT x // 2 AS x, y // 2 AS y, x % 2 AS p, y % 2 AS q FROM lf WHERE z = 2) GROUP BY x, y HAVING count(*) = 4)),
sliced AS (SELECT * FROM fine_slice UNION ALL SELECT * FROM coarse_slice)"""
SLICE_CELL = "((CAST(level AS BIGINT) << 58) + (CAST(y AS BIGINT) << 28) + x)"


def l_slice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    levels = {0: L.l_coarse(spark, sf_dir), 1: L.l_fine(spark, sf_dir)}
    extents = {0: (20, 20, 4), 1: (40, 40, 8)}
    return slices.slice_of_levels(levels, "z", 2.5, {k: (*L_GEOMETRY[k], extents[k]) for k in levels}, [("v", 1000.0, 90000.0)])


@query(f"""SELECT {SLICE_CELL} * 4 + i AS vid, level, CAST((x + dx) * (2 - level) AS DOUBLE) AS px, CAST((y + dy) * (2 - level) AS DOUBLE) AS py, CAST(2.5 AS DOUBLE) AS pz, CAST(CAST(u0 AS FLOAT) AS DOUBLE) AS u
FROM sliced, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS q(i, dx, dy)""", SLICED)
def slice_multilevel(spark, sf_dir):
    return doubles(l_slice(spark, sf_dir)[0].select("vid", "level", "px", "py", "pz", "u"), "px", "py", "pz", "u")


@query(f"SELECT {SLICE_CELL} * 2 + i AS fid, {SLICE_CELL} * 4 AS a, {SLICE_CELL} * 4 + i + 1 AS b, {SLICE_CELL} * 4 + i + 2 AS c FROM sliced, (VALUES (0), (1)) AS q(i)", SLICED)
def slice_multilevel_faces(spark, sf_dir):
    return l_slice(spark, sf_dir)[1].select("fid", "a", "b", "c")


# -- plotfiles: both levels' patches are written as one in the shared folder and read again ------------------------------


def written(spark, sf_dir) -> plot.AmrPlot:
    layers = L.read(spark, sf_dir, "embeddings").agg(F.max(F.expr("vec_id div 64")) + 1).first()[0]
    path = shared_path(spark, "plotfile")
    domains = [plotfile.Box((0, 0, 0), (8 * n - 1, 8 * n - 1, layers * n - 1)) for n in (2, 4)]
    source.export(L.e_patches(spark, sf_dir), path, ["density", "number"], domains, [(2.0,) * 3, (1.0,) * 3])
    return plot.AmrPlot.open(spark, path)


RANKED = "pr AS (SELECT level, patch_id AS vec_id, CAST(row_number() OVER (PARTITION BY level ORDER BY patch_id) - 1 AS INT) AS patch_id, lx, ly, lz, m, n0, n1 FROM (SELECT level, patch_id, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) - min(x) + 1 AS m, min(v) AS n0, max(v) AS n1 FROM ep GROUP BY level, patch_id))"


@query("SELECT level, component, pr.patch_id, x, y, z, CASE WHEN component = 0 THEN v ELSE i END AS v FROM ep JOIN pr ON pr.vec_id = ep.patch_id AND pr.level = ep.level, (VALUES (0), (1)) AS k(component)".replace("SELECT level,", "SELECT ep.level,"), RANKED)
def plotfile_cells(spark, sf_dir):
    return written(spark, sf_dir).cells()


@query("SELECT x, y, z, v FROM ep WHERE level = 1")
def plotfile_component_of_level(spark, sf_dir):
    return written(spark, sf_dir).cells_of("density", levels=[1]).select(*XYZ, "v")


@query("SELECT patch_id, count(*) AS n, sum(i) AS total FROM ep WHERE level = 0 GROUP BY patch_id".replace("SELECT patch_id", "SELECT pr.patch_id").replace("FROM ep WHERE level = 0 GROUP BY patch_id", "FROM ep JOIN pr ON pr.vec_id = ep.patch_id AND pr.level = ep.level WHERE ep.level = 0 GROUP BY pr.patch_id"), RANKED)
def plotfile_filtered(spark, sf_dir):
    """Filters on level and component, which the source takes where Spark pushes filters into Python sources."""
    return written(spark, sf_dir).cells().where("level = 0 AND component = 1").groupBy("patch_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT level, patch_id, lx, ly, lz, CAST(lx + m AS INT) AS hx, CAST(ly + m AS INT) AS hy, CAST(lz + m AS INT) AS hz, 0 AS ghost, CAST(lx * (2 - level) AS DOUBLE) AS plo_x, CAST((lx + m) * (2 - level) AS DOUBLE) AS phi_x FROM pr", RANKED)
def plotfile_patches(spark, sf_dir):
    return written(spark, sf_dir).patches().select("level", "patch_id", "lx", "ly", "lz", "hx", "hy", "hz", "ghost", "plo_x", "phi_x")


@query("SELECT level, patch_id, component, CASE WHEN component = 0 THEN n0 ELSE 0 END AS vmin, CASE WHEN component = 0 THEN n1 ELSE m * m * m - 1 END AS vmax FROM pr, (VALUES (0), (1)) AS k(component)", RANKED)
def plotfile_bounds(spark, sf_dir):
    return written(spark, sf_dir).patch_bounds()


@query("""SELECT k.level, 16 + 16 * k.level AS nx, CAST((1 + (SELECT max(vec_id // 64) FROM embeddings)) * (2 + 2 * k.level) AS INT) AS nz, CAST(2 - k.level AS DOUBLE) AS dx, CASE WHEN k.level = 1 THEN 2 END AS ratio, CASE WHEN k.level = 1 THEN 2 END AS rx,
CAST((SELECT count(*) FROM pr WHERE pr.level = k.level) AS INT) AS n_patches FROM (VALUES (0), (1)) AS k(level)""", RANKED)
def plotfile_levels(spark, sf_dir):
    p = written(spark, sf_dir)
    p.validate_all()
    return p.levels().select("level", "nx", "nz", "dx", "ratio", "rx", "n_patches")


@query("SELECT CAST(0 AS DOUBLE) AS time, 1 AS finest_level, CAST(32 AS DOUBLE) AS hi_x, CAST(4 * (1 + (SELECT max(vec_id // 64) FROM embeddings)) AS DOUBLE) AS hi_z, 0 AS coord_sys, component, name FROM (VALUES (0, 'density'), (1, 'number')) AS k(component, name)")
def plotfile_header(spark, sf_dir):
    p = written(spark, sf_dir)
    h = p.plot_header().first()
    return p.variables().select(*(F.lit(h[n]).alias(n) for n in ("time", "finest_level", "hi_x", "hi_z", "coord_sys")), "component", "name")


@query("SELECT level, component, x, y, z, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, CASE WHEN component = 0 THEN CAST(CAST(v AS FLOAT) AS DOUBLE) ELSE i END AS v FROM ep, (VALUES (0), (1)) AS k(component)")
def plotfile_converted(spark, sf_dir):
    path = shared_path(spark, "cells")
    plot.convert(written(spark, sf_dir), path, double=(1,))
    return spark.read.parquet(path).select("level", "component", *XYZ, "cx", "cy", "cz", "v")


E_BOTH = (E_CUBES, cubes_sql("ec", "eccubes"), "e_both AS (SELECT * FROM cubes UNION ALL SELECT * FROM eccubes WHERE (ax, ay, az) NOT IN (SELECT (x // 2, y // 2, z // 2) FROM ef))", edge_rows("e_both", E_ISO))


@query(f"SELECT {VID} AS vid, level, {SIZED} FROM edges e", *E_BOTH)
def volume_isosurface(spark, sf_dir):
    """The edge vertices of a plotfile's surface over both levels, with the plotfile's own geometry."""
    vertices, _ = Volume.load(written(spark, sf_dir), [0]).isosurface(0, E_ISO)
    return doubles(vertices.where(F.col("vid").bitwiseAND(F.lit(3)) != isosurface.INTERIOR).select("vid", "level", "px", "py", "pz"), "px", "py", "pz")


@query(f"SELECT {VID} AS vid, level FROM edges e WHERE level = 0", cubes_sql("ec", "eccubes"), edge_rows("eccubes", E_ISO))
def volume_isosurface_of_one_level(spark, sf_dir):
    """Levels beyond the range hide nothing."""
    vertices, _ = Volume.load(written(spark, sf_dir), [0]).isosurface(0, E_ISO, level_range=(0, 0))
    return vertices.where(F.col("vid").bitwiseAND(F.lit(3)) != isosurface.INTERIOR).select("vid", "level")


@query(f"""SELECT {SLICE_CELL} * 4 + i AS vid, level, CAST((x + dx) * (2 - level) AS DOUBLE) AS px, CAST((y + dy) * (2 - level) AS DOUBLE) AS py, CAST(CAST(u0 AS FLOAT) AS DOUBLE) AS u, CAST(CAST(u1 AS FLOAT) AS DOUBLE) AS v
FROM vs, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS q(i, dx, dy)""", """vs AS (SELECT level, x, y, z, greatest(0.0, least(1.0, v + 0.5)) AS u0, greatest(0.0, least(1.0, i / 100.0)) AS u1 FROM ep WHERE level = 1 AND z = 2
UNION ALL SELECT a.level, a.x, a.y, a.z, greatest(0.0, least(1.0, coalesce(a.v + (b.v - a.v) * 0.25, a.v) + 0.5)), greatest(0.0, least(1.0, coalesce(a.i + (b.i - a.i) * 0.25, a.i) / 100.0))
FROM ep a LEFT JOIN ep b ON b.level = 0 AND b.x = a.x AND b.y = a.y AND b.z = a.z - 1 WHERE a.level = 0 AND a.z = 1
  AND (a.x, a.y) NOT IN (SELECT (x, y) FROM (SELECT DISTINCT x // 2 AS x, y // 2 AS y, x % 2 AS p, y % 2 AS q FROM ef WHERE z = 2) GROUP BY x, y HAVING count(*) = 4))""")
def volume_slice(spark, sf_dir):
    vertices, _ = Volume.load(written(spark, sf_dir)).slice("z", 2.5, [(0, -0.5, 0.5), (1, 0.0, 100.0)])
    return doubles(vertices.select("vid", "level", "px", "py", "u", "v"), "px", "py", "u", "v")


@query("SELECT level, cx, cy, cz, CAST(vmin AS DOUBLE) AS vmin, CAST(vmax AS DOUBLE) AS vmax FROM vr0 UNION ALL SELECT level, cx, cy, cz, CAST(vmin AS DOUBLE), CAST(vmax AS DOUBLE) FROM vr1", E_CUBES, cubes_sql("ec", "eccubes"), ranges_sql("ef", "cubes", "vr1"), ranges_sql("ec", "eccubes", "vr0"))
def volume_ranges(spark, sf_dir):
    return Volume.load(written(spark, sf_dir), [0]).ranges(0)


@query("""SELECT 2 AS levels, 2 AS components, CAST((SELECT count(*) FROM pr) AS INT) AS patches, CAST((SELECT 2 * count(*) FROM pr) AS INT) AS component_patches, (SELECT count(*) FROM ep) AS samples,
(SELECT count(*) FROM (SELECT DISTINCT level, x >> 5, y >> 5, z >> 5 FROM ep)) AS chunks, count(*) AS cube_chunks, 2 * count(*) AS ranges
FROM (SELECT DISTINCT level, ax >> 5, ay >> 5, az >> 5 FROM (SELECT * FROM cubes UNION ALL SELECT * FROM eccubes))""", RANKED, E_CUBES, cubes_sql("ec", "eccubes"))
def volume_work_counts(spark, sf_dir):
    return Volume.load(written(spark, sf_dir)).work_counts()


# -- grids that change -------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(s.x, d.x) AS x, coalesce(s.y, d.y) AS y, coalesce(s.z, d.z) AS z, CAST(coalesce(s.v, d.v) AS DOUBLE) AS v
FROM ef d FULL JOIN (SELECT * FROM ec WHERE x < 10 AND y < 10 AND z < 10) s ON s.x = d.x AND s.y = d.y AND s.z = d.z""")
def union_replace(spark, sf_dir):
    return doubles(C.union_replace(L.e_fine(spark, sf_dir), L.e_coarse(spark, sf_dir), (0, 0, 0), (10, 10, 10)), "v")


@query("SELECT x, y, z, max({'p': p, 'v': v}).v AS v FROM (SELECT CAST(l_partkey % 40 AS INT) AS x, CAST(l_orderkey % 40 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, l_suppkey % 8 AS p, l_extendedprice AS v FROM lineitem) GROUP BY x, y, z")
def last_writer_wins(spark, sf_dir):
    w = L.read(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 40 as int) x", "cast(l_orderkey % 40 as int) y", "cast(l_linenumber - 1 as int) z", "l_extendedprice v", "struct(l_suppkey % 8, l_extendedprice) turn")
    return C.last_writer(w, "turn")


@query("""SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM ef WHERE NOT (x >= 2 AND x < 9 AND y >= 28 AND y < 32 AND z < 3)
UNION ALL SELECT CAST(x AS INT), CAST(y AS INT), CAST(z AS INT), 1.5 FROM range(2, 9) a(x), range(28, 32) b(y), range(0, 3) c(z)""")
def fill_box(spark, sf_dir):
    return doubles(C.fill_box(L.e_fine(spark, sf_dir), (2, 28, -1), (9, 40, 3), (0, 0, 0), (32, 32, 128), 1.5), "v")


@query("SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM ef WHERE NOT (x >= 2 AND x < 9 AND y >= 0 AND y < 30 AND z < 3)")
def clear_box(spark, sf_dir):
    return doubles(C.clear_box(L.e_fine(spark, sf_dir), (2, 0, 0), (9, 30, 3)).select(*XYZ, "v"), "v")


# -- meshes: a height field over each layer, with the holes of the fine level -------------------------------------

MESH = """mv AS (SELECT CAST(z AS BIGINT) * 1024 + y * 32 + x AS vid, CAST(x AS FLOAT) AS px, CAST(y AS FLOAT) AS py, CAST(z + floor(v * 64) / 64 AS FLOAT) AS pz FROM ef),
sq AS (SELECT vid AS s FROM mv WHERE px < 31 AND py < 31 AND vid + 1 IN (SELECT vid FROM mv) AND vid + 32 IN (SELECT vid FROM mv) AND vid + 33 IN (SELECT vid FROM mv)),
mf AS (SELECT 2 * s AS fid, s AS a, s + 1 AS b, s + 33 AS c FROM sq UNION ALL SELECT 2 * s + 1, s, s + 33, s + 32 FROM sq),
me AS (SELECT least(p, q) AS u, greatest(p, q) AS v, count(*) AS n FROM (SELECT a AS p, b AS q FROM mf UNION ALL SELECT b, c FROM mf UNION ALL SELECT c, a FROM mf) GROUP BY least(p, q), greatest(p, q)),
adj AS (SELECT u AS src, v AS dst FROM me UNION ALL SELECT v, u FROM me)"""


def height_field(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = L.e_fine(spark, sf_dir).select((F.col("z").cast("long") * 1024 + F.col("y") * 32 + F.col("x")).alias("vid"), F.col("x").cast("float").alias("px"), F.col("y").cast("float").alias("py"), (F.col("z") + F.floor(F.col("v") * 64) / 64).cast("float").alias("pz"))
    squares = v.where("px < 31 AND py < 31").select(F.col("vid").alias("s"))
    for d in (1, 32, 33):
        squares = squares.join(v.select((F.col("vid") - d).alias("s")), "s", "left_semi")
    s = F.col("s")
    two = F.array(*(F.struct((2 * s + i).alias("fid"), s.alias("a"), b.alias("b"), c.alias("c")) for i, (b, c) in enumerate(((s + 1, s + 33), (s + 33, s + 32)))))
    return v, squares.select(F.explode(two).alias("f")).select("f.*")


@query("SELECT u, v, n FROM me", MESH)
def edge_incidence(spark, sf_dir):
    return mesh.edges(height_field(spark, sf_dir)[1])


@query("SELECT DISTINCT vid FROM (SELECT u AS vid, n FROM me UNION ALL SELECT v, n FROM me) WHERE n <> 2", MESH)
def boundary_vertices(spark, sf_dir):
    return mesh.locked(mesh.edges(height_field(spark, sf_dir)[1]))


@query("SELECT src AS vid, count(*) AS degree FROM adj GROUP BY src", MESH)
def vertex_degree(spark, sf_dir):
    return mesh.degrees(mesh.edges(height_field(spark, sf_dir)[1]))


LENGTHS = """ml AS (SELECT src AS vid, avg(sqrt((p.px::DOUBLE - q.px) ^ 2 + (p.py::DOUBLE - q.py) ^ 2 + (p.pz::DOUBLE - q.pz) ^ 2)) AS mean_length FROM adj JOIN mv p ON p.vid = src JOIN mv q ON q.vid = dst GROUP BY src)"""


@query("SELECT vid, round(mean_length, 9) AS mean_length FROM ml", MESH, LENGTHS)
def mean_edge_length(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return mesh.mean_edge_lengths(mesh.edges(f), v).select("vid", F.round("mean_length", 9).alias("mean_length"))


@query("""SELECT v.vid, round(CAST(CAST(v.px + coalesce(dx * k, 0) AS FLOAT) AS DOUBLE), 4) AS px, round(CAST(CAST(v.py + coalesce(dy * k, 0) AS FLOAT) AS DOUBLE), 4) AS py, round(CAST(CAST(v.pz + coalesce(dz * k, 0) AS FLOAT) AS DOUBLE), 4) AS pz
FROM mv v LEFT JOIN (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) > mean_length * 0.25 THEN mean_length * 0.25 / sqrt(dx * dx + dy * dy + dz * dz) ELSE 1 END AS k FROM (
  SELECT p.vid, (avg(q.px::DOUBLE) - any_value(p.px)) * 0.5 AS dx, (avg(q.py::DOUBLE) - any_value(p.py)) * 0.5 AS dy, (avg(q.pz::DOUBLE) - any_value(p.pz)) * 0.5 AS dz
  FROM adj JOIN mv p ON p.vid = src JOIN mv q ON q.vid = dst WHERE p.vid NOT IN (SELECT u FROM me WHERE n <> 2 UNION SELECT v FROM me WHERE n <> 2) GROUP BY p.vid) JOIN ml USING (vid)) m ON m.vid = v.vid""", MESH, LENGTHS)
def relax_one_pass(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    e = mesh.edges(f)
    out = mesh.relax_pass(v, mesh.adjacency(e), mesh.locked(e), mesh.mean_edge_lengths(e, v), 0.5, 0.25)
    return out.select("vid", *(F.round(F.col(p).cast("double"), 4).alias(p) for p in mesh.P))


@query()
def relax_taubin(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return mesh.relax(v, f)


BAD_FACES = "bf AS (SELECT fid, a, CASE WHEN fid % 5 = 0 THEN a ELSE b END AS b, CASE WHEN fid % 7 = 3 THEN a + 2 * (b - a) ELSE c END AS c FROM mf WHERE fid % 7 <> 3 OR a + 2 * (b - a) IN (SELECT vid FROM mv))"


def bad_faces(v, f):
    third = F.col("a") + 2 * (F.col("b") - F.col("a"))
    some = f.join(v.select(F.col("vid").alias("__v")), third == F.col("__v"), "left").where((F.col("fid") % 7 != 3) | F.col("__v").isNotNull())
    return some.select("fid", "a", F.when(F.col("fid") % 5 == 0, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(F.col("fid") % 7 == 3, third).otherwise(F.col("c")).alias("c"))


CROSS = "(uy * wz - uz * wy) ^ 2 + (uz * wx - ux * wz) ^ 2 + (ux * wy - uy * wx) ^ 2"


@query(f"""SELECT fid, a, b, c FROM (SELECT fid, a, b, c, q.px::DOUBLE - p.px AS ux, q.py::DOUBLE - p.py AS uy, q.pz::DOUBLE - p.pz AS uz, r.px::DOUBLE - p.px AS wx, r.py::DOUBLE - p.py AS wy, r.pz::DOUBLE - p.pz AS wz
FROM bf JOIN mv p ON p.vid = a JOIN mv q ON q.vid = b JOIN mv r ON r.vid = c WHERE a <> b AND b <> c AND a <> c) WHERE 0.25 * ({CROSS}) > 0.5 * 0.5""", MESH, BAD_FACES)
def degenerate_faces(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return mesh.remove_degenerate(bad_faces(v, f), v, 0.5).select("fid", "a", "b", "c")


@query("""SELECT row_number() OVER (ORDER BY first) - 1 AS vid, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(pz AS DOUBLE) AS pz
FROM (SELECT vid, min(first) AS first FROM (SELECT a AS vid, fid * 3 AS first FROM mf UNION ALL SELECT b, fid * 3 + 1 FROM mf UNION ALL SELECT c, fid * 3 + 2 FROM mf) GROUP BY vid) JOIN mv USING (vid)""", MESH)
def compact_vertices(spark, sf_dir):
    return doubles(mesh.compact_vertices(*height_field(spark, sf_dir))[0], "px", "py", "pz")


@query("SELECT min(w) AS vid, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(pz AS DOUBLE) AS pz FROM (SELECT fid * 3 AS w, a AS vid FROM mf UNION ALL SELECT fid * 3 + 1, b FROM mf UNION ALL SELECT fid * 3 + 2, c FROM mf) JOIN mv USING (vid) GROUP BY vid, px, py, pz", MESH)
def weld_vertices(spark, sf_dir):
    """Face corners as vertices of their own, welded by the vertex they came from."""
    v, f = height_field(spark, sf_dir)
    own = f.select(F.posexplode(F.array("a", "b", "c")).alias("pos", "key"), "fid").select("key", (F.col("fid") * 3 + F.col("pos")).alias("vid"))
    return doubles(mesh.weld(own.join(v.withColumnRenamed("vid", "key"), "key"), ["key"]).drop("key"), "px", "py", "pz")


@query("SELECT min(fid) AS fid FROM (SELECT fid, a, b, c FROM mf UNION ALL SELECT fid + 1000000000000, b, c, a FROM mf WHERE fid % 3 = 0) GROUP BY list_sort([a, b, c])", MESH)
def face_dedup(spark, sf_dir):
    _, f = height_field(spark, sf_dir)
    again = f.where("fid % 3 = 0").select((F.col("fid") + 1000000000000).alias("fid"), F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))
    return mesh.distinct_faces(f.unionByName(again)).select("fid")


@query("SELECT fid, a, b, c FROM mf UNION ALL SELECT fid + (SELECT max(fid) + 1 FROM mf), a + m, c + m, b + m FROM mf, (SELECT max(vid) + 1 AS m FROM mv)", MESH)
def mesh_union_rebase(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return mesh.concat([(v, f), (v, mesh.flip(f))])[1]


@query()
def decimate_mesh(spark, sf_dir):
    """Half of the height field's faces."""
    v, f = height_field(spark, sf_dir)
    _, faces, _ = decimate.pipeline(v, f, options=decimate.Options(max_error=0.2))
    return faces


# -- codecs ------------------------------------------------------------------------------------------------------------

STEP = "(vmax - vmin) / CAST({top} AS DOUBLE)"


def quantised_sql(top: int) -> str:
    step = STEP.format(top=f"{top}.0")
    return f"max(abs(vmin + CASE WHEN {step} > 0 THEN floor((v - vmin) / ({step}) + 0.5) ELSE 0 END * ({step}) - v))"


METRICS = f"""lw AS (SELECT level, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, v FROM lf),
span AS (SELECT level, cx, cy, cz, count(*) AS n, min(v) AS vmin, max(v) AS vmax FROM lw GROUP BY level, cx, cy, cz),
metrics AS (SELECT level, cx, cy, cz, n, vmin, vmax, max(abs(vmin + (vmax - vmin) * 0.5 - v)) AS err_uniform, {quantised_sql(255)} AS err_u8, {quantised_sql(65535)} AS err_u16,
  max(abs(CAST(CAST(v AS FLOAT) AS DOUBLE) - v)) AS err_f32 FROM lw JOIN span USING (level, cx, cy, cz) GROUP BY level, cx, cy, cz, n, vmin, vmax)"""
CHOICE = """choice AS (SELECT level, cx, cy, cz, CASE WHEN err_uniform <= 2.0 THEN 'uniform:f64' WHEN err_u8 <= 2.0 THEN 'quantized:u8' WHEN err_u16 <= 2.0 THEN 'quantized:u16'
  WHEN err_f32 <= 2.0 THEN 'dense:f32' ELSE 'dense:f64' END AS codec,
  CAST(CASE WHEN err_uniform <= 2.0 THEN 8 WHEN err_u8 <= 2.0 THEN 32784 WHEN err_u16 <= 2.0 THEN 65552 WHEN err_f32 <= 2.0 THEN 131072 ELSE 262144 END AS BIGINT) AS bytes FROM metrics)"""


@query("SELECT level, cx, cy, cz, n, vmin, vmax, err_uniform FROM metrics", METRICS)
def codec_uniform_metrics(spark, sf_dir):
    return codec.metrics(L.l_fine(spark, sf_dir), 2.0).select("level", "cx", "cy", "cz", "n", "vmin", "vmax", "err_uniform")


@query("SELECT level, cx, cy, cz, err_u8, err_u16, err_f32 FROM metrics", METRICS)
def codec_quantised_metrics(spark, sf_dir):
    return codec.metrics(L.l_fine(spark, sf_dir), 2.0).select("level", "cx", "cy", "cz", "err_u8", "err_u16", "err_f32")


@query("SELECT * FROM choice", METRICS, CHOICE)
def codec_choice(spark, sf_dir):
    return codec.choice(codec.metrics(L.l_fine(spark, sf_dir), 2.0), 2.0)


@query("SELECT codec, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes FROM choice GROUP BY codec", METRICS, CHOICE)
def codec_stats(spark, sf_dir):
    chosen = codec.choice(codec.metrics(L.l_fine(spark, sf_dir), 2.0), 2.0)
    return chosen.groupBy("codec").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


AFFINE = {"sx": "lx", "sy": "ly", "sz": "lz", "sxx": "lx * lx", "sxy": "lx * ly", "sxz": "lx * lz", "syy": "ly * ly", "syz": "ly * lz", "szz": "lz * lz", "sv": "w", "svx": "w * lx", "svy": "w * ly", "svz": "w * lz"}


@query(f"SELECT level, cx, cy, cz, count(*) AS n, {', '.join(f'CAST(sum({e}) AS BIGINT) AS {n}' for n, e in AFFINE.items())} FROM (SELECT level, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, CAST(x & 31 AS BIGINT) AS lx, CAST(y & 31 AS BIGINT) AS ly, CAST(z & 31 AS BIGINT) AS lz, CAST(q AS BIGINT) AS w FROM lf) GROUP BY level, cx, cy, cz")
def codec_affine_sums(spark, sf_dir):
    return codec.affine_sums(L.l_fine(spark, sf_dir).withColumn("w", F.col("q").cast("long")), "w")


@query()
def archive_roundtrip(spark, sf_dir):
    """Encoded within a tolerance and decoded again."""
    cells = L.l_fine(spark, sf_dir).withColumn("component", F.lit(0))
    return codec.decode(codec.encode(cells, {0: codec.Policy("smallest", 2.0, scalar="f64")}))


@query("SELECT component, x, y, z, CASE WHEN component = 0 THEN CAST(CAST(v AS FLOAT) AS DOUBLE) ELSE q END AS v FROM lf, (VALUES (0), (1)) AS k(component)")
def archive_read(spark, sf_dir):
    """Written without loss, one component as floats and one without a policy, and read again."""
    path = shared_path(spark, "archive")
    archive.write(l_long(spark, sf_dir), {0: codec.Policy(scalar="f32")}, path)
    return archive.read(spark, path, [1, 0]).select("component", *XYZ, "v")


@query(f"SELECT component, x, y, z, CASE WHEN component = 0 THEN {CODE} / CAST(4294967295.0 AS DOUBLE) ELSE q END AS v FROM lf, (VALUES (0), (1)) AS k(component)")
def archive_transcoded(spark, sf_dir):
    """A normalised component and one of doubles, encoded twice."""
    a, b = shared_path(spark, "archive"), shared_path(spark, "archive")
    archive.write(l_long(spark, sf_dir), {0: codec.Policy(scalar="unorm32", unorm=(1000.0, 90000.0))}, a)
    archive.transcode(spark, a, {}, b)
    return archive.read(spark, b).select("component", *XYZ, "v")


@query("SELECT 0 AS component, 'f32' AS scalar UNION ALL SELECT 1, 'f64'")
def archive_components(spark, sf_dir):
    path = shared_path(spark, "archive")
    archive.write(l_long(spark, sf_dir), {0: codec.Policy(scalar="f32")}, path)
    return archive.components(spark, path).select("component", "scalar")


@query("SELECT level, component, x >> 5 AS cx, y >> 5 AS cy, z >> 5 AS cz, count(*) AS n, min(CASE WHEN component = 0 THEN v ELSE q END) AS low FROM lf, (VALUES (0), (1)) AS k(component) GROUP BY level, component, x >> 5, y >> 5, z >> 5")
def chunks_mapped(spark, sf_dir):
    """A function of each chunk's cells."""
    out = None
    for component in (0, 1):
        part = C.map_chunks(l_long(spark, sf_dir).where(F.col("component") == component), summary, "level int, cx int, cy int, cz int, n long, low double").withColumn("component", F.lit(component))
        out = part if out is None else out.unionByName(part)
    return out


def summary(cells):
    return cells.groupby(["level", "cx", "cy", "cz"], as_index=False).agg(n=("v", "size"), low=("v", "min"))


@query("SELECT CAST(coalesce(b.x, f.x) AS INT) AS x, CAST(coalesce(b.y, f.y) AS INT) AS y, CAST(coalesce(b.z, f.z) AS INT) AS z, CAST(coalesce(b.v, f.v) AS DOUBLE) AS v FROM ef f FULL JOIN (SELECT * FROM ea WHERE label = 0) b ON b.x = f.x AND b.y = f.y AND b.z = f.z")
def blocks_written(spark, sf_dir):
    """The blocks of label 0 written into the grid of the others."""
    e = L.read(spark, sf_dir, "embeddings").where("label = 0")
    at = [(F.expr(x) * 4).cast("int").alias(a) for x, a in (("vec_id % 8", "lx"), ("(vec_id div 8) % 8", "ly"), ("vec_id div 64", "lz"))]
    blocks = e.select(*at, *(F.lit(4).alias(f"n{a}") for a in "xyz"), F.col("embedding").alias("values"))
    return doubles(C.write_blocks(L.e_fine(spark, sf_dir), blocks, (0, 0, 0), (32, 32, 1 << 30)), "v")


@query()
def archive_codec_stats(spark, sf_dir):
    cells = L.e_cells(spark, sf_dir).withColumn("component", F.lit(0))
    return codec.codec_stats(codec.encode(cells, {0: codec.Policy("smallest", 0.001)}))


def entry(spark: SparkSession) -> DataFrame:
    return cube_case_histogram(spark, "/root/testdata/sf0.001")
