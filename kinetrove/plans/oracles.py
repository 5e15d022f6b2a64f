"""The same results in plain SQL over the same tables, written from the definitions.

They compare every pair and every lag outright, which is fine at test size and is what the Spark
queries avoid.
"""

from __future__ import annotations

from kinetrove.functions import constants as K
from kinetrove.functions.units import unit_rows
from kinetrove.plans.queries import BLOCK, CONNECT, OBSERVED, SHELL_CUTOFF, STRUCTURE_DIGITS

ORACLES: dict[str, str] = {}

_ELEMENT = "['C','H','O','N'][a%4+1]"
TRAJ = f"""traj AS (SELECT 'r0' AS run_id, vec_id AS frame_id, (a+1)::INT AS atom_id, {_ELEMENT} AS element,
  10.0::DOUBLE*embedding[3*a+1]::DOUBLE AS x, 10.0::DOUBLE*embedding[3*a+2]::DOUBLE AS y,
  10.0::DOUBLE*embedding[3*a+3]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(21)) AS a))"""
VEL = f"""vel AS (SELECT 'r0' AS run_id, vec_id AS frame_id, (a+1)::INT AS atom_id, {_ELEMENT} AS element,
  embedding[6*a+1]::DOUBLE AS x, embedding[6*a+2]::DOUBLE AS y, embedding[6*a+3]::DOUBLE AS z,
  embedding[6*a+4]::DOUBLE AS vx, embedding[6*a+5]::DOUBLE AS vy, embedding[6*a+6]::DOUBLE AS vz
  FROM embeddings, (SELECT unnest(range(10)) AS a))"""
RUNS = """runs AS (SELECT label::VARCHAR AS run_id, vec_id, embedding,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id FROM embeddings)"""

_TPS = 5.0 * 1 * K.ATOMIC_TIME_FS / 1000.0


def _d(v: float) -> str:
    return f"{v!r}::DOUBLE"


def _p(i: int) -> tuple[str, str, str]:
    """Coordinates of label i straight from the vector."""
    return tuple(f"(10.0::DOUBLE*embedding[{3 * (i - 1) + n}]::DOUBLE)" for n in (1, 2, 3))


def _cols(alias: str) -> tuple[str, str, str]:
    return tuple(f"{alias}.{c}" for c in "xyz")


def _sub(a, b):
    return tuple(f"({p}-{q})" for p, q in zip(a, b))


def _dot(u, v):
    return "(" + "+".join(f"{p}*{q}" for p, q in zip(u, v)) + ")"


def _cross(u, v):
    return (
        f"({u[1]}*{v[2]}-{u[2]}*{v[1]})",
        f"({u[2]}*{v[0]}-{u[0]}*{v[2]})",
        f"({u[0]}*{v[1]}-{u[1]}*{v[0]})",
    )


def _dist(a, b):
    d = _sub(b, a)
    return f"sqrt({_dot(d, d)})"


def _angle(a, b, c):
    u, v = _sub(a, b), _sub(c, b)
    n = f"(sqrt({_dot(u, u)})*sqrt({_dot(v, v)}))"
    return f"CASE WHEN {n}<>0 THEN degrees(acos(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,{_dot(u, v)}/{n})))) END"


def _dihedral_of(u, v, w):
    """Torsion from the three bond vectors given as column triples."""
    n1, n2 = _cross(u, v), _cross(v, w)
    ok = f"({_dot(n1, n1)}<>0 AND {_dot(n2, n2)}<>0 AND {_dot(v, v)}<>0)"
    return f"CASE WHEN {ok} THEN degrees(atan2({_dot(_cross(n1, v), n2)}, {_dot(n1, n2)}*sqrt({_dot(v, v)}))) END"


def _vectors(pairs: dict[str, tuple]) -> str:
    return ", ".join(f"{t} AS {name}{c}" for name, triple in pairs.items() for c, t in zip("xyz", triple))


def _names(name: str):
    return tuple(f"{name}{c}" for c in "xyz")


# ---- series --------------------------------------------------------------------------------------
_T0 = f"vec_id*{_d(_TPS)}"
_BOND = f"s AS (SELECT 'r0' AS run_id, vec_id AS frame_id, {_T0} AS time_ps, {_dist(_p(1), _p(2))} AS value FROM embeddings)"
_ANGLE = (
    f"s AS (SELECT * FROM (SELECT 'r0' AS run_id, vec_id AS frame_id, {_T0} AS time_ps, "
    f"{_angle(_p(1), _p(2), _p(3))} AS value FROM embeddings) WHERE value IS NOT NULL)"
)
_TORSION = (
    f"b AS (SELECT vec_id, {_vectors({'u': _sub(_p(2), _p(1)), 'v': _sub(_p(3), _p(2)), 'w': _sub(_p(4), _p(3))})} FROM embeddings), "
    f"raw AS (SELECT 'r0' AS run_id, vec_id AS frame_id, {_T0} AS time_ps, "
    f"{_dihedral_of(_names('u'), _names('v'), _names('w'))} AS angle FROM b)"
)
_DIHEDRAL = f"{_TORSION}, s AS (SELECT run_id, frame_id, time_ps, CASE WHEN angle<0 THEN angle+360 ELSE angle END AS value FROM raw WHERE angle IS NOT NULL)"
_HBOND = (
    f"s AS (SELECT 'r0' AS run_id, vec_id AS frame_id, (vec_id+1)*{_d(_TPS)} AS time_ps, {_dist(_p(1), _p(2))} AS d_dh, "
    f"{_dist(_p(2), _p(3))} AS d_ha, {_angle(_p(1), _p(2), _p(3))} AS angle FROM embeddings)"
)
_SERIES = "SELECT run_id, frame_id, round(time_ps,6) AS time_ps, round(value,6) AS value FROM s"
_STATS = """SELECT run_id, count(value) AS n, round(avg(value),6) AS mean, round(min(value),6) AS smallest,
  round(max(value),6) AS largest, round(coalesce(var_samp(value),0),6) AS variance,
  round(coalesce(stddev_samp(value),0),6) AS std_dev FROM s GROUP BY run_id"""

ORACLES["bond_series"] = f"WITH {_BOND} {_SERIES}"
ORACLES["bond_stats"] = f"WITH {_BOND} {_STATS}"
_mi = ["{d}-4.0::DOUBLE*round_even({d}/4.0::DOUBLE,0)".replace("{d}", d) for d in _sub(_p(2), _p(1))]
ORACLES["min_image_distance"] = f"""WITH m AS (SELECT vec_id, {_vectors({'d': _mi})} FROM embeddings)
SELECT 'r0' AS run_id, vec_id AS frame_id, round({_T0},6) AS time_ps, round(sqrt(dx*dx+dy*dy+dz*dz),6) AS value FROM m"""
ORACLES["angle_series"] = f"WITH {_ANGLE} {_SERIES}"
ORACLES["angle_clamped_stats"] = f"WITH {_ANGLE.replace('s AS (', 's0 AS (', 1)}, s AS (SELECT run_id, greatest(0.0,least(90.0::DOUBLE,value)) AS value FROM s0) {_STATS}"
ORACLES["dihedral_series"] = f"WITH {_DIHEDRAL} {_SERIES}"
ORACLES["dihedral_iupac"] = f"""WITH {_TORSION} SELECT run_id, frame_id, round(time_ps,6) AS time_ps,
  round(CASE WHEN angle=180 THEN angle ELSE -angle END,6) AS value FROM raw WHERE angle IS NOT NULL"""
ORACLES["hbond_series"] = f"""WITH {_HBOND} SELECT run_id, frame_id, round(time_ps,6) AS time_ps, round(d_dh,6) AS d_dh,
  round(d_ha,6) AS d_ha, round(angle,6) AS angle FROM s"""


# ---- distributions -------------------------------------------------------------------------------
def _hist(source: str, nbins: int, width: float, clamp: bool) -> str:
    idx = f"trunc(value/{_d(width)})::INT"
    if clamp:
        idx = f"CASE WHEN {idx}={nbins} THEN {nbins - 1} ELSE {idx} END"
    return f"""{source}, k AS (SELECT run_id, {idx} AS bin FROM s),
n AS (SELECT run_id, bin, count(*) AS c FROM k WHERE bin>=0 AND bin<{nbins} GROUP BY ALL),
tot AS (SELECT run_id, sum(c)::DOUBLE AS total FROM n GROUP BY run_id),
h AS (SELECT tot.run_id, g.bin::INT AS bin, {_d(width)}*(g.bin+0.5::DOUBLE) AS center, coalesce(n.c,0)::BIGINT AS count,
  coalesce(n.c,0)/total*100.0::DOUBLE AS pct FROM tot CROSS JOIN (SELECT unnest(range({nbins})) AS bin) g
  LEFT JOIN n ON n.run_id=tot.run_id AND n.bin=g.bin)"""


_HIST_OUT = "SELECT run_id, bin, round(center,6) AS center, count, round(pct,6) AS pct FROM h"
_RT = _d(K.GAS_CONSTANT_KCAL * 300.0)
_BOND_HIST = _hist(_BOND, 24, 0.25, False)
_ANGLE_HIST = _hist(_ANGLE, 36, 5.0, True)
_DIHEDRAL_HIST = _hist(_DIHEDRAL, 36, 10.0, True)
ORACLES["bond_hist"] = f"WITH {_BOND_HIST} {_HIST_OUT}"
ORACLES["angle_hist"] = f"WITH {_ANGLE_HIST} {_HIST_OUT}"
ORACLES["dihedral_hist"] = f"WITH {_DIHEDRAL_HIST} {_HIST_OUT}"
_FE = f"fe AS (SELECT run_id, bin, center, -{_RT}*ln(pct/100.0::DOUBLE) AS free_energy FROM h WHERE pct>0)"
_FE_OUT = "SELECT run_id, bin, round(center,6) AS center, round(free_energy,6) AS free_energy FROM fe"
ORACLES["bond_free_energy"] = f"WITH {_BOND_HIST}, {_FE} {_FE_OUT}"
ORACLES["bond_fe_min"] = f"WITH {_BOND_HIST}, {_FE} {_FE_OUT} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY fe.free_energy, bin)=1"


def _smoothed(hist: str, p: str) -> str:
    return f"""WITH {hist}, p AS (SELECT run_id, bin, center, greatest({p},1e-12::DOUBLE) AS p,
  row_number() OVER (PARTITION BY run_id ORDER BY bin) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM h WHERE pct>0),
w0 AS (SELECT *, greatest(5,least(11,n//12)) AS w FROM p),
w1 AS (SELECT * REPLACE (CASE WHEN n<5 THEN 1 ELSE least(CASE WHEN w%2=0 THEN w+1 ELSE w END, CASE WHEN n%2=1 THEN n ELSE n-1 END) END AS w) FROM w0),
o AS (SELECT w1.run_id, w1.bin, w1.center, w1.w, w1.n, w1.rn, unnest(range(-(w//2), w//2+1)) AS off FROM w1),
fe AS (SELECT o.run_id, o.bin, o.center, -{_RT}*ln(greatest(sum(q.p)/o.w,1e-12::DOUBLE)) AS free_energy
  FROM o JOIN w1 q ON q.run_id=o.run_id AND q.rn=greatest(1,least(o.n,o.rn+o.off)) GROUP BY o.run_id,o.bin,o.center,o.w)
{_FE_OUT}"""


ORACLES["angle_fe_jacobian"] = _smoothed(_ANGLE_HIST, "(pct/100.0::DOUBLE)/greatest(sin(radians(center)),1e-12::DOUBLE)")
ORACLES["dihedral_fe"] = _smoothed(_DIHEDRAL_HIST, "pct/100.0::DOUBLE")
_HBOND_DENSITY = f"""{_HBOND}, axis AS (SELECT * FROM (VALUES ('d_dh',0.25::DOUBLE,23),('d_ha',0.25::DOUBLE,23),('angle',5.0::DOUBLE,35)) t(coord,w,n)),
v AS (SELECT run_id,'d_dh' AS coord,d_dh AS value FROM s UNION ALL SELECT run_id,'d_ha',d_ha FROM s UNION ALL SELECT run_id,'angle',angle FROM s),
edges AS (SELECT coord, w, n, unnest(range(n)) AS bin FROM axis),
cnt AS (SELECT v.run_id, e.coord, e.bin, count(*) AS c FROM v JOIN edges e ON e.coord=v.coord AND value>=e.bin*w
  AND (value<(e.bin+1)*w OR (e.bin=n-1 AND value=n*w)) GROUP BY ALL),
tot AS (SELECT run_id, coord, sum(c)::DOUBLE AS total FROM cnt GROUP BY ALL),
h AS (SELECT tot.run_id, e.coord, e.bin::INT AS bin, (e.bin*w+(e.bin+1)*w)/2.0::DOUBLE AS center, coalesce(c,0)::BIGINT AS count,
  coalesce(c,0)/(w*total) AS density FROM tot JOIN edges e USING (coord) LEFT JOIN cnt ON cnt.run_id=tot.run_id AND cnt.coord=e.coord AND cnt.bin=e.bin)"""
ORACLES["hbond_density"] = f"WITH {_HBOND_DENSITY} SELECT run_id, coord, bin, round(center,6) AS center, count, round(density,6) AS density FROM h"
ORACLES["hbond_fe"] = f"WITH {_HBOND_DENSITY} SELECT run_id, coord, bin, round(center,6) AS center, round(-{_RT}*ln(density),6) AS free_energy FROM h WHERE density<>0"

# ---- topology ------------------------------------------------------------------------------------
_BONDS = f"""{TRAJ}, f0 AS (SELECT * FROM traj WHERE frame_id=0),
bonds AS (SELECT a.run_id, a.atom_id AS i, b.atom_id AS j FROM f0 a JOIN f0 b ON a.run_id=b.run_id AND a.atom_id<b.atom_id
  WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= {CONNECT * CONNECT}::DOUBLE),
ends AS (SELECT run_id, i AS at, j AS nb FROM bonds UNION ALL SELECT run_id, j, i FROM bonds)"""
_ANGLES = f"{_BONDS}, angles AS (SELECT p.run_id, p.nb AS i, p.at AS j, q.nb AS k FROM ends p JOIN ends q ON p.run_id=q.run_id AND p.at=q.at AND p.nb<q.nb)"
_QUADS = f"""{_BONDS}, quads AS (SELECT m.run_id, p.nb AS i, m.i AS j, m.j AS k, q.nb AS l FROM bonds m
  JOIN ends p ON p.run_id=m.run_id AND p.at=m.i AND p.nb<>m.j JOIN ends q ON q.run_id=m.run_id AND q.at=m.j AND q.nb<>m.i AND q.nb<>p.nb)"""


def _joined(table: str, labels: str, condition: str = "") -> str:
    joins = " ".join(f"JOIN traj p{c} ON p{c}.run_id=t.run_id AND p{c}.atom_id=t.{c}" for c in labels[:1])
    joins += "".join(
        f" JOIN traj p{c} ON p{c}.run_id=t.run_id AND p{c}.atom_id=t.{c} AND p{c}.frame_id=p{labels[0]}.frame_id" for c in labels[1:]
    )
    return f"FROM {table} t {joins} {condition}"


def _all_stats(ctes: str, labels: str, digits: int) -> str:
    keys = ", ".join(labels)
    return f"""WITH {ctes} SELECT run_id, {keys}, count(value) AS n, count(*)-count(value) AS degenerate, round(avg(value),{digits}) AS mean,
  round(var_pop(value),{digits}) AS variance, round(stddev_pop(value),{digits}) AS std_dev FROM v GROUP BY run_id, {keys}"""


ORACLES["all_bonds"] = _all_stats(f"{_BONDS}, v AS (SELECT t.*, {_dist(_cols('pi'), _cols('pj'))} AS value {_joined('bonds', 'ij')})", "ij", 6)
ORACLES["all_angles"] = _all_stats(f"{_ANGLES}, v AS (SELECT t.*, {_angle(_cols('pi'), _cols('pj'), _cols('pk'))} AS value {_joined('angles', 'ijk')})", "ijk", 6)
_steps = {"u": _sub(_cols("pj"), _cols("pi")), "v": _sub(_cols("pk"), _cols("pj")), "w": _sub(_cols("pl"), _cols("pk"))}
ORACLES["all_dihedrals"] = _all_stats(
    f"{_QUADS}, b AS (SELECT t.*, pi.frame_id, {_vectors(_steps)} {_joined('quads', 'ijkl')}), "
    f"v0 AS (SELECT *, {_dihedral_of(_names('u'), _names('v'), _names('w'))} AS value FROM b), "
    "v AS (SELECT * FROM v0 WHERE (run_id,i,j,k,l) IN (SELECT (run_id,i,j,k,l) FROM v0 WHERE frame_id=0 AND value IS NOT NULL))",
    "ijkl", 5,
)


def _map(table: dict[str, float]) -> str:
    return "MAP {" + ",".join(f"'{k}':{v!r}::DOUBLE" for k, v in table.items() if k in ("C", "H", "O", "N")) + "}"


_RCOV, _RVDW, _MASS, _MASS_RES = (_map(t) for t in (K.COVALENT_RADII, K.VDW_RADII, K.MASSES["general"], K.MASSES["residence"]))
ORACLES["dynamic_bonds"] = f"""WITH {TRAJ}, p AS (SELECT a.run_id, a.frame_id, a.atom_id AS i, b.atom_id AS j,
  (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2,
  least({CONNECT}::DOUBLE, {_RCOV}[a.element]+{_RCOV}[b.element]+0.45::DOUBLE) AS reach
  FROM traj a JOIN traj b ON a.frame_id=b.frame_id AND a.atom_id<b.atom_id)
SELECT run_id, frame_id, i, j, round(sqrt(d2),6) AS distance FROM p WHERE d2<=reach*reach"""

# ---- frames --------------------------------------------------------------------------------------
ORACLES["frame_stats"] = f"WITH {RUNS} SELECT run_id, count(*) AS n_frames, (count(*)*21)::BIGINT AS n_atom_rows, 21::BIGINT AS min_atoms, 21::BIGINT AS max_atoms FROM runs GROUP BY run_id"
ORACLES["composition"] = f"WITH {TRAJ} SELECT run_id, element, count(*) AS n_atoms FROM traj WHERE frame_id=0 GROUP BY ALL"
_ATOMS6 = "run_id, frame_id, atom_id, element, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z"
ORACLES["select_frames"] = f"WITH {TRAJ} SELECT {_ATOMS6} FROM traj WHERE frame_id BETWEEN 10 AND (SELECT count(*)*9//10 FROM embeddings) AND (frame_id-10)%5=0"
ORACLES["select_frames_b"] = f"WITH {VEL} SELECT {_ATOMS6}, round(vx,6) AS vx, round(vy,6) AS vy, round(vz,6) AS vz FROM vel WHERE frame_id+1>=5 AND frame_id+1<(SELECT count(*)*9//10+7 FROM embeddings) AND (frame_id-4)%7=0"
_KEPT = f"{_BOND}, kept AS (SELECT run_id, frame_id, value AS distance FROM s WHERE value BETWEEN 2.0::DOUBLE AND 4.0::DOUBLE)"
ORACLES["range_frames"] = f"WITH {_KEPT} SELECT run_id, frame_id, round(distance,6) AS distance FROM kept"
ORACLES["range_summary"] = f"""WITH {_KEPT} SELECT 'r0' AS run_id, (SELECT count(*) FROM s) AS total_frames, count(*) AS selected_frames,
  round(avg(distance),6) AS mean_distance, round(stddev_pop(distance),6) AS std_distance FROM kept"""
ORACLES["closest_frame"] = f"""WITH {_KEPT}, m AS (SELECT *, avg(distance) OVER () AS mean FROM kept)
SELECT run_id, frame_id, round(distance,6) AS distance, round(mean,6) AS mean_distance FROM m ORDER BY abs(distance-mean), frame_id LIMIT 1"""

# ---- pair correlation ----------------------------------------------------------------------------
_W = 6.0 / 60
_RDF = f"""{TRAJ}, img AS (SELECT x.s AS sx, y.s AS sy, z.s AS sz FROM (SELECT unnest([0.0,12.0,-12.0])::DOUBLE AS s) x,
  (SELECT unnest([0.0,12.0,-12.0])::DOUBLE AS s) y, (SELECT unnest([0.0,12.0,-12.0])::DOUBLE AS s) z),
t AS (SELECT p.run_id, p.x-c.x+sx AS dx, p.y-c.y+sy AS dy, p.z-c.z+sz AS dz FROM traj p JOIN traj c ON c.frame_id=p.frame_id AND c.atom_id=1, img
  WHERE p.element='O' AND p.atom_id NOT IN (1,3)),
d AS (SELECT run_id, sqrt(dx*dx+dy*dy+dz*dz) AS d FROM t),
e AS (SELECT unnest(range(60)) AS bin), edges AS (SELECT bin, bin*{_d(_W)} AS lo, (bin+1)*{_d(_W)} AS hi FROM e),
h AS (SELECT edges.bin, lo, hi, count(d.d) AS c FROM edges LEFT JOIN d ON d.d>=lo AND (d.d<hi OR (bin=59 AND d.d=hi)) AND d.d<=6.0::DOUBLE GROUP BY ALL),
m AS (SELECT *, c/(SELECT count(*) FROM embeddings)::DOUBLE AS m, {_d(4.0 / 3.0 * 3.141592653589793)}*(hi*hi*hi-lo*lo*lo) AS vol,
  (SELECT count(*) FROM traj WHERE frame_id=0 AND element='O')/1728.0::DOUBLE AS rho FROM h)"""
ORACLES["radial_distribution"] = f"WITH {_RDF} SELECT 'r0' AS run_id, bin::INT AS bin, round(lo,6) AS r, round(m/vol/rho,6) AS g FROM m"
ORACLES["coordination"] = f"WITH {_RDF} SELECT 'r0' AS run_id, bin::INT AS bin, round(lo,6) AS r, round(sum(m) OVER (ORDER BY bin),6) AS coordination FROM m"

# ---- residence -----------------------------------------------------------------------------------
_IDS = ",".join(str(g[0]) for g in OBSERVED)
_OCC = f"""{TRAJ}, occ AS (SELECT p.run_id, p.atom_id AS object_id, p.frame_id, ({_dist(_cols('c'), _cols('p'))}<={SHELL_CUTOFF}::DOUBLE)::INT AS h
  FROM traj p JOIN traj c ON c.frame_id=p.frame_id AND c.atom_id=1 WHERE p.atom_id IN ({_IDS}))"""
_SHELL = f"""{TRAJ}, occ AS (SELECT p.run_id, p.atom_id AS object_id, p.frame_id, ({_dist(_cols('c'), _cols('p'))} BETWEEN 0.0 AND 2.5::DOUBLE)::INT AS h
  FROM traj p JOIN traj c ON c.frame_id=p.frame_id AND c.atom_id=1 WHERE p.element='O' AND p.atom_id<>1)"""


def _filled(occ: str, tolerance: int) -> str:
    return f"""{occ}, nb AS (SELECT *, max(CASE WHEN h=1 THEN frame_id END) OVER (PARTITION BY object_id ORDER BY frame_id) AS pv,
  min(CASE WHEN h=1 THEN frame_id END) OVER (PARTITION BY object_id ORDER BY frame_id DESC) AS nx FROM occ),
filled AS (SELECT run_id, object_id, frame_id, CASE WHEN h=0 AND nx-pv-1<={tolerance} THEN 1 ELSE h END AS h FROM nb)"""


def _events(source: str) -> str:
    return f"""isl AS (SELECT *, frame_id-row_number() OVER (PARTITION BY object_id ORDER BY frame_id) AS g FROM {source} WHERE h=1),
ev AS (SELECT run_id, object_id, min(frame_id) AS start_frame, count(*) AS n_frames FROM isl GROUP BY run_id, object_id, g)"""


def _curve(source: str, dt: float) -> str:
    return f"""fr AS (SELECT max(frame_id)+1 AS nf, avg(h) AS hm FROM {source}),
lags AS (SELECT unnest(range(nf)) AS lag, nf, hm FROM fr),
num AS (SELECT b.frame_id-a.frame_id AS lag, count(*) AS num FROM {source} a JOIN {source} b
  ON a.object_id=b.object_id AND b.frame_id>=a.frame_id AND a.h=1 AND b.h=1 GROUP BY 1),
tf AS (SELECT frame_id, sum(sum(h)) OVER (ORDER BY frame_id) AS den FROM {source} GROUP BY frame_id),
c0 AS (SELECT lags.lag, hm, CASE WHEN den>0 THEN coalesce(num,0)/den::DOUBLE ELSE 0 END AS c FROM lags
  JOIN tf ON tf.frame_id=nf-1-lags.lag LEFT JOIN num USING (lag)),
cur AS (SELECT 'r0' AS run_id, lag, lag*{_d(dt)} AS t, greatest(0,least(1,c)) AS c,
  greatest(-1,least(1,CASE WHEN abs(1-hm)<=1.001e-5 THEN 1 ELSE (c-hm)/(1-hm) END)) AS r FROM c0)"""


ORACLES["occupancy"] = f"WITH {_OCC} SELECT run_id, object_id, frame_id, h FROM occ"
_GRP = "SELECT g AS object_id, unnest([3*g+1,3*g+2,3*g+3]) AS atom_id FROM (SELECT unnest(range(7)) AS g)"
ORACLES["occupancy_groups"] = f"""WITH {TRAJ}, grp AS ({_GRP}),
com AS (SELECT run_id, frame_id, object_id, sum(m*x)/sum(m) AS x, sum(m*y)/sum(m) AS y, sum(m*z)/sum(m) AS z
  FROM (SELECT traj.*, object_id, {_MASS_RES}[element] AS m FROM traj JOIN grp USING (atom_id)) GROUP BY ALL),
occ AS (SELECT p.run_id, p.object_id::INT AS object_id, ({_dist(_cols('c'), _cols('p'))}<={SHELL_CUTOFF}::DOUBLE)::INT AS h
  FROM com p JOIN com c ON c.frame_id=p.frame_id AND c.object_id=0 WHERE p.object_id>0)
SELECT run_id, object_id, sum(h)::BIGINT AS n_inside, round(avg(h),6) AS h_mean FROM occ GROUP BY ALL"""
ORACLES["gap_fill"] = f"WITH {_filled(_OCC, 2)} SELECT run_id, object_id, frame_id, h FROM filled"
ORACLES["residence_events"] = f"WITH {_OCC}, {_events('occ')} SELECT run_id, object_id, start_frame, n_frames FROM ev"
ORACLES["survival"] = f"""WITH {_OCC}, {_events('occ')}, l AS (SELECT unnest(range((SELECT max(n_frames)+1 FROM ev))) AS lag)
SELECT 'r0' AS run_id, lag, lag::DOUBLE AS t, round((SELECT count(*) FROM ev WHERE n_frames>=lag)/(SELECT count(*) FROM ev)::DOUBLE,6) AS value FROM l"""
_CURVE_OUT = "SELECT run_id, lag, round(t,6) AS t, round(c,6) AS c, round(r,6) AS r FROM cur"
ORACLES["intermittent"] = f"WITH {_OCC}, {_curve('occ', 1.0)} {_CURVE_OUT}"
ORACLES["intermittent_bounded"] = f"WITH {_OCC}, {_curve('occ', 1.0)} {_CURVE_OUT} WHERE lag<=40"
ORACLES["mrt_summary"] = f"""WITH {_filled(_OCC, 2)}, {_events('filled')}, {_curve('filled', 0.5)}
SELECT 'r0' AS run_id, (SELECT nf FROM fr) AS n_frames, (SELECT count(DISTINCT object_id) FROM occ) AS n_objects,
  round((SELECT hm FROM fr),6) AS occupancy_mean, (SELECT count(*) FROM ev) AS n_events, round((SELECT avg(n_frames) FROM ev)*0.5,6) AS direct_mrt,
  round((SELECT avg(n_frames)+1 FROM ev)*0.5,6) AS continuous_mrt, round((SELECT sum(r) FROM cur)*0.5,6) AS intermittent_mrt"""
ORACLES["shell_totals"] = f"""WITH {_filled(_SHELL, 1)} SELECT run_id, frame_id, round((frame_id+1)*{_d(_TPS)},6) AS time_ps,
  sum(h)::BIGINT AS coordination FROM filled GROUP BY run_id, frame_id"""
ORACLES["shell_residence"] = f"""WITH {_filled(_SHELL, 1)}, lg AS (SELECT *, lag(h) OVER (PARTITION BY object_id ORDER BY frame_id) AS ph FROM filled),
per AS (SELECT run_id, object_id, sum(h)::BIGINT AS rt_frames, count(CASE WHEN ph=0 AND h=1 THEN 1 END) AS exchanges,
  min(CASE WHEN h=1 THEN frame_id END) AS ff FROM lg GROUP BY ALL HAVING sum(h)>0)
SELECT run_id, object_id, rt_frames, exchanges, round(rt_frames*{_d(_TPS)},6) AS total_rt,
  round(CASE WHEN exchanges>0 THEN rt_frames*{_d(_TPS)}/exchanges ELSE rt_frames*{_d(_TPS)} END,6) AS mrt,
  row_number() OVER (ORDER BY ff, object_id)::INT AS first_order FROM per"""

# ---- autocorrelation -----------------------------------------------------------------------------
_ACF = f"""{VEL}, tot AS (SELECT count(*) AS nf FROM embeddings),
u AS (SELECT vel.*, frame_id//{BLOCK} AS block, frame_id%{BLOCK} AS lag FROM vel, tot WHERE (frame_id//{BLOCK})*{BLOCK}+1<=nf-{BLOCK}),
c AS (SELECT n.lag, avg(n.x*r.x+n.y*r.y+n.z*r.z) AS paf, avg(n.vx*r.vx+n.vy*r.vy+n.vz*r.vz) AS vaf
  FROM u n JOIN u r ON r.block=n.block AND r.atom_id=n.atom_id AND r.lag=0 WHERE n.lag>0 GROUP BY n.lag),
acf AS (SELECT 'r0' AS run_id, lag, paf/max(abs(paf)) OVER () AS paf, vaf/max(abs(vaf)) OVER () AS vaf FROM c)"""
ORACLES["paf"] = f"WITH {_ACF} SELECT run_id, lag, round(paf,6) AS paf FROM acf"
ORACLES["vaf"] = f"WITH {_ACF} SELECT run_id, lag, round(vaf,6) AS vaf FROM acf"
_N = BLOCK - 1
_SPACING = 5.0 * K.ATOMIC_TIME_FS * 1 * 1e-15
_PHASE = f"{_d(2 * 3.141592653589793)}*((lag-1)*k%{_N})/{_N}"
ORACLES["psd"] = f"""WITH {_ACF} SELECT 'r0' AS run_id, k, round((CASE WHEN k<={(_N - 1) // 2} THEN k ELSE k-{_N} END)/({_N}*{_d(_SPACING)})/1e12::DOUBLE,6) AS frequency,
  round(pow(sum(vaf*cos({_PHASE})),2)+pow(sum(vaf*sin({_PHASE})),2),6) AS power FROM acf, (SELECT unnest(range({_N})) AS k) GROUP BY k"""

# ---- states and logs -----------------------------------------------------------------------------
ORACLES["state_population"] = f"""WITH {RUNS}, v AS (SELECT run_id, vec_id%4 AS state FROM runs), n AS (SELECT count(DISTINCT run_id) AS r FROM v),
c AS (SELECT s.state::INT AS state, 1+(SELECT count(*) FROM v WHERE v.state=s.state) AS n FROM (SELECT unnest([1,2,3]) AS state) s)
SELECT state, round(c.n/r::DOUBLE,6) AS average, round(c.n*100.0::DOUBLE/(SELECT sum(n) FROM c),6) AS percent FROM c, n"""
ORACLES["state_frames"] = f"""WITH {RUNS} SELECT run_id, frame_id, CASE WHEN frame_id*10<9*count(*) OVER (PARTITION BY run_id, a) THEN (vec_id%4)::VARCHAR ELSE 'unknown' END AS state, (a+1)::INT AS atom_id,
  round(10.0::DOUBLE*embedding[3*a+1]::DOUBLE,6) AS x, round(10.0::DOUBLE*embedding[3*a+2]::DOUBLE,6) AS y, round(10.0::DOUBLE*embedding[3*a+3]::DOUBLE,6) AS z
  FROM runs, (SELECT unnest(range(21)) AS a)"""
ORACLES["energy_columns"] = """WITH e AS (SELECT event_id AS step, value, -100.0::DOUBLE-value/100.0::DOUBLE AS ks FROM events),
f AS (SELECT *, ks+value/500.0::DOUBLE AS c4 FROM e)
SELECT step, round(step::DOUBLE*5.0::DOUBLE*0.024188::DOUBLE/1000.0::DOUBLE,9) AS x, round(value/1000.0::DOUBLE,6) AS fictitious, round(value,6) AS temperature,
  round(ks,6) AS kohn_sham, round(c4,6) AS c4, round(c4-ks,6) AS ionic_kinetic, round(c4+value/1000.0::DOUBLE,6) AS total, round(value/10.0::DOUBLE,6) AS cpu_time FROM f"""
_UNIT = {name: factor for name, _, factor in unit_rows("energy")}
ORACLES["unit_convert"] = f"""SELECT l_orderkey, l_linenumber, l_quantity AS quantity,
  CASE l_returnflag WHEN 'A' THEN 'hartree' WHEN 'N' THEN 'KCAL/MOL' ELSE 'eV' END AS from_unit,
  CASE WHEN l_linestatus='O' THEN 'kilocalorie/mol' ELSE 'cal/mol' END AS to_unit,
  round(l_quantity*(CASE l_returnflag WHEN 'A' THEN {_d(_UNIT['hartree'])} WHEN 'N' THEN {_d(_UNIT['kcal/mol'])} ELSE {_d(_UNIT['ev'])} END)
  /(CASE WHEN l_linestatus='O' THEN {_d(_UNIT['kcal/mol'])} ELSE {_d(_UNIT['cal/mol'])} END),4) AS converted, NULL::VARCHAR AS unit_error FROM lineitem"""
# --- fixed values: factors to the base unit of the names that the query uses -------------------------
_FACTORS = {
    "energy": {"hartree": 4.3597447222060e-18, "kcal/mol": 4184.0 / 6.02214076e23, "kilocalorie/mol": 4184.0 / 6.02214076e23, "ev": 1.602176634e-19, "j": 1.0, "cal/mol": 4.184 / 6.02214076e23},
    "length": {"angstrom": 1e-10, "bohr": 5.29177210903e-11, "a0": 5.29177210903e-11, "nm": 1e-9, "mile": 1609.344, "km": 1000.0, "ly": 9.4607304725808e15},
    "time": {"fs": 1e-15, "au": 2.4188843265857e-17, "week": 604800.0, "hr": 3600.0, "month": 2628000.0, "day": 86400.0, "s": 1.0},
    "density": {"amu/angstrom^3": 1e24 / 6.02214076e23, "g/cm3": 1.0, "kg/liter": 1.0, "amu/a3": 1e24 / 6.02214076e23, "g/cm^3": 1.0, "kg/l": 1.0},
    "velocity": {"mph": 1609.344 / 3600.0, "knot": 0.5144444444, "angstrom/fs": 1e5, "m/s": 1.0, "c": 299792458.0, "km/h": 1000.0 / 3600.0},
}
_PAIRS_OF = {
    "energy": (("Hartree", "kcal/mol"), ("kilocalorie/mol", "eV"), ("ev", "J"), ("cal/mol", "rydberg")),
    "length": (("Angstrom", "bohr"), ("a0", "nm"), ("mile", "km"), ("ly", "furlong")),
    "time": (("fs", "au"), ("week", "hr"), ("month", "day"), ("fortnight", "s")),
    "density": (("amu/angstrom^3", "g/cm3"), ("kg/liter", "amu/a3"), ("g/cm^3", "kg/L"), ("g/cm^3", "lb/ft3")),
    "velocity": (("mph", "knot"), ("Angstrom/fs", "m/s"), ("c", "km/h"), ("warp", "m/s")),
}
_factor_rows = ",".join(f"('{c}','{n}',{f!r}::DOUBLE)" for c, names in _FACTORS.items() for n, f in names.items())
_pair_rows = ",".join(f"('{c}',{k},'{a}','{b}')" for c, pairs in _PAIRS_OF.items() for k, (a, b) in enumerate(pairs))
ORACLES["unit_categories"] = f"""WITH fac(category, name, f) AS (VALUES {_factor_rows}), pairs(category, k, from_unit, to_unit) AS (VALUES {_pair_rows}),
c AS (SELECT p.category, l_orderkey, l_linenumber, from_unit, to_unit, l_quantity*a.f/b.f AS converted, a.f AS af, b.f AS bf
  FROM lineitem JOIN pairs p ON (l_orderkey+l_linenumber)%4=p.k LEFT JOIN fac a ON a.category=p.category AND a.name=lower(from_unit)
  LEFT JOIN fac b ON b.category=p.category AND b.name=lower(to_unit))
SELECT category, l_orderkey, l_linenumber, from_unit, to_unit, round(converted/pow(10.0::DOUBLE,floor(log10(converted))),8) AS digits, floor(log10(converted))::INT AS power,
  CASE WHEN af IS NULL THEN 'Unsupported unit '||from_unit WHEN bf IS NULL THEN 'Unsupported unit '||to_unit END AS unit_error FROM c"""
_REACT = "re AS (SELECT s_suppkey AS reaction, (abs(s_acctbal)/200.0::DOUBLE+40.0::DOUBLE)*1000.0::DOUBLE AS ea, (-(s_suppkey%50))::DOUBLE AS entropy FROM supplier)"
_LNK = f"ln({_d(K.BOLTZMANN_J)}*temperature/{_d(K.PLANCK_JS)}) + entropy/{_d(K.GAS_CONSTANT_J)} - ea/({_d(K.GAS_CONSTANT_J)}*temperature)"
ORACLES["rate_constants"] = f"WITH {_REACT} SELECT reaction, round(({_LNK.replace('temperature', '300.0::DOUBLE')})/ln(10.0::DOUBLE),6) AS log10_rate FROM re"
ORACLES["arrhenius"] = f"""WITH {_REACT}, g AS (SELECT re.*, n::INT AS point, 250.0::DOUBLE+n*(200.0::DOUBLE/99) AS temperature FROM re, (SELECT unnest(range(100)) AS n))
SELECT reaction, point, round(temperature,6) AS temperature, round(1.0::DOUBLE/temperature,6) AS inv_t, round({_LNK},6) AS ln_k FROM g"""

# ---- groups, boxes, rotations --------------------------------------------------------------------
_TRIPLE = "((atom_id-1)//3+1)::INT AS group_id"
_COM = f"""com AS (SELECT run_id, frame_id, group_id, sum(m*x)/sum(m) AS x, sum(m*y)/sum(m) AS y, sum(m*z)/sum(m) AS z
  FROM (SELECT *, {_TRIPLE}, {_MASS}[element] AS m FROM traj) GROUP BY ALL)"""
ORACLES["center_of_mass"] = f"WITH {TRAJ}, {_COM} SELECT run_id, frame_id, group_id, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM com"
ORACLES["geometric_center"] = f"""WITH {TRAJ} SELECT run_id, frame_id, group_id, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z
  FROM (SELECT *, {_TRIPLE} FROM traj) GROUP BY ALL"""
ORACLES["bounding_radius"] = f"""WITH {TRAJ}, {_COM}, g AS (SELECT *, {_TRIPLE} FROM traj)
SELECT g.run_id, g.frame_id, g.group_id, round(max({_dist(_cols('com'), _cols('g'))}+{_RVDW}[g.element]),6) AS radius
  FROM g JOIN com USING (frame_id, group_id) GROUP BY ALL"""
_V2 = f"*{_d(K.AU_VELOCITY_M_PER_S)}*{_d(K.AU_VELOCITY_M_PER_S)}/1000.0::DOUBLE"
ORACLES["kinetic_energy"] = f"""WITH {VEL}, s AS (SELECT run_id, frame_id, sum(m)/1000.0::DOUBLE AS kg, sum(m*vx)/sum(m) AS vx, sum(m*vy)/sum(m) AS vy, sum(m*vz)/sum(m) AS vz
  FROM (SELECT *, {_MASS}[element] AS m FROM vel WHERE atom_id<=3) GROUP BY ALL), k AS (SELECT *, 0.5::DOUBLE*kg*(vx*vx+vy*vy+vz*vz){_V2} AS kj FROM s)
SELECT run_id, frame_id, round(kg,6) AS molar_mass_kg, round(kj,2) AS kj_mol, round(kj*{_d(K.KJ_TO_KCAL)},2) AS kcal_mol FROM k"""
ORACLES["atom_kinetic_energy"] = f"""WITH {VEL}, k AS (SELECT *, 0.5::DOUBLE*{_MASS}[element]/1000.0::DOUBLE*(vx*vx+vy*vy+vz*vz){_V2} AS kj FROM vel WHERE atom_id<=3)
SELECT run_id, frame_id, atom_id, element, round(kj,2) AS kj_mol, round(kj*{_d(K.KJ_TO_KCAL)},2) AS kcal_mol FROM k"""
_M = ", ".join(f"sum(m*{c})/sum(m) AS m{c}" for c in ("x", "y", "z", "vx", "vy", "vz"))
_AIM = ", ".join(
    f"round(CASE WHEN atom_id<=3 THEN v{c}-mv{c}+({t}.0::DOUBLE-m{c})/len*0.01::DOUBLE ELSE v{c} END,6) AS v{c}" for c, t in (("x", 20), ("y", 10), ("z", 5))
)
ORACLES["aim_velocity"] = f"""WITH {VEL}, s AS (SELECT frame_id, {_M} FROM (SELECT *, {_MASS}[element] AS m FROM vel WHERE atom_id<=3) GROUP BY frame_id),
l AS (SELECT *, sqrt((20-mx)*(20-mx)+(10-my)*(10-my)+(5-mz)*(5-mz)) AS len FROM s)
SELECT {_ATOMS6}, {_AIM} FROM vel JOIN l USING (frame_id)"""
_MI = [f"((a.{c}-b.{c})-12.0::DOUBLE*round_even((a.{c}-b.{c})/12.0::DOUBLE,0))" for c in "xyz"]
ORACLES["clash_pairs"] = f"""WITH {TRAJ}, t AS (SELECT *, ((atom_id-1)//3)::BIGINT AS mol, {_RVDW}[element] AS r FROM traj),
p AS (SELECT a.run_id, a.frame_id, a.mol AS mol_a, b.mol AS mol_b, {_dot(_MI, _MI)} AS d2, 0.3::DOUBLE*(a.r+b.r) AS lim
  FROM t a JOIN t b ON a.frame_id=b.frame_id AND a.mol<b.mol)
SELECT run_id, frame_id, mol_a, mol_b, count(*) AS contacts, round(sqrt(min(d2)),6) AS min_distance FROM p WHERE d2<lim*lim GROUP BY ALL"""
_IN = " AND ".join(f"{c}+6.0::DOUBLE BETWEEN 3.5::DOUBLE AND 8.5::DOUBLE" for c in "xyz")
ORACLES["inside_box"] = f"""WITH {TRAJ} SELECT run_id, frame_id, group_id, bool_and({_IN}) AS inside FROM (SELECT *, {_TRIPLE} FROM traj) GROUP BY run_id, frame_id, group_id"""
ORACLES["density"] = f"""WITH {TRAJ}, m AS (SELECT run_id, frame_id, sum(CASE WHEN z BETWEEN 0.0 AND 6.0 THEN {_MASS}[element] ELSE 0 END) AS mass FROM traj GROUP BY ALL)
SELECT run_id, frame_id, round(mass,6) AS mass, round(mass*{_d(K.AMU_GRAMS)}/{_d(12.0 * 12.0 * 6.0 * 1e-24)},6) AS density FROM m"""
ORACLES["target_molecules"] = f"""WITH s AS (SELECT p_partkey, (p_retailprice/1000.0::DOUBLE*((p_size+10.0::DOUBLE)*(p_size+11.0::DOUBLE)*(p_size+12.0::DOUBLE)*1e-24::DOUBLE)/{_d(K.AMU_GRAMS)}
  -180.156::DOUBLE)/18.015::DOUBLE AS n FROM part)
SELECT p_partkey, greatest(0,floor(n))::BIGINT AS n_floor, greatest(0,round_even(n,0))::BIGINT AS n_round FROM s"""
_B = _d(K.ANGSTROM_TO_BOHR)
ORACLES["rescale"] = f"WITH {TRAJ} SELECT run_id, frame_id, atom_id, element, round(x*{_B},6) AS x, round(y*{_B},6) AS y, round(z*{_B},6) AS z FROM traj"
ORACLES["force_magnitude"] = f"WITH {VEL} SELECT run_id, frame_id, atom_id, round(sqrt(vx*vx+vy*vy+vz*vz),6) AS force FROM vel"


def _eigenvector(name: str, value: str) -> str:
    """Null direction of A - value*I: the longest of the cross products of its rows."""
    rows = [(f"(xx-{value})", "xy", "xz"), ("xy", f"(yy-{value})", "yz"), ("xz", "yz", f"(zz-{value})")]
    picks = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        c = _cross(rows[a], rows[b])
        picks.append(f"{{'n':sqrt({_dot(c, c)}),'v':[{','.join(c)}]}}")
    return f"list_max([{','.join(picks)}]) AS {name}"


def _axis_sign(axis: str) -> str:
    at = f"(qx*{axis}x+qy*{axis}y+qz*{axis}z)"
    return f"CASE WHEN arg_max({at}, abs({at}))<0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


_unit = lambda c, name: ", ".join(f"{c}.v[{n}]/{c}.n AS {name}{a}" for n, a in ((1, "x"), (2, "y"), (3, "z")))
_uw = _cross(_names("u"), _names("w"))
_zx = _cross(_names("z"), _names("u"))
ORACLES["principal_axes"] = f"""WITH {TRAJ}, c AS (SELECT *, x-avg(x) OVER f AS qx, y-avg(y) OVER f AS qy, z-avg(z) OVER f AS qz FROM traj WINDOW f AS (PARTITION BY frame_id)),
m AS (SELECT frame_id, avg(qx*qx) AS xx, avg(qx*qy) AS xy, avg(qx*qz) AS xz, avg(qy*qy) AS yy, avg(qy*qz) AS yz, avg(qz*qz) AS zz FROM c GROUP BY frame_id),
m1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM m),
m2 AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM m1),
m3 AS (SELECT *, acos(greatest(-1,least(1,((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(p*p*p)/2)))/3 AS phi FROM m2),
m4 AS (SELECT *, q+2*p*cos(phi) AS big, q+2*p*cos(phi+{_d(2 * 3.141592653589793 / 3)}) AS small FROM m3),
m5 AS (SELECT *, 3*q-big-small AS mid FROM m4),
m6 AS (SELECT frame_id, {_eigenvector('e1', 'small')}, {_eigenvector('e2', 'mid')} FROM m5),
ax AS (SELECT frame_id, {_unit('e1', 'u')}, {_unit('e2', 'w')} FROM m6),
s1 AS (SELECT c.frame_id, {_axis_sign('u')} AS su, {_axis_sign('w')} AS sw FROM c JOIN ax USING (frame_id) GROUP BY c.frame_id),
a1 AS (SELECT frame_id, su*ux AS ux, su*uy AS uy, su*uz AS uz, sw*wx AS wx, sw*wy AS wy, sw*wz AS wz FROM ax JOIN s1 USING (frame_id)),
a2 AS (SELECT *, {_vectors({'z': _uw})} FROM a1),
s2 AS (SELECT c.frame_id, {_axis_sign('a2.z')} AS sz FROM c JOIN a2 USING (frame_id) GROUP BY c.frame_id),
a3 AS (SELECT frame_id, ux, uy, uz, sz*zx AS zx, sz*zy AS zy, sz*zz AS zz FROM a2 JOIN s2 USING (frame_id)),
a4 AS (SELECT *, {_vectors({'y': _zx})} FROM a3)
SELECT 'r0' AS run_id, c.frame_id, atom_id, element, round(qx*ux+qy*uy+qz*uz,5) AS x, round(qx*yx+qy*yy+qz*yz,5) AS y,
  round(qx*zx+qy*zy+qz*zz,5) AS z FROM c JOIN a4 USING (frame_id)"""

# ---- text in and out -----------------------------------------------------------------------------
ORACLES["xyz_roundtrip"] = f"WITH {TRAJ} SELECT run_id, frame_id, atom_id, element, round(x,7) AS x, round(y,7) AS y, round(z,7) AS z FROM traj"
ORACLES["xyz_errors"] = """SELECT 'r0' AS run_id, vec_id*23+7 AS line_no, 'expected 4 items, found 3' AS error FROM embeddings WHERE vec_id%10=3
UNION ALL SELECT 'r0', vec_id*23+10, 'non-numeric coordinate' FROM embeddings WHERE vec_id%15=4"""
for _fmt, _digits in STRUCTURE_DIGITS.items():
    ORACLES[f"structures_{_fmt}"] = f"""WITH {TRAJ} SELECT 'r0/'||frame_id AS run_id, 0::BIGINT AS frame_id, atom_id, element,
  round(x,{_digits}) AS x, round(y,{_digits}) AS y, round(z,{_digits}) AS z FROM traj"""
ORACLES["symbol_order_check"] = f"WITH {RUNS} SELECT run_id FROM runs GROUP BY run_id HAVING count(DISTINCT vec_id%97=5)>1"
_FAR = f"SELECT 'r0' AS run_id, vec_id AS frame_id, round({_T0},6) AS time_ps, round({_dist(_p(1), _p(21))},6) AS value FROM embeddings"
ORACLES["pack_frames"] = f"WITH {TRAJ} SELECT run_id, frame_id, atom_id, element, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM traj"
ORACLES["bond_series_atoms"] = _FAR
