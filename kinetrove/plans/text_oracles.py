"""SQL equivalents of the queries over text, from the tables that the text was rendered from."""

from __future__ import annotations

from kinetrove.plans.oracles import _RCOV, _TORSION, ORACLES, RUNS, TRAJ, VEL

_BAD_ATOM, _BAD_COUNT = "vec_id%89=7", "vec_id%97=3"
# A frame that tells one atom more than it has takes the next count line for an atom; the last one of a run is cut.
_DAMAGE = f"""{RUNS}, n AS (SELECT *, max(frame_id) OVER (PARTITION BY run_id) AS last FROM runs),
e AS (SELECT run_id, frame_id, CASE WHEN {_BAD_COUNT} AND frame_id=0 AND last=0 THEN frame_id*23+1
    WHEN {_BAD_COUNT} AND frame_id>0 THEN frame_id*23+1 WHEN {_BAD_COUNT} THEN 24 ELSE frame_id*23+10 END AS line_no,
  CASE WHEN {_BAD_COUNT} AND frame_id>0 THEN 'atom count changes in frame '||(frame_id+1)||', line '||(frame_id*23+1)
    WHEN {_BAD_COUNT} AND last=0 THEN 'truncated frame in frame 1, line 1'
    WHEN {_BAD_COUNT} THEN 'atom line needs four words in frame 1, line 24'
    ELSE 'coordinate is not a number in frame '||(frame_id+1)||', line '||(frame_id*23+10) END AS error
  FROM n WHERE {_BAD_ATOM} OR {_BAD_COUNT}),
first AS (SELECT run_id, min(frame_id) AS cut FROM e GROUP BY run_id)"""
ORACLES["xyz_corrupt"] = f"WITH {_DAMAGE} SELECT e.run_id, e.frame_id, e.line_no, e.error FROM e JOIN first ON e.run_id=first.run_id AND e.frame_id=first.cut"
ORACLES["xyz_permissive"] = f"""WITH {_DAMAGE}, k AS (SELECT runs.* FROM runs LEFT JOIN first USING (run_id) WHERE cut IS NULL OR frame_id<cut)
SELECT run_id, frame_id, 21::BIGINT AS n_atoms, round(list_sum(list_transform(range(21), lambda a: round(10.0::DOUBLE*embedding[3*a+1]::DOUBLE,7))),7) AS sum_x FROM k"""
ORACLES["xyz_changing_counts"] = """SELECT 'r0' AS run_id, vec_id*23-(vec_id//3)+7 AS line_no, 'non-numeric coordinate' AS error FROM embeddings WHERE vec_id%10=3"""
ORACLES["state_log"] = f"""WITH {RUNS}, e AS (SELECT run_id, frame_id AS row_idx, vec_id, CASE WHEN vec_id%101=5 THEN 'invalid state 9'
  WHEN vec_id%103=6 THEN 'expected 2 items, found 1' END AS error FROM runs)
SELECT run_id, row_idx, vec_id::INT AS step, CASE WHEN error IS NULL THEN (vec_id%4)::INT ELSE -1 END AS state, error FROM e"""
ORACLES["valid_runs"] = f"""WITH {RUNS}, v AS (SELECT run_id, vec_id%4 AS state FROM runs WHERE run_id NOT IN ('1','3','7')), n AS (SELECT count(DISTINCT run_id) AS r FROM v),
c AS (SELECT s.state::INT AS state, 1+(SELECT count(*) FROM v WHERE v.state=s.state) AS n FROM (SELECT unnest([1,2,3]) AS state) s)
SELECT state, round(c.n/r::DOUBLE,6) AS average, round(c.n*100.0::DOUBLE/(SELECT sum(n) FROM c),6) AS percent FROM c, n"""
_TWO = f"""{VEL}, two AS (SELECT CASE WHEN frame_id%2=1 THEN 'odd' ELSE 'even' END AS run_id, frame_id//2 AS frame_id, atom_id, element, x, y, z, vx, vy, vz
  FROM vel WHERE frame_id%2=0 OR atom_id<=7)"""
_PLACE = "round(x,6) AS x, round(y,6) AS y, round(z,6) AS z"
_SPEED = "round(vx,6) AS vx, round(vy,6) AS vy, round(vz,6) AS vz"
ORACLES["phase_space"] = f"WITH {_TWO} SELECT run_id, frame_id, atom_id, element, {_PLACE}, {_SPEED} FROM two"
ORACLES["phase_space_errors"] = f"""WITH {_TWO}, f AS (SELECT DISTINCT run_id, frame_id FROM two)
SELECT run_id, frame_id+1 AS frame_id, CASE WHEN frame_id%20=3 THEN 'first word is not a number' ELSE 'frame number changes inside the frame' END AS error
FROM f WHERE frame_id%20=3 OR frame_id%30=7"""
ORACLES["cp_frames"] = f"""WITH {_TWO} SELECT run_id, frame_id, atom_id, element, round(x*0.5291772109::DOUBLE,6) AS x, round(y*0.5291772109::DOUBLE,6) AS y, round(z*0.5291772109::DOUBLE,6) AS z FROM two"""
ORACLES["cp_forces"] = f"WITH {_TWO} SELECT run_id, frame_id, atom_id, element, round(sqrt(vx*vx+vy*vy+vz*vz),6) AS force FROM two"
ORACLES["snapshots"] = f"WITH {VEL} SELECT run_id||'/'||frame_id AS run_id, 0::BIGINT AS frame_id, atom_id, element, {_PLACE}, {_SPEED} FROM vel"
ORACLES["energy_log"] = """SELECT 'r0' AS run_id, event_id AS step, round(value/1000.0::DOUBLE,6) AS e_fict, round(value,6) AS temperature,
  round(-100.0::DOUBLE-value/100.0::DOUBLE,6) AS e_ks, round(-100.0::DOUBLE-value/100.0::DOUBLE+value/500.0::DOUBLE,6) AS c4,
  round(-100.0::DOUBLE-value/100.0::DOUBLE+value/500.0::DOUBLE+value/1000.0::DOUBLE,6) AS e_total, 0.0::DOUBLE AS c6, round(value/10.0::DOUBLE,6) AS cpu_s FROM events"""
ORACLES["energy_headered"] = """WITH e AS (SELECT event_id, value, event_id%3 AS k, event_id%50=7 AND event_id%3>0 AS bad FROM events)
SELECT ['blanks','commas','quotes'][k+1] AS run_id, event_id//3+3 AS line_no, event_id::DOUBLE AS step, round(value,6) AS temperature,
  CASE WHEN k>0 AND NOT bad THEN round(-100.0::DOUBLE-value/100.0::DOUBLE,6) END AS e_ks,
  CASE WHEN bad THEN 'column ''E KS'' is not numeric' END AS error FROM e"""
ORACLES["structures_cpmd"] = f"""WITH {TRAJ}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY (atom_id-1)%4, atom_id) AS k FROM traj)
SELECT 'r0/'||frame_id AS run_id, 0::BIGINT AS frame_id, k::INT AS atom_id, element, round(x*0.529177210903::DOUBLE,6) AS x,
  round(y*0.529177210903::DOUBLE,6) AS y, round(z*0.529177210903::DOUBLE,6) AS z FROM o"""
ORACLES["gaussian_inputs"] = ORACLES["structures_gaussian"]
_STEP = "[0.0,12.0,-12.0,24.0,-24.0]"
ORACLES["coordination_wide"] = f"""WITH {TRAJ}, img AS (SELECT x.s AS sx, y.s AS sy, z.s AS sz FROM (SELECT unnest({_STEP})::DOUBLE AS s) x,
  (SELECT unnest({_STEP})::DOUBLE AS s) y, (SELECT unnest({_STEP})::DOUBLE AS s) z),
t AS (SELECT p.x-c.x+sx AS dx, p.y-c.y+sy AS dy, p.z-c.z+sz AS dz FROM traj p JOIN traj c ON c.frame_id=p.frame_id AND c.atom_id=1, img
  WHERE p.element='O' AND p.atom_id NOT IN (1,3)),
d AS (SELECT sqrt(dx*dx+dy*dy+dz*dz) AS d FROM t),
w AS (SELECT 14.0::DOUBLE/70 AS w), e AS (SELECT unnest(range(70)) AS bin), edges AS (SELECT bin, bin*w AS lo, (bin+1)*w AS hi FROM e, w),
h AS (SELECT bin, lo, hi, count(d.d) AS c FROM edges LEFT JOIN d ON d.d>=lo AND (d.d<hi OR (bin=69 AND d.d=hi)) AND d.d<=14.0::DOUBLE GROUP BY ALL),
m AS (SELECT *, c/(SELECT count(*) FROM embeddings)::DOUBLE AS m, 4.0::DOUBLE/3.0*3.141592653589793::DOUBLE*(hi*hi*hi-lo*lo*lo) AS vol,
  (SELECT count(*) FROM traj WHERE frame_id=0 AND element='O')/1728.0::DOUBLE AS rho FROM h)
SELECT 'r0' AS run_id, bin::INT AS bin, round(lo,5) AS r, round(m/vol/rho,5) AS g, round(sum(m) OVER (ORDER BY bin),5) AS coordination FROM m"""
ORACLES["dihedral_full_range"] = f"""WITH {_TORSION}, hb AS (SELECT least(35,floor((angle+180.0::DOUBLE)/10.0::DOUBLE))::INT AS bin FROM raw WHERE angle IS NOT NULL),
n AS (SELECT count(*) AS total FROM hb), e AS (SELECT unnest(range(36))::INT AS bin)
SELECT 'r0' AS run_id, e.bin, round(10.0::DOUBLE*(e.bin+0.5::DOUBLE)-180.0::DOUBLE,6) AS center, count(hb.bin) AS count, round(count(hb.bin)*100.0::DOUBLE/any_value(total),6) AS pct
FROM n, e LEFT JOIN hb USING (bin) GROUP BY e.bin"""
ORACLES["dihedral_circular"] = f"""WITH {_TORSION}, m AS (SELECT count(angle) AS n, avg(sin(radians(angle))) AS s, avg(cos(radians(angle))) AS c FROM raw)
SELECT 'r0' AS run_id, n, round(degrees(atan2(s,c)),6) AS mean, round(sqrt(s*s+c*c),6) AS resultant, round(degrees(sqrt(-2*ln(sqrt(s*s+c*c)))),6) AS std_dev FROM m"""
_PAIR = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
# The pairs of the first frame alone, and their atoms in all frames.
_FIRST = f"p AS (SELECT a.atom_id AS i, b.atom_id AS j, a.element AS ea, b.element AS eb, {_PAIR} AS d2 FROM traj a JOIN traj b ON a.frame_id=0 AND b.frame_id=0 AND a.atom_id<b.atom_id)"
_FOLLOWED = "k JOIN traj a ON a.atom_id=k.i JOIN traj b ON b.atom_id=k.j AND b.frame_id=a.frame_id"
ORACLES["static_bonds"] = f"""WITH {TRAJ}, {_FIRST}, k AS (SELECT i, j FROM p WHERE sqrt(d2)<=least(1.5::DOUBLE,{_RCOV}[ea]+{_RCOV}[eb]+0.45::DOUBLE))
SELECT 'r0' AS run_id, a.frame_id, i, j, round(sqrt({_PAIR}),6) AS distance FROM {_FOLLOWED}"""
ORACLES["solute_bonds"] = f"""WITH {TRAJ}, {_FIRST}, k AS (SELECT i, j FROM p WHERE d2<=2.25::DOUBLE AND i<=12 AND j<=12), f AS (SELECT i, j, {_PAIR} AS d2 FROM {_FOLLOWED})
SELECT 'r0' AS run_id, i, j, count(*) AS n, 0::BIGINT AS degenerate, round(avg(sqrt(d2)),6) AS mean, round(var_pop(sqrt(d2)),6) AS variance, round(stddev_pop(sqrt(d2)),6) AS std_dev
FROM f GROUP BY i, j"""
ORACLES["series_csv"] = ORACLES["bond_series"]
ORACLES["state_files"] = f"""WITH {RUNS}, s AS (SELECT *, CASE WHEN frame_id*10<9*count(*) OVER (PARTITION BY run_id) THEN (vec_id%4)::VARCHAR ELSE 'unknown' END AS state FROM runs)
SELECT state, (a+1)::INT AS atom_id, ['C','H','O','N'][a%4+1] AS element, round(10.0::DOUBLE*embedding[3*a+1]::DOUBLE,7) AS x,
  round(10.0::DOUBLE*embedding[3*a+2]::DOUBLE,7) AS y, round(10.0::DOUBLE*embedding[3*a+3]::DOUBLE,7) AS z FROM s, (SELECT unnest(range(21)) AS a)"""
_NEAREST = "+".join(f"pow((a.{c}-b.{c})-12.0::DOUBLE*round_even((a.{c}-b.{c})/12.0::DOUBLE,0),2)" for c in "xyz")
ORACLES["tiled_pairs"] = f"""WITH {TRAJ}, p AS (SELECT a.run_id, a.frame_id, a.atom_id::BIGINT AS i, b.atom_id::BIGINT AS j, {_NEAREST} AS d2
  FROM traj a JOIN traj b ON a.frame_id=b.frame_id AND a.atom_id<b.atom_id) SELECT run_id, frame_id, i, j, round(d2,6) AS d2 FROM p WHERE d2<=2.25::DOUBLE"""
