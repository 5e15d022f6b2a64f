"""SQL equivalents of the queries over growing trajectories: drops do not change a result."""

from __future__ import annotations

from kinetrove.plans.oracles import _OCC, ORACLES, RUNS, _events, _filled

ORACLES["residence_events_online"] = ORACLES["residence_events"]
ORACLES["residence_events_appended"] = f"WITH {_filled(_OCC, 2)}, {_events('filled')} SELECT run_id, object_id, start_frame, n_frames FROM ev"
ORACLES["frames_by_offset"] = f"""WITH {RUNS} SELECT run_id, frame_id, (a+1)::INT AS atom_id, ['C','H','O','N'][a%4+1] AS element, round(10.0::DOUBLE*embedding[3*a+1]::DOUBLE,7) AS x,
  round(10.0::DOUBLE*embedding[3*a+2]::DOUBLE,7) AS y, round(10.0::DOUBLE*embedding[3*a+3]::DOUBLE,7) AS z FROM runs, (SELECT unnest(range(21)) AS a) WHERE frame_id%10=3"""
ORACLES["stored_frames"] = f"""WITH {RUNS} SELECT run_id, frame_id, (a+1)::INT AS atom_id, ['C','H','O','N'][a%4+1] AS element, round(10.0::DOUBLE*embedding[3*a+1]::DOUBLE,6) AS x,
  round(10.0::DOUBLE*embedding[3*a+2]::DOUBLE,6) AS y, round(10.0::DOUBLE*embedding[3*a+3]::DOUBLE,6) AS z FROM runs, (SELECT unnest(range(21)) AS a) WHERE frame_id>=5 AND (frame_id-5)%36=0"""
ORACLES["bond_moments_of_drops"] = ORACLES["all_bonds"]
