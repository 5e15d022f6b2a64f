"""Molecular-trajectory analytics as Spark DataFrame jobs.

``atoms``  : run_id, frame_id (0-based), atom_id (1-based), element, x, y, z[, vx, vy, vz, fx, fy, fz]
``frames`` : run_id, frame_id, elements ARRAY<STRING>, pos ARRAY<STRUCT<x,y,z[,vx,vy,vz]>>

Every operator takes DataFrames and returns DataFrames; ``run_id`` is part of every key, so one
trajectory and ten thousand runs are the same query.
"""

__version__ = "0.1.0"
