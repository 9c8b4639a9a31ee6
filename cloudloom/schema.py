"""Columns of a splat cloud."""

from __future__ import annotations

POSITION = ["x", "y", "z"]
SCALES = ["scale_0", "scale_1", "scale_2"]
ROTATION = ["rot_0", "rot_1", "rot_2", "rot_3"]
COLOURS = ["f_dc_0", "f_dc_1", "f_dc_2"]
BASE = [*POSITION, *SCALES, *ROTATION, "opacity", *COLOURS]
#: Coefficients of each colour by degree of the spherical harmonics.
COEFFICIENTS = {0: 0, 1: 3, 2: 8, 3: 15}
SCHEMA = "gid bigint, lod smallint, " + ", ".join(f"{c} float" for c in BASE) + ", f_rest array<float>"
