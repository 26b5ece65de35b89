"""Cell geometry as SQL text for DuckDB: centres, areas, disks and cells of points, from the constants of `icosahedron` alone.

Resolutions are even where an area is asked for: sides of their cells do not bend at the edges of the icosahedron. A disk is
worked out on the lattice of its base cell, for the cells that `inputs.cell_sql` makes from keys (base cells 5 to 11).
"""

from __future__ import annotations

import cmath
import math

import numpy as np

from hexweave.functions import icosahedron as ico


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v):.17e}" for v in np.ravel(values)) + "]"


def _ints(values) -> str:
    return "[" + ", ".join(str(int(v)) for v in np.ravel(values)) + "]"


def _spelled(base: str, res: int, digits: str) -> str:
    return f"CAST({(1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1)} + {base} * {1 << 45} + {digits} AS BIGINT)"


def _lead(digits: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {d} <> 0 THEN {d}" for d in digits) + " ELSE 0 END"


def _digit(h: str, r: int) -> str:
    return f"(({h} >> {3 * (15 - r)}) & 7)"


def placed(cells: str, h: str, res: int) -> str:
    """SELECT of h, face, x, y and corner, the position of every cell of ``cells`` on its home face; corner: it is a pentagon."""
    base, lead = f"(({h} >> 45) & 127)", _lead([_digit(h, r) for r in range(1, res + 1)])
    unit = [cmath.exp(1j * ico.TURN * (r % 2)) / math.sqrt(7.0) ** r for r in range(res + 1)]
    at = np.array([(ico.DIGIT_A + ico.DIGIT_B * ico.W) * unit[r] for r in range(res + 1)])
    x, y = (
        f"{_list(getattr(ico._HOME_POS, part))}[base + 1] + "
        + " + ".join(f"{_list(getattr(at[r], part))}[CASE WHEN back THEN {_ints(ico._TURNED[5])}[{_digit(h, r)} + 1] ELSE {_digit(h, r)} END + 1]" for r in range(1, res + 1))
        for part in ("real", "imag")
    )
    return f"""SELECT {h} AS h, {_ints(ico._HOME_FACE)}[base + 1] AS face, {x} AS x, {y} AS y, pentagon AND lead = 0 AS corner FROM (
      SELECT *, pentagon AND lead IN (4, 5) AS back FROM (
        SELECT {h}, {base} AS base, {lead} AS lead, {base} IN ({', '.join(map(str, ico.PENTAGONS))}) AS pentagon FROM {cells}))"""


def unfolded(rows: str, times: int = 4) -> str:
    """``rows`` (face, x, y) moved beyond edges onto the face they are on."""
    n = ico._NORMALS
    for _ in range(times):
        rows = f"""SELECT * EXCLUDE (o, e, m, face, x, y), CASE WHEN m THEN {_ints(ico._NEXT)}[face * 3 + e] ELSE face END AS face,
          CASE WHEN m THEN x * {_list(ico._TURN.real)}[face * 3 + e] - y * {_list(ico._TURN.imag)}[face * 3 + e] + {_list(ico._SHIFT.real)}[face * 3 + e] ELSE x END AS x,
          CASE WHEN m THEN x * {_list(ico._TURN.imag)}[face * 3 + e] + y * {_list(ico._TURN.real)}[face * 3 + e] + {_list(ico._SHIFT.imag)}[face * 3 + e] ELSE y END AS y
        FROM (SELECT *, list_position(o, list_max(o)) AS e, list_max(o) > 1 + 1e-9 AS m FROM (
          SELECT *, [{', '.join(f'x * {v.real:.17e} + y * {v.imag:.17e}' for v in n)}] AS o FROM ({rows})))"""
    return rows


def vectors(rows: str) -> str:
    """``rows`` (face, x, y) with the unit vector vx, vy, vz."""
    v = [
        f"{_list(ico._CENTER[:, i])}[face + 1] + {ico.PLANE_UNIT:.17e} * (x * {_list(ico._AXIS1[:, i])}[face + 1] + y * {_list(ico._AXIS2[:, i])}[face + 1])"
        for i in range(3)
    ]
    return f"""SELECT * EXCLUDE (ux, uy, uz, face, x, y), ux / norm AS vx, uy / norm AS vy, uz / norm AS vz FROM (
      SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS norm FROM (SELECT *, {v[0]} AS ux, {v[1]} AS uy, {v[2]} AS uz FROM ({rows})))"""


LAT, LNG = "degrees(atan2(vz, sqrt(vx * vx + vy * vy)))", "degrees(atan2(vy, vx))"


def centers(cells: str, h: str, res: int) -> str:
    """SELECT of h, lat, lng of every cell; a pentagon stays at its corner."""
    rows = placed(cells, h, res)
    both = f"{unfolded(f'SELECT * FROM ({rows}) WHERE NOT corner')} UNION ALL BY NAME SELECT * FROM ({rows}) WHERE corner"
    return f"SELECT h, {LAT} AS lat, {LNG} AS lng FROM ({vectors(both)})"


def area_ctes(cells: str, h: str, res: int) -> str:
    """Common table expressions ``outline`` and ``areas`` (h, km2): triangles from a cell's centre to each side."""
    spokes = [cmath.exp(1j * math.pi * (2 * k + 1) / 6) / math.sqrt(3.0) / math.sqrt(7.0) ** res for k in range(6)] + [0j]
    rows = f"SELECT h, face, x, y, corner FROM ({placed(cells, h, res)})"
    # Corners are seen from the centre's face; a pentagon's from its home face, and it has no sixth one.
    own = f"{unfolded(f'SELECT * FROM ({rows}) WHERE NOT corner')} UNION ALL BY NAME SELECT * FROM ({rows}) WHERE corner"
    points = f"""SELECT * EXCLUDE (x, y), x + {_list([s.real for s in spokes])}[k + 1] AS x, y + {_list([s.imag for s in spokes])}[k + 1] AS y
      FROM ({own}), range(7) t(k) WHERE NOT (corner AND k = 5)"""
    moved = f"{unfolded(f'SELECT * FROM ({points}) WHERE NOT (corner AND k = 6)')} UNION ALL BY NAME SELECT * FROM ({points}) WHERE corner AND k = 6"
    a, b, c = ([f"{t}.v{i}" for i in "xyz"] for t in "abc")
    p, q = ([f"({u} - {v})" for u, v in zip(side, c)] for side in (a, b))
    cross = [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]

    def dot(u, v):
        return " + ".join(f"{m} * {n}" for m, n in zip(u, v))

    found = f"""SELECT c.h, SUM(2 * atan2(abs({dot(c, cross)}), 1 + {dot(c, a)} + {dot(a, b)} + {dot(b, c)})) * {ico.EARTH_RADIUS_KM**2:.17e} AS km2
      FROM outline a JOIN outline b ON b.h = a.h AND b.k = (a.k + 1) % (CASE WHEN a.corner THEN 5 ELSE 6 END) JOIN outline c ON c.h = a.h AND c.k = 6
      WHERE a.k < 6 GROUP BY c.h"""
    return f"outline AS MATERIALIZED ({vectors(moved)}), areas AS ({found})"


def all_cells(res: int) -> str:
    """SELECT of h, every cell of a resolution; a pentagon has no descendants along its first axis."""
    lead = _lead([f"d{r}" for r in range(1, res + 1)])
    digits = " + ".join(f"d{r} * {1 << 3 * (15 - r)}" for r in range(1, res + 1))
    ranges = ", ".join(f"range(7) t{r}(d{r})" for r in range(1, res + 1))
    return f"""SELECT {_spelled('base', res, digits)} AS h FROM range(122) t(base), {ranges}
      WHERE NOT (base IN ({', '.join(map(str, ico.PENTAGONS))}) AND {lead} = 1)"""


def point_cells(points: str, res: int) -> str:
    """``points`` (lat, lng) with clat, clng, the centre of the cell of each, from the nearest face and its lattice."""
    scale = math.sqrt(7.0) ** res * cmath.exp(-1j * ico.TURN * (res % 2))
    back = 1 / scale
    v = ["cos(radians(lat)) * cos(radians(lng))", "cos(radians(lat)) * sin(radians(lng))", "sin(radians(lat))"]

    def dot(table):
        return " + ".join(f"p{i} * {_list(table[:, i])}[face + 1]" for i in range(3))

    on_face = f"""SELECT * EXCLUDE (p0, p1, p2, dots), ({dot(ico._AXIS1)}) / (list_max(dots) * {ico.PLANE_UNIT:.17e}) AS px, ({dot(ico._AXIS2)}) / (list_max(dots) * {ico.PLANE_UNIT:.17e}) AS py
      FROM (SELECT *, list_position(dots, list_max(dots)) - 1 AS face FROM (
        SELECT *, [{', '.join(' + '.join(f'p{i} * {c[i]:.17e}' for i in range(3)) for c in ico._CENTER)}] AS dots
        FROM (SELECT *, {v[0]} AS p0, {v[1]} AS p1, {v[2]} AS p2 FROM {points})))"""
    lattice = f"""SELECT *, qx + qy / {ico.W.imag:.17e} / 2 - qy / {ico.W.imag:.17e} AS lx, qy / {ico.W.imag:.17e} AS lz
      FROM (SELECT *, px * {scale.real:.17e} - py * {scale.imag:.17e} AS qx, px * {scale.imag:.17e} + py * {scale.real:.17e} AS qy FROM ({on_face}))"""
    rounded = f"SELECT *, round_even(lx, 0) AS rx, round_even(-lx - lz, 0) AS ry, round_even(lz, 0) AS rz FROM ({lattice})"
    gaps = f"SELECT *, abs(rx - lx) AS gx, abs(ry + lx + lz) AS gy, abs(rz - lz) AS gz FROM ({rounded})"
    fixed = f"""SELECT *, CASE WHEN gz > gy AND gz >= gx THEN -ix - ry ELSE rz END AS iz
      FROM (SELECT *, CASE WHEN gx > gy AND gx > gz THEN -ry - rz ELSE rx END AS ix FROM ({gaps}))"""
    a, b = "(ix + iz)", "iz"
    zx, zy = f"({a} - {b} / 2)", f"({b} * {ico.W.imag:.17e})"
    at = f"""SELECT * EXCLUDE (px, py, qx, qy, lx, lz, rx, ry, rz, gx, gy, gz, ix, iz),
      {zx} * {back.real:.17e} - {zy} * {back.imag:.17e} AS x, {zx} * {back.imag:.17e} + {zy} * {back.real:.17e} AS y FROM ({fixed})"""
    return f"SELECT * EXCLUDE (vx, vy, vz, norm), {LAT} AS clat, {LNG} AS clng FROM ({vectors(unfolded(at))})"


def disks(cells: str, h: str, res: int, k: int) -> str:
    """SELECT of h and near, the cells within ``k`` steps, for cells of base cells 5 to 11."""
    rows = f"SELECT {h} AS h, ({h} >> 45) & 127 AS base, 0 AS a, 0 AS b FROM {cells}"
    for r in range(1, res + 1):
        ca, cb = ("2 * a + b", "3 * b - a") if r % 2 else ("3 * a - b", "a + 2 * b")
        rows = f"SELECT h, base, {ca} + {_ints(ico.DIGIT_A)}[{_digit('h', r)} + 1] AS a, {cb} + {_ints(ico.DIGIT_B)}[{_digit('h', r)} + 1] AS b FROM ({rows})"
    rows = f"""SELECT h, base, a + da AS a, b + db AS b FROM ({rows}), (SELECT unnest(range({-k}, {k + 1})) AS da), (SELECT unnest(range({-k}, {k + 1})) AS db)
      WHERE abs(da - db) <= {k}"""
    for r in range(res, 0, -1):
        ua, ub, ca, cb = ("3 * a - b", "a + 2 * b", "2 * ua + ub", "3 * ub - ua") if r % 2 else ("2 * a + b", "3 * b - a", "3 * ua - ub", "ua + 2 * ub")
        rows = f"""SELECT * EXCLUDE (a, b, ua, ub), {_ints(ico._DIGIT_OF)}[(a - ({ca}) + 1) * 3 + b - ({cb}) + 2] AS d{r}, ua AS a, ub AS b
          FROM (SELECT *, CAST(round(({ua}) / 7.0) AS INT) AS ua, CAST(round(({ub}) / 7.0) AS INT) AS ub FROM ({rows}))"""
    table = []
    for base in range(5, 12):
        for da in (-1, 0, 1):
            for db in (-1, 0, 1):
                if abs(da - db) <= 1:
                    at = int(ico._HOME_FACE[base]), int(ico._HOME_A[base]) + da + 3, int(ico._HOME_B[base]) + db + 3
                    table.append((base, da, db, int(ico._BASE[at]), int(ico._BASE_TURNS[at]), 1 if ico._BASE_STEP[at] >= 0 else 5))
    turned = [f"{_ints(ico._TURNED)}[turns * 7 + d{r} + 1]" for r in range(1, res + 1)]
    rows = f"""SELECT h, nb, gap, {', '.join(f'{t} AS d{r}' for r, t in enumerate(turned, 1))}
      FROM ({rows}) JOIN (VALUES {', '.join(map(str, table))}) m(base, a, b, nb, turns, gap) USING (base, a, b)"""
    lead = _lead([f"d{r}" for r in range(1, res + 1)])
    rows = f"SELECT *, CASE WHEN nb IN ({', '.join(map(str, ico.PENTAGONS))}) AND {lead} = 1 THEN gap ELSE 0 END AS again FROM ({rows})"
    digits = " + ".join(f"{_ints(ico._TURNED)}[again * 7 + d{r} + 1]::BIGINT * {1 << 3 * (15 - r)}" for r in range(1, res + 1))
    return f"SELECT h, {_spelled('nb::BIGINT', res, digits)} AS near FROM ({rows})"
