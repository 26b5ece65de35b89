"""Cell geometry on the unfolded icosahedron, on numpy arrays.

A position is a face number and a complex number on that face's plane, in units of
the distance between neighbouring resolution-0 centres: the face centre is 0 and
its corners lie at distance 2 in the directions 0, 120 and 240 degrees. Leaving a
face means crossing an edge, a rotation by a multiple of 60 degrees and a shift.
At every resolution the cell centres are the Eisenstein integers a + b*w of a
lattice that is sqrt(7) finer than the one above, turned on odd resolutions.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the grid. Per face: latitude and longitude of the centre and
# azimuth of the first lattice axis, in radians.
FACES = np.array([
    [0.803582649718989942, 1.248397419617396099, 5.619958268523939882],
    [1.307747883455638156, 2.536945009877921159, 5.760339081714187279],
    [1.054751253523952054, -1.347517358900396623, 0.780213654393430055],
    [0.600191595538186799, -0.450603909469755746, 0.430469363979999913],
    [0.491715428198773866, 0.401988202911306943, 6.130269123335111400],
    [0.172745327415618701, 1.678146885280433686, 2.692877706530642877],
    [0.605929321571350690, 2.953923329812411617, 2.982963003477243874],
    [0.427370518328979641, -1.888876200336285401, 3.532912002790141181],
    [-0.079066118549212831, -0.733429513380867741, 3.494305004259568154],
    [-0.230961644455383637, 0.506495587332349035, 3.003214169499538391],
    [0.079066118549212831, 2.408163140208925497, 5.930472956509811562],
    [0.230961644455383637, -2.635097066257444203, 0.138378484090254847],
    [-0.172745327415618701, -1.463445768309359553, 0.448714947059150361],
    [-0.605929321571350690, -0.187669323777381622, 0.158629650112549365],
    [-0.427370518328979641, 1.252716453253507838, 5.891865957979238535],
    [-0.600191595538186799, 2.690988744120037492, 2.711123289609793325],
    [-0.491715428198773866, -2.739604450678486295, 3.294508837434268316],
    [-0.803582649718989942, -1.893195233972397139, 3.804819692245439833],
    [-1.307747883455638156, -0.604647643711872080, 3.664438879055192436],
    [-1.054751253523952054, 1.794075294689396615, 2.361378999196363184],
])
# Fixed values of the grid. Per base cell 0..121: home face and the cell's i, j, k coordinates on it.
HOMES = np.array([
    (1, 1, 0, 0), (2, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0),
    (1, 0, 0, 1), (2, 0, 0, 0), (0, 1, 0, 0), (2, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1),
    (3, 1, 0, 0), (3, 1, 1, 0), (11, 2, 0, 0), (4, 1, 0, 0), (0, 0, 0, 0), (6, 0, 1, 0),
    (0, 0, 0, 1), (2, 0, 1, 1), (7, 0, 0, 1), (2, 0, 0, 1), (0, 1, 1, 0), (6, 0, 0, 1),
    (10, 2, 0, 0), (6, 0, 0, 0), (3, 0, 0, 0), (11, 1, 0, 0), (4, 1, 1, 0), (3, 0, 1, 0),
    (0, 0, 1, 1), (4, 0, 0, 0), (5, 0, 1, 0), (0, 0, 1, 0), (7, 0, 1, 0), (11, 1, 1, 0),
    (7, 0, 0, 0), (10, 1, 0, 0), (12, 2, 0, 0), (6, 1, 0, 1), (7, 1, 0, 1), (4, 0, 0, 1),
    (3, 0, 0, 1), (3, 0, 1, 1), (4, 0, 1, 0), (6, 1, 0, 0), (11, 0, 0, 0), (8, 0, 0, 1),
    (5, 0, 0, 1), (14, 2, 0, 0), (5, 0, 0, 0), (12, 1, 0, 0), (10, 1, 1, 0), (4, 0, 1, 1),
    (12, 1, 1, 0), (7, 1, 0, 0), (11, 0, 1, 0), (10, 0, 0, 0), (13, 2, 0, 0), (10, 0, 0, 1),
    (11, 0, 0, 1), (9, 0, 1, 0), (8, 0, 1, 0), (6, 2, 0, 0), (8, 0, 0, 0), (9, 0, 0, 1),
    (14, 1, 0, 0), (5, 1, 0, 1), (16, 0, 1, 1), (8, 1, 0, 1), (5, 1, 0, 0), (12, 0, 0, 0),
    (7, 2, 0, 0), (12, 0, 1, 0), (10, 0, 1, 0), (9, 0, 0, 0), (13, 1, 0, 0), (16, 0, 0, 1),
    (15, 0, 1, 1), (15, 0, 1, 0), (16, 0, 1, 0), (14, 1, 1, 0), (13, 1, 1, 0), (5, 2, 0, 0),
    (8, 1, 0, 0), (14, 0, 0, 0), (9, 1, 0, 1), (14, 0, 0, 1), (17, 0, 0, 1), (12, 0, 0, 1),
    (16, 0, 0, 0), (17, 0, 1, 1), (15, 0, 0, 1), (16, 1, 0, 1), (9, 1, 0, 0), (15, 0, 0, 0),
    (13, 0, 0, 0), (8, 2, 0, 0), (13, 0, 1, 0), (17, 1, 0, 1), (19, 0, 1, 0), (14, 0, 1, 0),
    (19, 0, 1, 1), (17, 0, 1, 0), (13, 0, 0, 1), (17, 0, 0, 0), (16, 1, 0, 0), (9, 2, 0, 0),
    (15, 1, 0, 1), (15, 1, 0, 0), (18, 0, 1, 1), (18, 0, 0, 1), (19, 0, 0, 1), (17, 1, 0, 0),
    (19, 0, 0, 0), (18, 0, 1, 0), (18, 1, 0, 1), (19, 2, 0, 0), (19, 1, 0, 0), (18, 0, 0, 0),
    (19, 1, 0, 1), (18, 1, 0, 0),
])
PLANE_UNIT = 0.38196601125010500003
TURN = math.asin(math.sqrt(3.0 / 28.0))
EARTH_RADIUS_KM = 6371.007180918475
# Fixed values of the grid: a + b*w of each digit 0..6 (centre, K, J, JK, I, IK, IJ).
DIGIT_A = np.array([0, -1, 0, -1, 1, 0, 1])
DIGIT_B = np.array([0, -1, 1, 0, 0, -1, 1])

W = complex(-0.5, math.sqrt(3.0) / 2.0)
SIXTH = complex(0.5, math.sqrt(3.0) / 2.0)
_DIGIT_OF = np.full((3, 3), -1)
_DIGIT_OF[DIGIT_A + 1, DIGIT_B + 1] = np.arange(7)
# Digit after a turn by 60 degrees counter-clockwise, applied 0..5 times.
_TURNED = np.zeros((6, 7), dtype=np.int64)
for _n in range(6):
    for _d in range(7):
        _z = (DIGIT_A[_d] + DIGIT_B[_d] * W) * SIXTH**_n
        _b = round(_z.imag / W.imag)
        _TURNED[_n, _d] = _DIGIT_OF[round(_z.real + _b / 2) + 1, _b + 1]

_lat, _lng, _az = FACES.T
_CENTER = np.stack([np.cos(_lat) * np.cos(_lng), np.cos(_lat) * np.sin(_lng), np.sin(_lat)], axis=1)
_NORTH = np.stack([-np.sin(_lat) * np.cos(_lng), -np.sin(_lat) * np.sin(_lng), np.cos(_lat)], axis=1)
_EAST = np.stack([-np.sin(_lng), np.cos(_lng), np.zeros(20)], axis=1)
_AXIS1 = _NORTH * np.cos(_az)[:, None] + _EAST * np.sin(_az)[:, None]
_AXIS2 = _NORTH * np.sin(_az)[:, None] - _EAST * np.cos(_az)[:, None]
_NORMALS = np.exp(1j * np.radians([60.0, 180.0, 300.0]))  # outwards, edges 0, 1, 2
_CORNERS = 2 * np.exp(1j * np.radians([0.0, 120.0, 240.0]))  # edge e joins corners e and e+1


def to_vector(face: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Unit vector of a position."""
    v = _CENTER[face] + PLANE_UNIT * (p.real[..., None] * _AXIS1[face] + p.imag[..., None] * _AXIS2[face])
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def from_vector(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest face of a unit vector and the position on it."""
    dots = v @ _CENTER.T
    face = dots.argmax(axis=1)
    down = np.take_along_axis(dots, face[:, None], axis=1)[:, 0] * PLANE_UNIT
    x = np.einsum("ij,ij->i", v, _AXIS1[face]) / down
    y = np.einsum("ij,ij->i", v, _AXIS2[face]) / down
    return face, x + 1j * y


def _edges():
    """Neighbour across each edge with the turn and shift into its plane."""
    faces = np.repeat(np.arange(20), 3)
    corners = to_vector(faces, np.tile(_CORNERS, 20)).reshape(20, 3, 3)
    next_face = np.zeros((20, 3), dtype=np.int64)
    turn, shift = np.zeros((20, 3), dtype=complex), np.zeros((20, 3), dtype=complex)
    sixths = SIXTH ** np.arange(6)
    turns = np.zeros((20, 3), dtype=np.int64)
    for f in range(20):
        for e in range(3):
            ends = corners[f, e], corners[f, (e + 1) % 3]
            for g in range(20):
                near = [np.linalg.norm(corners[g] - c, axis=1) for c in ends]
                if g != f and near[0].min() < 1e-6 and near[1].min() < 1e-6:
                    pa, pb = _CORNERS[e], _CORNERS[(e + 1) % 3]
                    qa, qb = _CORNERS[near[0].argmin()], _CORNERS[near[1].argmin()]
                    n = int(np.abs(sixths - (qb - qa) / (pb - pa)).argmin())
                    next_face[f, e], turns[f, e] = g, n
                    turn[f, e], shift[f, e] = sixths[n], qa - sixths[n] * pa
    return next_face, turn, shift, turns


_NEXT, _TURN, _SHIFT, _TURNS = _edges()


def unfold(face: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move positions beyond their face's edges onto the face they are on."""
    face, p = face.copy(), p.copy()
    for _ in range(6):
        out = (p[..., None] * _NORMALS.conj()).real
        edge = out.argmax(axis=-1)
        move = out.max(axis=-1) > 1.0 + 1e-9
        if not move.any():
            break
        f, e = face[move], edge[move]
        p[move] = p[move] * _TURN[f, e] + _SHIFT[f, e]
        face[move] = _NEXT[f, e]
    return face, p


_HOME_FACE = HOMES[:, 0]
_HOME_A = HOMES[:, 1] - HOMES[:, 3]
_HOME_B = HOMES[:, 2] - HOMES[:, 3]
_HOME_POS = _HOME_A + _HOME_B * W
PENTAGONS = np.flatnonzero(np.abs(_HOME_POS) > 1.5)
_IS_PENTAGON = np.zeros(122, dtype=bool)
_IS_PENTAGON[PENTAGONS] = True
_BASE_VECTOR = to_vector(*unfold(_HOME_FACE, _HOME_POS))


def _fans() -> dict[tuple[int, int], tuple[int, int]]:
    """(pentagon, face) -> (steps around the corner from the home face, turns).

    Counter-clockwise steps keep the plane's directions. Clockwise ones add one
    turn, since the missing sixth lies between them and the home face.
    """
    fans = {}
    for base in PENTAGONS:
        for way, steps in ((1, 3), (-1, 3)):
            face, corner, total = int(_HOME_FACE[base]), 0, 0
            for n in range(steps):
                fans[int(base), face] = (n * way, (-total + (way < 0 and n > 0)) % 6)
                edge = corner if way > 0 else (corner + 2) % 3
                here = _CORNERS[corner] * _TURN[face, edge] + _SHIFT[face, edge]
                total += int(_TURNS[face, edge])
                face = int(_NEXT[face, edge])
                corner = int(np.abs(_CORNERS - here).argmin())
    return fans


def _base_cells():
    """Base cell, turns to its home directions and corner step per (face, a, b)."""
    base = np.full((20, 7, 7), -1)
    turns, step = np.zeros((20, 7, 7), dtype=np.int64), np.zeros((20, 7, 7), dtype=np.int64)
    fans = _fans()
    for f in range(20):
        for a in range(-3, 4):
            for b in range(-3, 4):
                p = a + b * W
                if abs(p) > 2.7:
                    continue
                face, total = f, 0
                while True:
                    out = (p * _NORMALS.conj()).real
                    e = int(out.argmax())
                    if out[e] <= 1.0 + 1e-9:
                        break
                    total += int(_TURNS[face, e])
                    p = p * _TURN[face, e] + _SHIFT[face, e]
                    face = int(_NEXT[face, e])
                v = to_vector(np.array([face]), np.array([p]))
                cell = int((v @ _BASE_VECTOR.T).argmax())
                base[f, a + 3, b + 3] = cell
                if _IS_PENTAGON[cell]:
                    step[f, a + 3, b + 3], extra = fans[cell, face]
                    total += extra
                elif face != _HOME_FACE[cell]:
                    e = int((p * _NORMALS.conj()).real.argmax())
                    total += int(_TURNS[face, e])
                    assert _NEXT[face, e] == _HOME_FACE[cell]
                turns[f, a + 3, b + 3] = total % 6
    return base, turns, step


_BASE, _BASE_TURNS, _BASE_STEP = _base_cells()


def _lattice(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest Eisenstein integer a + b*w."""
    b = p.imag / W.imag
    x, z = p.real + b / 2 - b, b
    y = -x - z
    rx, ry, rz = np.rint(x), np.rint(y), np.rint(z)
    dx, dy, dz = np.abs(rx - x), np.abs(ry - y), np.abs(rz - z)
    rx = np.where((dx > dy) & (dx > dz), -ry - rz, rx)
    rz = np.where((dz > dy) & (dz >= dx), -rx - ry, rz)
    return (rx + rz).astype(np.int64), rz.astype(np.int64)


def _lead(digits: list[np.ndarray], n: int) -> np.ndarray:
    lead = np.zeros(n, dtype=np.int64)
    for d in reversed(digits):
        lead = np.where(d != 0, d, lead)
    return lead


def index(v: np.ndarray, res: int) -> np.ndarray:
    """Cell at ``res`` of every unit vector."""
    return index_at(*from_vector(v), res)


def index_at(face: np.ndarray, p: np.ndarray, res: int) -> np.ndarray:
    """Cell at ``res`` of every position."""
    scale = math.sqrt(7.0) ** res * np.exp(-1j * TURN * (res % 2))
    a, b = _lattice(p * scale)
    digits: list[np.ndarray] = []
    for r in range(res, 0, -1):
        # divide by 2 - w on odd resolutions, by 3 + w on even ones
        if r % 2:
            ua, ub = np.rint((3 * a - b) / 7).astype(np.int64), np.rint((a + 2 * b) / 7).astype(np.int64)
            ca, cb = 2 * ua + ub, 3 * ub - ua
        else:
            ua, ub = np.rint((2 * a + b) / 7).astype(np.int64), np.rint((3 * b - a) / 7).astype(np.int64)
            ca, cb = 3 * ua - ub, ua + 2 * ub
        digits.insert(0, _DIGIT_OF[a - ca + 1, b - cb + 1])
        a, b = ua, ub
    base = _BASE[face, a + 3, b + 3]
    turns = _BASE_TURNS[face, a + 3, b + 3]
    digits = [_TURNED[turns, d] for d in digits]
    gap = _IS_PENTAGON[base] & (_lead(digits, len(base)) == 1)
    if gap.any():
        back = np.where(gap, np.where(_BASE_STEP[face, a + 3, b + 3] >= 0, 1, 5), 0)
        digits = [_TURNED[back, d] for d in digits]
    h = (np.int64(1) << 59) | (np.int64(res) << 52) | (base.astype(np.int64) << 45)
    h = h | np.int64((1 << (3 * (15 - res))) - 1)
    for r, d in enumerate(digits, start=1):
        h = h | (d.astype(np.int64) << (3 * (15 - r)))
    return h


def plane(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Face, centre position, lattice unit (as a complex step) and pentagon flag.

    A pentagon keeps its home face and corner position.
    """
    res, base = (h >> 52) & 15, (h >> 45) & 127
    base = np.minimum(base, 121)
    top = int(res.max()) if len(res) else 0
    digits = [np.where(r <= res, np.minimum((h >> (3 * (15 - r))) & 7, 6), 0) for r in range(1, top + 1)]
    lead = _lead(digits, len(h))
    pentagon = _IS_PENTAGON[base]
    if pentagon.any():
        back = np.where(pentagon & ((lead == 4) | (lead == 5)), 5, 0)
        digits = [_TURNED[back, d] for d in digits]
    p = _HOME_POS[base]
    for r, d in enumerate(digits, start=1):
        p = p + (DIGIT_A[d] + DIGIT_B[d] * W) * np.exp(1j * TURN * (r % 2)) / math.sqrt(7.0) ** r
    unit = np.exp(1j * TURN * (res % 2)) / math.sqrt(7.0) ** res
    corner = pentagon & (lead == 0)
    face, q = unfold(_HOME_FACE[base], p)
    return np.where(corner, _HOME_FACE[base], face), np.where(corner, p, q), unit, corner


def center(h: np.ndarray) -> np.ndarray:
    face, p, _, _ = plane(h)
    return to_vector(face, p)


# Around a pentagon the plane is read from 30 to 330 degrees; the rest is missing.
_AROUND = 2 * np.pi / 6 * np.arange(6)


def neighbours(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) neighbouring cells and a mask of the real ones (five at a pentagon)."""
    face, p, unit, corner = plane(h)
    step = unit[:, None] * np.exp(1j * _AROUND)
    angle = np.angle(step) % (2 * np.pi)
    real = ~corner[:, None] | ((angle > np.radians(29.9)) & (angle < np.radians(329.9)))
    f, q = unfold(np.repeat(face[:, None], 6, axis=1), p[:, None] + step)
    v = to_vector(f, q).reshape(-1, 3)
    out = np.zeros(len(v), dtype=np.int64)
    res = np.repeat((h >> 52) & 15, 6)
    for r in np.unique(res):
        out[res == r] = index(v[res == r], int(r))
    return out.reshape(-1, 6), real


def disk(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 1 + 3k(k + 1)) cells within ``k`` steps, and a mask of the rows this holds for.

    The steps are taken on the plane. Rows without a plane around them are those that reach a corner of the icosahedron,
    and ids that are not spelled as `index` spells them.
    """
    face, p, unit, _ = plane(h)
    far = np.abs(p[:, None] - _CORNERS).min(axis=1) > (k + 1) * np.abs(unit)
    steps = np.array([a + b * W for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a - b) <= k])
    out = np.zeros((len(h), len(steps)), dtype=np.int64)
    res = (h >> 52) & 15
    for r in np.unique(res[far]):
        rows = np.flatnonzero(far & (res == r))
        f, q = unfold(np.repeat(face[rows, None], len(steps), axis=1), p[rows, None] + unit[rows, None] * steps)
        out[rows] = index_at(f.reshape(-1), q.reshape(-1), int(r)).reshape(-1, len(steps))
    return out, far & (out[:, len(steps) // 2] == h)


def ring(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 12, 3) boundary vectors and a mask of the real ones.

    Even slots are corners. Odd slots are the points where a side of an odd
    resolution's cell crosses an edge of the icosahedron.
    """
    face, p, unit, corner = plane(h)
    n = len(h)
    spoke = unit[:, None] * np.exp(1j * (_AROUND + np.pi / 6)) / math.sqrt(3.0)
    # at a pentagon start at the first corner past 30 degrees
    angle = np.angle(spoke) % (2 * np.pi)
    real = ~corner[:, None] | ((angle > np.radians(29.9)) & (angle < np.radians(329.9)))
    start = p[:, None] + spoke
    end = p[:, None] + spoke * SIXTH
    out_a = (start[..., None] * _NORMALS.conj()).real
    out_b = (end[..., None] * _NORMALS.conj()).real
    side = np.where(out_a.max(axis=2) > out_b.max(axis=2), out_a.argmax(axis=2), out_b.argmax(axis=2))
    a = np.take_along_axis(out_a, side[..., None], axis=2)[..., 0]
    b = np.take_along_axis(out_b, side[..., None], axis=2)[..., 0]
    cross = ((a - 1.0) * (b - 1.0) < 0) & (np.abs(a - 1) > 1e-9) & (np.abs(b - 1) > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(cross, (1.0 - a) / (b - a), 0.5)
    # a pentagon's side k crosses the edge that leaves its corner at 90 + 60k degrees
    ray = np.exp(1j * (np.pi / 2 + _AROUND))
    along = ((spoke * np.conj(spoke * SIXTH)).imag) / (
        (ray * np.conj(spoke * SIXTH)).imag + (spoke * np.conj(ray)).imag
    )
    odd = (((h >> 52) & 15) % 2 == 1)[:, None]
    at = np.where(corner[:, None], p[:, None] + ray * along, start + (end - start) * t)
    cross = np.where(corner[:, None], real, cross) & odd
    f = np.repeat(face[:, None], 6, axis=1)
    vectors = np.empty((n, 12, 3))
    vectors[:, 0::2] = to_vector(*unfold(f, start))
    vectors[:, 1::2] = to_vector(*unfold(f, at))
    mask = np.empty((n, 12), dtype=bool)
    mask[:, 0::2], mask[:, 1::2] = real, cross
    return vectors, mask


def area_rads2(h: np.ndarray) -> np.ndarray:
    """Area on the unit sphere: triangles from the centre to each side."""
    c = center(h)
    vectors, mask = ring(h)
    total = np.zeros(len(h))
    first = np.full((len(h), 3), np.nan)
    last = np.full((len(h), 3), np.nan)

    def triangle(a, b):
        with np.errstate(invalid="ignore"):
            top = np.abs(np.einsum("ij,ij->i", c, np.cross(a - c, b - c)))
            low = 1 + np.einsum("ij,ij->i", c, a) + np.einsum("ij,ij->i", a, b) + np.einsum("ij,ij->i", b, c)
            return 2 * np.arctan2(top, low)

    for k in range(12):
        v, here = vectors[:, k], mask[:, k]
        known = here & ~np.isnan(last[:, 0])
        total = np.where(known, total + triangle(last, v), total)
        first = np.where((here & np.isnan(first[:, 0]))[:, None], v, first)
        last = np.where(here[:, None], v, last)
    return total + triangle(last, first)


def to_latlng(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lat = np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1])))
    return lat, np.degrees(np.arctan2(v[..., 1], v[..., 0]))


def from_latlng(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=-1)
