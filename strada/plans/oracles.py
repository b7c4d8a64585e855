"""DuckDB SQL that gives the same rows as the catalogue's queries."""

from __future__ import annotations

import math

from strada.functions import transform

# The view of segments, and what is derived from it.
SEG = """seg AS (
  SELECT CAST(label AS VARCHAR) AS map_id, vec_id * 16 + i AS seg_id,
         500::DOUBLE + 1000::DOUBLE * embedding[4 * i + 1]::DOUBLE AS x1, 500::DOUBLE + 1000::DOUBLE * embedding[4 * i + 2]::DOUBLE AS y1,
         500::DOUBLE + 1000::DOUBLE * embedding[4 * i + 3]::DOUBLE AS x2, 500::DOUBLE + 1000::DOUBLE * embedding[4 * i + 4]::DOUBLE AS y2
  FROM embeddings CROSS JOIN (SELECT unnest(range(16)) AS i)
)"""
ANGLE = f"""(CASE WHEN (CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + {math.pi!r} ELSE atan2(y2 - y1, x2 - x1) END) >= {math.pi!r}
  THEN (CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + {math.pi!r} ELSE atan2(y2 - y1, x2 - x1) END) - {math.pi!r}
  ELSE (CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + {math.pi!r} ELSE atan2(y2 - y1, x2 - x1) END) END)"""
LENGTH = "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"
PIX = (
    SEG
    + """, e1 AS (SELECT map_id, seg_id, round(x1)::BIGINT AS ax, round(y1)::BIGINT AS ay, round(x2)::BIGINT AS bx, round(y2)::BIGINT AS cy FROM seg),
e2 AS (SELECT *, abs(cy - ay) > abs(bx - ax) AS steep FROM e1),
e3 AS (SELECT map_id, seg_id, steep, CASE WHEN steep THEN ay ELSE ax END AS p0, CASE WHEN steep THEN cy ELSE bx END AS p1,
              CASE WHEN steep THEN ax ELSE ay END AS q0, CASE WHEN steep THEN bx ELSE cy END AS q1 FROM e2),
e4 AS (SELECT map_id, seg_id, steep, least(p0, p1) AS a0, abs(p1 - p0) AS n, CASE WHEN p1 < p0 THEN q1 ELSE q0 END AS b0,
              CASE WHEN p1 < p0 THEN q0 - q1 ELSE q1 - q0 END AS m FROM e3),
e5 AS (SELECT *, unnest(range(n + 1)) AS k FROM e4),
e6 AS (SELECT map_id, seg_id, steep, a0 + k AS a, b0 + sign(m) * CASE WHEN n = 0 THEN 0 ELSE (2 * k * abs(m) + n) // (2 * n) END AS b FROM e5),
pix AS (SELECT map_id, seg_id, x, y FROM (
  SELECT map_id, seg_id, (CASE WHEN steep THEN b ELSE a END)::BIGINT AS x, (CASE WHEN steep THEN a ELSE b END)::BIGINT AS y FROM e6)
  WHERE x BETWEEN 0 AND 999 AND y BETWEEN 0 AND 999)"""
)


def _image(ends: str, side: int, pen: str) -> str:
    """dots: the pixels of segments with these whole ends, drawn by a pen."""
    steps = PIX[PIX.index("e2 AS"):].replace("AND 999", f"AND {side - 1}")
    return f"""e1 AS ({ends}), {steps}, dots AS (SELECT DISTINCT map_id, x + dx AS x, y + dy AS y FROM pix, {pen} a(dx), {pen} b(dy) WHERE x + dx BETWEEN 0 AND {side - 1} AND y + dy BETWEEN 0 AND {side - 1})"""


_DOTS = "SELECT map_id, count(*) AS n_pixels, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM dots GROUP BY map_id"
SEEN = (
    PIX
    + f""", tot AS (SELECT map_id, y, x, count(*) AS total FROM pix GROUP BY ALL),
near AS (SELECT map_id, seg_id, x, y, (floor((x - 10) / 15::DOUBLE) + d)::BIGINT AS col, (floor((y - 10) / 15::DOUBLE) + e)::BIGINT AS row_
         FROM pix, (VALUES (0), (1)) t1(d), (VALUES (0), (1)) t2(e)),
kp AS (SELECT *, 10 + 15 * col AS gx, 10 + 15 * row_ AS gy, row_ * 66 + col AS lin FROM near WHERE col BETWEEN 0 AND 65 AND row_ BETWEEN 0 AND 65),
norm AS (SELECT sqrt(4 * sum(exp(-(i * i + j * j) / 225::DOUBLE)) FILTER (i > 0) + 1) AS nr FROM range(16) a(i), range(16) b(j)),
el AS (SELECT kp.map_id, lin, gx, gy, kp.x, kp.y, kp.seg_id, {ANGLE} AS angle_u,
              exp(-((kp.x - gx) * (kp.x - gx) + (kp.y - gy) * (kp.y - gy)) / 450::DOUBLE) / nr / total AS v
       FROM kp JOIN tot ON kp.map_id = tot.map_id AND kp.x = tot.x AND kp.y = tot.y JOIN seg ON kp.map_id = seg.map_id AND kp.seg_id = seg.seg_id, norm
       WHERE kp.x >= gx - 15 AND kp.x < gx + 15 AND kp.y >= gy - 15 AND kp.y < gy + 15),
parts AS (SELECT *, angle_u / {math.pi / 9!r} AS p FROM el)"""
)
_H = ", ".join(
    f"sum(CASE WHEN floor(p)::INT % 9 = {b} THEN v * (1 - (p - floor(p))) WHEN (floor(p)::INT + 1) % 9 = {b} THEN v * (p - floor(p)) ELSE 0 END) AS h{b}" for b in range(9)
)
HIST = SEEN + f", hist AS (SELECT map_id, lin, {_H} FROM parts GROUP BY map_id, lin HAVING count(DISTINCT seg_id) > 10)"
ANGLES = (
    HIST
    + f""", h1 AS (SELECT map_id, lin, [{", ".join(f"h{b}" for b in range(9))}] AS h FROM hist),
h2 AS (SELECT *, list_position(h, list_max(h)) - 1 AS b FROM h1),
h3 AS (SELECT *, h[(b + 8) % 9 + 1] AS hb, h[b + 1] AS hc, h[(b + 1) % 9 + 1] AS ha FROM h2),
angles AS (SELECT map_id, lin, (CASE WHEN q < 0 THEN q + 9 WHEN q >= 9 THEN q - 9 ELSE q END) * {math.pi!r} / 9 AS angle
           FROM (SELECT map_id, lin, (hb - ha) / (2 * (ha - 2 * hc + hb)) + b AS q FROM h3 WHERE ha - 2 * hc + hb <> 0))"""
)
_BIN = f"(CASE WHEN angle_u - angle < 0 THEN angle_u - angle + {math.pi!r} ELSE angle_u - angle END) / {math.pi / 9!r}"
DESC = (
    ANGLES
    + f""", rot AS (SELECT el.map_id, el.lin, v, {_BIN} AS p,
    round_even((x - gx) * cos(angle) + (y - gy) * sin(angle), 0)::INT + 15 AS j, round_even((y - gy) * cos(angle) - (x - gx) * sin(angle), 0)::INT + 15 AS i
  FROM el JOIN angles USING (map_id, lin)),
cells AS (SELECT *, ceil(i / 7::DOUBLE - 0.5::DOUBLE)::INT AS c, 1 - (ceil(i / 7::DOUBLE - 0.5::DOUBLE) - (i / 7::DOUBLE - 0.5::DOUBLE)) AS wx,
    ceil(j / 7::DOUBLE - 0.5::DOUBLE)::INT AS r, 1 - (ceil(j / 7::DOUBLE - 0.5::DOUBLE) - (j / 7::DOUBLE - 0.5::DOUBLE)) AS wy
  FROM rot WHERE i BETWEEN 0 AND 29 AND j BETWEEN 0 AND 29),
shares AS (SELECT map_id, lin, r - dr AS r, c - dc AS c, (floor(p)::INT + up) % 9 AS b,
    v * (CASE WHEN up = 1 THEN p - floor(p) ELSE 1 - (p - floor(p)) END) * (CASE WHEN dr = 1 THEN 1 - wy ELSE wy END) * (CASE WHEN dc = 1 THEN 1 - wx ELSE wx END) AS v
  FROM cells, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc), (VALUES (0), (1)) u(up)),
entries AS (SELECT map_id, lin, r, c, b, sum(v) AS v FROM shares WHERE r BETWEEN 0 AND 3 AND c BETWEEN 0 AND 3 GROUP BY ALL),
halves AS (SELECT map_id, lin, coalesce(sum(v) FILTER (b = 0 AND r < 2), 0) AS first, coalesce(sum(v) FILTER (b = 0 AND r >= 2), 0) AS last FROM entries GROUP BY ALL),
turned AS (SELECT map_id, lin, CASE WHEN last > first THEN 'keep' ELSE 'switch' END AS decision,
    (CASE WHEN last > first THEN r * 4 + c ELSE 15 - (r * 4 + c) END) * 9 + b AS pos, v FROM entries JOIN halves USING (map_id, lin) WHERE last <> first),
n1 AS (SELECT *, least(v / sqrt(sum(v * v) OVER (PARTITION BY map_id, lin)), 0.15::DOUBLE) AS v1 FROM turned),
vec AS (SELECT map_id, lin, decision, pos, v1 / sqrt(sum(v1 * v1) OVER (PARTITION BY map_id, lin)) AS v FROM n1)"""
)


def _described(k: int, pix: str, r: int, side: int, angle: float | None = None) -> str:
    """vec{k}: (map_id, lin, decision, pos, v) of descriptors of radius r of a level's pixels (map_id, seg_id, x, y, cnt)."""
    off, cell = int(0.7 * r), 2 * r // 4
    n = math.ceil((side - 2 * off) / r)
    own = f"angles{k} AS (SELECT map_id, lin, {angle!r}::DOUBLE AS angle FROM hist{k})"
    if angle is None:
        own = f"""ha{k} AS (SELECT map_id, lin, [{", ".join(f"h{b}" for b in range(9))}] AS h FROM hist{k}),
hb{k} AS (SELECT *, list_position(h, list_max(h)) - 1 AS b FROM ha{k}),
hc{k} AS (SELECT *, h[(b + 8) % 9 + 1] AS hb, h[b + 1] AS hc, h[(b + 1) % 9 + 1] AS ha FROM hb{k}),
angles{k} AS (SELECT map_id, lin, (CASE WHEN q < 0 THEN q + 9 WHEN q >= 9 THEN q - 9 ELSE q END) * {math.pi!r} / 9 AS angle
  FROM (SELECT map_id, lin, (hb - ha) / (2 * (ha - 2 * hc + hb)) + b AS q FROM hc{k} WHERE ha - 2 * hc + hb <> 0))"""
    at = lambda v: f"({v} / {cell}::DOUBLE - 0.5::DOUBLE)"
    return f"""lev{k} AS ({pix}), tot{k} AS (SELECT map_id, y, x, sum(cnt) AS total FROM lev{k} GROUP BY ALL),
kp{k} AS (SELECT *, {off} + {r} * col AS gx, {off} + {r} * row_ AS gy, row_ * {n} + col AS lin FROM (
  SELECT map_id, seg_id, x, y, cnt, (floor((x - {off}) / {r}::DOUBLE) + d)::BIGINT AS col, (floor((y - {off}) / {r}::DOUBLE) + e)::BIGINT AS row_ FROM lev{k}, (VALUES (0), (1)) t1(d), (VALUES (0), (1)) t2(e))
  WHERE col BETWEEN 0 AND {n - 1} AND row_ BETWEEN 0 AND {n - 1}),
norm{k} AS (SELECT sqrt(4 * sum(exp(-(i * i + j * j) / {r * r}::DOUBLE)) FILTER (i > 0) + 1) AS nr FROM range({r + 1}) a(i), range({r + 1}) b(j)),
el{k} AS (SELECT p.map_id, lin, gx, gy, p.x, p.y, p.seg_id, {ANGLE} AS angle_u, cnt * exp(-((p.x - gx) * (p.x - gx) + (p.y - gy) * (p.y - gy)) / {2 * r * r}::DOUBLE) / nr / total AS v
  FROM kp{k} p JOIN tot{k} t ON p.map_id = t.map_id AND p.x = t.x AND p.y = t.y JOIN seg ON p.map_id = seg.map_id AND p.seg_id = seg.seg_id, norm{k}
  WHERE p.x >= gx - {r} AND p.x < gx + {r} AND p.y >= gy - {r} AND p.y < gy + {r}),
hist{k} AS (SELECT map_id, lin, {_H} FROM (SELECT *, angle_u / {math.pi / 9!r} AS p FROM el{k}) GROUP BY map_id, lin HAVING count(DISTINCT seg_id) > 10),
{own},
rot{k} AS (SELECT el.map_id, el.lin, v, {_BIN} AS p, round_even((x - gx) * cos(angle) + (y - gy) * sin(angle), 0)::INT + {r} AS j, round_even((y - gy) * cos(angle) - (x - gx) * sin(angle), 0)::INT + {r} AS i
  FROM el{k} el JOIN angles{k} USING (map_id, lin)),
cells{k} AS (SELECT *, ceil{at('i')}::INT AS c, 1 - (ceil{at('i')} - {at('i')}) AS wx, ceil{at('j')}::INT AS r, 1 - (ceil{at('j')} - {at('j')}) AS wy FROM rot{k} WHERE i BETWEEN 0 AND {2 * r - 1} AND j BETWEEN 0 AND {2 * r - 1}),
shares{k} AS (SELECT map_id, lin, r - dr AS r, c - dc AS c, (floor(p)::INT + up) % 9 AS b,
    v * (CASE WHEN up = 1 THEN p - floor(p) ELSE 1 - (p - floor(p)) END) * (CASE WHEN dr = 1 THEN 1 - wy ELSE wy END) * (CASE WHEN dc = 1 THEN 1 - wx ELSE wx END) AS v
  FROM cells{k}, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc), (VALUES (0), (1)) u(up)),
entries{k} AS (SELECT map_id, lin, r, c, b, sum(v) AS v FROM shares{k} WHERE r BETWEEN 0 AND 3 AND c BETWEEN 0 AND 3 GROUP BY ALL),
halves{k} AS (SELECT map_id, lin, coalesce(sum(v) FILTER (b = 0 AND r < 2), 0) AS first, coalesce(sum(v) FILTER (b = 0 AND r >= 2), 0) AS last FROM entries{k} GROUP BY ALL),
turned{k} AS (SELECT map_id, lin, CASE WHEN last > first THEN 'keep' ELSE 'switch' END AS decision,
    (CASE WHEN last > first THEN r * 4 + c ELSE 15 - (r * 4 + c) END) * 9 + b AS pos, v FROM entries{k} JOIN halves{k} USING (map_id, lin) WHERE last <> first),
n1{k} AS (SELECT *, least(v / sqrt(sum(v * v) OVER (PARTITION BY map_id, lin)), 0.15::DOUBLE) AS v1 FROM turned{k}),
vec{k} AS (SELECT map_id, lin, decision, pos, v1 / sqrt(sum(v1 * v1) OVER (PARTITION BY map_id, lin)) AS v FROM n1{k})"""


_LEVEL = "SELECT map_id, seg_id, x // {z} AS x, y // {z} AS y, count(*) AS cnt FROM pix GROUP BY ALL"
#: (level, radius) of two octaves with all their radii.
_OCTAVES = [(level, r) for level in (0, 1) for r in (15, 19, 24)]
#: All numbers of a descriptor, in hundred thousandths, as one digest.
_DIGEST = "md5(string_agg(pos || ':' || round(v * 100000)::BIGINT, ',' ORDER BY pos)) AS digest"


def _hashed(seed: int, *of: str) -> str:
    """A number in (0, 1) from a digest."""
    return f"(('0x' || substr(md5({' || '.join(f'{c} || chr(47)' for c in of)} || '{seed}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"


def _normal(seed: int, *of: str) -> str:
    return f"(sqrt(-2 * ln({_hashed(seed, *of)})) * cos({2 * math.pi!r} * {_hashed(-1 - seed, *of)}))"


_ID2 = ("map_id", "seg_id")


def _moved(src: str, sd: float, *seeds: int) -> str:
    return f"SELECT map_id, seg_id, {', '.join(f'{c} + {_normal(q, *_ID2)} * {sd!r}::DOUBLE AS {c}' for c, q in zip(('x1', 'y1', 'x2', 'y2'), seeds))} FROM {src}"


def _left(share: float, seed: int) -> str:
    return f"SELECT map_id, seg_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY md5(seg_id || '/{seed}'), seg_id) AS place, count(*) OVER (PARTITION BY map_id) AS n FROM seg) WHERE place > round(n * {share!r}::DOUBLE)"


def _extra(share: float, length: float, sd: float, seed: int) -> str:
    of = ("map_id", "i")
    return f"""SELECT map_id, next_id + i AS seg_id, x1, y1, x1 + l * cos(a) AS x2, y1 + l * sin(a) AS y2 FROM (
  SELECT map_id, i, next_id, {_hashed(seed, *of)} * 1000 AS x1, {_hashed(seed + 1, *of)} * 1000 AS y1, {_normal(seed + 2, *of)} * {sd!r}::DOUBLE + {length!r}::DOUBLE AS l, {_hashed(seed + 3, *of)} * {2 * math.pi!r} AS a
  FROM (SELECT map_id, max(seg_id) + 1 AS next_id, unnest(range(round(count(*) * {share!r}::DOUBLE)::BIGINT)) AS i FROM seg GROUP BY map_id))"""


KNN = """near AS (
  SELECT q.vec_id AS qid, r.vec_id AS rid, CAST(r.label AS VARCHAR) AS ref_id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS dist
  FROM embeddings q, embeddings r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0
), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rn FROM near) WHERE rn <= 2)"""
MATCH = KNN + """, m AS (
  SELECT a.qid, a.rid, a.ref_id FROM knn a JOIN knn b ON a.qid = b.qid WHERE a.rn = 1 AND b.rn = 2 AND a.dist < b.dist * 0.95::DOUBLE)"""
_MOD = f"(CASE WHEN fmod(e4 * 10, {math.pi!r}) < 0 THEN fmod(e4 * 10, {math.pi!r}) + {math.pi!r} ELSE fmod(e4 * 10, {math.pi!r}) END)"
ROWS = (
    MATCH
    + f""", k0 AS (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3, embedding[4]::DOUBLE AS e4 FROM embeddings),
key AS (SELECT vec_id, 500 + 1000 * e1 AS x, 500 + 1000 * e2 AS y, 15 + abs(e3) * 100 AS s, {_MOD} AS o FROM k0),
rws AS (SELECT m.*, r.x AS xr, r.y AS yr, r.s AS sr, r.o AS o_r, t.x AS xt, t.y AS yt, t.s AS st, t.o AS o_t,
    power(2 / (r.s / 1000 + t.s / 1000), 2) AS w FROM m JOIN key t ON t.vec_id = qid JOIN key r ON r.vec_id = rid)"""
)


def _fit(source: str, keys: str, out: str = "model", tag: str = "") -> str:
    """Centred weighted least squares of source (keys, xr, yr, xt, yt, w), as `out`."""
    return f"""c1{tag} AS (SELECT {keys}, count(*) AS n, sum(w * xr) / sum(w) AS mxr, sum(w * yr) / sum(w) AS myr, sum(w * xt) / sum(w) AS mxt, sum(w * yt) / sum(w) AS myt FROM {source} GROUP BY {keys}),
c2{tag} AS (SELECT {keys}, n, mxr, myr, mxt, myt, sum(w * ((xr - mxr) * (xt - mxt) + (yr - myr) * (yt - myt))) AS re, sum(w * ((yr - myr) * (xt - mxt) - (xr - mxr) * (yt - myt))) AS im,
    sum(w * ((xt - mxt) * (xt - mxt) + (yt - myt) * (yt - myt))) AS tt, sum(w * ((xr - mxr) * (xr - mxr) + (yr - myr) * (yr - myr))) AS rr FROM {source} JOIN c1{tag} USING ({keys}) GROUP BY {keys}, n, mxr, myr, mxt, myt),
c3{tag} AS (SELECT {keys}, mxr, myr, mxt, myt, re / tt AS a, im / tt AS b FROM c2{tag} WHERE n >= 2 AND tt > 1e-9 AND (n > 2 OR rr > 1e-9)),
{out} AS MATERIALIZED (SELECT {keys}, mxr - (a * mxt - b * myt) AS tx, myr - (a * myt + b * mxt) AS ty, sqrt(a * a + b * b) AS s, CASE WHEN atan2(b, a) >= {math.pi!r} THEN atan2(b, a) - {2 * math.pi!r} ELSE atan2(b, a) END AS o FROM c3{tag})"""


def _hypotheses(rows: str, keys: str, of_test: str) -> str:
    """Models of sampled pairs of matches, each map (keys) having its share of the test map's 1000."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY qid) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {rows}),
enough AS (SELECT * FROM num WHERE cnt >= 2),
cnts AS (SELECT *, sum(cnt) OVER ({of_test}) AS every FROM (SELECT DISTINCT {keys}, cnt FROM enough)),
hyps AS (SELECT {keys}, cnt, unnest(range(greatest(1, floor(1000 * cnt / every::DOUBLE)::BIGINT))) AS hyp FROM cnts),
picks AS (SELECT {keys}, hyp, (hyp * 7919 + 13) % cnt AS i, ((hyp * 7919 + 13) % cnt + 1 + (hyp * 104729) % (cnt - 1)) % cnt AS j FROM hyps),
pair AS (SELECT hyp, e.* FROM picks JOIN enough e USING ({keys}) WHERE e.k IN (i, j)), """ + _fit("pair", keys + ", hyp")


HYP = ROWS + ", " + _hypotheses("rws", "ref_id", "")
_TURN = f"o_r - (CASE WHEN fmod(o_t + o, {math.pi!r}) < 0 THEN fmod(o_t + o, {math.pi!r}) + {math.pi!r} ELSE fmod(o_t + o, {math.pi!r}) END)"
#: Whether a match agrees with the model in the same row, with dtol 8 and atol 0.2.
_AGREES = f"""(abs(CASE WHEN {_TURN} < -{math.pi / 2!r} THEN {_TURN} + {math.pi!r} WHEN {_TURN} >= {math.pi / 2!r} THEN {_TURN} - {math.pi!r} ELSE {_TURN} END) / {2 * math.pi!r} <= 0.2 AND coalesce(
    (power(s * (cos(o) * xt - sin(o) * yt) + tx - xr, 2) + power(s * (sin(o) * xt + cos(o) * yt) + ty - yr, 2)) / 1e6
    + (power((cos(o) * (xr - tx) + sin(o) * (yr - ty)) / nullif(s, 0) - xt, 2) + power((cos(o) * (yr - ty) - sin(o) * (xr - tx)) / nullif(s, 0) - yt, 2)) / 1e6
    < 64 * (power(sr / 1000, 2) + power(st / 1000, 2)), false))"""


def _counted(rows: str, keys: str) -> str:
    return f"cntd AS (SELECT {keys}, hyp, sum({_AGREES}::BIGINT)::BIGINT AS n_inliers FROM {rows} JOIN model USING ({keys}) GROUP BY {keys}, hyp)"


def _best(keys: str) -> str:
    return f"best AS (SELECT {keys}, hyp, n_inliers FROM cntd WHERE n_inliers > 0 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n_inliers DESC, hyp) = 1)"


INLIER = HYP + ", " + _counted("rws", "ref_id")
# Two test maps: matches told apart by their test descriptor.
MANY = (
    ROWS + ", two AS (SELECT *, CASE WHEN qid % 10 = 0 THEN 'even' ELSE 'odd' END AS test_id FROM rws), " + _hypotheses("two", "test_id, ref_id", "PARTITION BY test_id")
    + ", " + _counted("two", "test_id, ref_id") + ", " + _best("test_id, ref_id")
)


def _refits() -> str:
    """Ten refits on the inliers of the model before; once the inliers stay the same, so does the model."""
    parts = ["m0 AS MATERIALIZED (SELECT ref_id, tx, ty, s, o FROM model JOIN best USING (ref_id, hyp) WHERE (SELECT max(n_inliers) FROM best) < 30 OR n_inliers >= 30)"]
    for k in range(11):
        parts.append(f"i{k} AS MATERIALIZED (SELECT rws.*, tx, ty, s, o FROM rws JOIN m{k} USING (ref_id) WHERE {_AGREES})")
        if k < 10:
            parts.append(_fit(f"i{k}", "ref_id", f"m{k + 1}", f"_{k}"))
    return ", ".join(parts)


_VIS = "(least(999, {x} + {s}) - greatest(0, {x} - {s} + 1)) * (least(999, {y} + {s}) - greatest(0, {y} - {s} + 1)) / power(2 * {s}, 2)"
VIS = ROWS + f""", vis AS (SELECT ref_id, {_VIS.format(x="xt", y="yt", s="st")} AS t, {_VIS.format(x="xr", y="yr", s="sr")} AS r FROM rws)"""


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) + 0::DOUBLE AS {name}"


def _xy(*es: str) -> str:
    return ", ".join(r6(e, n) for e, n in zip(es, ("x1", "y1", "x2", "y2")))


def _projected(m, scale: float = 1.0) -> list[str]:
    out = []
    for n in "12":
        x, y = f"(x{n} * {scale!r})", f"(y{n} * {scale!r})"
        rows = [f"({float(a)!r}::DOUBLE * {x} + {float(b)!r}::DOUBLE * {y} + {float(t)!r}::DOUBLE)" for a, b, t in m]
        out += [f"{rows[0]} / {rows[2]}", f"{rows[1]} / {rows[2]}"] if len(rows) == 3 else rows
    return out


_AFFINE, _ = transform.image_rotation(1000, 1000, 30.0)
_VIEW, _ = transform.perspective(1000, 1000, 800, (20.0, -15.0, 10.0))
_VIEW8, _ = transform.perspective(800, 800, 800, (20.0, -15.0, 10.0))
WKT = SEG + """, n AS (SELECT map_id, seg_id, (floor(x1) - 400)::INT AS a, (floor(y1) - 400)::INT AS b, (floor(x2) - 400)::INT AS c, (floor(y2) - 400)::INT AS d FROM seg)"""
PAIRS = SEG + """, two AS (SELECT a.*, b.x1 AS x1b, b.y1 AS y1b, b.x2 AS x2b, b.y2 AS y2b FROM seg a JOIN seg b ON b.seg_id = a.seg_id + 1 WHERE a.seg_id % 16 <> 15),
l AS (SELECT *, y2 - y1 AS a1, x1 - x2 AS b1, -(x1 * y2 - y1 * x2) AS c1, y2b - y1b AS a2, x1b - x2b AS b2, -(x1b * y2b - y1b * x2b) AS c2 FROM two),
h AS (SELECT *, b1 * c2 - c1 * b2 AS hx, c1 * a2 - a1 * c2 AS hy, a1 * b2 - b1 * a2 AS hw FROM l)"""


def _on(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay}) >= 0 AND ({x} - {ax}) * ({x} - {ax}) + ({y} - {ay}) * ({y} - {ay}) <= ({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


def _side(ax: float, ay: float, bx: float, by: float) -> str:
    """Where a segment meets one side of the rectangle, as a struct or null."""
    a2, b2, c2 = by - ay, ax - bx, -(ax * by - ay * bx)
    hx, hy, hw = f"(b1 * ({c2!r}) - c1 * ({b2!r}))", f"(c1 * ({a2!r}) - a1 * ({c2!r}))", f"(a1 * ({b2!r}) - b1 * ({a2!r}))"
    x, y = f"({hx} / nullif({hw}, 0))", f"({hy} / nullif({hw}, 0))"
    ends = [f"({v!r}::DOUBLE)" for v in (ax, ay, bx, by)]
    return f"CASE WHEN abs({hw}) >= 1e-7 AND {_on(x, y, 'x1', 'y1', 'x2', 'y2')} AND {_on(x, y, *ends)} THEN {{'x': {x}, 'y': {y}}} END"


_RECT = (450.0, 470.0, 540.0, 560.0)
_L, _T, _R, _B = _RECT
CLIP = SEG + f""", l AS (SELECT *, y2 - y1 AS a1, x1 - x2 AS b1, -(x1 * y2 - y1 * x2) AS c1 FROM seg),
p AS (SELECT map_id, seg_id, list_filter([
    CASE WHEN x1 BETWEEN {_L} AND {_R} AND y1 BETWEEN {_T} AND {_B} THEN {{'x': x1, 'y': y1}} END, CASE WHEN x2 BETWEEN {_L} AND {_R} AND y2 BETWEEN {_T} AND {_B} THEN {{'x': x2, 'y': y2}} END,
    {_side(_L, _T, _L, _B)}, {_side(_R, _T, _R, _B)}, {_side(_L, _T, _R, _T)}, {_side(_L, _B, _R, _B)}], lambda q: q IS NOT NULL) AS q FROM l)"""
_DENS = "(SELECT i AS step, 15::DOUBLE * power(1.5::DOUBLE, i) AS s FROM range({n}) t(i))"
DENSITY = PIX + """, road AS (SELECT DISTINCT map_id, y, x FROM pix), sizes AS (SELECT * FROM {sizes}),
tile AS (SELECT map_id, step, s, y // floor(s)::BIGINT AS i, x // floor(s)::BIGINT AS j, count(*) AS n FROM road, sizes
  WHERE y // floor(s)::BIGINT < ceil(1000 / s) AND x // floor(s)::BIGINT < ceil(1000 / s) GROUP BY ALL),
dens AS (SELECT map_id, step, s, max(n)::DOUBLE / sum(n) AS density FROM tile GROUP BY ALL)"""
_F = "floor({})"


def _cond(lat: bool) -> str:
    src = "SELECT map_id, seg_id, x1 / 10 AS x1, y1 / 10 AS y1, x2 / 10 AS x2, y2 / 10 AS y2 FROM seg" if lat else "SELECT * FROM seg"
    e, n = ("y", "x") if lat else ("x", "y")
    return f"""WITH {SEG}, raw AS ({src}),
box AS (SELECT map_id, min(least(x1, x2)) AS xn, max(greatest(x1, x2)) AS xx, min(least(y1, y2)) AS yn, max(greatest(y1, y2)) AS yx FROM raw GROUP BY map_id),
sc AS (SELECT map_id, {e}n AS e0, {n}n AS n0, greatest({e}x - {e}n, {n}x - {n}n) AS side, ({n}x - {n}n) AS tall FROM box)
SELECT map_id, seg_id, {_xy(f"({e}1 - e0) / side", f"(tall - ({n}1 - n0)) / side", f"({e}2 - e0) / side", f"(tall - ({n}2 - n0)) / side")} FROM raw JOIN sc USING (map_id)"""


_TX, _TY, _S, _O = 120.0, -45.0, 1.25, 0.3
_MODELCOLS = "round(tx, 4) + 0::DOUBLE AS tx, round(ty, 4) + 0::DOUBLE AS ty, round(s, 6) + 0::DOUBLE AS s, round(o, 6) + 0::DOUBLE AS o"
_INV = ", ".join(
    f"round_even(cos({_O!r}::DOUBLE) * ((x{n} - {_TX}) / {_S}) + sin({_O!r}::DOUBLE) * ((y{n} - ({_TY})) / {_S}), 0)::BIGINT AS x{n}, round_even(cos({_O!r}::DOUBLE) * ((y{n} - ({_TY})) / {_S}) - sin({_O!r}::DOUBLE) * ((x{n} - {_TX}) / {_S}), 0)::BIGINT AS y{n}"
    for n in "12"
)
_SVG = """'<line x1="' || floor(x1)::BIGINT || '.0" y1="' || floor(y1)::BIGINT || '.0" x2="' || floor(x2)::BIGINT || '.0" y2="' || floor(y2)::BIGINT || '.0" />'"""

ORACLES: dict[str, str] = {
    "fuzz_missing": f"WITH {SEG} SELECT map_id, seg_id FROM ({_left(0.1, 5)})",
    "fuzz_jitter": f"WITH {SEG} SELECT map_id, seg_id, {_xy('x1', 'y1', 'x2', 'y2')} FROM ({_moved('seg', 1.0, 5, 6, 7, 8)})",
    "fuzz_inaccuracy": f"WITH {SEG} SELECT map_id, seg_id, {_xy('x1', 'y1', 'x2', 'y2')} FROM ({_moved('seg', 1.0, 5, 6, 5, 6)})",
    "fuzz_extra": f"WITH {SEG} SELECT map_id, seg_id, {_xy('x1', 'y1', 'x2', 'y2')} FROM ({_extra(0.1, 40.0, 20.0, 5)})",
    "fuzz_all": f"""WITH {SEG}, f1 AS ({_left(0.1, 7)}), f2 AS ({_moved('f1', 1.0, 17, 18, 19, 20)}), f3 AS ({_moved('f2', 2.0, 27, 28, 27, 28)})
      SELECT map_id, seg_id, {_xy('x1', 'y1', 'x2', 'y2')} FROM (SELECT * FROM f3 UNION ALL {_extra(0.05, 40.0, 20.0, 37)})""",
    "shift_segments": f"WITH {SEG} SELECT seg_id, {_xy('x1 - 12.5', 'y1 + 7.25', 'x2 - 12.5', 'y2 + 7.25')} FROM seg",
    "map_image_pixels": f"""WITH {SEG}, {_image("SELECT map_id, seg_id, " + ", ".join(f"trunc({c} * 0.001::DOUBLE * 800)::BIGINT AS {a}" for c, a in zip(("x1", "y1", "x2", "y2"), ("ax", "ay", "bx", "cy")))
      + " FROM seg WHERE sqrt(power((x1 - x2) * 0.001::DOUBLE, 2) + power((y1 - y2) * 0.001::DOUBLE, 2)) >= 0.05", 800, "(VALUES (0), (1))")} {_DOTS}""",
    "wide_pixels": f"""WITH {SEG}, {_image("SELECT map_id, seg_id, round(x1)::BIGINT AS ax, round(y1)::BIGINT AS ay, round(x2)::BIGINT AS bx, round(y2)::BIGINT AS cy FROM seg", 1000, "(VALUES (-1), (0), (1))")} {_DOTS}""",
    "match_picture": f"""WITH {ROWS}, t AS (SELECT ref_id, qid, trunc(xr)::INT AS xr, trunc(yr)::INT AS yr, trunc(xt)::INT + 1000 AS xt, trunc(yt)::INT AS yt, trunc(sr)::INT AS sr, trunc(st)::INT AS st FROM rws)
      SELECT ref_id, qid, 'line' AS shape, xr AS x1, yr AS y1, xt AS x2, yt AS y2, -1 AS radius FROM t
      UNION ALL SELECT ref_id, qid, 'ref', xr, yr, -1, -1, sr FROM t UNION ALL SELECT ref_id, qid, 'test', xt, yt, -1, -1, st FROM t""",
    "npy_round_trip": f"WITH {SEG} SELECT map_id, count(*) AS n, count(*) - 1 AS last, {_xy('sum(x1)', 'sum(y1)', 'sum(x2)', 'sum(y2)')} FROM seg GROUP BY map_id",
    "lrp_descriptor_entries": f"""WITH {PIX}, {", ".join(_described(k, _LEVEL.format(z=2**level), r, 1000 >> level) for k, (level, r) in enumerate(_OCTAVES))}
      SELECT level::INT AS level, radius::INT AS radius, map_id, lin::INT AS lin, count(*) AS n, {_DIGEST}
      FROM ({" UNION ALL ".join(f"SELECT {level} AS level, {r} AS radius, * FROM vec{k}" for k, (level, r) in enumerate(_OCTAVES))}) WHERE round(v * 100000) <> 0 GROUP BY ALL""",
    "lrp_descriptor_override": f"""WITH {PIX}, {_described(0, _LEVEL.format(z=1), 15, 1000, 0.5)}
      SELECT map_id, lin::INT AS lin, decision, count(*) AS n, {_DIGEST} FROM vec0 WHERE round(v * 100000) <> 0 GROUP BY ALL""",
    "parse_wkt_osgb36": f"WITH {WKT} SELECT map_id, seg_id, a::DOUBLE AS x1, b::DOUBLE AS y1, c::DOUBLE AS x2, d::DOUBLE AS y2 FROM n WHERE seg_id % 7 <> 0 AND least(a, b, c, d) >= 0",
    "parse_wkt_latlong": f"WITH {WKT} SELECT map_id, seg_id, b::DOUBLE AS x1, a::DOUBLE AS y1, d::DOUBLE AS x2, c::DOUBLE AS y2 FROM n WHERE seg_id % 7 <> 0",
    "condition_osgb36": _cond(False),
    "condition_latlong": _cond(True),
    "earth_radius": f"""SELECT lat, round(sqrt((power(a * a * cos(phi), 2) + power(b * b * sin(phi), 2)) / (power(a * cos(phi), 2) + power(b * sin(phi), 2))), 3) AS r
      FROM (SELECT lat, {math.pi!r} * lat / 180 AS phi, 6378137::DOUBLE AS a, 6356752.3::DOUBLE AS b FROM range(-90, 91) t(lat))""",
    "seg_lengths": f"WITH {SEG} SELECT seg_id, {r6(LENGTH, 'value')} FROM seg",
    "seg_angles_oriented": f"WITH {SEG} SELECT seg_id, {r6(f'fmod(atan2(y2 - y1, x2 - x1) + {2 * math.pi!r}, {2 * math.pi!r})', 'value')} FROM seg",
    "seg_angles_unoriented": f"WITH {SEG} SELECT seg_id, {r6(ANGLE, 'value')} FROM seg",
    "filter_length": f"WITH {SEG}, n AS (SELECT map_id, sqrt(power((x1 - x2) * 0.001::DOUBLE, 2) + power((y1 - y2) * 0.001::DOUBLE, 2)) AS l FROM seg) SELECT map_id, count(*) FILTER (l >= 0.2) AS n_displayed, count(*) FILTER (l >= 0.3) AS n_described FROM n GROUP BY map_id",
    "seg_bounds": f"WITH {SEG} SELECT map_id, {r6('min(least(x1, x2))', 'xmin')}, {r6('min(least(y1, y2))', 'ymin')}, {r6('max(greatest(x1, x2)) + 1', 'xmax')}, {r6('max(greatest(y1, y2)) + 1', 'ymax')} FROM seg GROUP BY map_id",
    "seg_bounds_large": f"""WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS map_id, l_quantity * 20 AS x1, l_extendedprice / 105 AS y1, l_quantity * 20 + 1000 * (l_discount - 0.05::DOUBLE) AS x2, l_extendedprice / 105 + 1000 * (l_tax - 0.04::DOUBLE) AS y2 FROM lineitem)
      SELECT map_id, {r6('min(least(x1, x2))', 'xmin')}, {r6('min(least(y1, y2))', 'ymin')}, {r6('max(greatest(x1, x2)) + 1', 'xmax')}, {r6('max(greatest(y1, y2)) + 1', 'ymax')} FROM g GROUP BY map_id""",
    "seg2line": f"WITH {SEG} SELECT seg_id, round(y2 - y1, 3) AS a, round(x1 - x2, 3) AS b, round(-(x1 * y2 - y1 * x2), 3) AS c FROM seg",
    "line_intersect_homog": f"WITH {PAIRS} SELECT seg_id, round(hx, 1) AS hx, round(hy, 1) AS hy, round(hw, 1) AS hw FROM h",
    "intersect_segments": f"""WITH {PAIRS}, g AS (SELECT *, hx / nullif(hw, 0) AS x, hy / nullif(hw, 0) AS y FROM h),
      i AS (SELECT seg_id, x, y, abs(hw) >= 1e-7 AND {_on('x', 'y', 'x1', 'y1', 'x2', 'y2')} AND {_on('x', 'y', 'x1b', 'y1b', 'x2b', 'y2b')} AS ok FROM g)
      SELECT seg_id, {r6('CASE WHEN ok THEN x END', 'x')}, {r6('CASE WHEN ok THEN y END', 'y')} FROM i""",
    "clip_to_rect": f"WITH {CLIP} SELECT map_id, seg_id, {_xy('q[1].x', 'q[1].y', 'q[2].x', 'q[2].y')}, q[1].x = q[2].x AND q[1].y = q[2].y AS is_degenerate FROM p WHERE len(q) >= 2",
    "transform_affine": f"WITH {SEG} SELECT seg_id, {_xy(*_projected(_AFFINE))} FROM seg",
    "transform_perspective": f"WITH {SEG} SELECT seg_id, {_xy(*_projected(_VIEW))} FROM seg",
    "perspective_segments": f"WITH {SEG}, n AS (SELECT *, sqrt(power((x1 - x2) * 0.001::DOUBLE, 2) + power((y1 - y2) * 0.001::DOUBLE, 2)) AS l FROM seg) SELECT map_id, seg_id, {_xy(*_projected(_VIEW8, 0.8))}, l >= 0.2 AS is_described FROM n WHERE l >= 0.05",
    "imager_scaled_described": f"WITH {SEG}, n AS (SELECT *, sqrt(power((x1 - x2) * 0.001::DOUBLE, 2) + power((y1 - y2) * 0.001::DOUBLE, 2)) AS l FROM seg) SELECT map_id, seg_id, {_xy('x1 * 1.2::DOUBLE', 'y1 * 1.2::DOUBLE', 'x2 * 1.2::DOUBLE', 'y2 * 1.2::DOUBLE')} FROM n WHERE l >= 0.2",
    "metric_distance": f"WITH {SEG} SELECT seg_id, {r6(f'{LENGTH} / (1000 * 0.0005::DOUBLE)', 'd')} FROM seg",
    "pixel_distance": f"WITH {SEG} SELECT seg_id, {r6(f'{LENGTH} * (1000 * 0.0005::DOUBLE)', 'd')} FROM seg",
    "rasterize_segments": f"WITH {PIX} SELECT map_id, count(*) AS n_pixels, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM pix GROUP BY map_id",
    "pixel_multiset": f"WITH {PIX} SELECT map_id, y, x, count(DISTINCT seg_id) AS n_segs, count(*) AS total FROM pix GROUP BY ALL",
    "downsample_pyramid": f"WITH {PIX}, lv AS (SELECT map_id, k::INT AS level, y // (1 << k) AS y, x // (1 << k) AS x, count(*) AS t FROM pix, range(4) r(k) GROUP BY ALL) SELECT map_id, level, count(*) AS n_pixels, sum(t)::BIGINT AS total FROM lv GROUP BY ALL",
    "map_density": f"WITH {DENSITY.format(sizes=_DENS.format(n=8))} SELECT map_id, step::INT AS step, {r6('density', 'density')} FROM dens",
    "density_optimal_size": f"""WITH {DENSITY.format(sizes=_DENS.format(n=13))}, lagged AS (SELECT *, lag(s) OVER w AS s0, lag(density) OVER w AS d0 FROM dens WINDOW w AS (PARTITION BY map_id ORDER BY step)),
      hit AS (SELECT * FROM lagged WHERE density >= 0.05 QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY step) = 1)
      SELECT map_id, trunc(CASE WHEN s0 IS NULL THEN s ELSE s0 + (0.05::DOUBLE - d0) * (s - s0) / (density - d0) END)::INT AS size FROM hit""",
    "grid_points": """WITH l AS (SELECT level, radius, 1000 >> level AS w, 800 >> level AS h, trunc(radius * 0.7::DOUBLE)::INT AS off FROM range(3) a(level), (VALUES (15), (19), (24)) b(radius)),
      c AS (SELECT *, ceil((w - 2 * off) / radius::DOUBLE)::INT AS nc, ceil((h - 2 * off) / radius::DOUBLE)::INT AS nr FROM l)
      SELECT 'm' AS map_id, level::INT AS level, radius, nc::BIGINT AS n_cols, nr::BIGINT AS n_rows, (off + (nc - 1) * radius)::BIGINT AS last_x, (nc * nr - 1)::BIGINT AS last FROM c""",
    "scale_plan": "SELECT * FROM (VALUES (15::DOUBLE, 15::DOUBLE, 0, 1, 0, 2), (16, 100, 0, 1, 3, 2), (25, 100, 0, 0, 3, 2), (30, 120, 1, 1, 3, 2), (50, 500, 1, 0, 5, 2)) t(gmin, gmax, smin, rmin_idx, smax, rmax_idx)",
    "keypoint_pixel_count": f"WITH {SEEN} SELECT map_id, lin::INT AS lin, count(*) AS n_elements, count(DISTINCT seg_id) AS n_segs FROM el GROUP BY map_id, lin HAVING count(DISTINCT seg_id) > 10",
    "gaussian_weights": """WITH g AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 450::DOUBLE) AS e FROM range(16) a(dx), range(16) b(dy)), n AS (SELECT sqrt(4 * sum(e * e) FILTER (dx > 0) + 1) AS nr FROM g)
      SELECT dx, dy, round(e / nr, 8) AS w FROM g, n""",
    "global_orientation_hist": f"WITH {HIST} SELECT map_id, lin::INT AS lin, {', '.join(r6(f'h{b}', f'h{b}') for b in range(9))} FROM hist",
    "ref_angle": f"WITH {ANGLES} SELECT h1.map_id, h1.lin::INT AS lin, {r6('angle', 'angle')} FROM h1 LEFT JOIN angles USING (map_id, lin)",
    "lrp_descriptor": f"WITH {DESC} SELECT map_id, lin::INT AS lin, count(*) FILTER (v > 1e-12) AS n_nonzero, round(sum(v), 5) AS total, round(sqrt(sum(v * v)), 5) AS l2, round(sum(v * (pos + 1)), 4) AS placed, decision FROM vec GROUP BY map_id, lin, decision",
    "half_choice_counts": f"WITH {DESC} SELECT decision, count(DISTINCT (map_id, lin)) AS n FROM vec GROUP BY decision",
    "normalize_cap": f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT vec_id, least(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 0.15::DOUBLE) AS x FROM e),
      b AS (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM a) SELECT vec_id, {r6('sqrt(sum(x * x))', 'l2')}, {r6('max(x)', 'top')} FROM b GROUP BY vec_id""",
    "knn2_exact": f"WITH {KNN} SELECT qid, rn::INT AS rn, rid, {r6('dist', 'dist')} FROM knn",
    "snn_ratio_match": f"WITH {MATCH} SELECT qid, rid FROM m",
    "matches_per_ref": f"WITH {MATCH}, r AS (SELECT DISTINCT CAST(label AS VARCHAR) AS ref_id FROM embeddings WHERE vec_id % 5 <> 0) SELECT r.ref_id, count(m.qid) AS n FROM r LEFT JOIN m ON r.ref_id = m.ref_id GROUP BY r.ref_id",
    "ref_sampling_prob": f"WITH {MATCH}, c AS (SELECT ref_id, count(*) AS n FROM m GROUP BY ref_id HAVING count(*) >= 2) SELECT ref_id, {r6('n / (SELECT sum(n) FROM c)::DOUBLE', 'p')} FROM c",
    "lstsq_similarity": f"WITH {ROWS}, {_fit('rws', 'ref_id')} SELECT ref_id, {_MODELCOLS} FROM model",
    "ransac_pair_models": f"WITH {HYP} SELECT ref_id, hyp::INT AS hyp, {_MODELCOLS} FROM model",
    "model_inliers": f"WITH {INLIER} SELECT ref_id, hyp::INT AS hyp, n_inliers FROM cntd",
    "best_hypothesis": f"WITH {INLIER}, {_best('ref_id')} SELECT ref_id, hyp::INT AS hyp, n_inliers FROM best",
    "identify_many": f"WITH {MANY} SELECT test_id, ref_id, hyp::INT AS hyp, n_inliers FROM best",
    "refined_models": f"WITH {INLIER}, {_best('ref_id')}, {_refits()} SELECT ref_id, qid, count(*) OVER (PARTITION BY ref_id) AS n_inliers, {_MODELCOLS} FROM i10",
    "weighted_inliers": f"WITH {VIS} SELECT ref_id, {r6('sum(2 * t * r / nullif(t + r, 0))', 'w')} FROM vis GROUP BY ref_id",
    "identify_confidence": f"""WITH {VIS}, {_fit('rws', 'ref_id')}, ws AS (SELECT ref_id, sum(2 * t * r / nullif(t + r, 0)) AS w FROM vis SEMI JOIN (SELECT ref_id FROM model WHERE 1000 * s * 2 BETWEEN 50 AND 10000) USING (ref_id) GROUP BY ref_id),
      en AS (SELECT *, max(w) OVER () AS top FROM ws WHERE w >= 0.5), nr AS (SELECT * FROM en WHERE w >= 0.6::DOUBLE * top) SELECT ref_id, {r6('w / sum(w) OVER ()', 'confidence')} FROM nr""",
    "model_box_corners": f"""WITH {SEG} SELECT DISTINCT map_id AS ref_id, c::INT AS corner, round_even({_S} * (cos({_O}::DOUBLE) * x - sin({_O}::DOUBLE) * y) + {_TX}, 0)::BIGINT AS x, round_even({_S} * (sin({_O}::DOUBLE) * x + cos({_O}::DOUBLE) * y) + ({_TY}), 0)::BIGINT AS y
      FROM seg, (VALUES (0, 0, 0), (1, 999, 0), (2, 999, 999), (3, 0, 999)) t(c, x, y)""",
    "overlay_inverse_model": f"WITH {SEG} SELECT map_id, seg_id, {_INV} FROM seg",
    "svg_lines": f"WITH {SEG} SELECT map_id, seg_id, {_SVG} AS svg FROM seg",
    "svg_documents": f"""WITH {SEG}, b AS (SELECT map_id, round(max(greatest(floor(x1), floor(x2))) + 1 - min(least(floor(x1), floor(x2))))::INT AS w, round(max(greatest(floor(y1), floor(y2))) + 1 - min(least(floor(y1), floor(y2))))::INT AS h FROM seg GROUP BY map_id)
      SELECT map_id, seg_id AS part, {_SVG} AS line FROM seg
      UNION ALL SELECT map_id, -1, '<svg height="' || h || '" width="' || w || '"><rect width="' || w || '" height="' || h || '" style="fill:rgb(0,0,0)" /><g stroke-linecap="round" stroke-width="1" stroke="rgb(255,255,255)">' FROM b
      UNION ALL SELECT map_id, 9223372036854775807, '</g></svg>' FROM b""",
    "truncated_pixels": f"WITH {SEG} SELECT map_id, seg_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2 FROM seg",
    "results_filter_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7",
    "results_project_json": """SELECT event_id, '{"k":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '","a":{"b":null}}' AS doc FROM events""",
    "fuzz_missing_count": f"WITH {SEG} SELECT map_id, count(*) AS n_total, count(*) - round(count(*) * 0.1::DOUBLE)::BIGINT AS n_kept FROM seg GROUP BY map_id",
    "union_extra_segments": f"WITH {SEG} SELECT map_id, count(*) + round(count(*) * 0.1::DOUBLE)::BIGINT AS n_total, count(*) + round(count(*) * 0.1::DOUBLE)::BIGINT AS n_ids FROM seg GROUP BY map_id",
    "removed_segments": f"WITH {SEG} SELECT map_id, round(count(*) * 0.1::DOUBLE)::BIGINT AS n_gone FROM seg GROUP BY map_id",
    "downscaled_roads": f"WITH {SEG} SELECT map_id, seg_id, {_xy('x1 / 4', 'y1 / 4', 'x2 / 4', 'y2 / 4')}, {r6(ANGLE, 'angle_u')} FROM seg",
    "descriptor_budget": f"WITH {SEG} SELECT map_id, 66 * 66::BIGINT AS n FROM (SELECT DISTINCT map_id FROM seg)",
    "multiset_union": f"WITH {PIX} SELECT map_id, count(DISTINCT (y, x)) AS n_pixels, 2 * count(*) AS total FROM pix GROUP BY map_id",
    "keypoint_scale": f"WITH {SEG} SELECT map_id, (r * 66 + c)::INT AS lin, (4 * (10 + 15 * c))::BIGINT AS x, (4 * (10 + 15 * r))::BIGINT AS y, 60::BIGINT AS s FROM (SELECT DISTINCT map_id FROM seg), range(66) a(r), range(66) b(c)",
}
