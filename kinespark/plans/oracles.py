"""The catalog's queries in SQL for DuckDB, over the given tables."""

from __future__ import annotations

from kinespark.operators.fuse import BONES

_HANDS = """hands AS (
  SELECT vec_id AS pos, (vec_id // 8) // 64 AS sequence_id, vec_id // 8 AS group_id, 'C' || (vec_id % 4) AS camera_id,
    CASE WHEN (vec_id // 4) % 2 = 0 THEN 'Left' ELSE 'Right' END AS hand, (vec_id * 37 % 101) / 100.0::DOUBLE AS quality, embedding AS e
  FROM embeddings
  WHERE vec_id % 37 <> 0 AND NOT ((vec_id // 8) % 17 = 5 OR (vec_id // 8) % 23 IN (7, 8) OR (vec_id // 8) % 29 IN (11, 12, 13))
)"""
_RAW = (
    _HANDS
    + """, raw AS (
  SELECT pos, sequence_id, group_id, camera_id, hand, quality, CAST(j AS INTEGER) AS joint, e[3 * j + 1]::DOUBLE AS x, e[3 * j + 2]::DOUBLE AS y, e[3 * j + 3]::DOUBLE AS z
  FROM hands, range(21) AS t(j)
)"""
)
_ROOT = (
    _RAW
    + """, root AS (
  SELECT r.pos, r.sequence_id, r.group_id, r.camera_id, r.hand, r.quality, r.joint, r.x - w.x AS x, r.y - w.y AS y, r.z - w.z AS z
  FROM raw r JOIN raw w ON w.pos = r.pos AND w.joint = 0
)"""
)
_FUSED = (
    _ROOT
    + """, fused AS (
  SELECT sequence_id, group_id, hand, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z, sqrt(greatest(0, var_pop(x) + var_pop(y) + var_pop(z))) AS spread, count(*) AS views
  FROM root {where} GROUP BY sequence_id, group_id, hand, joint
)"""
)
_K = "sequence_id, group_id, hand"
_BONES = (
    _RAW
    + ", bones(bone, a, b) AS (VALUES "
    + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(BONES))
    + """), lengths AS (
  SELECT p.sequence_id, p.group_id, p.camera_id, p.hand, bone, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS length
  FROM bones JOIN raw p ON p.joint = a JOIN raw q ON q.joint = b AND q.pos = p.pos
)"""
)
_FINGER = "CASE WHEN joint = 0 THEN 'wrist' ELSE ['thumb', 'index', 'middle', 'ring', 'little'][(joint - 1) // 4 + 1] END"
_BOXES = """boxes AS (
  SELECT group_id, camera_id, n, x1, y1, x1 + w AS x2, y1 + h AS y2, score, origin, label, label_source, is_right FROM (
    SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY x1, y1, w, h, score, origin, label NULLS FIRST, label_source) AS n FROM (
      SELECT l_orderkey AS group_id, 'C' || (l_orderkey % 4) AS camera_id, (l_partkey % 1200)::DOUBLE AS x1, (l_suppkey * 7 % 900)::DOUBLE AS y1,
        20 + l_quantity * 6 AS w, 20 + l_discount * 1500 AS h, l_tax / 0.08::DOUBLE AS score, CASE WHEN l_returnflag = 'A' THEN 'mediapipe' ELSE 'sam3' END AS origin,
        CASE WHEN l_partkey % 3 = 0 THEN 'Left' WHEN l_partkey % 3 = 1 OR l_returnflag = 'A' THEN 'Right' END AS label,
        CASE l_suppkey % 5 WHEN 0 THEN 'prompt' WHEN 1 THEN 'hypothesis' ELSE 'tracker' END AS label_source, (l_suppkey % 2)::DOUBLE AS is_right
      FROM lineitem))
)"""
_OVERLAP = (
    _BOXES
    + """, shared AS (
  SELECT a.group_id, a.camera_id, a.n, b.n AS match,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s, (a.x2 - a.x1) * (a.y2 - a.y1) AS p, (b.x2 - b.x1) * (b.y2 - b.y1) AS q
  FROM boxes a JOIN boxes b ON a.group_id = b.group_id AND a.camera_id = b.camera_id WHERE a.origin = 'mediapipe' AND b.origin = 'sam3'
), best AS (
  SELECT * FROM (SELECT group_id, camera_id, n, match, s / (p + q - s) AS iou, row_number() OVER (PARTITION BY group_id, camera_id, n ORDER BY s / (p + q - s) DESC, match) AS r FROM shared WHERE s / (p + q - s) >= {least}) WHERE r = 1
), found AS (
  SELECT a.group_id, a.camera_id, a.n, best.match, best.iou FROM boxes a LEFT JOIN best USING (group_id, camera_id, n) WHERE a.origin = 'mediapipe'
)"""
)
_SERIES = """series AS (
  SELECT * FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS x FROM events) WHERE seq % 11 <> 6
)"""
_LABELLED = """labelled AS (
  SELECT o_orderkey // 4 AS group_id, o_orderkey % 2 AS camera, o_orderkey AS pos, o_custkey % 10 / 10.0::DOUBLE AS score, CASE WHEN o_custkey % 3 = 0 THEN 'Left' ELSE 'Right' END AS label FROM orders
)"""
_SHARDS = """shards AS (
  SELECT doc_id % 3 AS shard, doc_id, source, n_chars FROM documents
  UNION ALL SELECT 3, doc_id, source, n_chars + CASE WHEN doc_id % 20 = 0 THEN 1 ELSE 0 END FROM documents WHERE doc_id % 10 = 0
)"""
_PAIRS = (
    _ROOT
    + """, pairs AS (
  SELECT p.sequence_id, p.group_id, p.hand, p.joint, p.x, p.y, p.z, t.x AS tx, t.y AS ty, t.z AS tz
  FROM root p JOIN root t ON p.sequence_id = t.sequence_id AND p.group_id = t.group_id AND p.hand = t.hand AND p.joint = t.joint AND t.camera_id = 'C3' WHERE p.camera_id = 'C0'
)"""
)
_ALL_PAIRS = (
    _ROOT
    + """, all_pairs AS (
  SELECT p.camera_id, p.sequence_id, p.group_id, p.hand, p.joint, p.x, p.y, p.z, t.x AS tx, t.y AS ty, t.z AS tz
  FROM root p JOIN root t ON p.sequence_id = t.sequence_id AND p.group_id = t.group_id AND p.hand = t.hand AND p.joint = t.joint AND t.camera_id = 'C3' WHERE p.camera_id <> 'C3'
)"""
)
_GATE = (
    _ROOT
    + """, truth AS (SELECT * FROM root WHERE camera_id = 'C3'), both_views AS (
  SELECT sequence_id, group_id, hand, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM root WHERE camera_id IN ('C0', 'C1') GROUP BY ALL
), base AS (
  SELECT p.sequence_id, p.group_id, p.hand, floor(any_value(p.quality) * 4)::BIGINT AS bucket, avg(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2)) AS error
  FROM root p JOIN truth t USING (sequence_id, group_id, hand, joint) WHERE p.camera_id = 'C0' GROUP BY 1, 2, 3
), gated AS (
  SELECT p.sequence_id, p.group_id, p.hand, avg(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2)) AS error
  FROM both_views p JOIN truth t USING (sequence_id, group_id, hand, joint) GROUP BY 1, 2, 3
)"""
)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _knn(ask: str, known: str, k: int) -> str:
    return f"""SELECT q AS id, sum(exp(-0.5 * (d / h) ** 2) * v) / sum(exp(-0.5 * (d / h) ** 2)) AS predicted, min(d) AS nearest FROM (
  SELECT *, greatest(max(d) OVER (PARTITION BY q), 1e-6) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS r FROM (
      SELECT a.vec_id AS q, b.vec_id AS p, b.label::DOUBLE AS v, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 8.0, 12) AS d
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.{ask} AND b.{known})
  ) WHERE r <= {k}) GROUP BY q"""


def _asof(pick: str) -> str:
    return f"""WITH stream AS (
  SELECT user_id // 2 % 4 AS recording, event_id AS f, CASE WHEN user_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS hand, max(value) AS v FROM events WHERE event_id % 13 <> 4 GROUP BY ALL
), frames AS (SELECT DISTINCT recording, f FROM stream), marks AS (
  SELECT DISTINCT r.recording, CAST(floor(event_id * 25 / 60) AS BIGINT) AS group_id, 7 + floor(event_id * 25 / 60) * 60.0::DOUBLE / 25.0 AS mark FROM events, range(4) AS r(recording)
), lower_side AS (SELECT m.*, f.f AS lower FROM marks m ASOF JOIN frames f ON m.recording = f.recording AND m.mark >= f.f),
sides AS (SELECT l.*, f.f AS upper FROM lower_side l ASOF JOIN frames f ON l.recording = f.recording AND l.mark <= f.f)
SELECT s.recording, s.group_id, a.hand, round({pick}, 6) + 0.0 AS x FROM sides s JOIN stream a ON a.recording = s.recording AND a.f = s.lower JOIN stream b ON b.recording = s.recording AND b.f = s.upper AND b.hand = a.hand"""


def _gaussian() -> str:
    near = [(d, f"lag({{c}}, {-d}) OVER w") for d in range(-2, 3)]
    import math

    parts = {}
    for c in "xyz":
        total = " + ".join(f"coalesce({n.format(c=c)} * {math.exp(-0.5 * d * d)!r}::DOUBLE, 0)" for d, n in near)
        mass = " + ".join(f"CASE WHEN {n.format(c=c)} IS NULL THEN 0 ELSE {math.exp(-0.5 * d * d)!r}::DOUBLE END" for d, n in near)
        parts[c] = f"({total}) / ({mass}) AS {c}"
    return f"""WITH {_FUSED.format(where="")}, islands AS (SELECT *, group_id - row_number() OVER (PARTITION BY sequence_id, hand, joint ORDER BY group_id) AS island FROM fused),
smooth AS (SELECT {_K}, joint, {", ".join(parts.values())} FROM islands WINDOW w AS (PARTITION BY sequence_id, hand, joint, island ORDER BY group_id))
SELECT {_K}, joint, {_r("x", "y", "z")} FROM smooth"""


def _huber() -> str:
    rounds, before = [], "SELECT camera_id, hand, joint, avg(tx - x) AS sx, avg(ty - y) AS sy FROM all_pairs GROUP BY ALL"
    cut = "SELECT camera_id, hand, joint, greatest(-1, least(1, sx)) AS sx, greatest(-1, least(1, sy)) AS sy"
    for i in range(2):
        rounds.append(f"s{i} AS ({cut} FROM ({before}))")
        w = f"1 / greatest(1, sqrt((p.tx - p.x - s{i}.sx) ** 2 + (p.ty - p.y - s{i}.sy) ** 2) / 0.2)"
        before = f"SELECT camera_id, hand, joint, sum({w} * (p.tx - p.x)) / sum({w}) AS sx, sum({w} * (p.ty - p.y)) / sum({w}) AS sy FROM all_pairs p JOIN s{i} USING (camera_id, hand, joint) GROUP BY ALL"
    return f"WITH {_ALL_PAIRS}, {', '.join(rounds)}, done AS ({cut} FROM ({before})) SELECT camera_id, hand, joint, {_r('sx', 'sy')} FROM done"


def _affine() -> str:
    by = "camera_id, hand, joint"
    rounds, w = [], "1"
    source = "all_pairs p"
    for i in range(3):
        sums = ", ".join(f"sum({w} * {c}) AS s{c}, sum({w} * t{c}) AS t{c}, sum({w} * {c} * {c}) AS q{c}, sum({w} * {c} * t{c}) AS p{c}" for c in "xy")
        rounds.append(f"m{i} AS (SELECT {by}, sum({w}) AS n, {sums} FROM {source} GROUP BY {by})")
        slope = lambda c: f"CASE WHEN abs(n * q{c} - s{c} ** 2) > 1e-12 THEN (n * p{c} - s{c} * t{c}) / (n * q{c} - s{c} ** 2) ELSE 1 END"
        rounds.append(f"k{i} AS (SELECT *, {', '.join(f'{slope(c)} AS r{c}' for c in 'xy')} FROM m{i})")
        rounds.append(f"f{i} AS (SELECT {by}, {', '.join(f'greatest(0.5, least(1.5, r{c})) AS a{c}, greatest(-1, least(1, (t{c} - r{c} * s{c}) / n)) AS "b{c}"' for c in 'xy')} FROM k{i})")
        w = "1 / greatest(1, sqrt((ax * x + bx - tx) ** 2 + (ay * y + by_ - ty) ** 2) / 0.3)"
        source = f"(SELECT p.*, f.ax, f.bx, f.ay, f.\"by\" AS by_ FROM all_pairs p JOIN f{i} f USING ({by}))"
    return f"WITH {_ALL_PAIRS}, {', '.join(rounds)} SELECT {by}, {_r('ax', 'bx', 'ay')}, round(\"by\", 6) + 0.0 AS \"by\" FROM f2"


#: The palm frame of each hand: rows x, y and z.
_AXES = """p AS (SELECT pos, max(x) FILTER (WHERE joint = 0) AS wx, max(y) FILTER (WHERE joint = 0) AS wy, max(z) FILTER (WHERE joint = 0) AS wz,
  max(x) FILTER (WHERE joint = 5) AS ix, max(y) FILTER (WHERE joint = 5) AS iy, max(z) FILTER (WHERE joint = 5) AS iz,
  max(x) FILTER (WHERE joint = 17) AS px, max(y) FILTER (WHERE joint = 17) AS py, max(z) FILTER (WHERE joint = 17) AS pz FROM raw GROUP BY pos),
a AS (SELECT pos, wx, wy, wz, ix - wx AS a1, iy - wy AS a2, iz - wz AS a3, px - wx AS b1, py - wy AS b2, pz - wz AS b3 FROM p),
b AS (SELECT pos, wx, wy, wz, b1, b2, b3, a1 / na AS x1, a2 / na AS x2, a3 / na AS x3 FROM (SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS na FROM a) WHERE na > 1e-6),
c AS (SELECT *, x2 * b3 - x3 * b2 AS c1, x3 * b1 - x1 * b3 AS c2, x1 * b2 - x2 * b1 AS c3 FROM b),
f AS (SELECT pos, wx, wy, wz, x1, x2, x3, c1 / nc AS z1, c2 / nc AS z2, c3 / nc AS z3 FROM (SELECT *, sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS nc FROM c) WHERE nc > 1e-6),
g AS (SELECT *, z2 * x3 - z3 * x2 AS y1, z3 * x1 - z1 * x3 AS y2, z1 * x2 - z2 * x1 AS y3 FROM f)"""


def _palm() -> str:
    return f"""WITH {_RAW}, {_AXES},
o AS (SELECT r.pos, r.joint, (r.x - wx) * x1 + (r.y - wy) * x2 + (r.z - wz) * x3 AS x, (r.x - wx) * y1 + (r.y - wy) * y2 + (r.z - wz) * y3 AS y,
  (r.x - wx) * z1 + (r.y - wy) * z2 + (r.z - wz) * z3 AS z FROM raw r JOIN g USING (pos))
SELECT pos, joint, {_r("x", "y", "z")} FROM o"""


def _static() -> str:
    drawn = ", ".join(f"sum(CASE WHEN norm > 1e-8 THEN d{c} * (0.3 + 0.7 * t / norm) ELSE d{c} END) OVER w AS {c}" for c in "xyz")
    return f"""WITH {_BONES}, m AS (SELECT hand, camera_id, bone, median(length) AS m FROM lengths GROUP BY ALL HAVING count(*) >= 3), target AS (SELECT hand, bone, median(m) AS t FROM m GROUP BY ALL),
step AS (SELECT q.pos, q.hand, bone, b AS joint, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS norm
  FROM bones JOIN raw p ON p.joint = a JOIN raw q ON q.joint = b AND q.pos = p.pos),
o AS (SELECT pos, joint, {drawn} FROM step JOIN target USING (hand, bone) WINDOW w AS (PARTITION BY pos, bone // 4 ORDER BY joint) UNION ALL SELECT pos, 0, 0, 0, 0 FROM hands)
SELECT pos, CAST(joint AS INTEGER) AS joint, {_r("x", "y", "z")} FROM o"""


def _reprojection() -> str:
    return f"""WITH {_RAW}, q AS (SELECT {_K}, camera_id, quality, joint, x / (abs(z) + 4) * 600 + 320 AS u, y / (abs(z) + 4) * 580 + 240 AS v FROM raw WHERE camera_id IN ('C0', 'C3')),
c AS (SELECT *, 1.02 * u + 0.01 * v - 3 AS cu, -0.005 * u + 0.98 * v + 2 AS cv FROM q),
o AS (SELECT {_K}, sum(p.quality * sqrt((p.cu - t.cu) ** 2 + (p.cv - t.cv) ** 2)) / sum(p.quality) AS error FROM c p JOIN c t USING ({_K}, joint)
  WHERE p.camera_id = 'C0' AND t.camera_id = 'C3' AND p.quality > 1e-4 GROUP BY ALL)
SELECT {_K}, {_r("error")}, 0.0::DOUBLE AS undone FROM o"""


def _knuckles() -> str:
    points = ", ".join(f"max({c}) FILTER (WHERE joint = {j}) AS {n}{c}" for n, j in (("w", 0), ("i", 5), ("l", 17)) for c in "xyz")
    a = ", ".join(f"i{c} - l{c} AS a{c}, (i{c} + l{c}) / 2 - w{c} AS h{c}" for c in "xyz")

    def cross(p: str, q: str, out: str) -> str:
        return ", ".join(f"{p}{m} * {q}{n} - {p}{n} * {q}{m} AS {out}{c}" for c, m, n in ("xyz", "yzx", "zxy"))

    def unit(p: str, out: str) -> str:
        return ", ".join(f"{p}{c} / sqrt({p}x ** 2 + {p}y ** 2 + {p}z ** 2) AS {out}{c}" for c in "xyz")

    rows = " UNION ALL ".join(f"SELECT pos, {i} AS axis, {', '.join(f'round({n}{c}, 6) + 0.0 AS {c}' for c in 'xyz')} FROM f" for i, n in enumerate("pqr"))
    return f"""WITH {_RAW}, k AS (SELECT pos, {points} FROM raw GROUP BY pos), a AS (SELECT pos, {a} FROM k), b AS (SELECT pos, {unit("a", "p")}, {unit("h", "u")} FROM a),
c AS (SELECT *, {cross("p", "u", "n")} FROM b), d AS (SELECT *, {unit("n", "r")} FROM c), e AS (SELECT *, {cross("r", "p", "q")} FROM d), f AS (SELECT * FROM e) {rows}"""


def _transforms() -> str:
    rows = {
        "expanded": "least(1199, greatest(0, cx - s * 0.65)), least(899, greatest(0, cy - s * 0.65)), least(1199, greatest(0, cx + s * 0.65)), least(899, greatest(0, cy + s * 0.65))",
        "scaled": "least(1199, greatest(0, cx - w * 0.75)), least(899, greatest(0, cy - h * 0.75)), least(1199, greatest(0, cx + w * 0.75)), least(899, greatest(0, cy + h * 0.75))",
        "xywh": "x1, y1, greatest(1, x2 - x1), greatest(1, y2 - y1)",
        "joined": "least(x1, 300), least(y1, 200), greatest(x2, 500), greatest(y2, 400)",
    }
    every = " UNION ALL ".join(f"SELECT group_id, camera_id, n, '{k}', {v} FROM c" for k, v in rows.items())
    return f"""WITH {_BOXES}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, 2) AS w, greatest(y2 - y1, 2) AS h, greatest(x2 - x1, y2 - y1, 2) AS s FROM boxes),
t(group_id, camera_id, n, kind, v0, v1, v2, v3) AS ({every}) SELECT group_id, camera_id, n, kind, {_r("v0", "v1", "v2", "v3")} FROM t"""


def _crop() -> str:
    return f"""WITH {_RAW}, p AS (SELECT pos, joint, quality, CASE WHEN hand = 'Left' THEN -x ELSE x END * 200 + group_id % 700 + 100 AS px, y * 200 + pos % 500 + 100 AS py,
  least(group_id % 700, pos % 500, 1000 - group_id % 700, 700 - pos % 500) AS margin FROM raw),
b AS (SELECT *, 0.20 + 0.35 * 1.0 + 0.20 * least(1, greatest(0, (margin + 20) / 80)) + 0.25 * CASE WHEN pos % 3 <> 0 THEN quality ELSE 0.35 END AS base FROM p)
SELECT pos, joint, round(px, 6) AS px, round(py, 6) AS py,
  round(CASE WHEN px >= 0 AND px < 1200 AND py >= 0 AND py < 900 THEN least(1, base * CASE WHEN pos % 2 = 0 AND joint = 4 THEN 0.45 ELSE 1 END) ELSE 0 END, 6) AS confidence FROM b"""


def _report() -> str:
    return f"""WITH {_FUSED.format(where="")}, e AS (SELECT {_K}, r.camera_id, avg(sqrt((r.x - f.x) ** 2 + (r.y - f.y) ** 2 + (r.z - f.z) ** 2)) AS error FROM root r JOIN fused f USING ({_K}, joint) GROUP BY ALL),
o AS (SELECT camera_id, count(*) AS hands, count(*) FILTER (WHERE error <= 0.25) AS accepted, count(*) FILTER (WHERE error > 0.25) AS rejected, avg(error) AS mean, median(error) AS median, max(error) AS max FROM e GROUP BY camera_id)
SELECT camera_id, hands, accepted, rejected, {_r("mean", "median", "max")} FROM o"""


def _gate_reason() -> str:
    return f"""WITH {_HANDS}, c AS (SELECT *, CASE WHEN pos % 3 <> 0 THEN quality ELSE 0 END AS mask FROM hands WHERE camera_id = 'C1')
SELECT {_K}, CASE WHEN pos % 11 = 0 THEN 'missing_candidate' WHEN pos % 5 = 0 THEN 'not_known_hypothesis' WHEN mask < 0.4 AND 1 - quality < 0.5 THEN 'low_mask_score'
  WHEN pos % 4 <> 1 AND quality * 0.1 > 0.06 THEN 'temporal_discontinuity' WHEN mask >= 0.4 THEN 'passed' ELSE 'passed_by_view_quality' END AS reason FROM c"""


def _turns() -> str:
    names = [f"{a}{i}" for a in "xyz" for i in (1, 2, 3)]
    lags = ", ".join(f"lag({n}) OVER w AS l{n}" for n in names)
    trace = " + ".join(f"{n} * l{n}" for n in names)
    return f"""WITH {_RAW}, {_AXES}, l AS (SELECT pos, {", ".join(names)}, {lags} FROM g JOIN hands USING (pos) WINDOW w AS (PARTITION BY sequence_id, hand, camera_id ORDER BY group_id))
SELECT pos, round(degrees(acos(least(1, greatest(-1, ({trace} - 1) / 2)))), 4) + 0.0 AS degrees FROM l WHERE lx1 IS NOT NULL"""


def _decay() -> str:
    return f"""WITH {_HANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, hand, camera_id ORDER BY group_id) AS n FROM hands),
k AS (SELECT *, max(CASE WHEN group_id % 5 = 0 THEN n END) OVER (PARTITION BY sequence_id, hand, camera_id ORDER BY group_id) AS last FROM n)
SELECT a.pos, a.n - a.last AS age, round(b.quality * 0.98 ** (a.n - a.last), 6) + 0.0 AS carried FROM k a JOIN n b ON a.sequence_id = b.sequence_id AND a.hand = b.hand AND a.camera_id = b.camera_id AND b.n = a.last"""


def _triangulate() -> str:
    def det(m: list[list[str]]) -> str:
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    c = [[f"m{min(a, b)}{max(a, b)}" for b in "xyz"] for a in "xyz"]
    full = det(c)
    cramer = [det([[f"r{'xyz'[k]}" if j == i else c[k][j] for j in range(3)] for k in range(3)]) for i in range(3)]
    sums = ", ".join(f"sum({1 if a == b else 0} - d{a} * d{b}) AS m{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    right = ", ".join("sum(" + " + ".join(f"({1 if a == b else 0} - d{a} * d{b}) * o{b}" for b in "xyz") + f") AS r{a}" for a in "xyz")
    return f"""WITH {_RAW}, rays AS (SELECT group_id, hand, joint, substr(camera_id, 2, 1)::DOUBLE * 0.1 AS ox, substr(camera_id, 2, 1)::DOUBLE * substr(camera_id, 2, 1)::DOUBLE * 0.05 AS oy, 0.0 AS oz,
  x / sqrt(x * x + y * y + z * z) AS dx, y / sqrt(x * x + y * y + z * z) AS dy, z / sqrt(x * x + y * y + z * z) AS dz FROM raw),
s AS (SELECT group_id, hand, joint, count(*) AS views, {sums}, {right} FROM rays GROUP BY group_id, hand, joint),
p AS (SELECT group_id, hand, joint, views, {", ".join(f"CASE WHEN abs({full}) > 1e-14 * views ** 3 THEN {m} / {full} ELSE r{n} / views END AS {n}" for m, n in zip(cramer, "xyz", strict=True))} FROM s),
j AS (SELECT p.*, x - ox AS ax, y - oy AS ay, z - oz AS az, dx, dy, dz, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS t FROM rays JOIN p USING (group_id, hand, joint))
SELECT group_id, hand, joint, views, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, round(avg(sqrt((ax - t * dx) ** 2 + (ay - t * dy) ** 2 + (az - t * dz) ** 2)), 4) + 0.0 AS error
FROM j GROUP BY group_id, hand, joint, views, x, y, z"""


def _fill() -> str:
    bones = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(BONES))
    return f"""WITH {_RAW}, c0 AS (SELECT * FROM raw), nxt AS (
  SELECT DISTINCT sequence_id, hand, camera_id, group_id AS t, lead(group_id) OVER (PARTITION BY sequence_id, hand, camera_id ORDER BY group_id) AS u FROM c0 WHERE joint = 0),
gaps AS (SELECT * FROM nxt WHERE u - t BETWEEN 2 AND 3), ends AS (
  SELECT g.*, a.joint, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM gaps g
  JOIN c0 a ON a.camera_id = g.camera_id AND a.sequence_id = g.sequence_id AND a.hand = g.hand AND a.group_id = g.t JOIN c0 b ON b.camera_id = g.camera_id AND b.sequence_id = g.sequence_id AND b.hand = g.hand AND b.group_id = g.u AND b.joint = a.joint),
moved AS (SELECT sequence_id, hand, camera_id, t FROM ends GROUP BY ALL HAVING max(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2)) <= 1.2),
bone(bone, i, k) AS (VALUES {bones}),
change AS (SELECT p.sequence_id, p.hand, p.camera_id, p.t FROM ends p JOIN bone ON p.joint = i JOIN ends q ON q.joint = k AND q.camera_id = p.camera_id AND q.sequence_id = p.sequence_id AND q.hand = p.hand AND q.t = p.t
  GROUP BY ALL HAVING max(abs(sqrt((p.bx - q.bx) ** 2 + (p.by_ - q.by_) ** 2 + (p.bz - q.bz) ** 2) - sqrt((p.ax - q.ax) ** 2 + (p.ay - q.ay) ** 2 + (p.az - q.az) ** 2))
    / greatest(0.5 * (sqrt((p.ax - q.ax) ** 2 + (p.ay - q.ay) ** 2 + (p.az - q.az) ** 2) + sqrt((p.bx - q.bx) ** 2 + (p.by_ - q.by_) ** 2 + (p.bz - q.bz) ** 2)), 1e-8)) <= 1.5),
kept AS (SELECT e.*, unnest(range(e.t + 1, e.u)) AS group_id FROM ends e JOIN moved USING (sequence_id, hand, camera_id, t) JOIN change USING (sequence_id, hand, camera_id, t)),
o AS (SELECT {_K}, camera_id, joint, (1 - (group_id - t) / (u - t)) * ax + (group_id - t) / (u - t) * bx AS x, (1 - (group_id - t) / (u - t)) * ay + (group_id - t) / (u - t) * by_ AS y,
  (1 - (group_id - t) / (u - t)) * az + (group_id - t) / (u - t) * bz AS z FROM kept)
SELECT {_K}, camera_id, joint, {_r("x", "y", "z")} FROM o"""


_POINT = "sequence_id, hand, camera_id, joint"


def _hampel(radius: int, threshold: float, k: float) -> str:
    """Tables up to `hampel`: points of raw with those far from their window's median replaced."""
    rows = f"(PARTITION BY {_POINT} ORDER BY group_id ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    return f"""hw AS (SELECT {_POINT}, group_id, x, y, z, list(x) OVER w AS wx, list(y) OVER w AS wy, list(z) OVER w AS wz FROM raw WINDOW w AS {rows}),
hm AS (SELECT *, list_median(wx) AS mx, list_median(wy) AS my, list_median(wz) AS mz FROM hw),
hd AS (SELECT *, list_transform(range(1, len(wx) + 1), lambda i: sqrt((wx[i] - mx) ** 2 + (wy[i] - my) ** 2 + (wz[i] - mz) ** 2)) AS d FROM hm),
hl AS (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) > greatest({threshold}, {k} * 1.4826 * list_median(list_transform(d, lambda v: abs(v - list_median(d))))) AS replaced FROM hd),
hampel AS (SELECT {_POINT}, group_id, replaced, CASE WHEN replaced THEN mx ELSE x END AS x, CASE WHEN replaced THEN my ELSE y END AS y, CASE WHEN replaced THEN mz ELSE z END AS z FROM hl)"""


def _smooth() -> str:
    def fold(name: str, order: str) -> str:
        mean = ", ".join(f"0.72 * n.{c} + 0.28 * {name}.{c}" for c in "xyz")
        return f"""{name}o AS (SELECT *, row_number() OVER (PARTITION BY {_POINT} ORDER BY group_id {order}) AS i FROM hampel),
{name} AS (SELECT {_POINT}, group_id, i, x, y, z FROM {name}o WHERE i = 1 UNION ALL
  SELECT n.sequence_id, n.hand, n.camera_id, n.joint, n.group_id, n.i, {mean} FROM {name} JOIN {name}o n
  ON n.sequence_id = {name}.sequence_id AND n.hand = {name}.hand AND n.camera_id = {name}.camera_id AND n.joint = {name}.joint AND n.i = {name}.i + 1)"""

    mixed = ", ".join(f"0.45 * h.{c} + 0.55 * (f.{c} + b.{c}) / 2 AS {c}" for c in "xyz")
    return f"""WITH RECURSIVE {_RAW}, {_hampel(2, 0.05, 1.0)}, {fold("f", "ASC")}, {fold("b", "DESC")},
o AS (SELECT {_POINT}, group_id, h.replaced, r.x AS rx, r.y AS ry, r.z AS rz, {mixed} FROM hampel h JOIN f USING ({_POINT}, group_id) JOIN b USING ({_POINT}, group_id) JOIN raw r USING ({_POINT}, group_id))
SELECT {_POINT}, group_id, {_r("x", "y", "z")}, round(sqrt((x - rx) ** 2 + (y - ry) ** 2 + (z - rz) ** 2), 6) + 0.0 AS delta, replaced FROM o"""


def _one_euro() -> str:
    rate = lambda cutoff: f"(1 / (1 + 25 / (2 * pi() * ({cutoff}))))"
    slope = {c: f"({rate('1.0')} * (n.{c} - s.r{c}) * 25 + (1 - {rate('1.0')}) * s.d{c})" for c in "xyz"}
    a = rate("1.5 + 0.3 * sqrt(" + " + ".join(f"{v} ** 2" for v in slope.values()) + ")")
    key = " AND ".join(f"n.{c} = s.{c}" for c in (*_POINT.split(", "), "island"))
    next_ = ", ".join([*(f"n.{c}" for c in "xyz"), *slope.values(), *(f"{a} * n.{c} + (1 - {a}) * s.f{c}" for c in "xyz")])
    first = ", ".join([*"xyz", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", *"xyz"])
    names = ", ".join([*(f"r{c}" for c in "xyz"), *(f"d{c}" for c in "xyz"), *(f"f{c}" for c in "xyz")])
    return f"""WITH RECURSIVE {_RAW}, x AS (SELECT *, group_id - row_number() OVER (PARTITION BY {_POINT} ORDER BY group_id) AS island FROM raw),
n AS (SELECT *, group_id - min(group_id) OVER (PARTITION BY {_POINT}, island) AS i FROM x),
s({_POINT}, island, group_id, i, {names}) AS (SELECT {_POINT}, island, group_id, i, {first} FROM n WHERE i = 0 UNION ALL
  SELECT {", ".join(f"n.{c}" for c in _POINT.split(", "))}, n.island, n.group_id, n.i, {next_} FROM s JOIN n ON {key} AND n.i = s.i + 1)
SELECT {_POINT}, group_id, round(fx, 6) + 0.0 AS x, round(fy, 6) + 0.0 AS y, round(fz, 6) + 0.0 AS z FROM s"""


def _rotations() -> str:
    """The two leading axes of each frame blended with the smoothed ones before."""
    by = "sequence_id, hand, camera_id"
    p = {f"{n}{i}": f"(0.4 * n.{n}{i} + 0.6 * s.{n}{i})" for n in "xy" for i in (1, 2, 3)}
    size = "greatest(sqrt(" + " + ".join(f"{p[f'x{i}']} ** 2" for i in (1, 2, 3)) + "), 1e-8)"
    step = ", ".join(f"{p[f'x{i}']} / {size} AS x{i}" for i in (1, 2, 3))
    given = ", ".join(f"{p[f'y{i}']} AS q{i}" for i in (1, 2, 3))
    rest = ", ".join(f"q{i} - (q1 * x1 + q2 * x2 + q3 * x3) * x{i} AS h{i}" for i in (1, 2, 3))
    unit = ", ".join(f"h{i} / greatest(sqrt(h1 ** 2 + h2 ** 2 + h3 ** 2), 1e-8) AS y{i}" for i in (1, 2, 3))
    axes = " UNION ALL ".join([
        f"SELECT {by}, group_id, 0 AS axis, x1 AS x, x2 AS y, x3 AS z FROM t", f"SELECT {by}, group_id, 1, y1, y2, y3 FROM t",
        f"SELECT {by}, group_id, 2, x2 * y3 - x3 * y2, x3 * y1 - x1 * y3, x1 * y2 - x2 * y1 FROM t",
    ])
    names = "x1, x2, x3, y1, y2, y3"
    return f"""WITH RECURSIVE {_RAW}, {_AXES}, n AS (SELECT {by}, group_id, {names}, row_number() OVER (PARTITION BY {by} ORDER BY group_id) AS i FROM g JOIN hands USING (pos)),
t AS (SELECT {by}, group_id, i, {names} FROM n WHERE i = 1 UNION ALL SELECT {by}, group_id, i, x1, x2, x3, {unit} FROM (SELECT {by}, group_id, i, x1, x2, x3, {rest} FROM (
  SELECT n.sequence_id, n.hand, n.camera_id, n.group_id, n.i, {step}, {given} FROM t s JOIN n ON n.sequence_id = s.sequence_id AND n.hand = s.hand AND n.camera_id = s.camera_id AND n.i = s.i + 1))),
rows AS ({axes}) SELECT {by}, group_id, axis, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM rows"""


def _automaton() -> str:
    left, right = ("s.{0} + CASE WHEN n.vote = '{1}' THEN n.weight ELSE 0 END".format(*v) for v in (("l", "Left"), ("r", "Right")))
    lead = f"abs({left} - ({right}))"
    flips = "n.vote <> s.label AND s.streak + 1 >= 5 AND n.weight >= 2"
    return f"""WITH RECURSIVE {_LABELLED}, n AS (SELECT 'C' || camera AS camera_id, group_id // 64 AS track_id, pos AS t, label AS vote, score * 3 AS weight,
  row_number() OVER (PARTITION BY camera, group_id // 64 ORDER BY pos) AS i FROM labelled),
s(camera_id, track_id, t, i, label, l, r, streak, confidence) AS (
  SELECT DISTINCT camera_id, track_id, 0::BIGINT, 0::BIGINT, 'unknown', 0.0::DOUBLE, 0.0::DOUBLE, 0, 0.0::DOUBLE FROM n UNION ALL
  SELECT n.camera_id, n.track_id, n.t, n.i,
    CASE WHEN s.label = 'unknown' THEN CASE WHEN {lead} >= 3 THEN CASE WHEN {left} >= {right} THEN 'Left' ELSE 'Right' END ELSE s.label END WHEN {flips} THEN n.vote ELSE s.label END,
    {left}, {right},
    CASE WHEN s.label = 'unknown' THEN s.streak WHEN n.vote = s.label OR ({flips}) THEN 0 ELSE s.streak + 1 END,
    CASE WHEN s.label = 'unknown' THEN CASE WHEN {lead} >= 3 THEN least(1, 0.5 + 0.5 * {lead} / greatest({left} + {right}, 3)) ELSE s.confidence END
      WHEN n.vote = s.label THEN least(1, s.confidence + 0.04 * n.weight) WHEN {flips} THEN 0.7 ELSE s.confidence END
  FROM s JOIN n ON n.camera_id = s.camera_id AND n.track_id = s.track_id AND n.i = s.i + 1)
SELECT camera_id, track_id, t, label, round(confidence, 6) AS confidence FROM s WHERE i > 0"""


def _subsets() -> str:
    from itertools import combinations

    sets = [c for n in (2, 3, 4) for c in combinations(("C0", "C1", "C2", "C3"), n)]
    rows = ", ".join(f"({i}, {len(c)}, [{', '.join(repr(v) for v in c)}])" for i, c in enumerate(sets))
    inner = _triangulate().split("\ns AS (SELECT", 1)[0].rstrip().rstrip(",")
    inner = inner.replace("SELECT group_id, hand, joint, substr", "SELECT group_id, hand, joint, camera_id, substr", 1)
    body = _triangulate().split("\ns AS (SELECT", 1)[1].split("\nj AS", 1)[0].rstrip().rstrip(",")
    body = body.replace("group_id, hand, joint", "group_id, hand, joint, subset").replace("FROM rays GROUP", "FROM every GROUP")
    return f"""{inner}, subsets(subset, wanted, members) AS (VALUES {rows}),
every AS (SELECT * FROM (SELECT r.*, subset, wanted, count(*) OVER (PARTITION BY group_id, hand, joint, subset) AS got FROM rays r JOIN subsets ON list_contains(members, camera_id)
  WHERE list_contains(members, CASE hand WHEN 'Left' THEN 'C1' ELSE 'C2' END)) WHERE got = wanted),
s AS (SELECT{body},
j AS (SELECT p.*, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS t, x - ox AS ax, y - oy AS ay, z - oz AS az, dx, dy, dz FROM every JOIN p USING (group_id, hand, joint, subset)),
e AS (SELECT group_id, hand, joint, subset, views, x, y, z, min(t) AS low, max(t) AS high, avg(sqrt((ax - t * dx) ** 2 + (ay - t * dy) ** 2 + (az - t * dz) ** 2)) AS error,
  max(sqrt((ax - t * dx) ** 2 + (ay - t * dy) ** 2 + (az - t * dz) ** 2)) AS worst FROM j GROUP BY ALL),
q AS (SELECT *, CASE WHEN NOT (low >= 0 AND high <= 10) THEN 'depth' WHEN error > 0.12 OR worst > 0.15 THEN 'ray_error' ELSE '' END AS reason FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, hand, joint ORDER BY reason = '' DESC, CASE WHEN reason = '' THEN views ELSE 0 END DESC, reason = 'depth',
  reason <> '' AND error > 0.12, reason <> '' AND worst > 0.15, round(error, 9), round(worst, 9), subset) AS r FROM q)
SELECT group_id, hand, joint, views, reason = '' AS valid, reason, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("x", "y", "z", "error", "worst"))} FROM o WHERE r = 1"""


_PAIR_OVERLAPS = (
    _BOXES
    + """, pair AS (
  SELECT a.group_id, a.camera_id, a.n AS first, b.n AS second, s / (p + q - s) AS iou FROM (
    SELECT a.group_id, a.camera_id, a, b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s,
      (a.x2 - a.x1) * (a.y2 - a.y1) AS p, (b.x2 - b.x1) * (b.y2 - b.y1) AS q FROM boxes a JOIN boxes b USING (group_id) WHERE a.origin = 'mediapipe' AND b.origin = 'sam3'))"""
).replace("SELECT a.group_id, a.camera_id, a.n AS first, b.n AS second", "SELECT group_id, camera_id, a.n AS first, b.n AS second")


def _global() -> str:
    return f"""WITH RECURSIVE {_PAIR_OVERLAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY iou DESC, first, second) AS i FROM pair WHERE iou >= 0.05),
t(group_id, camera_id, i, firsts, seconds, first, second, iou, taken) AS (
  SELECT DISTINCT group_id, camera_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, false FROM o UNION ALL
  SELECT o.group_id, o.camera_id, o.i, CASE WHEN ok THEN list_append(firsts, o.first) ELSE firsts END, CASE WHEN ok THEN list_append(seconds, o.second) ELSE seconds END, o.first, o.second, o.iou, ok
  FROM (SELECT t.firsts, t.seconds, o, NOT list_contains(t.firsts, o.first) AND NOT list_contains(t.seconds, o.second) AS ok FROM t JOIN o ON o.group_id = t.group_id AND o.i = t.i + 1))
SELECT group_id, camera_id, first, second, round(iou, 6) + 0.0 AS iou FROM t WHERE taken"""


def _optimal() -> str:
    """Every one-to-one choice of partners for the fewer boxes, box by box; the best sum."""
    return f"""WITH RECURSIVE {_PAIR_OVERLAPS}, sizes AS (SELECT group_id, count(DISTINCT first) AS a, count(DISTINCT second) AS b FROM pair GROUP BY group_id),
e AS (SELECT group_id, camera_id, CASE WHEN a <= b THEN first ELSE second END AS p, CASE WHEN a <= b THEN second ELSE first END AS q, iou, least(a, b) AS m FROM pair JOIN sizes USING (group_id)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY p) AS i FROM e),
t(group_id, camera_id, m, i, used, total) AS (SELECT DISTINCT group_id, camera_id, m, 0::BIGINT, []::BIGINT[], 0.0::DOUBLE FROM o UNION ALL
  SELECT o.group_id, o.camera_id, o.m, o.i, list_sort(list_append(used, o.q)), max(total + o.iou) FROM t JOIN o ON o.group_id = t.group_id AND o.i = t.i + 1 WHERE NOT list_contains(used, o.q) GROUP BY 1, 2, 3, 4, 5)
SELECT group_id, camera_id, m AS pairs, round(max(total), 6) + 0.0 AS total FROM t WHERE i = m GROUP BY 1, 2, 3"""


def _greedy() -> str:
    grown = ", ".join(f"round(least({top}, greatest(0, (g{i} + g{i + 2}) / 2 + {sign} * greatest(g2 - g0, g3 - g1, 2) * 0.6)), 6) AS b{j}" for j, (i, sign, top) in enumerate(((0, "-1", 1199), (1, "-1", 899), (0, "1", 1199), (1, "1", 899))))
    grown = grown.replace("g1 + g3", "g1 + g3").replace("(g0 + g2)", "(g0 + g2)")
    return f"""WITH RECURSIVE {_PAIR_OVERLAPS}, l AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n) AS i, count(*) OVER (PARTITION BY group_id) AS m FROM boxes WHERE origin = 'mediapipe'),
keys AS (SELECT DISTINCT group_id, camera_id FROM boxes),
options AS (SELECT group_id, first, list({{'iou': iou, 'n': second}} ORDER BY iou DESC, second) AS os FROM pair WHERE iou >= 0.2 GROUP BY ALL),
t(group_id, i, first, second, used) AS (SELECT group_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM keys UNION ALL
  SELECT group_id, i, n, best, CASE WHEN best > 0 THEN list_append(used, best) ELSE used END FROM (
    SELECT l.group_id, l.i, l.n, t.used, coalesce(list_filter(os, lambda o: NOT list_contains(t.used, o.n))[1].n, 0) AS best
    FROM t JOIN l ON l.group_id = t.group_id AND l.i = t.i + 1 LEFT JOIN options ON options.group_id = l.group_id AND options.first = l.n)),
used AS (SELECT k.group_id, coalesce(last(t.used ORDER BY i), []::BIGINT[]) AS used, count(*) FILTER (WHERE i > 0) AS m FROM keys k JOIN t USING (group_id) GROUP BY k.group_id),
sides AS (SELECT group_id, list(DISTINCT label) AS seen FROM l GROUP BY group_id),
rest AS (SELECT b.*, u.m, s.seen, row_number() OVER (PARTITION BY b.group_id ORDER BY score DESC, (x2 - x1) * (y2 - y1) DESC, n) AS i FROM boxes b JOIN used u USING (group_id) LEFT JOIN sides s USING (group_id) WHERE origin = 'sam3' AND NOT list_contains(u.used, n)),
named AS (SELECT *, CASE WHEN label IS NOT NULL THEN label WHEN len(seen) = 1 THEN CASE seen[1] WHEN 'Left' THEN 'Right' ELSE 'Left' END ELSE 'unknown' END AS side,
  CASE WHEN label IS NOT NULL THEN label_source WHEN len(seen) = 1 THEN 'sam3_opposite_of_single_mediapipe' WHEN len(seen) >= 2 THEN 'sam3_extra_when_mediapipe_has_both' ELSE 'sam3_only_unknown' END AS why,
  label IS NULL AND coalesce(len(seen), 0) >= 2 AS debug FROM rest),
counted AS (SELECT *, m + coalesce(sum(CASE WHEN debug THEN 0 ELSE 1 END) OVER (PARTITION BY group_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM named),
jobs AS (SELECT t.group_id, t.i - 1 AS job, t.first, t.second, CASE WHEN b.label IS NOT NULL THEN b.label ELSE a.label END AS side, CASE WHEN b.label IS NOT NULL THEN b.label_source ELSE a.label_source END AS why,
    CASE WHEN t.second > 0 THEN 'mediapipe+sam3' ELSE 'mediapipe' END AS origin, false AS debug_only, least(a.x1, coalesce(b.x1, a.x1)) AS g0, least(a.y1, coalesce(b.y1, a.y1)) AS g1, greatest(a.x2, coalesce(b.x2, a.x2)) AS g2, greatest(a.y2, coalesce(b.y2, a.y2)) AS g3
  FROM t JOIN boxes a ON a.group_id = t.group_id AND a.n = t.first LEFT JOIN boxes b ON b.group_id = t.group_id AND b.n = t.second WHERE t.i > 0
  UNION ALL SELECT group_id, m + i - 1, 0, n, side, why, 'sam3', debug, x1, y1, x2, y2 FROM counted WHERE before < 2),
kept AS (SELECT j.*, k.camera_id FROM jobs j JOIN keys k USING (group_id) JOIN used u USING (group_id) WHERE job < greatest(2, u.m)),
prior AS (SELECT *, CASE camera_id WHEN 'C0' THEN 'Left' WHEN 'C3' THEN 'Right' END AS prior, side IN ('Left', 'Right') AND NOT starts_with(why, 'sam3_only_unknown') AS fixed FROM kept)
SELECT group_id, camera_id, job, first::DOUBLE AS first, second::DOUBLE AS second, CASE WHEN camera_id = 'C2' THEN 'Right' WHEN prior IS NOT NULL AND NOT fixed THEN prior ELSE side END AS label,
  CASE WHEN camera_id = 'C2' THEN 'camera_override:C2' WHEN prior IS NOT NULL AND NOT fixed THEN 'camera_prior:' || camera_id ELSE why END AS label_source, origin, debug_only, {grown} FROM prior"""


def _suppress() -> str:
    return f"""WITH RECURSIVE {_BOXES}, b AS (SELECT group_id, camera_id, n, x1, y1, x2, y2, label_source AS s, is_right AS r FROM boxes),
t(group_id, camera_id, i, kept) AS (SELECT DISTINCT group_id, camera_id, 0::BIGINT, []::STRUCT(n BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, s VARCHAR, r DOUBLE)[] FROM b UNION ALL
  SELECT group_id, camera_id, n, CASE WHEN twin IS NULL THEN list_append(kept, me)
      WHEN me.s = 'prompt' AND twin.s <> 'prompt' THEN list_transform(kept, lambda k: CASE WHEN k.n = twin.n THEN {{'n': k.n, 'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2, 's': me.s, 'r': me.r}} ELSE k END) ELSE kept END
  FROM (SELECT b.group_id, b.camera_id, b.n, t.kept, {{'n': b.n, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 's': b.s, 'r': b.r}} AS me,
      list_filter(t.kept, lambda k: b.s <> 'hypothesis' AND k.s <> 'hypothesis' AND greatest(0, least(b.x2, k.x2) - greatest(b.x1, k.x1)) * greatest(0, least(b.y2, k.y2) - greatest(b.y1, k.y1))
        / least((b.x2 - b.x1) * (b.y2 - b.y1), (k.x2 - k.x1) * (k.y2 - k.y1)) >= 0.6)[1] AS twin
    FROM t JOIN b ON b.group_id = t.group_id AND b.n = t.i + 1)),
last AS (SELECT group_id, camera_id, max_by(kept, i) AS kept FROM t GROUP BY ALL)
SELECT group_id, camera_id, k.n AS n, k.s AS label_source, k.r AS is_right FROM (SELECT group_id, camera_id, unnest(kept) AS k FROM last)"""


#: Prediction records that count, each with the number of its points' source.
_PREDICTIONS = """preds AS (
  SELECT vec_id AS pos, vec_id // 8 AS group_id, 'C' || (vec_id % 4) AS camera_id, CASE WHEN (vec_id // 4) % 2 = 0 THEN 'Left' ELSE 'Right' END AS hand, embedding AS e, vec_id AS v,
    CASE WHEN vec_id % 5 < 3 THEN floor((vec_id * 37 % 101) / 100.0::DOUBLE * 4) / 4 END AS mask, CASE WHEN vec_id % 5 = 3 THEN (vec_id * 37 % 101) / 100.0::DOUBLE END AS detector,
    vec_id * 13 % 1100 AS x1, vec_id * 17 % 800 AS y1, 40 + vec_id % 90 AS w, 30 + vec_id % 70 AS h, 1 + vec_id % 3 / 10.0::DOUBLE AS scale, (vec_id * 37 % 101) / 100.0::DOUBLE AS quality
  FROM embeddings WHERE vec_id % 19 <> 7 AND vec_id % 41 <> 5 AND vec_id % 23 <> 9 AND (vec_id % 3 = 0 OR (vec_id % 29 <> 3 AND vec_id % 31 <> 4))
)"""


def _palm_candidates() -> str:
    raw = _PREDICTIONS + ", raw AS (SELECT pos, j AS joint, e[3 * j + 1]::DOUBLE AS x, e[3 * j + 2]::DOUBLE AS y, e[3 * j + 3]::DOUBLE AS z FROM preds, range(21) AS t(j))"
    return f"""WITH {raw}, {_AXES},
q AS (SELECT pos, group_id, hand, camera_id, 0.55 * CASE WHEN mask IS NOT NULL THEN mask WHEN detector IS NOT NULL THEN detector WHEN v % 7 = 0 THEN 0 ELSE 0.28 END
  + CASE WHEN v % 11 <> 6 THEN 0.15 * CASE WHEN w * h / 1080000.0::DOUBLE < 0.003 THEN w * h / 1080000.0::DOUBLE / 0.003 WHEN w * h / 1080000.0::DOUBLE <= 0.12 THEN 1 ELSE 0.12 / (w * h / 1080000.0::DOUBLE) END
    + 0.12 * least(1, greatest(0, (least(x1, y1, 1200 - x1 - w, 900 - y1 - h) + 20) / 80.0::DOUBLE)) ELSE 0 END
  + 0.06 * CASE v % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 0.5 END + CASE WHEN v % 3 <> 1 THEN 0.05 ELSE 0 END - 0.04 * (scale - 1) AS quality FROM preds),
o AS (SELECT r.pos, (r.x - wx) * x1 + (r.y - wy) * x2 + (r.z - wz) * x3 AS x, (r.x - wx) * y1 + (r.y - wy) * y2 + (r.z - wz) * y3 AS y, (r.x - wx) * z1 + (r.y - wy) * z2 + (r.z - wz) * z3 AS z
  FROM raw r JOIN g USING (pos) WHERE r.joint = 8)
SELECT pos, group_id, hand, camera_id, round(quality, 6) AS quality, {_r("x", "y", "z")} FROM q JOIN o USING (pos)"""


def _choice() -> str:
    orders = {"crop": "coalesce(mask, -1) DESC, abs(scale - 1), v % 3 <> 1 DESC, pos", "record": "coalesce(mask, -1) DESC, v % 3 <> 1 DESC, quality DESC, pos"}
    each = " UNION ALL ".join(f"SELECT group_id, hand, camera_id, '{k}' AS by, pos FROM (SELECT *, row_number() OVER (PARTITION BY group_id, hand, camera_id ORDER BY {o}) AS r FROM p) WHERE r = 1" for k, o in orders.items())
    return f"WITH {_PREDICTIONS}, p AS (SELECT * REPLACE ('C' || (pos % 2) AS camera_id) FROM preds) {each}"


def _hypotheses() -> str:
    return f"""WITH {_BOXES}, h AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, 2) AS w, greatest(y2 - y1, 2) AS h,
  unnest(CASE WHEN label IS NOT NULL THEN [label] ELSE ['Left', 'Right'] END) AS hand, CASE WHEN label IS NOT NULL THEN 'known' ELSE 'unknown_hypothesis' END AS status FROM boxes),
k AS (SELECT *, unnest([0.9, 1.0, 1.2]::DOUBLE[]) AS scale FROM h)
SELECT group_id, camera_id, n, hand, status, CASE hand WHEN 'Right' THEN 1 ELSE 0 END AS is_right, scale, round(least(1199, greatest(0, cx - w * scale / 2)), 6) AS c0, round(least(899, greatest(0, cy - h * scale / 2)), 6) AS c1,
  round(least(1199, greatest(0, cx + w * scale / 2)), 6) AS c2, round(least(899, greatest(0, cy + h * scale / 2)), 6) AS c3 FROM k"""


def _precedence() -> str:
    return f"""WITH {_BOXES}, b AS (SELECT *, CASE WHEN n % 3 < 2 THEN label END AS own, CASE WHEN n % 2 = 0 THEN score END AS sure FROM boxes),
l AS (SELECT *, own IS NULL AND label_source = 'prompt' AS trusted FROM b)
SELECT group_id, camera_id, n, CASE WHEN own IS NOT NULL THEN own WHEN trusted THEN CASE is_right WHEN 1 THEN 'Right' ELSE 'Left' END ELSE '' END AS label, CASE WHEN own IS NOT NULL OR trusted THEN label_source ELSE '' END AS source,
  round(CASE WHEN own IS NOT NULL THEN coalesce(sure, -1) WHEN trusted THEN coalesce(sure, score, -1) ELSE -1 END, 6) AS confidence, own IS NULL AND NOT trusted AS prior FROM l"""


def _spaces() -> str:
    return f"""WITH {_RAW}, records AS (SELECT *, min(pos) OVER (PARTITION BY group_id, camera_id) AS rec FROM hands), good AS (SELECT * FROM records WHERE pos % 3 <> 0 OR pos % 4 <> 0),
last AS (SELECT * FROM (SELECT *, max(rec) OVER (PARTITION BY group_id) AS top FROM good) WHERE rec = top), one AS (SELECT group_id, hand, max(pos) AS pos FROM last GROUP BY ALL)
SELECT o.group_id, o.hand, joint, {_r("x", "y", "z")} FROM one o JOIN raw USING (pos)"""


def _glove() -> str:
    order = [0, 1, 2, 3, None, *range(4, 20)]
    joints = ", ".join(f"({i}, {-1 if j is None else j})" for i, j in enumerate(order))
    at = lambda j, k: f"e[3 * {j} + {k}]::DOUBLE"
    value = lambda j, k: f"CASE WHEN s = -1 THEN 2 * {at(3, k)} - {at(2, k)} ELSE {at('s', k)} END"
    return f"""WITH o(joint, s) AS (VALUES {joints}), sides(hand, f) AS (VALUES ('Left', 1), ('Right', -1)), p AS (SELECT vec_id + 1 AS group_id, hand, joint, f * ({value("s", 1)} - {at(0, 1)}) AS x,
  {value("s", 2)} - {at(0, 2)} AS y, {value("s", 3)} - {at(0, 3)} AS z FROM (SELECT vec_id, embedding AS e FROM embeddings), o, sides WHERE hand = 'Left' OR vec_id % 7 <> 2)
SELECT group_id, hand, joint, {_r("x", "y", "z")} FROM p"""


def _seeds() -> str:
    return f"""WITH {_BOXES}, f AS (SELECT * REPLACE ('C' || (group_id // 256) AS camera_id) FROM boxes), frames AS (SELECT camera_id, group_id, row_number() OVER (PARTITION BY camera_id ORDER BY group_id) - 1 AS v FROM (SELECT DISTINCT camera_id, group_id FROM f)),
good AS (SELECT f.*, v, min(v) OVER (PARTITION BY camera_id) AS low FROM f JOIN frames USING (camera_id, group_id) WHERE v < 10 AND score >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY score DESC, (x2 - x1) * (y2 - y1) DESC, n) AS rank FROM good WHERE v = low)
SELECT camera_id, group_id, v AS video_frame_index, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""


def _rig() -> str:
    turn = {"x": "CASE camera_id WHEN 'C0' THEN x WHEN 'C1' THEN -y WHEN 'C2' THEN -x ELSE y END", "y": "CASE camera_id WHEN 'C0' THEN y WHEN 'C1' THEN x WHEN 'C2' THEN -y ELSE -x END", "z": "(abs(z) + 1)"}
    size = "sqrt(x ** 2 + y ** 2 + (abs(z) + 1) ** 2)"
    c = "substr(camera_id, 2, 1)::DOUBLE"
    return f"""WITH {_RAW} SELECT pos, joint, round({c} * 0.1, 6) AS ox, round({c} * {c} * 0.05, 6) AS oy, 0.0::DOUBLE AS oz, {", ".join(f"round({v} / {size}, 6) + 0.0 AS d{a}" for a, v in turn.items())} FROM raw"""


def _shapes() -> str:
    kinds = {
        "plain": ["x1", "y1", "x2", "y2"],
        "padded": [f"least({top}, greatest(0, {m} {sign} greatest(x2 - x1, y2 - y1, 2) * 0.625))" for m, sign, top in (("(x1 + x2) / 2", "-", 1199), ("(y1 + y2) / 2", "-", 899), ("(x1 + x2) / 2", "+", 1199), ("(y1 + y2) / 2", "+", 899))],
        "clipped": ["l", "t", "least(1199, greatest(l + 2, x2))", "least(899, greatest(t + 2, y2))"],
    }
    where = {"clipped": "WHERE least(1199, greatest(l + 2, x2)) - l >= 4 AND least(899, greatest(t + 2, y2)) - t >= 4"}
    each = " UNION ALL ".join(f"SELECT pos, '{k}' AS kind, {', '.join(f'round({v}, 6) + 0.0 AS v{i}' for i, v in enumerate(vs))} FROM b {where.get(k, '')}" for k, vs in kinds.items())
    return f"""WITH {_RAW}, p AS (SELECT pos, x * 300 + 600 AS x, y * 300 + 450 AS y FROM raw WHERE z > -0.2), b AS (SELECT *, least(1198, greatest(0, x1)) AS l, least(898, greatest(0, y1)) AS t FROM (
  SELECT pos, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM p GROUP BY pos HAVING count(*) >= 4)) {each}"""


def _refined() -> str:
    palm = ", ".join(f"(r.x - wx) * {n}1 + (r.y - wy) * {n}2 + (r.z - wz) * {n}3 AS {n}" for n in "xyz")
    return f"""WITH {_RAW}, {_AXES}, o AS (SELECT r.pos, r.group_id, r.hand, r.camera_id, r.quality, r.joint, {palm} FROM raw r JOIN g USING (pos)),
e AS (SELECT o.pos, avg(sqrt((o.x - b.x) ** 2 + (o.y - b.y) ** 2 + (o.z - b.z) ** 2)) AS error FROM o JOIN o b ON b.camera_id = 'C0' AND b.group_id = o.group_id - 1 AND b.hand = o.hand AND b.joint = o.joint GROUP BY o.pos)
SELECT pos, coalesce(round(error, 6), -1) AS error, round(quality + 0.2 * (1 - quality) - CASE WHEN error IS NULL THEN 0 ELSE 0.25 * least(error, 1.5) / 1.5 END, 6) + 0.0 AS score FROM (SELECT DISTINCT pos, quality FROM o) LEFT JOIN e USING (pos)"""


def _replay() -> str:
    """Sums over the best matchings, whose overlaps differ between equal ones only in order."""
    best = _optimal()
    chain, _, _ = best.rpartition("SELECT group_id, camera_id, m AS pairs")
    chain = chain.replace("t(group_id, camera_id, m, i, used, total)", "t(group_id, camera_id, m, i, used, total, ious)").replace("[]::BIGINT[], 0.0::DOUBLE FROM o", "[]::BIGINT[], 0.0::DOUBLE, []::DOUBLE[] FROM o")
    chain = chain.replace("max(total + o.iou) FROM t", "max(total + o.iou), arg_max(list_append(ious, o.iou), total + o.iou) FROM t")
    return f"""{chain.rstrip()}, best AS (SELECT group_id, arg_max(ious, total) AS ious FROM t WHERE i = m GROUP BY group_id), v AS (SELECT group_id % 5 = 0 AS k, unnest(ious) AS iou FROM best),
r AS (SELECT count(*) AS n, count(*) FILTER (WHERE group_id % 5 <> 0) AS o FROM boxes WHERE origin = 'sam3')
SELECT any_value(r.n) AS reference, count(*) AS matched, any_value(r.o) AS nonkey_reference, count(*) FILTER (WHERE NOT k) AS nonkey_matched, round(count(*) FILTER (WHERE iou >= 0.5) / any_value(r.n), 6) + 0.0 AS recall,
  round(avg(iou), 6) + 0.0 AS mean, round(count(*) FILTER (WHERE iou >= 0.5 AND NOT k) / any_value(r.o), 6) + 0.0 AS nonkey_recall, round(avg(iou) FILTER (WHERE NOT k), 6) + 0.0 AS nonkey_mean FROM v, r"""


def oracle_sql() -> dict[str, str]:
    stats = "count(error) AS n, avg(error) AS mean, median(error) AS median, sqrt(avg(error * error)) AS rmse, quantile_cont(error, 0.9) AS p90, quantile_cont(error, 0.95) AS p95, max(error) AS max"
    errors = _FUSED.format(where="WHERE camera_id <> 'C3'") + f""", errors AS (
  SELECT p.hand, p.joint, {_FINGER.replace('joint', 'p.joint')} AS finger, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) AS error
  FROM fused p JOIN root t ON t.camera_id = 'C3' AND t.sequence_id = p.sequence_id AND t.group_id = p.group_id AND t.hand = p.hand AND t.joint = p.joint)"""
    area = "(c3 - c1) * (c4 - c2)"
    ema = f"""x AS (SELECT sequence_id, hand, camera_id, joint, axis, group_id, v AS x, group_id - row_number() OVER (PARTITION BY sequence_id, hand, camera_id, joint, axis ORDER BY group_id) AS island
  FROM (SELECT *, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS v FROM raw)),
y AS (SELECT *, group_id - min(group_id) OVER (PARTITION BY sequence_id, hand, camera_id, joint, axis, island) AS i FROM x),
z AS (SELECT sequence_id, hand, camera_id, joint, axis, island, group_id, i, x AS v FROM y WHERE i = 0 UNION ALL
  SELECT y.sequence_id, y.hand, y.camera_id, y.joint, y.axis, y.island, y.group_id, y.i, 0.6 * y.x + 0.4 * z.v
  FROM z JOIN y ON y.sequence_id = z.sequence_id AND y.hand = z.hand AND y.camera_id = z.camera_id AND y.joint = z.joint AND y.axis = z.axis AND y.island = z.island AND y.i = z.i + 1)"""
    near = "CASE WHEN lag(seq, {s}) OVER w = seq - ({s}) THEN lag(x, {s}) OVER w ELSE x END"
    cov = ", ".join(f"covar_pop({a}, t{b}) AS c{a}{b}" for a in "xyz" for b in "xyz")
    means = ", ".join([*(f"avg({c}) AS m{c}" for c in "xyz"), *(f"avg(t{c}) AS mt{c}" for c in "xyz")])
    moment_names = [*(f"m{c}" for c in "xyz"), *(f"mt{c}" for c in "xyz"), *(f"c{a}{b}" for a in "xyz" for b in "xyz"), "variance"]
    return {
        "frames_filter_range": f"WITH {_HANDS} SELECT pos, group_id, camera_id, hand FROM hands WHERE camera_id IN ('C0', 'C2') AND (group_id BETWEEN 3 AND 20 OR group_id = 24 OR group_id BETWEEN 30 AND 44)",
        "stride_sample": f"WITH {_HANDS} SELECT pos, group_id, camera_id, 'group' AS kind FROM hands WHERE group_id % 5 = 0 UNION ALL SELECT pos, group_id, camera_id, 'rank' FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY group_id, pos) - 1 AS r FROM hands) WHERE r % 7 = 2 UNION ALL SELECT pos, group_id, camera_id, 'odd' FROM hands WHERE group_id % 2 = 1",
        "view_argmax": f"WITH {_HANDS}, d AS (SELECT pos, group_id, hand, 'C' || (pos % 2) AS camera_id, floor(quality * 4) / 4 AS quality FROM hands) SELECT group_id, hand, camera_id, pos, quality FROM (SELECT *, row_number() OVER (PARTITION BY group_id, hand, camera_id ORDER BY quality DESC, pos) AS r FROM d) WHERE r = 1",
        "fuse_mean": f"WITH {_FUSED.format(where='')} SELECT {_K}, joint, {_r('x', 'y', 'z', 'spread')}, views FROM fused",
        "fuse_quality_weighted": f"WITH {_ROOT}, w AS (SELECT *, greatest(quality, 0.05) AS w FROM root), o AS (SELECT {_K}, joint, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z, count(*) AS views FROM w GROUP BY {_K}, joint) SELECT {_K}, joint, {_r('x', 'y', 'z')}, views FROM o",
        "fuse_medoid": f"""WITH {_ROOT}, d AS (SELECT {_K}, a.camera_id, b.camera_id AS other, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d, greatest(max(b.quality), 0.05) AS w, max(a.quality) AS q
  FROM root a JOIN root b USING ({_K}, joint) GROUP BY {_K}, a.camera_id, b.camera_id), c AS (SELECT {_K}, camera_id, sum(d * w) / sum(w) AS cost, max(q) AS q FROM d GROUP BY {_K}, camera_id)
SELECT {_K}, camera_id, {_r('cost')} FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY round(cost, 9), q DESC, camera_id) AS r FROM c) WHERE r = 1""",
        "fuse_mean_smoothed": _gaussian(),
        "bone_median_of_medians": f"WITH {_BONES}, m AS (SELECT hand, camera_id, bone, median(length) AS m FROM lengths GROUP BY ALL HAVING count(*) >= 3) SELECT hand, bone, round(median(m), 6) + 0.0 AS length, count(*) AS cameras FROM m GROUP BY hand, bone",
        "palm_local": _palm(),
        "sequence_shape": f"""WITH {_ROOT}, best AS (
  SELECT sequence_id, hand, pos FROM (SELECT sequence_id, hand, pos, row_number() OVER (PARTITION BY sequence_id, hand ORDER BY quality DESC, pos) AS r FROM hands) WHERE r <= 40
), long AS (
  SELECT r.sequence_id, r.hand, 3 * joint + axis AS d, [x, y, z][axis + 1] AS v, greatest(quality, 1e-3) AS w FROM root r JOIN best USING (sequence_id, hand, pos), range(3) AS t(axis)
), running AS (
  SELECT *, sum(w) OVER (PARTITION BY sequence_id, hand, d ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY sequence_id, hand, d) AS total,
    count(*) OVER (PARTITION BY sequence_id, hand, d) AS n FROM long
) SELECT sequence_id, hand, n, CAST(d AS INTEGER) AS d, round(greatest(-3, least(3, min(v))), 6) + 0.0 AS v FROM running WHERE run >= 0.5 * total - 1e-12 GROUP BY sequence_id, hand, n, d""",
        "mask_overlap": f"""WITH {_OVERLAP.format(least=0.25)}, pixels AS (
  SELECT group_id, camera_id, n, greatest(0, ceil(x1 - 0.5)) AS l, greatest(0, ceil(y1 - 0.5)) AS t, least(1200, ceil(x2 - 0.5)) AS r, least(900, ceil(y2 - 0.5)) AS b FROM boxes
), counted AS (
  SELECT f.group_id, f.camera_id, f.n, f.match, greatest(0, p.r - p.l) * greatest(0, p.b - p.t) AS a1, greatest(0, q.r - q.l) * greatest(0, q.b - q.t) AS a2,
    greatest(0, least(p.r, q.r) - greatest(p.l, q.l)) * greatest(0, least(p.b, q.b) - greatest(p.t, q.t)) AS i
  FROM found f JOIN pixels p USING (group_id, camera_id, n) JOIN pixels q ON q.group_id = f.group_id AND q.camera_id = f.camera_id AND q.n = f.match
), shares AS (
  SELECT *, coalesce(i / nullif(a1 + a2 - i, 0), 0) AS iou, coalesce(i / nullif(a1, 0), 0) AS reference_coverage, coalesce(i / nullif(a2, 0), 0) AS candidate_coverage FROM counted
) SELECT group_id, camera_id, n, match, round(iou, 6) + 0.0 AS iou, round(reference_coverage, 6) + 0.0 AS reference_coverage, round(candidate_coverage, 6) + 0.0 AS candidate_coverage,
  round(0.45 * iou + 0.45 * reference_coverage + 0.10 * candidate_coverage, 6) + 0.0 AS score, round(coalesce(i / nullif(least(a1, a2), 0), 0), 6) + 0.0 AS within FROM shares""",
        # the poses that made the pixels: the solver has to find them again
        "pose_from_points": f"""WITH {_HANDS}, judged AS (
  SELECT *, CASE WHEN pos % 9 = 4 THEN 'few_points' WHEN pos % 13 = 5 THEN 'rejected' ELSE 'estimated' END AS status FROM hands
) SELECT pos, status, 0.0::DOUBLE AS off, CASE WHEN status = 'estimated' THEN round(quality - 0.5, 4) ELSE 0.0 END AS tx,
  CASE WHEN status = 'estimated' THEN round(pos % 7 * 0.05, 4) ELSE 0.0 END AS ty, CASE WHEN status = 'estimated' THEN (9 + pos % 5)::DOUBLE ELSE 0.0 END AS tz FROM judged""",
        "eval_grouping_sets": f"WITH {errors}, o AS (SELECT concat_ws('_', CASE WHEN grouping(hand) = 0 THEN 'hand' END, CASE WHEN grouping(finger) = 0 THEN 'finger' END, CASE WHEN grouping(joint) = 0 THEN 'joint' END) AS level, hand, finger, joint, {stats} FROM errors GROUP BY GROUPING SETS ((), (hand), (finger), (joint), (hand, finger))) SELECT CASE WHEN level = '' THEN 'overall' ELSE level END AS level, hand, finger, coalesce(joint, -1) AS joint, n, {_r('mean', 'median', 'rmse', 'p90', 'p95', 'max')} FROM o",
        "gate_diagnostics_3way": f"WITH {_GATE}, g AS (SELECT bucket, base.error - gated.error AS gain FROM base JOIN gated USING ({_K})) SELECT bucket, count(*) AS n, round(avg(gain), 6) + 0.0 AS mean, round(median(gain), 6) + 0.0 AS median, round(avg((gain > 1e-9)::DOUBLE), 6) + 0.0 AS positive FROM g GROUP BY bucket",
        "prefer_gated": f"WITH {_GATE}, g AS (SELECT * FROM gated WHERE group_id % 3 <> 1), o AS (SELECT {_K}, coalesce(g.error < 1.2, false) AS replaced, CASE WHEN g.error < 1.2 THEN g.error ELSE base.error END AS error FROM base LEFT JOIN g USING ({_K})) SELECT {_K}, {_r('error')}, replaced FROM o",
        "gap_fill": _fill(),
        "causal_ema": f"WITH RECURSIVE {_RAW}, {ema} SELECT sequence_id, hand, camera_id, joint, axis, group_id, round(v, 6) + 0.0 AS x FROM z",
        "velocity_feature": f"WITH {_SERIES}, v AS (SELECT user_id, seq, 0.5 * ({near.format(s=-1)} - {near.format(s=1)}) AS velocity FROM series WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id, seq, {_r('velocity')} FROM v",
        "hampel": f"WITH {_RAW}, {_hampel(3, 0.05, 1.0)} SELECT sequence_id, hand, camera_id, joint, group_id, {_r('x', 'y', 'z')}, replaced FROM hampel",
        "smooth_sequence": _smooth(),
        "depth_carry_forward": f"WITH {_SERIES} SELECT user_id, seq, last_value(CASE WHEN event_id % 3 = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS carried FROM series",
        "frame_rate": "WITH t AS (SELECT event_id % 10 AS camera, event_id // 10 AS g, (event_id // 10) * 0.04::DOUBLE + user_id % 7 * 0.001::DOUBLE AS sec FROM events WHERE event_id % 13 <> 4), s AS (SELECT camera, sec - lag(sec) OVER w AS step, g - lag(g) OVER w AS d FROM t WINDOW w AS (PARTITION BY camera ORDER BY g, sec)) SELECT camera, round(coalesce(1 / median(step) FILTER (WHERE d = 1 AND step > 0 AND step < 1), 25.0), 6) + 0.0 AS fps FROM s GROUP BY camera",
        "asof_linear": _asof("CASE WHEN upper = lower THEN a.v ELSE (1 - (mark - lower) / (upper - lower)) * a.v + (mark - lower) / (upper - lower) * b.v END"),
        "asof_nearest": _asof("CASE WHEN upper - mark <= mark - lower THEN b.v ELSE a.v END"),
        "bbox_features": f"""WITH {_BOXES}, c AS (SELECT *, least(1199, greatest(0, x1)) AS c1, least(899, greatest(0, y1)) AS c2, least(1199, greatest(0, x2)) AS c3, least(899, greatest(0, y2)) AS c4 FROM boxes),
a AS (SELECT *, {area} AS area, {area} / 1080000.0::DOUBLE AS share, least(c1, c2, 1200 - c3, 900 - c4) AS margin FROM c)
SELECT group_id, camera_id, n, round(area, 6) AS area, round(CASE WHEN share <= 0 THEN 0 WHEN share < 0.003 THEN share / 0.003 WHEN share <= 0.12 THEN 1.0 ELSE 0.12 / share END, 6) AS area_score,
  round(least(1, greatest(0, (margin + 20) / 80)), 6) AS edge_score, round(1 / (1 + (greatest(score - 0.5, 0) / 0.2) ** 2), 6) AS weight FROM a""",
        "bbox_best_overlap": f"WITH {_OVERLAP.format(least=0.25)} SELECT group_id, camera_id, n, coalesce(match, 0) AS match, {_r('iou')} FROM found",
        "match_recall": f"WITH {_OVERLAP.format(least=0.05)}, v AS (SELECT camera_id, coalesce(iou, 0) AS v FROM found) SELECT camera_id, count(*) AS n, round(avg((v >= 0.5)::DOUBLE), 6) + 0.0 AS recall, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(quantile_cont(v, 0.1), 6) + 0.0 AS p10 FROM v GROUP BY camera_id",
        "duplicate_label_repair": f"WITH {_LABELLED}, m AS (SELECT *, count(*) OVER k = 2 AND min(label) OVER k = max(label) OVER k AS twins, row_number() OVER (PARTITION BY group_id, camera ORDER BY score DESC, pos) AS r FROM labelled WINDOW k AS (PARTITION BY group_id, camera)) SELECT group_id, camera, pos, score, CASE WHEN twins AND r = 2 THEN CASE label WHEN 'Left' THEN 'Right' ELSE 'Left' END ELSE label END AS label FROM m",
        "spatial_handedness": f"WITH {_LABELLED} SELECT pos, CASE WHEN count(*) OVER (PARTITION BY group_id, camera) = 2 THEN CASE WHEN row_number() OVER (PARTITION BY group_id, camera ORDER BY score, pos) = 1 THEN 'Left' ELSE 'Right' END END AS label FROM labelled",
        "majority_vote": f"WITH {_LABELLED}, v AS (SELECT group_id // 16 AS track, label, sum(score) AS weight FROM labelled GROUP BY ALL) SELECT track, label, {_r('weight')} FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(weight, 9) DESC, label) AS r FROM v) WHERE r = 1",
        "anchor_hysteresis": f"WITH {_HANDS}, m AS (SELECT *, coalesce(max(quality) OVER k <= max(quality) FILTER (WHERE camera_id = 'C0') OVER k + 0.25, false) AND camera_id = 'C0' AS keep FROM hands WINDOW k AS (PARTITION BY {_K})) SELECT {_K}, camera_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY keep DESC, quality DESC, camera_id) AS r FROM m) WHERE r = 1",
        "weighted_median": f"WITH {_RAW}, w AS (SELECT group_id, hand, joint, x, greatest(quality, 0.05) AS w FROM raw), s AS (SELECT *, sum(w) OVER (PARTITION BY group_id, hand, joint ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY group_id, hand, joint) AS total FROM w) SELECT group_id, hand, joint, round(min(x), 6) + 0.0 AS x FROM s WHERE run >= 0.5 * total GROUP BY group_id, hand, joint",
        "chunk_groups": f"WITH {_HANDS}, g AS (SELECT DISTINCT camera_id, group_id FROM hands), r AS (SELECT *, (row_number() OVER (PARTITION BY camera_id ORDER BY group_id) - 1) // 16 AS chunk FROM g) SELECT camera_id, chunk, min(group_id) AS low, max(group_id) AS high, count(*) AS n FROM r GROUP BY camera_id, chunk",
        "merge_first_wins": f"WITH {_SHARDS} SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shard) AS r FROM shards) WHERE r = 1",
        "merge_conflicts": f"WITH {_SHARDS} SELECT doc_id, count(*) AS n_rows, count(DISTINCT n_chars || '/' || source) AS n_forms FROM shards GROUP BY doc_id HAVING count(*) > 1",
        "merge_last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
        "workload_report": "WITH j AS (SELECT l_linenumber % 4 AS camera, l_orderkey, count(*) AS jobs FROM lineitem GROUP BY ALL) SELECT camera, count(*) AS frames, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(ceil(jobs / 2)) AS BIGINT) AS batches, max(jobs) AS most FROM j GROUP BY camera",
        "knn_loo": f"WITH k AS ({_knn('vec_id >= 0', 'vec_id >= 0', 8)}) SELECT id, {_r('predicted', 'nearest')} FROM k",
        "ood_gate": f"WITH own AS ({_knn('vec_id % 2 = 0', 'vec_id % 2 = 0', 1)}), ask AS ({_knn('vec_id % 2 <> 0', 'vec_id % 2 = 0', 1)}), q AS (SELECT quantile_cont(nearest, 0.5) AS a, quantile_cont(nearest, 0.95) AS b FROM own) SELECT id, round(least(1, greatest(0.1, (greatest(b, a + 1e-8) - nearest) / (greatest(b, a + 1e-8) - a))), 6) + 0.0 AS gate FROM ask, q",
        "joint_offsets_shrunk": f"WITH {_PAIRS}, m AS (SELECT joint, count(*) AS n, avg(tx - x) * count(*) / (count(*) + 20.0) AS x, avg(ty - y) * count(*) / (count(*) + 20.0) AS y, avg(tz - z) * count(*) / (count(*) + 20.0) AS z FROM pairs WHERE group_id % 2 = 0 GROUP BY joint), c AS (SELECT *, least(1, 0.05 / greatest(sqrt(x * x + y * y + z * z), 1e-12)) AS s FROM m) SELECT joint, n, round(x * s, 6) + 0.0 AS x, round(y * s, 6) + 0.0 AS y, round(z * s, 6) + 0.0 AS z FROM c",
        "bone_scales": f"WITH {_BONES}, m AS (SELECT p.bone, count(*) AS n, median(t.length / p.length) AS m FROM lengths p JOIN lengths t ON t.camera_id = 'C3' AND t.sequence_id = p.sequence_id AND t.group_id = p.group_id AND t.hand = p.hand AND t.bone = p.bone WHERE p.camera_id = 'C0' AND p.length > 1e-6 AND t.length > 1e-6 GROUP BY p.bone) SELECT bone, n, round(greatest(0.7, least(1.4, 1 + n / (n + 20.0) * (m - 1))), 6) + 0.0 AS scale FROM m",
        "similarity_moments": f"WITH {_PAIRS}, m AS (SELECT hand, count(*) AS n, {means}, {cov}, var_pop(x) + var_pop(y) + var_pop(z) AS variance FROM pairs GROUP BY hand) SELECT hand, n, {_r(*moment_names)} FROM m",
        "bidirectional_ema": f"""WITH RECURSIVE {_SERIES}, s AS (SELECT user_id, seq, x, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM series),
f AS (SELECT user_id, i, x AS v FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.5 * s.x + 0.5 * f.v FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1),
b AS (SELECT user_id, k, x AS v FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, 0.5 * s.x + 0.5 * b.v FROM b JOIN s ON s.user_id = b.user_id AND s.k = b.k + 1)
SELECT s.user_id, s.seq, round((f.v + b.v) / 2, 6) + 0.0 AS x FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i JOIN b ON b.user_id = s.user_id AND b.k = s.k""",
        "view_quality": f"""WITH {_BOXES}, a AS (SELECT *, (x2 - x1) * (y2 - y1) / 1080000.0::DOUBLE AS share, least(x1, y1, 1200 - x2, 900 - y2) AS margin FROM boxes)
SELECT group_id, camera_id, n, round(0.55 * CASE WHEN n % 3 IN (0, 1) THEN least(1, greatest(0, score)) WHEN n % 2 = 0 THEN 0 ELSE 0.28 END
  + 0.15 * CASE WHEN share < 0.003 THEN share / 0.003 WHEN share <= 0.12 THEN 1.0 ELSE 0.12 / share END + 0.12 * least(1, greatest(0, (margin + 20) / 80))
  + 0.06 * 0.5 + CASE WHEN n % 4 = 0 THEN 0.05 ELSE 0 END - 0.04 * (n / 10.0), 6) AS quality FROM a""",
        "chunk_overlap": f"WITH {_HANDS}, g AS (SELECT DISTINCT camera_id, group_id FROM hands), r AS (SELECT *, (row_number() OVER (PARTITION BY camera_id ORDER BY group_id) - 1) // 16 AS chunk FROM g), c AS (SELECT camera_id, chunk, min(group_id) AS low, max(group_id) AS high FROM r GROUP BY ALL) SELECT g.camera_id, chunk, min(group_id) AS low, max(group_id) AS high, count(*) AS n FROM g JOIN c ON g.camera_id = c.camera_id AND g.group_id BETWEEN c.low - 2 AND c.high + 2 GROUP BY g.camera_id, chunk",
        "static_bones_applied": _static(),
        "frame_bounds": "WITH b AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS hand, min(event_id) AS low, max(event_id) AS high, count(*) AS n FROM events WHERE event_id % 13 <> 4 GROUP BY 1) SELECT hand, low, high, n, greatest(0, ceil((low - 7) * 25 / 60))::BIGINT AS first_group, floor((high - 7) * 25 / 60)::BIGINT AS last_group FROM b",
        "backup_gate": _gate_reason(),
        "camera_report": _report(),
        "reprojection": _reprojection(),
        "rotation_step": _turns(),
        "knuckle_frame": _knuckles(),
        "keyframe_decay": _decay(),
        "box_transforms": _transforms(),
        "crop_keypoints": _crop(),
        "fingertip_summary": f"WITH {_ROOT} SELECT pos, joint, CASE WHEN joint % 4 = 0 THEN 'tip' ELSE 'base' END AS part, round(sqrt(x ** 2 + y ** 2 + z ** 2), 6) AS length FROM root WHERE joint IN (2, 4, 5, 8, 9, 12, 13, 16, 17, 20)",
        "refined_candidates": _refined(),
        "replay_metrics": _replay(),
        "axis_affine": _affine(),
        "one_euro": _one_euro(),
        "rotation_smooth": _rotations(),
        "vote_automaton": _automaton(),
        "view_pivot": f"""WITH {_HANDS} SELECT group_id, hand, '{{' || string_agg('"' || camera_id || '":' || quality, ',' ORDER BY camera_id) || '}}' AS views FROM hands GROUP BY group_id, hand""",
        "triangulate_subsets": _subsets(),
        "bbox_greedy_match": _greedy(),
        "bbox_global_match": _global(),
        "bbox_optimal_match": _optimal(),
        "bbox_suppress": _suppress(),
        "palm_candidates": _palm_candidates(),
        "candidate_choice": _choice(),
        "job_hypotheses": _hypotheses(),
        "label_precedence": _precedence(),
        "joint_spaces": _spaces(),
        "last_hands": f"WITH {_HANDS}, r AS (SELECT *, min(pos) OVER (PARTITION BY group_id, camera_id) AS rec FROM hands WHERE group_id % 4 <> 1), o AS (SELECT group_id, hand, max_by(e[25]::DOUBLE, {{'r': rec, 'p': pos}}) AS x FROM r GROUP BY ALL) SELECT group_id, hand, round(x, 6) AS x FROM o",
        "glove_hands": _glove(),
        "dense_frames": f"WITH {_HANDS} SELECT camera_id, group_id, row_number() OVER (PARTITION BY camera_id ORDER BY group_id) - 1 AS video_frame_index FROM (SELECT DISTINCT camera_id, group_id FROM hands)",
        "seed_hands": _seeds(),
        "rig_rays": _rig(),
        "first_groups": f"WITH {_HANDS}, l AS (SELECT pos * 7919 % 10007 AS line, pos, group_id, camera_id FROM hands), g AS (SELECT group_id FROM l GROUP BY group_id ORDER BY min(line) LIMIT 20) SELECT * FROM l WHERE group_id IN (SELECT group_id FROM g)",
        "box_shapes": _shapes(),
        "byte_account": "SELECT count(*) AS records, CAST(coalesce(sum(strlen(coalesce(text, ''))), 0) AS BIGINT) AS bytes, count(source) AS with_source, count(text) AS with_text FROM documents WHERE lang = 'en'",
        "detection_ratios": f"WITH {_BOXES} SELECT camera_id, count(*) AS n, round(count(label) / count(*), 6) + 0.0 AS labelled, round(count(*) FILTER (WHERE score >= 0.5) / count(*), 6) + 0.0 AS strong FROM boxes GROUP BY camera_id",
        "huber_shift": _huber(),
        "triangulate_rays": _triangulate(),
    }
