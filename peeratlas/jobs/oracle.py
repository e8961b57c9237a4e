"""Independent SQL for the registered queries: named parts, put together by use."""

import re

_U64 = "18446744073709551616::UHUGEINT"


def _hash(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 100000) / 100000.0::DOUBLE"


def _cell(v: str, n: int) -> str:
    return f"least({n - 1}, CAST(floor({v} * {n}) AS INTEGER))"


def _byte(v: str, top: int = 255) -> str:
    return f"greatest(0, least({top}, CAST(round_even({v}, 0) AS INTEGER)))"


def _channel(n: int) -> str:
    k = f"fmod({n} + hue / 30, 12)"
    return f"light - sat * least(light, 1 - light) * greatest(-1, least({k} - 3, 9 - {k}, 1))"


def _colors(rows: str, hue: str, light: str, sat: str) -> str:
    """Colours of rows(community, ...) with jitters j1, j2, j3 from 64 mixed bits."""
    return f"""
    SELECT *, {_channel(0)} AS r, {_channel(8)} AS g, {_channel(4)} AS b FROM (
      SELECT *, {hue} AS hue, {light} AS light, {sat} AS sat FROM (
        SELECT *, (h % 65536) / 65535.0::DOUBLE * 2 - 1 AS j1, ((h // 65536) % 65536) / 65535.0::DOUBLE * 2 - 1 AS j2,
               ((h // 4294967296) % 65536) / 65535.0::DOUBLE * 2 - 1 AS j3 FROM (
          SELECT *, xor(z3, z3 // 2147483648::UHUGEINT) AS h FROM (
            SELECT *, (xor(z2, z2 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {_U64} AS z3 FROM (
              SELECT *, (xor(z1, z1 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {_U64} AS z2 FROM (
                SELECT *, (community::UHUGEINT + 11400714819323198485::UHUGEINT) % {_U64} AS z1 FROM ({rows})))))))"""


_HALF = 0.48
_HUE = "CASE WHEN members < {m} THEN 0 ELSE fmod(fmod(degrees(atan2(cy - 0.5, cx - 0.5)) + 8 * j1, 360) + 360, 360) END"
_LIGHT, _SAT = "CASE WHEN members < {m} THEN 0.30 + 0.06 * j1 ELSE 0.58 + 0.08 * j3 END", "CASE WHEN members < {m} THEN 0.03 ELSE 0.70 + 0.08 * j2 END"

PARTS = {
    "works": "SELECT l_orderkey AS work_id, count(*) AS n_authors, list('A' || l_partkey) AS author_ids FROM lineitem GROUP BY l_orderkey",
    "used": "SELECT l_partkey, CAST(count(*) AS INTEGER) AS works_count, CAST(sum(l_quantity) AS INTEGER) AS cited_by_count FROM lineitem GROUP BY l_partkey",
    "authors": "SELECT 'A' || p_partkey AS id, p_partkey, p_name AS display_name, works_count, cited_by_count, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS institution, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS field FROM part JOIN used ON l_partkey = p_partkey",
    "nodes": "SELECT * EXCLUDE (p_partkey) FROM authors WHERE works_count >= 20",
    "wa": "SELECT DISTINCT work_id, n_authors, unnest(author_ids) AS author_id FROM works WHERE n_authors BETWEEN 2 AND 8",
    "chosen": "SELECT wa.* FROM wa WHERE author_id IN (SELECT id FROM nodes)",
    "pairs": "SELECT a.work_id, a.author_id AS src, b.author_id AS dst, 1.0::DOUBLE / (a.n_authors - 1) AS w FROM chosen a JOIN chosen b ON a.work_id = b.work_id AND a.author_id < b.author_id",
    "edges": "SELECT src, dst, sum(w) AS weight FROM pairs GROUP BY src, dst",
    "numbered": "SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS node_idx, * FROM nodes",
    "layout": """SELECT 'A' || p_partkey AS id, p_name AS display_name,
        CASE WHEN p_partkey % 97 = 0 THEN 60.0::DOUBLE ELSE 1 END * (1000 * CAST(embedding[1] AS DOUBLE) + (p_partkey % 31) - 15) AS x,
        CASE WHEN p_partkey % 97 = 0 THEN 60.0::DOUBLE ELSE 1 END * (1000 * CAST(embedding[2] AS DOUBLE) + (p_partkey % 29) - 14) AS y,
        CAST(CASE WHEN p_partkey % 97 = 0 THEN 1000 + p_partkey % 5 ELSE label END AS INTEGER) AS community, works_count, cited_by_count,
        CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS institution, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS field
        FROM part JOIN used ON l_partkey = p_partkey JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)""",
    "middle": "SELECT median(x) AS cx, median(y) AS cy FROM layout",
    "cs": "SELECT cx, cy, greatest(median(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 1e-9) AS s FROM layout, middle GROUP BY cx, cy",
    "sized": "SELECT *, count(*) OVER (PARTITION BY community) AS comm_n FROM layout",
    "polar": "SELECT *, ln(rs + sqrt(rs * rs + 1)) AS a FROM (SELECT sized.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / s AS rs, atan2(y - cy, x - cx) AS theta FROM sized, cs)",
    "flagged": "SELECT *, comm_n < 100 AND a > 0.9::DOUBLE * (SELECT coalesce(nullif(max(a), 0), 1e-9) FROM polar) AS is_ring FROM polar",
    "placed": f"""SELECT *, CASE WHEN is_ring THEN 0.60::DOUBLE + 0.38::DOUBLE * ({_hash('id')}) ELSE least(a / (SELECT coalesce(nullif(max(a), 0), 1e-9) FROM flagged WHERE NOT is_ring), 1.0) END AS ru,
        CASE WHEN is_ring THEN 2 * pi() * ({_hash("id || '/t'")}) ELSE theta END AS th FROM flagged""",
    "core": "SELECT *, ru * cos(th) AS ex, ru * sin(th) AS ey FROM placed WHERE NOT is_ring",
    "shifted": "SELECT *, ex + CASE WHEN comm_n >= 180 THEN 0.6::DOUBLE * avg(ex) OVER (PARTITION BY community) ELSE 0 END AS sx, ey + CASE WHEN comm_n >= 180 THEN 0.6::DOUBLE * avg(ey) OVER (PARTITION BY community) ELSE 0 END AS sy FROM core",
    "smax": "SELECT greatest(max(sqrt(sx * sx + sy * sy)), 1e-9) AS smax FROM shifted",
    "web": f"""SELECT id, display_name, 0.5 + {_HALF}::DOUBLE * sx / smax AS xw, 0.5 + {_HALF}::DOUBLE * sy / smax AS yw, community, works_count, cited_by_count, institution, field, is_ring FROM shifted, smax
        UNION ALL SELECT id, display_name, 0.5 + {_HALF}::DOUBLE * ru * cos(th), 0.5 + {_HALF}::DOUBLE * ru * sin(th), community, works_count, cited_by_count, institution, field, is_ring FROM placed WHERE is_ring""",
    "ranked_fields": "SELECT community, field, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, field ASC NULLS LAST) AS rn FROM web GROUP BY community, field",
    "stats": "SELECT w.community, f.field AS majority_field, count(*) AS members, avg(xw) AS cx, avg(yw) AS cy FROM web w JOIN ranked_fields f ON f.community = w.community AND f.rn = 1 GROUP BY w.community, f.field",
    "palette": "SELECT community, r, g, b FROM (" + _colors("SELECT * FROM stats", _HUE.format(m=180), _LIGHT.format(m=180), _SAT.format(m=180)) + ")",
    "lut": f"SELECT real AS community, {_byte('r * 255')} AS r, {_byte('g * 255')} AS g, {_byte('b * 255')} AS b FROM ("
    + _colors("SELECT community AS real, CASE WHEN members < 180 THEN 0 ELSE community END AS community, CASE WHEN members < 180 THEN 0 ELSE members END AS members, cx, cy FROM stats", _HUE.format(m=180), _LIGHT.format(m=180), _SAT.format(m=180))
    + ")",
    "pixels": f"""SELECT px, py, CAST(sum(c) OVER (PARTITION BY px, py) AS BIGINT) AS cnt, community, row_number() OVER (PARTITION BY px, py ORDER BY c DESC, community) AS rn
        FROM (SELECT {_cell('xw', 262144)} AS px, {_cell('yw', 262144)} AS py, community, count(*) AS c FROM web GROUP BY ALL)""",
    "level10": "SELECT px, py, cnt, community FROM pixels WHERE rn = 1",
    **{
        f"level{z}": f"SELECT px >> 1 AS px, py >> 1 AS py, CAST(sum(cnt) AS BIGINT) AS cnt, first(community ORDER BY cnt DESC, {'py, px' if z == 9 else 'px, py'}) AS community FROM level{z + 1} GROUP BY px >> 1, py >> 1"
        for z in range(9, -1, -1)
    },
    "levels": " UNION ALL ".join(f"SELECT {z} AS z, px, py, cnt, community FROM level{z}" for z in range(10, -1, -1)),
    "lit": "SELECT z, px, py, cnt, community, 0.05::DOUBLE + 0.95::DOUBLE * pow(cume_dist() OVER (PARTITION BY z ORDER BY cnt), 1.25::DOUBLE) AS bright FROM levels",
    "base": "SELECT z, px // 256 AS tx, (1 << z) - 1 - py // 256 AS ty, px % 256 AS ix, 255 - py % 256 AS iy, coalesce(r, 0.35) * bright AS r, coalesce(g, 0.35) * bright AS g, coalesce(b, 0.35) * bright AS b FROM lit LEFT JOIN palette USING (community)",
    "splats": f"SELECT id, {_cell('xw', 262144)} AS px, {_cell('yw', 262144)} AS py, community, CASE WHEN cited_by_count >= 200000 THEN 3 WHEN cited_by_count >= 60000 THEN 2 ELSE 1 END AS rad0 FROM web WHERE NOT is_ring AND cited_by_count >= 800",
    "dxy": "SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS d) a, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS d) b",
    "spots": """SELECT x // 256 AS tx, 1023 - y // 256 AS ty, x % 256 AS ix, 255 - y % 256 AS iy, max(r) AS r, max(g) AS g, max(b) AS b FROM (
        SELECT px + dx AS x, py + dy AS y, px, py, coalesce(r, 0.6) AS r, coalesce(g, 0.6) AS g, coalesce(b, 0.6) AS b FROM splats JOIN dxy ON dx * dx + dy * dy <= rad0 * rad0 LEFT JOIN palette USING (community))
        WHERE x >= 0 AND y >= 0 AND x // 256 = px // 256 AND y // 256 = py // 256 GROUP BY ALL""",
    "points": f"SELECT id, {_cell('xw', 262144)} AS x, {_cell('yw', 262144)} AS y FROM web WHERE NOT is_ring",
    "lines": "SELECT p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM edges e JOIN points p ON p.id = src JOIN points q ON q.id = dst WHERE weight >= 0.5 AND sqrt((q.x - p.x)::DOUBLE ** 2 + (q.y - p.y)::DOUBLE ** 2) <= 4000",
    "samples": """SELECT CAST(round_even(x0 + k * ((x1 - x0) / steps::DOUBLE), 0) AS INTEGER) AS px, CAST(round_even(y0 + k * ((y1 - y0) / steps::DOUBLE), 0) AS INTEGER) AS py
        FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM (SELECT *, greatest(1, abs(x1 - x0), abs(y1 - y0)) AS steps FROM (SELECT x0 >> 2 AS x0, y0 >> 2 AS y0, x1 >> 2 AS x1, y1 >> 2 AS y1 FROM lines)))""",
    "ends": """SELECT src, dst, weight, p.xw AS xw0, p.yw AS yw0, q.xw AS xw1, q.yw AS yw1, p.community AS community0, q.community AS community1, p.cited_by_count AS cited0, q.cited_by_count AS cited1
        FROM edges JOIN (FROM web WHERE NOT is_ring) p ON p.id = src JOIN (FROM web WHERE NOT is_ring) q ON q.id = dst WHERE weight >= 0.5""",
    "qedges": f"""SELECT src, dst, weight, {_byte('xw0 * 65535', 65535)} AS x0, {_byte('yw0 * 65535', 65535)} AS y0, {_byte('xw1 * 65535', 65535)} AS x1, {_byte('yw1 * 65535', 65535)} AS y1,
        l0.r AS r0, l0.g AS g0, l0.b AS b0, l1.r AS r1, l1.g AS g1, l1.b AS b1, {_byte('greatest(0.0, least(round(weight, 9), 20.0)) / 20 * 255')} AS w,
        {_byte('greatest(sqrt(cited0), sqrt(cited1)) / 700 * 255')} AS s FROM ends JOIN lut l0 ON l0.community = community0 JOIN lut l1 ON l1.community = community1""",
    "twoway": "SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges",
    "label0": "SELECT DISTINCT node, node AS label FROM twoway",
    **{
        f"label{k}": f"SELECT node, arg_min(label, (-w, label)) AS label FROM (SELECT b.node, l.label, round(sum(weight), 9) AS w FROM twoway b JOIN label{k - 1} l ON l.node = b.other GROUP BY b.node, l.label) GROUP BY node"
        for k in (1, 2, 3)
    },
    "top": "SELECT community, count(*) AS members, avg(xw) AS xw, avg(yw) AS yw, sqrt(var_pop(xw) + var_pop(yw)) AS spread, row_number() OVER (ORDER BY count(*) DESC, community) AS rank FROM web GROUP BY community ORDER BY rank LIMIT 12",
    "topics": "SELECT w.community, a.institution AS topic FROM web w JOIN authors a ON a.id = w.id WHERE a.institution IS NOT NULL AND w.community IN (SELECT community FROM top)",
    "scores": "SELECT community, topic, c, c * ln((SELECT count(*) FROM topics) * 1.0::DOUBLE / g) AS score FROM (SELECT community, topic, count(*) AS c FROM topics GROUP BY 1, 2) JOIN (SELECT topic, count(*) AS g FROM topics GROUP BY 1) USING (topic)",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(score, 9) DESC, c DESC, topic) AS rn FROM scores) WHERE rn <= 5",
    "cands": "SELECT rank, t.community, coalesce(list(topic ORDER BY rn) FILTER (topic IS NOT NULL), []) AS l FROM top t LEFT JOIN best b ON b.community = t.community WHERE rank <= 10 GROUP BY rank, t.community",
    "naming": """SELECT 0::BIGINT AS rank, NULL::INTEGER AS community, []::VARCHAR[] AS taken
        UNION ALL SELECT c.rank, c.community, list_append(n.taken, coalesce(list_filter(c.l, lambda x: NOT list_contains(n.taken, x))[1],
          list_filter(list_transform(range(c.rank, c.rank + len(n.taken) + 1), lambda i: coalesce(c.l[1], 'Unnamed') || ' (' || i || ')'), lambda x: NOT list_contains(n.taken, x))[1]))
        FROM naming n JOIN cands c ON c.rank = n.rank + 1""",
    "named": "SELECT community, taken[-1] AS name FROM naming WHERE rank > 0",
    "cells": f"""SELECT cx, cy, first(community ORDER BY c DESC, community) AS community FROM (
        SELECT {_cell('xw', 32)} AS cx, {_cell('yw', 32)} AS cy, community, count(*) AS c FROM web WHERE NOT is_ring GROUP BY ALL) GROUP BY cx, cy HAVING sum(c) >= 2""",
    "around": "SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b",
    **{
        name: part
        for n, (before, after) in enumerate((("cells", "smooth"), ("smooth", "smoothb"), ("smoothb", "smoothc")))
        for name, part in (
            (f"voted{n}", f"SELECT c.cx, c.cy, c.community AS own, n.community, count(*) AS k FROM {before} c, around JOIN {before} n ON n.cx = c.cx + dx AND n.cy = c.cy + dy GROUP BY ALL"),
            (after, f"SELECT cx, cy, CASE WHEN count(*) = 1 THEN min(community) ELSE min(own) END AS community FROM (SELECT *, max(k) OVER (PARTITION BY cx, cy) AS top FROM voted{n}) WHERE k = top GROUP BY cx, cy"),
        )
    },
    "steps": """SELECT 'h' AS dir, a.cx + 1 AS line, a.cy AS pos FROM cells a JOIN cells b ON b.cx = a.cx + 1 AND b.cy = a.cy WHERE a.community <> b.community
        UNION ALL SELECT 'v', a.cy + 1, a.cx FROM cells a JOIN cells b ON b.cx = a.cx AND b.cy = a.cy + 1 WHERE a.community <> b.community""",
    "borders": """SELECT 'h' AS dir, a.cx + 1 AS line, a.cy AS pos FROM smoothc a JOIN smoothc b ON b.cx = a.cx + 1 AND b.cy = a.cy WHERE a.community <> b.community
        UNION ALL SELECT 'v', a.cy + 1, a.cx FROM smoothc a JOIN smoothc b ON b.cx = a.cx AND b.cy = a.cy + 1 WHERE a.community <> b.community""",
    "spans": "SELECT dir, line / 32.0::DOUBLE AS line, min(pos) / 32.0::DOUBLE AS a, (max(pos) + 1) / 32.0::DOUBLE AS b, row_number() OVER () AS seg FROM (SELECT *, pos - row_number() OVER (PARTITION BY dir, line ORDER BY pos) AS g FROM borders) GROUP BY dir, line, g",
    "sides": "SELECT seg, CASE WHEN dir = 'h' THEN {'x': line, 'y': a} ELSE {'x': a, 'y': line} END AS p, CASE WHEN dir = 'h' THEN {'x': line, 'y': b} ELSE {'x': b, 'y': line} END AS q FROM spans",
    "halves": "SELECT seg, p, q FROM sides UNION ALL SELECT seg, q, p FROM sides",
    "degrees": "SELECT p, count(*) AS n FROM halves GROUP BY p",
    "walks": """SELECT p AS start, q AS cur, seg, [p, q] AS pts FROM halves
        UNION ALL SELECT start, h.q, h.seg, list_append(pts, h.q) FROM walks w JOIN halves h ON h.p = w.cur AND h.seg <> w.seg WHERE w.cur <> w.start""",
    "paths": """SELECT pts FROM walks JOIN degrees a ON a.p = start JOIN degrees b ON b.p = cur WHERE a.n = 1 AND b.n = 1 AND start < cur
        UNION ALL SELECT pts FROM walks WHERE start = cur AND start = list_min(pts) AND pts[2] < pts[-2]""",
    "once": "SELECT pts AS raw, CASE WHEN len(pts) < 3 THEN pts ELSE list_concat([pts[1]], flatten(list_transform(range(1, len(pts)), lambda i: [{'x': pts[i].x * 0.75::DOUBLE + pts[i + 1].x * 0.25::DOUBLE, 'y': pts[i].y * 0.75::DOUBLE + pts[i + 1].y * 0.25::DOUBLE}, {'x': pts[i].x * 0.25::DOUBLE + pts[i + 1].x * 0.75::DOUBLE, 'y': pts[i].y * 0.25::DOUBLE + pts[i + 1].y * 0.75::DOUBLE}])), [pts[-1]]) END AS pts FROM paths",
    "curved": "SELECT list_sum(list_transform(range(1, len(raw)), lambda i: abs(raw[i].x - raw[i + 1].x) + abs(raw[i].y - raw[i + 1].y))) AS length, CASE WHEN len(raw) < 3 THEN pts ELSE list_concat([pts[1]], flatten(list_transform(range(1, len(pts)), lambda i: [{'x': pts[i].x * 0.75::DOUBLE + pts[i + 1].x * 0.25::DOUBLE, 'y': pts[i].y * 0.75::DOUBLE + pts[i + 1].y * 0.25::DOUBLE}, {'x': pts[i].x * 0.25::DOUBLE + pts[i + 1].x * 0.75::DOUBLE, 'y': pts[i].y * 0.25::DOUBLE + pts[i + 1].y * 0.75::DOUBLE}])), [pts[-1]]) END AS pts FROM once",
    "dots": "SELECT * EXCLUDE (z) FROM base WHERE z = 10",
    "hits": """SELECT px // 256 AS tx, 1023 - py // 256 AS ty, px % 256 AS ix, 255 - py % 256 AS iy, least(0.25::DOUBLE, count(*) * 0.05::DOUBLE) AS alpha FROM (
        SELECT CAST(round_even(x0 + k * ((x1 - x0) / steps::DOUBLE), 0) AS INTEGER) AS px, CAST(round_even(y0 + k * ((y1 - y0) / steps::DOUBLE), 0) AS INTEGER) AS py
        FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM (SELECT *, greatest(1, abs(x1 - x0), abs(y1 - y0)) AS steps FROM lines))) GROUP BY ALL""",
    "layered": """SELECT tx, ty, ix, iy, max(r) AS r, max(g) AS g, max(b) AS b FROM (
        SELECT tx, ty, ix, iy, r, g, b FROM dots
        UNION ALL SELECT tx, ty, ix, iy, alpha * 0.45::DOUBLE, alpha * 0.50::DOUBLE, alpha * 0.60::DOUBLE FROM hits WHERE (tx, ty) IN (SELECT (tx, ty) FROM dots) AND (tx, ty, ix, iy) NOT IN (SELECT (tx, ty, ix, iy) FROM dots)
        UNION ALL SELECT tx, ty, ix, iy, r, g, b FROM spots WHERE (tx, ty) IN (SELECT (tx, ty) FROM dots)) GROUP BY tx, ty, ix, iy""",
    "glow": """SELECT tx, ty, x AS ix, y AS iy, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b FROM (
        SELECT tx, ty, ix + dx AS x, iy + dy AS y, CASE WHEN dx <> 0 AND dy <> 0 THEN 0.06::DOUBLE ELSE 0.12::DOUBLE END AS w, r, g, b FROM layered, around WHERE dx <> 0 OR dy <> 0) WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255 GROUP BY ALL""",
    "drawn": "SELECT tx, ty, ix, iy, CAST(floor(least(greatest(sum(r), 0.0), 1.0) * 255) AS INTEGER) AS r, CAST(floor(least(greatest(sum(g), 0.0), 1.0) * 255) AS INTEGER) AS g, CAST(floor(least(greatest(sum(b), 0.0), 1.0) * 255) AS INTEGER) AS b FROM (SELECT * FROM layered UNION ALL SELECT * FROM glow) GROUP BY tx, ty, ix, iy",
    "norms": "SELECT id, display_name AS name, xw, yw, cited_by_count, trim(regexp_replace(lower(strip_accents(coalesce(display_name, ''))), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM web",
    "entries": """SELECT *, strlen(CAST(json_array(norm, coalesce(name, ''), id, xw, yw, cited_by_count) AS VARCHAR)) + 7 AS bytes FROM (
        SELECT *, unnest(CASE WHEN len(w) > 1 AND w[1] <> w[-1] AND length(w[-1]) >= 2 THEN [w[1], w[-1]] ELSE [w[1]] END) AS token FROM (SELECT *, string_split(norm, ' ') AS w FROM norms))""",
    "heads": """SELECT *, regexp_extract(token, '^[a-z]{2}') AS h2, regexp_extract(token, '^[a-z]{3}') AS h3, regexp_extract(token, '^[a-z]{4}') AS h4, regexp_extract(token, '^[a-z]{5}') AS h5 FROM entries""",
    "sums": """SELECT *, sum(bytes) OVER (PARTITION BY h2) AS s2, sum(bytes) OVER (PARTITION BY h2, h3) AS s3, sum(bytes) OVER (PARTITION BY h2, h3, h4) AS s4 FROM heads""",
    "sharded": """SELECT *, CASE WHEN h2 = '' THEN CASE WHEN s2 > 20000 AND token <> '' THEN '_' || (ord(token) % 128) ELSE '_' END
        WHEN s2 <= 20000 OR h3 = '' THEN h2 WHEN s3 <= 20000 OR h4 = '' THEN h3 WHEN s4 <= 20000 OR h5 = '' THEN h4 ELSE h5 END AS shard FROM sums""",
}


def communities_sql(levels: int, rounds: int, refine: int) -> str:
    """node, label, modularity of the same rounds of moves over "edges", every round on its
    own, without an early end."""
    parts = [("ways", "SELECT src AS node, dst AS other, CAST(round(weight / 1e-6::DOUBLE, 0) AS BIGINT) AS w FROM edges UNION ALL SELECT dst, src, CAST(round(weight / 1e-6::DOUBLE, 0) AS BIGINT) FROM edges")]
    parts.append(("twice", "SELECT CAST(sum(w) AS BIGINT) AS m FROM ways"))
    parts.append(("v0", "SELECT node, CAST(sum(w) AS BIGINT) AS degree FROM ways GROUP BY node"))
    parts.append(("g0", "SELECT node, other, w, degree FROM ways JOIN v0 USING (node)"))

    def moves(graph: str, members: str, n: int, salt: int) -> str:
        for k in range(salt, salt + n):
            parts.append((f"s{k}", f"SELECT m.node, m.community, m.degree, t.total, ('0x' || substr(md5(m.community || ':{k}'), 1, 8))::BIGINT % 2 = 1 AS takes FROM {members} m JOIN (SELECT community, CAST(sum(degree) AS BIGINT) AS total FROM {members} GROUP BY community) t USING (community)"))
            parts.append(
                (
                    f"c{k}",
                    f"""SELECT node, CASE WHEN NOT takes AND -best.lost > stay THEN best.community ELSE community END AS community, degree FROM (
    SELECT node, max(community) FILTER (own) AS community, bool_or(takes) FILTER (own) AS takes, max(degree) AS degree, max(score) FILTER (own) AS stay, min({{'lost': -score, 'community': community}}) FILTER (NOT own AND takes) AS best FROM (
      SELECT *, (SELECT m FROM twice)::DOUBLE * w::DOUBLE - 1.0::DOUBLE * degree::DOUBLE * (total - CASE WHEN own THEN degree ELSE 0 END)::DOUBLE AS score FROM (
        SELECT node, community, CAST(sum(w) AS BIGINT) AS w, max(total) AS total, bool_or(takes) AS takes, bool_or(own) AS own, max(degree) AS degree FROM (
          SELECT g.node, s.community, s.total, s.takes, g.w, g.degree, false AS own FROM {graph} g JOIN s{k} s ON s.node = g.other UNION ALL SELECT node, community, total, takes, 0, degree, true FROM s{k}) GROUP BY node, community)) GROUP BY node)""",
                )
            )
            members = f"c{k}"
        return members

    found, mapping = "v0", "SELECT node, node AS community FROM v0"
    for level in range(levels):
        parts.append((f"m{level}", f"SELECT node, node AS community, degree FROM {found}"))
        last = moves(f"g{level}", f"m{level}", rounds, level * rounds)
        mapping = f"SELECT p.node, c.community FROM ({mapping}) p JOIN {last} c ON c.node = p.community"
        if level + 1 < levels:
            found = f"v{level + 1}"
            parts.append((found, f"SELECT community AS node, CAST(sum(degree) AS BIGINT) AS degree FROM {last} GROUP BY community"))
            parts.append((f"g{level + 1}", f"SELECT node, other, w, degree FROM (SELECT a.community AS node, b.community AS other, CAST(sum(g.w) AS BIGINT) AS w FROM g{level} g JOIN {last} a ON a.node = g.node JOIN {last} b ON b.node = g.other WHERE a.community <> b.community GROUP BY 1, 2) JOIN {found} USING (node)"))
    parts.append(("joined", f"SELECT p.node, p.community, degree FROM ({mapping}) p JOIN v0 USING (node)"))
    last = moves("g0", "joined", refine, levels * rounds)
    parts.append(("labelled", f"SELECT node, min(node) OVER (PARTITION BY community) AS label FROM {last}"))
    parts.append(("within", "SELECT a.label, sum(weight) FILTER (a.label = b.label) AS inside, sum(weight) AS total FROM (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) e JOIN labelled a ON a.node = e.node JOIN labelled b ON b.node = e.other GROUP BY a.label"))
    body = ",\n".join(f"{name} AS MATERIALIZED ({part})" for name, part in parts)
    return f"SELECT * FROM (WITH {body}\nSELECT node, label, (SELECT round(sum(coalesce(inside, 0)) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) FROM within) AS modularity FROM labelled)"


def sql(select: str) -> str:
    """The statement with the parts it uses, in order."""
    wanted, todo = set(), [select]
    while todo:
        words = set(re.findall(r"[a-z_]+[0-9]*", todo.pop()))
        for name in words & PARTS.keys() - wanted:
            wanted.add(name)
            todo.append(PARTS[name])
    used = [name for name in PARTS if name in wanted]
    kind = "WITH RECURSIVE " if wanted & {"naming", "walks"} else "WITH "
    parts = ",\n".join(f"{name}{'(rank, community, taken)' if name == 'naming' else ''} AS ({PARTS[name]})" for name in used)
    return f"{kind}{parts}\n{select}" if used else select
