"""The same queries in plain SQL, for exact checking."""

from __future__ import annotations

from ..functions.rng import below_sql as draw
from ..functions.rng import u32_sql as u
from ..operators.config import Layer
from . import tables as T

_S, _R, _D, _N = T.SAMPLES, T.ROOTS, T.DEPTH, T.DRAWS

#: Named relations, each over earlier ones.
RELATIONS: dict[str, str] = {
    "ids": "SELECT p_partkey AS id FROM part",
    "nodes": f"SELECT id, CASE WHEN {u('role', 'id')} % 100 < 85 THEN 'tr' WHEN {u('role', 'id')} % 100 < 90 THEN 'va' ELSE 'te' END AS role FROM ids",
    "ef": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey",
    "tr": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM nodes WHERE role = 'tr'",
    "et": "SELECT src, dst FROM ef WHERE src IN (SELECT id FROM tr) AND dst IN (SELECT id FROM tr)",
    "ev": "SELECT src, dst FROM ef WHERE src NOT IN (SELECT id FROM nodes WHERE role = 'te') AND dst NOT IN (SELECT id FROM nodes WHERE role = 'te')",
    "ei": "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM et",
    "deg": "SELECT tr.id, count(et.src) AS deg FROM tr LEFT JOIN et ON et.src = tr.id GROUP BY tr.id",
    "feat": "SELECT id, unnest([0,1,2,3])::INTEGER AS j, unnest([s, r, q, c]) AS v FROM (SELECT p_partkey AS id, p_size::BIGINT AS s, round(p_retailprice * 100)::BIGINT AS r, coalesce(q, 0)::BIGINT AS q, coalesce(c, 0)::BIGINT AS c FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)",
    "lab": "SELECT p_partkey AS id, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS y FROM part",
    "grid": f"SELECT a.range AS sg, b.range AS i FROM range({_S}) a, range({_N}) b",
    "w0": f"SELECT sg, i, tr.id AS v FROM (SELECT sg, i, {draw('(SELECT count(*) FROM tr)', 'root', 'sg', 'i')} AS r FROM grid WHERE i < {_R}) JOIN tr USING (r)",
    "w1": f"SELECT sg, i, coalesce(ei.dst, v) AS v FROM w0 JOIN deg ON deg.id = v LEFT JOIN ei ON ei.src = v AND deg > 0 AND ei.k = {draw('greatest(deg, 1)', 'hop1', 'sg', 'i')}",
    "w2": f"SELECT sg, i, coalesce(ei.dst, v) AS v FROM w1 JOIN deg ON deg.id = v LEFT JOIN ei ON ei.src = v AND deg > 0 AND ei.k = {draw('greatest(deg, 1)', 'hop2', 'sg', 'i')}",
    "sn": "SELECT DISTINCT sg, v FROM (SELECT sg, v FROM w0 UNION ALL SELECT sg, v FROM w1 UNION ALL SELECT sg, v FROM w2)",
    "lid": "SELECT sg, v, row_number() OVER (PARTITION BY sg ORDER BY v) - 1 AS lid FROM sn",
    "se": "SELECT a.sg, eid, src, dst, a.lid AS lsrc, b.lid AS ldst FROM ei JOIN lid a ON a.v = src JOIN lid b ON b.v = dst AND b.sg = a.sg",
    "cv": "SELECT tr.id, count(sn.v) AS c FROM tr LEFT JOIN sn ON sn.v = tr.id GROUP BY tr.id",
    "ce": "SELECT ei.eid, ei.src, ei.dst, count(se.eid) AS c FROM ei LEFT JOIN se ON se.eid = ei.eid GROUP BY ALL",
    "al": "SELECT eid, src, dst, cv.c AS c_v, ce.c AS c_e, CASE WHEN ce.c <> 0 THEN least(cv.c / ce.c, 1e4::DOUBLE) WHEN cv.c = 0 THEN 0.1::DOUBLE ELSE 1e4::DOUBLE END AS alpha FROM ce JOIN cv ON cv.id = src",
    "wt": "SELECT eid, src, dst, floor(1000000000 * (1.0::DOUBLE / a.deg + 1.0::DOUBLE / b.deg))::BIGINT AS w FROM ei JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE src <= dst",
    "wc": "SELECT *, (sum(w) OVER (ORDER BY eid))::BIGINT AS hi FROM wt",
    "pr": f"SELECT src, dst, w * {2.0 * _N}::DOUBLE / (sum(w) OVER ())::BIGINT AS p FROM (SELECT src, dst, floor(1e9::DOUBLE * (1.0::DOUBLE / a.deg + 1.0::DOUBLE / b.deg))::BIGINT AS w FROM et JOIN deg a ON a.id = src JOIN deg b ON b.id = dst)",
    "sc": f"SELECT id, y, j, {u('score', 'id', 'j')} % 1000 - 500 AS v FROM (SELECT p_partkey AS id, (p_size % {T.CLASSES})::INTEGER AS y, unnest(range({T.CLASSES}))::INTEGER AS j FROM part)",
    "pd": "SELECT id, y, (arg_max(j, v * 100 - j))::INTEGER AS pred FROM sc GROUP BY id, y",
    "lg": "SELECT y AS cls, 1 AS y, (pred = y)::INTEGER AS p FROM pd UNION ALL SELECT pred, 0, 1 FROM pd WHERE pred <> y",
    "cf": "SELECT cls, (count(*) FILTER (y = 1 AND p = 1))::BIGINT AS tp, (count(*) FILTER (y = 0 AND p = 1))::BIGINT AS fp, (count(*) FILTER (y = 1 AND p = 0))::BIGINT AS fn FROM lg GROUP BY cls",
    "mh": "SELECT doc_id AS id, unnest([0, 1])::INTEGER AS cls, unnest([coalesce(quality, 0), coalesce(toxic, 0)])::INTEGER AS y FROM documents LEFT JOIN labels USING (doc_id)",
    "mp": f"SELECT cls, y, ({u('multi', 'id', 'cls')} % 100 < 50)::INTEGER AS p FROM mh",
    "mc": "SELECT cls, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM mp GROUP BY cls",
    "ft": "SELECT j, sum(v)::DOUBLE / count(*) AS mean, CASE WHEN sp = 0 THEN 1.0::DOUBLE ELSE round(sqrt(sp::DOUBLE) / count(*), 6) END AS scale FROM (SELECT *, count(*) OVER (PARTITION BY j) * sum(v::HUGEINT * v) OVER (PARTITION BY j) - (sum(v::HUGEINT) OVER (PARTITION BY j)) * (sum(v::HUGEINT) OVER (PARTITION BY j)) AS sp FROM feat WHERE id IN (SELECT src FROM et)) GROUP BY j, sp",
    "sp1": "SELECT src AS id, j, sum(v)::BIGINT AS v FROM ef JOIN feat ON id = dst GROUP BY ALL",
    "wm": "SELECT a.range::INTEGER AS i, b.range::INTEGER AS o, ((a.range + 1) * (b.range + 2) % 5 - 2)::BIGINT AS w FROM range(9) a, range(3) b",
    "h": "SELECT id, o AS j, greatest(sum(v * w)::BIGINT + 1, 0) AS v FROM feat JOIN wm ON i = j GROUP BY ALL",
    "hs": "SELECT src AS id, j, sum(v)::BIGINT AS v FROM et JOIN h ON h.id = dst GROUP BY ALL",
    "hm": "SELECT h.id, h.j, coalesce(m, 0)::BIGINT AS v FROM h LEFT JOIN (SELECT src AS id, j, max(v) AS m FROM et JOIN h ON h.id = dst GROUP BY ALL) x ON x.id = h.id AND x.j = h.j",
    "gl": "SELECT id, CASE WHEN s < 0 THEN s ELSE s * 5 END AS s FROM (SELECT id, sum(v * (j + 1))::BIGINT AS s FROM h GROUP BY id)",
    "gr": "SELECT id, CASE WHEN s < 0 THEN s ELSE s * 5 END AS s FROM (SELECT id, sum(v * (1 - j))::BIGINT AS s FROM h GROUP BY id)",
    "ex": "SELECT *, exp(v / 1000.0::DOUBLE) AS e, v / 1000.0::DOUBLE AS x FROM sc",
    "sm": "SELECT id, y, j, exp(x - max(x) OVER w) / sum(exp(x - max_x)) OVER w AS p FROM (SELECT *, max(x) OVER (PARTITION BY id) AS max_x FROM ex) WINDOW w AS (PARTITION BY id)",
    "hz": "SELECT h.id, h.j, coalesce(hs.v, 0)::BIGINT AS v FROM h LEFT JOIN hs ON hs.id = h.id AND hs.j = h.j",
    "zp": "SELECT h.id, o AS j, sum(v * w)::BIGINT AS v FROM h JOIN wm ON i = h.j WHERE i < 3 GROUP BY ALL",
    "zm": "SELECT zp.id, zp.j, coalesce(m, 0)::BIGINT AS v FROM zp LEFT JOIN (SELECT src AS id, j, max(v) AS m FROM et JOIN zp ON zp.id = dst GROUP BY ALL) x ON x.id = zp.id AND x.j = zp.j",
    "hn": "SELECT h.id, h.j, coalesce(m, 0)::DOUBLE AS v FROM h LEFT JOIN (SELECT src AS id, j, sum(v)::DOUBLE / count(*) AS m FROM et JOIN h ON h.id = dst GROUP BY ALL) x ON x.id = h.id AND x.j = h.j",
    "lw": "SELECT nodes.id, CASE WHEN role = 'tr' THEN 20.0::DOUBLE / (CASE WHEN coalesce(c, 0) = 0 THEN 0.1::DOUBLE ELSE c::DOUBLE END) / (SELECT count(*) FROM tr) ELSE 0.0::DOUBLE END AS lam FROM nodes LEFT JOIN cv ON cv.id = nodes.id",
    "k1": "SELECT src, dst FROM ef WHERE src IN (SELECT src FROM ef GROUP BY src HAVING count(*) >= 90) AND dst IN (SELECT src FROM ef GROUP BY src HAVING count(*) >= 90)",
    "k2": "SELECT src, dst FROM k1 WHERE src IN (SELECT src FROM k1 GROUP BY src HAVING count(*) >= 90) AND dst IN (SELECT src FROM k1 GROUP BY src HAVING count(*) >= 90)",
    "k3": "SELECT src, dst FROM k2 WHERE src IN (SELECT src FROM k2 GROUP BY src HAVING count(*) >= 90) AND dst IN (SELECT src FROM k2 GROUP BY src HAVING count(*) >= 90)",
    "wd": "SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part",
    "vo": f"SELECT word, j, {u('vec', 'word', 'j')} % 1000 AS v FROM (SELECT word, unnest(range(4))::INTEGER AS j FROM (SELECT DISTINCT word FROM wd) WHERE {u('known', 'word')} % 5 > 0)",
    "an": "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ef",
    "fs": "SELECT id, j, round((v - mean) / scale, 4) AS v FROM feat JOIN ft USING (j)",
    "ch": f"SELECT sg, i, n, v, (SELECT least(deg, 10000) FROM deg WHERE id = v) AS d FROM (WITH RECURSIVE walk AS (SELECT sg, i, 0 AS n, tr.id AS v FROM (SELECT sg, i, {draw('(SELECT count(*) FROM tr)', 'frontier', 'sg', 'i')} AS r FROM grid WHERE i < 30) JOIN tr USING (r) UNION ALL SELECT sg, i, n + 1, coalesce(ei.dst, v) FROM walk JOIN deg ON deg.id = v LEFT JOIN ei ON ei.src = v AND deg > 0 AND ei.k = {draw('greatest(deg, 1)', 'mrw', 'sg', 'i', 'n + 1')} WHERE n < {_N - 30}) SELECT * FROM walk)",
    "cl": "SELECT sg, list(ds ORDER BY i) AS ds FROM (SELECT sg, i, list(d ORDER BY n) AS ds FROM ch GROUP BY sg, i) GROUP BY sg",
    "mw": f"SELECT sg, places FROM (WITH RECURSIVE moved AS (SELECT sg, ds, 0 AS step, list_transform(range(30), lambda x: 0) AS places FROM cl UNION ALL SELECT sg, ds, step + 1, list_transform(places, lambda a, p: a + (p = 1 + len(list_filter(range(1, 31), lambda q: list_sum(w[1:q]) <= r)))::INTEGER) AS places FROM (SELECT *, {draw('list_sum(w)::BIGINT', 'mrw-pick', 'sg', 'step')} AS r FROM (SELECT *, list_transform(range(1, 31), lambda p: ds[p][places[p] + 1]) AS w FROM moved WHERE step < {_N - 30}) WHERE list_sum(w) > 0)) SELECT *, row_number() OVER (PARTITION BY sg ORDER BY step DESC) AS last FROM moved) WHERE last = 1",
    "er": "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings",
}

_F1 = "round(CASE WHEN sum(2*tp+fp+fn) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(tp) / sum(2*tp+fp+fn) END, 9) AS f1_micro, round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2*tp+fp+fn) END), 9) AS f1_macro"
_BOTH = lambda q: f"SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM ({q}) UNION ALL SELECT b, a FROM ({q}))"

_ROWS = lambda q: f"SELECT id, j, round((v - m) / sqrt(avg((v - m) * (v - m)) OVER (PARTITION BY id) + 1e-9::DOUBLE), 4) AS v FROM (SELECT id, j, v, sum(v) OVER (PARTITION BY id) / count(*) OVER (PARTITION BY id)::DOUBLE AS m FROM ({q}))"


def _jump_sql(n: str) -> str:
    return f"floor(ln(({draw('4611686018427387904', 'b', 'eid', '0', n)}::DOUBLE + 0.5) / 4611686018427387904::DOUBLE) / ln(1 - p))::BIGINT"


def _source_sql(features: str, edges: str, train: int, val: int) -> str:
    """Roles by hash and features scaled by the training nodes with training edges."""
    role = f"CASE WHEN {u('role', 'id')} % 100 < {train} THEN 'tr' WHEN {u('role', 'id')} % 100 < {val} THEN 'va' ELSE 'te' END"
    return f"""SELECT id, role, j, round((v - mean) / sd + {T.OFF_HALVES}::DOUBLE, 3) + 0.0::DOUBLE AS v FROM (SELECT *, {role} AS role FROM ({features})) JOIN (SELECT j, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM ({features})
WHERE id IN (SELECT src AS id FROM ({edges}) WHERE src IN (SELECT id FROM ({features}) WHERE {role} = 'tr') AND dst IN (SELECT id FROM ({features}) WHERE {role} = 'tr')) GROUP BY j) USING (j)"""


def _network_sql() -> str:
    """The network of forward_full: its layer's outputs, rows of length 1, and the classifier."""
    f = lambda name: "(" + T.FORMULAS[name].format(o="0", i="j", c="c", h="0", k="0") + ")::DOUBLE"
    unit = f"SELECT id, j, v / sqrt(greatest(sum(v * v) OVER (PARTITION BY id), 1e-12::DOUBLE)) AS v FROM ({_layer_sql(T.NETWORK.layers[0], 'sum(v)')})"
    return f"SELECT id, c::INTEGER AS j, round(sum(v * {f('w')}) + {f('b')}, 4) + 0.0::DOUBLE AS v FROM ({unit}), (SELECT range AS c FROM range({T.NETWORK.classifier.outputs})) GROUP BY id, c"


def _layer_sql(layer: Layer, value: str = "round(sum(v), 4) + 0.0::DOUBLE") -> str:
    """A layer over scaled features fs and means over neighbours an, each hop a relation of (id, c, v)."""
    f = lambda name, **at: "(" + T.FORMULAS[name].format(**({k: "0" for k in "oichk"} | at)) + ")::DOUBLE"
    d, wide, ctes = layer.outputs // layer.heads, layer.outputs, []

    def relation(name: str, select: str) -> str:
        ctes.append(f"{name} AS MATERIALIZED ({select})")
        return name

    def dense(source: str, o: int) -> str:
        return f"SELECT id, c, greatest(sum(v * {f('w', o=str(o), i='j', c='c')}) + {f('b', o=str(o), c='c')}, 0) AS v FROM {source}, (SELECT range AS c FROM range({wide})) GROUP BY id, c"

    around = lambda x, c: f"SELECT x.id, x.{c}, coalesce(y.v, 0) AS v FROM {x} x LEFT JOIN (SELECT src AS id, {c}, sum(w * v) AS v FROM an JOIN {x} ON id = dst GROUP BY src, {c}) y ON y.id = x.id AND y.{c} = x.{c}"
    leaky = lambda x, name, o: f"(SELECT id, c // {d} AS hd, CASE WHEN sum(v * a) > 0 THEN sum(v * a) ELSE 0.2::DOUBLE * sum(v * a) END AS s FROM (SELECT id, c, v, {f(name, o=str(o), h=f'(c // {d})', k=f'(c % {d})')} AS a FROM {x}) GROUP BY id, c // {d})"
    hops, x = [], "fs"
    for o in range(layer.order + 1):
        hops.append(relation(f"h{o}", dense(x, o)))
        if layer.kind == "order" and o < layer.order:
            x = relation(f"x{o + 1}", around(x, "j"))
    if layer.kind == "gated":
        z = relation("zp", f"SELECT id, c, sum(v * {f('pool', i='j', c='c')}) AS v FROM fs, (SELECT range AS c FROM range({layer.gate})) GROUP BY id, c")
        best = f"SELECT x.id, x.c, coalesce(y.v, 0) AS v FROM {z} x LEFT JOIN (SELECT src AS id, c, max(v) AS v FROM an JOIN {z} ON id = dst GROUP BY src, c) y ON y.id = x.id AND y.c = x.c"
        joined = f"SELECT id, j AS i, v FROM fs UNION ALL SELECT id, {layer.inputs} + c, v FROM ({best}) UNION ALL SELECT id, {layer.inputs + layer.gate} + j, v FROM ({around('fs', 'j')})"
        relation("gates", f"SELECT id, hd, sum(v * {f('gate', i='i', c='hd')}) AS g FROM ({joined}), (SELECT range AS hd FROM range({layer.heads})) GROUP BY id, hd")
    if layer.kind == "joint":
        now = relation("hn", f"SELECT id, c, sum(v * {f('w', o='1', i='j', c='c')}) AS v FROM fs, (SELECT range AS c FROM range({wide})) GROUP BY id, c")
        end = lambda name: f"(SELECT id, c // {d} AS hd, sum(v * {f(name, o='0', h=f'(c // {d})', k=f'(c % {d})')}) + {f(f'{name}_b', h=f'(c // {d})')} AS s FROM {now} GROUP BY id, c // {d})"
        met = f"SELECT e.src AS id, n.c, sum(greatest(l.s + r.s, 0) * w * n.v) AS v FROM an e JOIN {now} n ON n.id = e.dst JOIN {end('own')} l ON l.id = e.src AND l.hd = n.c // {d} JOIN {end('other')} r ON r.id = e.dst AND r.hd = n.c // {d} GROUP BY e.src, n.c"
        hops[1] = relation("h1j", f"SELECT x.id, x.c, greatest(coalesce(y.v, 0) + {f('b', o='1', c='x.c')}, 0) AS v FROM {now} x LEFT JOIN ({met}) y ON y.id = x.id AND y.c = x.c")
    if layer.kind in ("attention", "gated"):
        for o in range(1, layer.order + 1):
            for s in range(o):
                now, own = hops[o], hops[o - s - 1]
                met = f"SELECT e.src AS id, n.c, sum((l.s + r.s) * w * n.v) AS v FROM an e JOIN {now} n ON n.id = e.dst JOIN {leaky(own, 'own', o - 1)} l ON l.id = e.src AND l.hd = n.c // {d} JOIN {leaky(now, 'other', o - 1)} r ON r.id = e.dst AND r.hd = n.c // {d} GROUP BY e.src, n.c"
                gate = f"JOIN gates g ON g.id = x.id AND g.hd = x.c // {d}" if layer.kind == "gated" else ""
                hops[o] = relation(f"h{o}_{s}", f"SELECT x.id, x.c, coalesce(y.v, 0) {'* g' if gate else ''} AS v FROM {now} x LEFT JOIN ({met}) y ON y.id = x.id AND y.c = x.c {gate}")
    part = f"id, c // {d}" if layer.kind == "attention" else "id"
    normed = lambda x, o: f"SELECT id, c, (v - m) / sqrt(avg((v - m) * (v - m)) OVER (PARTITION BY {part}) + 1e-9::DOUBLE) * {f('scale', o=str(o), c='c')} + {f('offset', o=str(o), c='c')} AS v FROM (SELECT *, avg(v) OVER (PARTITION BY {part}) AS m FROM {x})"
    rows = [normed(x, o) if layer.bias == "norm" else f"SELECT id, c, v FROM {x}" for o, x in enumerate(hops)]
    both = " UNION ALL ".join(f"SELECT id, (c + {o * wide if layer.aggr == 'concat' else 0})::INTEGER AS j, v FROM ({q})" for o, q in enumerate(rows))
    last = f"SELECT id, j, {value} AS v FROM ({both}) GROUP BY id, j"
    return f"WITH {', '.join(ctes)} {last}"


SELECTS: dict[str, str] = {
    "copurchase_edges": "SELECT * FROM ef",
    "symmetrize": _BOTH("SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL"),
    "embedding_edges": _BOTH("SELECT x.vec_id AS a, y.vec_id AS b FROM er x JOIN er y ON ((x.label = y.label AND y.r = x.r + 1) OR (y.label = (x.label + 1) % 10 AND y.r = x.r)) AND x.vec_id <> y.vec_id"),
    "role_counts": "SELECT role, count(*) AS n FROM nodes GROUP BY role",
    "edges_train": "SELECT * FROM et",
    "edges_val": "SELECT * FROM ev",
    "drop_dangling": "SELECT src, dst FROM ef WHERE src IN (SELECT id FROM nodes WHERE role = 'te') AND dst IN (SELECT id FROM nodes WHERE role = 'te')",
    "train_nodes_nonisolated": "SELECT DISTINCT src AS id FROM et",
    "degree": "SELECT * FROM deg",
    "deg_clipped": "SELECT id, least(deg, 100)::BIGINT AS deg FROM deg",
    "degree_stats": "SELECT count(*) AS n, sum(deg)::BIGINT AS total, min(deg) AS least, max(deg) AS most, sum(deg)::DOUBLE / count(*) AS mean FROM deg",
    "degree_cumsum": "SELECT id, deg, (sum(deg) OVER (ORDER BY id))::BIGINT AS cum FROM deg",
    "neighbor_rank": "SELECT src, dst, k, eid FROM ei",
    "edge_counts": "SELECT 'full' AS which, count(*) AS n FROM ef UNION ALL SELECT 'train', count(*) FROM et UNION ALL SELECT 'val', count(*) FROM ev",
    "row_tiles8": "SELECT id, id * 8 // (SELECT count(*) FROM nodes) AS tile FROM nodes",
    "eval_mask": "SELECT id, v FROM feat WHERE j = 0 AND id IN (SELECT id FROM nodes WHERE role <> 'tr')",
    "adj_transpose": "SELECT dst AS src, src AS dst FROM et",
    "edge_prob": "SELECT * FROM pr",
    "edge_prob_tri": "SELECT * FROM pr WHERE src <= dst",
    "edge_cumsum": "SELECT src, dst, w, hi AS cum FROM wc",
    "rw_sampler": "SELECT * FROM sn",
    "rw_hop": "SELECT * FROM w1",
    "node_sampler": f"SELECT DISTINCT sg, src AS v FROM grid JOIN ei ON eid = greatest({draw('(SELECT count(*) FROM ei)', 'n', 'sg', 'i')} - 1, 0)",
    "edge_sampler": f"SELECT DISTINCT sg, unnest([src, dst]) AS v FROM (SELECT sg, {draw('(SELECT max(hi) FROM wc)', 'e', 'sg', 'i')} AS s FROM grid) JOIN wc ON (hi - w < s AND s <= hi) OR (s = 0 AND hi = w)",
    "edge_sampler_bernoulli": f"SELECT DISTINCT sg, unnest([src, dst]) AS v FROM (WITH RECURSIVE c AS (SELECT eid, src, dst, (w * {_N})::DOUBLE / (SELECT sum(w) FROM wt)::DOUBLE AS p FROM wt), k AS (SELECT *, 0 AS n, {_jump_sql('0')} AS sg FROM c WHERE p < 1 UNION ALL SELECT eid, src, dst, p, n + 1, sg + 1 + {_jump_sql('n + 1')} FROM k WHERE sg < {_S}) SELECT sg, src, dst FROM k WHERE sg < {_S} UNION ALL SELECT range, src, dst FROM c, range({_S}) WHERE p >= 1)",
    "vanilla_node_sampler": f"SELECT DISTINCT sg, id AS v FROM grid JOIN tr ON r = {draw('(SELECT count(*) FROM tr)', 'vanilla', 'sg', 'i')}",
    "mrw_sampler": "SELECT DISTINCT ch.sg, v FROM ch JOIN mw ON mw.sg = ch.sg WHERE n <= places[i + 1]",
    "full_batch_sampler": f"SELECT range AS sg, id AS v FROM range({_S}), tr",
    "local_ids": "SELECT * FROM lid",
    "induced_subgraph": "SELECT sg, src, dst, lsrc, ldst, eid FROM se",
    "node_visits": "SELECT * FROM cv",
    "edge_visits": "SELECT src, dst, c FROM ce",
    "coverage": "SELECT count(*) AS total, count(DISTINCT v) AS nodes FROM sn",
    "pool_order": "SELECT sg, count(*) AS n FROM sn GROUP BY sg ORDER BY sg DESC LIMIT 1",
    "no_leakage": "SELECT count(*) AS leaked FROM sn WHERE v IN (SELECT id FROM nodes WHERE role <> 'tr')",
    "adj_norm": "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ef",
    "norm_loss_eval": "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS lambda FROM nodes",
    "num_batches": f"SELECT count(*) AS n, ceil(count(*) / {_R * _D}.0::DOUBLE)::BIGINT AS batches FROM tr",
    "gather_features": "SELECT sg, id, j, feat.v FROM sn JOIN feat ON id = sn.v",
    "gather_labels": "SELECT sg, id, y FROM sn JOIN lab ON id = v",
    "label_alignment": "SELECT count(*) AS n, (count(*) FILTER (y IS NULL OR role IS NULL))::BIGINT AS unmatched FROM lab FULL JOIN nodes USING (id)",
    "norm_aggr": "SELECT src, dst, c_v, c_e, alpha FROM al",
    "norm_loss": f"SELECT nodes.id, coalesce(c, 0)::BIGINT AS c_v, CASE WHEN role = 'tr' THEN {float(_S)}::DOUBLE / (CASE WHEN coalesce(c, 0) = 0 THEN 0.1::DOUBLE ELSE c::DOUBLE END) / (SELECT count(*) FROM tr) ELSE 0.0::DOUBLE END AS lambda FROM nodes LEFT JOIN cv ON cv.id = nodes.id",
    "subgraph_weights": "SELECT sg, se.src, se.dst, alpha / deg AS w FROM se JOIN al USING (eid) JOIN deg ON deg.id = se.src",
    "subgraph_rownorm": "SELECT sg, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY sg, src) AS w FROM se",
    "subgraph_indptr": "SELECT sg, lid, (sum(n) OVER (PARTITION BY sg ORDER BY lid) - n)::BIGINT AS indptr FROM (SELECT lid.sg, lid.lid, count(se.eid) AS n FROM lid LEFT JOIN se ON se.sg = lid.sg AND se.src = lid.v GROUP BY ALL)",
    "sample_offsets": "SELECT sg, n, (sum(n) OVER (ORDER BY sg) - n)::BIGINT AS start FROM (SELECT sg, count(*) AS n FROM sn GROUP BY sg)",
    "spmm_1hop": "SELECT * FROM sp1",
    "neighbor_mean": "SELECT src AS id, j, sum(v)::DOUBLE / count(*) AS v FROM ef JOIN feat ON id = dst GROUP BY ALL",
    "spmm_2hop": "SELECT src AS id, j, sum(v)::BIGINT AS v FROM ef JOIN sp1 ON id = dst GROUP BY ALL",
    "neighbor_max_pool": "SELECT feat.id, feat.j, coalesce(m, 0)::BIGINT AS v FROM feat LEFT JOIN (SELECT src AS id, j, max(v) AS m FROM et JOIN feat ON id = dst GROUP BY ALL) x ON x.id = feat.id AND x.j = feat.j",
    "hop_concat": "SELECT id, j, v FROM feat UNION ALL SELECT id, j + 4, v FROM sp1",
    "dense_layer": "SELECT id, o AS j, sum(v * w)::BIGINT + 7 AS v FROM feat JOIN wm ON i = j GROUP BY ALL",
    "relu_rows": "SELECT id, o AS j, greatest(sum(v * w)::BIGINT + 7, 0) AS v FROM feat JOIN wm ON i = j GROUP BY ALL",
    "sage_layer": "SELECT id, o AS j, greatest(sum(v * w)::BIGINT + 1, 0) AS v FROM feat JOIN wm ON i = j GROUP BY ALL UNION ALL SELECT id, o + 3, greatest(sum(v * w)::BIGINT + 1, 0) FROM sp1 JOIN wm ON i = j GROUP BY ALL",
    "reduce_sum_axis0": "SELECT j, sum(v)::BIGINT AS v FROM feat GROUP BY j",
    "scaler_fit": "SELECT * FROM ft",
    "scaler_transform": "SELECT id, j, round((v - mean) / scale, 4) AS v FROM feat JOIN ft USING (j)",
    "batch_norm": "SELECT id, j, round((v - mean) / sqrt(var + 1e-9::DOUBLE), 4) AS v FROM feat JOIN (SELECT j, sum(v)::DOUBLE / count(*) AS mean, (count(*) * sum(v::HUGEINT * v) - sum(v::HUGEINT) * sum(v::HUGEINT))::DOUBLE / count(*) / count(*) AS var FROM feat GROUP BY j) USING (j)",
    "label_onehot": "SELECT id, cls::INTEGER AS cls, (cls = y)::INTEGER AS y FROM lab, (SELECT unnest(range((SELECT max(y) + 1 FROM lab))) AS cls)",
    "label_multihot": "SELECT * FROM mh",
    "argmax_class": "SELECT id, pred FROM pd",
    "confusion_counts": "SELECT * FROM cf",
    "f1_single": f"SELECT {_F1} FROM cf",
    "f1_multi": f"SELECT {_F1} FROM mc",
    "accuracy": "SELECT round(sum((y = pred)::INTEGER)::DOUBLE / count(*), 9) AS accuracy FROM pd",
    "softmax_rows": "SELECT id, j, round(p, 9) AS v FROM sm",
    "sigmoid_rows": "SELECT id, j, round(1 / (1 + exp(-x)), 9) AS v FROM ex",
    "l2_normalize": "SELECT id, j, round(x / sqrt(greatest(sum(x * x) OVER (PARTITION BY id), 1e-12)), 6) AS v FROM ex",
    "row_layer_norm": "SELECT id, j, round((x - m) / sqrt(avg((x - m) * (x - m)) OVER (PARTITION BY id) + 1e-9), 6) AS v FROM (SELECT *, avg(x) OVER (PARTITION BY id) AS m FROM ex)",
    "loss_softmax": "SELECT id, round(ln(sum(e)) - sum(x) FILTER (j = y), 9) AS loss FROM ex GROUP BY id",
    "loss_sigmoid": "SELECT id, j, round(greatest(x, 0) - x * (j = y)::INTEGER + ln(1 + exp(-abs(x))), 9) AS loss FROM ex",
    "loss_grad": "SELECT id, j, round((p - (j = y)::INTEGER) / (SELECT count(*) FROM part), 12) AS v FROM sm",
    "matmul": "SELECT a.i, b.j, sum(a.v * b.v)::BIGINT AS v FROM (SELECT (id % 4)::INTEGER AS i, j, sum(v)::BIGINT AS v FROM feat GROUP BY ALL) a JOIN (SELECT (id % 4)::INTEGER AS i, j, sum(v)::BIGINT AS v FROM feat GROUP BY ALL) b ON a.j = b.i GROUP BY ALL",
    "gat_attention": "SELECT src AS id, j, sum((gl.s + gr.s) * v)::BIGINT AS v FROM et JOIN gl ON gl.id = src JOIN gr ON gr.id = dst JOIN h ON h.id = dst GROUP BY ALL",
    "gaan_gate": f"SELECT id, o AS j, round(sum(v * w) + {T.OFF_HALVES}::DOUBLE, 2) AS v FROM (SELECT id, j, v::DOUBLE AS v FROM h UNION ALL SELECT id, j + 3, v::DOUBLE FROM zm UNION ALL SELECT id, j + 6, v FROM hn) x JOIN wm ON i = x.j WHERE o < 2 GROUP BY ALL",
    "jk_concat": _ROWS("SELECT id, o AS j, greatest(sum(v * w)::BIGINT + 1, 0) AS v FROM (SELECT id, j, v FROM h UNION ALL SELECT id, j + 3, v FROM hz) x JOIN wm ON i = x.j GROUP BY ALL"),
    "jk_max": _ROWS("SELECT h.id, o AS j, greatest(sum(greatest(h.v, hz.v) * w)::BIGINT + 1, 0) AS v FROM h JOIN hz ON h.id = hz.id AND h.j = hz.j JOIN wm ON i = h.j GROUP BY ALL"),
    "sage_mean": f"SELECT id, o AS j, round(sum(v) + {T.OFF_HALVES}::DOUBLE, 2) AS v FROM (SELECT id, o, greatest(sum(v * w) + 1, 0) AS v FROM (SELECT id, j, v::DOUBLE AS v FROM h) JOIN wm ON i = j GROUP BY ALL UNION ALL SELECT id, o, greatest(sum(v * w) + 1, 0) FROM hn JOIN wm ON i = j GROUP BY ALL) GROUP BY ALL",
    "loss_softmax_weighted": "SELECT round(sum(lam * loss), 6) AS loss FROM (SELECT id, ln(sum(exp(x - top))) + max(top) - sum(x) FILTER (j = y) AS loss FROM (SELECT *, max(x) OVER (PARTITION BY id) AS top FROM ex) GROUP BY id) JOIN lw USING (id)",
    "loss_sigmoid_weighted": "SELECT round(sum(lam * (greatest(x, 0) - x * (j = y)::INTEGER + ln(1 + exp(-abs(x))))), 6) AS loss FROM ex JOIN lw USING (id)",
    "f1_threshold": f"SELECT {_F1} FROM (SELECT cls, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM (SELECT j AS cls, (j = y)::INTEGER AS y, (1 / (1 + exp(-x)) > 0.5)::INTEGER AS p FROM ex) GROUP BY cls)",
    "dropout_rows": f"SELECT id, j, CASE WHEN {u('drop', 'id', 'j')} % 100 >= 20 THEN v / 0.8::DOUBLE ELSE 0 END AS v FROM feat",
    "runs_mean_std": f"SELECT round(avg(hits), 6) AS mean, round(stddev_samp(hits), 6) AS std FROM (SELECT run, sum(({u('run', 'run', 'id')} % {T.CLASSES} = y)::INTEGER) AS hits FROM (SELECT DISTINCT id, y FROM sc), (SELECT range AS run FROM range(10)) GROUP BY run)",
    "best_epoch": f"SELECT epoch, hits FROM (SELECT epoch, hits, max(hits) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT epoch, sum(({u('epoch', 'epoch', 'id')} % {T.CLASSES} = y)::INTEGER)::BIGINT AS hits FROM (SELECT DISTINCT id, y FROM sc), (SELECT range AS epoch FROM range(50)) GROUP BY epoch)) WHERE best IS NULL OR hits > best",
    "role_explode": "SELECT role, id FROM nodes",
    "class_map_explode": "SELECT id, y FROM lab",
    "export_node_flags": "SELECT id, role = 'te' AS test, role = 'va' AS val FROM nodes",
    "char4grams": "SELECT gram, count(*) AS n FROM (SELECT substr(p_name, unnest(range(1, length(p_name) - 2))::INTEGER, 4) AS gram FROM part WHERE length(p_name) >= 4) GROUP BY gram",
    "mean_vector": "SELECT id, j, sum(v)::DOUBLE / count(*) AS v FROM wd JOIN vo USING (word) GROUP BY ALL",
    "topk_labels": "SELECT p_partkey AS id, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)",
    "label_merge": f"SELECT p_partkey AS id, ({u('merge', 'p_brand')} % 7)::INTEGER AS y FROM part",
    "kcore_prune": "SELECT * FROM k3",
    "forward_full": _network_sql(),
    "part_grams": "SELECT id, gram, count(*) AS n FROM (SELECT p_partkey AS id, substr(p_name, unnest(range(1, length(p_name) - 2))::INTEGER, 4) AS gram FROM part WHERE length(p_name) >= 4) GROUP BY ALL",
    "source_parts": _source_sql("SELECT id, j, v::DOUBLE AS v FROM feat", "SELECT src, dst FROM ef", 85, 90),
    "source_documents": _source_sql("SELECT doc_id AS id, unnest([0, 1, 2, 3, 4])::INTEGER AS j, unnest([coalesce(n_chars, 0)::DOUBLE, coalesce((lang = 'de')::INTEGER, 0), coalesce((lang = 'en')::INTEGER, 0), coalesce((lang = 'es')::INTEGER, 0), coalesce((lang = 'fr')::INTEGER, 0)])::DOUBLE AS v FROM documents", _BOTH("SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL"), 75, 85),
    "source_embeddings": _source_sql("SELECT vec_id AS id, (unnest(range(len(embedding))))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings", _BOTH("SELECT x.vec_id AS a, y.vec_id AS b FROM er x JOIN er y ON ((x.label = y.label AND y.r = x.r + 1) OR (y.label = (x.label + 1) % 10 AND y.r = x.r)) AND x.vec_id <> y.vec_id"), 50, 75),
} | {name: f"SELECT * FROM ({_layer_sql(layer)})" for name, (layer, _) in T.LAYERS.items()}


def oracle_sql() -> dict[str, str]:
    """Each query with the relations it needs."""
    import re

    out = {}
    for name, select in SELECTS.items():
        need, todo = set(), [select]
        while todo:
            for r in re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)|,\s*(\w+)\b", todo.pop()):
                for x in r:
                    if x in RELATIONS and x not in need:
                        need.add(x)
                        todo.append(RELATIONS[x])
        with_ = ",\n".join(f"{r} AS ({RELATIONS[r]})" for r in RELATIONS if r in need)
        out[name] = f"WITH {with_}\n{select}" if with_ else select
    return out
