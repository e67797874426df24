"""DuckDB SQL for the queries of ``network``, with constants of its own."""

from __future__ import annotations

from .oracles import _graph

# Fixed values, written out here as well: the conductance of each type in the fixture.
_CONDUCTANCE = "cond(statement_type, conductance) AS (VALUES ('DIRECTOR_OF', 0.6::DOUBLE), ('OWNS', 0.9), ('DONATED_TO', 0.5), ('MEMBER_OF', 0.3), ('CONTRACTED_WITH', 0.5))"
_STEPS = f"""{_CONDUCTANCE},
    both_ways AS (SELECT subject_id AS a, object_id AS b, * FROM stm UNION ALL SELECT object_id, subject_id, * FROM stm),
    step AS (
        SELECT a, b, confidence * conductance AS factor, confidence, statement_id, sources
        FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY confidence * conductance DESC, statement_id) AS place FROM both_ways JOIN cond USING (statement_type)) WHERE place = 1),
    wanted AS (
        SELECT 'P' || c_custkey AS start_id, 'P' || c_custkey + 1 AS goal_id FROM customer WHERE c_custkey % 50 = 0
        UNION SELECT 'P' || c_custkey, 'R' || c_custkey % 5 FROM customer WHERE c_custkey % 50 = 0),
    trail AS (
        SELECT start_id, goal_id, b AS spot, [start_id, b] AS path, [statement_id] AS stmts, factor AS score, [(sources, confidence)] AS grounds, 1 AS hop FROM wanted JOIN step ON a = start_id
        UNION ALL
        SELECT start_id, goal_id, b, path || [b], stmts || [s.statement_id], score * factor * 0.85::DOUBLE, grounds || [(s.sources, s.confidence)], hop + 1
        FROM trail t JOIN step s ON s.a = t.spot
        WHERE hop < 4 AND t.spot <> goal_id AND t.spot NOT IN (SELECT entity_id FROM hubs) AND NOT list_contains(path, b)),
    chosen AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_id, goal_id ORDER BY round(score, 9) DESC, path)::INT AS place FROM trail WHERE spot = goal_id) WHERE place <= 3),
    grounded AS (
        SELECT start_id, goal_id, place, product(c) AS confidence, list_sort(list_distinct(flatten(list(sources)))) AS sources
        FROM (SELECT start_id, goal_id, place, g[1] AS sources, min(g[2]) AS c FROM (SELECT *, unnest(grounds) AS g FROM chosen) GROUP BY ALL) GROUP BY ALL),
    shown AS (SELECT c.start_id, c.goal_id, c.place, path, stmts, score, g.confidence, g.sources FROM chosen c JOIN grounded g USING (start_id, goal_id, place))"""
_CONTROL = f"""{_CONDUCTANCE},
    owned AS (
        SELECT subject_id AS o, object_id AS d, confidence * conductance AS share FROM stm JOIN cond USING (statement_type) WHERE statement_type = 'OWNS'
        UNION ALL SELECT 'C' || x.l_suppkey, 'C' || y.l_suppkey, round(least(1.0::DOUBLE, 0.4::DOUBLE + 6 * y.l_discount), 2)
        FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 AND x.l_quantity >= 49 AND y.l_quantity >= 49),
    base_held AS (SELECT o, d, max(share) AS share FROM owned WHERE o <> d GROUP BY 1, 2 HAVING max(share) >= 0.25),
    chain(o, d, share, steps) AS (
        SELECT o, d, share, 1 FROM base_held
        UNION SELECT c.o, b.d, c.share * b.share, steps + 1 FROM chain c JOIN base_held b ON b.o = c.d WHERE c.o <> b.d AND c.share * b.share >= 0.25 AND steps < 25),
    controls AS (
        SELECT o AS controller_id, d AS company_id, share, steps
        FROM (SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY share DESC, steps) AS place FROM chain) WHERE place = 1),
    common AS (
        SELECT controller_id, company_id, share, first_value(company_id) OVER w AS first_id, first_value(share) OVER w AS first_share, count(*) OVER (PARTITION BY controller_id) AS n_members
        FROM controls WINDOW w AS (PARTITION BY controller_id ORDER BY share DESC, company_id))"""


def _rank_rounds(rounds: int) -> str:
    parts = [
        """linked AS (
        SELECT a, b, sum(confidence) AS w FROM (SELECT subject_id AS a, object_id AS b, confidence FROM stm UNION ALL SELECT object_id, subject_id, confidence FROM stm) GROUP BY 1, 2),
    parted AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS part FROM linked),
    r0 AS (SELECT entity_id, 1.0::DOUBLE / count(*) OVER () AS rank FROM ents)"""
    ]
    for k in range(rounds):
        parts.append(f"""r{k + 1} AS MATERIALIZED (
        SELECT e.entity_id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(flow, 0) + loose / n) AS rank
        FROM ents e CROSS JOIN (SELECT count(*) AS n FROM ents)
            CROSS JOIN (SELECT coalesce(sum(rank), 0) AS loose FROM r{k} WHERE entity_id NOT IN (SELECT a FROM linked))
            LEFT JOIN (SELECT b, sum(rank * part) AS flow FROM parted JOIN r{k} ON r{k}.entity_id = a GROUP BY b) ON b = e.entity_id)""")
    return ",\n    ".join(parts)


def _between(levels: int) -> str:
    """Levels of shortest paths from each pivot, then what entities hand back, written out."""
    parts = ["""near AS MATERIALIZED (
        SELECT DISTINCT a, b FROM (SELECT subject_id AS a, object_id AS b FROM stm UNION ALL SELECT object_id, subject_id FROM stm)
        WHERE a NOT IN (SELECT entity_id FROM hubs) AND b NOT IN (SELECT entity_id FROM hubs)),
    l0 AS (SELECT entity_id AS source, entity_id AS node_id, 1.0::DOUBLE AS paths FROM ents WHERE entity_type = 'person' ORDER BY md5(entity_id), entity_id LIMIT 8)"""]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT source, node_id FROM l{i}" for i in range(k))
        parts.append(f"""l{k} AS MATERIALIZED (
        SELECT source, b AS node_id, sum(paths) AS paths FROM l{k - 1} JOIN near ON a = node_id WHERE (source, b) NOT IN ({seen}) GROUP BY 1, 2)""")
    parts.append(f"h{levels} AS (SELECT *, 0.0::DOUBLE AS handed FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        parts.append(f"""h{k} AS MATERIALIZED (
        SELECT l.source, l.node_id, any_value(l.paths) AS paths, coalesce(sum(l.paths / h.paths * (1 + h.handed)), 0) AS handed
        FROM l{k} l LEFT JOIN (near JOIN h{k + 1} h ON near.b = h.node_id) ON near.a = l.node_id AND h.source = l.source GROUP BY 1, 2)""")
    parts.append("handed AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, levels)) + ")")
    return ",\n    ".join(parts)


SQL: dict[str, str] = {
    "path_best": _graph(
        "SELECT start_id, goal_id, place, array_to_string(path, '>') AS path, array_to_string(stmts, ',') AS statement_ids, round(score, 6) AS score, round(confidence, 6) AS confidence, array_to_string(sources, ',') AS sources FROM shown",
        _STEPS,
    ),
    "path_connections": _graph(
        """SELECT start_id, goal_id, count(*) AS n_paths, sum(taken) AS n_independent, round(max(score), 6) AS best,
            round(1 - product(1 - taken * confidence), 6) AS confidence, round(1 - product(1 - score), 6) AS strength
        FROM (SELECT *, CASE WHEN place = 1 OR place = 2 AND free1 OR place = 3 AND free1 AND (free2 OR NOT second) THEN 1 ELSE 0 END AS taken
            FROM (SELECT x.*, len(list_intersect(x.sources, p.sources)) = 0 AS free1, len(list_intersect(x.sources, q.sources)) = 0 AS free2, len(list_intersect(p.sources, q.sources)) = 0 AS second
                FROM shown x JOIN shown p ON p.place = 1 AND p.start_id = x.start_id AND p.goal_id = x.goal_id
                    LEFT JOIN shown q ON q.place = 2 AND q.start_id = x.start_id AND q.goal_id = x.goal_id))
        GROUP BY start_id, goal_id""",
        _STEPS,
    ),
    "control_chains": _graph("SELECT controller_id, company_id, round(share, 6) AS share, steps FROM controls", _CONTROL),
    "control_common": _graph("SELECT controller_id, company_id, round(share, 6) AS share, first_id, round(first_share, 6) AS first_share, n_members FROM common WHERE n_members > 1", _CONTROL),
    "control_related": _graph(
        """SELECT first_id, company_id, count(*) AS n_controllers, round(1 - exp(sum(ln(greatest(1 - share * first_share, 1e-12)))), 6) AS confidence
        FROM common WHERE n_members > 1 AND first_id <> company_id GROUP BY 1, 2""",
        _CONTROL,
    ),
    "control_ultimate": _graph(
        """SELECT company_id, controller_id, round(share, 6) AS share, steps, row_number() OVER (PARTITION BY company_id ORDER BY share DESC, controller_id)::INT AS place
        FROM controls WHERE controller_id NOT IN (SELECT company_id FROM controls)""",
        _CONTROL,
    ),
    "centrality_pagerank": _graph("SELECT entity_id, round(rank, 9) AS rank FROM r10", _rank_rounds(10)),
    "centrality_betweenness": _graph("SELECT node_id AS entity_id, round(sum(handed), 6) AS betweenness FROM handed GROUP BY 1 HAVING sum(handed) > 0", _between(16)),
    "stream_loop_alerts": _graph(
        """SELECT company_id, day AS closed_at, tie_id, other.tie_id AS other_id, kind
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY day, tie_id) AS place FROM halves WHERE date_diff('day', other.day, day) <= 20) WHERE place = 1""",
        """landed AS (
            SELECT md5(concat_ws('|', statement_type, a, b, valid_from, amount)) AS tie_id, a AS company_id, statement_type AS kind, valid_from AS day
            FROM ties WHERE a LIKE 'C%' AND statement_type IN ('DONATED_TO', 'CONTRACTED_WITH')),
        halves AS (
            SELECT *, CASE kind WHEN 'DONATED_TO' THEN max(CASE WHEN kind = 'CONTRACTED_WITH' THEN {'day': day, 'tie_id': tie_id} END) OVER before
                ELSE max(CASE WHEN kind = 'DONATED_TO' THEN {'day': day, 'tie_id': tie_id} END) OVER before END AS other
            FROM landed WINDOW before AS (PARTITION BY company_id ORDER BY day, tie_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    ),
}
