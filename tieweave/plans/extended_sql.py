"""DuckDB SQL for the queries of ``extended``."""

from __future__ import annotations

from .landed_sql import SQL as LANDED
from .oracles import _COMPONENTS, _GRAPH, _PEOPLE, _found, _graph, _insight, _keyed, _plain, _sorted
from .oracles import SQL as PLAIN

_SLOT = "nullif(regexp_extract(slots, '(^|;){}=([^;]*)', 2), '')"


def _slot(name: str) -> str:
    return _SLOT.format(name)


def _gbp(name: str) -> str:
    return f"format('{{:,}}', round({_slot(name)}::DECIMAL(28,6))::BIGINT)"


_LOSERS = f"""{_COMPONENTS},
    kept AS (SELECT component, entity_id AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, entity_id) AS place
        FROM comps JOIN (SELECT entity_id, count(*) AS n FROM ends GROUP BY 1) USING (entity_id)) WHERE place = 1),
    losers AS (SELECT entity_id, survivor FROM comps JOIN kept USING (component) WHERE entity_id <> survivor)"""
_BIRTHS = """
    births AS (SELECT 'P' || c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN '19' || 10 + c_custkey % 7 WHEN 1 THEN '19' || 10 + c_custkey % 7 || '-0' || 1 + c_custkey % 2 END AS dob FROM customer)"""
_ATTRIBUTES = """
    attrs AS (SELECT 'P' || c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN 'N' || c_nationkey END AS nation FROM customer)"""
_COVERAGE = LANDED["news_coverage"]
_CONSTELLATION = PLAIN["constellation"]
_MERGED = f"""{_COMPONENTS},
    okeys AS (SELECT entity_id, {_sorted("regexp_replace(" + _plain("name") + ", '(^| )(the|ltd|limited|plc|llp|llc|lp|inc|incorporated|cyf|cyfyngedig)( |$)', ' ', 'g')")} AS key FROM ents WHERE entity_type IN ('organisation', 'company')),
    pairs2 AS (SELECT a, b FROM ppairs UNION SELECT min(entity_id) OVER (PARTITION BY key), entity_id FROM okeys WHERE key <> ''),
    sym2 AS (SELECT a, b FROM pairs2 WHERE a <> b UNION SELECT b, a FROM pairs2 WHERE a <> b),
    reach2(n, r) AS (SELECT a, a FROM sym2 UNION SELECT sym2.b, reach2.r FROM reach2 JOIN sym2 ON sym2.a = reach2.n),
    comps2 AS (SELECT n AS entity_id, min(r) AS component FROM reach2 GROUP BY n),
    res AS (SELECT DISTINCT source_code, entity_id FROM (SELECT source_code, a AS entity_id FROM ties UNION ALL SELECT source_code, b FROM ties)),
    kept2 AS (SELECT component, entity_id AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, entity_id) AS place
        FROM comps2 JOIN (SELECT entity_id, count(*) AS n FROM res GROUP BY 1) USING (entity_id)) WHERE place = 1),
    moved AS (SELECT entity_id, survivor FROM comps2 JOIN kept2 USING (component)),
    mapped2 AS (
        SELECT m.* REPLACE (coalesce(x.survivor, m.a) AS a, coalesce(y.survivor, m.b) AS b) FROM mapped m LEFT JOIN moved x ON x.entity_id = m.a LEFT JOIN moved y ON y.entity_id = m.b
        WHERE coalesce(x.survivor, m.a) <> coalesce(y.survivor, m.b)),
    """ + _GRAPH[_GRAPH.index("edges AS (") : _GRAPH.index("ends AS (SELECT subject_id")].rstrip().rstrip(",").replace("FROM mapped ", "FROM mapped2 ").replace("edges", "edges2").replace("parts", "parts2").replace("stm AS", "stm2 AS")
_MENTIONED = f"""{_BIRTHS},
    ms AS (SELECT DISTINCT source_code || ':' || e AS mention_id, e AS entity_id FROM (SELECT source_code, a AS e FROM ties UNION ALL SELECT source_code, b FROM ties)),
    nb AS (SELECT DISTINCT source_code || ':' || e AS mention_id, n FROM (SELECT source_code, a AS e, b AS n FROM ties UNION ALL SELECT source_code, b, a FROM ties) WHERE n NOT IN (SELECT entity_id FROM hubs) AND e <> n),
    pm AS (
        SELECT mention_id AS entity_id, ms.entity_id AS grp, name, split_part(name, ' ', 2) AS surname, split_part(name, ' ', 1) AS fore, split_part(mention_id, ':', 1) AS src,
            coalesce(nbs, []) AS nb, left(dob, 4) AS birth_year
        FROM ms JOIN ents ON ents.entity_id = ms.entity_id AND entity_type = 'person' LEFT JOIN (SELECT mention_id, list_sort(list(n)) AS nbs FROM nb GROUP BY 1) USING (mention_id) LEFT JOIN births ON births.entity_id = ms.entity_id)"""
_GOLD = f"""{_MENTIONED},
    gk AS (SELECT *, {_sorted(_plain("name"))} AS key FROM pm),
    gsame AS (
        SELECT x.entity_id AS a, y.entity_id AS b, CASE WHEN x.grp = y.grp THEN 'positive_one_entity' WHEN len(list_intersect(x.nb, y.nb)) > 0 THEN 'positive_neighbour'
            WHEN x.birth_year = y.birth_year THEN 'positive_birth_year' ELSE 'hard_negative' END AS kind
        FROM gk x JOIN gk y ON x.key = y.key AND x.key <> '' AND x.entity_id < y.entity_id),
    samp AS (SELECT entity_id, surname, row_number() OVER (ORDER BY md5(entity_id), entity_id) AS place FROM gk ORDER BY md5(entity_id), entity_id LIMIT 800),
    gold AS (
        SELECT a, b, kind FROM gsame
        UNION ALL SELECT least(x.entity_id, y.entity_id), greatest(x.entity_id, y.entity_id), 'easy_negative' FROM samp x JOIN samp y ON y.place = x.place + 1 AND x.place % 2 = 1 WHERE x.surname <> y.surname)"""

SQL: dict[str, str] = {
    "load_findings": _graph("SELECT finding_id, shape_code, surprise, row_number() OVER (ORDER BY surprise DESC, finding_id) AS place FROM found WHERE shape_code <> 'QUIET_PORTFOLIO'", _found("BIG_MONEY", "QUIET_PORTFOLIO", "SHARED_BENCH")),
    "load_insights": f"""SELECT insight_id, entity_id, kind, priority, row_number() OVER (PARTITION BY entity_id ORDER BY priority DESC, insight_id) AS place
        FROM (SELECT * FROM ({PLAIN["insight_rank_portfolio"]}) UNION ALL SELECT * FROM ({PLAIN["insight_only_donor_contractor"]}) UNION ALL SELECT * FROM ({PLAIN["insight_bridge"]}))""",
    "load_extras": f"""
        SELECT 'coverage' AS extra, entity_id, coverage_id AS id, row_number() OVER (PARTITION BY entity_id ORDER BY seendate DESC, coverage_id) AS place FROM ({_COVERAGE})
        UNION ALL SELECT 'offshore', entity_id, lead_id, row_number() OVER (PARTITION BY entity_id ORDER BY lead_id) FROM ({LANDED["offshore_leads"]})
        UNION ALL SELECT 'overseas', donor_id, lead_id, row_number() OVER (PARTITION BY donor_id ORDER BY lead_id) FROM ({PLAIN["overseas_leads"]})""",
    "entity_by_id": _graph("SELECT * FROM ents WHERE entity_id = 'P7'"),
    "id_set_hash": _graph(
        """SELECT finding_id, lower(to_base(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(txt, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296), 36)) || ':' || n AS hash
        FROM (SELECT finding_id, array_to_string(list_sort(member_ids), '|') || '|' AS txt, len(member_ids) AS n FROM found)""", _found("BIG_MONEY", "SHARED_BENCH")),
    **{name: _graph(f"SELECT finding_id, coverage_id, place FROM told WHERE place <= {most}", _found("BIG_MONEY") + f""",
        cov AS ({_COVERAGE}),
        mem AS (SELECT finding_id, generate_subscripts(member_ids, 1) AS i, unnest(member_ids) AS entity_id FROM found),
        told AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY i, seendate DESC, coverage_id) AS place
            FROM (SELECT finding_id, coverage_id, min(i) AS i, max(seendate) AS seendate FROM mem JOIN cov USING (entity_id) GROUP BY 1, 2))""") for name, most in (("news_of_findings", 10**9), ("news_chips", 2))},
    "ledger_teaser": _graph("SELECT * FROM (SELECT finding_id, row_number() OVER (ORDER BY surprise DESC, finding_id) AS place FROM found) WHERE place <= 6", _found("BIG_MONEY")),
    "finding_pivots": _graph("""
        SELECT finding_id, CASE WHEN shape_code IN ('BIG_MONEY', 'SHARED_BENCH', 'FAMILY_DESK') THEN member_ids[1] ELSE member_ids[1] END AS pivot_id FROM found""", _found("BIG_MONEY", "SHARED_BENCH", "FAMILY_DESK", "LOOP_CLOSED")),
    "search_suggestions": _graph("""
        SELECT entity_id, name, row_number() OVER (ORDER BY less, f) AS place
        FROM (SELECT member_ids[1] AS entity_id, min((-surprise, finding_id))[1] AS less, min((-surprise, finding_id))[2] AS f FROM found GROUP BY 1) JOIN ents USING (entity_id) ORDER BY less, f LIMIT 3""", _found("BIG_MONEY", "SHARED_BENCH")),
    "find_parliamentarians": _graph("SELECT entity_id, name FROM mps WHERE contains(lower(name), 'gear') ORDER BY name, entity_id LIMIT 7"),
    "edges_between": _graph("SELECT statement_id, strength FROM stm WHERE least(subject_id, object_id) = 'P7' AND greatest(subject_id, object_id) = 'R2' ORDER BY strength DESC, statement_id LIMIT 12"),
    "constellation_links": _graph("""
        SELECT a, b, max(strength) AS strength FROM (
            SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, strength FROM stm JOIN con x ON x.entity_id = subject_id JOIN con y ON y.entity_id = object_id
            WHERE subject_id <> object_id AND (confidence >= 0.5 OR x.source = 1 AND y.source = 1)) GROUP BY a, b ORDER BY strength DESC, a, b LIMIT 900""", f"con AS ({_CONSTELLATION})"),
    "graph_links_unsourced": _graph("""SELECT statement_id, CASE statement_type WHEN 'CONTRACTED_WITH' THEN 'Contracts Finder' WHEN 'DONATED_TO' THEN 'Electoral Commission' WHEN 'DIRECTOR_OF' THEN 'Companies House'
        WHEN 'OWNS' THEN 'Companies House' WHEN 'MEMBER_OF' THEN 'Parliament' END AS method FROM stm"""),
    "finding_sentences": _graph(f"""
        SELECT finding_id, headline, why, CASE WHEN length(headline) > greatest(20, 200 - length(suffix)) THEN left(headline, greatest(20, 200 - length(suffix)) - 1) || '…' ELSE headline END || ' ' || suffix AS share
        FROM (SELECT finding_id, CASE shape_code
            WHEN 'BIG_MONEY' THEN {_slot("donor")} || ' gave £' || {_gbp("amount_gbp")} || ' to ' || {_slot("recipient")} || '.'
            WHEN 'SHARED_BENCH' THEN {_slot("org")} || ' is tied to ' || {_slot("n_people")} || ' parliamentarians.'
            WHEN 'LOOP_CLOSED' THEN coalesce({_slot("company")} || ' gave £' || {_gbp("donation_gbp")} || ' to ' || {_slot("party")} || '.', '') || ' It also holds ' || {_slot("contract_count")} || ' public '
                || CASE WHEN {_slot("contract_count")} = '1' THEN 'contract' ELSE 'contracts' END || '.'
            WHEN 'CROSSING' THEN {_slot("entity")} || ' appears in ' || {_slot("n_registers")} || ' public registers.'
            WHEN 'FAMILY_DESK' THEN {_slot("person_a")} || ' and ' || {_slot("person_b")} || ' are both tied to ' || {_slot("company")} || '.'
            ELSE '£' || {_gbp("amount_gbp")} || ' to ' || {_slot("recipient")} || ' from a donor with a registered residence in ' || {_slot("jurisdiction")} || '.' END AS headline,
            CASE shape_code WHEN 'BIG_MONEY' THEN '£' || {_gbp("amount_gbp")} || ' is among the largest single donations in this register.'
            WHEN 'SHARED_BENCH' THEN 'One organisation tied to ' || {_slot("n_people")} || ' lawmakers is a concentration worth knowing about.'
            WHEN 'LOOP_CLOSED' THEN 'Money went to a party, and public contracts came to the same company. That two-way flow is why this merits a look.'
            WHEN 'CROSSING' THEN 'The same name appears in ' || {_slot("n_registers")} || ' separate public registers.'
            WHEN 'FAMILY_DESK' THEN 'Two public figures sharing one company is worth a look.'
            ELSE 'Donations linked to overseas residence face extra rules in the UK. The size and origin of this one make it worth a look.' END AS why,
            coalesce('Sourced from ' || {_slot("n_registers")} || ' public registers. ', 'Sourced from the public registers. ') AS suffix
        FROM found)""", _found("BIG_MONEY", "SHARED_BENCH", "LOOP_CLOSED", "CROSSING", "OVERSEAS_MONEY", "FAMILY_DESK")),
    "insight_sentences": f"""
        SELECT insight_id, CASE kind
            WHEN 'RANK_MONEY_GIVEN' THEN CASE WHEN rank <= 3 THEN 'The ' || CASE rank WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd' END || ' largest donor in this register: £' || {_gbp("total_gbp")} || ' across '
                || {_slot("n_donations")} || CASE WHEN {_slot("n_donations")} = '1' THEN ' donation.' ELSE ' donations.' END ELSE 'Gave £' || {_gbp("total_gbp")} || ' in declared political donations.' END
            WHEN 'RANK_PORTFOLIO' THEN CASE WHEN {_slot("percentile")}::DOUBLE >= 75 THEN 'More declared corporate ties than ' || floor({_slot("percentile")}::DOUBLE + 0.5)::BIGINT || '% of entities in this register: '
                || {_slot("n_ties")} || ' in the registers.' ELSE {_slot("n_ties")} || ' declared corporate ' || CASE WHEN {_slot("n_ties")} = '1' THEN 'tie' ELSE 'ties' END || ' in the registers.' END
            WHEN 'BRIDGE' THEN 'Appears in ' || {_slot("n_registers")} || ' public registers: the widest crossings in the data.'
            ELSE 'One of ' || {_slot("set_size")} || ' entities with this pattern.' END AS sentence, coalesce({_slot("cohort")}, '') AS cohort
        FROM (SELECT * FROM ({PLAIN["insight_rank_money_given"]}) UNION ALL SELECT * FROM ({PLAIN["insight_rank_portfolio"]}) UNION ALL SELECT * FROM ({PLAIN["insight_bridge"]})
            UNION ALL SELECT * FROM ({PLAIN["insight_only_crossing"]}))""",
    "receipts": _graph("""SELECT '# Ties' || chr(10) || '- ' || s.name || ' | ' || lower(statement_type) || ' | ' || o.name || ' (' || array_to_string(sources, ', ') || ')' AS markdown
        FROM (SELECT * FROM stm WHERE (subject_id = 'P7' OR object_id = 'P7') AND amount_gbp IS NOT NULL ORDER BY amount_gbp DESC, statement_id LIMIT 1) JOIN ents s ON s.entity_id = subject_id JOIN ents o ON o.entity_id = object_id"""),
    "dedupe_births": _graph("""
        SELECT * FROM ppairs UNION SELECT x.entity_id, y.entity_id FROM pkeys x JOIN pkeys y ON x.name_key = y.name_key AND x.name_key <> '' AND x.entity_id < y.entity_id
            JOIN births p ON p.entity_id = x.entity_id JOIN births q ON q.entity_id = y.entity_id
        WHERE p.dob = q.dob OR left(p.dob, 4) = left(q.dob, 4) AND left(p.dob, 4) IN (SELECT dob FROM births WHERE length(dob) = 4)""", _BIRTHS),
    "dedupe_repoint": _graph("""SELECT DISTINCT source_code || ':' || e AS mention_id, coalesce(survivor, e) AS entity_id FROM (SELECT source_code, a AS e FROM ties UNION ALL SELECT source_code, b FROM ties) LEFT JOIN losers ON entity_id = e""", _LOSERS),
    "dedupe_fold": _graph("""SELECT e.entity_id, concat_ws(';', 'nation=' || coalesce(a.nation, f.nation), 'segment=' || coalesce(a.segment, f.segment)) AS attributes
        FROM ents e LEFT JOIN attrs a USING (entity_id) LEFT JOIN (SELECT survivor AS entity_id, arg_min(nation, l.entity_id) FILTER (nation IS NOT NULL) AS nation, arg_min(segment, l.entity_id) FILTER (segment IS NOT NULL) AS segment
            FROM losers l JOIN attrs a ON a.entity_id = l.entity_id GROUP BY 1) f USING (entity_id) WHERE entity_id NOT IN (SELECT entity_id FROM losers)""", f"{_LOSERS},{_ATTRIBUTES}"),
    "enrich_attributes": _graph("SELECT e.entity_id, concat_ws(';', 'nation=' || coalesce(dob, nation), 'segment=' || segment) AS attributes FROM ents e LEFT JOIN attrs USING (entity_id) LEFT JOIN births USING (entity_id)", f"{_BIRTHS},{_ATTRIBUTES}"),
    "resolve_singleton_attributes": f"""{_keyed()} SELECT mention_id, entity_id, coalesce(hint, 'person') AS entity_type, raw_name AS name,
            concat_ws(';', 'company_number=' || crn, 'country=' || country, 'donor_id=' || did, 'nationality=' || nationality, 'officer_link=' || link, 'officer_role=' || orole, 'parliament_member_id=' || pid, 'regulated_entity_id=' || rid) AS attributes
        FROM keyed WHERE rule = 'single'""",
    "edges_active": _graph("SELECT statement_type, count(*) AS n FROM mapped WHERE (a NOT LIKE 'P%' OR length(a) % 2 = 0) AND (b NOT LIKE 'P%' OR length(b) % 2 = 0) GROUP BY 1"),
    "person_mentions": _graph("SELECT entity_id, grp AS group, surname, CASE WHEN length(fore) > 1 THEN fore ELSE '' END AS forenames, array_to_string(nb, ',') AS neighbours, birth_year FROM pm".replace("AS group", 'AS "group"'), _MENTIONED),
    "gold_pairs": _graph("SELECT a, b, (kind LIKE 'positive%')::INT AS label, kind FROM gold", _GOLD),
    "gold_report": _graph("""SELECT kind, count(*) AS n, round(min(score), 4) AS least, round(quantile_cont(score, 0.5), 4) AS median, round(max(score), 4) AS most, round(avg(score), 4) AS mean
        FROM (SELECT kind, round(CASE WHEN fa[1] <> fb[1] THEN 0.05 ELSE 1 / (1 + exp(-(CASE WHEN sa = sb THEN ln(0.9 / u) ELSE 0 END
            + CASE WHEN fa = fb THEN ln(0.85 / 0.04) ELSE ln(0.4 / 0.2) END + CASE WHEN near IS NULL THEN ln(0.15 / 0.85) ELSE ln((0.5 + 0.5 * near) / 0.1) END + ln(0.02 / 0.98)))) END, 6) AS score FROM gp) GROUP BY kind""",
        f"""{_GOLD},
        gdeg AS (SELECT n, count(*) AS d FROM (SELECT unnest(nb) AS n FROM pm) GROUP BY 1),
        gu AS (SELECT surname, greatest(count(*) / (SELECT count(*) FROM pm), 1e-5) AS u FROM pm GROUP BY 1),
        gp AS (
            SELECT gold.*, x.fore AS fa, y.fore AS fb, x.surname AS sa, y.surname AS sb, u, (SELECT avg(1 / (1 + ln(1 + d))) FROM (SELECT unnest(list_intersect(x.nb, y.nb)) AS n) JOIN gdeg USING (n)) AS near
            FROM gold JOIN pm x ON x.entity_id = a JOIN pm y ON y.entity_id = b JOIN gu ON gu.surname = x.surname)"""),
    "calib_isotonic": """WITH raw AS (SELECT round(value % 1, 2) AS score, (round(value % 1, 2) > 0.35 + (event_id % 5) / 10)::INT AS label FROM events WHERE value IS NOT NULL),
        pts AS (SELECT score, count(*) AS n, sum(label) AS s, row_number() OVER (ORDER BY score) AS i FROM raw GROUP BY score),
        cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM pts),
        spans AS (SELECT x.i AS lo, y.i AS hi, (y.cs - x.cs + x.s)::DOUBLE / (y.cn - x.cn + x.n) AS mean FROM cum x JOIN cum y ON y.i >= x.i),
        least AS (SELECT k.i, lo, min(mean) AS low FROM pts k JOIN spans ON lo <= k.i AND hi >= k.i GROUP BY 1, 2)
        SELECT score, n, round(max(low), 6) AS fitted FROM least JOIN pts USING (i) GROUP BY score, n""",
    "build_publish": _graph("SELECT statement_type, count(*) AS n, 'second' AS build FROM ties GROUP BY 1 HAVING count(*) > 100"),
    "build_statements": _graph("SELECT statement_id, subject_id, statement_type, object_id, confidence, strength, amount_gbp FROM stm2", _MERGED),
}
