"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

``_GRAPH`` builds the fixture graph from the driver's tables; each query adds its own
steps. Amounts are decimals, scores are rounded as in the operators.
"""

from __future__ import annotations

# Fixed values, written out here as well, so that a wrong one in the operators shows.
_SOURCE_PRIORS = {
    "companies_house": 0.97,
    "electoral_commission": 0.97,
    "parliament_interests": 0.95,
    "parliament": 0.97,
    "contracts_finder": 0.96,
    "lords_interests": 0.96,
    "appg": 0.95,
}
_TYPE_WEIGHTS = {
    "DIRECTOR_OF": 0.7,
    "PSC_OF": 0.85,
    "OWNS": 0.8,
    "SHARES_ADDRESS_WITH": 0.4,
    "CO_DIRECTOR": 0.7,
    "DONATED_TO": 0.7,
    "MEMBER_OF": 0.6,
    "CHAIR_OF": 0.75,
    "SECRETARIAT_OF": 0.6,
    "FUNDS": 0.6,
    "HOSPITALITY_FROM": 0.3,
    "ADVISER_TO": 0.55,
    "MINISTERIAL_ROLE": 0.9,
    "CONTRACTED_WITH": 0.7,
    "FAMILY_OF": 0.95,
    "CO_MENTION": 0.1,
}
_SHAPE_WEIGHTS = {
    "LOOP_CLOSED": 1.0,
    "SHARED_BENCH": 0.8,
    "FAMILY_DESK": 0.9,
    "BIG_MONEY": 0.6,
    "OVERSEAS_MONEY": 0.95,
    "SECTOR_OVERLAP": 0.85,
    "QUIET_PORTFOLIO": 0.75,
    "CROSSING": 0.7,
    "NEW_ON_REGISTER": 0.5,
}
_REGISTERS = {
    "companies_house": "Companies House",
    "electoral_commission": "Electoral Commission",
    "parliament": "Parliament (Members API)",
    "parliament_interests": "Register of Members' Interests",
    "lords_interests": "Register of Lords' Interests",
    "contracts_finder": "Contracts Finder",
}
_NAME_TITLES = "mr mrs ms miss mx dr sir dame lord lady rt hon honourable the rev reverend prof professor baroness baron earl viscount councillor cllr qc kc mp".split()
_MATCH_TITLES = "mr mrs ms miss dr sir dame lord lady rt hon the honourable rev prof professor baroness earl councillor cllr qc kc mp".split()
_LEGAL_FORMS = "the ltd limited plc llp llc lp inc incorporated cyf cyfyngedig".split()
_GENERIC_TAIL = (
    "group holdings holding uk gb international global services service solutions capital partners partnership ventures trading investments management "
    "enterprises industries europe european finance financial "
).split()
_NO_GIVEN_NAMES = "mr mrs ms dr sir dame lord lady the rt hon honourable baroness baron earl of right".split()
_GB_ALIASES = ("united kingdom", "england", "scotland", "wales", "northern ireland", "great britain", "uk")
_SUFFIX_CLASSES = (
    ("ltd", r"\b(ltd|limited|cyf|cyfyngedig)\b"),
    ("plc", r"\bplc\b"),
    ("llp", r"\bllp\b"),
    ("lp", r"\blp\b"),
    ("foreign", r"\b(llc|inc|incorporated|corp|corporation)\b"),
)
_WEAK_WORDS = r"\b(the|company|co)\b"
_SUPPLIER_SUFFIXES = r"(?i)\b(limited|ltd|plc|public limited company|llp|l\.?l\.?p\.?|company|co|incorporated|inc|the)\b"
_NOISE_NAMES = "(?i)^(london|oxford|cambridge|edinburgh|cardiff|manchester|birmingham|glasgow|belfast|usa|uk|online|virtual|geneva|brussels)$"
_NOISE_FORMS = "(?i)(university of|^the [a-z]+$)"

_AS_OF = "DATE '2001-08-01'"
_PRIORS = ", ".join(f"('{k}', {v})" for k, v in _SOURCE_PRIORS.items())
_TYPES = ", ".join(f"('{k}', {v})" for k, v in _TYPE_WEIGHTS.items())

_GRAPH = f"""
    ents AS (
        SELECT 'P' || c_custkey AS entity_id, 'person' AS entity_type, p_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'mp' END AS category,
            CASE WHEN c_nationkey % 5 = 0 THEN 'N' || c_nationkey ELSE 'GB' END AS jurisdiction
        FROM customer JOIN part ON c_custkey = p_partkey
        UNION ALL SELECT 'C' || s_suppkey, 'company', s_name, 'company', 'GB' FROM supplier
        UNION ALL SELECT 'G' || n_nationkey, 'government_body', n_name, NULL, NULL FROM nation
        UNION ALL SELECT 'R' || r_regionkey, 'party', r_name, 'party', NULL FROM region
        UNION ALL SELECT DISTINCT 'O' || split_part(p_name, ' ', 2), 'organisation', 'Committee for ' || split_part(p_name, ' ', 2), NULL, NULL FROM part),
    base AS (
        SELECT *, n1.n_regionkey AS c_region, n2.n_regionkey AS s_region, o_orderdate::DATE AS ordered, l_shipdate::DATE AS shipped, split_part(p_name, ' ', 2) AS noun
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
            JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        WHERE l_quantity >= 45),
    ties AS (
        SELECT 'DONATED_TO' AS statement_type, 'electoral_commission' AS source_code, 'P' || c_custkey AS a, 'R' || s_region AS b, ordered AS valid_from,
            NULL::DATE AS valid_to, o_totalprice::DECIMAL(18,2) AS amount
        FROM base
        UNION ALL SELECT 'DONATED_TO', 'electoral_commission', 'C' || s_suppkey, 'R' || c_region, shipped, NULL, l_extendedprice::DECIMAL(18,2) FROM base WHERE l_quantity >= 48
        UNION ALL SELECT 'CONTRACTED_WITH', 'contracts_finder', 'C' || s_suppkey, 'G' || c_nationkey, ordered, shipped, l_extendedprice::DECIMAL(18,2)
            FROM base WHERE l_quantity >= 49 AND l_linestatus = 'O'
        UNION ALL SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'DIRECTOR_OF' ELSE 'OWNS' END,
            CASE WHEN o_orderstatus = 'F' THEN 'companies_house' ELSE 'parliament_interests' END, 'P' || c_custkey, 'C' || s_suppkey, ordered, shipped, NULL
            FROM base WHERE l_returnflag = 'R'
        UNION ALL SELECT 'MEMBER_OF', 'parliament', 'P' || c_custkey, 'O' || noun, NULL, NULL, NULL FROM base WHERE l_quantity >= 49 AND c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'MEMBER_OF', 'parliament', 'P' || c_custkey, 'R' || n_regionkey, NULL, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey),
    sure AS (
        SELECT entity_id, CASE WHEN entity_id NOT LIKE 'P%' THEN 1.0 WHEN substr(entity_id, 2)::BIGINT % 31 = 0 THEN 0.45
            WHEN substr(entity_id, 2)::BIGINT % 7 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS conf
        FROM ents),
    mapped AS (
        SELECT t.*, prior::DOUBLE * least(x.conf, y.conf) AS confidence
        FROM ties t JOIN sure x ON t.a = x.entity_id JOIN sure y ON t.b = y.entity_id JOIN (VALUES {_PRIORS}) p(source_code, prior) USING (source_code) WHERE t.a <> t.b),
    edges AS (
        SELECT a, statement_type, b, min(valid_from) AS valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to,
            max(confidence) AS confidence, max(amount) AS amount, list_sort(list(DISTINCT source_code)) AS sources, count(*) AS n_assertions
        FROM mapped GROUP BY a, statement_type, b),
    parts AS (
        SELECT *, weight::DOUBLE * exp(-0.15 * greatest(0, {_AS_OF} - coalesce(valid_to, {_AS_OF})) / 365.0::DOUBLE)
                * CASE WHEN valid_from IS NULL THEN 0.5 ELSE 1 - exp(-greatest(0, coalesce(valid_to, {_AS_OF}) - valid_from) / 365.0::DOUBLE / 5) END AS plain,
            CASE WHEN amount IS NULL THEN 1.0 ELSE least(1.0, ln(1 + amount::DOUBLE) / ln(1000001.0::DOUBLE)) END AS mag
        FROM edges JOIN (VALUES {_TYPES}) w(statement_type, weight) USING (statement_type)),
    stm AS (
        SELECT md5(concat_ws('|', statement_type, a, b)) AS statement_id, a AS subject_id, statement_type, b AS object_id, valid_from, valid_to,
            round(confidence, 4) AS confidence, round(greatest(0.0, least(1.0, plain * mag)), 4) AS strength,
            round(greatest(0.0, least(1.0, plain)), 4) AS plain_strength, amount AS amount_gbp, sources, n_assertions
        FROM parts),
    ends AS (SELECT subject_id AS entity_id, * FROM stm UNION ALL SELECT object_id, * FROM stm),
    hubs AS (SELECT entity_id FROM ents WHERE entity_type IN ('party', 'government_body')),
    degs AS (
        SELECT entity_id, count(*) AS degree FROM (
            SELECT subject_id AS entity_id FROM stm WHERE object_id NOT IN (SELECT entity_id FROM hubs)
            UNION ALL SELECT object_id FROM stm WHERE subject_id NOT IN (SELECT entity_id FROM hubs)) GROUP BY 1),
    idfs AS (SELECT e.entity_id, e.entity_type, 1 / log2(2 + coalesce(degree, 0)) AS idf FROM ents e LEFT JOIN degs USING (entity_id)),
    descs AS (
        SELECT 'C' || l_suppkey AS entity_id, array_to_string(list_sort(list(DISTINCT split_part(p_name, ' ', 2))), ' ') AS description
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_linenumber = 1 GROUP BY 1),
    lex AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS theme FROM part),
    mps AS (SELECT entity_id, name FROM ents WHERE category = 'mp'),
    seats AS (
        SELECT subject_id AS mp, lower(o.name) AS txt FROM stm JOIN mps ON subject_id = mps.entity_id JOIN ents o ON o.entity_id = object_id
        WHERE statement_type IN ('MEMBER_OF', 'CHAIR_OF', 'MINISTERIAL_ROLE') AND o.entity_type IN ('organisation', 'government_body')),
    held AS (
        SELECT subject_id AS mp, o.name AS org, lower(o.name) || ' ' || coalesce(description, '') AS txt, regexp_replace(lower(mps.name), '^.* ', '') AS surname
        FROM stm JOIN mps ON subject_id = mps.entity_id JOIN ents o ON o.entity_id = object_id LEFT JOIN descs d ON d.entity_id = object_id
        WHERE statement_type IN ('OWNS', 'DIRECTOR_OF')),
    seat_themes AS (SELECT DISTINCT mp, theme FROM seats JOIN lex ON contains(txt, theme)),
    held_themes AS (SELECT DISTINCT mp, theme FROM held JOIN lex ON contains(txt, theme)),
    conflicts AS (
        SELECT m.entity_id, h.orgs IS NOT NULL AND s.bodies IS NOT NULL AS conflict_flag, o.overlap,
            CASE WHEN o.overlap IS NOT NULL THEN 'strong' WHEN h.commercial THEN 'medium' ELSE 'low' END AS level, h.orgs, s.bodies
        FROM mps m
            LEFT JOIN (SELECT mp, string_agg(DISTINCT org, '; ' ORDER BY org) AS orgs, bool_or(NOT contains(txt, 'dormant') AND NOT contains(txt, surname)
                AND NOT regexp_matches(txt, '(labour|conservative| party| to win)')) AS commercial FROM held GROUP BY mp) h ON h.mp = m.entity_id
            LEFT JOIN (SELECT mp, string_agg(DISTINCT txt, '; ' ORDER BY txt) AS bodies FROM seats GROUP BY mp) s ON s.mp = m.entity_id
            LEFT JOIN (SELECT mp, string_agg(DISTINCT theme, ', ' ORDER BY theme) AS overlap FROM seat_themes JOIN held_themes USING (mp, theme) GROUP BY mp) o ON o.mp = m.entity_id),
    credited AS (
        SELECT entity_id, max(money) AS money FROM (
            SELECT subject_id AS entity_id, max(amount_gbp) AS money FROM stm WHERE statement_type = 'DONATED_TO' GROUP BY 1
            UNION ALL SELECT object_id, max(amount_gbp) FROM stm WHERE statement_type = 'DONATED_TO' GROUP BY 1
            UNION ALL SELECT c.subject_id, max(d.amount_gbp) FROM stm c JOIN stm d ON d.subject_id = c.object_id AND d.statement_type = 'DONATED_TO'
                WHERE c.statement_type IN ('DIRECTOR_OF', 'PSC_OF', 'OWNS', 'CO_DIRECTOR') GROUP BY 1
            UNION ALL SELECT c.subject_id, max(d.amount_gbp) FROM stm c JOIN stm d ON d.object_id = c.object_id AND d.statement_type = 'DONATED_TO'
                WHERE c.statement_type = 'MEMBER_OF' GROUP BY 1) GROUP BY entity_id),
    scrut AS (
        SELECT e.entity_id, money, round(least(1.0, coalesce(ln(1 + money::DOUBLE) / ln(5000001.0::DOUBLE), 0)
            + CASE WHEN category = 'mp' AND money IS NOT NULL THEN 0.2 ELSE 0 END), 3) AS scrutiny
        FROM ents e LEFT JOIN credited USING (entity_id)),
    node AS (
        SELECT e.*, coalesce(n, 0) AS ties, greatest(4, least(10, 4 + coalesce(n, 0))) AS importance
        FROM ents e LEFT JOIN (SELECT entity_id, count(*) AS n FROM ends GROUP BY 1) USING (entity_id)),
    regs AS (SELECT entity_id, list_sort(list(DISTINCT s)) AS registers, count(DISTINCT s) AS n_registers FROM (SELECT entity_id, unnest(sources) AS s FROM ends) GROUP BY 1),
    pkeys AS (SELECT entity_id, {{person_key}} AS name_key FROM ents WHERE entity_type = 'person'),
    nbrs AS (
        SELECT DISTINCT e AS entity_id, n AS neighbour FROM (SELECT subject_id AS e, object_id AS n FROM stm UNION ALL SELECT object_id, subject_id FROM stm)
        WHERE n NOT IN (SELECT entity_id FROM hubs)),
    ppairs AS (
        SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM pkeys x JOIN pkeys y ON x.name_key = y.name_key AND x.entity_id < y.entity_id AND x.name_key <> ''
            JOIN nbrs m ON m.entity_id = x.entity_id JOIN nbrs n ON n.entity_id = y.entity_id AND n.neighbour = m.neighbour)"""


def _person_key(name: str) -> str:
    plain = f"regexp_replace(lower({name}), '[^a-z0-9 ]', ' ', 'g')"
    return _sorted(f"regexp_replace({plain}, '(^| )({'|'.join(_NAME_TITLES)})( |$)', ' ', 'g')")


def _sorted(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda x: x <> '')), ' ')"


_GRAPH = _GRAPH.replace("{person_key}", _person_key("name"))


def _graph(tail: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_GRAPH}{', ' + more if more else ''} {tail}"


# What each shape finds: shape, members, statements, slots, money, least confidence.
_CANDIDATES = {
    "LOOP_CLOSED": """
        SELECT [company] AS members, list_concat(gifts, contracts) AS stmts,
            concat_ws(';', 'company=' || name, 'contract_count=' || n_contracts, 'contract_total_gbp=' || (won * n_gifts), 'donation_gbp=' || top, 'donation_total_gbp=' || given, 'party=' || party) AS slots,
            given::DOUBLE + (won * n_gifts)::DOUBLE AS total, least(c1, c2) AS least
        FROM (SELECT subject_id AS company, list(statement_id) AS gifts, max(amount_gbp) AS top, sum(DISTINCT amount_gbp) AS given, min(p.name) AS party, min(confidence) AS c1, count(*) AS n_gifts
              FROM stm JOIN ents p ON p.entity_id = object_id AND p.entity_type = 'party' WHERE statement_type = 'DONATED_TO' GROUP BY 1)
            JOIN (SELECT subject_id AS company, list(statement_id) AS contracts, count(*) AS n_contracts, sum(amount_gbp) AS won, min(confidence) AS c2
              FROM stm WHERE statement_type = 'CONTRACTED_WITH' GROUP BY 1) USING (company)
            JOIN ents ON entity_id = company""",
    "SHARED_BENCH": f"""
        SELECT list_concat([o.entity_id], list(DISTINCT m.entity_id)) AS members, list(DISTINCT statement_id) AS stmts,
            'n_people=' || count(DISTINCT m.entity_id) || ';org=' || o.name || ';people='
                || array_to_string(list_transform(list_sort(list(DISTINCT (m.name, m.entity_id))), lambda x: x[1]), ', ') AS slots,
            NULL::DOUBLE AS total, min(confidence) AS least
        FROM stm JOIN ents o ON o.entity_id = object_id JOIN mps m ON m.entity_id = subject_id
        WHERE statement_type IN ('ADVISER_TO', 'DIRECTOR_OF', 'CHAIR_OF', 'SECRETARIAT_OF') AND o.entity_type IN ('company', 'organisation') AND length(o.name) >= 4
            AND NOT regexp_matches(o.name, '{_NOISE_NAMES}') AND NOT regexp_matches(o.name, '^[0-9]') AND NOT regexp_matches(o.name, '{_NOISE_FORMS}')
        GROUP BY o.entity_id, o.name HAVING count(DISTINCT m.entity_id) >= 3""",
    "FAMILY_DESK": """
        SELECT [company, a, b] AS members, list_distinct(list_concat(list(x), list(y))) AS stmts,
            'company=' || name || ';person_a=' || na || ';person_b=' || nb || ';surname=' || surname AS slots, NULL::DOUBLE AS total, least(min(cx), min(cy)) AS least
        FROM (SELECT l.object_id AS company, l.subject_id AS a, r.subject_id AS b, l.sn AS surname, l.name AS na, r.name AS nb, l.statement_id AS x, r.statement_id AS y, l.confidence AS cx, r.confidence AS cy
              FROM (SELECT *, split_part(name, ' ', 2) AS sn FROM stm JOIN ents ON entity_id = subject_id WHERE entity_type = 'person' AND statement_type IN ('DIRECTOR_OF', 'OWNS', 'PSC_OF')) l
              JOIN (SELECT *, split_part(name, ' ', 2) AS sn FROM stm JOIN ents ON entity_id = subject_id WHERE entity_type = 'person' AND statement_type IN ('DIRECTOR_OF', 'OWNS', 'PSC_OF')) r
                ON l.object_id = r.object_id AND l.sn = r.sn AND l.subject_id < r.subject_id AND split_part(l.name, ' ', 1) <> split_part(r.name, ' ', 1) AND length(l.sn) > 2) z
            JOIN ents ON entity_id = company
        GROUP BY company, a, b, name, na, nb, surname""",
    "BIG_MONEY": """
        SELECT [subject_id, object_id] AS members, [statement_id] AS stmts,
            concat_ws(';', 'amount_gbp=' || amount_gbp, 'donor=' || d.name, 'donor_jurisdiction=' || d.jurisdiction, 'recipient=' || r.name) AS slots, amount_gbp::DOUBLE AS total, confidence AS least
        FROM stm JOIN ents d ON d.entity_id = subject_id JOIN ents r ON r.entity_id = object_id
        WHERE statement_type = 'DONATED_TO' AND amount_gbp::DOUBLE >= (SELECT quantile_cont(amount_gbp::DOUBLE, 0.9) FROM stm WHERE statement_type = 'DONATED_TO')""",
    "OVERSEAS_MONEY": """
        SELECT [subject_id, object_id] AS members, [statement_id] AS stmts,
            concat_ws(';', 'amount_gbp=' || amount_gbp, 'basis=Registered residence', 'donor=' || d.name, 'jurisdiction=' || d.jurisdiction, 'recipient=' || r.name) AS slots,
            amount_gbp::DOUBLE AS total, confidence AS least
        FROM stm JOIN ents d ON d.entity_id = subject_id JOIN ents r ON r.entity_id = object_id WHERE statement_type = 'DONATED_TO' AND d.jurisdiction <> 'GB'""",
    "SECTOR_OVERLAP": """
        SELECT list_concat([c.entity_id], list(DISTINCT i.object_id)) AS members, list_distinct(list_concat(list(s.statement_id), list(i.statement_id))) AS stmts,
            concat_ws(';', 'mp=' || m.name, 'overlap=' || overlap, 'strength=' || level) AS slots, NULL::DOUBLE AS total, least(min(s.confidence), min(i.confidence)) AS least
        FROM conflicts c JOIN mps m ON m.entity_id = c.entity_id
            JOIN stm s ON s.subject_id = c.entity_id AND s.statement_type IN ('MEMBER_OF', 'CHAIR_OF', 'MINISTERIAL_ROLE')
            JOIN stm i ON i.subject_id = c.entity_id AND i.statement_type IN ('OWNS', 'DIRECTOR_OF')
        WHERE conflict_flag AND level IN ('strong', 'medium') GROUP BY c.entity_id, m.name, overlap, level""",
    "QUIET_PORTFOLIO": """
        SELECT [subject_id] AS members, list(statement_id) AS stmts, 'companies=' || array_to_string(list_transform(list_sort(list(DISTINCT (o.name, o.entity_id))), lambda x: x[1]), ', ')
                || ';n_companies=' || count(DISTINCT object_id) || ';person=' || p.name AS slots, NULL::DOUBLE AS total, min(confidence) AS least
        FROM stm JOIN ents p ON p.entity_id = subject_id AND p.entity_type = 'person' JOIN ents o ON o.entity_id = object_id
        WHERE statement_type IN ('DIRECTOR_OF', 'OWNS') GROUP BY subject_id, p.name HAVING count(DISTINCT object_id) >= 3""",
    "CROSSING": """
        SELECT [entity_id] AS members, list(DISTINCT statement_id) AS stmts, 'entity=' || any_value(e.name) || ';n_registers=' || any_value(n_registers) AS slots,
            NULL::DOUBLE AS total, min(confidence) AS least
        FROM ends JOIN regs USING (entity_id) JOIN ents e USING (entity_id) WHERE n_registers >= 3 AND entity_id NOT IN (SELECT entity_id FROM hubs) GROUP BY entity_id""",
    "NEW_ON_REGISTER": f"""
        SELECT [subject_id, object_id] AS members, [statement_id] AS stmts, 'object=' || o.name || ';statement_type=' || statement_type || ';subject=' || s.name || ';valid_from=' || valid_from AS slots,
            NULL::DOUBLE AS total, confidence AS least, statement_type AS extra
        FROM stm JOIN ents s ON s.entity_id = subject_id JOIN ents o ON o.entity_id = object_id WHERE valid_from >= {_AS_OF} - 30""",
}


def _found(*shapes: str) -> str:
    """CTEs that end in ``found``: the scored findings of some shapes."""
    parts = []
    for shape in shapes:
        body = _CANDIDATES[shape] if shape == "NEW_ON_REGISTER" else _CANDIDATES[shape].replace("AS least\n", "AS least, NULL::VARCHAR AS extra\n", 1)
        if "AS extra" not in body:
            body = body.replace("AS least", "AS least, NULL::VARCHAR AS extra", 1)
        parts.append(f"SELECT '{shape}' AS shape_code, {_SHAPE_WEIGHTS[shape]}::DOUBLE AS w, * FROM ({body})")
    return f"""
        cand AS (SELECT *, md5(concat_ws('|', shape_code, array_to_string(list_sort(members), ','), extra)) AS finding_id FROM ({" UNION ALL ".join(parts)}) WHERE least >= 0.5),
        rare AS (SELECT finding_id, exp(avg(ln(idf))) AS r FROM (SELECT finding_id, unnest(members) AS entity_id FROM cand) JOIN idfs USING (entity_id)
            WHERE entity_type NOT IN ('party', 'government_body') GROUP BY 1),
        cited AS (SELECT finding_id, count(DISTINCT s) AS n FROM (SELECT finding_id, unnest(sources) AS s FROM (SELECT finding_id, unnest(stmts) AS statement_id FROM cand) JOIN stm USING (statement_id)) GROUP BY 1),
        rated AS (
            SELECT *, coalesce(r, 0) AS rr, 1 + 0.5::DOUBLE * greatest(0, coalesce(n, 1) - 1) AS cc, coalesce(least(1.0, log10(1 + total) / 6), 0) AS mm
            FROM cand LEFT JOIN rare USING (finding_id) LEFT JOIN cited USING (finding_id)),
        found AS (
            SELECT finding_id, shape_code, members AS member_ids, stmts, array_to_string(list_sort(members), ',') AS members, len(stmts) AS n_statements, slots, round(rr, 4) AS rarity,
                round(cc, 4) AS corroboration, round(mm, 4) AS money, round(w * (0.4 + 0.6 * rr) * cc * (0.5 + 0.5 * mm), 4) AS surprise,
                round(least, 4) AS min_confidence, least < 0.8 AS is_lead, total
            FROM rated)"""


def _insight(kind: str, body: str, more: str = "") -> str:
    """body: entity_id, priority, rank, cohort_size, slots and tag."""
    return _graph(
        f"SELECT md5(concat_ws('|', '{kind}', tag, entity_id)) AS insight_id, entity_id, '{kind}' AS kind, round(priority, 4) AS priority, rank, cohort_size, slots FROM ({body})", more
    )


def _money_rank(own: str, other: str, kind: str, apart: str, a: str, b: str, listed: str) -> str:
    before = listed < "name"
    return _insight(
        kind,
        f"""SELECT entity_id, NULL AS tag, 0.9 * (1 - (rank - 1) / greatest(1, cohort_size)) AS priority, rank, cohort_size,
            'cohort=' || cohort || {"';" + listed + "=' || top || " if before else ""}';n_donations=' || n || ';name=' || name
            || ';percentile=' || round(100 * (1 - (rank - 1) / greatest(1, cohort_size)), 1)::DECIMAL(5,1) || {"" if before else "';" + listed + "=' || top || "}';total_gbp=' || total AS slots
            FROM ranked""",
        f"""
        total AS (SELECT {own} AS entity_id, sum(amount_gbp) AS total, count(*) AS n FROM stm WHERE statement_type = 'DONATED_TO' GROUP BY 1),
        per AS (SELECT {own} AS entity_id, o.name AS other, sum(amount_gbp) AS amt FROM stm JOIN ents o ON o.entity_id = {other} WHERE statement_type = 'DONATED_TO' GROUP BY 1, 2),
        tops AS (SELECT entity_id, string_agg(other, ', ' ORDER BY place) AS top
            FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY amt DESC, other) AS place FROM per) WHERE place <= 3 GROUP BY 1),
        cohorted AS (SELECT *, CASE WHEN entity_type = '{apart}' THEN '{a}' ELSE '{b}' END AS cohort FROM total JOIN ents USING (entity_id) JOIN tops USING (entity_id)),
        ranked AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY total DESC) AS rank, count(*) OVER (PARTITION BY cohort) AS cohort_size FROM cohorted)""",
    )


_NAMES = """
    people AS (
        SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Rt Hon Sir ' || p_name WHEN 1 THEN 'Dr. ' || p_name
            WHEN 2 THEN upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) WHEN 3 THEN p_name || ' O''Brien MP' ELSE p_name END AS raw_name FROM part),
    companies AS (
        SELECT s_suppkey AS id, 'The ' || s_name || CASE s_suppkey % 7 WHEN 0 THEN ' Limited' WHEN 1 THEN ' plc' WHEN 2 THEN ' LLP' WHEN 3 THEN ' Inc.' WHEN 4 THEN ' & Co Ltd'
            WHEN 5 THEN ' Group Holdings UK' ELSE '' END AS raw_name FROM supplier)"""


def _country(k: str = "id") -> str:
    return f"(['England', 'United Kingdom', 'France', 'Wales', 'Malta', ''])[{k} % 6 + 1]"


_MENTIONS = f"""{_NAMES},
    men AS (
        SELECT 'companies_house:company:' || id AS mention_id, 'companies_house' AS source_code, 'company' AS hint, raw_name, (id % 40)::VARCHAR AS crn, NULL AS link, NULL AS orole,
            NULL AS pid, NULL AS did, NULL AS rid, {_country()} AS country, NULL AS nationality FROM companies
        UNION ALL SELECT 'electoral_commission:company:' || id, 'electoral_commission', 'company', raw_name, CASE WHEN id % 3 = 0 THEN (id % 40)::VARCHAR END, NULL, NULL, NULL, (id % 25)::VARCHAR, NULL, {_country()}, NULL FROM companies
        UNION ALL SELECT 'companies_house:person:' || id, 'companies_house', 'person', raw_name, NULL, (id % 700)::VARCHAR,
            CASE WHEN id % 50 = 0 THEN 'corporate-director' ELSE 'director' END, NULL, NULL, NULL, {_country()}, {_country()} FROM people
        UNION ALL SELECT 'parliament:person:' || id, 'parliament', 'person', raw_name, NULL, NULL, NULL, CASE WHEN id % 4 = 0 THEN (id % 300)::VARCHAR END, NULL, NULL, NULL, NULL FROM people
        UNION ALL SELECT 'electoral_commission:any:' || id, 'electoral_commission', NULL, raw_name, NULL, NULL, NULL, NULL, CASE WHEN id % 5 = 0 THEN (id % 150)::VARCHAR END,
            CASE WHEN id % 7 = 0 THEN (id % 90)::VARCHAR END, NULL, NULL FROM people
        UNION ALL SELECT 'electoral_commission:party:' || r_regionkey, 'electoral_commission', 'party',
            array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Parties (RP)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
        UNION ALL SELECT 'parliament:party:' || r_regionkey, 'parliament', 'party', 'The ' || split_part(lower(r_name), ' ', 1) || ' party', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
        UNION ALL SELECT 'parliament:government_body:' || n_nationkey, 'parliament', 'government_body', ' Office of ' || n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'contracts_finder:organisation:' || n_nationkey, 'contracts_finder', 'organisation', ' Office of ' || n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation),
    rules AS (
        SELECT *, CASE WHEN hint = 'company' AND crn IS NOT NULL THEN lpad(crn, 8, '0') END AS k1,
            CASE WHEN hint = 'party' THEN trim(regexp_replace(regexp_replace(lower(raw_name), '\\s*\\([^)]*\\)\\s*$', '', 'g'), '( and unionist| party|s$|^the )', '', 'g')) END AS k2,
            CASE WHEN hint IN ('organisation', 'government_body', 'appg') AND did IS NULL AND rid IS NULL THEN lower(trim(raw_name)) END AS k5
        FROM men)"""
_RULES = {"company_number": "k1", "party_name": "k2", "officer_link": "link", "parliament_id": "pid", "body_name": "k5", "donor_id": "did", "regulated_entity_id": "rid", "single": "mention_id"}


def _keyed(*chosen: str) -> str:
    cases = " ".join(f"WHEN {_RULES[r]} IS NOT NULL THEN '{r}'" for r in chosen or _RULES)
    keys = ", ".join(_RULES[r] for r in chosen or _RULES)
    return f"WITH {_MENTIONS}, keyed AS (SELECT *, md5(rule || '|' || key) AS entity_id FROM (SELECT *, CASE {cases} END AS rule, coalesce({keys}) AS key FROM rules) WHERE rule IS NOT NULL)"


def _resolved(*chosen: str) -> str:
    return f"""{_keyed(*chosen)}
        SELECT entity_id, rule, CASE WHEN rule = 'company_number' THEN 'company' WHEN rule = 'party_name' THEN 'party' WHEN rule = 'officer_link' AND bool_or(coalesce(orole, '') LIKE 'corporate%') THEN 'organisation'
            WHEN rule IN ('officer_link', 'parliament_id') THEN 'person' ELSE max(coalesce(hint, 'person')) END AS entity_type, min(raw_name) AS name,
            CASE rule WHEN 'company_number' THEN 'company' WHEN 'party_name' THEN 'party' WHEN 'parliament_id' THEN 'mp' END AS category, count(*) AS n_mentions
        FROM keyed GROUP BY entity_id, rule"""


def _plain(name: str) -> str:
    return f"regexp_replace(lower({name}), '[^a-z0-9 ]', ' ', 'g')"


def _base(name: str) -> str:
    text = _plain(name)
    for _, pattern in _SUFFIX_CLASSES:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return _sorted(f"regexp_replace({text}, '{_WEAK_WORDS}', ' ', 'g')")


def _class(name: str) -> str:
    text, out = _plain(name), "'none'"
    for kind, pattern in _SUFFIX_CLASSES:
        out = f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{kind}' ELSE {out} END"
    return out


def _modal(hint: str, column: str, source: str = "") -> str:
    folded = f"CASE WHEN lower(trim({column})) IN ({', '.join(repr(x) for x in _GB_ALIASES)}) THEN 'GB' ELSE {column} END" if column == "country" else column
    return f"""SELECT entity_id, v AS {column} FROM (
            SELECT entity_id, v, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, v) AS place
            FROM (SELECT entity_id, {folded} AS v FROM keyed WHERE hint = '{hint}' {source}) WHERE trim(coalesce(v, '')) <> '' GROUP BY entity_id, v) WHERE place = 1"""


_LAST = "CASE WHEN contains(raw, ',') THEN trim(split_part(raw, ',', 1)) ELSE coalesce(toks[-1], '') END"
_TITLES = ", ".join(f"'{t}'" for t in _MATCH_TITLES)
_MATCH = f"""{_NAMES},
    low AS (SELECT id, replace(replace(lower(raw_name), '.', ''), '''', '') AS raw FROM people),
    toks AS (SELECT *, list_filter(string_split(raw, ' '), lambda w: w <> '' AND w NOT IN ({_TITLES})) AS toks, list_filter(string_split(substr(raw, instr(raw, ',') + 1), ' '), lambda w: w <> '') AS rest FROM low),
    matched AS (SELECT id, {_LAST} AS surname, list_sort(list_distinct(list_filter(CASE WHEN contains(raw, ',') THEN rest ELSE toks[:-2] END,
        lambda w: length(w) > 1 AND w NOT IN ({_TITLES})))) AS fores FROM toks)"""
_PEOPLE = """
    ppl AS (
        SELECT e.entity_id, split_part(name, ' ', 2) AS surname, split_part(name, ' ', 1) AS fore, coalesce(nb, []) AS nb, registers AS src
        FROM mps e LEFT JOIN (SELECT entity_id, list(DISTINCT o) AS nb FROM (SELECT subject_id AS entity_id, object_id AS o FROM stm WHERE statement_type IN ('DIRECTOR_OF', 'OWNS')) GROUP BY 1) USING (entity_id)
            LEFT JOIN regs USING (entity_id)),
    ndeg AS (SELECT n, count(*) AS d FROM (SELECT unnest(nb) AS n FROM ppl) GROUP BY 1),
    rarity AS (SELECT surname, greatest(count(*) / (SELECT count(*) FROM ppl), 1e-5) AS u FROM ppl GROUP BY 1),
    prs AS (
        SELECT x.entity_id AS a, y.entity_id AS b, x.surname, u, x.fore AS fa, y.fore AS fb, x.src AS sa, y.src AS sb, list_intersect(x.nb, y.nb) AS sh
        FROM ppl x JOIN ppl y ON x.surname = y.surname AND x.entity_id < y.entity_id JOIN rarity r ON r.surname = x.surname),
    shw AS (SELECT a, b, avg(1 / (1 + ln(1 + d))) AS near FROM (SELECT a, b, unnest(sh) AS n FROM prs) JOIN ndeg USING (n) GROUP BY 1, 2),
    pairs AS (
        SELECT a, b, surname, len(sh) AS n_shared, round(CASE WHEN fa[1] <> fb[1] THEN 0.05 ELSE 1 / (1 + exp(-(ln(0.9 / u)
            + CASE WHEN fa = fb THEN ln(0.85 / 0.04) ELSE ln(0.4 / 0.2) END + CASE WHEN near IS NULL THEN ln(0.15 / 0.85) ELSE ln((0.5 + 0.5 * near) / 0.1) END + ln(0.02 / 0.98)))) END, 6) AS score,
            sa <> sb OR len(list_intersect(sa, sb)) = 0 AS across
        FROM prs LEFT JOIN shw USING (a, b)),
    banded AS (SELECT *, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.6 THEN 'lead' ELSE 'distinct' END AS band FROM pairs)"""
_EVERYONE = _PEOPLE.replace("FROM mps e LEFT JOIN", "FROM (SELECT * FROM ents WHERE entity_type = 'person') e LEFT JOIN").replace(
    "(SELECT subject_id AS entity_id, object_id AS o FROM stm WHERE statement_type IN ('DIRECTOR_OF', 'OWNS'))",
    "(SELECT subject_id AS entity_id, object_id AS o FROM stm UNION ALL SELECT object_id, subject_id FROM stm)",
)
_SCORED = """
    gold AS (SELECT event_id AS id, round(value % 1, 4) AS score, (round(value % 1, 4) > 0.35 + (event_id % 5) / 10)::INT AS label, event_type AS kind FROM events WHERE value IS NOT NULL)"""
_COMPONENTS = """
    sym AS (SELECT a, b FROM ppairs UNION SELECT b, a FROM ppairs),
    reach(n, r) AS (SELECT a, a FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.n),
    comps AS (SELECT n AS entity_id, min(r) AS component FROM reach GROUP BY n)"""
_ADJ = "adj AS (SELECT a, b, max(strength) AS s FROM (SELECT subject_id AS a, object_id AS b, strength FROM stm UNION ALL SELECT object_id, subject_id, strength FROM stm) GROUP BY 1, 2)"
_PATH = f"""{_ADJ},
    walk(id, path, hop) AS (
        SELECT 'P7', ['P7'], 0
        UNION ALL
        SELECT b, path || [b], hop + 1
        FROM (SELECT adj.b, min(w.path) AS path, any_value(w.hop) AS hop FROM walk w JOIN adj ON adj.a = w.id WHERE NOT list_contains(w.path, adj.b) GROUP BY adj.b)
        WHERE hop < 4),
    best AS (SELECT path FROM walk WHERE id = 'P11' ORDER BY hop, path LIMIT 1)"""
_LABELS = "labels(s, label) AS (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in _REGISTERS.items()) + ")"
_RANKED = """
    covered AS (
        SELECT subject_id AS entity_id FROM stm JOIN mps ON mps.entity_id = subject_id WHERE statement_type IN ('DIRECTOR_OF', 'OWNS', 'ADVISER_TO')
        UNION SELECT subject_id FROM stm WHERE statement_type = 'DONATED_TO' AND subject_id IN (SELECT subject_id FROM stm WHERE statement_type = 'CONTRACTED_WITH')),
    uncovered AS (SELECT entity_id FROM ents WHERE entity_id NOT IN (SELECT entity_id FROM covered))"""
_FINDING = "SELECT finding_id, shape_code, members, n_statements, slots, rarity, corroboration, money, surprise, min_confidence, is_lead FROM found"

SQL: dict[str, str] = {
    "name_key_person": f"WITH {_NAMES} SELECT id, {_person_key('raw_name')} AS name_key, array_to_string(list_sort(list_filter(string_split({_plain('raw_name')}, ' '), lambda x: x <> '' AND x NOT IN ({', '.join(repr(t) for t in _NAME_TITLES)}))), ' ') AS token_key FROM people",
    "name_key_org": f"WITH {_NAMES} SELECT id, {_sorted('regexp_replace(' + _plain('raw_name') + ', ' + repr('(^| )(' + '|'.join(_LEGAL_FORMS) + ')( |$)') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS name_key FROM companies",
    "match_name": f"WITH {_MATCH} SELECT id, surname, array_to_string(fores, ' ') AS forenames FROM matched",
    "suffix_class": f"WITH {_NAMES} SELECT id, {_class('raw_name')} AS suffix_class, {_base('raw_name')} AS base FROM companies",
    "edges_mapped": _graph("SELECT statement_type, source_code, count(*) AS n, round(sum(confidence), 2) AS confidence FROM mapped GROUP BY ALL"),
    "edges_statements": _graph("SELECT statement_id, subject_id, statement_type, object_id, valid_from, valid_to, confidence, strength, amount_gbp, array_to_string(sources, ',') AS sources FROM stm"),
    "edges_strength_plain": _graph("SELECT statement_id, plain_strength AS strength FROM stm"),
    "edges_provenance": _graph("""SELECT md5(concat_ws('|', statement_type, a, b)) AS statement_id, count(*) AS n_assertions
        FROM (SELECT DISTINCT statement_type, source_code, a, b, valid_from, valid_to, amount FROM mapped) GROUP BY 1"""),
    "edges_corroborated": _graph("""SELECT a AS subject_id, statement_type, b AS object_id, round(1 - exp(sum(ln(greatest(1 - c, 1e-12)))), 4) AS confidence, count(*) AS n_sources
        FROM (SELECT a, statement_type, b, source_code, max(confidence) AS c FROM mapped GROUP BY ALL) GROUP BY ALL"""),
    "scrutiny_money": _graph("SELECT * FROM credited"),
    "scrutiny_score": _graph("SELECT * FROM scrut"),
    "motif_conflict_flag": _graph("""SELECT m.entity_id, count(DISTINCT object_id) FILTER (statement_type IN ('MEMBER_OF', 'CHAIR_OF', 'MINISTERIAL_ROLE')) AS n_seats,
            count(DISTINCT object_id) FILTER (statement_type IN ('OWNS', 'DIRECTOR_OF')) AS n_interests, n_seats > 0 AND n_interests > 0 AS flagged
        FROM mps m LEFT JOIN stm ON subject_id = m.entity_id GROUP BY 1"""),
    "motif_theme_match": _graph("SELECT mp AS mp_id, theme FROM held_themes"),
    "motif_conflict_strength": _graph("""SELECT entity_id, conflict_flag, CASE WHEN conflict_flag THEN level END AS conflict_strength, CASE WHEN conflict_flag THEN overlap END AS conflict_overlap,
            CASE WHEN conflict_flag THEN 'Interests: ' || orgs || '. Seats: ' || bodies || '. ' || coalesce('Shared themes: ' || overlap, 'No shared theme') END AS conflict_reason FROM conflicts"""),
    "graph_degree_idf": _graph("SELECT entity_id, round(idf, 6) AS idf FROM idfs"),
    "statement_sources": _graph("SELECT statement_id, unnest(sources) AS source_code FROM stm"),
    **{f"finding_{s.lower()}": _graph(_FINDING, _found(s)) for s in _CANDIDATES},
    "suggested_pairs": _graph("""SELECT md5('PAIR|' || a || '|' || b) AS pair_id, a AS from_id, b AS to_id, why, round(1 / (1 + coalesce(total, 0)), 4) AS surprise
        FROM (SELECT a, b, why, total, row_number() OVER (PARTITION BY a, b ORDER BY total NULLS LAST, finding_id) AS place FROM best_of) WHERE place = 1 ORDER BY total NULLS LAST, a, b LIMIT 40""",
        _found("FAMILY_DESK") + """,
        mem AS (SELECT finding_id, unnest(member_ids) AS m, slots FROM found WHERE NOT is_lead),
        mp AS (SELECT x.finding_id, x.m AS a, y.m AS b, x.slots, p.degree + q.degree AS total FROM mem x JOIN mem y ON x.finding_id = y.finding_id AND x.m < y.m
            LEFT JOIN degs p ON p.entity_id = x.m LEFT JOIN degs q ON q.entity_id = y.m),
        best_of AS (SELECT *, 'Linked through ' || regexp_extract(slots, 'company=([^;]*)', 1) || ', sharing the surname ' || regexp_extract(slots, 'surname=([^;]*)', 1) || '.' AS why
            FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY total NULLS FIRST, a, b) AS place FROM mp) WHERE place = 1)"""),
    "overseas_leads": _graph("""SELECT md5('OVERSEAS_LEAD|' || d.donor_id || '|' || o.entity_id) AS lead_id, d.donor_id, d.donor AS donor_name, o.name AS officer_name, o.jurisdiction AS country, d.amount_gbp, d.recipient
        FROM donors d JOIN pkeys k ON k.entity_id = d.donor_id AND k.name_key <> '' JOIN pkeys l ON l.name_key = k.name_key AND l.entity_id <> d.donor_id
            JOIN ents o ON o.entity_id = l.entity_id AND o.jurisdiction <> 'GB'""",
        """donors AS (SELECT donor_id, donor, amount_gbp, recipient FROM (
            SELECT subject_id AS donor_id, e.name AS donor, amount_gbp, r.name AS recipient, sum(amount_gbp) OVER (PARTITION BY subject_id) AS total,
                row_number() OVER (PARTITION BY subject_id ORDER BY amount_gbp DESC, r.name DESC, object_id DESC) AS place
            FROM stm JOIN ents e ON e.entity_id = subject_id AND e.entity_type = 'person' JOIN ents r ON r.entity_id = object_id WHERE statement_type = 'DONATED_TO') WHERE place = 1 AND total >= 250000)"""),
    "insight_registers": _graph("SELECT entity_id, array_to_string(registers, ',') AS registers, n_registers FROM regs"),
    "insight_rank_money_given": _money_rank("subject_id", "object_id", "RANK_MONEY_GIVEN", "person", "person", "company", "recipients"),
    "insight_rank_money_received": _money_rank("object_id", "subject_id", "RANK_MONEY_RECEIVED", "party", "party", "person", "donors"),
    "insight_rank_portfolio": _insight("RANK_PORTFOLIO", """SELECT entity_id, NULL AS tag, 0.85 * (1 - (rank - 1) / greatest(1, cohort_size)) AS priority, rank, cohort_size,
            'kinds_breakdown=' || kinds || ';n_ties=' || n_ties || ';name=' || name || ';percentile=' || round(100 * (1 - (rank - 1) / greatest(1, cohort_size)), 1)::DECIMAL(5,1) AS slots FROM ranked""",
        """kinds AS (SELECT subject_id, name, statement_type, count(*) AS n FROM stm JOIN mps ON mps.entity_id = subject_id WHERE statement_type IN ('DIRECTOR_OF', 'OWNS', 'ADVISER_TO') GROUP BY ALL),
        pf AS (SELECT subject_id AS entity_id, name, sum(n)::BIGINT AS n_ties, string_agg(statement_type || ':' || n, ',' ORDER BY statement_type) AS kinds FROM kinds GROUP BY 1, 2),
        ranked AS (SELECT *, rank() OVER (ORDER BY n_ties DESC) AS rank, count(*) OVER () AS cohort_size FROM pf)"""),
    "insight_only_donor_contractor": _insight("ONLY_N", """SELECT entity_id, 'donor_contractor' AS tag, 1 / count(*) OVER () AS priority, NULL::BIGINT AS rank, count(*) OVER () AS cohort_size,
            'name=' || name || ';set=donor_contractor;set_size=' || count(*) OVER () AS slots FROM ents
            WHERE entity_id IN (SELECT subject_id FROM stm WHERE statement_type = 'DONATED_TO') AND entity_id IN (SELECT subject_id FROM stm WHERE statement_type = 'CONTRACTED_WITH')"""),
    "insight_only_crossing": _insight("ONLY_N", """SELECT entity_id, 'crossing' AS tag, 1 / count(*) OVER () AS priority, NULL::BIGINT AS rank, count(*) OVER () AS cohort_size,
            'name=' || name || ';set=crossing;set_size=' || count(*) OVER () AS slots FROM ents JOIN regs USING (entity_id) WHERE n_registers >= 3 AND entity_id NOT IN (SELECT entity_id FROM hubs)"""),
    "insight_bridge": _insight("BRIDGE", """SELECT entity_id, NULL AS tag, 0.6 * (1 - (rank - 1) / greatest(1, cohort_size)) AS priority, rank, cohort_size,
            'n_registers=' || n_registers || ';name=' || name || ';registers=' || array_to_string(registers, ',') AS slots
            FROM (SELECT *, rank() OVER (ORDER BY n_registers DESC) AS rank, count(*) OVER () AS cohort_size FROM ents JOIN regs USING (entity_id) WHERE n_registers >= 3 AND entity_id NOT IN (SELECT entity_id FROM hubs))"""),
    "insight_nearest_notable": _insight("NEAREST_NOTABLE", """SELECT n.entity_id, NULL AS tag, 0.3 / hops AS priority, NULL::BIGINT AS rank, NULL::BIGINT AS cohort_size,
            'headline=' || shape_code || ':' || hint || ';hops=' || hops || ';name=' || e.name || ';notable_name=' || o.name AS slots
            FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY hops, finding_id, notable_id) AS place FROM near) n JOIN ents e USING (entity_id) JOIN ents o ON o.entity_id = notable_id WHERE place = 1""",
        _found("BIG_MONEY", "SHARED_BENCH") + f""",{_RANKED}, {_ADJ},
        notable AS (SELECT finding_id, shape_code, CASE shape_code WHEN 'BIG_MONEY' THEN regexp_extract(slots, 'donor=([^;]*)', 1) ELSE regexp_extract(slots, 'org=([^;]*)', 1) END AS hint,
            unnest(member_ids) AS notable_id FROM found WHERE NOT is_lead),
        near AS (
            SELECT u.entity_id, n.*, 1 AS hops FROM uncovered u JOIN adj ON a = u.entity_id JOIN notable n ON n.notable_id = b
            UNION ALL SELECT u.entity_id, n.*, 2 FROM uncovered u JOIN adj x ON x.a = u.entity_id JOIN adj y ON y.a = x.b JOIN notable n ON n.notable_id = y.b AND n.notable_id <> u.entity_id)"""),
    "insight_basic": _insight("BASIC", """SELECT entity_id, NULL AS tag, 0.05::DOUBLE AS priority, NULL::BIGINT AS rank, NULL::BIGINT AS cohort_size,
            'n_registers=' || coalesce(n_registers, 0) || ';n_ties=' || coalesce(degree, 0) || ';name=' || name AS slots FROM uncovered JOIN ents USING (entity_id) LEFT JOIN degs USING (entity_id) LEFT JOIN regs USING (entity_id)""", _RANKED),
    "register_stats": _graph("""
        SELECT 'total_political_money' AS stat, sum(amount_gbp)::DECIMAL(28,2) AS value, format('{:,}', round(sum(amount_gbp))::BIGINT) || '|' || count(*) || '|' || count(DISTINCT subject_id) AS detail FROM gifts
        UNION ALL (SELECT 'largest_single_donation', amount_gbp, d.name || '|' || r.name FROM gifts JOIN ents d ON d.entity_id = subject_id JOIN ents r ON r.entity_id = object_id ORDER BY amount_gbp DESC, statement_id LIMIT 1)
        UNION ALL SELECT 'parliamentarians_with_paid_ties', count(DISTINCT mp), '' FROM held
        UNION ALL SELECT 'donor_and_contractor_companies', count(DISTINCT subject_id), '' FROM gifts WHERE subject_id IN (SELECT subject_id FROM stm WHERE statement_type = 'CONTRACTED_WITH')
        UNION ALL SELECT 'entities_total', count(*), '' FROM ents UNION ALL SELECT 'statements_total', count(*), '' FROM stm
        UNION ALL SELECT 'registers_total', count(DISTINCT s), '' FROM (SELECT unnest(sources) AS s FROM stm)
        UNION ALL (SELECT 'newest_disclosure', NULL, valid_from || '|' || s.name || '|' || statement_type || '|' || o.name FROM stm JOIN ents s ON s.entity_id = subject_id JOIN ents o ON o.entity_id = object_id
            WHERE valid_from IS NOT NULL ORDER BY valid_from DESC, statement_id LIMIT 1)""", "gifts AS (SELECT * FROM stm WHERE statement_type = 'DONATED_TO')"),
    "resolve_company_number": _resolved("company_number"),
    "resolve_party_name": _resolved("party_name"),
    "resolve_officer_type": _resolved("officer_link"),
    "resolve_parliament_id": _resolved("parliament_id"),
    "resolve_exact_name": _resolved("body_name"),
    "resolve_donor_id": _resolved("donor_id"),
    "resolve_regulated_entity": _resolved("regulated_entity_id"),
    "resolve_singletons": f"{_keyed()} SELECT mention_id, entity_id FROM keyed WHERE rule = 'single'",
    "resolve_cascade": _resolved(),
    "resolve_unresolved": f"WITH {_MENTIONS} SELECT mention_id FROM rules WHERE k1 IS NULL AND link IS NULL",
    "dedupe_neighbours": _graph("SELECT * FROM nbrs"),
    "dedupe_person_pairs": _graph("SELECT * FROM ppairs"),
    "dedupe_org_pairs": _graph("SELECT a, entity_id AS b FROM (SELECT entity_id, key, min(entity_id) OVER (PARTITION BY key) AS a FROM okeys WHERE key <> '') WHERE entity_id <> a",
        f"okeys AS (SELECT entity_id, {_sorted('regexp_replace(' + _plain('name') + ', ' + repr('(^| )(' + '|'.join(_LEGAL_FORMS) + ')( |$)') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS key FROM ents WHERE entity_type IN ('organisation', 'company'))"),
    "dedupe_components": _graph("SELECT * FROM comps", _COMPONENTS),
    "dedupe_survivors": _graph("SELECT component, entity_id AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, entity_id) AS place FROM comps JOIN (SELECT entity_id, count(*) AS n FROM ends GROUP BY 1) USING (entity_id)) WHERE place = 1", _COMPONENTS),
    "enrich_modal_value": f"{_keyed()} {_modal('person', 'country', 'AND source_code = ' + repr('companies_house'))}",
    "enrich_nationality": f"{_keyed()} {_modal('person', 'nationality', 'AND source_code = ' + repr('companies_house'))}",
    "enrich_company_jurisdiction": f"{_keyed()}, numbered AS (SELECT DISTINCT entity_id FROM keyed WHERE hint = 'company' AND crn IS NOT NULL) SELECT entity_id, 'GB' AS country FROM numbered UNION ALL SELECT * FROM ({_modal('company', 'country')}) WHERE entity_id NOT IN (SELECT entity_id FROM numbered)",
    "fs_surname_rarity": _graph("SELECT surname, round(u, 6) AS u FROM rarity", _PEOPLE),
    "fs_score_pairs": _graph("SELECT * FROM banded", _PEOPLE),
    "fs_bands": _graph("SELECT band, across, count(*) AS n FROM banded GROUP BY ALL", _PEOPLE),
    "fs_surname_rarity_everyone": _graph("SELECT surname, round(u, 6) AS u FROM rarity", _EVERYONE),
    "fs_score_pairs_everyone": _graph("SELECT * FROM banded", _EVERYONE),
    "fs_bands_everyone": _graph("SELECT band, across, count(*) AS n FROM banded GROUP BY ALL", _EVERYONE),
    "calib_threshold": f"WITH {_SCORED} SELECT min(score) AS threshold FROM (SELECT score, sum(label) OVER w / count(*) OVER w AS p FROM gold WINDOW w AS (ORDER BY score DESC, label DESC ROWS UNBOUNDED PRECEDING)) WHERE p >= 0.9",
    "calib_reliability": f"WITH {_SCORED} SELECT b AS bin, count(*) AS n, round(sum(score::DECIMAL(18,6))::DOUBLE / count(*), 4) AS mean_score, round(avg(label), 4) AS share FROM (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS p, count(*) OVER () AS n FROM gold) JOIN range(10) r(b) ON p >= b * n // 10 AND p < (b + 1) * n // 10 GROUP BY b",
    "calib_report": f"WITH {_SCORED} SELECT kind, count(*) AS n, round(min(score), 4) AS least, round(quantile_cont(score, 0.5), 4) AS median, round(max(score), 4) AS most, round(avg(score), 4) AS mean FROM gold GROUP BY kind",
    "graph_load_nodes": _graph("SELECT * FROM node"),
    "graph_types": _graph("SELECT entity_type, count(*) AS n FROM ents GROUP BY 1"),
    "leads_conflicts": _graph("""SELECT entity_id, n.name, level AS conflict_strength, overlap AS conflict_overlap, scrutiny, importance,
            row_number() OVER (ORDER BY CASE level WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, scrutiny DESC, importance DESC, n.name, entity_id) AS place
        FROM conflicts JOIN scrut USING (entity_id) JOIN node n USING (entity_id) WHERE conflict_flag"""),
    "leads_concentrations": _graph("""SELECT o AS entity_id, name, n_people, donor, contractor FROM (
            SELECT o, e.name, count(DISTINCT p) FILTER (q.entity_type = 'person') AS n_people, bool_or(statement_type = 'DONATED_TO' AND f) AS donor, bool_or(statement_type = 'CONTRACTED_WITH') AS contractor
            FROM (SELECT subject_id AS o, object_id AS p, statement_type, true AS f FROM stm UNION ALL SELECT object_id, subject_id, statement_type, false FROM stm) s
                JOIN ents e ON e.entity_id = o AND e.entity_type IN ('company', 'organisation') JOIN ents q ON q.entity_id = p GROUP BY 1, 2) WHERE donor AND contractor OR n_people >= 3"""),
    "ego_graph": _graph("SELECT statement_id FROM stm WHERE subject_id IN (SELECT e FROM near) AND object_id IN (SELECT e FROM near)",
        "top AS (SELECT * FROM stm WHERE subject_id = 'P7' OR object_id = 'P7' ORDER BY strength DESC, statement_id LIMIT 40), near AS (SELECT subject_id AS e FROM top UNION SELECT object_id FROM top)"),
    "graph_shortest_path": _graph("SELECT generate_subscripts(path, 1)::INT - 1 AS hop, unnest(path) AS entity_id FROM best", _PATH),
    "graph_focus_2hop": _graph("SELECT 'P7' AS entity_id, 0 AS hop UNION ALL SELECT entity_id, 1 FROM h1 UNION ALL SELECT entity_id, 2 FROM h2", f"""{_ADJ},
        h1 AS (SELECT b AS entity_id FROM adj WHERE a = 'P7' ORDER BY s DESC, b LIMIT 149),
        h2 AS (SELECT b AS entity_id FROM (SELECT b, max(s) AS s FROM adj WHERE a IN (SELECT entity_id FROM h1) AND b <> 'P7' AND b NOT IN (SELECT entity_id FROM h1) GROUP BY b)
            ORDER BY s DESC, b LIMIT (SELECT 149 - count(*) FROM h1))"""),
    "entity_rank_search": _graph("""SELECT entity_id, n.name, CASE WHEN NOT conflict_flag THEN 3 ELSE coalesce(CASE level WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END, 3) END AS conflict_rank, scrutiny, importance
        FROM node n JOIN scrut USING (entity_id) LEFT JOIN conflicts USING (entity_id) WHERE contains(lower(n.name), 'bolt') ORDER BY conflict_rank, scrutiny DESC, importance DESC, n.name, entity_id LIMIT 40"""),
    "ledger_sorted": _graph("SELECT finding_id, total::DECIMAL(28,2) AS amount_gbp, surprise FROM found WHERE total >= 200000", _found("BIG_MONEY", "OVERSEAS_MONEY")),
    "strongest_money_tie": _graph("SELECT statement_id, amount_gbp FROM stm WHERE (subject_id = 'P7' OR object_id = 'P7') AND amount_gbp IS NOT NULL ORDER BY amount_gbp DESC, statement_id LIMIT 1"),
    "hidden_links": _graph("SELECT count(*) FILTER (confidence * 100 < 80) AS hidden, count(*) AS n FROM stm"),
    "visible_neighbours": _graph("SELECT e.entity_id, e.name, e.entity_type, max(strength) AS strength FROM (SELECT object_id AS o, * FROM stm WHERE subject_id = 'P7' UNION ALL SELECT subject_id, * FROM stm WHERE object_id = 'P7') JOIN ents e ON e.entity_id = o WHERE confidence * 100 >= 40 AND e.entity_type IN ('company', 'organisation') GROUP BY 1, 2, 3"),
    "top_gifts_by_recipient": _graph("SELECT object_id, place::INT AS place, subject_id, amount_gbp FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY amount_gbp DESC, statement_id) AS place FROM stm WHERE statement_type = 'DONATED_TO') WHERE place <= 3"),
    "ties_of": _graph("""SELECT statement_type, direction, o AS other_id, e.name AS other, confidence, strength, round(2 * strength + confidence, 4) AS score, max(round(2 * strength + confidence, 4)) OVER (PARTITION BY statement_type) AS group_score,
            row_number() OVER (PARTITION BY statement_type ORDER BY round(2 * strength + confidence, 4) DESC, statement_id)::INT AS place
        FROM (SELECT 'out' AS direction, object_id AS o, * FROM stm WHERE subject_id = 'P7' UNION ALL SELECT 'in', subject_id, * FROM stm WHERE object_id = 'P7') JOIN ents e ON e.entity_id = o"""),
    "graph_registers": _graph("SELECT DISTINCT coalesce(label, s) AS register FROM (SELECT unnest(sources) AS s FROM stm) LEFT JOIN labels USING (s)", _LABELS),
    "graph_load_links": _graph("""SELECT statement_id, subject_id, object_id, replace(lower(statement_type), '_', ' ') AS relation, method, '£' || format('{:,}', round(amount_gbp)::BIGINT) AS amount, confidence, strength,
            CASE WHEN confidence >= 0.8 THEN 'Established' WHEN confidence >= 0.5 THEN 'Probable' ELSE 'Lead' END AS tier,
            CASE WHEN strength >= 0.75 THEN 'very strong' WHEN strength >= 0.5 THEN 'strong' WHEN strength >= 0.25 THEN 'moderate' ELSE 'weak' END AS band
        FROM stm JOIN (SELECT statement_id, string_agg(coalesce(label, s), ' + ' ORDER BY s) AS method FROM (SELECT statement_id, unnest(sources) AS s FROM stm) LEFT JOIN labels USING (s) GROUP BY 1) USING (statement_id)""", _LABELS),
    "graph_path_summary": _graph("""SELECT count(*) AS steps, min(confidence) AS weakest, (SELECT count(DISTINCT s) FROM (SELECT unnest(sources) AS s FROM onpath)) AS n_sources
        FROM (SELECT hop, max(confidence) AS confidence FROM onpath GROUP BY hop)""", f"""{_PATH},
        steps AS (SELECT h AS hop, path[h] AS x, path[h + 1] AS y FROM best, range(1, len(path)) r(h)),
        onpath AS (SELECT hop, stm.* FROM steps JOIN stm ON subject_id = x AND object_id = y OR subject_id = y AND object_id = x)"""),
    "leads_money": _graph("""SELECT statement_id, donor, party, amount_gbp, coalesce((SELECT string_agg(name, ', ' ORDER BY o) FROM (
            SELECT DISTINCT o, e.name FROM around JOIN ents e ON e.entity_id = o WHERE around.d = top.subject_id AND o <> top.object_id ORDER BY o LIMIT 4)), '') AS behind FROM top""",
        """top AS (SELECT stm.*, d.name AS donor, p.name AS party FROM stm JOIN ents p ON p.entity_id = object_id AND p.entity_type = 'party' JOIN ents d ON d.entity_id = subject_id
            WHERE statement_type = 'DONATED_TO' ORDER BY amount_gbp DESC, statement_id LIMIT 8),
        around AS (SELECT subject_id AS d, object_id AS o FROM stm WHERE statement_type IN ('DIRECTOR_OF', 'PSC_OF', 'OWNS') UNION SELECT object_id, subject_id FROM stm WHERE statement_type IN ('DIRECTOR_OF', 'PSC_OF', 'OWNS'))"""),
    "lead_pick": _graph("""SELECT finding_id, score FROM (SELECT finding_id, round(surprise * CASE shape_code WHEN 'OVERSEAS_MONEY' THEN 1.3 ELSE 1.0 END
            * CASE WHEN len(list_filter(member_ids, lambda x: x LIKE 'C%')) > 0 THEN 1.3 ELSE 1.0 END, 4) AS score FROM found) ORDER BY score DESC, finding_id LIMIT 1""", _found("OVERSEAS_MONEY", "SHARED_BENCH")),
    "evidence": _graph("SELECT DISTINCT statement_id, strength FROM ends WHERE entity_id = 'C1' ORDER BY strength DESC, statement_id LIMIT 12"),
    "constellation": _graph("SELECT entity_id, source, row_number() OVER (ORDER BY source, w DESC, entity_id) AS place FROM firsts ORDER BY source, w DESC, entity_id LIMIT 300",
        _found("BIG_MONEY") + """,
        every AS (
            SELECT unnest(member_ids) AS entity_id, 1 AS source, surprise AS w FROM found
            UNION ALL SELECT entity_id, 2, amount_gbp::DOUBLE FROM (SELECT subject_id, object_id, amount_gbp FROM stm WHERE statement_type = 'DONATED_TO' ORDER BY amount_gbp DESC, statement_id LIMIT 25) UNPIVOT (entity_id FOR e IN (subject_id, object_id))
            UNION ALL SELECT entity_id, 3, ties::DOUBLE FROM (SELECT entity_id, ties FROM node ORDER BY ties DESC, entity_id LIMIT 50)),
        firsts AS (SELECT entity_id, source, max(w) AS w FROM every e WHERE source = (SELECT min(source) FROM every f WHERE f.entity_id = e.entity_id) GROUP BY 1, 2)"""),
    "surname_given": f"""WITH {_NAMES} SELECT id, lower(CASE WHEN contains(raw_name, ',') THEN trim(split_part(raw_name, ',', 1)) ELSE regexp_replace(raw_name, '^.* ', '') END) AS surname,
            nullif(array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(lower(CASE WHEN contains(raw_name, ',') THEN regexp_replace(split_part(raw_name, ',', 2), '^ ', '')
                ELSE regexp_replace(raw_name, ' [^ ]*$', '') END), '[^a-z ]', '', 'g'), ' ')), lambda w: w <> '' AND w NOT IN ({", ".join(repr(w) for w in _NO_GIVEN_NAMES)}))), ' '), '') AS given FROM people""",
    "supplier_search_key": f"""WITH {_NAMES}, sup AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(raw_name), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'),
            '{_SUPPLIER_SUFFIXES}', ' ', 'g'), '\\s+', ' ', 'g')) AS supplier FROM companies),
        toks AS (SELECT id, supplier, unnest(string_split(supplier, ' ')) AS w, generate_subscripts(string_split(supplier, ' '), 1) AS i FROM sup),
        stops AS (SELECT id, min(i) AS m FROM toks WHERE i > 1 AND w IN ({", ".join(repr(w) for w in _GENERIC_TAIL)}) GROUP BY id)
        SELECT id, supplier, string_agg(w, ' ' ORDER BY i) FILTER (i < coalesce(m, 1000)) AS search_key FROM toks LEFT JOIN stops USING (id) GROUP BY 1, 2""",
    "money_parse": """WITH t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n,
            CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE '£' || format('{:,}', floor(o_totalprice)::BIGINT) || '.50' END AS raw FROM orders),
        v AS (SELECT *, try_cast(trim(regexp_replace(raw, '[£,]', '', 'g')) AS DECIMAL(18,2)) AS d FROM t)
        SELECT o_orderkey, CASE WHEN raw = '' THEN 0 ELSE d END AS money, d AS declared, CASE WHEN d > 0 THEN d END AS contract, (n % 90) * ([1e3, 1e6, 1e9, 1.0])[o_orderkey % 4 + 1]::DOUBLE AS short FROM v""",
    "interest_lines": f"""WITH {_NAMES}, l AS (SELECT id, id % 4 AS k, raw_name, id % 7 < 5 AS legal, CASE WHEN id % 4 = 0 THEN 'Co-chair and Director' WHEN id % 4 = 2 THEN 'Adviser' END AS role FROM companies)
        SELECT id, role, CASE WHEN role IS NOT NULL THEN raw_name END AS org, CASE WHEN k = 0 THEN 'DIRECTOR_OF' ELSE 'ADVISER_TO' END AS statement_type,
            CASE WHEN NOT legal OR k = 3 THEN NULL WHEN k = 1 THEN raw_name || ' (UK)' ELSE role || ', ' || raw_name END AS shares_in, CASE WHEN id % 7 < 6 THEN 'company' ELSE 'organisation' END AS entity_type
        FROM l""",
    "html_headings": """WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, html FROM pages)
        SELECT page_id, replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, len(regexp_extract_all(html, '(?is)<li>(.*?)</li>')) AS n_items FROM t""",
    "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS register_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS strict_date FROM orders""",
}
