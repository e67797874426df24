"""DuckDB SQL for the queries over landed registers and writes, from the driver's tables directly."""

from __future__ import annotations

from .oracles import _NAMES, _base, _class, _found, _graph, _plain, _sorted

_COLUMNS = "mention_id, source, hint, raw_name, crn, link, orole, pid, did, rid, country, nationality, description, dob, ident"
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in _COLUMNS.split(", ")[1:])
_ORDERS = """
    o AS (
        SELECT o_orderkey AS k, o_custkey AS c, c_mktsegment AS segment, p_name AS person, floor(o_totalprice)::BIGINT AS price, o_orderdate::DATE AS day, o_orderpriority AS priority
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_custkey)"""


def _men(source: str, key: str, hint: str, name: str, frm: str, **columns: str) -> str:
    """One kind of mention. key: what is hashed after the source; columns: crn, link, ... as SQL."""
    given = {"hint": hint, "raw_name": name, "ident": "false"} | columns
    rest = ", ".join(f"{given.get(c, 'NULL')}{'::BOOLEAN' if c == 'ident' else '::VARCHAR'} AS {c}" for c in _COLUMNS.split(", ")[2:])
    return f"SELECT md5(concat_ws('|', '{source}', {key})) AS mention_id, '{source}' AS source, {rest} FROM {frm}"


def _tie(source: str, kind: str, a: str, b: str, frm: str, begin: str = "NULL", end: str = "NULL", amount: str = "NULL") -> str:
    one = lambda key: f"md5(concat_ws('|', '{source}', {key}))"
    return f"SELECT {kind} AS kind, '{source}' AS source, {one(a)} AS a, {one(b)} AS b, ({begin})::DATE AS vfrom, ({end})::DATE AS vto, ({amount})::DECIMAL(18,2) AS amount FROM {frm}"


def _landed(steps: str, mentions: list[str], ties: list[str]) -> str:
    keys = ", ".join(f"coalesce({c}, '')" for c in _COLUMNS.split(", ")[4:-1])
    ends = "coalesce(vfrom::VARCHAR, ''), coalesce(vto::VARCHAR, ''), coalesce(amount::VARCHAR, '')"
    return f"""WITH RECURSIVE {steps},
        m0 AS ({" UNION ALL ".join(mentions)}),
        m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY {_ORDER}) AS place FROM m0 WHERE raw_name IS NOT NULL) WHERE place = 1),
        t AS ({" UNION ALL ".join(ties)})
        SELECT 'mention' AS record, mention_id AS id, source AS source_code, hint AS kind, raw_name AS name, concat_ws('|', {keys}, ident::VARCHAR) AS detail FROM m
        UNION ALL SELECT 'tie', md5(concat_ws('|', kind, source, a, b, {ends})), source, kind, NULL, concat_ws('|', a, b, {ends}) FROM t WHERE a <> b"""


_COMPANIES = f"""{_NAMES},
    co AS (SELECT id, lpad(id::VARCHAR, 8, '0') AS number, raw_name, CASE WHEN id % 5 = 0 THEN 'dissolved' ELSE 'active' END AS status FROM companies),
    li AS (SELECT co.*, l_partkey AS p, l_linenumber AS line, l_returnflag AS flag, l_shipdate::DATE AS day, p_name, 1930 + p_size AS born
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN co ON l_suppkey = id WHERE l_quantity >= 49),
    off AS (SELECT * FROM li WHERE line % 2 = 1),
    psc AS (SELECT *, p % 3 = 0 AS corporate FROM li WHERE line % 2 = 0 AND p % 11 <> 0)"""
_DONATIONS = f"""{_ORDERS},
    d AS (
        SELECT k, CASE WHEN k % 17 <> 0 THEN 'Party ' || k % 5 END AS party, k % 2 = 0 AS is_party, CASE WHEN k % 9 <> 0 THEN price + 0.5 ELSE 0 END AS value,
            CASE WHEN k % 13 <> 0 THEN person END AS donor, (['person', 'company', 'party', 'organisation'])[k % 4 + 1] AS hint, CASE WHEN k % 4 = 1 THEN c::VARCHAR END AS crn,
            CASE WHEN k % 5 <> 0 THEN c::VARCHAR END AS did, CASE WHEN k % 3 <> 0 THEN (k % 5)::VARCHAR END AS rid, day
        FROM o WHERE k % 13 <> 0 AND k % 17 <> 0)"""
_INTERESTS = f"""{_ORDERS},
    i AS (
        SELECT c::VARCHAR AS mid, person, day, k, CASE k % 4 WHEN 0 THEN 'Org ' || k % 50 || ' Ltd' WHEN 1 THEN 'Payer ' || k % 30 || CASE WHEN k % 3 = 0 THEN ' plc' ELSE '' END ELSE 'Giver ' || k % 20 END AS other,
            CASE k % 4 WHEN 0 THEN 'OWNS' WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 'DIRECTOR_OF' ELSE 'ADVISER_TO' END ELSE 'DONATED_TO' END AS kind,
            CASE k % 4 WHEN 0 THEN 'company' WHEN 1 THEN CASE WHEN k % 12 = 5 THEN 'person' WHEN k % 3 = 0 THEN 'company' ELSE 'organisation' END ELSE 'person' END AS hint,
            CASE k % 4 WHEN 0 THEN 'housing' WHEN 1 THEN 'media' ELSE '' END AS about, CASE k % 4 WHEN 1 THEN k WHEN 2 THEN 500 END AS amount
        FROM o WHERE segment = 'BUILDING' AND k % 4 < 3),
    pairs AS (SELECT *, 'member|' || mid AS member, 'org|' || lower(other) AS org FROM i)"""
_LORDS = """
    l AS (
        SELECT o_orderkey AS k, (o_orderkey // 10)::VARCHAR AS mid, 'Lord ' || o_orderkey // 10 AS lord, o_orderkey % 11 = 0 AS deleted,
            CASE WHEN o_orderkey % 10 < 2 THEN o_orderkey % 10 + 1 END AS category, CASE WHEN o_orderkey % 10 >= 2 THEN o_orderkey - 2 END AS parent FROM orders),
    standing(k, category) AS (
        SELECT k, category FROM l WHERE parent IS NULL AND NOT deleted
        UNION ALL SELECT l.k, s.category FROM standing s JOIN l ON l.parent = s.k WHERE NOT l.deleted),
    said AS (
        SELECT mid, lord, s.category, CASE WHEN s.category = 1 AND k % 4 = 0 THEN 'Estate ' || k % 25 || ' Limited' WHEN s.category = 1 THEN 'Bureau ' || k % 25
            WHEN k % 4 = 1 THEN 'Land ' || k % 25 || ' Ltd (UK)' END AS org, CASE WHEN s.category = 2 THEN 'OWNS' WHEN k % 4 = 0 THEN 'DIRECTOR_OF' ELSE 'ADVISER_TO' END AS kind,
            CASE WHEN s.category = 2 OR k % 4 = 0 THEN 'company' ELSE 'organisation' END AS hint
        FROM standing s JOIN l USING (k) WHERE s.category = 1 OR k % 4 = 1)"""
_CONTRACTS = """
    known AS (SELECT s_suppkey AS s, s_name || ' Limited' AS name, lpad(s_suppkey::VARCHAR, 8, '0') AS number FROM supplier
        UNION ALL SELECT s_suppkey, s_name || ' PLC', 'X' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0),
    won AS (
        SELECT 'n' || l_orderkey AS notice, number, name, min('Council ' || l_orderkey % 20) AS buyer, max(CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice)::BIGINT END) AS amount,
            min(CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE ELSE l_shipdate::DATE + 1 END) AS begin, max(l_shipdate::DATE + 365) AS ending
        FROM lineitem JOIN known ON l_suppkey = s WHERE l_quantity >= 49 AND l_partkey % 23 <> 0 GROUP BY 1, 2, 3)"""
_GROUPS = """
    grp AS (SELECT n_nationkey AS n, 'Group of ' || n_name || ' & Friends' AS title FROM nation),
    officer AS (SELECT c_nationkey AS n, p_name AS person, c_custkey % 50 = 0 AS chair FROM customer JOIN part ON c_custkey = p_partkey WHERE c_custkey % 10 = 0),
    gift AS (SELECT s_nationkey AS n, s_name || ' Ltd' AS funder, floor(s_acctbal)::BIGINT AS value, make_date(2020, 2, (1 + s_suppkey % 9)::INT) AS day FROM supplier WHERE floor(s_acctbal) >= 1500)"""

_NUMBERS = "n AS (SELECT o_orderstatus AS source_code, o_orderkey AS k, floor(o_totalprice)::BIGINT AS v FROM orders)"

# Themes and their words.
_THEMES = {
    "housing": ["home", "housing", "propert", "estate", "renter", "planning", "infrastructure", "construction", "tenant", "land", "architect", "planner", "real estate"],
    "finance": ["capital", "invest", "financ", "bank", "asset", "fund", "trading", "advisory", "account", "equity", "wealth", "payment"],
    "health": ["health", "care", "medical", "nhs", "pharma", "clinic", "hospital", "optic", "ophthalm", "optom"],
    "defence": ["defence", "military", "armed forces", "aerospace"],
    "data_tech": ["data", "digital", "software", "online", "telecom", "cyber", "learning", "technolog"],
    "media": ["media", "broadcast", "film", "music", "event", "festival", "culture", "sport", "entertain", "communicat", "public relations"],
    "transport": ["transport", "rail", "aviation", "logistic", "freight"],
    "energy": ["energy", "power", "renewable", "solar", "petroleum"],
    "education": ["education", "school", "academ", "universit"],
    "legal": ["litigation", "solicitor", "barrister", "chambers"],
    "procurement": ["procurement", "supply chain"],
}
_LEX = ", ".join(f"({i}, '{t}', '{w}')" for i, (t, w) in enumerate((t, w) for t, ws in _THEMES.items() for w in ws))
_N_WORDS = sum(map(len, _THEMES.values()))

SQL: dict[str, str] = {
    "land_companies": _landed(
        _COMPANIES,
        [
            _men("companies_house", "'company', number", "'company'", "raw_name", "co", crn="number"),
            _men("companies_house", "'officer', '/officers/' || p", "'person'", "p_name", "off", link="'/officers/' || p", orole="CASE WHEN p % 50 = 0 THEN 'corporate-director' ELSE 'director' END",
                 country="CASE WHEN p % 3 = 0 THEN 'England' ELSE 'Malta' END", nationality="'British'", dob="born", ident="p % 70 = 0"),
            _men("companies_house", "'psc', number, p_name", "CASE WHEN corporate THEN 'company' ELSE 'person' END", "p_name", "psc", crn="CASE WHEN corporate THEN p END", country="'England'", nationality="'British'", dob="born"),
        ],
        [
            _tie("companies_house", "'DIRECTOR_OF'", "'officer', '/officers/' || p", "'company', number", "off", "day", "CASE WHEN flag = 'R' THEN day + 400 END"),
            _tie("companies_house", "CASE WHEN corporate THEN 'OWNS' ELSE 'PSC_OF' END", "'psc', number, p_name", "'company', number", "psc", "day"),
        ],
    ),
    "land_donations": _landed(
        _DONATIONS,
        [
            _men("electoral_commission", "'donor', coalesce(did, donor)", "hint", "donor", "d", crn="crn", did="did"),
            _men("electoral_commission", "'recipient', coalesce(rid, party)", "CASE WHEN is_party THEN 'party' ELSE 'person' END", "party", "d", rid="rid"),
        ],
        [_tie("electoral_commission", "'DONATED_TO'", "'donor', coalesce(did, donor)", "'recipient', coalesce(rid, party)", "d", "day", "NULL", "value")],
    ),
    "land_members": _landed(
        f"""{_ORDERS},
        mem AS (SELECT DISTINCT c, c::VARCHAR AS mid, person, CASE WHEN c % 9 <> 0 THEN 'Party ' || c % 5 END AS party FROM o WHERE segment = 'BUILDING'),
        post AS (SELECT * FROM o WHERE segment = 'BUILDING' AND k % 7 = 0), seat AS (SELECT *, 'Committee ' || k % 12 AS body FROM o WHERE segment = 'BUILDING' AND k % 7 IN (1, 2))""",
        [
            _men("parliament", "'member', mid", "'person'", "person", "mem", pid="mid"),
            _men("parliament", "'party', lower(party)", "'party'", "party", "mem"),
            _men("parliament", "'post', lower(priority)", "'government_body'", "priority", "post"),
            _men("parliament", "'committee', lower(body)", "'organisation'", "body", "seat"),
        ],
        [
            _tie("parliament", "'MEMBER_OF'", "'member', mid", "'party', lower(party)", "mem WHERE party IS NOT NULL"),
            _tie("parliament", "'MINISTERIAL_ROLE'", "'member', c", "'post', lower(priority)", "post", "day"),
            _tie("parliament", "CASE WHEN k % 7 = 1 THEN 'CHAIR_OF' ELSE 'MEMBER_OF' END", "'member', c", "'committee', lower(body)", "seat", "day"),
        ],
    ),
    "land_interests": _landed(
        _INTERESTS,
        [_men("parliament_interests", "member", "'person'", "person", "pairs", pid="mid"), _men("parliament_interests", "org", "hint", "other", "pairs", description="about")],
        [_tie("parliament_interests", "kind", "CASE WHEN kind = 'DONATED_TO' THEN org ELSE member END", "CASE WHEN kind = 'DONATED_TO' THEN member ELSE org END", "pairs", "day", "NULL", "amount")],
    ),
    "land_lords": _landed(
        _LORDS,
        [_men("lords_interests", "'member', mid", "'person'", "lord", "said", pid="mid"), _men("lords_interests", "'org', lower(org)", "hint", "org", "said")],
        [_tie("lords_interests", "kind", "'member', mid", "'org', lower(org)", "said")],
    ),
    "land_contracts": _landed(
        _CONTRACTS,
        [_men("contracts_finder", "'company', number", "'company'", "name", "won", crn="number"), _men("contracts_finder", "'buyer', lower(buyer)", "'government_body'", "buyer", "won")],
        [_tie("contracts_finder", "'CONTRACTED_WITH'", "'company', number", "'buyer', lower(buyer)", "won", "begin", "ending", "amount")],
    ),
    "land_groups": _landed(
        _GROUPS,
        [
            _men("appg", "'group', lower(title)", "'appg'", "title", "grp"), _men("appg", "'person', lower(person)", "'person'", "person", "officer"),
            _men("appg", "'funder', lower(funder)", "'company'", "funder", "gift"),
        ],
        [
            _tie("appg", "CASE WHEN chair THEN 'CHAIR_OF' ELSE 'MEMBER_OF' END", "'person', lower(person)", "'group', lower(title)", "officer JOIN grp USING (n)"),
            _tie("appg", "'FUNDS'", "'funder', lower(funder)", "'group', lower(title)", "gift JOIN grp USING (n)", "day", "NULL", "value"),
        ],
    ),
    "land_group_cells": "SELECT n_nationkey AS page_id, 0 AS row, 'Title|Group of ' || n_name || ' &amp; Friends' AS cells FROM nation UNION ALL SELECT n_nationkey, 1, 'Purpose|x' FROM nation",
    "land_group_index": "SELECT '010620' AS page_id, 'group-' || n_nationkey AS slug, n_name || ' & Co' AS group_name FROM nation".replace("group_name", '"group"'),
    "land_articles": f"""WITH {_ORDERS} SELECT key, url, title, domain, seendate FROM (
        SELECT 'P' || c AS key, 'https://news.test/' || k AS url, 'T' || k AS title, 'news.test' AS domain, day::VARCHAR AS seendate, row_number() OVER (PARTITION BY c ORDER BY 'https://news.test/' || k) AS place
        FROM o WHERE c % 5 <> 0 AND c % 7 <> 0) WHERE place <= 3""",
    "land_leaked": f"""WITH {_NAMES} SELECT 'n' || id AS node_id, upper(raw_name) AS name, CASE WHEN id % 4 = 0 THEN 'SAM' ELSE 'Samoa' END AS jurisdiction,
        CASE WHEN id % 7 = 0 THEN 'Malta Corporate Registry' ELSE 'Papers' END AS leak FROM companies WHERE id % 13 <> 0""",
    "largest_donations": f"""WITH {_ORDERS} SELECT 'R' || k AS "ECRef", CASE WHEN k % 9 <> 0 THEN '£' || format('{{:,}}', price) || '.50' END AS "Value" FROM o
        ORDER BY CASE WHEN k % 9 <> 0 THEN price END DESC NULLS LAST, 'R' || k LIMIT 25""",
    "crawl_companies": f"""WITH {_COMPANIES}, ap AS (SELECT DISTINCT p, number FROM off)
        SELECT '00000001' AS company_number, 0 AS hop
        UNION ALL (SELECT DISTINCT y.number, 1 FROM ap x JOIN ap y USING (p) WHERE x.number = '00000001' AND y.number <> '00000001' ORDER BY 1 LIMIT 4)""",
    "contract_targets": f"""WITH {_NAMES} SELECT 'C' || id AS entity_id, raw_name AS name, id::VARCHAR AS company_number,
            'supplier ' || lpad(id::VARCHAR, 9, '0') || CASE WHEN id % 7 = 4 THEN ' and' ELSE '' END AS search_key FROM companies WHERE id % 3 <> 0""",
    "offshore_leads": f"""WITH {_NAMES},
        own AS (SELECT id, {_base("raw_name")} AS base, {_class("raw_name")} AS form FROM companies),
        leak AS (SELECT id, upper(raw_name) AS name, {_base("upper(raw_name)")} AS base, {_class("upper(raw_name)")} AS form FROM companies WHERE id % 13 <> 0 AND id % 7 <> 0)
        SELECT md5('OFFSHORE|C' || own.id || '|n' || leak.id) AS lead_id, 'C' || own.id AS entity_id, 'n' || leak.id AS node_id, name, CASE WHEN leak.id % 4 = 0 THEN 'SAM' ELSE 'Samoa' END AS jurisdiction, 'Papers' AS leak
        FROM leak JOIN own USING (base, form) WHERE base LIKE '% %'""",
    "news_coverage": f"""WITH {_ORDERS},
        once AS (SELECT 'P' || c AS entity_id, 'https://news.test/' || k % 400 AS url, max((strftime(day, '%Y%m%dT%H%M%SZ'), 'T' || k)) AS a FROM o GROUP BY 1, 2)
        SELECT md5('COVERAGE|' || entity_id || '|' || url) AS coverage_id, entity_id, a[2] AS title, 'news.test' AS domain, url, a[1] AS seendate, strftime(strptime(a[1][1:8], '%Y%m%d'), '%Y-%m-%d') AS seen
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY a[1] DESC, url) AS place FROM once) WHERE place <= 3""",
    "news_names": _graph(
        """SELECT entity_id, priority, name FROM (SELECT entity_id, min(p) AS priority FROM parts_of GROUP BY 1) JOIN ents USING (entity_id)
            WHERE len(regexp_split_to_array(trim(name), '\\s+')) >= 2 AND length(name) >= 8 ORDER BY priority, name, entity_id LIMIT 120""",
        _found("CROSSING") + """,
        pf AS (SELECT subject_id AS entity_id, count(*) AS n FROM stm JOIN mps ON mps.entity_id = subject_id WHERE statement_type IN ('DIRECTOR_OF', 'OWNS', 'ADVISER_TO') GROUP BY 1),
        donors AS (SELECT subject_id AS donor_id FROM stm JOIN ents e ON e.entity_id = subject_id AND e.entity_type = 'person' WHERE statement_type = 'DONATED_TO' GROUP BY 1 HAVING sum(amount_gbp) >= 250000),
        parts_of AS (
            SELECT unnest(member_ids) AS entity_id, 3 AS p FROM found
            UNION ALL SELECT entity_id, 2 FROM (SELECT entity_id, rank() OVER (ORDER BY n DESC) AS r FROM pf) WHERE r <= 10
            UNION ALL SELECT d.donor_id, 1 FROM donors d JOIN pkeys k ON k.entity_id = d.donor_id AND k.name_key <> '' JOIN pkeys l ON l.name_key = k.name_key AND l.entity_id <> d.donor_id
                JOIN ents o ON o.entity_id = l.entity_id AND o.jurisdiction <> 'GB')""",
    ),
    "declared_companies": f"""WITH {_INTERESTS},
        named AS (SELECT org, other, hint, mid FROM pairs),
        shown AS (SELECT org, min(hint) AS hint, any_value(other) AS name FROM named GROUP BY org)
        SELECT name, count(DISTINCT mid) AS n_declarers FROM shown JOIN named USING (org) WHERE shown.hint = 'company' GROUP BY name""",
    "bridge_companies": f"""WITH
        want AS (SELECT DISTINCT CASE WHEN s_suppkey % 6 = 0 THEN 'The Company' ELSE s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Ltd' ELSE '' END END AS name FROM supplier),
        reg AS (
            SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS number, s_name || ' Limited' AS cname FROM supplier UNION ALL SELECT 'X' || s_suppkey, s_name || ' PLC' FROM supplier WHERE s_suppkey % 10 = 0),
        w AS (SELECT name, {_base("name")} AS base, {_class("name")} AS form FROM want),
        r AS (SELECT number, {_base("cname")} AS base, {_class("cname")} AS form FROM reg WHERE number NOT LIKE '%5'),
        hits AS (SELECT name, count(DISTINCT number) AS n, min(number) AS found FROM w JOIN r ON w.base = r.base AND w.base <> '' AND (w.form = r.form OR w.form = 'none' OR r.form = 'none') GROUP BY name)
        SELECT name, CASE WHEN n = 1 THEN found END AS company_number, CASE WHEN base = '' THEN 'empty key' WHEN n IS NULL THEN 'no match' WHEN n > 1 THEN 'ambiguous:' || n END AS reason
        FROM w LEFT JOIN hits USING (name)""",
    "not_ingested": f"WITH {_NAMES} SELECT lpad(id::VARCHAR, 8, '0') AS company_number FROM companies WHERE id % 3 <> 0",
    "donor_groups": f"""WITH {_DONATIONS},
        shown AS (SELECT coalesce(did, donor) AS who, arg_min(donor, (hint, donor)) AS raw, min(hint) AS hint FROM d GROUP BY 1),
        keyed AS (SELECT who, raw, {_sorted(_plain("raw"))} AS name_key FROM shown WHERE hint = 'person'),
        per AS (SELECT name_key, sum(value) AS total, arg_max(raw, (length(raw), raw)) AS name FROM keyed JOIN (SELECT coalesce(did, donor) AS who, value FROM d) USING (who) GROUP BY name_key)
        SELECT name_key, total::DECIMAL(28,2) AS total, name FROM per WHERE total >= 500000 ORDER BY total DESC, name_key LIMIT 40""",
    "write_by_source": f"WITH {_NUMBERS} SELECT source_code, k, CASE WHEN source_code = 'F' THEN 1 ELSE v END AS v FROM n WHERE source_code <> 'F' OR k % 3 = 0",
    "write_rebuild": f"WITH {_NUMBERS} SELECT * FROM n WHERE k % 5 = 0",
    "write_reset": f"WITH {_NUMBERS} SELECT source_code, k, 0 AS derived_left FROM n WHERE source_code <> 'P'",
    "write_insert_absent": f"WITH {_NUMBERS} SELECT source_code, k, CASE WHEN k % 4 = 0 THEN v ELSE -v END AS v FROM n WHERE k % 2 = 0",
    "write_update": f"WITH {_NUMBERS} SELECT source_code, k, CASE WHEN k % 14 = 0 THEN 0 WHEN k % 7 = 0 THEN NULL ELSE v END AS v FROM n",
    "write_delete": f"WITH {_NUMBERS} SELECT * FROM n WHERE v % 3 <> 0",
    "scan_optional": "SELECT r_regionkey::VARCHAR AS lead_id, r_name AS name FROM region",
    "theme_lexicon": f"""WITH lexicon(i, theme, word) AS (VALUES {_LEX}),
        texts AS (SELECT p_partkey, 'supplies ' || word || 's and ' || p_name AS txt FROM part JOIN lexicon ON i = p_partkey % {_N_WORDS})
        SELECT DISTINCT p_partkey, theme FROM texts JOIN lexicon ON contains(txt, word)""",
    "company_descriptions": f"""WITH {_INTERESTS},
        shown AS (SELECT lower(other) AS entity_id, arg_min(about, (hint, other)) AS about FROM pairs GROUP BY 1)
        SELECT entity_id, about AS description FROM shown WHERE about <> ''""",
}
_APPOINTED = SQL["donor_groups"].removeprefix("WITH ")
SQL["donor_appointments"] = f"""WITH {_COMPANIES},
        top AS (WITH {_APPOINTED}),
        act AS (SELECT DISTINCT '/officers/' || p AS officer, {_sorted(_plain("p_name"))} AS name_key, number AS company_number FROM off WHERE status = 'active' AND flag <> 'R')
        SELECT name_key, officer, company_number FROM (SELECT *, row_number() OVER (PARTITION BY officer ORDER BY company_number) AS place FROM act WHERE name_key IN (SELECT name_key FROM top)) WHERE place <= 3"""
