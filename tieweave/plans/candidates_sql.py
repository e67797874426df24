"""DuckDB SQL for the queries of ``candidates``, with constants of its own."""

from __future__ import annotations

# Fixed values, written out here as well: parts of names.
_SURNAMES = "['ba','ker','tin','mor','phil','son','gar','ley','wood','ches','ter','ham','vic','stone','quin','dale']"
_BEGINNINGS = "['an','jo','mar','el','ste','da','ro','li','vi','phi','ca','ge','wi','ha','su','ed']"
_ENDINGS = "['na','hn','ry','la','ven','vid','bert','sa','ctor','lip','rol','orge','liam','rold','san','win']"


def _part(parts: str, place: int) -> str:
    return f"{parts}[('0x' || substr(md5(c_custkey::VARCHAR), {place}, 1))::INT + 1]"


def _sound() -> str:
    # Fixed values, written out here as well: spellings of one sound in order.
    rules = [
        ("^[kgp]n", "n"), ("^wr", "r"), ("^x", "s"), ("^wh", "w"), ("mb$", "m"), ("ght", "t"), ("gh", "g"), ("ph", "f"), ("s?ch|tch|sh", "x"), ("dg([eiy])", r"j\1"),
        ("g([eiy])", r"j\1"), ("c([eiy])", r"s\1"), ("[cq]", "k"), ("[dt]h?", "t"), ("v", "f"), ("z", "s"), ("g", "k"), ("b", "p"),
    ]
    found = "surname"
    for pattern, by in rules + [(f"{c}+", c) for c in "fjklmnprstx"]:
        found = f"regexp_replace({found}, '{pattern}', '{by}', 'g')"
    return found


_NAMES = f"""
WITH parts AS (
        SELECT c_custkey AS k, {_part(_SURNAMES, 1)} || {_part(_SURNAMES, 2)} || {_part(_SURNAMES, 3)} AS s, {_part(_BEGINNINGS, 4)} || {_part(_ENDINGS, 5)} AS f FROM customer),
    placed AS (SELECT *, (2 + k % (length(s) - 2))::INT AS p FROM parts),
    told AS (
        SELECT 'a:' || k AS mention_id, k, s AS surname, f AS forenames, (1940 + k % 50)::VARCHAR AS birth_year FROM placed
        UNION ALL
        SELECT 'b:' || k, k, CASE k % 4 WHEN 0 THEN left(s, p - 1) || substr(s, p + 1) WHEN 1 THEN left(s, p) || substr(s, p) WHEN 2 THEN translate(replace(s, 'ph', 'f'), 'kvy', 'cfi')
                ELSE left(s, p - 1) || substr(s, p + 1, 1) || substr(s, p, 1) || substr(s, p + 2) END,
            f, CASE WHEN k % 2 = 0 THEN (1940 + k % 50)::VARCHAR END
        FROM placed WHERE k % 3 = 0),
    member AS (SELECT *, md5(concat_ws('|', surname, forenames, coalesce(birth_year, ''))) AS form_id FROM told),
    sounded AS (SELECT DISTINCT form_id, surname, forenames, birth_year, {_sound()} AS heard, forenames || ' ' || surname AS whole FROM member),
    form AS (
        SELECT * EXCLUDE (heard), regexp_replace(left(heard, 1), '[aeiouy]', 'a') || regexp_replace(substr(heard, 2), '[aeiouyhw]', '', 'g') AS heard FROM sounded),
    keyed AS (
        SELECT form_id, 0 AS kind, heard || '|' || birth_year AS key FROM form WHERE birth_year IS NOT NULL
        UNION ALL SELECT form_id, 1, heard || '|' || left(forenames, 1) FROM form
        UNION SELECT form_id, 2, unnest(list_transform(range(1, length(whole) + 2), lambda i: left(whole, (i - 1)::INT) || substr(whole, (i + 1)::INT))) FROM form),
    met AS (
        SELECT a, b, array_to_string(list_transform(list_sort(list(DISTINCT kind)), lambda x: ['year', 'initial', 'edit'][x + 1]), ',') AS met_by
        FROM (SELECT DISTINCT x.form_id AS a, y.form_id AS b, kind FROM keyed x JOIN keyed y USING (kind, key) WHERE x.form_id < y.form_id) GROUP BY a, b)"""

_VECTORS = """
WITH wide AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + 0.0::DOUBLE) AS raw FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    usable AS (SELECT * FROM wide WHERE len(raw) = (SELECT len(raw) FROM wide GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
    class AS (SELECT vec_id AS row_id, min(vec_id) OVER (PARTITION BY raw) AS class_id, raw FROM usable),
    unit AS (SELECT class_id, raw, sqrt(list_dot_product(raw, raw)) AS norm FROM class WHERE row_id = class_id)"""

SQL: dict[str, str] = {
    "block_name_members": _NAMES + "SELECT mention_id, form_id FROM member",
    "block_name_pairs": _NAMES + """
        SELECT a, b, x.surname AS surname_a, x.forenames AS forenames_a, y.surname AS surname_b, y.forenames AS forenames_b, met_by,
            round(jaro_winkler_similarity(x.surname, y.surname), 6) AS surname_similarity, round(jaro_winkler_similarity(x.forenames, y.forenames), 6) AS forename_similarity
        FROM met JOIN form x ON x.form_id = a JOIN form y ON y.form_id = b
        WHERE coalesce(x.birth_year = y.birth_year, true) AND round(jaro_winkler_similarity(x.surname, y.surname), 6) >= 0.85
            AND round(jaro_winkler_similarity(x.forenames, y.forenames), 6) >= 0.8""",
    "block_name_recall": _NAMES + """,
    truth AS (
        SELECT least(x.form_id, y.form_id) AS a, greatest(x.form_id, y.form_id) AS b
        FROM member x JOIN member y ON x.k = y.k AND x.mention_id LIKE 'a:%' AND y.mention_id LIKE 'b:%' AND x.form_id <> y.form_id),
    told_kinds AS (SELECT unnest(['year', 'initial', 'edit', 'any']) AS kind)
        SELECT kind, count(*) AS n_true, count(*) FILTER (met_by IS NOT NULL AND (kind = 'any' OR list_contains(string_split(met_by, ','), kind))) AS n_found,
            round(count(*) FILTER (met_by IS NOT NULL AND (kind = 'any' OR list_contains(string_split(met_by, ','), kind))) / count(*), 6) AS recall
        FROM truth CROSS JOIN told_kinds LEFT JOIN met USING (a, b) GROUP BY kind""",
    "block_vector_classes": _VECTORS + "SELECT row_id, class_id FROM class",
    "block_vector_exact": _VECTORS + """
        SELECT query_id, neighbour_id, similarity, place FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id)::INT AS place FROM (
                SELECT q.class_id AS query_id, u.class_id AS neighbour_id, round(list_dot_product(q.raw, u.raw) / q.norm / u.norm, 9) AS similarity
                FROM unit q JOIN unit u ON q.class_id <> u.class_id WHERE q.class_id IN (SELECT class_id FROM class WHERE row_id % 20 = 0)))
        WHERE place <= 10""",
}
