"""The registered queries over the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, langid, mixing, periodic, quality, urls, whitening
from .bpe import encode_decode
from .common import scratch_path, table
from .line_dedup import line_report
from .packing import pack_powers_of_two
from .simhash import near_duplicates
from .token_files import read_token_files, with_crc32, write_token_files


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_powers_of_two(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return with_crc32(read_token_files(spark, path), keep=["doc_id", "start", "n_tokens"])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.predict(documents, langid.fit(documents))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.segments(table(spark, sf_dir, "conversations"))
    return rendered.select("conv_id", "position", "n_turns", "copies", "role", F.sha2("segment", 256).alias("segment_sha256"), "trained")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


URL_RULES = [
    urls.Rule("net/", "block"),
    urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"),
    urls.Rule("org/fr/", "allow"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("longest", periodic.longest())
    start, length, period = F.col("longest.start"), -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(periodic.runs_text(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    "op5_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS position,
                coalesce(role, '') AS role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment
            FROM conversations),
        prefixes AS (
            SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n_turns, role, segment,
                sha256(string_agg(sha256(segment), '') OVER (PARTITION BY conv_id ORDER BY position)) AS prefix
            FROM turns),
        whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE position = n_turns GROUP BY prefix),
        kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE position < n_turns))
        SELECT conv_id, position, n_turns, copies, role, sha256(segment) AS segment_sha256, role = 'assistant' AS trained
        FROM prefixes JOIN kept USING (conv_id)
    """,
    "op9_url_filters": """
        WITH whole AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parsed AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM whole),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
                list_filter(string_split(path, '/'), lambda x: x <> '') AS seg
            FROM parsed),
        cut AS (
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v,
                seg[1] AS s1, seg[2] AS s2, CASE WHEN len(seg) > 3 THEN '**' ELSE seg[3] END AS s3
            FROM ruled),
        counts AS (
            SELECT host, s1, s2, s3, count(*) AS n, count(*) FILTER (v = 'block') AS bad, count(*) FILTER (v = 'allow') AS good FROM cut GROUP BY ALL),
        kinds1 AS (SELECT host, s1, sum(n) AS own FROM counts WHERE s1 IS NOT NULL GROUP BY ALL),
        named1 AS (
            SELECT *, CASE WHEN count(*) OVER w >= 8 AND 10 * own <= sum(own) OVER w OR count(*) OVER w >= 2 AND regexp_matches(s1, '[0-9]') THEN '*' ELSE s1 END AS t1
            FROM kinds1 WINDOW w AS (PARTITION BY host)),
        level1 AS (
            SELECT l.*, r.t1 FROM counts l LEFT JOIN named1 r ON l.host = r.host AND l.s1 = r.s1),
        kinds2 AS (SELECT host, t1, s2, sum(n) AS own FROM level1 WHERE s2 IS NOT NULL GROUP BY ALL),
        named2 AS (
            SELECT *, CASE WHEN count(*) OVER w >= 8 AND 10 * own <= sum(own) OVER w OR count(*) OVER w >= 2 AND regexp_matches(s2, '[0-9]') THEN '*' ELSE s2 END AS t2
            FROM kinds2 WINDOW w AS (PARTITION BY host, t1)),
        level2 AS (
            SELECT l.*, r.t2 FROM level1 l LEFT JOIN named2 r ON l.host = r.host AND l.s2 = r.s2 AND l.t1 IS NOT DISTINCT FROM r.t1),
        kinds3 AS (SELECT host, t1, t2, s3, sum(n) AS own FROM level2 WHERE s3 IS NOT NULL GROUP BY ALL),
        named3 AS (
            SELECT *, CASE WHEN count(*) OVER w >= 8 AND 10 * own <= sum(own) OVER w OR count(*) OVER w >= 2 AND regexp_matches(s3, '[0-9]') THEN '*' ELSE s3 END AS t3
            FROM kinds3 WINDOW w AS (PARTITION BY host, t1, t2)),
        level3 AS (
            SELECT l.*, r.t3 FROM level2 l LEFT JOIN named3 r ON l.host = r.host AND l.s3 = r.s3 AND l.t1 IS NOT DISTINCT FROM r.t1 AND l.t2 IS NOT DISTINCT FROM r.t2),
        ways2 AS (SELECT host, t1, t2, coalesce(t3, '') AS below, sum(n) AS n FROM level3 WHERE t2 IS NOT NULL GROUP BY ALL),
        pooled2 AS (
            SELECT *, n / sum(n) OVER (PARTITION BY host, t1, t2) - sum(n) OVER (PARTITION BY host, t1, below) / sum(n) OVER (PARTITION BY host, t1) AS more,
                dense_rank() OVER (PARTITION BY host, t1 ORDER BY t2) AS place
            FROM ways2),
        node2 AS (SELECT *, max(place) OVER (PARTITION BY host, t1) AS branches FROM pooled2),
        alike2 AS (
            SELECT host, t1, t2 FROM node2 GROUP BY host, t1, t2
            HAVING round(sum(greatest(more, 0)), 9) <= round(0.1 + 1 / sqrt(sum(n)), 9) AND max(branches) > 1
                AND 2 * sum(CASE WHEN below <> '' THEN n ELSE 0 END) >= sum(n)),
        merged2 AS (
            SELECT l.* REPLACE (CASE WHEN r.host IS NULL THEN l.t2 ELSE '{}' END AS t2)
            FROM level3 l LEFT JOIN alike2 r ON l.host = r.host AND l.t1 = r.t1 AND l.t2 = r.t2),
        ways1 AS (SELECT host,  t1, concat_ws('/', t2, t3) AS below, sum(n) AS n FROM merged2 WHERE t1 IS NOT NULL GROUP BY ALL),
        pooled1 AS (
            SELECT *, n / sum(n) OVER (PARTITION BY host,  t1) - sum(n) OVER (PARTITION BY host,  below) / sum(n) OVER (PARTITION BY host) AS more,
                dense_rank() OVER (PARTITION BY host ORDER BY t1) AS place
            FROM ways1),
        node1 AS (SELECT *, max(place) OVER (PARTITION BY host) AS branches FROM pooled1),
        alike1 AS (
            SELECT host,  t1 FROM node1 GROUP BY host,  t1
            HAVING round(sum(greatest(more, 0)), 9) <= round(0.1 + 1 / sqrt(sum(n)), 9) AND max(branches) > 1
                AND 2 * sum(CASE WHEN below <> '' THEN n ELSE 0 END) >= sum(n)),
        merged1 AS (
            SELECT l.* REPLACE (CASE WHEN r.host IS NULL THEN l.t1 ELSE '{}' END AS t1)
            FROM merged2 l LEFT JOIN alike1 r ON l.host = r.host AND l.t1 = r.t1),
        totals AS (
            SELECT host, s1, s2, s3, concat_ws('/', '', t1, t2, t3) AS template, sum(bad) OVER w AS n_bad, sum(good) OVER w AS n_good,
                sum(n - bad - good) OVER w AS n_unlabelled
            FROM merged1 WINDOW w AS (PARTITION BY host, concat_ws('/', '', t1, t2, t3)))
        SELECT page_id, cut.host, path, rule, template, n_bad::BIGINT AS n_bad, n_good::BIGINT AS n_good, n_unlabelled::BIGINT AS n_unlabelled,
            coalesce(v, CASE WHEN 4 * n_bad > 4 * (n_good + 2) + n_unlabelled THEN 'block' ELSE 'allow' END) AS verdict
        FROM cut JOIN totals t ON cut.host = t.host AND cut.s1 IS NOT DISTINCT FROM t.s1
            AND cut.s2 IS NOT DISTINCT FROM t.s2 AND cut.s3 IS NOT DISTINCT FROM t.s3
    """,
    "op10_quality_rules": r"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        judged AS (
            SELECT doc_id, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own,
                length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
                length(regexp_replace(line, '[^|<>]', '', 'g')) AS separators
            FROM lines),
        placed AS (
            SELECT own, n, coalesce(lag(own) OVER w, '') AS earlier, coalesce(lead(own) OVER w, '') AS later
            FROM judged WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
        boilerplate AS (
            SELECT own FROM placed WHERE n <= 40 GROUP BY own
            HAVING count(*) >= 10 AND 4 * greatest(count(DISTINCT earlier), count(DISTINCT later)) >= 3 * count(*)),
        losses AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                sum(n) FILTER (
                    symbols > 0 AND (5 * separators >= n OR 5 * symbols > n)
                    OR n >= 3 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}')
                    OR own IN (SELECT own FROM boilerplate)
                    OR n < 12 AND NOT regexp_matches(line, '[.!?…:;。！？।؟]["''”’»)\]]*[\x20\x09-\x0D]*$')) AS lost
            FROM judged WHERE n > 0 GROUP BY doc_id),
        words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
            FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words),
        windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM places),
        repeats AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows),
        covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM repeats WHERE c > 1),
        repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
        counts AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
            FROM words LEFT JOIN losses USING (doc_id) LEFT JOIN repeated USING (doc_id)),
        base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
            n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
            NOT base_failed AND lost <= 0.3 * n_words AS kept
        FROM base
    """,
    "op6_line_dedup": """
        WITH numbered AS (
            SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS raw
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        lines AS (
            SELECT doc_id, line, w, len(w) AS n, array_to_string(w, ' ') AS own
            FROM (SELECT doc_id, line, regexp_extract_all(
                translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM numbered)
            WHERE len(w) > 0),
        different AS (SELECT own, any_value(w) AS w, any_value(n) AS n, min((doc_id, line)) AS place FROM lines GROUP BY own),
        places AS (SELECT own, w, place, unnest(range(1, n + 1)) AS i FROM different WHERE n >= 8),
        rests AS (SELECT own, place, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS rest FROM places),
        replaced AS (SELECT own, place > min(place) OVER (PARTITION BY i, rest) AS late FROM rests),
        near AS (
            SELECT own FROM replaced WHERE late
            UNION SELECT r.own FROM rests r JOIN different d ON d.own = r.rest AND d.n >= 8 WHERE d.place < r.place
            UNION SELECT d.own FROM rests r JOIN different d ON d.own = r.rest AND d.n >= 8 WHERE r.place < d.place),
        gone AS (
            SELECT DISTINCT l.doc_id, l.line FROM lines l JOIN different d USING (own)
            WHERE d.place <> (l.doc_id, l.line) OR l.own IN (SELECT own FROM near)),
        dropped AS (SELECT doc_id, count(*) AS n_dropped, string_agg(line::VARCHAR, ',' ORDER BY line) AS dropped FROM gone GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped
        FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN dropped USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM texts JOIN groups USING (text_sha256)
    """,
    "op13_source_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS size, md5(doc_id::VARCHAR) AS tie FROM documents),
        sources AS (
            SELECT source, sum(size)::HUGEINT AS words, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight FROM docs GROUP BY source),
        ordered AS (
            SELECT *, (sum(words) OVER ())::HUGEINT - 3 * coalesce(sum(words) OVER before, 0)::HUGEINT AS words_left,
                (sum(weight) OVER ())::HUGEINT - coalesce(sum(weight) OVER before, 0)::HUGEINT AS weight_left
            FROM sources WINDOW before AS (ORDER BY 6 * words // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        share AS (
            SELECT arg_max(words_left, weight_left) AS words_left, max(weight_left) AS weight_left
            FROM ordered WHERE words_left * weight <= 3 * words * weight_left),
        goals AS (
            SELECT o.source, o.words, CASE WHEN stops THEN 3 * o.words ELSE s.words_left * o.weight END AS over_, CASE WHEN stops THEN 1 ELSE s.weight_left END AS under_
            FROM (SELECT *, words_left * weight > 3 * words * weight_left AS stops FROM ordered) o CROSS JOIN share s),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, tie NULLS LAST, doc_id NULLS LAST) - 1 AS place,
                ('0x' || substr(md5('42|' || coalesce('=' || source, '')), 1, 5))::BIGINT AS draw
            FROM docs),
        drawn AS (
            SELECT doc_id, size, words, over_, under_,
                CASE WHEN words > 0 THEN (under_ * words * draw + (place + 1) * over_ * 1048576) // (under_ * words * 1048576)
                    - (under_ * words * draw + place * over_ * 1048576) // (under_ * words * 1048576) ELSE 0 END AS copies
            FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, CASE WHEN words > 0 THEN over_::DOUBLE / under_::DOUBLE ELSE 0 END AS target, (size * copies)::BIGINT AS taken
        FROM drawn
    """,
}


def oracle_sql() -> dict[str, str]:
    return SQL
