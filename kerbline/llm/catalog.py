"""The operators' queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import ann, chat, divergence, exact, fingerprint, lines, mixing, neardup, packing, resample, secrets, toxicity, urls

#: The tokenizer of the packing query; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), z=5.0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


_ALL = (
    op1_nearest_vectors,
    op2_document_fingerprints,
    op3_best_fit_packing,
    op4_mix_sources,
    op5_line_dedup,
    op6_secret_scan,
    op7_url_filter,
    op8_toxicity,
    op9_chat_rotation,
    op10_near_dedup,
    op11_exact_dedup,
    op12_importance_resampling,
    op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op4_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS seat
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows,
                   row_number() OVER (ORDER BY source IS NULL, source) AS place
            FROM d GROUP BY source),
        w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS all_words FROM s),
        c AS (
            SELECT *, all_words - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
            FROM w WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, max(CASE WHEN weight * rest <= 3 * source_size * open THEN open END) OVER () AS share_open FROM c),
        g AS (SELECT *, max(CASE WHEN open = share_open THEN rest END) OVER () AS share_rest FROM f),
        t AS (
            SELECT source, place, source_size, n_rows, all_words,
                   CASE WHEN share_open IS NULL OR open > share_open THEN CAST(3 * source_size AS DOUBLE)
                        ELSE CAST(weight * share_rest AS DOUBLE) / CAST(share_open AS DOUBLE) END AS target,
                   CAST(floor(all_words / 8 + 0.5) AS BIGINT) AS seats
            FROM g),
        q AS (SELECT t.*, target / sum(target) OVER () * seats AS quota, count(*) OVER () AS n FROM t),
        e AS (SELECT *, CAST(greatest(floor(quota) - n - 1, 0) AS BIGINT) AS sure FROM q),
        k AS (SELECT place, target, unnest(generate_series(sure + 1, CAST(ceil(quota) AS BIGINT) + n + 1)) AS k FROM e),
        r AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place, k) AS nth, target FROM k),
        won AS (
            SELECT place, count(*) FILTER (WHERE target > 0 AND nth <= (SELECT max(seats) - sum(sure) FROM e)) AS got FROM r GROUP BY place),
        b AS (
            SELECT e.source, e.place, e.source_size, e.target, e.sure + won.got AS blocks,
                   greatest(CAST(ceil((source_size + 20 * n_rows) / 1000000) AS BIGINT), 1) AS shards
            FROM e JOIN won USING (place)),
        x AS (
            SELECT d.*, b.place, b.source_size, b.target, b.blocks, CAST('0x' || substr(d.seat, 1, 8) AS BIGINT) % b.shards AS shard
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        y AS (SELECT place, shard, blocks, sum(size) AS cell FROM x GROUP BY ALL),
        yq AS (SELECT *, count(*) OVER p AS n, cell / sum(cell) OVER p * blocks AS quota FROM y WINDOW p AS (PARTITION BY place)),
        ye AS (SELECT *, CAST(greatest(floor(coalesce(quota, 0)) - n - 1, 0) AS BIGINT) AS sure FROM yq),
        yk AS (SELECT place, shard, cell, unnest(generate_series(sure + 1, CAST(ceil(coalesce(quota, 0)) AS BIGINT) + n + 1)) AS k FROM ye),
        yr AS (SELECT place, shard, cell, row_number() OVER (PARTITION BY place ORDER BY cell / (2 * k - 1) DESC, shard, k) AS nth FROM yk),
        ys AS (SELECT place, max(blocks) - sum(sure) AS free FROM ye GROUP BY place),
        yw AS (SELECT yr.place, shard, count(*) FILTER (WHERE cell > 0 AND nth <= free) AS got FROM yr JOIN ys USING (place) GROUP BY ALL),
        z AS (
            SELECT ye.place, ye.shard, ye.cell, least(8 * (ye.sure + yw.got), 3 * ye.cell) AS amount
            FROM ye JOIN yw ON ye.place = yw.place AND ye.shard = yw.shard),
        o AS (
            SELECT x.doc_id, x.size, x.source_size, x.target, z.cell, z.amount,
                   coalesce(sum(x.size) OVER (PARTITION BY x.place, x.shard ORDER BY x.seat, x.doc_id, x.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM x JOIN z ON x.place = z.place AND x.shard = z.shard)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN cell > 0 THEN (amount // cell) * size + least(greatest(amount % cell - before, 0), size) ELSE 0 END AS BIGINT) AS taken
        FROM o""",
    "op5_line_dedup": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
        h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_chat_rotation": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text,
                   CAST(coalesce(floor(turn / 64), 0) AS BIGINT) AS part
            FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
        r AS (
            SELECT t.*, p.participant, t.role = p.participant AS own, t.text || '<|end|>' AS body,
                   CASE WHEN t.role = p.participant THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
                        ELSE '<|user:' || replace(t.role, '<|', '<\|') || '|>' END AS head
            FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        u AS (
            SELECT *, row_number() OVER o AS n, CAST(sum(length(head) + length(body)) OVER o AS BIGINT) AS upto
            FROM r WINDOW o AS (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, participant, part, count(*) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_masked,
               string_agg(head || body, '' ORDER BY n) AS rendered,
               coalesce(string_agg((upto - length(body)) || ':' || upto, ',' ORDER BY n) FILTER (WHERE own), '') AS mask
        FROM u GROUP BY conv_id, participant, part""",
    "op10_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS item
            FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 2, least(len(words), 1)))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
        k AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
        e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
        SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
    "op11_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY body)""",
    "op13_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        l AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT w.lang, source, term, count(*)::HUGEINT AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.terms) AS p,
                   1 + (1000000000 * (l.n + 5)) // (v.total + 5 * v.terms) AS q
            FROM g JOIN l ON l.lang = g.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM r)
        SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM o WHERE part = 'pair' OR place <= 50""",
}
