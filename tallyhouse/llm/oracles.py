"""DuckDB SQL with the rows of those registered queries that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS MATERIALIZED (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id <> y.vec_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
        reached AS (SELECT vec_id AS a, vec_id AS b FROM v
                    UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a""",
    "op6_exact_dedup": f"""
        WITH normal AS (SELECT doc_id, {LOWERED} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY t)""",
    "op7_minhash_dedup": f"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM shingles AS x JOIN shingles AS y USING (s)
                   WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b
            WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
                    UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents AS d JOIN least ON d.doc_id = least.a LEFT JOIN sizes ON d.doc_id = sizes.doc_id""",
    "op8_warc": """
        WITH payload AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        known AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
                         min(page_id) OVER (PARTITION BY html) AS first FROM payload)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM known""",
}
