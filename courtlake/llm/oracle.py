"""DuckDB statements of the operators that SQL can express, each by the plainest way."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

STATEMENTS = {
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w),
        g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS gram FROM p),
        f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram),
        c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g JOIN f USING (gram) WHERE first_id < doc_id),
        a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
        r AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
        t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM a ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op5_embedding_near_dedup": """
        WITH RECURSIVE u AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other),
        m AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
        SELECT m.vec_id, count(e.b) AS n_links, any_value(component_id) AS component_id, m.vec_id = any_value(component_id) AS kept
        FROM m LEFT JOIN e ON e.a = m.vec_id GROUP BY m.vec_id
    """,
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        s AS (SELECT *, role || chr(10) || text || chr(10) AS said, length(role || text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + 23 AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id
    """,
    "op9_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        c AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
        r AS (SELECT doc_id, doc_id AS other FROM c UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM r JOIN c USING (doc_id) GROUP BY doc_id
    """,
}
