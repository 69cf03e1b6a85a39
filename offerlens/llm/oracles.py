"""The numbered queries that DuckDB can work out too, over the same tables."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, WORD, needed, words_in

FILL_MIDDLE = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS hex FROM documents
), numbered AS (
    SELECT doc_id, text, lines, len(lines) AS n,
           [('0x' || substr(hex, 1, 8))::BIGINT, ('0x' || substr(hex, 9, 8))::BIGINT, ('0x' || substr(hex, 17, 8))::BIGINT, ('0x' || substr(hex, 25, 8))::BIGINT] AS h
    FROM hashed
), cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS one, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS two,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), parted AS (
    SELECT *, array_to_string(lines[1:one], '') AS p, array_to_string(lines[one + 1:two], '') AS m, array_to_string(lines[two + 1:], '') AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""


def clustering(clusters: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> str:
    """Every vector against every centroid, in rounds written out one after another."""
    kept = f"len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    nearest = """
    SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d
    FROM (SELECT vec_id, k, list_sum(list_transform(range(1, {width} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v, c{n})
    GROUP BY vec_id"""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {clusters})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(width=width, n=n)})")
        means = f"SELECT k, i, sum(x[i]) AS s, count(*) AS m FROM v JOIN a{n} USING (vec_id), range(1, {width} + 1) AS r(i) GROUP BY k, i"
        exact = f"SELECT k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM ({means}) GROUP BY k"
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(z.c, c{n}.c) AS c FROM c{n} LEFT JOIN ({exact}) AS z USING (k))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


def license_scan(threshold: float = 0.8) -> str:
    """Every block of every text against every template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = [f"list_filter(range(n_words), lambda i: words[i + 1:i + {len(words_in(p))}] = {listed(words_in(p))})" for p, _ in PHRASES]
    # Texts without the phrase's last word have no place of it.
    places = [f"CASE WHEN contains(text, '{words_in(p)[-1]}') THEN {at} ELSE [] END" for at, (p, _) in zip(places, PHRASES)]
    named = [f"CASE WHEN len({at}) > 0 THEN '{label}' END" for at, (_, label) in zip(places, PHRASES)]
    templates = ", ".join(f"('{t.label}', {len(t.words)}, {len(set(t.words))}, {needed(t, threshold)}, {listed(sorted(set(t.words)))})" for t in TEMPLATES)
    return f"""
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS key FROM documents
), cut AS MATERIALIZED (
    SELECT key, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM lowered
), counted AS (
    SELECT *, len(words) AS n_words FROM cut
), templates(label, m, size, least, theirs) AS (
    VALUES {templates}
), met AS (
    SELECT key, label, len(list_intersect(list_distinct(words[b * m + 1:(b + 2) * m]), theirs)) AS shared, size, least
    FROM (SELECT key, label, words, m, size, least, theirs, unnest(range((n_words - 1) // m + 1)) AS b FROM counted, templates WHERE n_words > 0)
), best AS (
    SELECT key, list(DISTINCT label) AS more, max(shared / size) AS share FROM met WHERE shared >= least GROUP BY key
), placed AS (
    SELECT key, doc_id, n_words, list_concat({", ".join(places)}) AS spots, list_filter([{", ".join(named)}], lambda x: x IS NOT NULL) AS named FROM counted
)
SELECT doc_id, n_words::BIGINT AS n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(named)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(named, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM placed LEFT JOIN best USING (key)"""
