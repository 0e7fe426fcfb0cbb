"""DuckDB SQL of the queries that SQL can express: the same results by plain means, for small tables."""

from __future__ import annotations

import string

from . import mixing, secrets

_WORD = "[^\\x20\\x09-\\x0D]+"
_ASCII_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, where: str = "true") -> str:
    """(doc_id, kind, s, e, v): matches with their places in code points."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, m[i] AS v
      FROM (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_split_to_array(t, {p}) AS g FROM texts) WHERE len(m) > 0) WHERE {where}"""


def op1_secrets() -> str:
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    least = "CASE " + " ".join(f"WHEN regexp_matches(v, {_quoted(p)}) THEN {bits}::DOUBLE" for p, bits in secrets.THRESHOLDS.items()) + " END"
    allowed = " OR ".join(f"regexp_matches(v, {_quoted(p)})" for p in secrets.ALLOWED)
    w = secrets.WINDOW
    text = "string_agg(label || ':' || s || ':' || (s + n), ',' ORDER BY s, kind)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({_found(0, secrets.ASSIGN, f"length(regexp_extract(m[i], {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}")} UNION ALL {_found(1, secrets.ACCESS)} UNION ALL {_found(2, secrets.HEX)}),
    cands AS (SELECT c.*, row_number() OVER () AS id FROM ({_found(3, secrets.CANDIDATE)}) c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.n AND b.s + b.n > c.s) AND NOT ({allowed})),
    windows AS (SELECT id, j, unnest(string_split(substr(v, j, {w}), '')) AS ch FROM (SELECT id, v, unnest(generate_series(1, length(v) - {w - 1})) AS j FROM cands)),
    counts AS (SELECT id, j, ch, count(*) / {float(w)}::DOUBLE AS p FROM windows GROUP BY id, j, ch),
    entropy AS (SELECT id, max(h) AS h FROM (SELECT id, j, -sum(p * log2(p)) AS h FROM counts GROUP BY id, j) GROUP BY id),
    every AS (SELECT doc_id, kind, s, n FROM base UNION ALL SELECT doc_id, kind, s, n FROM cands JOIN entropy USING (id) WHERE h >= {least}),
    named AS (SELECT *, {kinds}[kind + 1] AS label FROM every),
    per AS (SELECT doc_id, {text} AS spans, {text.replace('s, kind)', 's, kind) FILTER (kind < 3)')} AS base, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.KINDS))} FROM named GROUP BY doc_id)
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN per USING (doc_id)"""


def op2_mixing(weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = mixing.SEED) -> str:
    turn = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in weights) + "]"
    return f"""WITH r AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key, md5(concat_ws(':', '{seed}', doc_id)) AS h, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
    s AS (SELECT key, sum(size)::BIGINT AS source_size, {turn}[(row_number() OVER (ORDER BY key) - 1) % {len(weights)} + 1] AS w FROM r GROUP BY key),
    c AS (SELECT *, source_size * {most}::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * {most}::DOUBLE / w, key) AS i FROM s),
    l AS (SELECT i, cap / w AS ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER after) AS level FROM c
      WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    t AS (SELECT key, source_size, least(cap, w * (SELECT level FROM l WHERE level <= ratio ORDER BY i LIMIT 1)) AS target FROM c),
    b AS (SELECT *, floor(target + 0.5::DOUBLE)::BIGINT AS budget FROM t),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
    p AS (SELECT r.*, source_size, target, epochs, budget - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN e USING (key))
    SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, epochs::BIGINT AS epochs FROM p"""


def _components(nodes: str, links: str) -> str:
    """CTEs `links` (a, b, both ways) and `roots` (node, component_id)."""
    return f"""links AS ({links}), reach(node, other) AS (SELECT node, node FROM ({nodes}) UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
    roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""


def op9_minhash(words: int = 3, percent: int = 85) -> str:
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    shingles = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - {words - 1}), lambda i: {run})) END"
    links = f"SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN sets m ON m.doc_id = x.doc_id JOIN sets n ON n.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING count(*) * 100 >= {percent} * (m.n + n.n - count(*))"
    return f"""WITH RECURSIVE sets AS (SELECT doc_id, s, len(s) AS n FROM (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{_WORD}') AS w FROM documents))),
    each AS (SELECT doc_id, unnest(s) AS s FROM sets), {_components('SELECT doc_id AS node FROM documents', links)}
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots ON node = doc_id"""


def op10_embedding_dedup(cosine: float = 0.93) -> str:
    links = f"SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {cosine}"
    return f"""WITH RECURSIVE fit AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    {_components('SELECT vec_id AS node FROM embeddings', links)}, n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN roots ON node = vec_id LEFT JOIN n ON n.a = vec_id"""


ORACLE_SQL = {f.__name__: f() for f in (op1_secrets, op2_mixing, op9_minhash, op10_embedding_dedup)}
