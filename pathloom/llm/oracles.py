"""DuckDB SQL for the operators that SQL can express on whole small tables."""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="text")} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS u(s)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM later, unnest(range(0, 20)) AS v(j)),
word AS (SELECT doc_id, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_REACH = """reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM w, unnest(range(1, len(ws))) AS u(i) UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_REACH},
k AS (SELECT a AS doc_id, least(a, min(b)) AS k FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, d.doc_id) AS component_id, coalesce(k, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH},
k AS (SELECT a AS vec_id, least(a, min(b)) AS k FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(k, v.vec_id) AS component_id, coalesce(k, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN k USING (vec_id)"""

SESSIONS = """
WITH RECURSIVE d AS (SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) AS a, kind, value, row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts, client_id) AS k FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT client_id, us, click_id, coalesce(a - us > 900000000, false) AS late, coalesce(kind IN ('purchase', 'signup') AND value >= 60, false) AS final, CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents FROM d WHERE k = 1),
t AS (SELECT *, lag(us) OVER w AS pus, lag(final) OVER w AS pfinal, row_number() OVER w AS rn FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
h AS (SELECT *, pus IS NULL OR pfinal OR us - pus >= 900000000 AS hard FROM t),
i AS (SELECT *, sum(CAST(hard AS INTEGER)) OVER (PARTITION BY client_id ORDER BY rn) AS island FROM h),
f AS (SELECT client_id, island, us, min(rn) AS rn FROM i GROUP BY ALL),
n AS (SELECT i.client_id, i.island, i.rn, min(f.rn) AS nxt FROM i LEFT JOIN f ON i.client_id = f.client_id AND i.island = f.island AND f.us > i.us + 3600000000 GROUP BY ALL),
s(client_id, island, rn) AS (SELECT client_id, island, rn FROM i WHERE hard UNION ALL SELECT s.client_id, s.island, n.nxt FROM s JOIN n USING (client_id, island, rn) WHERE n.nxt IS NOT NULL),
m AS (SELECT i.*, s.rn IS NOT NULL AS opens FROM i LEFT JOIN s USING (client_id, island, rn)),
g AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY client_id ORDER BY rn) AS session FROM m),
x AS (SELECT client_id, session, arg_min(click_id, rn) AS session_id, arg_min(us, rn) AS start_us, arg_max(us, rn) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents, arg_max(final, rn) AS final, arg_max(rn, rn) AS rn, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY rn)) AS path_sha256 FROM g GROUP BY ALL),
l AS (SELECT x.client_id, x.session FROM c ASOF JOIN (SELECT client_id, start_us, max(session) AS session FROM x GROUP BY ALL) x ON c.client_id = x.client_id AND c.us >= x.start_us WHERE c.late),
ln AS (SELECT client_id, session, count(*) AS n_late FROM l GROUP BY ALL),
y AS (SELECT x.*, h.hard AS nhard, h.pfinal AS npfinal, h.us - h.pus >= 900000000 AS ngap FROM x LEFT JOIN h ON h.client_id = x.client_id AND h.rn = x.rn + 1)
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents, CASE WHEN nhard IS NULL THEN CASE WHEN final THEN 'end' ELSE 'none' END WHEN npfinal THEN 'end' WHEN ngap THEN 'gap' ELSE 'length' END AS closed_by, path_sha256 FROM y LEFT JOIN ln USING (client_id, session)"""


def _vector_codes(rounds: int = 2, parts: int = 16, entries: int = 64, width: int = 4) -> str:
    """Codebooks of vectors of parts x width components."""
    near = "+".join(f"(p.v[{i}] - e.v[{i}]) * (p.v[{i}] - e.v[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"CAST(floor(sum(p.v[{i}]) / CAST(count(*) AS DOUBLE)) AS BIGINT)" for i in range(1, width + 1))
    steps = [f"""k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT r, j AS part, c[j * {width} + 1:(j + 1) * {width}] AS v FROM k, unnest(range({parts})) AS u(j)), e0 AS (SELECT part, r - 1 AS i, v FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT p.r, p.part, min(({near}, e.i)) AS m FROM p JOIN e{n} e ON p.part = e.part GROUP BY p.r, p.part)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT a.part, a.m[2] AS i, [{mean}] AS v FROM a{n} a JOIN p USING (r, part) GROUP BY a.part, a.m[2]), e{n + 1} AS (SELECT e.part, e.i, coalesce(m.v, e.v) AS v FROM e{n} e LEFT JOIN m{n} m ON e.part = m.part AND e.i = m.i)")
    steps.append(f"z AS (SELECT r, string_agg(format('{{:02x}}', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r), h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, i)) AS codebooks_sha256 FROM e{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN z USING (r), h"


VECTOR_CODES = _vector_codes()

ARCHIVES = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id IS DISTINCT FROM f AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM f"""
