"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from quayside.llm.license_scan import SPECIFIC, TEMPLATES

WORDS = r"REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"


def count(pattern: str, text: str = "text") -> str:
    return f"LEN(REGEXP_EXTRACT_ALL(COALESCE({text}, ''), '{pattern}'))"


# windows of three words by position; a word is covered if any window over it occurs twice
OP2 = rf"""WITH w AS (SELECT doc_id, COALESCE(text, '') AS text, {WORDS} AS ws FROM documents),
 p AS (SELECT doc_id, UNNEST(RANGE(LEN(ws) - 2)) AS i, ws FROM w WHERE LEN(ws) >= 3), t AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS g FROM p),
 d AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1), c AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM d, (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY 1),
 m AS (SELECT w.doc_id, text, ws, CAST(LEN(ws) AS BIGINT) AS n_words, CAST(COALESCE(LIST_SUM(LIST_TRANSFORM(ws, lambda x: LENGTH(x))), 0) AS BIGINT) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
 LEN(LIST_FILTER(STRING_SPLIT(text, CHR(10)), lambda l: REGEXP_MATCHES(l, '[^\x20\x09-\x0D]'))) - LEN(LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(text, CHR(10)), lambda l: REGEXP_MATCHES(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
 r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {count(chr(10))} + 1 AS n_lines FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * {count('\\p{Lu}'.replace(chr(92) * 2, chr(92)))} > word_chars
 OR 2 * LEN(LIST_FILTER(ws, lambda x: NOT REGEXP_MATCHES(x, '\p{{L}}'))) > n_words OR 4 * {count('!!')} > n_words OR 10 * {count(r'(?:[.][.][.]|…)[\x20\t\r]*(?:\n|\z)')} > 3 * n_lines) AS kept FROM r"""

REACH = "re(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, re.root FROM re JOIN links e ON e.a = re.id)"

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND LIST_SUM(LIST_TRANSFORM(embedding, lambda x: ABS(x))) > 0),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND LEN(x.e) = LEN(y.e) WHERE LIST_COSINE_SIMILARITY(x.e, y.e) >= 0.98), nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}
 SELECT vec_id, (SELECT COUNT(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN (SELECT id, MIN(root) AS c FROM re GROUP BY 1) ON id = vec_id"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(COALESCE(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(ws[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, ws, UNNEST(RANGE(GREATEST(1, LEN(ws) - 3))) AS i FROM w WHERE LEN(ws) > 0)), n AS (SELECT doc_id, COUNT(*) AS k FROM s GROUP BY 1),
 links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.k >= 80 * (na.k + nb.k - p.k)), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
 SELECT d.doc_id, COALESCE(n.k, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, MIN(root) AS c FROM re GROUP BY 1) ON id = d.doc_id"""

NOTICES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())
LOW = r"REGEXP_EXTRACT_ALL(LOWER(COALESCE(text, '')), '[\p{L}\p{N}]+')"

PAIRS = ", ".join(f"('{s}', '{g}')" for s, g in SPECIFIC)

# windows of twice a size class at steps of once; a shingle at position p is in windows p // width and the one before
OP10 = f"""WITH tp(license, text) AS (VALUES {NOTICES}), tw AS (SELECT license, {LOW} AS ws FROM tp), ts AS (SELECT DISTINCT license, ARRAY_TO_STRING(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT license, ws, UNNEST(RANGE(LEN(ws) - 4)) AS i FROM tw)),
 tn AS (SELECT license, COUNT(*) AS n, CAST(POW(2, CEIL(LOG2(COUNT(*)))) AS BIGINT) AS width FROM ts GROUP BY 1), dw AS (SELECT doc_id, {LOW} AS ws FROM documents),
 ds AS (SELECT doc_id, i, ARRAY_TO_STRING(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, ws, UNNEST(RANGE(LEN(ws) - 4)) AS i FROM dw WHERE LEN(ws) >= 5)),
 hits AS (SELECT doc_id, ts.license, ds.g, n, i // width - back AS win FROM ds JOIN ts USING (g) JOIN tn ON tn.license = ts.license, (SELECT UNNEST([0, 1]) AS back) WHERE i // width - back >= 0),
 best AS (SELECT doc_id, license, MAX(share) AS c FROM (SELECT doc_id, license, win, COUNT(DISTINCT g) / MAX(n) AS share FROM hits GROUP BY 1, 2, 3) WHERE share >= 0.8 GROUP BY 1, 2),
 ch AS (SELECT special, general, (1 + (SELECT COUNT(*) FROM ts a JOIN ts b ON b.g = a.g WHERE a.license = special AND b.license = general) / (SELECT n FROM tn WHERE license = special)) / 2 AS least FROM (VALUES {PAIRS}) v(special, general))
 SELECT doc_id, license, ROUND(c, 6) AS containment FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y, ch WHERE y.doc_id = x.doc_id AND ((x.license = general AND y.license = special AND y.c >= least * x.c) OR (x.license = special AND y.license = general AND x.c < least * y.c)))"""

# sources that are capped are a prefix by cap per weight: what is left is shared by the weights of the rest
OP1 = rf"""WITH d AS (SELECT doc_id, source, CAST(LEN({WORDS}) AS BIGINT) AS size, SUBSTR(MD5('17:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || MD5(COALESCE(text, ''))), 1, 15) AS h FROM documents),
 s AS (SELECT source, SUM(size) AS n, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source), w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, SUM(n) OVER () AS total FROM s),
 f AS (SELECT *, total - COALESCE(SUM(3 * n) OVER before, 0) AS rest, SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0) AS share FROM w WINDOW before AS (ORDER BY 3 * n / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, 3 * n < rest * weight / share AS capped FROM f),
 t AS (SELECT source, k, CAST(n AS BIGINT) AS source_size, CASE WHEN capped THEN 3.0 * n ELSE CAST(MAX(rest) FILTER (NOT capped) OVER () AS DOUBLE) * weight / MAX(share) FILTER (NOT capped) OVER () END AS target FROM o),
 p AS (SELECT doc_id, size, source_size, target, CASE WHEN k % 2 = 1 THEN 0.5 ELSE -0.5 END AS a, COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, CAST(LIST_SUM(LIST_TRANSFORM([0, 1, 2], lambda i: GREATEST(0, LEAST(size, FLOOR(target + 0.5) - start - i * source_size)))) AS BIGINT) AS taken FROM p)
 SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN ROUND(ABS(SQRT((1 - a) * (1 - a) + 4 * a * LEAST(1.0, start / target)) - (1 - a)) / ABS(2 * a), 9) END AS position FROM q"""

# the values that spans have; their places are tested against a brute-force version
SECRET_BASE = rf"""SELECT doc_id, CAST(LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: LENGTH(x) >= 12)) AS BIGINT) AS n_assign,
 CAST({count('AKIA[A-Z0-9]{14,}')} AS BIGINT) AS n_access, CAST({count('[0-9a-f]{16,}')} AS BIGINT) AS n_hex FROM documents"""

DIGITS = "REGEXP_REPLACE(x, '[^0-9]', '', 'g')"
PII_BASE = rf"""WITH v AS (SELECT doc_id, {count('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')} AS n_email, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS ip,
 LIST_TRANSFORM(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[0-9](?:[ -]?[0-9])+'), lambda x: {DIGITS}) AS card, LIST_TRANSFORM(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[+][0-9][ ().0-9-]+[0-9]'), lambda x: {DIGITS}) AS phone FROM documents)
 SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(LEN(LIST_FILTER(ip, lambda x: LEN(LIST_FILTER(STRING_SPLIT(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
 CAST(LEN(LIST_FILTER(card, lambda x: LENGTH(x) BETWEEN 12 AND 19 AND LIST_SUM(LIST_TRANSFORM(RANGE(LENGTH(x)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(x[LENGTH(x) - i] AS INT) ELSE 2 * CAST(x[LENGTH(x) - i] AS INT) - CASE WHEN CAST(x[LENGTH(x) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
 CAST(LEN(LIST_FILTER(phone, lambda x: LENGTH(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM v"""

LOW_TEXT = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# every group times every kept term of its language; shares are integer division in 128 bits
OP11 = rf"""WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, ROW_NUMBER() OVER () AS i, REGEXP_EXTRACT_ALL({LOW_TEXT}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 t AS (SELECT lang, source, i, UNNEST(ws) AS term FROM d), kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING COUNT(DISTINCT i) >= 30), v AS (SELECT lang, COUNT(*) AS v FROM kept GROUP BY 1),
 c AS (SELECT lang, source, term, COUNT(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3), g AS (SELECT DISTINCT lang, source FROM d),
 m AS (SELECT g.lang, g.source, kept.term, COALESCE(c.n, 0) AS n, v FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 share AS (SELECT lang, source, term, n, v, SUM(n) OVER (PARTITION BY lang, source) AS g_all, SUM(n) OVER (PARTITION BY lang, term) AS l_n, SUM(n) OVER (PARTITION BY lang) AS l_all FROM m),
 p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (g_all + 5 * v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (l_n + 5)) // (l_all + 5 * v) AS BIGINT) AS q FROM share),
 f AS (SELECT a.lang, a.source, b.source AS item, CAST(SUM(ABS(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o) SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""

# a passage at a place covers its words; the empty list has a digest too
OP13 = rf"""WITH d AS (SELECT doc_id, ROW_NUMBER() OVER () AS k, REGEXP_EXTRACT_ALL({LOW_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents), b AS (SELECT item_id, REGEXP_EXTRACT_ALL({LOW_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
 w AS (SELECT DISTINCT item_id, n, ARRAY_TO_STRING(ws[i + 1 : i + n], ' ') AS g FROM (SELECT *, UNNEST(RANGE(LEN(ws) - n + 1)) AS i FROM (SELECT item_id, ws, LEAST(10, LEN(ws)) AS n FROM b WHERE LEN(ws) > 0))),
 p AS (SELECT k, i, n, ARRAY_TO_STRING(ws[i + 1 : i + n], ' ') AS g FROM (SELECT k, ws, n, UNNEST(RANGE(LEN(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE LEN(ws) >= n)), h AS (SELECT p.k, p.i, w.n, w.item_id FROM p JOIN w ON w.g = p.g AND w.n = p.n),
 c AS (SELECT k, COUNT(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT k, i, n FROM h), (SELECT UNNEST(RANGE(10)) AS j) WHERE j < n GROUP BY k), l AS (SELECT k, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY k)
 SELECT doc_id, CAST(LEN(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.k = d.k LEFT JOIN l ON l.k = d.k"""

SQL: dict[str, str] = {"op1_mixing": OP1, "secret_base_counts": SECRET_BASE, "pii_base_counts": PII_BASE, "op2_quality": OP2, "op7_embeddings": OP7, "op9_minhash": OP9, "op10_licenses": OP10, "op11_divergence": OP11, "op13_decontamination": OP13}
