"""SQL for the operators that plain SQL can express, over whole tables; it shares no rule with the operators but the contract."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_PLAIN}), []) AS w FROM documents),
items AS MATERIALIZED (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, {_PLAIN}), []) AS w FROM benchmark),
item_windows AS MATERIALIZED (SELECT item_id, least(13, len(w)) AS n, i, w[i:i + least(13, len(w)) - 1] AS g FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0),
doc_windows AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM docs, (SELECT DISTINCT n FROM item_windows), unnest(range(1, len(w) - n + 2)) t(i)),
places AS MATERIALIZED (SELECT d.doc_id, b.item_id, d.i, b.n, d.i - b.i AS shift FROM doc_windows d JOIN item_windows b USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM places), unnest(range(i, i + n)) t(p) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM places) GROUP BY doc_id),
stretches AS (SELECT doc_id, item_id, min(i) AS i, count(*) + n - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift, n ORDER BY i) AS island FROM places) GROUP BY doc_id, item_id, shift, n, island),
longest AS (SELECT DISTINCT ON (doc_id) doc_id, size, i - 1 AS start, item_id::VARCHAR AS item FROM stretches ORDER BY doc_id, size DESC, i, stretches.item_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(size, 0)::BIGINT AS longest_match, start::BIGINT AS match_start, item AS match_item
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id) LEFT JOIN longest USING (doc_id)"""

SUBSTRING_DEDUP = f"""WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM docs, unnest(range(1, len(w) - 48)) t(i)),
repeats AS (SELECT doc_id, i FROM windows JOIN (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(DISTINCT doc_id) > 1) USING (g) WHERE first < doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) t(p)),
marked AS (SELECT doc_id, p, word, coalesce(max(r.i) OVER (PARTITION BY doc_id ORDER BY p), -50) < p - 49 AS stays FROM words LEFT JOIN (SELECT doc_id, i, i AS p FROM repeats) r USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (stays) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED}), []) AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s FROM docs, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS whole FROM sets GROUP BY doc_id),
classes AS MATERIALIZED (SELECT whole, min(doc_id) AS rep, any_value(n) AS n FROM sizes GROUP BY whole),
of_reps AS MATERIALIZED (SELECT rep, n, s FROM classes JOIN sets ON rep = doc_id),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM of_reps a JOIN of_reps b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep, rep AS other FROM classes UNION SELECT r.rep, e.b FROM reach r JOIN edges e ON r.other = e.a),
named AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.whole = s.whole LEFT JOIN named ON named.rep = c.rep"""

LINE_DEDUP = r"""WITH lines AS MATERIALIZED (SELECT doc_id, i, parts[i] AS line, translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i)),
often AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often ON lines.key = often.key GROUP BY doc_id"""

FILL_IN_MIDDLE = r"""WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda k: ('0x' || h[8 * k + 1:8 * k + 8])::BIGINT) AS d FROM units),
formed AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut"""

_ORDERS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p, count(*) AS f FROM pieces, unnest(range(1, len(w) - {k - 2})) t(i) GROUP BY 1, 3 HAVING count(*) >= 30" for k in (1, 2, 3, 4))
_CUTS = " UNION ALL ".join(f"SELECT *, {j} AS j, array_to_string(w[:{j}], ' ') AS head, array_to_string(w[{j + 1}:], ' ') AS tail FROM phrases WHERE k > {j}" for j in (1, 2, 3))
_INNER = " UNION ALL ".join(f"SELECT lang, f, array_to_string(w[{i}:{i + m - 1}], ' ') AS p FROM phrases WHERE k > {m} AND k >= {i + m - 1}" for m in (2, 3) for i in (1, 2, 3))
COLLOCATIONS = rf"""WITH pieces AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED ({_ORDERS}),
phrases AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM grams WHERE k > 1),
cuts AS MATERIALIZED ({_CUTS}),
scored AS (SELECT c.lang, c.p, c.f, j, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT // (x.f + y.f))::BIGINT AS score FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = head JOIN grams y ON y.lang = c.lang AND y.p = tail),
best AS (SELECT DISTINCT ON (lang, p) * FROM scored ORDER BY lang, p, score, j),
covered AS (SELECT DISTINCT g.lang, g.p FROM grams g JOIN ({_INNER}) i ON g.lang = i.lang AND g.p = i.p WHERE 100 * i.f >= 80 * g.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(p)) AS rank FROM best ANTI JOIN covered USING (lang, p))
SELECT lang, rank, p AS phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
