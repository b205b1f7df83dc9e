"""DuckDB statements that state the expected rows of the operator queries independently."""

from __future__ import annotations

#: The words of a text, as in common.words_of().
SQL_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_QUOTE = "[\"'']?"
_SECRETS = {
    "assign": (rf"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(part, '{p}', 1)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(part) >= 16"),
    "hex": ("[0-9a-f]+", "length(part) >= 32"),
    "ident": (rf"(?:[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]){_QUOTE}\x20*[:=]\x20*{_QUOTE}[A-Za-z0-9_.@-]{{3,}}", "true"),
    "random": ("[A-Za-z0-9+/_-]{20,}", "regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]')"),
    "endpoint": ("https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", "true"),
}


def secret_scan_sql(scope: int = 200) -> str:
    """Every kind's matches by splitting the text around them; weak ones by a plain theta join."""
    ctes = ["docs AS (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents)"]
    for k, (kind, (pattern, keep)) in enumerate(_SECRETS.items()):
        ctes.append(
            f"split_{kind} AS (SELECT rid, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM docs)"
        )
        ctes.append(
            f"{kind} AS (SELECT rid, {k} AS kind_no, '{kind}' AS kind, s, s + length(part) AS e FROM (SELECT rid, part, i, "
            f"coalesce(sum(length(part)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s "
            f"FROM (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split_{kind} WHERE len(parts) > 1)) "
            f"WHERE i % 2 = 0 AND {keep.format(p=pattern)})"
        )
    ctes.append("strong AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)")
    ctes.append(
        "weak AS (SELECT * FROM (SELECT * FROM ident UNION ALL SELECT * FROM random UNION ALL SELECT * FROM endpoint) w "
        "WHERE NOT EXISTS (SELECT 1 FROM strong x WHERE x.rid = w.rid AND x.s < w.e AND x.e > w.s))"
    )
    ctes.append(
        "linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM (SELECT * FROM strong UNION ALL SELECT * FROM weak) x "
        f"WHERE x.rid = w.rid AND ((x.s >= w.e AND x.s - w.e <= {scope}) OR (x.e <= w.s AND w.s - x.e <= {scope})) AND "
        "((w.kind IN ('ident', 'endpoint') AND x.kind IN ('assign', 'hex', 'random')) OR (w.kind = 'random' AND x.kind IN ('access', 'ident', 'endpoint')))))"
    )
    ctes.append("found AS (SELECT *, true AS base FROM strong UNION ALL SELECT *, false AS base FROM linked)")
    ctes.append(
        "per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (base) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS a FROM found GROUP BY rid)"
    )
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs LEFT JOIN per USING (rid)"
    )


#: Every document position against every window, by the ten words joined.
DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s : s + 9], ' ') AS k, least(len(w), 10) AS n
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, s, pos.n AS n, item FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


def line_dedup_sql(max_edits: int = 2, near_chars: int = 40, short_chars: int = 20, words_an_edit: int = 10) -> str:
    """Edits of characters by every pair whose letter counts allow it; edits of words by a full banded table.

    DuckDB's distance works on bytes, so the few non-ASCII letters become single bytes first;
    lengths and counts only leave out pairs that cannot be within max_edits edits. Lines within
    their budget of words (of ten words at least) have five words in a row in common."""
    letters = "éèêàâçñóíáúüäößÉÈÊÀÂÇÑÓÍÁÚÜÄÖ"
    single = "".join(f"chr({k})" + " || " * (k < len(letters) + 1) for k in [*range(2, len(letters) + 2)])
    counted = "etanorishl,. "
    counts = ", ".join(f"len(t) - len(replace(t, '{c}', '')) AS c{k}" for k, c in enumerate(counted))
    close = " + ".join(f"abs(a.c{k} - b.c{k})" for k in range(len(counted)))
    # the table's row of word i as a band: at place d stands the distance to the first i - k + d words of the other line
    j = "u[1] - k + v[1]"
    cell = (
        "least(CASE WHEN v[1] < 2 * k THEN acc[v[1] + 2] + 1 ELSE 1000000 END, CASE WHEN v[1] > 0 THEN done[v[1]] + 1 ELSE 1000000 END, "
        f"CASE WHEN {j} BETWEEN 1 AND len(y) THEN acc[v[1] + 1] + (x[u[1]] <> y[{j}])::INTEGER ELSE 1000000 END)"
    )
    cell = f"CASE WHEN {j} = 0 THEN u[1] WHEN {j} < 0 OR {j} > len(y) THEN 1000000 ELSE {cell} END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, no - 1 AS no, line FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d) WHERE trim(line, ' ') <> ''),
f AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS first FROM l GROUP BY line),
t AS (SELECT line, first, length(line) AS n, translate(line, '{letters}', {single}) AS t FROM f WHERE length(line) >= {min(short_chars, near_chars)}),
s AS (SELECT *, {counts} FROM t),
chars AS (SELECT DISTINCT a.line FROM s a JOIN s b ON b.n BETWEEN a.n - {max_edits} AND a.n + {max_edits} AND {close} <= {2 * max_edits} AND a.first > b.first
         WHERE levenshtein(a.t, b.t) <= CASE WHEN least(a.n, b.n) >= {near_chars} THEN {max_edits} ELSE 1 END),
w AS (SELECT row_number() OVER () AS k, line, first, w, len(w) AS n FROM (SELECT line, first, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM f) WHERE len(w) >= {words_an_edit - 1}),
g AS (SELECT DISTINCT k, first, n, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT k, first, n, w, unnest(generate_series(1, n - 4)) AS i FROM w)),
p AS (SELECT DISTINCT a.k AS a, b.k AS b, least(greatest(a.n, b.n) // {words_an_edit}, floor(sqrt(greatest(a.n, b.n))))::INTEGER AS k FROM g a JOIN g b ON a.g = b.g AND a.first > b.first
      WHERE abs(a.n - b.n) <= least(greatest(a.n, b.n) // {words_an_edit}, floor(sqrt(greatest(a.n, b.n))))),
e AS (SELECT p.a, wa.line, wa.w AS x, wb.w AS y, p.k FROM p JOIN w wa ON wa.k = p.a JOIN w wb ON wb.k = p.b
      WHERE len(list_filter(list_distinct(wa.w), lambda v: NOT list_contains(wb.w, v))) <= p.k AND len(list_filter(list_distinct(wb.w), lambda v: NOT list_contains(wa.w, v))) <= p.k),
words AS (SELECT DISTINCT line FROM (SELECT line, x, y, k, list_reduce(list_transform(generate_series(1, len(x)), lambda i: [i::INTEGER]),
      lambda acc, u: list_reduce(list_transform(generate_series(0, 2 * k), lambda z: [z::INTEGER]), lambda done, v: list_append(done, {cell}), []::INTEGER[]),
      list_transform(generate_series(0, 2 * k), lambda v: CASE WHEN v >= k THEN (v - k)::INTEGER ELSE 1000000 END)) AS last FROM e) WHERE last[len(y) - len(x) + k + 1] <= k),
near AS (SELECT line FROM chars UNION SELECT line FROM words),
lost AS (SELECT rid, l.no FROM l JOIN f USING (line) WHERE struct_pack(d := l.doc_id, n := l.no) <> f.first OR l.line IN (SELECT line FROM near)),
per AS (SELECT rid, count(*) AS n_dropped, string_agg(no, ',' ORDER BY no) AS dropped FROM lost GROUP BY rid),
n AS (SELECT rid, count(*) AS n_lines FROM l GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(dropped, '') AS dropped
FROM d LEFT JOIN n USING (rid) LEFT JOIN per USING (rid)
"""


def license_scan_sql(templates: tuple[tuple[str, str], ...], phrases: dict[str, str], threshold: float = 0.9, block_words: int = 64) -> str:
    """Every block against every template by plain counting of common words."""
    half = block_words // 2
    values = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(templates))
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, s - 1 AS place FROM p WHERE array_to_string(w[s : s + {len(phrase.split()) - 1}], ' ') = '{phrase}'" for phrase, label in phrases.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, {SQL_WORDS.format("text")} AS w FROM documents),
p AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE list_contains(w, 'license')),
base AS ({places}),
l AS (SELECT rid, no, {SQL_WORDS.format("line")} AS w FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM d)),
k AS (SELECT rid, no, 0 AS s, w FROM l WHERE len(w) <= {block_words} UNION ALL
      SELECT rid, no, s, w[s + 1 : s + {block_words}] AS w FROM (SELECT rid, no, w, unnest(generate_series(0, len(w) - {block_words} + {half} - 1, {half})) AS s FROM l WHERE len(w) > {block_words})),
t AS (SELECT t, label, list_distinct({SQL_WORDS.format("body")}) AS tw FROM (VALUES {values}) v(t, label, body)),
tt AS (SELECT t, unnest(tw) AS word FROM t),
kw AS (SELECT DISTINCT rid, no, s, unnest(w) AS word FROM k),
m AS (SELECT rid, no, s, t, count(*) AS c FROM kw JOIN tt USING (word) GROUP BY ALL),
hit AS (SELECT rid, no, s, label, c / len(tw) AS score FROM m JOIN t USING (t) WHERE c >= ceil({threshold} * len(tw) - 1e-9)),
b AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM hit) GROUP BY rid),
h AS (SELECT rid, count(DISTINCT (no, s)) AS n_blocks, max(score) AS score FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(n_blocks, 0)::BIGINT AS n_blocks, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(round(score, 6), 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN h USING (rid)
"""

#: All pairs of a label by cosine, then reachability by repeated least labels.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a WHERE r.c < p.b),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, vec_id = c AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_LEVEL = r"length(regexp_replace(regexp_extract({0}, '^[ \t]*(>[ \t]*)*'), '[^>]', '', 'g'))"
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"

#: Passages as islands of lines; links by the normalised text of every run of units of every message.
CHAT_QUOTES = rf"""
WITH m AS (SELECT conv_id, turn, (min(struct_pack(t := coalesce(text, ''), r := coalesce(role, 'user')))) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
l AS (SELECT conv_id, turn, i, line, {_LEVEL.format("line")} AS lv, lead(line) OVER w AS nxt
      FROM (SELECT conv_id, turn, unnest(string_split_regex(x.t, '\r?\n')) AS line, generate_subscripts(string_split_regex(x.t, '\r?\n'), 1) AS i FROM m WHERE contains(x.t, '>'))
      WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
k AS (SELECT *, CASE WHEN lv > 0 THEN trim(regexp_replace(line, '^[ \t]*(>[ \t]*)*', ''), ' ') ELSE line END AS body FROM l
      WHERE NOT (rtrim(line, ' ') LIKE '%wrote:' AND coalesce({_LEVEL.format("nxt")}, 0) > lv)),
g AS (SELECT *, sum(CASE WHEN lv = plv THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS isl
      FROM (SELECT *, lag(lv) OVER (PARTITION BY conv_id, turn ORDER BY i) AS plv FROM k)),
p AS (SELECT conv_id, turn, isl, lv, {_NORMAL.format("string_agg(body, chr(10) ORDER BY i)")} AS u FROM g WHERE lv > 0 GROUP BY 1, 2, 3, 4),
o AS (SELECT conv_id, turn, x.r AS role, CASE WHEN contains(x.t, '>') THEN regexp_replace(coalesce(q.own, ''), '^\n+|\n+$', '', 'g') ELSE x.t END AS own
      FROM m LEFT JOIN (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY i) AS own FROM k WHERE lv = 0 GROUP BY 1, 2) q USING (conv_id, turn)),
un AS (SELECT conv_id, turn AS source, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(own, '([.!?…]["'')\]»”’]{{0,3}})[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '([。！？])', '\1' || chr(10), 'g'), '\r?\n'),
       lambda y: {_NORMAL.format("y")}), lambda y: y <> '') AS us FROM o WHERE conv_id IN (SELECT conv_id FROM p WHERE u <> '')),
ru AS (SELECT DISTINCT conv_id, source, array_to_string(us[a : b], ' ') AS u FROM (SELECT *, unnest(generate_series(a, len(us))) AS b FROM (SELECT *, unnest(generate_series(1, len(us))) AS a FROM un))),
f AS (SELECT p.conv_id, p.turn, p.isl, max(p.lv) AS lv, max(source) AS source FROM p LEFT JOIN ru ON ru.conv_id = p.conv_id AND ru.u = p.u AND ru.source < p.turn GROUP BY 1, 2, 3),
a AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, (-lv) * 1e12 + source) AS best FROM f GROUP BY 1, 2),
r AS (SELECT o.conv_id, o.turn, o.role, o.own, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(best, b.turn, -1) AS after
      FROM o LEFT JOIN a USING (conv_id, turn) LEFT JOIN o b ON b.conv_id = o.conv_id AND b.turn = o.turn - 1),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY after, turn) - 1 AS position FROM r)
SELECT conv_id, (position // 256)::BIGINT AS part, count(*)::BIGINT AS n_turns, sum(n_quotes)::BIGINT AS n_quotes, sum(n_linked)::BIGINT AS n_linked,
       string_agg(turn, ',' ORDER BY position) AS reply_order,
       length(string_agg('<|' || role || '|>' || chr(10) || own, chr(10) ORDER BY position))::BIGINT AS n_chars,
       sha256(string_agg('<|' || role || '|>' || chr(10) || own, chr(10) ORDER BY position)) AS chat_sha256
FROM z GROUP BY 1, 2
"""


#: Units as a list, cut by list slices; the text is rebuilt from the output by the places of its marks.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                 CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM d),
formed AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
                  array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM formed),
parts AS (SELECT *, instr(o, '<P>') AS ip, instr(o, '<S>') AS is_, instr(o, '<M>') AS im FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, is_ - 4) || substr(o, im + 3) || substr(o, is_ + 3, im - is_ - 3)
                        ELSE substr(o, ip + 3, im - ip - 3) || substr(o, im + 3) || substr(o, 4, ip - 4) END) AS restored_sha256
FROM parts
"""

#: All scores of every query, ranked.
EXACT_TOPK = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.v, c.v), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


#: Every kept term for every group, its share, and all pairs of sources by a join on the term.
SOURCE_DIVERGENCE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
q AS (SELECT kept.lang, term, 1 + CAST(1000000000 AS HUGEINT) * (kept.n + 5) // (langs.n + 5 * v) AS q FROM kept JOIN langs USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(gn.n, 0) + 5 * v) AS p
      FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
