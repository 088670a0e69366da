"""DuckDB SQL for the registered corpus queries, written from their rules and not from the Spark plans."""

from quillstone.plans.fixture_oracles import ORACLES as FIXTURES

LETTERS = "array_to_string(regexp_extract_all(text, '\\p{L}'), '')"

LINES = """
lines AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, l[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
)"""

TERMINAL = """'.', '!', '?', '"', '''', ')', ']', '}', ':', ';', '。', '！', '？', '：', '；', '」', '』', '）', '】', '〉', '》'"""

TRIMMED = "trim(line, ' ')"

HEADERS = f"""
counted AS (
  SELECT doc_id, {TRIMMED} AS line, count(*) AS n FROM lines WHERE {TRIMMED} <> '' GROUP BY 1, 2
), headers AS (
  SELECT * FROM (
    SELECT doc_id, line, n,
      CASE WHEN starts_with(line, '# ') AND (regexp_full_match(substr(line, 3), '[0-9]{{1,4}}') OR n >= 2) THEN 'h1'
           WHEN NOT starts_with(line, '#') AND length(line) >= 3 AND NOT regexp_full_match(line, '[0-9]+') AND (
             (n >= 3 AND (chapterish OR bracketed OR length(line) <= 15)) OR
             (n = 2 AND (bracketed OR length(line) <= 10 OR (chapterish AND length(line) <= 25)))) THEN 'plain' END AS kind
    FROM (SELECT *, regexp_matches(line, '^第[零一二三四五六七八九十百千0-9]+[章節编編篇卷]') AS chapterish,
                 regexp_matches(line, '^[「『"][^」』"]{{1,20}}[」』"]$') AS bracketed FROM counted)
  ) WHERE kind IS NOT NULL
)"""


def _visible(gap: str) -> str:
    t = f"regexp_replace(coalesce(html, ''), '(?is)<[^>]+>', '{gap}', 'g')"
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{value}')"
    return f"md5(trim(regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))"


_HEADING = "|".join(f"<h{k}\\b[^>]*>.*?</h{k}>" for k in range(1, 7))

PAIRS = f"""
letters AS (SELECT doc_id, lang, source, {LETTERS} AS t FROM documents),
pairs AS (
  SELECT doc_id, lang, source, (i - 1)::INTEGER AS pos, substr(t, i, 2) AS bigram FROM letters, unnest(range(1, length(t))) AS u(i)
), model AS (SELECT lang, bigram, count(*) AS n FROM pairs GROUP BY 1, 2)"""

FRAGMENTS = f"""
pieces AS (
  SELECT doc_id, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS piece, f FROM (
    SELECT doc_id, lang, i, trim(p[i], ' ') AS f FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?;]*[.!?;]|[^.!?;]+') AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)
  ) WHERE f <> ''
), cut AS (SELECT *, {LETTERS.replace('text', 'f')} AS c FROM pieces),
fragments AS (
  SELECT doc_id, lang, piece, 0::INTEGER AS part, f AS fragment, c FROM cut WHERE length(c) <= 90
  UNION ALL
  SELECT doc_id, lang, piece, (k / 45)::INTEGER AS part, substr(c, k + 1, 90), substr(c, k + 1, 90)
  FROM cut, unnest(range(0, length(c), 45)) AS u(k) WHERE length(c) > 90 AND length(c) - k >= 12
), letters AS (SELECT lang, {LETTERS} AS t FROM documents),
model AS (SELECT lang, substr(t, i, 2) AS bigram, count(*) AS n FROM letters, unnest(range(1, length(t))) AS u(i) GROUP BY 1, 2),
chars AS (SELECT lang, substr(t, i, 1) AS ch, count(*) AS n FROM letters, unnest(range(1, length(t) + 1)) AS u(i) GROUP BY 1, 2),
flags AS (
  SELECT doc_id, piece, part, i, substr(c, i, 1) = substr(c, i + 1, 1) AS same, coalesce(n, 0) AS n
  FROM (SELECT *, substr(c, i, 2) AS bigram FROM fragments, unnest(range(1, length(c))) AS u(i) WHERE length(c) >= 10) LEFT JOIN model USING (lang, bigram)
), runs AS (
  SELECT doc_id, piece, part, max(len) AS longest FROM (
    SELECT doc_id, piece, part, count(*) AS len FROM (
      SELECT *, i - row_number() OVER (PARTITION BY doc_id, piece, part ORDER BY i) AS island FROM flags WHERE n = 1
    ) GROUP BY doc_id, piece, part, island
  ) GROUP BY 1, 2, 3
), pair_counts AS (
  SELECT doc_id, piece, part, count(*) AS pairs, count(*) FILTER (n = 1) AS singles, count(*) FILTER (n >= 3) AS anchors, count(*) FILTER (same) AS repeats FROM flags GROUP BY 1, 2, 3
), char_counts AS (
  SELECT doc_id, piece, part, count(*) AS n_chars, count(*) FILTER (n <= 2) AS rare
  FROM (SELECT *, substr(c, i, 1) AS ch FROM fragments, unnest(range(1, length(c) + 1)) AS u(i) WHERE length(c) >= 10) JOIN chars USING (lang, ch) GROUP BY 1, 2, 3
), counts AS (
  SELECT doc_id, piece, part, n_chars, pairs, singles, anchors, repeats, coalesce(longest, 0) AS longest_run, rare
  FROM pair_counts JOIN char_counts USING (doc_id, piece, part) LEFT JOIN runs USING (doc_id, piece, part)
)"""

ORACLES = {
    "lines_explode": f"WITH {LINES} SELECT * FROM lines",
    "clean_text": """
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'),
  '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS clean_md5 FROM documents""",
    "visible_text": f"SELECT page_id, {_visible(' ')} AS spaced_md5, {_visible('')} AS joined_md5 FROM pages",
    "heading_candidates": f"""
SELECT page_id, (i - 1)::INTEGER AS heading_no, substr(h[i], 3, 1)::INTEGER AS level,
  trim(regexp_replace(replace(regexp_replace(h[i], '(?is)<[^>]+>', '', 'g'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS title
FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is){_HEADING}') AS h FROM pages), unnest(range(1, len(h) + 1)) AS u(i)""",
    "toc_links": """
SELECT page_id, count(*) AS n_links, string_agg(DISTINCT href, ' ' ORDER BY href) AS targets
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""",
    "running_headers": f"WITH {LINES}, {HEADERS} SELECT doc_id, line, n, kind FROM headers",
    "page_segments": f"""
WITH {LINES}, {HEADERS}, has AS (SELECT doc_id, bool_or(kind = 'h1') AS h1 FROM headers GROUP BY 1), marked AS (
  SELECT l.doc_id, l.line_no, coalesce(h.kind = CASE WHEN has.h1 THEN 'h1' ELSE 'plain' END, false) AS is_header
  FROM lines l LEFT JOIN headers h ON l.doc_id = h.doc_id AND trim(l.line, ' ') = h.line LEFT JOIN has ON l.doc_id = has.doc_id
)
SELECT doc_id, line_no, is_header, (sum(is_header::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS segment FROM marked""",
    "bigram_model": f"WITH {PAIRS} SELECT * FROM model",
    "book_bigram_model": f"""
WITH letters AS (SELECT source, string_agg({LETTERS}, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
SELECT source, substr(t, i, 2) AS bigram, count(*) AS n FROM (
  SELECT source, p, substr(t, p, 5001) AS t FROM letters, unnest(range(1, length(t) + 1, 5000)) AS v(p)
), unnest(range(1, least(length(t), 5001))) AS u(i) GROUP BY 1, 2""",
    "singleton_windows": f"""
WITH {PAIRS}, hits AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, sum(CASE WHEN m.n = 1 THEN 1 ELSE 0 END) OVER w AS s, count(*) OVER w AS c
    FROM pairs p JOIN model m USING (lang, bigram) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)
  ) WHERE s >= 1 AND c = 11
), islands AS (
  SELECT doc_id, min(pos) AS start, max(pos) + 12 AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM hits) GROUP BY doc_id, g HAVING count(*) >= 2
)
SELECT doc_id, start::INTEGER AS start, stop::INTEGER AS stop, substr(t, start + 1, stop - start) AS span FROM islands JOIN letters USING (doc_id)""",
    "repeat_runs": f"""
WITH letters AS (SELECT doc_id, {LETTERS} AS t FROM documents), c AS (
  SELECT doc_id, i, substr(t, i, 1) AS ch FROM letters, unnest(range(1, length(t) + 1)) AS u(i)
), r AS (
  SELECT doc_id, ch, min(i) AS first, count(*) AS run_length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c
  ) GROUP BY doc_id, ch, g HAVING count(*) >= 3
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS run_no, ch, run_length::INTEGER AS run_length FROM r""",
    "fragment_scores": f"WITH {FRAGMENTS} SELECT * FROM counts",
    "top_suspicious": f"""
WITH {FRAGMENTS}, scored AS (
  SELECT doc_id, piece, part, round(CASE WHEN n_chars < 2 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.44::DOUBLE * (singles / pairs) + 0.22::DOUBLE * (rare / n_chars) + 0.20::DOUBLE * (longest_run / pairs) + 0.14::DOUBLE - 0.25::DOUBLE * (anchors / pairs)
    + CASE WHEN n_chars BETWEEN 8 AND 25 AND singles / pairs >= 0.75 THEN (singles / pairs - 0.75::DOUBLE) * 1.2 ELSE 0 END
    + CASE WHEN n_chars >= 8 AND repeats / pairs >= 0.80 THEN (repeats / pairs - 0.80::DOUBLE) * 2.5 ELSE 0 END
    + CASE WHEN n_chars >= 20 AND repeats / pairs >= 0.95 THEN 0.30 ELSE 0 END)) END, 6) AS score FROM counts
), best AS (
  SELECT s.doc_id, trim(regexp_replace(fragment, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS excerpt, score FROM scored s JOIN fragments f USING (doc_id, piece, part) WHERE score >= 0.1
)
SELECT doc_id, excerpt, max(score) AS score FROM best GROUP BY 1, 2 ORDER BY score DESC, doc_id, excerpt LIMIT 50""",
    "hopping_windows": f"""
WITH letters AS (SELECT doc_id, {LETTERS} AS t FROM documents), w AS (
  SELECT doc_id, size, start, substr(t, start + 1, size) AS x
  FROM letters, (VALUES (16, 8), (24, 12), (32, 16)) AS v(size, step), unnest(range(0, length(t) - size + 1, step)) AS u(start) WHERE length(t) >= size
)
SELECT doc_id, size, count(*) AS n, count(DISTINCT x) AS n_distinct, max(start)::INTEGER AS last_start FROM w GROUP BY 1, 2""",
    "sentence_round_robin": """
WITH s AS (
  SELECT source, doc_id, i, trim(p[i], ' ') AS sentence
  FROM (SELECT source, doc_id, string_split_regex(coalesce(text, ''), '[.!?\\n][」』）)]*') AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)
), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sentence_no FROM s WHERE sentence <> ''),
f AS (
  SELECT *, len(regexp_extract_all(sentence, '\\p{L}')) AS letters FROM n
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source, substr(sentence, 1, 60) ORDER BY doc_id, sentence_no) AS dup FROM f
  WHERE letters >= 10 AND len(regexp_extract_all(sentence, '[《》「」（）〝〞]')) / letters <= 0.3 AND length(sentence) >= 6
    AND NOT regexp_matches(sentence, 'University Press|http://|https://|ISBN|譯者')
)
SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id, sentence_no)::INTEGER AS turn, source, doc_id, sentence_no, sentence FROM k WHERE dup = 1 ORDER BY turn, source LIMIT 200""",
    "adjacent_boundaries": f"""
WITH letters AS (SELECT conv_id, {LETTERS} AS t FROM conversations),
model AS (SELECT conv_id, substr(t, i, 2) AS bigram, count(*) AS n FROM letters, unnest(range(1, length(t))) AS u(i) GROUP BY 1, 2),
c AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g'), '[」』”’）》】〕〉"0-9０-９¹²³⁴⁵⁶⁷⁸⁹⁰]+$', '') AS tail,
         lead(turn) OVER w AS nxt, substr(lead({LETTERS}) OVER w, 1, 1) AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (
  SELECT *, right(array_to_string(regexp_extract_all(tail, '\\p{{L}}'), ''), 1) AS z FROM c WHERE nxt = turn + 1 AND tail <> '' AND NOT regexp_matches(tail, '[!?;]$')
)
SELECT t.conv_id, turn, nxt AS next_order, CASE WHEN coalesce(n, 0) <= 1 THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS score,
       CASE WHEN coalesce(n, 0) <= 1 THEN 'open_tail_no_terminal rare_boundary_bigram' ELSE 'open_tail_no_terminal' END AS reasons
FROM t LEFT JOIN model ON t.conv_id = model.conv_id AND z || a = bigram WHERE z <> '' AND a <> '' AND a IS NOT NULL""",
    "span_to_doc": """
WITH r AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[^\\n]{12,}')) AS run FROM benchmark),
h AS (SELECT run, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM (SELECT DISTINCT run FROM r) JOIN documents ON contains(text, run) GROUP BY run HAVING count(DISTINCT doc_id) = 1)
SELECT item_id, run, doc_id FROM (SELECT item_id, run, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length(run) DESC, run) AS k FROM r JOIN h USING (run)) WHERE k = 1""",
    "source_lookup": """
WITH k AS (SELECT item_id, length(text) AS len, s, substr(text, s, 24) AS key FROM benchmark, unnest(range(1, 121, 24)) AS u(s) WHERE s + 23 <= length(text)),
m AS (SELECT item_id, len, key, doc_id, documents.text AS t, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, s) AS r FROM k JOIN documents ON contains(documents.text, key)),
f AS (SELECT *, instr(t, key) - 1 AS p FROM m WHERE r = 1)
SELECT item_id, doc_id, key, trim(substr(t, greatest(p - 40, 0)::INTEGER + 1, (p + len + 120 - greatest(p - 40, 0))::INTEGER), ' ') AS context FROM f""",
    "source_lookup_whole": """
WITH k AS (SELECT item_id, length(text) AS len, s, substr(text, s, 24) AS key FROM benchmark, unnest(range(1, length(text) - 22, 24)) AS u(s)),
m AS (SELECT item_id, len, key, doc_id, documents.text AS t, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, s) AS r FROM k JOIN documents ON contains(documents.text, key)),
f AS (SELECT *, instr(t, key) - 1 AS p FROM m WHERE r = 1)
SELECT item_id, doc_id, key, trim(substr(t, greatest(p - 40, 0)::INTEGER + 1, (p + len + 120 - greatest(p - 40, 0))::INTEGER), ' ') AS context FROM f""",
    "paragraph_reflow": """
WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r(doc_id, k, cur, blank, done) AS (
  SELECT doc_id, 0, '', 0, []::VARCHAR[] FROM l
  UNION ALL
  SELECT doc_id, k + 1,
    CASE WHEN line = '' THEN cur WHEN special THEN '' WHEN cur = '' OR close THEN line ELSE t || ' ' || line END,
    CASE WHEN line = '' THEN blank + 1 ELSE 0 END,
    CASE WHEN line = '' THEN done WHEN special THEN list_append(CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END, line)
         WHEN cur <> '' AND close THEN list_append(done, cur) ELSE done END
  FROM (
    SELECT *, CASE WHEN blank >= 2 THEN ends WHEN blank = 1 THEN NOT wrap AND (ends OR (length(line) > 20 AND right(line, 1) IN ({TERMINAL}) AND NOT ends_with(t, '，')))
              ELSE ends OR right(t, 1) IN (':', ';', ',', '-', '：', '；', '，') END AS close
    FROM (
      SELECT *, right(t, 1) IN ({TERMINAL}) AS ends,
             length(line) <= 30 AND regexp_matches(t, '[\\x{3400}-\\x{9FFF}]$') AND regexp_matches(ltrim(line, ' '), '^[\\x{3400}-\\x{9FFF}]') AS wrap,
             regexp_matches(line, '^(#{1,6}[ \\t\\n\\x0B\\f\\r]|>|[ \\t\\n\\x0B\\f\\r]*[-*][ \\t\\n\\x0B\\f\\r]|[0-9]+\\.)')
               OR (length(line) <= 25 AND regexp_matches(line, '^第[零一二三四五六七八九十百千0-9]+[章節编編篇卷]')) AS special
      FROM (SELECT r.*, rtrim(ls[k + 1], ' ') AS line, rtrim(cur, ' ') AS t FROM r JOIN l USING (doc_id) WHERE k < len(ls))
    )
  )
), f AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS p FROM r JOIN l USING (doc_id) WHERE k = len(ls))
SELECT doc_id, len(p)::INTEGER AS n_paragraphs, md5(array_to_string(p, chr(10) || chr(10))) AS text_md5 FROM f""".replace("{TERMINAL}", TERMINAL),
    "inversion_swaps": """
WITH n AS (SELECT user_id, row_number() OVER w - 1 AS idx, event_id % 7 AS printed, lead(event_id % 7) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, idx, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM n WHERE printed = nxt + 1)
SELECT user_id, idx FROM (SELECT user_id, idx, idx - min(idx) OVER (PARTITION BY user_id, g) AS o FROM i) WHERE o % 2 = 0""",
    "asof_boundary": """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""",
    "range_sections": """
SELECT section, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents JOIN (VALUES ('front', 0, 9), ('body', 10, 599), ('gap', 700, 799), ('back', 800, 1000000000)) s(section, a, b)
ON doc_id BETWEEN a AND b GROUP BY 1""",
    "range_sections_all": """
SELECT CASE WHEN doc_id BETWEEN 0 AND 9 THEN 'front' WHEN doc_id BETWEEN 10 AND 599 THEN 'body' WHEN doc_id BETWEEN 700 AND 799 THEN 'gap'
            WHEN doc_id BETWEEN 800 AND 1000000000 THEN 'back' ELSE 'outside' END AS section, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1""",
    "constraint_violations": """
SELECT doc_id AS id, 'label without document' AS issue FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'document id repeated' FROM documents GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT page_id, 'url with fragment' FROM pages WHERE NOT regexp_matches(url, '^https?://') OR contains(url, '#top')
UNION ALL SELECT min(doc_id), 'text repeated' FROM documents GROUP BY text HAVING count(*) > 1""",
    "cjk_scanner": """
WITH t AS (SELECT '三三三三三三三三甲乙丙丁天地玄黃宇宙洪荒天地玄黃宇宙洪荒' AS t)
SELECT substr(t, i, 2) AS bigram, count(*) AS n FROM t, unnest(range(1, length(t))) AS u(i) GROUP BY 1""",
    "stripped_headers": f"""
WITH {LINES}, marks AS (
  SELECT DISTINCT doc_id, regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS fp FROM (SELECT doc_id, {TRIMMED} AS line FROM lines WHERE {TRIMMED} <> '' GROUP BY 1, 2 HAVING count(*) >= 3)
), t AS (
  SELECT l.*, {TRIMMED} AS s, count(*) OVER (PARTITION BY l.doc_id) AS n, row_number() OVER w AS k, marks.fp IS NOT NULL AS printed,
         regexp_matches({TRIMMED}, '^([0-9]+|[零一二三四五六七八九十百千]{{1,3}})$') AS num
  FROM lines l LEFT JOIN marks ON l.doc_id = marks.doc_id AND regexp_replace(l.line, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') = marks.fp WINDOW w AS (PARTITION BY l.doc_id ORDER BY line_no)
), h AS (
  SELECT *, s <> '' AND NOT num AND (printed OR (regexp_matches(s, '^第[零一二三四五六七八九十百千0-9]+[章節编編篇卷]') AND length(s) <= 25)
    OR (regexp_matches(s, '^(「[^」]{{1,20}}」|『[^』]{{1,20}}』|"[^"]{{1,20}}")$') AND length(s) <= 20
        AND (k = 1 OR k = n OR coalesce(lag(num) OVER w, false) OR coalesce(lead(num) OVER w, false)))) AS header
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), g AS (
  SELECT *, n >= 2 AND (num OR header) AS gone FROM h
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone OR line = '') AS n_blank FROM g WHERE gone OR s <> '' OR line = '' OR n < 2 GROUP BY 1""",
    "epub_issues": """
SELECT * FROM (VALUES ('b', 'mimetype is not the first entry', 'EPUB/chapter_001.xhtml'), ('b', 'nav target file missing', 'chapter_002.xhtml#start'),
('b', 'spine file missing', 'EPUB/chapter_002.xhtml'), ('b', 'not exactly one h1', 'EPUB/chapter_002.xhtml: 0')) t(book, issue, detail)""",
    "epub_segments": """
SELECT * FROM (VALUES ('a', 1, 'EPUB/chapter_001.xhtml', 0, '第一章 甲', true, false), ('a', 1, 'EPUB/chapter_001.xhtml', 1, '甲文', false, false), ('a', 2, 'EPUB/chapter_002.xhtml', 0, '第二章 乙', true, false),
('a', 2, 'EPUB/chapter_002.xhtml', 1, '乙', false, true), ('a', 2, 'EPUB/chapter_002.xhtml', 2, '乙文', false, false)) t(book, boundary_no, path, child_no, text, starts, repeats)""",
    "toc_targets": "SELECT * FROM (VALUES ('a', 'EPUB/chapter_001.xhtml', 0, 'start', 10), ('a', 'EPUB/chapter_002.xhtml', 0, 'start', 10)) t(book, path, elem_no, id, score)",
    "chapters": "SELECT * FROM (VALUES (1, 3, 1, '第一章 開始'), (1, 5, 1, '第二章 中間'), (1, 6, 1, '第三章 末尾'), (1, 7, 1, '附錄'), (1, 8, 1, '索引')) t(book, page, level, title)",
} | FIXTURES
