"""DuckDB SQL for the queries over generated rows, written from the rules."""

from quillstone.plans.fixtures import HEAD, TAIL

_GOOD = TAIL + TAIL[:14] + TAIL
_BAD = TAIL + "居之者忽音但一通乃一祔一筆八" + TAIL

ORACLES = {
    "repaired_order": """
WITH p AS (
  SELECT (k // 12)::INTEGER AS book, (k % 12)::INTEGER AS idx FROM range(3600) r(k)
), q AS (
  SELECT book, idx, (CASE WHEN book % 3 = 0 THEN CASE WHEN idx % 2 = 0 THEN 101 + idx ELSE 99 + idx END
                          WHEN book % 3 = 2 THEN 50 + idx
                          WHEN idx < 2 THEN NULL WHEN idx = 2 THEN 1 WHEN book % 2 = 0 AND idx IN (3, 4) THEN NULL
                          WHEN idx % 2 = 1 THEN idx ELSE idx - 2 END)::INTEGER AS n FROM p
), inv AS (
  SELECT book, idx, n FROM (SELECT *, lead(n) OVER (PARTITION BY book ORDER BY idx) AS nxt FROM q) WHERE n = nxt + 1
), tally AS (
  SELECT book, idx - (n - 3) AS start, count(*) AS votes, max(n) AS top, min(idx) AS seen FROM inv WHERE n >= 3 AND n % 2 = 1 AND idx - (n - 3) >= 0 GROUP BY 1, 2
), best AS (
  SELECT * FROM (SELECT *, sum(votes) OVER (PARTITION BY book) AS cast_, row_number() OVER (PARTITION BY book ORDER BY votes DESC, seen) AS k FROM tally)
  WHERE k = 1 AND votes >= 2 AND votes >= 0.6 * cast_
), candidates AS (
  SELECT book, idx FROM inv UNION SELECT book, unnest(range(start, least(10, start + top - 3) + 1, 2))::INTEGER FROM best
), runs AS (
  SELECT book, idx, idx - row_number() OVER (PARTITION BY book ORDER BY idx) AS run FROM candidates
), chosen AS (
  SELECT book, idx FROM (SELECT book, idx, idx - min(idx) OVER (PARTITION BY book, run) AS o FROM runs) WHERE o % 2 = 0
)
SELECT p.book, p.idx, (CASE WHEN a.idx IS NOT NULL THEN p.idx + 1 WHEN b.idx IS NOT NULL THEN p.idx - 1 ELSE p.idx END)::BIGINT AS new_index
FROM p LEFT JOIN chosen a ON a.book = p.book AND a.idx = p.idx LEFT JOIN chosen b ON b.book = p.book AND b.idx = p.idx - 1""",
    "noise_tables": """
WITH t AS (SELECT k::INTEGER AS table_id, 8 + k % 19 AS size, 1880 + 40 * (k % 9) AS first FROM range(300) r(k)),
y AS (
  SELECT table_id, count(*) AS numbers, count(*) FILTER (v BETWEEN 1900 AND 2200) AS years, count(DISTINCT v) FILTER (v BETWEEN 1900 AND 2200) AS kinds,
         max(v) FILTER (v BETWEEN 1900 AND 2200) - min(v) FILTER (v BETWEEN 1900 AND 2200) AS span, any_value(size) AS size
  FROM (SELECT table_id, size, first + r + c AS v FROM t, unnest(range(1, size + 1)) AS a(r), (VALUES (0), (1), (2)) AS b(c) WHERE table_id % 3 = 0) GROUP BY 1
), d AS (
  SELECT table_id, count(*) AS cells, greatest(count(*) FILTER (odd), count(*) FILTER (NOT odd)) AS shared, count(DISTINCT c) AS kinds, max(c) - min(c) AS span
  FROM (SELECT table_id, c, NOT (table_id % 4 = 1 AND c % 2 = 0) AS odd FROM t, unnest(range(1, size + 1)) AS a(c) WHERE table_id % 3 = 1) GROUP BY 1
), f AS (
  SELECT t.table_id, coalesce(y.size >= 12 AND numbers >= 30 AND years >= 0.8 * numbers AND y.kinds >= 12 AND y.span >= 12, false) AS years,
         coalesce(cells >= 16 AND shared >= 0.8 * cells AND d.kinds >= 12 AND d.span >= 12, false) AS outline
  FROM t LEFT JOIN y USING (table_id) LEFT JOIN d USING (table_id)
)
SELECT table_id, years, outline, NOT (years OR outline) AS kept FROM f""",
    "chinese_numerals": """
WITH n AS (SELECT (k // 3 + 1)::INTEGER AS n, (k % 3)::INTEGER AS kind FROM range(2997) r(k)),
p AS (SELECT *, n // 100 AS h, n // 10 % 10 AS t, n % 10 AS u FROM n),
s AS (
  SELECT *, CASE WHEN h > 0 THEN substr('一二三四五六七八九', h, 1) || '百' ELSE '' END
         || CASE WHEN t > 0 THEN CASE WHEN h = 0 AND t = 1 THEN '' ELSE substr('一二三四五六七八九', t, 1) END || '十' WHEN h > 0 AND u > 0 THEN '零' ELSE '' END
         || CASE WHEN u > 0 THEN substr('一二三四五六七八九', u, 1) ELSE '' END AS numeral FROM p
)
SELECT n, kind, CASE kind WHEN 0 THEN '第' || numeral || '章 題' WHEN 1 THEN '第' || n || '章' ELSE '第' || numeral || '節' END AS title,
       CASE WHEN kind < 2 THEN n END AS number,
       CASE WHEN kind = 0 AND h > 0 AND t > 0 THEN (h * 100 + t) * 10 + u WHEN kind < 2 THEN n END::INTEGER AS literal
FROM s""",
    "cjk_repeats": """
WITH d AS (SELECT k::INTEGER AS doc_id, (k % 12)::INTEGER AS a, ((k * 7) % 11)::INTEGER AS b FROM range(400) r(k))
SELECT doc_id, 0 AS run_no, '三' AS ch, a AS run_length FROM d WHERE a >= 6
UNION ALL SELECT doc_id, CASE WHEN a >= 6 THEN 1 ELSE 0 END, '丁', b FROM d WHERE b >= 6""",
    "page_start_alignment": """
SELECT k AS id, CASE WHEN k % 5 = 4 THEN -1 ELSE k % 29 END::INTEGER AS "offset", CASE WHEN k % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity,
       k % 5 <> 4 AND k % 29 >= 8 AS possible_omission FROM range(200) r(k)""",
    "diff_patch": f"""
SELECT (k // 2)::INTEGER AS chunk, (k % 2 + 1)::INTEGER AS page,
       CASE WHEN k % 2 = 0 THEN repeat('{TAIL}', 3) WHEN (k // 2) % 3 = 1 THEN '{_BAD}' ELSE '{_GOOD}' END AS text,
       CASE WHEN k % 2 = 1 AND (k // 2) % 3 = 0 THEN 1 ELSE 0 END AS patched FROM range(300) r(k)""",
    "kth_occurrence_link": """
WITH m AS (SELECT k::INTEGER AS page, j::INTEGER AS marker_no, (1 + j % 3)::VARCHAR AS number FROM range(300) r(k), unnest(range(k % 9 + 1)) AS u(j)),
n AS (SELECT k::INTEGER AS page, j::INTEGER AS note_no, (1 + (j * 2) % 3)::VARCHAR AS number FROM range(300) r(k), unnest(range(k % 7 + 1)) AS u(j)),
mo AS (SELECT *, row_number() OVER (PARTITION BY page, number ORDER BY marker_no) AS occurrence FROM m),
no AS (SELECT *, row_number() OVER (PARTITION BY page, number ORDER BY note_no) AS occurrence FROM n)
SELECT mo.page, marker_no, mo.number, mo.occurrence, note_no FROM mo LEFT JOIN no ON mo.page = no.page AND mo.number = no.number AND mo.occurrence = no.occurrence""",
    "visual_fallbacks": """
WITH p AS (SELECT (k + 1)::INTEGER AS page FROM range(400) r(k)),
f AS (
  SELECT page, page % 7 = 0 OR (page % 7 > 1 AND (page % 3 = 0 OR (page % 3 = 1 AND (page % 4) / 100.0 >= 0.005))) AS need, page % 3 = 0 AND page % 4 >= 2 AS turned FROM p
)
SELECT page, CASE WHEN need THEN printf('imgs/page_fallback_%04d.png', page) END AS fallback_path, CASE WHEN turned THEN 90 ELSE 0 END AS rotation FROM f""",
    "caption_cleanup": """
SELECT k AS id, CASE k % 5
  WHEN 0 THEN repeat(chr(10), (k % 3)::INTEGER) || '正文' || k
  WHEN 1 THEN '![](imgs/' || k || '.png)'
  WHEN 2 THEN CASE WHEN k % 3 = 0 THEN '話！' || chr(10) || '就在這時刻他說他要講幾句' ELSE repeat(chr(10), (1 + k % 3)::INTEGER) || '就在這時刻他說他要講幾句話！' END
  WHEN 3 THEN 'Figure 1. is kept ' || k
  ELSE '' END AS text FROM range(500) r(k)""",
    "toc_repairs": """
WITH b AS (SELECT k, k::VARCHAR AS book FROM range(120) r(k)), n AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 't2-start' ELSE 'm' END AS two, CASE WHEN k % 3 = 0 THEN 't3-chapter-2' ELSE 't3-chapter' END AS three FROM b
)
SELECT book, 'E/a.xhtml' AS path, '<html><body><h1 id="t1">第一章 甲</h1><p>' || book || '</p><h2 id="' || two || '">第二章</h2><p id="t2">乙</p>'
  || CASE WHEN k % 3 = 0 THEN '<p id="t3-chapter">x</p>' ELSE '' END || '<h3 id="' || three || '">第三章</h3><h3 id="t3">丙</h3></body></html>' AS text FROM n
UNION ALL
SELECT book, 'E/b.xhtml', '<html><body><h2 id="toc-auto-start">第四章</h2><p>丁' || book || '</p><p id="p-part">第二編</p><p>戊</p><p id="p">戊</p></body></html>' FROM n
UNION ALL
SELECT book, 'E/nav.xhtml', '<html><body><a href="a.xhtml#t1">第一章 甲</a><a href="a.xhtml#' || two || '">第二章 乙</a><a href="a.xhtml#' || three
  || '">第三章 丙</a><a href="b.xhtml#toc-auto-start">第四章 丁</a><a href="b.xhtml#p-part">第二編 戊</a></body></html>' FROM n""",
}
