"""Registered queries that chunk by structure: Markdown written from documents and lineitem, and pages written from
conversations; the SQL finds lines, headings, pieces and parents by joins, windows and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import structure
from corpusloom.runtime import checkpointed, read_table


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as Markdown: a title, a heading over every fifth line, and the table of the order of its number."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), F.lit(" |"))
    rows = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("rows"))
    part = lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("\n"), F.repeat(F.lit("#"), i % 3 + 2), F.lit(" Part "), i.cast("string"), F.lit("\n\n"), x)).otherwise(x)
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), part), "\n")
    table = F.concat(F.lit("\n\n## Lines\n\n| line | part | supplier | flag |\n| --- | :---: | --- | --- |\n"), "rows", F.lit("\n\nEnd of the lines."))
    docs = read_table(spark, sf, "documents").join(rows, F.col("doc_id") == F.col("l_orderkey"), "left")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), body, F.coalesce(table, F.lit(""))).alias("text"))


def turn_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as a document with a page a turn; even turns have a heading, every fifth one that isn't in its text."""
    name = F.concat(F.lit("Turn "), F.col("turn").cast("string"))
    level = (F.col("turn") % 3 + 1).cast("int")
    heading = lambda text: F.array(F.struct(text.alias("text"), level.alias("level"), F.col("turn").cast("int").alias("page_number")))
    headings = F.when(F.col("turn") % 2 == 0, heading(name)).when(F.col("turn") % 5 == 3, heading(F.concat(F.lit("Lost "), name)))
    tables = F.lit(None).cast(structure.TABLES)
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("before it\n"), name, F.lit("\n"), "text")).otherwise(F.col("text"))
    return read_table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), text.alias("text"), headings.alias("headings"), tables.alias("tables"))


def _pages(spark, sf):
    return structure.parse_markdown_pages(markdown_docs(spark, sf))


def _named(chunks: DataFrame, *more: str) -> DataFrame:
    path = F.array_join("heading_path", " > ").alias("path")
    return chunks.select("doc_id", "chunk_id", "chunk_index", "page_number", "heading", "heading_level", path, "content", *more)


def markdown_pages(spark, sf):
    p = structure.page_rows(_pages(spark, sf))
    heads = F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), h["text"])), ",")
    cells = F.transform("tables", lambda t: F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, ",")), ";"))
    return p.select("doc_id", "text", heads.alias("headings"), F.array_join(cells, "/").alias("tables"))


def section_paths(spark, sf):
    s = structure.with_sections(turn_pages(spark, sf))
    return s.select("doc_id", "page_number", "nth", F.coalesce("heading", F.lit("")).alias("heading"), F.array_join("heading_path", " > ").alias("path"), F.sha2("body", 256).alias("body_sha256"))


def chunk_structure(spark, sf):
    return _named(structure.chunk_structure(structure.page_rows(_pages(spark, sf))))


def chunk_turns(spark, sf):
    return _named(structure.chunk_structure(turn_pages(spark, sf), 120))


def chunk_tables(spark, sf):
    t = structure.chunk_tables(structure.page_rows(_pages(spark, sf)), 120)
    return _named(t, "table_index", "table_part", "table_part_count", "row_start", "row_end")


def chunk_parent_child(spark, sf):
    c = structure.chunk_parent_child(turn_pages(spark, sf), 600, 150)
    return _named(c, "chunk_type", "parent_chunk_id", "child_count", F.array_join("child_chunk_ids", ",").alias("children"))


def chunk_combined(spark, sf):
    c = structure.build_chunks(checkpointed(_pages(spark, sf)), "combined")
    return _named(c, "chunk_type", "parent_chunk_id", "combined_chunk_index", "child_count", F.array_join("child_chunk_ids", ",").alias("children"))


QUERIES = {f.__name__: f for f in (markdown_pages, section_paths, chunk_structure, chunk_turns, chunk_tables, chunk_parent_child, chunk_combined)}

# SQL ------------------------------------------------------------------------------------------------------------------

_W = "(chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160))"


def _trim(x: str) -> str:
    return f"trim({x}, {_W})"


_S = r"[\t-\r\x1c- \x{85}\x{a0}]"
_NL = "chr(10)"

_MARKDOWN = r"""
listed AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY line) AS rows FROM (SELECT l_orderkey, '| ' || concat_ws(' | ', l_linenumber, l_partkey, l_suppkey, l_returnflag) || ' |' AS line FROM lineitem) GROUP BY l_orderkey),
md AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, '# Document ' || doc_id || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN chr(10) || repeat('#', (i - 1) % 3 + 2) || ' Part ' || (i - 1) || chr(10) || chr(10) || x ELSE x END), chr(10))
  || CASE WHEN rows IS NULL THEN '' ELSE chr(10) || chr(10) || '## Lines' || chr(10) || chr(10) || '| line | part | supplier | flag |' || chr(10) || '| --- | :---: | --- | --- |' || chr(10) || rows || chr(10) || chr(10) || 'End of the lines.' END AS text FROM documents LEFT JOIN listed ON doc_id = l_orderkey)"""

_PARSED = rf"""{_MARKDOWN},
md_lines AS (SELECT doc_id, string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\n\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM md),
ln AS (SELECT doc_id, unnest(CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END) AS line, generate_subscripts(CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END, 1) AS pos FROM md_lines),
ln2 AS (SELECT *, regexp_extract(line, '^{_S}*(#{{1,6}}){_S}+(.+?){_S}*$', 1) AS marks, regexp_extract(line, '^{_S}*(#{{1,6}}){_S}+(.+?){_S}*$', 2) AS title, starts_with({_trim("line")}, '|') AND ends_with({_trim("line")}, '|') AS is_row FROM ln),
ln3 AS (SELECT *, CASE WHEN is_row THEN list_transform(string_split(replace(substr({_trim("line")}, 2, greatest(0, length({_trim("line")}) - 2)), '\|', chr(1)), '|'), lambda c: {_trim("replace(c, chr(1), '|')")}) END AS cells FROM ln2),
ln4 AS (SELECT *, coalesce(len(list_filter(cells, lambda c: NOT regexp_full_match(c, ':?-{{3,}}:?'))) = 0, false) AS rule, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ln3),
ln5 AS (SELECT *, is_row AND coalesce(lead(rule) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM ln4),
ln6 AS (SELECT *, CASE WHEN is_row THEN min(CASE WHEN opens THEN pos END) OVER (PARTITION BY doc_id, run) END AS begun FROM ln5),
tb AS (SELECT doc_id, 1 AS page, begun, list(cells ORDER BY pos) AS rows FROM ln6 WHERE pos = begun OR (pos > begun AND NOT rule) GROUP BY doc_id, begun),
pg AS (SELECT doc_id, 1 AS page, {_trim("string_agg(CASE WHEN marks <> '' THEN title ELSE line END, chr(10) ORDER BY pos)")} AS text FROM ln6 GROUP BY doc_id),
hd AS (SELECT doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS ord, title AS t, length(marks) AS l FROM ln6 WHERE marks <> '')"""

_TURN_PAGES = """
pg AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INT) AS page, CASE WHEN turn % 2 = 0 THEN 'before it' || chr(10) || 'Turn ' || turn || chr(10) || text ELSE text END AS text FROM conversations),
hd AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INT) AS page, 1 AS ord, CASE WHEN turn % 2 = 0 THEN 'Turn ' || turn ELSE 'Lost Turn ' || turn END AS t, turn % 3 + 1 AS l FROM conversations WHERE turn % 2 = 0 OR turn % 5 = 3)"""


def _sections(text: str = "pg") -> str:
    """sec(doc_id, page, k, g, h, l, path, body): headings placed one after another, paths from heads not ended yet."""
    return f"""
place AS (SELECT doc_id, page, 0 AS ord, 1 AS cursor, CAST(NULL AS BIGINT) AS pos FROM {text}
  UNION ALL SELECT doc_id, page, ord, CASE WHEN a IS NULL THEN cursor ELSE a + length(t) END, a FROM (
    SELECT p.doc_id, p.page, h.ord, p.cursor, h.t, CASE WHEN instr(substr(x.text, p.cursor), h.t) > 0 THEN p.cursor - 1 + instr(substr(x.text, p.cursor), h.t) ELSE nullif(instr(x.text, h.t), 0) END AS a
    FROM place p JOIN hd h ON h.doc_id = p.doc_id AND h.page = p.page AND h.ord = p.ord + 1 JOIN {text} x ON x.doc_id = p.doc_id AND x.page = p.page)),
eff AS (SELECT * FROM (SELECT h.*, p.pos, max(p.pos) OVER (PARTITION BY h.doc_id, h.page) IS NOT NULL AS any_placed FROM hd h JOIN place p USING (doc_id, page, ord)) WHERE pos IS NOT NULL OR NOT any_placed),
head AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos, ord) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos, ord) AS g, lead(pos) OVER (PARTITION BY doc_id, page ORDER BY pos, ord) AS nxt FROM eff),
ends AS (SELECT a.doc_id, a.g, min(b.g) AS e FROM head a JOIN head b ON b.doc_id = a.doc_id AND b.g > a.g AND b.l <= a.l GROUP BY a.doc_id, a.g),
cnt AS (SELECT x.doc_id, x.page, x.text, coalesce(n, 0) AS n, first_at, coalesce(sum(n) OVER (PARTITION BY x.doc_id ORDER BY x.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {text} x LEFT JOIN (SELECT doc_id, page, count(*) AS n, min(pos) AS first_at FROM head GROUP BY ALL) USING (doc_id, page)),
sec0 AS (
  SELECT doc_id, page, 0 AS k, before AS g, {_trim("substr(text, 1, first_at - 1)")} AS body FROM cnt WHERE first_at IS NOT NULL AND {_trim("substr(text, 1, first_at - 1)")} <> ''
  UNION ALL SELECT h.doc_id, h.page, h.k, h.g, {_trim("substr(c.text, h.pos + length(h.t), greatest(0, coalesce(h.nxt, length(c.text) + 1) - h.pos - length(h.t)))")} FROM head h JOIN cnt c USING (doc_id, page) WHERE h.pos IS NOT NULL
  UNION ALL SELECT doc_id, page, n, before + n, {_trim("text")} FROM cnt WHERE first_at IS NULL AND {_trim("text")} <> ''
  UNION ALL SELECT h.doc_id, h.page, h.k, h.g, '' FROM head h JOIN cnt c USING (doc_id, page) WHERE h.pos IS NULL AND {_trim("c.text")} = ''),
paths AS (SELECT s.doc_id, s.page, s.k, list(h.t ORDER BY h.g) AS path, arg_max(h.l, h.g) AS l FROM sec0 s JOIN head h ON h.doc_id = s.doc_id AND h.g <= s.g LEFT JOIN ends e ON e.doc_id = h.doc_id AND e.g = h.g WHERE e.e IS NULL OR e.e > s.g GROUP BY ALL),
sec AS (SELECT doc_id, page, k, g, coalesce(path[len(path)], '') AS h, l, coalesce(array_to_string(path, ' > '), '') AS path, body, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS nth FROM sec0 LEFT JOIN paths USING (doc_id, page, k))"""


def _pieces(name: str, source: str, size: int, body: str = "body") -> str:
    """{name}(id, piece, content) of source(id, h, body): paragraphs, sentences and cuts, packed twice by recursion."""
    n = name
    return rf"""
{n}_in AS (SELECT id, {_trim("h")} AS h, CASE WHEN {_trim("h")} = '' THEN {size} WHEN {size} - length({_trim("h")}) - 2 <= 0 THEN {size} ELSE {size} - length({_trim("h")}) - 2 END AS room, {size} - length({_trim("h")}) - 2 <= 0 AND {_trim("h")} <> '' AS alone, {body} AS body FROM {source}),
{n}_par AS (SELECT id, room, p, x FROM (SELECT id, room, generate_subscripts(a, 1) AS p, {_trim("unnest(a)")} AS x FROM (SELECT id, room, string_split_regex(body, '\n{_S}*\n+') AS a FROM {n}_in)) WHERE x <> ''),
{n}_sen AS (SELECT id, room, p, s, x FROM (SELECT id, room, p, generate_subscripts(a, 1) AS s, {_trim("unnest(a)")} AS x FROM (SELECT id, room, p, string_split(regexp_replace(x, '([.!?…]){_S}+|\n+', '\1' || chr(2), 'g'), chr(2)) AS a FROM {n}_par WHERE length(x) > room)) WHERE x <> ''),
{n}_cut AS (SELECT id, room, p, s, 0 AS c, CAST(NULL AS VARCHAR) AS piece, x AS rest FROM {n}_sen
  UNION ALL SELECT id, room, p, s, c + 1, {_trim("left(rest, b)")}, {_trim("substr(rest, b + 1)")} FROM (
    SELECT *, CASE WHEN length(rest) <= room THEN length(rest) WHEN instr(reverse(left(rest, room + 1)), ' ') > 0 AND room + 1 - instr(reverse(left(rest, room + 1)), ' ') > 0 THEN room + 1 - instr(reverse(left(rest, room + 1)), ' ') ELSE room END AS b FROM {n}_cut WHERE rest <> '')),
{n}_bit AS (SELECT id, room, p, piece AS x, row_number() OVER (PARTITION BY id, p ORDER BY s, c) AS r FROM {n}_cut WHERE piece IS NOT NULL),
{n}_one AS (SELECT id, room, p, x, r, 1 AS grp, length(x) AS used FROM {n}_bit WHERE r = 1
  UNION ALL SELECT b.id, b.room, b.p, b.x, b.r, CASE WHEN o.used + 1 + length(b.x) > b.room THEN o.grp + 1 ELSE o.grp END, CASE WHEN o.used + 1 + length(b.x) > b.room THEN length(b.x) ELSE o.used + 1 + length(b.x) END FROM {n}_one o JOIN {n}_bit b ON b.id = o.id AND b.p = o.p AND b.r = o.r + 1),
{n}_unit AS (SELECT id, room, p, x, row_number() OVER (PARTITION BY id ORDER BY p, grp) AS r FROM (SELECT id, room, p, 0 AS grp, x FROM {n}_par WHERE length(x) <= room UNION ALL SELECT id, any_value(room), p, grp, string_agg(x, ' ' ORDER BY r) FROM {n}_one GROUP BY id, p, grp)),
{n}_two AS (SELECT id, room, x, r, 1 AS grp, length(x) AS used FROM {n}_unit WHERE r = 1
  UNION ALL SELECT b.id, b.room, b.x, b.r, CASE WHEN o.used + 2 + length(b.x) > b.room THEN o.grp + 1 ELSE o.grp END, CASE WHEN o.used + 2 + length(b.x) > b.room THEN length(b.x) ELSE o.used + 2 + length(b.x) END FROM {n}_two o JOIN {n}_unit b ON b.id = o.id AND b.r = o.r + 1),
{n} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS piece, content FROM (
  SELECT id, 0 AS grp, h AS content FROM {n}_in WHERE h <> '' AND (alone OR body = '')
  UNION ALL SELECT t.id, grp, CASE WHEN any_value(i.h) = '' OR any_value(i.alone) THEN string_agg(x, chr(10) || chr(10) ORDER BY r) ELSE any_value(i.h) || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY r) END FROM {n}_two t JOIN {n}_in i USING (id) GROUP BY t.id, grp))"""


def _digest(*parts: str) -> str:
    return "left(sha256(" + " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "), 24)"


_KEYED = "keyed AS (SELECT *, doc_id || '/' || page || '/' || nth AS id FROM sec)"


def _structure(pages: str, size: int) -> str:
    return f"""WITH RECURSIVE {pages}, {_sections()}, {_KEYED}, {_pieces("pc", "keyed", size)},
ch AS (SELECT k.doc_id, k.page, k.h, k.l, k.path, p.content, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.page, k.nth, p.piece) - 1 AS i FROM pc p JOIN keyed k USING (id))
SELECT doc_id, {_digest("doc_id", "'text'", "page", "h", "''", "i", "content")} AS chunk_id, CAST(i AS INT) AS chunk_index, page AS page_number, h AS heading, CAST(l AS INT) AS heading_level, path, content FROM ch"""


def _families(text: str, parent: int, child: int) -> str:
    """par and kid: parents, and children with their parent's id and index."""
    return f"""{_sections(text)}, {_KEYED}, {_pieces("pc", "keyed", parent)},
par0 AS (SELECT k.doc_id, k.page, k.h, k.l, k.path, p.content, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.page, k.nth, p.piece) - 1 AS i FROM pc p JOIN keyed k USING (id)),
par AS (SELECT *, {_digest("doc_id", "'parent'", "page", "h", "''", "i", "content")} AS own, doc_id || '/' || i AS id, CASE WHEN h <> '' AND starts_with(content, h) THEN ltrim(substr(content, length(h) + 1), {_W}) ELSE content END AS inside FROM par0),
{_pieces("kc", "par", child, "inside")},
kid0 AS (SELECT p.doc_id, p.page, p.h, p.l, p.path, p.own AS parent, p.i AS parent_i, c.content, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i, c.piece) - 1 AS i FROM kc c JOIN par p USING (id)),
kid AS (SELECT *, {_digest("doc_id", "'child'", "page", "h", "parent", "i", "content")} AS own FROM kid0)"""


def _table_line(cells: str) -> str:
    return f"'| ' || array_to_string(list_transform({cells}, lambda c: {_trim('''replace(replace(c, chr(10), ' '), '|', chr(92) || '|')''')}), ' | ') || ' |'"


def _table_chunks(size: int) -> str:
    """tc(doc_id, page, h, l, content, ti, part, parts, row_start, row_end, i) of the parsed tables; needs place and head."""
    return f"""
tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY begun) AS n, {_table_line("rows[1]")} AS line1, array_to_string(list_filter(rows[1], lambda c: c <> ''), ' ') AS flat1 FROM tb),
tp AS (SELECT doc_id, 0 AS n, 1 AS cursor, CAST(NULL AS BIGINT) AS pos FROM pg
  UNION ALL SELECT doc_id, n, coalesce(a + 1, cursor), a FROM (SELECT t.doc_id, t.n, p.cursor, CASE WHEN instr(substr(x.text, p.cursor), t.line1) > 0 THEN p.cursor - 1 + instr(substr(x.text, p.cursor), t.line1) WHEN flat1 <> '' AND instr(substr(x.text, p.cursor), flat1) > 0 THEN p.cursor - 1 + instr(substr(x.text, p.cursor), flat1) END AS a FROM tp p JOIN tn t ON t.doc_id = p.doc_id AND t.n = p.n + 1 JOIN pg x ON x.doc_id = p.doc_id)),
towner AS (SELECT t.doc_id, t.n, coalesce(max({{'pos': h.pos, 'ord': h.ord, 't': h.t, 'l': h.l}}) FILTER (WHERE h.pos <= p.pos), max({{'pos': h.pos, 'ord': h.ord, 't': h.t, 'l': h.l}}) FILTER (WHERE h.pos IS NOT NULL), max({{'pos': h.pos, 'ord': h.ord, 't': h.t, 'l': h.l}})) AS o FROM tn t JOIN tp p USING (doc_id, n) LEFT JOIN head h ON h.doc_id = t.doc_id GROUP BY t.doc_id, t.n),
tl AS (SELECT t.doc_id, t.page, t.n, coalesce(o.t, '') AS h, o.l AS l, 'Table ' || t.n || ': ' || coalesce(o.t, 'Full text') || chr(10) || line1 || chr(10) || '| ' || array_to_string(list_transform(rows[1], lambda c: '---'), ' | ') || ' |' AS top, rows FROM tn t JOIN towner USING (doc_id, n)),
tr AS (SELECT doc_id, n, r, top, {_table_line("cells")} AS line FROM (SELECT doc_id, n, top, unnest(rows[2:]) AS cells, generate_subscripts(rows[2:], 1) AS r FROM tl)),
tk AS (SELECT doc_id, n, r, line, 1 AS grp, length(top) + 1 + length(line) AS used FROM tr WHERE r = 1
  UNION ALL SELECT b.doc_id, b.n, b.r, b.line, CASE WHEN k.used + 1 + length(b.line) > {size} THEN k.grp + 1 ELSE k.grp END, CASE WHEN k.used + 1 + length(b.line) > {size} THEN length(b.top) + 1 + length(b.line) ELSE k.used + 1 + length(b.line) END FROM tk k JOIN tr b ON b.doc_id = k.doc_id AND b.n = k.n AND b.r = k.r + 1),
tc AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS parts, row_number() OVER (PARTITION BY doc_id ORDER BY n, grp) - 1 AS i FROM (
  SELECT tl.doc_id, tl.page, tl.h, tl.l, tl.n, coalesce(grp, 1) AS grp, any_value(top) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY r), '') AS content, coalesce(min(r), 0) AS row_start, coalesce(max(r), 0) AS row_end FROM tl LEFT JOIN tk USING (doc_id, n) GROUP BY tl.doc_id, tl.page, tl.h, tl.l, tl.n, grp))"""


_NO_TABLE_ROWS = rf"""
sigs AS (SELECT doc_id, list(DISTINCT array_to_string(list_transform(r, lambda c: {_trim(f"regexp_replace(c, '{_S}+', ' ', 'g')")}), chr(31))) AS rows, list(DISTINCT array_to_string(list_filter(list_transform(r, lambda c: {_trim(f"regexp_replace(c, '{_S}+', ' ', 'g')")}), lambda c: c <> ''), ' ')) AS flats FROM (SELECT doc_id, unnest(rows) AS r FROM tb) GROUP BY doc_id),
tx_lines AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '[\n\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM pg)),
tx_cells AS (SELECT *, CASE WHEN starts_with({_trim("line")}, '|') AND ends_with({_trim("line")}, '|') THEN list_transform(string_split(replace(substr({_trim("line")}, 2, greatest(0, length({_trim("line")}) - 2)), '\|', chr(1)), '|'), lambda c: {_trim("replace(c, chr(1), '|')")}) END AS cells, {_trim(f"regexp_replace(line, '{_S}+', ' ', 'g')")} AS tight FROM tx_lines),
tx AS (SELECT doc_id, 1 AS page, {_trim("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')")} AS text FROM (
  SELECT c.*, coalesce(cells IS NOT NULL AND (list_contains(rows, array_to_string(list_transform(cells, lambda x: {_trim(f"regexp_replace(x, '{_S}+', ' ', 'g')")}), chr(31))) OR len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-{{3,}}:?'))) = 0), false) OR coalesce(tight <> '' AND list_contains(flats, tight), false) AS gone FROM tx_cells c LEFT JOIN sigs USING (doc_id)) GROUP BY doc_id)"""

_COLUMNS = "doc_id, own AS chunk_id, CAST(i AS INT) AS chunk_index, page AS page_number, h AS heading, CAST(l AS INT) AS heading_level, path, content"

ORACLE_SQL: dict[str, str] = {
    "markdown_pages": f"""WITH {_PARSED}
SELECT doc_id, text, coalesce((SELECT string_agg(l || t, ',' ORDER BY ord) FROM hd WHERE hd.doc_id = pg.doc_id), '') AS headings, coalesce((SELECT string_agg(array_to_string(list_transform(rows, lambda r: array_to_string(r, ',')), ';'), '/' ORDER BY begun) FROM tb WHERE tb.doc_id = pg.doc_id), '') AS tables FROM pg""",
    "section_paths": f"WITH RECURSIVE {_TURN_PAGES}, {_sections()} SELECT doc_id, page AS page_number, CAST(nth AS INT) AS nth, h AS heading, path, sha256(body) AS body_sha256 FROM sec",
    "chunk_structure": _structure(_PARSED, 500),
    "chunk_turns": _structure(_TURN_PAGES, 120),
    "chunk_tables": f"""WITH RECURSIVE {_PARSED}, {_sections()}, {_table_chunks(120)},
named AS (SELECT *, {_digest("doc_id", "'table'", "page", "h", "''", "i", "content")} AS own, h AS path FROM tc)
SELECT {_COLUMNS}, CAST(n - 1 AS INT) AS table_index, CAST(grp AS INT) AS table_part, CAST(parts AS INT) AS table_part_count, CAST(row_start AS INT) AS row_start, CAST(row_end AS INT) AS row_end FROM named""",
    "chunk_parent_child": f"""WITH RECURSIVE {_TURN_PAGES}, {_families("pg", 600, 150)}
SELECT {_COLUMNS}, 'parent' AS chunk_type, NULL AS parent_chunk_id, CAST((SELECT count(*) FROM kid WHERE kid.parent = par.own AND kid.doc_id = par.doc_id) AS INT) AS child_count, coalesce((SELECT string_agg(kid.own, ',' ORDER BY kid.i) FROM kid WHERE kid.parent = par.own AND kid.doc_id = par.doc_id), '') AS children FROM par
UNION ALL SELECT {_COLUMNS}, 'child', parent, NULL, NULL FROM kid""",
    "chunk_combined": f"""WITH RECURSIVE {_PARSED}, {_NO_TABLE_ROWS}, {_families("tx", 1500, 300)},
thead AS (SELECT * FROM hd),
tplace AS (SELECT doc_id, page, 0 AS ord, 1 AS cursor, CAST(NULL AS BIGINT) AS pos FROM pg
  UNION ALL SELECT doc_id, page, ord, CASE WHEN a IS NULL THEN cursor ELSE a + length(t) END, a FROM (
    SELECT p.doc_id, p.page, h.ord, p.cursor, h.t, CASE WHEN instr(substr(x.text, p.cursor), h.t) > 0 THEN p.cursor - 1 + instr(substr(x.text, p.cursor), h.t) ELSE nullif(instr(x.text, h.t), 0) END AS a
    FROM tplace p JOIN thead h ON h.doc_id = p.doc_id AND h.page = p.page AND h.ord = p.ord + 1 JOIN pg x ON x.doc_id = p.doc_id AND x.page = p.page)),
whole_head AS (SELECT h.*, p.pos FROM hd h JOIN tplace p USING (doc_id, page, ord)), {_table_chunks(500).replace("JOIN head h", "JOIN whole_head h")},
found AS (SELECT t.*, coalesce((SELECT min({{'i': p.i, 'own': p.own}}) FROM par p WHERE p.doc_id = t.doc_id AND p.page = t.page AND p.h = t.h), (SELECT min({{'i': p.i, 'own': p.own}}) FROM par p WHERE p.doc_id = t.doc_id AND p.page = t.page)) AS up FROM tc t),
made0 AS (SELECT f.*, coalesce((SELECT count(*) FROM par p WHERE p.doc_id = f.doc_id), 0) AS pos FROM found f WHERE up IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i) = 1),
made AS (SELECT doc_id, page, h, l, h AS path, content, pos AS i, {_digest("doc_id", "'parent'", "page", "h", "''", "pos", "content")} AS own FROM made0),
tab AS (SELECT f.doc_id, f.page, f.h, f.l, f.h AS path, f.content, f.i, coalesce(up.own, m.own) AS parent FROM found f LEFT JOIN made m ON m.doc_id = f.doc_id AND m.page = f.page),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, i) - 1 AS c FROM (
  SELECT doc_id, page, h, l, path, content, i, parent, own, 'child' AS kind FROM kid UNION ALL SELECT doc_id, page, h, l, path, content, i, parent, {_digest("doc_id", "'table'", "page", "h", "parent", "i", "content")}, 'table' FROM tab) WHERE {_trim("content")} <> ''),
up AS (SELECT doc_id, page, h, l, path, content, i, own FROM par UNION ALL SELECT doc_id, page, h, l, path, content, i, own FROM made),
of AS (SELECT doc_id, parent AS own, count(*) AS n, string_agg(own, ',' ORDER BY c) AS ids FROM kept GROUP BY ALL)
SELECT {_COLUMNS}, 'parent' AS chunk_type, NULL AS parent_chunk_id, NULL AS combined_chunk_index, CAST(n AS INT) AS child_count, ids AS children FROM up JOIN of USING (doc_id, own)
UNION ALL SELECT {_COLUMNS}, kind, parent, CAST(c AS INT), NULL, NULL FROM kept""",
}
