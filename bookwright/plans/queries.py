"""The registered queries of the core, each over its whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookwright.functions import text as fn
from bookwright.functions.embedding import HashingEmbedder, embed
from bookwright.functions.markup import html_text
from bookwright.operators import blocks, changes, chunking, cleaning, exporting, listing, rows, search
from bookwright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: White space for RE2, as functions.text.SPACE is for Java.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEARCHED = "loose torque cassette"
NOTES = rows.RowMapping("notes", "id", ("body", "status"), "title", ("status", "updated_at"))
TICKETS = rows.RowMapping("notes", "id", ("body",), "title", ("status",))


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with its SQL where SQL can express it."""

    def add(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql:
            _sql[query.__name__] = sql.replace("{WS}", WS)
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _words(column: str) -> str:
    return f"regexp_extract_all({column}, '[^{WS}]+')"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _estimate(column: str) -> str:
    return f"case when {column} is null then null when len({_words(column)}) = 0 then 0 else greatest(1, length({column}) // 4, len({_words(column)}) * 13 // 10) end"


# Text functions


@registered(f"select id, ({_estimate('text')})::int as estimate from chunks")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "text").select("id", fn.estimate_tokens(F.col("text")).alias("estimate"))


@registered(f"select lang, count(*) as documents, sum({_estimate('text')})::bigint as tokens from documents group by lang")
def token_totals_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(fn.estimate_tokens(F.col("text"))).alias("tokens"))


@registered(r"""
with t as (select distinct title from notes where title is not null),
w as (select title, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) as term, generate_subscripts(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), 1) as pos from t),
d as (select title, term, min(pos) as pos from w where length(term) > 1 group by all)
select title, coalesce(string_agg('"' || term || '"', ' OR ' order by pos), '') as expression from t left join d using (title) group by title""")
def match_expressions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes", "title").where("title is not null").distinct().select("title", fn.match_expression(F.col("title")).alias("expression"))


@registered("""
select c.id, md5(array_to_string(list_concat([d.source_name], c.heading_path), ' › ') || chr(10) || chr(10) || c.text) as digest, coalesce(c.heading_path[-1], '') as section
from chunks c join documents d on c.document_id = d.doc_id where d.source_name is not null""")
def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source_name").where("source_name is not null")
    chunks = table(spark, folder, "chunks", "id", "document_id", "text", "heading_path")
    joined = chunks.join(docs, F.col("document_id") == F.col("doc_id"))
    return joined.select("id", F.md5(fn.embedding_text(F.col("source_name"), F.col("heading_path"), F.col("text"))).alias("digest"), fn.section_title(F.col("heading_path")).alias("section"))


@registered(r"""
with s as (select doc_id, collection, source_path, coalesce(nullif(substr(regexp_replace(regexp_replace(source_name, '[^\p{L}\p{N}\p{M}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'item') as stem from documents)
select doc_id, stem, stem || '-' || substr(sha1(collection || chr(0) || source_path), 1, 8) as key, stem || '-' || substr(sha1(collection || chr(0) || source_path), 1, 8) || '_chunk_001' as first_chunk from s""")
def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "collection", "source_path", "source_name").withColumn("stem", fn.stem_slug(F.col("source_name")))
    key = fn.document_key(F.col("collection"), F.col("source_path"), F.col("stem"))
    return docs.select("doc_id", "stem", key.alias("key"), fn.chunk_id(key, F.lit(1)).alias("first_chunk"))


@registered("select doc_id, 'sha256:' || sha256(text) as content_hash from documents")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", fn.content_hash(F.col("text")).alias("content_hash"))


@registered("""
select c.id, d.source_name || case when coalesce(page_start, 0) <> 0 then ', p.' || page_start || case when coalesce(page_end, 0) <> 0 and page_end <> page_start then '–' || page_end else '' end else '' end
  || case when len(heading_path) > 0 then ' › ' || array_to_string(heading_path, ' › ') else '' end as citation
from chunks c join documents d on c.document_id = d.doc_id""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source_name")
    chunks = table(spark, folder, "chunks", "id", "document_id", "page_start", "page_end", "heading_path")
    cited = fn.citation(F.col("source_name"), F.col("page_start"), F.col("page_end"), F.col("heading_path"))
    return chunks.join(docs, F.col("document_id") == F.col("doc_id")).select("id", cited.alias("citation"))


@registered("select id, case when length(text) > 400 then substr(text, 1, 400) || '…' else text end as snippet from chunks")
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "text").select("id", fn.snippet(F.col("text")).alias("snippet"))


@registered("""
select c.id, len(regexp_extract_all(c.text, '[a-zA-Z]{3,}')) < 10 and d.ocr_used > 0 as weak
from chunks c join documents d on c.document_id = d.doc_id where c.text is not null""")
def weak_pages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "ocr_used")
    chunks = table(spark, folder, "chunks", "id", "document_id", "text").where("text is not null")
    return chunks.join(docs, F.col("document_id") == F.col("doc_id")).select("id", fn.is_weak_page(F.col("text"), F.col("ocr_used")).alias("weak"))


@registered(f"select id, len(string_split(regexp_replace(text, '([.!?…])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))) as sentences from chunks where text is not null")
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "text").where("text is not null").select("id", F.size(fn.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@registered(f"select id, array_to_string({_words('text')}[-49:], ' ') as tail from chunks where text is not null")
def overlap_tails(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "text").where("text is not null").select("id", fn.overlap_tail(F.col("text"), 64).alias("tail"))


@registered("""
with p as (select id, heading_path as a, lag(heading_path) over (partition by document_id order by seq) as b from chunks)
select id, case when b is null then 0 else coalesce((select min(i) - 1 from generate_series(1, least(len(a), len(b)) + 1) g(i) where i > least(len(a), len(b)) or a[i] <> b[i]), 0) end as shared from p""")
def shared_headings(spark: SparkSession, folder: str) -> DataFrame:
    told = search.previous(table(spark, folder, "chunks", "id", "document_id", "seq", "heading_path"), "heading_path")
    return told.select("id", F.when(F.col("before").isNull(), 0).otherwise(F.size(fn.common_prefix(F.col("heading_path"), F.col("before")))).cast("bigint").alias("shared"))


# Rows as documents


def _latest_notes(spark: SparkSession, folder: str) -> DataFrame:
    return rows.latest(table(spark, folder, "notes").where("id is not null"), "id", "updated_at")


_NOTES = "n as (select * from notes where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last, title desc nulls last, body desc nulls last, status desc nulls last) = 1)"


@registered(f"with {_NOTES} select id, title, body, status from n")
def notes_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _latest_notes(spark, folder).select("id", "title", "body", "status")


@registered(f"""
with {_NOTES}
select 'sql:notes/' || id as source_path, coalesce(nullif({_strip('title')}, ''), 'notes #' || id) as source_name,
  concat_ws(chr(10) || chr(10), '# ' || nullif({_strip('title')}, ''), 'status: ' || nullif(status, ''), nullif({_strip('body')}, '')) as text
from n where nullif({_strip('body')}, '') is not null""")
def notes_as_documents(spark: SparkSession, folder: str) -> DataFrame:
    return rows.documents(_latest_notes(spark, folder), TICKETS)


@registered(f"""
with {_NOTES}
select 'sql:notes/' || id as source_path, coalesce(nullif({_strip('title')}, ''), 'notes #' || id) as source_name,
  concat_ws(chr(10) || chr(10), '# ' || nullif({_strip('title')}, ''), nullif(concat_ws(chr(10), 'status: ' || nullif(status, '')), ''), '## body' || chr(10) || chr(10) || nullif({_strip('body')}, ''), '## status' || chr(10) || chr(10) || nullif({_strip('status')}, '')) as text
from n where coalesce(nullif({_strip('body')}, ''), nullif({_strip('status')}, '')) is not null""")
def notes_as_sections(spark: SparkSession, folder: str) -> DataFrame:
    return rows.documents(_latest_notes(spark, folder), rows.RowMapping("notes", "id", ("body", "status"), "title", ("status",)))


@registered(f"select 'sql:notes/' || id as source_path, count(*) as n from notes where id is not null and nullif({_strip('body')}, '') is not null group by id having count(*) > 1")
def note_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return rows.duplicates(rows.documents(table(spark, folder, "notes"), TICKETS, strict=False))


# Cleaning and structure

_L = r"\p{L}"


def _letters(c: str) -> str:
    return f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"


def _bare(c: str, signs: str) -> str:
    return f"regexp_replace({c}, '^[{signs}]+|[{signs}]+$', '', 'g')"


def _short(parts: str, signs: str) -> str:
    return f"(len(list_filter({parts}, lambda w: length({_bare('w', signs)}) <= 2)) / len({parts}))"


def _cleaned(text: str) -> str:
    """Common table expressions of kept lines: ``id``, ``pos``, ``line``, ``blanks``, ``before``."""
    return rf"""
s as (select id, unnest(string_split({text}, chr(10))) as line, generate_subscripts(string_split({text}, chr(10)), 1) - 1 as pos from chunks where text is not null),
m as (select id, pos, {_strip('line')} as raw, sum(({_strip('line')} = '')::int) over (partition by id order by pos) as blanks from s),
w as (select *, {_words('raw')} as p from m where raw <> ''),
k as (select * from w where not (regexp_matches(raw, '^\p{{Nd}}{{1,4}}$') or (length(raw) > 2 and regexp_matches(raw, '^[\p{{Nd}}{WS}]+$')) or (length(raw) <= 4 and {_letters('raw')} <= 2)
  or (contains(raw, '@') and len(p) > 2) or (len(p) >= 3 and {_short('p', '.,;:!?')} > 0.5) or (length(raw) > 8 and {_letters('raw')} / length(raw) < 0.5))),
r as (select *, len(p) - coalesce(list_position(list_reverse(list_transform(p, lambda w: length({_bare('w', '.,;:!?@()\\[\\]')}) >= 3 and {_letters(_bare('w', '.,;:!?@()\\[\\]'))} >= 3)), true), 0) as real from k),
c as (select *, case when len(p) >= 5 and real >= 2 and real < len(p) - 2 and {_short('p[real + 2:]', '.,;:!?@')} > 0.5 and regexp_replace(array_to_string(p[1:real + 1], ' '), '[ ,;:]+$', '') <> ''
  then regexp_replace(array_to_string(p[1:real + 1], ' '), '[ ,;:]+$', '') else raw end as line from r),
f as (select *, lag(line) over (partition by id order by pos) as last from c),
g as (select *, lag(blanks) over (partition by id order by pos) as before from f where last is null or raw <> last)"""


@registered(f"with {_cleaned('text')} select id, pos::int as pos, line, coalesce(blanks > before, false) as gap from g")
def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "id", "text").where("text is not null")
    return cleaning.clean_lines(chunks.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")), ["id"])


def _unescaped(column: str) -> str:
    """Character references resolved; of named ones SQL knows these."""
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        column = f"replace({column}, '{reference}', '{sign}')"
    return column


_PLAIN = f"regexp_replace({_unescaped('text')}, '[{cleaning.SILENT}]', '', 'g')"


@registered(f"""
with {_cleaned(_PLAIN)}, j as (select id, string_agg(case when blanks > before then chr(10) else '' end || line, chr(10) order by pos) as cleaned from g group by id)
select c.id, coalesce(cleaned, '') as text from chunks c left join j using (id)""")
def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_pages(table(spark, folder, "chunks", "id", "text"), ["id"])


_LINES = f"""
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
k as (select *, regexp_matches({_strip('line')}, '^(```|~~~)')::int as mark from l),
s as (select *, sum(mark) over (partition by doc_id order by pos) as seen from k),
n as (select doc_id, pos, line, mark = 1 or seen % 2 = 1 as fenced, {_strip('line')} as bare from s),
h as (select doc_id, pos, length(regexp_extract(bare, '^(#{{1,6}})[{WS}]+(.+?)[{WS}]*#*[{WS}]*$', 1)) as level, regexp_extract(bare, '^(#{{1,6}})[{WS}]+(.+?)[{WS}]*#*[{WS}]*$', 2) as title from n where not fenced)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.lines(table(spark, folder, "documents", "doc_id", "text"))


@registered(f"with {_LINES} select doc_id, pos::int as pos, level::int as level, title from h where level > 0")
def markdown_headings(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.headings(_lines(spark, folder))


@registered(f"""
with {_LINES}
select n.doc_id, n.pos::int as pos, (case when regexp_extract(bare, '^(\\d+(?:\\.\\d+)*)', 1) = '' then 1 else least(4, len(string_split(regexp_extract(bare, '^(\\d+(?:\\.\\d+)*)', 1), '.'))) end)::int as level
from n where length(bare) < 120 and not ends_with(bare, '.') and (regexp_matches(bare, '(?i)^(chapter|part|section|appendix)\\s') or regexp_matches(bare, '^\\d+(\\.\\d+)*\\s+\\S'))""")
def numbered_headings(spark: SparkSession, folder: str) -> DataFrame:
    is_heading, level = blocks.numbered_heading(F.col("line"))
    return _lines(spark, folder).where(is_heading).select("doc_id", "pos", level.cast("int").alias("level"))


@registered(f"""
with {_LINES}, f as (select * from h where level > 0),
o as (select a.doc_id, a.pos, b.pos as place, b.title from f a join f b on a.doc_id = b.doc_id and b.pos <= a.pos
  where b.level <= a.level and not exists (select 1 from f c where c.doc_id = a.doc_id and c.pos > b.pos and c.pos <= a.pos and c.level <= b.level))
select doc_id, pos::int as pos, string_agg(title, ' › ' order by place) as path from o group by doc_id, pos""")
def heading_paths(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.heading_paths(blocks.headings(_lines(spark, folder))).select("doc_id", "pos", F.array_join("path", fn.PATH_MARK).alias("path"))


@registered(f"""
with {_LINES}, e as (select n.*, not fenced and (bare = '' or coalesce(h.level, 0) > 0) as ends from n left join h using (doc_id, pos)),
g as (select *, sum(ends::int) over (partition by doc_id order by pos) as grp from e)
select doc_id, min(pos)::int as pos, md5(string_agg(regexp_replace(line, '[{WS}]+$', ''), chr(10) order by pos)) as digest from g where not ends group by doc_id, grp""")
def paragraph_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.paragraphs(_lines(spark, folder)).select("doc_id", "pos", F.md5("text").alias("digest"))


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text as one page, of a paged source if they have pages."""
    docs = table(spark, folder, "documents", "doc_id", "text", "total_pages").where("text is not null")
    return docs.select("doc_id", F.array("text").alias("pages"), (F.col("total_pages") > 0).alias("paged"))


_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_BLOCKS = rf"""
l as (select doc_id, coalesce(total_pages > 0, false) as paged, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
k as (select *, {_strip('line')} as bare, regexp_matches({_strip('line')}, '^(```|~~~)')::int as mark from l),
s as (select *, mark = 1 or sum(mark) over (partition by doc_id order by pos) % 2 = 1 as fenced from k),
m as (select *, case when fenced then 0 else length(regexp_extract(bare, '^(#{{{{1,6}}}})[{{WS}}]+(.+?)[{{WS}}]*#*[{{WS}}]*$', 1)) end as md, regexp_extract(bare, '^(#{{{{1,6}}}})[{{WS}}]+(.+?)[{{WS}}]*#*[{{WS}}]*$', 2) as mdt, regexp_extract(bare, '^(\d+(?:\.\d+)*)', 1) as num from s),
d as (select *, max(md) over (partition by doc_id) > 0 as marked,
  not fenced and bare <> '' and length(bare) < 120 and not ends_with(bare, '.') and (regexp_matches(bare, '(?i)^(chapter|part|section|appendix)\s') or regexp_matches(bare, '^\d+(\.\d+)*\s+\S')
    or (regexp_matches(bare, '[{_CASED}]') and not regexp_matches(bare, '(^|[^{_CASED}])\p{{Ll}}|[{_CASED}][\p{{Lu}}\p{{Lt}}]')) or (regexp_matches(bare, '\p{{Lu}}') and not regexp_matches(bare, '[\p{{Ll}}\p{{Lt}}]'))) as guessed from m),
g as (select *, (case when marked then md when not guessed then 0 when num = '' then 1 else least(4, len(string_split(num, '.'))) end)::int as level, case when marked then mdt else bare end as title from d),
e as (select *, not fenced and (bare = '' or level > 0) as ends from g),
n as (select *, sum(ends::int) over (partition by doc_id order by pos) as grp from e),
hd as (select doc_id, pos, level, title from n where level > 0),
pg as (select doc_id, grp, any_value(paged) as paged, min(pos) as pos, string_agg(case when paged and not fenced then bare else regexp_replace(line, '[{{WS}}]+$', '') end, chr(10) order by pos) as text from n where not ends group by doc_id, grp),
b as (select doc_id, pos, level, title as text from hd union all select doc_id, pos, 0, case when paged then replace(regexp_replace(text, '-\n(\p{{Ll}})', '\1', 'g'), chr(10), ' ') else text end from pg)"""
_BLOCKS = _BLOCKS.replace("{{", "{").replace("}}", "}").replace("{WS}", WS)


@registered(f"""
with {_BLOCKS},
o as (select b.doc_id, b.pos, h.pos as place, h.title from b join hd h on h.doc_id = b.doc_id and h.pos <= b.pos and (b.level = 0 or h.level <= b.level)
  where not exists (select 1 from hd c where c.doc_id = b.doc_id and c.pos > h.pos and c.pos <= b.pos and c.level <= h.level)),
p as (select doc_id, pos, string_agg(title, ' › ' order by place) as path from o group by doc_id, pos)
select b.doc_id, b.pos::bigint as place, b.level, md5(b.text) as digest, coalesce(p.path, '') as path from b left join p on p.doc_id = b.doc_id and p.pos = b.pos""")
def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    found = blocks.blocks(_paged(spark, folder))
    return found.select("doc_id", "place", "level", F.md5("text").alias("digest"), F.array_join("path", fn.PATH_MARK).alias("path"))


@registered()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_documents(_paged(spark, folder), ["doc_id"])


@registered(f"""
with {_BLOCKS},
x as (select doc_id, string_agg(case when level > 0 then repeat('#', level) || ' ' else '' end || text, chr(10) || chr(10) order by pos) || chr(10) as markdown from b group by doc_id)
select d.doc_id, md5(coalesce(markdown, '')) as digest from documents d left join x using (doc_id) where d.text is not null""")
def documents_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.markdown_documents(_paged(spark, folder), "doc_id").select("doc_id", F.md5("markdown").alias("digest"))


def _html() -> str:
    """A page's text by one replacement after another; a self-closing hidden element counts as open."""
    rest = """(?:[\\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>"""
    steps = [(r"(?s)<!--.*?(?:-->|$)|<!\[CDATA\[|\]\]>", "''")]
    steps += [(f"(?is)<{name}{rest}.*?(?:</{name}\\s*>|$)", "''") for name in ("script", "style", "head", "title", "noscript")]
    steps += [(f"(?i)<h{n}{rest}", f"chr(10) || chr(10) || '{'#' * n} '") for n in range(1, 7)]
    blocks_ = "p|div|br|li|tr|section|article|blockquote|pre|table"
    steps += [(f"(?i)</?(?:{blocks_}){rest}|</h[1-6]{rest}", "chr(10)"), (f"(?i)</?[a-z][^\\s/>]*{rest}|<[!?/][^>]*>|<[a-z/!?][^>]*$", "''")]
    column = "text"
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', {new}, 'g')"
    column, line = _unescaped(column), WS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
    for pattern, new in ((r"[ \t\x{a0}]+", "' '"), (f"(?m)^[{line}]+|[{line}]+$", "''"), (r"\n{3,}", "chr(10) || chr(10)")):
        column = f"regexp_replace({column}, '{pattern}', {new}, 'g')"
    return _strip(column)


@registered(f"select doc_id, {_html()} as text from documents")
def html_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", html_text(F.col("text")).alias("text"))


_HELD = _strip("acc.held || ' ' || x.text")
_FULL = f"(acc.held <> '' and (x.fresh or ({_estimate(_HELD)}) > 64))"


@registered(f"""
with c1 as (select id, text, string_split(regexp_replace(text, '([.!?…])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) as own from chunks where text is not null),
c2 as (select id, text, own, flatten(list_transform(own, lambda q: case when ({_estimate('q')}) > 64 then list_transform({_words('q')}, lambda w, i: {{'t': w, 'f': i = 1}}) else [{{'t': q, 'f': false}}] end)) as units from c1),
c3 as (select id, text, own, list_reduce(list_transform(units, lambda y: {{'done': []::varchar[], 'held': '', 'text': y.t, 'fresh': y.f}}),
  lambda acc, x: {{'done': case when {_FULL} then list_append(acc.done, acc.held) else acc.done end, 'held': case when {_FULL} or acc.held = '' then x.text else {_HELD} end, 'text': '', 'fresh': false}},
  {{'done': []::varchar[], 'held': '', 'text': '', 'fresh': false}}) as r from c2),
c4 as (select id, list_filter(case when ({_estimate('text')}) > 64 then list_append(r.done, r.held) when len(own) > 1 then [{_strip("array_to_string(own, ' ')")}] else [text] end, lambda x: x <> '') as pieces from c3)
select id, len(pieces) as pieces, md5(array_to_string(pieces, chr(1))) as digest from c4""")
def long_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    pieces = table(spark, folder, "chunks", "id", "text").where("text is not null").select("id", chunking.split_long(F.col("text"), 64).alias("p"))
    return pieces.select("id", F.size("p").cast("bigint").alias("pieces"), F.md5(F.array_join("p", "\x01")).alias("digest"))


# Vectors


@registered("select id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm from chunks where embedding is not null")
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "embedding").where("embedding is not null").select("id", F.round(search.norm(F.col("embedding")), 4).alias("norm"))


@registered("""
with v as (select id, embedding[1:32] as e from chunks where embedding is not null and len(embedding) >= 32),
n as (select id, e, sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) as len from v)
select id, round((e[1]::double / case when len = 0 then 1 else len end)::float::double, 4) + 0.0 as first_value, round((e[32]::double / case when len = 0 then 1 else len end)::float::double, 4) + 0.0 as last_value from n""")
def vectors_truncated(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "id", "embedding").where("embedding is not null and size(embedding) >= 32")
    short = chunks.select("id", search.truncated(F.col("embedding"), 32).alias("v"))
    return short.select("id", (F.round(F.col("v")[0].cast("double"), 4) + 0.0).alias("first_value"), (F.round(F.col("v")[31].cast("double"), 4) + 0.0).alias("last_value"))


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The embedding of the first chunk of length 64: the query of the examples below."""
    return table(spark, folder, "chunks", "id", "embedding").where("size(embedding) = 64").orderBy("id").limit(1).collect()[0]["embedding"]


_VECTOR = """q as (select embedding::double[] as e from chunks where len(embedding) = 64 order by id limit 1),
vs as (select id, list_dot_product(c.embedding::double[], q.e) as s from chunks c, q where len(c.embedding) = 64)"""


@registered(f"with {_VECTOR} select id, round(s, 4) as vector_score, (row_number() over (order by s desc, id))::int as vector_rank from vs order by s desc, id limit 20")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    top = search.vector_top(table(spark, folder, "chunks", "id", "embedding"), _query_vector(spark, folder), 20)
    return top.select("id", F.round("vector_score", 4).alias("vector_score"), "vector_rank")


@registered("""
with q as (select d.collection, min(c.id) as query_id from chunks c join documents d on c.document_id = d.doc_id where c.embedding is not null group by 1),
v as (select query_id, embedding from q join chunks on id = query_id),
s as (select query_id, c.id, list_dot_product(c.embedding::double[], v.embedding::double[]) as s from chunks c join v on len(c.embedding) = len(v.embedding))
select query_id, id, (row_number() over (partition by query_id order by round(s, 9) desc, id))::int as vector_rank from s qualify vector_rank <= 5""")
def vector_topk_each(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "id", "document_id", "embedding").where("embedding is not null")
    docs = table(spark, folder, "documents", "doc_id", "collection")
    first = chunks.join(docs, F.col("document_id") == F.col("doc_id")).groupBy("collection").agg(F.min_by(F.struct("id", "embedding"), "id").alias("q"))
    return search.vector_top_each(chunks, first.select(F.col("q.id").alias("query_id"), F.col("q.embedding").alias("vector")), 5).select("query_id", "id", "vector_rank")


# Words

_TOKENS = r"""
t as (select id, unnest(list_concat(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*'), regexp_extract_all(lower(coalesce(section_title, '')), '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*'))) as term from chunks),
f as (select id, term, count(*) as tf from t group by all),
n as (select c.id, coalesce(sum(tf), 0) as n from chunks c left join f using (id) group by 1),
a as (select count(*) as chunks, avg(n) as mean from n),
df as (select term, count(*) as df from f group by 1)"""
_BM25 = f"""{_TOKENS},
b as (select f.id, sum(greatest(ln((chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as s
  from f join df using (term) join n using (id), a where term in ('loose', 'torque', 'cassette') group by 1)"""


def _index(spark: SparkSession, folder: str, stemmed: bool = False) -> search.WordIndex:
    return search.word_index(table(spark, folder, "chunks", "id", "text", "section_title"), stemmed=stemmed)


@registered(f"with {_TOKENS} select term, df from df")
def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return search.document_frequencies(table(spark, folder, "chunks", "id", "text", "section_title"))


@registered(f"with {_TOKENS} select chunks, round(mean, 6) as mean_length from a")
def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).stats().select("chunks", F.round("mean_length", 6).alias("mean_length"))


@registered(f"with {_BM25} select id, round(s, 6) as bm25, (row_number() over (order by round(s, 9) desc, id))::int as keyword_rank from b order by round(s, 9) desc, id limit 20")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    top = search.keyword_top(_index(spark, folder), SEARCHED, 20)
    return top.select("id", F.round("bm25", 6).alias("bm25"), "keyword_rank")


@registered(f"with {_BM25} select b.id, d.collection, round(s, 6) as bm25 from b join chunks c on c.id = b.id join documents d on d.doc_id = c.document_id where d.collection in ('household', 'bike-repair')")
def bm25_in_collections(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "collection").where(F.col("collection").isin("household", "bike-repair"))
    chunks = table(spark, folder, "chunks", "id", "document_id").join(docs, F.col("document_id") == F.col("doc_id"))
    return search.keyword_scores(_index(spark, folder), SEARCHED).join(chunks, "id").select("id", "collection", F.round("bm25", 6).alias("bm25"))


@registered()
def bm25_stemmed_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.keyword_top(_index(spark, folder, stemmed=True), "loosened torques of the cassettes", 20)


_FUSED = f"""with {_VECTOR}, {_BM25},
v as (select id, s as vector_score, row_number() over (order by s desc, id) as vr from vs order by s desc, id limit 40),
k as (select id, row_number() over (order by round(s, 9) desc, id) as kr from b order by round(s, 9) desc, id limit 40),
u as (select id, vector_score, vr, kr, coalesce(1 / (60.0 + vr), 0) + coalesce(1 / (60.0 + kr), 0) as fused from v full join k using (id)),
top as (select *, row_number() over (order by fused desc, vr nulls last, kr nulls last) as rank from u order by fused desc, vr nulls last, kr nulls last limit 10)"""


@registered(f"""{_FUSED}
select rank::int as rank, chunk_id, d.collection, source_path, source_name, seq, page_start, page_end, section_title, round(fused, 6) as score, round(vector_score, 4) as vector_score, kr::int as keyword_rank
from top join chunks c using (id) join documents d on d.doc_id = c.document_id""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    found = search.search(chunks, docs, _index(spark, folder), SEARCHED, _query_vector(spark, folder), k=10)
    return found.drop("text", "heading_path", "tags")


@registered(f"with {_BM25}, k as (select id, row_number() over (order by round(s, 9) desc, id) as kr from b order by round(s, 9) desc, id limit 10) select chunk_id, kr::int as rank, round(1 / (60.0 + kr), 6) as score from k join chunks c using (id)")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    return search.search(chunks, docs, _index(spark, folder), SEARCHED, None, k=10, mode="keyword").select("chunk_id", "rank", "score")


@registered(f"with {_VECTOR} select chunk_id, (row_number() over (order by s desc, id))::int as rank, round(s, 6) as score from vs join chunks c using (id) order by s desc, id limit 10")
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    return search.search(chunks, docs, None, "by vector", _query_vector(spark, folder), k=10, mode="vector").select("chunk_id", "rank", "score")


@registered(f"""
with {_BM25}, k as (select id, row_number() over (order by round(s, 9) desc, id) as kr from b order by round(s, 9) desc, id limit 10)
select kr::int as rank, chunk_id, '[' || kr || '] ' || d.source_name || case when coalesce(page_start, 0) <> 0 then ', p.' || page_start || case when coalesce(page_end, 0) <> 0 and page_end <> page_start then '–' || page_end else '' end else '' end
  || case when len(heading_path) > 0 then ' › ' || array_to_string(heading_path, ' › ') else '' end || ' (' || chunk_id || ')' || chr(10) || '    '
  || replace(case when length(c.text) > 400 then substr(c.text, 1, 400) || '…' else c.text end, chr(10), chr(10) || '    ') as shown
from k join chunks c using (id) join documents d on d.doc_id = c.document_id""")
def hits_as_text(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    return search.rendered(search.search(chunks, docs, _index(spark, folder), SEARCHED, None, k=10, mode="keyword"))


@registered("""
with o as (select document_id, seq from chunks where chunk_id = (select max(chunk_id) from chunks))
select c.chunk_id, c.seq, d.collection, d.source_path, 0.0::double as score from chunks c join o on c.document_id = o.document_id and abs(c.seq - o.seq) <= 2 join documents d on d.doc_id = c.document_id""")
def read_chunk(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    last = chunks.agg(F.max("chunk_id")).collect()[0][0]
    return search.read_window(chunks, docs, last, 2).select("chunk_id", "seq", "collection", "source_path", "score")


@registered("""
select id, document_id, seq, count(*) over w as n_around, min(seq) over w as first_seq, max(seq) over w as last_seq from chunks
window w as (partition by document_id order by seq range between 1 preceding and 1 following)""")
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    return search.windows(table(spark, folder, "chunks", "id", "document_id", "seq")).withColumn("n_around", F.col("n_around").cast("bigint"))


# Listings and counters


@registered("""
select c.name, embedder, dim, count(distinct doc_id) as documents, coalesce(sum(total_chunks), 0)::bigint as chunks
from collections c left join documents d on d.collection = c.name group by all""")
def collections_summary(spark: SparkSession, folder: str) -> DataFrame:
    return listing.collections_summary(table(spark, folder, "collections"), table(spark, folder, "documents", "doc_id", "collection", "total_chunks"))


@registered("select collection, source_name, source_path, total_pages, total_chunks, ocr_used, ocr_pages_skipped, array_to_string(tags, ',') as tags from documents")
def documents_listing(spark: SparkSession, folder: str) -> DataFrame:
    return listing.documents_listing(table(spark, folder, "documents")).withColumn("tags", F.array_join("tags", ","))


@registered("select string_agg(distinct embedder, ',' order by embedder) as embedders from collections")
def distinct_embedders(spark: SparkSession, folder: str) -> DataFrame:
    return listing.embedders(table(spark, folder, "collections")).select(F.array_join("embedders", ",").alias("embedders"))


_DELIVERED = "i as (select distinct * from ingests)"


@registered(f"with {_DELIVERED} select status, count(*) as n from i group by status")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return changes.histogram(table(spark, folder, "ingests").distinct())


@registered(f"""with {_DELIVERED} select collection, count(*) as outcomes, count(*) filter (where status = 'failed') as failed, coalesce(sum(chunk_count), 0)::bigint as chunks, coalesce(sum(page_count), 0)::bigint as pages,
coalesce(sum(ocr_pages_skipped), 0)::bigint as pages_skipped, count(*) filter (where coalesce(error, '') <> '') as errors from i group by collection""")
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return table(spark, folder, "ingests").distinct().groupBy("collection").agg(
        F.count("*").alias("outcomes"), F.count_if(F.col("status") == "failed").alias("failed"), total("chunk_count").alias("chunks"), total("page_count").alias("pages"),
        total("ocr_pages_skipped").alias("pages_skipped"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


@registered("select document_id, min(page_start) as first_page, max(page_end) as last_page, count(*) as chunks, max(seq) - min(seq) + 1 - count(*) as missing from chunks group by document_id")
def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    missing = (F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("missing")
    return table(spark, folder, "chunks", "document_id", "seq", "page_start", "page_end").groupBy("document_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.count("*").alias("chunks"), missing)


@registered("select d.doc_id, d.total_chunks, count(c.id) as stored from documents d left join chunks c on c.document_id = d.doc_id group by all having count(c.id) <> d.total_chunks")
def chunk_count_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "chunks", "document_id").groupBy("document_id").agg(F.count("*").alias("n"))
    docs = table(spark, folder, "documents", "doc_id", "total_chunks").join(stored, F.col("doc_id") == F.col("document_id"), "left")
    return docs.select("doc_id", "total_chunks", F.coalesce("n", F.lit(0)).alias("stored")).where("stored <> total_chunks")


# Change data

_HASH = "'sha256:' || lower(regexp_replace(regexp_replace(lower(trim(source_hash)), '^\\s*sha-?256\\s*[:= ]?\\s*', ''), '[^0-9a-f]', '', 'g'))"


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """What a second ingest brings: every document with its hash in plain form and its language as a tag, and exported items that are no longer stored."""
    docs = table(spark, folder, "documents", "collection", "source_path", "source_hash", "lang", "tags")
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim("source_hash")), r"^\s*sha-?256\s*[:= ]?\s*", ""), "[^0-9a-f]", "")
    tags = F.when(F.col("lang").isNull(), F.array().cast("array<string>")).when(F.col("lang") == "en", F.col("tags")).otherwise(F.concat("tags", F.array("lang")))
    again = docs.select("collection", "source_path", F.concat(F.lit("sha256:"), bare).alias("source_hash"), tags.alias("tags"))
    items = table(spark, folder, "exports", "collection", F.col("item").alias("source_path")).distinct().join(docs.select("collection", "source_path"), changes.KEY, "left_anti")
    return again.unionByName(items.select("collection", "source_path", F.lit("sha256:new").alias("source_hash"), F.array().cast("array<string>").alias("tags")))


@registered(f"""
with n as (select collection, source_path, {_HASH} as h, case when lang is null then []::varchar[] when lang = 'en' then tags else list_concat(tags, [lang]) end as t from documents
  union all select distinct e.collection, e.item, 'sha256:new', []::varchar[] from exports e where not exists (select 1 from documents d where d.collection = e.collection and d.source_path = e.item))
select n.collection, n.source_path, case when d.doc_id is null then 'added' when d.source_hash = n.h then case when len(n.t) > 0 and list_sort(n.t) <> list_sort(d.tags) then 'retagged' else 'unchanged' end else 'updated' end as status,
  array_to_string(case when len(n.t) > 0 then n.t else coalesce(d.tags, []) end, ',') as tags, d.total_chunks as old_chunks
from n left join documents d on d.collection = n.collection and d.source_path = n.source_path""")
def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    decided = changes.decide(_incoming(spark, folder), table(spark, folder, "documents", "collection", "source_path", "source_hash", "tags", "total_chunks"))
    return decided.select("collection", "source_path", "status", F.array_join("tags", ",").alias("tags"), "old_chunks")


@registered("""
with l as (select * from ingests qualify row_number() over (partition by collection, source_path order by happened_at desc, ingest_id desc) = 1)
select d.doc_id, d.total_chunks from documents d where starts_with(source_path, 'sql:') and not exists (select 1 from l where l.collection = d.collection and l.source_path = d.source_path and l.status in ('added', 'unchanged', 'retagged'))""")
def sync_removed(spark: SparkSession, folder: str) -> DataFrame:
    newest = Window.partitionBy(*changes.KEY).orderBy(F.desc("happened_at"), F.desc("ingest_id"))
    last = table(spark, folder, "ingests").withColumn("n", F.row_number().over(newest)).where("n = 1 and status in ('added', 'unchanged', 'retagged')")
    return changes.removed(last, table(spark, folder, "documents", "doc_id", "collection", "source_path", "total_chunks"), "sql:").select("doc_id", "total_chunks")


# Exports


@registered("""
with b as (select distinct target, collection, item from exports)
select * from b where not exists (select 1 from documents d where d.collection = b.collection and d.source_path = b.item)
and not exists (select 1 from b o where o.target = b.target and o.item = b.item and o.collection <> b.collection)""")
def export_diff(spark: SparkSession, folder: str) -> DataFrame:
    current = table(spark, folder, "documents", "collection", F.col("source_path").alias("item"))
    return exporting.gone(table(spark, folder, "exports"), current)


_BOOK = r"""
n as (select collection, source_path, regexp_replace(regexp_replace(regexp_replace(source_name, '(.)\.(?i:pdf|epub|fb2|o?xps|docx|html?|txt|text|md|markdown|rst)$', '\1'), '(?i)\.(pdf|txt|epub)$', ''), '[_-]+', ' ', 'g') as a from documents),
m as (select *, trim(regexp_replace(regexp_replace(a, '(?i)\bv?[0-9]+(?:\.[0-9]+)+\b', '', 'g'), '[{WS}]+', ' ', 'g')) as b from n),
x as (select *, coalesce(nullif(array_to_string(list_transform(string_split(b, ''), lambda c, i: case when regexp_matches(c, '[a-z]') and (i = 1 or not regexp_matches(b[i - 1:i - 1], '[A-Za-z0-9_]')) then upper(c) else c end), ''), ''), 'Untitled') as book from m)"""


@registered(rf"""
with {_BOOK}
select collection, source_path, book, case when regexp_matches(lower(book), 'adventure|module|campaign|curse|descent|tomb|lost mine|dragon of') then 'adventure' else 'sourcebook' end as category,
  case when regexp_matches(book, '(?i)^(homebrew|srd(\s*5(\.[12])?(\.1)?)?)$') then 'reserved' when row_number() over (partition by collection, book order by source_path) > 1 then 'duplicate' end as skipped from x""")
def export_books(spark: SparkSession, folder: str) -> DataFrame:
    return exporting.books(table(spark, folder, "documents", "collection", "source_path", "source_name").where("source_name is not null")).drop("source_name")


@registered("""
select d.collection, d.source_path, c.seq, c.chunk_id, c.token_count, '[' || array_to_string(list_transform(c.embedding, lambda x: printf('%.7g', x::double)), ',') || ']' as embedding
from chunks c join documents d on d.doc_id = c.document_id""")
def export_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = exporting.scan(table(spark, folder, "chunks"), table(spark, folder, "documents"))
    return found.select("collection", "source_path", "seq", "chunk_id", "token_count", exporting.vector_literal(F.col("embedding")).alias("embedding"))


@registered("select collection, count(distinct source_path) as documents, count(*) as chunks from chunks c join documents d on d.doc_id = c.document_id group by collection")
def export_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = exporting.scan(table(spark, folder, "chunks"), table(spark, folder, "documents"), ordered=False)
    return found.groupBy("collection").agg(F.countDistinct("source_path").alias("documents"), F.count("*").alias("chunks"))


@registered(f"""
with {_BM25}, k as (select id, row_number() over (order by round(s, 9) desc, id) as kr from b order by round(s, 9) desc, id limit 10)
select to_json({{'rank': kr::int, 'chunk_id': chunk_id, 'collection': d.collection, 'source_path': source_path, 'source_name': source_name, 'seq': seq, 'text': c.text, 'page_start': page_start, 'page_end': page_end, 'section_title': section_title,
  'heading_path': heading_path, 'score': round(1 / (60.0 + kr), 6), 'vector_score': null, 'keyword_rank': kr::int, 'tags': tags}})::varchar as value from k join chunks c using (id) join documents d on d.doc_id = c.document_id""")
def hits_as_json(spark: SparkSession, folder: str) -> DataFrame:
    chunks, docs = table(spark, folder, "chunks"), table(spark, folder, "documents")
    return exporting.as_json(search.search(chunks, docs, _index(spark, folder), SEARCHED, None, k=10, mode="keyword"))


@registered("select doc_id, source_path from documents where source_path = (select min(source_name) from documents) or source_name = (select min(source_name) from documents)")
def documents_matched(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source_path", "source_name")
    source = docs.agg(F.min("source_name")).collect()[0][0]
    return docs.where(listing.matches(source, F.col("source_path"), F.col("source_name"))).select("doc_id", "source_path")


@registered("select d.doc_id, d.collection from documents d join collections c on c.name = d.collection where c.embedder = (select min(embedder) from collections)")
def searchable_documents(spark: SparkSession, folder: str) -> DataFrame:
    collections = table(spark, folder, "collections")
    embedder = collections.agg(F.min("embedder")).collect()[0][0]
    return table(spark, folder, "documents", "doc_id", "collection").where(F.col("collection").isin(listing.searchable(collections, embedder)))


@registered(r"""
select c.id, regexp_replace(d.source_name, '\.[^.]+$', '') || '_chunk_' || case when length((seq + 1)::varchar) >= greatest(3, length(d.total_chunks::varchar)) then (seq + 1)::varchar else lpad((seq + 1)::varchar, greatest(3, length(d.total_chunks::varchar))::int, '0') end as chunk_id,
  d.source_name as source_file, coalesce(heading_path[-1], '') as section, array_to_string(heading_path, ' › ') as path, seq + 1 as chunk_index, d.total_chunks, page_start, page_end, 'kept' as tags
from chunks c join documents d on c.document_id = d.doc_id""")
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", F.col("doc_id").alias("document_id"), "source_name", "total_chunks")
    chunks = table(spark, folder, "chunks", "id", "document_id", "seq", "text", "token_count", "page_start", "page_end", "heading_path").join(docs, "document_id")
    m = "metadata."
    return exporting.with_metadata(chunks, ("kept",), "id").select(
        "id", "chunk_id", m + "source_file", F.col(m + "section_title").alias("section"), F.array_join(m + "heading_path", fn.PATH_MARK).alias("path"), m + "chunk_index", m + "total_chunks", m + "page_start", m + "page_end", F.array_join(m + "custom_tags", ",").alias("tags"),
    )


@registered("""
select 'household' as collection, c.chunk_id, d.source_name, d.source_path, md5(coalesce(c.text, '')) as digest, coalesce(c.token_count, 0) as token_count, c.page_start, c.page_end, coalesce(c.section_title, '') as section_title,
  to_json(coalesce(heading_path, []))::varchar as heading_path, to_json(coalesce(tags, []))::varchar as tags, 'e' as embedder, '[' || array_to_string(list_transform(c.embedding, lambda x: printf('%.7g', x::double)), ',') || ']' as embedding
from chunks c join documents d on d.doc_id = c.document_id where d.collection = 'household' and c.embedding is not null""")
def export_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = exporting.table_rows(table(spark, folder, "chunks"), table(spark, folder, "documents"), "household", "e")
    return rows.select("*", F.md5("content").alias("digest")).drop("content")


@registered(rf"""
with {_BOOK},
k as (select *, regexp_matches(book, '(?i)^(homebrew|srd(\s*5(\.[12])?(\.1)?)?)$') as reserved, row_number() over (partition by collection, book order by source_path) as n from x)
select 'u' || '' as owner, c.chunk_id, k.book as source_book, case when regexp_matches(lower(k.book), 'adventure|module|campaign|curse|descent|tomb|lost mine|dragon of') then 'adventure' else 'sourcebook' end as category,
  nullif(c.section_title, '') as section_title, c.token_count, md5(c.text) as digest
from chunks c join documents d on d.doc_id = c.document_id join k on k.collection = d.collection and k.source_path = d.source_path where not k.reserved and k.n = 1""")
def library_rows(spark: SparkSession, folder: str) -> DataFrame:
    named = exporting.books(table(spark, folder, "documents", "collection", "source_path", "source_name").where("source_name is not null")).where("skipped is null").select("collection", "source_path", "book", "category")
    found = exporting.scan(table(spark, folder, "chunks"), table(spark, folder, "documents"), ordered=False).join(named, ["collection", "source_path"])
    rows = exporting.library_rows(found, "00000000-0000-4000-8000-000000000001", F.col("book"), F.col("category"))
    return rows.select(F.lit("u").alias("owner"), "chunk_id", "source_book", "category", "section_title", "token_count", F.md5("content").alias("digest"))


@registered("""
with m as (select document_id as doc_id, count(*) as chunks, sum(token_count)::bigint as tokens, min(page_start) as first_page, max(page_end) as last_page from chunks group by 1)
select collection, source_path, source_name, total_pages, ocr_used = 1 as ocr_used, coalesce(chunks, 0) as chunks, coalesce(tokens, 0) as tokens, first_page, last_page from documents left join m using (doc_id)""")
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = exporting.manifest(table(spark, folder, "chunks"), table(spark, folder, "documents"))
    return found.select("collection", "source_path", "source_name", "total_pages", "ocr_used", "chunks", "tokens", "first_page", "last_page")


@registered()
def hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embed(table(spark, folder, "chunks", "id", "text"), HashingEmbedder(64), "text").select("id", "embedding")
