"""SQL for DuckDB of the queries that SQL can express; each works on whole tables.

Without SQL, and tested against brute force, exact round trips or another
implementation instead: p2 (found by hashing, with a recall), p1 (lines of pages told by their titles), p3_pieces and
p7 (sequential cuts and a tokenizer), p6 (a tokenizer), p8_canonical.
"""

from __future__ import annotations

from bookwright.llm.lookalikes import CYRILLIC, GREEK, SIGNS

_WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_N_WORDS = f"len(regexp_extract_all(text, '[^{_WS}]+'))"


def _leaf(column: str) -> str:
    return f"replace(replace(lower(regexp_replace({column}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"


# Copies as TESTDATA.md states them: the letters and digits, or all fields of a record as pairs of name and value in any order.
_COPIES = rf"""
k as (select distinct id, text, {_leaf('text')} as plain from chunks where id is not null and text is not null),
f as (select id, plain, list_filter(regexp_split_to_array(text, '[\r\n\x{{85}}\x{{2028}}\x{{2029}}]+| \| |; '), lambda p: length(trim(p)) > 0) as parts from k where plain <> ''),
r as (select id, plain, case when len(parts) > 1 and list_bool_and(list_transform(parts, lambda p: regexp_matches(split_part(p, ':', 1), '[\p{{L}}\p{{N}}]') and contains(p, ':')))
  then list_sort(list_transform(parts, lambda p: {{'name': {_leaf("split_part(p, ':', 1)")}, 'value': {_leaf("substr(p, strpos(p, ':') + 1)")}}}))::varchar else 'text ' || id end as rec from f),
a as (select *, min(id) over (partition by plain) as m from r),
b as (select *, min(m) over (partition by rec) as m2 from a),
c as (select *, min(m2) over (partition by plain) as m3 from b),
g as (select id, min(m3) over (partition by rec) as first_id from c)"""
_HASHES = r"""
h as (select distinct doc_id, regexp_replace(regexp_replace(lower(trim(source_hash)), '^\s*sha[-_ ]?256\s*[:= ]?\s*', ''), '[^0-9a-z]', '', 'g') as key from documents where doc_id is not null),
d as (select doc_id, min(doc_id) over (partition by key) as first_id from h where regexp_matches(key, '^[0-9a-f]{64}$'))"""

_RUNS = f"""
w as (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from chunks where text is not null),
r as (select distinct id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from w where len(w) > 2),
z as (select id, count(*) as n from r group by id),
p as (select a.id as a, b.id as b, count(*) as common from r a join r b on a.run = b.run and a.id < b.id group by all)"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_BLANKS = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_FROM = _WIDE + CYRILLIC[0] + GREEK[0] + "".join(SIGNS) + _BLANKS
_TO = "".join(map(chr, range(0x21, 0x7F))) + CYRILLIC[1] + GREEK[1] + "".join(SIGNS.values()) + " " * len(_BLANKS)


def _look(column: str) -> str:
    bare = f"regexp_replace(nfc_normalize({column}), '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ё", "ë"), ("Ё", "Ë"), ("ї", "ï"), ("Ї", "Ï")):
        bare = f"replace({bare}, '{joined}', '{letters}')"
    quoted = [x.replace("'", "''") for x in (_FROM, _TO)]
    return f"nfc_normalize(translate({bare}, '{quoted[0]}', '{quoted[1]}'))"


_BLANK = f"regexp_replace(look, '[{_WS}]+', '', 'g') <> ''"

SQL = {
    "p3_found": f"select distinct id from chunks where id is not null and {_N_WORDS} > 0 and greatest(1, length(text) // 4, {_N_WORDS} * 13 // 10) > 512",
    "p4_found": f"with {_COPIES}, {_HASHES} select 'chunks' as rec, first_id, id as copy_id from g where id <> first_id union all select 'documents', first_id, doc_id from d where doc_id <> first_id",
    "p4_records": f"with {_COPIES} select first_id, count(*) as copies from (select distinct i.id, coalesce(g.first_id, i.id) as first_id from chunks i left join g on g.id = i.id where i.id is not null) group by first_id",
    "p5_found": f"""with {_COPIES}, {_RUNS.replace("r as (", "runs as (").replace("from r ", "from runs ").replace("join r ", "join runs ")}
select p.a as id_a, p.b as id_b from p join z x on x.id = p.a join z y on y.id = p.b join g u on u.id = p.a join g v on v.id = p.b where common * 2 >= x.n + y.n - common and u.first_id <> v.first_id""",
    "p8_found": f"""with l as (select doc_id, text, {_look('text')} as look from documents where text is not null)
select a.doc_id as doc_a, b.doc_id as doc_b from l a join l b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text where trim(a.look) <> ''""",
    "p8_looks": f"""with l as (select doc_id, text, {_look('text')} as look from documents where text is not null)
select doc_id, min(doc_id) over (partition by look) as group_id, dense_rank() over (partition by look order by text) + dense_rank() over (partition by look order by text desc) - 1 as texts from l where {_BLANK}""",
}
