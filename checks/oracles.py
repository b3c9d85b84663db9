"""SQL for every registered query, for a database that has the tables as views."""

from __future__ import annotations

from checks import text_sql as Q

ORACLES: dict[str, str] = {}


def text(stage: str, select: str) -> str:
    return f"{Q.upto(stage)} {select}"


def whole(cte: str) -> str:
    return f"select slot, string_agg(line, chr(10) order by n) as text from {cte} group by slot"


# every document keeps a row, even one whose text became empty
def whole_of(stage: str, cte: str) -> str:
    return text(stage, f"select d.slot, coalesce(t.text, '') as text from docs d left join ({whole(cte)}) t using (slot)")


SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
FIRST_LINE = "string_split(text, chr(10))[1]"
STOP = "'the','and','with','for','series','edition','wiley','press','ieee','inc','compress','analysis','vol'"

ORACLES["distinct_files"] = """
with f as (
  select source || case when doc_id % 2 = 0 then '-b/' else '/' end || (doc_id % 7) || '/' as folder,
    case when doc_id % 11 = 0 then '~' else '' end || upper(lang) || (n_chars % 50) || '.pdf' as name, n_chars % 90 as length
  from documents)
select length, lower(name) as name, arg_min(folder || name, string_split(folder || name, '/')) as path
from f where name not like '~%' group by length, lower(name)"""

ORACLES["formfeed_pages"] = """
select doc_id as pdf, (3 + n - 1)::int as page, md5(t) as text_md5
from documents, unnest(string_split(text, chr(10))) with ordinality as u(t, n)"""

ORACLES["page_source"] = """
with v as (
  select doc_id // 500 as volume, string_split(string_agg(coalesce(text, '') || chr(12), '' order by doc_id), chr(12)) as pages
  from documents group by 1)
select volume, i::int as page, md5(pages[i]) as text_md5, null::varchar as error from (select volume, pages, unnest(range(1, len(pages))) as i from v)"""

ORACLES["page_marker_render"] = """
select doc_id, '[PAGE ' || (doc_id + length(source)) || ']' || chr(10) || rtrim(text, ' ' || chr(10)) || chr(10) as rendered
from documents"""

ORACLES["split_pages"] = text("pages", """
select slot, page, (count(*) - max((page is not null)::int))::int as n_lines,
  md5(coalesce(string_agg(line, chr(10) order by n) filter (num is null), '')) as lines_md5
from paged group by slot, page""")

ORACLES["limit_per_group"] = """
select source, doc_id from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 5"""

ORACLES["migrate_upsert"] = """
select doc_id as id, case when lang <> 'fr' then md5(text) else 'old' end as payload from documents"""

ORACLES["slug"] = f"select p_partkey, {SLUG.format(x='p_name')} as slug from part"

ORACLES["short_key"] = f"""
with w as (
  select doc_id, {SLUG.format(x='text')} as s,
    list_filter(string_split({SLUG.format(x='text')}, '_'), lambda x: length(x) > 2
      and not regexp_full_match(x, '[0-9]+') and x not in ({STOP})) as words
  from documents)
select doc_id, left(case when len(words) > 0 then array_to_string(words[1:2], '_')
  when s = '' then 'doc' else left(s, 12) end, 24) as short_key from w"""

ORACLES["unique_key"] = f"""
with recursive w as (
  select doc_id, lpad(doc_id::varchar, 12, '0') as path, {SLUG.format(x="regexp_split_to_array(text, '[ \\n]+')[1]")} as s from documents),
wanted as (select path, case when doc_id % 3 = 0 then s || '_' || (doc_id % 4 + 2) else s end as base from w),
names as (select distinct base as name from wanted where length(base) % 2 = 0),
b as (
  select path, case when base = '' then 'doc' else base end as base, row_number() over (order by path) as i,
    (select count(*) from wanted o where starts_with(o.base, wanted.base)) + (select count(*) from names where starts_with(name, wanted.base)) as most
  from wanted),
walk(i, used, path, key) as (
  select 0::bigint, (select list(name) from names), null::varchar, null::varchar
  union all
  select i, list_append(used, k), path, k from (
    select b.i, used, b.path, case when not list_contains(used, base) then base else base || '_' || list_filter(
      range(2, most + 4), lambda n: not list_contains(used, base || '_' || n))[1] end as k
    from walk join b on b.i = walk.i + 1))
select path, key from walk where i > 0"""

ORACLES["article_key"] = f"""
with t as (select doc_id, lang, {SLUG.format(x=FIRST_LINE)} as s from documents)
select doc_id, {SLUG.format(x="'Vol ' || lang")} || '_' || case when doc_id < 100 then lpad(doc_id::varchar, 2, '0') else doc_id::varchar end
  || case when left(s, 24) <> '' then '_' || left(s, 24) else '' end as article_key from t"""

ORACLES["free_slots"] = """
with f as (
  select s, row_number() over (order by s) as k
  from (select unnest(range(0, (select count(*) + max(o_orderkey) + 1 from orders))) as s) anti join orders on o_orderkey = s),
c as (select lpad(c_custkey::varchar, 12, '0') as path, row_number() over (order by lpad(c_custkey::varchar, 12, '0')) as k from customer)
select path, s as slot from c join f using (k)"""

ORACLES["source_label"] = """
select page_id, array_to_string(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 1), ' / ') as label from pages"""

PDF = """
pdf_pages as (
  select lang as pdf, row_number() over (partition by lang order by doc_id)::int as page, text, n_chars, doc_id, source from documents),
toc as (
  select pdf, page as ord, case when n_chars > 3000 then 1 else 2 end as level,
    ' ' || string_split(text, chr(10))[1] || ' ' as title, page from pdf_pages where n_chars > 1000),
outline as (
  select pdf, ord, trim(title) as title, page from toc t
  where level = (select min(level) from toc u where u.pdf = t.pdf) and page > 0),
counts as (select lang as pdf, count(*)::int as page_count from documents group by lang),
spans as (
  select pdf, title, lo, hi, row_number() over (partition by pdf order by lo, ord)::int as nth from (
    select pdf, title, ord, page as lo, coalesce(lead(page) over (partition by pdf order by page, ord) - 1, page_count) as hi
    from outline join counts using (pdf)) where hi >= lo)"""

ORACLES["top_outline"] = f"with {PDF} select pdf, ord, title, page from outline"
ORACLES["article_spans"] = f"with {PDF} select pdf, title, lo, hi, nth from spans"
ORACLES["issue_classifier"] = """
with d as (select source || '-' || lang as pdf, doc_id, n_chars, string_split(text, chr(10))[1] as line from documents),
n as (select pdf, (count(*) + 70 + min(doc_id) % 15)::int as page_count from d group by pdf),
e as (select pdf, 1 + length(line) % 8 as level, n_chars % 5 as page from d),
m as (select pdf, count(*) filter (page > 0 and level = top) as marks from (select *, min(level) over (partition by pdf) as top from e) group by pdf)
select pdf, page_count, coalesce(marks, 0) as marks, page_count >= 80 and coalesce(marks, 0) >= 6 as is_issue from n left join m using (pdf)"""

ORACLES["page_titles"] = r"""
with l as (
  select lang as pdf, doc_id as page, format('{:.1f}', 40.05::double - least(length(t), 300) / 10.0::double)::double as size, ((n - 1) % 7)::double as x,
    round_even((n - 1) * 12.25::double, 0) as y, trim(t) as t
  from documents, unnest(string_split(text, chr(10))) with ordinality as u(t, n) where trim(t) <> ''),
s as (
  select pdf, page, size, trim(regexp_replace(string_agg(t, ' ' order by y, x, t), '\s+', ' ', 'g')) as title from l group by all)
select pdf, page, coalesce(arg_max(title, size) filter (length(title) between 12 and 300
  and not regexp_matches(title, '(?i)^ieee($|[^\p{L}\p{N}_])') and length(regexp_replace(title, '[^\p{L}]', '', 'g')) >= 10), '') as title
from s group by pdf, page"""

FOLIO = r"""
folio_lines as (
  select {key}, list_filter(list_transform(string_split({whole}, chr(10)), lambda l: trim(l)), lambda l: l <> '') as ls
  from {src}),
folio_numbers as (
  select distinct {key}, v from (
    select {key}, try_cast(w as int) as v from folio_lines,
      unnest(flatten(list_transform(list_concat(ls[1:4], ls[greatest(len(ls) - 2, 1):len(ls)]),
        lambda l: string_split(regexp_replace(l, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')))) as u(w)
    where regexp_full_match(w, '[0-9]{{1,5}}'))
  where v between 1 and 30000)"""

FOLIOED = "'Vol. 12, ' || (doc_id + 417) || chr(10) || text || chr(10) || 'April 2023 ' || (doc_id + 417) || ' 123456'"

ORACLES["folio_candidates"] = f"""with {FOLIO.format(key='doc_id', whole=FOLIOED, src='documents')}
select d.doc_id, coalesce(string_agg(v::varchar, ',' order by v), '') as folios
from documents d left join folio_numbers f on f.doc_id = d.doc_id group by d.doc_id"""

ORACLES["offset_vote"] = f"""
with p as (
  select source || '-' || lang as pdf, n_chars % 3 as r, coalesce(text, '') as text, row_number() over (partition by source, lang order by doc_id) as page from documents),
s as (
  select pdf, page, 'Proc. ' || case r when 0 then (page + 400)::varchar when 1 then (page + 100)::varchar else '' end || chr(10) || text as whole
  from p where page <= 8),
{FOLIO.format(key='pdf, page', whole='whole', src='s')},
n as (select pdf, v - page as o, count(*) as n from folio_numbers where v - page between -400 and 30000 group by all),
best as (select pdf, n, o from n qualify row_number() over (partition by pdf order by n desc, o) = 1)
select pdf, case when n >= 3 then o end::int as page_offset from (select distinct pdf from p) left join best using (pdf)"""

ORACLES["skip_titles"] = rf"""
with t as (
  select doc_id, source,
    case when lang = 'de' then 'Table of Contents ' when source = 'src3' then 'Guest Editorial: '
      when source = 'src4' then '2022 Index ' else '' end || {FIRST_LINE} as title,
    case when source = 'src5' then 'Front cover' else string_split(text, ' ')[1] end as bookmark
  from documents)
select doc_id, length(source) >= 2 and not regexp_matches(bookmark, '(?i)contents|cover|editorial|adverti|masthead|call[-_ ]?for|index|blank')
    and title <> '' and not regexp_matches(title, '(?i)^\s*(table of )?contents([^\p{{L}}\p{{N}}_]|$)|^\s*(guest )?editorial([^\p{{L}}\p{{N}}_]|$)|^\s*([0-9]{{4}} )?index([^\p{{L}}\p{{N}}_]|$)|^\s*cover([^\p{{L}}\p{{N}}_]|$)') as keep,
  source = 'src6' as volume_index
from t"""

ORACLES["register_merge"] = """
select lang || '/' || case when source = 'src7' then 'Index of Vol ' else 'd' end || doc_id || '.pdf' as path,
  case lang when 'fr' then 'known' when 'es' then 'moved' else case when source = 'src7' then 'index' else 'new' end end as status
from documents"""

ORACLES["shouty_prune"] = rf"""
with t as (
  select doc_id, case when lang = 'es' then 'book' else 'article' end as kind,
    list_filter(regexp_split_to_array(case when lang = 'de' then upper({FIRST_LINE}) else {FIRST_LINE} end, '\s+'), lambda w: length(w) > 2) as ws
  from documents)
select doc_id, kind from t where kind = 'book' or (len(ws) > 0
  and len(list_filter(ws, lambda w: regexp_matches(w, '\p{{Lu}}') and not regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]')))::double / len(ws) <= 0.6)"""

ORACLES["bad_records"] = """
select event_id, case when event_type = 'click' then 'ValueError: not a JSON object: ' || left(props, length(props) - 1) else '' end as error,
  case when event_type = 'click' then -1 else len(json_keys(props))::int end as fields from events"""

ORACLES["only_documents"] = "select doc_id, source as key from documents where source = 'src1' or source = 'src7'"

ORACLES["clean_signature"] = r"""
select doc_id, md5(text) || '|' || case when lang = 'fr' then '[]' else '[{"lo":1,"hi":' || (doc_id % 9) || '}]' end || '|'
  || case when lang = 'de' then (n_chars % 100)::varchar else 'None' end || '|' || md5('Downloaded from https://onlinelibrary\.wiley\.com') as signature
from documents"""

ORACLES["contents_pages"] = text("pages", "select slot, page, coalesce(contents_like, false) as contents_like from judged")
ORACLES["index_pages"] = text("pages", "select slot, page, coalesce(index_like, false) as index_like from judged")
ORACLES["body_pages"] = """
select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) > 88)) >= 3 as body_like from documents"""
ORACLES["front_matter"] = text("matter", "select d.slot, lo, hi from docs d left join front using (slot)")
ORACLES["back_matter"] = text("matter", "select d.slot, start from docs d left join back using (slot)")
ORACLES["auto_resolve"] = text("matter", "select slot, lo, hi, end_page as body_end_page from matter")

ORACLES["pages_in_span"] = f"""with {PDF}
select s.pdf || '_' || nth as key, p.page, (p.page + length(title))::int as printed, md5(text) as text_md5
from spans s join pdf_pages p on p.pdf = s.pdf and p.page between s.lo and s.hi"""

ORACLES["ocr_needed"] = text("pages", """
select slot as key, count(*) as pages, sum(chars)::bigint as chars, sum(chars) / count(*) < 120 as needs_ocr from (
  select slot, page, length(trim(coalesce(string_agg(line, chr(10) order by n) filter (num is null), ''), ' ' || chr(10))) as chars
  from paged group by slot, page) group by slot""")

ORACLES["extract_status"] = """
select doc_id::varchar as key, case
  when lang = 'es' then case when source not in ('src1', 'src2') then 'no pdf' else 'MISSING' end
  when source not in ('src1', 'src2', 'src3', 'src4') then 'cached'
  when source = 'src3' then 'adopted' when n_chars < 120 then 'NO TEXT LAYER' else 'extracted' end as status
from documents"""

ORACLES["content_hash"] = "select doc_id, md5(text) as hash from documents"

# ---- cleaning ---------------------------------------------------------------

ORACLES["trim_matter"] = text("trimmed", f"""
select d.slot, d.dropped::int as dropped, coalesce(t.text, '') as text from dropped d left join ({whole('trimmed')}) t using (slot)""")
ORACLES["normalize_text"] = text("lines0", """
select slot, replace(replace(string_agg(line, chr(10) order by n), chr(64257), 'fi'), chr(8217), '''') || '|' || (['''', '"', '"', '-', '-', '-', '-',
  '', '', '', ' ', ' ', '''', 'ff', 'ffi', 'A', '1', '2', 'TM', chr(956), chr(197), 'IJ', ' ', '...', 'D' || chr(381), 'm3'])[slot % 26 + 1] || '|' as text
from lines0 group by slot""")
ORACLES["is_prose"] = f"""
select doc_id, (n - 1)::int as n, coalesce({Q.prose('line')}, false) as prose,
  round(case when replace(line, ' ', '') = '' then 0 else {Q.letters('line')}::double / length(replace(line, ' ', '')) end, 9) as ratio
from documents, unnest(string_split(text, chr(10))) with ordinality as u(line, n)"""
ORACLES["banner_filter"] = whole_of("normed", "unbannered")
ORACLES["running_headers"] = text("swept", "select slot, h as header from headers")
ORACLES["page_furniture"] = whole_of("swept", "swept")
ORACLES["lift_captions"] = text("lifted", f"""
select d.slot, coalesce(moved, 0)::int as moved, coalesce(t.text, '') as text
from docs d left join captions using (slot) left join ({whole('lifted')}) t using (slot)""")
ORACLES["hyphen_lexicon"] = text("joined", "select slot, w as word from lexicon")
ORACLES["fix_hyphenation"] = text("joined", f"""
select d.slot, coalesce(j.joined, 0)::int as joined, coalesce(t.text, '') as text
from docs d left join (select slot, count(*) as joined from picked group by slot) j using (slot)
left join ({whole('joined')}) t using (slot)""")
ORACLES["drop_junk"] = whole_of("sound", "sound")
ORACLES["reflow"] = whole_of("flowed", "flowed")
ORACLES["collapse_blanks"] = whole_of("flowed", "cleanlines")
ORACLES["clean_text"] = text("flowed", "select slot, clean_text from cleaned")
ORACLES["clean_stats"] = text("flowed", f"""
select d.slot, (select count(*) from lines0 x where x.slot = d.slot)::int as lines_in, dropped::int as matter_dropped,
  ((select count(*) from normed x where x.slot = d.slot) - (select count(*) from unbannered x where x.slot = d.slot))::int as banners,
  (select count(*) from furniture x where x.slot = d.slot and gone)::int as furniture,
  coalesce((select moved from captions x where x.slot = d.slot), 0)::int as captions_moved,
  (select count(*) from picked x where x.slot = d.slot)::int as hyphens_joined,
  ((select count(*) from joined x where x.slot = d.slot) - (select count(*) from sound x where x.slot = d.slot))::int as junk,
  (select count(*) from cleanlines x where x.slot = d.slot)::int as lines_out,
  (select {Q.words('clean_text')} from cleaned x where x.slot = d.slot)::int as words_out,
  (select count(*) from cleanlines x where x.slot = d.slot and num is not null)::int as pages
from docs d join dropped using (slot)""")

# ---- sections and chunks ----------------------------------------------------

ORACLES["book_headings"] = text("lines0", rf"""
, g as (
  select slot, (n - 1)::int as n, kind,
    regexp_extract(trim(line), '^([0-9]{{1,2}})\.([0-9]{{1,2}})(?:\.([0-9]{{1,2}}))?\s+([A-Z].{{3,90}})$', ['a', 'b', 'c', 'title']) as h
  from lines0 join docs using (slot))
select slot, n, h.a::int as chapter, h.a || '.' || h.b || case when h.c <> '' then '.' || h.c else '' end as section,
  regexp_replace(trim(h.title), '\s+', ' ', 'g') as title
from g where kind <> 'article' and h.title <> '' and h.a::int between 1 and 20
  and not regexp_matches(trim(h.title), '\s[0-9]{{1,4}}$') and not trim(h.title) like '%,' and {Q.letters('h.title')} >= 4""")
ORACLES["parse_sections"] = text("blocks", """
select slot, chapter, section, section_title, b::int as b, text, page_start, page_end from blocks""")
ORACLES["paper_headings"] = text("blocks", """
select slot, chapter, section, section_title, count(*)::int as n_blocks from blocks
where kind = 'article' and section is not null group by slot, sec, chapter, section, section_title""")
ORACLES["token_count"] = f"select doc_id, ({Q.tokens('text')})::int as n_tokens from documents"
ORACLES["split_sentences"] = r"""
select doc_id, (n - 1)::int as n, md5(s) as sentence_md5
from documents, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) with ordinality as u(s, n)"""
ORACLES["pack_chunks"] = text("chunks", "select * from chunks")
ORACLES["chunk_ids"] = text("chunks", "select book, min(id) as first, max(id) as last, count(*) as n from chunks group by book")
ORACLES["token_quantiles"] = text("chunks", """
select count(*) as chunks, min(n_tokens) as min_tokens, list_sort(list(n_tokens))[count(*) // 2 + 1] as p50_tokens,
  list_sort(list(n_tokens))[floor(count(*) * 0.95::double)::int + 1] as p95_tokens, max(n_tokens) as max_tokens from chunks""")

# ---- maintenance ------------------------------------------------------------

ORACLES["stale_docs"] = "select 'doc_' || doc_id as key, md5(text) as sig from documents where lang in ('es', 'fr')"
ORACLES["stale_stages"] = f"""
select source || '-' || doc_id as key, lang = 'de' or lang = 'es' and upper(text) <> text as clean,
  lang = 'de' or lang = 'es' and upper(text) <> text or lang = 'fr' and string_split(text, chr(10))[1] <> 'old' as chunk
from documents"""

ORACLES["index_signature"] = """
with r as (
  select source as book, doc_id * 1000 + n - 1 as id,
    md5((doc_id * 1000 + n - 1)::varchar || chr(31) || line) as h
  from documents, unnest(string_split(text, chr(10))) with ordinality as u(line, n)),
s as (
  select book, min(id) // 1048576 as slot, count(*) as chunks,
    sum(('0x' || substr(h, 1, 15))::bigint::hugeint)::varchar || '-' || sum(('0x' || substr(h, 16, 15))::bigint::hugeint)::varchar as t
  from r group by book)
select book, slot, chunks, md5(t) || ':' || slot as sig from s"""
ORACLES["manifest_upsert"] = """
select doc_id as slot, 'doc_' || doc_id as key, case when lang = 'fr'
  then md5(array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ')) else 'old' end as sig from documents"""
ORACLES["replace_document"] = """
select conv_id as book, turn as id, text from conversations
where conv_id not in (select conv_id from conversations where text like '%tion%')
union all select conv_id, turn, upper(text) from conversations where text like '%tion%'"""
ORACLES["upsert_points"] = """
select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1"""
ORACLES["remove_document"] = """
select doc_id as id, source as book from documents
where source not in (select source from documents group by source having sum(n_chars) % 2 = 0)"""
ORACLES["purgeable_files"] = "select distinct source || '/' || lang as pdf from documents where lang = 'de'"
LABEL = "array_to_string(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 1), ' / ')"
ORACLES["unregistered"] = f"""
select distinct {LABEL} as path from pages where {LABEL} not in (select {LABEL} from pages where contains(url, '/en/'))"""


# ---- retrieval --------------------------------------------------------------

TERMS = r"""
words as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents),
tf as (select id, ('0x' || left(md5(w), 8))::bigint as t, count(*) as n from words group by 1, 2),
qwords as (select item_id as qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from benchmark),
qtf as (select qid, ('0x' || left(md5(w), 8))::bigint as t, count(*) as n from qwords group by 1, 2),
vec as (select id, t % 64 as j, sum(case when (t >> 16) & 1 = 1 then n else -n end)::double as v from tf group by 1, 2),
qvec as (select qid, t % 64 as j, sum(case when (t >> 16) & 1 = 1 then n else -n end)::double as v from qtf group by 1, 2),
live as (select doc_id as id from documents where {live}),
sparse as (
  select qid, id, round(sum(d.n * q.n)::double, 6) as score from tf d join qtf q using (t)
  where id in (select id from live) group by qid, id),
norms as (select id, sum(v * v) as s from vec group by id),
qnorms as (select qid, sum(v * v) as s from qvec group by qid),
dots as (select qid, id, sum(d.v * q.v) as dot from vec d join qvec q using (j) where id in (select id from live) group by qid, id),
dense as (
  select b.qid, a.id, round(case when a.s * b.s > 0 then coalesce(dot, 0) / sqrt(a.s * b.s) else 0 end, 6) as score
  from qnorms b join norms a on a.id in (select id from live)
  left join dots d on d.qid = b.qid and d.id = a.id),
sparse_rank as (select *, row_number() over (partition by qid order by score desc, id) as rank from sparse),
dense_rank_ as (select *, row_number() over (partition by qid order by score desc, id) as rank from dense)"""


def terms(live: str = "true") -> str:
    return TERMS.replace("{live}", live)


def fused(n: int, limit: int) -> str:
    return f"""
branches as (
  select qid, id, rank from sparse_rank where rank <= {n} union all select qid, id, rank from dense_rank_ where rank <= {n}),
fused as (
  select * from (
    select *, row_number() over (partition by qid order by score desc, id) as rank from (
      select qid, id, sum(1.0::double / (60 + rank)) as score from branches group by qid, id)) where rank <= {limit})"""


OVERLAP = r"""
qset as (select distinct qid, w from qwords),
dset as (select distinct id, w from words),
overlap as (
  select f.qid, f.id, f.score, f.rank, count(dset.w)::double / count(*) as rerank_score
  from {hits} f join qset using (qid) left join dset on dset.id = f.id and dset.w = qset.w
  group by f.qid, f.id, f.score, f.rank),
reranked as (select qid, id, score, rerank_score, row_number() over (partition by qid order by rerank_score desc, rank) as rank from overlap)"""

KIND = "case lang when 'fr' then 'article' when 'de' then 'issue' else 'book' end"

ORACLES["embed_points"] = r"""
with words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents),
tf as (select doc_id, ('0x' || left(md5(w), 8))::bigint as t, count(*) as n from words group by 1, 2),
grid as (select doc_id, unnest(range(64)) as j from documents),
v as (select doc_id, t % 64 as j, sum(case when (t >> 16) & 1 = 1 then n else -n end) as v from tf group by 1, 2),
d as (select doc_id, string_agg(coalesce(v, 0)::int::varchar, ',' order by j) as dense from grid left join v using (doc_id, j) group by doc_id)
select doc_id, dense, coalesce(c, 0)::int as n_terms, coalesce(s, 0)::bigint as n_words
from d left join (select doc_id, count(*) as c, sum(n) as s from tf group by doc_id) using (doc_id)"""

ORACLES["dense_topk"] = """
with e as (select vec_id, label, unnest(embedding) as v, unnest(range(len(embedding))) as j from embeddings),
q as (select label as qid, j, avg(v::double) as m from e group by label, j),
qn as (select qid, sqrt(sum(m * m)) as n from q group by qid),
dn as (select vec_id, sqrt(sum(v::double * v::double)) as n from e group by vec_id),
s as (
  select qid, vec_id as id, round(sum(v::double * m) / any_value(qn.n) / any_value(dn.n), 6) as score
  from e join q using (j) join qn using (qid) join dn using (vec_id) group by qid, vec_id)
select qid::bigint as qid, id, score, rank from (
  select *, row_number() over (partition by qid order by score desc, id)::int as rank from s) where rank <= 10"""

ORACLES["sparse_topk"] = f"with {terms()} select qid, id, score, rank::int as rank from sparse_rank where rank <= 10"
ORACLES["dense_cells"] = ORACLES["dense_topk"]
ORACLES["sparse_blocks"] = ORACLES["sparse_topk"]
ORACLES["rrf_fusion"] = f"with {terms()}, {fused(30, 5)} select qid, id, round(score, 9) as score, rank::int as rank from fused"
ORACLES["hybrid_search"] = f"""with {terms()}, {fused(30, 30)}, {OVERLAP.format(hits='fused')}
select qid, id, 'doc_' || id as book, {KIND} as kind, round(score, 9) as score, round(rerank_score, 9) as rerank_score, rank::int as rank
from reranked join documents on doc_id = id where rank <= 5"""
ORACLES["filtered_search"] = f"""with {terms("lang = 'fr' and source = 'src3'")}, {fused(30, 5)}
select qid, id, 'doc_' || id as book, {KIND} as kind, round(score, 9) as score, rank::int as rank
from fused join documents on doc_id = id"""
ORACLES["rerank_topk"] = f"""with {terms()}, top as (select qid, id, score, rank from sparse_rank where rank <= 30),
{OVERLAP.format(hits='top')}
select qid, id, round(rerank_score, 9) as rerank_score, rank::int as rank from reranked where rank <= 3"""
ORACLES["source_match"] = rf"""
select page_id, {LABEL} as source from pages
where list_has_all(regexp_extract_all(lower({LABEL}), '[\p{{L}}\p{{N}}_]+'), ['example', 'en'])"""

CITE = """book_title || case when source <> '' then ' | ' || source else '' end || ' | '
  || case when coalesce(section, '') <> '' then 'S' || section || ' ' || section_title else section_title end || ' | '
  || case when page_start is not distinct from page_end then 'p.' || coalesce(page_start::varchar, 'None')
    else 'pp.' || coalesce(page_start::varchar, 'None') || '-' || coalesce(page_end::varchar, 'None') end"""
ORACLES["cite"] = text("chunks", f"select id, {CITE} as cite from chunks")
ORACLES["hit_preview"] = text("chunks", "select id, replace(left(text, 600), chr(10), ' ') || ' ...' as preview from chunks")
ORACLES["render_hits"] = f"""with {terms()}, {fused(30, 4)}, entries as (
  select qid, rank, '[' || rank || '] ' || array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ')
    || ' | Journal of Tests / ' || source || ' | abstract | p.1  (chunk_id=' || id || ')' || chr(10) || text as entry
  from fused join documents on doc_id = id)
select qid, coalesce(string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank), 'No passages matched that query.') as rendered
from (select item_id as qid from benchmark) left join entries using (qid) group by qid"""
ORACLES["read_context"] = text("chunks", """
select a.id as chunk_id, b.id, a.id = b.id as requested
from chunks a join chunks b on b.book = a.book and b.section is not distinct from a.section and b.id between a.id - 1 and a.id + 3
where a.id % 1048576 = 0""")

# ---- catalog ----------------------------------------------------------------

REG = f"""
reg as (
  select doc_id as slot, 'doc_' || doc_id as key, array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ') as title,
    {KIND} as kind, source, case when lang = 'es' then 0 else len(string_split(text, chr(10))) end as chunks from documents)"""
ORACLES["catalog_summary"] = f"""with {REG}
select 'textbook' as section, key as name, title, chunks::bigint as n from reg where kind <> 'article'
union all select 'papers_by_source', source, '', count(*) from reg where kind = 'article' group by source
union all select 'total_documents', '', '', count(*) from reg"""
ORACLES["catalog_by_source"] = f"""with {REG}, f as (select * from reg where contains(lower(source), 'rc1'))
select key as book, title, source, (select count(*) from f) as papers, least((select count(*) from f), 80) as showing
from (select *, row_number() over (order by title, key) as r from f) where r <= 80"""
ORACLES["list_documents"] = f"with {REG} select key as book, title, chunks::bigint as chunks, kind, source from reg"
ORACLES["status_rollup"] = f"""with {REG}
select case when grouping(s) = 1 then 'TOTAL' else s end as source, count(*) as docs, count(*) filter (chunks > 0) as chunked
from (select case when source = 'src0' then '(textbooks)' else source end as s, chunks from reg) group by rollup (s)"""
ORACLES["kind_histogram"] = f"with {REG} select kind, count(*) as n from reg group by kind"
ORACLES["history_window"] = """
select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as transcript from (
  select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 6 group by conv_id"""
