"""Relational restatement of the text operators for the SQL check.

The library works on arrays inside a document's row; the SQL here works on one
row per line with window functions, so agreement is not a matter of shared code.
Each CTE adds one stage; ``upto(stage)`` gives the WITH clause it needs.
"""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"


def letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"


def capitals(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g'))"


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') and not regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def prose(x: str) -> str:
    t = f"trim({x})"
    return (
        f"(length({t}) >= 25 and contains({t}, ' ')"
        f" and {letters(t)}::double / length(replace({t}, ' ', '')) >= 0.72"
        f" and {capitals(t)}::double / greatest({letters(t)}, 1) <= 0.8)"
    )


def words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def tokens(x: str) -> str:
    return f"(floor({words(x)} * 1.35::double)::bigint + 1)"


NUM = r"try_cast(nullif(regexp_extract(trim(line), '^\[PAGE ([0-9]+)\]$', 1), '') as int)"
LONG = "'^[A-Za-z]{8,}$'"

STAGES: dict[str, str] = {}

STAGES["docs"] = """
docs as (
  select doc_id as slot, 'doc_' || doc_id as key,
    array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ') as title,
    case lang when 'fr' then 'article' when 'de' then 'issue' else 'book' end as kind,
    source, text as plain
  from documents)"""

STAGES["lines0"] = f"""
pars as (
  select slot, kind, source, (i - 1)::int as i,
    list_filter(string_split(p, ' '), lambda w: w <> '') as ws
  from docs, unnest(string_split(plain, chr(10))) with ordinality as u(p, i)),
sizes as (
  select slot, any_value(source) as source, count(*) as npars, (count(*) >= 6)::int as opening
  from pars group by slot),
wrapped as (
  select slot, i, 0 as ord, 0 as k,
    case when kind = 'article' then
      case when (i // 5) % 2 = 0 and i < 150
        then ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'][i // 10 + 1] || '. '
        else 'A. ' end
      else '1.' || (i // 5 + 1) || ' ' end
      || 'Study ' || array_to_string(ws[1:2], ' ') as line
  from pars where i % 5 = 4
  union all
  select slot, i, 1, k,
    case when k > 0 and regexp_matches(coalesce(ws[k * 9], ''), {LONG})
      then substr(ws[k * 9], 5) || ' ' else '' end
    || case when k < ceil(len(ws) / 9.0) - 1 and regexp_matches(coalesce(ws[k * 9 + 9], ''), {LONG})
      then left(array_to_string(ws[k * 9 + 1 : k * 9 + 9], ' '),
                length(array_to_string(ws[k * 9 + 1 : k * 9 + 9], ' ')) - length(ws[k * 9 + 9]) + 4) || '-'
      else array_to_string(ws[k * 9 + 1 : k * 9 + 9], ' ') end
  from (select slot, i, ws, unnest(range(ceil(len(ws) / 9.0)::int)) as k from pars)
  union all
  select slot, i, 2, 0, '' from pars),
body as (
  select slot, (r // 12)::int as pg, (r % 12 + 1)::int as pos, line,
    count(*) over (partition by slot, r // 12) as rows_here
  from (select slot, line, row_number() over (partition by slot order by i, ord, k) - 1 as r from wrapped)),
shown as (
  select slot, pg, max(rows_here) as rows_here,
    case when coalesce(max(line) filter (pos = 3), '') like '%-'
      then regexp_extract(max(line) filter (pos = 3), '([A-Za-z]{{4}}-)$', 1)
        || coalesce(regexp_extract(max(line) filter (pos = 4), '^([a-z]+)', 1), '')
      else 'nothing' end as word
  from body group by slot, pg),
placed as (
  select b.slot, pg + 1 + opening as p, case when pos <= 5 then 3 else 5 end as ord, pos as sub, line
  from body b join sizes using (slot)
  union all
  select s.slot, pg + 1 + opening, 4, x.k,
    case x.k when 1 then 'Figure ' || (pg + 1 + opening) || '.1 shows ' || word
             when 2 then 'as measured for ' || source else '' end
  from shown s join sizes using (slot), (values (1), (2), (3)) x(k)
  where rows_here > 6
  union all
  select slot, 1, 3, 0, 'CONTENTS' from sizes where opening = 1
  union all
  select slot, 1, 3, i + 1, array_to_string(ws[1:2], ' ') || ' ' || (i + 2)
  from pars join sizes using (slot) where opening = 1
  union all
  select p.slot, opening + (select count(distinct pg) from body b where b.slot = p.slot) + 1 + i // 10,
    3, i, coalesce(ws[1], '') || ', ' || (i + 2) || ', ' || (i + 5)
  from pars p join sizes using (slot) where npars >= 8),
framed as (
  select * from placed
  union all
  select slot, p, x.ord, 0,
    case x.ord when 0 then '[PAGE ' || p || ']' when 1 then 'COLLECTED REPORTS OF ' || upper(source)
      when 2 then 'Downloaded from https://onlinelibrary.wiley.com, page ' || p else p::varchar end
  from (select distinct slot, p from placed) join sizes using (slot), (values (0), (1), (2), (6)) x(ord)
  where x.ord <> 2 or p % 2 = 0
  union all
  select slot, 0, 0, x.k,
    case x.k when 1 then '# SOURCE: ' || source when 2 then '# TITLE: ' || title
      when 3 then '# PAGES: pdf index' else '' end
  from docs, (values (1), (2), (3), (4)) x(k)),
lines0 as (
  select slot, row_number() over (partition by slot order by p, ord, sub) as n,
    case when p = 0 then line
      else replace(replace(line, 'fi', chr(64257)), 'tion ', 'tion' || chr(8217) || ' ') end as line
  from framed)"""

STAGES["pages"] = f"""
paged as (
  select *, last_value(num ignore nulls) over (partition by slot order by n
    rows between unbounded preceding and current row) as page
  from (select *, {NUM} as num from lines0)),
pagefacts as (
  select slot, page, count(*) filter (ink) as n_ink,
    arg_min(t, n) filter (ink) as first_line,
    count(*) filter (ink and length(t) < 80) as n_short,
    count(*) filter (ink and regexp_matches(t, '[\\s.][0-9]{{1,4}}$')) as n_folio,
    count(*) filter (ink and regexp_matches(t, '^[A-Za-z].*?,\\s*[0-9,\\s\\-–]+$')) as n_entry,
    count(*) filter (ink and length(t) > 88) as n_long
  from (select *, trim(line) as t, trim(line) <> '' and num is null as ink from paged)
  where page is not null group by slot, page),
judged as (
  select slot, page, row_number() over (partition by slot order by page) as ordinal,
    count(*) over (partition by slot) as total,
    n_ink >= 6 and (regexp_full_match(first_line, '(?i)(TABLE OF )?CONTENTS')
      or (n_short::double / n_ink > 0.85 and n_folio::double / n_ink > 0.3)) as contents_like,
    n_ink > 0 and (coalesce(regexp_full_match(first_line, 'INDEX|Index(\\s+Terms)?'), false)
      or (n_ink >= 8 and n_entry::double / n_ink > 0.45)) as index_like,
    n_long >= 3 as body_like
  from pagefacts)"""

STAGES["matter"] = """
opened as (select distinct slot, 1 as o from paged where page is null and trim(line) <> ''),
head as (
  select *, max(page) filter (contents_like) over (partition by slot order by page) as last_hit
  from judged left join opened using (slot)
  where ordinal + coalesce(o, 0) <= greatest(4, floor((total + coalesce(o, 0)) * 0.15::double))),
grown as (
  select slot, min(page) filter (contents_like) as lo,
    min(page) filter (not contents_like and last_hit is not null and page - last_hit > 2) as stop
  from head group by slot),
grown2 as (
  select slot, lo, max(page) as hi from grown join head using (slot)
  where contents_like and (stop is null or page < stop) group by slot, lo),
trail as (
  select slot, page, lo, hi,
    body_like or page - greatest(hi, coalesce(lag(page) over (partition by slot order by page), hi)) > 3 as halt
  from grown2 join head using (slot) where page > hi),
front as (
  select g.slot, g.lo, greatest(g.hi, coalesce(max(t.page), g.hi)) as hi
  from grown2 g left join (
    select *, max(halt::int) over (partition by slot order by page) as halted from trail) t
    on t.slot = g.slot and t.halted = 0
  group by g.slot, g.lo, g.hi),
tail as (
  select slot, page, ordinal,
    sum((gap > 3)::int) over (partition by slot order by ordinal desc) as island
  from (select *, lag(ordinal, 1, ordinal) over (partition by slot order by ordinal desc) - ordinal as gap
        from judged where ordinal > floor(total * 0.8::double) and index_like)),
back as (
  select slot, min(page) as start from tail where island = 0
  group by slot having max(page) - min(page) >= 2),
matter as (
  select d.slot, d.kind,
    case when kind <> 'article' then f.lo end as lo, case when kind <> 'article' then f.hi end as hi,
    case when kind <> 'article' then b.start end as end_page
  from docs d left join front f using (slot) left join back b using (slot))"""

STAGES["trimmed"] = """
flagged as (
  select p.*, m.lo, m.hi, m.end_page,
    min(case when num >= end_page then n end) over (partition by slot) as stop_n
  from paged p join matter m using (slot)),
trimmed as (
  select slot, n, line, num from flagged
  where (stop_n is null or n < stop_n) and not coalesce(page between lo and hi, false)),
dropped as (
  select slot, count(*) filter ((stop_n is null or n < stop_n) and coalesce(page between lo and hi, false))
    + max((stop_n is not null)::int) as dropped
  from flagged group by slot)"""

STAGES["normed"] = """
normed as (
  select slot, n, num, replace(replace(line, chr(64257), 'fi'), chr(8217), '''') as line from trimmed),
unbannered as (
  select slot, row_number() over (partition by slot order by n) as n, num, line
  from normed where not regexp_matches(line, 'Downloaded from https://onlinelibrary\\.wiley\\.com'))"""

STAGES["swept"] = f"""
headers as (
  select slot, trim(line) as h from unbannered where trim(line) <> ''
  group by all having count(*) >= 3 and length(h) <= 75 and {letters("h")} >= 6
    and ({is_upper("h")} or regexp_matches(h, '^([0-9]{{1,4}}\\s+.{{0,60}}?\\s+(Chapter\\s+[0-9]+|Appendix\\s+[A-Z])|(Chapter\\s+[0-9]+|Appendix\\s+[A-Z]\\s+.{{0,60}}?\\s+[0-9]{{1,4}})|Section\\s+[0-9]+\\.[0-9]+\\..{{0,60}}?\\s+[0-9]{{1,4}})$'))),
near as (
  select *, max((num is not null)::int) over (partition by slot order by n
    rows between 2 preceding and 2 following) as close
  from unbannered),
furniture as (
  select e.*, close = 1 and num is null and trim(line) <> '' and (h is not null
    or regexp_full_match(trim(line), '[0-9]{{1,4}}') or regexp_full_match(trim(line), '(?i)[ivxlcdm]{{1,6}}')) as gone
  from near e left join headers on headers.slot = e.slot and h = trim(e.line)),
swept as (select slot, n, num, line from furniture where not gone)"""

STAGES["lifted"] = r"""
parted as (
  select *, sum((num is not null)::int) over (partition by slot order by n) as part from swept),
placed2 as (
  select *, row_number() over (partition by slot, part order by n) - (part > 0)::int as idx,
    sum((num is not null or trim(line) = '')::int) over (partition by slot, part order by n) as seg
  from parted),
hits as (
  select *, trim(line) <> '' and num is null and max((idx > 1 and
      regexp_matches(trim(line), '^(FIGURE|TABLE|Figure|Table)\s+[0-9]+[-.–]?[0-9]*($|[^\p{L}\p{N}_])'))::int)
      over (partition by slot, part, seg order by n) = 1 as lift
  from placed2),
reordered as (
  select slot, part, 0 as ord, n::double as n, num, line from hits where not lift
  union all
  select slot, part, 1, 0, null, '' from hits group by slot, part
  having bool_or(lift) and trim(arg_max(line, n) filter (not lift)) <> ''
  union all
  select slot, part, 2, n, num, line from hits where lift
  union all
  select slot, part, 2, max(n) + 0.5, null, '' from hits where lift group by slot, part, seg),
lifted as (
  select slot, row_number() over (partition by slot order by part, ord, n) as n, num, line from reordered),
captions as (select slot, count(distinct (part, seg)) as moved from hits where lift group by slot)"""

STAGES["joined"] = rf"""
lexicon as (
  select distinct slot, lower(w) as w from (
    select slot, unnest(regexp_extract_all(
      regexp_replace(line, '[^\p{{L}}\p{{N}}_-]+', '  ', 'g'), '(?:^|[ -])([A-Za-z]{{2,}}-[A-Za-z]{{2,}})(?:$|[ -])', 1)) as w
    from lifted)),
ahead as (
  select *, {", ".join(f"lead(line, {k}) over w as l{k}, coalesce(lead(kind, {k}) over w, 'e') as k{k}" for k in (1, 2, 3, 4))}
  from (select *, case when num is not null then 'm' when trim(line) = '' then 'b' else 't' end as kind from lifted)
  window w as (partition by slot order by n)),
heads as (
  select *, case skip when 0 then l1 when 1 then l2 when 2 then l3 else l4 end as target, n + skip + 1 as tn
  from (select *, length(regexp_extract(k1 || k2 || k3, '^b*m?b*')) as skip from ahead
        where regexp_matches(rtrim(line), '[A-Za-z]{{2,}}-$'))),
able as (
  select slot, n, tn, line, trim(target) as target,
    regexp_extract(rtrim(line), '([A-Za-z]{{2,}})-$', 1) as head,
    regexp_extract(trim(target), '^([a-z]{{2,}})($|[^\p{{L}}\p{{N}}_])', 1) as cont
  from heads where regexp_matches(trim(target), '^[a-z]{{2,}}($|[^\p{{L}}\p{{N}}_])')),
chain as (
  select a.slot, a.n, a.tn, 0 as depth from able a
  where not exists (select 1 from able b where b.slot = a.slot and b.tn = a.n)
  union all
  select a.slot, a.n, a.tn, depth + 1 from chain c join able a on a.slot = c.slot and a.n = c.tn),
picked as (
  select a.* from able a join chain c on c.slot = a.slot and c.n = a.n where depth % 2 = 0),
joined as (
  select l.slot, row_number() over (partition by l.slot order by l.n) as n, l.num,
    case when p.n is null then l.line else left(rtrim(l.line), length(rtrim(l.line)) - 1)
      || case when x.w is null then '' else '-' end || p.target end as line
  from lifted l
  left join picked p on p.slot = l.slot and p.n = l.n
  left join lexicon x on x.slot = p.slot and x.w = lower(p.head || '-' || p.cont)
  left join picked q on q.slot = l.slot and l.n > q.n and l.n <= q.n + 4 and l.n <= q.tn and l.num is null
  where q.n is null)"""

STAGES["sound"] = r"""
sound as (
  select slot, row_number() over (partition by slot order by n) as n, num, rtrim(line) as line from joined
  where not regexp_matches(trim(line), '^([^\p{L}\p{N}_]{1,3}|[. ·]+)$'))"""

STAGES["flowed"] = rf"""
fact as (
  select *, {prose("line")} as prose, regexp_matches(line, '[.:;!?"'')]$') as stop, left(trim(line), 1) as c1
  from sound),
around as (
  select *, lag(prose) over w as p0, lag(stop) over w as s0, lead(prose) over w as p2, lead(c1) over w as c2
  from fact window w as (partition by slot order by n)),
bridged as (
  select slot, n, num, line, prose, stop, c1 from around
  where not (line = '' and coalesce(p0 and not s0 and p2 and regexp_matches(c2, '^[a-z]$'), false))),
links as (
  select *, coalesce(prose and lag(prose) over w and not lag(stop) over w
      and regexp_matches(c1, '^[a-z(]$'), false) as a,
    coalesce(lag(length(line)) over w >= 45, false) as strong
  from bridged window w as (partition by slot order by n)),
runs as (
  select *, sum((not a)::int) over (partition by slot order by n) as run from links),
settled as (
  select *, a and max((a and strong)::int) over (partition by slot, run order by n) = 1 as j from runs),
para as (
  select *, sum((not j)::int) over (partition by slot order by n) as pid from settled),
flowed as (
  select slot, pid as n, any_value(num) as num,
    string_agg(case when j then trim(line) else line end, ' ' order by n) as line
  from para group by slot, pid),
cleanlines as (
  select slot, row_number() over (partition by slot order by n) as n, num, line
  from (select *, lag(line) over (partition by slot order by n) as before from flowed)
  where line <> '' or before is null or before <> ''),
cleaned as (
  select slot, trim(string_agg(line, chr(10) order by n), ' ' || chr(10)) || chr(10) as clean_text
  from cleanlines group by slot)"""

STAGES["blocks"] = rf"""
numbered as (
  select c.*, d.kind, last_value(num ignore nulls) over (partition by slot order by n
    rows between unbounded preceding and current row) as page
  from cleanlines c join docs d using (slot)),
endings as (select slot, arg_max(page, n) as last_page from numbered group by slot),
shaped as (
  select *, trim(line) as t,
    regexp_extract(trim(line), '^([0-9]{{1,2}})\.([0-9]{{1,2}})(?:\.([0-9]{{1,2}}))?\s+([A-Z].{{3,90}})$', ['a', 'b', 'c', 'title']) as bk,
    regexp_extract(trim(line), '^([IVX]{{1,5}})\.\s+([A-Z][A-Za-z].{{2,90}})$', ['num', 'title']) as k2,
    regexp_extract(trim(line), '^([A-Z])\.\s+([A-Z][A-Za-z].{{2,90}})$', ['num', 'title']) as k3
  from numbered where num is null and line not like '#%'),
ruled as (
  select *,
    kind <> 'article' and bk.title <> '' and try_cast(bk.a as int) between 1 and 20
      and not regexp_matches(trim(bk.title), '\s[0-9]{{1,4}}$') and not trim(bk.title) like '%,'
      and {letters("bk.title")} >= 4 as is_book,
    case when kind = 'article' and k2.title <> '' and {letters("k2.title")} >= 3
      and not regexp_matches(trim(k2.title), '\s[0-9]{{1,4}}$')
      then nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], k2.num), 0) end as roman,
    kind = 'article' and k3.title <> '' and length(trim(k3.title)) <= 70 and {letters("k3.title")} >= 3 as letter
  from shaped),
ruled2 as (
  select *, last_value(roman ignore nulls) over w as roman_now,
    last_value(case when roman is not null then k2.num end ignore nulls) over w as roman_label
  from ruled window w as (partition by slot order by n rows between unbounded preceding and current row)),
headed as (
  select *, is_book or roman is not null or (letter and roman_now is not null) as head from ruled2),
located as (
  select *, sum(head::int) over w as sec,
    sum((head or t = '')::int) over w as par,
    lead(n) over w as next_n, lead(page) over w as next_page
  from headed window w as (partition by slot order by n)),
sections as (
  select slot, sec,
    case when is_book then bk.a::int else roman_now end as chapter,
    case when is_book then bk.a || '.' || bk.b || case when coalesce(bk.c, '') <> '' then '.' || bk.c else '' end
      when roman is not null then k2.num else roman_label || '.' || k3.num end as section,
    regexp_replace(trim(case when is_book then bk.title when roman is not null then k2.title else k3.title end), '\s+', ' ', 'g') as title
  from located where head),
paras as (
  select slot, sec, par, trim(string_agg(line, chr(10) order by n), ' ' || chr(10)) as text,
    arg_min(page, n) filter (page is not null) as page_start,
    case when arg_max(next_n is null, n) then any_value(last_page)
      else max(next_page) filter (n = last_n) end as page_end
  from (select *, max(n) over (partition by slot, sec, par) as last_n
        from located join endings using (slot) where not head and t <> '')
  group by slot, sec, par),
blocks as (
  select p.slot, p.sec, row_number() over (partition by p.slot, p.sec order by par) as b, text, page_start, page_end,
    {tokens("text")} as n, s.chapter, s.section,
    coalesce(s.title, case when d.kind = 'book' then 'front matter' else 'abstract' end) as section_title,
    d.key, d.title as book_title, d.kind, d.source
  from paras p join docs d using (slot) left join sections s on s.slot = p.slot and s.sec = p.sec)"""

STAGES["chunks"] = rf"""
sized as (
  select *, n > 800 as big, sum((n > 800)::int) over (partition by slot, sec order by b) as grp,
    case when coalesce(section, '') <> '' then 'Section ' || section || ' ' || section_title
      else section_title end as label
  from blocks),
pieces as (
  select slot, sec, 2 * grp + 1 as run, b, 0 as q, big, text, page_start, page_end, n, chapter, section,
    section_title, key, book_title, kind, source, label
  from sized where not big
  union all
  select slot, sec, 2 * grp, b, q, big, piece, page_start, page_end, {tokens("piece")}, chapter, section,
    section_title, key, book_title, kind, source, label
  from sized, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) with ordinality as u(piece, q)
  where big),
units as (
  select *, row_number() over w - 1 as u, sum(n) over w as upto, sum(n) over w - n as before,
    case when big then 0 else 80 end as overlap,
    '[' || book_title || ' | ' || case when source <> '' then source || ' | ' else '' end || label || ']' as header
  from pieces window w as (partition by slot, sec, run order by b, q)),
starts as (
  select f.slot, f.sec, f.run, f.u as f, coalesce(min(t.u), f.u) as s,
    f.before - coalesce(f.before - min(t.before), 0) as base
  from units f left join units t on t.slot = f.slot and t.sec = f.sec and t.run = f.run
    and t.u < f.u and f.before - t.before <= f.overlap
  group by f.slot, f.sec, f.run, f.u, f.before),
reach as (
  select s.slot, s.sec, s.run, s.f, s.s, max(e.u) as e
  from starts s join units e on e.slot = s.slot and e.sec = s.sec and e.run = s.run
    and e.u >= s.f and (e.u = s.f or e.upto - s.base <= 450)
  group by all),
walk as (
  select * from reach where f = 0
  union all
  select r.* from walk w join reach r on r.slot = w.slot and r.sec = w.sec and r.run = w.run and r.f = w.e + 1),
made as (
  select w.slot, w.sec, w.run, w.f, any_value(big) as big,
    case when any_value(big) then string_agg(text, ' ' order by u) else string_agg(text, chr(10) || chr(10) order by u) end as text,
    min(least(coalesce(page_start, page_end), coalesce(page_end, page_start))) as lo,
    max(greatest(coalesce(page_start, page_end), coalesce(page_end, page_start))) as hi,
    any_value(page_start) as ps, any_value(page_end) as pe,
    any_value(chapter) as chapter, any_value(section) as section, any_value(section_title) as section_title,
    any_value(key) as book, any_value(book_title) as book_title, any_value(kind) as kind,
    any_value(source) as source, any_value(header) as header
  from walk w join units u on u.slot = w.slot and u.sec = w.sec and u.run = w.run and u.u between w.s and w.e
  group by w.slot, w.sec, w.run, w.f, u.big),
weighed as (
  select *, {tokens("header")} + {tokens("text")} as n_tokens from made),
chunks as (
  select slot * 1048576 + row_number() over (partition by slot order by sec, run, f) - 1 as id,
    book, book_title, kind, source, chapter, section, section_title,
    case when big then ps else lo end as page_start, case when big then pe else hi end as page_end,
    n_tokens::int as n_tokens, text, header || chr(10) || text as embed_text
  from weighed where n_tokens >= 40)"""

_ORDER = list(STAGES)


def upto(stage: str) -> str:
    """WITH clause holding every stage up to and including ``stage``."""
    wanted = _ORDER[: _ORDER.index(stage) + 1]
    return "with recursive " + ",".join(STAGES[s] for s in wanted)


def text_of(cte: str) -> str:
    return f"select slot, string_agg(line, chr(10) order by n) as text from {cte} group by slot"
