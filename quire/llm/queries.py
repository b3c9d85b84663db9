"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_va_top_k(spark, d):
    """The 20 best integer inner products of every 20th vector, by VA-files."""
    from quire.llm.va_search import va_top_k

    return va_top_k(table(spark, d, "embeddings"), c("vec_id") % 20 == 0, k=20, scale=64)


ORACLES["op1_va_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
    from embeddings where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, v.vec_id,
        list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
"""


@query
def op5_simhash_bk_trees(spark, d):
    """Near-duplicate classes of all documents."""
    from quire.llm.simhash import near_duplicates

    return near_duplicates(table(spark, d, "documents"), shingle=3, radius=3)


@query
def op7_int8_block_join(spark, d):
    """The 10 nearest neighbours of every 100th vector."""
    from quire.llm.int8_join import int8_neighbours

    return int8_neighbours(table(spark, d, "embeddings"), c("vec_id") % 100 == 0, k=10)


ORACLES["op7_int8_block_join"] = """
with v as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
    select q.vec_id as query_id, v.vec_id, list_distance(q.e, v.e) as score
    from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0
)
select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 10
"""


@query
def op9_seed_and_extend(spark, d):
    """Repeated passages of 13 words and more, cut from all but their first document."""
    from quire.llm.substring import substring_dedup

    return substring_dedup(table(spark, d, "documents").select("doc_id", "text"), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op9_seed_and_extend"] = r"""
with w as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
    from documents
), win as (
    select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g
    from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)
), dup as (
    select win.doc_id, i from win join (select g, min(doc_id) as first from win group by g) using (g) where first < doc_id
), gone as (
    select distinct doc_id, i + unnest(range(13)) as i from dup
), kept as (
    select doc_id, count(*) filter (gone.i is not null) as n_removed,
        coalesce(string_agg(word, ' ' order by w.i) filter (gone.i is null), '') as kept
    from (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w) w
    left join gone using (doc_id, i) group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query
def op8_capture_index(spark, d):
    """A WARC record per page, written, indexed, and read back through the index."""
    from quire.llm.warc import capture_keys, lookup, write_archive

    pages = table(spark, d, "pages")
    return lookup(write_archive(pages, min_bytes=0), capture_keys(pages), payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_capture_index"] = """
with d as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as x from pages),
f as (select *, min(page_id) over (partition by x, n) as first from d)
select page_id, n::bigint as payload_bytes,
    -- five hexadecimal digits are four digits to the base 32
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(x, (i // 4 * 5 + 1)::int, 5))::int >> (15 - i % 4 * 5)::int) & 31) + 1, 1)), '') as payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type,
    case when page_id > first then first end as refers_to
from f
"""


@query
def op2_sentencepiece(spark, d):
    """Ids of every document and whether they decode to its text."""
    from quire.llm.spm import encode, read_model

    docs = table(spark, d, "documents").select("doc_id", "text")
    return encode(docs, read_model(TOKENIZER), decode=True).select(
        "doc_id", "n_tokens", "token_ids", F.expr("decoded <=> replace(text, '\u2581', ' ')").alias("round_trip"))


@query
def op3_perspectives(spark, d):
    """Every dialogue as each of its speakers sees it."""
    from quire.llm.chat import perspectives

    return perspectives(table(spark, d, "conversations"))


ORACLES["op3_perspectives"] = r"""
with t as (
    select conv_id, coalesce(conv_id::varchar, '-') as conv, role, replace(coalesce(text, ''), '<|', '< |') as text,
        row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as nth
    from conversations
), s as (select distinct coalesce(conv_id::varchar, '-') as conv, role as speaker from conversations where role <> 'system'),
seen as (
    select conv, conv_id, speaker, ((nth - 1) // 256)::int as part, nth, coalesce(role = speaker, false) as own,
        '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system'
            else 'user name=' || coalesce(regexp_replace(role, '[<|>\s]', '_', 'g'), 'unknown') end || chr(10) as head,
        text || '<|im_end|>' as body
    from t join s using (conv)
), placed as (
    select *, sum(length(head) + length(body) + 1) over (partition by conv, speaker, part order by nth)::bigint - 1 as stop from seen
)
select any_value(conv_id) as conv_id, speaker, part, count(*) as n_turns, count(*) filter (own) as n_own,
    string_agg(head || body || chr(10), '' order by nth) as rendered,
    coalesce(string_agg((stop - length(body)) || '-' || stop, ',' order by nth) filter (own), '') as mask
from placed group by conv, speaker, part
"""


@query
def op4_temperature_mix(spark, d):
    """The documents in a mix of their sources with an entropy of 95 % and at most 4 passes over a source."""
    from quire.llm.mixing import Target, mix

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mix(docs, Target(entropy=0.95, repetition=4.0), seed=7).select("doc_id", "source", "block", "place", "n_tokens")


ORACLES["op4_temperature_mix"] = r"""
with d as (
    select doc_id, source, coalesce('=' || source, '-') as key,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as n
    from documents
), sums as (select key, sum(n)::bigint as t from d group by key),
p as (select key, t, t / (select sum(t) from sums)::double as p from sums where t > 0),
edge as (select count(*) as n, min(p) as lo, max(p) as hi, 1048576 as g from p),
coarse as (
    select k, ln(sum(pow(p, k / g))) - (k / g) * sum(pow(p, k / g) * ln(p)) / sum(pow(p, k / g)) as h,
        pow(any_value(lo), k / g - 1) * pow(any_value(hi), 1 - k / g) as r
    from p, edge, (select unnest(range(0, 1048577, 1024)) as k) group by k, g
), near as (
    select (select coalesce(min(k), 1048577) from coarse, edge where h < 0.95 * ln(n) - 1e-9) as e,
        (select min(k) from coarse where r <= 4 + 1e-9) as r
), fine as (
    select k, ln(sum(pow(p, k / g))) - (k / g) * sum(pow(p, k / g) * ln(p)) / sum(pow(p, k / g)) as h,
        pow(any_value(lo), k / g - 1) * pow(any_value(hi), 1 - k / g) as r
    from p, edge, (
        select distinct unnest(range(greatest(0, x - 1024), least(1048576, x) + 1)) as k from (select unnest([e, r]) as x from near)
    ) group by k, g
), a as (
    select greatest(
        (select coalesce(min(k), 1048577) - 1 from fine, edge where h < 0.95 * ln(n) - 1e-9),
        (select min(k) from fine where r <= 4 + 1e-9), 0) / 1048576 as a
), z as (select sum(pow(p, a)) as z, max(p) as hi from p, a),
plan as (
    select key, t, round(pow(p, a) / z * ((select sum(t) from sums) * z * pow(hi, 1 - a)))::bigint as b from p, a, z
    union all select key, 0, 0 from sums where t = 0
), blocks as (select key, t, b, case when t > 0 then b // t else 1 end as n_blocks from plan),
e as (
    select doc_id, source, key, n, n_blocks, b - n_blocks * t as rest, unnest(range(n_blocks + 1))::bigint as block
    from d join blocks using (key)
), placed as (select *, md5('7:' || block || ':' || doc_id) as place from e),
run as (select *, sum(n) over (partition by key, block order by place) as upto from placed)
select doc_id, source, block, place, n as n_tokens from run where block < n_blocks or rest > 0 and upto <= rest
"""


@query
def op6_co_training(spark, d):
    """The quality of every document, from two views trained on the labels and on each other."""
    from quire.llm.quality import fit, score

    docs = table(spark, d, "documents")
    model = fit(docs, table(spark, d, "labels"), most_labelled=3000, most_pool=3000)
    return score(docs.select("doc_id", "text", "lang", "source"), model).select(
        "doc_id", "content_score", "metadata_score", "quality_score", "keep")


@query
def op10_licence_scan(spark, d):
    """Licence notices in all documents, by the paragraph classifier trained on templates and these documents."""
    from quire.llm.licences import scan, train

    docs = table(spark, d, "documents").select("doc_id", "text")
    return scan(docs, train(docs, most_negatives=2000))


@query
def op11_cross_tokenizer(spark, d):
    """Every document by two tokenizers, aligned where their tokens end together, with corpus-wide counts of linked ids."""
    from quire.llm.align import align, read, scored

    aligned = align(table(spark, d, "documents").select("doc_id", "text"), read(BYTE_TOKENIZER), read(TOKENIZER))
    digest = F.when(c("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return scored(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "counts"))


@query
def op12_merkle_manifest(spark, d):
    """Leaves, proofs and roots of all documents; a third of them lower-cased, each a version of the tree."""
    from quire.llm.merkle import lower_ascii, manifest, third

    done = manifest(table(spark, d, "documents"), changed={"text": lower_ascii()}, where=third())
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


ORACLES["op12_merkle_manifest"] = """
with recursive docs as (
    select doc_id, coalesce('=' || lang, '-') as key,
        list_transform([doc_id::varchar, source, lang, n_chars::varchar], lambda x: coalesce(strlen(x) || ':' || x, '-')) as f,
        text, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint) as digits
    from documents
), crc as (
    -- one bit after the other, from the lowest of each byte
    select *, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(digits, lambda x: list_transform(range(8), lambda k: (x >> k::int) & 1))),
        lambda r, b: xor(r >> 1, (xor(r, b) & 1) * 3988292384))) as crc from docs
), leaves as (
    select doc_id, key, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos, leaf, changed
    from (
        select doc_id, key, sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) as leaf,
            case when crc % 3 = 0 then sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || low, '-')) else leaf end as changed
        from (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from crc)
    )
), own as (
    select key, 0 as level, pos, leaf as node, count(*) over (partition by key) as n from leaves
    union all
    select key, level + 1, pos // 8, sha256(string_agg(node, '' order by pos)), (any_value(n) + 7) // 8
    from own where n > 1 group by key, level, pos // 8
), sub as (
    select key, node as subroot, row_number() over (order by key) - 1 as pos, count(*) over () as n from own where n = 1
), top as (
    select 0 as level, pos, subroot as node, n from sub
    union all
    select level + 1, pos // 8, sha256(string_agg(node, '' order by pos)), (any_value(n) + 7) // 8
    from top where n > 1 group by level, pos // 8
), fold as (
    select row_number() over () as id, key, 0 as level, pos, changed as node, '' as proof from leaves
    union all
    select f.id, any_value(f.key), any_value(f.level) + 1, any_value(f.pos) // 8,
        sha256(string_agg(case when own.pos = f.pos then f.node else own.node end, '' order by own.pos)),
        any_value(f.proof) || coalesce(string_agg(own.node, '' order by own.pos) filter (own.pos <> f.pos), '')
    from fold f join own on own.key = f.key and own.level = f.level and own.pos // 8 = f.pos // 8
    where own.n > 1 group by f.id
), ids as (select row_number() over () as id, * from leaves),
half as (
    select f.id, sub.pos, sub.subroot, f.node, f.proof
    from fold f join own on own.key = f.key and own.level = f.level and own.pos = f.pos and own.n = 1 join sub on sub.key = f.key
), full_fold as (
    select id, 0 as level, pos, node, proof from half
    union all
    select f.id, any_value(f.level) + 1, any_value(f.pos) // 8,
        sha256(string_agg(case when top.pos = f.pos then f.node else top.node end, '' order by top.pos)),
        any_value(f.proof) || coalesce(string_agg(top.node, '' order by top.pos) filter (top.pos <> f.pos), '')
    from full_fold f join top on top.level = f.level and top.pos // 8 = f.pos // 8
    where top.n > 1 group by f.id
), root as (select node as root from top where n = 1)
select ids.doc_id, ids.leaf, half.subroot, root.root, sha256(f.proof) as proof_sha256, f.node as folded_root, f.node = root.root as verified
from full_fold f join top on top.level = f.level and top.pos = f.pos and top.n = 1 join ids using (id) join half using (id), root
"""


@query
def op13_positional_index(spark, d):
    """Words of all documents that runs of ten words of a benchmark item cover."""
    from quire.llm.positional import decontaminate

    done = decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"), size=10)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op13_positional_index"] = r"""
with d as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents
), b as (
    select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark
), win as (
    select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as g
    from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as i from b where len(ws) > 0)
), found as (
    select p.doc_id, i, n, g from (
        select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g
        from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from win))
    ) p semi join win using (n, g)
), hit as (
    select doc_id, count(*) as n_hit from (select distinct doc_id, i + unnest(range(n)) as i from found) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
    from (select distinct doc_id, item_id from found join win using (n, g) where item_id is not null) group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
