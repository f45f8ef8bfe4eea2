"""SQL twins, for an oracle database, of those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .mixing import BLOCK_ROWS, EVENNESS, NO_SOURCE, PERIOD, SOURCES_A_PERIOD
from .sharding import RECORD_BYTES, TOGETHER

_HASH = "cast('0x' || substr(md5({}), 1, 13) as bigint)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
#: The polynomial of crc32, bits reversed.
_POLYNOMIAL = 0xEDB88320
_STEP = f"case when {{0}} & 1 = 1 then xor({{0}} >> 1, {_POLYNOMIAL}) else {{0}} >> 1 end"


def sharding(shards: int) -> str:
    """The running sum of sizes in the order of hashes, cut into equal parts; crc32 byte by byte from its table."""
    table = "with recursive bits(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, " + _STEP.format("c") + ", k + 1 from bits where k < 8)"
    return f"""{table}, crcs as (select list(c order by i) as t from bits where k = 8),
 sized as (select doc_id, coalesce(text, '') as text, cast(strlen(coalesce(text, '')) + {RECORD_BYTES} as bigint) as size from documents),
 summed as (select doc_id, size, {_HASH.format("text")} as key, {_HASH.format("coalesce(cast(doc_id as varchar), '')")} as second,
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from sized, crcs),
 placed as (select *, sum(size) over (order by key, second, doc_id rows unbounded preceding) as stop, sum(size) over () / {shards} as part, sum(size) over (partition by key) as own from summed),
 grouped as (select *, max(stop) over (partition by key) as own_stop from placed),
 dealt as (select *, cast(least(floor((case when own <= {TOGETHER} * part then own_stop - own / 2 else stop - size / 2 end) / part), {shards - 1}) as integer) as shard from grouped)
 select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key, second, doc_id) - 1 as slot, cast(null as integer) as grown_shard from dealt"""


def mixing() -> str:
    """Earliest deadline first, slot by slot, and every block's place among the blocks that are there."""
    release = "floor(d * period / p) <= t and d < p"
    return f"""with recursive named as (select doc_id, text, coalesce(source, '{NO_SOURCE}') as source, {_HASH.format("coalesce(cast(doc_id as varchar), '')")} as h from documents),
 counts as (select source, count(*) as n from named group by 1),
 span as (select {PERIOD} * greatest(1, cast(ceil(count(*) / {SOURCES_A_PERIOD}) as bigint)) as period from counts),
 exact as (select source, n, pow(n, {EVENNESS}) / sum(pow(n, {EVENNESS})) over () * (period - count(*) over ()) as e, count(*) over () as m, period from counts, span),
 share as (select source, n, cast(1 + floor(e) + case when row_number() over (order by e - floor(e) desc, source) <= period - m - sum(floor(e)) over () then 1 else 0 end as bigint) as p from exact),
 plan as (select list(p order by source) as ps from share),
 run(t, done, r) as (select 0, list_transform(ps, lambda x: 0::bigint), 0::bigint from plan
  union all select t + 1, list_transform(done, lambda d, i: case when i = k then d + 1 else d end), k from
  (select t, done, (select i from (select unnest(range(1, len(ps) + 1)) as i, unnest(done) as d, unnest(ps) as p) where {release} order by ceil((d + 1) * period / p), i limit 1) as k from run, plan, span where t < period)),
 slots as (select t - 1 as slot, source, p, n, row_number() over (partition by source order by t) - 1 as j from run join (select *, row_number() over (order by source) as i from share) on i = r where t > 0),
 numbered as (select doc_id, source, row_number() over (partition by source order by h, doc_id) - 1 as source_row from named),
 blocks as (select s.source, b as block, b // s.p * (select period from span) + slot as slot, least({BLOCK_ROWS}, s.n - b * {BLOCK_ROWS}) as n from (select source, n, p, unnest(range((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})) as b from share) s join slots on slots.source = s.source and slots.j = b % s.p),
 placed as (select *, row_number() over (order by slot) - 1 as place, cast(sum(n) over (order by slot rows unbounded preceding) - n as bigint) as first_row from blocks)
 select doc_id, d.source, source_row, block, slot, place, first_row + source_row % {BLOCK_ROWS} as position from numbered d join placed b on b.source = d.source and b.block = source_row // {BLOCK_ROWS}"""


def near_duplicates(percent: int = 75) -> str:
    """All pairs that share a shingle, and what is reachable over those that are alike enough."""
    return f"""with recursive spelt as (select doc_id, {_WORDS} as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from spelt),
 sizes as (select doc_id, count(*) as n from s group by 1),
 pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
 ways as (select a, b from links union all select b, a from links),
 reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, w.b from reach r join ways w on w.a = r.other)
 select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept from reach r left join sizes z on z.doc_id = r.doc_id group by r.doc_id"""


def contamination(window: int = 10) -> str:
    """Windows as joined words, looked up in all documents."""
    spelt = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    joined = "array_to_string(w[i:i + m - 1], ' ')"
    return f"""with items as (select item_id, w, least(len(w), {window}) as m from (select item_id, {spelt} as w from benchmark) where len(w) > 0),
 windows as (select distinct item_id, m, {joined} as g from (select *, unnest(range(1, len(w) - m + 2)) as i from items)),
 docs as (select row_number() over () as r, doc_id, {spelt} as w from documents),
 places as (select r, m, i, {joined} as g from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, (select distinct m from windows) where len(w) >= m)),
 found as (select r, i, p.m, item_id from places p join windows b on p.m = b.m and p.g = b.g),
 hit as (select r, count(distinct k) as n from (select r, unnest(range(i, i + m)) as k from (select distinct r, i, m from found)) group by 1),
 named as (select r, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by 1)
 select doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(x.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
 from docs left join hit h using (r) left join named x using (r)"""


def word_runs(least: int = 24, periods: int = 3) -> str:
    """Every period of every document by comparing words that far apart; of equal stretches the smallest period."""
    table = "with recursive bits(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, " + _STEP.format("c") + ", k + 1 from bits where k < 8)"
    crc = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(cast(doc_id as varchar))), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""{table}, crcs as (select list(c order by i) as t from bits where k = 8),
 spelt as (select row_number() over () as r, doc_id, {crc} as h, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents, crcs),
 cut as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from spelt),
 sized as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from cut),
 docs as (select r, doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from sized),
 words as (select r, n, unnest(range(0, n)) as i, unnest(w) as g from docs where n >= {least}),
 pairs as (select a.r, b.i - a.i as q, a.i as i from words a join words b on a.r = b.r and a.g = b.g and b.i > a.i and {periods} * (b.i - a.i) <= a.n),
 stretches as (select r, q, min(i) as start, count(*) + q as length from (select r, q, i, i - row_number() over (partition by r, q order by i) as s from pairs) group by r, q, s having count(*) + q >= greatest({least}, {periods} * q)),
 runs as (select r, start, length, min(q) as period from stretches group by 1, 2, 3),
 told as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t,
  list({{'s': start, 'l': length, 'q': period}} order by start, period) as all_ from runs group by 1),
 best as (select r, start, length, period from (select *, row_number() over (partition by r order by (select max(cast(o.l * period > length * o.q as integer)) from (select unnest(all_) as o)), start, period) as k from runs join told using (r)) where k = 1),
 gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
 kept as (select d.r, coalesce(string_agg(x.g, ' ' order by x.i), '') as t from (select r, unnest(range(0, n)) as i, unnest(w) as g from docs where r in (select r from runs)) x join docs d using (r) anti join gone using (r, i) group by 1)
 select doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(told.t, '')) as runs_sha256, sha256(coalesce(k.t, array_to_string(w, ' '))) as collapsed_sha256
 from docs left join told using (r) left join best b using (r) left join kept k using (r)"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds: every part against all entries of its codebook."""
    out = f"""with kept as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 cut as materialized (select r, p, x[1 + p * len(x) // {parts}:(p + 1) * len(x) // {parts}] as v from kept, range({parts}) t(p)),
 book0 as (select p, r - 1 as e, v from cut where r <= {entries})"""
    away = "list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        out += f""",
 at{k} as materialized (select r, p, arg_min(e, (d, e)) as e, min(d) as d from (select r, c.p, e, cast({away} as bigint) as d from cut c join book{k} b on c.p = b.p) group by 1, 2)"""
        if k < rounds:
            out += f""",
 means{k} as (select p, e, list(cast(floor(s / n) as bigint) order by j) as v from (select p, e, j, sum(x) as s, count(*) as n from (select a.p, a.e, unnest(v) as x, unnest(range(len(v))) as j from at{k} a join cut using (r, p)) group by 1, 2, 3) group by 1, 2),
 book{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from book{k} b left join means{k} m on m.p = b.p and m.e = b.e)"""
    return out + f""",
 coded as (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from at{rounds} group by 1),
 labelled as (select vec_id, label, code, error from coded join kept using (r)),
 sums as (select label, cast(sum(error) as bigint) as label_error from labelled group by 1)
 select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256 from labelled l join sums s on l.label is not distinct from s.label"""
