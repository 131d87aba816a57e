"""DuckDB twins of the operators that SQL can say; they compare all with all, so they are for small tables."""

_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"

#: Windows of 35 words by their text; a word goes if a window over it starts anywhere else too.
SUBSTRING = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS.format('text')} as ws from documents),
w as (select rid, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select rid, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35)),
twice as (select h from w group by h having count(*) > 1),
hit as (select rid, i from w semi join twice using (h)),
gone as (select distinct rid, unnest(range(i, i + 35)) as i from hit),
words as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
kept as (select rid, count(*) as n, string_agg(word, ' ' order by i) as txt from words anti join gone using (rid, i) group by rid)
select doc_id, len(ws)::bigint as n_words, len(ws)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(txt, '')) as kept_sha256 from d left join kept using (rid)"""

#: All pairs with a common 2-word shingle, linked at a similarity of 0.8, and the smallest doc_id that each reaches.
NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from d),
x as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, seen) as (select doc_id, doc_id from s union select r.doc_id, p.b from r join p on r.seen = p.a)
select doc_id, len(sh)::bigint as n_shingles, c as component_id, doc_id = c as kept from s join (select doc_id, min(seen) as c from r group by 1) using (doc_id)"""

#: Trigrams, each text scored by the counts of all others.
LM_SCORES = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS.format('text')} as ws from documents),
t as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
b as (select rid, w, lag(w) over p as v, lag(w, 2) over p as u from t window p as (partition by rid order by i)),
o1 as (select rid, w, count(*) as n from b group by 1, 2), c1 as (select w, sum(n) as n from o1 group by 1),
o2 as (select rid, v, w, count(*) as n from b where v is not null group by 1, 2, 3), c2 as (select v, w, sum(n) as n from o2 group by 1, 2),
o3 as (select rid, u, v, w, count(*) as n from b group by 1, 2, 3, 4), c3 as (select u, v, w, sum(n) as n from o3 where u is not null group by 1, 2, 3),
l1 as (select rid, w, c1.n - o1.n as k from o1 join c1 using (w)),
l2 as (select rid, v, w, c2.n - o2.n as k from o2 join c2 using (v, w)),
k as (select o3.rid, o3.n, coalesce(c3.n - o3.n, 0) as k3, cuv.k as kuv, coalesce(cvw.k, 0) as k2, cv.k as kv, cw.k as k1 from o3
  left join c3 using (u, v, w) left join l2 cuv on cuv.rid = o3.rid and cuv.v = o3.u and cuv.w = o3.v
  left join l2 cvw on cvw.rid = o3.rid and cvw.v = o3.v and cvw.w = o3.w
  left join l1 cv on cv.rid = o3.rid and cv.w = o3.v join l1 cw on cw.rid = o3.rid and cw.w = o3.w),
z as (select sum(len(ws)) as total from d),
s as (select k.rid, fsum(k.n * case when k3 > 0 then log10(k3 / greatest(kuv, k3)) when k2 > 0 then log10(k2 / greatest(kv, k2)) + log10(0.4::double)
  else log10(greatest(k1, 0.5::double) / greatest(total - len(ws), 1)) + 2 * log10(0.4::double) end) as s from k join d using (rid), z group by 1)
select doc_id, len(ws)::bigint as n_words, round(coalesce(s, 0.0), 6) as log10_sum, round(s / len(ws), 6) as log10_mean from d left join s using (rid)"""


#: Base measures by plain counting; repeats of six words or more cover the words of the six-word windows found twice, and a
#: repeat is over 200 words long where a window of 201 words is found twice.
QUALITY = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, {_WORDS.format('text')} as ws from documents),
w as (select rid, k, i, md5(array_to_string(ws[i:i + k - 1], ' ')) as h from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select unnest([3, 6, 201]) as k) where len(ws) >= k)),
twice as (select rid, k, h from w group by all having count(*) > 1),
hit as (select rid, k, i from w semi join twice using (rid, k, h)),
covered as (select rid, k, count(distinct j) as n from (select rid, k, unnest(range(i, i + k)) as j from hit) group by all),
c as (select rid, max(n) filter (k = 3) as c3, max(n) filter (k = 6) as c6, max(n) filter (k = 201) as c201 from covered group by 1),
l as (select rid, count(*) - count(distinct line) as n from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
b as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  coalesce(l.n, 0) as n_dup_lines, coalesce(c3, 0) as n_repeat_words, coalesce(c6, 0) as covered_words, coalesce(c201, 0) > 0 as long_repeat from d left join c using (rid) left join l using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
 not base_failed and not long_repeat and 100 * covered_words <= 30 * n_words as kept, covered_words::bigint as covered_words, long_repeat from f"""


def _number(text: str) -> str:
    return f"('0x' || md5({text})[1:15])::bigint"


#: The mixture: exponent by sixty bisections, weights, blocks in seeded order, and of the last block rows by their numbers.
MIXING = f"""
with recursive said as (select doc_id, source, coalesce('s:' || source, 'null') as src, greatest(len({_WORDS.format('text')}), 1) as size,
  concat_ws('|', {", ".join(f"case when {c} is null then '-' else '+' || md5({c}::varchar) end" for c in ("doc_id", "text", "source"))}) as content from documents),
d as (select *, {_number("'41|' || content")} as spot from said),
t as (select src, sum(size)::double as n from d group by 1),
l as (select list(n order by src) as ns, list_max(list(n)) as top, list_sum(list(n)) as total from t),
b(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when ok then lo else mid end, case when ok then mid else hi end from (select i, lo, hi, (lo + hi) / 2 as mid,
    list_bool_and(list_transform(ns, lambda x: pow(x / top, (lo + hi) / 2) / list_sum(list_transform(ns, lambda y: pow(y / top, (lo + hi) / 2))) * total <= 2.0::double * x * (1 + 1e-9::double))) as ok from b, l) where i < 60),
z as (select case when list_bool_and(list_transform(ns, lambda x: 1 / len(ns) * total <= 2.0::double * x * (1 + 1e-9::double))) then 0.0::double else (select hi from b where i = 60) end as a from l),
w as (select src, n, floor(pow(n / top, a) / list_sum(list_transform(ns, lambda y: pow(y / top, a))) * total)::bigint as goal from t, l, z),
p as (select src, goal // n::bigint as "full", goal % n::bigint as rest, ceil(n / 1048576)::bigint as blocks from w),
r as (select d.*, "full", rest, spot % blocks as block from d join p using (src)),
s as (select src, block, "full", rest, sum(size) as n, {_number("concat_ws('|', '41', src, \"full\"::varchar, block::varchar)")} as turn from r group by 1, 2, 3, 4),
o as (select src, block, n, rest - coalesce(sum(n) over (partition by src order by turn, block rows between unbounded preceding and 1 preceding), 0) as "left" from s),
h as (select r.*, coalesce("left", 0) as "left", coalesce(o.n, 0) as n, coalesce(sum(size) over (partition by src, block order by spot rows between unbounded preceding and 1 preceding), 0) as head from r join o using (src, block)),
e as (select *, unnest(range("full" + case when "left" > 0 and head < "left" then 1 else 0 end)) as epoch from h)
select doc_id, source, epoch::int as epoch, block::int as block, {_number("concat_ws('|', '41', src, epoch::varchar, block::varchar)")} as block_order, size::bigint as n_tokens from e"""

#: crc32 as a fold over bits (each byte is followed by eight shifts), near words by masked and shortened spellings, roots step by step.
SPELLING = """
with recursive r as (select doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as x from documents) group by all),
b as (select *, hex(coalesce(doc_id::varchar, '') || ':' || run) as hx from r),
h as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(hx), 2), lambda i: [('0x' || substr(hx, i, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) as h from b),
v as (select case when h % 97 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end as word, sum(k)::bigint as n from h group by 1 having len(word) >= 5 and sum(k) >= 3),
p as (select word, n, unnest(range(1, len(word) + 1)) as i from v),
m as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as mask, substr(word, 1, i - 1) || substr(word, i + 1) as part from p),
d as (select distinct m.word as a, m.n as an, v.word as b, v.n as bn from m join v on m.part = v.word),
near as (select x.word, x.n, y.word as other, y.n as k from m x join m y on x.mask = y.mask and x.word <> y.word union all select a, an, b, bn from d union all select b, bn, a, an from d),
best as (select word, count(*) as n_near, first(other order by k desc, other) as form, max(k) as k from near group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when k >= 2 * v.n then form end as form, case when k >= 2 * v.n then k end as form_n from v left join best using (word)),
way(word, place) as (select word, word from f union all select way.word, f.form from way join f on f.word = way.place where f.form is not null)
select f.word, f.form, way.place as root, f.n, f.n_near, f.form_n from f join way on way.word = f.word join f z on z.word = way.place and z.form is null"""
