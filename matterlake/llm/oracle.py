"""SQL for the operators that SQL can express."""

# BM25 (k1 1.2, b 0.75) of each hundredth document's distinct terms.
TOPK_SEARCH = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w
  from documents where doc_id is not null
),
tf as (select doc_id, w, count(*) as c from words group by doc_id, w),
lengths as (select doc_id, sum(c) as l from tf group by doc_id),
overall as (
  select count(*)::double as n, (select sum(l) from lengths) / count(*)::double as mean
  from documents where doc_id is not null
),
df as (select w, count(*) as d from tf group by w),
scores as (
  select q.doc_id, h.doc_id as hit_doc_id,
    round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * h.c * 2.2
      / (h.c + 1.2 * (0.25 + 0.75 * l / mean))), 6) as score
  from tf q join tf h using (w) join df using (w)
  join lengths on lengths.doc_id = h.doc_id cross join overall
  where q.doc_id % 100 = 0
  group by q.doc_id, h.doc_id
)
select doc_id,
  cast(row_number() over (partition by doc_id order by score desc, hit_doc_id) as integer) as rank,
  hit_doc_id, score
from scores
qualify rank <= 10
"""

SOURCE_MIXING = r"""
with sized as (
  select doc_id, source, text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    length(coalesce(text, '')) as n,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double as h
  from documents
),
keyed as (
  select *, pow((h + 1.0) / 4503599627370497.0,
    1.0 / (1.0 / (1.0 + abs(n / greatest(size, 1)::double - 6.0) / 6.0))) as k
  from sized
),
sources as (
  select source, sum(size)::bigint as source_size from sized group by source
),
weighted as (
  select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3]::double as weight,
    2.0 * source_size as most
  from sources
),
levels as (
  select *, (1.5 * sum(source_size) over ()
      - coalesce(sum(most) over (order by most / weight, encode(source) nulls last
          rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by most / weight, encode(source) nulls last
          rows between current row and unbounded following) as level
  from weighted
),
common as (
  select arg_min(level, most / weight) as level from levels where most > weight * level
),
targets as (
  select l.source, l.source_size,
    case when c.level is not null and l.most > l.weight * c.level
      then l.weight * c.level else l.most end as target
  from levels l cross join common c
),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs
  from targets
),
placed as (
  select k.*, source_size, target, epochs,
    floor(target - epochs * source_size + 0.5)::bigint as rest,
    coalesce(sum(size) over (partition by k.source order by k desc, doc_id nulls last
      rows between unbounded preceding and 1 preceding), 0) as before
  from keyed k join budgets b on k.source is not distinct from b.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken
from placed
"""

def _hashed_field(value: str) -> str:
    return (
        f"case when {value} is null then '-' "
        f"else strlen({value}::varchar) || ':' || {value}::varchar end"
    )


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(map(_hashed_field, fields))})"


# crc32 bit by bit, the polynomial in reflected form (a fixed value).
_CRC32 = """xor(list_reduce(
    list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
      lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)),
    4294967295::bigint), 4294967295)"""

# Both trees grow level by level; a leaf's steps are looked up at each level.
MERKLE_MANIFEST = f"""
with recursive marked as (
  select *, coalesce({_CRC32} % 7 = 0 and n_chars is not null, false) as bent from documents
),
leaves as (
  select doc_id, lang, {_leaf("n_chars")} as leaf,
    case when bent then {_leaf("(n_chars::hugeint + 1)")} else {_leaf("n_chars")} end as checked
  from marked
),
placed as (
  select *, count(*) over (partition by lang) as n,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos
  from leaves
),
up(tree, level, pos, node, n) as (
  select lang, 0, pos, leaf, n from placed
  union all
  select tree, level + 1, pos // 2, sha256(node || coalesce(other, '')), (n + 1) // 2
  from (select *, lead(node) over (partition by tree order by pos) as other from up where n > 1)
  where pos % 2 = 0
),
subroots as (
  select tree, node, count(*) over () as n,
    row_number() over (order by encode(tree) nulls first) - 1 as pos
  from up where n = 1
),
crown(level, pos, node, n) as (
  select 0, pos, node, n from subroots
  union all
  select level + 1, pos // 2, sha256(node || coalesce(other, '')), (n + 1) // 2
  from (select *, lead(node) over (order by pos) as other from crown where n > 1)
  where pos % 2 = 0
),
rows_ as (
  select p.*, s.node as subroot, s.pos as spot, row_number() over () as row_
  from placed p join subroots s on p.lang is not distinct from s.tree
),
steps as (
  select row_, l.level as k, (p.pos >> l.level) % 2 = 1 as is_right, u.node as other
  from rows_ p
  join (select distinct tree, level from up where n > 1) l on p.lang is not distinct from l.tree
  left join up u on u.tree is not distinct from l.tree and u.level = l.level
    and u.pos = xor(p.pos >> l.level, 1)
  union all
  select row_, 100 + l.level, (p.spot >> l.level) % 2 = 1, c.node
  from rows_ p
  cross join (select distinct level from crown where n > 1) l
  left join crown c on c.level = l.level and c.pos = xor(p.spot >> l.level, 1)
),
paths as (
  select row_, string_agg(other, '' order by k) as proof,
    list({{'is_right': is_right, 'other': other}} order by k) as steps
  from steps group by row_
),
folded as (
  select p.*, sha256(coalesce(proof, '')) as proof_sha256,
    list_reduce(coalesce(steps, []), lambda below, step: {{'is_right': false, 'other': sha256(
        case when step.other is null then below.other
          when step.is_right then step.other || below.other
          else below.other || step.other end)}},
      {{'is_right': false, 'other': checked}}).other as folded_root
  from rows_ p left join paths using (row_)
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from folded cross join (select node as root from crown where n = 1)
"""


def _cut_score(part: str, rest: str) -> str:
    return f"(1000000::hugeint * t.a * t.a // ({part}.a::hugeint * {rest}.a))::bigint"


# Every phrase is counted; no bound is needed.
PHRASE_COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
occurring as (
  select lang, 1 as size, unnest(w) as phrase from words
  union all
  select lang, 2, z[1] || ' ' || z[2] from (
    select lang, unnest(list_zip(w[:len(w) - 1], w[2:])) as z from words where len(w) > 1)
  union all
  select lang, 3, z[1] || ' ' || z[2] || ' ' || z[3] from (
    select lang, unnest(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])) as z
    from words where len(w) > 2)
),
f as (
  select lang, size, phrase, lang || chr(10) || phrase as key, count(*) as a
  from occurring group by lang, size, phrase
),
totals as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
candidates as (
  select *, string_split(phrase, ' ') as w from f where size > 1 and a >= 10
),
cuts as (
  select t.lang, t.phrase, t.a, 1 as k, x.a as l, y.a as r, {_cut_score("x", "y")} as score
  from candidates t
  join f x on x.key = t.lang || chr(10) || t.w[1]
  join f y on y.key = t.lang || chr(10) || array_to_string(t.w[2:], ' ')
  union all
  select t.lang, t.phrase, t.a, 2, x.a, y.a, {_cut_score("x", "y")}
  from candidates t
  join f x on x.key = t.lang || chr(10) || t.w[1] || ' ' || t.w[2]
  join f y on y.key = t.lang || chr(10) || t.w[3]
  where t.size = 3
),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
),
covering as (
  select lang, phrase, max(a) as a from (
    select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase
    from candidates where size = 3
  ) group by lang, phrase
)
select p.lang, row_number() over (partition by p.lang
    order by p.score desc, p.a desc, encode(p.phrase)) as rank,
  p.phrase, p.a, p.l, p.r, n, p.score
from lowest p join totals using (lang)
left join covering c on c.lang = p.lang and c.phrase = p.phrase
where c.a is null or 100 * c.a < 50 * p.a
qualify rank <= 2000
"""
