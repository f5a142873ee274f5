"""DuckDB SQL for the queries it can express."""

ORACLES = {}

ORACLES["op3_line_chunks"] = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
  from documents where text is not null),
rolled as (
  select *, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    ('0x' || substr(md5(line), 1, 8))::bigint
      + 31 * lag(('0x' || substr(md5(line), 1, 8))::bigint) over (partition by doc_id order by i) as r,
    max(i) over (partition by doc_id) as last_i
  from lines),
boundaries as (
  select doc_id, d, i as start, lead(i) over (partition by doc_id, d order by i) as stop
  from rolled, range(1, 9) divisors(d) where i = 0 or i = last_i or r % d = 0),
chunks as (
  select b.doc_id, b.start, b.stop, string_agg(l.line, chr(10) order by l.i) as piece
  from (select distinct doc_id, start, stop from boundaries where stop is not null) b
  join rolled l on l.doc_id = b.doc_id and l.i between b.start and b.stop
  group by b.doc_id, b.start, b.stop having sum(l.chars) >= 32
  union all
  select doc_id, i, i, line from rolled
  where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
ranked as (
  select *, row_number() over (partition by piece order by doc_id, start) as place from chunks),
gone as (select distinct doc_id, unnest(range(start, stop + 1)) as i from ranked where place > 1)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed_lines, 0) as n_removed_lines,
       sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed_lines,
         string_agg(l.line, chr(10) order by l.i) filter (g.i is null) as kept
  from lines l left join gone g using (doc_id, i) group by l.doc_id) k using (doc_id)
"""

ORACLES["op2_jaccard"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as gram
  from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id
  join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, m.n, n.n having 100 * count(*) >= 90 * (m.n + n.n - count(*))),
reach as (
  select doc_id as x, doc_id as y from documents
  union select r.x, l.y from reach r join links l on r.y = l.x)
select r.x as doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.y) as component_id
from reach r left join sizes s on s.doc_id = r.x group by r.x
"""

ORACLES["op7_vectors"] = """
with recursive usable as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
    and len(list_filter(embedding, lambda v: v <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b
    on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select vec_id as x, vec_id as y from embeddings
  union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as component_id from reach group by x)
select v.vec_id, count(l.y) as n_links, any_value(c.component_id) as component_id,
  v.vec_id = any_value(c.component_id) as kept
from embeddings v join least c on c.x = v.vec_id left join links l on l.x = v.vec_id group by v.vec_id
"""


def _centroids_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Each round spelled out: distances to all centroids, then floor(sum / count)."""
    steps = [f"""
usable as (
  select row_number() over () as rid, vec_id, embedding::double[] as x from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
u as (
  select rid, generate_subscripts(x, 1) as i, floor(unnest(x) * {scale})::hugeint as q from usable),
starts as (
  select rid, row_number() over (
    order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), x) - 1 as j from usable),
c0 as (select j, i, q from starts join u using (rid) where j < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} as (
  select u.rid, c.j, sum((u.q - c.q) * (u.q - c.q)) as d from u join c{n} c using (i) group by u.rid, c.j),
a{n} as (select rid, min(d * {k} + j) // {k} as d, min(d * {k} + j) % {k} as j from d{n} group by rid)""")
        if n < rounds:
            steps.append(f"""
m{n} as (select a.j, u.i, sum(u.q) as s, count(*) as n from a{n} a join u using (rid) group by a.j, u.i),
c{n + 1} as (
  select c.j, c.i, case when m.n is null then c.q
    else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as q
  from c{n} c left join m{n} m on m.j = c.j and m.i = c.i)""")
    return f"""
with {",".join(steps)},
hashes as (
  select j, sha256(string_agg(q::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by j)
select v.vec_id, a.j::int as cluster, a.d::bigint as distance,
  (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
  h.centroid_sha256
from a{rounds} a join usable v using (rid) join hashes h using (j)
"""


ORACLES["op11_centroids"] = _centroids_sql()

ORACLES["op12_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
sizes as (select unnest([1, 2, 3, 4, 5]) as size),
grams as (
  select lang, size, unnest(list_transform(
    range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as phrase
  from pieces, sizes where len(w) >= size),
f as (select lang, size, phrase, count(*) as f from grams group by all having count(*) >= 100),
cuts as (
  select lang, size, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, size)) as cut
  from f where size > 1),
scored as (
  select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, t.n,
    (1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as score
  from cuts c join totals t on t.lang = c.lang
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1 : ], ' ')),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (
  select * from best b where not exists (
    select 1 from f x where x.lang = b.lang and x.f >= b.a and x.phrase <> b.phrase
      and contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from held)
where rank <= 2000
"""

ORACLES["op13_chats"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
marked as (
  select *, coalesce(lag(role) over w = role, false) as goes_on,
    length(regexp_replace(role, '([<\[])(\\*)(\|(?:turn|text|next|end)\|>|/?s>|/?INST\])', '\1\2!\3', 'g')) as role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(\|(?:turn|text|next|end)\|>|/?s>|/?INST\])', '\1\2!\3', 'g')) as text_chars
  from turns window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, ''
    order by turn nulls first, role, text), '')) as loss_sha256,
  -- a head and an end for each message, a mark between the turns of one
  sum(text_chars + case when goes_on then 8 else 8 + role_chars + 8 + 7 end)::bigint as formatted_chars
from marked group by conv_id
"""
