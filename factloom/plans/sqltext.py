"""Pieces of DuckDB SQL for the comparison statements."""

from __future__ import annotations

from statistics import NormalDist

from factloom.functions.text import INVARIANT_ENDINGS, INVARIANT_NOUNS, MERGE_CUES, MERGE_PREFIXES, PARAGRAPH_CUES, PARAGRAPH_PREFIXES, STOPWORDS, YES_NO_WORDS


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def singular(x: str) -> str:
    return (
        f"case when length({x}) <= 3 then {x} when ends_with({x}, 'ies') and length({x}) > 4 then left({x}, -3) || 'y' "
        f"when ends_with({x}, 'ses') and length({x}) > 4 then left({x}, -2) "
        f"when ends_with({x}, 's') and not regexp_matches({x}, '(ss|us|is)$') then left({x}, -1) else {x} end"
    )


def plural(x: str) -> str:
    return f"case when ends_with({x}, 'y') and length({x}) > 2 then left({x}, -1) || 'ies' when regexp_matches({x}, '(s|x|z|ch|sh)$') then {x} || 'es' else {x} || 's' end"


def canon(x: str, lemma: bool = True) -> str:
    s = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'))"
    return f"array_to_string([{singular('p')} for p in string_split({s}, '_')], '_')" if lemma else s


def normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({x}), '-', ' '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


SENTENCES = r"""
s0 as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents
), sentences as (select doc_id, unnest(l) as sentence, unnest(range(len(l))) as pos from s0)
"""

UNITS = f"""
with {SENTENCES}, flags as (
  select *, string_split_regex(lower(trim(sentence)), '\\s+') as w from sentences
), starts as (
  select doc_id, pos, sentence, case when pos > 0 and (w[1] in ({words(MERGE_CUES)}) or array_to_string(w[1:2], ' ') in ({words(MERGE_PREFIXES)})
    or array_to_string(w[1:3], ' ') in ({words(MERGE_PREFIXES)})) then 0 else 1 end as opens from flags
), groups as (select *, sum(opens) over (partition by doc_id order by pos) as g from starts)
select doc_id, cast(g - 1 as int) as unit_no, string_agg(sentence, ' ' order by pos) as unit from groups group by doc_id, g
"""

CONCEPTS = f"""
with w as (
  select doc_id, [{singular('x')} for x in string_split({normal('text')}, ' ') if length(x) >= 3 and x not in ({words(STOPWORDS)})] as l from documents
), d as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from w)
select doc_id, l[1:12] as concepts from d
"""

STATEMENTS = """
stmts as (select record_id, unnest(pln) as raw, unnest(range(len(pln))) as pos from vector_records),
tidy as (select record_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as stmt from stmts)
"""

BALANCED = """(
  len(regexp_replace(stmt, '[^(]', '', 'g')) = len(regexp_replace(stmt, '[^)]', '', 'g'))
  and coalesce(list_min(list_transform(range(1, len(regexp_replace(stmt, '[^()]', '', 'g')) + 1), lambda i:
      2 * length(replace(left(regexp_replace(stmt, '[^()]', '', 'g'), i), ')', '')) - i)), 0) >= 0)"""

FLAT = "\\(([A-Za-z][A-Za-z0-9_]*)((?:\\s+[^()\\s]+)*)\\)"

REASON = f"""case when not starts_with(stmt, '(:') then 'missing_prefix'
  when not regexp_matches(stmt, '\\((STV|PointMass|ParticleFrom)') then 'missing_weight'
  when not {BALANCED} then 'unbalanced_parens'
  when not regexp_matches(stmt, '^\\(:\\s+([^\\s()]+)\\s+(.+)\\)$') then 'bad_toplevel'
  when regexp_matches(regexp_extract(stmt, '^\\(:\\s+([^\\s()]+)\\s+(.+)\\)$', 1), '^[$?]') then 'variable_name'
  when contains(stmt, 'Implication') and not (contains(stmt, '(Premises') and contains(stmt, '(Conclusions')) then 'bad_implication_shape' end"""

TRIPLES = f"""
t0 as (
  select *, case relation when '/r/IsA' then 'IsA' when '/r/HasProperty' then 'IsA' when '/r/PartOf' then 'PartOf' when '/r/UsedFor' then 'UsedFor'
    when '/r/CapableOf' then 'CapableOf' when '/r/AtLocation' then 'AtLocation' when '/r/HasA' then 'HasA' when '/r/MadeOf' then 'MadeOf' end as predicate,
    case when starts_with(start_uri, '/c/en/') then nullif({canon("regexp_extract(start_uri, '^/c/en/([^/]*)', 1)")}, '') end as source,
    case when starts_with(end_uri, '/c/en/') then nullif({canon("regexp_extract(end_uri, '^/c/en/([^/]*)', 1)")}, '') end as target,
    case when json_valid(metadata_json) and json_type(metadata_json) = 'OBJECT' then
      case when json_extract_string(metadata_json, '$.weight') is null and not regexp_matches(metadata_json, '"weight"\\s*:') then 1.0
      else try_cast(json_extract_string(metadata_json, '$.weight') as double) end end as weight
  from conceptnet_assertions
), eligible as (
  select * from t0 where predicate is not null and source is not null and target is not null and weight >= 2.0 and not isnan(weight)
)
"""

SCORE = "(('0x' || substr(sha256('42|' || predicate || '|' || source || '|' || target), 1, 16))::ubigint::double / 18446744073709551616.0)"

YES_NO = f"string_split({normal('question')}, ' ')[1] in ({words(YES_NO_WORDS)})"


def normal_particles(n: int) -> list[float]:
    return [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]


UNITS_CTE = UNITS[UNITS.index("with ") + 5 : UNITS.rindex("select doc_id, cast(g - 1")] + ", units as (select doc_id, g, string_agg(sentence, ' ' order by pos) as unit from groups group by doc_id, g)"


def _last(mark: str) -> str:
    return f"case when instr(reverse(tail), {mark}) > 0 then length(tail) - instr(reverse(tail), {mark}) + 1 else 0 end"


#: Windows of 512 characters over units that are longer: each ends at the last mark of its final fifth and overlaps by 64.
_CUT = f"coalesce(nullif(greatest({_last(chr(39) + '.' + chr(39))}, {_last(chr(39) + '!' + chr(39))}, {_last(chr(39) + '?' + chr(39))}, {_last('chr(10)')}), 0) + 409, 512)"
CHUNKS = f"""
with recursive {UNITS_CTE}, w as (
  select doc_id, g, unit, 0 as start, 0 as k, substr(unit, 410, 103) as tail from units
  union all
  select doc_id, g, unit, start + cut - 64, k + 1, substr(unit, start + cut - 64 + 410, 103)
  from (select *, {_CUT} as cut from w) where start + 512 < length(unit)
), parts as (
  select doc_id, g, k, regexp_replace(substr(unit, start + 1, case when start + 512 >= length(unit) then length(unit) else {_CUT} end), '^\\s+|\\s+$', '', 'g') as chunk from w
)
select doc_id, cast(row_number() over (partition by doc_id order by g, k) - 1 as int) as chunk_no, chunk from parts where chunk <> ''
"""

#: Groups of consecutive units, by a fold over the list of a document.
BATCHES = f"""
with {UNITS_CTE}, l as (select doc_id, list({{'done': []::varchar[][], 'open': [unit], 'n': length(unit)}} order by g) as l from units group by doc_id),
f as (select doc_id, list_reduce(l, lambda a, x: case when len(a.open) >= 4 or a.n + 1 + x.n > 2000 then {{'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n}}
  else {{'done': a.done, 'open': list_concat(a.open, x.open), 'n': a.n + 1 + x.n}} end) as r from l),
b as (select doc_id, list_append(r.done, r.open) as b from f)
select doc_id, cast(unnest(range(len(b))) as int) as batch_no, unnest(b) as batch from b
"""

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PARAGRAPHS = f"""
with d as (select doc_id, {_TRIM.format('text')} as text from documents where text is not null),
p1 as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as l from d where length(text) > 512),
p as (select doc_id, unnest(range(len(l))) as para, unnest(l) as text from p1),
s0 as (select doc_id, para, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as l from p where length(text) > 512),
s as (select doc_id, para, unnest(range(len(l))) as pos, unnest(l) as sentence from s0),
s1 as (select *, string_split_regex(lower(trim(sentence)), '\\s+') as w from s),
s2 as (select *, sum(case when pos > 0 and (w[1] in ({words(PARAGRAPH_CUES)}) or array_to_string(w[1:2], ' ') in ({words(PARAGRAPH_PREFIXES)}) or array_to_string(w[1:3], ' ') in ({words(PARAGRAPH_PREFIXES)})) then 0 else 1 end) over (partition by doc_id, para order by pos) as g from s1),
m as (select doc_id, para, g, string_agg(sentence, ' ' order by pos) as unit from s2 group by 1, 2, 3),
ml as (select doc_id, para, list({{'done': []::varchar[], 'open': unit, 'n': length(unit) + 1}} order by g) as l from m group by 1, 2),
mr as (select doc_id, para, list_reduce(l, lambda a, x: case when a.n + x.n - 1 > 512 then {{'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n - 1}}
  else {{'done': a.done, 'open': a.open || ' ' || x.open, 'n': a.n + x.n}} end) as r from ml),
runs as (select doc_id, para, text, sum(case when length(text) > 512 then 1 else 0 end) over (partition by doc_id order by para) as run from p),
sl as (select doc_id, min(para) as para, list({{'done': []::varchar[], 'open': text, 'n': length(text) + 2}} order by para) as l from runs where length(text) <= 512 group by doc_id, run),
sr as (select doc_id, para, list_reduce(l, lambda a, x: case when a.n + x.n - 2 > 512 then {{'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n}}
  else {{'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open, 'n': a.n + x.n}} end) as r from sl),
chunks as (
  select doc_id, 0 as para, [text] as l from d where length(text) between 1 and 512
  union all select doc_id, para, list_append(r.done, r.open) from mr union all select doc_id, para, list_append(r.done, r.open) from sr
), e as (select doc_id, para, unnest(range(len(l))) as k, unnest(l) as chunk from chunks)
select doc_id, cast(row_number() over (partition by doc_id order by para, k) - 1 as int) as chunk_no, chunk from e
"""


def snake(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


def _kept(x: str) -> str:
    return f"case when {x} in ({words(INVARIANT_NOUNS)}) or regexp_matches({x}, '({'|'.join(INVARIANT_ENDINGS)})$') then {x} else {singular(x)} end"


def argument(x: str) -> str:
    """An argument in canonical form: variables keep their case, words lose their plural but for those with hyphen or digit."""
    joined = f"array_to_string([case when regexp_matches(t, '[-0-9]') then t else {_kept('lower(t)')} end for t in string_split_regex(trim({x}), '\\s+')], '-')"
    return f"case when regexp_matches({x}, '^[$?]') then '$' || substr({x}, 2) else {snake(joined)} end"


def _missing(name: str) -> str:
    return f"'missing required attribute ''{name}'''"


EXTRACTIONS = f"""
with a as (select assertion_id, load_batch, relation, case when assertion_id % 17 = 0 then '$x' else replace(regexp_extract(start_uri, '^/c/[a-z]+/([^/]*)', 1), '_', ' ') end as sub0,
  regexp_extract(end_uri, '^/c/[a-z]+/([^/]*)', 1) as obj0, case when assertion_id % 13 > 0 then nullif(trim(substr(relation, 4, 40)), '') end as pred from conceptnet_assertions),
c as (select * exclude (sub0, obj0), nullif(trim(sub0), '') as sub, nullif(trim(obj0), '') as obj, case relation when '/r/IsA' then 'type_decl' when '/r/HasProperty' then 'property' when '/r/PartOf' then 'inheritance' when '/r/Antonym' then 'negation' when '/r/RelatedTo' then 'guess' else 'fact' end as cls from a),
r as (select *, case when assertion_id % 9 = 0 then 'fuzzy alignment' when cls = 'guess' then 'unsupported statement class ''guess'''
  when regexp_matches(coalesce(sub, ''), '^[$?]') then 'free variable in ''subject'' for ' || cls when regexp_matches(coalesce(obj, ''), '^[$?]') then 'free variable in ''object'' for ' || cls
  when cls in ('fact', 'negation') and pred is null then {_missing('predicate')}
  when cls = 'type_decl' and sub is null then {_missing('entity')} when cls = 'type_decl' and obj is null then {_missing('type')}
  when cls = 'property' and sub is null then {_missing('entity')} when cls = 'property' and obj is null then {_missing('value')}
  when cls = 'inheritance' and sub is null then {_missing('child')} when cls = 'inheritance' and obj is null then {_missing('parent')}
  when cls in ('fact', 'negation') and sub is null and obj is null then 'fact requires at least one argument' end as reason from c),
e as (select *, case when cls in ('type_decl', 'inheritance') then 'isa' when cls = 'property' then 'has' else pred end as head,
  list_filter(case when cls = 'property' then [sub, 'quality', obj] else [sub, obj] end, lambda x: x is not null) as args from r),
t as (select *, [{argument('x')} for x in args] as vals, case when head in ('isa', 'Inheritance', 'IsA', ':') and len(args) = 2 then 'IsA'
  else array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split_regex(replace(lower(head), ' ', '-'), '[^A-Za-z0-9]+') if x <> ''], '') end as shown from e),
n as (select *, substr(array_to_string(list_filter(list_concat(vals[1:2], [{snake("replace(lower(head), ' ', '-')")}, case cls when 'type_decl' then 'type' when 'negation' then 'neg' else cls end]), lambda x: x <> ''), '_'), 1, 80) as name,
  '(' || array_to_string(list_concat([shown], vals), ' ') || ')' as atom from t)
select assertion_id, load_batch, case when reason is null then '(: ' || name || ' ' || case when cls = 'negation' then '(Not ' || atom || ')' else atom end || ' (STV 1.0 1.0))' end as stmt, reason from n
"""
