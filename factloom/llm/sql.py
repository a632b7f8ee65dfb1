"""DuckDB statements with the results of those queries that SQL can express on whole tables."""

from __future__ import annotations

from factloom.llm.sample import MULTIPLIERS, OFFSETS, PRIMES

M31, M32 = (1 << 31) - 1, (1 << 32) - 1


def _network(source: str) -> str:
    """CTEs r0, k0, f0, ... of the network over source(ident, seed, ...), step by step, one select per round."""
    c, p = MULTIPLIERS, PRIMES
    steps = [f"r0 as (select *, (ident >> 32) & {M32} as lft, ident & {M32} as rgt from {source})"]
    steps += [
        f"k{i} as (select *, xor(xor(seed & {M31}, {o}) * {c[0]} % {p[1]}, (seed >> 31) & {M31}) as key from r{i}), "
        f"f{i} as (select *, (xor(xor(rgt, key) * {c[0]} % {p[0]}, {OFFSETS[0]}) * {c[1]} % {p[1]} + key) * {c[2]} % {p[2]} * {c[2]} & {M32} as f from k{i}), "
        f"r{i + 1} as (select * exclude (lft, rgt, key, f), rgt as lft, xor(lft, f) as rgt from f{i})"
        for i, o in enumerate(OFFSETS)
    ]
    return ", ".join(steps)


_LAST = f"r{len(OFFSETS)}"
_BOUND = "(least(greatest(coverage / 100.0, 0.0), 1.0) * 4294967296.0)"
_IN_SAMPLE = f"(lft < floor({_BOUND})::bigint or (lft = floor({_BOUND})::bigint and rgt < floor(({_BOUND} - floor({_BOUND})) * 4294967296.0)::bigint))"
_WEIGHED = """
  select source_file, assertion_id, load_batch,
    relation in ('/r/IsA', '/r/HasProperty', '/r/PartOf', '/r/UsedFor', '/r/CapableOf', '/r/AtLocation', '/r/HasA', '/r/MadeOf')
      and regexp_matches(start_uri, '^/c/en/[^/]*[A-Za-z0-9]') and regexp_matches(end_uri, '^/c/en/[^/]*[A-Za-z0-9]') as mapped,
    case when json_valid(metadata_json) and json_type(metadata_json) = 'OBJECT' then
      case when json_extract_string(metadata_json, '$.weight') is null and not regexp_matches(metadata_json, '"weight"\\s*:') then 1.0
      else try_cast(json_extract_string(metadata_json, '$.weight') as double) end end as weight
  from conceptnet_assertions
"""

_REPLAY = f"""
w as ({_WEIGHED}), settings as (
  select distinct source_file, min_weight, coverage_percent, sample_seed from conceptnet_manifest where sampled_row_count is not null
), n0 as (
  select w.source_file, load_batch, min_weight, coverage_percent as coverage, assertion_id as ident, sample_seed as seed,
    coalesce(mapped and weight >= min_weight, false) as ok
  from w join settings using (source_file)
), {_network("n0")}, counts as (
  select source_file, min_weight, coverage, seed, load_batch, count(*) as scanned, count(*) filter (ok and coalesce({_IN_SAMPLE}, false)) as sampled
  from {_LAST} group by all
), upto as (
  select source_file, min_weight, coverage, seed, sum(scanned) over g as upto_rows, sum(sampled) over g as upto_sampled
  from counts window g as (partition by source_file, min_weight, coverage, seed order by load_batch)
), replayed as (
  select e.manifest_id, cast(coalesce(max(upto_sampled), 0) as bigint) as replayed_count
  from conceptnet_manifest e left join upto s on e.source_file = s.source_file and e.min_weight is not distinct from s.min_weight
    and e.coverage_percent is not distinct from s.coverage and e.sample_seed is not distinct from s.seed and s.upto_rows <= e.scanned_rows
  where e.sampled_row_count is not null group by 1
)
"""

P1_REPLAY = f"with {_REPLAY} select * from replayed"

P1_FOUND = f"""
with {_REPLAY}, s as (
  select manifest_id, scanned_rows - lag(scanned_rows) over w as scanned, eligible_row_count - lag(eligible_row_count) over w as eligible,
    sampled_row_count - lag(sampled_row_count) over w as recorded, replayed_count - lag(replayed_count) over w as replayed, lag(manifest_id) over w as first
  from conceptnet_manifest join replayed using (manifest_id)
  window w as (partition by source_file, normalization_version, min_weight, coverage_percent, sample_seed order by exported_at, manifest_id)
)
select first as first_manifest_id, manifest_id as later_manifest_id from s
where first is not null and scanned >= 0 and eligible >= 0 and (recorded < least(replayed, 0) or (scanned = 0 and eligible = 0 and recorded <> replayed))
"""

P1_SAMPLE = f"""
with latest as (
  select source_file, arg_max({{'w': min_weight, 'c': coverage_percent, 's': sample_seed}}, {{'a': exported_at, 'b': manifest_id}}) as s
  from conceptnet_manifest group by 1
), w as ({_WEIGHED}), n0 as (
  select source_file, load_batch, s.c as coverage, assertion_id as ident, s.s as seed from w join latest using (source_file)
  where mapped and weight >= s.w and not isnan(weight)
), {_network("n0")}
select source_file, ident as assertion_id, min(load_batch) as load_batch from {_LAST} where {_IN_SAMPLE} group by 1, 2
"""


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

P3_FOUND = f"""
with t as (
  select request_id, setting_id, unnest(texts) as text, unnest(range(len(texts))) as text_no
  from ingest_requests where texts is not null and len(texts) > 0
)
select distinct request_id, cast(text_no as int) as text_no
from t join ingest_settings using (setting_id)
where length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) > chunk_size
"""

P3_CHECK = f"""
with r as (select distinct request_id, setting_id, texts from ingest_requests where texts is not null and len(texts) > 0),
t as (select request_id, setting_id, unnest(texts) as text, unnest(range(len(texts))) as text_no from r),
u as (select distinct request_id, text_no, chunk_size, length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) as n from t join ingest_settings using (setting_id))
select chunk_size, count(*) as texts, cast(sum(n) as bigint) as characters, 0::bigint as over_limit, 0::bigint as bad_overlaps, 0::bigint as not_rebuilt from u where n > chunk_size group by 1
"""

P6_CHECK = """
select budget_id, cast(sum(length(text)) as bigint) as placed, cast(sum(ceil(length(text) / capacity_tokens)) as bigint) as pieces, 0::bigint as overfull, true as well_filled
from documents, context_budgets where length(text) > 0 group by 1
"""

P7_LONGEST = r"""
with e as (
  select case_id, cast(n as int) as entry_no, text from (select case_id, unnest(texts) as text, unnest(range(len(texts))) as n from benchmark_cases)
  union all select case_id, -1, question from benchmark_cases
), ew as (
  select case_id, entry_no, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from e where text is not null
), eg as (
  select case_id, entry_no, i, array_to_string(w[i:i + 11], ' ') as gram from (select case_id, entry_no, w, unnest(range(1, len(w) - 10)) as i from ew where len(w) >= 12)
), dw as (
  select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from documents where text is not null
), dg as (
  select doc_id, j, gram from (select doc_id, j, array_to_string(w[j:j + 11], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 10)) as j from dw where len(w) >= 12)) where gram in (select gram from eg)
), m as (
  select case_id, entry_no, doc_id, i, j, j - i as d, i - row_number() over (partition by case_id, entry_no, doc_id, j - i order by i) as run from eg join dg using (gram)
), runs as (
  select case_id, entry_no, doc_id, count(*) + 11 as words, min(j) - 1 as doc_word, min(i) - 1 as entry_word from m group by case_id, entry_no, doc_id, d, run
), best as (select *, row_number() over (partition by case_id, entry_no, doc_id order by words desc, doc_word, entry_word) as k from runs)
select case_id, entry_no, doc_id, cast(words as int) as words, cast(doc_word as int) as doc_word, cast(entry_word as int) as entry_word from best where k = 1
"""

_CANON = "list_sort([regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g') for x in %s if x is not null])"

P5_KEYS = f"""
with raw as (
  select line_id, line from background_jsonl where json_valid(line) and json_type(line) = 'OBJECT'
), parsed as (
  select line_id, json_extract_string(line, '$.nl') as nl, cast(json_extract(line, '$.pln') as varchar[]) as pln,
         json_extract_string(line, '$.source') as source, json_extract_string(line, '$.background') as background,
         json_extract_string(line, '$.relation') as relation
  from raw where json_extract_string(line, '$.nl') is not null and json_type(line, '$.pln') = 'ARRAY'
), keyed as (
  select 'ingest_item_results' as table_name, item_id as id, {_CANON % 'atoms'} as stmts, cast(null as varchar[]) as rest from ingest_item_results
  union all
  select 'vector_records', record_id, {_CANON % 'pln'}, null from vector_records
  union all
  select 'background_jsonl', line_id, {_CANON % 'pln'}, [regexp_replace(lower(nl), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), coalesce('=' || source, ''), coalesce('=' || background, ''), coalesce('=' || relation, '')] from parsed
), members as (
  select table_name, id, min(id) over g as first_id, count(*) over g as copies
  from keyed where len(stmts) > 0 window g as (partition by table_name, stmts, rest)
)
"""

P5_FOUND = P5_KEYS + "select table_name, first_id, id as copy_id from members where id <> first_id"
P5_COUNTS = P5_KEYS + "select copies, cast(count(*) / copies as bigint) as n_groups, cast(count(*) as bigint) as n_records from members group by copies"

P7_FOUND = r"""
with e as (
  select case_id, unnest(texts) as text from benchmark_cases union all select case_id, question from benchmark_cases
), ew as (
  select case_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from e where text is not null
), eg as (
  select distinct case_id, array_to_string(w[i:i + 11], ' ') as gram from (select case_id, w, unnest(range(1, len(w) - 10)) as i from ew where len(w) >= 12)
), dw as (
  select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from documents where text is not null
), dg as (
  select doc_id, array_to_string(w[i:i + 11], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12)
)
select distinct case_id, doc_id from eg join dg using (gram)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_replay": P1_REPLAY, "p1_sample": P1_SAMPLE, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_counts": P5_COUNTS, "p7_found": P7_FOUND, "p3_check": P3_CHECK, "p6_check": P6_CHECK, "p7_longest": P7_LONGEST}
