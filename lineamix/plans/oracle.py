"""The same queries in SQL for DuckDB, written independently of the operators.

Every statement starts with the views it needs, as common table expressions.
"""

from __future__ import annotations

import re

from lineamix.sources.views import LETTER_QUALITY, LETTERS, OTHER_LETTER, OTHER_QUALITY

_CODE = "cast(ascii({0}) * 65536 + ascii(substr({0}, 2, 1)) * 256 + ascii(substr({0}, 3, 1)) as int)"


def _code(name: str) -> str:
    return _CODE.format(name)


def _hash(seed: int, *cols: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({c} as varchar)" for c in cols]])
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint)"


def _class(name: str) -> str:
    return (
        f"case when {name} like 'ST%' or {name} = 'SMALL' then 'delta' "
        f"when {name} like 'EC%' or {name} like 'PR%' then 'omicron' "
        f"when {name} like 'L%' then 'recombinant' else 'other' end"
    )


_RECODE = """case when scorpio_call in ('Probable Omicron (Unassigned)', 'Omicron (Unassigned)',
  'Omicron (BA.1-like)') then 'omicron'
  when scorpio_call in ('Probable Delta (Unassigned)', 'Delta (B.1.617.2-like)', 'Delta (AY.4-like)')
  then 'delta' else scorpio_call end"""


def _posterior(keys: str) -> str:
    return f"""
  select {', '.join('o.' + k.strip() for k in keys.split(','))}, f.solution, o.odds,
    {_code('f.lineage')} as ord, f.lineage, f.fraction
  from (select solution, lineage, q / sum(q) over (partition by solution) as fraction
        from (select l_orderkey as solution, p_type as lineage, sum(l_quantity) as q
              from lineitem join part on l_partkey = p_partkey group by 1, 2)) f
  join (select sample, coverage, solution,
          round(o_totalprice / max(o_totalprice) over (partition by {keys}), 1) as odds
        from (select cast(o_custkey as varchar) as sample, o_orderkey as solution, o_totalprice,
                case when o_orderkey % 2 = 0 then '100x' else '1000x' end as coverage
              from orders)) o on o.solution = f.solution"""


def _calls(keys: str) -> str:
    return f"""
  select {keys},
    case when n % 2 = 0 then p_type || '.1' else p_type end as lineage,
    case when n % 3 = 0 then substr(p_type, 1, 1) || '.' || substr(p_type, 3, 1)
         else lower(substr(p_type, 1, 3)) end as clade,
    case p_type when 'STANDARD' then 'Delta (AY.4-like)' when 'SMALL' then 'Probable Delta (Unassigned)'
      when 'ECONOMY' then 'Omicron (BA.1-like)' when 'LARGE' then 'Omicron (Unassigned)'
      when 'PROMO' then 'Unassigned call' end as scorpio_call,
    case p_type when 'STANDARD' then 'Delta' when 'SMALL' then 'Delta' when 'ECONOMY' then 'Omicron'
      when 'PROMO' then 'Omicron' when 'LARGE' then 'Recombinant' end as clade_who
  from (select {keys}, p_type, n,
          row_number() over (partition by {keys} order by n desc, {_code('p_type')}) as rn
        from (select {keys}, p_type, count(*) as n from v_lines group by all)) where rn = 1"""


VIEWS = {
    "v_lines": """
  select cast(o_custkey as varchar) as sample,
    case when l_linestatus = 'F' then '100x' else '1000x' end as coverage,
    p_type, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey""",
    "v_counts": """
  select cast(date_trunc('month', l_shipdate) as date) as date, cast(s_nationkey as varchar) as state,
    p_brand || ' ' || case when p_size <= 10 then 'early' else 'late' end as clade,
    cast(count(*) as bigint) as sequences
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  group by 1, 2, 3""",
    "v_clades": "select date, clade, cast(sum(sequences) as bigint) as sequences from v_counts group by 1, 2",
    "v_kept": """
  select * from (select *, cast(sum(sequences) over (partition by date) as bigint) as total_sequences
                 from v_clades)
  where total_sequences >= 50 and sequences / total_sequences >= 0.01""",
    "v_freq": """
  select date, total_sequences, clade, sequences,
    sequences / sum(sequences) over (partition by date) as fraction from v_kept""",
    "v_dates": f"""
  select date from (select distinct date from v_freq) order by {_hash(1313, 'date')}, date limit 10""",
    "v_drawn": f"""
  select date, clade, fraction, count(*) over (partition by date) = 3 as complete
  from (select *, row_number() over (partition by date order by
          -ln(({_hash(42, 'date', 'clade')} + 1) / 4503599627370496.0e0) / fraction, clade) as rn
        from v_freq) where rn <= 3""",
    "v_composed": """
  select 'SimulatedSample' || n as sample, date, split_part(clade, ' ', 1) as lineage,
    fraction / sum(fraction) over (partition by date) as fraction
  from v_drawn join (select date, row_number() over (order by date) as n from v_dates) using (date)""",
    "v_abundance": """
  select cast(l_suppkey as varchar) as sample,
    case when l_linestatus = 'F' then '100x' else '1000x' end as coverage,
    p_brand as target_id, sum(l_quantity) as tpm
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3""",
    "v_mix": """
  select sample, coverage, p_type as target_id, sum(l_quantity) as tpm from v_lines group by 1, 2, 3""",
    "v_mix_all": "select sample, p_type as target_id, sum(l_quantity) as tpm from v_lines group by 1, 2",
    "v_posterior": _posterior("sample, coverage"),
    "v_posterior_all": _posterior("sample"),
    "v_best": "select * from v_posterior where odds = 1.0e0",
    "v_best_all": "select * from v_posterior_all where odds = 1.0e0",
    "v_first": """
  select * from v_best b where solution = (select min(solution) from v_best c
    where c.sample = b.sample and c.coverage = b.coverage)""",
    "v_first_all": """
  select * from v_best_all b where solution = (select min(solution) from v_best_all c
    where c.sample = b.sample)""",
    "v_truth": f"""
  select sample, {_code('target_id')} as ord, target_id as lineage,
    tpm / sum(tpm) over (partition by sample) as fraction
  from (select *, row_number() over (partition by sample order by tpm desc, target_id) as rn
        from v_mix_all) where rn <= 3""",
    "v_dominant": """
  select sample, lineage from (select *, row_number() over (partition by sample
    order by fraction desc, ord) as rn from v_truth) where rn = 1""",
    "v_listed": """
  select sample, coverage, solution, lineage from (select *, row_number() over (
    partition by sample, coverage, solution order by fraction desc, ord) as rn from v_best) where rn = 1""",
    "v_calls": _calls("sample, coverage"),
    "v_calls_all": _calls("sample"),
    "v_clade_map": "select distinct substr(p_type, 1, 3) as clade, p_type as pango from part",
    "v_top": """
  select sample, coverage, target_id as lineage from (select *, row_number() over (
    partition by sample, coverage order by tpm desc, target_id desc) as rn from v_mix) where rn = 1""",
    "v_hits": """
  select 'posterior' as tool, sample, coverage, t.lineage as truth,
    bool_or(p.lineage = t.lineage) as hit, bool_or(p.lineage = t.lineage) as exact
  from v_listed p join v_dominant t using (sample) group by 1, 2, 3, 4
  union all
  select 'consensus', sample, coverage, t.lineage, contains(p.lineage, t.lineage), p.lineage = t.lineage
  from v_calls p join v_dominant t using (sample)
  union all
  select 'abundance', sample, coverage, t.lineage, contains(p.lineage, t.lineage), p.lineage = t.lineage
  from v_top p join v_dominant t using (sample)""",
    "v_matches": """
  select distinct c.clade as pattern, m.pango
  from (select distinct clade from v_calls) c
  join v_clade_map m on regexp_matches(m.clade, c.clade, 'i')""",
    "v_clade_hits": """
  select 'clade' as tool, c.sample, c.coverage, t.lineage as truth, m.pango is not null as hit
  from v_calls c join v_dominant t on c.sample = t.sample
  left join v_matches m on m.pattern = c.clade and m.pango = t.lineage""",
    "v_all_hits": """
  select tool, sample, coverage, hit from v_hits
  union all select tool, sample, coverage, hit from v_clade_hits""",
    "v_scores": """
  select tool, coverage, count(*) as n_samples,
    count(*) / (select count(distinct sample) from v_truth) as call_rate,
    avg(case when hit then 100.0e0 else 0.0e0 end) as accuracy
  from v_all_hits group by 1, 2""",
    "v_pairs": """
  select p.sample, p.coverage, p.solution, p.lineage, coalesce(t.fraction, 0.0e0) as actual,
    p.fraction as predicted, t.lineage is not null as matched
  from v_best p left join v_truth t on p.sample = t.sample and p.lineage = t.lineage""",
    "v_folded": """
  select sample, coverage, solution, case when matched then lineage else '~other' end as lineage,
    max(actual) as actual, sum(predicted) as predicted
  from v_pairs group by 1, 2, 3, 4""",
    "v_chosen": """
  select sample, coverage, solution, rmse from (
    select *, row_number() over (partition by sample, coverage order by rmse, solution desc) as rn
    from (select sample, coverage, solution,
            round(sqrt(avg((actual - predicted) * (actual - predicted))), 12) as rmse
          from v_folded group by 1, 2, 3)) where rn = 1""",
    "v_points": "select f.*, rmse from v_folded f join v_chosen using (sample, coverage, solution)",
    "v_mix_points": """
  select sample, coverage, label, max(actual) as actual, sum(predicted) as predicted
  from (select m.sample, m.coverage, coalesce(t.lineage, '~other') as label,
          coalesce(t.fraction, 0.0e0) as actual, m.fraction as predicted
        from (select *, tpm / sum(tpm) over (partition by sample, coverage) as fraction from v_mix) m
        left join v_truth t on t.sample = m.sample and t.lineage = m.target_id)
  group by 1, 2, 3 having label <> '~other' or sum(predicted) > 0""",
    "v_tables": f"""
  select sample, lineage as prediction, {_class('lineage')} as who_name, fraction, 'truth' as tool
  from v_truth
  union all
  select sample, lineage, {_class('lineage')}, fraction, 'posterior' from v_first_all where fraction <> 0
  union all select * from v_top5
  union all select sample, lineage, {_RECODE}, 1.0e0, 'consensus' from v_calls_all
  union all select sample, lineage, lower(clade_who), 1.0e0, 'clade' from v_calls_all""",
    "v_top5": f"""
  select sample, prediction, {_class('prediction')} as who_name, fraction, 'abundance' as tool from (
    select sample, target_id as prediction, tpm / total as fraction from v_ranked where rn <= 5
    union all
    select sample, 'other', coalesce(sum(case when rn > 5 then tpm end), 0.0e0) / max(total)
    from v_ranked group by 1)""",
    "v_ranked": """
  select *, row_number() over (partition by sample order by tpm desc, target_id) as rn,
    sum(tpm) over (partition by sample) as total from v_mix_all""",
    "v_bars": """
  select sample, tool, prediction, fraction,
    sum(fraction) over (partition by sample, tool order by prediction
      rows between unbounded preceding and current row) as upto
  from (select sample, tool, prediction, sum(fraction) as fraction from v_tables group by 1, 2, 3)""",
    "v_genotype": """
  select l_suppkey, cast(l_suppkey as varchar) as lineage, cast(l_partkey as int) as pos,
    case max(l_returnflag) when 'R' then '1|1' when 'N' then '0|1' else '.|.' end as gt
  from lineitem group by l_suppkey, l_partkey""",
    "v_nation": """
  select cast(s_suppkey // 4 as varchar) as sample, s_suppkey as ord,
    cast(s_suppkey as varchar) as lineage from supplier""",
    "v_sets": """
  select distinct lineage, 'ref_' || pos || '_A_G' as variant from v_genotype
  where gt = '1|1' and lineage in (select lineage from v_nation)""",
    "v_couples": """
  select a.sample, cast(row_number() over (partition by a.sample order by a.ord, b.ord) as int) as pair_index,
    a.lineage as lineage1, b.lineage as lineage2
  from v_nation a join v_nation b on a.sample = b.sample and a.ord < b.ord""",
    "v_sizes": "select lineage, count(*) as n from v_sets group by 1",
    "v_shared": """
  select p.sample, p.pair_index, count(*) as shared
  from v_couples p join v_sets x on x.lineage = p.lineage1
  join v_sets y on y.lineage = p.lineage2 and y.variant = x.variant group by 1, 2""",
    "v_similar": """
  select p.*, coalesce(s.shared, 0) as shared,
    coalesce(a.n, 0) + coalesce(b.n, 0) - 2 * coalesce(s.shared, 0) as difference
  from v_couples p left join v_shared s on s.sample = p.sample and s.pair_index = p.pair_index
  left join v_sizes a on a.lineage = p.lineage1 left join v_sizes b on b.lineage = p.lineage2""",
    "v_share": """
  select lineage, l_suppkey, count(*) as n_calls, count(*) filter (gt = '1|1') as n_hom_alt,
    count(*) filter (gt = '1|1') / count(*) as share
  from v_genotype group by 1, 2 having count(*) filter (gt = '1|1') / count(*) >= 0.3""",
    "v_reads": """
  select cast(l_suppkey as varchar) as sample, cast(l_orderkey as varchar) as qname,
    cast(case when l_linenumber % 2 = 1 then 64 else 128 end
      + case when l_linestatus = 'F' then 16 else 0 end
      + case when l_discount = 0 then 4 else 0 end as int) as flag,
    case when l_discount <> 0 then 'chr1' end as chrom,
    case when l_discount <> 0 then l_partkey * 60 end as "start",
    case when l_discount <> 0 then l_partkey * 60 + cast(l_quantity as bigint) end as "end"
  from lineitem""",
    "v_regions": """
  select distinct g_start, g_start + p_size as g_end from (select p_size,
    p_partkey * 60 + case when p_partkey % 3 = 0 then -5 else 25 end as g_start from part)""",
    "v_clipped": """
  select flag, "start", "end", any_value(sample) as sample, cast(max(case
    when g_start is null then 0
    when (flag & 16) = 0 and g_start <= "start" then least(g_end, "end") - "start"
    when (flag & 16) <> 0 and g_end >= "end" then "end" - greatest(g_start, "start")
    else 0 end) as bigint) as clip
  from (select *, row_number() over () as id from v_reads) r
  left join v_regions on "start" < g_end and "end" > g_start
  group by id, flag, "start", "end" """,
    "v_fastq": f"""
  select source as sample, cast(doc_id as varchar) as read_id, seq,
    translate(regexp_replace(seq, '[^a-z]', '{OTHER_LETTER}', 'g'), '{LETTERS}{OTHER_LETTER}', '{LETTER_QUALITY}{OTHER_QUALITY}') as qual
  from (select *, regexp_replace(text, '[ \\t\\n\\r]', '', 'g') as seq from documents)""",
    "v_cells": """
  select p_partkey, p_size, p_type, s_suppkey, coalesce(n || ':' || call,
    '.:' || case when (p_partkey + s_suppkey) % 10 < 3 then '1|1' else './.' end) as cell
  from (select * from part where p_partkey in (select l_partkey from lineitem)) cross join supplier
  left join (select l_partkey, l_suppkey, count(*) as n,
      case max(l_returnflag) when 'R' then '1/1' when 'N' then '0|1' else './.' end as call
    from lineitem group by 1, 2) on l_partkey = p_partkey and l_suppkey = s_suppkey""",
    "v_copies": """
  select p_partkey, s_suppkey, cell, p_size, p_type, p_partkey * 2 + 10 + copy as line_no
  from v_cells, (values (0), (1)) c(copy) where copy = 0 or p_size < 5""",
    "v_called": """
  select s_suppkey, cast(s_suppkey as varchar) as lineage, replace(split_part(cell, ':', 2), '/', '|') as gt, p_partkey from v_copies""",
    "v_hom": """
  select s_suppkey, lineage from v_called group by 1, 2 having count(*) filter (gt = '1|1') / count(*) >= 0.3""",
    "v_post": """
  select o_custkey, l_orderkey, p_type, sum(l_quantity) as q
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2, 3""",
    "v_post_types": """
  select o_custkey, p_type, cast(row_number() over (partition by o_custkey order by p_type) + 1 as int) as ord
  from (select distinct o_custkey, p_type from v_post)""",
    "v_haps": """
  select cast(o_custkey as varchar) as sample, o_orderkey as hap_id,
    o_totalprice / sum(o_totalprice) over (partition by o_custkey) as frequency from orders""",
    "v_aln": """
  select l_orderkey as hap_id, case l_returnflag when 'A' then 16 when 'N' then 272 else 4 end as flag,
    'strain' || (l_suppkey % 5) as lineage,
    cast(l_linenumber as bigint) * 100000000000000 + l_partkey * 1000000 + l_suppkey as line_no
  from lineitem join orders on l_orderkey = o_orderkey""",
    "v_hap_found": """
  select sample, lineage, sum(frequency) as fraction
  from (select hap_id, lineage from (select *, row_number() over (partition by hap_id
          order by line_no desc) as rn from v_aln where (flag & 2308) = 0) where rn = 1)
  join v_haps using (hap_id) group by 1, 2""",
    "v_meta": """
  select cast(c_custkey as varchar) as sample, cast(min(o_orderdate) as date) as collection_date
  from customer left join orders on c_custkey = o_custkey group by 1""",
    "v_mix_reads": """
  select sample, p_type as lineage,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as read_id, mate
  from v_lines, (values (1), (2)) m(mate)""",
    "v_sampled": f"""
  select r.sample, r.lineage, r.read_id, r.mate from v_mix_reads r
  join (select sample, lineage, read_id, row_number() over (partition by sample, lineage
          order by {_hash(100, 'sample', 'lineage', 'read_id')}, read_id) as rn
        from (select distinct sample, lineage, read_id from v_mix_reads)) k
    on r.sample = k.sample and r.lineage = k.lineage and r.read_id = k.read_id
  join v_truth t on t.sample = r.sample and t.lineage = r.lineage
  where rn <= cast(trunc(t.fraction * 20) as int)""",
    "v_names": """
  select distinct p_type as target_id,
    case when length(p_type) > 5 then substr(p_type, 1, 2) else p_type end as short from part""",
}


def _needed(text: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", text):
        if name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def sql(body: str) -> str:
    """Put the needed views before the statement."""
    found = _needed(body, [])
    if not found:
        return body.strip()
    views = ",\n".join(f"{name} as ({VIEWS[name]})" for name in found)
    return f"with {views}\n{body.strip()}"


def _r9(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 9) + 0.0e0 as {alias or expr}"


def _spearman(source: str, key: str, x: str, y: str) -> str:
    def rank(v: str) -> str:
        peers = f"count(*) over (partition by {key}, round({v}, 12))"
        return f"rank() over (partition by {key} order by round({v}, 12)) + ({peers} - 1) / 2.0e0"

    return f"""(select {key}, corr(rx, ry) as spearman, count(*) as n_points
  from (select {key}, {rank(x)} as rx, {rank(y)} as ry from {source}) group by 1)"""


_WIDE = ", ".join(
    [f"max(case when pair_index = {i} then lineage1 || ' vs ' || lineage2 end) as Lineage_Pair_{i}" for i in range(1, 7)]
    + [f"max(case when pair_index = {i} then difference end) as Diff_{i}" for i in range(1, 7)]
    + [f"max(case when pair_index = {i} then shared end) as Shared_{i}" for i in range(1, 7)]
)
_WATCHED = "(select unnest(['LARGE', 'PROMO']) as lineage)"


def _max_abundance(view: str, keys: str) -> str:
    on = " and ".join(f"p.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""select {', '.join('g.' + k.strip() for k in keys.split(','))}, g.lineage,
  coalesce(max(case when p.odds = 1.0e0 and p.fraction > 0 then p.fraction end), 0.0e0) * 100 as abundance
  from (select * from (select distinct {keys} from {view}), {_WATCHED}) g
  left join {view} p on {on} and p.lineage = g.lineage group by all"""


def _merged(tools: list[str]) -> str:
    columns = ", ".join(
        f"{t}.n_samples as {t}_n_samples, {_r9(f'{t}.call_rate', f'{t}_call_rate')}, {_r9(f'{t}.accuracy', f'{t}_accuracy')}" for t in tools
    )
    joins = " ".join(f"left join (select * from v_scores where tool = '{t}') {t} on {t}.coverage = c.coverage" for t in tools)
    listed = ", ".join(f"'{t}'" for t in tools)
    return f"select c.coverage, {columns} from (select distinct coverage from v_scores where tool in ({listed})) c {joins}"


_TRIMMED = """
  select sample, read_id, substr(seq, a, z - a + w) as seq, substr(qual, a, z - a + w) as qual
  from v_fastq join (
    select sample, read_id, least(4, n) as w, min(i) as a, max(i) as z
    from (select sample, read_id, i, count(*) over (partition by sample, read_id) as n,
            sum(q) over (partition by sample, read_id order by i
              rows between current row and 3 following) as total
          from (select sample, read_id, unnest(range(1, length(qual) + 1)) as i,
                  ascii(unnest(string_split(qual, ''))) - 33 as q from v_fastq where seq <> ''))
    where i <= n - least(4, n) + 1 and total >= 28 * least(4, n) group by 1, 2, 3)
  using (sample, read_id)"""


_BODIES: dict[str, str] = {
    "clade_counts": "select date, clade, sequences from v_clades",
    "clade_map": """select date, cast(count(*) over (partition by date) as int) as n_clades, clade, sequences
        from v_clades""",
    "clade_freq": f"select date, total_sequences, clade, sequences, {_r9('fraction')} from v_freq",
    "freq_map": f"select date, total_sequences, clade, {_r9('fraction')} from v_freq",
    "fractions": f"""select sample, coverage, target_id, tpm,
        {_r9('tpm / sum(tpm) over (partition by sample, coverage)', 'fraction')} from v_abundance""",
    "top1_target": """select sample, coverage, target_id as lineage from (select *, row_number() over (
        partition by sample, coverage order by tpm desc, target_id desc) as rn from v_abundance) where rn = 1""",
    "top5_other": f"""select sample, coverage, prediction, {_r9('fraction')} from (
        with r as (select *, row_number() over (partition by sample, coverage order by tpm desc, target_id) as rn,
          sum(tpm) over (partition by sample, coverage) as total from v_abundance)
        select sample, coverage, target_id as prediction, tpm / total as fraction from r where rn <= 5
        union all
        select sample, coverage, 'other', coalesce(sum(case when rn > 5 then tpm end), 0.0e0) / max(total)
        from r group by 1, 2)""",
    "abundance_order": """select sample, coverage, target_id, tpm, row_number() over (
        partition by sample, coverage order by tpm desc, target_id) as position from v_abundance""",
    "best_solutions": f"select sample, coverage, solution, odds, lineage, {_r9('fraction')} from v_best",
    "first_solution": f"select sample, coverage, solution, lineage, {_r9('fraction')} from v_first",
    "dominant_per_solution": """select sample, coverage, lineage, count(*) as n_solutions
        from v_listed group by 1, 2, 3""",
    "max_abundance": f"""select sample, lineage, {_r9('abundance')}
        from ({_max_abundance('v_posterior', 'sample')})""",
    "abundance_grid": f"""select sample, coverage, lineage, {_r9('coalesce(fraction, 0)', 'fraction')}
        from (select * from (select distinct sample, coverage from v_first), {_WATCHED}) g
        left join (select sample, coverage, lineage, fraction from v_first) f using (sample, coverage, lineage)""",
    "dominant_truth": "select sample, lineage from v_dominant",
    "truth_pairs": f"""select sample, coverage, solution, lineage, {_r9('actual')}, {_r9('predicted')}, matched
        from v_pairs""",
    "fold_unmatched": f"""select sample, coverage, solution, lineage, {_r9('actual')}, {_r9('predicted')}
        from v_folded""",
    "best_rmse": f"""select sample, coverage, solution, lineage, {_r9('rmse')}, {_r9('actual')},
        {_r9('predicted')} from v_points""",
    "mse_points": f"""select coverage, {_r9('avg((actual - predicted) * (actual - predicted))', 'mse')},
        count(*) as n_points from v_points group by 1""",
    "spearman": f"""select l_returnflag, {_r9('spearman')}, n_points
        from {_spearman('lineitem', 'l_returnflag', 'l_quantity', 'l_extendedprice')}""",
    "key_parity": """select sample, coverage, p.sample is not null as in_predictions, t.sample is not null as in_truth
        from (select distinct sample, coverage from v_posterior) p
        full join (select distinct sample, coverage from v_truth, (values ('100x'), ('1000x')) c(coverage)) t
          using (sample, coverage)
        where p.sample is null or t.sample is null""",
    "call_match": """select tool, sample, coverage, truth, hit as hit_substring, exact as hit_exact from v_hits""",
    "clade_match": "select sample, coverage, truth, hit from v_clade_hits",
    "tool_accuracy": f"""select tool, coverage, n_samples, {_r9('call_rate')}, {_r9('accuracy')}
        from v_scores where tool <> 'clade'""",
    "clade_accuracy": f"""select tool, coverage, n_samples, {_r9('call_rate')}, {_r9('accuracy')}
        from v_scores where tool = 'clade'""",
    "merge_tools": _merged(["posterior", "consensus", "abundance"]),
    "classify_lineage": f"""select p_type as lineage, {_class('p_type')} as who_name, count(*) as n
        from part group by 1""",
    "recode_calls": f"select sample, coverage, scorpio_call, {_RECODE} as who_name from v_calls",
    "rename_keys": """select sample, coverage, short as target_id, tpm from v_mix join v_names using (target_id)""",
    "canonical_predictions": f"select sample, prediction, who_name, {_r9('fraction')}, tool from v_top5",
    "all_predictions": f"select sample, prediction, who_name, {_r9('fraction')}, tool from v_tables",
    "distinct_values": "select distinct who_name, prediction from v_tables",
    "page": f"""select sample, prediction, who_name, {_r9('fraction')}, tool from v_tables
        order by sample, tool, prediction, who_name limit 25 offset 25""",
    "stacked_fractions": f"""select sample, tool, cast(list_position(
          ['truth', 'posterior', 'abundance', 'consensus', 'clade'], tool) as int) as tool_order, prediction,
        {_r9('fraction')}, {_r9('least(greatest(upto - fraction, 0), 1)', 'bar_start')},
        {_r9('least(greatest(upto, 0), 1)', 'bar_end')} from v_bars""",
    "mse_by_tool": f"""select tool, {_r9('avg((f - t) * (f - t))', 'mse')}, count(*) as n_cells from (
        select unnest(['posterior', 'abundance']) as tool, t, unnest([p, a]) as f from (
          select sample, who_name, coalesce(sum(fraction) filter (tool = 'truth'), 0) as t,
            coalesce(sum(fraction) filter (tool = 'posterior'), 0) as p,
            coalesce(sum(fraction) filter (tool = 'abundance'), 0) as a
          from v_tables where who_name in ('omicron', 'delta') and sample not in ('0', '1')
            and tool in ('truth', 'posterior', 'abundance')
          group by 1, 2)) group by 1""",
    "hom_alt_share": f"select lineage, n_calls, n_hom_alt, {_r9('share')} from v_share",
    "variant_sets": "select lineage, variant from v_sets",
    "lineage_pairs": "select sample, pair_index, lineage1, lineage2 from v_couples",
    "lineage_similarity": "select sample, pair_index, lineage1, lineage2, shared, difference from v_similar",
    "similarity_wide": f"select sample, {_WIDE} from v_similar group by 1",
    "sample_dates": "select date from v_dates",
    "weighted_sample3": f"select date, clade, {_r9('fraction')}, complete from v_drawn",
    "compose_samples": f"select sample, date, lineage, {_r9('fraction')} from v_composed",
    "read_quota": """select sample, lineage, coverage, cast(trunc(fraction * n) as int) as num_reads
        from v_truth, (values ('100x', 20000), ('1000x', 200000)) d(coverage, n)""",
    "sample_n_reads": "select sample, lineage, read_id, mate from v_sampled",
    "bernoulli_subset": f"""select o_orderkey from orders
        where ({_hash(42, 'o_orderkey')} + 1) / 4503599627370496.0e0 <= 0.1e0""",
    "interval_anti": """select sample, flag, "start", "end", count(*) as n from v_reads r
        where not exists (select 1 from v_regions where r."start" < g_end and r."end" > g_start)
        group by 1, 2, 3, 4""",
    "primer_clip": 'select flag, "start", "end", clip, count(*) as n from v_clipped group by 1, 2, 3, 4',
    "mate_pairs": """select sample, qname, case when flag & 64 <> 0 then 1 else 2 end as mate, singleton,
        count(*) as n from v_reads join (select sample, qname, count(distinct flag & 64) = 1 as singleton
          from v_reads group by 1, 2) using (sample, qname) group by 1, 2, 3, 4""",
    "coordinate_sort": """select chrom, "start", "end", sample, qname, flag, copies,
        cast(sum(copies) over (order by chrom nulls last, "start", "end", sample, qname, flag
          rows between unbounded preceding and current row) - copies + 1 as bigint) as first_position
        from (select chrom, "start", "end", sample, qname, flag, count(*) as copies from v_reads group by all)""",
    "primary_alignments": "select hap_id, lineage, line_no from v_aln where (flag & 2308) = 0",
    "hap_abundance": f"select sample, lineage, {_r9('fraction')} from v_hap_found",
    "read_qc": f"""select sample, pos, {_r9('avg(ascii(q) - 33)', 'mean_quality')}, count(*) as n_reads,
        count(*) filter (lower(b) = 'a') as n_a, count(*) filter (lower(b) = 'c') as n_c,
        count(*) filter (lower(b) = 'g') as n_g, count(*) filter (lower(b) = 't') as n_t
        from (select sample, unnest(string_split(regexp_replace(seq, '[^a-zA-Z]', '_', 'g'), '')) as b, unnest(string_split(qual, '')) as q,
                cast(unnest(range(1, length(seq) + 1)) as int) as pos from v_fastq where seq <> '') group by 1, 2""",
    "read_summary": """select sample, count(*) as n_reads, cast(sum(length(seq)) as bigint) as n_bases,
        min(length(seq)) as min_length, max(length(seq)) as max_length from v_fastq group by 1""",
    "quality_filter": """select sample, read_id, cast(length(seq) as int) as length from v_fastq
        where length(regexp_replace(qual, '[5-~]', '', 'g')) <= length(qual) * 0.4e0""",
    "quality_trim": f"""select sample, read_id, cast(length(seq) as int) as length, md5(seq) as seq_md5,
        md5(qual) as qual_md5 from ({_TRIMMED})""",
    "contig_lengths": r"""select doc_id, length(regexp_replace(text, '\s', '', 'g')) as length from documents""",
    "metadata_lookup": f"""select sample, coalesce(cast(collection_date as varchar), 'NA') as collection_date,
        {_r9('measure')} from v_meta left join (select sample, max(fraction) as measure
          from v_first_all group by 1) using (sample)""",
    "route_reads": """select sample, primer, case when primer is null then 'trimmed' else 'clipped' end as route
        from (select distinct sample from v_truth) left join (select cast(c_custkey as varchar) as sample,
          case c_nationkey % 3 when 0 then 'v3' when 1 then 'v4' end as primer from customer) using (sample)""",
    "sample_grid": """select cast(c_custkey as varchar) as sample, coverage
        from customer, (values ('100x'), ('1000x')) c(coverage)
        where (cast(c_custkey as varchar), coverage) not in (select sample, coverage from v_posterior)""",
    "natural_order": r"""select p_brand, 'Brand#|' || lpad(cast(length(digits) as varchar), 6, '0') || digits
        as natural_key, cast(digits as bigint) as suffix, n
        from (select p_brand, regexp_extract(p_brand, '(\d+)$', 1) as digits, count(*) as n from part group by 1, 2)""",
    "name_order": """select name, min(position) as first, max(position) as last
        from (select 'r' || qname || case m when 2 then '.02' else '.1' end || '/' || length(qname) as name,
            row_number() over (order by cast(qname as bigint), m) as position
          from (select *, case when flag & 64 = 0 then 2 else 1 end as m from v_reads)) group by 1""",
    "positional_zip": f"""select sample, position, lineage, target_id, {_r9('fraction')}, tpm
        from (select *, row_number() over (partition by sample order by lineage) as position from v_truth)
        join (select *, row_number() over (partition by sample order by target_id) as position from v_mix_all)
        using (sample, position)""",
    "vcf_records": """select line_no, 'ref' as chrom, cast(p_partkey as int) as pos, 'id' || p_partkey as id, 'A' as ref,
          'G,T' as alt, cast(p_size as varchar) as qual, case when p_size < 10 then 'low' else 'PASS' end as filter,
          'TYPE=' || p_type as info, 'DP:GT' as format, cast(count(*) as int) as n_cells,
          md5(string_agg(cell, ',' order by s_suppkey)) as cells
        from v_copies group by line_no, p_partkey, p_size, p_type""",
    "vcf_genotypes": """select lineage, cast(dense_rank() over (order by s_suppkey) - 1 as int) as ord, gt, n, places
        from (select s_suppkey, lineage, gt, count(*) as n, cast(sum(p_partkey) as bigint) as places
              from v_called group by 1, 2, 3)""",
    "sam_alignments": """select '/aln/' || l_suppkey || '.sam' as file, l_orderkey * 8 + l_linenumber as line_no, 'r' || l_orderkey as qname,
          cast(case when l_discount <> 0 then l_linenumber * 16 else 4 end as int) as flag,
          case when l_discount <> 0 and (l_linenumber * 16) & 4 = 0 then 'chr' || l_partkey end as chrom,
          case when l_discount <> 0 then l_partkey end as "start",
          case when l_discount <> 0 then l_partkey + cast(l_quantity as bigint) + 1 + l_linenumber end as "end",
          '=' as rnext, cast(l_partkey as int) as pnext, cast(-l_quantity as int) as tlen,
          'NM:i:' || l_linenumber || case when l_returnflag = 'R' then ';XR:Z:a b' else '' end as tags
        from lineitem""",
    "sam_round_trip": """select '/aln/' || l_suppkey || '.sam' as file, l_orderkey * 8 + l_linenumber as line_no,
          md5(concat_ws(chr(9), 'r' || l_orderkey, case when l_discount <> 0 then l_linenumber * 16 else 4 end,
            case when l_discount <> 0 then 'chr' || l_partkey else '*' end, case when l_discount <> 0 then l_partkey + 1 else 0 end, '60',
            case when l_discount <> 0 then '2S' || cast(l_quantity as int) || 'M1D3I' || l_linenumber || '=' else '*' end,
            '=', l_partkey, '-' || cast(l_quantity as int), '*', '*', 'NM:i:' || l_linenumber,
            case when l_returnflag = 'R' then 'XR:Z:a b' end)) as line
        from lineitem""",
    "fastq_reads": """select sample, read_id, 1 as mate, cast(length(coalesce(seq, '')) as int) as bases,
          md5(coalesce(seq, '')) as seq, md5(coalesce(qual, '')) as qual from v_fastq""",
    "posterior_long": """select cast(o_custkey as varchar) as sample, '100x' as coverage, cast(l_orderkey + 1 as int) as solution, t.ord,
          0.5e0 as density, cast(l_orderkey % 2 as double) as odds, t.p_type as lineage, coalesce(q, 0.0e0) as fraction
        from (select distinct o_custkey, l_orderkey from v_post) o join v_post_types t using (o_custkey)
        left join v_post p using (o_custkey, l_orderkey, p_type)""",
    "whitespace_table": """select case when c_custkey % 7 <> 0 then collection_date end as "CollectionDate",
          cast(c_custkey as varchar) as "SRA_ID", cast(null as int) as "Other"
        from customer join v_meta on sample = cast(c_custkey as varchar)""",
    "bed_intervals": """select 'chr1' as chrom, p_partkey * 60 as "start", p_partkey * 60 + p_size as "end",
          case when p_partkey % 2 = 0 then p_name end as name, case when p_partkey % 2 = 0 then cast(p_size as varchar) end as pool,
          case when p_partkey % 2 = 0 and p_size > 20 then '+' end as strand, cast(null as varchar) as seq from part""",
    "fasta_sequences": r"""select 'p' || doc_id as contig,
          'p' || doc_id || case when doc_id % 3 = 0 then ' 10x frequency=0.' || doc_id else ' none' end as description,
          case when doc_id % 3 = 0 then cast('0.' || doc_id as double) end as frequency,
          md5(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g')) as sequence from documents""",
    "accession_list": "select s_name as accession from supplier where s_suppkey % 5 <> 0",
    "path_dims": """select o_orderkey, layout, 'S' || o_custkey as sample, case when o_orderkey % 3 <> 0 then '100x' end as coverage,
          case layout when 'file' then '/x.y/' when 'folder' then '/x/' else '/x/quant_results_' end || 'S' || o_custkey
          || case when o_orderkey % 3 <> 0 then '-100x' else '' end
          || case layout when 'file' then '.tar.csv' when 'folder' then '/out.tsv' else '/abundance.tsv' end as file
        from (select *, ['file', 'folder', 'quant_folder'][o_custkey % 3 + 1] as layout from orders)""",
    "mate_dims": """select o_orderkey, 'S' || o_custkey as sample,
          case when o_orderkey % 3 <> 0 then cast(o_orderkey % 3 as int) end as mate from orders""",
    "first_rows": """select cast(l_orderkey as varchar) as file, arg_min(l_partkey, row_id) as l_partkey,
          arg_min(l_quantity, row_id) as l_quantity
        from (select *, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + cast(l_quantity as bigint) as row_id from lineitem)
        group by 1""",
    "column_pair": "select distinct p_brand as brand, p_type as type from part",
    "report_names": """select s_suppkey, case when contains(s_name, '#00000000') then substr(s_name, strpos(s_name, '#00000000'))
          else 'Substring not found' end as part, 'https://example.org/' || s_name as link from supplier""",
    "similarity_cells": f"""select sample, {', '.join(
        f"concat_ws('=', Lineage_Pair_{i}, {m}_{i}) as {m}_{i}" for m in ('Diff', 'Shared') for i in range(1, 7))}
        from (select sample, {_WIDE} from v_similar group by 1)""",
    "study_vcf_filter": """select 0 as line_no, '##fileformat=VCFv4.2' as value union all select 1, '##INFO=<ID=TYPE>' union all
        select 2, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT',
          (select string_agg(lineage, chr(9) order by s_suppkey) from v_hom)) union all
        select line_no, concat_ws(chr(9), 'ref', p_partkey, 'id' || p_partkey, 'A', 'G,T', p_size,
          case when p_size < 10 then 'low' else 'PASS' end, 'TYPE=' || p_type, 'DP:GT', string_agg(cell, chr(9) order by s_suppkey))
        from v_copies where s_suppkey in (select s_suppkey from v_hom) group by line_no, p_partkey, p_size, p_type""",
    "study_simulation_input": f"""select sample, date, lineage, {_r9('fraction')}, coverage,
        cast(trunc(fraction * n) as int) as num_reads
        from v_composed, (values ('100x', 20000), ('1000x', 200000)) d(coverage, n)""",
    "study_abundant_validation": _merged(["posterior", "consensus", "abundance", "clade"]),
    "study_scatter_posterior": f"""select coverage, {_r9('mse')}, n_points, {_r9('spearman')}
        from (select coverage, avg((actual - predicted) * (actual - predicted)) as mse from v_points group by 1)
        join {_spearman('v_points', 'coverage', 'actual', 'predicted')} using (coverage)""",
    "study_scatter_abundance": f"""select coverage, {_r9('mse')}, n_points, {_r9('spearman')}
        from (select coverage, avg((actual - predicted) * (actual - predicted)) as mse from v_mix_points group by 1)
        join {_spearman('v_mix_points', 'coverage', 'actual', 'predicted')} using (coverage)""",
    "study_labmix": f"""select coverage, {_r9('spearman')}, n_points from {_spearman('''(
        select m.coverage, coalesce(t.fraction, 0.0e0) as actual, m.fraction as predicted
        from (select sample, coverage, short, tpm / sum(tpm) over (partition by sample, coverage) as fraction
              from v_mix join v_names using (target_id)) m
        left join (select sample, short, fraction from v_truth join v_names on lineage = target_id) t
          on t.sample = m.sample and t.short = m.short)''', 'coverage', 'actual', 'predicted')}""",
    "study_labmix_posterior": f"""select coverage, {_r9('spearman')}, n_points from {_spearman('''(
        select c.coverage, t.fraction as actual, coalesce(p.fraction, 0.0e0) as predicted
        from (select sample, coverage, min(solution) as solution from v_posterior where odds = 1.0e0 group by 1, 2) c
        join (select sample, short, sum(fraction) as fraction from v_truth join v_names on lineage = target_id group by 1, 2) t
          on t.sample = c.sample
        left join (select sample, coverage, solution, short, sum(fraction) as fraction
          from v_posterior join v_names on lineage = target_id and length(target_id) > 5 group by all) p
          on p.sample = c.sample and p.coverage = c.coverage and p.solution = c.solution and p.short = t.short)''', 'coverage', 'actual', 'predicted')}""",
    "study_coinfection": f"""select tool, cast(list_position(
          ['truth', 'posterior', 'abundance', 'consensus', 'clade'], tool) as int) as tool_order, prediction,
        count(*) as n_samples, {_r9('avg(fraction)', 'mean_fraction')},
        {_r9('max(least(greatest(upto, 0), 1))', 'highest')} from v_bars group by 1, 2, 3""",
    "study_coinfection_errors": f"""select b.tool, cast(list_position(
          ['truth', 'posterior', 'abundance', 'consensus', 'clade'], b.tool) as int) as tool_order,
        n_samples, n_bars, n_cells, round(e.mse, 9) + 0.0e0 as mse, printf('%.4f', e.mse) as label
        from (select tool, count(distinct sample) as n_samples, count(*) as n_bars from v_bars group by 1) b
        left join (select tool, avg((f - t) * (f - t)) as mse, count(*) as n_cells from (
            select unnest(['posterior', 'abundance', 'consensus']) as tool, t, unnest([p, a, c]) as f from (
              select sample, who_name, coalesce(sum(fraction) filter (tool = 'truth'), 0) as t,
                coalesce(sum(fraction) filter (tool = 'posterior'), 0) as p,
                coalesce(sum(fraction) filter (tool = 'abundance'), 0) as a,
                coalesce(sum(fraction) filter (tool = 'consensus'), 0) as c
              from v_tables where who_name in ('omicron', 'delta') and tool <> 'clade' group by 1, 2)) group by 1) e
          on e.tool = b.tool""",
    "study_similarity": f"select sample, {_WIDE} from v_similar group by 1",
    "study_genotype_filter": r"""select 1 as kind, 0 as pos,
          '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL'
          || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9)
          || string_agg(lineage, chr(9) order by l_suppkey) as value from v_share
        union all
        select 2, pos, array_to_string(['ref', cast(pos as varchar), '.', 'A', 'G', '.', '.', '.', 'GT'], chr(9))
          || chr(9) || string_agg(coalesce(gt, './.'), chr(9) order by l_suppkey)
        from (select p.pos, k.l_suppkey, g.gt
              from (select distinct pos from v_genotype where lineage in (select lineage from v_share)) p
              cross join v_share k left join v_genotype g on g.pos = p.pos and g.l_suppkey = k.l_suppkey)
        group by pos""",
    "study_monitoring": f"""select m.sample, strftime(m.collection_date, '%Y-%m-%d') as collection_date,
        w.lineage, {_r9('a.abundance', 'abundance')}
        from v_meta m cross join {_WATCHED} w
        left join ({_max_abundance('v_posterior_all', 'sample')}) a on a.sample = m.sample and a.lineage = w.lineage""",
    "study_hap_abundance": f"""select sample, lineage, {_r9('coalesce(t.fraction, 0)', 'actual')},
        {_r9('coalesce(f.fraction, 0)', 'predicted')}
        from (select * from (select distinct sample from v_hap_found),
          (select unnest(['strain0', 'strain1', 'strain2', 'strain3', 'strain4', 'strain9']) as lineage))
        left join v_hap_found f using (sample, lineage)
        left join (select sample, 'strain' || (hap_id % 5) as lineage, sum(frequency) as fraction
          from v_haps group by 1, 2) t using (sample, lineage)""",
    "study_read_mix": "select sample, mate, count(*) as n from v_sampled group by 1, 2",
    "study_clipped_reads": """select r.sample, r.flag,
        case when r.flag & 16 = 0 then r."start" + clip else r."start" end as "start",
        case when r.flag & 16 <> 0 then r."end" - clip else r."end" end as "end", count(*) as n
        from v_reads r join (select distinct flag, "start", "end", clip from v_clipped) c
          on r.flag = c.flag and r."start" is not distinct from c."start" and r."end" is not distinct from c."end"
        group by 1, 2, 3, 4""",
}

ORACLE = {key: sql(body) for key, body in _BODIES.items()}
