"""DuckDB SQL with the results of :mod:`ionweave.plans.queries`, written without a look at how those work."""

from __future__ import annotations

from ..functions.peaks import HYDROGEN
from .queries import HIGH, LOW

RAW = """
with b as (
  select l_partkey pk, l_orderkey ok, unnest([0, 1, 2]) r, cast(l_extendedprice as double) ep, cast(l_quantity as double) lq from lineitem
), raw as (
  select pk * 3 + r sid, 60.0::double + 0.5::double * floor((ep - 1600::double * floor(ep / 1600::double)) / 0.5::double) + 0.01::double * r mz,
    max(lq * lq * (1 + 0.05::double * r * (ok % 3)) + (ok % 997) * 0.0005::double + 0.37::double) intensity
  from b where (ok + r) % 11 <> 0 group by all
), spec as (
  select distinct sid, sid // 3 pk, sid % 3 r, case when (sid // 3) % 7 = 0 then null else ((sid // 3) % 3) + 1 end charge,
    cast(400 + ((sid // 3) % 97) * 0.5::double + [0.0::double, 0.002::double, 0.005::double][(sid % 3) + 1] as double) pmz,
    cast(((sid // 3) * 7 % 3600) + [0, 9, 4][(sid % 3) + 1] as double) rt
  from raw
)"""

CLEAN = f"""{RAW}, rng as (
  select * from raw where mz >= {LOW!r}::double and mz <= {HIGH!r}::double
), prec as (
  select g.* from rng g join spec s using (sid)
  where len(list_filter(range(1, coalesce(charge, 1) + 1), lambda c: abs(mz - ((pmz - {HYDROGEN!r}::double) * coalesce(charge, 1) / c + {HYDROGEN!r}::double)) <= 1.5::double)) = 0
), strong as (
  select * from (select *, max(intensity) over (partition by sid) top from prec) where intensity > 0.01::double * top
), best as (
  select * from (select *, row_number() over (partition by sid order by intensity desc, mz) k from strong) where k <= 20
), unit as (
  select sid, mz, intensity / sqrt(sum(intensity * intensity) over (partition by sid)) x from best
)"""

BLOCKS = """, ordered as (
  select *, coalesce(charge, -128) z, lag(pmz) over (partition by charge order by pmz, sid) was from spec
), blocked as (
  select *, sum(case when {gap} then 1 else 0 end) over (partition by charge order by pmz, sid) block from ordered
)"""
PPM = BLOCKS.format(gap="(pmz - was) / was * 1e6 > 20")

PAIRS = f"""{CLEAN}{PPM}, matches as (
  select a.sid s1, b.sid s2, p.x * q.x w
  from blocked a join blocked b on a.z = b.z and a.block = b.block and a.sid < b.sid
  join unit p on p.sid = a.sid join unit q on q.sid = b.sid and floor(p.mz) - floor(q.mz) between -1 and 1 and abs(p.mz - q.mz) <= 0.05::double
), scored as (
  select s1, s2, count(*) n_match, sum(w) dot from matches group by all
), pairs as (
  select s1, s2, n_match, 1 - greatest(0, least(1, dot)) distance from scored
)"""

# similar spectra are replicas of one part, at most three, so the merges can be listed
TRIPLES = f"""{PAIRS}, d as (
  select pk, max(case when r = 0 then sid end) a, max(case when r = 1 then sid end) b, max(case when r = 2 then sid end) c from spec group by pk
), dist as (
  select d.*, coalesce(x.distance, 1) ab, coalesce(y.distance, 1) ac, coalesce(v.distance, 1) bc from d
  left join pairs x on x.s1 = a and x.s2 = b left join pairs y on y.s1 = a and y.s2 = c left join pairs v on v.s1 = b and v.s2 = c
), first as (
  select *, least(ab, ac, bc) low, case when ab <= ac and ab <= bc then 'ab' when ac <= bc then 'ac' else 'bc' end pair from dist
), merged as (
  select *, low <= 0.1 two,
    low <= 0.1 and case pair when 'ab' then {{f}}(ac, bc) when 'ac' then {{f}}(ab, bc) else {{f}}(ab, ac) end <= 0.1 three from first
), labels as (
  select unnest([a, b, c]) sid, unnest([a, case when three or (two and pair = 'ab') then a else b end,
    case when three or (two and pair = 'ac') then a when two and pair = 'bc' then b else c end]) cluster, ab, ac, bc from merged
), clusters as (
  select sid, cluster, ab, ac, bc from labels where sid is not null
)"""


def _triples(f: str) -> str:
    sql = TRIPLES.replace("{f}", f)
    return sql if f != "mean" else sql.replace("mean(ac, bc)", "((ac + bc) / 2)").replace("mean(ab, bc)", "((ab + bc) / 2)").replace("mean(ab, ac)", "((ab + ac) / 2)")


COMPLETE = _triples("greatest")
# who is in a cluster with whom, by replica
MATES = f"""{COMPLETE}, mates as (
  select c.sid, c.sid % 3 r, c.cluster, bool_or(o.sid % 3 = 0) a, bool_or(o.sid % 3 = 1) b, bool_or(o.sid % 3 = 2) c
  from clusters c join clusters o using (cluster) group by all
)"""
HEADS = f"""{COMPLETE}, sums as (
  select x.sid, x.cluster, coalesce(sum(case when y.sid <> x.sid then
    case when (x.sid % 3) + (y.sid % 3) = 1 then x.ab when (x.sid % 3) + (y.sid % 3) = 2 then x.ac else x.bc end end), 0) total
  from clusters x join clusters y using (cluster) group by all
), heads as (
  select sid, cluster, row_number() over (partition by cluster order by round(total, 12), sid) = 1 is_representative from sums
)"""

OF = "select sid, count(*) n_peaks, min(mz) first_mz, round(sum(cast(cast(intensity as float) as double)), 4) total from raw group by sid"
ROWS = "select sid, mz, round(intensity, 6) intensity"

ORACLES = {
    "mz_range_filter": f"{CLEAN} {ROWS} from rng",
    "min_intensity_filter": f"{RAW} {ROWS} from (select *, max(intensity) over (partition by sid) top from raw) where intensity > 0.01::double * top",
    "top_k_peaks": f"{RAW} {ROWS} from (select *, row_number() over (partition by sid order by intensity desc, mz) k from raw) where k <= 20",
    "precursor_peak_removal": CLEAN.replace("from rng g", "from raw g") + f" {ROWS} from prec",
    "scale_root": f"{RAW} select sid, mz, round(sqrt(intensity), 6) intensity from raw",
    "scale_log": f"{RAW} select sid, mz, round(log2(1 + intensity), 6) intensity from raw",
    "scale_rank": f"{RAW} select sid, mz, cast(51 - row_number() over (partition by sid order by intensity desc, mz) as double) intensity from raw",
    "normalize_l2": f"{RAW} select sid, mz, round(intensity / sqrt(sum(intensity * intensity) over (partition by sid)), 6) intensity from raw",
    "valid_spectra": f"""{CLEAN}, ok as (
  select sid, count(*) n, max(mz) - min(mz) w from best group by sid
) select s.sid, coalesce(n >= 12 and w >= 1100, false) valid from spec s left join ok using (sid)""",
    "low_quality_count": f"""{CLEAN}, ok as (
  select sid, count(*) n, max(mz) - min(mz) w from best group by sid
) select count_if(coalesce(n >= 12 and w >= 1100, false)) n_valid, count_if(not coalesce(n >= 12 and w >= 1100, false)) n_low_quality from spec s left join ok using (sid)""",
    "preprocess_full": f"""{CLEAN}, ok as (
  select sid from best group by sid having count(*) >= 12 and max(mz) - min(mz) >= 1100
) select sid, mz, round(x, 6) intensity from unit semi join ok using (sid)""",
    "charge_partition_stats": f"{RAW} select charge, count(*) n, round(min(pmz), 6) lo, round(max(pmz), 6) hi from spec group by charge",
    "precursor_blocks": f"{RAW}{PPM} select z, cast(block as bigint) block, count(*) n, round(min(pmz), 6) lo, round(max(pmz), 6) hi from blocked group by all",
    "precursor_blocks_da": RAW + BLOCKS.format(gap="pmz - was > 0.0025::double") + " select z, cast(block as bigint) block, count(*) n, round(min(pmz), 6) lo, round(max(pmz), 6) hi from blocked group by all",
    "block_chunks": f"""{RAW}{PPM}, sized as (
  select *, count(*) over (partition by z, block) size, row_number() over (partition by z, block order by pmz, sid) - 1 k from blocked
), cut as (select *, (size + 4) // 5 n from sized)
select sid, z, cast(block as bigint) block, case when size < 5 then 0 when k < (size % n) * (size // n + 1) then k // (size // n + 1)
  else size % n + (k - (size % n) * (size // n + 1)) // (size // n) end chunk from cut""",
    "peak_band_join": f"{PAIRS} select s1, s2, n_match, round(dot, 6) dot from scored",
    "pairwise_cosine": f"{PAIRS} select s1, s2, n_match, round(distance, 6) distance from pairs",
    "min_matched_gate": f"{PAIRS} select s1, s2, n_match, round(case when n_match < 6 then 1 else distance end, 6) distance from pairs",
    "similar_pairs": f"{PAIRS} select s1, s2, n_match, round(distance, 6) distance from pairs where distance <= 0.1",
    "cluster_complete": f"{COMPLETE} select sid, cluster from clusters",
    "cluster_average": f"{_triples('mean')} select sid, cluster from clusters",
    "cluster_single": f"{_triples('least')} select sid, cluster from clusters",
    # precursors lie at 0, 2 and 5 mDa: at 8 ppm the third leaves the first, and stays with the second alone
    "precursor_refine": f"{MATES} select sid, case when r = 2 and a then sid when r = 2 and b then sid - 1 else cluster end cluster from mates",
    # times lie at 0, 9 and 4 s: within 6 s the second leaves the first, and stays with the third alone
    "rt_refine": f"""{MATES} select sid, case when r = 1 and a then sid when r = 2 and b and not a then sid - 1
  when r = 2 and a then sid - 2 else cluster end cluster from mates""",
    "cluster_medoids": f"{HEADS} select sid, cluster, is_representative from heads",
    "representatives": f"{HEADS} select h.sid, round(s.pmz, 6) precursor_mz, n.n_peaks from heads h join spec s using (sid) join (select sid, count(*) n_peaks from best group by sid) n using (sid) where is_representative",
    "cluster_summary": f"""{COMPLETE}, sizes as (select cluster, count(*) n from clusters group by cluster)
select cast(sum(n) as bigint) n_spectra, count_if(n > 1) n_clusters, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) n_clustered, count_if(n = 1) n_single, count(*) n_labels from sizes""",
    "global_labels": f"""{COMPLETE}, sizes as (
  select cluster, count(*) < 2 alone, min(z) z, min(block) block from clusters join blocked using (sid) group by cluster
), numbers as (select cluster, row_number() over (order by alone, z, block, cluster) - 1 label from sizes)
select sid, label from clusters join numbers using (cluster)""",
    "natural_sort_output": f"{RAW} select 'f' || r || '.mgf' filename, 's' || pk spectrum_id, row_number() over (order by r, pk) - 1 position from spec",
    "bin_vectors": f"{CLEAN} select sid, cast(floor((mz - {LOW!r}::double) / 0.05::double) as bigint) bin, round(sum(x), 6) as value from unit group by all",
    "mgf_roundtrip": f"{RAW} select sid, charge, round(pmz, 1) precursor_mz, rt retention_time, n_peaks, total from spec join ({OF}) using (sid)",
}
_SCAN = f"""{RAW} select sid, charge, round(pmz, 1) precursor_mz, rt retention_time, n_peaks, round(first_mz, 1) first_mz, total
from spec join ({OF}) using (sid) where sid % 5 <> 0"""
# the best choice among all sets of matches without a common peak, listed match by match within runs of near peaks
_DENSE = PAIRS.replace("with b as", "with recursive b as", 1).replace("select a.sid s1, b.sid s2, p.x * q.x w", "select a.sid s1, b.sid s2, p.mz m1, q.mz m2, p.x * q.x w").replace("<= 0.05::double", "<= 0.8::double")
_DENSE += """, points as (
  select s1, s2, m1 m from matches union select s1, s2, m2 from matches
), steps as (
  select *, lag(m) over (partition by s1, s2 order by m) before from points
), runs as (
  select s1, s2, m m1, sum(case when m - before > 0.8::double then 1 else 0 end) over (partition by s1, s2 order by m) run from steps
), listed as (
  select *, row_number() over (partition by s1, s2, run order by m1, m2) k, count(*) over (partition by s1, s2, run) n from matches join runs using (s1, s2, m1)
), sets as (
  select s1, s2, run, 1::bigint k, n, [m1] ls, [m2] rs, w total from listed where k = 1
  union all
  select s1, s2, run, 1::bigint k, n, [] ls, [] rs, 0::double total from listed where k = 1
  union all
  select s.s1, s.s2, s.run, l.k, s.n, case when take then list_append(s.ls, l.m1) else s.ls end, case when take then list_append(s.rs, l.m2) else s.rs end, s.total + case when take then l.w else 0 end
  from sets s join listed l on s.s1 = l.s1 and s.s2 = l.s2 and s.run = l.run and l.k = s.k + 1 cross join (values (true), (false)) t(take)
  where not take or not (list_contains(s.ls, l.m1) or list_contains(s.rs, l.m2))
), best_sets as (
  select s1, s2, run, max(total) total, max_by(len(ls), total) n from sets where k = n group by all
) select s1, s2, cast(sum(n) as bigint) n_match, round(1 - least(1, sum(total)), 6) distance from best_sets group by s1, s2"""
_BINS = f"""bins as (
  select sid, cast(floor((mz - {LOW!r}::double) / 0.05::double) as bigint) bin, sum(x) as value from unit group by all
)"""
_MATRIX = """matrix as (
  select distinct bin, (bin * 7 + r * 11) % 32 as dim, cast((bin + r * 5) % 7 - 3 as double) weight from bins, (values (0), (1), (2)) t(r)
)"""
_SIGNS = """picked as (
  select bin, ('0x' || substr(md5('42:' || bin || ':' || r), 1, 12))::bigint h from (select distinct bin from bins), range(8) t(r)
), matrix as (
  select bin, h % 64 as dim, sum(case when (h >> 40) % 2 = 0 then 1.0::double else -1.0::double end) / sqrt(8.0::double) weight from picked group by all
)"""
_PROJECTED = """projected as (
  select sid, dim, sum(value * weight) as value from bins join matrix using (bin) group by all
), lengths as (
  select *, sqrt(sum(value * value) over (partition by sid)) as length from projected
) select sid, dim, round(case when length > 0 then value / length else value end, 6) + 0.0::double as value from lengths"""
ORACLES |= {"mzml_scan": _SCAN, "mzxml_scan": _SCAN}
ORACLES |= {
    "cosine_assignment_dense": _DENSE,
    "project_vectors": f"{CLEAN}, {_BINS}, {_SIGNS}, {_PROJECTED}",
    "project_vectors_matrix": f"{CLEAN}, {_BINS}, {_MATRIX}, {_PROJECTED}",
    "bin_ranges": """with asked as (
  select range k, cast(50 + 1.7::double * range as float) lo, cast(1500 + 7.3::double * range as float) hi, cast(0.02::double + 0.01::double * (range % 5) as float) w from range(25)
), snapped as (select k, w, lo - lo % w low, (hi + w) - hi % w high from asked)
select k, cast(ceil((high - low) / w) as bigint) n_bins, cast(low as double) low, cast(high as double) high from snapped""",
    "mzml_truncated": _SCAN,
    "mixed_formats": f"{RAW} select sid, charge, round(pmz, 1) precursor_mz, rt retention_time, n_peaks from spec join ({OF}) using (sid) where sid % 3 = 0 or sid % 5 <> 0",
    "staged_batches": f"""{CLEAN}, ok as (
  select sid, count(*) n_peaks from best group by sid having count(*) >= 12 and max(mz) - min(mz) >= 1100
) select charge, count(*) n, count(*) n_sids, cast(sum(n_peaks) as bigint) n_peaks from ok join spec using (sid) group by charge""",
    "staging_keys": "select * from (values ('nothing', true), ('cleaning', false), ('clustering', true), ('files', false)) t(changed, reused)",
    "mzml_parameter_groups": _SCAN,
    "mzxml_nested": _SCAN,
    "mgf_file_parameters": f"{RAW} select sid, case when sid % 4 < 2 then coalesce(charge, 5) else charge end charge, n_peaks from spec join (select sid, count(*) n_peaks from raw group by sid) using (sid)",
    "mgf_bad_records": f"{RAW} select count_if(x) n_bad, count_if(not x) n_good from (select sid % 10 in (1, 2) or (sid % 10 = 0 and charge is not null) x from spec)",
    "staged_stream": f"{RAW} select charge, count(*) n, count(*) n_sids from spec group by charge",
    "csv_roundtrip": f"{RAW} select 'f' || r || '.mgf' filename, 's' || pk spectrum_id, charge, round(pmz, 3) precursor_mz, rt retention_time, pk as cluster from spec",
}
