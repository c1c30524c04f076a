"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.clonotype import CODONS
from ..operators.diversity import thisted_coefficients
from ..operators.features import HYDROPATHY, VOLUME
from ..operators.kmer_space import reduced_alphabet
from . import toy
from .adapter import MUTATED, SHORT, oracle

STRIP = r"array_to_string(list_sort(list_distinct(list_transform(string_split({c}, ','), lambda x: regexp_replace(trim(x), '\*.*$', '')))), ',')"
V, J, CC = (STRIP.format(c=c) for c in ("v_call", "j_call", "c_call"))
RF = "round(cast(duplicate_count as double) / sum(duplicate_count) over (partition by sample_id), 6) as frequency"
ROWS = f"select sample_id, ord, duplicate_count, {RF} from"
RAW = "select sample_id, ord, duplicate_count, round(frequency, 6) as frequency from"
W = "cast(sum(duplicate_count) as bigint) as weight"
KMER = "unnest(list_transform(range(1, length({c}) - {k} + 2), lambda i: substr({c}, cast(i as int), {k})))"
AGG = "agg as (select sample_id, {k}, sum(duplicate_count) as count from clonotypes group by all), per as (select *, count / sum(count) over (partition by sample_id) as freq from agg)"
SPEC = "sp as (select sample_id, duplicate_count as c, count(*) as m from clonotypes group by all)"
DESIGN = "design as (select sample_id, batch, cmv = '+' as positive from samples where cmv is not null)"
FEAT = "feat as (select distinct sample_id, junction_aa from clonotypes where not regexp_matches(junction_aa, '[*_]'))"
LF = "lgamma({} + 1)"
_lf = LF.format
PMF = f"exp({_lf('a + c')} - {_lf('k')} - {_lf('a + c - k')} + {_lf('b + d')} - {_lf('a + b - k')} - {_lf('d - a + k')} - {_lf('a + b + c + d')} + {_lf('a + b')} + {_lf('c + d')})"
LIGHT = "r as (select *, case when locus in ('TRB', 'TRD', 'IGH') then 'heavy' else 'light' end as role from cells), " \
    "k as (select *, row_number() over w as rn, first_value(duplicate_count) over w as d1, first_value(umi_count) over w as u1 from r window w as (partition by cell_id, role order by duplicate_count desc, umi_count desc, ord)), " \
    "res as (select * from k where rn = 1 or (role = 'light' and rn = 2 and duplicate_count / d1 > 0.1 and umi_count / u1 > 0.1 and umi_count >= 2 and duplicate_count >= 5))"

TABLES = f"{FEAT}, z as (select count(*) filter (positive) as p, count(*) filter (not positive) as q from design), t as (select distinct a, b, p - a as c, q - b as d from (select junction_aa, count(*) filter (positive) as a, count(*) filter (not positive) as b from feat join design using (sample_id) group by all), z)"
NS = f"{SPEC}, n0 as (select sample_id, cast(sum(c * m) as double) as n, cast(sum(m) as double) as s, cast(coalesce(sum(m) filter (c = 1), 0) as double) as f1, cast(coalesce(sum(m) filter (c = 2), 0) as double) as f2 from sp group by all), " \
    "n1 as (select *, (n - 1) / n * case when f2 > 0 then f1 * f1 / 2 / f2 else f1 * (f1 - 1) / 2 end as f0 from n0), ns as (select *, case when f1 > 0 then n * f0 / (n * f0 + f1) else 1 end as hidden from n1)"
_TR = "coalesce(list_aggregate(list_transform(range(0, length({x}) // 3), lambda i: " + "map {" + ", ".join(f"'{k}': '{v}'" for k, v in CODONS.items()).replace("{", "{{") + "}[substr({x}, cast(3 * i + 1 as int), 3)]), 'string_agg', ''), '')"
_TR = _TR.replace("map {", "map {{").replace("'}[", "'}}[")
_THISTED = ", ".join(f"({depth}, {x}, {h:.25f}::double)" for depth in range(1, 21) for x, h in enumerate(thisted_coefficients(depth), 1))
PAIR = "j0 as (select v_call, j_call, coalesce(sum(duplicate_count) filter (sample_id = 'S01'), 0) as ca, coalesce(sum(duplicate_count) filter (sample_id = 'S02'), 0) as cb from clonotypes where sample_id in ('S01', 'S02') group by all), " \
    "j as (select v_call, j_call, cast(ca as bigint) as ca, cast(cb as bigint) as cb, cast(ca as double) / sum(ca) over () as fa, cast(cb as double) / sum(cb) over () as fb from j0)"
GRID = f"r as (select sample_id, batch, {V} as v, {J} as j, duplicate_count from clonotypes join samples using (sample_id)), u as (select sample_id, batch, substr(v, 1, 3) as locus, v, j, {{count}} as n from r group by all), " \
    "g as (select * from (select distinct sample_id, batch, locus from u) join (select distinct locus, v, j from u) using (locus)), p0 as (select g.*, coalesce(n, 0) as n from g left join u using (sample_id, batch, locus, v, j)), p as (select *, (n + 1e0) / sum(n + 1e0) over (partition by sample_id, locus) as p, ln((n + 1e0) / sum(n + 1e0) over (partition by sample_id, locus)) as l from p0)"

KERNEL = "x as (select junction_aa as s, sum(frequency) as p from clonotypes where sample_id = 'S01' group by all), y as (select junction_aa as s, sum(frequency) as p from clonotypes where sample_id = 'S02' group by all), " \
    + ", ".join("k{a}{b} as (select sum(a.p * b.p * exp(-hamming(a.s, b.s) / {{tau}})) as {a}{b} from {x} a join {y} b on length(a.s) = length(b.s) and hamming(a.s, b.s) <= 1)".format(a=a, b=b, x=x, y=y) for a, b, x, y in (("a", "b", "x", "y"), ("a", "a", "x", "x"), ("b", "b", "y", "y"))) \
    + ", k as (select * from kab, kaa, kbb)"
SIG = f"rw as (select sample_id, substr(v_call, 1, 3) as locus, junction_aa as s, duplicate_count as n, v_identity as i, {CC} as c from clonotypes), wk as (select *, log2(1 + n) / sum(log2(1 + n)) over (partition by sample_id, locus) as w from rw where regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWY]+$')), " \
    "st as (select sample_id, locus, sum(n) as reads, cast(count(*) as double) as rich, cast(count(*) filter (n = 1) as double) as f1, cast(count(*) filter (n = 2) as double) as f2, max(n) / sum(n) as top from wk group by all)"

_COST = "case when {x} = {y} then 0 when {hx} is null or {hy} is null then worst else greatest(1, floor(abs({hx} - {hy})) + floor(abs({vx} - {vy}) / 40)) end"
GAPPED = "sc(l, h, v) as (values " + ", ".join(f"('{a}', {h}e0, {VOLUME[a]}e0)" for a, h in HYDROPATHY.items()) + "), mp as (select map(list(l), list(h)) as mh, map(list(l), list(v)) as mv, (select max(" + _COST.format(x="a.l", y="b.l", hx="a.h", hy="b.h", vx="a.v", vy="b.v").replace("worst", "0") + ") from sc a, sc b) as worst from sc), " \
    "w as (select sample_id as g, junction_aa as s, sum(frequency) as w from clonotypes where sample_id in ('S01', 'S02') and junction_aa is not null group by all), " \
    "t as (select s, length(s) as n, string_split(s, '') as c, list_transform(string_split(s, ''), lambda x: mh[x]) as h, list_transform(string_split(s, ''), lambda x: mv[x]) as v, worst from (select distinct s from w), mp), " \
    "al as (select a.s as s, b.s as r, a.c as c, b.c as c2, a.h as h, b.h as h2, a.v as v, b.v as v2, a.n - b.n as d, b.n as n, a.worst as worst, unnest(case when a.n = b.n then [0] else range(b.n + 1) end) as p from t a join t b on a.n - b.n between 0 and 2), " \
    "ac as (select *, case when d > 0 then 3 + (d - 1) + 0.5e0 * abs(p - 0.5e0 * n) else 0e0 end as gap from al), " \
    "pn as (select s, r, min(gap + coalesce(list_sum(list_transform(range(1, n + 1), lambda i: " + _COST.format(x="c[i + if(i > p, d, 0)]", y="c2[i]", hx="h[i + if(i > p, d, 0)]", hy="h2[i]", vx="v[i + if(i > p, d, 0)]", vy="v2[i]") + ")), 0)) as pen from ac where gap <= 4 group by all), " \
    "nr as (select s, r, pen from pn where pen <= 4 union select r, s, pen from pn where pen <= 4), " \
    "pr as (select a.g as g, b.g as g2, sum(a.w * b.w * exp(-2 * pen)) as z, sum(a.w * b.w) as met from nr join w a on a.s = nr.s join w b on b.s = nr.r group by all), tw as (select g, sum(w) as w from w group by all), " \
    "ph as (select pr.*, z + exp(-8e0) * greatest(x.w * y.w - met, 0) as zh from pr join tw x on x.g = pr.g join tw y on y.g = g2), " \
    "k as (select max(z) filter (g = 'S01' and g2 = 'S02') as ab, max(zh) filter (g = 'S01' and g2 = 'S02') as abh, max(z) filter (g = g2 and g = 'S01') as aa, max(zh) filter (g = g2 and g = 'S01') as aah, max(z) filter (g = g2 and g = 'S02') as bb, max(zh) filter (g = g2 and g = 'S02') as bbh from ph)"
RESIDUE = f"x as (select distinct a as junction_aa from (select {_TR.format(x='junction_nt')} as a from ({toy.JUNCTIONS.strip()}) where length(junction_nt) % 3 = 0) where not contains(a, '*')), g as (select a, sum(p) as p from (select {_TR.format(x='s')} as a, p from space where length(s) % 3 = 0) group by a)"


def significant(sql: str) -> str:
    """``round(x, 6)`` in ``sql`` as nine significant digits of x."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at += 6
            continue
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 6)"):
            inner = sql[at + 6 : end - 4]
            sql = f"{sql[:at]}case when abs({inner}) < 1e-12 then 0 else cast(printf('%.8e', cast({inner} as double)) as double) end{sql[end:]}"
        at += 6
    return sql


def _pool(key: str, rest: str) -> str:
    best = ", ".join(f"arg_max(coalesce({c}, chr(1)), duplicate_count * 1000000000000 - ord) as {c}_" for c in rest.split(", "))
    names = ", ".join(f"nullif({c}_, chr(1)) as {c}" for c in rest.split(", "))
    return f"select {key}, {names}, duplicate_count, round(cast(duplicate_count as double) / sum(duplicate_count) over (), 6) as frequency, incidence, occurrences, convergence from (select {key}, {best}, cast(sum(duplicate_count) as bigint) as duplicate_count, count(distinct sample_id) as incidence, count(*) as occurrences, count(distinct (junction_nt, v_call, j_call)) as convergence from clonotypes group by {key})"


_H = "map {" + ", ".join(f"'{k}': {v}e0" for k, v in HYDROPATHY.items()) + "}"

ORACLE_SQL: dict[str, str] = {name: oracle(significant(sql)) for name, sql in {
    "schema_normalize": f"select sample_id, ord, v_call, cast(null as varchar) as d_call, junction_aa, duplicate_count, {RF} from clonotypes",
    "scalar_expressions": rf"""select ord, case when length(v_call) >= 3 then substr(v_call, 1, 3) end as locus, {V} as genes, regexp_replace(trim(string_split(v_call, ',')[1]), '\*.*$', '') as gene,
        upper(regexp_replace(c_call, '^(IGH[MDGAE]).*$', '\1')) as isotype, case duplicate_count when 1 then 'singleton' when 2 then 'doubleton' when 3 then 'tripleton' else 'large' end as size_class,
        round(1 - exp(-frequency * 100), 6) as capture, reverse(translate(upper(junction_nt), 'ACGT', 'TGCA')) as reverse, round(log10(greatest(duplicate_count, 1)), 6) as log10, round(ln(1 + duplicate_count), 6) as log1p,
        round(ln((frequency * 1000 + 0.5) / ((1 - frequency) * 1000 + 0.5)), 6) as logit, round(asin(sqrt((frequency * 1000 + 0.375) / 1000.75)), 6) as arcsine, round(greatest(least((duplicate_count - 25) / 10e0, 8), -8), 6) as z from clonotypes""",
    "clr_usage": f", u as (select sample_id, {V} as v_call, sum(duplicate_count) as w from clonotypes group by all), p as (select *, ln(w / sum(w) over (partition by sample_id)) as l from u) select sample_id, v_call, round(l - avg(l) over (partition by sample_id), 6) as clr from p",
    "robust_loc_scale": f", u as (select sample_id, {V} as v_call, cast(sum(duplicate_count) as double) as w from clonotypes group by all), m as (select *, median(w) over (partition by sample_id) as mid from u) select sample_id, round(any_value(mid), 6) as loc, round(median(abs(w - mid)) * 1.4826, 6) as scale from m group by sample_id",
    "filter_productive": f"{ROWS} clonotypes where not regexp_matches(junction_aa, '[*atgc#~_?]')",
    "filter_unproductive": f"{RAW} clonotypes where regexp_matches(junction_aa, '[*atgc#~_?]')",
    "filter_functional_genes": rf"{ROWS} clonotypes where regexp_replace(trim(v_call), '\*.*$', '') not in (select 'TRBV' || (4 * i) from range(1, 5) t(i))",
    "filter_length": f"{ROWS} clonotypes where length(junction_aa) between 11 and 13",
    "filter_frequency": f", w as (select *, sum(frequency) over (partition by sample_id order by duplicate_count desc, ord rows unbounded preceding) as cum from clonotypes where frequency >= 3e-4), k as (select * from w where cum <= 0.8 + 1e-12) {ROWS} k",
    "filter_segment": rf"{ROWS} clonotypes where regexp_matches(v_call, '(^|,)\s*(TRBV1|TRBV2)') and regexp_matches(j_call, '(^|,)\s*(TRBJ1)')",
    "filter_by_sample": f"{ROWS} clonotypes where sample_id != 'S00' and (junction_aa, v_call, j_call) in (select (junction_aa, v_call, j_call) from clonotypes where sample_id = 'S00')",
    "decontaminate": f", s as (select sample_id, junction_aa, j_call, sum(duplicate_count) as own from clonotypes group by all) , k as (select * from clonotypes c where not exists (select 1 from s where s.junction_aa = c.junction_aa and s.j_call = c.j_call and s.sample_id != c.sample_id and s.own >= 3 * c.duplicate_count)) {ROWS} k",
    "sanitise_dropped": "select sample_id, round(sum(case when regexp_matches(junction_aa, '^C[ACDEFGHIKLMNPQRSTVWY]*[FW]$') then 0 else duplicate_count end) / sum(duplicate_count), 6) as dropped from clonotypes group by sample_id",
    "select_top": f"{ROWS} (select *, row_number() over (partition by sample_id order by duplicate_count desc, ord) as r from clonotypes) where r <= 25",
    "downsample_reads": "select sample_id, cast(least(500, sum(duplicate_count)) as bigint) as reads, cast(0 as bigint) as overdrawn from clonotypes group by sample_id",
    "downsample_clones": "select sample_id, cast(least(40, count(*)) as bigint) as clones from clonotypes group by sample_id",
    "pool_aa": _pool("junction_aa", "v_call, d_call, j_call, junction_nt"),
    "pool_strict": _pool("junction_nt, junction_aa, v_call, j_call", "d_call"),
    "join_samples": ", f as (select junction_aa, v_call, j_call, sample_id, sum(frequency) as f from clonotypes group by all), n as (select count(distinct sample_id) as n from clonotypes), g as (select junction_aa, v_call, j_call, count(*) as incidence, exp((sum(ln(f + 1e-9)) + (n - count(*)) * ln(1e-9)) / n) as g from f, n group by junction_aa, v_call, j_call, n having count(*) >= 3) select junction_aa, v_call, j_call, incidence, round(g / sum(g) over (), 6) as frequency, cast(floor(g / min(g) over () + 1e-9) as bigint) as duplicate_count from g",
    "track_clonotypes": "select junction_aa, " + ", ".join(f"round(coalesce(sum(frequency) filter (sample_id = '{s}'), 0), 6) as {s}" for s in ("S01", "S02", "S03")) + ", round(sum(frequency), 6) as freq_sum from clonotypes where sample_id in ('S01', 'S02', 'S03') group by junction_aa",
    "diversity_stats": f""", {SPEC}, n as (select sample_id, sum(c * m) as n, sum(m) as s, coalesce(sum(m) filter (c = 1), 0) as f1, coalesce(sum(m) filter (c = 2), 0) as f2 from sp group by all),
        e as (select sample_id, sum(-m * (c / n) * ln(c / n)) as h, sum(m * (c / n) * (c / n)) as d from sp join n using (sample_id) group by all),
        k as (select sample_id, count(*) filter (cum < 0.5 * n) + 1 as k from (select sample_id, sum(duplicate_count) over (partition by sample_id order by duplicate_count desc, ord) as cum, sum(duplicate_count) over (partition by sample_id) as n from clonotypes) group by all)
        select sample_id, cast(n as bigint) as reads, cast(s as bigint) as observed, round(s + f1 * (f1 - 1) / (2 * (f2 + 1)), 6) as chao1,
        round(case when f1 * (f1 - 1) > 0 then s + f1 * (f1 - 1) / (2 * (f2 + 1)) * (1 - pow(1 - f1 / (n * (f1 * (f1 - 1) / (2 * (f2 + 1)))), n)) else s end, 6) as chao_e,
        round(exp(h), 6) as shannon_wiener, round(case when s > 1 then h / ln(s) else 0 end, 6) as normalized_shannon_wiener, round(1 / d, 6) as inverse_simpson, round(1 - least(k, s) / s, 6) as d50 from n join e using (sample_id) join k using (sample_id)""",
    "hill_numbers": f", {SPEC}, p as (select *, c / sum(c * m) over (partition by sample_id) as p from sp) select sample_id, round(cast(sum(m) as double), 6) as hill_0, round(exp(sum(-m * p * ln(p))), 6) as hill_1, round(1 / sum(m * p * p), 6) as hill_2 from p group by all",
    "count_spectrum": "select sample_id, duplicate_count as count, count(*) as clones from clonotypes group by all",
    "segment_usage_v": f"select sample_id, substr(v_call, 1, 3) as locus, {V} as v_call, {W} from clonotypes group by all",
    "segment_usage_d": f"select sample_id, substr(v_call, 1, 3) as locus, {STRIP.format(c='d_call')} as d_call, count(*) as weight from clonotypes where d_call is not null group by all",
    "segment_usage_j": f"select sample_id, substr(v_call, 1, 3) as locus, {J} as j_call, round(sum(frequency), 6) as weight from clonotypes group by all",
    "vj_usage": f"select sample_id, substr(v_call, 1, 3) as locus, {V} as v_call, {J} as j_call, {W} from clonotypes group by all",
    "spectratype": f"select sample_id, substr(v_call, 1, 3) as locus, cast(length(junction_aa) as int) as length, {W} from clonotypes group by all",
    "vj_spectratype": f"select sample_id, substr(v_call, 1, 3) as locus, {V} as v_call, {J} as j_call, cast(length(junction_nt) as int) as length, {W} from clonotypes group by all",
    "shm_spectrum": ", h as (select sample_id, cast(least(floor(v_identity * 20), 19) as int) as bin, sum(frequency) as weight from clonotypes where v_identity is not null group by all), g as (select distinct sample_id, cast(b as int) as bin from clonotypes, range(20) t(b)) select sample_id, bin, round(bin / 20, 6) as low, round(coalesce(weight, 0), 6) as weight from g left join h using (sample_id, bin)",
    "shm_summary": r""", x as (select sample_id, v_identity as i, duplicate_count as w, upper(regexp_replace(c_call, '^(IGH[MDGAE]).*$', '\1')) as iso from clonotypes where v_identity is not null and c_call is not null),
        b as (select sample_id, least(floor(i * 20), 19) as bin, sum(w) as b from x group by all), p as (select *, b / sum(b) over (partition by sample_id) as p from b), e as (select sample_id, sum(-p * ln(p)) as entropy from p group by all),
        m as (select sample_id, sum(w * i) / sum(w) as mean, sum(w * i * i) / sum(w) as m2, coalesce(sum(w) filter (i < 0.98), 0) / sum(w) as mut, coalesce(sum(w) filter (iso not in ('IGHM', 'IGHD')), 0) / sum(w) as sw from x group by all)
        select sample_id, round(mean, 6) as mean_identity, round(mut, 6) as frac_mutated, round(sw, 6) as frac_switched, round(entropy, 6) as entropy, round(sqrt(greatest(m2 - mean * mean, 0)), 6) as sd_identity from m join e using (sample_id)""",
    "kmer_profile": f", k as (select sample_id, substr(v_call, 1, 3) as locus, duplicate_count, {KMER.format(c='junction_aa', k=3)} as kmer from clonotypes) select sample_id, locus, kmer, {W} from k group by all",
    "v_kmer_c_profile": f", k as (select substr(v_call, 1, 3) as locus, {V} as v, {CC} as c, duplicate_count, {KMER.format(c='junction_aa', k=4)} as kmer from clonotypes) select locus, v as v_call, c as c_call, kmer, {W} from k group by all",
    "kmer_cohort": f", t as (select sample_id, {V} as v_call, substr(junction_aa, 4, length(junction_aa) - 6) as core from clonotypes where length(junction_aa) > 6) select distinct sample_id, v_call, {KMER.format(c='core', k=3)} as kmer from t",
    "physchem_profile": f", t as (select sample_id, j_call, duplicate_count as w, list_filter(list_transform(string_split(substr(junction_aa, cast(length(junction_aa) // 2 - 1 as int), 5), ''), lambda r: {_H}[r]), lambda x: x is not null) as v from clonotypes where length(junction_aa) >= 5) select sample_id, j_call, 'hydropathy' as property, round(ROUND(sum(list_avg(v) * w) / sum(w), 6), 6) as value from t where len(v) > 0 group by all",
    "overlap_pair": ", " + AGG.format(k="junction_aa") + " select junction_aa, cast(a.count as bigint) as count_a, round(a.freq, 6) as freq_a, cast(b.count as bigint) as count_b, round(b.freq, 6) as freq_b from per a join per b using (junction_aa) where a.sample_id = 'S01' and b.sample_id = 'S02'",
    "overlap_cohort": ", " + AGG.format(k="junction_aa") + """, n as (select sample_id, count(*) as n from per group by all), m as (select a.sample_id as sample_a, b.sample_id as sample_b, count(*) as shared, sum(a.freq * b.freq) as ab, sum(sqrt(a.freq * b.freq)) as f2, case when count(*) > 2 then corr(a.freq, b.freq) end as r from per a join per b using (junction_aa) where a.sample_id < b.sample_id group by all)
        select sample_a, sample_b, x.n as n_a, y.n as n_b, shared, round(shared / (x.n * y.n), 6) as "D", round(sqrt(ab), 6) as "F", round(f2, 6) as "F2", round(r, 6) as "R", round(shared / (x.n + y.n - shared), 6) as jaccard from m join n x on x.sample_id = sample_a join n y on y.sample_id = sample_b""",
    "pairwise_distances": ", " + AGG.format(k="junction_aa, j_call") + ", m as (select a.sample_id as sample_a, b.sample_id as sample_b, sqrt(sum(a.freq * b.freq)) as f from per a join per b using (junction_aa, j_call) where a.sample_id != b.sample_id group by all), s as (select distinct sample_id from clonotypes) select x.sample_id as sample_a, y.sample_id as sample_b, round(case when x.sample_id = y.sample_id then 0 else -log10(coalesce(f, 0) + 1e-9) end, 6) as distance from s x cross join s y left join m on sample_a = x.sample_id and sample_b = y.sample_id",
    "pairwise_distances_fuzzy": ", x as (select sample_id, junction_aa as j, sum(duplicate_count) / any_value(n) as f from clonotypes join (select sample_id, sum(duplicate_count) as n from clonotypes group by all) using (sample_id) group by all), w as (select distinct j from x), l as (select a.j as ja, b.j as jb from w a join w b on length(a.j) = length(b.j) and hamming(a.j, b.j) <= 1), "
        "r as (select distinct l.ja as j, x.sample_id as other from l join x on x.j = l.jb), m as (select sample_id as sample_a, other as sample_b, sum(f) as f from x join r using (j) where sample_id <> other group by all), b as (select a.sample_a, a.sample_b, sqrt(a.f * b.f) as f from m a join m b on a.sample_a = b.sample_b and a.sample_b = b.sample_a), "
        "s as (select distinct sample_id from clonotypes) select x.sample_id as sample_a, y.sample_id as sample_b, round(case when x.sample_id = y.sample_id then 0 else -log10(coalesce(f, 0) + 1e-9) end, 5) + 0e0 as distance from s x cross join s y left join b on sample_a = x.sample_id and sample_b = y.sample_id",
    "sample_layout": ", pt as (select sample_id, avg(length(junction_aa)) as x, avg(ln(duplicate_count)) as y from clonotypes group by all) select a.sample_id as sample_a, b.sample_id as sample_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) as distance from pt a, pt b",
    "sample_groups": ", m as (select sample_id, min(sample_id) over (partition by batch) as b, min(sample_id) over (partition by batch, hla_1) as h from samples) select sample_id as sample, dense_rank() over (order by b) as cluster, row_number() over (order by b, h, sample_id) - 1 as leaf_order from m",
    "sample_linkage": ", " + AGG.format(k="junction_aa, j_call") + ", m as (select a.sample_id as cluster_a, b.sample_id as cluster_b, -log10(sqrt(sum(a.freq * b.freq)) + 1e-9) as height from per a join per b using (junction_aa, j_call) where a.sample_id < b.sample_id group by all) select cluster_a, cluster_b, round(height, 6) as height, cast(1 as bigint) as size_a, cast(1 as bigint) as size_b from m order by m.height, 1, 2 limit 1",
    "germline_audit": ", g as (select coalesce(allele, '') as allele, segment, coalesce(sequence, '') as sequence, regexp_matches(coalesce(sequence, ''), '^[ACGT]+$') as plain from germline), i as (select 'error' as severity, 'segment' as check, segment, allele from g where segment not in ('V', 'D', 'J') union all select 'error', 'empty_allele', segment, allele from g where allele = '' "
        "union all select 'warn', 'gene_level_name', segment, allele from g where allele <> '' and not contains(allele, '*') union all select 'error', 'empty_sequence', segment, allele from g where allele <> '' and sequence = '' union all select 'warn', 'ambiguous', segment, allele from g where allele <> '' and sequence <> '' and not plain "
        "union all select 'warn', 'anchor_frame', segment, allele from g where allele <> '' and plain and ((segment = 'V' and left(sequence, 3) not in ('TGT', 'TGC')) or (segment = 'J' and right(sequence, 3) not in ('TTT', 'TTC', 'TGG')))) "
        "select *, count(*) as n from i group by all union all select 'error', 'duplicate_allele', min(segment), allele, count(*) from g where allele <> '' group by allele having count(*) > 1",
    "germline_joints": ", g as (select distinct allele, segment, cast(regexp_extract(allele, '^TRB[DJ]([0-9]+)', 1) as bigint) as k from germline where allele is not null and segment in ('D', 'J')) select d.allele as d_allele, count(*) as n from g d join g j on d.segment = 'D' and j.segment = 'J' and j.k < d.k group by all",
    "fuzzy_overlap": ", x as (select junction_aa, sum(frequency) as f from clonotypes where sample_id = 'S01' group by all), y as (select junction_aa, sum(frequency) as f from clonotypes where sample_id = 'S02' group by all) select x.junction_aa as seq_a, y.junction_aa as seq_b, cast(levenshtein(x.junction_aa, y.junction_aa) as int) as distance, round(x.f, 6) as freq_a, round(y.f, 6) as freq_b from x, y where levenshtein(x.junction_aa, y.junction_aa) <= 1",
    "fuzzy_overlap_metrics": ", x as (select junction_aa as j, sum(frequency) as f from clonotypes where sample_id = 'S01' group by all), y as (select junction_aa as j, sum(frequency) as f from clonotypes where sample_id = 'S02' group by all), p as (select x.j as a, y.j as b, x.f as fa, y.f as fb from x, y where length(x.j) = length(y.j) and hamming(x.j, y.j) <= 1), q as (select (select count(*) from p) as pairs, (select count(distinct a) from p) / (select count(*) from x) as matched_a, (select coalesce(sum(fa), 0) from (select distinct a, fa from p)) as freq_a, (select count(distinct b) from p) / (select count(*) from y) as matched_b, (select coalesce(sum(fb), 0) from (select distinct b, fb from p)) as freq_b) select pairs, round(matched_a, 6) as matched_a, round(freq_a, 6) as freq_a, round(matched_b, 6) as matched_b, round(freq_b, 6) as freq_b, round(sqrt(freq_a * freq_b), 6) as \"fuzzy_F\" from q",
    "metaclonotypes": ", n as (select distinct junction_aa as s, v_call, j_call from clonotypes where not regexp_matches(junction_aa, '[*_]')), e as (select a.v_call, a.j_call, a.s as x, b.s as y from n a join n b on a.v_call = b.v_call and a.j_call = b.j_call and length(a.s) = length(b.s) and a.s != b.s where hamming(a.s, b.s) = 1), r as (with recursive r as (select v_call, j_call, s, s as root from n union select r.v_call, r.j_call, e.y, r.root from r join e on r.v_call = e.v_call and r.j_call = e.j_call and r.s = e.x) select * from r) select s as junction_aa, v_call, j_call, v_call || '|' || j_call || '|' || min(root) as meta from r group by s, v_call, j_call",
    "near_pairs_two": f", x as (select distinct {SHORT} as s from clonotypes where sample_id = 'S01'), y as (select distinct {SHORT} as s from clonotypes where sample_id = 'S02') select x.s as seq_a, y.s as seq_b, cast(hamming(x.s, y.s) as int) as distance from x, y where length(x.s) = length(y.s) and hamming(x.s, y.s) <= 2",
    "translate_junction": f", n as (select distinct unnest([junction_nt, substr(junction_nt, 1, length(junction_nt) - 1), substr(junction_nt, 3), substr(junction_nt, 1, length(junction_nt) - 7)]) as s from reads), h as (select s, length(s) // 2 as mid from n), p as (select s, case when length(s) % 3 = 0 then s else substr(s, 1, 3 * (mid // 3)) end as l, case when length(s) % 3 = 0 then '' else substr(s, length(s) - 3 * ((length(s) - mid) // 3) + 1) end as r from h) select s as junction_nt, {_TR.format(x='l')} || case when length(s) % 3 = 0 then '' else '_' end || {_TR.format(x='r')} as junction_aa from p",
    "correct_errors": f", c as (select * replace ({MUTATED} as junction_nt) from clonotypes), d as (select distinct junction_nt as s from c), h as (select x.s as sa, y.s as sb, hamming(x.s, y.s) as m from d x, d y where length(x.s) = length(y.s) and x.s != y.s and hamming(x.s, y.s) <= 2), q as (select a.sample_id, a.ord, a.duplicate_count as na, b.duplicate_count as nb, m from c a join h on a.junction_nt = h.sa join c b on b.sample_id = a.sample_id and b.junction_nt = h.sb), v as (select sample_id, ord, bool_or(log10(nb / na) - m * -log10(0.2e0) > 0) as gone, sum(case when log10(na / nb) - m * -log10(0.2e0) > 0 then nb else 0 end) as more from q group by all), o as (select c.sample_id, c.ord, cast(c.duplicate_count + coalesce(more, 0) as bigint) as duplicate_count from c left join v using (sample_id, ord) where not coalesce(gone, false)) {ROWS} o",
    "efron_thisted": f", {SPEC}, s as (select sample_id, cast(sum(m) as double) as s from sp group by all), k(depth, x, h) as (values {_THISTED}), g as (select sample_id, s, depth from s, (select distinct depth from k)), e as (select g.sample_id, g.depth, any_value(s) + coalesce(sum(h * m), 0) as est, sqrt(coalesce(sum(h * h * m), 0)) as dev from g left join k using (depth) left join sp on sp.sample_id = g.sample_id and sp.c = k.x group by all) select sample_id, round(coalesce(arg_min(est, depth) filter (dev / est >= 0.05), max(est) filter (depth = 20)), 6) as efron_thisted from e group by sample_id",
    "sample_coverage": f", {NS}, z as (select unnest([100, 1000, 2500, 2501]) as m), i as (select sample_id, z.m, 1 - sum(sp.m * c / n * case when n - c >= z.m then exp(lgamma(n - c + 1) - lgamma(n - c - z.m + 1) - lgamma(n) + lgamma(n - z.m)) else 0 end) as v from sp join ns using (sample_id), z group by sample_id, z.m, n) select sample_id, cast(m as double) as m, round(ROUND(v, 5), 6) as sample_coverage from i where m in (100, 1000) union all select sample_id, 2500.5, round(ROUND(sum(v) / 2, 5), 6) from i where m > 2000 group by sample_id union all select sample_id, 1e6, round(ROUND(1 - f1 / n * pow(hidden, 1e6 - n + 1), 5), 6) from ns",
    "asymptotic_diversity": f", {NS}, t as (select sample_id, sum(-m * (c / n) * ln(c / n)) as h, sum(m * (c / n) * (c / n)) as d, sum(cast(m as double) * c * (c - 1)) / (n * (n - 1)) as u from sp join ns using (sample_id) group by sample_id, n), hm as (select r, sum(1e0 / r) over (order by r) as h from range(1, 400000) g(r)), w as (select sample_id, sum(m * c / n * (x.h - coalesce(y.h, 0))) as first from sp join ns using (sample_id) join hm x on x.r = n - 1 left join hm y on y.r = c - 1 group by all), b as (select sample_id, n, f1, case when f2 > 0 then 2 * f2 / ((n - 1) * f1 + 2 * f2) when f1 > 0 then 2 / ((n - 1) * (f1 - 1) + 2) else 1 end as a from ns), l as (select sample_id, case when f1 = 0 or a = 1 then 0 else f1 / n * pow(1 - a, 1 - n) * (-ln(a) - list_sum(list_transform(range(1, cast(n as bigint)), lambda r: pow(1 - a, r) / r))) end as second from b) select sample_id, 0 as order_q, round(s, 6) as observed, round(s + f0, 6) as estimator from ns union all select sample_id, 1, round(exp(h), 6), round(exp(first + second), 6) from t join w using (sample_id) join l using (sample_id) union all select sample_id, 2, round(1 / d, 6), round(1 / u, 6) from t",
    "inext": f", {NS}, z as (select unnest([50, 700]) as m), v as (select sample_id, z.m, n, s, 1 - sum(sp.m * c / n * case when n - c >= z.m then exp(lgamma(n - c + 1) - lgamma(n - c - z.m + 1) - lgamma(n) + lgamma(n - z.m)) else 0 end) as cov, s - sum(sp.m * case when n - c >= z.m then exp(lgamma(n - c + 1) - lgamma(n - c - z.m + 1) - lgamma(n + 1) + lgamma(n - z.m + 1)) else 0 end) as d0, 1 / (1e0 / z.m + (z.m - 1e0) / z.m * sum(cast(sp.m as double) * c * (c - 1)) / (n * (n - 1))) as d2 from sp join ns using (sample_id), z group by sample_id, z.m, n, s), k as (select sample_id, m, exp(sum(f * -(k / m) * ln(k / m) * exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + lgamma(n - c + 1) - lgamma(m - k + 1) - lgamma(n - c - m + k + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)))) as d1 from (select sp.sample_id, z.m, n, c, sp.m as f, unnest(range(1, cast(least(c, z.m) as bigint) + 1)) as k from sp join ns using (sample_id), z) group by all), o as (select sample_id, m, 0 as order_q, cov, d0 as d from v union all select sample_id, m, 1, cov, d1 from v join k using (sample_id, m) union all select sample_id, m, 2, cov, d2 from v) select sample_id, order_q, cast(m as double) as m, 'rarefaction' as method, round(ROUND(cov, 5), 6) as sample_coverage, round(ROUND(d, 4), 6) as \"qD\" from o",
    "estimate_d": f", {NS}, u as (select sample_id, sum(cast(m as double) * c * (c - 1)) / (n * (n - 1)) as u from sp join ns using (sample_id) group by sample_id, n), v as (select sample_id, n, round(1 - f1 / n * pow(hidden, 1e6 - n + 1), 6) as cov, s + f0 * (1 - pow(1 - (f1 / n) / (f0 + f1 / n), 1e6 - n)) as d0, 1 / (1 / 1e6 + (1e6 - 1) / 1e6 * u) as d2 from ns join u using (sample_id)) select sample_id, 0 as order_q, 1e6 as m, 'extrapolation' as method, cov as sample_coverage, round(d0, 6) as \"qD\" from v union all select sample_id, 2, 1e6, 'extrapolation', cov, round(d2, 6) from v",
    "inext_coverage": "select distinct sample_id, order_q, cov as sample_coverage from clonotypes, (select unnest([0, 2]) as order_q), (select unnest([0.3e0, 0.999e0]) as cov)",
    "fisher_minlike": f", {DESIGN}, {TABLES}, u as (select *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: {PMF}) as q, a - greatest(0, a - d) + 1 as i from t) select a, b, c, d, round(least(1, list_sum(list_filter(q, lambda x: x <= q[i] * (1 + 1e-7)))), 6) as p_value from u",
    "fisher_two_sided": f", {DESIGN}, {TABLES}, u as (select *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: {PMF}) as q, a - greatest(0, a - d) + 1 as i from t) select a, b, c, d, round(least(1, 2 * least(list_sum(q[:i]), list_sum(q[i:]))), 6) as p_value from u",
    "bayes_tables": f", {DESIGN}, {TABLES}, u as (select *, ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) as l, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) as e, a + b + c + d as n from t) select a, b, c, d, round(l, 6) as logor, round(e, 6) as se, round(l - 1.959963984540054e0 * e, 6) as ci_lo, round(l + 1.959963984540054e0 * e, 6) as ci_hi, round(lgamma(a + 1) + lgamma(c + 1) - lgamma(a + c + 2) + lgamma(b + 1) + lgamma(d + 1) - lgamma(b + d + 2) - lgamma(a + b + 1) - lgamma(c + d + 1) + lgamma(n + 2), 6) as bf, round(coalesce(n * pow(greatest(abs(cast(a as double) * d - b * c) - n / 2, 0), 2) / nullif(cast(a + b as double) * (c + d) * (a + c) * (b + d), 0), 0), 6) as chi2 from u",
    "permutation_test": f""", {DESIGN}, k as (select count(*) filter (positive) as m from design), o as (select i, sample_id, row_number() over (partition by i order by md5('0:' || i || ':cmv:' || sample_id), sample_id) <= m as marked from design, k, range(200) r(i)),
        f as (select distinct sample_id, {V} as v_call from clonotypes), a as (select v_call, count(*) filter (positive) as a from f join design using (sample_id) group by all), n as (select v_call, i, count(*) filter (marked) as n from f join o using (sample_id) group by all)
        select v_call, 'cmv' as level, a, round((1 + count(*) filter (n >= a)) / 201e0, 6) as p_value from a join n using (v_call) group by all""",
    "fuzzy_features": f", f as (select distinct sample_id, junction_aa, {J} as j_call from clonotypes where not regexp_matches(junction_aa, '[*_]')), k as (select distinct junction_aa, j_call from f) select k.junction_aa, k.j_call, count(distinct sample_id) as incidence from k join f on f.j_call = k.j_call and length(f.junction_aa) = length(k.junction_aa) and hamming(f.junction_aa, k.junction_aa) <= 1 group by all",
    "cooccurrence": f", f as (select distinct sample_id, substr(v_call, 1, 3) as chain, {V} as v from clonotypes where not regexp_matches(junction_aa, '[*_]')), g as (select sample_id from f where chain in ('TRB', 'IGH') group by sample_id having count(distinct chain) = 2), i as (select chain, v from f group by all having count(*) >= 2), h as (select f.* from f join i using (chain, v) join g using (sample_id)), n as (select count(*) as n from g), s as (select chain, v, count(*) as k from h group by all), p as (select x.v as v1, y.v as v2, count(*) as ab from h x join h y using (sample_id) where x.chain = 'TRB' and y.chain = 'IGH' group by all having count(*) >= 2), t as (select v1, v2, ab, n, sx.k as na, sy.k as nb, ab as a, sx.k - ab as b, sy.k - ab as c, n - sx.k - sy.k + ab as d from p join s sx on sx.chain = 'TRB' and sx.v = v1 join s sy on sy.chain = 'IGH' and sy.v = v2, n), u as (select *, least(1, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda k: {PMF}))) as p, (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)) as o from t), w as (select *, round(p, 12) as pr from u), x as (select *, count(*) over (order by pr) as r, count(*) over () as m from w) select v1 as a_v_call, v2 as b_v_call, n, na as n_a, nb as n_b, ab as n_ab, round(n * ab / (na * nb), 6) as theta, round(o, 6) as odds_ratio, round(log2(o), 6) as log2_or, round(p, 6) as p_value, round(least(1, min(p * m / r) over (order by pr range between current row and unbounded following)), 6) as q_value from x",
    "stratified_design": "select sample_id, 'cmv' as level, cmv = '+' as positive, batch as stratum from samples where cmv is not null",
    "pair_dynamics": f", {PAIR}, z as (select v_call, j_call, fa, fb, cast(round_even(fa * 3000, 0) as bigint) as x, cast(round_even(fb * 3000, 0) as bigint) as y from j), s as (select sum(x) as ra, sum(y) as rb from z), t as (select v_call, j_call, fa, fb, x as a, y as b, cast(ra - x as bigint) as c, cast(rb - y as bigint) as d, ra, rb from z, s), u as (select *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: {PMF}) as q, a - greatest(0, a - d) + 1 as i from t where a + b >= 6), w as (select v_call, j_call, least(1, list_sum(list_filter(q, lambda x: x <= q[i] * (1 + 1e-7)))) as p from u), r as (select *, round(p, 12) as pr from w), m as (select *, count(*) over (order by pr) as k, count(*) over () as m from r), e as (select v_call, j_call, p, least(1, min(p * m / k) over (order by pr range between current row and unbounded following)) as q from m) select t.v_call, t.j_call, a as count_a, b as count_b, round(fa, 6) as f_a, round(fb, 6) as f_b, round(ROUND(coalesce(p, 1), 6), 6) as p_value, round(ROUND(coalesce(q, 1), 6), 6) as q_value, case when p is null then 'untested' when q < 0.2 and a = 0 then 'emergent' when q < 0.2 and b = 0 then 'vanishing' when q < 0.2 and b / rb > a / ra then 'expanded' when q < 0.2 then 'contracted' else 'persistent' end as dynamics from t left join e on e.v_call = t.v_call and e.j_call = t.j_call",
    "expansion": f", {PAIR}, n as (select cast(sum(ca) as double) as na, cast(sum(cb) as double) as nb from j), p as (select log2(cb / nb) - log2(ca / na) as m, (log2(cb / nb) + log2(ca / na)) / 2 as s, (nb - cb) / (nb * cb) + (na - ca) / (na * ca) as v from j, n where ca > 0 and cb > 0), e as (select quantile_cont(m, 0.3) as m1, quantile_cont(m, 0.7) as m2, quantile_cont(s, 0.05) as s1, quantile_cont(s, 0.95) as s2 from p), f as (select sqrt(pow(2, sum(m / v) / sum(1 / v))) as f from p, e where m between m1 and m2 and s between s1 and s2), y as (select v_call, j_call, ca, cb, ca * (sqrt(nb / na) * f) as qa, cb * (sqrt(na / nb) / f) as qb from j, n, f), t as (select *, cast(round_even(qa, 0) as bigint) as y, cast(round_even(qa, 0) + round_even(qb, 0) as bigint) as t, log2((qb + 0.5) / (qa + 0.5)) as l from y), u as (select *, list_transform(range(0, t + 1), lambda k: exp(lgamma(t + 1) - lgamma(k + 1) - lgamma(t - k + 1) + lgamma(k + 5e0) + lgamma(t - k + 5e0) - lgamma(t + 1e1) + lgamma(1e1) - 2 * lgamma(5e0))) as q from t where t >= 6), w as (select v_call, j_call, least(1, list_sum(list_filter(q, lambda x: x <= q[y + 1] * (1 + 1e-9)))) as p from u), r as (select *, round(p, 12) as pr from w), m as (select *, count(*) over (order by pr) as k, count(*) over () as m from r), g as (select v_call, j_call, p, least(1, min(p * m / k) over (order by pr range between current row and unbounded following)) as q from m) select t.v_call, t.j_call, ca as count_a, cb as count_b, round(qa, 6) as q_a, round(qb, 6) as q_b, round(l, 6) as log2fc, round(coalesce(p, 1), 6) as p_value, round(coalesce(q, 1), 6) as q_value, 0.2e0 as dispersion, case when p is null then 'untested' when q < 0.5 and l >= 1 then 'expanded' when q < 0.5 and l <= -1 then 'contracted' else 'unchanged' end as call from t left join g on g.v_call = t.v_call and g.j_call = t.j_call",
    "expansion_dispersion": "select v_call, cast(coalesce(sum(duplicate_count) filter (sample_id = 'S01'), 0) as bigint) as count_a, cast(coalesce(sum(duplicate_count) filter (sample_id = 'S02'), 0) as bigint) as count_b, true as fitted from clonotypes where sample_id in ('S01', 'S02') group by v_call",
    "effective_size": "select true as positive",
    "capture_rates": "select j_call as group, size_class, n_captured, n_total, round((n_captured + 1) / (n_total + 2), 6) as capture_rate from (select j_call, case n when 1 then 'singleton' when 2 then 'doubleton' when 3 then 'tripleton' else 'large' end as size_class, count(*) filter (junction_aa in (select junction_aa from clonotypes where sample_id = 'S02')) as n_captured, count(*) as n_total from (select junction_aa, j_call, sum(duplicate_count) as n from clonotypes where sample_id = 'S01' group by all) group by all)",
    "capture_paired": ", c as (select *, cast(substr(sample_id, 2) as int) // 2 as donor, cast(substr(sample_id, 2) as int) % 2 as late, case when ord % 2 = 0 then 'x' else 'y' end as g from clonotypes), p as (select donor, junction_aa, g, sum(duplicate_count) as n from c where late = 0 group by all), q as (select distinct donor, junction_aa, 1 as met from c where late = 1), r as (select donor, g, case n when 1 then 'singleton' when 2 then 'doubleton' when 3 then 'tripleton' else 'large' end as size_class, ln((count(met) + 1) / (count(*) + 2)) as l from p left join q using (donor, junction_aa) group by all), w as (select donor, size_class, max(l) filter (g = 'x') - max(l) filter (g = 'y') as off from r group by all) select size_class, count(off) as n_pairs, round(case when count(off) >= 2 then avg(off) / (stddev_samp(off) / sqrt(count(off))) end, 6) as t from w group by all",
    "vj_correction_location": f", {GRID.format(count='sum(duplicate_count)')}, m as (select *, l - avg(l) over (partition by locus, v, j, batch) + avg(l) over (partition by locus, v, j) as x from p) select sample_id, batch, locus, v as v_call, j as j_call, cast(n as bigint) as count, round(p, 6) as p, round(exp(x) / sum(exp(x)) over (partition by sample_id, locus), 6) as p_corrected from m",
    "vj_correction_sigmoid": f", {GRID.format(count='count(*)')}, a as (select locus, v, j, sum(n) / sum(sum(n)) over (partition by locus) as a from p group by locus, v, j), m as (select *, avg(l) over w as mu, stddev_samp(l) over w as sd from p window w as (partition by locus, v, j, batch)), x as (select m.*, 2 * a / (1 + exp(-greatest(least(case when sd > 0 then (l - mu) / sd else 0 end, 6), -6))) as x from m join a using (locus, v, j)) select sample_id, batch, locus, v as v_call, j as j_call, cast(n as bigint) as count, round(p, 6) as p, round(x / sum(x) over (partition by sample_id, locus), 6) as p_corrected from x",
    "vj_correction_applied": "select sample_id, cast(sum(duplicate_count) as bigint) as reads, 1e0 as frequency from clonotypes group by all",
    "design_binary": "select sample_id, 'cmv' as level, cmv = '+' as positive from samples where cmv is not null",
    "design_categorical": ", l as (select batch as level from samples group by all having count(*) >= 2) select sample_id, level, batch = level as positive from samples, l",
    "design_hla": ", t as (select distinct sample_id, string_split(a, ':')[1] as level from (select sample_id, unnest([hla_1, hla_2]) as a from samples) where a is not null) select s.sample_id, l.level, exists (select 1 from t where t.sample_id = s.sample_id and t.level = l.level) as positive from (select distinct sample_id from t) s, (select distinct level from t) l",
    "design_zygosity": "select sample_id, 'homozygous' as level, hla_1 = hla_2 as positive from samples where hla_1 is not null and hla_2 is not null",
    "select_candidates": f", f as (select distinct sample_id, junction_aa, {V} as v_call, {J} as j_call from clonotypes where not regexp_matches(junction_aa, '[*_]')) select junction_aa, v_call, j_call, count(*) as incidence from f group by all having count(*) >= greatest(2, ceil((select count(distinct sample_id) from f) * 0.2))",
    "fisher_association": f""", {DESIGN}, {FEAT}, z as (select count(*) filter (positive) as p, count(*) filter (not positive) as q from design),
        t as (select junction_aa, a, b, p - a as c, q - b as d from (select junction_aa, count(*) filter (positive) as a, count(*) filter (not positive) as b from feat join design using (sample_id) group by all), z where a + b >= 2),
        u as (select *, least(1, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda k: {PMF}))) as p_value from t),
        v as (select *, round(p_value, 12) as pr from u), w as (select *, count(*) over (order by pr) as r, count(*) over () as m from v)
        select junction_aa, 'cmv' as level, a, b, c, d, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) as odds_ratio, case when a * (b + d) > b * (a + c) then 'enriched' else 'depleted' end as direction, round(p_value, 6) as p_value, round(least(1, min(p_value * m / r) over (order by pr range between current row and unbounded following)), 6) as q_value from w""",
    "cmh_association": f""", {DESIGN}, {FEAT}, z as (select batch, count(*) filter (positive) as p, count(*) filter (not positive) as q from design group by all),
        t as (select junction_aa, a, b, p - a as c, q - b as d, p + q as n from (select junction_aa, batch, count(*) filter (positive) as a, count(*) filter (not positive) as b from feat join design using (sample_id) group by all) join z using (batch) where p + q >= 2),
        s as (select junction_aa, sum(a * d / n) as up, sum(b * c / n) as down, sum(a) as obs, sum((a + b) * (a + c) / n) as ex, sum((a + b) * (c + d) * (a + c) * (b + d) / (cast(n as double) * n * (n - 1))) as v from t group by all)
        select junction_aa, round(case when down > 0 then up / down when up > 0 then 'inf'::double else 'nan'::double end, 6) as or_mh, round(case when v > 0 then pow(greatest(abs(obs - ex) - 0.5, 0), 2) / v else 0 end, 6) as chi2 from s""",
    "resolve_chains": f", {LIGHT} select cell_id, sequence_id, locus, duplicate_count, umi_count from res",
    "pair_chains": f", {LIGHT}, p as (select a.cell_id, a.v_call as alpha_v_call, a.j_call as alpha_j_call, a.junction_aa as alpha_junction_aa, a.umi_count as alpha_umi_count, a.duplicate_count as alpha_duplicate_count, b.v_call as beta_v_call, b.j_call as beta_j_call, b.junction_aa as beta_junction_aa, b.umi_count as beta_umi_count, b.duplicate_count as beta_duplicate_count, row_number() over (partition by a.cell_id order by b.ord, a.ord) as i, count(*) over (partition by a.cell_id) as n from res a join res b using (cell_id) where a.locus = 'TRA' and b.locus = 'TRB') select * exclude (i, n), case when n = 1 then cell_id else cell_id || '_' || i end as pair_id from p",
    "chain_multiplicity": ", c as (select cell_id, cast(sum(cast(locus = 'TRA' as int)) as bigint) as n_light, cast(sum(cast(locus = 'TRB' as int)) as bigint) as n_heavy from cells where locus in ('TRA', 'TRB') group by all) select n_light, n_heavy, count(*) as cells from c group by all",
    "pgen_nt_vj": f", {toy.space(toy.VJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select s, sum(p) as p from space group by s) select junction_nt, round(coalesce(p, 0), 6) as pgen from x left join g on s = junction_nt",
    "pgen_nt_vdj": f", {toy.space(toy.VDJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select s, sum(p) as p from space group by s) select junction_nt, round(coalesce(p, 0), 6) as pgen from x left join g on s = junction_nt",
    "read_other_orders": """select sample_id, v_call, count(*) as n, cast(sum(duplicate_count) as bigint) as reads, count(distinct (junction_nt, junction_aa, j_call)) as junctions, count(*) filter (ord % 10 = 4) as notes
        from clonotypes where junction_aa not like '%*%' and not contains(junction_aa, '_') group by all""",
    "exact_quantiles": """, s as (select [0.0e0, 0.05e0, 0.5e0, 0.777e0, 1.0e0] as shares), q as (select 'frequency' as field, quantile_cont(frequency, [0.0, 0.05, 0.5, 0.777, 1.0]) as v from clonotypes union all select 'duplicate_count', quantile_cont(cast(duplicate_count as double), [0.0, 0.05, 0.5, 0.777, 1.0]) from clonotypes),
        u as (select field, unnest(shares) as share, unnest(v) as value from q, s) select field, share, round(value, 6) as value from u""",
    "pgen_summary": f""", x as ({toy.JUNCTIONS.strip()}), ga as (with {toy.space(toy.VJ)} select s, sum(p) as p from space group by s), gb as (with {toy.space(toy.VDJ)} select s, sum(p) as p from space group by s),
        l as (select case when ga.p > 0 then round(log10(ga.p), 9) end as a, case when gb.p > 0 then round(log10(gb.p), 9) end as b from x left join ga on ga.s = junction_nt left join gb on gb.s = junction_nt), m as (select a, b, round(a - b, 9) as d from l),
        r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2e0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2e0 as rb from m where a is not null and b is not null),
        v as (select a as v, 1 as na, 0 as nb from m where a is not null union all select b, 0, 1 from m where b is not null), c as (select v, sum(sum(na)) over (order by v) as ca, sum(sum(nb)) over (order by v) as cb, sum(sum(na)) over () as ta, sum(sum(nb)) over () as tb from v group by v),
        k as (select max(abs(ca / ta::double - cb / tb::double)) as d, sqrt(any_value(ta::double * tb / (ta + tb))) as e from c), t as (select count(*) as n, count(a) as n_scoreable_a, count(b) as n_scoreable_b, count(d) as n_scoreable_both, count(*) filter (a is not null and b is null) as only_a_scoreable, count(*) filter (b is not null and a is null) as only_b_scoreable,
        avg(a) as ma, avg(b) as mb, avg(d) as md, stddev_samp(d) as sd, corr(a, b) as pc, median(a) as qa, median(b) as qb, quantile_cont(d, 0.05) as q1, median(d) as q2, quantile_cont(d, 0.95) as q3 from m)
        select n, n_scoreable_a, n_scoreable_b, n_scoreable_both, only_a_scoreable, only_b_scoreable, round(ma, 6) as mean_log10_a, round(mb, 6) as mean_log10_b, round(md, 6) as mean_delta, round(sd, 6) as sd_delta, round(pc, 6) as pearson_log10, round(qa, 6) as median_log10_a, round(qb, 6) as median_log10_b,
        round(q1, 6) as q05_delta, round(q2, 6) as median_delta, round(q3, 6) as q95_delta, round((select corr(ra, rb) from r), 6) as spearman_log10, round(k.d, 6) as ks_stat, round(case when k.d * e < 0.2 then 1 else least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda i: (case when i % 2 = 1 then 1e0 else -1e0 end) * exp(-2 * i * i * k.d * k.d * e * e))))) end, 6) as ks_p from t, k""",
    "best_scenario_vj": f", {toy.space(toy.VJ)}, x as ({toy.JUNCTIONS.strip()}) select junction_nt, round(max(p), 6) as p from x join space on s = junction_nt group by junction_nt",
    "best_scenario_vdj": f", {toy.space(toy.VDJ)}, x as ({toy.JUNCTIONS.strip()}) select junction_nt, round(max(p), 6) as p from x join space on s = junction_nt group by junction_nt",
    "scenario_counts": f", {toy.space(toy.VDJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select la, lb, p / sum(p) over (partition by s) as p from x join space on s = junction_nt) select 'len0' as kind, cast(la as varchar) as piece, round(sum(p), 6) as x from g group by la union all select 'len1', cast(lb as varchar), round(sum(p), 6) from g group by lb",
    "scenario_fit": f", {toy.space(toy.VJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select sum(p) as p from x join space on s = junction_nt group by s) select 'n' as piece, round(cast(count(*) as double), 6) as x from g union all select 'log', round(sum(ln(p)), 6) from g",
    "inferred_genes": f", {toy.space(toy.VDJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select v, j, p / sum(p) over (partition by s) as p from x join space on s = junction_nt) select 'v' as event, v as value, round(sum(p) / (select sum(p) from g), 6) as p from g group by v union all select 'j', j, round(sum(p) / (select sum(p) from g), 6) from g group by j",
    "inferred_joint": f", {toy.space(toy.VJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select v, j, p / sum(p) over (partition by s) as p from x join space on s = junction_nt), h as (select v, j, sum(p) as p from g group by all) select v as parent, j as value, round(p / sum(p) over (partition by v), 6) as p from h",
    "pgen_nt_genes": f", {toy.space(toy.VDJ)}, x as (select junction_nt, case when junction_nt like 'TGT%' then 'V1' else 'V2*01' end as v_call, case when junction_nt like '%TTTC' then 'J1*01' else 'J2' end as j_call from ({toy.JUNCTIONS.strip()})), g as (select s, v, j, sum(p) as p from space group by all) select junction_nt, v_call, j_call, round(coalesce(p, 0), 6) as pgen from x left join g on s = junction_nt and starts_with(v, v_call) and starts_with(j, j_call)",
    "pgen_aa_vj": f", {toy.space(toy.VJ)}, {RESIDUE} select junction_aa, round(coalesce(p, 0), 6) as pgen from x left join g on a = junction_aa",
    "pgen_aa_vdj": f", {toy.space(toy.VDJ)}, {RESIDUE} select junction_aa, round(coalesce(p, 0), 6) as pgen from x left join g on a = junction_aa",
    "pgen_ball": f", {toy.space(toy.VDJ)}, {RESIDUE} select junction_aa, round(coalesce(sum(p), 0), 6) as pgen_ball from x left join g on length(a) = length(junction_aa) and not contains(a, '*') and hamming(case when length(a) = length(junction_aa) then a else junction_aa end, junction_aa) <= 1 group by junction_aa",
    "pgen_fit": f", {toy.space(toy.VJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select s, sum(p) as p from space group by s), y as (select coalesce(p, 0) as p from x left join g on s = junction_nt) select count(*) as n, count(*) filter (p <= 0) as zero, round(avg(log10(p)) filter (p > 0), 6) as log_likelihood from (select p, case when p > 0 then p else 1 end as q from y) where true".replace("avg(log10(p))", "avg(log10(q))"),
    "pgen_histogram": f", {toy.space(toy.VDJ)}, x as ({toy.JUNCTIONS.strip()}), g as (select s, sum(p) as p from space group by s) select floor(log10(p)) as low, count(*) as n from x join g on s = junction_nt where p > 0 group by all",
    "generated": f", {toy.space(toy.VDJ)} select distinct v as v_call, j as j_call, true as drawn from space",
    "model_genes": f", {toy.marginals(toy.VJ, 'm')} select value, round(sum(weight * p), 6) as p from m where event = 'j' group by all",
    "model_entropy": f", {toy.marginals(toy.VDJ, 'm')} select event, round(sum(case when p > 0 then -weight * p * log2(p) else 0 end), 6) as entropy from m group by all",
    "model_total_entropy": f", {toy.marginals(toy.VDJ, 'm')}, e as (select event, sum(case when p > 0 then -weight * p * log2(p) else 0 end) as h from m group by all), n as (select event || '_step' as event, sum(p * cast(value as double)) as n from m where event in ('vd_ins', 'dj_ins') group by event) select round(sum(h * coalesce(n, 1)), 6) as entropy from e left join n using (event)",
    "model_information": f", {toy.marginals(toy.VJ, 'm')}, q as (select event, value, sum(weight * p) as q from m group by all) select event, round(sum(weight * p * log2(p / q)), 6) as information from m join q using (event, value) where weight * p > 0 group by all",
    "model_distance": f", {toy.marginals(toy.VJ, 'a')}, {toy.marginals(toy.VDJ, 'b')}, u as (select coalesce(a.event, b.event) as event, coalesce(a.parent, b.parent) as parent, coalesce(a.p, 0) as p, coalesce(b.p, 0) as q, max(coalesce(a.weight, 0)) over w as wa, max(coalesce(b.weight, 0)) over w as wb from a full join b on a.event = b.event and a.parent = b.parent and a.value = b.value window w as (partition by coalesce(a.event, b.event), coalesce(a.parent, b.parent))), h as (select event, parent, sum(case when p > 0 then 0.5 * p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then 0.5 * q * log2(2 * q / (p + q)) else 0 end) as js, sum(abs(p - q)) / 2 as tv, (max(wa) + max(wb)) / 2 as w from u group by all) select event, round(sum(w * js) / sum(w), 6) as js, round(sum(w * tv) / sum(w), 6) as tv from h group by all",
    "model_usage": ", v as (select count(*) filter (v_call like 'TRB%') as a, count(*) filter (v_call not like 'TRB%') as b from clonotypes) select 'V1*01' as value, round((a + b / 2) / (a + b), 6) as p from v union all select 'V2*01', round((b / 2) / (a + b), 6) from v",
    "kmer_vocabulary": f", r as (select sample_id, {V} as v, translate(junction_aa, '{''.join(reduced_alphabet(8))}', '{''.join(reduced_alphabet(8).values())}') as a from clonotypes where regexp_matches(junction_aa, '^[ACDEFGHIKLMNPQRSTVWY]+$')), k as (select sample_id, v || ':' || substr(c, cast(i as int), 2) || substr(c, cast(i + 3 as int), 1) as kmer from (select sample_id, v, substr(a, 3, length(a) - 4) as c, unnest(range(1, length(a) - 4 - 4 + 2)) as i from r)), n as (select count(distinct sample_id) as n from clonotypes) select kmer, count(distinct sample_id) as df, round(ln((1 + n) / (1 + count(distinct sample_id))) + 1, 6) as idf from k, n group by kmer, n having count(distinct sample_id) between 0.1 * n and 0.9 * n",
    "kmer_projection": "select distinct sample_id, 1e0 as length from clonotypes",
    "shm_entropy": ", b as (select sample_id, least(floor(v_identity * 20), 19) as b, sum(frequency) as w from clonotypes where v_identity is not null group by all), p as (select *, w / sum(w) over (partition by sample_id) as p from b) select sample_id, round(sum(-p * ln(p)), 6) as entropy from p group by all",
    "pgen_pattern": f", {toy.space(toy.VDJ)}, {RESIDUE}, y as (select distinct 'CX' || substr(junction_aa, 3) as pattern from x where length(junction_aa) > 2) select pattern, round(coalesce(sum(p), 0), 6) as pgen from y left join g on a[1] = 'C' and length(a) = length(pattern) and substr(a, 3) = substr(pattern, 3) and a[2] != '*' group by pattern",
    "cluster_eval": """, c as (select label as t, vec_id % 7 as p, cast(count(*) as double) as n from embeddings group by all), t as (select t, sum(n) as n, max(n) as m from c group by all), p as (select p, sum(n) as n, max(n) as m from c group by all),
        z as (select sum(n) as total, sum(m) as mt, max(n) as big, count(*) as k, ln(sum(n)) - sum(n * ln(n)) / sum(n) as hc from t), y as (select sum(m) as mp, ln(sum(n)) - sum(n * ln(n)) / sum(n) as hk from p), x as (select ln(sum(n)) - sum(n * ln(n)) / sum(n) as hck from c),
        r as (select mp / total as pu, (mp / total - big / total) / (1 - big / total) as npu, mt / total as ip, (mt / total - k / total) / (1 - k / total) as nip, 1 - greatest(0, hck - hk) / hc as h, 1 - greatest(0, hck - hc) / (ln(total) - hc) as s from z, y, x)
        select round(pu, 6) as purity, round(npu, 6) as normalized_purity, round(ip, 6) as inverse_purity, round(nip, 6) as normalized_inverse_purity, round(h, 6) as homogeneity, round(s, 6) as parsimony, round(2 * h * s / (h + s), 6) as q_measure from r""",
    "neighbour_enrichment": f""", r as (select sample_id, {SHORT} as s, substr(v_call, 1, 3) as locus, v_call, j_call, duplicate_count as n, ord from clonotypes where sample_id in ('S01', 'S02')), o as (select locus, s, arg_max(v_call, n * 1000000000000 - ord) as v_call, arg_max(j_call, n * 1000000000000 - ord) as j_call, sum(n) as n from r where sample_id = 'S01' group by all),
        k as (select distinct s from r where sample_id = 'S02'), d as (select a.locus, a.s, count(*) - 1 as d from o a join o b on a.locus = b.locus and length(a.s) = length(b.s) and hamming(a.s, b.s) <= 1 group by all), c as (select a.locus, a.s, count(*) as c from o a join k on length(a.s) = length(k.s) and hamming(a.s, k.s) <= 1 group by all),
        z as (select locus, count(*) as z from o group by all), m as (select count(*) as m from k), e as (select o.*, d.d, coalesce(c.c, 0) as c, z / m * coalesce(c.c, 0) as e from o join d using (locus, s) left join c using (locus, s) join z using (locus), m),
        p as (select *, case when d <= 0 then 1 when e <= 0 then 0 else least(1, list_sum(list_transform(range(d, d + 150), lambda i: exp(i * ln(e) - e - lgamma(i + 1))))) end as p from e), w as (select *, round(p, 12) as pr from p), x as (select *, count(*) over (order by pr) as r, count(*) over () as m from w)
        select 'S01' as sample_id, s as junction_aa, v_call, j_call, cast(n as bigint) as duplicate_count, d as n_neighbors, c as n_control, round(e, 6) as "E", round(p, 6) as p_enrichment, round(least(1, min(p * m / r) over (order by pr range between current row and unbounded following)), 6) as q_value, locus from x""",
    "neighbour_enrichment_model": f""", r as (select sample_id, {SHORT} as s, substr(v_call, 1, 4) as v, substr(j_call, 1, 4) as j, duplicate_count as n from clonotypes where duplicate_count >= 2), g as (select sample_id, v, j, count(*) as g from r group by all), h as (select sample_id, v, j, s, count(*) as k, sum(n) as n from r group by all),
        d as (select a.sample_id, a.v, a.j, a.s, a.n, sum(b.k) as d from h a join h b on a.sample_id = b.sample_id and a.v = b.v and a.j = b.j and length(a.s) = length(b.s) and hamming(a.s, b.s) <= 1 group by all), e as (select d.*, g, 1e-3 * length(s) as q, g * 9.41e0 * 1e-3 * length(s) as e from d join g using (sample_id, v, j) where d >= 2)
        select sample_id, s as junction_aa, v as v_call, j as j_call, cast(n as bigint) as duplicate_count, cast(d as bigint) as n_neighbors, g as n_group, round(q, 6) as pgen_ball, round(e, 6) as "E", round(case when d > e then list_sum(list_transform(range(cast(d as bigint), cast(d as bigint) + 200), lambda i: exp(i * ln(e) - e - lgamma(i + 1)))) else 1 - list_sum(list_transform(range(0, cast(d as bigint)), lambda i: exp(i * ln(e) - e - lgamma(i + 1)))) end, 6) as p_enrichment, substr(v, 1, 3) as locus from e""",
    "similarity_overlap": f", {KERNEL.format(tau='1e0')} select round(ab / sqrt(aa * bb), 6) as similarity from k",
    "similarity_overlap_morisita": f", {KERNEL.format(tau='2e0')} select round(2 * ab / (aa + bb), 6) as similarity from k",
    "residue_overlap": f", {GAPPED} select round(ab / sqrt(aa * bb), 6) as similarity, round(ab / sqrt(aah * bbh), 6) as low, round(abh / sqrt(aa * bb), 6) as high from k",
    "functional_diversity": ", p as (select sample_id, junction_aa as s, sum(frequency) / sum(sum(frequency)) over (partition by sample_id) as p from clonotypes group by sample_id, junction_aa), z as (select a.sample_id, a.s, any_value(a.p) as p, sum(b.p * exp(-cast(hamming(a.s, b.s) as double))) as z from p a join p b on a.sample_id = b.sample_id and length(a.s) = length(b.s) and hamming(a.s, b.s) <= 1 group by all), r as (select sample_id, 1 - sum(p * z) as rao, sum(p / z) as d0, exp(-sum(p * ln(z))) as d1, 1 / sum(p * z) as d2 from z group by all), o as (select sample_id, rao, 0 as order_q, d0 as d from r union all select sample_id, rao, 1, d1 from r union all select sample_id, rao, 2, d2 from r) select sample_id, round(rao, 6) as rao, order_q, round(d, 6) as diversity from o",
    "flag_mispairing": f", {LIGHT}, p as (select a.cell_id, a.v_call as alpha_v_call, a.j_call as alpha_j_call, a.junction_aa as alpha_junction_aa, a.umi_count as alpha_umi_count, a.duplicate_count as alpha_duplicate_count, b.v_call as beta_v_call, b.j_call as beta_j_call, b.junction_aa as beta_junction_aa, b.umi_count as beta_umi_count, b.duplicate_count as beta_duplicate_count, row_number() over (partition by a.cell_id order by b.ord, a.ord) as i, count(*) over (partition by a.cell_id) as n from res a join res b using (cell_id) where a.locus = 'TRA' and b.locus = 'TRB'), q as (select * exclude (i, n), case when n = 1 then cell_id else cell_id || '_' || i end as pair_id, beta_v_call || '|' || beta_j_call || '|' || beta_junction_aa as m, alpha_v_call || '|' || alpha_j_call || '|' || alpha_junction_aa as s, alpha_duplicate_count + alpha_umi_count as w from p), e as (select m, s, count(*) as n, sum(w) as w from q group by all), c as (select m, first(s order by n desc, w desc, s) as c, count(*) as k from e group by all), f as (select q.*, c, k, bool_or(s = c) over (partition by cell_id, m) as h from q join c using (m)), g as (select *, case when k > 4 then 'ambient_master' when s != c and not h then 'noncanonical_alpha' else 'ok' end as mispairing_reason from f) select * exclude (m, s, w, c, k, h), mispairing_reason != 'ok' as mispairing_flag from g",
    "singleton_ids": ", e as (select event_id, case when event_id % 3 = 0 then null when event_id % 7 = 0 then -1 else event_id % 5 end as c from events) select event_id, cast(-row_number() over (order by event_id) as bigint) as cluster from e where c is null or c = -1 union all select event_id, cast(c as bigint) from e where c != -1",
    "signature_depth": f", {SIG}, f as (select *, case when f2 > 0 then f1 * f1 / (2 * f2) else f1 * (f1 - 1) / 2 end as u from st) select sample_id, locus, 'depth' as block, f.feature, round(case f.feature when 'reads' then log10(reads) when 'richness' then log10(rich) else ln(1 + u) end, 6) as value from f, (select unnest(['reads', 'richness', 'S_unseen']) as feature) f(feature)".replace("from f, (select", "from f g, (select"),
    "signature_clones": f", {SIG}, p as (select *, [f1 / rich, f2 / rich, (rich - f1 - f2) / rich] as p from st), z as (select *, len(list_filter(p, lambda x: x = 0)) as z, list_min(list_filter(p, lambda x: x > 0)) as lo from p), q as (select *, case when z > 0 then least(0.5 / rich, 0.5 * lo / z) else 0 end as d from z), l as (select *, list_transform(p, lambda x: ln(case when x = 0 then d else x * (1 - d * z) end)) as l from q) select sample_id, locus, 'clon' as block, feature, round(case feature when 'f1' then l[1] - list_avg(l) when 'f2' then l[2] - list_avg(l) else ln((top * reads + 0.5) / ((1 - top) * reads + 0.5)) end, 6) as value from l, (select unnest(['f1', 'f2', 'top']) as feature)",
    "signature_lengths": f", {SIG}, m as (select sample_id, locus, sum(w * length(s)) as m from wk group by all), v as (select sample_id, locus, any_value(m) as m, sqrt(sum(w * pow(length(s) - m, 2))) as sd, sum(w * pow(length(s) - m, 3)) as t from wk join m using (sample_id, locus) group by all) select sample_id, locus, 'len' as block, feature, round(case feature when 'mean' then m when 'sd' then sd else coalesce(t / nullif(sd * sd * sd, 0), 0) end, 6) as value from v, (select unnest(['mean', 'sd', 'skew']) as feature)",
    "signature_isotypes": f", {SIG}, p as (select sample_id, locus, count(*) as n, [coalesce(sum(w) filter (c = 'IGHM'), 0), coalesce(sum(w) filter (c = 'IGHD'), 0), coalesce(sum(w) filter (c in ('IGHG1', 'IGHG2', 'IGHG3', 'IGHG4')), 0), coalesce(sum(w) filter (c in ('IGHA1', 'IGHA2')), 0), coalesce(sum(w) filter (c = 'IGHE'), 0)] as q from wk where locus = 'IGH' group by all), r as (select *, list_append(q, case when 1 - list_sum(q) > 1e-12 then 1 - list_sum(q) else 0 end) as r from p), p2 as (select *, list_transform(r, lambda x: x / list_sum(r)) as p from r), z as (select *, len(list_filter(p, lambda x: x = 0)) as z, list_min(list_filter(p, lambda x: x > 0)) as lo from p2), y as (select *, case when z > 0 then least(0.5 / n, 0.5 * lo / z) else 0 end as d from z), l as (select *, list_transform(p, lambda x: ln(case when x = 0 then d else x * (1 - d * z) end)) as l from y) select sample_id, locus, 'iso' as block, ['IgM', 'IgD', 'IgG', 'IgA', 'IgE'][i] as feature, round(l[i] - list_avg(l), 6) as value from l, (select unnest([1, 2, 3, 4, 5]) as i)",
    "signature_mutation": f", {SIG}, m as (select sample_id, locus, sum(w * i) filter (i is not null) / sum(w) filter (i is not null) as x, count(i) as n from wk group by all) select sample_id, locus, 'shm' as block, 'mean_v_identity' as feature, round(ln((least(greatest(x, 0), 1) * n + 0.5) / ((1 - least(greatest(x, 0), 1)) * n + 0.5)), 6) as value from m",
    "signature_pairs": f", {SIG}, r as (select sample_id, coalesce(sum(reads) filter (locus = 'TRB'), 0) as b, coalesce(sum(reads) filter (locus = 'IGH'), 0) as h from st group by all) select sample_id, 'all' as locus, 'pair' as block, feature, round(case feature when 'log_IGK_IGL' then 0 when 'log_IGH_TRB' then log10((h + 1) / (b + 1)) else log10(1 / (b + 1)) end, 6) as value from r, (select unnest(['log_TRA_TRB', 'log_TRG_TRB', 'log_TRD_TRB', 'log_IGK_IGL', 'log_IGH_TRB']) as feature)",
    "signature_residues": f", {SIG}, g as (select sample_id, locus, sum(length(s)) as m, sum(length(s) * w) as t from wk group by all), x as (select sample_id, locus, r, sum(w * (length(s) - length(replace(s, r, '')))) as x from wk, (select unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) as r) group by all) select sample_id, locus, 'aa' as block, r as feature, round(asin(sqrt((x / t * m + 0.375) / (m + 0.75))), 6) as value from x join g using (sample_id, locus)",
    "signature_quality": f", {SIG}, a as (select sample_id, locus, count(*) as n, sum(n) as a from rw group by all), b as (select sample_id, locus, sum(n) as b from wk group by all), q as (select *, 1 - coalesce(b, 0) / a as x from a left join b using (sample_id, locus)) select sample_id, locus, 'qc' as block, 'nonstd_aa_frac' as feature, round(ln((x * n + 0.5) / ((1 - x) * n + 0.5)), 6) as value from q",
    "signature_properties": f", {SIG}, v as (select sample_id, locus, w, list_filter(list_transform(string_split(s, ''), lambda r: {_H}[r]), lambda x: x is not null) as v from wk) select sample_id, locus, 'pchem' as block, 'all_hydropathy' as feature, round(sum(list_avg(v) * w) / sum(w), 6) as value from v where len(v) > 0 group by all",
    "signature_wide": f", {SIG}, t as (select sample_id, log10(reads) as r from st where locus = 'TRB'), p as (select sample_id, log10((sum(reads) filter (locus = 'IGH') + 1) / (sum(reads) filter (locus = 'TRB') + 1)) as q from st group by all), l as (select sample_id, sum(w * length(s)) as m from wk where locus = 'TRB' group by all) select sample_id, round(r, 6) as reads, round(q, 6) as ratio, round(m, 6) as length from t join p using (sample_id) join l using (sample_id)",
}.items()}
