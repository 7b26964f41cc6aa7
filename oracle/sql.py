"""DuckDB SQL for every query that SQL can express, written independently of the Spark code.

Each statement starts from the same common table expressions, which bind the sales tables to the
clinical ones; DuckDB ignores the ones a statement does not use.
"""

from __future__ import annotations

from wardstat.sources.tables import FLAGS

_FLAG_LIST = ", ".join(FLAGS)
_SUM_FLAGS = " + ".join(FLAGS)


def _each(template: str, names=FLAGS, sep: str = ", ") -> str:
    return sep.join(template.format(f=f, i=i) for i, f in enumerate(names))


_BANDS = "case when {a} between 16 and 24 then '16-24' when {a} between 25 and 44 then '25-44' when {a} between 45 and 64 then '45-64' when {a} between 65 and 84 then '65-84' when {a} between 85 and 95 then '85-95' end"

_ROLES = f"""
with patients as (
  select c_custkey as subject_id,
         case when c_custkey % 2 = 0 then 'M' else 'F' end as gender,
         timestamp '1885-01-01' + to_days(cast((c_custkey * 7919) % 38000 as integer)) as dob,
         case when c_acctbal < 0
              then timestamp '1885-01-01' + to_days(cast((c_custkey * 7919) % 38000 + 36500 as integer)) end as dod
  from customer
), admissions as (
  select o_orderkey as hadm_id, o_custkey as subject_id, cast(o_orderdate as timestamp) as admittime,
         cast(o_orderdate as timestamp) + to_hours(cast((o_orderkey * 13) % 720 + 1 as integer)) as dischtime,
         case when o_orderstatus = 'F'
              then cast(o_orderdate as timestamp) + to_hours(cast((o_orderkey * 13) % 720 + 1 as integer)) end as deathtime,
         case o_orderpriority when '5-LOW' then 'ELECTIVE' when '1-URGENT' then 'URGENT' else 'EMERGENCY' end as admission_type
  from orders
), icustays as (
  select l_orderkey * 10 + l_linenumber as icustay_id, l_orderkey as hadm_id, o_custkey as subject_id,
         cast(min(l_shipdate) as timestamp) as intime,
         cast(min(l_shipdate) as timestamp) + to_hours(cast(sum(l_quantity) as bigint)) as outtime
  from lineitem join orders on o_orderkey = l_orderkey
  group by l_orderkey, l_linenumber, o_custkey
), sofa as (
  select l_orderkey * 10 + l_linenumber as icustay_id, l_orderkey as hadm_id, o_custkey as subject_id,
         cast(max(l_partkey % 25) as integer) as sofa
  from lineitem join orders on o_orderkey = l_orderkey where l_suppkey % 10 <> 0
  group by l_orderkey, l_linenumber, o_custkey
), oasis as (
  select l_orderkey as hadm_id, o_custkey as subject_id, cast(max(l_suppkey % 61) as integer) as oasis
  from lineitem join orders on o_orderkey = l_orderkey where l_suppkey % 10 <> 1
  group by l_orderkey, l_linenumber, o_custkey
), angus as (
  select l_orderkey as hadm_id, o_custkey as subject_id,
         max(case when l_partkey % 7 = 0 then 1 else 0 end) as organ_dysfunction,
         max(case when l_partkey % 17 = 0 or l_partkey % 23 = 0 then 1 else 0 end) as explicit_sepsis
  from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, o_custkey
), elixhauser as (
  select l_orderkey as hadm_id,
         {_each("max(case when l_partkey % 30 = {i} and l_discount >= 0.03 then 1 else 0 end) as {f}")}
  from lineitem group by l_orderkey
), diagnoses as (
  select l_orderkey as hadm_id, case when l_partkey % 17 = 0 then '99592' when l_partkey % 23 = 0 then '78552'
         else cast(l_partkey as varchar) end as code
  from lineitem
), firsts as (
  select * from icustays qualify intime = min(intime) over (partition by subject_id)
), adults as (
  select f.subject_id, p.dob, p.gender, f.hadm_id, f.icustay_id, f.intime, f.outtime,
         cast(date_part('year', age(f.intime, p.dob)) as integer) as age_at_admission
  from firsts f join patients p using (subject_id)
  where date_part('year', age(f.intime, p.dob)) >= 16
), included as (
  select d.subject_id, d.hadm_id, d.icustay_id, a.deathtime, d.intime as icu_intime, d.outtime as icu_outtime,
         a.admittime, a.dischtime, d.gender, d.age_at_admission,
         if(a.admission_type = 'ELECTIVE', 'Elective', 'Non-Elective') as admission_type
  from adults d join admissions a on a.hadm_id = d.hadm_id where d.age_at_admission <= 95
), lengths as (
  select *, epoch(icu_outtime - icu_intime) / 86400.0 as los_icu_days,
         epoch(dischtime - admittime) / 86400.0 as los_hospital_days
  from included
), flagged as (
  select l.subject_id, l.hadm_id, icustay_id, deathtime, gender, age_at_admission, admission_type,
         round(los_icu_days, 6) as los_icu_days, round(los_hospital_days, 6) as los_hospital_days, {_FLAG_LIST}
  from lengths l join elixhauser e on e.hadm_id = l.hadm_id
), counted as (
  select l.subject_id, l.hadm_id, icustay_id, deathtime, gender, age_at_admission, admission_type,
         los_icu_days, los_hospital_days, {_SUM_FLAGS} as disease_count
  from lengths l join elixhauser e on e.hadm_id = l.hadm_id
), scored as (
  select c.*, s.sofa, {_BANDS.format(a="age_at_admission")} as age_bucket,
         case when disease_count = 1 then '1 disease' when disease_count > 7 then '>7 diseases'
              else disease_count || ' diseases' end as disease_category
  from counted c join sofa s on s.icustay_id = c.icustay_id
), classed as (
  select *, cast(subject_id % 7 + 1 as integer) as class_assignment from flagged
), sepsis as (
  select a.subject_id, a.hadm_id, d.severe_sepsis, d.septic_shock,
         if(coalesce(d.severe_sepsis, 0) + coalesce(d.septic_shock, 0) > 0, 1, 0) as sepsis
  from admissions a left join (
    select hadm_id, cast(bool_or(code = '99592') as integer) as severe_sepsis,
           cast(bool_or(code = '78552') as integer) as septic_shock
    from diagnoses group by hadm_id) d on d.hadm_id = a.hadm_id
), category as (
  select d.*, a.admittime, a.dischtime, a.deathtime,
         if(a.admission_type = 'ELECTIVE', 'Elective', 'Non-Elective') as admission_category
  from adults d join admissions a on a.hadm_id = d.hadm_id and a.subject_id = d.subject_id
), prepared as (
  select subject_id, hadm_id, icustay_id, deathtime, if(gender = 'M', 0, 1) as gender, age_at_admission,
         if(admission_type = 'Elective', 1, 0) as admission_type, los_icu_days, los_hospital_days,
         {_each("{f} + 1 as {f}")}
  from flagged
), marks as (
  unpivot (select icustay_id, class_assignment, {_FLAG_LIST} from classed) on {_FLAG_LIST} into name condition value v
), outcomes as (
  select c.* exclude (class_assignment), class_assignment as "Subgroup", s.sofa, o.oasis, g.organ_dysfunction,
         g.explicit_sepsis, z.sepsis, p.dod is null as dod_missing
  from classed c
  join sofa s on s.subject_id = c.subject_id and s.hadm_id = c.hadm_id
  join oasis o on o.subject_id = c.subject_id and o.hadm_id = c.hadm_id
  join angus g on g.subject_id = c.subject_id and g.hadm_id = c.hadm_id
  join sepsis z on z.subject_id = c.subject_id and z.hadm_id = c.hadm_id
  join patients p on p.subject_id = c.subject_id
)"""


def _text(x: str) -> str:
    return f"rtrim(rtrim(cast(cast(round({x}, 4) as decimal(18,4)) as varchar), '0'), '.')"


def _profile(group: str) -> str:
    """Unrounded Table One statistics of ``scored`` per value of a SQL expression."""
    rate = "1.96 * sqrt({p} * (1 - {p}) / count(*)) * 100"
    multi = "(count(*) filter (where disease_count > 1) / count(*)::double)"
    dead = "(count(deathtime) / count(*)::double)"
    parts = [
        f"{group} as grp",
        "count(*) as n",
        *[f"quantile_cont(disease_count, {q}) as q{i}" for i, q in enumerate((0.25, 0.5, 0.75), 1)],
        f"100 * {multi} as multi, {rate.format(p=multi)} as multi_h",
        f"100 * {dead} as dead, {rate.format(p=dead)} as dead_h",
        "avg(sofa) as sofa, 1.96 * stddev_samp(sofa) / sqrt(count(sofa)) as sofa_h",
        *[
            f"avg({c}) as {n}, 1.96 * stddev_samp({c}) / sqrt(count(subject_id)) as {n}_h"
            for n, c in (("icu", "los_icu_days"), ("hosp", "los_hospital_days"))
        ],
    ]
    return f"select {', '.join(parts)} from scored group by 1"


def _bounds(x: str, est: str, lo: str, hi: str) -> str:
    return f"round({x}, 6) as {est}, round({x} - {x}_h, 6) as {lo}, round({x} + {x}_h, 6) as {hi}"


_MEANS = (("sofa", "sofa"), ("icu", "los_icu"), ("hosp", "los_hospital"))
_MEAN_BOUNDS = ", ".join(_bounds(x, f"mean_{n}", f"{n}_lower_95ci", f"{n}_upper_95ci") for x, n in _MEANS)
_MULTI = _bounds("multi", "percent_multimorbidity", "lower_95ci_multimorbidity", "upper_95ci_multimorbidity")
_DEAD = _bounds("dead", "percent_mortality", "lower_95ci_mortality", "upper_95ci_mortality")
_IQR = f"round(q2, 6) as median_morbidity_count, {_text('q1')} || ' - ' || {_text('q3')} as iqr_morbidity_count"
_SHARE = "round(100.0 * n / sum(n) over (), 6) as patient_percentage"


def _span(x: str) -> str:
    return f"{_text(x)} || ' (' || {_text(f'{x} - {x}_h')} || ', ' || {_text(f'{x} + {x}_h')} || ')'"


def _table_one(by: str, columns: str) -> str:
    return f"select grp as {by}, n as patient_count, {columns} from ({_profile(by)})"


def _overall() -> str:
    means = ", ".join(f"round({x}, 6) as mean_{n}, {_span(x)} as {n}_95ci" for x, n in _MEANS)
    return (
        f"select n as patient_count, {_SHARE}, {_IQR}, {_MULTI}, {means}, "
        f"round(dead, 6) as percent_mortality, {_span('dead')} as mortality_95ci from ({_profile('1')})"
    )


def _all_cuts() -> str:
    cuts = {"overall": "null::varchar", "gender": "gender", "disease_category": "disease_category",
            "admission_type": "admission_type", "age_bucket": "age_bucket"}
    columns = ", ".join(
        _bounds(x, n, f"{n}_lower_95ci", f"{n}_upper_95ci")
        for x, n in (("multi", "percent_multimorbidity"), ("dead", "percent_mortality"),
                     *[(x, f"mean_{n}") for x, n in _MEANS])
    )
    return " union all ".join(
        f"select '{cut}' as cut, grp as label, n as patient_count, {_SHARE}, {_IQR}, {columns} from ({_profile(g)})"
        for cut, g in cuts.items()
    )


def _by_age(source: str, value: str, name: str) -> str:
    band = _BANDS.format(a="age_at_admission")
    return (
        f"select {band} as age_bucket, count(*) as number_of_patients, round(avg({value}), 6) as {name} "
        f"from {source} group by 1"
    )


def _mean_pair(c: str, alias: str) -> str:
    half = f"1.96 * stddev_samp({c}) / sqrt(count({c}))"
    return (
        f"round(avg({c}), 6) as mean_{alias}, round(avg({c}) - {half}, 6) as lower_95ci_{alias}, "
        f"round(avg({c}) + {half}, 6) as upper_95ci_{alias}"
    )


def _category_rate(hits: str, hit_name: str, source: str, percent: str, scale: float) -> str:
    p = f"({hits} / count(*)::double)"
    half = f"1.96 * sqrt({p} * (1 - {p}) / count(*)) * {scale}"
    return (
        f"select admission_category, {hits} as {hit_name}, count(*) as total_patients, "
        f"round(100 * {p}, 6) as {percent}, round(100 * {p} - {half}, 6) as lower_95ci, "
        f"round(100 * {p} + {half}, 6) as upper_95ci from {source} group by 1"
    )


_PAIRS = """
  select {key} l.condition as a, r.condition as b, count(*) as n
  from marks l join marks r on r.icustay_id = l.icustay_id
  where l.v = 1 and r.v = 1 group by all"""

_GRID = "(select unnest([" + ", ".join(f"'{f}'" for f in FLAGS) + "]) as {c})"
_ALL_PAIRS = f"""(select x.a, y.b, coalesce(p.n, 0) as n from {_GRID.format(c='a')} x cross join {_GRID.format(c='b')} y
  left join ({_PAIRS.format(key='')}) p on p.a = x.a and p.b = y.b)"""

_POSITION = "list_position([" + ", ".join(f"'{f}'" for f in FLAGS) + "], condition)"
_BOX = """
select {g}, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
       round(min(v) filter (where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
       round(max(v) filter (where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
       cast(count(*) filter (where not v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as bigint) as outliers
from (select {g}, cast({v} as double) as v, count({v}) over w as n, quantile_cont({v}, 0.25) over w as q1,
             quantile_cont({v}, 0.5) over w as median, quantile_cont({v}, 0.75) over w as q3
      from {src} where {v} is not null window w as (partition by {g})) group by {g}, n, q1, median, q3"""

_TOPCODED = "if(disease_count >= 8, '>=8', cast(disease_count as varchar))"

_POSTERIORS = ", ".join(f"((subject_id * 31 + hadm_id * 17 + {c * c * 37}) % 1009) / 1009.0 as p{c}" for c in range(1, 8))
# Keep the six most frequent classes, then take the most probable kept one; ties prefer frequency.
_REASSIGNED = f"""
  select r.icustay_id, arg_min(k.cls, k.place) as new_class from (
    select icustay_id, cls, p, max(p) over (partition by icustay_id) as top from (
      unpivot (select icustay_id, {_POSTERIORS} from prepared) on p1, p2, p3, p4, p5, p6, p7 into name cls value p)
    where cls in (select cls from kept)) r join kept k on k.cls = r.cls where r.p = r.top group by r.icustay_id"""
_KEPT = """kept as (select 'p' || c as cls, row_number() over (order by n desc, c) as place from (
    select subject_id % 7 + 1 as c, count(*) as n from prepared group by 1) order by n desc, c limit 6)"""
_NEW_CLASS = f"""moved as (select icustay_id, cast(substr(new_class, 2) as integer) as class_assignment from ({_REASSIGNED}))"""

_ROC = """
  select score as threshold, sum(sum(label)) over w as tp, sum(count(*) - sum(label)) over w as fp,
         sum(label) as pos, count(*) - sum(label) as neg
  from (select n_chars as score, quality as label from documents join labels using (doc_id))
  where score is not null and label is not null group by score window w as (order by score desc)"""


_MANIFEST = ["admission_type", "gender", "age_at_admission", *FLAGS]
_MANIFEST_LIST = ", ".join(f"'{v}'" for v in _MANIFEST)

# A parameter table by a plain rule over the levels of the prepared rows, three classes.
_PARAMS = f"""answers as materialized (
  unpivot (select icustay_id, {", ".join(f"cast({v} as varchar) as {v}" for v in _MANIFEST)} from prepared)
  on {", ".join(_MANIFEST)} into name variable value level
), levels as (
  select variable, level, row_number() over (partition by variable order by cast(level as integer)) as code, count(*) as n
  from answers group by variable, level
), params as materialized (
  select c, variable, level, c / 6.0 as share, w / sum(w) over (partition by c, variable) as prob
  from (select c, variable, level, 1 + (c * 7 + list_position([{_MANIFEST_LIST}], variable) * 3 + code * 5) % 11 as w
        from levels, (select unnest([1, 2, 3]) as c)))"""


def _expectation(name: str, params: str) -> str:
    """Class probabilities of every row under a parameter table, and its log density."""
    return f"""{name} as materialized (
  select icustay_id, c, exp(j - top) / sum(exp(j - top)) over (partition by icustay_id) as post,
         top + ln(sum(exp(j - top)) over (partition by icustay_id)) as density
  from (select *, max(j) over (partition by icustay_id) as top from (
    select icustay_id, c, ln(greatest(any_value(share), 1e-300)) + sum(ln(greatest(prob, 1e-300))) as j
    from answers join {params} using (variable, level) group by icustay_id, c)))"""


_STEP = """step as materialized (
  select c, variable, level, n / sum(n) over (partition by c, variable) as prob,
         sum(n) over (partition by c, variable) / sum(n) over (partition by variable) as share
  from (select c, variable, level, sum(post) as n from answers join first_look using (icustay_id) group by c, variable, level)
)"""
_EM = f"{_PARAMS}, {_expectation('first_look', 'params')}, {_STEP}"
_CHAIN = f"""{_EM}, {_expectation('second_look', 'step')}, modal as (
  select icustay_id, arg_max(c, (post, -c)) as c from second_look group by icustay_id
), frequent as (select c, row_number() over (order by count(*) desc, c) as place from modal group by c order by count(*) desc, c limit 2
), moved as (select icustay_id, cast(arg_max(c, (post, -place)) as integer) as class_assignment
  from second_look join frequent using (c) group by icustay_id)"""


# Models of two to four classes by the same rule: densities, parameters and criteria.
_CRITERIA = f"""wide as (
  select c, variable, level, w / sum(w) over (partition by c, variable) as prob
  from (select c, variable, level, 1 + (c * 7 + list_position([{_MANIFEST_LIST}], variable) * 3 + code * 5) % 11 as w
        from levels, (select unnest([1, 2, 3, 4]) as c))
), joint as materialized (
  select icustay_id, c, sum(ln(prob)) as j from answers join wide using (variable, level) group by icustay_id, c
), judged as (
  select k, count(*) as n, sum(density) as ll from (
    select k, icustay_id, any_value(top) + ln(sum(exp(s - top))) as density from (
      select *, max(s) over (partition by k, icustay_id) as top from (
        select k, icustay_id, j + ln(c / (k * (k + 1) / 2.0)) as s from joint, (select unnest([2, 3, 4]) as k) where c <= k))
    group by k, icustay_id) group by k
), criteria as (
  select *, -2 * ll + 2 * p as aic, -2 * ll + ln(n) * p as bic
  from judged, (select k as pk, k * (select sum(m - 1) from (select count(*) as m from levels group by variable)) + k - 1 as p from judged) where pk = k
)"""


def _subgroup_table() -> str:
    return f"""select f.*, s.class_assignment, count_morbidity,
              round(100.0 * count(*) over (partition by m.class_assignment, count_morbidity) / count(*) over (partition by m.class_assignment), 6) as percent
            from (select subject_id, hadm_id, icustay_id, deathtime, gender, age_at_admission, admission_type, los_icu_days, los_hospital_days, {_each('{f} - 1 as {f}')} from prepared) f
            join (select icustay_id, {_TOPCODED} as count_morbidity from counted) k on k.icustay_id = f.icustay_id
            join moved m on m.icustay_id = f.icustay_id
            join (select icustay_id, cast(dense_rank() over (order by class_assignment) as integer) as class_assignment from moved) s on s.icustay_id = f.icustay_id"""


def _nearest(k: int = 6) -> str:
    """The rows with their distances ``d`` to the fixed centres."""
    distance = [
        "(" + " + ".join([f"({f} - {((i + c) % 5) / 10}) ** 2" for i, f in enumerate(FLAGS)] + [f"(age_at_admission - {20 + 12 * c}) ** 2"]) + ")"
        for c in range(k)
    ]
    return f"(select *, [{', '.join(distance)}] as d from adults a join elixhauser e on e.hadm_id = a.hadm_id where age_at_admission <= 95)"


_FEATURE_MEANS = ", ".join(f"round(avg({f}), 6) as {f}" for f in [*FLAGS, "age_at_admission"])


def _kmeans_step() -> str:
    return f"""select cast(list_position(d, list_min(d)) - 1 as integer) as cluster, count(*) as n, round(sum(list_min(d)), 6) as inertia, {_FEATURE_MEANS}
      from {_nearest()} group by 1"""


def _fixed_roc() -> str:
    """Counts per class and whole-number score, accumulated from the highest score down."""
    design = "[1, " + ", ".join(_LOGIT) + "]"
    return f"""select c, e as threshold, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, lead(pos) over w as next_pos, lead(neg) over w as next_neg,
             row_number() over w as place, sum(pos) over (partition by c) as p, sum(neg) over (partition by c) as n
      from (select c, e, count(*) filter (where cls = c) as pos, count(*) filter (where cls <> c) as neg
            from (select c, cls, list_sum(list_transform(range(1, len(x) + 1), lambda j: x[j] * ((c * 5 + (j - 1) * 3) % 7 - 3))) as e
                  from (select subject_id % 7 + 1 as cls, {design} as x from (select *, age_at_admission // 10 as age from prepared)), (select unnest(range(1, 8)) as c))
            group by c, e)
      window w as (partition by c order by e desc)"""


_LOGIT = ["gender", "admission_type", "age", *FLAGS[:9]]


def _logit_gradient() -> str:
    names = "['intercept', " + ", ".join(f"'{f}'" for f in _LOGIT) + "]"
    return f"""select cast(c as integer) as class_assignment, fold, quantity, term_a, term_b, round(sum(total) over (partition by c, quantity, term_a, term_b) - total, 6) as value
      from (
        select c, fold, 'loss' as quantity, null::varchar as term_a, null::varchar as term_b, sum(greatest(e, 0) + ln(1 + exp(-abs(e))) - y * e) as total from fits group by c, fold
        union all
        select c, fold, 'gradient', a, null, sum((p - y) * x[i]) from fits, places group by c, fold, a
        union all
        select c, fold, 'curvature', a, b, sum(p * (1 - p) * x[i] * x[j]) from fits, pairs group by c, fold, a, b
      )"""


_LOGIT_FITS = """design as (
  select cast(subject_id % 7 + 1 as integer) as cls, cast(subject_id % 10 as integer) as fold, {x} as x from (select *, age_at_admission / 100.0 as age from prepared)
), etas as (
  select c, fold, x, if(cls = c, 1.0, 0.0) as y,
         list_sum(list_transform(range(1, len(x) + 1), lambda j: x[j] * ((c * 5 + (j - 1) * 3) % 7 - 3) / 20.0)) as e
  from design, (select unnest(range(1, 8)) as c)
), fits as materialized (select *, 1 / (1 + exp(-e)) as p from etas
), places as (select unnest({names}) as a, unnest(range(1, len({names}) + 1)) as i
), pairs as (select l.a, l.i, r.a as b, r.i as j from places l join places r on r.i >= l.i)"""


def _ordered_folds(folds: int = 10) -> str:
    return f"""select subject_id, hadm_id, icustay_id, cast(c as integer) as target, cast(count(*) filter (where upto <= rank) as integer) as fold
      from (select *, row_number() over (partition by c, enc order by subject_id, hadm_id, icustay_id) - 1 as rank from (
              select r.*, c, (cls = c) <> (first(cls) over (order by subject_id, hadm_id, icustay_id) = c) as enc
              from (select *, subject_id % 7 + 1 as cls from included) r, (select distinct subject_id % 7 + 1 as c from included)))
      join (select c as ac, enc as aenc, i, sum(n) over (partition by c, enc order by i) as upto from (
              select c, p >= head as enc, p % {folds} as i, count(*) as n
              from (select c, if(lead = c, own, whole - own) as head, unnest(range(cast(whole as bigint))) as p from (
                      select subject_id % 7 + 1 as c, count(*) as own, sum(count(*)) over () as whole,
                             (select subject_id % 7 + 1 from included order by subject_id, hadm_id, icustay_id limit 1) as lead
                      from included group by 1))
              group by all)) on ac = c and aenc = enc
      group by all"""


_FACTOR = "dense_rank() over (order by {v})"


def _binary() -> str:
    whole = ["subject_id", "hadm_id", "icustay_id", "deathtime", "age_at_admission", "los_icu_days", "los_hospital_days",
             *FLAGS, '"Subgroup"', "sofa", "oasis", "organ_dysfunction", "explicit_sepsis", "sepsis", "dod_missing"]
    tests = ", ".join(
        f"count(distinct {c}) + max(cast({c} is null as integer)) = 2 as {c}" for c in whole
    )
    return f"select column_name from (unpivot (select {tests} from outcomes) on columns(*) into name column_name value two) where two"


def oracle_queries() -> dict[str, str]:
    ages = "select i.subject_id, icustay_id, cast(date_part('year', age(intime, dob)) as integer) as age_at_admission from icustays i join patients p on p.subject_id = i.subject_id"
    table_one = f"{_IQR}, {_MULTI}, {_MEAN_BOUNDS}, {_DEAD}"
    by_group_means = _each("round(avg({f}), 6) as {f}")
    counts = f"(select *, {_TOPCODED} as count_morbidity, cast(subject_id % 7 + 1 as integer) as class_assignment from counted)"
    body = {
        "first_event": "select * from firsts",
        "cohort_unique": "select * from adults",
        "cohort_included": "select * from included",
        "morbidity_counts": "select * replace (round(los_icu_days, 6) as los_icu_days, round(los_hospital_days, 6) as los_hospital_days) from counted",
        "cohort_with_flags": "select * from flagged",
        "csv_roundtrip": "select * from flagged",
        "flags_with_age": f"select e.hadm_id, {_FLAG_LIST}, age_at_admission, gender from adults d join elixhauser e on e.hadm_id = d.hadm_id where age_at_admission <= 95",
        "flags_with_age_group": f"select e.hadm_id, {_FLAG_LIST}, {_BANDS.format(a='age_at_admission')} as age_group, gender from adults d join elixhauser e on e.hadm_id = d.hadm_id where age_at_admission <= 95",
        "sepsis_flags": "select * from sepsis",
        "calendar_age": ages,
        "duration_days": "select icustay_id, round(epoch(outtime - intime) / 86400.0, 6) as los_icu_days from icustays",
        "age_bucket": f"select icustay_id, age_at_admission, {_BANDS.format(a='age_at_admission')} as age_bucket, {_BANDS.format(a='age_at_admission')} as age_bin from ({ages})",
        "flag_count": f"select hadm_id, {_SUM_FLAGS} as disease_count from elixhauser",
        "morbidity_topcode": f"select subject_id, hadm_id, icustay_id, {_TOPCODED} as count_morbidity from counted",
        "recode": "select p.subject_id, hadm_id, if(gender = 'M', 0, 1) as gender_code, case admission_type when 'ELECTIVE' then 1 when 'URGENT' then 2 end as admission_code from patients p join admissions a on a.subject_id = p.subject_id",
        "relabel_sequential": "select subject_id, icustay_id, cast(dense_rank() over (order by subject_id % 5) as integer) as label from adults",
        "table_one_overall": _overall(),
        "table_one_gender": _table_one("gender", f"{_SHARE}, {table_one}"),
        "table_one_admission": _table_one("admission_type", f"{_SHARE}, {table_one}"),
        "table_one_age_bucket": _table_one("age_bucket", table_one),
        "table_one_disease_count": _table_one(
            "disease_category",
            f"{_SHARE}, {_MEAN_BOUNDS}, {_bounds('dead', 'percent_mortality', 'mortality_lower_95ci', 'mortality_upper_95ci')}",
        ),
        "table_one_all": _all_cuts(),
        "los_icu_by_age": _by_age("adults", "epoch(outtime - intime) / 86400.0", "los_score"),
        "los_hospital_by_age": _by_age("category", "epoch(dischtime - admittime) / 86400.0", "los_score"),
        "score_by_age": _by_age("(select d.*, s.sofa from adults d join sofa s on s.icustay_id = d.icustay_id and s.subject_id = d.subject_id)", "sofa", "sofa_score"),
        "multimorbidity_by_category": _category_rate(
            "count(*) filter (where k > 1)", "multimorbid_patients",
            f"(select admission_category, {_SUM_FLAGS} as k from category c join elixhauser e on e.hadm_id = c.hadm_id)",
            "percent_multimorbidity", 1.0,
        ),
        "mortality_by_category": _category_rate("count(deathtime)", "deaths", "category", "percent_mortality", 100.0),
        "severity_by_category": f"""select c.admission_category, {_mean_pair('sofa', 'sofa')}, {_mean_pair('los_icu', 'los_icu')}, {_mean_pair('los_hospital', 'los_hospital')}
            from category c join sofa s on s.subject_id = c.subject_id and s.icustay_id = c.icustay_id
            join (select subject_id, hadm_id, epoch(outtime - intime) / 86400.0 as los_icu, epoch(dischtime - admittime) / 86400.0 as los_hospital from category) t
              on t.subject_id = c.subject_id and t.hadm_id = c.hadm_id group by 1""",
        "morbidity_distribution": f"select cast({_SUM_FLAGS} as bigint) as morbidity_count, count(*) as n from flagged group by 1",
        "class_distribution": "select cast(subject_id % 7 + 1 as integer) as class_assignment, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from included group by 1",
        "group_profile": f"select {_BANDS.format(a='age_at_admission')} as age_group, gender, {by_group_means} from flagged group by 1, 2",
        "prevalence_overall": "select condition, round(avg(v), 6) as prevalence from marks group by 1",
        "prevalence_by_group": f"select class_assignment, {_each('round(100 * avg({f}), 6) as {f}')} from classed group by 1",
        "prevalence_capped": "select class_assignment, condition, round(least(avg(v), 0.14), 6) as prevalence from marks group by 1, 2",
        "prevalence_by_age_group": f"select age_group, condition, round(avg(v), 6) as prevalence from (unpivot (select {_BANDS.format(a='age_at_admission')} as age_group, {_FLAG_LIST} from flagged) on {_FLAG_LIST} into name condition value v) group by 1, 2",
        "percent_within_group": "select subject_id, hadm_id, icustay_id, gender, label as disease_category, round(100.0 * count(*) over (partition by gender, label) / count(*) over (partition by gender), 6) as percent from (select *, case when disease_count = 1 then '1 disease' when disease_count > 7 then '>7 diseases' else disease_count || ' diseases' end as label from counted)",
        "binary_columns": _binary(),
        "top_conditions_by_group": f"select class_assignment, condition, round(p, 6) as prevalence, cast(place as integer) as rank from (select *, row_number() over (partition by class_assignment order by p desc, {_POSITION}) as place from (select class_assignment, condition, avg(v) as p from marks group by 1, 2)) where place <= 6",
        "boxplot_summary": _BOX.format(g="admission_type", v="los_hospital_days", src="lengths"),
        "boxplot_scores": _BOX.format(g='"Subgroup"', v="sofa", src="outcomes"),
        "bubble_points": f"select class_assignment, count_morbidity, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by class_assignment), 6) as percent from {counts} group by 1, 2",
        "cooccurrence": f"select * from {_ALL_PAIRS}",
        "cooccurrence_by_class": f"""select g.class_assignment, x.a, y.b, coalesce(p.n, 0) as n from (select distinct class_assignment from classed) g
            cross join {_GRID.format(c='a')} x cross join {_GRID.format(c='b')} y left join ({_PAIRS.format(key='l.class_assignment as cls,')}) p
            on p.cls = g.class_assignment and p.a = x.a and p.b = y.b""",
        "network_edges": f"select a as \"from\", b as \"to\", n as weight, round(n / max(n) over (), 6) as weight_pct from {_ALL_PAIRS} where a <> b and n > 0",
        "network_nodes": f"select name, total_cooccurrences, round(pct, 6) as total_pct, round(least(pct, 60), 6) as node_size from (select a as name, cast(sum(n) as bigint) as total_cooccurrences, 100.0 * sum(n) / sum(sum(n)) over () as pct from {_ALL_PAIRS} group by 1)",
        "lca_prepare": "select * from prepared",
        "reassign_classes": f"select subject_id, hadm_id, r.icustay_id, class_assignment from prepared r join moved m on m.icustay_id = r.icustay_id",
        "subgroup_table": _subgroup_table(),
        "model_subgroups": _subgroup_table(),
        "model_outcomes": f"""select r.label as "Subgroup", {", ".join(f"round(100 * avg({c}), 6) as {c}" for c in ("organ_dysfunction", "explicit_sepsis", "sepsis"))},
              round(100 * avg(cast(dod_missing as integer)), 6) as dod_missing, {_each("round(100 * avg(o.{f}), 6) as {f}")}
            from outcomes o join (select icustay_id, cast(dense_rank() over (order by class_assignment) as integer) as label from moved) r on r.icustay_id = o.icustay_id group by 1""",
        "export_tables": " union all ".join(
            f"select '{t}' as table_name, count(*) as n, cast(sum(subject_id) as bigint) as subject_sum, {' + '.join(f'count({c})' for c in columns)} as filled from {t}"
            for t, columns in {"sofa": ("icustay_id", "hadm_id", "subject_id", "sofa"), "angus": ("hadm_id", "subject_id", "organ_dysfunction", "explicit_sepsis"),
                               "oasis": ("hadm_id", "subject_id", "oasis"), "patients": ("subject_id", "gender", "dob", "dod")}.items()
        ),
        "named_view": "select admission_type, count(*) as n, round(avg(age_at_admission), 6) as mean_age, count(deathtime) as deaths from included group by 1",
        "head": "select * from flagged order by subject_id, hadm_id, icustay_id limit 5",
        "class_targets": f"select subject_id, hadm_id, icustay_id, if(gender = 'M', 1.0, 0.0)::double as male, {', '.join(f'cast(subject_id % 7 + 1 = {c} as integer) as target_{c}' for c in range(1, 8))} from included",
        "answer_patterns": "select admission_type, gender, obesity, hypertension, depression, count(*) as n from prepared where subject_id % 3 > 0 group by all",
        "lca_em_step": """select cast(c as integer) as "class", round(share, 6) as share, variable, level, round(prob, 6) as prob,
              (select round(sum(density), 6) from first_look where c = 1) as log_likelihood from step""",
        "lca_posterior_fixed": """select subject_id, hadm_id, icustay_id, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, cast(k as integer) as class_assignment
            from prepared join (select icustay_id, max(post) filter (where c = 1) as p1, max(post) filter (where c = 2) as p2,
              max(post) filter (where c = 3) as p3, arg_max(c, (post, -c)) as k from first_look group by icustay_id) using (icustay_id)""",
        "lca_criteria_fixed": """select cast(k as integer) as n_classes, cast(p as integer) as n_parameters, n as n_rows, round(ll, 6) as log_likelihood, round(aic, 6) as aic,
              round(bic, 6) as bic, round(aic + bic, 6) as aic_plus_bic, aic = min(aic) over () as best_aic, bic = min(bic) over () as best_bic,
              aic + bic = min(aic + bic) over () as best_combined from criteria""",
        "kmeans_step": _kmeans_step(),
        "cluster_profile_fixed": f"select {_BANDS.format(a='age_at_admission')} as age_group, cast(list_position(d, list_min(d)) - 1 as integer) as cluster, {_FEATURE_MEANS} from {_nearest()} group by 1, 2",
        "class_auc_fixed": f"""select cast(c as integer) as class_assignment, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives,
              round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) as auc from ({_fixed_roc()}) group by 1""",
        "class_roc_fixed": f"""select cast(c as integer) as class_assignment, cast(threshold as double) as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr
            from ({_fixed_roc()}) where place = 1 or next_pos is null or next_pos <> pos or next_neg <> neg""",
        "logit_gradient": _logit_gradient(),
        "ordered_folds": _ordered_folds(),
        "csv_indexed": "select row_number() over (order by subject_id, hadm_id, icustay_id) - 1 as row_index, * from flagged",
        "posterior_aligned": f"select subject_id, hadm_id, r.icustay_id, {', '.join(f'round(p{c}, 6) as p{c}' for c in range(1, 8))}, class_assignment from (select *, {_POSTERIORS} from prepared) r join moved m on m.icustay_id = r.icustay_id",
        "factor_levels": """select variable, level, cast(row_number() over (partition by variable order by try_cast(level as integer), level) as integer) as code, count(*) as n
            from (unpivot (select icustay_id, admission_type, gender, cast(age_at_admission as varchar) as age_at_admission from included)
                  on admission_type, gender, age_at_admission into name variable value level) group by variable, level""",
        "factor_conversion": f"select subject_id, hadm_id, icustay_id, {', '.join(f'cast({_FACTOR.format(v=v)} as integer) as {v}' for v in ('admission_type', 'gender', 'age_at_admission'))} from included",
        "prevalence_overall_capped": "select condition, round(least(avg(v), 0.5), 6) as prevalence from marks group by 1",
        "boxplot_oasis": _BOX.format(g='"Subgroup"', v="oasis", src="outcomes"),
        "boxplot_age": _BOX.format(g="class_assignment", v="age_at_admission", src="(select *, cast(subject_id % 7 + 1 as integer) as class_assignment from included)"),
        "boxplot_outliers": """select subject_id, hadm_id, icustay_id, gender, disease_count,
              round(if(disease_count < q1 - 1.5 * (q3 - q1), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), 6) as fence
            from (select *, quantile_cont(disease_count, 0.25) over (partition by gender) as q1,
                         quantile_cont(disease_count, 0.75) over (partition by gender) as q3 from counted)
            where disease_count < q1 - 1.5 * (q3 - q1) or disease_count > q3 + 1.5 * (q3 - q1)""",
        "network_edges_by_class": f"""select cls as class_assignment, a as "from", b as "to", n as weight, round(n / max(n) over (partition by cls), 6) as weight_pct
            from ({_PAIRS.format(key='l.class_assignment as cls,')}) where a <> b""",
        "network_nodes_by_class": f"""select class_assignment, name, total_cooccurrences, round(pct, 6) as total_pct, round(least(pct, 60), 6) as node_size
            from (select g.class_assignment, x.a as name, cast(coalesce(sum(p.n), 0) as bigint) as total_cooccurrences,
                         100.0 * coalesce(sum(p.n), 0) / nullif(sum(coalesce(sum(p.n), 0)) over (partition by g.class_assignment), 0) as pct
                  from (select distinct class_assignment from classed) g cross join {_GRID.format(c='a')} x
                  left join ({_PAIRS.format(key='l.class_assignment as cls,')}) p on p.cls = g.class_assignment and p.a = x.a group by 1, 2)""",
        "outcome_merge_deduped": """select c.* exclude (class_assignment), class_assignment as "Subgroup", s.sofa, o.oasis, g.organ_dysfunction,
              g.explicit_sepsis, z.sepsis, p.dod is null as dod_missing
            from classed c
            join (select subject_id, hadm_id, max(sofa) as sofa from sofa group by all) s on s.subject_id = c.subject_id and s.hadm_id = c.hadm_id
            join (select subject_id, hadm_id, max(oasis) as oasis from oasis group by all) o on o.subject_id = c.subject_id and o.hadm_id = c.hadm_id
            join angus g on g.subject_id = c.subject_id and g.hadm_id = c.hadm_id
            join sepsis z on z.subject_id = c.subject_id and z.hadm_id = c.hadm_id
            join patients p on p.subject_id = c.subject_id""",
        "roc_points_pruned": f"""select threshold, round(fp / neg_all, 6) as fpr, round(tp / pos_all, 6) as tpr from (
              select *, max(fp) over () as neg_all, max(tp) over () as pos_all,
                     lead(pos) over w as next_pos, lead(neg) over w as next_neg, row_number() over w as place
              from ({_ROC}) window w as (order by threshold desc))
            where place = 1 or next_pos is null or next_pos <> pos or next_neg <> neg""",
        "outcome_merge": "select * from outcomes",
        "outcome_prevalence": "select \"Subgroup\", round(100 * avg(organ_dysfunction), 6) as organ_dysfunction, round(100 * avg(sepsis), 6) as sepsis from outcomes group by 1",
        "stratified_folds": "select class_assignment, cast(floor((r - 1) * 10 / n) as integer) as fold, count(*) as n from (select subject_id % 7 + 1 as c, cast(subject_id % 7 + 1 as integer) as class_assignment, row_number() over (partition by subject_id % 7) as r, count(*) over (partition by subject_id % 7) as n from included) group by 1, 2",
        "auc_score": f"select cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives, round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) as auc from ({_ROC})",
        "roc_points": f"select threshold, round(fp / max(fp) over (), 6) as fpr, round(tp / max(tp) over (), 6) as tpr from ({_ROC})",
    }
    chosen = f", {_KEPT}, {_NEW_CLASS}"
    design = "[1.0, " + ", ".join(f"cast({f} as double)" for f in _LOGIT) + "]"
    names = "['intercept', " + ", ".join(f"'{f}'" for f in _LOGIT) + "]"
    extra = {
        "reassign_classes": chosen,
        "subgroup_table": chosen,
        "posterior_aligned": chosen,
        "lca_em_step": f", {_EM}",
        "lca_criteria_fixed": f", {_PARAMS}, {_CRITERIA}",
        "lca_posterior_fixed": f", {_PARAMS}, {_expectation('first_look', 'params')}",
        "model_subgroups": f", {_CHAIN}",
        "model_outcomes": f", {_CHAIN}",
        "logit_gradient": ", " + _LOGIT_FITS.format(x=design, names=names),
    }
    return {key: f"{_ROLES}{extra.get(key, '')}\n{sql}" for key, sql in body.items()}
