"""Queries of the general problems (1 and 4) and the SQL they are checked with."""

from __future__ import annotations

from lodestone.operators.history import combined_history, found_versions
from lodestone.operators.intervals import found_periods
from lodestone.sources.tables import read_table

ATTRIBUTES = ("works_for", "belongs_to", "prefers")

_NAME = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"

_VERSIONS = rf"""
e as (select distinct {_NAME.format('subject')} s, {_NAME.format('predicate')} p, {_NAME.format('object')} o,
        {_NAME.format('action')} a, epoch_us(coalesce(observed_at, created_at)) t, seq from fact_ops),
u as (select * from e where s <> '' and o <> '' and t is not null and a in ('assert', 'retract')
        and p in ('works_for', 'belongs_to', 'prefers')),
w as (select *, sum((a = 'assert')::int) over k seg, last_value(case when a = 'assert' then o end ignore nulls) over k v
        from u window k as (partition by s, p order by t, seq rows unbounded preceding)),
g as (select s, p, seg, v o, min(case when a = 'assert' then t end) t0, min(case when a = 'retract' and o = v then t end) r
        from w where seg > 0 group by s, p, seg, v),
n as (select *, coalesce(r, lead(t0) over (partition by s, p order by seg)) t1 from g),
m as (select *, case when lag(o) over k = o and lag(t1) over k = t0 then 0 else 1 end nw
        from n where t1 is null or t1 > t0 window k as (partition by s, p order by seg)),
i as (select *, sum(nw) over (partition by s, p order by seg) isl from m),
v as (select s, p, o, min(t0) t0, case when count(*) = count(t1) then max(t1) end t1 from i group by s, p, o, isl)
"""

P1_SQL = f"""with {_VERSIONS}
select s as subject, p as predicate, o as object, (t0 // 1000000)::bigint as from_s, coalesce(t1 // 1000000, 0)::bigint as to_s from v"""

P1C_SQL = f"""with {_VERSIONS},
b as (select s, t0 t from v union select s, t1 from v where t1 is not null),
x as (select s, t, lead(t) over (partition by s order by t) u from b),
c as (select x.s, x.t, x.u, max(case when p = 'works_for' then o end) works_for, max(case when p = 'belongs_to' then o end) belongs_to,
        max(case when p = 'prefers' then o end) prefers
        from x join v on v.s = x.s and v.t0 <= x.t and (v.t1 is null or v.t1 > x.t) group by x.s, x.t, x.u)
select s as subject, works_for, belongs_to, prefers, (t // 1000000)::bigint as from_s, coalesce(u // 1000000, 0)::bigint as to_s from c"""

P4_SQL = rf"""with r as (select {_NAME.format('subject')} s, {_NAME.format('predicate')} p, epoch_us(valid_from) f,
        coalesce(epoch_us(valid_to), 4611686018427387904) t from triples where valid_from is not null and (valid_to is null or valid_to > valid_from)),
m as (select *, max(t) over (partition by s, p order by f, t rows between unbounded preceding and 1 preceding) before from r where s <> '' and p <> ''),
i as (select *, sum(case when before is null or f > before then 1 else 0 end) over (partition by s, p order by f, t rows unbounded preceding) g from m),
d as (select s, p, g, min(f) f, max(t) t from i group by s, p, g),
a as (select s, p, 'period' kind, f, t from d union all
      select s, p, 'gap', lag(t) over (partition by s, p order by g), f from d)
select s as subject, p as predicate, kind, (f // 1000000)::bigint as from_s,
  case when t = 4611686018427387904 then 0 else (t // 1000000) end::bigint as to_s from a where f is not null"""


def p1_found(spark, sf_dir):
    """Versions of the three single-valued attributes (problem 1)."""
    return found_versions(read_table(spark, sf_dir, "fact_ops"), ATTRIBUTES)


def p1_combined(spark, sf_dir):
    """Periods in which all attributes of a subject stood still (problem 1)."""
    return combined_history(read_table(spark, sf_dir, "fact_ops"), ATTRIBUTES)


def p4_found(spark, sf_dir):
    """Continuous periods and gaps per subject and predicate (problem 4)."""
    return found_periods(read_table(spark, sf_dir, "triples"))


QUERIES = {"p1_found": p1_found, "p1_combined": p1_combined, "p4_found": p4_found}
SQL = {"p1_found": P1_SQL, "p1_combined": P1C_SQL, "p4_found": P4_SQL}
