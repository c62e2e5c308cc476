"""The derived tables once more, as SQL for the reference database.

Every named query is a list of common table expressions; `compose` puts the needed ones in
front of a final SELECT.
"""

from __future__ import annotations

import math
import re

from methmix import bridge, labels


def _strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(column: str, table: dict[str, str], default: str = "null") -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"case {column} {whens} else {default} end"


def _number_map(column: str, table: dict[str, float]) -> str:
    whens = " ".join(f"when '{k}' then {v!r}::double" for k, v in table.items())
    return f"case {column} {whens} end"


def _windows(text: str, k: int, letter: str) -> str:
    return (f"len(list_filter(range(1, length({text}) - {k} + 2), "
            f"lambda i: substr({text}, i, {k}) = '{letter * k}'))::bigint")


def _kmers() -> str:
    out = []
    for k in labels.KMERS:
        out += [f"{_windows('t', k, 'C')} as meth_k{k}", f"{_windows('t', k, 'T')} as unmeth_k{k}",
                f"{_windows(chr(39).join(['translate(t, ', 'T', ', ', 'C', ')']), k, 'C')} as total_k{k}"]
    return ", ".join(out)


SUM_COLUMNS = [f"{kind}_k{k}" for k in labels.KMERS for kind in ("meth", "unmeth", "total")]
FLAGS = ["frac_alpha_leq_25pct", "frac_alpha_geq_75pct"]
ROW_WORDS = ("('0x' || substr(md5(molecule_id || '|' || region_id), 1, 7))::bigint as row_x, "
             "('0x' || substr(md5(molecule_id || '|' || region_id), 8, 7))::bigint as row_y")
SEED_SQL = ("('0x' || substr(md5('888|' || titrated || '-' || proportion_id || '-' || replicate), 1, 8))::bigint % 1000001")


def mixture_words(mixtures: str) -> str:
    """The coefficients of every mixture and cell type, from its own seed and key."""
    return f"""
        select *, ('0x' || substr(h, 1, 7))::bigint + 1 as mix_a, ('0x' || substr(h, 8, 7))::bigint + 1 as mix_b,
               ('0x' || substr(h, 15, 7))::bigint as mix_c
        from (select *, md5({SEED_SQL} || '|' || titrated || '|' || proportion_id || '|' || replicate || '|' || pool) as h
              from {mixtures}) q where fraction > 0"""


SPARSE = 0.00390625  # larger fractions compare every row, the others place points


def _poisson_limit(n: int) -> str:
    """Steps of a draw below which a row places `n` points or more in a cell."""
    masses = "+".join(f"pow(rate, {k}) / {math.factorial(k)}" for k in range(n))
    return f"(1 - exp(-rate) * ({masses})) * 2147483647"


def sparse_tables(mixtures: str) -> dict[str, str]:
    """The rows that points draw into the sparse ones of `mixtures`: table `<mixtures>_hits`."""
    m, word = mixtures, "('0x' || substr({}, {}, 7))::bigint"
    limits = [_poisson_limit(n) for n in range(1, 12)]
    at = "(place_start + i * place_step) % 2147483647"
    return {
        f"{m}_line": f"""
            select * from (select titrated, proportion_id, replicate, pool, ({SEED_SQL}) as seed, round(-ln(1 - least(fraction, 0.5)) * 35184372088832)::bigint as len
            from {m} where fraction > 0 and fraction <= {SPARSE}) q where len > 0""",
        f"{m}_celled": f"""
            select *, ((sum(len) over (partition by titrated, pool order by replicate, proportion_id) - len) // 17592186044416)::bigint as cell
            from {m}_line""",
        f"{m}_intervals": f"""
            select titrated, proportion_id, replicate, pool, cell, floor((upto - len)::double / total::double * 2147483647) as lo,
                   floor(upto::double / total::double * 2147483647) as hi
            from (select *, sum(len) over (partition by titrated, pool, cell order by replicate, proportion_id) as upto,
                         sum(len) over (partition by titrated, pool, cell) as total from {m}_celled) q""",
        f"{m}_cells": f"""
            select titrated, pool, cell, rate, {word.format('h', 1)} + 1 as a, {word.format('h', 8)} + 1 as b, {word.format('h', 15)} as c,
                   {word.format('g', 1)} + 1 as at_a, {word.format('g', 8)} + 1 as at_b, {word.format('g', 15)} as at_c,
                   {word.format('g', 22)} + 1 as step_a, {word.format('h', 22)} + 1 as step_b
            from (select *, md5(key) as h, md5(key || '|points') as g from (
                  select titrated, pool, cell, sum(len)::double / 35184372088832 as rate,
                         string_agg(seed::varchar, ',' order by replicate, proportion_id) || '|' || titrated || '|' || pool || '|' || cell as key
                  from {m}_celled group by titrated, pool, cell) q) r""",
        f"{m}_points": f"""
            select p.*, c.titrated, c.cell, (at_a * row_x + at_b * row_y + at_c) % 2147483647 as place_start,
                   (step_a * row_x + step_b * row_y + 1) % 2147483647 as place_step,
                   unnest(range(1, 1 + len([t for t in [{', '.join(limits)}] if (a * row_x + b * row_y + c) % 2147483647 < t]))) as i
            from pools p join {m}_cells c using (pool)
            where (a * row_x + b * row_y + c) % 2147483647 < {limits[0]}""",
        f"{m}_hits": f"""
            select distinct x.* exclude (cell, place_start, place_step, i), v.proportion_id, v.replicate
            from {m}_points x join {m}_intervals v using (titrated, pool, cell) where {at} >= lo and {at} < hi""",
    }


def sums(weight: str) -> str:
    parts = ["sum(number_molecules)::bigint as number_molecules"]
    parts += [f"sum({c} * {weight})::bigint as {c}" for c in SUM_COLUMNS]
    parts += [f"sum({c} * {weight})::double / sum(number_molecules) as {c}" for c in FLAGS]
    return ", ".join(parts)


def rounded_scores() -> str:
    return ", ".join(["number_molecules"] + SUM_COLUMNS + [f"round({c}, 6) as {c}" for c in FLAGS])


LEVELS = ", ".join(f"({i}, {p!r}::double)" for i, p in enumerate(labels.TITRATION_LEVELS))
POOL_TO_REF = dict(zip(bridge.GROUPS, bridge.CELL_TYPES))


def reads_sql(sample: str = "l_suppkey % 10", group: str = "l_suppkey % 5", target: str = "(locus // 5) % 5") -> str:
    return f"""
        select 's' || sid as sample_id, molecule_id, 'chr' || (1 + locus // 50) as chr, number_molecules,
               cmin as cpg_index_min, cmin + len - 1 as cpg_index_max,
               substr(case when grp = {target}
                      then translate(h, '0123456789abcdef', 'TTTTTTTTTTTTCCC.')
                      else translate(h, '0123456789abcdef', 'CCCCCCCCCCCCTTT.') end, 1, len) as pat_string
        from (select {sample} as sid, {group} as grp, l_partkey % 200 as locus,
                     l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as molecule_id,
                     case when l_quantity >= 45 then 2 else 1 end as number_molecules,
                     (l_partkey % 200) * 5 + l_linenumber as cmin,
                     4 + floor(l_quantity)::int % 9 as len,
                     md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber) as h
              from lineitem) t"""


def atlas_sql(types: list[str]) -> str:
    """The rows of `cells` that have a score for every cell type, one column a type."""
    return "select region_id, " + ", ".join(
        f"max(case when ref_celltype = '{c}' then score end) as a{i}" for i, c in enumerate(types)
    ) + f" from cells group by region_id having count(*) = {len(types)}"


def equations_sql(k: int) -> str:
    """The normal equations of every mixture for an atlas of `k` cell types."""
    return "select titrated, proportion_id, replicate, count(*) as n_regions, " + ", ".join(
        [f"sum(a{i} * a{j}) as g{i}{j}" for i in range(k) for j in range(k)]
        + [f"sum(a{i} * b) as h{i}" for i in range(k)]) + " from aligned group by all"


def truth_sql(pool_to_ref: dict[str, str]) -> str:
    return f"""
        select titrated, proportion_id, titration, {_map('pool', pool_to_ref)} as ref_celltype,
               proportion as true_proportion, (pool = titrated)::int as is_titrated from design"""


TABLES: dict[str, str] = {
    "reads": reads_sql(),
    "regions_bed": """
        select 'chr' || (1 + r // 10) as region_chr, r * 250 + 140 as region_start, r * 250 + 240 as region_end,
               r * 25 + 14 as region_cpg_index_min, r * 25 + 24 as region_cpg_index_max, 'r' || r as region_id
        from (select distinct (p_partkey % 200) // 5 as r from part) q""",
    "regions": """
        select region_chr, region_start, region_end, region_cpg_index_min,
               region_cpg_index_max - 1 as region_cpg_index_max, region_id from regions_bed""",
    "panel": f"""
        select 'r' || r as region_id, case when r < 20 then 'immune_broad' else 'immune_refined' end as subpanel,
               {_strings(bridge.TARGETS)}[r % 5 + 1] as target_celltype,
               case when r % 13 = 12 then 0 else 1 end as v23_conv
        from (select (p_partkey % 200) // 5 as r from part) q""",
    "samples": f"""
        select 's' || s_suppkey as sample_id,
               case when s_suppkey < 10 then 'blueprint_loyfer2022' else 'other' end as source,
               case when s_suppkey % 5 <> 3 then {_strings(bridge.GROUPS)}[s_suppkey % 5 + 1]
                    when s_suppkey % 10 = 3 then 'Blueprint-CD4' else 'Blueprint-CD8' end as sample_group,
               case when s_suppkey % 5 <> 3 then null when s_suppkey % 10 = 3 then 'regulatory T cell'
                    else 'CD4-positive, alpha-beta T cell' end as cell_type,
               case when s_acctbal < 0 then null else (floor(s_acctbal / 2500)::bigint * 20)::varchar
                    || ' - ' || (floor(s_acctbal / 2500)::bigint * 20 + 20)::varchar end as age
        from supplier""",
    "donors": f"""
        select 's' || s_suppkey as sample_id,
               case when s_nationkey % 2 = 0 then 'Female' else 'Male' end as donor_sex,
               {_strings(bridge.GROUPS)}[s_suppkey % 5 + 1] as donor_type
        from supplier where s_suppkey % 7 <> 4""",
    "cpg_map": """
        select i as cpg_index, case when i % 19 = 0 then null else i + i // 40 end as cpg_index_hg38
        from (select distinct unnest(range(cpg_index_min, cpg_index_max + 1)) as i from reads) q""",
    "region_reads": """
        select r.*, g.region_id, g.region_cpg_index_min, g.region_cpg_index_max
        from reads r join regions g
          on r.cpg_index_min <= g.region_cpg_index_max and r.cpg_index_max >= g.region_cpg_index_min""",
    "trimmed": """
        select *, substr(pat_string, greatest(region_cpg_index_min - cpg_index_min, 0) + 1,
                 least(region_cpg_index_max - cpg_index_min, cpg_index_max - cpg_index_min)
                 - greatest(region_cpg_index_min - cpg_index_min, 0) + 1) as t
        from region_reads""",
    "counted": f"select *, {_kmers()} from trimmed",
    "scored": """
        select *, case when meth_k1::double / total_k1 <= 0.25 then 1 else 0 end as frac_alpha_leq_25pct,
                  case when meth_k1::double / total_k1 >= 0.75 then 1 else 0 end as frac_alpha_geq_75pct
        from counted where total_k1 >= 3""",
    "scores": f"select sample_id, region_id, {sums('number_molecules')} from scored group by all",
    "sample_map": f"""
        select distinct sample_id, ref_celltype from (
            select sample_id, {_map('sample_group', labels.SAMPLE_LABELS_T_COMBINED)} as ref_celltype
            from samples where source = 'blueprint_loyfer2022') q where ref_celltype is not null""",
    "region_map": f"""
        select distinct region_id, ref_celltype from (
            select region_id, {_map('target_celltype', labels.REGION_LABELS_T_COMBINED)} as ref_celltype
            from panel where v23_conv = 1) q where ref_celltype is not null""",
    "cells": """
        select s.region_id, m.ref_celltype, avg(s.frac_alpha_leq_25pct) as score
        from scores s join sample_map m using (sample_id)
        where s.number_molecules >= 10 and s.region_id in (select region_id from region_map)
        group by all""",
    "atlas": atlas_sql(bridge.CELL_TYPES),
    "atlas_cells": "select c.* from cells c where c.region_id in (select region_id from atlas)",
    "pool_map": f"""
        select distinct sample_id, {_map('sample_group', labels.T_COMBINED_GROUPS, 'sample_group')} as pool
        from samples where source = 'blueprint_loyfer2022'""",
    "pools": f"select s.*, m.pool, {ROW_WORDS} from scored s join pool_map m using (sample_id)",
    "pool_counts": "select pool, count(*) as pool_rows from pools group by pool",
    "total": "select floor(sum(pool_rows) * 0.25)::bigint as total_reads from pool_counts",
    "levels": f"select * from (values {LEVELS}) v(proportion_id, titration)",
    "targets": "select pool as titrated from pool_counts",
    "abundance": f"select pool, pool_rows, {_number_map('pool', labels.WHOLE_BLOOD_ABUNDANCE)} as abundance from pool_counts",
    "design": """
        select t.titrated, l.proportion_id, l.titration, a.pool,
               case when a.pool = t.titrated then l.titration
                    else a.abundance / (select sum(b.abundance) from abundance b where b.pool <> t.titrated)
                         * (1 - l.titration) end as proportion
        from abundance a cross join targets t cross join levels l""",
    "mixtures": """
        select d.titrated, d.proportion_id, rep.replicate, d.pool,
               d.proportion * total.total_reads / c.pool_rows as fraction
        from design d join pool_counts c using (pool) cross join total
             cross join (select unnest(range(0, 20)) as replicate) rep""",
    "mixture_words": mixture_words("mixtures"),
    **sparse_tables("mixtures"),
    "drawn": f"""
        select m.titrated, m.proportion_id, m.replicate, p.*
        from pools p join mixture_words m using (pool)
        where m.fraction > {SPARSE} and (m.mix_a * p.row_x + m.mix_b * p.row_y + m.mix_c) % 2147483647 < m.fraction * 2147483647
        union all by name select * from mixtures_hits""",
    "mix_scores": f"""
        select titrated, proportion_id, replicate, region_id, {sums('number_molecules')} from drawn group by all""",
    "truth": truth_sql(POOL_TO_REF),
    "naive": """
        select s.titrated, s.proportion_id, s.replicate, m.ref_celltype, avg(s.frac_alpha_leq_25pct) as coeff
        from mix_scores s join region_map m using (region_id)
        where s.number_molecules >= 20 group by all""",
    "aligned": "select s.titrated, s.proportion_id, s.replicate, s.frac_alpha_leq_25pct as b, a.* "
               "from mix_scores s join atlas a using (region_id)",
    "equations": equations_sql(5),
}


def _descent(source: str, lower: str, sweeps: int, k: int = 5) -> str:
    """Coordinate descent on the normal equations of `source`, one row per mixture and sweep."""
    columns = ", ".join(f"x{i}" for i in range(k))
    inner = f"x.titrated, x.proportion_id, x.replicate, x.it, e.* exclude (titrated, proportion_id, replicate), {columns}"
    query = f"select {inner} from sweeps x join {source} e using (titrated, proportion_id, replicate) where x.it < {sweeps}"
    for i in range(k):
        others = " - ".join([f"h{i}"] + [f"g{i}{j} * x{j}" for j in range(k) if j != i])
        value = f"({others}) / g{i}{i}"
        value = f"greatest({lower}, {value})" if lower else value
        query = f"select * exclude (x{i}), {value} as x{i} from ({query}) q{i}"
    zeros = ", ".join(f"0.0::double as x{i}" for i in range(k))
    return (f"select titrated, proportion_id, replicate, 0 as it, {zeros} from {source} "
            f"union all select titrated, proportion_id, replicate, it + 1, {columns} from ({query}) q")


def unpivoted(source: str, iteration: int, alias: str, types: list[str] = bridge.CELL_TYPES) -> str:
    pieces = [f"select titrated, proportion_id, replicate, '{c}' as ref_celltype, x{i} as coeff "
              f"from {source} where it = {iteration}" for i, c in enumerate(types)]
    return " union all ".join(pieces)


TABLES["sweeps"] = _descent("equations", "0.0", 200)
TABLES["nnls"] = unpivoted("sweeps", 200, "nnls")
OLS_SWEEPS = _descent("equations", "", 200)


def _subset_tables() -> dict[str, str]:
    """The tables that differ once the T samples are sorted into subsets and titrated inside the T group; the others follow."""
    split = "case when {0} = 3 then 10 + {1} % 3 else {0} end"
    details, blood = bridge.SUBSET_DETAILS, labels.WHOLE_BLOOD_ABUNDANCE
    shares = {"t_effector": labels.T_REG_SHARES_UNDER_EFFECTOR, "t_reg": labels.T_EFFECTOR_SHARES_UNDER_REG}
    inside = ", ".join(f"('{t}', '{m}', {w!r}::double)" for t, table in shares.items() for m, w in table.items())
    types = bridge.SUBSET_TYPES
    return {
        "reads": reads_sql("(l_suppkey % 10) || case when l_suppkey % 5 = 3 then '-' || (l_orderkey % 3) else '' end",
                           split.format("l_suppkey % 5", "l_orderkey"), split.format("(locus // 5) % 5", "(locus // 25)")),
        "panel": TABLES["panel"].replace(f"{_strings(bridge.TARGETS)}[r % 5 + 1]",
                                         f"case when r % 5 = 3 then {_strings(bridge.SUBSET_TARGETS)}[(r // 5) % 3 + 1] "
                                         f"else {_strings(bridge.TARGETS)}[r % 5 + 1] end"),
        "sorted_samples": f"""
            select 's' || s_suppkey || coalesce('-' || n, '') as sample_id,
                   case when n is null then {_strings(bridge.GROUPS)}[s_suppkey % 5 + 1]
                        else {_map(f"{_strings(details)}[n + 1]", labels.T_SUBSET_CELL_TYPES)} end as pool
            from (select s_suppkey, unnest(case when s_suppkey % 5 = 3 then [0, 1, 2] else [null] end) as n
                  from supplier where s_suppkey < 10) q""",
        "pool_map": "select sample_id, pool from sorted_samples",
        "sample_map": f"select sample_id, {_map('pool', labels.SAMPLE_LABELS_T_SUBSET)} as ref_celltype from sorted_samples",
        "region_map": f"""
            select distinct region_id, ref_celltype from (
                select region_id, {_map('target_celltype', labels.REGION_LABELS_T_SUBSET)} as ref_celltype
                from panel where v23_conv = 1) q where ref_celltype is not null""",
        "shares": f"select * from (values {inside}) v(titrated, pool, share)",
        "design": f"""
            select t.titrated, l.proportion_id, l.titration, a.pool,
                   case when a.pool = t.titrated then {labels.T_GROUP_TOTAL!r}::double * l.titration
                        when s.share is not null then {labels.T_GROUP_TOTAL!r}::double * (1 - l.titration) * s.share
                        else {_number_map('a.pool', blood)} end as proportion
            from pool_counts a cross join (select distinct titrated from shares) t cross join levels l
            left join shares s on s.titrated = t.titrated and s.pool = a.pool""",
        "truth": truth_sql(dict(zip(bridge.SUBSET_POOLS, types))),
        "atlas": atlas_sql(types),
        "equations": equations_sql(len(types)),
        "sweeps": _descent("equations", "0.0", SUBSET_SWEEPS, len(types)),
        "nnls": unpivoted("sweeps", SUBSET_SWEEPS, "nnls", types),
    }


SUBSET_SWEEPS = 300
SUBSET_TABLES = _subset_tables()


def rate_steps(rates: str) -> str:
    """The rates of a curve with those of the next level."""
    return (f"select *, lead(p) over w as next_p, lead(rate) over w as next_rate, "
            f"row_number() over w as place from {rates} window w as (partition by ref_celltype order by p)")


def lod_from(steps: str, target: float = 0.95) -> str:
    return f"""
        select ref_celltype, round(case when first_rate > {target} then null else lod end, 6) as lod,
               case when first_rate > {target} then 'below_grid' when lod is null then 'never_reached'
                    else 'ok' end as status
        from (select ref_celltype,
                     min(case when rate = {target} then p
                              when rate <= {target} and next_rate > {target}
                              then p + ({target} - rate) * (next_p - p) / (next_rate - rate) end) as lod,
                     max(case when place = 1 then rate end) as first_rate
              from {steps} group by ref_celltype) q"""


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """`final` preceded by every table it needs, in order of dependence."""
    tables = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def need(sql: str, inside: str = "") -> None:
        for word in re.findall(r"\b(?:from|join|in \(select \w+ from|cross join)\s+(\w+)", sql):
            if word in tables and word not in ordered and word != inside:
                need(tables[word], word)
                ordered.append(word)

    need(final)
    if not ordered:
        return final
    recursive = "recursive " if any(re.search(rf"\bfrom {name}\b", tables[name]) for name in ordered) else ""

    def body(name: str) -> str:
        kept = "" if re.search(rf"\bfrom {name}\b", tables[name]) else "materialized "
        return f"{name} as {kept}({tables[name]})"

    return f"with {recursive}" + ", ".join(body(n) for n in ordered) + " " + final
