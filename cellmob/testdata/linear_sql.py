"""Linear regression with an elastic net as DuckDB SQL: covariances per set of folds, and
coordinate descent as a recursive query over all grid points and sets at once.

Written over the tables ``vectors`` (r, training, fold, crowd, x) and ``sets`` (k: all
training rows but those of fold k, or all for -1) of the oracle.
"""

from __future__ import annotations

from cellmob.operators.predict import MODELS

P = 9
_SWEEPS = 500
_GRID = [(reg, mix) for reg in MODELS["linear_regression"].grid["regParam"]
         for mix in MODELS["linear_regression"].grid["elasticNetParam"]]
_ALL = range(P + 1)  # the features, then the label
_PAIRS = [(i, j) for i in _ALL for j in range(i, P + 1)]


def _list(template: str, indices=range(P)) -> str:
    return ", ".join(template.format(i=i, n=i + 1) for i in indices)


def _sum(template: str) -> str:
    return " + ".join(template.format(i=i, n=i + 1) for i in range(P))


def _cov(i: int, j: int) -> str:
    return f"c{min(i, j)}_{max(i, j)}"


def _gram(i: int) -> str:
    return ", ".join(f"case when d{i} > 0 and d{j} > 0 then {_cov(i, j)} / (d{i} * d{j}) else 0 end"
                     for j in range(P))


def _sweep() -> str:
    """Each coordinate in turn, those before it being new already: a query inside the next."""
    query = f"linear_descent join linear_problems using (point, k) where step < {_SWEEPS}"
    for i in range(P):
        now = ", ".join(f"n{j}" if j < i else f"b{j}" for j in range(P))
        slope = f"r{i} - list_dot_product(g{i}, [{now}]) + g{i}[{i + 1}] * b{i}"
        query = f"(select *, {slope} as z{i} from {query})"
        query = f"(select *, sign(z{i}) * greatest(abs(z{i}) - l1, 0) / (1 + l2) as n{i} from {query})"
    return query


TABLES = {
    "linear_means": f"""
        select avg(crowd) as a{P}, {_list('avg(x[{n}]) as a{i}')} from vectors where training""",
    "linear_rows": f"""
        select training, fold, crowd - a{P} as x{P}, {_list('x[{n}] - a{i} as x{i}')}
        from vectors cross join linear_means""",
    "linear_folds": f"""
        select fold, count(*) as n, {_list('sum(x{i}) as s{i}', _ALL)},
          {', '.join(f'sum(x{i} * x{j}) as q{i}_{j}' for i, j in _PAIRS)}
        from linear_rows where training group by fold""",
    "linear_sets": f"""
        select k, sum(n)::double as n, {_list('sum(s{i}) as s{i}', _ALL)},
          {', '.join(f'sum(q{i}_{j}) as q{i}_{j}' for i, j in _PAIRS)}
        from linear_folds join sets on fold <> k group by k""",
    "linear_cov": f"""
        select k, n, {_list('s{i} / n as m{i}', _ALL)},
          {', '.join(f'q{i}_{j} / n - s{i} / n * s{j} / n as c{i}_{j}' for i, j in _PAIRS)}
        from linear_sets""",
    "linear_grid": "select * from (values {}) t(point, reg, mix)".format(
        ", ".join(f"({n}, {reg}::double, {mix}::double)" for n, (reg, mix) in enumerate(_GRID))),
    "linear_scaled": f"""
        select *, sqrt({_cov(P, P)}) as dy, coalesce(reg * mix / nullif(dy, 0), 0) as l1,
          coalesce(reg * (1 - mix) / nullif(dy, 0), 0) as l2,
          {', '.join(f'case when {_cov(i, i)} > 1e-24 then sqrt({_cov(i, i)}) else 0 end as d{i}'
                     for i in range(P))}
        from linear_cov cross join linear_grid""",
    "linear_problems": f"""
        select point, k, reg, mix, dy, l1, l2, {_list('m{i}', _ALL)}, {_list('d{i}')},
          {', '.join(f'[{_gram(i)}] as g{i}' for i in range(P))},
          {', '.join(f'case when d{i} > 0 and dy > 0 then {_cov(i, P)} / (d{i} * dy) else 0 end as r{i}'
                     for i in range(P))}
        from linear_scaled""",
    "linear_descent": f"""
        select point, k, 0 as step, {_list('0::double as b{i}')} from linear_problems
        union all
        select point, k, step + 1, {_list('n{i}')} from {_sweep()}""",
    "linear_fits": f"""
        select *, m{P} - ({_sum('e{i} * m{i}')}) as centred,
          centred + a{P} - ({_sum('e{i} * a{i}')}) as intercept
        from (select *, {_list('case when d{i} > 0 then b{i} * dy / d{i} else 0 end + 0 as e{i}')}
              from linear_descent join linear_problems using (point, k) where step = {_SWEEPS})
        cross join linear_means""",
    "linear_scores": f"""
        select point, avg(error) as score from (
          select point, k, sqrt(avg(pow(x{P} - (centred + {_sum('e{i} * x{i}')}), 2))) as error
          from linear_fits join linear_rows on fold = k where training group by point, k)
        group by point""",
    "linear_errors": f"""
        select point, avg(pow(x{P} - (centred + {_sum('e{i} * x{i}')}), 2)) as squared
        from linear_fits cross join linear_rows where k = -1 and training group by point""",
    "linear_found": f"""
        select f.*, score, squared,
          squared / 2 + dy * dy * (l1 * ({_sum('abs(b{i})')}) + l2 / 2 * ({_sum('b{i} * b{i}')}))
            as objective,
          greatest({_list('case when d{i} = 0 then 0 when b{i} <> 0 then abs(y{i} - l1 * sign(b{i}))'
                          ' else abs(y{i}) - l1 end')}, 0) as violation
        from (select *, {', '.join(f'r{i} - list_dot_product(g{i}, [{_list("b{i}")}]) - l2 * b{i} as y{i}'
                                   for i in range(P))}
              from linear_fits where k = -1) f
        join linear_scores using (point) join linear_errors using (point)""",
    "linear_best": "select * from linear_found order by score, point limit 1",
    "linear_guessed": f"""
        select crowd::double as l, intercept + {_sum('e{i} * x[{n}]')} as p
        from vectors cross join linear_best where not training""",
    "linear_classes": """
        select l, support, hits, coalesce(predicted, 0) as predicted from (
          select l, count(*) as support, count(*) filter (where p = l) as hits
          from linear_guessed group by l)
        left join (select p, count(*) as predicted from linear_guessed group by p) on p = l""",
}

# name, value of one fit
_VALUES = [("reg", "reg"), ("mix", "mix"), ("intercept", "round(intercept, 7)"),
           ("objective", "round(objective, 8)"), ("violation", "round(violation, 7)"),
           *((f"coefficient_{i}", f"round(e{i}, 8)") for i in range(P))]

PATH = "\nunion all ".join(
    f"select point::int as point, '{name}' as name, ({value})::double as value from linear_found"
    for name, value in [("score", "round(score, 6)"), *_VALUES])

BEST = "".join(f"\nunion all select 'linear_regression', '{name}', ({value})::double from linear_best"
               for name, value in [*_VALUES, ("training_error", "round(sqrt(squared), 6)")])
BEST += "".join(f"\nunion all select 'linear_regression', 'score_{n}', round(score, 6)"
                f" from linear_found where point = {n}" for n in range(len(_GRID)))
