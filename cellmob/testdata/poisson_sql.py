"""Poisson regression with a quadratic penalty as DuckDB SQL: reweighted least squares as a
recursive query over all grid points and sets of folds at once.

A step weighs the rows by their expected counts, sums weighted products into one linear
system per problem, and eliminates it by nested queries. Written over ``vectors``,
``sets`` and ``linear_means`` of the oracle.
"""

from __future__ import annotations

from cellmob.operators.predict import MODELS
from cellmob.testdata.linear_sql import P, _list, _sum

_STEPS = 12
_REGS = MODELS["poisson_regression"].grid["regParam"]
_ALL = range(P + 1)  # the features, then the intercept


def _x(i: int) -> str:
    return f" * x{i}" if i < P else ""


def _system() -> str:
    """Rows of the normal equations, each with its right-hand side."""
    lines = []
    for i in _ALL:
        left = [f"sum(mu{_x(i)}{_x(j)})" + (" + reg * sum(mu)" if i == j < P else "") for j in _ALL]
        lines.append(f"[{', '.join(left)}, sum((mu * eta + y - mu){_x(i)})] as a{i}")
    return ", ".join(lines)


def _solved() -> str:
    query = f"""(select point, k, reg, step, {_system()} from (
          select point, k, reg, step, y, {_list('x{i}')}, eta, exp(eta) as mu from (
            select *, b{P} + {_sum('b{i} * x{i}')} as eta
            from poisson_steps join poisson_rows on fold <> k where training and step < {_STEPS}))
        group by point, k, reg, step)"""
    for p in _ALL:
        rows = [f"list_transform(a{i}, lambda v: v / a{p}[{p + 1}]) as a{i}" if i == p else
                f"list_transform(range(1, {P + 3}), lambda j: a{i}[j] - a{i}[{p + 1}] / a{p}[{p + 1}]"
                f" * a{p}[j]) as a{i}" for i in _ALL]
        query = f"(select point, k, reg, step, {', '.join(rows)} from {query})"
    return query


TABLES = {
    "poisson_grid": "select * from (values {}) t(point, reg)".format(
        ", ".join(f"({n}, {reg}::double)" for n, reg in enumerate(_REGS))),
    "poisson_rows": f"""
        select training, fold, crowd::double as y, {_list('x[{n}] - a{i} as x{i}')}
        from vectors cross join linear_means""",
    "poisson_steps": f"""
        select point, k, reg, 0 as step, {_list('0::double as b{i}')}, ln(avg(y)) as b{P}
        from poisson_rows join sets on fold <> k cross join poisson_grid
        where training group by point, k, reg
        union all
        select point, k, reg, step + 1, {_list(f'a{{i}}[{P + 2}]', _ALL)} from {_solved()}""",
    "poisson_fits": f"select * from poisson_steps where step = {_STEPS}",
    "poisson_scores": f"""
        select point, avg(error) as score from (
          select point, k, sqrt(avg(pow(y - exp(b{P} + {_sum('b{i} * x{i}')}), 2))) as error
          from poisson_fits join poisson_rows on fold = k where training group by point, k)
        group by point""",
    "poisson_best": f"""
        select *, b{P} - ({_sum('b{i} * a{i}')}) as intercept
        from poisson_fits join poisson_scores using (point) cross join linear_means
        where k = -1 order by score, point limit 1""",
    "poisson_expected": f"""
        select *, exp(eta) as mu from (
          select r.*, reg, {_list('b{i}')}, b{P} + {_sum('b{i} * x{i}')} as eta
          from poisson_rows r cross join poisson_best)""",
    "poisson_sums": f"""
        select count(*) as n, sum(y * ln(case when y > 0 then y / mu else 1 end) - (y - mu)) as half,
          sum(y * eta - mu - lgamma(y + 1)) as likelihood, sqrt(avg(pow(y - mu, 2))) as error,
          greatest({_list('abs(sum((y - mu) * x{i}) - any_value(reg * b{i}) * sum(mu))')},
                   abs(sum(y - mu))) / count(*) as residual
        from poisson_expected where training""",
    "poisson_guessed": "select y as l, mu as p from poisson_expected where not training",
    "poisson_classes": """
        select l, support, hits, coalesce(predicted, 0) as predicted from (
          select l, count(*) as support, count(*) filter (where p = l) as hits
          from poisson_guessed group by l)
        left join (select p, count(*) as predicted from poisson_guessed group by p) on p = l""",
}

BEST = "".join(
    f"\nunion all select 'poisson_regression', '{name}', ({value})::double from {table}"
    for name, value, table in [
        ("reg", "reg", "poisson_best"), ("intercept", "round(intercept, 6)", "poisson_best"),
        *((f"coefficient_{i}", f"round(b{i}, 7)", "poisson_best") for i in range(P)),
        ("deviance", "round(2 * half, 5)", "poisson_sums"),
        ("aic", f"round({2 * P + 2} - 2 * likelihood, 4)", "poisson_sums"),
        ("training_error", "round(error, 6)", "poisson_sums"),
        ("score_residual", "round(residual, 6)", "poisson_sums"),
        *((f"score_{n}", "round(score, 6)", f"poisson_scores where point = {n}")
          for n in range(len(_REGS)))])
