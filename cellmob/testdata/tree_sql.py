"""Both decision trees as DuckDB SQL: grown level by level from histograms per node, feature
and bin, for all sets of folds and all least node sizes at once.

A tree of a lesser depth is the top of the deeper one. Thresholds are midpoints between
values, or between some of equal shares where values are many; the day is nominal and its
values are ordered per node by impurity, or by mean. Of equal gains the first feature and
the first threshold count. Spark ML looks for thresholds in a sample of 10,000 rows, so
that this holds for up to so many training rows. Written over ``vectors`` and ``sets``.
"""

from __future__ import annotations

from cellmob.operators.predict import MODELS

_FEATURES = 9
_CLASSES = 12  # at most; columns of counts
_NODES = MODELS["decision_tree_regressor"].grid["minInstancesPerNode"]
_DEPTHS = MODELS["decision_tree_regressor"].grid["maxDepth"]
_KEY = "k, m, node"

COMMON = {
    "tree_days": "select count(*) as days, greatest(count(*), 31) as splits from training_days",
    "tree_values": f"""
        select k, f, x[f] as v, count(*) as n from vectors join sets on fold <> k
        cross join (select unnest(range(2, {_FEATURES + 1})) as f) where training group by all""",
    "tree_ordered": """
        select *, row_number() over (partition by k, f order by v) as i,
          sum(n) over (partition by k, f order by v rows unbounded preceding) as seen,
          sum(n) over (partition by k, f) as rows_in, count(*) over (partition by k, f) as different
        from tree_values""",
    # of many values: a threshold wherever the next value would lead further past a share
    "tree_strides": """
        select k, f, 1::bigint as i, rows_in / (splits + 1)::double as target, null::double as t
        from tree_ordered cross join tree_days where i = 1 and different - 1 > splits
        union all
        select s.k, s.f, b.i,
          case when abs(a.seen - target) < abs(b.seen - target)
               then target + a.rows_in / (splits + 1)::double else target end,
          case when abs(a.seen - target) < abs(b.seen - target) then (a.v + b.v) / 2 end
        from tree_strides s join tree_ordered a on a.k = s.k and a.f = s.f and a.i = s.i
        join tree_ordered b on b.k = s.k and b.f = s.f and b.i = s.i + 1 cross join tree_days""",
    "tree_thresholds": """
        select k, f, t from tree_strides where t is not null
        union all
        select a.k, a.f, (a.v + b.v) / 2 from tree_ordered a
        join tree_ordered b on b.k = a.k and b.f = a.f and b.i = a.i + 1
        cross join tree_days where a.different - 1 <= splits""",
    "tree_edges": "select k, f, list(t order by t) as ts from tree_thresholds group by k, f",
    "tree_bins": f"""
        select r, k, f, case when f = 1 then x[1]::bigint
          else len(list_filter(coalesce(ts, []), lambda t: t < x[f])) end as bin
        from vectors cross join sets cross join (select unnest(range(1, {_FEATURES + 1})) as f)
        left join tree_edges using (k, f)
        where k = -1 or training""",
    "tree_rows": """
        select r, k, list(bin order by f) as bins, any_value(training and fold <> k) as fit,
          any_value(training) as training, any_value(crowd) as crowd, any_value(crowdIndex) as crowdIndex
        from tree_bins join vectors using (r) group by r, k""",
}


def _gini(count, total: str) -> str:
    """``count`` names the rows of a class; the squares are taken off in turn."""
    out = "1"
    for c in range(_CLASSES):
        out = f"({out} - ({count(c)} / {total}::double) * ({count(c)} / {total}::double))"
    return out


def _variance(n: str, s: str, ss: str) -> str:
    return f"((({ss}) - (({s}) * ({s})) / ({n})::double) / ({n})::double)"


class _Kind:
    """What differs between classes and counts: sums of a bin, impurity, order, prediction."""

    def __init__(self, classes: bool) -> None:
        self.name = "class" if classes else "count"
        self.label = "crowdIndex" if classes else "crowd"
        self.sums = ([(f"c{c}", f"count(*) filter (where crowdIndex = {c})") for c in range(_CLASSES)]
                     if classes else [("s", "sum(crowd)::double"), ("q", "sum(crowd * crowd)::double")])
        if classes:
            self.impurity = lambda p, n: _gini(lambda c: f"{p}c{c}", n)
            self.rest = lambda: _gini(lambda c: f"(tc{c} - lc{c})", "(tn - ln)")
            self.order = self.impurity("", "n")
            self.predicted = "(list_position(counts, list_max(counts)) - 1)::double"
        else:
            self.impurity = lambda p, n: _variance(n, f"{p}s", f"{p}q")
            self.rest = lambda: _variance("tn - ln", "ts - ls", "tq - lq")
            self.order = "s / n"
            self.predicted = "mean"

    def level(self, n: int) -> dict[str, str]:
        at = f"tree_{self.name}"
        window = f"partition by {_KEY}, f"
        running = ", ".join(f"sum({c}) over (w rows unbounded preceding) as l{c},"
                            f" sum({c}) over ({window}) as t{c}"
                            for c in ["n", *(c for c, _ in self.sums)])
        return {
            f"{at}_histogram_{n}": f"""
                select {_KEY}, f, bins[f] as bin, count(*) as n,
                  {', '.join(f'{sql} as {c}' for c, sql in self.sums)}
                from {at}_level_{n} cross join (select unnest(range(1, {_FEATURES + 1})) as f)
                where fit and active group by {_KEY}, f, bin""",
            f"{at}_ordered_{n}": f"""
                select *, row_number() over ({window}
                  order by case when f = 1 then {self.order} else 0 end, bin) as place
                from {at}_histogram_{n}""",
            f"{at}_running_{n}": f"""
                select {_KEY}, f, bin, place, {running} from {at}_ordered_{n}
                window w as ({window} order by place)""",
            f"{at}_gains_{n}": f"""
                select {_KEY}, f, bin, place, {self.impurity('t', 'tn')}
                    - (ln / tn::double) * {self.impurity('l', 'ln')}
                    - ((tn - ln) / tn::double) * {self.rest()} as gain
                from {at}_running_{n} where ln >= m and tn - ln >= m""",
            f"{at}_best_{n}": f"""
                select {_KEY}, f, bin as edge, place as last from (
                  select *, row_number() over (partition by {_KEY} order by gain desc, f, place) as chosen
                  from {at}_gains_{n}) where chosen = 1 and gain > 0""",
            f"{at}_splits_{n}": f"""
                select {_KEY}, b.f, any_value(edge) as edge, list(o.bin) as lefts
                from {at}_best_{n} b join {at}_ordered_{n} o using ({_KEY}, f)
                where o.place <= last group by {_KEY}, b.f""",
            f"{at}_level_{n + 1}": f"""
                select r, k, m, case when f is null then node when
                    case when f = 1 then list_contains(lefts, bins[1]) else bins[f] <= edge end
                  then 2 * node else 2 * node + 1 end as node,
                  f is not null as active, bins, fit, training, crowd, crowdIndex
                from {at}_level_{n} left join {at}_splits_{n} using ({_KEY})""",
        }

    def tables(self) -> dict[str, str]:
        at = f"tree_{self.name}"
        out = {f"{at}_level_0": f"""
            select r, k, m, 1::bigint as node, true as active, bins, fit, training, crowd, crowdIndex
            from tree_rows cross join (select unnest({_NODES}) as m)"""}
        for n in range(max(_DEPTHS)):
            out.update(self.level(n))
        counts = ", ".join(f"count(*) filter (where crowdIndex = {c})" for c in range(_CLASSES))
        leaves = "\nunion all ".join(f"""
            select r, {_KEY}, fit, training, crowd, crowdIndex, {i * len(_NODES)} + list_position({_NODES}, m) - 1
              as point from {at}_level_{depth}""" for i, depth in enumerate(_DEPTHS))
        good = ("avg((l = p)::int)" if self.name == "class" else "sqrt(avg((p - l) * (p - l)))")
        out.update({
            f"{at}_leaves": leaves,
            f"{at}_values": f"""
                select point, {_KEY}, {self.predicted} as p from (
                  select point, {_KEY}, [{counts}] as counts, avg(crowd) as mean
                  from {at}_leaves where fit group by point, {_KEY})""",
            f"{at}_all": f"""
                select point, k, fit, training, {self.label}::double as l, p
                from {at}_leaves join {at}_values using (point, {_KEY})""",
            f"{at}_scores": f"""
                select point, avg(good) as score from (
                  select point, k, {good} as good from {at}_all
                  where k >= 0 and not fit group by point, k) group by point""",
            f"{at}_chosen": f"""select point from {at}_scores
                order by score {'desc' if self.name == 'class' else ''}, point limit 1""",
            f"{at}_guessed": f"""
                select l, p from {at}_all join {at}_chosen using (point) where k = -1 and not training""",
            f"{at}_classes": f"""
                select l, support, hits, coalesce(predicted, 0) as predicted from (
                  select l, count(*) as support, count(*) filter (where p = l) as hits
                  from {at}_guessed group by l)
                left join (select p, count(*) as predicted from {at}_guessed group by p) on p = l""",
            f"{at}_error": f"""
                select {'avg((l <> p)::int)' if self.name == 'class' else good} as error
                from {at}_all join {at}_chosen using (point) where k = -1 and training""",
        })
        return out

    def rows(self, model: str) -> str:
        at, points = f"tree_{self.name}", len(_DEPTHS) * len(_NODES)
        return f"""
            union all select '{model}', 'training_error', round(error, 6) from {at}_error""" + "".join(
            f"\nunion all select '{model}', 'score_{n}', round(score, 6) from {at}_scores where point = {n}"
            for n in range(points))


CLASSES, COUNTS = _Kind(True), _Kind(False)
TABLES = {**COMMON, **CLASSES.tables(), **COUNTS.tables()}
