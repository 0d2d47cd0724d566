"""The registered queries as DuckDB SQL, written in the plain form.

Windows, self-joins and cross joins here, where the library uses histograms, hulls and
grids: the comparison checks those too.
"""

from __future__ import annotations

from cellmob.schema import AIRPORT, INNER_CITY, OUTER_CITY, Area
from cellmob.testdata import linear_sql, poisson_sql, tree_sql
from cellmob.testdata.view import RAW_SQL


def _km(lat1, lng1, lat2, lng2) -> str:
    return (f"6371 * (2 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
            f" + pow(sin(radians({lng2} - {lng1}) / 2), 2)"
            f" * cos(radians({lat1})) * cos(radians({lat2})))))")


def _within(area: Area, lat="lat", lng="lng") -> str:
    return (_km(lat, lng, f"{area.lat}::double", f"{area.lng}::double")
            + f" <= {area.radius_km}::double")


# Each table is defined over the ones before it.
_TABLES = {
    "raw": RAW_SQL,
    "reduced": """
        select strftime("timestamp", '%m.%d') as dataset, subscriber, "timestamp", lat, lng
        from raw where lat > 0 and lng > 0 and subscriber is not null
          and "timestamp" is not null and not isnan(lat) and not isnan(lng)""",
    "cells": "select distinct lat, lng from reduced",
    "visits": "select distinct dataset, subscriber, lat, lng from reduced",
    "extents": f"""
        select dataset, subscriber, max(round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 2))
          as haversine
        from visits a join visits b using (dataset, subscriber)
        group by dataset, subscriber""",
    "longest": """
        select dataset, subscriber, haversine from (
          select *, rank() over (partition by dataset order by haversine desc) as r
          from extents) where r <= 5""",
    "counted": """
        select *, count("timestamp") over (partition by dataset, subscriber) as n
        from reduced""",
    "last": """
        select dataset, subscriber, "timestamp", lat, lng, n as events from (
          select *, row_number() over (partition by dataset, subscriber
                     order by "timestamp" desc, lat desc, lng desc) as r
          from counted) where r = 1""",
    "frames": """
        select dataset, cast(hour("timestamp") as integer) as dataframe, lat, lng
        from reduced""",
    "crowd": """
        select dataset, dataframe, lat, lng, count(*) as crowd
        from frames group by all""",
    "neighbours": f"""
        select lat, lng, oLat, oLng, haversine from (
          select *, rank() over (partition by lat, lng order by haversine) as r from (
            select a.lat, a.lng, b.lat as oLat, b.lng as oLng,
                   round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 2) as haversine
            from cells a, cells b where not (a.lat = b.lat and a.lng = b.lng)))
        where r <= 3""",
    "lagged": """
        select *, lag(crowd, 1, 0) over (order by dataset, dataframe, lat, lng)
                 as lastFrameCrowd
        from crowd""",
    "beside": """
        select l.dataset, l.dataframe, l.lat, l.lng, l.crowd, l.lastFrameCrowd,
               k.oLat, k.oLng, k.haversine, o.crowd as oCrowd
        from lagged l join neighbours k on l.lat = k.lat and l.lng = k.lng
        join crowd o on o.dataset = l.dataset and o.dataframe = l.dataframe
                    and o.lat = k.oLat and o.lng = k.oLng""",
    "features": """
        select dataset, dataframe, lat, lng, crowd, lastFrameCrowd,
               min(oCrowd) over w as knnMin, cast(sum(oCrowd) over w as bigint) as knnSum,
               round(avg(oCrowd) over w, 2) as knnAvg,
               round(max(haversine) over w, 2) as knnClosest
        from beside window w as (partition by dataset, dataframe, lat, lng)""",
    "hashed": """
        select *, row_number() over () as r, md5(concat_ws('|', dataset, cast(dataframe as varchar),
                   cast(cast(round(lat * 1000000) as bigint) as varchar),
                   cast(cast(round(lng * 1000000) as bigint) as varchar))) as digest
        from features""",
    "guessed": """
        select crowd::double as l, round(knnAvg) as p from features""",
    "classes": """
        select l, support, hits, coalesce(predicted, 0) as predicted from (
          select l, count(*) as support, count(*) filter (where p = l) as hits
          from guessed group by l)
        left join (select p, count(*) as predicted from guessed group by p) on p = l""",
    "crowd_classes": """
        select crowd, cast(row_number() over (order by count(*) desc, cast(crowd as varchar)) - 1
          as double) as crowdIndex from features group by crowd""",
    "indexed": """
        select h.*, c.crowdIndex, ('0x' || substr(digest, 1, 8))::bigint % 1000 < 700 as training,
          ('0x' || substr(digest, 9, 8))::bigint % 4 as fold
        from hashed h join crowd_classes c using (crowd)""",
    "training_days": """
        select dataset, row_number() over (order by count(*) desc, dataset) - 1 as i
        from indexed where training group by dataset""",
    "vectors": """
        select r, training, fold, crowd, crowdIndex,
          [coalesce(d.i, (select count(*) from training_days)), dataframe, lat, lng,
           lastFrameCrowd, knnMin, knnSum, knnAvg, knnClosest]::double[] as x
        from indexed left join training_days d using (dataset)""",
    "shares": """
        select -sum(n / total * ln(n / total)) as loss from (
          select count(*)::double as n, sum(count(*)) over ()::double as total
          from indexed where training group by crowdIndex)""",
    # a set of training rows to fit to: all but those of a fold, or all (-1)
    "sets": "select unnest([-1, 0, 1, 2, 3]) as k",
    "sums": """
        select k, crowdIndex, count(*) as n, [sum(x[1]), sum(x[2]), sum(x[3]), sum(x[4]), sum(x[5]),
          sum(x[6]), sum(x[7]), sum(x[8]), sum(x[9])] as s
        from vectors join sets on fold <> k where training group by k, crowdIndex""",
    # logarithms of smoothed shares; classes are numbered as far as they occur in the set
    "bayes": """
        select k, row_number() over (partition by k order by crowdIndex) - 1 as c,
          ln(n + 1) - ln(sum(n) over (partition by k) + count(*) over (partition by k)) as prior,
          list_transform(s, lambda v: ln(v + 1) - ln(list_sum(s) + 9)) as theta from sums""",
    "bayes_scores": """
        select r, k, training, fold, crowdIndex, c, prior + list_dot_product(x, theta) as score
        from vectors cross join bayes where k = -1 or training and k = fold""",
    "bayes_best": """
        select r, k, training, fold, crowdIndex as l, c::double as p from (
          select *, row_number() over (partition by r, k order by score desc, c) as place
          from bayes_scores) where place = 1""",
    "bayes_guessed": "select l, p from bayes_best where k = -1 and not training",
    "bayes_classes": """
        select l, support, hits, coalesce(predicted, 0) as predicted from (
          select l, count(*) as support, count(*) filter (where p = l) as hits
          from bayes_guessed group by l)
        left join (select p, count(*) as predicted from bayes_guessed group by p) on p = l""",
    **linear_sql.TABLES,
    **poisson_sql.TABLES,
    **tree_sql.TABLES,
}


def _needed(body: str) -> list[str]:
    """Names of the tables that ``body`` uses, in the order of their definition."""
    found: set[str] = set()
    texts = [body]
    while texts:
        words = set(texts.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in _TABLES.keys() & words - found:
            found.add(name)
            texts.append(_TABLES[name])
    return [name for name in _TABLES if name in found]


def _query(body: str) -> str:
    ctes = [f"{name} as ({_TABLES[name].strip()})" for name in _needed(body)]
    return "with recursive " + ",\n".join(ctes) + "\n" + body


def _quartiles(group: str) -> str:
    part = f"partition by {group} " if group else ""
    cols = f"{group}, " if group else ""
    return f"""select {cols}cast(q as integer) as quantile, min(haversine) as haversine
        from (select *, ntile(4) over ({part}order by haversine) as q from extents)
        group by {cols}q"""


def _distribution(dataset: str) -> str:
    return f"""select distinct dataset, haversine,
          cume_dist() over (partition by dataset order by haversine) as cume_dist
        from (select {dataset} as dataset,
                     cast(floor(haversine + 0.5::double) as integer) as haversine
              from extents)"""


def _profile(table: str, numbers: list[str], texts: list[str]) -> str:
    rows = [f"""select '{c}' as "column", count({c}) as "count",
              round(avg({c}), 6) as mean, round(stddev({c}), 6) as stddev,
              min({c})::double as min_value, max({c})::double as max_value,
              null::varchar as min_text, null::varchar as max_text from {table}"""
            for c in numbers]
    rows += [f"""select '{c}' as "column", count({c}) as "count",
              round(avg(try_cast({c} as double)), 6) as mean,
              round(stddev(try_cast({c} as double)), 6) as stddev,
              null::double as min_value, null::double as max_value,
              min({c}) as min_text, max({c}) as max_text from {table}"""
             for c in texts]
    return "\nunion all\n".join(rows)


def _in(area: Area) -> str:
    return f"(select * from reduced where {_within(area)})"


def _trails(days: str) -> str:
    return f"""select r.* from reduced r
        semi join ({days}) d on r.dataset = d.dataset and r.subscriber = d.subscriber"""


def _metrics(guessed: str, classes: str) -> str:
    return f"""select 'rmse' as metric, sqrt(avg((p - l) * (p - l))) as value from {guessed}
        union all select 'mae', avg(abs(p - l)) from {guessed}
        union all select 'r2', 1 - sum((p - l) * (p - l))
                  / (sum(l * l) - count(*) * avg(l) * avg(l)) from {guessed}
        union all select 'accuracy', avg((p = l)::int::double) from {guessed}
        union all select 'weightedPrecision',
            sum(support * coalesce(hits / nullif(predicted, 0), 0)) / sum(support) from {classes}
        union all select 'f1',
            sum(support * coalesce(2.0 * hits / nullif(predicted + support, 0), 0))
            / sum(support) from {classes}"""


def _size(model: str, label: str) -> str:
    """The size of the problem, and what the best constant leaves."""
    constant = ("1 - max(n) / sum(n)::double from (select count(*) as n from indexed"
                " where training group by crowdIndex)" if label == "crowdIndex"
                else f"stddev_pop({label}) from indexed where training")
    return f"""select '{model}' as model, 'training_rows' as metric, count(*)::double as value
        from indexed where training
        union all select '{model}', 'test_rows', count(*)::double from indexed where not training
        union all select '{model}', 'label_mean', round(avg({label}), 6) from indexed where training
        union all select '{model}', 'constant_error', round(value, 6)
        from (select {constant.replace(' from', ' as value from', 1)})"""


_ENDING = f"select dataset, subscriber from last where events > 1 and {_within(AIRPORT)}"
_EVENT_PROFILE = (["lat", "lng"], ["dataset", "subscriber"])

_BODIES = {
    "reduce_events": "select * from reduced",
    "area_outer_city": f"select * from reduced where {_within(OUTER_CITY)}",
    "area_inner_city": f"select * from reduced where {_within(INNER_CITY)}",
    "area_airport": f"select * from reduced where {_within(AIRPORT)}",
    "drop_singletons": 'select dataset, subscriber, "timestamp", lat, lng from counted where n > 1',
    "hour_frames": "select * from frames",
    "unique_cells": "select * from cells",
    "unique_visits": "select * from visits",
    "cell_distance_from_airport": f"""select lat, lng,
        round({_km('lat', 'lng', f'{AIRPORT.lat}::double', f'{AIRPORT.lng}::double')}, 6)
        as km from cells""",
    "daily_extent": "select * from extents",
    "extent_values": "select dataset, haversine from extents",
    "whole_km": """select dataset, subscriber,
        cast(floor(haversine + 0.5::double) as integer) as haversine from extents""",
    "distance_metadata": """select dataset, count(haversine) as "count",
        min(haversine) as "min", max(haversine) as "max", round(avg(haversine), 6) as mean
        from extents group by dataset""",
    "distance_quartiles": _quartiles("dataset"),
    "distance_quartiles_all": _quartiles(""),
    "distance_cume_dist": _distribution("dataset"),
    "distance_cume_dist_all": _distribution("'1'"),
    "longest_paths": "select * from longest",
    "longest_path_trails": _trails("select dataset, subscriber from longest"),
    "last_events": "select * from last",
    "days_ending_at_airport":
        f"select dataset, subscriber, events from last where events > 1 and {_within(AIRPORT)}",
    "airport_trails": _trails(_ENDING),
    "cell_crowd": "select * from crowd",
    "nearest_cells": "select * from neighbours",
    "lag_crowd": "select * from lagged",
    "lag_crowd_per_cell": """select *, lag(crowd, 1, 0) over (
        partition by lat, lng order by dataset, dataframe) as lastFrameCrowd from crowd""",
    "weighted_crowd": """select dataset, dataframe, lat, lng, oLat, oLng,
        oCrowd / nullif(haversine, 0) as weightedCrowd from beside""",
    "knn_features": "select * from features",
    "knn_features_distinct": "select distinct * from features",
    "profile_raw": _profile("raw", ["callId", "eventType", "lat", "lng"],
                            ["subscriber", "ni", "dt", "TAC", "cellId"]),
    "profile_reduced": _profile("reduced", *_EVENT_PROFILE),
    "profile_outer_city": _profile(_in(OUTER_CITY), *_EVENT_PROFILE),
    "profile_inner_city": _profile(_in(INNER_CITY), *_EVENT_PROFILE),
    "profile_airport": _profile(_in(AIRPORT), *_EVENT_PROFILE),
    "day_index": """select dataset, cast(row_number() over (order by count(*) desc, dataset) - 1
        as double) as datasetIndex from features group by dataset""",
    "crowd_index": """select crowd, cast(row_number() over (order by count(*) desc,
        cast(crowd as varchar)) - 1 as double) as crowdIndex from features group by crowd""",
    # edges by exact ranks: the count of the row at each eighth
    "crowd_bins": """select crowdBin, min(crowd) as least, max(crowd) as most, count(*) as "rows"
        from (select crowd, cast(len(list_filter(edges, lambda e: e < crowd)) as double) as crowdBin
              from features cross join (
                select list_distinct(quantile_disc(crowd, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))
                  as edges from features))
        group by crowdBin""",
    "feature_vectors": """select dataset, dataframe, lat, lng,
          d.i as f0, dataframe::double as f1, lat as f2, lng as f3, lastFrameCrowd::double as f4,
          knnMin::double as f5, knnSum::double as f6, knnAvg as f7, knnClosest as f8
        from features join (select dataset, cast(row_number() over (
            order by count(*) desc, dataset) - 1 as double) as i
          from features group by dataset) d using (dataset)""",
    "split_by_key": """select dataset, dataframe, lat, lng,
          (('0x' || substr(digest, 1, 8))::bigint % 1000 < 700) as training,
          cast(('0x' || substr(digest, 9, 8))::bigint % 4 as integer) as fold
        from hashed""",
    "feature_vectors_no_position": """select dataset, dataframe, lat, lng,
          d.i as f0, dataframe::double as f1, lastFrameCrowd::double as f2,
          knnMin::double as f3, knnSum::double as f4, knnAvg as f5, knnClosest as f6
        from features join (select dataset, cast(row_number() over (
            order by count(*) desc, dataset) - 1 as double) as i
          from features group by dataset) d using (dataset)""",
    "nearest_cells_5": f"""select lat, lng, oLat, oLng, haversine from (
          select *, rank() over (partition by lat, lng order by haversine) as r from (
            select a.lat, a.lng, b.lat as oLat, b.lng as oLng,
                   round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 2) as haversine
            from cells a, cells b where not (a.lat = b.lat and a.lng = b.lng)))
        where r <= 5""",
    "longest_paths_3": """select dataset, subscriber, haversine from (
          select *, rank() over (partition by dataset order by haversine desc) as r
          from extents) where r <= 3""",
    "evaluate": f"select metric, round(value, 6) as value from ({_metrics('guessed', 'classes')})",
    "predict_naive_bayes": _size("naive_bayes", "crowdIndex") + f"""
        union all select 'naive_bayes', 'training_error', round(avg((l <> p)::int), 6)
        from bayes_best where k = -1 and training
        union all select 'naive_bayes', 'score_0', round(avg(accuracy), 6)
        from (select avg((l = p)::int) as accuracy from bayes_best where k >= 0 group by k)
        union all select 'naive_bayes', metric, round(value, 6)
        from ({_metrics('bayes_guessed', 'bayes_classes')})""",
    "cross_validation_naive_bayes": """select k::int as fold, count(*) as "rows",
        round(avg((l = p)::int), 6) as accuracy from bayes_best where k >= 0 group by k""",
    "linear_regression_path": linear_sql.PATH,
    "predict_logistic_regression": _size("logistic_regression", "crowdIndex") + """
        union all select 'logistic_regression', 'shares_loss', round(loss, 6) + 0 from shares
        union all select 'logistic_regression', 'gains', (loss > 0)::int::double from shares""",
    "predict_decision_tree_classifier": _size("decision_tree_classifier", "crowdIndex")
        + tree_sql.CLASSES.rows("decision_tree_classifier") + f"""
        union all select 'decision_tree_classifier', metric, round(value, 6)
        from ({_metrics('tree_class_guessed', 'tree_class_classes')})""",
    "predict_linear_regression": _size("linear_regression", "crowd") + linear_sql.BEST + f"""
        union all select 'linear_regression', metric, round(value, 6)
        from ({_metrics('linear_guessed', 'linear_classes')})""",
    "predict_poisson_regression": _size("poisson_regression", "crowd") + poisson_sql.BEST + f"""
        union all select 'poisson_regression', metric, round(value, 6)
        from ({_metrics('poisson_guessed', 'poisson_classes')})""",
    "predict_decision_tree_regressor": _size("decision_tree_regressor", "crowd")
        + tree_sql.COUNTS.rows("decision_tree_regressor") + f"""
        union all select 'decision_tree_regressor', metric, round(value, 6)
        from ({_metrics('tree_count_guessed', 'tree_count_classes')})""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _query(body) for name, body in _BODIES.items()}
