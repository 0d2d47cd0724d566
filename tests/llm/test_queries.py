"""The registered queries against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline as P
from cellmob.llm import language, queries, scratch
from compare import connect, difference
from test_mix_shard_pack import plain_targets
from test_near_dups import plain_components, plain_exact

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert difference(df, connect(SF_DIR), queries.ORACLE_SQL[name]) is None


def docs_of(df):
    assert df.columns == list(P.COLUMNS)
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, written and read again as the next one's documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup",
                                        "source_mixing", "best_fit_packing"]
    assert P.ORACLE_SQL is None


def test_language_stage_keeps_what_is_not_rejected(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.train(docs)
    kept = {r.doc_id for r in language.predict(docs, model).collect() if not r.rejected}
    got = docs_of(stages[0])
    assert sorted(got) == sorted(r for r in docs_of(docs.select(*P.COLUMNS)) if r[0] in kept)
    assert len(got) >= 0.97 * docs.count()


def test_dedup_stages_equal_brute_force(stages):
    before, exact, near = (docs_of(s) for s in stages[:3])
    keep = {k for i, k, *_ in plain_exact([r[:2] for r in before])}
    assert sorted(exact) == sorted(r for r in before if r[0] in keep)
    first = {i for i, _, c, kept in plain_components([r[:2] for r in exact], 5, 80) if kept}
    assert sorted(near) == sorted(r for r in exact if r[0] in first)
    assert len(near) < len(before)


def test_mixing_stage_comes_near_the_targets(stages):
    near, mixed = docs_of(stages[2]), docs_of(stages[3])
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in near}
    sources, taken, times = Counter(), Counter(), Counter(r[0] for r in mixed)
    for r in near:
        sources[r[3]] += size[r[0]]
    for r in mixed:
        taken[r[3]] += size[r[0]]
    longest = {s: max(size[r[0]] for r in near if r[3] == s) for s in sources}
    for s, t in plain_targets(sources).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    assert set(mixed) <= set(near) and max(times.values()) <= 2


def test_packing_stage_holds_all_tokens(spark, stages):
    mixed, packed = docs_of(stages[3]), stages[4].collect()
    fills, rows = defaultdict(list), Counter()
    for r in packed:
        fills[r.sequence_id].append((r.offset, r.length))
        rows[r.doc_id] += r.piece == 0
    assert rows == Counter(r[0] for r in mixed)
    for places in fills.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(fills) <= -(-sum(r.length for r in packed) // 4096) + 2


def test_run_applies_the_stages(spark, stages):
    got = P.run(spark, SF_DIR)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got.collect())) == Counter(map(key, stages[4].collect()))


def test_odd_documents_pass_all_stages(spark, frame, nasty, tmp_path):
    """Rows without ids, repeated rows and empty texts, counted through every stage."""
    docs, out = frame(nasty), []
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, None).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        out.append(docs.collect())
    told, exact, near, mixed, packed = out
    given = Counter((i, t) for i, t, *_ in nasty)
    kept = Counter((r.doc_id, r.text) for r in told)
    assert not kept - given and (None, "no id") in kept
    same = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(same(r.text) for r in exact) == Counter({same(t) for _, t in kept})
    assert not Counter((r.doc_id, r.text) for r in exact) - kept
    words = lambda t: (t or "").lower().split()
    sets = [frozenset(zip(*(words(r.text)[k:] for k in range(5)))) or frozenset([tuple(words(r.text))])
            for r in exact]
    linked = list(range(len(exact)))
    for a in range(len(exact)):
        for b in range(a):
            if sets[a] != {()} and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked = [linked[b] if x == linked[a] else x for x in linked]
    assert len(near) == len(set(linked))
    assert not Counter(map(tuple, near)) - Counter(map(tuple, exact))
    times = Counter((r.doc_id, r.text) for r in mixed)
    assert set(times) <= {(r.doc_id, r.text) for r in near if words(r.text)} and max(times.values()) <= 2
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    empty = frame([])
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, empty, None).write.parquet(str(tmp_path / f"empty{n}"))
        empty = spark.read.parquet(str(tmp_path / f"empty{n}"))
    assert empty.count() == 0


def test_a_stage_deletes_what_the_one_before_wrote_for_itself(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    P.exact(spark, docs, SF_DIR).write.parquet(str(tmp_path / "exact"))
    before = list(P._own)
    assert before and set(before) <= set(scratch._written)
    P.near(spark, spark.read.parquet(str(tmp_path / "exact")), SF_DIR).write.parquet(str(tmp_path / "near"))
    assert P._own and not set(before) & set(scratch._written)


def test_sql_of_removed_bytes_on_texts_of_many_scripts():
    con = duckdb.connect()
    con.execute("create table documents as select * from (values (1, repeat('aé', 200)), (2, null), (3, 'b')) t(doc_id, text)")
    rows = con.execute(queries.ORACLE_SQL["op9_suffix_array_dedup"]).fetchall()
    assert {r[0]: r[1:4] for r in rows} == {1: (600, 600, 1), 2: (0, 0, 0), 3: (1, 0, 0)}
