"""The registered queries over the smallest tables: against SQL where there is some, and by their own invariants."""

import glob
import os

import duckdb
import pytest

from voxloom.llm import queries as Q

SF = os.environ.get("VOXLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(Q.oracle_sql()[name]).fetchall())


def test_mapped_values(spark, duck):
    rows = Q.p2_found(spark, SF).collect()
    n = duck.execute("SELECT count(*) FROM (SELECT DISTINCT entry_id, speaker_display AS v FROM review_entries WHERE v IS NOT NULL AND v NOT IN (SELECT display_name FROM cast_list) UNION ALL SELECT DISTINCT entry_id, speaker_status FROM review_entries WHERE speaker_status IS NOT NULL AND speaker_status NOT IN (SELECT speaker_status FROM status_list))").fetchone()[0]
    assert len(rows) == n and len({(r.entry_id, r.field_name) for r in rows}) == n


def test_everyone_with_three_votes_has_a_speaker(spark, duck):
    got = {r.dialogue_id for r in Q.p5_found(spark, SF).collect()}
    assert got == {r[0] for r in duck.execute("SELECT dialogue_id FROM votes WHERE speaker_entity_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model) >= 3").fetchall()}


def test_pairs_are_ordered_and_closed(spark):
    persons = {tuple(r) for r in Q.p3_found(spark, SF).collect()}
    near = {}
    for a, b in persons:
        assert a < b
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    assert all(near[a] == near[b] for a, b in persons)
    assert all(a < b for a, b in Q.p6_found(spark, SF).select("id_a", "id_b").collect())


def test_every_text_is_packed_once(spark, duck):
    packed = Q.p7_pack(spark, SF).groupBy("doc_id").sum("tokens").count()
    empty = duck.execute("SELECT count(*) FROM documents WHERE coalesce(text, '') <> ''").fetchone()[0]
    assert packed <= empty and packed >= 0.99 * empty
    fill = Q.p7_fill(spark, SF).first()
    assert fill.fullest <= 2048 and fill.containers >= fill.least_containers


def test_all_queries_run(spark):
    for name in ("p1_pieces", "p2_mapped", "p3_people", "p5_consensus", "p5_annotators", "p6_canonical", "p8_mix", "p8_shares", "p9_shared"):
        assert Q.queries()[name](spark, SF).count() >= 0
