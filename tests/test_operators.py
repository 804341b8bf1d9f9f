"""Branches of the operators on literal rows."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from evidentia.functions import mask, scores, text
from evidentia.operators import builds, cases, changes, config, evidence, fusion, graph, lineage, requirements, search
from evidentia.sources import files
from evidentia.sources.snapshots import SnapshotStore, normalised


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores_of_a_method(spark):
    rows = spark.createDataFrame([("METHOD", 1.0, None, None, None, 0.85), ("METHOD", 0.6, None, None, None, None), ("SQL_TABLE", None, 1.0, None, 0.9, None), ("OTHER", 1.0, None, None, None, 0.5)], "kind string, code double, db double, config double, rag double, llm double")
    got = {(r.kind, r.code): (r.score_overall, r.consensus_count, r.confidence_tier) for r in fusion.corroborated(rows).collect()}
    assert got["METHOD", 1.0] == (1.0, 2, "HIGH")
    assert got["METHOD", 0.6] == (0.4286, 1, "MEDIUM")  # the missing bridge stays in the denominator
    assert got["SQL_TABLE", None] == (0.8444, 2, "HIGH")
    assert got["OTHER", 1.0] == (0.5, 0, "MEDIUM")


def test_bad_numbers_count_as_zero(spark):
    rows = spark.createDataFrame([("0.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert [r.x for r in rows.select(scores.number_of(F.col("v")).alias("x")).collect()] == [0.5, 0.0, 0.0, 0.0, 0.0]


def test_db_and_config_scores(spark):
    assert one(spark, scores.db_score(F.lit("literal"), F.lit(False), F.lit(3))) == 1.0
    assert one(spark, scores.db_score(F.lit("concat"), F.lit(True), F.lit(1))) == 0.5
    assert one(spark, scores.db_score(F.lit("unknown"), F.lit(False), F.lit(0))) == 0.4
    assert one(spark, scores.config_score(F.lit(True), F.lit(""), F.lit(None).cast("string"))) == 0.4
    assert one(spark, scores.config_score(F.lit(False), F.lit(""), F.lit("xml_id_match"))) == 0.85


def test_change_types(spark):
    assert one(spark, scores.change_type(F.lit("METHOD"), F.lit(True))) == "add_method"
    assert one(spark, scores.change_type(F.lit("JOB"), F.lit(False))) == "modify_method"
    assert one(spark, scores.change_type(F.lit("NEW"), F.lit(False))) == "unknown"


def test_sequence_usage(spark):
    assert one(spark, scores.sequence_usage(F.lit("8100000000000000000000000000"), F.lit("0"), F.lit("9000000000000000000000000000"))) == 90.0
    assert one(spark, scores.sequence_usage(F.lit("5"), F.lit("9"), F.lit("3"))) is None
    assert one(spark, scores.sequence_usage(F.lit("x"), F.lit("0"), F.lit("3"))) is None


def test_masks(spark):
    assert one(spark, mask.masked(F.lit("secret123"))) == "****t123"
    assert one(spark, mask.masked(F.lit("abc"))) == "****"
    assert one(spark, mask.is_sensitive_key(F.lit("db.PASSWORD")))
    assert not one(spark, mask.is_sensitive_key(F.lit("pin_key")))
    assert one(spark, mask.is_sensitive_key(F.lit("secret_key")))
    assert one(spark, mask.is_sensitive_value(F.lit("http://u:p@h/x")))
    assert not one(spark, mask.is_sensitive_value(F.lit("jdbc:oracle:thin:@host")))
    item = one(spark, mask.sanitized_item(F.lit("db.pwd"), F.lit("tiger"), b"s"))
    assert item == ("****iger", 1, hmac.new(b"s", b"tiger", hashlib.sha256).hexdigest())


def test_redaction_is_idempotent(spark):
    rows = spark.createDataFrame([("scott/tiger@db pwd=x http://a:b@c AKIAABCDEFGH1234",)], "t string")
    once = rows.select(mask.redacted(F.col("t")).alias("t"))
    assert once.select(mask.redacted(F.col("t")).alias("t")).first() == once.first()
    assert "tiger" not in once.first()["t"] and "db" in once.first()["t"]


@pytest.mark.parametrize(("value", "label"), [("mail a@b.org", "email"), ("call 13912345678 now", "msisdn"), ("token: abc", "credential"), ("value_raw=1", "value_raw"), ("姓名：张三", "name"), ("plain words", None)])
def test_personal_data(spark, value, label):
    assert one(spark, mask.personal_data(F.lit(value))) == label


def test_languages(spark):
    rows = spark.createDataFrame([("需求说明",), ("plain",), ("修改 QueryDetail",), ("123",)], "t string")
    assert [r.x for r in rows.select(text.language(F.col("t")).alias("x")).collect()] == ["zh", "en", "mixed", "en"]


def test_cycles_end_and_caps_are_told(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2"), ("b", "c", "3"), ("a", "d", "4")], "caller string, callee string, row_id string")
    found = graph.expand(edges, spark.createDataFrame([("a", "a")], "root string, node string"), 2, 10).collect()
    assert sorted((r.hop, r.caller, r.callee) for r in found) == [(1, "a", "b"), (1, "a", "d"), (2, "b", "a"), (2, "b", "c")]
    cut = graph.expand(edges, spark.createDataFrame([("a", "a")], "root string, node string"), 1, 1).collect()
    assert [(r.callee, r.truncated) for r in cut] == [("b", True)]


def test_bare_names(spark):
    methods = spark.createDataFrame([("p.A.x(int)",), ("p.A.x(long)",), ("p.A.y()",)], "method_fqn string")
    names = spark.createDataFrame([("p.A.x",), ("p.A.y",), ("p.A.z",)], "name string")
    assert {r.name: (r.method_fqn, r.n) for r in graph.bare_matches(names, methods).collect()} == {"p.A.x": (None, 2), "p.A.y": ("p.A.y()", 1), "p.A.z": (None, 0)}


def test_edge_ids(spark):
    both = [one(spark, lineage.edge_id(F.lit(a), F.lit(b), F.lit("JOIN"))) for a, b in (("x", "y"), ("y", "x"))]
    way = [one(spark, lineage.edge_id(F.lit(a), F.lit(b), F.lit("INSERT_SELECT"))) for a, b in (("x", "y"), ("y", "x"))]
    assert both[0] == both[1] and way[0] != way[1]


def test_two_edges_become_one(spark):
    edges = spark.createDataFrame([("E1", "a", "b", "JOIN", "low", 1, 1), ("E1", "a", "b", "JOIN", "medium", 1, 2)], "edge_id string, src_table string, dst_table string, relation_type string, confidence string, evidence_count int, row_id int")
    got = lineage.deduplicated(edges, spark.createDataFrame([("E1",), ("E1",)], "edge_id string")).collect()
    assert [(r.confidence, r.evidence_count) for r in got] == [("medium", 2)]


def test_exists_yields_no_where_relation(spark):
    sql = spark.createDataFrame([("t", "garbage text"), ("u", "")], "template_id string, sql_text string")
    assert lineage.equal_pairs(sql).count() == 0


def test_rank_fusion(spark):
    rows = spark.createDataFrame([("x", i + 1, d) for i, d in enumerate("ABC")] + [("y", i + 1, d) for i, d in enumerate("BAD")], "path string, rank int, doc string")
    order = [r.doc for r in fusion.rank_fusion(rows).orderBy(F.desc("score"), "doc").collect()]
    assert order[:2] == ["A", "B"] and set(order[2:]) == {"C", "D"}


def test_strong_core_falls_back_to_all(spark):
    rows = spark.createDataFrame([("k", 1, True), ("k", 2, False), ("m", 3, False)], "kind string, n int, s boolean")
    assert sorted(r.n for r in fusion.strong_core(rows, F.col("s")).collect()) == [1, 3]


def test_changes_and_plan(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "key string, digest string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "key string, digest string")
    found = changes.changes(now, before)
    assert {r.key: r.change for r in found.collect()} == {"a": "same", "b": "modified", "c": "deleted", "d": "added"}
    assert changes.plan(found, True, True).first()["mode"] == "incremental"
    assert changes.plan(found, True, False).first()["mode"] == "full"
    assert changes.plan(found.filter("change = 'same'"), True, True).first()["mode"] == "noop"


def test_gates(spark):
    counts = spark.createDataFrame([("methods", 5), ("refs", 0)], "table string, n int")
    assert changes.gates(counts, ["methods"], ["refs"], 0.0, 0.0).first()["verdict"] == "degraded"
    assert changes.gates(counts, ["refs"], [], 0.0, 0.0).first()["verdict"] == "keep_old"
    assert changes.gates(counts, ["methods"], [], 0.1, 0.0).first()["verdict"] == "ok"


def test_no_owner_is_an_error(spark):
    rows = spark.createDataFrame([("a_stage",), ("",), (None,)], "owner string")
    assert [r.owner for r in evidence.owners(rows, []).collect()] == ["A_STAGE"]
    with pytest.raises(Exception, match="no owner is left"):
        evidence.owners(rows, ["*_STAGE"]).collect()


def test_ranks_over_partitions(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)] + [(None, 200)], "v int, k int").repartition(5)
    got = sorted((r["rank"], r.v is not None, r.v) for r in search.ranked(rows, F.asc_nulls_first("v"), F.asc("k")).collect())
    assert [x[0] for x in got] == [*range(1, 103)] and [x[2] for x in got] == [None, *range(101)]
    assert search.ranked(rows.limit(0), F.asc("v")).count() == 0


def test_a_hot_tag_keeps_all_its_terms(spark):
    n = 1_000_005
    rows = spark.range(n).selectExpr("'t' as tag", "cast(id as string) as term", "id as at")
    r = cases.synonym_pool(rows, "tag", "term", "at").selectExpr("canonical", "size(split(variants, ',')) as n", "right(variants, 7) as last").first()
    assert (r.canonical, r.n, r.last) == ("0", n - 1, "1000004")
    assert cases.synonym_pool(rows.limit(1), "tag", "term", "at").first().variants == ""


def test_cases_are_merged(spark):
    rows = spark.createDataFrame([("c", "dev", "ops", 1), ("c", "dev", "qa", 3), ("c", "host", "ops", 2)], "case string, kind string, role string, day int")
    r = cases.merged(rows, "case", "kind", "role", "day").first()
    assert (r.confirmations, r.by_kind, r.roles, r.last_day) == (3, "dev:2,host:1", "ops,qa", 3)


def test_last_and_first(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "key string, value string, n int")
    assert config.last_wins(rows, "key", "value", "n").first()["value"] == "b"
    assert config.first_wins(rows, ["key"], ["n"]).first()["value"] == "a"


def test_read_slice(spark):
    lines = text.lines_of(spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id long, text string"))
    r = search.read_slice(lines, F.lit(2), F.lit(4), 2).first()
    assert (r.source, r.truncated) == ("b\nc", True)


def test_text_without_marks_is_one_segment():
    assert [r["row"] for r in requirements.segments_of("no marks\n10 Jan 2026 here\nBatch run")] == [0]


def test_low_confidence_fallback():
    rows = requirements.segments_of("1. a\n9. far away")
    assert [(r["label"], r["confidence"]) for r in rows[1:]] == [("1", "high"), ("9", "low")]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.read("t", "a int").count() == 0
    with pytest.raises(LookupError):
        store.read("t")
    store.replace({"t": spark.range(3)})
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.replace({"t": bad})
    assert store.read("t").count() == 3
    store.replace({"t": spark.range(5)})
    assert store.read("t").count() == 5 and len(store.history()) == 2


def test_rows_of_other_columns(spark):
    a, b = spark.createDataFrame([(1, None)], "id int, owner string"), spark.createDataFrame([(2,)], "id int")
    got = normalised([a, b], {"owner": "", "n": 0}).orderBy("id").collect()
    assert [(r.id, r.owner, r.n) for r in got] == [(1, "", 0), (2, "", 0)]


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.sql").write_text("select 1\nfrom x")
    rows = files.read_files(spark, str(tmp_path), "*.sql").collect()
    assert [(r.path.endswith("m/a.sql"), r.content) for r in rows] == [(True, "select 1\nfrom x")]


def test_a_changing_statement_is_refused(spark):
    with pytest.raises(ValueError, match="SELECT"):
        files.bounded_query(spark, "jdbc:x", "delete from t", ["jdbc:x"])
    with pytest.raises(ValueError, match="production"):
        files.bounded_query(spark, "jdbc:x//PROD1/db", "select 1", ["jdbc:x//PROD1/db"])


def test_the_rest_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_masks_keep_a_tokens_last_four(spark):
    assert one(spark, mask.redacted(F.lit("key sk-abcdefgh1234 and scott/tiger@db1 or x://u:p@h pwd = a;b"))) == "key ****1234 and ****@db1 or x://****@h pwd =****;b"
    assert one(spark, mask.redacted(F.lit(None).cast("string"))) == ""
    assert one(spark, mask.prompt_redacted(F.lit("Bearer abcdefgh x"))) == "Bearer **** x"
    assert one(spark, mask.sanitized_text(F.lit('a=b token: "abcdef" s=\'pin=9\' n=pin=12345'))) == "a=b token=****cdef s='pin=****' n=pin=****2345"


def test_no_value_leaves_with_a_view(spark):
    rows = spark.createDataFrame([(1, ("a", None), [("", "x")]), (2, None, None)], "id int, s struct<name:string,value_raw:string>, l array<struct<content_raw:string,b:string>>")
    assert mask.without_values(rows).count() == 2
    leaking = spark.createDataFrame([(1, [("secret", "x")])], "id int, l array<struct<content_raw:string,b:string>>")
    with pytest.raises(Exception, match="raw value"):
        mask.without_values(leaking).collect()


def test_gates_of_queries(spark):
    assert one(spark, files.readonly(F.lit(None).cast("string"))) is False
    assert one(spark, files.refused_instance(F.lit(None).cast("string"), ["a"])) == "not allowed"
    allowed = lambda sql: one(spark, files.readonly(F.lit(sql)))
    assert not allowed("WITH x AS (SELECT 1) EXEC p") and not allowed("select 1 from t begin") and not allowed("select 1; select 2")
    assert allowed("SELECT LISTAGG(a, ',' ON OVERFLOW TRUNCATE) FROM t;")
    rows = spark.range(5)
    assert [r.truncated for r in files.capped(rows, 3).collect()] == [True] * 3
    assert [r.truncated for r in files.capped(rows, 5).collect()] == [False] * 5 and files.capped(rows.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="not allowed"):
        files.bounded_query(spark, "jdbc:x//h/test", "select 1", ["jdbc:y"])


def test_rules_of_texts(spark):
    assert one(spark, text.normalised_table(F.lit(" t_202401_3"))) == "T"
    assert one(spark, text.slug(F.lit("--Ünï  Code!! x"))) == "n-code-x" and one(spark, text.slug(F.lit(None).cast("string"))) == "run"
    assert one(spark, text.compatible(F.lit("Ｏ ﬃ\tX"))) == "offix"
    assert [one(spark, text.is_pointer(F.lit(p))) for p in ("fqn:a.B.c(int)", "fqn:a;b", "table:A.B", "table:A", "config:a.b", "config:a\nb", None)] == [True, False, True, False, True, False, False]
    assert one(spark, text.is_stale(F.lit(None).cast("string"), F.lit("2026-01-01T00:00:00"), 1)) and one(spark, text.is_stale(F.lit("no date"), F.lit("2026-01-01T00:00:00"), 1))
    assert not one(spark, text.is_stale(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T00:30:00Z"), 1)) and one(spark, text.is_stale(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T00:30:00"), 1))


def test_segment_marks():
    marks = lambda body: [(r["label"], r["style"]) for r in requirements.segments_of(body)[1:]]
    assert marks("1】 a\n2】 b") == [("1", "arabic"), ("2", "arabic")]
    assert marks("(1) a") == [] and marks("123. a") == [] and marks("1; a") == []
    assert marks("I. a\nII. b") == [("I", "roman_upper"), ("II", "roman_upper")] and marks("i. a\nii. b") == [("i", "letter_lower")]


def test_one_builder_at_a_time(spark, tmp_path):
    lock = f"file://{tmp_path}/lock"
    with builds.single_flight(spark, lock) as first:
        with builds.single_flight(spark, lock) as second:
            assert first and not second
    with builds.single_flight(spark, lock) as third:
        assert third


def test_steps_fail_apart(spark):
    def broken():
        raise LookupError("no table")

    rows = {r.dimension: (r.status, r.n, r.verdict) for r in builds.initialised(spark, {"code": lambda: spark.range(3), "config": broken, "corpus": lambda: spark.range(0)}).collect()}
    assert rows == {"code": ("ok", 3, "degraded"), "config": ("failed", 0, "degraded"), "corpus": ("degraded", 0, "degraded")}


def test_row_sets_of_an_index(spark):
    rows = spark.createDataFrame([("a#b()", "T1"), (None, "T2"), ("a#b()", "T1")], "methodFqn string, tableName string")
    assert [tuple(r) for r in evidence.index_table(rows, "table_refs").collect()] == [("a.b()", "T1")]
    assert evidence.index_table(spark.createDataFrame([("x.Y",)], "class_fqn string"), "classes").first().start_line == 0


def test_references_without_a_class(spark):
    rows = spark.createDataFrame([("a.java", 'x.getProperty("k");'), ("b.java", None), ("c.java", "")], "path string, content string")
    assert [(r.ref_key, r.line, r.class_fqn) for r in evidence.config_references(rows).collect()] == [("k", 1, "")]


def test_candidates_either_way(spark):
    edges = spark.createDataFrame([("ORDERS", "", 2), ("orders_hist", "X", 1), (None, "ORDERS", 1)], "src_table string, dst_table string, evidence_count long")
    terms = spark.createDataFrame([("order",), ("my_x_table",), (None,)], "term string")
    assert sorted((r.term, r.table, r.evidence_count) for r in evidence.table_candidates(terms, edges).collect()) == [("my_x_table", "X", 1), ("order", "ORDERS", 3), ("order", "orders_hist", 1)]
