"""Golden records from bundles that are dealt by run once."""

from decimal import Decimal

from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators import golden, resolve
from kinloom.plans.queries import KEPT, dealt, kept, resolution

ROWS = "run_id long, account_key string, source string, handle string, display_name string, location string, website_url string, bio string, field_confidence decimal(6,4), relation_rank int, source_rank int, bundle_rank int"


def bundle(run, key, rank, place, site):
    return run, key, "github", "h", None, place, site, "Builds data tools, mostly", Decimal("0.5"), 1, 1, rank


def test_what_is_dealt_by_run_is_not_shuffled_again(spark):
    rows = [bundle(1, "a", 1, "Town", "https://a.dev"), bundle(1, "b", 2, "Place, X", "b.dev/x/"), bundle(1, "c", 3, "place x", "https://www.B.dev"), bundle(2, "d", 1, None, None)]
    b = dealt(spark.createDataFrame(rows, ROWS), "run_id")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    for part, told in ((golden.location, [(1, "Place, X")]), (golden.website, [(1, "https://b.dev/x")]), (golden.bio, [(1, "Builds data tools, mostly"), (2, "Builds data tools, mostly")])):
        made = part(b)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r)[:2] for r in made.collect()) == told
    assert spark.conf.get("spark.sql.adaptive.enabled") == before == "true"


def test_stages_of_a_resolution_stay_where_they_are(spark):
    r = resolution(spark, "/root/testdata/sf0.001")
    names, before = ("requests", "accounts", "evidence", "conflicts", "account_scores", "pair_scores", "decided", "bundles"), {n: spark.conf.get(n) for n in KEPT}
    for name in names:
        own = getattr(r, name)
        plan = own._jdf.queryExecution().executedPlan()
        held = [a.toString() for a in (plan.output().apply(i) for i in range(plan.output().size())) if a.name() == "run_id"]
        assert plan.outputPartitioning().toString().startswith(f"hashpartitioning({held[0]}, "), name
        assert "Exchange" not in own.groupBy("run_id").count()._jdf.queryExecution().executedPlan().toString(), name
    assert {n: spark.conf.get(n) for n in KEPT} == before


def test_rows_of_a_view_keep_how_they_are_dealt(spark):
    spark.sql("SELECT id % 3 AS k, id FROM range(30)").createOrReplaceTempView("dealt_view")
    made = dealt(spark.sql("WITH a AS (SELECT k AS run_id, id FROM dealt_view), b AS (SELECT a.* FROM a) SELECT run_id, id FROM b"), "run_id", "run_id", "id")
    both = made.join(made.select("run_id", "id", (F.col("id") + 1).alias("more")), ["run_id", "id"])
    assert made.columns == ["run_id", "id"] and sorted(map(tuple, made.collect())) == sorted((i % 3, i) for i in range(30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in made.groupBy("run_id").count()._jdf.queryExecution().executedPlan().toString()
        assert kept(both).count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_signals_are_told_without_lambdas(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b")], "run_id long, x string, y string")
    made = resolve._unpivot(df, resolve._signal("same_website", F.col("x").isNotNull(), F.col("x"), F.col("y"), F.col("x")), resolve._signal("same_location", F.col("x") > "z", F.col("x"), F.col("y"), F.col("x")))
    assert "lambda" not in made._jdf.queryExecution().analyzed().toString()
    assert [(r.run_id, r.signal, r.account_key, r.other_key) for r in made.collect()] == [(1, "same_website", "a", "b")]


def test_names_and_blanks(spark):
    given = {"Dr  Ann Lee": "ann lee", "Mr-Prof.": None, "Drew Sirius": "drew sirius", "x_dr_y": "x y", "": None, None: None, "a\nb": "a b"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.normalize_name(F.col("t"))).collect()] == list(given.values())
    assert [r[0] for r in df.orderBy("i").select(text.blank_to_null(F.col("t"))).collect()] == [t or None for t in given]
    assert "lambda" not in df.select(text.blank_to_null(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_ratios_of_handles_need_no_shuffle(spark):
    from kinloom.functions import fuzzy
    from kinloom.plans.queries import QUERIES

    made = QUERIES["handle_indel_similarity"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(1, "ab", "b"), (2, "b", "ab"), (3, None, "b"), (4, "b", None), (5, None, None), (6, "a", "a"), (7, "", ""), (8, "", "a")], "i int, a string, b string")
    got, want = fuzzy.with_indel_ratio(df, "a", "b", "ratio"), fuzzy.by_distinct_pair(df, "a", "b", fuzzy.indel_ratio, "ratio")
    assert sorted(got.collect(), key=lambda r: r.i) == sorted(want.collect(), key=lambda r: r.i)
