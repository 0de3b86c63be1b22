"""Sources and sinks: CSV uploads, type inference, imputation, generator, registry, stream."""

import os

import pytest
from pyspark.sql import functions as F

from churnscope.functions.status import STATUS_CLASS
from churnscope.operators import filters, kpis, preprocess, profile
from churnscope.plans import catalog as C
from churnscope.sources import files, generator, registry
from conftest import SF_SMALL


def test_csv_roundtrip_with_na_tokens_and_inference(spark, tmp_dir):
    raw = C.raw(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "upload")
    raw.coalesce(2).write.option("header", True).csv(path)
    back = files.read_customers(spark, path)
    assert back.count() == raw.count()
    assert back.where(F.col("MonthlyRevenue") == "N/A").count() == 0  # NA token -> null
    typed = files.read_customers(spark, path, infer=True)
    types = dict(typed.dtypes)
    assert types["UsageFrequency"] == "bigint" and types["TenureMonths"] == "double"
    assert types["SupportTickets"] == "double" and types["MonthlyRevenue"] == "string"
    filled = files.impute_mean(typed)
    assert filled.where(F.col("TenureMonths").isNull() | F.col("SupportTickets").isNull()).count() == 0
    typed2, means = files.infer_types(files.read_customers(spark, path), with_means=True)
    assert typed2.dtypes == typed.dtypes
    separate = typed.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    assert means == pytest.approx(separate, rel=1e-12)
    fused = files.impute_mean(typed2, means=means)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, filled.collect()))
    # The cleaned upload gives the same KPI row as the parquet-derived table.
    a = kpis.kpis(preprocess.preprocess(back)).first()
    b = kpis.kpis(C.cleaned(spark, SF_SMALL)).first()
    assert a == b


def test_csv_quotes_and_line_breaks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "q.csv")
    with open(path, "w") as f:
        f.write('id,note,mrr\n1,"say ""hi"", ok",5\n2,"two\nlines",7\n')
    rows = files.read_customers(spark, path, multiline=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", ok', "5"), ("2", "two\nlines", "7")]


def test_imputation_of_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 5, "x"), (None, float("nan"), 6, None), (4, None, 7, "y")],
                               "a bigint, b double, c int, t string")
    out = files.impute_mean(df)
    assert dict(out.dtypes) == {"a": "double", "b": "double", "c": "int", "t": "string"}
    assert [tuple(r) for r in out.collect()] == [(1.0, 2.0, 5, "x"), (2.5, 2.0, 6, None), (4.0, 2.0, 7, "y")]
    typed, means = files.infer_types(df, with_means=True)
    assert files.impute_mean(typed, means=means).collect() == out.collect()


def test_generator_ranges_and_shares(spark):
    g = generator.generate_customers(spark, 5000, seed=42)
    rows = g.collect()
    assert len(rows) == 5000 and len({r.CustomerID for r in rows}) == 5000
    plans = {p: sum(r.PlanType == p for r in rows) / 5000 for p in generator.PLANS}
    assert abs(plans["Starter"] - 0.6) < 0.03 and abs(plans["Enterprise"] - 0.1) < 0.02
    for r in rows:
        assert 1 <= r.UsageFrequency <= 30 and 0 <= r.SupportTickets <= 10
        assert 0 <= r.LastLoginDaysAgo <= 44 and r.TenureMonths >= 1
        assert r.Status in ("Active", "Churned")
        assert r.LTV == pytest.approx(round(r.MonthlyRevenue * r.TenureMonths, 2), abs=0.011)
    again = generator.generate_customers(spark, 5000, seed=42, num_partitions=7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert set(preprocess.preprocess(g).columns) >= set(C.ROLES)


def test_registry_replace_and_missing(spark):
    owner = f"user-{os.getpid()}"
    g = generator.generate_customers(spark, 50)
    got = registry.register_dataset(spark, g, owner=owner)
    assert got.count() == 50
    registry.register_dataset(spark, g.limit(10), owner=owner)
    assert registry.get_dataset(spark, owner=owner).count() == 10
    with pytest.raises(registry.NoDatasetError):
        registry.get_dataset(spark, owner=owner + "-nobody")


def test_registry_names_and_self_overwrite(spark):
    tag = f"{os.getpid()}"
    g = generator.generate_customers(spark, 20)
    registry.register_dataset(spark, g, owner=f"ann+{tag}@x.io")
    registry.register_dataset(spark, g.limit(5), owner=f"ann_{tag}@x.io")
    mine = registry.get_dataset(spark, owner=f"ann+{tag}@x.io")
    assert mine.count() == 20  # the other owner's folder is another one
    some = mine.where("TenureMonths > 3")
    n = some.count()
    registry.register_dataset(spark, some, owner=f"ann+{tag}@x.io")  # derived from what it replaces
    assert registry.get_dataset(spark, owner=f"ann+{tag}@x.io").count() == n
    for name in ("", ".", ".."):
        with pytest.raises(ValueError):
            registry.dataset_path(spark, name)


def test_profile_and_preview(spark):
    raw = C.raw(spark, SF_SMALL)
    p = profile.profile(raw).first()
    assert p.rows == raw.count() and p.n_columns == 11
    prev = profile.preview(raw).collect()
    assert len(prev) == 5 and [r.CustomerID for r in prev] == sorted(r.CustomerID for r in prev)


def test_map_columns_errors_and_independent_roles(spark):
    df = spark.createDataFrame([("a", "5")], "id string, n string")
    with pytest.raises(preprocess.MappingError):
        preprocess.map_columns(df, {"CustomerID": "id"})
    m = {r: "n" for r in C.ROLES}
    m["CustomerID"] = "id"
    out = preprocess.preprocess(df, m).first()
    assert out.MonthlyRevenue == 5.0 and out.TenureMonths == 5 and out.Status == "5"


def test_quality_report_counts(spark):
    q = {r.role: r for r in preprocess.quality_report(C.raw(spark, SF_SMALL)).collect()}
    raw = C.raw(spark, SF_SMALL)
    assert q["MonthlyRevenue"].coerced_count == raw.where("MonthlyRevenue = 'N/A'").count()
    assert q["CAC"].null_count == raw.where("CAC IS NULL").count()
    assert q["SupportTickets"].coerced_count == raw.where("SupportTickets = 'nan'").count()
    assert q["SignupDate"].coerced_count == raw.where("SignupDate = 'unknown'").count()


def test_stream_kpis_per_upload(spark, tmp_dir):
    from churnscope.streaming.uploads import kpis_per_upload
    g = generator.generate_customers(spark, 300)
    src = os.path.join(tmp_dir, "uploads")
    os.makedirs(src)
    for i, part in enumerate([g.limit(100), g.subtract(g.limit(100))]):
        part.coalesce(1).write.option("header", True).csv(os.path.join(tmp_dir, f"stage{i}"))
        f = [x for x in os.listdir(os.path.join(tmp_dir, f"stage{i}")) if x.endswith(".csv")][0]
        os.link(os.path.join(tmp_dir, f"stage{i}", f), os.path.join(src, f"upload{i}.csv"))
    out = os.path.join(tmp_dir, "kpis")
    q = kpis_per_upload(spark, src, out, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.total_customers for r in rows) == [100, 200]
    assert sum(r.active_count for r in rows) == g.where("Status = 'Active'").count()


def test_cluster_conf_sizing():
    from churnscope.session import cluster_conf
    c = cluster_conf(11e12, 16000)
    assert int(c["spark.sql.shuffle.partitions"]) == 48000
    small = cluster_conf(1e9, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # three waves of 8 cores


def test_registry_status_partitions_prune_and_agree(spark):
    from churnscope.operators import filters, kpis as K
    clean = C.cleaned(spark, SF_SMALL)
    reg = registry.register_dataset(spark, clean, name="parts", owner=f"p-{os.getpid()}", by_status=True)
    act = filters.active_filter(reg)
    plan = act._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(churnscope_status_class" in plan and "active" in plan
    assert act.count() == filters.active_filter(clean).count()
    assert filters.churned_filter(reg).count() == filters.churned_filter(clean).count()
    a = K.kpis(reg).first()
    b = K.kpis(clean).first()
    assert a == b


def test_stream_restart_is_exactly_once(spark, tmp_dir):
    from churnscope.streaming.uploads import kpis_per_upload
    g = generator.generate_customers(spark, 120)
    src = os.path.join(tmp_dir, "uploads")
    os.makedirs(src)

    def drop(i, df):
        stage = os.path.join(tmp_dir, f"stage{i}")
        df.coalesce(1).write.option("header", True).csv(stage)
        f = [x for x in os.listdir(stage) if x.endswith(".csv")][0]
        os.link(os.path.join(stage, f), os.path.join(src, f"upload{i}.csv"))

    out, ckpt = os.path.join(tmp_dir, "kpis"), os.path.join(tmp_dir, "ckpt")
    drop(0, g.limit(50))
    kpis_per_upload(spark, src, out, ckpt).awaitTermination(120)
    kpis_per_upload(spark, src, out, ckpt).awaitTermination(120)   # restart: nothing new
    assert sorted(r.total_customers for r in spark.read.parquet(out).collect()) == [50]
    drop(1, g.subtract(g.limit(50)))
    kpis_per_upload(spark, src, out, ckpt).awaitTermination(120)
    assert sorted(r.total_customers for r in spark.read.parquet(out).collect()) == [50, 70]


def test_checkpoint_dir_refuses_local_fallback_on_a_cluster():
    from churnscope.session import checkpoint_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

        def set(self, k, v):
            self[k] = v

    class Ctx:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Ctx()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
    shared = Session()
    shared.conf = Conf({"spark.checkpoint.dir": "/shared/ckpt"})
    shared.sparkContext.setCheckpointDir = lambda p: None
    assert checkpoint_dir(shared) == "/shared/ckpt"


def test_reserved_status_class_column_is_refused(spark):
    """An upload cannot bring its own status class; a column of another name changes no filter."""
    df = spark.createDataFrame([tuple("Active" if r == "Status" else "1" for r in C.ROLES) + ("churned",)],
                               ", ".join(f"{r} string" for r in C.ROLES) + ", status_class string")
    assert filters.active_filter(preprocess.preprocess(df)).count() == 1
    with pytest.raises(preprocess.MappingError, match="reserved"):
        preprocess.preprocess(df.withColumnRenamed("status_class", STATUS_CLASS))


def test_versions_are_numbered_and_vacuumed(spark, tmp_dir):
    from churnscope.sources import versions

    path = tmp_dir + "/store"
    assert versions.vacuum(spark, path) == [] and versions.current(spark, path) is None
    for i in range(4):
        v = versions.new_version(spark, path)
        spark.range(i + 1).write.parquet(v)
        if i != 1:  # one write was never announced
            versions.announce(spark, path, v)
    names = versions.versions(spark, path)
    assert [int(n[1:21]) for n in names] == [1, 2, 3] and spark.read.parquet(versions.current(spark, path)).count() == 4
    running = versions.new_version(spark, path)
    spark.range(9).write.parquet(running)
    gone = versions.vacuum(spark, path, keep=1)
    assert len(gone) == 3 and set(names[:2]) <= set(gone)
    assert spark.read.parquet(versions.current(spark, path)).count() == 4 and spark.read.parquet(running).count() == 9
