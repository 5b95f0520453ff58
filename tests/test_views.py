"""Every view over the driver tables keeps all rows of its source (no subsets, no caps)."""

from kernelspark.plans import views as V

SF = "/root/testdata/sf0.01"


def test_views_cover_whole_tables(spark):
    n = {t: V.table(spark, SF, t).count() for t in ("lineitem", "events", "embeddings", "labels", "orders")}
    assert V.preds(spark, SF).count() == n["lineitem"]
    assert V.preds2(spark, SF).count() == n["events"]
    assert V.methods(spark, SF).count() == 2 * n["events"]
    assert V.emb(spark, SF).count() == n["embeddings"]
    assert V.draws(spark, SF).count() == V.N_DRAWS * n["embeddings"]
    assert V.chain(spark, SF).count() == n["events"]
    assert V.trials(spark, SF).count() == n["orders"]
    assert V.manifest(spark, SF).count() == n["labels"]
    assert V.regress(spark, SF).count() == n["lineitem"]
    assert V.history(spark, SF).count() == n["orders"]
