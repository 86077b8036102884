"""Small inputs are spread over the cores; large ones stay as they are."""

from lexigrid.plans.spread import spread


def test_spread(spark):
    few, many = spark.range(10).coalesce(1), spark.range(0, 100, 1, 32)
    assert spread(few).rdd.getNumPartitions() >= 4 and spread(few).count() == 10
    assert spread(many).rdd.getNumPartitions() == 32


def test_ship(spark):
    from lexigrid.sources.ship import ROOT, ship

    ship(spark)
    ship(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(ROOT) == 1
