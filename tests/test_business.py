import datetime as dt
from decimal import Decimal

from orderloom.operators import business, explore, grain
from orderloom.sources.tables import Star

ITEMS = "order_id long, item_id int, product_id long, seller_id long, price decimal(18,2), freight_value decimal(22,4)"


def item(order, product, price):
    return (order, 1, product, 7, Decimal(price), Decimal("0.5"))


def test_revenue_by_category_groups_orders_once(spark):
    items = spark.createDataFrame([
        item(1, 10, 5), item(1, 10, 5), item(1, 11, 2), item(2, 10, 1), item(None, 10, 1), item(3, 12, 9),
        item(3, None, 9), item(4, 13, 4)], ITEMS)
    products = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None), (None, "b")], "product_id long, category string")
    found = explore.revenue_by_category(items, products)
    assert [(r.category, r.total_revenue, r.order_count, r.item_count) for r in found.collect()] == [
        ("a", 16.5, 2, 5), ("b", 9.5, 1, 1)]
    # No aggregation on (product, order), whose groups are nearly as many as the items.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [category" in plan and "Aggregate [product_id" not in plan


def test_written_review_rows_serve_every_group(spark):
    day = dt.datetime(2018, 1, 5)
    star = Star(spark, {
        "orders": spark.createDataFrame(
            [(1, 1, day, day, day), (2, 1, day, None, day), (3, None, day, day, day)],
            "order_id long, customer_id long, purchase_ts timestamp_ntz, delivered_ts timestamp_ntz, estimated_ts timestamp_ntz"),
        "customers": spark.createDataFrame([(1, "SP")], "customer_id long, state string"),
        "items": spark.createDataFrame([item(1, 10, 5), item(1, 11, 5), item(1, 12, 2), item(2, 10, 1), item(4, 10, 1)], ITEMS),
        "products": spark.createDataFrame([(10, "a"), (11, "a"), (12, None)], "product_id long, category string"),
        "scored_reviews": spark.createDataFrame(
            [(1, 1, 5, "Negative", "t", ["x"]), (2, 1, 1, "Positive", "t", ["y"]), (3, 2, None, None, None, None), (4, 3, 1, "Negative", "t", ["x"])],
            "review_id long, order_id long, review_score int, sentiment_label string, topic_label string, extracted_aspects array<string>"),
    })
    level = grain.review_level(star)
    rows = {}
    for key in ("category", "product_id", "seller_id"):
        plain = grain.review_level_by(star, key)
        rows[key] = grain.review_level_by(star, key, level)
        assert sorted(map(repr, rows[key].select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert sorted(map(repr, business.sample_size_buckets(star, rows).collect())) == sorted(
        map(repr, business.sample_size_buckets(star).collect()))
    assert sorted(map(repr, business.category_metrics(star, rows=rows["category"]).collect())) == sorted(
        map(repr, business.category_metrics(star).collect()))
