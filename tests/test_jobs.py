"""Raw CSV files through all batch stages, on a small made-up shop."""

import csv

import pytest

from orderloom import jobs
from orderloom.operators import quality
from orderloom.sources import files


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    words = ["entrega rapida, recomendo", 'produto "quebrado"\nnao gostei', "chegou atrasado, pessimo", "otimo produto bom"]
    n = 40
    tables = {
        "customers": [["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"]]
        + [[f"c{i}", f"u{i % 30}", 1000 + i % 4, "rio", ("RJ", "SP")[i % 2]] for i in range(n)],
        "geolocation": [["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"]]
        + [[1000, lat, -43.0, city, "RJ"] for lat, city in ((1.0, "rio"), (1.0, "rio"), (2.0, "niteroi"), (6.0, "rio"))],
        "orders": [["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]]
        + [[f"o{i}", f"c{i}", "delivered" if i % 5 else "shipped", f"2018-0{1 + i % 3}-05 10:00:00", "", "",
            f"2018-0{1 + i % 3}-{20 + i % 5} 12:00:00" if i % 5 else "", f"2018-0{1 + i % 3}-22 00:00:00"] for i in range(n)],
        "items": [["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"]]
        + [[f"o{i}", k + 1, f"p{(i + k) % 6}", f"s{i % 3}", "2018-01-10 00:00:00" if i % 7 else "soon", 10.5 + i, 2.25]
           for i in range(n - 2) for k in range(1 + i % 2)],
        "payments": [["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"]]
        + [[f"o{i}", s, t, s, v] for i in range(n) for s, t, v in ((1, "voucher", 5.0), (2, "credit_card", 5.0 + i % 2))],
        "reviews": [["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
                     "review_creation_date", "review_answer_timestamp"]]
        + [[f"r{i}", f"o{i}", 1 + i % 5, "", words[i % 4] if i % 6 else "", "2018-02-01 00:00:00", "never"] for i in range(n)],
        "products": [["product_id", "product_category_name", "product_name_lenght", "product_description_lenght", "product_photos_qty",
                      "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]]
        + [[f"p{i}", ("brinquedos", "pc_gamer", "")[i % 3], *[1] * 7] for i in range(6)],
        "sellers": [["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]]
        + [[f"s{i}", 1000, "rio", "RJ"] for i in range(3)],
        "translation": [["product_category_name", "product_category_name_english"], ["brinquedos", "toys"]],
    }
    paths = {}
    for name, rows in tables.items():
        paths[name] = str(folder / f"{name}.csv")
        with open(paths[name], "w", newline="", encoding="utf-8") as handle:
            csv.writer(handle).writerows(rows)
    return paths


@pytest.fixture(scope="module")
def star(spark, raw, tmp_path_factory):
    return jobs.build_star(spark, raw, str(tmp_path_factory.mktemp("star")))


def test_star_tables(star):
    assert star.orders.count() == 40 and star.reviews.count() == 40
    categories = {r.product_id: r.category for r in star.products.collect()}
    assert categories == {"p0": "toys", "p1": "pc_gamer", "p2": "unknown", "p3": "toys", "p4": "pc_gamer", "p5": "unknown"}
    geo = star.raw("dim_geolocation").collect()
    assert [(r.zip_code_prefix, r.lat, r.city) for r in geo] == [(1000, 2.0, "rio")]
    assert star.raw("fact_order_reviews").where("review_answer_timestamp is not null").count() == 0
    payments = {r.order_id: (r.payment_type, r.payment_value) for r in star.payments_raw.collect()}
    assert payments["o0"][0] == "voucher" and payments["o1"][0] == "credit_card" and float(payments["o1"][1]) == 11.0
    assert star.reviews.where("review_comment_message like '%\n%'").count() > 0


def test_features_have_one_row_per_order(star):
    features = jobs.build_features(star)
    assert features.count() == 40 and len(features.columns) == 20
    rows = {r.order_id: r for r in features.collect()}
    assert rows["o0"].delivery_delay_days is None and rows["o0"].is_delay_outlier is False
    assert rows["o1"].delivery_delay_days == -0.5 and rows["o39"].order_total_value is None
    assert rows["o1"].is_interstate_order and not rows["o2"].is_interstate_order


def test_reviews_and_analysis(star, tmp_path):
    scored = jobs.score_reviews(star, stop_words=["e", "o"], topic_count=3, min_df=2, max_iter=5)
    assert len(scored.columns) == 14 and scored.count() == star.reviews.where("review_comment_message is not null").count()
    assert quality.key_violations(scored, ["review_id", "order_id"]).count() == 0
    results = jobs.analyse(star, str(tmp_path / "out"), min_category=2, min_seller=2)
    months = results["agg_monthly"].collect()
    reviewed = scored.join(star.items.select("order_id").distinct(), "order_id").count()
    assert sum(r.review_count for r in months) == reviewed
    assert all(0 <= r.late_delivery_rate <= 1 for r in months)
    assert sum(r.review_count for r in results["agg_category"].collect()) >= reviewed
    for row in results["complaint_matrix"].collect():
        assert all(0 <= row[c] <= 1 for c in row.asDict() if c != "category")
    tests = results["statistics"].collect()
    assert {"correlations", "ontime_vs_late", "price_bands", "logistic_regression"} == {r.section for r in tests}
    assert all(r.p_value is None or 0 <= r.p_value <= 1 for r in tests)
    sides = {r.name: r.n for r in tests if r.section == "ontime_vs_late"}
    assert sides["on time"] + sides["late"] == sides["Mann-Whitney U"] > 0
    assert sum(r.n for r in results["late_by_category"].collect()) > 0 and results["commercial_exposure"].count() == 1
    assert all((tmp_path / "out" / name / "_SUCCESS").exists() for name in results)
    again = jobs.build_features(star, if_missing=True)
    assert again.count() == 40


def test_csv_cannot_be_misread(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_csv(spark, str(tmp_path / "swapped.csv"), "a int, b int").collect()
    (tmp_path / "odd.csv").write_text("a,b\n1,2\nx,3\n4\n5,6,7\n8,9\n")
    found = files.bad_rows(spark, {"odd": (str(tmp_path / "odd.csv"), "a int, b int")}).first()
    assert (found.source, found["rows"], found.bad) == ("odd", 5, 3)


def test_half_written_tables_are_written_again(spark, tmp_path):
    frame = spark.range(5)
    path = files.write_parquet_set({"t": frame}, str(tmp_path))["t"]
    assert files.is_complete(spark, path)
    files.write_parquet_set({"t": spark.range(9)}, str(tmp_path), "ignore")
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t" / "_SUCCESS").unlink()
    files.write_parquet_set({"t": spark.range(9)}, str(tmp_path), "ignore")
    assert spark.read.parquet(path).count() == 9
