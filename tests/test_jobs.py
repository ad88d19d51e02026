import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from burnish import plans
from burnish.rules import Synonyms
from burnish.sources import current_reports, load_table, read_raw

MATERIALS_CSV = os.environ.get("MATERIALS_CSV")

# Recounted by hand from a raw material file of 500 rows: products, invalid prices, mean of valid prices,
# mean of all prices.
MATERIAL_FIGURES = {
    "clothing": (69, 7, 27983.93, 26687.75),
    "kitchen": (68, 7, 26210.03, 25374.79),
    "beauty": (60, 4, 42517.30, 41047.74),
    "home": (59, 3, 25168.24, 24724.93),
    "electronics": (57, 8, 43829.68, 39037.35),
    "toys": (53, 7, 21091.39, 19793.95),
    "automotive": (52, 4, 37303.07, 35102.89),
    "sports": (52, 3, 26169.03, 25643.65),
    "(unmapped)": (30, 9, 28554.42, 23043.95),
}


@pytest.mark.skipif(MATERIALS_CSV is None, reason="MATERIALS_CSV names no file")
def test_known_figures(spark):
    materials = plans.clean_materials(read_raw(spark, MATERIALS_CSV))
    found = {r[0]: tuple(r[1:]) for r in plans.material_quality_by_category(materials).collect()}
    assert found == MATERIAL_FIGURES
    assert tuple(plans.material_clean_rate(materials).first()) == (500, 30, 52, 85.4)


def test_from_files_to_reports(spark, tmp_path):
    db = f"shop_{abs(hash(tmp_path))}"
    files = {
        "customers": "customer_id,first_name,last_name,email,phone_number,device_id(s)\n"
        "c1,ann ,LEE,a@x.org,+1 555-010-0042x7,d1;d2\nc1,zed,LEE,,,\nc2, bob,ray,,123,d3\n",
        "materials": "product_id,product_name,category,price\np1,Ball,t0ys,\"1,200\"\np2,Pan,KIT,-100\np3,Hat,,NaN\n",
        "orders": "order_id,customer_id,product_id,payment_method,status,order_date,order_amount\n"
        'o1,c1,p1,Crd,SUC,2023-05-01,"1,000.50"\no2,c9,p2,e-wall,pending,31-12-2023,nan\n'
        "o3,c2,p3,x,ref,,20\no4,,p9,UPI,fail,2023/05/01 10:30,5\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)

    customers = plans.load_customers(spark, str(tmp_path / "customers.csv"), db, ["first_name"])
    materials = plans.load_materials(spark, str(tmp_path / "materials.csv"), db)
    orders = plans.load_orders(spark, str(tmp_path / "orders.csv"), db)
    assert [tuple(r) for r in customers.orderBy("customer_id").select(
        "customer_id", "first_name", "last_name", "email_missing", "phone_clean", "device_count", "primary_device_id",
        "source_rows").collect()] == [
        ("c1", "Ann", "Lee", False, "5550100042", 2, "d1", 2), ("c2", "Bob", "Ray", True, "123", 1, "d3", 1)]
    assert customers.schema["device_list"].dataType.simpleString() == "array<string>"
    assert [tuple(r) for r in materials.orderBy("product_id").select(
        "category_raw", "category", "category_missing", "price_str", "price_clean", "price_invalid").collect()] == [
        ("t0ys", "toys", False, "1200", 1200.0, False), ("KIT", "kitchen", False, "-100", -100.0, True),
        (None, None, True, None, None, True)]
    assert [tuple(r) for r in orders.orderBy("order_id").select(
        "payment_method_clean", "status_clean", "order_date_flag", F.col("order_date_clean").cast("string"),
        "order_amount_clean", "order_amount_missing").collect()] == [
        ("card", "success", "ok", "2023-05-01", 1000.5, False), ("wallet", None, "sentinel_placeholder", None, None, True),
        (None, "refunded", "missing", None, 20.0, False), ("upi", "failed", "ok", "2023-05-01", 5.0, False)]
    assert [tuple(r) for r in plans.order_integrity(orders, customers, materials).collect()] == [
        ("orphaned_customer_refs", 2), ("orphaned_product_refs", 1)]

    metrics = load_table(spark, db, "load_metrics")
    assert [tuple(r) for r in plans.loaded_rows(metrics).collect()] == [
        ("customer_master", 3, 2, 1), ("material_master", 3, 3, 0), ("orders_fact", 4, 4, 0)]
    assert [tuple(r) for r in plans.loaded_unmapped(metrics).collect()] == [
        ("material_master", "category", 1), ("orders_fact", "payment_method_clean", 1), ("orders_fact", "status_clean", 1)]
    assert [tuple(r) for r in plans.loaded_dates(metrics).collect()] == [tuple(r) for r in plans.parse_success(orders).collect()]
    assert [tuple(r) for r in plans.loaded_orphans(metrics).collect()] == [
        ("orphaned_customer_refs", 2), ("orphaned_product_refs", 1)]

    plans.quality_reports(spark, db, str(tmp_path / "reports"))

    def report(name):
        (part,) = Path(current_reports(spark, str(tmp_path / "reports")).path(name)).glob("part-*.csv")
        return part.read_text().splitlines()

    assert report("customer_quality_summary")[1] == "2,1,50.0,1,1.5"
    assert report("material_quality_by_category")[1:] == [
        "(unmapped),1,1,,", "kitchen,1,1,,-100.0", "toys,1,0,1200.0,1200.0"]
    assert report("orders_date_quality")[1:] == ["ok,2,50.0", "missing,1,25.0", "sentinel_placeholder,1,25.0"]
    assert report("orders_payment_distribution")[1:] == [",1", "card,1", "upi,1", "wallet,1"]
    assert report("orders_status_distribution")[1:] == [",1", "failed,1", "refunded,1", "success,1"]
    assert report("revenue_by_category")[1:] == ["toys,1,1000.5,1000.5", ",1,20.0,20.0"]
    assert report("payment_status_crosstab")[1:] == [
        ",refunded,1", "card,success,1", "upi,failed,1", "wallet,,1"]
    assert report("reconciliation_summary")[1:] == [
        "customer_master,duplicate_ids_removed,1", "customer_master,missing_email,1",
        "material_master,category_unmapped,1", "material_master,invalid_price,2",
        "orders_fact,missing_date,1", "orders_fact,missing_order_amount,1", "orders_fact,sentinel_placeholder_date,1"]
    assert load_table(spark, db, "orders_summary").count() == 4


def test_a_repeated_key_leaves_the_duplicate_report_alone(spark, tmp_path):
    db = f"twice_{abs(hash(tmp_path))}"
    files = {
        "customers": "customer_id,first_name,last_name,email,phone_number,device_id(s)\nc1,a,b,,,\n",
        "materials": "product_id,product_name,category,price\np1,Ball,Hand Tools,?\np1,Ball,hand-tools,2\n",
        "orders": "order_id,customer_id,product_id,payment_method,status,order_date,order_amount\no1,c1,p2,cash,won,1.5.2023,3\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    plans.load_customers(spark, str(tmp_path / "customers.csv"), db, ["email"], key="customer_id", separator="|")
    materials = plans.load_materials(
        spark, str(tmp_path / "materials.csv"), db, vocabulary=["Hand Tools", "Garden"], missing_tokens=["?"]
    )
    assert {tuple(r) for r in materials.select("category", "price_clean").collect()} == {("Hand Tools", None), ("Hand Tools", 2.0)}
    orders = plans.load_orders(
        spark, str(tmp_path / "orders.csv"), db, statuses=[Synonyms("success", equals=("won",))], date_formats=["d.M.yyyy"]
    )
    assert [(r.status_clean, str(r.order_date_clean)) for r in orders.collect()] == [("success", "2023-05-01")]
    with pytest.raises(ValueError, match="material_master.*1"):
        plans.quality_reports(spark, db, str(tmp_path / "reports"))
    assert [p.name for p in (tmp_path / "reports").iterdir()] == ["duplicate_keys"]


ORDERS = "order_id,customer_id,product_id,payment_method,status,order_date,order_amount\n"


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_orders_are_checked_while_they_are_loaded(spark, conf, tmp_path, threshold):
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    db = f"marks_{abs(hash(tmp_path))}_{threshold.strip('-')}"
    lines = [f"o{k},{('c0', 'c1', '', 'gone')[k % 4]},{'p0' if k % 3 else 'p9'},card,success,2023-05-01,1\n" for k in range(600)]
    (tmp_path / "orders.csv").write_text(ORDERS + "".join(lines))
    (tmp_path / "empty.csv").write_text(ORDERS)
    (tmp_path / "customers.csv").write_text(
        "customer_id,first_name,last_name,email,phone_number,device_id(s)\nc0,a,b,,,\nc0,a,c,,,\nc1,a,b,,,\n,x,y,,,\n")
    (tmp_path / "materials.csv").write_text("product_id,product_name,category,price\np0,a,toys,1\np0,b,toys,1\n,c,toys,1\n")

    def orphans(file):
        orders = plans.load_orders(spark, str(tmp_path / file), db)
        assert not {"orphaned_customer_refs", "orphaned_product_refs"} & set(orders.columns)
        return orders.count(), {r[0]: r[1] for r in plans.loaded_orphans(load_table(spark, db, "load_metrics")).collect()}

    assert orphans("orders.csv") == (600, {})  # no masters yet
    plans.load_customers(spark, str(tmp_path / "customers.csv"), db, ["email"])
    assert orphans("orders.csv") == (600, {"orphaned_customer_refs": 300})
    plans.load_materials(spark, str(tmp_path / "materials.csv"), db)
    assert orphans("orders.csv") == (600, {"orphaned_customer_refs": 300, "orphaned_product_refs": 200})
    assert orphans("empty.csv") == (0, {"orphaned_customer_refs": 0, "orphaned_product_refs": 0})
    assert {r[0] for r in load_table(spark, db, "load_metrics").select("table_name").distinct().collect()} == {
        "customer_master", "material_master", "orders_fact"}
