"""A small sales mart as natural-key rows, loaded through the loading operators."""

import csv
import datetime
import io

from pyspark.sql import functions as F

from tidemill.operators.loading import assign_ids, expand_price_list, resolve_keys, with_defaults

MOTORS = """\
model,family,kw,rpm,volt,nm,cooling,status,p2024,c2024,p2025,c2025,p2026,c2026,available,reserved
DS4-100-AA,DS4,7.50,3000,400,23.87,AIR,ACTIVE,2400,1650,2520,1720,2650,1810,28,5
DS4-132-AA,DS4,15.00,3000,400,47.75,WATER,ACTIVE,3250,2250,3400,2350,3550,2450,30,12
DS4-132-DD,DS4,22.00,2000,400,105.04,WATER,ACTIVE,4650,3250,4850,3400,5100,3550,14,8
DS4-132-FF,DS4,30.00,1800,400,159.15,WATER,ACTIVE,5450,3850,5700,4000,5950,4170,8,3
DS4-160-AA,DS4,37.00,1500,400,235.55,WATER,ACTIVE,6900,4900,7200,5100,7550,5350,5,2
DST3-135-CC,DST3,18.50,2000,400,88.33,WATER,ACTIVE,4300,3000,4500,3150,4700,3300,12,4
DST3-135-DD,DST3,30.00,1500,400,190.99,WATER,ACTIVE,6100,4300,6400,4500,6750,4750,9,5
DST3-135-FF,DST3,45.00,1200,400,358.10,WATER,ACTIVE,7900,5550,8250,5800,8600,6050,4,2
DS3-160-AA,DS3,22.00,1500,400,140.06,AIR,ACTIVE,4700,3300,4900,3450,5150,3620,17,6
DS3-160-FF,DS3,37.00,1500,400,235.55,AIR,ACTIVE,7100,5050,7450,5250,7800,5500,6,3
DS2-200-AA,DS2,45.00,1000,400,429.72,WATER,ACTIVE,8900,6350,9300,6600,9700,6900,3,1
DS2-200-FF,DS2,75.00,1000,400,716.20,WATER,ACTIVE,13200,9450,13800,9900,14400,10300,2,1
DSD2-100-LO,DSD2,5.50,4500,400,11.67,AIR,ACTIVE,2100,1450,2200,1520,2320,1600,35,10
DSD2-100-BO,DSD2,8.00,4000,400,19.10,AIR,ACTIVE,2650,1850,2780,1940,2920,2040,24,8
DSD2-100-XO,DSD2,10.00,3500,400,27.28,AIR,DEVELOPMENT,3150,2200,3300,2320,3500,2450,5,3
"""

CUSTOMERS = """\
customer_number,company_name,country,segment,active
CUST-001,Alpha Machines GmbH,Germany,Plastics machinery,TRUE
CUST-002,Beta Automation s.r.o.,Czechia,Automation,TRUE
CUST-003,Gamma Robotics GmbH,Austria,Robotics,TRUE
CUST-004,Delta Drives Sp. z o.o.,Poland,Drive systems,TRUE
CUST-005,Epsilon Packaging SAS,France,Packaging,TRUE
CUST-006,Zeta Handling B.V.,Netherlands,Material handling,TRUE
CUST-007,Eta Industrial Systems Ltd.,United Kingdom,Industrial systems,TRUE
CUST-008,Theta Machine Tools S.p.A.,Italy,Machine tools,TRUE
CUST-009,Iota Engineering AB,Sweden,Engineering,TRUE
CUST-010,Kappa Production s.r.o.,Slovakia,Manufacturing,TRUE
"""

ORDERS = """\
order_number,order_date,delivery_date,status,currency,customer_number
ORD-2024-001,2024-01-15,2024-02-28,DELIVERED,EUR,CUST-001
ORD-2024-002,2024-03-12,2024-04-30,DELIVERED,EUR,CUST-002
ORD-2024-003,2024-05-20,2024-07-05,DELIVERED,EUR,CUST-003
ORD-2024-004,2024-08-08,2024-09-20,DELIVERED,EUR,CUST-004
ORD-2024-005,2024-11-04,2024-12-16,DELIVERED,EUR,CUST-005
ORD-2025-001,2025-01-10,2025-02-25,DELIVERED,EUR,CUST-006
ORD-2025-002,2025-02-18,2025-04-04,DELIVERED,EUR,CUST-001
ORD-2025-003,2025-04-11,2025-05-30,DELIVERED,EUR,CUST-007
ORD-2025-004,2025-06-06,2025-07-22,DELIVERED,EUR,CUST-002
ORD-2025-005,2025-08-14,2025-10-02,DELIVERED,EUR,CUST-008
ORD-2025-006,2025-10-03,2025-11-21,DELIVERED,EUR,CUST-009
ORD-2025-007,2025-12-01,2026-01-20,CANCELLED,EUR,CUST-010
ORD-2026-001,2026-01-08,2026-02-20,DELIVERED,EUR,CUST-001
ORD-2026-002,2026-02-12,2026-03-30,DELIVERED,EUR,CUST-002
ORD-2026-003,2026-03-18,2026-05-05,DELIVERED,EUR,CUST-003
ORD-2026-004,2026-04-22,2026-06-10,CONFIRMED,EUR,CUST-004
ORD-2026-005,2026-05-15,2026-07-01,CONFIRMED,EUR,CUST-005
ORD-2026-006,2026-06-18,2026-08-15,CONFIRMED,EUR,CUST-006
ORD-2026-007,2026-07-08,2026-09-01,OPEN,EUR,CUST-007
ORD-2026-008,2026-07-22,2026-09-15,OPEN,EUR,CUST-008
"""

ITEMS = """\
quantity,delivered_quantity,unit_price,discount_percent,model,order_number
10,10,3150,3,DS4-132-AA,ORD-2024-001
5,5,4500,2,DS4-132-DD,ORD-2024-001
14,14,2320,2,DS4-100-AA,ORD-2024-002
8,8,2050,2,DSD2-100-LO,ORD-2024-002
6,6,5950,3,DST3-135-DD,ORD-2024-003
4,4,7650,4,DST3-135-FF,ORD-2024-003
7,7,4550,2,DS3-160-AA,ORD-2024-004
3,3,8650,3,DS2-200-AA,ORD-2024-004
12,12,2580,2,DSD2-100-BO,ORD-2024-005
9,9,3300,3,DS4-132-AA,ORD-2025-001
5,5,4350,3,DST3-135-CC,ORD-2025-001
16,16,3260,4,DS4-132-AA,ORD-2025-002
8,8,4680,4,DS4-132-DD,ORD-2025-002
11,11,2130,3,DSD2-100-LO,ORD-2025-003
7,7,2680,4,DSD2-100-BO,ORD-2025-003
10,10,5530,3,DS4-132-FF,ORD-2025-004
4,4,6980,3,DS4-160-AA,ORD-2025-004
6,6,6200,3,DST3-135-DD,ORD-2025-005
3,3,8050,4,DST3-135-FF,ORD-2025-005
5,5,7200,3,DS3-160-FF,ORD-2025-006
2,2,13400,3,DS2-200-FF,ORD-2025-006
20,0,3350,2,DS4-132-AA,ORD-2025-007
15,15,3400,4,DS4-132-AA,ORD-2026-001
6,6,6500,4,DST3-135-DD,ORD-2026-001
12,12,3450,3,DS4-132-AA,ORD-2026-002
9,9,4950,3,DS4-132-DD,ORD-2026-002
8,8,3480,2,DS4-132-AA,ORD-2026-003
5,5,5750,3,DS4-132-FF,ORD-2026-003
10,0,5000,2,DS4-132-DD,ORD-2026-004
4,0,7350,3,DS4-160-AA,ORD-2026-004
7,0,6600,2,DST3-135-DD,ORD-2026-005
3,0,8400,2,DST3-135-FF,ORD-2026-005
6,0,9500,2,DS2-200-AA,ORD-2026-006
2,0,14100,2,DS2-200-FF,ORD-2026-006
18,0,2250,2,DSD2-100-LO,ORD-2026-007
10,0,2840,2,DSD2-100-BO,ORD-2026-007
5,0,3400,2,DSD2-100-XO,ORD-2026-008
7,0,5000,3,DS3-160-AA,ORD-2026-008
"""

PERIODS = [("2024-01-01", "2024-12-31"), ("2025-01-01", "2025-12-31"), ("2026-01-01", None)]
LOADED = datetime.datetime(2026, 8, 1)


def table(spark, text, **types):
    rows = [
        {"seq": number, **row} for number, row in enumerate(csv.DictReader(io.StringIO(text)), start=1)
    ]
    df = spark.createDataFrame(rows)
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def build_mart(spark):
    motors = table(
        spark, MOTORS, kw="decimal(10,2)", rpm="int", volt="int", nm="decimal(10,2)", available="int", reserved="int"
    )
    numbered = assign_ids(motors, ["seq"])
    motor_table = numbered.select(
        "id", F.concat(F.lit("MTR-"), "model").alias("article_number"), "model",
        F.col("family").alias("motor_family"), F.lit("text").alias("description"),
        F.col("kw").alias("rated_power_kw"), F.col("rpm").alias("rated_speed_rpm"),
        F.col("volt").alias("rated_voltage_v"), F.col("nm").alias("rated_torque_nm"),
        F.col("cooling").alias("cooling_type"), F.col("status").alias("product_status"),
        F.lit(LOADED).cast("timestamp_ntz").alias("created_at"),
    )
    listed = motors.select(
        "model",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(start).cast("date").alias("valid_from"),
                        F.col(f"p{start[:4]}").cast("decimal(12,2)").alias("list_price"),
                        F.col(f"c{start[:4]}").cast("decimal(12,2)").alias("production_cost"),
                    )
                    for start, _ in PERIODS
                )
            )
        ),
    )
    prices = assign_ids(expand_price_list(motor_table, listed, PERIODS), ["valid_from", "motor_id"])
    stock = resolve_keys(
        motors.select("model", "seq", F.col("available").alias("quantity_available"),
                      F.col("reserved").alias("quantity_reserved"), F.lit("Brno").alias("warehouse")),
        motor_table, {"model": "model"}, "id", "motor_id",
    )
    customers = assign_ids(
        table(spark, CUSTOMERS, active="boolean").withColumnRenamed("segment", "customer_segment"), ["seq"]
    ).drop("seq")
    staged_orders = table(spark, ORDERS, order_date="date", delivery_date="date").withColumnRenamed(
        "status", "order_status"
    )
    orders = assign_ids(
        resolve_keys(staged_orders, customers, {"customer_number": "customer_number"}, "id", "customer_id"), ["seq"]
    ).drop("seq")
    staged_items = table(
        spark, ITEMS, quantity="int", delivered_quantity="int", unit_price="decimal(12,2)",
        discount_percent="decimal(5,2)",
    )
    with_order = resolve_keys(staged_items, orders, {"order_number": "order_number"}, "id", "order_id")
    items = assign_ids(resolve_keys(with_order, motor_table, {"model": "model"}, "id", "motor_id"), ["seq"])
    return {
        "motors": motor_table,
        "customers": with_defaults(customers, "customers"),
        "orders": with_defaults(orders, "orders"),
        "order_items": items.drop("seq"),
        "motor_prices": prices,
        "inventory": with_defaults(assign_ids(stock, ["seq"]).drop("seq"), "inventory"),
    }
