"""A hand-made set of raw feeds with one row for every case worth telling apart.

Orders: o1 two items, payments and reviews (scores 1 and 5), delivered late;
o2 nothing at all; o3 score unreadable, delivered exactly on the estimate, 23:00 to
01:00 two dates later; o4 canceled, unknown seller and product, no review;
o5 delivered early. Items and payments of order 'zz' have no order.
"""

from __future__ import annotations

from tallyline.sources import FEEDS

ROWS = {
    "olist_orders": [
        ("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-01 11:00:00",
         "2018-01-03 00:00:00", "2018-01-20 09:00:00", "2018-01-15 00:00:00"),
        ("o2", "c1", "shipped", "2018-02-01 10:00:00", "", None, None, "2018-02-15"),
        ("o3", "c2", "delivered", "2018-03-01 23:00:00", "2018", "2018-02-30",
         "2018-03-03 01:00:00", "2018-03-03 01:00:00"),
        ("o4", "c9", "canceled", "2018-04-01 10:00:00", "02/01/2018", None, None,
         "2018-04-20 00:00:00"),
        ("o5", "c2", "delivered", "2018-05-01 10:00:00", "2018-05-01 10:00:00",
         "2018-05-02 00:00:00", "2018-05-05 10:00:00", "2018-05-20 00:00:00"),
    ],
    "olist_order_items": [
        ("o1", "1", "p1", "s1", "2018-01-05 00:00:00", "10.5", "1.5"),
        ("o1", "2", "p2", "s1", "2018-01-05 00:00:00", "20.0", "2.0"),
        ("o3", "1", "p1", "s2", "2018-03-05 00:00:00", "30.0", "3.0"),
        ("o4", "1", "p9", "s9", "2018-04-05 00:00:00", "40.0", "4.0"),
        ("o5", "3.7", "p3", "s2", "2018-05-05 00:00:00", "abc", "5.0"),
        ("o5", "abc", "p3", "s2", "2018-05-05 00:00:00", "50.0", ""),
        ("zz", "1", "p1", "s1", "2018-05-05 00:00:00", "99.0", "9.0"),
    ],
    "olist_order_payments": [
        ("o1", "1", "credit_card", "2", "30.0"),
        ("o1", "2", "voucher", "1", "4.0"),
        ("o3", "1", "credit_card", "2", "33.0"),
        ("o4", "1", "credit_card", "1e0", "44.0"),
        ("o4", "2", "credit_card", "1", "1.0"),
        ("zz", "1", "voucher", "1", "7.0"),
    ],
    "olist_order_reviews": [
        ("r1", "o1", "1", "bad", 'late,\n"very" late', "2018-01-21 00:00:00", "2018-01-22 00:00:00"),
        ("r2", "o1", "5", "good", "fine", "2018-01-25 00:00:00", "2018-01-26 00:00:00"),
        ("r3", "o3", "abc", None, None, "2018-03-05 00:00:00", None),
        ("r5", "o5", "4", None, "ok", "2018-05-06 00:00:00", ""),
        ("r9", "yy", "2", None, None, "2018-06-01 00:00:00", None),
    ],
    "olist_customers": [
        ("c1", "u1", "01037", "sao paulo", "SP"),
        ("c2", "u2", "20000", "rio", "RJ"),
        ("c3", "u1", "01037", "sao paulo", "SP"),
    ],
    "olist_sellers": [
        ("s1", "01037", "sao paulo", "SP"),
        ("s2", "30000", "belo horizonte", "MG"),
        ("s3", "40000", "salvador", "BA"),
    ],
    "olist_products": [
        ("p1", "moveis", "3.7", "2.5", "1e3", "100", "1", "2", "3"),
        ("p2", "livros", "", "abc", "3000000000", "200.5", "", "x", None),
        ("p3", None, "10", "20", "1", "300", "4", "5", "6"),
        ("p4", "moveis", "1", "1", "1", "400", "7", "8", "9"),
    ],
    "olist_geolocation": [
        ("01037", -23.0, -46.0, "sao paulo", "SP"),
        ("01037", -25.0, -48.0, "santos", "AC"),
        ("20000", -22.0, -43.0, "rio", "RJ"),
    ],
    "product_category_name_translation": [("moveis", "furniture")],
}


def small_feeds(spark):
    return {name: spark.createDataFrame(rows, FEEDS[name].schema) for name, rows in ROWS.items()}
