"""Filters, joins, grouping, paging and scalar functions."""

from pyspark.sql import functions as F

from mediamatch import functions as fn
from mediamatch.catalog import tables as t
from mediamatch.catalog.registry import query
from mediamatch.operators import relational as rel
from mediamatch.schema import ALLOWED_MIME

JAN_10, JAN_20 = 1_704_844_800, 1_705_708_800
TRUSTED = ("10.0.0.1", "10.0.0.2")


@query(
    "orders_open_expensive",
    "P1 P2",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000""",
)
def orders_open_expensive(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300_000)).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "lineitem_quantity_between",
    "P3",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12""",
)
def lineitem_quantity_between(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    return lines.where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "lineitem_raw_predicate",
    "P4",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem
       WHERE l_discount * 100 > 8.5 AND l_returnflag <> 'N'""",
)
def lineitem_raw_predicate(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag")
    found = rel.where_raw(lines, "l_discount * 100 > :floor AND l_returnflag <> :flag", floor=8.5, flag="N")
    return found.drop("l_returnflag")


@query(
    "events_date_range_inclusive",
    "P5",
    f"""SELECT event_id, user_id FROM events
        WHERE ts >= make_timestamp({JAN_10}000000) AND ts <= make_timestamp({JAN_20}000000)""",
)
def events_date_range_inclusive(spark, sf_dir):
    return rel.where_date_range(t.table(spark, sf_dir, "events"), "ts", JAN_10, JAN_20).select("event_id", "user_id")


@query(
    "orders_date_range_exclusive",
    "P5",
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
)
def orders_date_range_exclusive(spark, sf_dir):
    # The ends fall on midnight, as order dates do, so the exclusive form differs from the inclusive.
    return rel.where_date_range(
        t.table(spark, sf_dir, "orders"), "o_orderdate", 820_454_400, 852_076_800, inclusive=False
    ).select("o_orderkey")


@query(
    "orders_in_list",
    "P6 P7",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""",
)
def orders_in_list(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    # Empty lists filter nothing.
    orders = rel.where_not_in(rel.where_in(orders, "o_orderkey", []), "o_orderkey", [])
    return rel.where_not_in(rel.where_in(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderstatus", ["P"])


@query(
    "orders_or_group",
    "P8",
    """SELECT o_orderkey FROM orders
       WHERE (o_orderpriority = '1-URGENT' OR o_totalprice < 50000) AND o_orderstatus = 'F'""",
)
def orders_or_group(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    either = [F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") < 50_000]
    return rel.where_any(rel.where_any(orders, []), either).select("o_orderkey")


_ALLOWED_SQL = ", ".join(f"'{m}'" for m in ALLOWED_MIME)


@query(
    "media_type_checks",
    "P9 P10",
    f"""WITH {t.MEDIA_SQL} SELECT attachment_id, mime_type IN ({_ALLOWED_SQL}) AS accepted,
        starts_with(mime_type, 'image/') AS is_image FROM media""",
)
def media_type_checks(spark, sf_dir):
    mime = F.col("mime_type")
    return t.media(spark, sf_dir).select(
        "attachment_id", mime.isin(*ALLOWED_MIME).alias("accepted"), mime.startswith("image/").alias("is_image")
    )


@query(
    "hash_text_guard",
    "P11 F2",
    """WITH texts AS (SELECT doc_id, CASE lang WHEN 'en' THEN upper(left(md5(text), 16)) WHEN 'fr' THEN md5(text)
                             ELSE left(md5(text), 15) || 'g' END AS hash_text FROM documents)
       SELECT doc_id, CASE WHEN regexp_full_match(lower(hash_text), '[0-9a-f]{16}') THEN lower(hash_text) END AS phash
       FROM texts""",
)
def hash_text_guard(spark, sf_dir):
    digest = F.md5(F.col("text").cast("binary"))
    text = (
        F.when(F.col("lang") == "en", F.upper(F.substring(digest, 1, 16)))
        .when(F.col("lang") == "fr", digest)
        .otherwise(F.concat(F.substring(digest, 1, 15), F.lit("g")))
    )
    documents = t.table(spark, sf_dir, "documents")
    return documents.select("doc_id", fn.long_to_hash(fn.hash_to_long(F.lower(text))).alias("phash"))


@query(
    "index_row_status",
    "P12 P14",
    f"""WITH {t.MEMBERSHIP_SQL}
        SELECT doc_id AS attachment_id, coalesce(error_code, '') = '' AND m.attachment_id IS NOT NULL AS is_indexed,
               CASE WHEN coalesce(error_code, '') <> '' THEN 'failed' WHEN m.attachment_id IS NOT NULL THEN 'indexed'
                    ELSE 'pending' END AS status,
               CASE error_code WHEN 'unfingerprintable' THEN 'Corrupt / unreadable' END AS error_label
        FROM documents LEFT JOIN membership m ON m.attachment_id = doc_id""",
)
def index_row_status(spark, sf_dir):
    listed = t.membership(spark, sf_dir).withColumn("phash", F.when(F.col("error_code") == "", "hash").otherwise(""))
    library = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("attachment_id"))
    status = fn.row_status("error_code", "phash")
    return library.join(listed, "attachment_id", "left").select(
        "attachment_id",
        (status == "indexed").alias("is_indexed"),
        status.alias("status"),
        fn.error_label("error_code").alias("error_label"),
    )


@query(
    "page_title_search",
    "P13 U1 L9",
    """WITH hit AS (
         SELECT page_id AS attachment_id,
                CASE WHEN contains(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'th') THEN 0
                     WHEN contains(lower(url), 'th') THEN 1 END AS source
         FROM pages)
       SELECT attachment_id, source FROM hit WHERE source IS NOT NULL ORDER BY source, attachment_id DESC LIMIT 500""",
)
def page_title_search(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("attachment_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("filename"),
        F.lit("attachment").alias("post_type"),
        F.lit("inherit").alias("status"),
    )
    return rel.search_titles(pages, "th")


@query(
    "customer_orders_inner",
    "J1",
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer c ON c.c_custkey = o_custkey
       AND c.c_acctbal > 0 WHERE o_orderstatus = 'F'""",
)
def customer_orders_inner(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    customers = t.table(spark, sf_dir, "customer").alias("c")
    on = (F.col("c.c_custkey") == F.col("o_custkey")) & (F.col("c.c_acctbal") > 0)
    return orders.join(customers, on).select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "customer_orders_left",
    "J2",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey
       AND o.o_totalprice > 450000""",
)
def customer_orders_left(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").alias("o")
    on = (F.col("o.o_custkey") == F.col("c_custkey")) & (F.col("o.o_totalprice") > 450_000)
    return t.table(spark, sf_dir, "customer").join(orders, on, "left").select("c_custkey", "o_orderkey")


@query(
    "lineitem_group_having",
    "A1 A2",
    """SELECT l_suppkey, l_returnflag, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS sum_quantity
       FROM lineitem GROUP BY l_suppkey, l_returnflag HAVING count(*) > 100 AND sum(l_quantity) < 20000""",
)
def lineitem_group_having(spark, sf_dir):
    grouped = (
        t.table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_returnflag")
        .agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("bigint").alias("sum_quantity"))
    )
    return grouped.where((F.col("n_lines") > 100) & (F.col("sum_quantity") < 20_000))


@query(
    "lineitem_derived_table",
    "U4",
    """SELECT l_returnflag, count(*) AS n_orders, max(n_lines) AS most_lines
       FROM (SELECT l_orderkey, l_returnflag, count(*) AS n_lines FROM lineitem GROUP BY 1, 2) d GROUP BY l_returnflag""",
)
def lineitem_derived_table(spark, sf_dir):
    derived = t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n_lines")).alias("d")
    return derived.groupBy("l_returnflag").agg(F.count("*").alias("n_orders"), F.max("d.n_lines").alias("most_lines"))


@query(
    "orders_ordered_page",
    "L1 L2 L3 L4",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
       ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def orders_ordered_page(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ordered = rel.order_by(orders, ("o_orderpriority", "up"), ("o_totalprice", "desc"), ("o_orderkey", "ASC"))
    return rel.paginate(ordered, page=3, per_page=25)


@query(
    "orders_scalar_read",
    "A12",
    """SELECT max(o_totalprice) AS highest FROM orders""",
)
def orders_scalar_read(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("highest"))


@query(
    "index_rows_page",
    "L5 J9 F13",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL}
        SELECT attachment_id, error_code, title, regexp_extract(filename, '[^/]*$') AS filename
        FROM membership JOIN media USING (attachment_id) WHERE attachment_id < 150
        ORDER BY attachment_id DESC LIMIT 25""",
)
def index_rows_page(spark, sf_dir):
    page = rel.rows_page(t.membership(spark, sf_dir), after_id=150)
    return rel.hydrate_rows(page, t.media(spark, sf_dir))


_IMAGE_SQL = "post_type = 'attachment' AND starts_with(mime_type, 'image/') AND status = 'inherit'"


@query(
    "image_ids_page",
    "L6",
    f"""WITH {t.MEDIA_SQL} SELECT attachment_id FROM media WHERE {_IMAGE_SQL} AND attachment_id > 20
        ORDER BY attachment_id LIMIT 200""",
)
def image_ids_page(spark, sf_dir):
    return rel.ids_page(t.media(spark, sf_dir), after_id=20)


@query("image_ids_all", "L7", f"""WITH {t.MEDIA_SQL} SELECT attachment_id FROM media WHERE {_IMAGE_SQL}""")
def image_ids_all(spark, sf_dir):
    return rel.all_image_ids(t.media(spark, sf_dir))


@query(
    "document_size_labels",
    "F10",
    """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1))
              ELSE printf('%.1f MB', round(b / 1048576.0, 1)) END AS size_label
       FROM (SELECT doc_id, n_chars * CASE lang WHEN 'de' THEN 1024 ELSE 1 END AS b FROM documents)""",
)
def document_size_labels(spark, sf_dir):
    size = F.col("n_chars") * F.when(F.col("lang") == "de", 1024).otherwise(1)
    return t.table(spark, sf_dir, "documents").select("doc_id", fn.human_bytes(size).alias("size_label"))


@query(
    "page_file_types",
    "S3 F13",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS filename,
              CASE WHEN starts_with(url, 'https:') THEN 'image/webp'
                   ELSE coalesce(CASE lower(regexp_extract(url, '\\.([^./]+)$', 1))
                        WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' END, '') END AS mime_type
       FROM pages""",
)
def page_file_types(spark, sf_dir):
    stored = F.when(F.col("url").startswith("https:"), "image/webp").otherwise("")
    return t.table(spark, sf_dir, "pages").select(
        "page_id", fn.basename("url").alias("filename"), fn.mime_from_name("url", stored).alias("mime_type")
    )


@query(
    "order_discount_percent",
    "F11",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_discount * 100) AS INTEGER) AS discount_percent,
              round(l_quantity / 100.0, 3) AS quantity_ratio FROM lineitem""",
)
def order_discount_percent(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fn.ratio_to_percent("l_discount").alias("discount_percent"),
        fn.percent_to_ratio("l_quantity").alias("quantity_ratio"),
    )


@query(
    "mapped_clients",
    "F14",
    """SELECT event_id, CASE event_type
              WHEN 'click' THEN '::ffff:198.51.100.' || (user_id % 250)
              WHEN 'view' THEN '2001:db8::1:192.0.2.' || (user_id % 250)
              WHEN 'signup' THEN '64:ff9b:1:2:3:4:203.0.113.' || (user_id % 250)
              ELSE '192.0.2.77' END AS client FROM events""",
)
def mapped_clients(spark, sf_dir):
    """Forwarded addresses whose tail is a dotted quad; the malformed one is passed over for the entry before it."""
    kind, last = F.col("event_type"), (F.col("user_id") % 250).cast("string")
    forwarded = (
        F.when(kind == "click", F.concat(F.lit("192.0.2.77, ::ffff:198.51.100."), last))
        .when(kind == "view", F.concat(F.lit("192.0.2.77, 2001:db8::1:192.0.2."), last, F.lit(", 10.0.0.2")))
        .when(kind == "signup", F.concat(F.lit("192.0.2.77, 64:ff9b:1:2:3:4:203.0.113."), last))
        .otherwise(F.concat(F.lit("192.0.2.77, 1:2:3:4:5:6:7:203.0.113."), last))
    )
    events = t.table(spark, sf_dir, "events").select("event_id", F.lit("10.0.0.1").alias("peer"), forwarded.alias("forwarded"))
    return events.select("event_id", fn.client_address("peer", "forwarded", TRUSTED).alias("client"))


@query(
    "request_clients",
    "F14 F15 F16",
    """WITH request AS (
         SELECT event_id, ts, CASE WHEN event_type = 'view' THEN '192.0.2.' || (user_id % 250) ELSE '10.0.0.1' END AS peer,
                CASE event_type WHEN 'click' THEN '198.51.100.' || (user_id % 250) || ', 10.0.0.2'
                                WHEN 'signup' THEN '203.0.113.9, 2001:db8::' || (user_id % 10)
                                WHEN 'error' THEN 'unknown,10.0.0.2 , 300.1.1.1' END AS forwarded
         FROM events),
       resolved AS (
         SELECT event_id, ts, CASE WHEN peer = '10.0.0.1' AND forwarded LIKE '198.51%' THEN regexp_extract(forwarded, '^[^,]*')
                               WHEN peer = '10.0.0.1' AND forwarded LIKE '203.0%' THEN regexp_extract(forwarded, '2001.*$')
                               ELSE peer END AS client FROM request)
       SELECT event_id, client, sha256(client) AS client_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS requested_at FROM resolved""",
)
def request_clients(spark, sf_dir):
    kind, last = F.col("event_type"), (F.col("user_id") % 250).cast("string")
    events = t.table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.when(kind == "view", F.concat(F.lit("192.0.2."), last)).otherwise("10.0.0.1").alias("peer"),
        F.when(kind == "click", F.concat(F.lit("198.51.100."), last, F.lit(", 10.0.0.2")))
        .when(kind == "signup", F.concat(F.lit("203.0.113.9, 2001:db8::"), (F.col("user_id") % 10).cast("string")))
        .when(kind == "error", "unknown,10.0.0.2 , 300.1.1.1")
        .alias("forwarded"),
    )
    client = fn.client_address("peer", "forwarded", TRUSTED)
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return events.select("event_id", client.alias("client"), seconds.alias("s")).select(
        "event_id", "client", fn.client_key("client").alias("client_key"), fn.epoch_to_text("s").alias("requested_at")
    )
