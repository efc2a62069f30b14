"""Corpora that Spark derives from the given tables.

``invoices``   one invoice text per order (orders, customer, nation, part)
``library``    the catalogue, fields and tables that the catalogue operators read
``tables``     customer, orders, part and nation as extracted string tables
``questions``  question texts built from customers, and the user turns of conversations

Every builder is a projection plus key joins, so its work grows with the tables and no
group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import spread

TABLE_DOC_BASE = 1_000_000_000_000
TABLE_SPECS = {
    1: ("customer", "c_custkey", ["custkey", "name", "nationkey", "acctbal", "mktsegment"]),
    2: ("orders", "o_orderkey", ["orderkey", "custkey", "orderstatus", "totalprice", "orderdate", "orderpriority"]),
    3: ("part", "p_partkey", ["partkey", "name", "brand", "type", "size", "retailprice"]),
    4: ("nation", "n_nationkey", ["nationkey", "name", "regionkey"]),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document texts as a catalogue; documents labelled low quality count as failed."""
    docs = spread(read(spark, sf_dir, "documents"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    failed = F.coalesce(F.col("quality") == 0, F.lit(False))
    title = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"),
        F.concat(title, F.lit(".txt")).alias("filename"),
        title.alias("title"),
        F.col("lang").alias("file_type"),
        F.col("n_chars").alias("size"),
        F.when(failed, "failed").otherwise("ready").alias("status"),
        F.when(failed, "rejected by label").alias("error"),
        F.concat(
            F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"),
            F.lit("-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"),
        ).alias("uploaded_at"),
        "text",
    )


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents without the label join, for jobs that only need the texts."""
    return spread(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("file_type"),
        "text",
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, title, file_type, status, text): nine lines of text per order."""
    orders = spread(read(spark, sf_dir, "orders"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("o_custkey") == F.col("p_partkey"))
    )
    key = F.col("o_orderkey").cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("INVOICE #INV-"), key),
        F.concat(F.lit("Vendor: "), "n_name", F.lit(" Trading")),
        F.concat(F.lit("Bill to: "), "c_name"),
        F.concat(F.lit("Invoice date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.concat(F.lit("Status: "), "o_orderstatus"),
        F.concat(F.lit("Priority: "), "o_orderpriority"),
        F.concat(
            F.lit("Line items: "), "p_name", F.lit(" x"), (F.col("o_orderkey") % 9 + 1).cast("string"),
            F.lit(" Rs."), money(F.col("p_retailprice")), F.lit(" handling fee x1 Rs.25.00"),
        ),
        F.concat(F.lit("Total Rs."), money(F.col("o_totalprice"))),
        F.concat(F.lit("Pay at https://pay.example.com/inv/"), key),
        F.concat(
            F.lit("Contact: billing"), F.col("o_custkey").cast("string"), F.lit("@example.com | +91 90000 "),
            F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"),
        ),
    )
    return j.select(
        F.col("o_orderkey").alias("document_id"),
        F.concat(F.lit("invoice_"), key).alias("title"),
        F.lit("txt").alias("file_type"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ready").alias("status"),
        text.alias("text"),
    )


def _cells(table_id: int, df: DataFrame) -> DataFrame:
    name, key, _ = TABLE_SPECS[table_id]
    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind == "double":
            c = money(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(F.coalesce(c.cast("string"), F.lit("")))
    return df.select(F.lit(table_id).cast("long").alias("table_id"), F.col(key).cast("int").alias("row_index"), F.array(*cols).alias("cells"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, row_index, cells): the four tables as rows of strings."""
    out = None
    for table_id, (name, _, _) in TABLE_SPECS.items():
        part = _cells(table_id, read(spark, sf_dir, name))
        out = part if out is None else out.unionByName(part)
    return out


def table_headers(spark: SparkSession) -> DataFrame:
    """(table_id, document_id, name, col_names): one short row per table."""
    rows = [(i, TABLE_DOC_BASE + i, name, cols) for i, (name, _, cols) in TABLE_SPECS.items()]
    return spark.createDataFrame(rows, "table_id long, document_id long, name string, col_names array<string>")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): one question per customer, and every user turn of the conversations."""
    key = F.col("c_custkey")
    shapes = F.array(
        F.concat(F.lit("How many customer rows are in the "), "c_mktsegment", F.lit(" segment?")),
        F.concat(F.lit("what is the average acctbal of "), "c_name"),
        F.lit("what is the total value of all orders?"),
        F.concat(F.lit("total retailprice of part for each "), "c_mktsegment"),
        F.lit("list all vendors and their email"),
        F.concat(F.lit("sum of totalprice, who is "), "c_name"),
        F.lit("average size of economy part"),
        F.concat(F.lit("What is the due date and amount for "), "c_name", F.lit("?")),
    )
    asked = read(spark, sf_dir, "customer").select(
        (key * 2).alias("query_id"),
        F.element_at(shapes, (key % 8 + 1).cast("int")).alias("q"),
    )
    turns = read(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        ((F.col("conv_id") * 1048576 + F.col("turn")) * 2 + 1).alias("query_id"), F.col("text").alias("q"),
    )
    return asked.unionByName(turns)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): every benchmark passage as a search request."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue over the invoices plus one csv document per extracted table."""
    inv = invoices(spark, sf_dir).select(
        "document_id", "title", "file_type", "status",
        F.when(F.col("status") == "failed", "no extractable text").alias("error"),
        F.length("text").cast("long").alias("size"),
    )
    tabs = table_headers(spark).select(
        "document_id", F.concat("name", F.lit("_table")).alias("title"), F.lit("csv").alias("file_type"),
        F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("size"),
    )
    return inv.unionByName(tabs)
