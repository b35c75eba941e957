"""Tables written in each format and read again, and columns of lists and documents as rows."""

from pyspark.sql import functions as F

from tidewell.plans.registry import Registry
from tidewell.session import scratch_path
from tidewell.sources import files, load, sinks

plans = Registry()

_EVENTS = "SELECT event_id, event_type, value FROM events"


def _events(spark, folder):
    return load(spark, folder, "events").select("event_id", "event_type", "value")


@plans.query("json_lines_round_trip", _EVENTS)
def json_lines_round_trip(spark, folder):
    """Events appended as JSON lines and read back with a schema."""
    path = scratch_path(spark, "lines")
    sinks.append_lines(_events(spark, folder), path)
    return files.json_lines(spark, path, "event_id long, event_type string, value double", strict=True)


@plans.query("sorted_lines_round_trip", "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS place FROM events")
def sorted_lines_round_trip(spark, folder):
    """Lines in order over all part files: places are told by file and line."""
    from pyspark.sql import Window

    path = scratch_path(spark, "sorted")
    sinks.sorted_lines(_events(spark, folder), path, "event_type", "event_id")
    lines = spark.read.text(path).select(F.from_json("value", "event_id long, event_type string").alias("r"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    return lines.select("r.event_id", F.row_number().over(Window.orderBy("r.event_type", "r.event_id")).alias("place"))


@plans.query("delimited_round_trip", _EVENTS)
def delimited_round_trip(spark, folder):
    path = scratch_path(spark, "delimited")
    sinks.delimited(_events(spark, folder), path)
    return files.separated(spark, path, "event_id long, event_type string, value double", sep=",")


@plans.query("exported_tables", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def exported_tables(spark, folder):
    path = scratch_path(spark, "export")
    sinks.export_tables(path, nation=load(spark, folder, "nation"), supplier=load(spark, folder, "supplier"))
    count = lambda name: spark.read.parquet(f"{path}/{name}.parquet").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count("nation").unionByName(count("supplier"))


@plans.query("committed_batches", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def committed_batches(spark, folder):
    """Two batches that were written whole, one of them twice, and one that broke off."""
    path, events = scratch_path(spark, "batches"), _events(spark, folder)
    for kind in ("click", "view", "click"):
        sinks.staged(events.where(F.col("event_type") == kind), path, kind)
    events.where("event_type = 'error'").withColumn("__batch", F.lit("error")).write.mode("append").partitionBy("__batch").parquet(path)
    return sinks.committed(spark, path)


@plans.query("columns_to_rows", _EVENTS + " WHERE event_type = 'view'")
def columns_to_rows(spark, folder):
    """Parallel lists of each user as rows again."""
    views = load(spark, folder, "events").where("event_type = 'view'")
    lists = views.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("l")).select(*[F.col(f"l.{c}").alias(c) for c in ("event_id", "event_type", "value")])
    return files.rows_of_columns(lists, "event_id", "event_type", "value")


@plans.query("enveloped_rows", "SELECT n_nationkey, n_name FROM nation")
def enveloped_rows(spark, folder):
    """An object that holds the rows in a list, as one file."""
    path = scratch_path(spark, "envelope")
    listed = load(spark, folder, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("results"))).alias("value"))
    listed.coalesce(1).write.text(path)
    return files.enveloped(spark, path, "struct<n_nationkey:bigint,n_name:string>")


@plans.query("fixed_width_rows", "SELECT DISTINCT form, cik, accession_number FROM filing_records WHERE length(form) <= 12 AND length(cik) <= 10")
def fixed_width_rows(spark, folder):
    """A form index with fixed columns."""
    path = scratch_path(spark, "index")
    rows = load(spark, folder, "filing_records").where("length(form) <= 12 and length(cik) <= 10").select("form", "cik", "accession_number").distinct()
    rows.select(F.concat(F.rpad("form", 12, " "), F.rpad("cik", 10, " "), "accession_number").alias("value")).write.text(path)
    return files.fixed_width(spark, path, form=(1, 12), cik=(13, 10), accession_number=(23, 40))


@plans.query("rederived_ids", "SELECT DISTINCT f.filing_id, sha256(lpad(f.cik, 10, '0') || ':' || f.accession_number) AS id FROM filing_records f WHERE f.cik IS NOT NULL AND f.accession_number IS NOT NULL")
def rederived_ids(spark, folder):
    """Identifiers made again from their parts, and met with the rows that hold those parts."""
    rows = load(spark, folder, "filing_records").where("cik is not null and accession_number is not null")
    derived = rows.select(F.sha2(F.concat(F.lpad("cik", 10, "0"), F.lit(":"), "accession_number"), 256).alias("id"), F.lpad("cik", 10, "0").alias("c"), "accession_number").distinct()
    return rows.withColumn("c", F.lpad("cik", 10, "0")).join(derived, ["c", "accession_number"]).select("filing_id", "id").distinct()


@plans.query("html_cells", "SELECT n_nationkey, n_name FROM nation")
def html_cells(spark, folder):
    """Rows of a page's table as cells."""
    cell = lambda c: F.concat(F.lit("<td class='x'><b>"), F.col(c).cast("string"), F.lit("</b>&nbsp;</td>"))
    body = load(spark, folder, "nation").agg(F.array_join(F.collect_list(F.concat(F.lit("<tr>"), cell("n_nationkey"), cell("n_name"), F.lit("</tr>"))), "").alias("b"))
    page = body.select(F.concat(F.lit("<html><TABLE border=1>"), "b", F.lit("</TABLE></html>")).alias("html"))
    return files.html_tables(page, "html").select(F.col("cells")[0].cast("long").alias("n_nationkey"), F.col("cells")[1].alias("n_name"))
