"""Reports as files: CSV with sections, a statement for each party with a manifest, redacted exports."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import csv_cell, csv_guard, slug

#: Bytes of a proof export and of a telemetry export at most.
PROOF_BYTES, TELEMETRY_BYTES = 256 * 1024, 64 * 1024
#: Cells of a telemetry export at most: as many as its bytes could hold.
TELEMETRY_CELLS = 10_000
BOM = "﻿"


def csv_line(*cells: tuple[Column, bool]) -> Column:
    """A line of cells ``(value, is_text)``: text is guarded, numbers and dates aren't; all are quoted where they must be; null is empty."""
    return F.concat_ws(",", *[csv_cell(csv_guard(F.coalesce(c, F.lit(""))) if text else F.coalesce(c.cast("string"), F.lit(""))) for c, text in cells])


def statement_lines(bills: DataFrame, title: str) -> DataFrame:
    """``(party, file, n, line)``: a title, a heading, the party's bills and its two directional totals."""
    text, plain = lambda c: (F.col(c), True), lambda c: (F.col(c), False)
    w = Window.partitionBy("party").orderBy(F.desc_nulls_last("age"), "due_date", "reference", "kind")
    rows = bills.select("party", (F.row_number().over(w) + 2).cast("long").alias("n"), csv_line(text("reference"), plain("bill_date"), plain("due_date"), plain("amount"), plain("age"), text("kind")).alias("line"))
    sums = bills.groupBy("party").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias(k) for k in ("receivable", "payable")], F.count("*").alias("_n"))
    last = lambda i, k: sums.select("party", (F.col("_n") + 2 + i).cast("long").alias("n"), csv_line((F.lit(f"Total {k}"), True), (F.lit(None), False), (F.lit(None), False), plain(k)).alias("line"))
    first = sums.select("party", F.lit(1).cast("long").alias("n"), F.concat(F.lit(BOM), csv_line((F.lit(title), True), text("party"))).alias("line"))
    head = sums.select("party", F.lit(2).cast("long").alias("n"), F.lit("Reference,Bill date,Due date,Amount,Days overdue,Direction").alias("line"))
    names = statement_names(sums.select("party")).withColumnRenamed("party", "_party")
    lines = first.unionByName(head).unionByName(rows).unionByName(last(1, "receivable")).unionByName(last(2, "payable"))
    return lines.join(names, F.col("party") == F.col("_party")).select("party", "file", "n", "line")


def statement_names(parties: DataFrame) -> DataFrame:
    """``(party, file)`` of distinct parties: those whose names give the same file are told apart by their order."""
    names = parties.select("party", F.when(slug(F.col("party")) == "", "party").otherwise(slug(F.col("party"))).alias("_slug"))
    k = F.row_number().over(Window.partitionBy("_slug").orderBy("party"))
    return names.select("party", F.when(k == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", k.cast("string"))).alias("file"))


def write_statements(lines: DataFrame, folder: str) -> DataFrame:
    """``(file, path)`` of one text file for each party, its lines in order; parties are dealt by their own key. Writes when it is read; stage it.

    Tasks write the files below a folder of their attempt and tell where they are, so no driver renames or lists them,
    and a task that runs again disturbs no file that is read.
    """

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        now, out = None, None
        for b in batches:
            done = []
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != now:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(f"{path}/{attempt}", recursive=True)
                    now, out = file, store.open_output_stream(f"{path}/{attempt}/{file}.csv")
                    done.append(file)
                out.write(f"{line}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([f"{folder}/{attempt}/{f}.csv" for f in done], pa.string())], names=["file", "path"])
        if out is not None:
            out.close()

    return lines.repartition("file").sortWithinPartitions("file", "n").select("file", "line").mapInArrow(run, "file string, path string")


def read_statements(paths: DataFrame) -> DataFrame:
    """``(file, value)``: the whole text of each file ``(file, path)``."""

    def run(batches):
        for b in batches:
            for file, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([f.read().decode()])], names=["file", "value"])

    return paths.select("file", "path").mapInArrow(run, "file string, value string")


def manifest(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """``(party, json)``: file, bills and directional totals of each statement as JSON with sorted keys."""
    files = lines.filter("n = 1").select("party", "file")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").cast("string")
    sums = bills.groupBy("party").agg(F.count("*").alias("bills"), total("payable").alias("payable"), total("receivable").alias("receivable"))
    return sums.join(files, "party").select("party", F.to_json(F.struct("bills", "file", "party", "payable", "receivable")).alias("json"))


def proof_export(proofs: DataFrame, allowed: list[str]) -> DataFrame:
    """``(chain, state, json, checksum)``: each chain's proofs as JSON, if all of the chain holds, its codes are allowed and it isn't too long.

    Entries are ``(chain, seq, prev_hash, payload, entry_hash, code)``; a chain's export is bounded by PROOF_BYTES, and
    longer chains are refused before their entries are gathered.
    """
    w = Window.partitionBy("chain").orderBy("seq")
    whole = (F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit("genesis"))) & (F.col("entry_hash") == F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256))
    item = F.to_json(F.struct(F.col("code"), F.col("entry_hash"), F.col("seq")))
    rows = proofs.withColumn("_ok", whole).withColumn("_item", item)
    per = rows.groupBy("chain").agg(F.count_if(~F.col("_ok")).alias("broken"), F.count_if(~F.col("code").isin(*allowed)).alias("foreign"), (F.sum(F.octet_length("_item") + 1) + 1).alias("bytes"))
    state = F.when(F.col("broken") > 0, "chain_broken").when(F.col("foreign") > 0, "code_not_allowed").when(F.col("bytes") > PROOF_BYTES, "too_large").otherwise("exported")
    per = per.select("chain", state.alias("state"))
    good = rows.join(per.filter("state = 'exported'").select(F.col("chain").alias("_c")), F.col("chain") == F.col("_c"), "left_semi")
    json = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "_item"))), lambda x: x["_item"]), ","), F.lit("]"))
    out = good.groupBy(F.col("chain").alias("_c")).agg(json.alias("json"))
    return per.join(out, F.col("chain") == F.col("_c"), "left").select("chain", "state", "json", F.sha2("json", 256).alias("checksum"))


def telemetry_export(histogram: DataFrame) -> DataFrame:
    """One row: the histogram ``(class, outcome, bucket, attempts)`` as JSON; its cells are few by construction, refused whole beyond TELEMETRY_CELLS or TELEMETRY_BYTES."""
    cell = F.struct("class", "outcome", "bucket", "attempts")
    json = F.to_json(F.sort_array(F.collect_list(cell)))
    size = F.octet_length("json")
    fits = (size <= TELEMETRY_BYTES) & (F.col("cells") <= TELEMETRY_CELLS)
    return histogram.limit(TELEMETRY_CELLS + 1).agg(json.alias("json"), F.count("*").alias("cells")).select(F.when(fits, F.col("json")).alias("json"), fits.alias("exported"))
