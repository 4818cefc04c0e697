"""An append-only mirror of observed records in the shared folder: staging, commits with a proof chain, checkpoints.

Everything that changes the mirror is an entry of one numbered log. What an entry
tells of is first written whole, below a name that nobody knows yet; then the
entry is published as the log's next number, which only one writer can take. So
a reader sees a change wholly or not at all, a writer that dies between any two
steps leaves the state before, and of two writers one wins and the other looks at
the new state and tries again. An entry of a batch that is there already is found and
not made twice: a batch may run again from any step, as often as it likes. The
same batch with other rows is an error (``MirrorConflict``).

Rows: null keys are one key; repeated equal records are one; equal keys with
different hashes are a conflict and never stored. An empty batch is an entry too.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVED = "key string, hash string, payload string"
VERDICT = f"{OBSERVED}, verdict string"
PROOF = "seq long, batch string, prev_hash string, payload string, entry_hash string"
CHECKPOINT = "company string, pack string, position string"
EVENT = "stream string, at long, kind string, body string"


class MirrorConflict(Exception):
    """A batch was given again with other rows."""


def publish(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Create a file with all its bytes; False if there is one already. Both steps are atomic where renaming is."""
    store, path = fs.FileSystem.from_uri(uri)
    unseen = f"{path}.{uuid.uuid4().hex}"
    if isinstance(store, fs.LocalFileSystem):
        with open(unseen, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(unseen, path)  # unlike renaming it never replaces
        except FileExistsError:
            return False
        finally:
            os.unlink(unseen)
        return True
    with store.open_output_stream(unseen) as f:
        f.write(data)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place = lambda name: hadoop.Path(f"{uri.rsplit('/', 1)[0]}/{name.rsplit('/', 1)[1]}")
    if hadoop.FileSystem.get(place(path).toUri(), conf).rename(place(unseen), place(path)):
        return True
    store.delete_file(unseen)
    return False


class Mirror:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # The log -------------------------------------------------------------------

    def entries(self) -> list[dict]:
        """All entries so far, in their order: one for each batch and step, so as many as there were batches."""
        store, path = fs.FileSystem.from_uri(f"{self.folder}/log")
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out = []
        for info in sorted((i for i in found if i.base_name.endswith(".json")), key=lambda i: i.base_name):
            with store.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
        if [e["seq"] for e in out] != list(range(1, len(out) + 1)):
            raise ValueError(f"the log in {self.folder} has gaps")
        return out

    def _publish(self, entry: dict) -> bool:
        """Take the entry's number, or tell that another writer has."""
        store, path = fs.FileSystem.from_uri(f"{self.folder}/log")
        store.create_dir(path, recursive=True)
        return publish(self.spark, f"{self.folder}/log/{entry['seq']:012d}.json", json.dumps(entry, sort_keys=True).encode())

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(path)
        return path

    def _change(self, kind: str, batch: str, digest: str, make) -> dict:
        """The batch's entry of a kind: that which is there, or a new one of what ``make(entries)`` gives."""
        while True:
            entries = self.entries()
            for e in entries:
                if (e["kind"], e["batch"]) == (kind, batch):
                    if e["digest"] != digest:
                        raise MirrorConflict(f"{kind} of {batch} had other rows before")
                    return e
            entry = {"seq": len(entries) + 1, "kind": kind, "batch": batch, "digest": digest, **make(entries)}
            if entry.get("state") not in (None, "committed") or self._publish(entry):
                return entry

    @staticmethod
    def _digest(rows: DataFrame) -> str:
        """Equal for equal bags of rows."""
        r = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns))).first()
        return f"{r[0]}:{r[1]}:{r[2]}"

    def table(self, name: str, schema: str) -> DataFrame:
        """All rows of a kind that the log tells of, with their batch as ``part``; an unreadable one is an error."""
        if name == "proofs":
            rows = [(e["proof"]["seq"], e["batch"], e["proof"]["prev_hash"], e["proof"]["payload"], e["proof"]["entry_hash"], e["batch"]) for e in self.entries() if e["kind"] == "commit"]
            return self.spark.createDataFrame(rows, f"{PROOF}, part string")
        paths = [e["path"] for e in self.entries() if e["kind"] == name]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, part string")
        return self.spark.read.schema(f"{schema}, part string").parquet(*paths)

    # Batches -------------------------------------------------------------------

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``(key, hash, payload)`` with a verdict each: inserted, replayed (as known), or conflict (known with another hash, or
        twice in the batch with different ones)."""
        known = self.table("observe", VERDICT).filter("verdict = 'inserted'").select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), F.lit(True).alias("_known"))
        own = rows.groupBy("key").agg(F.min("hash").alias("hash"), F.min_by("payload", "hash").alias("payload"), F.count_distinct("hash").alias("_n"))
        differs = (F.col("_n") > 1) | (F.col("_known") & ~F.col("_hash").eqNullSafe(F.col("hash")))
        verdict = F.when(differs, "conflict").when(F.col("_known"), "replayed").otherwise("inserted")
        return own.join(known, F.col("key").eqNullSafe(F.col("_key")), "left").select("key", "hash", "payload", verdict.alias("verdict"))

    def observe(self, batch: str, rows: DataFrame) -> DataFrame:
        """Stage a batch: new records are appended, replays change nothing, conflicts are rows and never stored."""
        rows = rows.select("key", "hash", "payload")
        make = lambda entries: {"path": self._write(self.verdicts(rows).withColumn("part", F.lit(batch)))}  # noqa: E731, ARG005
        entry = self._change("observe", batch, self._digest(rows), make)
        return self.spark.read.schema(f"{VERDICT}, part string").parquet(entry["path"]).drop("part")

    def observed(self) -> DataFrame:
        """The records that are stored."""
        return self.table("observe", VERDICT).filter("verdict = 'inserted'").select("key", "hash", "payload", "part")

    def commit(self, batch: str, positions: DataFrame | None = None, expected: dict[tuple[str, str], str | None] | None = None) -> str:
        """Append the batch's proof to the chain and, in the same entry, its checkpoints ``(company, pack, position)``.

        ``committed``, ``already_committed``, ``not_observed``, ``conflict`` (the batch has one), or
        ``concurrent_checkpoint``: a pair isn't where ``expected`` has it (None: has no checkpoint).
        """
        digest = "" if positions is None else self._digest(positions.select("company", "pack", "position"))
        fresh = []

        def make(entries):
            fresh.append(True)
            staged = next((e for e in entries if (e["kind"], e["batch"]) == ("observe", batch)), None)
            if staged is None:
                return {"state": "not_observed"}
            read = self.spark.read.schema(f"{VERDICT}, part string").parquet(staged["path"])
            counts = {r["verdict"]: r["count"] for r in read.groupBy("verdict").count().collect()}
            if counts.get("conflict"):
                return {"state": "conflict"}
            if expected:
                now = {(r["company"], r["pack"]): r["position"] for r in self.checkpoints(entries).collect()}
                if any(now.get(pair) != position for pair, position in expected.items()):
                    return {"state": "concurrent_checkpoint"}
            done = [e["proof"] for e in entries if e["kind"] == "commit"]
            before = done[-1]["entry_hash"] if done else "genesis"
            payload = ",".join(f"{k}={counts[k]}" for k in sorted(counts))
            proof = {"seq": len(done) + 1, "prev_hash": before, "payload": payload, "entry_hash": hashlib.sha256(f"{before}|{payload}".encode()).hexdigest()}
            out = {"state": "committed", "proof": proof}
            return out if positions is None else {**out, "checkpoints": self._write(positions.select("company", "pack", "position"))}

        entry = self._change("commit", batch, digest, make)
        return entry["state"] if fresh else "already_committed"

    def checkpoint(self, batch: str, rows: DataFrame) -> None:
        """``(company, pack, position)``: each pair's next generation; the latest one counts."""
        rows = rows.select("company", "pack", "position")
        self._change("checkpoint", batch, self._digest(rows), lambda entries: {"checkpoints": self._write(rows)})  # noqa: ARG005

    def checkpoints(self, entries: list[dict] | None = None) -> DataFrame:
        """Each pair's latest position, with how many it has had."""
        paths = [(e["seq"], e["checkpoints"]) for e in (self.entries() if entries is None else entries) if "checkpoints" in e]
        found = self.spark.createDataFrame([], f"{CHECKPOINT}, seq long")
        if paths:
            order = self.spark.createDataFrame([(s, p.rsplit("/", 1)[1]) for s, p in paths], "seq long, _name string")
            name = F.element_at(F.split(F.input_file_name(), "/"), -2)
            read = self.spark.read.schema(CHECKPOINT).parquet(*(p for _, p in paths)).withColumn("_name", name)
            found = read.join(F.broadcast(order), "_name").drop("_name")
        return found.groupBy("company", "pack").agg(F.max_by("position", "seq").alias("position"), F.count_distinct("seq").alias("generation"))

    def log(self, batch: str, rows: DataFrame) -> None:
        """Append events ``(stream, at, kind, body)``: audit entries, or items of an outbox."""
        rows = rows.select("stream", "at", "kind", "body")
        self._change("log", batch, self._digest(rows), lambda entries: {"path": self._write(rows.withColumn("part", F.lit(batch)))})  # noqa: ARG005

    def pending(self) -> DataFrame:
        """Items of the outbox whose last event is ``pending``."""
        last = F.max_by("kind", F.struct("at", "kind"))
        return self.table("log", EVENT).groupBy("stream").agg(last.alias("kind"), F.count("*").cast("long").alias("events")).filter("kind = 'pending'")
