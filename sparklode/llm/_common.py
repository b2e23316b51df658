"""What the operators of this subpackage share: sessions, cuts in the lineage, bounded samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_BATCH = 512
PART_BYTES, MOST_PARTS, UNKNOWN = 12 << 20, 1_000_000, 1 << 60  # of input for each reduce partition; sizes from UNKNOWN on are no sizes
NODE, ROW = "__node", "__row"
MOST_LABELS = 4096  # different labels that a sample takes in
SAMPLE_BYTES = 96 << 20  # of text of all labels together
WORD_BREAK = rb"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts can't fill a worker's memory; workers find this library where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: spark.checkpoint.dir, or else the checkpoint folder that is set.

    Only a local session may do without: it gets a temporary folder. On a cluster that would be lost on other machines, so it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ckpt")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder. Where the session has spark.cleaner.referenceTracking.cleanCheckpoints, Spark
    deletes a checkpoint once nothing on the driver refers to it."""
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark._jvm.System.gc()  # Spark drops shuffle files once nothing on the driver refers to them
    return done


def stored(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path; then the folder ``before``, which it was made from, goes."""
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}")
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(path), path


def partitions(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Number of reduce partitions: what the session is set to, or more where ``docs`` has more than PART_BYTES for each.

    So what a reduce task holds at once depends on PART_BYTES and not on how much larger the input is than the session was set up for.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if docs is None:
        return n
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n, min(MOST_PARTS, -(-size // PART_BYTES))) if size < UNKNOWN else n


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``NODE``, a number of each row with an id, in the order of doc_id, and of text where ids are equal; and whether ids repeat.

    Where none does, the number is the id, and only ids are shuffled to find that out. Else the rows are sorted by ranges and
    written once. Rows with a null id have no number.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return docs.withColumn(NODE, F.col("doc_id")), False
    parts = partitions(docs.sparkSession, docs)
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = cut(known.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order))
    return ordered.withColumn(NODE, F.monotonically_increasing_id()).unionByName(docs.where("doc_id is null").withColumn(NODE, F.lit(None).cast("long"))), True


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``ROW``: all columns of ``docs`` but the text in one, where no name of an operator's own can clash with them."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias(ROW))


def opened(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``sealed`` has put away, in their order, and the text."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"{ROW}.`{c}`").alias(c) for c in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int):
    """crc32 of doc_id as text, modulo n; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def sample_ids(rows: DataFrame, per_class: int) -> list[tuple[int, str]]:
    """(doc_id, label) of at most ``per_class`` rows of each label, the same ones at every run, each label's in the order of a hash of the id.

    ``rows`` has doc_id and label (string). Rows without either take no part. Labels are counted first, so that
    the second pass returns about per_class rows of each and not whole classes. More than MOST_LABELS labels are an error.
    """
    rows = rows.where("doc_id is not null and label is not null").select("doc_id", "label")
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"there are more than {MOST_LABELS} labels")
    if not counts:
        return []
    shares = rows.sparkSession.createDataFrame([(r["label"], min(1.0, 1.3 * per_class / r["n"] + 40 / r["n"])) for r in counts], "label string, share double")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))
    got = rows.join(F.broadcast(shares), "label").withColumn("at", order).where(F.col("at") < F.col("share") * float(1 << 52)).collect()  # shares: MOST_LABELS rows at most
    taken: dict[str, int] = {}
    out, seen = [], set()
    for r in sorted(got, key=lambda r: (r["at"], r["doc_id"], r["label"])):
        if r["doc_id"] not in seen and taken.get(r["label"], 0) < per_class:
            taken[r["label"]] = taken.get(r["label"], 0) + 1
            seen.add(r["doc_id"])
            out.append((r["doc_id"], r["label"]))
    return out


def sample_texts(docs: DataFrame, rows: DataFrame, per_class: int, *more: str) -> list[tuple]:
    """(label, text, *more) of the sampled rows, sorted by doc_id: whole texts, SAMPLE_BYTES of them at most, an equal share for each label."""
    ids = sample_ids(rows, per_class)
    if not ids:
        return []
    spark = docs.sparkSession
    small = spark.createDataFrame(ids, "doc_id long, label string")  # bounded by per_class for each label
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(small), "doc_id").where("size is not null").groupBy("doc_id").agg(F.sum("size").alias("size"))
    sizes = {r["doc_id"]: r["size"] for r in sizes.collect()}
    room, kept = dict.fromkeys((label for _, label in ids), SAMPLE_BYTES // len({label for _, label in ids})), []
    for doc_id, label in ids:
        if (size := sizes.get(doc_id)) is not None and size <= room[label]:
            room[label] -= size
            kept.append((doc_id, label))
    if not kept:
        return []
    small = spark.createDataFrame(kept, "doc_id long, label string")
    got = docs.select("doc_id", "text", *more).join(F.broadcast(small), "doc_id").where("text is not null").collect()
    return [(r["label"], r["text"], *(r[m] for m in more)) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]
