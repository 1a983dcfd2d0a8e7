"""Token counts by scanning flat token files for separators.

A flat file is nothing but token ids of 2 or 4 bytes, each document followed by
an end-of-document id; there is no index.  Files are read in blocks of a fixed
number of bytes, many blocks of one file at once.  In a block a vectorised
comparison finds the separators; a block reports its length and their places.
A prefix scan over the blocks of a file (running counts of separators and of
tokens since the last one) then says which document each block begins in and
how many of its tokens came before, which stitches documents across borders.

``write_flat`` makes such files.  Its tasks write to a name of their own and
rename at the end, so a task that runs twice leaves the same file.

Nulls: a null text is an empty document of 0 tokens; a null doc_id keeps its
count; repeated rows are documents of their own.  Texts of any length are
written whole and their tokens may fill many blocks.  Files of one name cannot
tie, and other columns are not read.  An empty table gives no rows.  Tokens after the last separator are a document that
was cut off, reported with ``closed`` false.  Empty files have no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.llm.common import cut

BLOCK_BYTES = 4 << 20
#: Blocks of one file that are summed in one group.
RUN = 4096


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    sc = spark.sparkContext
    cut(spark.range(1))  # sets a checkpoint folder where none is
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level encoding of a ranks file."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> np.ndarray:
    return np.array(encoding(path).encode_ordinary(text), dtype=np.uint32)


def write_flat(docs: DataFrame, to: str, tokenizer: str, *, eod: int, width: int = 2) -> DataFrame:
    """Write the tokens of ``docs`` as one flat file a partition; returns (file, doc, doc_id) by position.

    The result is run once and kept, since running it writes the files.
    """
    kind = f"<u{width}"
    most = max(eod, encoding(tokenizer).max_token_value)
    if most >= 1 << 8 * width:
        raise ValueError(f"token ids up to {most} do not fit in {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(to)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.tokens"
        own = f"{base}/_{name}.{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                end = np.array([eod], dtype=kind).tobytes()
                for start in range(0, len(texts), 256):
                    part = [encode(tokenizer, t) for t in texts[start : start + 256]]
                    out.write(b"".join(t.astype(kind).tobytes() + end for t in part))
                files = pa.array([name] * len(texts), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [files, pa.array(range(n, n + len(texts)), pa.int64()), batch.column(0)], ["file", "doc", "doc_id"]
                )
                n += len(texts)
        fs.move(own, f"{base}/{name}")

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "file string, doc long, doc_id long"))


def blocks_of(spark: SparkSession, at: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, begin, size) of all blocks of the flat files in a folder."""
    fs, base = pafs.FileSystem.from_uri(at)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    rows = [(f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".tokens")]
    files = spark.createDataFrame(rows, "file string, bytes long")
    last = F.floor((F.col("bytes") - 1) / block_bytes).cast("long")
    blocks = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    begin = F.col("block") * block_bytes
    return blocks.select("file", "block", begin.alias("begin"), F.least(F.lit(block_bytes), F.col("bytes") - begin).alias("size"))


def scan_flat(blocks: DataFrame, at: str, *, eod: int, width: int = 2) -> DataFrame:
    """(file, doc, n_tokens, closed): the documents of flat files in order."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(at)
        for batch in batches:
            for file, block, begin, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{file}") as source:
                    ids = np.frombuffer(source.read_at(size, begin), dtype=kind)
                ends = np.flatnonzero(ids == eod).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([ends], pa.list_(pa.int32()))],
                    ["file", "block", "tokens", "ends"],
                )

    dealt = blocks.repartition("file", "block")
    found = cut(dealt.mapInArrow(run, "file string, block long, tokens long, ends array<int>"))
    placed = found.select("file", "block", "ends").join(_prefixes(found), ["file", "block"])
    lengths = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.col("doc") + i).alias("doc"),
            F.when(i == 0, F.col("open") + e).otherwise(e - F.get("ends", i - 1) - 1).cast("long").alias("n_tokens"),
            F.lit(True).alias("closed"),
        ),
    )
    cut_off = F.struct((F.col("doc") + F.size("ends")).alias("doc"), F.col("tail").alias("n_tokens"), F.lit(False).alias("closed"))
    every = F.when(F.col("tail") > 0, F.concat(lengths, F.array(cut_off))).otherwise(lengths)
    return placed.select("file", F.explode(every).alias("d")).select("file", "d.*")


def _prefixes(found: DataFrame) -> DataFrame:
    """(file, block, doc, open, tail): documents closed before a block, tokens open at its begin and left at the file's end.

    A scan in two levels over the blocks' summaries: inside runs of RUN blocks,
    then over the runs of a file, so a file of any size is no hot group.
    """
    ends = F.size("ends").cast("long")
    last = F.when(ends > 0, F.element_at("ends", -1).cast("long") + 1)
    blocks = found.select("file", "block", F.floor(F.col("block") / RUN).alias("run"), "tokens", ends.alias("n"), last.alias("last"))
    zero = F.lit(0).cast("long")
    inside = Window.partitionBy("file", "run").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "*", F.coalesce(F.sum("tokens").over(earlier), zero).alias("before"), F.coalesce(F.sum("n").over(earlier), zero).alias("docs")
    )
    blocks = blocks.withColumn("last", F.col("before") + F.col("last"))
    blocks = cut(blocks.withColumn("opened", F.max("last").over(earlier)))  # places are relative to the run
    runs = blocks.groupBy("file", "run").agg(F.sum("tokens").alias("run_tokens"), F.sum("n").alias("run_docs"), F.max("last").alias("run_last"))
    over = Window.partitionBy("file").orderBy("run")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "file", "run", "run_tokens", F.coalesce(F.sum("run_tokens").over(past), zero).alias("base"),
        F.coalesce(F.sum("run_docs").over(past), zero).alias("base_docs"), "run_last", F.lead("run").over(over).isNull().alias("final"),
    )
    runs = runs.withColumn("base_last", F.coalesce(F.max(F.col("base") + F.col("run_last")).over(past), zero))
    both = blocks.join(runs, ["file", "run"])
    opened = F.coalesce(F.col("base") + F.col("opened"), F.col("base_last"))
    before = F.col("base") + F.col("before")
    at_end = F.col("final") & (F.col("before") + F.col("tokens") == F.col("run_tokens"))
    tail = before + F.col("tokens") - F.coalesce(F.col("base") + F.col("last"), opened)
    return both.select(
        "file", "block", (F.col("base_docs") + F.col("docs")).alias("doc"), (before - opened).alias("open"),
        F.when(at_end, tail).otherwise(zero).alias("tail"),
    )


def count_tokens(docs: DataFrame, tokenizer: str, *, eod: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, file, doc, n_tokens, counted in the flat files written from ``docs``."""
    spark = docs.sparkSession
    at = folder(spark, "tokens")
    fs, base = pafs.FileSystem.from_uri(at)
    fs.create_dir(base, recursive=True)
    order = write_flat(docs, at, tokenizer, eod=eod, width=width)
    counts = scan_flat(blocks_of(spark, at, block_bytes=block_bytes), at, eod=eod, width=width)
    counts = cut(counts.filter("closed"))
    fs.delete_dir(base)  # the counts are kept, so nothing reads the files again
    # Both sides have a row a document: never a broadcast, whatever the planner's estimate.
    return order.join(counts.hint("shuffle_merge"), ["file", "doc"]).select("doc_id", "file", "doc", "n_tokens")
