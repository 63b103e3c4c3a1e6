"""Token counts of flat token files without an index, by a scan for the end-of-document id.

A file is nothing but little-endian ids. It is cut into blocks; each task reads its blocks' bytes, finds all
separators in one vectorised comparison, and sends their places. What a document's start is depends on all blocks
before: a prefix scan (count of separators, place of the last one) over blocks in groups, then over groups,
stitches documents that cross blocks. No task holds more than a block, or a group's summaries.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import also_staged, shared_dir, small_batches, stage, utf8
from reviewlake.llm.wordbpe import word_bpe

END = 49407
#: Ids in a block, and blocks in a group of the prefix scan.
BLOCK, GROUP = 1 << 20, 1024


def open_fs(uri: str):
    """A file system that tasks can open on every machine, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_token_files(docs: DataFrame, tokenizer: str, end: int = END, width: int = 2) -> tuple[str, DataFrame]:
    """Write one flat file a task to the shared folder. Returns the folder, and doc_id by file and ordinal.

    A file appears under its name only when it is whole, and a task that runs again writes the same bytes.
    """
    spark = docs.sparkSession
    folder = also_staged(f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    system, path = open_fs(folder)
    system.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        bpe = word_bpe(tokenizer, True)
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        draft = f"{top}/.{name}-{uuid.uuid4().hex}"
        at, out = 0, None
        for b in batches:
            out = out or fs.open_output_stream(draft)
            for ids in bpe.ids(b.column(1).to_pylist()):
                out.write(np.append(ids, np.uint32(end)).astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(b), pa.string()), pa.array(range(at, at + len(b)), pa.int64())], ["doc_id", "file", "ordinal"])
            at += len(b)
        if out:
            out.close()
            fs.move(draft, f"{top}/{name}")

    kind = dict(docs.dtypes)["doc_id"]
    with small_batches(spark):
        return folder, stage(docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, f"doc_id {kind}, file string, ordinal long"), "token-files")


def block_separators(spark: SparkSession, folder: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, first, n, places (absolute, of the separators) of every block of every file in the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", F.floor(F.col("length") / width).alias("ids"))
    cut = files.where("ids > 0").select("path", "ids", F.explode(F.expr(f"sequence(0, (ids - 1) div {block})")).alias("block"))
    cut = cut.select("path", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block), F.col("ids") - F.col("block") * block).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, k, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(n * width, first * width), f"<u{width}")
                places = pa.array([np.flatnonzero(ids == end) + first], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([k]), pa.array([first]), pa.array([n]), places], ["file", "block", "first", "n", "places"])

    dealt = cut.repartition(F.col("path"), F.col("block"))
    return dealt.mapInArrow(run, "file string, block long, first long, n long, places array<long>")


def stitch(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated of every document; ids after a file's last separator are one that isn't terminated."""
    blocks = blocks.withColumns({"grp": F.floor(F.col("block") / group), "seps": F.size("places"), "last": F.try_element_at("places", F.lit(-1))})
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("file", "grp").agg(F.sum("seps").alias("seps"), F.max("last").alias("last"))
    over = before("file", "grp")
    groups = groups.select("file", "grp", F.coalesce(F.sum("seps").over(over), F.lit(0)).alias("docs_before"), F.max("last").over(over).alias("last_before"))
    inner = before("file", "grp", "block")
    scanned = blocks.select("*", F.coalesce(F.sum("seps").over(inner), F.lit(0)).alias("here"), F.max("last").over(inner).alias("last_here")).join(groups, ["file", "grp"])
    start = F.coalesce(F.col("last_here"), F.col("last_before"), F.lit(-1).cast("long")) + 1
    scanned = scanned.withColumns({"base": F.col("docs_before") + F.col("here"), "open": start})
    pairs = F.transform("places", lambda p, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.get("places", i - 1) + 1).alias("start"), p.alias("end")))
    each = scanned.select("file", "base", F.posexplode(pairs).alias("k", "d"))
    whole = each.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = blocks.groupBy("file").agg(F.sum("seps").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("start"), F.max(F.col("first") + F.col("n")).alias("ids"))
    tails = tails.where("ids > start").select("file", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(tails)


def document_tokens(docs: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every row, counted in the flat files that its text went to.

    Null and empty texts have 0 tokens; repeated rows each have their place; an empty table gives no rows.
    """
    folder, names = write_token_files(docs, tokenizer, end)
    found = stitch(stage(block_separators(docs.sparkSession, folder, end, 2, block), "separators"))
    return names.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
