"""Graph files: edge lists, large ids, binary adjacency, parts, and their writers. Paths are Spark's."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subweave.operators.clean import csr, neighbours, numbered, symmetric
from subweave.store import stored

#: Sizes of a vertex id and of an offset in binary files, which stand in their header.
VERTEX_BYTES, OFFSET_BYTES = 4, 8


def read_graph(spark: SparkSession, path: str, directed: bool = False, kind: str | None = None) -> DataFrame:
    """src, dst by the file's kind (txt, lvid, bin, adj), or its suffix. Undirected lists give both directions."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    readers: dict[str, Callable[[], DataFrame]] = {
        "txt": lambda: read_edge_list(spark, path, directed),
        "lvid": lambda: read_large_ids(spark, path, directed),
        "bin": lambda: read_binary(spark, path),
        "adj": lambda: _both(read_adjacency(spark, path), directed),
    }
    if kind not in readers:
        raise ValueError(f"no reader for graphs of kind {kind!r}")
    return readers[kind]()


def _both(edges: DataFrame, directed: bool) -> DataFrame:
    return edges if directed else symmetric(edges)


def _numbers(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"(\d+)"))


def raw_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of the lines that begin with a digit: their first two numbers."""
    rows = spark.read.text(path).where(F.col("value").rlike("^[0-9]")).select(F.split(F.trim("value"), r"\s+").alias("x"))
    return rows.where(F.size("x") >= 2).select(F.col("x")[0].cast("long").alias("src"), F.col("x")[1].cast("long").alias("dst"))


def read_edge_list(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """Edges with ids counted from the smallest; repeated edges and loops stay."""
    edges = raw_edges(spark, path)
    low = edges.agg(F.least(F.min("src"), F.min("dst")).alias("low")).first()["low"] or 0
    return _both(edges.select((F.col("src") - low).alias("src"), (F.col("dst") - low).alias("dst")), directed)


def _in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, block and row, which order them as they stand: Spark reads a block from its start, but blocks in an order of its own."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _counted_on(lines: DataFrame, weight: Column, name: str) -> DataFrame:
    """Lines with the sum of weights of all lines before them, in the order of the files: a block's start and the sum in it."""
    lines = lines.withColumn("_weight", weight.cast("long"))
    earlier = Window.unboundedPreceding, -1
    blocks = lines.groupBy("file", "block").agg(F.sum("_weight").alias("_sum"))
    bases = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(Window.orderBy("file", "block").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_weight").over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(*earlier)), F.lit(0))
    return lines.withColumn("_inner", inner).join(bases, ["file", "block"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_weight")


def _tokens(lines: DataFrame, column: str) -> DataFrame:
    """at and token: the elements of an array column of all lines in turn, counted from 0."""
    return _counted_on(lines, F.size(column), "before").select("before", F.posexplode(column).alias("pos", "token")).select((F.col("before") + F.col("pos")).alias("at"), "token")


def _in_pairs(tokens: DataFrame) -> DataFrame:
    """pair, a and b: each two tokens that follow each other; an odd last one is left out."""
    pairs = tokens.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min_by("token", "at").alias("a"), F.max_by("token", "at").alias("b"), F.count("*").alias("n"))
    return pairs.where("n = 2").drop("n")


def read_large_ids(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """Edges of ids of any length: the numbers of all lines that begin with a digit make pairs in turn, also across lines.

    An id is numbered when it first comes. An odd count of numbers is an error.
    """
    lines = _in_file_order(spark, path).where(F.col("value").rlike("^[0-9]")).withColumn("x", _numbers(F.col("value")))
    if (lines.agg(F.sum(F.size("x"))).first()[0] or 0) % 2:
        raise ValueError("the file has an odd count of numbers")
    tokens = _tokens(lines, "x")
    ranks = numbered(tokens.groupBy("token").agg(F.min("at").alias("at")), "at", "id").select("token", "id")
    a, b = ranks.select(F.col("token").alias("a"), F.col("id").alias("src")), ranks.select(F.col("token").alias("b"), F.col("id").alias("dst"))
    return _both(_in_pairs(tokens).join(a, "a").join(b, "b").select("src", "dst"), directed)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges of rows `u n v1 .. vn`, of one file or of several (paths with commas between)."""
    rows = spark.read.text(path.split(",")).select(F.split(F.trim("value"), r"\s+").alias("x")).where("size(x) > 2")
    return rows.select(F.col("x")[0].cast("long").alias("src"), F.explode(F.slice("x", F.lit(3), F.col("x")[1].cast("int")).cast("array<bigint>")).alias("dst"))


def clean_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The numbers of a file paired anew in turn, also across lines, and its other words paired in the same way: pair, a, b as text.

    Lines that begin with # are comments; spaces, tabs and commas part words. An odd count of numbers is an error.
    """
    lines = _in_file_order(spark, path).where(~F.col("value").startswith("#")).withColumn("words", F.array_remove(F.split("value", "[ ,\\t]+"), ""))
    lines = lines.withColumn("x", F.filter("words", lambda w: w.rlike("^[0-9]+$"))).withColumn("rest", F.filter("words", lambda w: ~w.rlike("^[0-9]+$")))
    if (lines.agg(F.sum(F.size("x"))).first()[0] or 0) % 2:
        raise ValueError("the file has an odd count of numbers")
    return _in_pairs(_tokens(lines, "x")), _in_pairs(_tokens(lines, "rest"))


def write_clean(spark: SparkSession, path: str, out: str) -> None:
    """out.clean with a pair of numbers a line, and out.fail with the words that are none, in their order."""
    for rows, end in zip(clean_lines(spark, path), ("clean", "fail"), strict=True):
        rows.orderBy("pair").select(F.concat_ws("\t", "a", "b").alias("value")).write.text(f"{out}.{end}")


def read_parts(spark: SparkSession, path: str | None, k: int, vertices: DataFrame | None = None) -> DataFrame:
    """part from files with the part of vertex 0, 1, .. a line; without a file, or for one part, all are in part 0."""
    if not path or k == 1:
        return vertices.select("v", F.lit(0).alias("pid"))
    lines = _in_file_order(spark, path).where("trim(value) <> ''")
    part = _counted_on(lines, F.lit(1), "v").select("v", F.trim("value").cast("int").alias("pid"))
    if part.agg(F.max("pid")).first()[0] != k - 1:
        raise ValueError(f"the file has not {k} parts")
    return part


def in_memory(spark: SparkSession, lists: dict[int, list[int]]) -> DataFrame:
    """adj from lists of neighbours."""
    return spark.createDataFrame(list(lists.items()), "v long, n array<long>").select(F.col("v").alias("src"), F.explode("n").alias("dst"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("content"):
            data = blob.as_buffer()
            head = np.frombuffer(data, "<u8", 4)
            if head[0] != VERTEX_BYTES or head[1] != OFFSET_BYTES:
                raise ValueError("ids or offsets of another size")
            n, m = int(head[2]), int(head[3])
            if data.size != 32 + (n + 1) * OFFSET_BYTES + m * VERTEX_BYTES:
                raise ValueError("the file is shorter or longer than its header says")
            offsets = np.frombuffer(data, "<u8", n + 1, 32).astype(np.int64)
            columns = np.frombuffer(data, "<u4", m, 32 + (n + 1) * OFFSET_BYTES)
            for lo in range(0, n, 1 << 16):
                own = offsets[lo : min(n, lo + (1 << 16)) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(lo, lo + len(own) - 1), np.diff(own))), pa.array(columns[own[0] : own[-1]].astype(np.int64))], names=["src", "dst"])


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """adj of a binary file of at most 2 GB: a header of four 64-bit numbers, offsets, neighbours."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, "src long, dst long")


def write_binary(adj: DataFrame, path: str) -> None:
    """One binary file, streamed through the driver a megabyte at a time; vertices are 0.. without gaps."""
    spark = adj.sparkSession
    rows = stored(csr(adj), "csr")
    n, m = rows.count(), rows.agg(F.coalesce(F.sum(F.size("n")), F.lit(0))).first()[0]
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = own.getFileSystem(spark._jsc.hadoopConfiguration()).create(own, True)

    def send(parts: Iterator[bytes]) -> None:
        held = bytearray()
        for part in parts:
            held += part
            if len(held) >= 1 << 20:
                out.write(held)
                held = bytearray()
        out.write(held)

    try:
        send(iter([struct.pack("<4Q", VERTEX_BYTES, OFFSET_BYTES, n, m)]))
        send(struct.pack("<Q", r["offset"]) for r in rows.select("v", "offset").orderBy("v").toLocalIterator())
        send(iter([struct.pack("<Q", m)]))
        send(np.array(r["n"], "<u4").tobytes() for r in rows.select("v", "n").orderBy("v").toLocalIterator())
    finally:
        out.close()


def edge_lines(adj: DataFrame) -> DataFrame:
    """value: each undirected edge once, tab between."""
    return adj.where("src < dst").select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def adjacency_lines(adj: DataFrame) -> DataFrame:
    """v and value: the vertex, a tab, its neighbours."""
    return neighbours(adj).select("v", F.concat_ws("\t", F.col("v").cast("string"), F.concat_ws(" ", F.col("n").cast("array<string>"))).alias("value"))


def info_line(adj: DataFrame) -> DataFrame:
    """value: vertices and directed edges."""
    return adj.agg(F.concat_ws(" ", F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0)).cast("string"), F.count("*").cast("string")).alias("value"))


def write_graph(adj: DataFrame, path: str, kind: str) -> None:
    """Write as path.snap.txt, path.adj.txt with path.info, or path.bin."""
    if kind == "txt":
        edge_lines(adj).write.text(f"{path}.snap.txt")
    elif kind == "adj":
        adjacency_lines(adj).orderBy("v").select("value").write.text(f"{path}.adj.txt")
        info_line(adj).write.text(f"{path}.info")
    elif kind == "bin":
        write_binary(adj, f"{path}.bin")
    else:
        raise ValueError(f"no writer for graphs of kind {kind!r}")


def write_lines(header: DataFrame, rows: DataFrame, by: list[str], path: str) -> None:
    """A header line and rows in order: weights for partitioners. Parts sort behind each other; the header comes first."""
    first = header.select(F.lit(0).alias("_kind"), F.col("line"), *(F.lit(None).cast("long").alias(c) for c in by))
    both = first.unionByName(rows.select(F.lit(1).alias("_kind"), "line", *by))
    both.orderBy("_kind", *by).select("line").write.text(path)


#: What weights by the patterns q0 to q11 are called in file names. Other patterns have no name.
WEIGHT_NAMES = ("triangle", "square", "chordalsquare", "fourclique", "house", "quadsquare", "near5clique", "fiveclique", "q8", "q9", "q10", "q11")


def weight_path(path: str, kind: str, pattern_name: str) -> str:
    """File name of weights: kind is motifcut, weight or veweight; what the pattern is called, or uniform, comes last."""
    if kind not in ("motifcut", "weight", "veweight"):
        raise ValueError(kind)
    if pattern_name == "line":
        return f"{path}.{kind}.uniform"
    number = pattern_name.split("_")[0].removeprefix("q")
    if not number.isdigit() or int(number) >= len(WEIGHT_NAMES):
        raise ValueError(f"no file name for weights by {pattern_name}")
    return f"{path}.{kind}.{WEIGHT_NAMES[int(number)]}"
