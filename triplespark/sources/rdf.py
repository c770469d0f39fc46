"""N-Triples and JSON-LD files, stores, and the files that file individuals stand for."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .jsonld import bad_jsonld, parse_jsonld

# Escapes of characters by number: neither surrogates nor numbers beyond all characters.
_CODE = r"\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9A-Fa-f]{4}"
_IRI = rf"<(?:[^<>\\]|{_CODE})*+>"
#: One statement of a line: subject, predicate, and an entity, or a literal with language or datatype. Possessive, so that long literals need no stack.
_LINE = rf"""^\s*+({_IRI}|_:\S+)\s++({_IRI})\s*+(?:({_IRI}|_:[^\s.]+(?:\.[^\s.]+)*)|"((?:[^"\\]++|\\[tbnrf"'\\]|{_CODE})*+)"(?:@([A-Za-z0-9-]+)|\^\^({_IRI}))?)\s*+\.\s*+(?:#.*+)?$"""

#: Escapes and what they stand for (fixed values).
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """All escapes in one pass from left to right."""
    found = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
    return text.map(lambda x: x and found.sub(lambda m: _ESCAPES[m[3]] if m[3] else chr(int(m[1] or m[2], 16)), x))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files; files split by line."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """The triples of N-Triples lines (value); empty lines, comments and what isn't a statement (see `bad_lines`) are left out."""
    names = ("s", "p", "e", "v", "lang", "dt")
    rows = lines.where(F.col("value").rlike(_LINE)).select("value", *[F.regexp_extract("value", _LINE, n + 1).alias(c) for n, c in enumerate(names)])
    coded = F.col("value").contains("\\")
    clean = rows.where(~coded).unionByName(rows.where(coded).withColumns({c: _unescaped(c) for c in names if c != "lang"})).drop("value")
    bare = lambda c: F.when(F.col(c).startswith("<"), F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.col(c))
    entity = F.col("e") != ""
    s, o = bare("s"), F.when(entity, bare("e")).otherwise(F.col("v"))
    datatype = F.when(entity, "").when(F.col("lang") != "", S.RDF + "langString").when(F.col("dt") != "", bare("dt")).otherwise(S.XSD + "string")
    return clean.select(s.alias("s"), S.kind_of(s).alias("s_kind"), bare("p").alias("p"), o.alias("o"), F.when(entity, S.kind_of(o)).otherwise("literal").alias("o_kind"), datatype.alias("o_dt"), F.lower("lang").alias("o_lang")).distinct()


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines that are neither statements, comments nor empty."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def _escaped_iri(c: str) -> Column:
    """An IRI in angle brackets, with what can't stand there as \\u escapes."""
    own = F.replace(F.col(c), F.lit("\\"), F.lit("\\u005C"))
    for x in [*map(chr, range(33)), *'<>"{}|^`']:
        own = F.replace(own, F.lit(x), F.lit(f"\\u{ord(x):04X}"))
    return F.concat(F.lit("<"), F.when(F.col(c).rlike(r"""[\x00-\x20<>"{}|^`\\]"""), own).otherwise(F.col(c)), F.lit(">"))


def ntriples_lines(t: DataFrame) -> DataFrame:
    """(value): a line for each triple with an entity as subject."""
    term = lambda c, kind: F.when(F.col(kind) == "bnode", F.col(c)).otherwise(_escaped_iri(c))
    escaped = F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\"))
    for code, character in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"')):
        escaped = F.replace(escaped, F.lit(character), F.lit(code))
    end = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isin("", S.XSD + "string"), "").otherwise(F.concat(F.lit("^^"), _escaped_iri("o_dt")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), end)).otherwise(term("o", "o_kind"))
    return t.where("s_kind <> 'literal'").select(F.concat(term("s", "s_kind"), F.lit(" "), _escaped_iri("p"), F.lit(" "), o, F.lit(" .")).alias("value"))


def write_ntriples(t: DataFrame, path: str, mode: str = "error") -> None:
    """Writes the graph as N-Triples files, in parallel."""
    ntriples_lines(t).write.mode(mode).text(path)


_VALUES = "array<map<string,string>>"


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """The triples of JSON-LD files: a list of node objects, one node, or a context with a graph."""
    return parse_jsonld(spark.read.text(path, wholetext=True))


#: Node objects that a subject's values may be spread over, so that a hub's are not in one.
NODE_PARTS = 64


def jsonld_nodes(t: DataFrame) -> DataFrame:
    """(value): node objects of each subject, links by hash in up to `NODE_PARTS` with the same @id; each value keeps its datatype or language."""
    value = F.when(F.col("o_kind") != "literal", F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@type"), F.lit(None).cast("string").alias("@language")))
    value = value.otherwise(F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.when(F.col("o_lang") == "", F.col("o_dt")).alias("@type"), F.when(F.col("o_lang") != "", F.col("o_lang")).alias("@language")))
    spread = F.when(F.col("o_kind") == "literal", F.lit(0)).otherwise(F.pmod(F.xxhash64("o"), F.lit(NODE_PARTS)).cast("int"))
    sets = t.where("s_kind <> 'literal'").groupBy("s", spread.alias("_n"), "p").agg(F.sort_array(F.collect_list(F.to_json(value))).alias("v"))
    line = F.concat(F.to_json(F.array("p")), F.lit(":["), F.concat_ws(",", "v"), F.lit("]"))
    line = F.regexp_replace(line, r"^\[(.*?)\]:\[", "$1:[")
    nodes = sets.groupBy("s", "_n").agg(F.sort_array(F.collect_list(line)).alias("parts"))
    return nodes.select(F.concat(F.lit('{"@id":'), F.regexp_replace(F.to_json(F.array("s")), r"^\[|\]$", ""), F.lit(","), F.concat_ws(",", "parts"), F.lit("}")).alias("value"))


def write_jsonld(t: DataFrame, path: str, mode: str = "error") -> None:
    """Writes a node object for each subject on a line of its own; each line is a JSON-LD document, read again with `read_jsonld_lines`."""
    jsonld_nodes(t).write.mode(mode).text(path)


def read_jsonld_lines(spark: SparkSession, path: str) -> DataFrame:
    """The triples of files that hold a node object on each line."""
    return parse_jsonld_lines(spark.read.text(path))


def parse_jsonld_lines(lines: DataFrame) -> DataFrame:
    """The triples of node objects (value), one on each line."""
    nodes = lines.select(F.from_json("value", "map<string,string>").alias("n"))
    rows = nodes.select(F.col("n")["@id"].alias("s"), F.explode("n").alias("p", "v")).where("p <> '@id' and s is not null")
    values = rows.select("s", "p", F.explode(F.from_json("v", _VALUES)).alias("x"))
    x = F.col("x")
    datatype = F.coalesce(x["@type"], F.when(x["@language"].isNotNull(), F.lit(S.RDF + "langString")), F.lit(S.XSD + "string"))
    made = F.when(x["@id"].isNotNull(), S.link(F.col("s"), F.col("p"), x["@id"])).otherwise(S.literal(F.col("s"), F.col("p"), x["@value"], datatype, F.coalesce(x["@language"], F.lit(""))))
    return S.from_structs(values, made)


def predicate_group(tb_kinds: DataFrame, t: DataFrame) -> DataFrame:
    """`t` with grp: type, attribute, link or other, by which a store is partitioned."""
    kinds = tb_kinds.where(F.col("kind").isin("relationship", "attribute")).select(F.col("s").alias("p"), "kind")
    group = F.when(F.col("p") == S.TYPE, "type").when(F.col("kind") == "attribute", "attribute").when(F.col("kind") == "relationship", "link").otherwise("other")
    return t.join(kinds, "p", "left").select(*S.COLUMNS, group.alias("grp"))


def write_store(t: DataFrame, tb, path: str, mode: str = "error") -> None:
    """Writes the graph as Parquet, partitioned by group of predicates and sorted by subject within files."""
    predicate_group(tb.kinds, t).sortWithinPartitions("grp", "s").write.mode(mode).partitionBy("grp").parquet(path)


def read_store(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """The graph of a store; a group alone reads its partition only."""
    rows = spark.read.parquet(path)
    if group is not None:
        rows = rows.where(F.col("grp") == group)
    return rows.select(*S.COLUMNS)


def read_jdbc(spark: SparkSession, url: str, table: str = "triples", parts: int = 1, part: str | None = None, **options: str) -> DataFrame:
    """The graph of a database table with the columns of a graph.

    With `parts` the table is read by so many tasks at once, each with its own condition: `part` is the
    database's expression for a row's number from 0 to parts - 1, with {parts} for their number, such
    as a hash of the subject. Rows for which it is null come with the first.
    """
    if parts == 1:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*S.COLUMNS)
    if part is None:
        raise ValueError("an expression is needed by which rows are dealt to parts")
    number = part.format(parts=parts)
    predicates = [f"{number} = {n}" + (f" or ({number}) is null" if n == 0 else "") for n in range(parts)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=options).select(*S.COLUMNS)


def write_jdbc(t: DataFrame, url: str, table: str = "triples", mode: str = "error", **options: str) -> None:
    """Writes the graph as a database table, in parallel."""
    t.select(*S.COLUMNS).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_files(rows: DataFrame, path: str) -> None:
    """Stores a file for each row (key, text) below a folder that all tasks can open; a key's slashes are folders' ends.

    Written anew, a file has the same content, so a task that runs twice does no harm.
    """
    folder = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString()

    def save(part: Iterator) -> None:
        fs, own = pfs.FileSystem.from_uri(uri)
        for row in part:
            name = f"{own}/{row['key']}"
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(row["text"].encode())

    rows.select("key", "text").foreachPartition(save)


#: Bytes that are read and hashed at a time.
READ = 4 << 20


def _streamable(path: str) -> bool:
    """Whether tasks can open files of this place as streams themselves."""
    try:
        pfs.FileSystem.from_uri(path)
    except Exception:  # noqa: BLE001 - whatever the library makes of a scheme it doesn't know
        return False
    return True


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder, whatever their size.

    Files are hashed as streams, a few megabytes at a time; where only Spark can open the place,
    each file is read as one value, which holds up to two gigabytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = found.select("path").first()
    if first is not None and not _streamable(first["path"]):
        return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                fs, own = pfs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with fs.open_input_stream(own) as stream:
                    while data := stream.read(READ):
                        digest.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "size", "sha256"])

    # Lengths alone are read here; a task takes a file at a time.
    return found.select("path", F.col("length").alias("size")).repartition(F.xxhash64("path")).mapInArrow(run, "path string, size long, sha256 string")


def file_manifest(spark: SparkSession, path: str, t: DataFrame) -> DataFrame:
    """(s, storage_key, size, sha256) of each file individual.

    Its content is the file below `path` whose name is the base-64 form of its IRI, in which a slash is a
    folder's end; size and sha256 are null where there is none.
    """
    files = t.where((F.col("p") == S.TYPE) & (F.col("o") == S.FILE)).select("s").distinct()
    files = files.withColumn("storage_key", F.regexp_replace(F.base64(F.encode("s", "UTF-8")), r"\s", ""))
    # A stored file's name is what follows the folder, as the file system itself writes that.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(folder).toUri().getPath().rstrip("/") + "/"
    begin = F.locate(folder, "path")
    stored = hashed_files(spark, path).select(F.substring("path", begin + len(folder), F.length("path")).alias("storage_key"), "size", "sha256")
    return files.join(stored, "storage_key", "left").select("s", "storage_key", "size", "sha256")


def main_individual(t: DataFrame, individuals: DataFrame) -> DataFrame:
    """(s): the individual flagged as main, the first by name of several; all individuals if none is flagged."""
    flagged = t.where((F.col("p") == S.MAIN) & (F.col("o") == "true") & (F.col("o_dt") == S.XSD + "boolean")).select("s")
    first = individuals.join(flagged, "s", "left_semi").agg(F.min("s")).first()[0]
    return individuals if first is None else individuals.where(F.col("s") == first)
