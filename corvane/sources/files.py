"""Sources: folders of files, uploads, JSON chunk stores, graphs in XML, learnt-ranking rows, checked and made into documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

# What a walk takes and leaves, and its limit.
INCLUDE = ("**/*.md", "**/*.txt", "**/*.json", "**/*.py")
EXCLUDE = ("**/.env*", "**/secrets*", "**/*.ckpt", "**/*.pt", "**/*.safetensors", "**/*.bin", "**/*.pkl", "**/*.zarr", "**/__pycache__/**", "**/node_modules/**", "**/.git/**", "**/target/**", "**/htmlcov/**", "**/unsloth_compiled_cache/**")
MOST_BYTES = 2 * 1024 * 1024
SUFFIXES = (".md", ".txt", ".json", ".py")


def ignored(text: str) -> list[str]:
    """SRC-3: the patterns of an ignore file, without comments and empty lines."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def name_pattern(segment: str) -> str:
    """A glob's segment as a regular expression: * is any run and ? one of characters other than a slash, [...] one of a class."""
    kinds = re.compile(r"(?P<run>\*+)|(?P<one>\?)|\[(?P<no>[!^]?)(?P<set>[^]]+)\]|(?P<plain>.)", re.S)
    out = []
    for x in kinds.finditer(segment):
        if x["run"]:
            out.append("[^/]*")
        elif x["one"]:
            out.append("[^/]")
        elif x["set"]:
            out.append("[" + "^/" * bool(x["no"]) + re.sub(r"([\\\[&])", r"\\\1", x["set"]) + "]")
        else:
            out.append(re.escape(x["plain"]))
    return "".join(out)


def glob_pattern(glob: str, below: bool = False) -> str:
    """A glob as one regular expression over relative paths.

    A glob is a list of segments between slashes; the segment ** stands for any number of
    folders, none too. It begins at the root if it has a slash inside and doesn't begin
    with **, else at any folder. It ends where the path ends; a name without wildcards, a
    glob that ends with a slash or with **, and with below any glob, also stand for
    all that lies below a folder of that name.
    """
    segments = [x for x in glob.split("/") if x]
    if not segments:
        return r"(?!)"
    rooted = "/" in glob.strip("/") and segments[0] != "**" or glob.startswith("/")
    inner = [x for n, x in enumerate(segments) if x != "**" or 0 < n < len(segments) - 1]
    if not inner:
        return r"^"
    parts = "".join(r"(?:[^/]+/)*" if x == "**" else name_pattern(x) + "/" for x in inner)[:-1]
    if segments[-1] == "**" or glob.endswith("/"):
        end = "/"
    elif below or len(segments) == 1 and not re.search(r"[*?\[]", glob):
        end = "(?:/|$)"
    else:
        end = "$"
    return ("^" if rooted else "(?:^|/)") + parts + end


def matches(path: Column, globs: list[str] | tuple[str, ...], below: bool = False) -> Column:
    """SRC-2, SRC-4: whether a relative path matches one of the globs, see glob_pattern(); all of them are one regular expression."""
    return path.rlike("|".join(f"(?:{glob_pattern(g, below)})" for g in globs) or r"(?!)")


def verdict(path: Column, size: Column, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, most: int = MOST_BYTES) -> Column:
    """SRC-2, SRC-6: glob, size or ok, before a file is read. What lies below an excluded folder is excluded."""
    return F.when(matches(path, exclude, True) | ~matches(path, include), "glob").when(size > most, "size").otherwise("ok")


def is_binary(content: Column) -> Column:
    """SRC-5: a zero byte among the first 512."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(..)*00")


def stats(files: DataFrame) -> DataFrame:
    """SRC-7: one row of counts over files (verdict, kind)."""
    why = {w: F.count_if(F.col("verdict") == w).alias(f"skipped_{w}") for w in ("glob", "size", "binary")}
    kinds = {k: F.count_if((F.col("verdict") == "ok") & (F.col("kind") == k)).alias(k) for k in ("markdown", "python", "json", "text")}
    return files.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("verdict") == "ok").alias("accepted"), *why.values(), *kinds.values())


def walk(spark: SparkSession, root: str, section: str = "docs", include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, ignore: str = "") -> tuple[DataFrame, DataFrame]:
    """SRC-1: (documents, files) under a folder. documents: doc_id, content with its header, kind, path, relative, size, mtime; files: relative, size, verdict, kind.

    Names and sizes come from a listing that opens no file, so that a file may have any
    size; then the accepted ones alone are read. Their paths pass through the driver, where
    Spark's file index has them anyway. Bytes that aren't UTF-8 are replaced. ignore is the
    text of an ignore file. Names that start with a dot or an underscore Spark doesn't
    list, so they are neither seen nor counted. A file that goes in between is left out.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    plain = re.sub(r"^file:/+", "/", base)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.col("path").alias("uri"), "length", "modificationTime")
    path = F.regexp_replace(F.regexp_replace("uri", "^file:/+", "/"), "%20", " ")
    own = listed.withColumn("path", path).withColumn("relative", F.substring("path", F.lit(len(plain) + 2), F.length("path")))
    own = own.withColumns({"early": verdict(F.col("relative"), F.col("length"), include, (*exclude, *ignored(ignore))), "kind": T.kind_of(F.col("path"))})
    taken = [r.uri for r in own.filter("early = 'ok'").select("uri").collect()]
    if taken:
        literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", x) for x in taken]  # load() takes globs
        read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(literal).filter(F.col("length") <= MOST_BYTES)
    else:
        read = spark.createDataFrame([], "path string, content binary")
    read = read.select(F.col("path").alias("uri"), "content")
    binary = read.select("uri", is_binary(F.col("content")).alias("binary"))
    files = own.join(binary, "uri", "left").select("relative", F.col("length").alias("size"), F.when((F.col("early") == "ok") & F.coalesce("binary", F.lit(False)), "binary").otherwise(F.col("early")).alias("verdict"), "kind")
    good = own.filter("early = 'ok'").join(read.filter(~is_binary(F.col("content"))), "uri")
    header = T.source_header(T.basename(F.col("path")), T.section_of(F.lit(plain.rsplit("/", 1)[-1]), F.col("kind")) if section == "docs" else F.lit(section), F.date_format("modificationTime", "yyyy-MM-dd"))
    content = F.make_valid_utf8(F.col("content").cast("string"))
    docs = good.select(T.stable_id(F.col("path")).alias("doc_id"), T.with_header(content, header).alias("content"), "kind", "path", "relative", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return docs, files


def checked_uploads(uploads: DataFrame, most_files: int = 100, most_bytes: int = MOST_BYTES, most_total: int = 20 * MOST_BYTES) -> DataFrame:
    """SRC-17: uploads (ord, name, content) with reason, the first check that a file fails, null if it passes all. Files count towards the total in their order."""
    from pyspark.sql import Window

    w = Window.orderBy("ord")  # one request's files, most_files at most; the checks below don't look at more
    own = uploads.orderBy("ord").limit(most_files + 1)
    size = F.length("content")
    own = own.withColumns({"_n": F.row_number().over(w), "_total": F.sum(size).over(w), "_same": F.row_number().over(Window.partitionBy("name").orderBy("ord"))})
    text = F.col("content").cast("string")
    suffix = F.lower(F.regexp_extract("name", r"[^./](\.[^./]+)$", 1))
    unsafe = F.col("name").isNull() | (F.col("name") == "") | F.col("name").rlike(r"[\x00\\]|^/|(^|/)\.{0,2}(/|$)")
    reason = (
        F.when(F.col("_n") > most_files, "too_many_files").when(unsafe, "unsafe_filename").when(~suffix.isin(*SUFFIXES), "unsupported_file_type").when(F.col("_same") > 1, "duplicate_filename")
        .when(size > most_bytes, "file_too_large").when(F.col("_total") > most_total, "upload_too_large").when(F.col("content").isNull() | (size == 0), "empty_file").when(F.hex("content").rlike("^(..)*00"), "binary_file")
        .when(~F.is_valid_utf8(text), "invalid_utf8").when(F.regexp_replace(text, r"\s", "") == "", "empty_file")
    )
    return own.withColumn("reason", reason).drop("_n", "_total", "_same")


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: (chunk_id, content, file_path, chunk_index, source_doc_id) of a JSON file that maps ids to chunks."""
    shape = "map<string, struct<content:string, file_path:string, chunk_index:int, source_doc_id:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m"))
    return whole.select(F.explode("m").alias("chunk_id", "c")).select("chunk_id", "c.*")


def graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-11: nodes (id, attributes) and edges (a, b, attributes) of a GraphML file; keys are resolved by their declarations."""
    read = lambda tag, shape: spark.read.format("xml").option("rowTag", tag).schema(shape).load(path)
    data = "data array<struct<_key:string, _VALUE:string>>"
    keys = read("key", "`_id` string, `_attr.name` string")
    names = {r[0]: r[1] for r in keys.collect()}  # a file declares a handful
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values()))) if names else F.create_map()
    named = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(F.element_at(known, d["_key"]), d["_key"]), d["_VALUE"])))
    nodes = read("node", f"`_id` string, {data}").select(F.col("_id").alias("id"), named.alias("attributes"))
    return nodes, read("edge", f"`_source` string, `_target` string, {data}").select(F.col("_source").alias("a"), F.col("_target").alias("b"), named.alias("attributes"))


def ranking_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """SRC-14: learnt-ranking rows of a JSON-lines file whose header row must name just these features, in this order."""
    shape = "feature_names array<string>, query_id string, item_id string, rank int, label int, features array<double>"
    rows = spark.read.schema(shape).json(path)
    head = rows.filter("feature_names is not null").limit(2).collect()
    if len(head) != 1 or list(head[0].feature_names) != names:
        raise ValueError("the file's features are not the expected ones")
    return rows.filter("feature_names is null").drop("feature_names")
