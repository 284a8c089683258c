"""Reading and writing of files: text tables, schema checks, latest files, walks and snapshots."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = {"csv": ",", "tsv": "\t", "ttxt": "\t", "psv": "|", "ptxt": "|"}


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file with a header, every column a string, empty fields null."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("nullValue", "").option("multiLine", True).csv(path)


def check_columns(columns: Sequence[str], required: Sequence[str], path: str = "") -> list[str]:
    """The columns beyond those required; an error if one of these is missing."""
    if missing := [c for c in required if c not in columns]:
        raise KeyError(f"{path} lacks the columns {missing}")
    return [c for c in columns if c not in required]


def read_directory(spark: SparkSession, paths: Sequence[str], required: Sequence[str], sep: str = ",") -> DataFrame:
    """The union of checked files, required columns first, further ones after them; those that a file lacks are null."""
    out: DataFrame | None = None
    for path in paths:
        df = read_text_table(spark, path, sep)
        extra = check_columns(df.columns, required, path)
        df = df.select(*required, *extra)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in required]))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def removed_quietly(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the process ends; the session may have been stopped before."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_crosswalk(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Distinct rows of a pipe-delimited file, its declared columns only; an empty table if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = read_text_table(spark, path, "|")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]).distinct()


def walk(spark: SparkSession, root: str, ignore: Sequence[str] = (), glob: str | None = None) -> DataFrame:
    """path, mtime and size of all files under root whose path contains none of ignore; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = reader.load(root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    for word in ignore:
        out = out.where(~F.col("path").contains(word))
    return out


def latest_file(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "") -> str | None:
    name = F.element_at(F.split("path", "/"), -1)
    files = walk(spark, folder).where(name.startswith(prefix) & name.endswith(suffix))
    return files.agg(F.max_by("path", F.struct("mtime", "path"))).first()[0]


def python_files(spark: SparkSession, root: str, tests: bool) -> DataFrame:
    """Paths of Python files under root: tests (test_*.py, *_test.py) or, without them and __init__.py, the rest."""
    name = F.element_at(F.split("path", "/"), -1)
    is_test = name.rlike(r"^test_.*\.py$|_test\.py$")
    skip = F.col("path").rlike(r"/(\.git|\.venv|venv|node_modules|__pycache__|build|dist)/")
    files = walk(spark, root, glob="*.py").where(~skip)
    return files.where(is_test if tests else ~is_test & (name != "__init__.py")).orderBy("path")


def write_text_table(df: DataFrame, path: str, kind: str = "csv", sep: str | None = None) -> None:
    """df as a separated file of kind csv, tsv, ttxt, psv or ptxt with a header, or as parquet."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind in SEPARATORS:
        df.write.mode("overwrite").option("header", True).option("sep", sep or SEPARATORS[kind]).csv(path)
    else:
        raise ValueError(f"unknown file kind: {kind}")


def convert(spark: SparkSession, source: str, kind: str, target: str, source_kind: str = "csv") -> str:
    """Writes the table source, of one of SEPARATORS' kinds or Parquet, as another kind, Parquet by snappy, and gives
    the folder that holds it: target, or source for a kind that isn't known. The source stays until the caller removes
    it."""
    if kind != "parquet" and kind not in SEPARATORS:
        return source
    rows = spark.read.parquet(source) if source_kind == "parquet" else read_text_table(spark, source, SEPARATORS[source_kind])
    write_text_table(rows, target, kind)
    return target


#: Readers of tables by the ending of a file's name; loader() adds to them.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{kind: partial(lambda sep, spark, path: read_text_table(spark, path, sep), sep) for kind, sep in SEPARATORS.items()},
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
    "jsonl": lambda spark, path: spark.read.json(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "txt": lambda spark, path: spark.read.text(path),
}


def loader(ending: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers a reader for an ending, in place of the one that there is."""

    def add(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        LOADERS[ending.lower().lstrip(".")] = read
        return read

    return add


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by the reader of its ending."""
    ending = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    if ending not in LOADERS:
        raise ValueError(f"no reader for {path}: one of {sorted(LOADERS)}")
    return LOADERS[ending](spark, path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; across file systems it is copied and then removed. The target must not be there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(target)
    of_old, of_new = old.getFileSystem(conf), new.getFileSystem(conf)
    if of_new.exists(new):
        raise FileExistsError(target)
    of_new.mkdirs(new.getParent())
    if of_old.getUri().equals(of_new.getUri()):
        done = of_old.rename(old, new)
    else:
        done = hadoop.FileUtil.copy(of_old, old, of_new, new, True, conf)
    if not done:
        raise OSError(f"{source} could not be moved to {target}")


def write_tokens(frames: Sequence[DataFrame], folder: str, prefix: str, suffix: str, kind: str = "csv") -> str | None:
    """All frames as one pipe-delimited table, prefix_suffix.kind; nothing, and no path, if there are no frames."""
    if not frames:
        return None
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    path = f"{folder}/{prefix}_{suffix}.{kind}"
    write_text_table(out, path, "csv", "|")
    return path


def write_masked(df: DataFrame, folder: str, prefix: str, suffix: str, kind: str = "csv") -> str | None:
    """A masked table as write_tokens() writes it; nothing if it is empty."""
    return write_tokens([df], folder, prefix, suffix, kind) if df.limit(1).count() else None


#: Columns of the tables that a detokenizer reads from its master folder.
MASTER = {
    "donotmerge": "tokenid string, insertdate timestamp",
    "detoken_crosswalk": "detokenid string, token_hash string, token_order int",
    "token_crosswalk": "tokenid string, detokenid string, startdate timestamp, enddate timestamp",
    "merge_history": "tokenid string, old_detokenid string, new_detokenid string, merge_dt timestamp",
    "final_crosswalk": "detokenid string, id string",
}


def detokenizer_tables(spark: SparkSession, output: str, master: str, prefix: str, recipes: Sequence[tuple]) -> dict[str, DataFrame]:
    """What a detokenizer works on: the latest token table under output whose name begins with prefix, the recipes
    (name, version, family) and the tables of MASTER, empty where there is no file."""
    latest = latest_table(spark, output, prefix)
    if latest is None:
        raise FileNotFoundError(f"no {prefix}* in {output}")
    out = {"token": read_text_table(spark, latest, "|"), "tokencfg": spark.createDataFrame(list(recipes), "token_name string, token_version string, token_family string")}
    for name, columns in MASTER.items():
        out[name] = read_crosswalk(spark, f"{master}/{name}.csv", T.StructType.fromDDL(columns))
    return out


def latest_table(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The file or folder of a table in folder that begins with prefix and was changed last; of equal times the last
    by name."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(root) if s.getPath().getName().startswith(prefix)]
    return max(found)[1] if found else None


def random_record(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(1)


def sitemap_locations(pages: DataFrame, xml: str, *keep: str) -> DataFrame:
    """A row per location of the sitemaps in a column, whatever their namespace, with the columns to keep."""
    return pages.select(*keep, F.explode(F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))).alias("url"))


def source_kind(url):
    """txt, sitemap or page."""
    return F.when(F.lower(url).endswith(".txt"), "txt").when(F.lower(url).endswith("sitemap.xml"), "sitemap").otherwise("page")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def html_table(df: DataFrame, most: int = 1000) -> str:
    """The first rows as an HTML table, for reports; most bounds what reaches the driver."""
    escape = lambda v: "" if v is None else str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values) + "</tr>"
    return "<table>" + row("th", df.columns) + "".join(row("td", r) for r in df.limit(most).collect()) + "</table>"


def merged_tables(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    """All tables of a folder as one, columns by name, with the file that each row is from."""
    paths = [r["path"] for r in walk(spark, folder, glob="*.csv").orderBy("path").collect()]
    out = read_directory(spark, paths, [], sep)
    return out if paths else spark.createDataFrame([], "value string")
