"""Files as sources: CSV scans that keep every text, JSON documents, archives, and where to look for a file."""

from __future__ import annotations

import re
import shutil
import tarfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrun.functions.scalars import numeric_first
from tallyrun.plans.catalog import ALIASES, COLUMNS

#: No text of a CSV file equals this, so that the literal NULL and blanks stay what they are.
NOTHING = "\x00"


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: columns {missing} are missing; there are {df.columns}")
    return df


def pick_column(df: DataFrame, candidates: Sequence[str], name: str, meaning: str) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"{name}: no column for {meaning}; there are {df.columns}")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, index: bool = False) -> DataFrame:
    """All-text scan with RFC 4180 quotes; ``index`` adds ``row_index``, the place in the file from 0."""
    if not Path(path).exists() and "://" not in path:
        raise FileNotFoundError(path)
    reader = spark.read.options(header=True, escape='"', nullValue=NOTHING, emptyValue="", multiLine=True, encoding="UTF-8")
    df = require_columns(reader.csv(path), columns or (), path)
    names = list(columns or df.columns)
    return (with_row_index(df) if index else df).select(*names, *(["row_index"] if index else [])).na.fill("", names)


def with_row_index(df: DataFrame) -> DataFrame:
    """``row_index`` in file order without sorting rows: splits are counted, each row adds its place in its split."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = placed.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = placed.join(splits, ["_f", "_b"])
    return out.withColumn("row_index", F.col("_before") + F.col("_m") - F.col("_low")).drop("_f", "_b", "_m", "_n", "_low", "_before")


def table_name(name: str) -> str:
    return ALIASES.get(name.strip(), name.strip())


def csv_paths(folder: str) -> list[Path]:
    """Known tables first, then other CSV files by name."""
    root = Path(folder)
    known = [root / f"{n}.csv" for n in COLUMNS if (root / f"{n}.csv").exists()]
    return known + sorted(p for p in root.glob("*.csv") if p not in known)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight tables of a folder of CSV files, with ``row_index``."""
    return {n: read_csv(spark, str(Path(folder) / f"{n}.csv"), index=True) for n in COLUMNS}


def first_existing(candidates: Sequence[Path], what: str) -> Path:
    for p in candidates:
        if p.exists():
            return p
    raise FileNotFoundError(f"{what}: none of {[str(p) for p in candidates]}")


def questions_path(root: str, level: str) -> Path:
    r = Path(root)
    return first_existing([r / f"{level}.json", r / f"{level}_questions.json", r / level / "questions.json", r / level / f"{level}.json"], f"questions of {level}")


def capitals_path(folder: str, names: Sequence[str], earlier_output: str | None = None) -> Path:
    """The capitals' file by its known names, else any ``*capital*.csv``, else an earlier output."""
    root = Path(folder)
    others = sorted(root.glob("*capital*.csv"))
    extra = [Path(earlier_output) / "countries.csv"] if earlier_output else []
    return first_existing([*[root / n for n in names], *others, *extra], "capital cities")


def read_json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one per file: ``question_id`` (else the file's stem), the path, and the fields.

    Documents that are no objects are left out; of several with one id the last file by path holds.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"))
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    parsed = raw.filter(F.col("value").rlike(r"^\s*\{")).select("path", stem.alias("stem"), F.from_json("value", schema).alias("doc"))
    parsed = parsed.filter("doc IS NOT NULL").select("path", F.coalesce(F.nullif(F.col("doc.question_id").cast("string"), F.lit("")), "stem").alias("question_id"), "doc")
    w = Window.partitionBy("question_id").orderBy(F.desc("path"))
    return parsed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array as rows, with their place ``pos``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.posexplode(F.from_json("value", f"array<{schema}>")).alias("pos", "r"))
    return parsed.select("pos", "r.*")


def common_folders(left: str, right: str, pattern: str = "*") -> list[str]:
    """Sub-folders that both roots have, ``level_N`` in order of N."""
    names = [{p.name for p in Path(r).glob(pattern) if p.is_dir()} for r in (left, right)]
    number = lambda n: (0, int(m[1]), n) if (m := re.search(r"(\d+)$", n)) else (1, 0, n)
    return sorted(names[0] & names[1], key=number)


def _inside(root: Path, member: str) -> Path:
    target = (root / member).resolve()
    if root.resolve() not in [target, *target.parents]:
        raise ValueError(f"archive member {member!r} leaves {root}")
    return target


def extract_archive(archive: str, folder: str) -> None:
    """Unpack zip or tar; members that would leave the folder, and links, are refused."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for m in z.namelist():
                _inside(root, m)
            z.extractall(root)
        return
    with tarfile.open(archive) as t:
        for m in t.getmembers():
            _inside(root, m.name)
            if m.issym() or m.islnk():
                raise ValueError(f"archive member {m.name!r} is a link")
        t.extractall(root, filter="data")


def install(source: str, folder: str) -> None:
    """Bring a download in place: a folder is copied, an archive unpacked, any other file copied."""
    src, dst = Path(source), Path(folder)
    if src.is_dir():
        shutil.copytree(src, dst, dirs_exist_ok=True)
    elif zipfile.is_zipfile(src) or tarfile.is_tarfile(src):
        extract_archive(source, folder)
    else:
        dst.mkdir(parents=True, exist_ok=True)
        shutil.copy2(src, dst / src.name)


def ids_in_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*numeric_first(F.col(column)))
