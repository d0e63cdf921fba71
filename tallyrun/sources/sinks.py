"""Results as files.  Parquet is for data of any size; single CSV, JSON and text files are for exports that people read."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.scalars import file_slug


def prepare_folder(folder: str, source: str | None = None) -> Path:
    """Empty an output folder, but never the input, the working folder, a parent of either, or a root."""
    out = Path(folder).resolve()
    kept = [Path.cwd().resolve(), *([Path(source).resolve()] if source else [])]
    if out == Path(out.anchor) or any(out in (k, *k.parents) for k in kept):
        raise ValueError(f"{out} will not be overwritten")
    shutil.rmtree(out, ignore_errors=True)
    out.mkdir(parents=True)
    return out


def save_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    (df.write.mode("overwrite").partitionBy(*partitions) if partitions else df.write.mode("overwrite")).parquet(path)


def _single_file(df: DataFrame, path: str, **options: object) -> None:
    part = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", **options).csv(part)
    found = next(Path(part).glob("part-*.csv"), None)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if found:
        shutil.move(str(found), path)
    else:
        Path(path).write_text(",".join(df.columns) + "\n", encoding="utf-8")
    shutil.rmtree(part)


def save_csv(df: DataFrame, path: str, order: Sequence[str] = (), quoted: bool = False) -> None:
    """One CSV file with a header, rows in the given order; ``quoted`` quotes every field."""
    rows = df.orderBy(*order) if order else df
    _single_file(rows, path, quoteAll=quoted)


def save_tables(tables: dict[str, DataFrame], folder: str, source: str | None = None) -> dict[str, int]:
    """One CSV file per table; rows written per table, observed while writing."""
    from pyspark.sql import Observation

    out, counts = prepare_folder(folder, source), {}
    for name, df in tables.items():
        seen = Observation(f"rows_{name}")
        save_csv(df.observe(seen, F.count(F.lit(1)).alias("n")), str(out / f"{name}.csv"))
        counts[name] = seen.get["n"]
    return counts


def rows_as_json(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, one partition at a time."""
    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield json.loads(r["j"])


def save_json_array(df: DataFrame, path: str) -> int:
    """A JSON array, written row by row as it arrives."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(rows_as_json(df), 1):  # noqa: B007
            f.write(("," if n > 1 else "") + "\n  " + json.dumps(row, ensure_ascii=False))
        f.write("\n]\n" if n else "]\n")
    return n


def document_name(c: Column) -> Column:
    """File name of a question's document, without its ending."""
    return F.coalesce(F.nullif(file_slug(c), F.lit("")), F.lit("question"))


def save_documents(df: DataFrame, folder: str, key: str) -> int:
    """One pretty JSON file per row, named by its key; rows arrive one partition at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for n, row in enumerate(rows_as_json(df.withColumn("_file", document_name(F.col(key)))), 1):  # noqa: B007
        name = row.pop("_file")
        (Path(folder) / f"{name}.json").write_text(json.dumps(row, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return n


def save_lines(path: str, parts: Iterable[str]) -> None:
    """Text written as it arrives; it ends with one line break."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        held = ""
        for part in parts:
            text = held + part
            kept = text.rstrip()
            f.write(kept)
            held = text[len(kept) :]
        f.write("\n")


def save_text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def csv_field(c: Column) -> Column:
    """One CSV field, quoted where it must be."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])


def csv_text(columns: Sequence[str], order: Column) -> Column:
    """Aggregate: header and rows as CSV text, in order, without a last line break."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), csv_line(columns).alias("l")))), lambda x: x["l"])
    return F.concat_ws("\n", F.lit(",".join(columns)), F.array_join(lines, "\n"))
