"""Sinks: Parquet, CSV, JSON lines, append logs, manifests, Markdown and workbooks."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested cells as JSON text, arrays of strings joined by semicolons."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        flat.append((F.array_join(c, ";") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "map", "struct")) else c).alias(f.name))
    df.select(*flat).write.mode(mode).csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", gzip: bool = False) -> None:
    df.write.mode(mode).json(path, compression="gzip" if gzip else "none")


def append_log(df: DataFrame, path: str) -> None:
    """Adds records to an append-only log; each call adds files, none is changed."""
    df.write.mode("append").json(path)


def content_digest(df: DataFrame) -> str:
    """16 hex digits that depend on the rows but not on their order or files."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    n, total, odd = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).head()
    return hashlib.sha256(f"{n}:{total}:{odd}".encode()).hexdigest()[:16]


def manifest(splits: dict[str, DataFrame], variant: str = "variant_type", **facts: object) -> dict:
    """Counts by split and variant, exclusions, flags and digests; only small aggregates reach the driver."""
    out: dict = {**facts, "counts": {}, "digest": {}}
    for name, df in splits.items():
        by = {r[0]: r[1] for r in df.groupBy(variant).count().collect()}
        out["counts"][name] = {"total": sum(by.values()), **dict(sorted(by.items(), key=lambda x: (-x[1], str(x[0]))))}
        out["digest"][name] = content_digest(df)
        if "reason" in df.columns:
            out.setdefault("exclusions", {}).update({r[0]: r[1] for r in df.where("reason <> ''").groupBy("reason").count().collect()})
    return out


def to_json(value: dict) -> str:
    return json.dumps(value, indent=1, ensure_ascii=False, default=str)


def small(df: DataFrame, limit: int) -> list:
    """All rows of a result for the driver, which must not have more than limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; aggregate first, or raise the limit")
    return rows


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small result; fails where that has over limit rows."""
    rows = small(df, limit)
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def sheet_xml(columns: list[str], rows: Iterable) -> Iterator[str]:
    """The XML of a sheet, row by row."""
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    # control characters can't stand in XML at all
    shown = lambda x: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "\ufffd", x))

    def cell(x: object) -> str:
        if x is None or isinstance(x, float) and not math.isfinite(x):
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{shown(x if isinstance(x, str) else str(x))}</t></is></c>'

    for r in ([columns], rows):
        for values in r:
            yield f"<row>{''.join(map(cell, values))}</row>"
    yield "</sheetData></worksheet>"


#: Rows that a sheet of a workbook can hold, its head among them.
SHEET_ROWS = 1 << 20


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table, in their order. Rows go from the cluster into the file as a stream, a partition at a time, so the driver holds no table; what one sheet can't hold goes on in others (name, name 2, ...). A table without columns is a sheet that says so."""
    main, office = "http://schemas.openxmlformats.org", "officeDocument/2006/relationships"
    names: list[str] = []

    def put(book: zipfile.ZipFile, name: str, columns: list[str], rows: Iterator) -> bool:
        names.append(name)
        n = 0

        def counted() -> Iterator:
            nonlocal n
            for r in itertools.islice(rows, SHEET_ROWS - 1):
                n += 1
                yield r

        with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
            for part in sheet_xml(columns, counted()):
                f.write(part.encode())
        return n == SHEET_ROWS - 1

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, df in sheets.items():
            columns = df.columns or ["note"]
            rows = iter(df.toLocalIterator()) if df.columns else iter([["no rows"]])
            part, base = 1, re.sub(r"[\[\]:*?/\\]", "_", name)
            while put(book, base[:31] if part == 1 else f"{base[:26]} {part}", columns, rows):
                first = next(rows, None)
                if first is None:
                    break
                rows, part = itertools.chain([first], rows), part + 1
        tag = lambda k, n: f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>'
        listed = list(enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/{office}"><sheets>{"".join(tag(k, n) for k, n in listed)}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{main}/{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in listed) + "</Relationships>")
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r0" Type="{main}/{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k, _ in listed) + "</Types>")
